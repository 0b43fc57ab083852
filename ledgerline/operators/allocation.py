"""Weights over (symbol, session): membership, capacity, capped budgets, portfolio scaling and bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.panel import by_symbol
from ledgerline.operators.rolling import full, realized_volatility, trailing


def membership(panel: DataFrame, field: str = "turnover", window: int = 63, floor: float = 0.0, history: int = 315, lag: int = 1) -> DataFrame:
    """Adds ``member``: rolling median of the field at least ``floor`` and at least ``history`` quoted rows, both ``lag`` rows before; else false."""
    median = full(F.percentile(F.coalesce(F.col(field), F.lit(0.0)), 0.5), F.lit(1), trailing(window), window)
    age = F.count(field).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))
    out = panel.withColumn("member", F.coalesce((median >= floor) & (age >= history), F.lit(False)))
    return out.withColumn("member", F.lag("member", lag, False).over(by_symbol()))


def capacity(panel: DataFrame, field: str = "turnover", limit: float = 0.02, window: int = 63, lag: int = 1) -> DataFrame:
    """Adds ``median`` (rolling, ``lag`` rows before; null as 0) and ``capacity``, its share that may be traded."""
    median = full(F.percentile(F.coalesce(F.col(field), F.lit(0.0)), 0.5), F.lit(1), trailing(window), window)
    out = panel.withColumn("median", median).withColumn("median", F.lag("median", lag).over(by_symbol()))
    return out.withColumn("capacity", F.col("median") * limit)


def trade_bounds(panel: DataFrame, limit: float = 0.1, window: int = 60, whole: bool = True) -> DataFrame:
    """Adds ``rebalance_bound`` and ``session_bound``: the share ``limit`` of the median volume before the row and of its own volume, in whole contracts if ``whole``; and ``bound``, the smaller.

    A missing volume (null or NaN) counts as 0, and so does an infinite one for its own session; without a full window before it the rebalance has no bound yet (null), and neither has the row.
    """
    out = panel.withColumn("__volume", F.when(~F.isnan("volume"), F.col("volume")))
    out = capacity(out, "__volume", limit, window).withColumnsRenamed({"capacity": "rebalance_bound"}).drop("median")
    out = out.withColumn("session_bound", F.when(F.abs("__volume") < float("inf"), F.col("__volume") * limit).otherwise(0.0)).drop("__volume")
    if whole:
        out = out.withColumns({c: F.floor(c).cast("double") for c in ("rebalance_bound", "session_bound")})
    return out.withColumn("bound", F.when(F.col("rebalance_bound").isNotNull(), F.least("rebalance_bound", "session_bound")))


def cap_and_normalise(rows: DataFrame, raw: str, cap: float, out: str = "budget") -> DataFrame:
    """Adds shares of one per session in proportion to ``raw``, none above ``cap``; what a capped symbol gives up goes to the others.

    Negative, null and NaN count as 0; if all positive ones are at the cap, the
    sum stays below one.  In falling order of raw, the share is min(cap, level x
    raw) with the first level (1 - k cap) / (sum of raw from k on) that keeps
    the next symbol below the cap: the limit of passes that hand on what exceeds
    the cap.
    """
    size = F.when(F.isnan(raw) | F.col(raw).isNull() | (F.col(raw) < 0), 0.0).otherwise(F.col(raw).cast("double"))
    rows = rows.withColumn("__size", size)
    if cap >= 1.0:
        total = F.sum("__size").over(Window.partitionBy("session"))
        return rows.withColumn(out, F.coalesce(F.try_divide(F.col("__size"), total), F.lit(0.0))).drop("__size")
    falling = Window.partitionBy("session").orderBy(F.desc("__size"), "symbol")
    rows = rows.withColumn("__k", F.row_number().over(falling) - 1).withColumn("__rest", F.sum("__size").over(falling.rowsBetween(0, Window.unboundedFollowing)))
    level = F.try_divide(1 - F.col("__k") * cap, F.col("__rest"))
    fits = (F.col("__size") > 0) & (level * F.col("__size") <= cap + 1e-15)
    rows = rows.withColumn("__level", F.when(fits, F.struct(F.col("__k").alias("k"), level.alias("level"))))
    first = F.min("__level").over(Window.partitionBy("session"))["level"]
    share = F.when(F.col("__size") > 0, F.least(F.lit(cap), F.coalesce(F.col("__first") * F.col("__size"), F.lit(cap)))).otherwise(0.0)
    return rows.withColumn("__first", first).withColumn(out, share).drop("__size", "__k", "__rest", "__level", "__first")


def desired_weights(panel: DataFrame, cap: float = 0.4, vol_window: int = 63, vol_floor: float = 0.01, book_window: int = 126, budget: float = 0.1, high: float = 1.0, gate: str | None = None) -> DataFrame:
    """(symbol, session, weight, scale, cash) of (symbol, session, ret, member): inverse-volatility budgets under a cap, gated, scaled by the book's own volatility.

    A symbol without an estimate of volatility (one row before) has no budget.
    The scale is budget over the volatility of the unscaled book, at most
    ``high``; 0 until that is known.  Cash takes the rest of one.
    """
    rows = realized_volatility(panel, vol_window, demean=True, lag=1)
    rows = rows.withColumn("__raw", F.when(F.col("member") & F.col("vol").isNotNull(), 1 / F.greatest(F.col("vol"), F.lit(vol_floor))).otherwise(0.0))
    rows = cap_and_normalise(rows, "__raw", cap, "__budget")
    if gate:
        rows = rows.withColumn("__budget", F.when(F.coalesce(F.col(gate), F.lit(False)), F.col("__budget")).otherwise(0.0))
    rows = rows.withColumn("__before", F.coalesce(F.lag("__budget").over(by_symbol()), F.lit(0.0)))
    book = rows.groupBy("session").agg(F.sum(F.col("__before") * F.coalesce("ret", F.lit(0.0))).alias("ret")).withColumn("symbol", F.lit("book"))
    first = F.row_number().over(by_symbol()) == 1
    vol = realized_volatility(book.withColumn("ret", F.when(~first, F.col("ret"))), book_window, lag=1)
    scale = F.coalesce(F.when(F.col("vol") > 0, F.least(F.lit(high), budget / F.col("vol"))), F.lit(0.0))
    joined = rows.select("symbol", "session", "__budget").join(vol.select("session", scale.alias("scale")), "session")
    joined = joined.withColumn("weight", F.col("__budget") * F.col("scale"))
    return joined.withColumn("cash", 1 - F.sum("weight").over(Window.partitionBy("session"))).select("symbol", "session", "weight", "scale", "cash")


def banded_hold(rows: DataFrame, band: float) -> DataFrame:
    """Adds ``hold`` to (want, held): held inside the band, else want less the band on the side it comes from."""
    gap = F.col("want") - F.col("held")
    return rows.withColumn("hold", F.when(F.abs(gap) < band, F.col("held")).otherwise(F.col("want") - F.signum(gap) * band))


def scaled_to_volatility(decisions: DataFrame, monthly: DataFrame, months: int = 36, instrument: float = 0.4, target: float = 0.1) -> DataFrame:
    """Weights of (symbol, month, signal, vol) scaled so that the trailing covariance of ``monthly`` (symbol, month, ret) gives the target volatility.

    w'Cw is the variance over the months of the weighted sum of returns, so no
    matrix is made.  Only symbols with a signal, a volatility and all of the
    last ``months`` months take part; a month with fewer than two is left out.
    """
    monthly = monthly.withColumn("__m", F.year("month") * 12 + F.month("month")).select("symbol", F.col("__m").alias("__of"), "ret")
    live = decisions.filter(F.col("signal").isNotNull() & (F.col("vol") > 0)).withColumn("__m", F.year("month") * 12 + F.month("month"))
    held = live.join(monthly, "symbol").filter((F.col("__of") <= F.col("__m")) & (F.col("__of") > F.col("__m") - months))
    whole = held.withColumn("__n", F.count("ret").over(Window.partitionBy("symbol", "month"))).filter(F.col("__n") == months)
    counted = whole.withColumn("__live", F.count(F.lit(1)).over(Window.partitionBy("month", "__of"))).filter("__live >= 2")
    raw = counted.withColumn("raw", F.col("signal") * instrument / F.col("vol") / F.col("__live"))
    by_month = raw.groupBy("month", "__of").agg(F.sum(F.col("raw") * F.col("ret")).alias("__r"))
    ex_ante = by_month.groupBy("month").agg(F.sqrt(F.var_samp("__r") * 12).alias("ex_ante")).filter("ex_ante > 0")
    own = raw.select("symbol", "month", "raw", F.col("__live").alias("live")).distinct()
    return own.join(ex_ante, "month").select("symbol", "month", "live", "ex_ante", (F.col("raw") * target / F.col("ex_ante")).alias("weight"))


def fixed_weights(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Adds ``weight`` (the symbol's constant one while it is a ``member``, else 0) and ``cash``, the rest of one in its session."""
    given = F.coalesce(*(F.when(F.col("symbol") == s, F.lit(float(w))) for s, w in weights.items()), F.lit(0.0))
    out = rows.withColumn("weight", F.when(F.col("member"), given).otherwise(0.0))
    return out.withColumn("cash", 1 - F.sum("weight").over(Window.partitionBy("session")))


def equal_weights(rows: DataFrame) -> DataFrame:
    """Adds ``equal``: one over the number of members of the session; 0 for others."""
    many = F.count_if("member").over(Window.partitionBy("session"))
    return rows.withColumn("equal", F.when(F.col("member"), 1.0 / many).otherwise(0.0))
