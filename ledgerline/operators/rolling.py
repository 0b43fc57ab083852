"""Rolling operators over (symbol, session): full-window statistics, signals, states and weights.

All windows of a chain share one partitioning by symbol, so a chain costs one
shuffle.  A frame counts only when it holds as many values as it asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.columns import grown
from ledgerline.operators.panel import by_symbol, month_end_rows, project


def full(value: Column, over: str | Column, window, need: int) -> Column:
    """``value`` over the frame, null until the frame has ``need`` values of ``over``."""
    return F.when(F.count(over).over(window) >= need, value.over(window))


def trailing(n: int, skip: int = 0):
    return by_symbol().rowsBetween(-(n - 1) - skip, -skip)


def trend_sign(panel: DataFrame, lookback: int = 252) -> DataFrame:
    """Sign of the price change over ``lookback`` rows."""
    return panel.withColumn("signal", F.signum(F.col("close") - F.lag("close", lookback).over(by_symbol())))


def liquidity_mask(panel: DataFrame, field: str = "volume", window: int = 60, floor: float = 0.0, strict: bool = True, lag: int = 0) -> DataFrame:
    """Rolling median of the field (null as 0) above the floor; ``strict`` compares with >, else >=; lagged rows without a value are false."""
    median = full(F.percentile(F.coalesce(F.col(field), F.lit(0.0)), 0.5), F.lit(1), trailing(window), window)
    ok = F.coalesce(median > floor if strict else median >= floor, F.lit(False))
    out = panel.withColumn("median", median).withColumn("tradeable", ok)
    return out.withColumn("tradeable", F.lag("tradeable", lag, False).over(by_symbol())) if lag else out


def realized_volatility(returns: DataFrame, window: int = 63, periods: int = 252, demean: bool = False, lag: int = 0) -> DataFrame:
    """Annualised root mean square (or population deviation) of the last ``window`` returns."""
    spread = (F.var_pop("ret") if demean else F.avg(F.col("ret") * F.col("ret"))).over(trailing(window))
    out = returns.withColumn("vol", F.when(F.count("ret").over(trailing(window)) >= window, F.sqrt(spread * periods)))
    return out.withColumn("vol", F.lag("vol", lag).over(by_symbol())) if lag else out


def terciles(frame: DataFrame, field: str, history: int | None = 252, need: int = 126) -> DataFrame:
    """Low, Middle or High against the thirds of strictly earlier values; null with too few of them."""
    before = by_symbol().rowsBetween(-history if history else Window.unboundedPreceding, -1)
    cuts = F.when(F.count(field).over(before) >= need, F.percentile(field, F.array(F.lit(1 / 3), F.lit(2 / 3))).over(before))
    out = frame.withColumn("__cuts", cuts)
    label = F.when(F.col(field) <= F.col("__cuts")[0], "Low").when(F.col(field) > F.col("__cuts")[1], "High").otherwise("Middle")
    return out.withColumn("state", F.when(F.col(field).isNotNull() & F.col("__cuts").isNotNull(), label)).drop("__cuts")


def compounded(returns: DataFrame, window: int, need: int, name: str = "momentum") -> DataFrame:
    """Compounded return of the last ``window`` rows with at least ``need`` observations."""
    frame = trailing(window)
    ready = (F.row_number().over(by_symbol()) >= window) & (F.count("ret").over(frame) >= need)
    return returns.withColumn(name, F.when(ready, grown("ret", frame) - 1))


def blended_signs(returns: DataFrame, windows: tuple[int, ...] = (21, 63, 252)) -> DataFrame:
    """Mean of the signs of compounded returns at several horizons; null if any is."""
    for n in windows:
        returns = compounded(returns, n, n, f"__m{n}")
    total = sum((F.signum(f"__m{n}") for n in windows), F.lit(0.0))
    return returns.withColumn("blend", total / len(windows)).drop(*[f"__m{n}" for n in windows])


def time_trend_t(returns: DataFrame, window: int = 252) -> DataFrame:
    """t-statistic of the slope of cumulative log return on time over the window, in closed form from rolling sums."""
    run = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    out = returns.withColumn("__c", F.sum(F.coalesce(F.log1p("ret"), F.lit(0.0))).over(run)).withColumn("__s", F.row_number().over(by_symbol()).cast("double"))
    frame = trailing(window)
    n, s = float(window), F.col("__s")
    mean_t = s - (n - 1) / 2
    out = out.withColumn("__y", F.sum("__c").over(frame)).withColumn("__ty", F.sum(F.col("__s") * F.col("__c")).over(frame)).withColumn("__yy", F.sum(F.col("__c") * F.col("__c")).over(frame))
    stt = n * (n * n - 1) / 12
    sty, syy = F.col("__ty") - mean_t * F.col("__y"), F.col("__yy") - F.col("__y") * F.col("__y") / n
    slope = sty / stt
    error = F.sqrt(F.greatest(syy - slope * sty, F.lit(0.0)) / (n - 2) / stt)
    return out.withColumn("t", F.when(s >= window, F.try_divide(slope, F.when(error > 0, error)))).drop("__c", "__s", "__y", "__ty", "__yy")


def inverse_vol_weights(frame: DataFrame, budget: float = 0.1) -> DataFrame:
    """signal x budget / vol / number of live symbols of the session; live: signal and vol are there and vol > 0."""
    live = F.col("signal").isNotNull() & (F.col("vol") > 0)
    many = F.sum(F.when(live, 1).otherwise(0)).over(Window.partitionBy("session"))
    return frame.withColumn("weight", F.when(live, F.col("signal") * budget / F.col("vol") / many))


def volatility_scale(returns: DataFrame, window: int = 126, budget: float = 0.12, low: float = 0.0, high: float = 2.0, lag: int = 1) -> DataFrame:
    """budget / realised volatility, clipped, ``lag`` rows later."""
    out = realized_volatility(returns, window)
    scale = F.when(F.col("vol") > 0, F.least(F.lit(high), F.greatest(F.lit(low), budget / F.col("vol"))))
    return out.withColumn("scale", F.lag(scale, lag).over(by_symbol()))


def pair_correlation(returns: DataFrame, window: int = 63, symbols: list[str] | None = None) -> DataFrame:
    """Rolling correlation of every pair of symbols (left < right) over shared sessions; null where a side is flat.

    Grows with the square of the number of symbols: pass the symbols wanted.
    """
    if symbols:
        returns = returns.filter(F.col("symbol").isin(symbols))
    a = returns.select("session", F.col("symbol").alias("left"), F.col("ret").alias("x"))
    b = returns.select("session", F.col("symbol").alias("right"), F.col("ret").alias("y"))
    both = a.join(b, "session").filter("left < right AND x IS NOT NULL AND y IS NOT NULL")
    frame = Window.partitionBy("left", "right").orderBy("session").rowsBetween(-(window - 1), 0)
    value = F.try_divide(F.covar_pop("x", "y").over(frame), F.nullif(F.stddev_pop("x").over(frame) * F.stddev_pop("y").over(frame), F.lit(0.0)))
    return both.withColumn("corr", F.when(F.count("x").over(frame) >= window, value)).select("left", "right", "session", "corr")


def moving_average_state(panel: DataFrame, months: int = 10, lag: int = 1) -> DataFrame:
    """Risk-on when the month-end close exceeds the mean of the last ``months`` month ends, projected on sessions."""
    ends = month_end_rows(panel)
    mean = full(F.avg("close"), "close", by_symbol().rowsBetween(-(months - 1), 0), months)
    state = F.when(mean.isNotNull(), F.when(F.col("close") > mean, "Risk-on").otherwise("Risk-off"))
    return project(ends.withColumn("state", state), panel, "state", lag)


def past_return_state(panel: DataFrame, months: int = 24, lag: int = 1, below: str = "Bear", above: str = "Not bear") -> DataFrame:
    """State of the return over ``months`` month ends that ended a month before, projected on sessions."""
    ends = month_end_rows(panel)
    past = F.try_divide(F.lag("close", 1).over(by_symbol()), F.lag("close", months + 1).over(by_symbol())) - 1
    state = F.when(past.isNotNull(), F.when(past < 0, below).otherwise(above))
    return project(ends.withColumn("state", state), panel, "state", lag)


def ewm_volatility(returns: DataFrame, com: float = 60.0, need: int = 20, periods: int = 252) -> DataFrame:
    """Adds ``vol``: exponentially weighted deviation (recursive weights, bias-corrected), annualised.

    Weights decay on null rows too.  The recursion has no built-in form, so each
    symbol's path is folded in a grouped map; a path is the unit of work.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in returns.schema)

    def fold(pdf):
        pdf = pdf.sort_values("session")
        return pdf.assign(vol=pdf["ret"].ewm(com=com, adjust=False, min_periods=need).std() * periods**0.5)

    return returns.groupBy("symbol").applyInPandas(fold, f"{fields}, vol double")


def momentum_state(panel: DataFrame, lookback: int = 252, lag: int = 1) -> DataFrame:
    """Positive or Negative by the sign of the price change over ``lookback`` rows, ``lag`` rows later."""
    sign = trend_sign(panel, lookback)
    state = F.when(F.col("signal") > 0, "Positive").when(F.col("signal") <= 0, "Negative")
    return sign.withColumn("state", F.lag(state, lag).over(by_symbol()))


def mean_correlation(pairs: DataFrame, need: int, lag: int = 1) -> DataFrame:
    """(session, pairs, mean): mean of the pairs' correlations where at least ``need`` are known, ``lag`` sessions later."""
    out = pairs.groupBy("session").agg(F.count("corr").alias("pairs"), F.avg("corr").alias("mean"))
    # One row a session.
    mean = F.lag(F.when(F.col("pairs") >= need, F.col("mean")), lag).over(Window.orderBy("session"))
    return out.withColumn("mean", mean)


def clipped_t(t: Column, at: float) -> Column:
    """t over ``at``, at most 1 either way; null stays null."""
    return F.when(t.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), t / at)))


def threshold_t(t: Column, at: float) -> Column:
    """The sign of t beyond ``at``, 0 inside; null stays null."""
    return F.when(t > at, 1.0).when(t < -at, -1.0).when(t.isNotNull(), 0.0)
