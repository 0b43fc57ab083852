"""Path metrics, drawdowns and regime reports over (member, session, ret) or labelled rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.columns import elapsed_years, grown


def path_rows():
    """Rows of a member in session order."""
    return Window.partitionBy("member").orderBy("session")


def so_far():
    return path_rows().rowsBetween(Window.unboundedPreceding, 0)


def wealth(paths: DataFrame) -> DataFrame:
    """Adds nav (from 1; 0 once all is lost), peak (at least the initial 1) and drawdown."""
    out = paths.withColumn("nav", grown("ret", so_far()))
    out = out.withColumn("peak", F.greatest(F.lit(1.0), F.max("nav").over(so_far())))
    return out.withColumn("drawdown", F.col("nav") / F.col("peak") - 1)


def lagged(rows: DataFrame, lags: int) -> DataFrame:
    """Adds the member's earlier values of ret, for ``autocovariances``."""
    return rows.select("*", *(F.lag("ret", k).over(path_rows()).alias(f"__l{k}") for k in range(1, lags + 1)))


def autocovariances(lags: int) -> tuple[list[Column], Column]:
    """Aggregates over ``lagged`` rows, and from them (with columns n and mean) the Bartlett-weighted sum of products of deviations.

    The mean is taken out afterwards, so no row waits for its member's mean.
    """
    parts = [F.sum(F.col("ret") * F.col("ret")).alias("__p0")]
    total = F.col("__p0") - F.col("n") * F.col("mean") * F.col("mean")
    for k in range(1, lags + 1):
        lag = F.col(f"__l{k}")
        parts += [F.sum(F.col("ret") * lag).alias(f"__p{k}"), F.sum(F.when(lag.isNotNull(), F.col("ret") + lag)).alias(f"__s{k}")]
        product = F.col(f"__p{k}") - F.col("mean") * F.col(f"__s{k}") + (F.col("n") - k) * F.col("mean") * F.col("mean")
        total = total + 2 * (1 - k / (lags + 1)) * F.coalesce(product, F.lit(0.0))
    return parts, total


def path_metrics(paths: DataFrame, start: str | None = None, end: str | None = None, periods: int = 252, lags: int = 21) -> DataFrame:
    """One row per member over the sessions from ``start`` to ``end``.

    Growth is annualised by the calendar time since the session before the
    window (or its first, if there is none); Sharpe ratios with the plain, the
    monthly and the Newey-West deviation; tails, moments, drawdown and the best
    and worst runs.  A drawdown within rounding of 0 ends a spell.  Figures that are not defined are null.  Sessions without a
    return are left out.
    """
    rows = paths.withColumn("__from", F.coalesce(F.lag("session").over(path_rows()), F.col("session")))
    for edge, keep in ((start, F.col("session") >= F.lit(start)), (end, F.col("session") <= F.lit(end))):
        rows = rows.filter(keep) if edge else rows
    rows = rows.filter("ret IS NOT NULL")
    cut = rows.groupBy("member").agg(F.percentile("ret", 0.05).alias("__cut"))
    tail = rows.join(cut, "member").groupBy("member").agg((-F.first("__cut")).alias("var95"), (-F.avg(F.when(F.col("ret") <= F.col("__cut"), F.col("ret")))).alias("cvar95"))
    months = monthly_returns(rows).groupBy("member").agg(F.when(F.stddev_samp("ret") > 0, F.avg("ret") / F.stddev_samp("ret") * 12**0.5).alias("monthly_sharpe"), F.avg((F.col("ret") > 0).cast("double")).alias("positive_months"), F.max("ret").alias("best_month"), F.min("ret").alias("worst_month"))

    out = wealth(rows).withColumn("__i", F.row_number().over(path_rows()))
    out = out.withColumn("__streak", F.col("__i") - F.coalesce(F.max(F.when(~(F.col("drawdown") < -1e-12), F.col("__i"))).over(so_far()), F.lit(0)))
    for k in (5, 21):
        frame = path_rows().rowsBetween(-(k - 1), 0)
        out = out.withColumn(f"__w{k}", F.when(F.count("ret").over(frame) == k, grown("ret", frame) - 1))
    frame = path_rows().rowsBetween(-62, 0)
    out = out.withColumn("__v63", F.when(F.count("ret").over(frame) == 63, F.stddev_samp("ret").over(frame)))
    n, sd, mean, root = F.count("ret"), F.stddev_samp("ret"), F.avg("ret"), periods**0.5
    down = F.sqrt(F.avg(F.pow(F.least("ret", F.lit(0.0)), 2)))
    lost = -F.sum(F.when(F.col("ret") < 0, F.col("ret")))
    later = F.when(F.col("__l1").isNotNull(), F.col("ret"))
    products, long_run = autocovariances(lags)
    figures = lagged(out, lags).groupBy("member").agg(
        n.alias("n"), F.min("__from").alias("period_start"), elapsed_years(F.min("__from"), F.max("session")).alias("years"), grown("ret").alias("__grown"), (sd * root).alias("vol"), (F.try_divide(mean, F.nullif(sd, F.lit(0.0))) * root).alias("sharpe"), mean.alias("mean"),
        F.when(down > 0, mean * periods / (down * root)).alias("sortino"), (down * root).alias("downside"), F.when(lost > 0, F.sum(F.when(F.col("ret") > 0, F.col("ret")).otherwise(0.0)) / lost).alias("profit_factor"), F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"),
        F.when(n > 2, F.skewness("ret") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"), F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis("ret") + 6)).alias("excess_kurtosis"), F.when(n > 2, F.try_divide(F.covar_pop(later, "__l1"), F.nullif(F.stddev_pop(later) * F.stddev_pop("__l1"), F.lit(0.0)))).alias("autocorrelation"),
        F.min("drawdown").alias("max_drawdown"), F.max("__streak").alias("max_duration"), F.max("ret").alias("best_day"), F.min("ret").alias("worst_day"), F.min("__w5").alias("worst_5"), F.min("__w21").alias("worst_21"), (F.max("__v63") * root).alias("peak_vol"), *products,
    )
    cagr = F.pow("__grown", 1 / F.col("years")) - 1
    variance = long_run / (F.col("n") - 1)
    figures = figures.withColumn("cagr", cagr).withColumn("calmar", F.when(F.col("max_drawdown") < 0, F.col("cagr") / -F.col("max_drawdown"))).withColumn("hac_sharpe", F.when((F.col("n") > lags) & (variance > 0), F.col("mean") / F.sqrt(variance) * root))
    kept = [c for c in figures.columns if not c.startswith("__")]
    return figures.select(kept).join(tail, "member").join(months, "member")


def loss_shape(paths: DataFrame, periods: int = 252) -> DataFrame:
    """Drawdown to volatility, ulcer and pain index, worst 21 and 63 sessions per member."""
    rows = wealth(paths)
    for k in (21, 63):
        frame = path_rows().rowsBetween(-(k - 1), 0)
        rows = rows.withColumn(f"__w{k}", F.when(F.count("ret").over(frame) == k, grown("ret", frame) - 1))
    return rows.groupBy("member").agg(
        F.try_divide(F.min("drawdown"), F.stddev_samp("ret") * periods**0.5).alias("drawdown_to_vol"), F.sqrt(F.avg(F.pow("drawdown", 2))).alias("ulcer"), F.avg(-F.col("drawdown")).alias("pain"), F.min("__w21").alias("worst_21"), F.min("__w63").alias("worst_63")
    )


def drawdown_episodes(paths: DataFrame, depth: float = 0.02) -> DataFrame:
    """Spells under water deeper than ``depth``: start, trough, end, sessions, recovered."""
    rows = wealth(paths).withColumn("__under", F.col("drawdown") < -1e-12)
    rows = rows.withColumn("__spell", F.sum(F.when(F.col("__under"), 0).otherwise(1)).over(so_far()))
    last = F.max("session").over(Window.partitionBy("member"))
    rows = rows.withColumn("__last", last).filter("__under")
    out = rows.groupBy("member", "__spell").agg(F.min("session").alias("start"), F.min_by("session", F.struct("drawdown", "session")).alias("trough"), F.max("session").alias("end"), F.count(F.lit(1)).alias("sessions"), F.min("drawdown").alias("depth"), (F.max("session") < F.first("__last")).alias("recovered"))
    return out.filter(F.col("depth") < -depth).drop("__spell")


def rescale_frontier(paths: DataFrame, multipliers: list[float]) -> DataFrame:
    """Growth, volatility and drawdown of the paths times each multiplier."""
    scaled = paths.withColumn("multiplier", F.explode(F.array(*map(F.lit, multipliers)))).withColumn("ret", F.col("ret") * F.col("multiplier"))
    by = Window.partitionBy("member", "multiplier").orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    rows = scaled.withColumn("__nav", grown("ret", by))
    rows = rows.withColumn("__dd", F.col("__nav") / F.greatest(F.lit(1.0), F.max("__nav").over(by)) - 1)
    years = elapsed_years(F.min("session"), F.max("session"))
    return rows.groupBy("member", "multiplier").agg((F.pow(grown("ret"), 1 / years) - 1).alias("cagr"), (F.stddev_samp("ret") * 252**0.5).alias("vol"), F.min("__dd").alias("max_drawdown"))


def monthly_returns(paths: DataFrame) -> DataFrame:
    """Compounded return by member and month; null for a month without observation."""
    total = grown("ret") - 1
    return paths.groupBy("member", F.trunc("session", "MM").alias("month")).agg(F.when(F.count("ret") > 0, total).alias("ret"), F.count("ret").alias("n"))


def occupancy(labels: DataFrame, state: str = "state") -> DataFrame:
    """Per symbol and state: sessions, share, number of spells, mean, median and longest spell.  Null labels end a spell and are not counted."""
    by = Window.partitionBy("symbol").orderBy("session")
    rows = labels.withColumn("__new", (~F.col(state).eqNullSafe(F.lag(state).over(by))).cast("int")).withColumn("__run", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    spells = rows.filter(F.col(state).isNotNull()).groupBy("symbol", F.col(state).alias("state"), "__run").agg(F.count(F.lit(1)).alias("n"))
    out = spells.groupBy("symbol", "state").agg(F.sum("n").alias("sessions"), F.count(F.lit(1)).alias("spells"), F.avg("n").alias("mean_spell"), F.percentile("n", 0.5).alias("median_spell"), F.max("n").alias("longest_spell"))
    return out.withColumn("share", F.col("sessions") / F.sum("sessions").over(Window.partitionBy("symbol")))


def transitions(labels: DataFrame, state: str = "state") -> DataFrame:
    """Counts and row probabilities of consecutive labelled sessions per symbol."""
    after = F.lead(state).over(Window.partitionBy("symbol").orderBy("session"))
    counts = labels.select("symbol", F.col(state).alias("from_state"), after.alias("to_state")).dropna().groupBy("symbol", "from_state", "to_state").count().withColumnRenamed("count", "n")
    return counts.withColumn("probability", F.col("n") / F.sum("n").over(Window.partitionBy("symbol", "from_state")))


def risk_share(positions: DataFrame) -> DataFrame:
    """Share of portfolio variance by symbol, cov(contribution, total) / var(total), from (session, symbol, contribution)."""
    total = F.sum("contribution").over(Window.partitionBy("session"))
    return positions.withColumn("total", total).groupBy("symbol").agg(F.try_divide(F.covar_pop("contribution", "total"), F.var_pop("total")).alias("risk_share"), F.avg("contribution").alias("mean_contribution"))


def episode_attribution(episodes: DataFrame, contributions: DataFrame, worst: int = 2) -> DataFrame:
    """Contribution by symbol between start and trough of each episode (member, start, trough), ranked from the worst.

    Episodes are split into calendar years, so that the range join has an equality to be dealt by.
    """
    inside = (F.col("session") >= F.col("start")) & (F.col("session") <= F.col("trough"))
    yearly = episodes.select("member", "start", "trough", F.explode(F.sequence(F.year("start"), F.year("trough"))).alias("__year"))
    dated = contributions.select("session", "symbol", "contribution", F.year("session").alias("__year"))
    sums = yearly.join(dated, "__year").filter(inside).groupBy("member", "start", "symbol").agg(F.sum("contribution").alias("contribution"))
    return sums.withColumn("rank", F.row_number().over(Window.partitionBy("member", "start").orderBy("contribution", "symbol"))).filter(F.col("rank") <= worst)


def rebalance_sessions(panel: DataFrame) -> DataFrame:
    """The first session after each month end of the union calendar."""
    days = panel.select("session").distinct()
    # A row a day.
    before = F.lag("session").over(Window.orderBy("session"))
    return days.withColumn("__b", before).filter(F.trunc("session", "MM") > F.trunc("__b", "MM")).select("session")


def annual_boundaries(panel: DataFrame, first: int, last: int) -> DataFrame:
    """(year, session): the first session of each year from first to last."""
    return panel.groupBy(F.year("session").alias("year")).agg(F.min("session").alias("session")).filter(F.col("year").between(first, last))


def calendar_boundaries(start: str, end: str, step: int = 1) -> list[dt.date]:
    """Year starts strictly inside a span, every ``step`` years."""
    a, b = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    inside = [dt.date(y, 1, 1) for y in range(a.year, b.year + 1) if a < dt.date(y, 1, 1) < b]
    return inside[::step]


def truncation_drift(work: Callable[[DataFrame], DataFrame], panel: DataFrame, cut: Callable[[DataFrame, str], DataFrame], last: str, fields: list[str]) -> DataFrame:
    """(symbol, session, drift, missing) of rows up to ``last``: the largest difference between a computation on the panel as known then and the same rows of the whole computation; 0 if it never looks ahead."""
    whole = work(panel).filter(F.col("session") <= F.lit(last).cast("date")).select("symbol", "session", *(F.col(f).alias(f"__w_{f}") for f in fields))
    known = work(cut(panel, last)).select("symbol", "session", *fields, F.lit(1).alias("__there"))
    both = whole.join(known, ["symbol", "session"], "full_outer")
    apart = [F.when(F.col(f).eqNullSafe(F.col(f"__w_{f}")), 0.0).otherwise(F.coalesce(F.abs(F.col(f) - F.col(f"__w_{f}")), F.lit(float("inf")))) for f in fields]
    return both.select("symbol", "session", F.greatest(F.lit(0.0), *apart).alias("drift"), F.col("__there").isNull().alias("missing"))
