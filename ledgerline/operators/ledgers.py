"""Position ledgers: roll turnover, execution costs, portfolio rows, accounting identities, turnover, exposures and limits.

Markets are rows (symbol, session, close, volume, position, before, gross, ...);
the portfolio has one row a session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.columns import elapsed_years, grown
from ledgerline.operators.panel import by_symbol
from ledgerline.operators.performance import wealth


def roll_turnover(rows: DataFrame) -> DataFrame:
    """Adds ``roll_turnover``: both legs of the contracts held before, on the first tradeable session from a ``roll`` on."""
    past = by_symbol().rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__spell", F.coalesce(F.sum(F.col("tradeable").cast("int")).over(past), F.lit(0)))
    due = F.max(F.col("roll").cast("int")).over(Window.partitionBy("symbol", "__spell")) == 1
    return rows.withColumn("roll_turnover", F.when(F.col("tradeable") & due, 2 * F.abs("before")).otherwise(0.0)).drop("__spell")


def execution_costs(rows: DataFrame, fixed: float = 0.5, impact_bps: float = 10.0, point_value: float = 1.0) -> DataFrame:
    """Adds trade, rebalance, turnover, participation, fixed and impact cost, their sum, and its parts by rebalance and roll turnover.

    Impact is the traded notional times ``impact_bps`` times the root of the
    share of the session's volume.
    """
    rows = rows.withColumn("trade", F.col("position") - F.col("before")).withColumn("rebalance", F.abs("trade")).withColumn("turnover", F.col("rebalance") + F.col("roll_turnover"))
    rows = rows.withColumn("participation", F.try_divide("turnover", "volume"))
    rows = rows.withColumn("fixed", F.col("turnover") * fixed).withColumn("impact", F.col("turnover") * F.abs("close") * point_value * (impact_bps / 1e4) * F.sqrt("participation"))
    rows = rows.withColumn("cost", F.col("fixed") + F.col("impact"))
    part = lambda c: F.when(F.col("turnover") > 0, F.col("cost") * F.col(c) / F.col("turnover")).otherwise(0.0)
    return rows.withColumn("regular_cost", part("rebalance")).withColumn("roll_cost", part("roll_turnover"))


def portfolio(rows: DataFrame, capital: float, margin: float) -> DataFrame:
    """One row a session: results, costs, NAV from ``capital``, return on the NAV before, notional, margin and peaks."""
    total = lambda c: F.sum(c).alias(c)
    daily = rows.groupBy("session").agg(
        *map(total, ("gross", "fixed", "impact", "cost", "rebalance", "roll_turnover", "turnover")), F.sum(F.abs(F.col("position") * F.col("close"))).alias("notional"), F.sum(F.abs("position") * margin).alias("margin"),
        F.max("participation").alias("peak_participation"), F.count_if(F.col("position") != 0).alias("markets"),
    )
    # One row a session: the only ordered window over all of them.
    past = Window.orderBy("session").rowsBetween(Window.unboundedPreceding, -1)
    daily = daily.withColumn("net", F.col("gross") - F.col("cost")).withColumn("prior_nav", capital + F.coalesce(F.sum("net").over(past), F.lit(0.0)))
    daily = daily.withColumn("nav", F.col("prior_nav") + F.col("net")).withColumn("ret", F.col("net") / F.col("prior_nav"))
    return daily.withColumn("gross_multiple", F.col("notional") / F.col("nav")).withColumn("margin_fraction", F.col("margin") / F.col("nav"))


def identity_checks(markets: DataFrame, daily: DataFrame, episodes: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """One row per accounting identity: check, error (the largest absolute one) and status, BLOCKED beyond the tolerance or where it is not a number.

    Portfolio rows also need finite figures, a NAV above 0 and costs of at least 0.
    """
    sums = markets.groupBy("session").agg(F.sum("gross").alias("m_gross"), (F.sum("regular_cost") + F.sum("roll_cost")).alias("m_cost"))
    moved = F.col("position") - F.coalesce(F.lag("position").over(by_symbol()), F.lit(0.0)) - F.col("trade")
    worst = lambda c: F.max(F.abs(c))
    c = F.col
    days = daily.join(sums, "session", "full_outer").agg(
        worst(F.coalesce("m_gross", F.lit(0.0)) - F.coalesce("gross", F.lit(0.0))).alias("market_gross_to_portfolio"), worst(F.coalesce("m_cost", F.lit(0.0)) - F.coalesce("cost", F.lit(0.0))).alias("market_costs_to_portfolio"),
        worst(c("fixed") + c("impact") - c("cost")).alias("fixed_and_impact_to_cost"), worst(c("gross") - c("cost") - c("net")).alias("net_result"), worst(c("prior_nav") + c("net") - c("nav")).alias("nav_recursion"), worst(c("net") / c("prior_nav") - c("ret")).alias("net_return"),
        F.max((~((c("nav") > 0) & (c("nav") < float("inf")))).cast("double")).alias("nav_positive"), F.max((~((c("cost") >= 0) & (c("cost") < float("inf")))).cast("double")).alias("costs_not_negative"), F.sum("gross").alias("__gross"), F.sum("cost").alias("__cost"),
    )
    trades = markets.select(moved.alias("moved")).agg(worst(c("moved")).alias("positions_to_trades"))
    spells = episodes.agg(F.coalesce(F.sum("gross"), F.lit(0.0)).alias("__e_gross"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("__e_cost"))
    # Three frames of one row each.
    row = days.join(F.broadcast(trades)).join(F.broadcast(spells))
    row = row.withColumn("episodes_to_gross", F.abs(c("__e_gross") - c("__gross"))).withColumn("episodes_to_costs", F.abs(c("__e_cost") - c("__cost")))
    names = [n for n in row.columns if not n.startswith("__")]
    out = row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check"), c(n).alias("error")) for n in names))).alias("x")).select("x.*")
    return out.withColumn("status", F.when(c("error") <= tolerance, "PASS").otherwise("BLOCKED"))


def turnover_report(daily: DataFrame) -> DataFrame:
    """One row: turnover a year by calendar time, the share of rolls, the 99.9 % participation and notional traded a year over the NAV before."""
    years = F.greatest(F.datediff(F.max("session"), F.min("session")) / 365.2425, F.lit(1e-9))
    total = F.sum("rebalance") + F.sum("roll_turnover")
    return daily.agg((F.sum("rebalance") / years).alias("rebalance_a_year"), (F.sum("roll_turnover") / years).alias("roll_a_year"), (F.sum("turnover") / years).alias("total_a_year"), F.when(total > 0, F.sum("roll_turnover") / total).alias("roll_share"), F.percentile("peak_participation", 0.999).alias("participation_p999"), (F.sum(F.col("traded_notional") / F.col("prior_nav")) / years).alias("notional_a_year"))


def exposure_report(daily: DataFrame, periods: int = 252) -> DataFrame:
    """One row: cost drags a year, exposures, peaks and markets held of the portfolio rows."""
    drag = lambda x: F.avg(F.col(x) / F.col("prior_nav")) * periods
    return daily.agg(
        drag("cost").alias("cost_drag"), drag("fixed").alias("fixed_drag"), drag("impact").alias("impact_drag"), F.avg("gross_multiple").alias("mean_gross"), F.max("gross_multiple").alias("peak_gross"), F.avg("margin_fraction").alias("mean_margin"), F.max("margin_fraction").alias("peak_margin"), F.max("peak_participation").alias("peak_participation"), F.avg("markets").alias("markets_held")
    )


def drawdown_anatomy(paths: DataFrame, exposure: str, threshold: float, periods: int = 252) -> DataFrame:
    """Per member and sample (all, inside and outside a drawdown deeper than the threshold): sessions, share, return, volatility, hit rate and mean exposure, and their ratios to all."""
    rows = wealth(paths.filter("ret IS NOT NULL")).withColumn("__in", F.col("drawdown") < -threshold)
    samples = F.array_compact(F.array(F.lit("all"), F.when(F.col("__in"), "inside").otherwise("outside")))
    rows = rows.withColumn("sample", F.explode(samples))
    out = rows.groupBy("member", "sample").agg(F.count(F.lit(1)).alias("sessions"), (F.avg("ret") * periods).alias("mean"), (F.stddev_samp("ret") * periods**0.5).alias("vol"), F.avg((F.col("ret") > 0).cast("double")).alias("hit_rate"), F.avg(exposure).alias("exposure"))
    # At most three rows a member.
    whole = lambda c: F.max(F.when(F.col("sample") == "all", F.col(c))).over(Window.partitionBy("member"))
    out = out.withColumn("share", F.col("sessions") / whole("sessions"))
    ratio = lambda c: F.try_divide(F.col(c), F.nullif(whole(c), F.lit(0.0))).alias(f"{c}_ratio")
    return out.select("*", ratio("vol"), ratio("exposure"), (F.col("hit_rate") - whole("hit_rate")).alias("hit_rate_difference"))


def conditional_exposure(paths: DataFrame, conditioner: str, share: float = 0.8, multiplier: float = 0.5, periods: int = 252) -> DataFrame:
    """Per member: the path as it is, with exposure cut where the conditioner exceeds its own quantile, and that scaled back to the volatility it had.

    The threshold is fitted on the same sample: it shows a shape, it is no evidence.
    """
    rows = paths.filter("ret IS NOT NULL")
    # The quantile of a member is one number, joined back.
    cut = rows.groupBy("member").agg(F.percentile(conditioner, share).alias("threshold"))
    rows = rows.join(cut, "member").withColumn("__low", F.col(conditioner) > F.col("threshold")).withColumn("__cut", F.col("ret") * F.when(F.col("__low"), multiplier).otherwise(1.0))
    scale = rows.groupBy("member").agg(F.try_divide(F.stddev_samp("ret"), F.nullif(F.stddev_samp("__cut"), F.lit(0.0))).alias("__k"))
    rows = rows.join(scale, "member")
    cases = F.array(*(F.struct(F.lit(n).alias("form"), v.alias("r")) for n, v in (("plain", F.col("ret")), ("conditioned", F.col("__cut")), ("matched", F.col("__cut") * F.col("__k")))))
    long = rows.select("member", "session", "threshold", "__low", F.explode(cases).alias("x")).select(F.concat_ws("|", "member", "x.form").alias("key"), "member", "session", "threshold", "__low", F.col("x.form").alias("form"), F.col("x.r").alias("ret"))
    own = wealth(long.select(F.col("key").alias("member"), "session", "ret")).groupBy(F.col("member").alias("key")).agg(F.min("drawdown").alias("max_drawdown"))
    years = elapsed_years(F.min("session"), F.max("session"))
    out = long.groupBy("key", "member", "form").agg(F.first("threshold").alias("threshold"), F.count_if("__low").alias("reduced"), (F.pow(grown("ret"), 1 / years) - 1).alias("cagr"), (F.stddev_samp("ret") * periods**0.5).alias("vol"), (F.try_divide(F.avg("ret"), F.nullif(F.stddev_samp("ret"), F.lit(0.0))) * periods**0.5).alias("sharpe"))
    return out.join(own, "key").drop("key").withColumn("drawdown_to_vol", F.try_divide(-F.col("max_drawdown"), F.nullif(F.col("vol"), F.lit(0.0))))


def month_figures(daily: DataFrame) -> DataFrame:
    """Per month of the portfolio rows: compounded return, costs over the NAV before, mean and peak exposure, sessions."""
    return daily.groupBy(F.trunc("session", "MM").alias("month")).agg((grown("ret") - 1).alias("ret"), F.sum(F.col("cost") / F.col("prior_nav")).alias("cost"), F.avg("gross_multiple").alias("mean_gross"), F.max("gross_multiple").alias("peak_gross"), F.max("peak_participation").alias("peak_participation"), F.count(F.lit(1)).alias("sessions"))


def limited_contracts(targets: DataFrame, nav: float, gross_limit: float, margin_limit: float) -> DataFrame:
    """Whole contracts of targets (session, symbol, per_dollar, price, point_value, margin) under limits of gross notional and margin to the NAV, a decision date at a time.

    The book is scaled to the limits, rounded half to even, and where rounding
    breaches a limit scaled once more and cut towards 0.  A target that cannot
    be valued raises.
    """
    date = Window.partitionBy("session")
    value = F.abs(F.col("price") * F.col("point_value"))
    known = (F.col("per_dollar") == 0) | (value.isNotNull() & F.col("margin").isNotNull())
    rows = targets.withColumn("desired", F.when(F.coalesce(known, F.lit(False)), F.col("per_dollar") * nav).otherwise(F.raise_error(F.lit("a target cannot be valued")).cast("double")))

    def scale(contracts: Column) -> Column:
        gross, margin = F.sum(F.abs(contracts) * value).over(date), F.sum(F.abs(contracts) * F.col("margin")).over(date)
        fit = lambda used, limit: F.when(used > 0, F.lit(limit * nav) / used).otherwise(1.0)
        return F.least(F.lit(1.0), fit(gross, gross_limit), fit(margin, margin_limit))

    rows = rows.withColumn("__first", scale(F.col("desired"))).withColumn("__whole", F.rint(F.col("desired") * F.col("__first")))
    rows = rows.withColumn("__second", scale(F.col("__whole")))
    cut = F.signum("__whole") * F.floor(F.abs(F.col("__whole") * F.col("__second")))
    return rows.select("session", "symbol", F.when(F.col("__second") < 1, cut).otherwise(F.col("__whole")).alias("contracts"), (F.col("__first") * F.col("__second")).alias("scale"))
