"""Fund files: adjustment factors, distributions and splits recovered from them, turnover by year and coverage audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.panel import by_symbol


def fund_rows(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fund, violations) of (symbol, session, close, unadjusted, volume, turnover): adds factor and shares; a price that is not positive and finite is a violation and its row is left out."""
    sound = lambda c: F.coalesce((F.col(c) > 0) & (F.col(c) < float("inf")), F.lit(False))
    good = sound("close") & sound("unadjusted")
    factor = F.col("close") / F.col("unadjusted")
    fund = raw.filter(good).withColumn("factor", factor).withColumn("shares", F.col("volume") * factor)
    return fund, raw.filter(~good).select("symbol", "session", F.lit("a price is not positive").alias("reason"))


def adjustment_events(fund: DataFrame, tolerance: float = 1e-6, split: float = 0.15) -> DataFrame:
    """(symbol, session, step, before, kind, distribution): steps of the adjustment factor.

    A step further than ``split`` from one is a split; else it is a distribution
    of before x (1 - 1 / step), with the price traded the row before.
    """
    rows = fund.withColumn("step", F.col("factor") / F.lag("factor").over(by_symbol())).withColumn("before", F.lag("unadjusted").over(by_symbol()))
    away = F.abs(F.col("step") - 1)
    kind = F.when(away > split, "split").otherwise("distribution")
    return rows.filter(away > tolerance).select("symbol", "session", "step", "before", kind.alias("kind"), F.when(away <= split, F.col("before") * (1 - 1 / F.col("step"))).alias("distribution"))


def dividend_report(fund: DataFrame, tolerance: float = 1e-6, split: float = 0.15) -> DataFrame:
    """Per symbol: events a year, product of the splits, adjustment without them, implied yield, and how far adjusted and traded steps differ on quiet sessions."""
    by = by_symbol()
    rows = fund.withColumn("step", F.col("factor") / F.lag("factor").over(by))
    rows = rows.withColumn("gap", F.abs(F.col("close") / F.lag("close").over(by) - F.col("unadjusted") / F.lag("unadjusted").over(by)))
    away = F.abs(F.col("step") - 1)
    event, cut = F.coalesce(away > tolerance, F.lit(False)), F.coalesce(away > split, F.lit(False))
    quiet = F.when(~event, F.col("gap"))
    years = F.datediff(F.max("session"), F.min("session")) / 365.2425
    out = rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("sessions"), years.alias("years"), F.count_if(event & ~cut).alias("distributions"), F.count_if(cut).alias("splits"), F.exp(F.coalesce(F.sum(F.when(cut, F.log("step"))), F.lit(0.0))).alias("split_product"),
        (F.max_by("factor", "session") / F.min_by("factor", "session")).alias("__whole"), F.coalesce(F.percentile(quiet, 0.5), F.lit(0.0)).alias("median_gap"), F.coalesce(F.max(quiet), F.lit(0.0)).alias("largest_gap"),
    )
    out = out.withColumn("adjustment", F.col("__whole") / F.col("split_product"))
    return out.withColumn("distributions_a_year", F.try_divide(F.col("distributions"), F.nullif(F.col("years"), F.lit(0.0)))).withColumn("implied_yield", F.when(F.col("years") > 0, F.pow("adjustment", 1 / F.col("years")) - 1)).drop("__whole")


def yearly_turnover(fund: DataFrame) -> DataFrame:
    """(symbol, year, median): median turnover of a session by calendar year."""
    return fund.groupBy("symbol", F.year("session").alias("year")).agg(F.percentile("turnover", 0.5).alias("median"))


def thin_years(fund: DataFrame, floor: float) -> DataFrame:
    """Years whose median turnover lies below the floor."""
    return yearly_turnover(fund).filter(F.col("median") < floor)


def turnover_audit(fund: DataFrame, declared: DataFrame, first: str, last: str) -> DataFrame:
    """Per symbol of (symbol, declared): the median turnover of the window and of the whole life, and both over what is declared."""
    inside = F.when(F.col("session").between(F.lit(first).cast("date"), F.lit(last).cast("date")), F.col("turnover"))
    seen = fund.groupBy("symbol").agg(F.percentile(inside, 0.5).alias("window_median"), F.percentile("turnover", 0.5).alias("life_median"))
    out = declared.join(seen, "symbol", "left")
    return out.withColumn("window_ratio", F.col("window_median") / F.col("declared")).withColumn("life_ratio", F.col("life_median") / F.col("declared"))


def fully_quoted(panel: DataFrame) -> DataFrame:
    """One row: the first session by which every symbol has been quoted."""
    return panel.groupBy("symbol").agg(F.min("session").alias("first")).agg(F.max("first").alias("session"), F.count(F.lit(1)).alias("symbols"))


def common_panel(panel: DataFrame, first: str, last: str, ceiling: str) -> tuple[DataFrame, DataFrame]:
    """(panel, one count row): rows of sessions from first to last that every symbol has, with simple returns of ``close``.

    Nothing after ``ceiling``, the last session that may be seen, comes out; the
    count row has the sessions of the union, of the intersection and those
    dropped, and BLOCKED if the ceiling was asked to be passed.
    """
    cap = F.lit(ceiling).cast("date")
    rows = panel.filter(F.col("session").between(F.lit(first).cast("date"), F.least(F.lit(last).cast("date"), cap)))
    # How many symbols there are is one number.
    many = panel.agg(F.count_distinct("symbol").alias("__many"))
    seen = rows.groupBy("session").agg(F.count_distinct("symbol").alias("__n")).join(F.broadcast(many)).withColumn("whole", F.col("__n") == F.col("__many"))
    kept = rows.join(seen.filter("whole").select("session"), "session", "left_semi")
    kept = kept.withColumn("ret", F.try_divide(F.col("close"), F.lag("close").over(by_symbol())) - 1)
    counts = seen.agg(F.count(F.lit(1)).alias("union_sessions"), F.count_if("whole").alias("common_sessions"), F.count_if(~F.col("whole")).alias("dropped"), F.max(F.when(F.col("whole"), F.col("session"))).alias("last_session"))
    return kept, counts.withColumn("status", F.when(F.lit(last).cast("date") > cap, "BLOCKED").otherwise("PASS"))
