"""Calendars, alignment and bounded forward fill of long panels (symbol, session, fields)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_symbol():
    """Rows of a symbol in session order (made on use: a window needs a session)."""
    return Window.partitionBy("symbol").orderBy("session")


def business_days(panel: DataFrame) -> DataFrame:
    """Monday to Friday between the first and the last session of the panel."""
    ends = panel.agg(F.min("session").alias("a"), F.max("session").alias("b"))
    return ends.select(F.explode(F.expr("sequence(a, b, interval 1 day)")).alias("session")).filter(F.dayofweek("session").between(2, 6))


def sessions(panel: DataFrame) -> DataFrame:
    """Union calendar: every session of any symbol."""
    return panel.select("session").distinct()


def align(panel: DataFrame, fields: list[str], calendar: DataFrame | None = None, limit: int | None = 5) -> DataFrame:
    """Every symbol on every calendar day; a missing field takes the last value of at most ``limit`` rows before (None: any)."""
    grid = (calendar if calendar is not None else sessions(panel)).join(panel.select("symbol").distinct(), how="cross")
    frame = by_symbol().rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0)
    filled = [F.last(f, True).over(frame).alias(f) for f in fields]
    return grid.join(panel, ["symbol", "session"], "left").select("symbol", "session", *filled)


def common_sessions(panel: DataFrame) -> DataFrame:
    """The rows of sessions that every symbol has (intersection calendar)."""
    many = panel.select("symbol").distinct().agg(F.count(F.lit(1)).alias("n"))
    kept = panel.groupBy("session").agg(F.countDistinct("symbol").alias("n")).join(many, "n", "left_semi")
    return panel.join(kept.select("session"), "session", "left_semi")


def truncate(panel: DataFrame, last: str) -> DataFrame:
    """The panel as it was known on a date."""
    return panel.filter(F.col("session") <= F.lit(last).cast("date"))


def simple_returns(panel: DataFrame, field: str = "close") -> DataFrame:
    """Adds ``ret``: field over its previous row, less one; null where undefined."""
    return panel.withColumn("ret", F.try_divide(F.col(field), F.lag(field).over(by_symbol())) - 1)


def month_end_rows(panel: DataFrame, keep_partial: bool = True) -> DataFrame:
    """The last row of each month of a symbol.  Without ``keep_partial`` the final month stays only if its last row is the month's last business day."""
    by = Window.partitionBy("symbol", F.trunc("session", "MM")).orderBy(F.desc("session"))
    rows = panel.withColumn("__r", F.row_number().over(by)).filter("__r = 1").drop("__r")
    if keep_partial:
        return rows
    final = F.max("session").over(Window.partitionBy("symbol"))
    end = F.last_day("session")
    business = F.when(F.dayofweek(end) == 1, F.date_sub(end, 2)).when(F.dayofweek(end) == 7, F.date_sub(end, 1)).otherwise(end)
    return rows.withColumn("__f", final).filter((F.col("session") < F.col("__f")) | (F.col("session") == business)).drop("__f")


def project(labels: DataFrame, panel: DataFrame, field: str, lag: int = 1) -> DataFrame:
    """Labels of earlier decision rows carried forward onto the panel's sessions, then ``lag`` rows later."""
    joined = panel.select("symbol", "session").join(labels.select("symbol", "session", field), ["symbol", "session"], "left")
    carried = joined.withColumn(field, F.last(field, True).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0)))
    return carried.withColumn(field, F.lag(field, lag).over(by_symbol()))


def bad_rows(panel: DataFrame, fields: list[str]) -> DataFrame:
    """Violations as rows (symbol, session, reason): repeated sessions, infinite or negative fields."""
    twice = panel.groupBy("symbol", "session").count().filter("count > 1").select("symbol", "session", F.lit("repeated session").alias("reason"))
    for f in fields:
        wrong = panel.filter((F.col(f) < 0) | F.isnan(f) | (F.abs(f) == float("inf"))).select("symbol", "session", F.lit(f"{f} is negative or not finite").alias("reason"))
        twice = twice.unionByName(wrong)
    return twice
