"""Trade episodes: spells of one direction in a position ledger, and their figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ledger(positions: DataFrame, cost_per_contract: float) -> DataFrame:
    """(symbol, session, close, position) with the day's gross result on the position held into it, and the cost of the change."""
    by = Window.partitionBy("symbol").orderBy("session")
    held = F.coalesce(F.lag("position").over(by), F.lit(0.0))
    gross = F.coalesce(held * (F.col("close") - F.lag("close").over(by)), F.lit(0.0))
    return positions.withColumn("gross", gross).withColumn("cost", F.abs(F.col("position") - held) * cost_per_contract)


def trade_episodes(ledger: DataFrame) -> DataFrame:
    """One row per directional episode of (symbol, session, position, gross, cost).

    An episode opens when the sign of the position becomes another one but zero,
    and closes when the sign changes.  The closing day's gross result is the old
    episode's; a flip splits its cost by the old and new size.  ``mfe`` and
    ``mae`` are the best and worst running net result, at least and at most 0.
    Open episodes have no exit.
    """
    by = Window.partitionBy("symbol").orderBy("session")
    now, before = F.col("position"), F.col("__before")
    turned = F.signum(now) != F.signum(before)
    rows = ledger.withColumn("__before", F.coalesce(F.lag("position").over(by), F.lit(0.0)))
    rows = rows.withColumn("__opens", turned & (now != 0)).withColumn("__closes", turned & (before != 0))
    rows = rows.withColumn("__number", F.sum(F.col("__opens").cast("long")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    kept = F.when(F.col("__opens") & F.col("__closes"), F.abs(before) / (F.abs(before) + F.abs(now))).when(before != 0, 1.0).otherwise(0.0)

    def leg(number, sign, gross, cost, closed, resized, there):
        return F.when(there, F.struct(number.alias("episode"), sign.cast("int").alias("direction"), gross.alias("gross"), cost.alias("cost"), closed.alias("closed"), resized.alias("resized")))

    old = leg(F.col("__number") - F.col("__opens").cast("long"), F.signum(before), F.col("gross"), F.col("cost") * kept, F.col("__closes"), ~turned & (now != before), before != 0)
    new = leg(F.col("__number"), F.signum(now), F.lit(0.0), F.col("cost") * (1 - kept), F.lit(False), F.lit(False), F.col("__opens"))
    legs = rows.select("symbol", "session", F.explode(F.array_compact(F.array(old, new))).alias("leg")).select("symbol", "session", "leg.*")
    running = F.sum(F.col("gross") - F.col("cost")).over(Window.partitionBy("symbol", "episode").orderBy("session").rowsBetween(Window.unboundedPreceding, 0))
    legs = legs.withColumn("__net", running)
    return legs.groupBy("symbol", "episode").agg(
        F.first("direction").alias("direction"), F.min("session").alias("entry"), F.max(F.when(F.col("closed"), F.col("session"))).alias("exit"), (F.count(F.lit(1)) - 1).alias("sessions"), F.count_if("resized").alias("resizes"),
        F.sum("gross").alias("gross"), F.sum("cost").alias("cost"), F.sum(F.col("gross") - F.col("cost")).alias("net"), F.greatest(F.max("__net"), F.lit(0.0)).alias("mfe"), F.least(F.min("__net"), F.lit(0.0)).alias("mae"),
    )


def episode_metrics(episodes: DataFrame, least: float = 0.01) -> DataFrame:
    """Per symbol, over closed episodes: wins and losses beyond ``least``, profit factor, expectancy, payoff and holding."""
    closed, net = F.col("exit").isNotNull(), F.col("net")
    win, loss = F.when(closed & (net > least), net), F.when(closed & (net < -least), net)
    return episodes.groupBy("symbol").agg(
        F.count_if(closed).alias("closed"), F.count_if(~closed).alias("open"), F.count(win).alias("wins"), F.count(loss).alias("losses"), F.try_divide(F.sum(win), -F.sum(loss)).alias("profit_factor"),
        F.avg(F.when(closed, net)).alias("expectancy"), F.try_divide(F.avg(win), -F.avg(loss)).alias("payoff"), F.percentile(F.when(closed, F.col("sessions")), 0.5).alias("median_holding"),
    )
