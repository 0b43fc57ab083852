"""Structured Streaming forms of the event folds.

Each operator takes a stream and returns a stream; ``finish`` runs one over
what is there and returns the rows it has emitted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.audit import NEXT
from ledgerline.sources.files import scratch
from ledgerline.streaming.folds import fold


def stream(spark: SparkSession, path: str) -> DataFrame:
    """A file stream with the schema of the table at ``path``, a folder or one file (which a stream takes as a pattern only)."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


#: The store that timers and typed state need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start(rows: DataFrame, at: str, **trigger):
    """Start a query that appends to Parquet under ``at``; rows with an outcome go to a folder for each."""
    spark = rows.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        out = rows.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").outputMode("append")
        return (out.partitionBy("outcome") if "outcome" in rows.columns else out).trigger(**trigger).start()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def finish(rows: DataFrame, name: str, outcome: str | None = "seen", **trigger) -> DataFrame:
    """Process all that is available, append to Parquet in the shared folder and read it: rows of one outcome, or (None) all with theirs.

    A stream with timers of the clock has no end, so it takes ``once=True``: one batch.
    """
    at = scratch(rows.sparkSession, name)
    start(rows, at, **(trigger or {"availableNow": True})).awaitTermination()
    out = rows.sparkSession.read.schema(rows.schema).parquet(f"{at}/rows")
    return out.filter(F.col("outcome") == outcome).drop("outcome") if outcome and "outcome" in out.columns else out


def activity_sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a key that are over: no event for ``gap``, and the watermark has passed."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("events"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def window_counts(events: DataFrame, key: str, size: str, slide: str, late: str = "1 hour") -> DataFrame:
    """Events by key in sliding windows that the watermark has passed."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", size, slide).alias("w"), key).agg(F.count(F.lit(1)).alias("events"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def stale_components(events: DataFrame, component: str, limit: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(component, since, stale_at, beats): each time that a component has been silent for ``limit``, once the watermark has passed it."""
    out = activity_sessions(events, component, limit, late)
    return out.select(component, F.col("start").alias("since"), F.col("end").alias("stale_at"), F.col("events").alias("beats"))


def cost_rollup(costs: DataFrame, group: str, size: str, late: str = "1 hour") -> DataFrame:
    """(group, start, end, fills, quantity, cost): fill costs (ts, quantity, shortfall) in windows that the watermark has passed; cost is shortfall times quantity."""
    rows = costs.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", size).alias("w"), group).agg(F.count(F.lit(1)).alias("fills"), F.sum("quantity").alias("quantity"), F.sum(F.col("quantity") * F.col("shortfall")).alias("cost"))
    return out.select(group, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "fills", "quantity", "cost")


def illegal_transitions(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Every event (key, event_id, event, ts) that may not follow the one before it, once the watermark has passed it.

    An event id that repeats while it waits counts once; the repeated and the late events have outcomes of their own."""
    legal = {(a, b) for a, following in NEXT.items() for b in following} | {(None, "OUTBOX")}

    def step(state, row):
        return row["event"], (state, (state, row["event"]) in legal)

    rows = fold(events.select("key", "event_id", "event", "ts"), ["ts", "event_id"], "before string, legal boolean", step, late, ["ts", "event_id"])
    return rows.filter("NOT coalesce(legal, false)").select("key", "event_id", "before", "event", "outcome")
