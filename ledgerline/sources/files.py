"""Delimited scans with a declared schema, and sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``; only a local session may go without one, and gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_panel(panel: DataFrame, path: str, form: str = "csv", by: str | None = "symbol") -> None:
    """Write a panel in folders by symbol (None: one folder)."""
    out = panel.write.mode("overwrite").format(form)
    if form == "csv":
        out = out.option("header", True)
    (out.partitionBy(by) if by else out).save(path)


def scan_panel(spark: SparkSession, path: str, fields: dict[str, str], date: str = "session", symbol: str = "symbol") -> tuple[DataFrame, DataFrame]:
    """(panel, violations) of delimited files in folders by symbol: fields by name and type in the order of the files.

    All is read as text once and cast, so that nothing is inferred.  Violations
    are (symbol, session, field, reason): a date that cannot be read or occurs
    twice, a number that cannot be read, is not finite, or is negative in
    ``volume``.  The panel holds rows with a date; what cannot be read is null.
    """
    schema = ", ".join(f"`{name}` string" for name in [*fields, symbol])
    text = spark.read.schema(schema).option("header", True).csv(path)
    typed = {name: F.col(name).try_cast(kind) for name, kind in fields.items()}
    numbers = [n for n, kind in fields.items() if kind == "double"]
    finite = {n: F.when(~F.isnan(typed[n]) & (F.abs(typed[n]) != float("inf")), typed[n]) for n in numbers}
    panel = text.select(F.col(symbol), *({**typed, **finite}[n].alias(n) for n in fields)).filter(F.col(date).isNotNull())

    def wrong(field, test, reason):
        return F.when(test, F.struct(F.lit(field).alias("field"), F.lit(reason).alias("reason")))

    tests = [wrong(date, typed[date].isNull(), "no date")]
    for n in numbers:
        tests.append(wrong(n, F.col(n).isNotNull() & finite[n].isNull(), "not a finite number"))
    if "volume" in fields:
        tests.append(wrong("volume", finite["volume"] < 0, "negative"))
    found = text.select(F.col(symbol), typed[date].alias(date), F.explode(F.array_compact(F.array(*tests))).alias("v")).select(symbol, date, "v.field", "v.reason")
    twice = panel.groupBy(symbol, date).count().filter("count > 1").select(symbol, date, F.lit(date).alias("field"), F.lit("repeated").alias("reason"))
    return panel, found.unionByName(twice)


def fingerprint(rows: DataFrame, group: str) -> DataFrame:
    """Per group: rows, and a digest that does not depend on the order of rows or columns.

    A digest of the sorted digests of rows would bring a whole group together;
    instead the row digests are added in four lanes of 32 bits, which combines
    before the shuffle.  Rows that are repeated count.
    """
    names = sorted(rows.columns)
    own = F.sha2(F.concat_ws("|", *(F.concat(F.lit(f"{n}="), F.coalesce(F.col(n).cast("string"), F.lit("null"))) for n in names)), 256)
    lanes = rows.select(group, own.alias("__h")).select(group, *(F.conv(F.substring("__h", 1 + 8 * k, 8), 16, 10).cast("long").alias(f"__{k}") for k in range(4)))
    sums = lanes.groupBy(group).agg(F.count(F.lit(1)).alias("rows"), *(F.sum(f"__{k}").alias(f"__{k}") for k in range(4)))
    return sums.select(group, "rows", F.concat_ws("-", *(f"__{k}" for k in range(4))).alias("digest"))


def scan_field(spark: SparkSession, path: str, fields: dict[str, str], field: str, calendar: DataFrame | None = None, fill: int | None = None) -> DataFrame:
    """(symbol, session, field) of delimited files: as observed, or with a calendar on its days, filled forward over at most ``fill`` rows.

    Closes are filled, but what was observed, traded prices, volumes and
    delivery labels are not.
    """
    from ledgerline.operators.panel import align

    panel = scan_panel(spark, path, fields)[0].select("symbol", "session", field)
    if calendar is None:
        return panel.filter(F.col(field).isNotNull())
    return align(panel, [field], calendar, fill or 0)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file below a folder, for inputs of files that fit in a task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_dated(panel: DataFrame, path: str) -> None:
    """Write a panel as Parquet in folders by the year of its session, for ``scan_dated``."""
    panel.withColumn("year", F.year("session")).repartition("year").write.mode("overwrite").partitionBy("year").parquet(path)


def scan_dated(spark: SparkSession, path: str, last: str | None = None) -> DataFrame:
    """The panel of ``write_dated``, up to the session ``last``: later years are not opened, and of its own year the scan leaves later rows out."""
    rows = spark.read.parquet(path)
    if last is not None:
        day = F.lit(last).cast("date")
        rows = rows.filter((F.col("year") <= F.year(day)) & (F.col("session") <= day))
    return rows.drop("year")
