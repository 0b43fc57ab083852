"""Proportional stratified interleaving.

Rows are shuffled inside their stratum by a seeded hash and ranked; rank r of
n gets the fraction (r-u)/n, so every stratum is spread evenly over (0, 1).
The phase u, between 0 and 1, is a hash of the stratum: with one phase for all,
every stratum of a single row would have the same fraction, and all of them
would fall into one shard and one task.  In order of the fraction the table is
one interleaved sequence, and cutting it into equal runs gives shards that each
match the mixture.

Both ranks are found without one task per stratum: rows fall into buckets by
the leading digits of the hash (or of the fraction), a small count per bucket
gives each bucket's offset, and rows are numbered inside their bucket only.
The number of buckets grows with the number of rows.  The hash takes the key
and what tells its rows apart, so that rows that repeat a key spread as well;
rows that are equal throughout can be counted first and written out when they
have their ranks, which spread them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import table

#: Rows that one bucket, and so one task, numbers.
BUCKET_ROWS = 10_000
SHARDS = 24
SEED = 20260
_RUN = 65_536  # ranks of equal rows that are written out from one array
_HEX = 8  # hexadecimal digits of the shuffle key that order rows by buckets: 32 bits, so that the product with up to 2**31 buckets stays a long


def interleave(df: DataFrame, stratum: str, key: str, shards: int, seed: int = SEED, tie: list[str] | None = None, collapse: bool = False) -> DataFrame:
    """``df`` with ``shard`` (0 to shards-1) and ``slot`` (gapless from 0 in each shard).

    Shard sizes differ by at most one row, and each shard's rows of a stratum
    differ from its even share by at most about one.  A null stratum is a
    stratum of its own.  The key (a null one is empty) is shuffled together with
    the ``tie`` columns, so that rows that repeat it spread.  Rows equal in key and
    in the ``tie`` columns get neighbouring ranks in no fixed order and are ranked
    in one task, unless ``collapse`` is set: then rows equal in all columns, which
    must have types that can be grouped, are counted before they are ranked.
    Texts of any length are never moved, unless the table itself holds them.  An empty
    table gives an empty table.  Columns named ``shard`` or ``slot`` are
    replaced; names starting with ``__`` are reserved for the operator.
    """
    total = df.count()
    buckets = max(1, -(-total // BUCKET_ROWS))
    tie = [F.col(c) for c in tie or []]
    df = df.drop("shard", "slot")
    df = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__m")) if collapse else df.withColumn("__m", F.lit(1))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("")), *(c.cast("string") for c in tie)).cast("binary"))
    df = df.withColumn("__key", digest)
    df = df.withColumn("__bucket", F.shiftright(F.conv(F.substring("__key", 1, _HEX), 16, 10).cast("long") * F.lit(buckets), 4 * _HEX))
    order = [F.col("__key"), F.col(key), *tie]

    counts = df.groupBy(F.col(stratum).alias("__s"), F.col("__bucket").alias("__b")).agg(F.sum("__m").alias("__n"))
    by = Window.partitionBy("__s")
    offsets = counts.select("__s", "__b", F.coalesce(F.sum("__n").over(by.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__n").over(by).alias("__of"))
    upto = Window.partitionBy(stratum, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ranked = df.withColumn("__rank", F.sum("__m").over(upto) - F.col("__m"))
    ranked = ranked.join(offsets, F.col(stratum).eqNullSafe(F.col("__s")) & (F.col("__bucket") == F.col("__b")))
    ranked = ranked.withColumn("__rank", F.col("__rank") + F.col("__before"))
    if collapse:
        ranked = ranked.withColumn("__run", F.explode(F.expr(f"sequence(0L, (__m - 1) div {_RUN})")))
        ranked = ranked.withColumn("__i", F.explode(F.expr(f"sequence(1L, least({_RUN}L, __m - __run * {_RUN}))")))
        ranked = ranked.withColumn("__rank", F.col("__rank") + F.col("__run") * _RUN + F.col("__i")).drop("__run", "__i")
    else:
        ranked = ranked.withColumn("__rank", F.col("__rank") + 1)
    named = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(stratum).cast("string"), F.lit(""))).cast("binary"))
    phase = (F.conv(F.substring(named, 1, _HEX), 16, 10).cast("long") + 0.5) / 2.0 ** (4 * _HEX)
    ranked = ranked.withColumn("__at", (F.col("__rank").cast("double") - phase) / F.col("__of").cast("double"))
    ranked = ranked.drop("__s", "__b", "__before", "__of", "__m").withColumn("__bucket", F.least((F.col("__at") * buckets).cast("long"), F.lit(buckets - 1)))

    places = ranked.groupBy(F.col("__bucket").alias("__b")).agg(F.count(F.lit(1)).alias("__n"))
    # One row per 10,000 rows of the table: the only unpartitioned window.
    places = places.select("__b", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    placed = ranked.withColumn("__in", F.row_number().over(Window.partitionBy("__bucket").orderBy("__at", stratum, *order)))
    placed = placed.join(places, F.col("__bucket") == F.col("__b")).withColumn("__place", F.col("__before") + F.col("__in") - 1)
    placed = placed.withColumn("shard", F.expr(f"(__place * {shards}) div {max(total, 1)}").cast("int"))
    begin = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}) div {shards}")
    return placed.withColumn("slot", F.col("__place") - begin).drop("__key", "__bucket", "__rank", "__at", "__in", "__b", "__before", "__place")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 24 shards that all match the mixture of sources."""
    text = F.coalesce(F.col("text"), F.lit(""))
    thin = table(spark, sf_dir, "documents").select("doc_id", "source", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = interleave(thin, "source", "doc_id", SHARDS, tie=["text_crc32", "size"], collapse=True)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


OP3_SQL = f"""
WITH RECURSIVE poly AS (SELECT i, i AS v, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM poly WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM poly WHERE k = 8),
bytes AS (SELECT doc_id, source, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
measured AS (SELECT doc_id, source, CAST(length(h) / 2 + 8 AS BIGINT) AS size,
  xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(h, '..'), lambda x: CAST(('0x' || x) AS BIGINT))),
      lambda a, b: xor(a >> 8, t[xor(a, b) % 256 + 1]))) AS text_crc32 FROM bytes, crc_table),
sized AS (SELECT *, md5(concat_ws(':', '{SEED}', coalesce(CAST(doc_id AS VARCHAR), ''), text_crc32, size)) AS k,
  (('0x' || substr(md5('{SEED}:' || coalesce(source, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE AS phase FROM measured),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY k, doc_id NULLS FIRST, text_crc32, size) AS r, count(*) OVER (PARTITION BY source) AS n FROM sized),
placed AS (SELECT *, row_number() OVER (ORDER BY (CAST(r AS DOUBLE) - phase) / CAST(n AS DOUBLE), source NULLS FIRST, k, doc_id NULLS FIRST, text_crc32, size) - 1 AS p, count(*) OVER () AS total FROM ranked)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST((p * {SHARDS}) // total AS INTEGER) AS shard,
  CAST(p - (((p * {SHARDS}) // total) * total + {SHARDS - 1}) // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, source FROM placed
"""
