"""Market-style tables derived from the star schema, each as DataFrame code and as DuckDB SQL.

Base values are exact decimal sums, so both engines agree before any rounding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a large table that one task of a shuffle is dealt, about.
ROWS_A_TASK = 200_000


def parts_for(spark: SparkSession, rows: int) -> int | None:
    """The tasks over which so many rows are dealt; None where the session's own number is enough."""
    parts = -(-rows // ROWS_A_TASK)
    return parts if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars (symbol, session, close, high, low, volume, turnover) from lineitem: six symbols."""
    rows = read(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("symbol"), F.col("l_shipdate").cast("date").alias("session"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price"), F.col("l_quantity").cast("decimal(18,2)").alias("qty"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("each")
    )
    total = lambda c: F.sum(c).cast("double")
    return rows.groupBy("symbol", "session").agg((total("price") / total("qty")).alias("close"), F.max("each").alias("high"), F.min("each").alias("low"), total("qty").alias("volume"), total("price").alias("turnover"))


BARS = """bars AS (SELECT l_returnflag || l_linestatus AS symbol, CAST(l_shipdate AS DATE) AS session,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS close,
  max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
  CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS volume, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS turnover
  FROM lineitem GROUP BY ALL)"""


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synchronised return paths (member, session, ret): bars on the union calendar, filled forward, one hundredth of the return, clipped to 5 %."""
    from ledgerline.operators.panel import align, simple_returns

    filled = align(bars(spark, sf_dir).select("symbol", "session", "close"), ["close"], limit=None)
    ret = F.greatest(F.lit(-0.05), F.least(F.lit(0.05), F.col("ret") * 0.01))
    return simple_returns(filled, "close").select(F.col("symbol").alias("member"), "session", F.coalesce(ret, F.lit(0.0)).alias("ret"))


PATHS = f"""{BARS},
dates AS (SELECT DISTINCT session FROM bars), members AS (SELECT DISTINCT symbol FROM bars),
grid AS (SELECT symbol, session, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY session) AS close
  FROM dates CROSS JOIN members LEFT JOIN bars USING (symbol, session)),
paths AS (SELECT symbol AS member, session, coalesce(greatest(-0.05::DOUBLE, least(0.05::DOUBLE,
  (close / lag(close) OVER (PARTITION BY symbol ORDER BY session) - 1) * 0.01::DOUBLE)), 0.0::DOUBLE) AS ret FROM grid)"""


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executions: lineitem with its order and part; the fill id hashes every column that tells rows apart."""
    line, order, part = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    order = order.select("o_orderkey", F.col("o_orderdate").cast("date").alias("arrival"))
    part = part.select("p_partkey", "p_brand", "p_type", "p_retailprice")
    joined = line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        F.col("l_orderkey").alias("order_id"), F.col("p_brand").alias("root"), F.col("p_type").alias("contract"), "arrival", F.col("l_shipdate").cast("date").alias("filled"),
        F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"), F.col("l_quantity").cast("double").alias("quantity"), (F.col("l_quantity") * 50.0).alias("interval_volume"),
        (F.col("p_retailprice") * 0.999).alias("bid"), (F.col("p_retailprice") * 1.001).alias("ask"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_tax").cast("double").alias("fees"),
    )


FILLS = """fills AS (SELECT l_orderkey AS order_id, p_brand AS root, p_type AS contract, CAST(o_orderdate AS DATE) AS arrival, CAST(l_shipdate AS DATE) AS filled,
  CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, CAST(l_quantity AS DOUBLE) AS quantity, l_quantity * 50.0::DOUBLE AS interval_volume,
  p_retailprice * 0.999::DOUBLE AS bid, p_retailprice * 1.001::DOUBLE AS ask, l_extendedprice / l_quantity AS price, CAST(l_tax AS DOUBLE) AS fees
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
