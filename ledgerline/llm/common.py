"""What the training-data operators share: table access, durable intermediate
tables, and a streaming view of Arrow batches in byte-bounded chunks."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

#: Python tasks work on at most about this many bytes of text at a time.
CHUNK_BYTES = 500_000
#: Batches that Spark sends to Python tasks hold at most about this many bytes.
BATCH_BYTES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``.

    Only a local session (one machine) may go without it; it then gets a
    temporary folder, and the setting is filled in for later calls.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="spark-shared-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def materialise(df: DataFrame, label: str, **options) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The new frame has no lineage, so a lost executor costs a file read, not a
    recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete the files of materialised frames that no later step reads."""
    for df in frames:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Let shuffle files go whose plans are no longer held; Spark removes them once the driver collects its garbage.

    The first collection lets go of what holds the plan of a query that has just
    ended, the second of the plan.
    """
    for _ in range(2):
        time.sleep(0.3)
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's limit on the bytes of a batch for Python to BATCH_BYTES; a lower limit stays.

    A batch stands in the JVM's buffers and, with the one before, in the Python
    worker, for each core; Spark's own limits are 10,000 rows or 64 MB.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``text`` column holds about ``limit`` bytes;
    a single longer row is a slice of its own.  What a batch took is given back
    after it, as reused Python workers would hold it through all later stages."""
    pool = pa.default_memory_pool()
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(text)).fill_null(0).to_pylist()
        begin, held = 0, 0
        for i, size in enumerate(sizes):
            if i > begin and held + size > limit:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += size
        if begin < len(sizes):
            yield batch.slice(begin)
        del batch
        pool.release_unused()
