"""A bundle of tables that is published as a whole.

The tables are written into a folder of their own, their files are hashed by a
scan, and the manifest is written beside them; only then does the small file
``CURRENT``, replaced by one rename, name the new folder.  A reader sees the
old bundle or the new one, and can check every file against the manifest.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "name string, file string, bytes long, sha256 string"


def _jvm_path(spark: SparkSession, path: str):
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return made, made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, file, bytes, sha256) of the data files below a bundle's folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(f"{folder}/tables")
    inside = F.regexp_extract("path", "/tables/(.*)$", 1)
    return found.select(F.substring_index(inside, "/", 1).alias("name"), inside.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def publish(tables: dict[str, DataFrame], path: str) -> str:
    """Write the tables as Parquet, with a manifest, and make them the current bundle at ``path``; returns its folder.

    A run that ends early leaves the bundle that was current; its folder stays
    unnamed.  Of two writers at once the later rename counts.
    """
    spark = next(iter(tables.values())).sparkSession
    folder = f"{path.rstrip('/')}/bundle-{uuid.uuid4().hex}"
    for name, df in tables.items():
        if not name.isidentifier():
            raise ValueError(f"a table's name is an identifier, not {name!r}")
        df.write.parquet(f"{folder}/tables/{name}")
    _files(spark, folder).coalesce(1).write.json(f"{folder}/manifest")
    staged, fs = _jvm_path(spark, f"{folder}/CURRENT")
    out = fs.create(staged, True)
    out.write(bytearray(folder.rsplit("/", 1)[1].encode()))
    out.close()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(fs.makeQualified(staged).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(staged), fs.makeQualified(_jvm_path(spark, f"{path.rstrip('/')}/CURRENT")[0]), options)
    return folder


def current(spark: SparkSession, path: str) -> str:
    """The folder of the current bundle."""
    return f"{path.rstrip('/')}/{spark.read.text(f'{path.rstrip("/")}/CURRENT').first()[0]}"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/tables/{name}")


def verify(spark: SparkSession, folder: str) -> DataFrame:
    """(name, file, status): every file of the manifest and of the folder, OK, CHANGED, MISSING or ADDED."""
    listed = spark.read.schema(_MANIFEST).json(f"{folder}/manifest").select("name", "file", F.col("bytes").alias("b0"), F.col("sha256").alias("h0"))
    both = listed.join(_files(spark, folder), ["name", "file"], "full_outer")
    same = (F.col("b0") == F.col("bytes")) & (F.col("h0") == F.col("sha256"))
    return both.select("name", "file", F.when(F.col("h0").isNull(), "ADDED").when(F.col("sha256").isNull(), "MISSING").when(same, "OK").otherwise("CHANGED").alias("status"))
