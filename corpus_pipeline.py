"""A corpus pipeline over ``documents``: low quality, near duplicates and
benchmark leaks go, secrets are masked, and what stays is tokenised.

Every stage takes the table that the stage before has written and returns a
DataFrame; all but the last keep the columns of ``documents``.  A null text is
an empty one to every stage and stays null unless it goes; an empty table gives
an empty table; whole texts of any length are read.  Columns beyond those of
``documents`` are carried along; the names ``__score``, ``__leaks``,
``__secrets``, ``__id``, ``__many`` and ``__t`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.bpe import digests
from ledgerline.llm.common import materialise, table
from ledgerline.llm.decontaminate import find_leaks
from ledgerline.llm.jaccard import similar_documents
from ledgerline.llm.quality import score_quality, train
from ledgerline.llm.secrets import redact, scan_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the classifier scores 0.5 or more."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model, out="__score").filter("__score >= 0.5").drop("__score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each class of similar documents; of rows that repeat its id, the smallest."""
    kept = similar_documents(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    ids = kept.groupBy(F.col("doc_id").alias("__id")).agg(F.count(F.lit(1)).alias("__many"))
    own = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("__id")))
    # Ids that occur once, nearly all, go through; only the others are grouped.
    once, several = own.filter("__many = 1").select(docs.columns), own.filter("__many > 1").select(docs.columns)
    # Rows with a null id are documents of their own: only equal texts are one.
    text = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
    least = several.groupBy("doc_id", text.alias("__t")).agg(F.min(F.struct(*docs.columns)).alias("row"))
    return once.unionByName(least.select(*(F.col(f"row.{c}").alias(c) for c in docs.columns)))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    found = find_leaks(docs, table(spark, sf_dir, "benchmark"), out="__leaks")
    return found.filter(F.size("__leaks") == 0).drop("__leaks")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets in the texts; ``n_chars`` follows the new text."""
    found = scan_secrets(docs, out="__secrets")
    found = found.withColumn("text", redact(F.col("text"), F.col("__secrets")))
    changed = F.when(F.size("__secrets") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", changed).select(docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document that stays, as digests."""
    return digests(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", secrets), ("tokenise", tokenise)]

#: SQL cannot express the classifier, the window search or the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
