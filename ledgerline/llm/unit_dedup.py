"""Substring removal by hashing lines, paragraphs and sentences.

A text is cut into paragraphs, lines and sentences, each normalised (A-Z in
lower case, white space collapsed) and hashed to 128 bits by BLAKE2b of its bytes.  Lines and
paragraphs count at any length; sentences are taken in addition, from
``MIN_WORDS`` words.  Digests are grouped globally, whatever the kind of unit;
the earliest document that has a unit keeps its first occurrence, every other
occurrence is listed for removal with its offsets in the original text.  Units
nest, so listed spans of a document may lie inside each other.

A group is only ever a count and a smallest document: both combine before the
shuffle, so a unit that a third of all documents share is no large group.  The
join that marks the other occurrences is an inner sort-merge join, whose large
partitions adaptive execution can split.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm import wordhash
from ledgerline.llm.common import chunks, materialise, table

#: Sentences of fewer words say too little about their origin and only go with their line.
MIN_WORDS = 6
KINDS = ("paragraph", "line", "sentence")


def split_units(texts: list[bytes], unit: str, min_words: int) -> tuple[np.ndarray, ...]:
    """(text, start, end, words, digest 1, digest 2, first) of every unit; offsets in code points.

    ``unit``: "line" ends at a line feed, "paragraph" at an empty line, and
    "sentence" at a line feed or after a word that ends in a full stop,
    exclamation or question mark; "all" takes every kind, a span once.  Only
    sentences need ``min_words``.  ``first``: no earlier unit of the text is equal.
    """
    value, start, end, first = wordhash.words(texts)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    points, begins = wordhash.code_points(texts)
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    feeds = np.concatenate([[0], np.cumsum(data == 10)])
    at, to = start + begins[text], end + begins[text]
    between = feeds[at[1:]] - feeds[to[:-1]] if len(at) else np.zeros(0, np.int64)
    spans = []
    for kind in KINDS if unit == "all" else (unit,):
        last = np.ones(len(value), bool)
        if len(value):
            last[:-1] = (text[1:] != text[:-1]) | (between >= (2 if kind == "paragraph" else 1))
            if kind == "sentence":
                last |= np.isin(data[to - 1], list(b".!?"))
        stop = np.flatnonzero(last) + 1
        begin = np.concatenate([[0], stop[:-1]])[: len(stop)]
        keep = stop - begin >= (min_words if kind == "sentence" else 1)
        spans.append(begin[keep] * (len(value) + 1) + stop[keep])
    begin, stop = np.divmod(np.unique(np.concatenate(spans)), len(value) + 1)
    tokens = wordhash.lowered(texts).split()
    digest = b"".join([blake2b(b" ".join(tokens[a:b]), digest_size=16).digest() for a, b in zip(begin.tolist(), stop.tolist(), strict=True)])
    one, two = np.frombuffer(digest, np.int64).reshape(-1, 2).T
    of = text[begin]
    order = np.lexsort((np.arange(len(one)), two, one, of))
    new = np.ones(len(one), bool)
    new[order[1:]] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]]) | (of[order[1:]] != of[order[:-1]])
    origin = points[begins[of]]
    return of, points[at[begin]] - origin, points[to[stop - 1]] - origin, stop - begin, one, two, new


def units(df: DataFrame, key: str, text: str, unit: str = "all", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per unit: key, start, end, n_words, h1, h2, first."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            of, *columns = split_units([(t or "").encode() for t in batch.column("text").to_pylist()], unit, min_words)
            types = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(of)), *(pa.array(c).cast(t) for c, t in zip(columns, types, strict=True))], names=["key", "start", "end", "n_words", "h1", "h2", "first"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, start int, end int, n_words int, h1 long, h2 long, first boolean")


def repeated_units(df: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "all", min_words: int = MIN_WORDS) -> DataFrame:
    """Every unit to remove: key, start, end, n_words, kept_key.

    The unit stays in the document of the smallest key (``kept_key``), at its
    first place there; where a removed paragraph held that place, its words stay
    in the kept paragraph, perhaps over other lines.  Null keys rank last and stand for one document; repeated
    rows of a key are one document and do not remove each other.  Null and empty
    texts have no units; other columns are not read.
    """
    found = materialise(units(df, key, text, unit, min_words), "units")
    groups = found.groupBy(F.col("h1").alias("g1"), F.col("h2").alias("g2")).agg(F.min("key").alias("kept_key"), F.count(F.lit(1)).alias("__n"))
    repeated = groups.filter("__n > 1")
    rows = found.join(repeated, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")))
    return rows.filter(~F.col("key").eqNullSafe(F.col("kept_key")) | ~F.col("first")).select("key", "start", "end", "n_words", "kept_key")


def remove_units(df: DataFrame, removed: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with the removed units cut out of ``text`` and ``kept``: the original offsets (start, end) of what stays.

    A document's spans are gathered per document, so no more than one text's
    units come together.  Spans that lie inside each other are cut once.
    """
    so_far = F.max("end").over(Window.partitionBy("key").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1))
    removed = removed.withColumn("start", F.greatest("start", so_far)).filter("start < end")
    spans = removed.groupBy(F.col("key").alias("__key")).agg(F.array_sort(F.collect_set(F.struct(F.col("start").alias("s"), F.col("end").alias("e")))).alias("__cut"))
    joined = df.join(spans, F.col(key).eqNullSafe(F.col("__key")), "left")
    size = F.length(text)
    cut = F.coalesce("__cut", F.array().cast("array<struct<s:int,e:int>>"))
    bounds = F.concat(F.transform(cut, lambda x: x["s"]), F.array(size))
    begins = F.concat(F.array(F.lit(0)), F.transform(cut, lambda x: x["e"]))
    kept = F.filter(F.zip_with(begins, bounds, lambda a, b: F.struct(a.alias("start"), b.alias("end"))), lambda x: x["start"] < x["end"])
    joined = joined.withColumn("kept", F.when(F.col(text).isNotNull(), kept))
    body = F.array_join(F.transform("kept", lambda x: F.substring(text, x["start"] + 1, x["end"] - x["start"])), "")
    return joined.withColumn(text, F.when(F.col(text).isNotNull(), body)).drop("__key", "__cut")


def op6_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All repeated paragraphs, lines and sentences of all documents but each one's earliest occurrence."""
    return repeated_units(table(spark, sf_dir, "documents")).select(F.col("key").alias("doc_id"), "start", "end", "n_words", F.col("kept_key").alias("kept_doc_id"))
