"""Repeated passages by a sparse suffix array.

Suffixes of the word sequence are retained only at minimiser positions: of any
26 neighbouring positions, the one whose 25-word hash is smallest.  Two equal
passages of 50 words or more therefore retain a suffix at the same place
inside, with its first 25 words in the passage.

Retained suffixes are put together by their first 25 words and sorted by what
follows; neighbours are compared and their match is extended to the right and
to the left, word by word.  A second order, by what precedes, catches pairs
whose common part lies mostly to the left.  Extension needs 26 words to either
side only: a match that goes further has another retained suffix there, and
the overlapping spans of a document are joined at the end.

Neighbours say that a passage repeats, not which copy comes first.  So every
LENGTH-word window of the spans is hashed to 96 bits, and the smallest key and
place of each digest, a minimum that combines before the shuffle, is the copy
that stays.  Spans are joined for the report only after that.

Suffixes whose 25 words occur once are dropped by a count that combines before
the shuffle; only the others fetch their surroundings from the texts.

A key of very many suffixes is sorted by several tasks: its rows are dealt by
range of the whole sort order, and the last row of each range is compared with
the first of the next.  The neighbours, and with them the result, are the same
as if one task had sorted the key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm import wordhash
from ledgerline.llm.common import chunks, materialise, release, sweep, table

#: Shortest repeated passage, in words.
LENGTH = 50
KEY = LENGTH // 2
SPAN = LENGTH - KEY + 1  # window of the minimisers, and reach of the extension
#: A key of at least so many suffixes is sorted by several tasks: its surroundings fill about 64 MB, Spark's advised size of a shuffle partition.  If more than CROWDED_MAX keys are, the bar is doubled until they fit.  Neither changes a result.
CROWDED, CROWDED_MAX = 250_000, 100_000


def _slide(a: np.ndarray, size: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of every ``size`` neighbours, by doubling."""
    width = 1
    while 2 * width <= size:
        a = pick(a[:-width], a[width:])
        width *= 2
    rest = size - width
    return pick(a[: len(a) - rest], a[rest:]) if rest else a


def retained(value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position in the text, key) of the retained suffixes."""
    keys = wordhash.shingles(value, KEY)
    none = np.zeros(0, np.int64)
    if len(keys) < SPAN:
        return none, none, none.astype(np.uint64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    smallest = _slide(keys, SPAN, np.minimum)
    whole = text[: len(smallest)] == text[SPAN + KEY - 2 :][: len(smallest)]  # the window and its keys lie in one text
    smallest = np.where(whole, smallest, np.uint64(0))
    edge = np.zeros(SPAN - 1, np.uint64)
    best = _slide(np.concatenate([edge, smallest, edge]), SPAN, np.maximum)
    at = np.flatnonzero((best == keys) & (text[: len(keys)] == text[KEY - 1 :]))
    return text[at], at - first[text[at]], keys[at]


def suffixes(df: DataFrame) -> DataFrame:
    """Retained suffixes of ``df`` (key, text): key, pos, h."""
    kind = df.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            value, _, _, first = wordhash.words([(t or "").encode() for t in batch.column("text").to_pylist()])
            text, pos, keys = retained(value, first)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(text)), pa.array(pos).cast(pa.int32()), pa.array(keys.view(np.int64))], names=["key", "pos", "h"])

    return df.mapInArrow(run, f"key {kind}, pos int, h long")


def _surroundings(df: DataFrame) -> DataFrame:
    """For rows (key, text, places): each place's suffix key and the 26 words before and after its 25, as 32-bit hashes (0 beyond the text)."""
    kind = df.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            value, _, _, first = wordhash.words(texts)
            places = batch.column("places").to_pylist()
            of = np.repeat(np.arange(len(texts)), [len(p) for p in places])
            pos = np.array([p for own in places for p in own], np.int64)
            size = np.diff(first)
            fits = pos + KEY <= size[of]  # false only where several texts share a key
            of, pos = of[fits], pos[fits]
            short = np.concatenate([(value >> np.uint64(32)).astype(np.uint32) | np.uint32(1), np.zeros(1, np.uint32)])
            begin, end = first[of][:, None], first[of + 1][:, None]
            at = (first[of] + pos)[:, None]
            right = at + KEY + np.arange(SPAN)
            left = at - 1 - np.arange(SPAN)
            right = short[np.where(right < end, right, len(value))].astype(">u4")
            left = short[np.where(left >= begin, left, len(value))].astype(">u4")
            h = wordhash.shingles(value, KEY)[at.ravel()]
            pack = lambda a: pa.array([r.tobytes() for r in np.ascontiguousarray(a)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(of)), pa.array(pos).cast(pa.int32()), pa.array(h.view(np.int64)), pack(left), pack(right)], names=["key", "pos", "h", "before", "after"])

    return df.mapInArrow(run, f"key {kind}, pos int, h long, before binary, after binary")


def _neighbours(batch: pa.RecordBatch, pick=None) -> pa.RecordBatch:
    """Neighbouring rows of a key (of them those that ``pick`` marks), extended both ways: key, start, end, other, other_start."""
    h, pos, keys = batch.column("h").to_numpy(), batch.column("pos").to_numpy().astype(np.int64), batch.column("key")
    before, after = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, SPAN) for c in ("before", "after"))
    i = np.flatnonzero(h[1:] == h[:-1] if pick is None else (h[1:] == h[:-1]) & pick)
    reach = lambda a: np.cumprod((a[i] == a[i + 1]) & (a[i] != 0), axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
    to_left, to_right = reach(before), reach(after)
    long = to_left + KEY + to_right >= LENGTH
    i, to_left, to_right = i[long], to_left[long], to_right[long]
    a, b = np.concatenate([i, i + 1]), np.concatenate([i + 1, i])
    begin = pos[a] - np.tile(to_left, 2)
    end = pos[a] + KEY + np.tile(to_right, 2)
    return pa.RecordBatch.from_arrays([keys.take(pa.array(a)), pa.array(begin).cast(pa.int32()), pa.array(end).cast(pa.int32()), keys.take(pa.array(b)), pa.array(pos[b] - np.tile(to_left, 2)).cast(pa.int32())], names=["key", "start", "end", "other", "other_start"])


def _joined(held: pa.RecordBatch | None, batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]


def _sorting(order: str) -> list[str]:
    return ["h", order, "before" if order == "after" else "after", "key", "pos"]


def _compare(rows: DataFrame, order: str) -> DataFrame:
    """Neighbours in the given order within each partition."""
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            batch = _joined(held, batch)
            held = batch.slice(batch.num_rows - 1) if batch.num_rows else None
            if batch.num_rows > 1:
                yield _neighbours(batch)

    return rows.sortWithinPartitions(*_sorting(order)).mapInArrow(run, f"key {kind}, start int, end int, other {kind}, other_start int")


def _compare_ranges(rows: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Neighbours in the given order over all of ``rows``, dealt by range; second: the written table behind it.

    A range's task also writes its first and its last row (``side`` 0 and 1),
    two rows a partition; in their common order each last row stands before the
    first of the next range, and only these two are compared.
    """
    kind = rows.schema["key"].dataType.simpleString()
    pair, edge = ["key", "start", "end", "other", "other_start"], ["key", "pos", "h", "before", "after"]
    empty = {"start": pa.int32(), "end": pa.int32(), "other_start": pa.int32(), "pos": pa.int32(), "h": pa.int64(), "before": pa.binary(), "after": pa.binary(), "side": pa.int32()}
    names = [*pair, *edge[1:], "side"]

    def padded(batch: pa.RecordBatch, side: int | None = None) -> pa.RecordBatch:
        own = {n: batch.column(n) for n in batch.schema.names}
        own["side"] = pa.array([side] * batch.num_rows, pa.int32())
        none = {n: pa.nulls(batch.num_rows, empty[n] if n in empty else batch.schema.field("key").type) for n in names if n not in own}
        return pa.RecordBatch.from_arrays([(own | none)[n] for n in names], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in (b.select(edge) for b in batches if b.num_rows):
            if held is None:
                yield padded(batch.slice(0, 1), 0)
            batch = _joined(held, batch)
            held = batch.slice(batch.num_rows - 1)
            if batch.num_rows > 1:
                yield padded(_neighbours(batch))
        if held is not None:
            yield padded(held, 1)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            batch = _joined(held, batch)
            held = batch.slice(batch.num_rows - 1) if batch.num_rows else None
            if batch.num_rows > 1:
                side = batch.column("side").to_numpy()
                yield _neighbours(batch, (side[:-1] == 1) & (side[1:] == 0))

    dealt = rows.select(edge).repartitionByRange(*_sorting(order)).sortWithinPartitions(*_sorting(order))
    found = materialise(dealt.mapInArrow(run, f"key {kind}, start int, end int, other {kind}, other_start int, pos int, h long, before binary, after binary, side int"), "suffix-ranges")
    edges = found.filter("side IS NOT NULL").select(*edge, "side").repartition(1).sortWithinPartitions(*_sorting(order), "side")
    between = edges.mapInArrow(across, f"key {kind}, start int, end int, other {kind}, other_start int")
    return found.filter("side IS NULL").select(pair).unionByName(between), found


def _windows(df: DataFrame) -> DataFrame:
    """For rows (key, text, runs): digest and place of every LENGTH-word window inside a run: key, pos, h1, h2."""
    kind = df.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            value, _, _, first = wordhash.words(texts)
            runs = batch.column("runs").to_pylist()
            of = np.repeat(np.arange(len(texts)), [len(r) for r in runs])
            begin, end = (np.array([x[c] for own in runs for x in own], np.int64) for c in ("start", "end"))
            many = np.maximum(np.minimum(end, np.diff(first)[of]) - LENGTH + 1 - begin, 0)  # a run is cut only where several texts share a key
            pos = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())
            of = np.repeat(of, many)
            at = first[of] + pos
            one, two = (wordhash.shingles(value, LENGTH, salt)[at] for salt in (1, 2))
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(of)), pa.array(pos).cast(pa.int32()), pa.array(one.view(np.int64)), pa.array((two >> np.uint64(32)).astype(np.uint32).view(np.int32))], names=["key", "pos", "h1", "h2"])

    return df.mapInArrow(run, f"key {kind}, pos int, h1 long, h2 int")


def _islands(spans: DataFrame, reach: int) -> DataFrame:
    """``spans`` (key, start, end, ...) with ``group``: spans of a key that begin at most ``reach`` behind the furthest end so far go together."""
    by = Window.partitionBy("key").orderBy("start", "end")
    spans = spans.withColumn("__far", F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    return spans.withColumn("group", F.sum(F.when(F.col("start") <= F.col("__far") + reach, 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("__far")


def _bar(counts: DataFrame) -> tuple[int, int]:
    """From how many rows on a key of ``counts`` (..., n) is crowded, and how many keys are."""
    bar = CROWDED
    while (many := counts.filter(F.col("n") >= bar).count()) > CROWDED_MAX:
        bar *= 2
    return bar, many


def _spread(rows: DataFrame, counts: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` (key, pos, ...) joined with the keys of ``counts`` (by, n, ...); a crowded key is dealt over about n / bar shares."""
    bar, many = _bar(counts)
    if not many:
        return rows.join(counts, by)
    shares = F.floor(F.col("n") / bar).cast("int")
    marked = rows.join(F.broadcast(counts.filter(F.col("n") >= bar).select(*by, (shares + 1).alias("__shares"))), by, "left")
    dealt = marked.withColumn("__share", F.coalesce(F.pmod(F.xxhash64("key", "pos"), F.col("__shares")), F.lit(0)).cast("int")).drop("__shares")
    return dealt.join(counts.withColumn("__share", F.explode(F.sequence(F.lit(0), shares))), [*by, "__share"]).drop("__share")


def repeated_passages(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every passage of at least LENGTH words that occurs elsewhere: key, start, end (words, end exclusive), other, first.

    ``first``: the words belong to the earliest occurrence, by key and place, of
    some repeated LENGTH words.  Removing the rows where it is false leaves that
    occurrence of each whole, and no other unless earliest occurrences of its
    neighbours hold all its words.  Touching passages are split into rows only
    where ``first`` changes, so a row may be what an earliest occurrence leaves
    of a passage.  ``other`` is the smallest key among the compared occurrences
    of the touching passages.  Words are compared in lower case (A-Z).  Null and
    short texts have no passage; null keys rank last and stand for one document,
    and repeated rows of a key are one document.  Other columns are not read.
    """
    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = suffixes(docs)
    counts = materialise(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "suffix-keys")
    bar, many = _bar(counts)
    sets = (F.collect_set(F.when(F.col("n") < bar, F.col("pos"))).alias("places"), F.collect_set(F.when(F.col("n") >= bar, F.col("pos"))).alias("crowded"))
    places = materialise(_spread(found, counts, ["h"]).groupBy("key").agg(*sets), "suffix-places")
    release(counts)
    sweep(df.sparkSession)
    by_key = lambda own: docs.join(own.withColumnRenamed("key", "__key"), F.col("key").eqNullSafe(F.col("__key"))).drop("__key")
    # Both orders read one shuffle of these rows, which has a short lineage.
    rows = _surroundings(by_key(places.filter(F.size("places") > 0).select("key", "places"))).repartition("h")
    pairs, written = _compare(rows, "after").unionByName(_compare(rows, "before")), [places]
    if many:
        crowd = materialise(_surroundings(by_key(places.filter(F.size("crowded") > 0).select("key", F.col("crowded").alias("places")))), "suffix-crowd")
        for order in ("after", "before"):
            own, found = _compare_ranges(crowd, order)
            pairs = pairs.unionByName(own)
            written.append(found)
        release(crowd)
    same = F.col("key").eqNullSafe(F.col("other"))
    pairs = pairs.filter(~(same & (F.col("start") == F.col("other_start"))))
    own = pairs.groupBy("key", "start", "end").agg(F.min("other").alias("other"))
    # Spans that share all but one of LENGTH words have no window between them that neither holds.
    runs = materialise(_islands(own, 1 - LENGTH).groupBy("key", "group").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("other").alias("other")).drop("group"), "suffix-runs")
    release(*written)
    sweep(df.sparkSession)

    windows = _windows(by_key(runs.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("runs"))))
    place = F.min(F.struct(F.col("key").isNull().alias("null"), "key", "pos")).alias("place")
    stays = windows.groupBy("h1", "h2").agg(place).select("place.key", F.col("place.pos").alias("start"), (F.col("place.pos") + LENGTH).alias("end"))
    stays = _islands(stays, 0).groupBy("key", "group").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("group")
    both = runs.withColumn("stays", F.lit(False)).unionByName(stays.withColumn("stays", F.lit(True)), allowMissingColumns=True)
    span = F.struct("start", "end", F.lit(True).alias("first"))
    whole = _islands(both, 0).groupBy("key", "group").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("other").alias("other"), F.array_sort(F.collect_list(F.when(F.col("stays"), span))).alias("stays"))
    begins = F.concat(F.array("start"), F.transform("stays", lambda x: x["end"]))
    ends = F.concat(F.transform("stays", lambda x: x["start"]), F.array("end"))
    gone = F.filter(F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("start"), b.alias("end"), F.lit(False).alias("first"))), lambda x: x["start"] < x["end"])
    return whole.select("key", "other", F.explode(F.concat("stays", gone)).alias("x")).select("key", "x.start", "x.end", "other", "x.first")


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passages of 50 words or more that occur more than once in the documents."""
    return repeated_passages(table(spark, sf_dir, "documents")).select(F.col("key").alias("doc_id"), F.col("start").alias("start_word"), F.col("end").alias("end_word"), F.col("other").alias("other_doc_id"), "first")
