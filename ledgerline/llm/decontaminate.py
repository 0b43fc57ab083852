"""Benchmark decontamination by SimHash windows.

Every document position carries a 64-bit SimHash of an item-sized window of
five-word shingles.  Item lengths fall into classes a factor of about 1.3
apart; an item is represented by windows of its class size (its first, its
last and those between at that spacing), so a leaked item has a window equal
in size and place to one of its own.  Windows of all positions are summed from
one running count per bit.

Fingerprints are split into four blocks of 16 bits.  Two that differ in at
most seven bits differ in at most one bit of some block, so looking up every
block with its one-bit neighbours finds all fingerprints within the radius.
Each candidate is aligned to the whole item and kept if the weighted Jaccard
similarity of the shingles (weights: how often a shingle occurs) is at least
0.8.  The documents are not shuffled.

A changed item can have all those windows beyond the radius.  So each of its
shingles is a window too, the shortest one, whose fingerprint is the shingle
itself and is looked up exactly: similarity 0.8 needs 0.8 of an item's shingles
in as many words, and every alignment that has them is compared.  For items of
five words or more this finds what comparing every alignment would find.

What is reported is counted again on the words themselves, not on hashes.

The benchmark is read in blocks of bounded size.  Each block is indexed and
sent to the tasks, and the documents are scanned once per block and written
before the next one, so a large benchmark costs more passes and not more memory.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ledgerline.llm import wordhash
from ledgerline.llm.common import chunks, materialise, release, table

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 7
#: Window sizes in words; below five words a window is one shingle of its own size.
CLASSES = (1, 2, 3, 4, 5, 6, 8, 10, 13, 17, 22, 29, 38, 49, 64, 83, 108, 140, 182, 237)
#: Bytes of benchmark text that one pass indexes.
BLOCK_BYTES = 16_000_000
_BLOCKS, _WIDTH = 4, 16


def _exact(one: list[bytes], two: list[bytes]) -> float:
    """Weighted Jaccard similarity of the shingles of two word lists."""
    k = min(SHINGLE, len(one), len(two))
    a, b = (Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) for w in (one, two))
    shared = (a & b).total()
    return shared / (a.total() + b.total() - shared)


def window_counts(value: np.ndarray) -> np.ndarray:
    """Running count, modulo 256, of set bits per bit position: row i covers the features before i."""
    bits = np.unpackbits(value.view(np.uint8).reshape(-1, 8), axis=1)
    counts = np.zeros((len(value) + 1, 64), np.uint8)
    np.cumsum(bits, axis=0, dtype=np.uint8, out=counts[1:])
    return counts


def window_prints(counts: np.ndarray, features: int) -> np.ndarray:
    """SimHash of every window of ``features`` (at most 255) consecutive features: a bit is set where more than half have it."""
    inside = counts[features:] - counts[:-features]
    return np.packbits(inside > features // 2, axis=1).view(np.uint64).ravel()


class BenchmarkIndex:
    """Fingerprints of benchmark items by class and 16-bit block, and the items' shingles."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        texts = [t.encode() for _, t in items]
        value, _, _, first = wordhash.words(texts)
        self.ids, self.texts = [i for i, _ in items], texts
        self.lengths = np.diff(first)
        self.shingles: list[tuple[np.ndarray, np.ndarray]] = []
        found: dict[int, list[tuple[int, int, int]]] = {}
        for item, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            n = b - a
            if not n:
                self.shingles.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
                continue
            # Two words of room, so that a changed word at one end leaves the window at the other end whole.
            size = max(c for c in CLASSES if c <= (n - 2 if n >= SHINGLE + 2 else n))
            k = min(SHINGLE, n)
            self.shingles.append(np.unique(wordhash.shingles(value[a:b], k), return_counts=True))
            own = window_prints(window_counts(wordhash.shingles(value[a:b], min(SHINGLE, size))), size - min(SHINGLE, size) + 1)
            found.setdefault(size, []).extend((int(own[j]), item, j) for j in sorted({*range(0, n - size + 1, size), n - size}))
        self.classes = {}
        near = np.array([0] + [1 << b for b in range(_WIDTH)], np.uint16)
        for size, rows in found.items():
            prints = np.array([r[0] for r in rows], np.uint64)
            blocks = []
            for b in range(_BLOCKS):
                keys = ((prints >> np.uint64(b * _WIDTH)).astype(np.uint16)[:, None] ^ near).ravel()
                order = np.argsort(keys, kind="stable")
                ends = np.searchsorted(keys[order], np.arange((1 << _WIDTH) + 1))
                blocks.append((ends, order // len(near)))
            self.classes[size] = (prints, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), blocks)
        owned = [s if n >= SHINGLE else s[:0] for (s, _), n in zip(self.shingles, self.lengths.tolist(), strict=True)]
        keys = np.concatenate([np.zeros(0, np.uint64), *owned])
        order = np.argsort(keys, kind="stable")
        self.keys, self.key_items = keys[order], np.repeat(np.arange(len(owned)), [len(s) for s in owned])[order]
        self.shift = np.uint64(64 - max(16, (8 * len(keys)).bit_length()))
        self.seen = np.zeros(1 << (64 - int(self.shift)), bool)  # the keys' leading bits, to pass over most shingles
        self.seen[self.keys >> self.shift] = True

    def alignments(self, full: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(text, item, begins): where as many words as the item has (or the whole of a shorter text) hold SIMILARITY of its shingles' number.

        ``full``: the shingle that begins at each word of all texts.
        """
        at = np.flatnonzero(self.seen[full >> self.shift])
        low, high = (np.searchsorted(self.keys, full[at], side) for side in ("left", "right"))
        text = np.searchsorted(first, at, side="right") - 1
        many = np.where(at + SHINGLE <= first[text + 1], high - low, 0)
        item = self.key_items[np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())]
        text, at = np.repeat(text, many), np.repeat(at, many)
        order = np.lexsort((at, item, text))
        text, item, at = text[order], item[order], at[order]
        edge = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (item[1:] != item[:-1])])) if len(at) else at
        size = np.diff(np.append(edge, len(at)))
        need = np.ceil(SIMILARITY * (self.lengths[item[edge]] - SHINGLE + 1) - 1e-9)
        for e, m, k in zip(edge[size >= need].tolist(), size[size >= need].tolist(), need[size >= need].tolist(), strict=True):
            t, i, hits = int(text[e]), int(item[e]), at[e : e + m]
            n = min(int(self.lengths[i]), int(first[t + 1] - first[t]))
            # k hits in a row lie in the n words of an alignment that begins at the first of them or so much earlier that the last still fits.
            k = int(k)
            spots = [np.arange(max(b - n + SHINGLE, int(first[t])), min(a, int(first[t + 1]) - n) + 1) for a, b in zip(hits[: m - k + 1].tolist(), hits[k - 1 :].tolist(), strict=True) if b - a <= n - SHINGLE]
            if spots:
                yield t, i, np.unique(np.concatenate(spots))

    def distance(self, item: int, value: np.ndarray) -> int:
        """Bits that differ between the SimHash of the whole item and that of the words."""
        theirs, weights = self.shingles[item]
        ours, counts = np.unique(wordhash.shingles(value, min(SHINGLE, len(value))), return_counts=True)
        bits = [(np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1) * w[:, None]).sum(axis=0) > w.sum() // 2 for x, w in ((theirs, weights), (ours, counts))]
        return int((bits[0] != bits[1]).sum())

    def candidates(self, size: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, row, distance) of every window and indexed row within the radius."""
        own, _, _, blocks = self.classes[size]
        pairs = []
        for b, (ends, rows) in enumerate(blocks):
            key = (prints >> np.uint64(b * _WIDTH)).astype(np.uint16)
            hit = np.flatnonzero((ends[1:] > ends[:-1])[key])
            begin, many = ends[key[hit]], ends[key[hit].astype(np.int64) + 1] - ends[key[hit]]
            window = np.repeat(hit, many)
            row = rows[np.repeat(begin - np.cumsum(many) + many, many) + np.arange(len(window))] if len(window) else window
            distance = np.bitwise_count(prints[window] ^ own[row])
            close = distance <= RADIUS
            pairs.append((window[close] * len(own) + row[close]).astype(np.int64))
        both = np.unique(np.concatenate(pairs))
        window, row = np.divmod(both, len(own))
        return window, row, np.bitwise_count(prints[window] ^ own[row])

    def similarity(self, item: int, value: np.ndarray) -> float:
        """Weighted Jaccard similarity of an item's shingles and those of as many words."""
        theirs, weights = self.shingles[item]
        ours, counts = np.unique(wordhash.shingles(value, min(SHINGLE, len(value))), return_counts=True)
        _, i, j = np.intersect1d(theirs, ours, assume_unique=True, return_indices=True)
        shared = int(np.minimum(weights[i], counts[j]).sum())
        return shared / (int(weights.sum()) + int(counts.sum()) - shared)

    def leaks(self, texts: list[bytes]) -> list[list[tuple[int, float, int, int, int]]]:
        """For each text, the best match of every item in it: (item, similarity, distance, start, end), offsets in code points."""
        out: list[list[tuple[int, float, int, int, int]]] = [[] for _ in texts]
        value, start, end, first = wordhash.words(texts)
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        tried: set[tuple[int, int]] = set()
        counted: dict[int, np.ndarray] = {}
        last = first[1:][np.repeat(np.arange(len(texts)), np.diff(first))]  # where each word's text ends
        for size, (_, item_of, place_of, _) in self.classes.items():
            k = min(SHINGLE, size)
            if len(value) < size:
                continue
            if k not in counted:
                counted[k] = window_counts(wordhash.shingles(value, k))
            prints = window_prints(counted[k], size - k + 1)
            window, row, distance = self.candidates(size, prints)
            inside = window + size <= last[window]
            for w, r, d in zip(window[inside].tolist(), row[inside].tolist(), distance[inside].tolist(), strict=True):
                item = int(item_of[r])
                n = int(self.lengths[item])
                text = int(np.searchsorted(first, w, side="right")) - 1
                a = min(max(w - int(place_of[r]), int(first[text])), int(first[text + 1]) - n)
                if a < first[text] or (a, item) in tried:
                    continue
                tried.add((a, item))
                s = self.similarity(item, value[a : a + n])
                if s >= SIMILARITY and (text, item) not in best or (text, item) in best and s > best[text, item][0]:
                    best[text, item] = (s, d, a)
        for text, item, begins in self.alignments(wordhash.shingles(value, SHINGLE), first):
            n = int(self.lengths[item])
            for a in begins.tolist():
                had = best.get((text, item))
                if had and had[0] == 1:
                    break
                if (a, item) in tried:
                    continue
                words = value[a : min(a + n, int(first[text + 1]))]
                s = self.similarity(item, words)
                if s >= SIMILARITY and (not had or s > had[0]):
                    best[text, item] = (s, self.distance(item, words), a)
        tokens = wordhash.lowered(texts).split() if best else []
        for (text, item), (_, d, a) in sorted(best.items()):
            data = texts[text]
            s = _exact(wordhash.lowered([self.texts[item]]).split(), tokens[a : min(a + int(self.lengths[item]), int(first[text + 1]))])
            if s < SIMILARITY:
                continue
            b, e = int(start[a]), int(end[min(a + int(self.lengths[item]), int(first[text + 1])) - 1])
            begin = len(data[:b].decode())
            out[text].append((self.ids[item], s, d, begin, begin + len(data[b:e].decode())))
        return out


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[object, str]]]:
    """The benchmark's items in blocks of about BLOCK_BYTES, chosen by hash."""
    items = benchmark.select(F.col(item).alias("item"), F.col(text).alias("text")).filter("item IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    many = max(1, -(-total // BLOCK_BYTES))
    for i in range(many):
        rows = items if many == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(many)) == i)
        if block := sorted({(r["item"], r["text"]) for r in rows.collect()}):
            yield block


def find_leaks(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", out: str = "leaks") -> DataFrame:
    """``df`` with ``out``: array of structs (item, similarity, distance, start, end), one for each benchmark item found.

    Offsets are code points of the best window, which is as many words as the item
    has, or the whole of a shorter text; of equally similar windows an earlier
    one found counts.  Item ids may be of any type that can be ordered.  Null and
    empty texts hold nothing; null or empty items, and items with a null id,
    match nothing.  Items under five words match where the same words stand in a
    row.  An empty table or benchmark gives empty arrays at most.  Texts of any
    length are scanned whole.  An input column called ``out`` is refused.  Each
    row is judged on its own, so repeated rows get equal results.
    """
    if out in df.columns:
        raise ValueError(f"the table already has a column {out}")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    names = ("item", "similarity", "distance", "start", "end")
    id_type = benchmark.schema[item].dataType
    kind = pa.list_(pa.struct([("item", to_arrow_type(id_type)), ("similarity", pa.float64()), ("distance", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    leak = f"array<struct<item:{id_type.simpleString()},similarity:double,distance:int,start:int,end:int>>"
    held = None
    for block in _blocks(benchmark, item, item_text):
        index = df.sparkSession.sparkContext.broadcast(BenchmarkIndex(block))
        first = out not in df.columns
        if not first:
            # One block's index at a time: what is found so far is written down.
            df, before = materialise(df, "leaks"), held
            if before is not None:
                release(before)
            held = df

        def scan(batches: Iterator[pa.RecordBatch], index=index, first=first) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches, text, 500_000):
                texts = [(t or "").encode() for t in batch.column(text).to_pylist()]
                found = [[dict(zip(names, x, strict=True)) for x in row] for row in index.value.leaks(texts)]
                if not first:
                    found = [a + b for a, b in zip(batch.column(out).to_pylist(), found, strict=True)]
                    batch = batch.drop_columns([out])
                yield batch.append_column(out, pa.array(found, kind))

        df = df.mapInArrow(scan, f"{fields}, `{out}` {leak}")
    return df if out in df.columns else df.withColumn(out, F.array().cast(leak))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that it contains."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("leaks").alias("leak"))
    return found.select("doc_id", F.col("leak.item").alias("item_id"), F.round("leak.similarity", 6).alias("similarity"), F.col("leak.distance").alias("distance"), F.col("leak.start").alias("start"), F.col("leak.end").alias("end"))
