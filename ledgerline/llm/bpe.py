"""Byte-pair encoding and decoding with a given vocabulary.

Merging follows the contiguous rank array: a word's part boundaries stand in
one list, and beside each boundary stands the rank of the pair that begins
there.  The list is scanned for the smallest rank, the boundary between the
two parts is deleted, and the ranks of the two neighbouring pairs are looked
up again, until no pair has a rank.  For words of a few dozen bytes this scan
beats a heap.  A scan for each merge would take the square of a long word's
length, so above SHORT symbols the same merges in the same order come from a
heap of (rank, place) over linked parts.  Words recur, so each task keeps a
bounded memory of word to ids.

``BpeModel`` reads a tokenizer file whose texts are normalised (NFC, white
space to one space, lower case), split by a pattern, mapped to byte symbols
and ended by a word-end mark.  Files with other parts are refused.  Characters
that Unicode gained after version 15.1 may be classed differently than there.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import chunks, table

#: Words that a task remembers, and the longest of them; beyond the number it starts anew.
MEMORY, LONGEST = 150_000, 64
#: Words above this many symbols take their merges from a heap.
SHORT = 512
_NONE = 1 << 60
_SPACE, _SEPARATORS = regex.compile(r"\s+"), re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others from code point 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class BpeModel:
    """A vocabulary, its merge ranks and its text rules, from a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, norm, pre = spec["model"], spec["normalizer"], spec["pre_tokenizer"]
        steps = [n["type"] for n in norm["normalizers"]]
        splits = [p["type"] for p in pre["pretokenizers"]]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or splits != ["Split", "ByteLevel"] or model.get("continuing_subword_prefix") or model.get("byte_fallback"):
            raise ValueError(f"unsupported tokenizer: {model['type']}, {steps}, {splits}")
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        # A pair of part ids gives the merge's rank; the rank gives the merged id.
        self.pairs: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, (a, b) in enumerate(map(tuple, (m if isinstance(m, list) else m.split(" ") for m in model["merges"]))):
            self.pairs.setdefault(self.vocab[a] << 32 | self.vocab[b], rank)
            self.merged.append(self.vocab[a + b])
        self.split = regex.compile(pre["pretokenizers"][0]["pattern"]["Regex"])
        self.symbols = byte_symbols()
        self.inner = [self.vocab.get(s) for s in self.symbols]
        self.last = [self.vocab.get(s + self.end) for s in self.symbols]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        names = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.added.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.known: dict[str, tuple[int, ...]] = {}  # by word
        self.seen: dict[str, tuple[int, ...]] = {}  # by what stands between spaces

    def _merge(self, parts: list[int]) -> list[int]:
        """Contiguous rank array over the ids of a word's parts."""
        get, merged = self.pairs.get, self.merged
        ranks = [get(a << 32 | b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == _NONE:
                break
            i = ranks.index(best)
            parts[i] = here = merged[best]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(here << 32 | parts[i + 1], _NONE)
            if i:
                ranks[i - 1] = get(parts[i - 1] << 32 | here, _NONE)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same merges for long words, the next one from a heap: n log n steps."""
        get, n = self.pairs.get, len(parts)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, i) for i, r in enumerate(get(a << 32 | b, _NONE) for a, b in zip(parts, parts[1:], strict=False)) if r != _NONE]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            j = after[i]
            # Of a pair that has changed since, the heap holds the new rank too.
            if parts[i] < 0 or j >= n or get(parts[i] << 32 | parts[j], _NONE) != rank:
                continue
            parts[i], parts[j] = self.merged[rank], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := get(parts[i] << 32 | parts[k], _NONE)) != _NONE:
                    heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := get(parts[h] << 32 | parts[i], _NONE)) != _NONE:
                heappush(heap, (r, h))
        return [p for p in parts if p >= 0]

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of one piece of text that the split pattern has found."""
        raw = word.encode()
        parts = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        parts = [p for p in parts if p is not None]
        return tuple(self._merge(parts) if len(parts) <= SHORT else self._merge_long(parts))

    def _between(self, run: str) -> tuple[int, ...]:
        """Ids of a run of text without white space."""
        run = unicodedata.normalize("NFC", run)
        run = run.lower() if run.isascii() else "".join(map(str.lower, run))  # each character by itself: no final-sigma rule
        known, out = self.known, []
        for w in self.split.findall(run):
            ids = known.get(w)
            if ids is None:
                ids = self.word(w)
                if len(w) <= LONGEST:
                    if len(known) >= MEMORY:
                        known.clear()
                    known[w] = ids
            out += ids
        return tuple(out)

    def _ids(self, text: str, out: list[int]) -> None:
        """The split pattern takes no white space, so runs between it stand alone.  (Python also splits at four control characters that are not white space.)"""
        seen = self.seen
        for run in text.split() if not _SEPARATORS.search(text) else _SPACE.split(text):
            ids = seen.get(run)
            if ids is None:
                ids = self._between(run)
                if len(run) <= LONGEST:
                    if len(seen) >= MEMORY:
                        seen.clear()
                    seen[run] = ids
            out += ids

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; strings of special tokens become those tokens, nothing is added."""
        out: list[int] = []
        at = 0
        for m in self.specials.finditer(text) if self.specials else ():
            self._ids(text[at : m.start()], out)
            out.append(self.added[m[0]])
            at = m.end()
        self._ids(text[at:], out)
        return out

    def forget(self) -> None:
        """Let remembered words go: a task's worker is used again, by other stages."""
        self.known.clear()
        self.seen.clear()

    def decode(self, ids: list[int]) -> str:
        """Tokens' names joined by spaces, as a file without a decoder asks for."""
        names = self.names
        return " ".join([names[i] for i in ids])


@lru_cache(maxsize=4)
def model(path: str) -> BpeModel:
    return BpeModel(path)


def bpe_path() -> str:
    """Where the installed vocabulary files are; looked up where it is used, on each executor."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_texts(df: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """``df`` with ``out``: the text's ids as array<int>.  Null counts as empty (no ids); an input column called ``out`` is refused."""
    if out in df.columns:
        raise ValueError(f"the table already has a column {out}")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path or bpe_path())
        for batch in chunks(batches, text):
            ids = [np.array(m.encode(t or ""), np.int32) for t in batch.column(text).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield batch.append_column(out, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))

    return df.mapInArrow(run, f"{fields}, {out} array<int>")


def decode_ids(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """``df`` with ``out``: the text of its ids; null ids count as none."""
    if out in df.columns:
        raise ValueError(f"the table already has a column {out}")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path or bpe_path())
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                yield part.append_column(out, pa.array([m.decode(i or []) for i in part.column(ids).to_pylist()], pa.string()))

    return df.mapInArrow(run, f"{fields}, {out} string")


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256 of every document, encoded and decoded in one pass (one Python worker a task, one model each).

    A null text counts as empty: no ids, and the digests of nothing.  Null keys
    stay, repeated rows give repeated results, an empty table an empty one.
    Whole texts are encoded whatever their length; a row's ids are held at once.
    Other columns are not read, so their names cannot clash.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(bpe_path())
        try:
            for batch in chunks(batches, "text", 500_000):
                n, of_ids, of_text = [], [], []
                for t in batch.column("text").to_pylist():
                    ids = m.encode(t or "")
                    n.append(len(ids))
                    of_ids.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                    of_text.append(hashlib.sha256(m.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])
        finally:
            m.forget()

    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("key", key)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return digests(table(spark, sf_dir, "documents"))
