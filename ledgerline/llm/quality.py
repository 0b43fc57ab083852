"""Line-level conditional random field for document quality.

A document is a chain of lines, each good or bad.  A line's evidence is what
its characters and words look like, together with the same figures of the line
before and the line after.  Forward-backward gives every line's probability of
being good, and the mean over a document's lines, weighted by their length, is
the document's quality.

Training reads a sample of labelled documents that is bounded in documents,
bytes and lines; a document's label stands for all its lines.  The likelihood
is maximised by gradient steps over a few thousand short chains, in one task:
the driver gets the weights only.  Scoring reads every document once, without
a shuffle: line figures are array sums over the bytes, and the chains of a
chunk are walked side by side.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import wordhash
from ledgerline.llm.common import chunks, table

#: Labelled documents that training reads at most, the longest it takes (bytes,
#: lines), and the lines of all together.
TRAIN_DOCS = 4000
TRAIN_BYTES = 100_000
TRAIN_LINES, ALL_LINES = 2000, 200_000
ROUNDS = 300
RIDGE = 1e-3

_KIND = np.zeros(256, np.int64)
for _name, _signs in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b".,;:'\"?()-", b"!", b"|", b"#$%&*@^~_=+<>{}[]\\/`"), 1):
    _KIND[list(_signs)] = _name
_KIND[128:] = 9
_KINDS = 10
FEATURES = _KINDS + 9
_WIDE = 3 * FEATURES + 1


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(figures, length, first) of all lines: lines first[i]:first[i+1] belong to texts[i]; every text has at least one line."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    end = np.flatnonzero(data == 10)
    start = np.concatenate([[0], end[:-1] + 1])
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    first = np.searchsorted(start, np.concatenate([[0], np.cumsum(sizes + 1)]))
    length = end - start
    kind = _KIND[data]
    line = np.repeat(np.arange(len(start)), length + 1)
    counts = np.bincount(line * _KINDS + kind, minlength=len(start) * _KINDS).reshape(-1, _KINDS).astype(float)
    counts[:, 0] -= 1  # the line feed itself
    n = np.maximum(length, 1)[:, None]

    value, word_start, word_end, word_first = wordhash.words(texts)
    text_of = np.repeat(np.arange(len(texts)), np.diff(word_first))
    at = word_start + (np.cumsum(sizes + 1) - sizes - 1)[text_of]
    word_line = np.searchsorted(start, at, side="right") - 1
    words = np.bincount(word_line, minlength=len(start)).astype(float)
    # The same word twice in a document, and how often it recurs there.
    key = wordhash.mix(value ^ (text_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    long_word = (word_end - word_start) >= 6
    again = np.bincount(word_line, weights=(times[inverse] > 1) & long_word, minlength=len(start))
    longs = np.bincount(word_line, weights=long_word, minlength=len(start))
    twice = np.concatenate([[False], (value[1:] == value[:-1]) & (text_of[1:] == text_of[:-1])]) if len(value) else np.zeros(0, bool)
    echo = np.bincount(word_line, weights=twice, minlength=len(start))
    sign = np.isin(kind, (6, 7, 8))
    tail = np.bincount(word_line, weights=sign[np.minimum(at + (word_end - word_start) - 1, len(sign) - 1)], minlength=len(start))
    w = np.maximum(words, 1)
    text_words = np.diff(word_first).astype(float)
    own = np.column_stack([counts / n, np.log1p(length) / 5, np.log1p(words) / 5, np.minimum(length / w / 10, 5), again / np.maximum(longs, 1), tail / w, echo / w, (words == 0), np.minimum(counts[:, 2] / w, 3), np.repeat(np.log1p(text_words), np.diff(first)) / 5])
    return own, length, first


def sample_features(texts: list[bytes], limit: int = 500_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """line_features() of a sample, taken in pieces of about ``limit`` bytes so that the byte arrays stay small."""
    parts, begin, held = [], 0, 0
    for i, text in enumerate([*texts, b""]):
        if i == len(texts) or i > begin and held + len(text) > limit:
            parts.append(line_features(texts[begin:i]))
            begin, held = i, 0
        held += len(text)
    lines = np.concatenate([np.diff(first) for _, _, first in parts])
    return np.concatenate([own for own, _, _ in parts]), np.concatenate([length for _, length, _ in parts]), np.concatenate([[0], np.cumsum(lines)])


def with_neighbours(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A line's figures, those of the lines before and after it in its text (zeros beyond the ends), and a constant."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    return np.hstack([own, before, after, np.ones((len(own), 1))])


def marginals(unary: np.ndarray, first: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward on many two-state chains side by side.

    ``unary``: log-odds of good for each line; ``pair``: 2 x 2 log weights.
    Returns each line's probability of good, each chain's log normaliser and
    the expected number of each transition in all chains.
    """
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    begin, size = first[:-1][order], lengths[order]
    steps = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(steps), side="left")  # chains longer than t
    score = np.column_stack([np.zeros(len(unary)), unary])
    forward, backward = np.zeros((len(unary), 2)), np.zeros((len(unary), 2))
    alpha = None
    for t in range(steps):
        at = begin[: active[t]] + t
        if alpha is None:
            alpha = score[at]
        else:
            held = alpha[: active[t]]
            alpha = score[at] + np.logaddexp(held[:, :1] + pair[0], held[:, 1:] + pair[1])
        forward[at] = alpha
    ends = first[1:] - 1
    log_z = np.logaddexp(forward[ends, 0], forward[ends, 1])
    for t in range(steps - 2, -1, -1):
        at = begin[: active[t + 1]] + t
        after = score[at + 1] + backward[at + 1]
        backward[at, 0] = np.logaddexp(pair[0, 0] + after[:, 0], pair[0, 1] + after[:, 1])
        backward[at, 1] = np.logaddexp(pair[1, 0] + after[:, 0], pair[1, 1] + after[:, 1])
    whole = np.repeat(log_z, lengths)
    good = np.exp(np.minimum(forward[:, 1] + backward[:, 1] - whole, 0.0))
    inner = np.ones(len(unary), bool)
    inner[ends] = False
    i = np.flatnonzero(inner)
    expected = np.array([[np.exp(forward[i, a] + pair[a, b] + score[i + 1, b] + backward[i + 1, b] - whole[i]).sum() for b in (0, 1)] for a in (0, 1)])
    return good, log_z, expected


class LineCrf:
    """Weights of the line figures and of the transitions."""

    def __init__(self, weights: np.ndarray, pair: np.ndarray, centre: np.ndarray, scale: np.ndarray, slope: float, shift: float) -> None:
        self.weights, self.pair, self.centre, self.scale, self.slope, self.shift = weights, pair, centre, scale, slope, shift

    @classmethod
    def constant(cls, share: float) -> LineCrf:
        """The model of a sample with one kind of label, or none: the share of good ones."""
        share = min(max(share, 0.01), 0.99)
        zero = np.zeros(_WIDE)
        zero[-1] = np.log(share / (1 - share))
        return cls(zero, np.zeros((2, 2)), np.zeros(_WIDE), np.ones(_WIDE), 1.0, 0.0)

    @classmethod
    def fit(cls, texts: list[bytes], labels: np.ndarray) -> LineCrf:
        """Maximum likelihood with a ridge, by Adam steps over all chains; then the aggregate is calibrated."""
        if not len(texts) or labels.min() == labels.max():
            return cls.constant(float(labels.mean()) if len(labels) else 0.5)
        own, length, first = sample_features(texts)
        x = with_neighbours(own, first)
        centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        centre[-1], scale[-1] = 0.0, 1.0
        x = (x - centre) / scale
        y = np.repeat(labels, np.diff(first)).astype(float)
        chains = len(texts)
        inner = np.ones(len(y), bool)
        inner[first[1:] - 1] = False
        i = np.flatnonzero(inner)
        seen = np.array([[((y[i] == a) & (y[i + 1] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
        theta, m, v = np.zeros(_WIDE + 4), np.zeros(_WIDE + 4), np.zeros(_WIDE + 4)
        for step in range(1, ROUNDS + 1):
            weights, pair = theta[:_WIDE], theta[_WIDE:].reshape(2, 2)
            good, _, expected = marginals(x @ weights, first, pair)
            gradient = np.concatenate([(y - good) @ x, (seen - expected).ravel()]) / chains - RIDGE * theta
            m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
            theta = theta + 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        out = cls(theta[:_WIDE], theta[_WIDE:].reshape(2, 2), centre, scale, 1.0, 0.0)
        out._calibrate(out._mean(own, length, first), labels)
        return out

    def _calibrate(self, mean: np.ndarray, labels: np.ndarray) -> None:
        """Logistic fit of the labels on the log-odds of the aggregate, so that one half is where either label is as likely."""
        z = np.log(mean / (1 - mean))
        a, b = 1.0, 0.0
        for _ in range(500):
            p = 1 / (1 + np.exp(-(a * z + b)))
            a += 0.1 * ((labels - p) @ z / len(z) - 1e-3 * (a - 1))
            b += 0.1 * ((labels - p).mean() - 1e-3 * b)
        self.slope, self.shift = max(a, 0.05), b

    def _mean(self, own: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
        x = (with_neighbours(own, first) - self.centre) / self.scale
        good, _, _ = marginals(x @ self.weights, first, self.pair)
        weight = length + 1.0
        mean = np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])
        return np.clip(mean, 1e-6, 1 - 1e-6)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Quality of every text, 0 to 1."""
        mean = self._mean(*line_features(texts))
        return 1 / (1 + np.exp(-(self.slope * np.log(mean / (1 - mean)) + self.shift)))


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> LineCrf:
    """Fit on at most TRAIN_DOCS labelled documents, chosen by a hash of their key; held-out keys are left out.

    Documents beyond TRAIN_BYTES or TRAIN_LINES are not used, nor rows with a
    null key, label or text; of several labels for one key the smallest counts,
    and of several texts the smallest.  Documents are taken in the order of that
    hash until their lines reach ALL_LINES.  Without a labelled document, or
    with one kind of label only, the model is a constant.  Other columns are not
    read, so their names cannot clash.
    """
    marks = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("__key")).agg(F.min(F.col(label).cast("double")).alias("__label"))
    usable = (F.octet_length(text) <= TRAIN_BYTES) & (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) < TRAIN_LINES)
    there = docs.filter(usable).select(F.col(key).alias("__key")).distinct()
    place = F.md5(F.col("__key").cast("string").cast("binary"))
    chosen = marks.join(there, "__key", "left_semi").orderBy(place, "__key").limit(TRAIN_DOCS)
    rows = docs.filter(usable).select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(F.broadcast(chosen), "__key")
    rows = rows.groupBy("__key", "__label").agg(F.min("__text").alias("text")).select(place.alias("place"), F.col("__label").alias("label"), "text")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels, lines = [], [], 0
        for batch in batches:
            for value, mark in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                lines += value.count("\n") + 1
                if lines <= ALL_LINES:
                    texts.append(value.encode())
                    labels.append(mark)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(LineCrf.fit(texts, np.array(labels, float)))])], names=["model"])

    # At most TRAIN_DOCS rows meet in the one task that fits.
    fitted = rows.repartition(1).sortWithinPartitions("place").mapInArrow(fit, "model binary").first()
    return pickle.loads(fitted["model"]) if fitted else LineCrf.constant(0.5)


def score_quality(df: DataFrame, model: LineCrf, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with ``out``, the quality of each text; null counts as empty, which is one empty line.

    Each text is scored on its own, so repeated rows and equal texts get equal
    scores; an empty table gives an empty table.  A very long text takes about
    thirty bytes of memory a byte and a few hundred a line.  An input column
    called ``out`` is refused.
    """
    if out in df.columns:
        raise ValueError(f"the table already has a column {out}")
    held = df.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text, 1_000_000):
            if batch.num_rows:
                yield batch.append_column(out, pa.array(held.value.score([(t or "").encode() for t in batch.column(text).to_pylist()]), pa.float64()))

    return df.mapInArrow(run, f"{fields}, {out} double")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, train(docs, table(spark, sf_dir, "labels"))).drop("text")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
