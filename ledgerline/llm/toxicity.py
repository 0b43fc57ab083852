"""Toxic passages: maximum-scoring segments over word log-odds.

A feature is a whole word or the beginning of one.  Its weight is the log-odds
of toxic against other documents with a Dirichlet prior that has the shape of
both together (Monroe, Colaresi and Quinn), moved two standard errors towards
zero, so that uncertain features weigh nothing; a feature that does not differ
from its own beginning weighs as that.  A word scores as its longest feature
that occurs often enough, less a drift that every word costs.

One scan finds all maximal scoring segments of a text (Ruzzo and Tompa): these
are its candidate passages.  Scores of clean text have an extreme-value law
(Karlin and Altschul): a text of n words holds a Poisson number of segments of
score S or more, with mean E = K n exp(-lambda S).  Lambda is the positive root
of E[exp(lambda s)] = 1 over clean words, K the likelihood's maximum over clean
documents.  The r-th best segment's probability is that of r such events or
more; the evidence of a document is its rarest r, and a logistic fit turns that
into the score.

The model is fitted in one task on a bounded sample of labelled documents.
Every document is then scored whole, on its own, without a shuffle.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import chunks, table

#: Labelled documents that training reads at most, the longest it takes, and the bytes of all together.
TRAIN_DOCS, TRAIN_BYTES, ALL_BYTES = 8000, 100_000, 64_000_000
#: Words that the prior counts for, standard errors that a weight is moved towards zero, cost of a word.
PRIOR, ERRORS, DRIFT = 1000.0, 2.0, 0.5
#: Standard errors from which a feature differs from its beginning.
DIFFERS = 3.0
#: Letters of the beginnings that are features, how often a word counts in one document, and occurrences that a feature needs.
BEGINNINGS, OFTEN, ENOUGH = range(8, 2, -1), 4, 10
#: Expected number of chance segments below which a passage is reported.
SIGNIFICANT = 0.05
#: Words a task remembers; beyond the number it starts anew.
REMEMBERED = 300_000

_WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """The word itself, marked by a blank at its end, and its beginnings, the longest first."""
    return [f"{word} ", *(word[:k] for k in BEGINNINGS if k <= len(word))]


def maximal_segments(at: np.ndarray, score: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """(first word, last word, score) of all maximal scoring segments.

    ``at``: places of the words of positive score, ascending; ``score``: those
    scores; every word between costs ``drift``.  Linear in the places.
    """
    found: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum to the end, nearest earlier with a smaller sum before
    total, previous = 0.0, -1
    for place, gain in zip(at.tolist(), score.tolist(), strict=True):
        total -= drift * (place - previous - 1)
        first, before, after = place, total, total + gain
        total, previous = after, place
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= after:
                found.append((first, place, before, after, j))
                break
            first, before = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, after - before) for a, b, before, after, _ in found]


def at_least(r: int, mean: float) -> float:
    """Minus the natural logarithm of the probability that a Poisson variable of this mean is r or more."""
    if mean > r:  # no evidence
        return 0.0
    term, total, k = 1.0, 1.0, r
    while term > 1e-12 * total:
        k += 1
        term *= mean / k
        total += term
    return max(0.0, mean - r * math.log(max(mean, 1e-300)) + math.lgamma(r + 1) - math.log(total))


class ToxicModel:
    """Weights of features, the law of clean segments, and the logistic fit."""

    def __init__(self, weights: dict[str, float], decay: float, rate: float, slope: float, shift: float) -> None:
        self.weights, self.decay, self.rate, self.slope, self.shift = weights, decay, rate, slope, shift
        self._known: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": {}}

    def word(self, word: str) -> float:
        """Score of a word as it stands in the text."""
        got = self._known.get(word)
        if got is None:
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            got = self._known[word] = next((self.weights[f] for f in features(word.lower()) if f in self.weights), 0.0) - DRIFT
        return got

    def segments(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """The number of words, and the maximal segments by word."""
        words = _WORD.findall(text)
        known = self._known
        scores = [known[w] if w in known else self.word(w) for w in words]
        at = [i for i, s in enumerate(scores) if s > 0]
        if not at:
            return len(words), []
        # What words between two positive ones cost beyond the drift counts where it stands.
        value = np.array(scores)
        places, gains = np.array(at), value[at]
        if len(places) > 1:
            run = np.concatenate([[0.0], np.cumsum(np.where(value > 0, 0.0, value + DRIFT))])
            extra = np.concatenate([[0.0], run[places[1:]] - run[places[:-1]]])
        else:
            extra = np.zeros(1)
        if extra.any():
            # Fold the extra cost into the gap: as if that many more words stood there.
            stretched = places + np.round(np.cumsum(-extra) / DRIFT).astype(np.int64)
            back = dict(zip(stretched.tolist(), places.tolist(), strict=True))
            return len(words), [(back[a], back[b], s) for a, b, s in maximal_segments(stretched, gains, DRIFT)]
        return len(words), maximal_segments(places, gains, DRIFT)

    def expected(self, n: int, score: float) -> float:
        """Chance segments of this score or more in n words of clean text."""
        return self.rate * max(n, 1) * math.exp(-self.decay * score)

    def evidence(self, n: int, segments: list[tuple[int, int, float]]) -> float:
        best = sorted((s for _, _, s in segments), reverse=True)
        return max((at_least(r, self.expected(n, s)) for r, s in enumerate(best[:50], 1)), default=0.0)

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * math.log1p(evidence) + self.shift))))

    def read(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """(score, significant passages as (begin, end, expected number of chance ones)) of a text, offsets in code points, end exclusive."""
        n, found = self.segments(text)
        passages = [(a, b, self.expected(n, s)) for a, b, s in found]
        passages = [p for p in passages if p[2] <= SIGNIFICANT]
        if passages:
            spans = [m.span() for m in _WORD.finditer(text)]
            passages = [(spans[a][0], spans[b][1], e) for a, b, e in passages]
        return self.probability(self.evidence(n, found)), passages

    @classmethod
    def constant(cls, share: float) -> ToxicModel:
        """The model of a sample with one kind of label, or none."""
        share = min(max(share, 0.01), 0.99)
        return cls({}, 1.0, 1.0, 0.0, math.log(share / (1 - share)))

    @classmethod
    def fit(cls, texts: list[str], labels: list[bool]) -> ToxicModel:
        if not texts or len(set(labels)) < 2:
            return cls.constant(sum(labels) / len(labels) if labels else 0.5)
        words, all_words = (Counter(), Counter()), Counter()
        seen = set()
        for text, label in zip(texts, labels, strict=True):
            own: Counter[str] = Counter()
            for line in text.split("\n"):
                # Lines that copies share count once.
                if (label, line) not in seen:
                    seen.add((label, line))
                    own.update(w.lower() for w in _WORD.findall(line))
            if not label:
                all_words.update(own)
            for word, n in own.items():
                words[label][word] += min(n, OFTEN)
        counts: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
        for label in (0, 1):
            for word, n in words[label].items():
                for f in features(word):
                    counts[label][f] += n
        n0, n1 = (max(words[k].total(), 1) for k in (0, 1))
        weights, share = {"": 0.0}, {"": n1 / (n0 + n1)}
        # The shorter first: a feature that its own beginning explains weighs as that.
        for f in sorted(counts[1] | counts[0], key=len):
            y0, y1 = counts[0][f], counts[1][f]
            if y0 + y1 < ENOUGH:
                continue
            shorter = f.rstrip(" ")[: max(BEGINNINGS)] if f[-1] == " " else f[:-1]
            shorter = shorter if len(shorter) >= min(BEGINNINGS) else ""
            p = share[shorter]
            if abs(y1 - p * (y0 + y1)) <= DIFFERS * math.sqrt((y0 + y1) * p * (1 - p) + 0.25):
                weights[f], share[f] = weights[shorter], p
                continue
            prior = PRIOR * (y0 + y1) / (n0 + n1)
            odds = math.log((y1 + prior) / max(n1 + PRIOR - y1 - prior, 1.0)) - math.log((y0 + prior) / max(n0 + PRIOR - y0 - prior, 1.0))
            sure = abs(odds) - ERRORS * math.sqrt(1 / (y1 + prior) + 1 / (y0 + prior))
            weights[f], share[f] = math.copysign(max(sure, 0.0), odds), (y1 + 0.5) / (y0 + y1 + 1)
        model = cls(weights, 1.0, 1.0, 1.0, 0.0)
        model._law(all_words, [t for t, x in zip(texts, labels, strict=True) if not x])
        # Logistic fit on the evidence, by Newton steps with a small ridge.
        z = np.log1p([model.evidence(*model.segments(t)) for t in texts])
        x, y, beta = np.column_stack([z, np.ones(len(z))]), np.array(labels, float), np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            beta = beta + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), x.T @ (y - p) - 1e-2 * beta)
        model.slope, model.shift = max(float(beta[0]), 0.0), float(beta[1])
        return model

    def _law(self, clean: Counter[str], texts: list[str]) -> None:
        """Lambda and K of clean text; a word of positive score that clean text lacks counts as half a word."""
        by_score: Counter[float] = Counter()
        for word, n in clean.items():
            by_score[round(self.word(word), 3)] += n
        for f, w in self.weights.items():
            if f.endswith(" ") and w > DRIFT and f[:-1] not in clean:
                by_score[round(w - DRIFT, 3)] += 0.5
        s, n = np.array(list(by_score), float), np.array(list(by_score.values()), float)
        share = n / n.sum() if len(n) else n
        low, high = 1e-3, 50.0
        if len(s) and s.max() > 0:
            for _ in range(100):
                middle = (low + high) / 2
                # Sum of share * exp(middle * s), in logs.
                e = middle * s + np.log(share)
                grown = e.max() + math.log(np.exp(e - e.max()).sum())
                low, high = (middle, high) if grown < 0 else (low, middle)
            self.decay = low
        # Each clean document's E at its best segment is exponential; documents without a segment are cut off at score 0.
        hits, weight = 0.5, 0.0
        for text in texts:
            n_words, found = self.segments(text)
            hits += bool(found)
            weight += max(n_words, 1) * math.exp(-self.decay * max((x for _, _, x in found), default=0.0))
        self.rate = hits / max(weight, 1e-9)


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicModel:
    """Fit on at most TRAIN_DOCS labelled documents, chosen by a hash of their key; held-out keys are left out.

    Not used are documents beyond TRAIN_BYTES and rows with a null key, label
    or text; of several labels of a key the largest counts, of several texts
    the smallest.  Documents are taken in the order of the hash up to ALL_BYTES.
    Without a labelled document, or with one kind of label only, the model is a
    constant.  Other columns are not read.
    """
    marks = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("__key")).agg(F.max(F.col(label).cast("int")).alias("__label"))
    usable = docs.filter(F.octet_length(text) <= TRAIN_BYTES)
    place = F.md5(F.col("__key").cast("string").cast("binary"))
    chosen = marks.join(usable.select(F.col(key).alias("__key")).distinct(), "__key", "left_semi").orderBy(place, "__key").limit(TRAIN_DOCS)
    rows = usable.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(F.broadcast(chosen), "__key")
    rows = rows.groupBy("__key", "__label").agg(F.min("__text").alias("text")).select(place.alias("place"), F.col("__label").alias("label"), "text")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, marks, held = [], [], 0
        for batch in batches:
            for value, mark in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                held += len(value)
                if held <= ALL_BYTES:
                    texts.append(value)
                    marks.append(mark > 0)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(ToxicModel.fit(texts, marks))])], names=["model"])

    # At most TRAIN_DOCS rows meet in the one task that fits.
    fitted = rows.repartition(1).sortWithinPartitions("place").mapInArrow(fit, "model binary").first()
    return pickle.loads(fitted["model"]) if fitted else ToxicModel.constant(0.5)


def score_toxicity(df: DataFrame, model: ToxicModel, text: str = "text", out: str = "score", passages: str = "passages") -> DataFrame:
    """``df`` with ``out``, the probability of being toxic, and ``passages``, its significant ones.

    A passage has ``begin`` and ``end`` in code points (end exclusive) and
    ``expected``, the number of chance ones as good.  A null text counts as
    empty and scores as a text without any segment; equal texts score equally;
    an empty table gives an empty one; texts of any length are read whole.
    Input columns of the new names are refused.
    """
    if {out, passages} & set(df.columns):
        raise ValueError(f"the table already has a column {out} or {passages}")
    held = df.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("expected", pa.float64())]))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            read = [held.value.read(t or "") for t in batch.column(text).to_pylist()]
            found = [[{"begin": a, "end": b, "expected": e} for a, b, e in p] for _, p in read]
            yield batch.append_column(out, pa.array([s for s, _ in read], pa.float64())).append_column(passages, pa.array(found, kind))

    return df.mapInArrow(run, f"{fields}, `{out}` double, `{passages}` array<struct<begin: bigint, end: bigint, expected: double>>")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, and how many significant passages it has."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
