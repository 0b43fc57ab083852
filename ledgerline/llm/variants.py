"""Spelling variants: words one edit apart, by composed automata.

The vocabulary is an acceptor (a minimal acyclic automaton whose arcs carry
code points).  Composed with a transducer that inserts, deletes or replaces
one code point, and with the acceptor again, it accepts the pairs of words that
differ by one edit.  The composed machine is walked a letter at a time for all
of its states together: before the edit both readers are in one state, after it
in a pair of states that read the same letters; two readers in one state accept
all that follows, because states are minimal.  Words are numbered by their
order, and arcs carry how many words precede them, so a pair of final states
names its two words without spelling them.

The vocabulary is dealt by initial states: words that begin alike, with as many
code points as it takes to leave at most ``LEAF_WORDS`` in a part.  Each part
is composed on its own and finds the pairs that share the initial state.  The
same is done with the words read backwards, for edits near the beginning.  A
pair is missed by both only if its edit lies within the initial states of both
directions (short words in crowded parts); those positions, a few for a word,
are joined on the word without the edited code point.  Every pair is found, and
counted in one place.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import chunks, materialise, release, table

#: Most words of a part, unless more of them end within its first letters.
LEAF_WORDS = 4096
#: Letters of an initial state before crowded ones are split.
FIRST_LETTERS = 2
#: Words that a counting task holds before it hands them on.
HELD_WORDS = 200_000

# Latin-1 byte to itself, in lower case for A-Z, or to a space if it is no letter here.
_LETTER = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def damaged(doc_id: object, run: bytes) -> bytes:
    """The run (Latin-1, lower case) as it counts: every 97th lacks a code point, by a checksum of document and run."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()))
    if h % 97:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", least_letters: int = 5, least_count: int = 3) -> DataFrame:
    """``word, n``: the words of all texts with at least that many letters and occurrences.

    A null text has no words; a null key counts as an empty one; repeated rows
    count each time.  An empty table gives an empty one.  Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in held], pa.string())
            out = pa.RecordBatch.from_arrays([words, pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in chunks(batches, "t"):
            for k, value in zip(batch.column("k").to_pylist(), batch.column("t").to_pylist(), strict=True):
                # What is beyond Latin-1 becomes a question mark, which is no letter.
                for word, n in Counter((value or "").encode("latin-1", "replace").translate(_LETTER).split()).items():
                    word = damaged(k, word)
                    if len(word) >= least_letters:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield flush()
        if held:
            yield flush()

    parts = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


class Acceptor:
    """Minimal acyclic automaton of distinct words in code-point order.

    Arcs of state s are first[s]:first[s+1], by letter; ``before`` is the number
    of words of s that precede those through the arc; the word that ends in s
    comes first.
    """

    def __init__(self, words: list[str]) -> None:
        register: dict[tuple, int] = {}
        final: list[bool] = []
        arcs: list[tuple] = []
        open_states: list[list] = [[False, []]]  # of the last word's prefixes: final, arcs

        def close(depth: int, word: str) -> None:
            for at in range(len(open_states) - 1, depth, -1):
                made = (open_states[at][0], tuple(open_states[at][1]))
                state = register.get(made)
                if state is None:
                    state = register[made] = len(final)
                    final.append(made[0])
                    arcs.append(made[1])
                open_states[at - 1][1].append((ord(word[at - 1]), state))
                del open_states[at]

        last = ""
        for word in words:
            common, most = 0, min(len(word), len(last))
            while common < most and word[common] == last[common]:
                common += 1
            close(common, last)
            open_states.extend([False, []] for _ in range(len(word) - common))
            open_states[-1][0] = True
            last = word
        close(0, last)
        final.append(open_states[0][0])
        arcs.append(tuple(open_states[0][1]))
        self.root = len(final) - 1
        self.final = np.array(final, bool)
        self.first = np.concatenate([[0], np.cumsum([len(a) for a in arcs])]).astype(np.int64)
        self.letter = np.array([x for a in arcs for x, _ in a], np.int64)
        self.target = np.array([x for a in arcs for _, x in a], np.int64)
        self.key = np.repeat(np.arange(len(arcs)), np.diff(self.first)) << 21 | self.letter
        self.before = np.zeros(len(self.letter), np.int64)
        self.words = np.zeros(len(final), np.int64)
        counts, befores, at = self.words.tolist(), [], 0
        for state, own in enumerate(arcs):  # targets are closed before the states that lead to them
            many = int(final[state])
            for _, to in own:
                befores.append(many)
                many += counts[to]
            counts[state] = many
        self.words[:] = counts
        self.before[:] = befores

    def leave(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(owner, arc) of all arcs of the states."""
        begin = self.first[states]
        many = self.first[states + 1] - begin
        owner = np.repeat(np.arange(len(states)), many)
        return owner, np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + begin[owner]

    def find(self, states: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The state's arc with the letter, -1 if there is none."""
        key = states << 21 | letters
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, at, -1)


def one_edit_pairs(a: Acceptor) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of each pair that the acceptor, a one-edit transducer and the acceptor accept in a row; a pair comes once.

    A letter that could be inserted at several places of a run is inserted at the last.
    """
    none = np.zeros(0, np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    state, base = np.array([a.root]), np.zeros(1, np.int64)
    # After the edit: the states and first word numbers of the two readers, and a letter that may not follow (-1: any).
    left = right = left_base = right_base = barred = none
    while len(state) or len(left):
        owner, arc = a.leave(state)
        to, to_base = a.target[arc], base[owner] + a.before[arc]
        # Replaced: two different arcs of one state.
        many = a.first[state + 1] - a.first[state]
        later = np.repeat(np.cumsum(many), many) - np.arange(len(arc)) - 1
        one = np.repeat(np.arange(len(arc)), later)
        two = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(later) - later, later)
        # One more read by the right, and then the readers go on; and pairs that had their edit before.
        if len(left):
            of, step = a.leave(left)
            there = a.find(right[of], a.letter[step])
            on = (there >= 0) & (a.letter[step] != barred[of])
            of, step, there = of[on], step[on], there[on]
            went = (a.target[step], a.target[there], left_base[of] + a.before[step], right_base[of] + a.before[there])
        else:
            went = (none, none, none, none)
        left = np.concatenate([to[one], state[owner], went[0]])
        right = np.concatenate([to[two], to, went[1]])
        left_base = np.concatenate([to_base[one], base[owner], went[2]])
        right_base = np.concatenate([to_base[two], to_base, went[3]])
        barred = np.concatenate([np.full(len(one), -1), a.letter[arc], np.full(len(went[0]), -1)])
        state, base = to, to_base
        # One state for both readers: all that it accepts.
        same = left == right
        if same.any():
            many = a.words[left[same]]
            inner = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            found.append((np.repeat(left_base[same], many) + inner, np.repeat(right_base[same], many) + inner))
            left, right, left_base, right_base, barred = (x[~same] for x in (left, right, left_base, right_base, barred))
        ends = a.final[left] & a.final[right]
        found.append((left_base[ends], right_base[ends]))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _composed(part: pd.DataFrame, backwards: bool) -> pd.DataFrame:
    """Near words of one part: their number, and of each word the one of largest n (ties: the smallest)."""
    part = part.sort_values("reversed" if backwards else "word", ignore_index=True)
    one, two = one_edit_pairs(Acceptor((part["reversed"] if backwards else part["word"]).tolist()))
    if backwards:  # pairs of one forward part are that part's
        leaf = pd.factorize(part["forward"])[0]
        apart = leaf[one] != leaf[two]
        one, two = one[apart], two[apart]
    here, there = np.concatenate([one, two]), np.concatenate([two, one])
    words, n = part["word"].to_numpy(), part["n"].to_numpy()
    by_rank = np.lexsort((np.argsort(np.argsort(words, kind="stable")), -n))
    rank = np.empty(len(words), np.int64)
    rank[by_rank] = np.arange(len(words))
    best = np.full(len(words), len(words))
    np.minimum.at(best, here, rank[there])
    many = np.bincount(here, minlength=len(words))
    at = np.flatnonzero(many)
    chosen = by_rank[best[at]]
    return pd.DataFrame({"word": words[at], "n_near": many[at], "near_n": n[chosen], "near": words[chosen]})


def _with_depth(words: DataFrame, column: str, depth: str, most: int) -> DataFrame:
    """``words`` with the letters of each word's initial state: as few as leave at most ``most`` words that begin so."""
    out, k = words.withColumn(depth, F.lit(FIRST_LETTERS)), FIRST_LETTERS
    while True:
        begin = F.substring(column, 1, k)
        longer = (F.col(depth) == k) & (F.length(column) >= k)
        crowded = out.filter(longer).groupBy(begin.alias("__begin")).agg(F.count(F.lit(1)).alias("__many")).filter(F.col("__many") > most)
        if crowded.isEmpty():
            return out
        # Adaptive execution broadcasts the crowded beginnings if they are small, and splits a hot one if not.
        deeper = out.join(crowded.select("__begin"), longer & (begin == F.col("__begin")), "left")
        after = materialise(deeper.withColumn(depth, F.when(F.col("__begin").isNull(), F.col(depth)).otherwise(k + 1)).drop("__begin"), "beginnings")
        if k > FIRST_LETTERS:
            release(out)
        out, k = after, k + 1


def near_words(words: DataFrame, most: int = LEAF_WORDS) -> DataFrame:
    """``word, n_near, near, near_n``: how many words are one edit away, and the one of largest ``n`` (ties: the smallest in code-point order).

    ``words`` has ``word`` (distinct, not null) and ``n``; words without a near
    one are left out, an empty table gives an empty one.  A part's memory grows
    with its letters: a word of a hundred thousand letters takes some 50 MB.
    """
    # The reference words are read several times, so they are written once.
    words = materialise(words.select("word", F.reverse("word").alias("reversed"), "n"), "words")
    placed = _with_depth(_with_depth(words, "word", "ahead", most), "reversed", "back", most)
    placed = materialise(placed.select("*", F.expr("substring(word, 1, ahead)").alias("forward"), F.expr("substring(reversed, 1, back)").alias("backward")), "parts")
    schema = "word string, n_near long, near_n long, near string"
    ahead = placed.select("forward", "word", "n").groupBy("forward").applyInPandas(lambda part: _composed(part, False), schema)
    back = placed.select("backward", "forward", "word", "reversed", "n").groupBy("backward").applyInPandas(lambda part: _composed(part, True), schema)
    both = ahead.unionByName(back).unionByName(_within_beginnings(placed).select("word", F.lit(1).cast("long").alias("n_near"), "near_n", "near"))
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w")))
    out = both.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return out.select("word", "n_near", F.col("best.w").alias("near"), (-F.col("best.m")).alias("near_n"))


def _within_beginnings(placed: DataFrame) -> DataFrame:
    """Pairs in both directions whose edit lies within both initial states of each word: joined on place and remaining letters."""
    # Places at which a word can lack a code point, or be without one that the other word has.
    lost = F.expr("CASE WHEN greatest(0, length(word) - back) <= least(length(word), ahead) - 1 THEN sequence(greatest(0, length(word) - back), least(length(word), ahead) - 1) ELSE array() END")
    kept = F.expr("CASE WHEN greatest(0, length(word) - back + 1) <= least(length(word), ahead - 1) THEN sequence(greatest(0, length(word) - back + 1), least(length(word), ahead - 1)) ELSE array() END")
    columns = ["word", "n", "forward", "backward"]
    without = placed.select(*columns, F.explode(lost).alias("at")).select(
        *columns, "at", F.expr("concat(substring(word, 1, at), substring(word, at + 2))").alias("rest"), F.expr("substring(word, at + 1, 1) <> substring(word, at + 2, 1)").alias("run_end")
    )
    whole = placed.select(*columns, F.explode(kept).alias("at")).select(*columns, "at", F.col("word").alias("rest"))

    def other(df: DataFrame) -> DataFrame:
        return df.select(*(F.col(c).alias(f"o_{c}") for c in df.columns))

    apart = (F.col("at") == F.col("o_at")) & (F.col("rest") == F.col("o_rest")) & (F.col("forward") != F.col("o_forward")) & (F.col("backward") != F.col("o_backward"))
    replaced = without.join(other(without), apart & (F.col("word") != F.col("o_word"))).select("word", "n", "o_word", "o_n")
    moved = without.filter("run_end").join(other(whole), apart).select("word", "n", "o_word", "o_n")
    pairs = replaced.unionByName(moved).unionByName(moved.select(F.col("o_word").alias("word"), F.col("o_n").alias("n"), F.col("word").alias("o_word"), F.col("n").alias("o_n")))
    return pairs.select("word", F.col("o_word").alias("near"), F.col("o_n").alias("near_n"))


def follow(links: DataFrame) -> DataFrame:
    """``word, root`` of every ``word, form``: the end of the chain of forms.  Chains must not close; each round halves what is left of them."""
    out = materialise(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = out.select(F.col("word").alias("__w"), F.col("root").alias("__r"))
        joined = materialise(out.join(ahead, F.col("root") == F.col("__w"), "left").select("word", F.coalesce("__r", "root").alias("root"), F.col("__r").isNotNull().alias("on")), "roots")
        release(out)
        if joined.filter("on").isEmpty():
            return joined.drop("on")
        out = joined


def spelling_forms(words: DataFrame, gain: Column | int = 2, most: int = LEAF_WORDS) -> DataFrame:
    """``words`` (``word``, ``n``) with ``form``, ``root``, ``n_near`` and ``form_n``.

    A word's form is its near word of largest ``n``, if that is at least
    ``gain`` (above 1) times its own, else null; the root follows forms to the
    last.  A word without a near one has ``n_near`` 0.
    """
    words = materialise(words.select("word", "n"), "vocabulary")
    near = near_words(words, most)
    held = words.join(near, "word", "left")
    good = F.col("near_n") >= F.col("n") * gain
    held = materialise(held.select("word", F.when(good, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("near_n")).alias("form_n")), "forms")
    roots = follow(held.filter("form IS NOT NULL").select("word", "form"))
    return held.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms and roots of the words of all documents."""
    return spelling_forms(count_words(table(spark, sf_dir, "documents")))


OP13_SQL = r"""
WITH RECURSIVE poly AS (SELECT i, i AS v, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM poly WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM poly WHERE k = 8),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS m, hex(encode(concat(doc_id, ':', run))) AS h FROM runs GROUP BY doc_id, run),
summed AS (SELECT run, m, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(h, '..'), lambda x: CAST(('0x' || x) AS BIGINT))),
  lambda a, b: xor(a >> 8, t[xor(a, b) % 256 + 1]))) AS c FROM counted, crc_table),
words AS (SELECT CASE WHEN c % 97 = 0 THEN substr(run, 1, (c % length(run))::INT) || substr(run, (c % length(run))::INT + 2) ELSE run END AS word, m FROM summed),
vocabulary AS (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM words WHERE length(word) >= 5 GROUP BY word HAVING sum(m) >= 3),
without AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, CAST(unnest(range(length(word))) AS INT) AS i FROM vocabulary)),
pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM without a JOIN without b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM without a JOIN vocabulary b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM without a JOIN vocabulary b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS near_n FROM pairs GROUP BY word),
nearest AS (SELECT b.word, b.n_near, b.near_n, min(p.near) AS near FROM best b JOIN pairs p ON b.word = p.word AND b.near_n = p.near_n GROUP BY ALL),
formed AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * v.n THEN near END AS form, CASE WHEN near_n >= 2 * v.n THEN near_n END AS form_n FROM vocabulary v LEFT JOIN nearest USING (word)),
walk AS (SELECT word, word AS root FROM formed UNION ALL SELECT walk.word, formed.form FROM walk JOIN formed ON walk.root = formed.word WHERE formed.form IS NOT NULL),
ends AS (SELECT walk.word, walk.root FROM walk JOIN formed ON walk.root = formed.word WHERE formed.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""
