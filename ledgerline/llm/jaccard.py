"""N-gram Jaccard join: grouped prefixes.

A document is the set of its distinct five-word shingles.  In one order of all
shingles, two sets whose Jaccard similarity is at least 0.8 share a shingle
among the first ``n - ceil(0.8 n) + 1`` of each (its prefix).  The order puts
shingles that many documents have last, so that shared passages do not meet in
prefixes; any order gives the same result.

1. Shingles whose hash lies in the lowest quarter (prefixes take about the
   lowest fifth) are counted; a bounded list of frequent ones goes to all tasks.
   Where a prefix without them reaches beyond the quarter, as in documents that
   consist of a shared passage and a little of their own, the shingles beyond it
   are counted over such documents, the only ones to have them in prefixes.
2. Documents with one prefix and size are one group; equal sets one class.
3. Prefix shingles are the keys of an index of groups.  Those that one document
   alone has are dropped.
4. Star rounds: in every list of the index, and in every group of several
   classes, each member meets two others of about its size: the first in order
   of size, and one that is drawn anew for each list and round.  Each keeps the
   partners of its closest sketches; verified on the sets, they join most of
   each family without pairs of all its members.  Links are carried over as
   labels of components, and lists that hold one component only leave the index.
   Rounds end when one joins fewer than a hundredth of the classes.
5. Last round: in the lists that still hold more than one component, all pairs
   of different components that pass the size, position and sketch filters are
   expanded to classes and verified.  What remains apart shares no link.

Lists are only ever reduced to minima, which combine before the shuffle, or
joined by an inner join whose large keys adaptive execution can split; no list
is gathered in one task.

Before sets are fetched for a pair, sketches bound its overlap: bit b of a
sketch is the parity of the shingles that fall on b, so two sketches never
differ in more bits than the sets differ in shingles.  A sketch has at least a
bit for each shingle; the longer of two is folded to the length of the shorter.
Only texts of pairs that may still link are read again.

Sets are compared by 64-bit hashes of their shingles (see ``wordhash``: no
arrangement of words makes two coincide, only a chance of 2**-64).  Classes and
groups have 64-bit ids cut from BLAKE2b; in a corpus of a billion different
documents the chance that any two of them coincide is a few per cent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm import wordhash
from ledgerline.llm.common import bounded_batches, chunks, materialise, release, sweep, table
from ledgerline.llm.components import components

SHINGLE = 5
#: The similarity as hundredths, so that every comparison is in whole numbers.
PERCENT = 80
#: Shingles in at least so many documents are frequent; the list holds at most so many.
FREQUENT, FREQUENT_MAX = 32, 1_000_000
#: Bits of the smallest sketch; longer ones are 4, 16, ... times as long.
SKETCH = 1024
_COUNTED = np.uint64(1 << 62)  # hashes below are counted
#: Star rounds go on while one joins at least one in so many classes.
WORTHWHILE = 100
_FOLD = [f"s{i}" for i in range(SKETCH // 64)]
#: Partners that a member keeps in a star round.
PARTNERS = 3
#: Up to so many wanted classes go to all tasks; more are found by a shuffle of the texts.
BROADCAST_CLASSES = 500_000


def _need(n: np.ndarray | int):
    """Least overlap of a set of n with any set it links to: ceil(0.8 n)."""
    return -(-n * PERCENT // 100)


def _sets(batch: pa.RecordBatch) -> list[np.ndarray]:
    return wordhash.shingle_sets([(t or "").encode() for t in batch.column("text").to_pylist()], SHINGLE)


def _digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _head(s: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The prefix of an ascending set, frequent shingles last, and which of the set are frequent."""
    common = often[np.minimum(np.searchsorted(often, s), len(often) - 1)] == s if len(often) else np.zeros(len(s), bool)
    return np.concatenate([s[~common], s[common]])[: len(s) - _need(len(s)) + 1], common


def _group(size: int, head: np.ndarray) -> int:
    return _digest(size.to_bytes(8, "little") + head.tobytes())


def repeated_shingles(docs: DataFrame) -> DataFrame:
    """h and count of the counted shingles that more than one document has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            low = [s[: np.searchsorted(s, _COUNTED)] for s in _sets(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*low, np.zeros(0, np.uint64)]).view(np.int64))], names=["h"])

    return materialise(docs.select("text").mapInArrow(run, "h long").groupBy("h").count().filter("count > 1"), "shingles")


def frequent_shingles(counts: DataFrame) -> np.ndarray:
    """Counted shingles in FREQUENT documents or more; if those are too many, the bar is doubled until they fit."""
    bar = FREQUENT
    while counts.filter(F.col("count") >= bar).count() > FREQUENT_MAX:
        bar *= 2
    rows = counts.filter(F.col("count") >= bar).select("h").toPandas()
    return np.sort(rows["h"].to_numpy(np.int64).view(np.uint64))


def prefixes(docs: DataFrame, often: np.ndarray) -> DataFrame:
    """docs (id, text) as id, n, cls, gid, sketch, prefix: set size, ids of the set and of (n, prefix), parity sketch, and the prefix in order.

    ``whole`` is the set where the prefix reaches beyond the counted shingles, else null.
    """
    frequent = docs.sparkSession.sparkContext.broadcast(often)
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequent.value
        for batch in chunks(batches, "text"):
            n, cls, gid, sketch, prefix, whole = [], [], [], [], [], []
            for s in _sets(batch):
                size = len(s)
                n.append(size)
                if not size:
                    cls.append(None), gid.append(None), sketch.append(None), prefix.append(None), whole.append(None)
                    continue
                head, common = _head(s, often)
                own = np.searchsorted(s, _COUNTED)
                whole.append(s.view(np.int64) if own - np.count_nonzero(common[:own]) < len(head) else None)
                cls.append(_digest(s.tobytes()))
                gid.append(_group(size, head))
                bits = SKETCH
                while bits < size:
                    bits *= 4
                odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
                sketch.append(np.packbits(odd).tobytes())
                prefix.append(head.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int32()), pa.array(cls, pa.int64()), pa.array(gid, pa.int64()), pa.array(sketch, pa.binary()), pa.array(prefix, pa.list_(pa.int64())), pa.array(whole, pa.list_(pa.int64()))], names=["id", "n", "cls", "gid", "sketch", "prefix", "whole"])

    return docs.mapInArrow(run, f"id {kind}, n int, cls long, gid long, sketch binary, prefix array<long>, whole array<long>")


def _beyond(reaching: DataFrame, often: np.ndarray) -> DataFrame:
    """The rows of ``prefixes`` that reach beyond the counted shingles, with prefixes in which the ones frequent there come last too."""
    far = reaching.select(F.explode("whole").alias("h")).filter(~F.col("h").between(0, int(_COUNTED) - 1))
    counts = materialise(far.groupBy("h").count().filter(F.col("count") >= FREQUENT), "shingles")
    more = frequent_shingles(counts)
    release(counts)
    if not len(more):
        return reaching.drop("whole")
    frequent = reaching.sparkSession.sparkContext.broadcast(np.union1d(often, more))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in reaching.schema if f.name != "whole")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gid, prefix = [], []
            for s in batch.column("whole"):
                own = s.values.to_numpy().view(np.uint64)
                head, _ = _head(own, frequent.value)
                gid.append(_group(len(own), head))
                prefix.append(head.view(np.int64))
            made = {"gid": pa.array(gid, pa.int64()), "prefix": pa.array(prefix, pa.list_(pa.int64()))}
            names = [c for c in batch.schema.names if c != "whole"]
            yield pa.RecordBatch.from_arrays([made.get(c, batch.column(c)) for c in names], names=names)

    return reaching.mapInArrow(run, fields)


def _folded(classes: DataFrame) -> DataFrame:
    """cls, size and the sketch folded to its smallest length, as long columns s0, s1, ..."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = [np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, SKETCH // 8), axis=0).view(np.int64) for x in batch.column("sketch").to_pylist()]
            parts = np.array(fold, np.int64).reshape(-1, SKETCH // 64)
            yield pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("size"), *(pa.array(np.ascontiguousarray(parts[:, i])) for i in range(SKETCH // 64))], names=["cls", "size", *_FOLD])

    return classes.select("cls", "size", "sketch").mapInArrow(run, "cls long, size int, " + ", ".join(f"{s} long" for s in _FOLD))


def _class_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """cls and its set, as bytes of ascending hashes, for the documents in ``wanted`` (rep, of)."""
    small = wanted.count() <= BROADCAST_CLASSES
    texts = docs.join(F.broadcast(wanted) if small else wanted, F.col("id").eqNullSafe(F.col("rep"))).select("of", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            data = [s.tobytes() for s in _sets(batch)]
            same = pa.array([_digest(d) for d in data], pa.int64())
            kept = pa.compute.equal(same, batch.column("of"))
            out = pa.RecordBatch.from_arrays([same, pa.array(data, pa.binary())], names=["cls", "members"])
            yield out.filter(kept)

    return texts.mapInArrow(run, "cls long, members binary").dropDuplicates(["cls"])


def _plausible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sizes and sketches allow a link, and how far apart the sketches are."""
    one, two = (classes.select(F.col("cls").alias(c), F.col("size").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, apart = [], []
            for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "sa", "sb")), strict=True):
                p, q = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
                differ = int(np.bitwise_count(np.bitwise_xor.reduce(q.reshape(-1, len(p)), axis=0) ^ p).sum())
                # overlap <= (n + m - differ) / 2, and a link needs 180 * overlap >= 80 * (n + m).
                keep.append((n + m - differ) * (100 + PERCENT) >= 2 * PERCENT * (n + m))
                apart.append(differ / (n + m))
            yield batch.select(["a", "b"]).append_column("apart", pa.array(apart, pa.float64())).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long, apart double")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sets link; sets are made again from one text of each class."""
    pairs = materialise(pairs.select("a", "b"), "pairs")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("of")).distinct().join(classes.select(F.col("cls").alias("of"), "rep"), "of")
    sets = materialise(_class_sets(docs, needed), "sets")
    one, two = sets.select(F.col("cls").alias("a"), F.col("members").alias("x")), sets.select(F.col("cls").alias("b"), F.col("members").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * shared >= PERCENT * (len(p) + len(q) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    links = materialise(pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "verified")
    release(sets, pairs)
    return links


def _sizes_fit(n: str, m: str):
    """Sets of these sizes can link."""
    low, high = F.least(n, m), F.greatest(n, m)
    return low * 100 >= high * PERCENT


def _heads(labelled: DataFrame) -> DataFrame:
    """Each group's smallest class, and its smallest and largest component."""
    return labelled.groupBy("gid").agg(F.min("cls").alias("head"), F.min("comp").alias("low"), F.max("comp").alias("high"))


def _open(index: DataFrame, labelled: DataFrame) -> DataFrame:
    """The index (token, gid, n, pos) with head, low, high, where a list holds more than one component."""
    held = index.select("token", "gid", "n", "pos").join(_heads(labelled), "gid")
    lists = held.groupBy("token").agg(F.min("low").alias("__low"), F.max("high").alias("__high")).filter("__low <> __high")
    return materialise(held.join(lists.select("token"), "token", "left_semi"), "open-lists")


def _mixed(labelled: DataFrame) -> DataFrame:
    """The members (gid, cls, comp) of groups that hold more than one component."""
    return labelled.join(_heads(labelled).filter("low <> high").select("gid"), "gid").select("gid", "cls", "comp")


def _star_pairs(index: DataFrame, labelled: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of a class in an open list and one of the two that stand for its list and size."""
    # In every other round the size classes begin half a step later.
    cell = F.floor(F.log("n") / F.log(F.lit(100 / PERCENT)) + F.lit(turn % 2 / 2)).cast("int")
    members = index.select("token", cell.alias("cell"), F.col("head").alias("cls"), "n", "low", "high")
    inside = _mixed(labelled).select(F.col("gid").alias("token"), F.lit(-1).alias("cell"), "cls", F.lit(1).alias("n"), F.col("comp").alias("low"), F.col("comp").alias("high"))
    members = members.unionByName(inside)
    drawn = F.struct(F.xxhash64(F.lit(turn), "token", "cls").alias("__draw"), "cls", "n", "low", "high")
    hubs = members.groupBy("token", "cell").agg(F.min(F.struct("n", "cls", "low", "high")).alias("first"), F.min(drawn).alias("drawn"))
    hub = lambda c: F.struct(*(F.col(f"{c}.{x}").alias(x) for x in ("cls", "n", "low", "high")))
    near = members.join(hubs, ["token", "cell"]).select("cls", "n", "low", "high", F.explode(F.array(hub("first"), hub("drawn"))).alias("p"))
    near = near.filter((F.col("cls") != F.col("p.cls")) & _sizes_fit("n", "p.n") & (F.least("low", "p.low") != F.greatest("high", "p.high")))
    return near.select(F.col("cls").alias("a"), F.col("p.cls").alias("b")).distinct()


def _joined(labelled: DataFrame, links: DataFrame) -> tuple[DataFrame, int]:
    """``labelled`` (cls, gid, comp) with components joined by the links, and the number of links between different ones."""
    one, two = (labelled.select(F.col("cls").alias(c), F.col("comp").alias(f"comp_{c}")) for c in "ab")
    across = materialise(links.join(one, "a").join(two, "b").filter("comp_a <> comp_b").select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")).distinct(), "across")
    many = across.count()
    if not many:
        release(across)
        return labelled, 0
    found = components(across)
    out = materialise(labelled.join(found, F.col("comp") == F.col("node"), "left").select("cls", "gid", F.coalesce("component", "comp").alias("comp")), "labelled")
    release(found, across, labelled)
    return out, many


def _rest(index: DataFrame, labelled: DataFrame, classes: DataFrame) -> DataFrame:
    """All pairs (a, b) of classes of different components in the open lists that pass the size, position and sketch filters."""
    member = labelled.join(_folded(classes), "cls")
    rows = index.select("token", "gid", "n", "pos").join(member.select("gid", "cls", "comp", *_FOLD), "gid").select("token", "cls", "comp", "n", "pos", *_FOLD)
    # Groups of several classes may have no shingle in a shared list: they are lists themselves.
    inside = _mixed(labelled).join(_folded(classes), "cls").select(F.col("gid").alias("token"), "cls", "comp", F.col("size").alias("n"), F.lit(0).alias("pos"), *_FOLD)
    rows = materialise(rows.unionByName(inside), "open-members")
    left, right = (rows.select("token", *(F.col(c).alias(f"{c}_{side}") for c in rows.columns if c != "token")) for side in (1, 2))
    total = F.col("n_1") + F.col("n_2")
    # The shingles before and at the shared one bound the overlap from above; so do the sketches.
    most = F.least("pos_1", "pos_2") + F.least(F.col("n_1") - F.col("pos_1"), F.col("n_2") - F.col("pos_2"))
    differ = sum((F.bit_count(F.col(f"{s}_1").bitwiseXOR(F.col(f"{s}_2"))) for s in _FOLD), F.lit(0))
    fits = _sizes_fit("n_1", "n_2") & (most * (100 + PERCENT) >= total * PERCENT) & ((total - differ) * (100 + PERCENT) >= 2 * PERCENT * total)
    pairs = left.join(right, "token").filter((F.col("cls_1") < F.col("cls_2")) & (F.col("comp_1") != F.col("comp_2")) & fits).select(F.col("cls_1").alias("a"), F.col("cls_2").alias("b"))
    out = materialise(pairs.distinct(), "rest")
    release(rows)
    return out


def similar_documents(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles and component_id (the smallest key reachable by links) of every row.

    Null and empty texts have no shingles, link with nothing and are their own
    component; texts of under five words are one shingle.  Long texts take a
    sketch as long as their set.  Rows that repeat a key are one node each time
    with the same result, also where their texts differ and link with different
    components.  A null key takes the smallest key of its component, null if it
    has none.  Equal texts tie and are one class.  An empty table gives an empty
    table.  Other columns are not read, so their names cannot clash.
    """
    bounded_batches(df.sparkSession)
    docs = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    counts = repeated_shingles(docs)
    often = frequent_shingles(counts)
    ordered = materialise(prefixes(docs, often), "prefixes")
    reached = materialise(_beyond(ordered.filter("whole IS NOT NULL"), often), "reached")
    rows = ordered.filter("whole IS NULL").drop("whole").unionByName(reached)
    sweep(df.sparkSession)
    filled = rows.filter("n > 0")
    groups = filled.groupBy("gid").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    index = groups.select("gid", "n", F.posexplode("prefix").alias("pos", "token"))
    counted = F.col("token").between(0, int(_COUNTED) - 1)
    shared = index.filter(counted).join(counts.select(F.col("h").alias("token")), "token", "left_semi").select(*index.columns)
    index = materialise(shared.unionByName(index.filter(~counted)), "index")
    crowded = filled.select("gid", "cls").distinct().groupBy("gid").count().filter("count > 1").select("gid")
    live = index.select("gid").unionByName(crowded).distinct()
    classes = materialise(filled.join(live, "gid", "left_semi").groupBy("cls").agg(F.min("id").alias("rep"), F.min("gid").alias("gid"), F.min("n").alias("size"), F.first("sketch").alias("sketch")), "classes")
    members = materialise(rows.select("id", "n", "cls"), "members")
    release(ordered, reached, counts)
    sweep(df.sparkSession)

    many, turn = classes.count(), 0
    labelled = materialise(classes.select("cls", "gid", F.col("cls").alias("comp")), "labelled")
    while many:
        before, index = index, _open(index, labelled)
        release(before)
        hopeful = materialise(_plausible(_star_pairs(index, labelled, turn), classes), "star-pairs")
        best = hopeful.withColumn("__rank", F.row_number().over(Window.partitionBy("a").orderBy("apart", "b"))).filter(F.col("__rank") <= PARTNERS)
        links = _verified(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), classes, docs)
        labelled, joined = _joined(labelled, links)
        release(hopeful, links)
        sweep(df.sparkSession)
        turn += 1
        if joined * WORTHWHILE < many:
            break

    before, index = index, _open(index, labelled)
    rest = _rest(index, labelled, classes)
    links = _verified(_plausible(rest, classes), classes, docs)
    release(before, index, rest)
    labelled, _ = _joined(labelled, links)
    release(links)

    least = labelled.join(classes.select("cls", "rep"), "cls")
    least = labelled.select("cls", "comp").join(least.groupBy("comp").agg(F.min("rep").alias("least")), "comp").select("cls", "least")
    of = members.filter("n > 0").groupBy("cls").agg(F.min("id").alias("own")).join(least, "cls", "left").select("cls", F.coalesce("least", "own").alias("least"))
    out = members.join(of, "cls", "left")
    return out.select(F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return similar_documents(table(spark, sf_dir, "documents"))


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP4_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, CAST(len(w) - 3 AS BIGINT)), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= {PERCENT} * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS c FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.x WHERE r.c < e.y)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(c) AS c FROM r GROUP BY x) m ON m.x = d.doc_id
"""
