"""Product codes of vectors: Lloyd rounds over partition-local cover trees.

A vector is cut into equal consecutive parts, and every part position has a
codebook of integer entries.  A task builds a cover tree for each part position
over a block of vectors: a node's centre is one of its own points, its children
are centres more than half the node's radius apart, and a node's points are
consecutive, so that running sums over the points give the sum and the number
of any subtree.

To assign a tree, its root starts with all entries as candidates.  By the
triangle inequality an entry that is more than twice the node's radius farther
from the centre than the nearest entry is nearest to no point below, so it goes;
a node with one candidate left is assigned as a whole, by its running sums, and
only ambiguous nodes hand their candidates to their children.  A single point is
a node of radius 0, where the squared distances are compared as integers and
ties go to the lower entry.

The trees are written once and read by every round; a round gives sums by part,
entry and component, added up in each task before they are shuffled, and only
the codebooks pass through the driver.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import materialise, release, table

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Components are whole multiples of 1/SCALE.
SCALE = 256
#: Beyond this, multiples count as this, so that squared distances stay exact.
LARGEST = 1 << 24
#: Vectors of one block of trees.
BLOCK = 8192


class CoverTree:
    """Points of one part position, in an order in which every subtree is consecutive.

    Node k has the points begin[k]:end[k], its centre first; ``child`` and
    ``children`` are its first child and their number, 0 where all points are
    equal.  Nodes stand level by level.
    """

    def __init__(self, order: np.ndarray, begin: np.ndarray, end: np.ndarray, radius: np.ndarray, child: np.ndarray, children: np.ndarray) -> None:
        self.order, self.begin, self.end, self.radius, self.child, self.children = order, begin, end, radius, child, children

    @classmethod
    def build(cls, points: np.ndarray) -> CoverTree:
        """All nodes of a level are split at once: the point farthest from its centre becomes a centre, until every point is within half the node's radius."""
        n = len(points)
        order, centre_at = np.arange(n), np.zeros(1, np.int64)
        begins, ends, radii, childs, many = [], [], [], [], []
        begin, end, made = np.array([0]), np.array([n]), 1
        while len(begin):
            size = end - begin
            node = np.repeat(np.arange(len(begin)), size)
            place = np.arange(len(node)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
            own = points[order[place]]
            first = np.cumsum(size) - size
            # Squared distance to the nearest centre so far, and which one of the node's that is.
            square = ((own - own[first][node]) ** 2).sum(axis=1)
            radius2 = np.maximum.reduceat(square, first)
            group = np.zeros(len(own), np.int64)
            centres = np.where(radius2 > 0, 1, 0)
            centre_row = [first]
            while True:
                far = np.maximum.reduceat(square, first)
                open_ = np.flatnonzero((4 * far > radius2) & (far > 0))
                if not len(open_):
                    break
                # The first farthest point of each open node.
                hit = np.flatnonzero(square == np.where((4 * far > radius2) & (far > 0), far, -1)[node])
                new = hit[np.concatenate([[True], node[hit][1:] != node[hit][:-1]])]
                row = np.full(len(begin), -1)
                row[open_] = new
                inside = np.flatnonzero(row[node] >= 0)
                d = ((own[inside] - own[row[node[inside]]]) ** 2).sum(axis=1)
                nearer = d < square[inside]
                square[inside[nearer]] = d[nearer]
                group[inside[nearer]] = centres[node[inside[nearer]]]
                centres[open_] += 1
                centre_row.append(row)
            begins.append(begin)
            ends.append(end)
            radii.append(np.sqrt(radius2))
            childs.append(np.where(centres > 0, made + np.cumsum(centres) - centres, 0))
            many.append(centres)
            made += int(centres.sum())
            # Children of split nodes become nodes; each centre goes first.
            is_centre = np.zeros(len(own), bool)
            for row in centre_row:
                is_centre[row[row >= 0]] = True
            rank = np.lexsort((~is_centre, group, node))
            order[place] = order[place[rank]]
            kept = centres[node[rank]] > 0
            child_of = node[rank][kept] * (int(centres.max(initial=0)) + 1) + group[rank][kept]
            edge = np.flatnonzero(np.concatenate([[True], child_of[1:] != child_of[:-1]])) if len(child_of) else np.zeros(0, np.int64)
            there = place[kept]
            begin = there[edge]
            end = begin + np.diff(np.concatenate([edge, [len(child_of)]]))
        return cls(order, *(np.concatenate(x) for x in (begins, ends, radii, childs, many)))

    def assign(self, points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, entry): disjoint nodes that hold all points, each with the nearest entry of every one of its points.

        ``points`` stand in the tree's order.
        """
        node = np.zeros(len(entries), np.int64)
        entry = np.arange(len(entries))
        done_node, done_entry = [], []
        while len(node):
            square = ((points[self.begin[node]] - entries[entry]) ** 2).sum(axis=1)
            first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            many = np.diff(np.concatenate([first, [len(node)]]))
            least = np.repeat(np.minimum.reduceat(square, first), many)
            radius = self.radius[node]
            # Roundings of roots are far below one part in 10**9.
            stays = np.where(radius == 0, square == least, np.sqrt(square) <= (np.sqrt(least) + 2 * radius) * (1 + 1e-9))
            node, entry = node[stays], entry[stays]
            first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            many = np.diff(np.concatenate([first, [len(node)]]))
            at = node[first]
            over = (many == 1) | (self.radius[at] == 0)
            done_node.append(at[over])
            done_entry.append(entry[first[over]])
            # Every child gets the candidates that its node has left.
            at, first, many = at[~over], first[~over], many[~over]
            kids = self.children[at]
            each = np.repeat(many, kids)
            child = np.arange(int(kids.sum())) - np.repeat(np.cumsum(kids) - kids, kids) + np.repeat(self.child[at], kids)
            node = np.repeat(child, each)
            entry = entry[np.arange(len(node)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(np.repeat(first, kids), each)]
        return np.concatenate(done_node), np.concatenate(done_entry)

    def arrays(self) -> dict[str, np.ndarray]:
        return {"order": self.order.astype(np.int32), "begin": self.begin.astype(np.int32), "end": self.end.astype(np.int32), "radius": self.radius, "child": self.child.astype(np.int32), "children": self.children.astype(np.int32)}


def whole_parts(vectors: DataFrame, key: str, vector: str, also: list[str]) -> DataFrame:
    """``key``, ``also`` and ``__x``, the components as whole multiples; vectors that are null or hold null or non-finite components go."""
    x = F.col(vector).cast("array<double>")
    whole = F.transform(x, lambda v: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), v * SCALE))).cast("int"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.filter(F.col(vector).isNotNull()).filter(~bad).select(key, *also, whole.alias("__x"))


def _pack(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, **arrays)
    return out.getvalue()


def _trees(rows: DataFrame, width: int, parts: int) -> DataFrame:
    """A row for each block of vectors of a task: the vectors in their order and the trees of their parts."""
    carried = [f for f in rows.schema.fields if f.name != "__x"]
    schema = ", ".join([*(f"`{f.name}` array<{f.dataType.simpleString()}>" for f in carried), "__trees binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t.column("__x").chunks]).reshape(-1, width).astype(np.int64)
            step, packed = width // parts, {"x": x.astype(np.int32)}
            for p in range(parts):
                packed |= {f"{k}{p}": v for k, v in CoverTree.build(x[:, p * step : (p + 1) * step]).arrays().items()}
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), t.column(f.name).combine_chunks()) for f in carried]
            return pa.RecordBatch.from_arrays([*lists, pa.array([_pack(packed)], pa.binary())], names=[*(f.name for f in carried), "__trees"])

        many = 0
        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, BLOCK - many))
                batch = batch.slice(BLOCK - many)
                many += held[-1].num_rows
                if many == BLOCK:
                    yield block()
                    held, many = [], 0
        if many:
            yield block()

    return rows.mapInArrow(run, schema)


def _loaded(packed: bytes, parts: int) -> tuple[np.ndarray, list[CoverTree]]:
    z = np.load(io.BytesIO(packed))
    return z["x"].astype(np.int64), [CoverTree(*(z[f"{k}{p}"] for k in ("order", "begin", "end", "radius", "child", "children"))) for p in range(parts)]


def _round(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """The next codebooks: floor of the mean of each entry's parts; unused entries stay."""
    held = trees.sparkSession.sparkContext.broadcast(books)
    parts, entries, step = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, number = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for packed in batch.column(0):
                x, own = _loaded(packed.as_py(), parts)
                for p, tree in enumerate(own):
                    points = x[tree.order, p * step : (p + 1) * step]
                    node, entry = tree.assign(points, held.value[p])
                    running = np.concatenate([np.zeros((1, step), np.int64), np.cumsum(points, axis=0)])
                    np.add.at(total[p], entry, running[tree.end[node]] - running[tree.begin[node]])
                    np.add.at(number[p], entry, tree.end[node] - tree.begin[node])
        p, e = np.nonzero(number)
        row = np.repeat(np.arange(len(p)), step)
        columns = [p[row], e[row], np.tile(np.arange(step), len(p)), total[p, e].ravel(), number[p, e][row]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "entry", "at", "total", "number"])

    sums = trees.select("__trees").mapInArrow(run, "part long, entry long, at long, total long, number long").groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("number").alias("number"))
    out = books.copy()
    for r in sums.toLocalIterator():  # a number for each component of the codebooks
        out[r.part, r.entry, r.at] = r.total // r.number
    return out


def _coded(trees: DataFrame, books: np.ndarray, fields: list, code: str, error: str) -> DataFrame:
    held = trees.sparkSession.sparkContext.broadcast(books)
    parts, _, step = books.shape
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"{code} string, {error} long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, own = _loaded(batch.column("__trees")[i].as_py(), parts)
                codes, errors = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
                for p, tree in enumerate(own):
                    node, entry = tree.assign(x[tree.order, p * step : (p + 1) * step], held.value[p])
                    by_place = np.argsort(tree.begin[node])
                    codes[tree.order, p] = np.repeat(entry[by_place], (tree.end - tree.begin)[node][by_place])
                    errors += ((x[:, p * step : (p + 1) * step] - held.value[p][codes[:, p]]) ** 2).sum(axis=1)
                text = codes.tobytes().hex()
                lines = [text[k : k + 2 * parts] for k in range(0, len(text), 2 * parts)]
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name)[i].values for f in fields), pa.array(lines, pa.string()), pa.array(errors)], names=[*(f.name for f in fields), code, error])

    return trees.mapInArrow(run, schema)


def product_codes(vectors: DataFrame, key: str, vector: str, also: list[str] | None = None, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(``key``, ``also``, ``code``, ``error``; codebooks as parts x entries x components).

    Rows go whose vector is null, holds a null or non-finite component, or has
    another length than that of the smallest kept key; lengths that ``parts``
    does not divide go too.  Entries start as the vectors of the smallest keys
    (ties: the smallest components; null keys last), fewer if there are fewer
    rows; at most 256.  Repeated rows are coded each.  A table without usable
    rows gives an empty one and no entries.  Components count up to 2**16 in
    absolute value and as that beyond.  Only ``key``, ``vector`` and ``also``
    are read; ``code``, ``error`` and ``__x`` may not be among them.
    """
    also = list(also or [])
    if entries > 256 or {"code", "error", "__x", "__trees"} & {key, *also}:
        raise ValueError("at most 256 entries, and no column named code, error, __x or __trees")
    rows = whole_parts(vectors, key, vector, also).filter((F.size("__x") > 0) & (F.size("__x") % parts == 0))
    least = rows.select(F.col(key).alias("k"), "__x").orderBy(F.col("k").asc_nulls_last(), "__x")
    top = least.first()
    width = len(top[1]) if top else parts
    rows = rows.filter(F.size("__x") == width)
    start = [r[1] for r in least.filter(F.size("__x") == width).limit(entries).collect()]
    books = np.array(start, np.int64).reshape(-1, parts, width // parts).transpose(1, 0, 2).copy()
    fields = [f for f in rows.schema.fields if f.name != "__x"]
    if not start:
        return rows.select(key, *also, F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0), books
    trees = materialise(_trees(rows, width, parts), "trees")
    for _ in range(rounds):
        books = _round(trees, books)
    coded = materialise(_coded(trees, books, fields, "code", "error"), "codes")
    release(trees)
    return coded, books


def codebook_digest(books: np.ndarray) -> str:
    """SHA-256 of all components, by part, entry and place, as decimal integers between commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op12_covertree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of all embeddings, and the error of each label."""
    coded, books = product_codes(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", ["label"])
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """Codebooks by part and entry; a round is a join of all parts with them, of all rows with 64 stated entries."""
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"""picked{k} AS (SELECT vec_id, label, rn, p, x, min_by(e, e + 64 * d) AS e, min(d) AS d FROM (
  SELECT s.*, b.e, list_sum(list_transform(range(1, len(s.x) + 1), lambda i: (s.x[i] - b.c[i]) * (s.x[i] - b.c[i]))) AS d FROM split s JOIN book{k} b USING (p)) GROUP BY vec_id, label, rn, p, x)""")
        if k < ROUNDS:
            steps.append(f"""sums{k} AS (SELECT p, e, i, CAST(sum(x[i]) AS BIGINT) AS t, count(*) AS m FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS i FROM picked{k}) GROUP BY p, e, i),
means{k} AS (SELECT p, e, list((t - ((t % m) + m) % m) // m ORDER BY i) AS c FROM sums{k} GROUP BY p, e),
book{k + 1} AS (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN means{k} m USING (p, e))""")
    return f"""
WITH kept AS (SELECT *, row_number() OVER (ORDER BY vec_id, embedding) AS rn FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0),
whole AS (SELECT vec_id, label, rn, list_transform(embedding, lambda v: CAST(floor(CAST(v AS DOUBLE) * {SCALE}) AS BIGINT)) AS x, len(embedding) // {PARTS} AS w FROM kept),
split AS (SELECT vec_id, label, rn, p, x[p * w + 1 : (p + 1) * w] AS x FROM whole, range({PARTS}) t(p)),
book0 AS (SELECT p, rn - 1 AS e, x AS c FROM split WHERE rn <= {ENTRIES}),
{", ".join(steps)},
coded AS (SELECT vec_id, label, rn, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM picked{ROUNDS} GROUP BY vec_id, label, rn),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, digest
"""


OP12_SQL = _sql()
