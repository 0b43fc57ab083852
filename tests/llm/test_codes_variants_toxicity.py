"""Product codes, spelling variants and toxic passages, against brute force."""

import itertools
import math
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from ledgerline.llm import covertree, toxicity, variants

SF = "/root/testdata/sf0.001"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_sql(sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    return con.execute(sql).df()


# Cover trees


@pytest.mark.parametrize("spread", [4, 300])
def test_tree_invariants_and_assignment(spread):
    rng = np.random.default_rng(spread)
    for n in (1, 2, 50, 400):
        x = rng.integers(-spread, spread, (n, 3))
        tree = covertree.CoverTree.build(x)
        assert sorted(tree.order) == list(range(n))
        points = x[tree.order]
        for b, e, r, c, k in zip(tree.begin, tree.end, tree.radius, tree.child, tree.children, strict=True):
            assert np.sqrt(((points[b:e] - points[b]) ** 2).sum(1)).max() == pytest.approx(r)
            if k:
                centres = points[tree.begin[c : c + k]]
                apart = np.sqrt(((centres[:, None] - centres) ** 2).sum(2)) + np.eye(k) * 1e9
                assert tree.begin[c] == b and tree.end[c + k - 1] == e and (apart > r / 2).all()
            else:
                assert r == 0
        for m in (1, 5, 64):
            entries = rng.integers(-spread, spread, (m, 3))
            node, entry = tree.assign(points, entries)
            got = np.full(n, -1)
            for a, b in zip(node, entry, strict=True):
                got[tree.begin[a] : tree.end[a]] = b
            assert (got == ((points[:, None] - entries) ** 2).sum(2).argmin(1)).all()


def brute_codes(rows, parts, entries, rounds):
    kept = sorted((k, tuple(math.floor(v * 256) for v in x), label) for k, x, label in rows)
    x = np.array([r[1] for r in kept]).reshape(len(kept), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    for k in range(rounds + 1):
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(3)
        code = d.argmin(2)
        for p, e in itertools.product(range(parts), range(books.shape[1])):
            if k < rounds and (code[:, p] == e).any():
                own = x[code[:, p] == e, p]
                books[p, e] = own.sum(0) // len(own)
    return sorted((r[0], "".join(f"{c:02x}" for c in code[i]), int(d[i].min(1).sum())) for i, r in enumerate(kept)), books


def test_product_codes_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i // 2), rng.normal(0, 0.4, 8).round(3).tolist(), int(i % 3)) for i in range(300)]
    rows += [(500 + i, [0.25] * 8, None) for i in range(200)]
    bad = [(901, None, 1), (902, [0.1] * 7 + [None], 1), (903, [float("nan")] + [0.1] * 7, 1), (904, [float("inf")] * 8, None), (905, [], 1), (906, [0.5] * 4, 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, v array<float>, label int")
    exact = [(k, [float(np.float32(y)) for y in x], label) for k, x, label in rows]
    want, books = brute_codes(exact, 4, 16, 2)
    coded, got_books = covertree.product_codes(df.withColumn("extra", df.label), "vec_id", "v", parts=4, entries=16)
    assert sorted((r.vec_id, r.code, r.error) for r in coded.collect()) == want
    assert (got_books == books).all()


def test_blocks_of_a_task_do_not_matter(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").coalesce(1)
    whole = sorted(map(tuple, covertree.product_codes(df, "vec_id", "embedding")[0].collect()))
    monkeypatch.setattr(covertree, "BLOCK", 37)
    assert sorted(map(tuple, covertree.product_codes(df, "vec_id", "embedding")[0].collect())) == whole


def test_codes_of_few_or_no_vectors(spark):
    schema = "vec_id long, v array<float>"
    empty, books = covertree.product_codes(spark.createDataFrame([], schema), "vec_id", "v", parts=2)
    assert empty.collect() == [] and books.size == 0
    few, _ = covertree.product_codes(spark.createDataFrame([(None, [1.0, 1.0]), (7, [3e38, -3e38]), (7, [3e38, -3e38])], schema), "vec_id", "v", parts=2)
    assert sorted((str(r.vec_id), r.error) for r in few.collect()) == [("7", 0), ("7", 0), ("None", 0)]
    with pytest.raises(ValueError):
        covertree.product_codes(spark.createDataFrame([], "code long, v array<float>"), "code", "v")


def test_op12_equals_sql(spark):
    got = covertree.op12_covertree(spark, SF).toPandas()
    want = by_sql(covertree.OP12_SQL.replace("FROM embeddings", f"FROM '{SF}/embeddings.parquet'"))
    assert sorted(map(tuple, got[sorted(got.columns)].values.tolist())) == sorted(map(tuple, want[sorted(want.columns)].values.tolist()))


# Spelling variants


def test_composed_automata_find_each_pair_once():
    rng = random.Random(1)
    for letters in ("ab", "abcd", "aé\U0001f600"):
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(200)})
        one, two = variants.one_edit_pairs(variants.Acceptor(words))
        got = sorted(tuple(sorted((words[a], words[b]))) for a, b in zip(one, two, strict=True))
        assert got == [p for p in itertools.combinations(words, 2) if near(*p)]


def test_acceptor_is_minimal():
    a = variants.Acceptor(sorted(x + y for x in ("ab", "cb", "db") for y in ("ing", "ed")))
    assert len(a.final) == 7 and a.words[a.root] == 6


@pytest.mark.parametrize("most", [2, 12, 4096])
def test_near_words_however_parts_are_cut(spark, most):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(5, 8))) for _ in range(250)})
    n = {w: rng.randint(3, 40) for w in words}
    got = {r.word: r for r in variants.near_words(spark.createDataFrame(list(n.items()), "word string, n long"), most).collect()}
    for w in words:
        there = [x for x in words if near(x, w)]
        assert (w in got) == bool(there)
        if there:
            best = min(there, key=lambda x: (-n[x], x))
            assert (got[w].n_near, got[w].near, got[w].near_n) == (len(there), best, n[best])


def test_forms_and_roots(spark):
    words = [("aaaaa", 3), ("aaaab", 6), ("aaabb", 12), ("aabbb", 30), ("zzzzz", 5), ("zzzzy", 9), ("lonely", 4)]
    got = {r.word: r for r in variants.spelling_forms(spark.createDataFrame(words, "word string, n long")).collect()}
    assert [got[w].root for w in ("aaaaa", "aaaab", "aaabb", "aabbb")] == ["aabbb"] * 4
    assert got["aaaaa"].form == "aaaab" and got["aaaaa"].form_n == 6 and got["aabbb"].form is None and got["aabbb"].n_near == 1
    assert got["zzzzz"].form is None and got["zzzzz"].root == "zzzzz" and got["lonely"].n_near == 0
    assert variants.spelling_forms(spark.createDataFrame([], "word string, n long")).collect() == []


def test_counted_words(spark):
    long = "q" * 30_000
    rows = [(1, "Hello hello, HELLO ×÷ÀÉ 日本hello"), (None, "hello"), (2, None), (3, ""), (4, f"{long} {long} {long}"), (4, f"{long}")]
    want = {}
    for key, text in rows:
        for run in __import__("re").findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            run = run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] = want.get(run, 0) + 1
    df = spark.createDataFrame([(k, t, 0, "x") for k, t in rows], "doc_id long, text string, n int, word string")
    got = {r.word: r.n for r in variants.count_words(df).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 5 and n >= 3} and got
    assert variants.count_words(df.limit(0)).collect() == []


def test_op13_equals_sql(spark):
    got = variants.op13_variants(spark, SF).toPandas()
    want = by_sql(variants.OP13_SQL.replace("FROM documents", f"FROM '{SF}/documents.parquet'"))
    key = lambda df: sorted(tuple(v if isinstance(v, str) else "" if pd.isna(v) else int(v) for v in r) for r in df[sorted(df.columns)].values.tolist())
    assert key(got) == key(want) and len(got)


# Toxic passages


def test_maximal_segments_equal_their_definition():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(1, 14)
        score = [rng.choice([-0.5, -0.5, rng.random()]) for _ in range(n)]  # no ties
        at = [i for i, s in enumerate(score) if s > 0]
        got = sorted((a, b) for a, b, _ in toxicity.maximal_segments(np.array(at, int), np.array([score[i] for i in at]), 0.5)) if at else []

        def best(low, high):
            """The definition: the best contiguous segment, and then what lies on both sides of it."""
            found = max(((sum(score[a : b + 1]), -(b - a), a, b) for a in range(low, high) for b in range(a, high)), default=(0,))
            if found[0] <= 0:
                return []
            _, _, a, b = found
            return [*best(low, a), (a, b), *best(b + 1, high)]

        assert got == sorted(best(0, n))


def test_poisson_tail():
    for r, mean in ((1, 0.3), (3, 0.01), (5, 2.0), (2, 1e-8)):
        terms = [mean**k * math.exp(-mean) / math.factorial(k) for k in range(r, r + 40)]
        assert toxicity.at_least(r, mean) == pytest.approx(-math.log(sum(terms)), rel=1e-6)
    assert toxicity.at_least(1, 50.0) == 0.0


def made(rng, toxic):
    words = [rng.choice(["lorem", "ipsum", "dolor", "amet", "velit"]) + rng.choice(["", "a", "us"]) for _ in range(60)]
    if toxic:
        words[20:20] = [rng.choice(["nastyword", "vileness"]) for _ in range(3)]
    return " ".join(words)


def test_planted_passages_are_found_and_bounds_hold(spark):
    rng = random.Random(9)
    rows = [(i, made(rng, i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    odd = [(1000, None), (1001, ""), (1002, "lorem " * 50_000 + "nastyword vileness nastyword"), (1003, "VILENESS nastyword nastyword!"), (1004, "ipsum")]
    got = {r.doc_id: r for r in toxicity.score_toxicity(spark.createDataFrame([*rows, *odd, odd[2]], "doc_id long, text string"), model).collect()}
    assert all((got[i].score >= 0.5) == (i % 4 == 0) for i, _ in rows)
    for i, text in rows:
        for p in got[i].passages:
            assert {w for w in text[p.begin : p.end].split() if w in ("nastyword", "vileness")}
        assert bool(got[i].passages) == (i % 4 == 0)
    assert got[1000].score == got[1001].score == got[1004].score < 0.5
    assert got[1002].score >= 0.5 and got[1002].passages[0].begin == 300_000 and got[1003].score >= 0.5


def test_no_labels_or_one_kind(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.score for r in toxicity.score_toxicity(docs, none).collect()] == [0.5, 0.5]
    one = toxicity.train(docs, spark.createDataFrame([(1, 0), (None, 1)], "doc_id long, toxic int"))
    assert all(r.score < 0.5 for r in toxicity.score_toxicity(docs, one).collect())
    with pytest.raises(ValueError):
        toxicity.score_toxicity(docs.withColumn("score", docs.doc_id), one)


def test_op11_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = toxicity.op11_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)
    assert sum(r.predicted == r.toxic for r in got) >= 0.95 * len(got)
