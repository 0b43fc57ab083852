"""Training-data operators against brute force, on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from ledgerline.llm import bpe, chat, common, decontaminate, jaccard, quality, secrets, sharding, suffixes, tiff, unit_dedup

rng = random.Random(5)
VOCAB = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) + ("." if r.random() < 0.1 else "") for _ in range(n))


def corpus():
    base = [prose(60 + 10 * i, i) for i in range(12)]
    near = base[3].split()
    near[7] = "changed"
    passage = prose(55, 99)
    texts = [*base, base[3], " ".join(near), base[5], base[1] + " " + passage, passage + " " + base[2], None, "", "one two", "One  TWO", "x" * 5000, prose(4000, 7), "é \U0001f600 " + base[4]]
    return [(i, t, "s0" if i % 3 else None, 1.5) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string, source string, shard double").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, shard double")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_jaccard_equals_brute_force(docs):
    sets = {i: shingles(t) for i, t, *_ in corpus()}
    least = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    least[a] = min(least[a], least[b])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_documents(docs).collect()}
    assert got == {i: (len(sets[i]), least[i]) for i in sets}
    assert got[12][1] == 3 and got[13][1] == 3 and got[20][1] == 19


def test_jaccard_of_an_empty_table(empty):
    assert jaccard.similar_documents(empty).count() == 0


def test_sharding_law_and_mixture(docs, empty):
    rows = sharding.interleave(docs, "source", "doc_id", 4, tie=["text"]).collect()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    sizes = [len(v) for v in by.values()]
    assert len(rows) == len(corpus()) and max(sizes) - min(sizes) <= 1
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    of = [sum(r["source"] is None for r in v) for v in by.values()]
    assert max(of) - min(of) <= 2
    assert sharding.interleave(empty, "source", "doc_id", 4).count() == 0


def test_secrets_base_patterns_and_random_runs(spark, empty):
    r = random.Random(1)
    key = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(44))
    texts = [None, "", 'password = "hunter2x" token:abc Secret=é', "AKIA" + "Z" * 16, "\U0001f600 " + "0123456789abcdef" * 2, f"say {key} now", "donaudampfschifffahrtsgesellschaftskapitaen", "a-long-hyphenated-identifier-of-words"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, secrets string")
    got = {r["doc_id"]: [tuple(x) for x in r["secrets"]] for r in secrets.scan_secrets(df).collect()}
    assert got[0] == got[1] == [] and got[2] == [(0, 0, 20)] and got[3] == [(0, 1, 20)] and got[4] == [(2, 2, 34)]
    assert got[5] == [(4, 3, 48)] and got[6] == got[7] == []
    assert secrets.scan_secrets(empty).count() == 0


def test_battery_rejects_patterned_runs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("abcdefghijklmnopqrstuvwxyz0123456789",), ("a1" * 20,)], "t string").select(secrets.battery(F.col("t")).alias("b"))
    assert not any(r["b"]["uniform"] for r in df.collect())


def test_battery_accepts_random_base36_of_any_length(spark):
    from pyspark.sql import functions as F

    r = random.Random(11)
    for letters in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
        tokens = [("".join(r.choice(letters + "0123456789") for _ in range(n)),) for n in (32, 48, 64, 128) for _ in range(25)]
        got = [x["b"]["uniform"] for x in spark.createDataFrame(tokens, "t string").select(secrets.battery(F.col("t")).alias("b")).collect()]
        assert [sum(got[i : i + 25]) >= 23 for i in range(0, 100, 25)] == [True] * 4, [sum(got[i : i + 25]) for i in range(0, 100, 25)]


def test_leaks_are_found_where_they_stand(spark, docs, empty):
    items = [(0, prose(30, 500)), (1, prose(13, 501)), (2, None), (3, ""), (4, "tiny words here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [(0, prose(40, 1) + " " + items[0][1].upper() + " " + prose(5, 2), 1), (1, prose(80, 3), 1), (2, None, 1), (3, "so tiny  words here end", 1), (4, items[1][1], 1), (4, items[1][1], 1)]
    df = spark.createDataFrame(texts, "doc_id long, text string, item_id int")
    got = [(r["doc_id"], x["item"], x["similarity"], r["text"][x["start"] : x["end"]]) for r in decontaminate.find_leaks(df, bench).collect() for x in r["leaks"]]
    assert sorted((a, b, c) for a, b, c, _ in got) == [(0, 0, 1.0), (3, 4, 1.0), (4, 1, 1.0), (4, 1, 1.0)]
    assert next(t for a, _, _, t in got if a == 0) == items[0][1].upper()
    assert decontaminate.find_leaks(empty, bench).count() == 0
    assert all(not r["leaks"] for r in decontaminate.find_leaks(df, bench.limit(0)).collect())


def test_changed_items_are_found_as_by_brute_force():
    r, items, texts = random.Random(5), [], []
    for i in range(60):
        w = prose(r.choice((20, 39, 50, 60, 80, 150, 300)), 2000 + i).split()
        items.append((i, " ".join(w)))
        for kind in ("change", "insert", "drop"):
            v = list(w)
            for _ in range(r.choice((1, 1, 2, 3))):
                at = r.randrange(len(v))
                v[at : at + (kind != "insert")] = [] if kind == "drop" else ["new"]
            texts += [" ".join(v), f"{prose(20, i)} {' '.join(v)} {prose(20, i + 1)}"]
    index = decontaminate.BenchmarkIndex(items)
    got = {(t, x[0]): x[1] for t, row in enumerate(index.leaks([t.encode() for t in texts])) for x in row}
    want = {}
    for t, text in enumerate(texts):
        value = decontaminate.wordhash.words([text.encode()])[0]
        n = min(int(index.lengths[t // 6]), len(value))
        s = max(index.similarity(t // 6, value[a : a + n]) for a in range(len(value) - n + 1))
        if s >= decontaminate.SIMILARITY:
            want[t, t // 6] = s
    assert got == want and len(want) > 100


def test_multi_index_finds_every_fingerprint_within_the_radius():
    index = decontaminate.BenchmarkIndex([(i, prose(40, i)) for i in range(50)])
    size, (own, *_) = next(iter(index.classes.items()))
    g = np.random.default_rng(3)
    prints = own[g.integers(0, len(own), 4000)].copy()
    for i in range(len(prints)):
        for b in g.choice(64, g.integers(0, 12), replace=False):
            prints[i] ^= np.uint64(1) << np.uint64(b)
    window, row, _ = index.candidates(size, prints)
    brute = {(i, j) for i in range(len(prints)) for j in np.flatnonzero(np.bitwise_count(prints[i] ^ own) <= decontaminate.RADIUS).tolist()}
    assert set(zip(window.tolist(), row.tolist(), strict=True)) == brute


def test_tiff_round_trips():
    r = random.Random(2)
    for n in (0, 1, 2, 130, 5000, 40000):
        for data in (r.randbytes(n), b"a" * n, bytes(r.choice(b"abc") for _ in range(n))):
            assert tiff.packbits_decode(tiff.packbits_encode(data), n) == data and tiff.lzw_decode(tiff.lzw_encode(data), n) == data
    a = np.frombuffer(r.randbytes(64 * 37), np.uint8).reshape(37, 64)
    for codec in (tiff.PLAIN, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS):
        for predictor in (1, 2):
            for tile in (None, (16, 16), (32, 48)):
                (page,) = tiff.read_pages(tiff.tiff_bytes(a, codec, predictor, 10, tile))
                assert page.pixels == a.tobytes()


def test_tiff_pages_of_media_rows(spark, docs):
    one = tiff.tiff_bytes(np.zeros((3, 64), np.uint8))
    df = spark.createDataFrame([(1, one), (2, None), (3, b"junk"), (4, one[:40])], "id int, media binary")
    got = {r["id"]: r for r in tiff.tiff_pages(df, "media", ["id"]).collect()}
    assert set(got) == {1, 3, 4} and got[1]["height"] == 3 and got[3]["error"] and got[4]["error"]
    with pytest.raises(ValueError):
        tiff.tiff_pages(df.withColumnRenamed("id", "page"), "media", ["page"])


def test_units_equal_brute_force(docs, empty):
    got = {(r["key"], r["start"], r["end"]) for r in unit_dedup.repeated_units(docs, unit="sentence").collect()}
    seen, want = set(), set()
    for i, text, *_ in corpus():
        for m in re.finditer(r"\S[^\n]*?(?:[.!?](?=\s|$)|(?=\s*\n)|(?=\s*$))", text or ""):
            w = tuple(words(m[0]))
            if len(w) >= unit_dedup.MIN_WORDS:
                if w in seen:
                    want.add((i, m.start(), m.end()))
                seen.add(w)
    assert got == want and got
    removed = unit_dedup.repeated_units(docs)
    texts = {r["doc_id"]: (r["text"], r["kept"]) for r in unit_dedup.remove_units(docs, removed).collect()}
    original = {i: t for i, t, *_ in corpus()}
    assert all(t is None or t == "".join(original[i][k["start"] : k["end"]] for k in kept) for i, (t, kept) in texts.items())
    assert unit_dedup.repeated_units(empty).count() == 0


def test_short_lines_and_lines_of_short_sentences_are_units(spark):
    licence, short = "Released under the MIT license.", "En la. Et enim. Tu quoque. Ave atque."
    texts = [(0, f"{licence}\n{short}\n\nYes"), (1, f"one\n{licence.upper()}\ntwo"), (2, f"{short}\nthree"), (3, f"four\n\n{licence}\n{short}\n\nyes"), (4, f"five {licence}")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    removed = unit_dedup.repeated_units(df)
    assert {r["kept_key"] for r in removed.collect()} == {0}
    got = {r["doc_id"]: r["text"] for r in unit_dedup.remove_units(df, removed).collect()}
    assert got == {0: texts[0][1], 1: "one\n\ntwo", 2: "\nthree", 3: "four\n\n\n\n", 4: texts[4][1]}


@pytest.mark.parametrize("crowded", [suffixes.CROWDED, 3, 2])
def test_passages_equal_brute_force(docs, empty, monkeypatch, crowded):
    monkeypatch.setattr(suffixes, "CROWDED", crowded)
    seen = {}
    for i, text, *_ in corpus():
        w = words(text)
        for k in range(len(w) - suffixes.LENGTH + 1):
            seen.setdefault(tuple(w[k : k + suffixes.LENGTH]), []).append((i, k))
    want = {(i, j) for v in seen.values() if len(v) > 1 for i, k in v for j in range(k, k + suffixes.LENGTH)}
    got = {(r["key"], j) for r in suffixes.repeated_passages(docs).collect() for j in range(r["start"], r["end"])}
    assert got == want and want
    assert suffixes.repeated_passages(empty).count() == 0


def test_passages_do_not_depend_on_how_a_key_is_sorted(spark, monkeypatch):
    """Equal rows from one task a key and from ranges with edges, also where three texts share only parts of a passage, so that neighbours shorten a span."""
    r, p = random.Random(21), prose(110, 820).split(" ")
    rows = []
    for i in range(300):
        a, b = sorted((r.randrange(0, 60), r.randrange(50, 111)))
        rows.append((i if i % 50 else None, f"{prose(20, 2000 + i)} {' '.join(p[a:b])} {prose(20, 3000 + i)}"))
    rows += [rows[7], (400, rows[7][1]), (401, " ".join(p + p))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(suffixes, "CROWDED", 10**9)
    want = sorted(map(tuple, suffixes.repeated_passages(df).collect()), key=str)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        for bar in (40, 2):
            monkeypatch.setattr(suffixes, "CROWDED", bar)
            assert sorted(map(tuple, suffixes.repeated_passages(df).collect()), key=str) == want and len(want) > 100
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("crowded", [suffixes.CROWDED, 10])
def test_removing_later_passages_leaves_one_of_each(spark, monkeypatch, crowded):
    monkeypatch.setattr(suffixes, "CROWDED", crowded)
    p, q = prose(60, 800), prose(70, 801)
    texts = [(i, f"{prose(30, 900 + i)} {p} {prose(30, 1000 + i)}") for i in range(100, 140)]
    texts += [(50, f"{p} {q}"), (20, f"{prose(30, 1)} {q} {prose(30, 2)}"), (60, f"{q} {p}"), (None, f"{p} {p}")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    gone = {}
    for r in suffixes.repeated_passages(df).collect():
        if not r["first"]:
            gone.setdefault(r["key"], set()).update(range(r["start"], r["end"]))
    left = [" ".join(w for j, w in enumerate(words(t)) if j not in gone.get(i, ())) for i, t in texts]
    for passage in (words(p), words(q)):
        for k in range(len(passage) - suffixes.LENGTH + 1):
            assert sum(t.count(" ".join(passage[k : k + suffixes.LENGTH])) for t in left) == 1
    assert {i: t for (i, _), t in zip(texts, left, strict=True)}[50].startswith(" ".join(words(p)))


def test_chat_reads_back_and_expands(spark):
    turns = [(1, 0, "system", "be \\ kind"), (1, 1, "user", None), (1, 2, "assistant", "<|end|>\n</s>[INST] ok"), (1, 3, "user", "b"), (1, 4, "assistant", "é\U0001f600"), (2, None, None, "lone"), (2, None, None, "lone"), (None, 0, "us\ner\\n", "hi"), (None, 1, "assistant", "long " * 30000)]
    df = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, segment string")
    formatted = chat.format_turns(df)
    assert chat.read_back(*[f(chat.format_turns(df.limit(0))) for f in (lambda t: t, chat.examples)]).count() == 0
    one = chat.read_back(*[f(chat.format_turns(spark.createDataFrame([(1, 0, "us\ner", "hi")], df.drop("segment").schema))) for f in (lambda t: t, chat.examples)]).first()
    assert one["turns_sha256"] == hashlib.sha256(b"us\ner\nhi\n").hexdigest() and chat.unescape_role("us\\ner") == "us\ner"
    got = {r["conv_id"]: r for r in chat.read_back(formatted, chat.examples(formatted)).collect()}
    for c in (1, 2, None):
        own = [(r or "", t or "") for i, _, r, t in turns if i == c]
        loss = "".join(t for r, t in own if r == "assistant")
        assert got[c]["n_examples"] == sum(r == "assistant" for r, _ in own)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"], got[c]["n_turns"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(own))
    examples = {r["position"]: r for r in chat.example_texts(formatted.filter("conv_id = 1")).collect()}
    assert sorted(examples) == [2, 4]
    assert chat.unescape(examples[2]["text"][examples[2]["loss_start"] : examples[2]["loss_end"]]) == turns[2][3]
    assert examples[4]["text"].startswith(examples[2]["text"])
    short = {r["position"]: r for r in chat.examples(formatted).filter("conv_id = 1").collect()}
    assert all(examples[p]["text"][short[p]["context_end"] :] == short[p]["reply"] for p in examples)


def test_bpe_equals_the_library(docs):
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.bpe_path()
    library, own = tokenizers.Tokenizer.from_file(path), bpe.BpeModel(path)
    texts = [t or "" for _, t, *_ in corpus()] + ["<|endoftext|> It's WE'LL 12½ İ ΣΣ é \x1c\x85a", "ab" * 900, "日本 \U0001f600"]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids and own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    rows = bpe.digests(docs).collect()
    assert len(rows) == len(corpus()) and all(r["n_tokens"] == len(own.encode(dict((i, t) for i, t, *_ in corpus())[r["doc_id"]] or "")) for r in rows)


def test_quality_on_held_out_documents(spark):
    S = "/root/testdata/sf0.01"
    scored = quality.op8_quality(spark, S).join(spark.read.parquet(f"{S}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert (scored["predicted"] == scored["quality"]).mean() > 0.95 and scored["score"].between(0, 1).all()
    zero = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert quality.score_quality(zero, quality.LineCrf.constant(0.5)).count() == 2


def test_marginals_equal_enumeration():
    from itertools import product

    g = np.random.default_rng(1)
    unary, pair, first = g.normal(size=7), g.normal(size=(2, 2)), np.array([0, 4, 5, 7])
    good, _, _ = quality.marginals(unary, first, pair)
    for a, b in zip(first[:-1], first[1:], strict=True):
        total, on = 0.0, np.zeros(b - a)
        for y in product((0, 1), repeat=b - a):
            p = np.exp(sum(unary[a + i] * v for i, v in enumerate(y)) + sum(pair[y[i], y[i + 1]] for i in range(len(y) - 1)))
            total += p
            on += p * np.array(y)
        assert np.allclose(good[a:b], on / total)


def test_op5_digests(spark):
    S = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{S}/documents.parquet").collect()}
    for r in tiff.op5_media(spark, S).collect():
        payload = texts[r["doc_id"]].ljust(max(64, -(-len(texts[r["doc_id"]]) // 64) * 64), b"\0")
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_pipeline_keeps_columns(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 50


# Words whose polynomial hashes coincide modulo 2^64 whatever the odd base.
THUE = "".join("ab"[i.bit_count() % 2] for i in range(1024))
MORSE = THUE.translate({97: "b", 98: "a"})


def test_words_built_to_collide_do_not(spark):
    head = "one two three four five "
    df = spark.createDataFrame([(1, THUE), (2, MORSE), (3, head + THUE), (4, head + MORSE)], "doc_id long, text string")
    assert {r["component_id"] for r in jaccard.similar_documents(df).collect()} == {1, 2, 3, 4}
    assert unit_dedup.repeated_units(df).count() == 0
    index = decontaminate.BenchmarkIndex([(0, prose(20, 1) + " " + THUE)])
    assert index.leaks([(prose(20, 1) + " " + THUE).encode()])[0][0][1] == 1.0 and index.leaks([MORSE.encode()]) == [[]]
    words = [decontaminate.wordhash.words([" ".join(THUE if (c == "a") == turn else MORSE for c in THUE).encode()])[0] for turn in (True, False)]
    assert all(decontaminate.wordhash.shingles(words[0], k)[0] != decontaminate.wordhash.shingles(words[1], k)[0] for k in (2, 25, 50, 1024))


def test_jaccard_of_null_keys_and_repeated_rows(spark):
    a, b = prose(40, 60), prose(40, 61)
    df = spark.createDataFrame([(None, a), (7, a), (7, a), (None, b), (3, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard.similar_documents(df).collect()), key=str)
    assert got == sorted([(None, 7), (7, 7), (7, 7), (None, None), (3, 3)], key=str)


def test_large_families_of_near_copies_join_as_by_brute_force(spark):
    r, base, rows = random.Random(4), prose(120, 70).split(), []
    for i in range(150):
        w = list(base)
        for _ in range(r.choice((0, 1, 1, 2, 3))):
            w[r.randrange(len(w))] = f"new{i}"
        rows.append((i, " ".join(w)))
    sets = {i: shingles(t) for i, t in rows}
    least = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    got = {x["doc_id"]: x["component_id"] for x in jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == least


def test_sharding_of_null_keys_ties_and_repeats(spark):
    df = spark.createDataFrame([(None, f"t{i % 9}", "a") for i in range(40)] + [(5, "x", None)] * 10, "doc_id long, text string, source string")
    rows = sharding.interleave(df, "source", "doc_id", 4, tie=["text"]).collect()
    sizes = [sum(r["shard"] == s for r in rows) for s in range(4)]
    assert sorted(sizes) == [12, 12, 13, 13]
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s])) for s in range(4))


def test_sharding_spreads_repeats_and_small_strata(spark, monkeypatch):
    df = spark.range(3000).selectExpr("7L AS doc_id", "id % 2 AS tie", "'hot' AS source").unionByName(spark.range(3000).selectExpr("id AS doc_id", "id AS tie", "concat('s', id) AS source"))
    found = {}
    for size in (100, 10_000):
        monkeypatch.setattr(sharding, "BUCKET_ROWS", size)
        for collapse in (True, False):
            rows = sharding.interleave(df, "source", "doc_id", 12, tie=["tie"], collapse=collapse).collect()
            found[size, collapse] = sorted((r["shard"], r["slot"], r["doc_id"], r["tie"], r["source"]) for r in rows)
    # Neither the number of buckets nor counting equal rows first changes a place.
    assert len(set(map(str, found.values()))) == 1
    got = found[100, True]
    assert [(s, k) for s, k, *_ in got] == [(s, k) for s in range(12) for k in range(500)]
    hot = [sum(r[0] == s and r[4] == "hot" for r in got) for s in range(12)]
    assert sum(hot) == 3000 and max(hot) - min(hot) < 80
    # Runs of equal rows longer than an array are written out whole.
    monkeypatch.setattr(sharding, "_RUN", 64)
    again = sharding.interleave(df, "source", "doc_id", 12, tie=["tie"], collapse=True).collect()
    assert sorted((r["shard"], r["slot"], r["doc_id"], r["tie"], r["source"]) for r in again) == got


def planted(kind, n, r):
    letters = "abcdefghijklmnopqrstuvwxyz"
    sets = {"hex": "0123456789ABCDEF", "base32": letters.upper() + "234567", "base36": letters + "0123456789", "BASE36": letters.upper() + "0123456789", "base62": letters + letters.upper() + "0123456789", "base64": letters + letters.upper() + "0123456789+/", "lower": letters, "upper": letters.upper()}
    return "".join(r.choice(sets[kind]) for _ in range(n))


def test_recall_and_precision_of_random_runs(spark):
    r = random.Random(21)
    natural = ["".join(r.choice(VOCAB) for _ in range(8))[: r.randrange(20, 60)] for _ in range(150)] + ["_".join(r.choice(VOCAB) for _ in range(6)) for _ in range(150)] + ["snakeCaseName".join(r.choice(VOCAB).title() for _ in range(3)) for _ in range(50)]
    cases = [(kind, n, planted(kind, n, r)) for kind in ("hex", "base32", "base36", "BASE36", "base62", "base64") for n in (40, 64) for _ in range(15)] + [(kind, 128, planted(kind, 128, r)) for kind in ("lower", "upper") for _ in range(15)]
    df = spark.createDataFrame([("natural", 0, t) for t in natural] + cases, "kind string, n int, text string")
    found = secrets.scan_secrets(df).selectExpr("kind", "n", "exists(secrets, x -> x.k = 3) AS hit").toPandas().groupby(["kind", "n"])["hit"].mean().to_dict()
    assert found.pop(("natural", 0)) <= 0.02
    assert min(found.values()) >= 0.7 and np.mean(list(found.values())) >= 0.9, found


def test_secrets_equal_brute_force_on_long_texts_and_repeats(spark):
    r = random.Random(8)
    parts = ["token=abcdef1234", "AKIA" + "Q" * 16, "0123456789abcdef" * 2, "PASSWORD: 'short'", "api_key = \"long.er/value=\"", "word", "\U0001f600"]
    text = " ".join(r.choice(parts) for _ in range(6000))
    df = spark.createDataFrame([(1, text), (1, text), (2, None)], "doc_id long, text string")
    got = [[(x["s"], x["k"], x["e"]) for x in row["secrets"] if x["k"] < 3] for row in secrets.scan_secrets(df).orderBy("doc_id").collect()]
    assign = re.compile(r"((?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    want = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    assert got[0] == got[1] == sorted(want) and got[2] == [] and len(want) > 1000
    with pytest.raises(ValueError):
        secrets.scan_secrets(df.withColumn("__base", df.doc_id))


def test_leaks_with_text_ids_blocks_and_long_texts(spark, monkeypatch):
    items = [(f"item {i}", prose(30, 600 + i)) for i in range(6)]
    texts = [(1, prose(20000, 5) + " " + items[2][1] + " " + items[4][1], "x"), (2, items[0][1], "y"), (2, None, "z")]
    df = spark.createDataFrame(texts, "doc_id long, text string, item string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = [(1, ["item 2", "item 4"]), (2, []), (2, ["item 0"])]
    for size in (decontaminate.BLOCK_BYTES, 300):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        rows = decontaminate.find_leaks(df, bench).collect()
        assert sorted((r["doc_id"], sorted(x["item"] for x in r["leaks"])) for r in rows) == want


def test_broken_and_oversized_tiffs_give_an_error_row(spark):
    import struct

    good = tiff.tiff_bytes(np.arange(4096, dtype=np.uint8).reshape(64, 64), tiff.PACKBITS)
    cut = bytearray(good)
    at = struct.unpack_from("<I", cut, 4)[0]
    for k in range(struct.unpack_from("<H", cut, at)[0]):
        tag = struct.unpack_from("<H", cut, at + 2 + 12 * k)[0]
        if tag == tiff.STRIP_COUNTS:
            struct.pack_into("<I", cut, at + 10 + 12 * k, 5)
    huge = bytearray(good)
    struct.pack_into("<I", huge, at + 10, 4_000_000_000)
    df = spark.createDataFrame([(1, bytes(cut)), (2, bytes(huge)), (3, good)], "id int, media binary")
    got = {r["id"]: r for r in tiff.tiff_pages(df, "media", ["id"]).collect()}
    assert got[1]["error"] and got[2]["error"] and got[3]["error"] is None and got[3]["height"] == 64
    assert tiff.tiff_pages(df.limit(0), "media", ["id"]).count() == tiff.bytes_as_tiff(df.limit(0), "media", "out").count() == 0
    with pytest.raises(ValueError):
        tiff.bytes_as_tiff(df, "media", "id")


def test_every_form_of_storage_meets_every_length(spark):
    r = random.Random(6)
    data = [(i, r.choice((b"", b"ab", r.randbytes(100), prose(3000, i).encode(), prose(120, i).encode()))) for i in range(80)]
    df = spark.createDataFrame(data, "id int, raw binary")
    stored = tiff.bytes_as_tiff(df, "raw")
    back = {x["id"]: (bytes(x["pixels"]), x["codec"]) for x in tiff.tiff_pages(stored, "media", ["id"]).collect()}
    assert all(back[i][0] == d.ljust(max(64, -(-len(d) // 64) * 64), b"\0") for i, d in data)
    assert {(back[i][1], len(d) > 5000) for i, d in data} >= {(c, True) for c in (tiff.LZW, tiff.PACKBITS, tiff.DEFLATE)}


def test_planar_bits_are_interleaved():
    tags = {tiff.WIDTH: (3,), tiff.HEIGHT: (1,), tiff.SAMPLES: (2,), tiff.BITS: (4, 4), tiff.PLANAR: (2,), tiff.STRIP_OFFSETS: (0, 2), tiff.STRIP_COUNTS: (2, 2)}
    assert tiff._page(bytes([0x12, 0x30, 0xAB, 0xC0]), tags, "<").pixels == bytes([0x1A, 0x2B, 0x3C])


def test_bpe_of_long_words_equals_the_library_in_bounded_time():
    tokenizers = pytest.importorskip("tokenizers")
    import time

    library, own = tokenizers.Tokenizer.from_file(bpe.bpe_path()), bpe.BpeModel(bpe.bpe_path())
    r = random.Random(3)
    for n in (511, 513, 3000, 40000):
        word = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        assert own.encode(word) == library.encode(word, add_special_tokens=False).ids
    begin = time.time()
    own.encode("".join(r.choice("etaoinshr") for _ in range(300_000)))
    assert time.time() - begin < 30


def test_bpe_edge_cases(spark, empty):
    assert bpe.digests(empty).count() == bpe.encode_texts(empty).count() == 0
    rows = bpe.digests(spark.createDataFrame([(None, None), (1, ""), (1, "")], "doc_id long, text string")).collect()
    assert len(rows) == 3 and {r["ids_sha256"] for r in rows} == {hashlib.sha256(b"").hexdigest()}
    with pytest.raises(ValueError):
        bpe.encode_texts(empty.withColumnRenamed("source", "ids"))


def test_quality_edge_cases(spark, empty):
    marks = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, quality int")
    texts = [(i, ("good line of words here.\n" if i % 2 else "###!!!\n$$$\n") * 6, i) for i in range(40)]
    docs = spark.createDataFrame(texts + [(None, "x", 0), (3, None, 0), (41, "\n" * 200_000, 0)], "doc_id long, text string, score int")
    model = quality.train(docs, marks)
    assert quality.train(empty, marks).weights[:-1].max() == 0 and quality.train(docs, marks.limit(0)).slope == 1.0
    got = quality.score_quality(docs.drop("score"), model).collect()
    assert len(got) == 43 and all(0 <= r["score"] <= 1 for r in got)
    assert np.mean([(r["score"] >= 0.5) == r["doc_id"] % 2 for r in got if r["doc_id"] is not None and r["text"] and r["doc_id"] < 40]) == 1
    with pytest.raises(ValueError):
        quality.score_quality(docs, model)
    assert quality.score_quality(empty, model).count() == 0


@pytest.mark.parametrize("crowded", [suffixes.CROWDED, 2])
def test_units_and_passages_of_null_keys_and_repeated_rows(spark, monkeypatch, crowded):
    monkeypatch.setattr(suffixes, "CROWDED", crowded)
    line, text = "a line that stays", prose(60, 300)
    df = spark.createDataFrame([(None, line), (4, line), (4, line), (9, None)], "doc_id long, text string")
    assert [(r["key"], r["kept_key"]) for r in unit_dedup.repeated_units(df).collect()] == [(None, 4)]
    df = spark.createDataFrame([(None, text), (4, text), (4, text)], "doc_id long, text string")
    assert {(r["key"], r["first"]) for r in suffixes.repeated_passages(df).collect()} == {(None, False), (4, True)}


def test_pipeline_stages_on_hard_rows(spark, tmp_path):
    """Every stage on nulls, empty and long texts, ties and repeats, against what each operator says of the same rows."""
    import corpus_pipeline

    r = random.Random(9)
    good = [prose(60, 700 + i).capitalize() for i in range(30)]
    items = [(0, prose(25, 900)), (1, prose(40, 901))]
    key = planted("base62", 44, r)
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(good)]
    rows += [(50, good[3], "en", "s", 1), (50, good[3], "en", "s", 1), (51, f"{prose(30, 5)} {items[0][1]} {prose(30, 6)}", "en", "s", 1), (52, f"{prose(40, 7)} password = hunter2x {key}", "en", "s", 1), (53, None, None, None, None), (54, "", "en", "s", 0), (55, prose(6000, 8), "en", "s", 1), (None, prose(50, 11), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, folder)
        assert after.columns == docs.columns, name
        ids = sorted((x["doc_id"] for x in after.collect()), key=str)
        if name == "near_duplicates":
            assert 50 not in ids and 3 in ids and len(ids) == len(set(ids))
        if name == "decontaminate":
            assert 51 not in ids and {0, 52, 55, None} <= set(ids)
        if name == "secrets":
            masked = {x["doc_id"]: (x["text"], x["n_chars"]) for x in after.collect()}
            assert "hunter2x" not in masked[52][0] and "[SECRET]" in masked[52][0] and masked[52][1] == len(masked[52][0]) and masked[0][0] == good[0]
        kept = after
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and sorted((x["doc_id"] for x in out.collect()), key=str) == ids
    none = docs.limit(0)
    assert all(stage(spark, none, folder).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_chat_examples_hold_their_whole_context(spark):
    from pyspark.sql import functions as F

    rows = [(c, t, "assistant" if t % 2 else "user", f"turn {t} \u00e9</s>\\") for c in (1, 2, None) for t in range(6)]
    turns = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    segments = {(r.conv_id, r.position): r.segment for r in turns.collect()}
    found = {(r.conv_id, r.position): r for r in chat.examples(turns).collect()}
    assert sorted(found, key=repr) == sorted(((c, t) for c in (1, 2, None) for t in (1, 3, 5)), key=repr)
    for (c, t), r in found.items():
        assert r.context == "".join(segments[c, i] for i in range(t)) and r.reply == segments[c, t] and r.context_end == len(r.context)
    # A context that is not what stands before the reply is refused.
    other = chat.examples(turns).withColumn("context", F.when((F.col("conv_id") == 2) & (F.col("position") == 3), F.translate("context", "0", "1")).otherwise(F.col("context")))
    with pytest.raises(Exception, match="does not continue its context"):
        chat.read_back(turns, other).collect()


def test_python_workers_keep_little_between_stages(spark):
    """Batches for Python are bounded in bytes, and reused workers have forgotten the tokeniser's words."""
    rows = spark.range(0, 2000, 1, 1).selectExpr("id AS doc_id", "concat('word', id, repeat(' of a long text', 600)) AS text")
    jaccard.similar_documents(rows.limit(5)).count()

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([len(bpe.model(bpe.bpe_path()).known)])], names=["bytes", "known"])

    seen = rows.mapInArrow(sizes, "bytes long, known long").collect()
    assert len(seen) > 1 and max(r.bytes for r in seen) <= 1.1 * common.BATCH_BYTES
    bpe.digests(rows).count()
    assert {r.known for r in rows.mapInArrow(sizes, "bytes long, known long").collect()} == {0}
