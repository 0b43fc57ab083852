"""Work that must not grow with the square of a group."""

import random

from ledgerline.llm import jaccard


def test_documents_of_one_shared_line_make_no_pairs(spark, monkeypatch):
    made = []
    real = jaccard._rest
    monkeypatch.setattr(jaccard, "_rest", lambda *a: made.append((out := real(*a)).count()) or out)
    rng = random.Random(3)
    line = " ".join(f"common{i}" for i in range(40))
    own = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(14)) for _ in range(1500)]
    rows = [(i, f"{line} {x}") for i, x in enumerate(own)] + [(5000, f"{line} {own[7]}"), (5001, f"{line} {own[9]} more")]
    got = {r.doc_id: r.component_id for r in jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i for i in range(1500)} | {5000: 7, 5001: 9}
    assert made[0] <= 2 * len(rows)
