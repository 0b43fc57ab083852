"""File scans under a ceiling, custody, catalogues, digests, recovery, funded and scaled paths on small tables."""

import datetime as dt
import glob
import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import intake
from ledgerline.sources import files

DAY = dt.date(2020, 1, 1)


def day(i, start=DAY):
    return start + dt.timedelta(days=i)


def test_ceiling_is_in_the_scan(spark, tmp_path):
    rows = [("A", day(i, dt.date(2019, 12, 20)), float(i)) for i in range(400)]
    at = str(tmp_path / "dated")
    files.write_dated(spark.createDataFrame(rows, "symbol string, session date, close double"), at)
    last = "2020-03-01"
    cut = files.scan_dated(spark, at, last)
    want = {(s, d, c) for s, d, c in rows if d.isoformat() <= last}
    assert {tuple(r) for r in cut.select("symbol", "session", "close").collect()} == want
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "LessThanOrEqual(session" in plan
    assert files.scan_dated(spark, at).count() == 400
    # A broken file of a later year is not opened.
    for f in glob.glob(f"{at}/year=2021/*.parquet"):
        open(f, "wb").write(b"no parquet")
    assert cut.count() == len(want)


def test_allocation_inputs(spark):
    panel = spark.createDataFrame([("A", day(0), 1.0), ("A", day(1), 2.0), ("A", day(3), 4.0), ("B", day(1), 5.0), ("B", day(2), None), ("B", day(3), 7.0)], "symbol string, session date, close double")
    traded, life = intake.allocation_inputs(panel)
    assert {(r.symbol, r.session) for r in traded.collect()} == {(s, day(i)) for s in "AB" for i in (1, 3)}
    got = {(r.symbol, r.session): r.close for r in life.collect()}
    assert len(got) == 8 and got["B", day(0)] is None and got["A", day(2)] is None and got["B", day(3)] == 7.0
    assert {r.session for r in intake.allocation_inputs(panel, "2020-01-02")[0].collect()} == {day(1), day(3)}
    for part in intake.allocation_inputs(panel.limit(0)):
        assert part.collect() == []


def test_custody_finds_a_look_ahead(spark):
    rng = np.random.default_rng(4)
    rows = [(m, day(i, dt.date(2018, 1, 1)), float(rng.normal(mean, 0.01))) for i in range(4 * 365) for m, mean in (("a", 0.0), ("b", 0.001))]
    panel = spark.createDataFrame(rows, "member string, session date, ret double")
    last, years = "2020-12-31", [2019, 2020, 2021]
    cut = panel.filter(F.col("session") <= F.lit(last).cast("date"))
    clean = lambda p: intake.stitched(p, years)
    got = intake.custody_report(clean, panel, cut, last).first()
    assert (got.status, got.drift, got.missing, got.compared) == ("PASS", 0.0, 0, 731) and got.guarded_choice == got.whole_choice
    ahead = lambda p: intake.stitched(p.join(p.groupBy("member").agg(F.avg("ret").alias("m")), "member").withColumn("ret", F.col("ret") - F.col("m")).drop("m"), years)
    assert intake.custody_report(ahead, panel, cut, last).first().status == "BLOCKED"
    # The guarded panel reaches too far; nothing can be compared.
    assert intake.custody_report(clean, panel, panel, last).first().status == "BLOCKED"
    empty = intake.custody_report(clean, panel, panel.limit(0), last).first()
    assert empty.status == "BLOCKED" and empty.compared == 0


def test_fund_catalogue_reads_dates_strictly(spark):
    rows = [("A", "3/1/95"), ("B", "31/12/68"), ("C", "1/1/69"), ("D", "31/2/95"), ("E", "1995-01-03"), ("F", None), (" ", "1/1/99"), (None, "1/1/99"), ("G", "1/2/03"), ("G", "1/2/03"), ("H", " 01/02/03 ")]
    got, wrong = intake.fund_catalogue(spark.createDataFrame(rows, "symbol string, first_quoted string").withColumn("extra", F.lit(1)))
    assert {r.symbol: r.first_quoted for r in got.collect()} == {"A": dt.date(1995, 1, 3), "B": dt.date(2068, 12, 31), "C": dt.date(1969, 1, 1), "H": dt.date(2003, 2, 1)}
    assert sorted((str(r.symbol), r.reason) for r in wrong.collect()) == [("D", "no date"), ("E", "no date"), ("F", "no date"), ("G", "repeated"), ("None", "no symbol")]


def test_entries_and_year_starts(spark):
    members = spark.createDataFrame([("A", day(0), False), ("A", day(1), True), ("A", day(2), None), ("B", day(0), False)], "symbol string, session date, member boolean")
    assert {r.symbol: (r.entry, r.sessions) for r in intake.entry_sessions(members).collect()} == {"A": (day(1), 1), "B": (None, 0)}
    spans = spark.createDataFrame([(1, dt.date(1990, 6, 1), dt.date(1995, 1, 1)), (2, dt.date(1990, 1, 1), dt.date(1990, 12, 31)), (3, dt.date(1990, 1, 1), dt.date(1991, 1, 2)), (4, None, None)], "k int, start date, end date")
    got = sorted((r.k, r.boundary.year) for r in intake.year_starts(spans, 2).collect())
    assert got == [(1, 1991), (1, 1993), (3, 1991)]
    # The list of dates that the driver makes is the same.
    from ledgerline.operators.performance import calendar_boundaries

    for start, end in (("1990-06-01", "1995-01-01"), ("1990-01-01", "1991-01-02"), ("1990-01-01", "1991-01-01")):
        one = spark.createDataFrame([(dt.date.fromisoformat(start), dt.date.fromisoformat(end))], "start date, end date")
        assert [r.boundary for r in intake.year_starts(one, 1).orderBy("boundary").collect()] == calendar_boundaries(start, end)


def test_canonical_digest(spark):
    rows = [("x", f"k{i:03d}", i, None if i % 7 == 0 else "t|,\"") for i in range(300)]
    kind = "g string, k string, q long, note string"
    digest = lambda r, **how: {x.g: (x.rows, x.wrong, x.digest) for x in intake.canonical_digest(spark.createDataFrame(r, kind).repartition(3), "g", "k", ["q", "note"], **how).collect()}
    got = digest(rows)["x"]
    assert got == digest(rows[::-1])["x"] and got[:2] == (300, 0)
    parts = {}
    for _, k, q, note in rows:
        parts.setdefault(hashlib.md5(k.encode()).hexdigest()[:2], []).append((k, json.dumps({"k": k, "q": q, "note": note}, separators=(",", ":"))))
    hashed = [hashlib.sha256("\n".join(j for _, j in sorted(parts[p])).encode()).hexdigest() for p in sorted(parts)]
    assert got[2] == hashlib.sha256("\n".join(hashed).encode()).hexdigest()
    assert digest([*rows[:-1], ("x", "k299", 300, None)])["x"][2] != got[2]
    # Repeated, blank and null keys leave no digest; blanks around a key do not count.
    assert digest([*rows, ("x", "k000 ", 0, None), ("x", " ", 0, None), ("x", None, 0, None)])["x"] == (303, 3, None)
    assert digest([("x", " a ", 1, None)]) == digest([("x", "a", 1, None)]) and digest([("x", "a", 1, None)], digits=0)["x"][2]


def test_scalar_in_force(spark):
    rows = [("A", day(i), 0.5 + i / 1000, 0.0 if i < 10 else 1.0) for i in range(120)]
    table = spark.createDataFrame(rows, "symbol string, session date, scalar double, exposure double")
    got = {r.session: r.in_force for r in intake.scalar_in_force(table, "exposure", warm_up=40).collect()}
    # Exposure from the eleventh session, warm 40 later: the end of January counts as 1, that of February is the first.
    want, ends = 1.0, {30: 1.0, 59: 0.559, 90: 0.59}
    for i in range(120):
        assert got[day(i)] == pytest.approx(want), i
        want = ends.get(i, want)


def test_recovery_report(spark):
    at = lambda n: dt.datetime(2024, 1, 1, 0, n)
    kind = "book string, key string, event_id string, event string, ts timestamp, quantity long"
    good = [("p", "o1", "1", "OUTBOX", at(0), 10), ("p", "o1", "2", "ACK", at(1), 0), ("p", "o1", "3", "FILL", at(2), 4), ("p", "o2", "1", "OUTBOX", at(0), 5), ("p", "o2", "2", "REJECT", at(1), 0)]
    report = lambda rows, broker: {(r.book, r.gate): (r.observed, r.status, r.reason) for r in intake.recovery_report(spark.createDataFrame(rows, kind), spark.createDataFrame(broker, "book string, key string, open long")).collect()}
    assert report(good, [("p", "o1", 6)]) == {("p", "journal_replay"): (2, "PASS", "order states replay"), ("p", "open_orders"): (0, "PASS", "open orders agree")}
    assert report(good, [("p", "o1", 5)])["p", "open_orders"] == (1, "BLOCKED", "open orders differ")
    assert report(good, [])["p", "open_orders"] == (1, "BLOCKED", "open orders differ")
    # An order that only the broker has, and one that two books use.
    assert report(good, [("p", "o1", 6), ("p", "o9", 1)])["p", "open_orders"][0] == 1
    two = report([*good, ("q", "o1", "1", "FILL", at(0), 1)], [("p", "o1", 6), ("r", "o1", 1)])
    assert two["p", "open_orders"][1] == "PASS" and two["q", "journal_replay"] == (1, "BLOCKED", "2 faults") and two["q", "open_orders"] == (None, "BLOCKED", "journal replay failed")
    assert two["r", "journal_replay"] == (0, "BLOCKED", "no journal")
    assert report([*good, ("p", "o1", "4", "FILL", at(3), 7)], [])["p", "journal_replay"][2] == "1 faults"


def test_recovery_report_deals_orders_over_more_tasks(spark):
    from ledgerline.sources import views

    at = lambda n: dt.datetime(2024, 1, 1, 0, n)
    rows = [(f"b{i % 3}", i, str(n), kind, at(n), q) for i in range(300) for n, (kind, q) in enumerate([("OUTBOX", 9), ("ACK", 0), ("FILL", i % 12)])]
    events = spark.createDataFrame(rows, "book string, key int, event_id string, event string, ts timestamp, quantity long").repartition(3)
    broker = spark.createDataFrame([(f"b{i % 3}", i, max(9 - i % 12, 0)) for i in range(300)], "book string, key int, open long")
    whole, dealt = intake.recovery_report(events, broker), intake.recovery_report(events, broker, 7)
    assert sorted(whole.collect()) == sorted(dealt.collect()) and len(dealt.collect()) == 6
    # Events are dealt once, by the number of parts, for the replay and for what remains.
    plan = intake.recovery_report(events, broker, 7)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1 and plan.count("SortMergeJoin") == 1
    assert views.parts_for(spark, 100) is None and views.parts_for(spark, 36_000_000) == 180


def test_funded_performance_and_volatility_budget(spark):
    rng = np.random.default_rng(5)
    ret, interest = rng.normal(0.0003, 0.01, 300), np.full(300, 0.0001)
    funded = spark.createDataFrame([("p", day(i), float(r), 0.036, float(x), float(r + x)) for i, (r, x) in enumerate(zip(ret, interest))], "member string, session date, ret double, rate double, interest double, funded double")
    got = {r.basis: r for r in intake.funded_performance(funded).collect()}
    assert got["excess"].sharpe == got["funded"].sharpe == pytest.approx(ret.mean() / ret.std() * 252**0.5)
    assert got["funded"].cagr > got["excess"].cagr and got["excess"].contribution == got["excess"].rate == 0
    assert got["funded"].contribution == pytest.approx(0.03 / (299 / 365.2425)) and got["funded"].rate == pytest.approx(0.036)
    rows = [("calm", day(i), float(r) / 10, 1.0, 0.9) for i, r in enumerate(ret)] + [("wild", day(i), float(r), 0.5 if i % 4 else 1.0, 0.0 if i % 2 else 0.4) for i, r in enumerate(ret)]
    got = {r.member: r for r in intake.volatility_budget(spark.createDataFrame(rows, "member string, session date, ret double, scale double, risk_weight double")).collect()}
    assert (got["calm"].at_ceiling, got["calm"].no_risk, got["calm"].binds) == (1.0, 0.0, False) and got["calm"].over_budget < 1
    assert (got["wild"].at_ceiling, got["wild"].no_risk, got["wild"].binds) == (0.25, 0.5, True) and got["wild"].mean_cash == pytest.approx(0.8)
    assert got["wild"].realized == pytest.approx(ret.std(ddof=1) * 252**0.5)


def test_evidence_gates(spark):
    from hashlib import sha256

    from ledgerline.operators import evidence

    at, digest = lambda d: dt.datetime(2024, 1, d), lambda t: sha256(t.encode()).hexdigest()
    good = {"run": 1, "gate": "a", "artifact": "x", "digest": digest("text"), "issued": at(1), "expires": at(20), "run_digest": digest("run"), "author": "Ann", "reviewer": "Bob", "approved": True, "revoked": False}
    kind = "run long, gate string, artifact string, digest string, issued timestamp, expires timestamp, run_digest string, author string, reviewer string, approved boolean, revoked boolean"
    files = spark.createDataFrame([("x", "text"), ("x", "text"), ("y", "one"), ("y", "two"), ("z", None)], "artifact string, content string")
    runs = spark.createDataFrame([(1, digest("run").upper()), (2, None)], "run long, digest string")

    def report(*records):
        rows = [tuple(r.values()) for r in records]
        return {(r.run, r.gate): (r.records, r.reasons, r.status) for r in evidence.evidence_gates(spark.createDataFrame(rows, kind), files, runs, ["a", "b"], "2024-01-10").collect()}

    none = (0, "no record", "BLOCKED")
    assert report() == {(r, g): none for r in (1, 2) for g in "ab"}
    assert report(good, good | {"gate": "other"}, good | {"run": 9}) == {(1, "a"): (1, "", "PASS"), (1, "b"): none, (2, "a"): none, (2, "b"): none}
    assert report(good, good)[1, "a"] == (2, "several records", "BLOCKED")
    cases = {
        "digest,artifact changed": {"digest": None}, "artifact missing": {"artifact": "w"}, "artifact changed": {"digest": digest("other")}, "dates,expired": {"expires": at(1)}, "dates": {"issued": None},
        "not yet issued": {"issued": at(11)}, "expired": {"expires": at(10)}, "other run": {"run_digest": digest("else")}, "names": {"author": " "}, "own review": {"reviewer": "ANN "}, "not approved": {"approved": None}, "revoked": {"revoked": None},
    }
    keys = {"artifact missing": None}
    batch = [(reason, good | change) for reason, change in cases.items()] + [("artifact changed", good | {"artifact": "y", "digest": digest("one")}), ("artifact changed", good | {"artifact": "z"}), ("artifact missing", good | {"artifact": keys["artifact missing"]})]
    # One run a case, so that all are judged in one job.
    runs = spark.createDataFrame([(i, digest("run")) for i in range(len(batch))], "run long, digest string")
    got = report(*(r | {"run": i} for i, (_, r) in enumerate(batch)))
    assert [got[i, "a"][1] for i in range(len(batch))] == [reason for reason, _ in batch]
    runs = spark.createDataFrame([(2, None)], "run long, digest string")
    assert report(good | {"run": 2})[2, "a"] == (1, "other run", "BLOCKED")


def test_canonical_digest_shuffles_its_rows_once(spark):
    rows = spark.createDataFrame([("a", " x", 1), ("a", "y", None), ("b", "", 1), ("c", "x", 2), ("c", "x ", 1), ("d", None, 1), ("d", None, 2)], "book string, id string, n long")
    out = intake.canonical_digest(rows, "book", "id", ["n"])
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    parts = lambda *keys: hashlib.sha256("\n".join(hashlib.sha256(j.encode()).hexdigest() for _, j in sorted((hashlib.md5(k.encode()).hexdigest()[:2], j) for k, j in keys)).encode()).hexdigest()
    assert {r.book: (r.rows, r.wrong, r.digest) for r in out.collect()} == {"a": (2, 0, parts(("x", '{"id":"x","n":1}'), ("y", '{"id":"y","n":null}'))), "b": (1, 1, None), "c": (2, 1, None), "d": (2, 2, None)}
