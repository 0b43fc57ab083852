"""Scenario, family, bundle and order-batch operators on small tables."""

import datetime as dt
import glob
import os

import numpy as np
import pytest

from ledgerline.operators import audit, controls, families, inference, reports, scenarios
from ledgerline.sources import bundle

DAY = dt.date(2020, 1, 1)


def days(n, start=DAY):
    return [start + dt.timedelta(days=i) for i in range(n)]


def test_costs_change_the_choice(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i, d in enumerate(days(3 * 366)):
        noise = float(rng.normal(0, 0.001))
        # The dear member is better before costs only.
        rows += [("dear", d, 0.003 + noise, 0.002), ("cheap", d, 0.002 + noise, 0.0)]
        if i % 2:
            rows.append(("odd", d, -0.001, 0.0))
    ledger = spark.createDataFrame(rows, "member string, session date, gross double, cost double")
    got = {r.multiplier: r for r in scenarios.cost_sensitivity(ledger, [0.0, 1.0, 4.0], [2021, 2022], 2022).collect()}
    assert got[0.0].selected == "2021:dear,2022:dear" and got[1.0].selected == got[4.0].selected == "2021:cheap,2022:cheap"
    assert got[0.0].cost == 0 and got[1.0].cost == 0 and got[0.0].switches == 0 and got[0.0].folds == 2
    with pytest.raises(ValueError):
        scenarios.cost_sensitivity(ledger, [1.0, 1.0], [2021], 2021)
    assert scenarios.cost_sensitivity(ledger.limit(0), [1.0], [2021], 2021).collect() == []


def test_block_and_mean_of_folds_are_different(spark):
    rng = np.random.default_rng(2)
    sessions = days(3 * 366)
    returns = [float(x) for x in rng.normal(0.001, 0.01, len(sessions))]
    ledger = spark.createDataFrame([("only", d, r, 0.0) for d, r in zip(sessions, returns, strict=True)], "member string, session date, gross double, cost double")
    got = scenarios.cost_sensitivity(ledger, [1.0], [2021, 2022], 2021).first()
    late = np.array([r for d, r in zip(sessions, returns, strict=True) if d.year in (2021, 2022)])
    sharpe = lambda x: x.mean() / x.std(ddof=1) * 252**0.5
    each = [sharpe(np.array([r for d, r in zip(sessions, returns, strict=True) if d.year == y])) for y in (2021, 2022)]
    assert got.block_sharpe == pytest.approx(sharpe(late)) and got.mean_fold_sharpe == pytest.approx(np.mean(each)) and got.sessions == len(late)


def test_spliced_weights_and_gaps(spark):
    w = [(m, d, "X", 0.1 * k) for m, k in (("a", 1), ("b", 5)) for d in days(40) if not (m == "b" and d == DAY + dt.timedelta(days=25))]
    weights = spark.createDataFrame(w, "member string, session date, symbol string, weight double")
    chosen = spark.createDataFrame([(1, "a"), (2, "b")], "fold int, member string")
    cut = [DAY + dt.timedelta(days=k) for k in (0, 10, 20, 30, 400)]
    spans = spark.createDataFrame([(1, cut[1], cut[2]), (2, cut[2], cut[3]), (3, cut[3], cut[4])], "fold int, begin date, until date")
    got = scenarios.spliced_weights(weights, chosen, spans).collect()
    assert {(r.fold, r.member) for r in got} == {(1, "a"), (2, "b")} and len(got) == 19
    assert all(cut[r.fold] <= r.session < cut[r.fold + 1] for r in got)
    report = {r.fold: r for r in scenarios.splice_report(weights, chosen, spans, "a").collect()}
    assert (report[1].switched, report[1].missing, report[1].jump) == (False, 0, pytest.approx(0.0))
    assert (report[2].switched, report[2].missing, report[2].sessions, report[2].jump) == (True, 1, 10, pytest.approx(0.4))
    assert report[3].member is None and report[3].missing == report[3].sessions == 10


def test_variants_keep_their_errors(spark):
    rows = [("base", d, 0.01 if d.day % 2 else -0.005) for d in days(60)] + [("good", d, 0.01) for d in days(60)] + [("lost", DAY, -1.2), ("twice", DAY, 0.1), ("twice", DAY, 0.1), ("nan", DAY, float("nan")), ("extra", DAY, 0.1)]
    declared = spark.createDataFrame([(v,) for v in ("base", "good", "lost", "twice", "nan", "none")], "variant string")
    got = {r.variant: r for r in scenarios.compare_variants(spark.createDataFrame(rows, "variant string, session date, ret double"), declared, "base").collect()}
    assert {v: r.reason for v, r in got.items() if r.status == "ERROR"} == {"lost": "a return below -1", "twice": "a session twice", "nan": "a return that is not finite", "none": "no path", "extra": "not declared"}
    assert got["base"].cagr_change == pytest.approx(0) and got["good"].cagr_change > 0 and got["lost"].cagr is None


def test_friction_scales_costs(spark):
    ledger = spark.createDataFrame([("m", d, 0.01 if d.day % 3 else -0.01, 0.001, 0.002) for d in days(50)], "member string, session date, gross double, fixed double, impact double")
    got = {r.scenario: r for r in scenarios.friction_stress(ledger, [("as is", 1, 1), ("free", 0, 0), ("twice", 2, 2)]).collect()}
    assert got["as is"].cost == pytest.approx(0.15) and got["twice"].cost == pytest.approx(0.3) and got["free"].cost == 0
    assert got["free"].cagr_change > 0 > got["twice"].cagr_change and got["as is"].sharpe_change == pytest.approx(0)


def test_bounds(spark):
    values = spark.createDataFrame([("cap", 1.0, None), ("cap", 3.0, None), ("cap", 2.0, None), ("cap", None, None), ("floor", 0.5, True), ("floor", 0.9, False)], "bound string, value double, binding boolean")
    got = {r.bound: r for r in scenarios.bound_activity(values, {"cap": ("upper", 3.0, 0.0), "floor": ("lower", 0.1, 0.0)}).collect()}
    assert (got["cap"].observations, got["cap"].binding, got["cap"].headroom, got["cap"].median, got["cap"].activity) == (3, 1, 0.0, 2.0, "ACTIVE")
    assert (got["floor"].binding, got["floor"].share, got["floor"].headroom) == (1, 0.5, pytest.approx(0.4))
    with pytest.raises(Exception, match="no such bound"):
        scenarios.bound_activity(values, {"cap": ("upper", 3.0, 0.0)}).collect()
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(0.5, 0.5), (1.0, 2.0), (None, 9.0)], "given double, x double")
    capped = F.least(F.lit(1.0), "x")
    good, bad = (scenarios.bound_binding(rows, {"cap": (g, capped, F.col("x"))}).first() for g in (F.col("given"), F.col("given") + 0.1))
    assert (good.status, good.observations, good.binding, good.share, good.largest_effect) == ("MEASURED", 2, 1, 0.5, 1.0)
    assert (bad.status, bad.mismatches, bad.binding, bad.share) == ("NOT_ESTIMABLE", 2, None, None)


def family(spark):
    rng = np.random.default_rng(4)
    return spark.createDataFrame([(m, d, float(rng.normal(k, 0.01))) for m, k in (("base", 0.0), ("up", 0.002), ("same", 0.0)) for d in days(300)], "member string, session date, ret double")


def test_family_members(spark):
    rows = family(spark)
    other = rows.filter("member <> 'up' OR session > '2020-01-05'")
    declared = spark.createDataFrame([("base",), ("up",), ("ghost",)], "member string")
    got = {r.member: (r.status, r.sessions) for r in families.family_members(other, declared, "base").collect()}
    assert got == {"base": ("SYNCHRONISED", 300), "up": ("UNSYNCHRONISED", 295), "ghost": ("MISSING", 0), "same": ("UNDECLARED", 300)}
    # As many sessions, but others.
    moved = rows.selectExpr("member", "date_add(session, int(member = 'up')) AS session", "ret")
    assert {r.member: r.status for r in families.family_members(moved, declared, "base").collect()}["up"] == "UNSYNCHRONISED"
    assert {r.status for r in families.family_members(rows.filter("member <> 'base'"), declared, "base").collect()} == {"MISSING", "UNSYNCHRONISED", "UNDECLARED"}
    for refused in (other, moved, rows.unionByName(rows.limit(1))):
        with pytest.raises(ValueError, match="share their sessions"):
            families.family_draws(refused, "base")
    with pytest.raises(ValueError, match="share their sessions"):
        inference.bootstrap_drawdown(other)


def test_family_report_shares_its_draws(spark):
    got = families.family_report(family(spark), "base", (5, 21), 60).collect()
    assert len(got) == 2 * 2 * 4 and all(0 < r.p_value <= 1 for r in got)
    alone = families.reality_check(families.family_draws(family(spark), "base", 60, 5)).first()
    same = next(r for r in got if (r.statistic, r.block, r.procedure) == ("mean", 5, "reality check"))
    assert same.value == pytest.approx(alone.statistic) and same.p_value == pytest.approx(alone.p_value)
    p = {r.procedure: r.p_value for r in got if (r.statistic, r.block) == ("sharpe", 21)}
    assert p["superior ability, lower"] <= p["superior ability, consistent"] <= p["superior ability, upper"]


def test_straddling(spark):
    rows = [("a", d, 0.01) for d in days(20)] + [("b", d, 0.01) for d in days(5)]
    got = {(r.member, r.part): r for r in reports.straddling_episode(spark.createDataFrame(rows, "member string, session date, ret double"), "2020-01-03", "2020-01-18", "2020-01-10").collect()}
    assert [got["a", p].sessions for p in ("whole", "before", "after")] == [16, 7, 9]
    assert got["a", "before"].growth == pytest.approx(1.01**7 - 1) and got["a", "whole"].basis == "MIXED" and got["a", "after"].basis == "OUT_OF_SAMPLE"
    assert got["b", "whole"].basis == "NOT_STRADDLING" and got["b", "whole"].growth is None


def test_exposure_shares_add_up(spark):
    rng = np.random.default_rng(8)
    book = [(d, s, c, float(rng.random()), float(rng.normal(0, 0.01))) for d in days(50) for s, c in (("x", "bonds"), ("y", "bonds"), ("z", None)) if not (s == "z" and d.day == 3)]
    df = spark.createDataFrame(book, "session date, symbol string, class string, weight double, ret double")
    got = {(r["class"], r.symbol): r for r in reports.exposure_shares(df, "2020-01-05").collect()}
    assert set(got) == {("bonds", None), ("bonds", "x"), ("bonds", "y"), ("unclassified", None), ("unclassified", "z")}
    assert sum(r.risk_share for k, r in got.items() if k[1]) == pytest.approx(1) and sum(r.risk_share for k, r in got.items() if not k[1]) == pytest.approx(1)
    held, before = {}, {}
    for d, s, _, w, r in book:
        held.setdefault(d, {})[s] = before.get(s, 0.0) * r
        before[s] = w
    cut = [v for d, v in held.items() if d >= dt.date(2020, 1, 5)]
    x, total = np.array([v.get("x", 0) for v in cut]), np.array([sum(v.values()) for v in cut])
    assert got["bonds", "x"].risk_share == pytest.approx(np.cov(x, total, ddof=0)[0, 1] / total.var())


def test_continuity(spark):
    schema = "root string, session date, value double"
    old = spark.createDataFrame([(r, d, 1.0 * d.day) for r in ("same", "moved", "apart") for d in days(5)], schema)
    new = spark.createDataFrame([("same", d, 1.0 * d.day) for d in days(8)] + [("moved", DAY, 1.5), ("apart", DAY + dt.timedelta(days=99), 1.0), ("apart", DAY, None), ("new", DAY, 1.0)], schema)
    got = {r.root: (r.status, r.shared_sessions, r.largest_difference) for r in audit.continuity(old, new).collect()}
    assert got == {"same": ("PASS", 5, 0.0), "moved": ("BLOCKED", 1, 0.5), "apart": ("BLOCKED", 0, None), "new": ("BLOCKED", 0, None)}
    assert audit.continuity(old, new, 1.0).filter("root = 'moved'").first().status == "PASS"


def test_bundle_is_old_or_new_and_shows_tampering(spark, tmp_path):
    at = str(tmp_path)
    first = bundle.publish({"a": spark.range(10), "b": spark.range(3)}, at)
    assert bundle.current(spark, at) == first
    with pytest.raises(Exception):  # noqa: B017
        bundle.publish({"a": spark.range(20), "b": spark.range(1).selectExpr("raise_error('no')")}, at)
    assert bundle.current(spark, at) == first and bundle.read_table(spark, first, "a").count() == 10
    second = bundle.publish({"a": spark.range(20), "b": spark.range(3)}, at)
    assert bundle.current(spark, at) == second and bundle.read_table(spark, second, "a").count() == 20
    assert {r.status for r in bundle.verify(spark, second).collect()} == {"OK"}
    name = sorted(glob.glob(f"{second}/tables/a/part-*"))[0]
    folder, file = os.path.split(name)
    os.remove(f"{folder}/.{file}.crc")
    with open(name, "ab") as f:
        f.write(b"x")
    spark.range(1).write.mode("append").parquet(f"{second}/tables/b")
    assert {r.status for r in bundle.verify(spark, second).collect()} == {"OK", "CHANGED", "ADDED"}
    with pytest.raises(ValueError):
        bundle.publish({"a b": spark.range(1)}, at)


NOON = dt.datetime(2020, 1, 1, 12)
TERMS = [("F1", "R", 1000.0, 99.0, 101.0, 1000.0, 100.0, NOON + dt.timedelta(days=2), "X", "USD"), ("F2", "R", 1000.0, 99.0, 101.0, 1000.0, 100.0, NOON + dt.timedelta(days=90), "X", "USD")]


def assessed(spark, orders, positions, nav=1e6, terms=TERMS):
    kind = "batch string, order_id string, contract string, root string, side string, quantity long, order_type string, limit_price double, decided_at timestamp, reduce_only boolean, roll_id string"
    o = spark.createDataFrame([("b", *x) for x in orders], kind)
    b = spark.createDataFrame([("b", NOON, nav)], "batch string, as_of timestamp, nav double")
    s = spark.createDataFrame(terms, "contract string, root string, volume double, bid double, ask double, notional double, margin double, deadline timestamp, exchange string, currency string")
    p = spark.createDataFrame([("b", *x) for x in positions], "batch string, contract string, position long")
    return {r.order_id: r for r in controls.assess_batches(o, b, s, p).collect()}


def test_a_sound_roll_passes(spark):
    got = assessed(spark, [("1", "F1", "R", "SELL", 5, "MARKET", None, NOON, True, "r"), ("2", "F2", "R", "BUY", 5, "MARKETABLE_LIMIT", 102.0, NOON, False, "r")], [("F1", 5)])
    assert {r.status for r in got.values()} == {"PASS"} and got["1"].reduces and not got["2"].reduces and got["1"].gross == pytest.approx(0.005)


def test_each_block_is_named(spark):
    late = NOON - dt.timedelta(hours=1)
    got = assessed(
        spark,
        [("1", "F1", "R", "BUY", 50, "MARKETABLE_LIMIT", 100.0, late, True, "r"), ("2", "??", "R", "BUY", 1, "MARKET", None, NOON + dt.timedelta(hours=1), False, None), ("3", "F2", "Q", "SELL", 1, "MARKETABLE_LIMIT", 100.0, NOON, False, "s"), ("4", "F1", "R", "SELL", 1, "MARKET", None, NOON, False, "s")],
        [("F1", 5), ("gone", 1)],
        nav=1000.0,
    )
    said = {k: set(r.reasons.split("; ")) for k, r in got.items()}
    assert said["1"] >= {"the decision is stale", "too large a share of volume", "the buy limit is below the ask", "marked as reducing, but is not", "opens within the safety days of the deadline", "a roll has two legs", "gross notional beyond the limit", "margin beyond the limit", "the batch has several orders for one contract"}
    assert said["2"] >= {"decided in the future", "the contract is not in the snapshot", "the batch holds contracts without terms"}
    assert said["3"] >= {"another root than the contract's", "the sell limit is above the bid", "roll legs do not match"}
    twice = assessed(spark, [("1", "F2", "R", "BUY", 1, "MARKET", None, NOON, False, None)] * 2, [])
    assert "the batch repeats an order id" in twice["1"].reasons
    only = assessed(spark, [("1", "F2", "R", "BUY", 2, "MARKET", None, NOON, False, "r"), ("2", "F1", "R", "SELL", 2, "MARKET", None, NOON, False, "r")], [("F1", 5)])
    assert "a roll closes one leg and opens the other" in only["1"].reasons
    back = assessed(spark, [("1", "F2", "R", "SELL", 2, "MARKET", None, NOON, True, "r"), ("2", "F1", "R", "BUY", 2, "MARKET", None, NOON, False, "r")], [("F2", 5)])
    assert "the roll does not lead to a later contract" in back["1"].reasons


def test_orders_are_shuffled_for_positions_and_rolls_only(spark, monkeypatch):
    assess, kept = controls.assess_batches, []
    monkeypatch.setattr(controls, "assess_batches", lambda *tables: kept.append(assess(*tables)) or kept[0])
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert len(assessed(spark, [("1", "F1", "R", "SELL", 5, "MARKET", None, NOON, True, "r")], [("F1", 10)])) == 1
        assert kept[0]._jdf.queryExecution().sparkPlan().toString().count("SortMergeJoin") <= 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
