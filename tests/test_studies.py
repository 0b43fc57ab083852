"""Operators that SQL cannot express, or only by another road, against brute force on literal tables."""

import datetime as dt
import itertools
import math
from statistics import NormalDist

import numpy as np
import pytest

from ledgerline.operators import allocation, controls, families, regimes
from ledgerline.sources import files

DAY = dt.date(2020, 1, 1)


def day(i):
    return DAY + dt.timedelta(days=i)


@pytest.mark.parametrize("raw", [[5.0, 3.0, 1.0, 1.0], [9.0, 0.5, 0.3, 0.2], [1.0, 1.0, 1.0, 1.0], [2.0, 1.0, 0.0, 0.0]])
def test_capped_shares(spark, raw):
    """A share is at the cap or in one proportion to its size, capped sizes are the largest, and nothing is left unless all are at the cap."""
    df = spark.createDataFrame([(f"s{i}", DAY, r) for i, r in enumerate(raw)], "symbol string, session date, raw double")
    got = [r["budget"] for r in allocation.cap_and_normalise(df, "raw", 0.4).orderBy("symbol").collect()]
    live = [i for i, r in enumerate(raw) if r > 0]
    free = [i for i in live if got[i] < 0.4 - 1e-12]
    assert all(got[i] == 0 for i in range(len(raw)) if i not in live) and max(got) <= 0.4 + 1e-12
    assert sum(got) == pytest.approx(1.0 if free else min(1.0, 0.4 * len(live)))
    levels = [got[i] / raw[i] for i in free]
    assert levels == pytest.approx(levels[:1] * len(levels))
    assert all(levels[0] * raw[i] >= 0.4 - 1e-12 for i in live if i not in free and levels)


def test_trade_bounds(spark):
    rows = [("A", day(i), v) for i, v in enumerate([40.0, 20.0, None, 99.0, float("nan"), 35.0])]
    got = allocation.trade_bounds(spark.createDataFrame(rows, "symbol string, session date, volume double"), 0.1, window=2).orderBy("session").collect()
    # Medians of two rows, missing volumes as 0: 30, 10, 49.5, 49.5.
    assert [r["session_bound"] for r in got] == [4, 2, 0, 9, 0, 3]
    assert [r["rebalance_bound"] for r in got] == [None, None, 3, 1, 4, 4]
    assert [r["bound"] for r in got] == [None, None, 0, 1, 0, 3]


def test_capped_shares_of_nothing(spark):
    df = spark.createDataFrame([("a", DAY, None), ("b", DAY, -1.0), ("c", DAY, float("nan"))], "symbol string, session date, raw double")
    assert [r["budget"] for r in allocation.cap_and_normalise(df, "raw", 0.4).collect()] == [0.0] * 3


def anomalies(labels, short=5):
    """Repairs the first brief run between two runs of one label until there is none."""
    cleaned, found = list(labels), set()
    while True:
        runs = [list(g) for _, g in itertools.groupby(range(len(cleaned)), key=lambda i: cleaned[i])]
        for a, b, c in zip(runs, runs[1:], runs[2:]):
            if len(b) <= short and cleaned[a[-1]] == cleaned[c[0]]:
                found.add(b[0])
                for i in b:
                    cleaned[i] = cleaned[a[-1]]
                break
        else:
            break
    for i in range(1, len(cleaned)):
        if cleaned[i] != cleaned[i - 1] and cleaned[i] < max(cleaned[:i]):
            found.add(i)
    return found


def test_roll_anomalies(spark):
    rng = np.random.default_rng(3)
    rows, want = [], set()
    for s in range(12):
        labels = np.repeat(rng.integers(1, 4, 12), rng.integers(1, 9, 12)).tolist()
        rows += [(f"s{s}", day(i), int(v)) for i, v in enumerate(labels)]
        want |= {(f"s{s}", day(i)) for i in anomalies(labels)}
    got = controls.roll_anomalies(spark.createDataFrame(rows, "symbol string, session date, delivery int")).collect()
    assert {(r["symbol"], r["session"]) for r in got} == want and want


def test_filtered_states_equal_the_sum_over_all_state_paths(spark):
    y, means, variances = [0.1, -0.4, 1.2, 0.9], [0.0, 1.0], [0.5, 0.2]
    moves, start = [[0.8, 0.2], [0.3, 0.7]], [0.6, 0.4]
    fit = spark.createDataFrame([("a", "ESTIMATED", 4, means, variances, moves, start, 0.0, 1)], regimes.FIT)
    rows = spark.createDataFrame([("a", day(i), v) for i, v in enumerate(y)], "series string, session date, value double")
    got = [r["probabilities"] for r in regimes.filtered_states(rows, fit).orderBy("session").collect()]
    for t in range(len(y)):
        mass = [0.0, 0.0]
        for path in itertools.product((0, 1), repeat=t + 1):
            p = start[path[0]] * math.prod(moves[a][b] for a, b in zip(path, path[1:]))
            mass[path[-1]] += p * math.prod(NormalDist(means[s], variances[s] ** 0.5).pdf(v) for s, v in zip(path, y))
        assert got[t] == pytest.approx([m / sum(mass) for m in mass])


def test_switching_fit_finds_two_regimes_and_refuses_short_series(spark):
    rng = np.random.default_rng(1)
    calm, wild = rng.normal(0.0, 0.5, 200), rng.normal(3.0, 1.0, 100)
    rows = [("long", day(i), float(v)) for i, v in enumerate(np.concatenate([calm, wild]))] + [("short", day(i), 1.0 * i) for i in range(9)]
    got = {r["series"]: r for r in regimes.fit_switching(spark.createDataFrame(rows, "series string, session date, value double"), restarts=4, iterations=100).collect()}
    assert got["short"]["status"] == "NOT_ESTIMABLE"
    assert got["long"]["means"] == pytest.approx([calm.mean(), wild.mean()], abs=0.05)
    assert got["long"]["transition"][0][0] > 0.98


def test_absorption_ratio(spark):
    x = np.random.default_rng(2).normal(size=(30, 4))
    rows = [(f"s{j}", day(i), float(x[i, j])) for i in range(30) for j in range(4)]
    got = [r["ratio"] for r in regimes.absorption_ratio(spark.createDataFrame(rows, "symbol string, session date, ret double"), window=20, components=2, lag=1).orderBy("session").collect()]
    for i in range(20, 30):
        values = np.linalg.eigvalsh(np.cov(x[i - 20 : i], rowvar=False))
        assert got[i] == pytest.approx(values[-2:].sum() / values.sum())
    assert got[:20] == [None] * 20


def test_family_tests_equal_their_formulas(spark):
    rng = np.random.default_rng(5)
    observed, n = {"a": 0.3, "b": -0.9, "c": 0.1}, 100
    draws = {m: o + rng.normal(0, 0.2, 60) for m, o in observed.items()}
    rows = [(r, m, n, observed[m], float(draws[m][r])) for m in observed for r in range(60)]
    df = spark.createDataFrame(rows, "rep long, member string, n long, observed double, draw double")
    o, d = np.array(list(observed.values())), np.column_stack(list(draws.values()))
    real = families.reality_check(df).first()
    assert real["p_value"] == pytest.approx((1 + ((d - o).max(axis=1) * 10 >= 10 * o.max()).sum()) / 61)
    omega = np.sqrt(((d - o) ** 2 * n).mean(axis=0))
    t = max(0.0, (10 * o / omega).max())
    spa = families.superior_ability(df).first()
    centres = {"p_upper": o, "p_consistent": np.where(10 * o / omega >= -math.sqrt(2 * math.log(math.log(n))), o, 0), "p_lower": np.maximum(o, 0)}
    for name, c in centres.items():
        most = np.maximum(((d - c) * 10 / omega).max(axis=1), 0)
        assert spa[name] == pytest.approx((1 + (most >= t).sum()) / 61)
    assert spa["statistic"] == pytest.approx(t)


def test_deflated_sharpe(spark):
    rows = [("a", 0.1, 10, 0.01, 500, -0.5, 2.0), ("b", 0.1, None, None, 500, 0.0, 0.0)]
    got = {r["m"]: r for r in families.deflated_sharpe(spark.createDataFrame(rows, "m string, sharpe double, trials int, trial_variance double, sessions int, skew double, excess_kurtosis double")).collect()}
    normal, e = NormalDist(), 0.5772156649015329
    best = 0.1 * ((1 - e) * normal.inv_cdf(0.9) + e * normal.inv_cdf(1 - 1 / (10 * math.e)))
    assert got["a"]["deflated"] == pytest.approx(normal.cdf((0.1 - best) * math.sqrt(499) / math.sqrt(1 + 0.05 + 0.01)))
    assert got["b"]["status"] == "NOT_ESTIMABLE"


def test_scan_reports_what_it_cannot_read(spark, tmp_path):
    folder = tmp_path / "symbol=A"
    folder.mkdir()
    (folder / "a.csv").write_text("session,close,volume\n2020-01-01,1.5,10\n2020-01-01,x,-1\nnever,2,3\n")
    panel, wrong = files.scan_panel(spark, str(tmp_path), {"session": "date", "close": "double", "volume": "double"})
    assert panel.count() == 2
    assert {(r["field"], r["reason"]) for r in wrong.collect()} == {("session", "repeated"), ("close", "not a finite number"), ("volume", "negative"), ("session", "no date")}


def test_superior_ability_of_two_sessions_has_no_p_value(spark):
    rows = [(r, m, 2, 0.1, 0.1 * r) for m in "ab" for r in range(5)]
    got = families.superior_ability(spark.createDataFrame(rows, "rep long, member string, n long, observed double, draw double")).first()
    assert got["p_upper"] is None and got["p_consistent"] is None and got["statistic"] is not None


def test_exact_quantiles_of_large_and_small_groups(spark):
    rng = np.random.default_rng(7)
    large, small = rng.normal(size=4000).round(2), rng.normal(size=9)
    rows = [("large", float(v)) for v in large] + [("small", float(v)) for v in small] + [("one", 3.0), ("one", None)]
    from ledgerline.operators import audit

    df = spark.createDataFrame(rows, "g string, v double")
    for accuracy in (100, 10_000):  # below and above the size of the large group
        got = {r["g"]: (r["a"], r["b"], r["c"]) for r in audit.exact_quantiles(df, "g", "v", {"a": 0.05, "b": 0.5, "c": 0.95}, accuracy).collect()}
        for name, values in (("large", large), ("small", small), ("one", [3.0])):
            assert got[name] == pytest.approx(np.quantile(values, [0.05, 0.5, 0.95]).tolist())


def test_spanning_regression_equals_least_squares(spark):
    from ledgerline.operators import inference

    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 2))
    y = 0.3 + x @ [1.5, -0.5] + rng.normal(size=200)
    rows = [(m, day(i), float(v)) for m, column in (("y", y), ("a", x[:, 0]), ("b", x[:, 1])) for i, v in enumerate(column)]
    got = {r["term"]: r for r in inference.spanning_regression(spark.createDataFrame(rows, "member string, session date, ret double"), "y", lags=3).collect()}
    design = np.column_stack([np.ones(200), x])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    error = y - design @ beta
    score = design * error[:, None]
    meat = score.T @ score + sum((1 - k / 4) * (score[k:].T @ score[:-k] + score[:-k].T @ score[k:]) for k in (1, 2, 3))
    bread = np.linalg.inv(design.T @ design)
    want = np.sqrt(np.diag(bread @ meat @ bread))
    for i, term in enumerate(("intercept", "a", "b")):
        assert got[term]["coefficient"] == pytest.approx(beta[i]) and got[term]["se"] == pytest.approx(want[i], rel=1e-6)
    assert got["a"]["condition"] == pytest.approx(np.linalg.cond(design)) and got["a"]["r2"] == pytest.approx(1 - error.var() / y.var())


def test_snapshot_gates_and_validation(spark):
    from ledgerline.operators import evidence

    at = dt.datetime(2024, 3, 1, 12, tzinfo=dt.timezone.utc)
    d = at.date()
    row = dict(contract=" ES-1", root="ES", exchange="cme", currency="usd", seen=at, session=d, bid=-2.0, ask=-1.0, settlement=-1.5, volume=1.0, open_interest=0.0, point_value=50.0, tick_size=0.25, margin=1.0, fee=0.0, delivery="physical", expiry=d + dt.timedelta(9), notice=d + dt.timedelta(8), last_trade=d + dt.timedelta(7), cutoff=at + dt.timedelta(5), spec_from=at - dt.timedelta(1), spec_to=at + dt.timedelta(99))
    kind = ", ".join(f"{c} {'string' if c in ('contract', 'root', 'exchange', 'currency', 'delivery') else 'timestamp' if c in ('seen', 'cutoff', 'spec_from', 'spec_to') else 'date' if c in ('session', 'expiry', 'notice', 'last_trade') else 'double'}" for c in evidence.SNAPSHOT)
    make = lambda *rows: spark.createDataFrame([tuple(r[c] for c in evidence.SNAPSHOT) for r in rows], kind)
    now = "2024-03-01 12:02:00"
    assert evidence.validated_snapshot(make(row), now).select("contract", "exchange", "delivery").first() == ("ES-1", "CME", "PHYSICAL")
    broken = {"fresh": {"seen": at - dt.timedelta(minutes=9)}, "identifiers": {"root": "ES-1"}, "market_values": {"ask": float("nan")}, "expiry": {"last_trade": d + dt.timedelta(10)}, "delivery": {"cutoff": at + dt.timedelta(8)}, "effective": {"spec_to": at}, "session": {"session": d - dt.timedelta(3)}, "venue_currency": {"currency": None}}
    for gate, change in broken.items():
        failed = {r["gate"] for r in evidence.snapshot_gates(make({**row, **change}), now).filter("status = 'BLOCKED'").collect()}
        assert gate in failed, gate
        with pytest.raises(ValueError, match=gate):
            evidence.validated_snapshot(make({**row, **change}), now)
    assert {r["gate"]: r["status"] for r in evidence.snapshot_gates(make(), now).collect()}["available"] == "BLOCKED"
    assert evidence.snapshot_gates(make(row).drop("fee"), now).first()["gate"] == "columns"


def test_identity_checks_catch_each_break(spark):
    from ledgerline.operators import episodes, ledgers

    rows = [("A", day(i), 10.0 + i, 100.0, p) for i, p in enumerate([1.0, 2.0, -1.0, 0.0])]
    held = episodes.ledger(spark.createDataFrame(rows, "symbol string, session date, close double, volume double, position double"), 0.0).drop("cost")
    from pyspark.sql import functions as F

    held = held.withColumn("before", F.coalesce(F.lag("position").over(allocation.by_symbol()), F.lit(0.0))).withColumn("roll", F.col("session") == F.lit(day(1))).withColumn("tradeable", F.col("session") != F.lit(day(1)))
    markets = ledgers.execution_costs(ledgers.roll_turnover(held))
    assert [r["roll_turnover"] for r in markets.orderBy("session").collect()] == [0.0, 0.0, 4.0, 0.0]
    daily = ledgers.portfolio(markets, 1000.0, 5.0)
    spells = episodes.trade_episodes(markets.select("symbol", "session", "position", "gross", "cost"))
    status = lambda d, m=markets: {r["check"]: r["status"] for r in ledgers.identity_checks(m, d, spells).collect()}
    assert set(status(daily).values()) == {"PASS"}
    for column, check in (("gross", "market_gross_to_portfolio"), ("net", "net_result"), ("nav", "nav_recursion"), ("ret", "net_return"), ("fixed", "fixed_and_impact_to_cost")):
        assert status(daily.withColumn(column, F.col(column) + 1))[check] == "BLOCKED"
    assert status(daily, markets.withColumn("trade", F.col("trade") + 1))["positions_to_trades"] == "BLOCKED"


def test_collateral_checks_pass_and_catch(spark):
    from pyspark.sql import functions as F

    from ledgerline.operators import controls, reports

    paths = spark.createDataFrame([("p", day(i), 0.01 * (-1) ** i) for i in range(10)], "member string, session date, ret double")
    rates = spark.createDataFrame([(day(i), 0.05) for i in range(0, 9, 2)], "session date, rate double")
    funded, stressed = (controls.funded_paths(paths, rates, spread=s) for s in (0.002, 0.012))
    status = lambda f, s=stressed: {r["check"]: r["status"] for r in reports.collateral_checks(f, s, 0.002, 360, 5).collect()}
    assert set(status(funded).values()) == {"PASS"}
    assert status(funded.withColumn("interest", F.col("interest") * 2))["accrual"] == "BLOCKED"
    assert status(funded.withColumn("days", F.col("days") + 1))["days_complete"] == "BLOCKED"
    assert status(stressed, funded)["spread_monotone"] == "BLOCKED"


def test_manifest_and_fields(spark, tmp_path):
    import hashlib

    folder = tmp_path / "symbol=A"
    folder.mkdir()
    text = "session,close,delivery\n2020-01-01,1.5,202003\n2020-01-03,2.5,\n"
    (folder / "a.csv").write_text(text)
    kinds = {"session": "date", "close": "double", "delivery": "int"}
    days = spark.createDataFrame([(day(i),) for i in range(5)], "session date")
    assert [r["close"] for r in files.scan_field(spark, str(tmp_path), kinds, "close", days, 1).orderBy("session").collect()] == [1.5, 1.5, 2.5, 2.5, None]
    assert [r["delivery"] for r in files.scan_field(spark, str(tmp_path), kinds, "delivery").collect()] == [202003]
    got = files.manifest(spark, str(tmp_path)).first()
    assert (got["bytes"], got["sha256"]) == (len(text), hashlib.sha256(text.encode()).hexdigest())


def test_exact_quantiles_leave_rows_where_they_are(spark):
    """No group's rows meet in one task, also where Spark broadcasts nothing by itself."""
    from ledgerline.operators import audit

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(0, 500, 1, 4).selectExpr("id % 2 AS g", "CAST(id AS DOUBLE) AS v")
        out = audit.exact_quantiles(df, "g", "v", {"half": 0.5}, 50)
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert {r.g: r.half for r in out.collect()} == {0: 249.0, 1: 250.0}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
