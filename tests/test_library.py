"""Operators on literal tables and truncation invariance on the given ones."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import audit, episodes, inference, panel, performance, rolling
from ledgerline.sources.views import bars
from ledgerline.streaming import events as streams

S = "/root/testdata/sf0.01"


def days(*values, symbol="A", start=dt.date(2020, 1, 1)):
    return [(symbol, start + dt.timedelta(days=i), v) for i, v in enumerate(values)]


def test_bounded_fill(spark):
    df = spark.createDataFrame(days(1.0, None, None, None, 5.0), "symbol string, session date, close double")
    got = [r["close"] for r in panel.align(df, ["close"], limit=2).orderBy("session").collect()]
    assert got == [1.0, 1.0, 1.0, None, 5.0]


def test_terciles_need_history_and_keep_nulls(spark):
    df = spark.createDataFrame(days(1.0, 2.0, 3.0, 9.0, None, 0.0), "symbol string, session date, x double")
    got = [r["state"] for r in rolling.terciles(df, "x", history=3, need=3).orderBy("session").collect()]
    assert got == [None, None, None, "High", None, None]


def test_drawdown_spell_and_recovery(spark):
    rows = [("p", d, r) for _, d, r in days(0.1, -0.2, 0.05, 0.5, -0.1)]
    got = performance.drawdown_episodes(spark.createDataFrame(rows, "member string, session date, ret double")).orderBy("start").collect()
    assert [(r["sessions"], r["recovered"]) for r in got] == [(2, True), (1, False)]
    assert got[0]["depth"] == pytest.approx(-0.2)


def test_a_total_loss_stays_and_worse_is_refused(spark):
    make = lambda *r: spark.createDataFrame([("p", d, v) for _, d, v in days(*r)], "member string, session date, ret double")
    got = performance.wealth(make(0.1, -1.0, 0.1)).orderBy("session").collect()
    assert [r["nav"] for r in got] == [pytest.approx(1.1), 0.0, 0.0] and got[2]["drawdown"] == -1.0
    figures = performance.path_metrics(make(0.1, -1.0, 0.1)).first()
    assert figures["cagr"] == -1.0 and figures["max_drawdown"] == -1.0 and figures["max_duration"] == 2
    with pytest.raises(Exception, match="below -1"):
        performance.wealth(make(0.1, -1.5)).collect()


def test_metrics_by_calendar_time_within_a_window(spark):
    rows = [("p", dt.date(2019, 12, 31) + dt.timedelta(days=73 * i), 0.1) for i in range(6)]
    got = performance.path_metrics(spark.createDataFrame(rows, "member string, session date, ret double"), start="2020-01-01").first()
    assert (got["n"], got["period_start"]) == (5, dt.date(2019, 12, 31))
    assert got["years"] == pytest.approx(365 / 365.2425) and got["cagr"] == pytest.approx(1.1 ** (5 / got["years"]) - 1)
    assert got["calmar"] is None and got["profit_factor"] is None and got["max_duration"] == 0


def test_a_path_without_variance_has_an_infinite_error(spark):
    got = inference.hac_standard_error(spark.createDataFrame([("p", d, 0.0) for _, d, _ in days(*range(30))], "member string, session date, ret double")).first()
    assert got["se"] == float("inf") and got["t"] is None


def test_cscv_refuses_what_it_cannot_estimate(spark):
    df = spark.createDataFrame([(m, d, 0.01 * (i % 5 - 2) + 0.001 * k) for k, m in enumerate("abc") for i, (_, d, _) in enumerate(days(*range(67)))], "member string, session date, ret double")
    report = lambda **k: inference.cscv_report(df, **k).first()
    assert report(blocks=7)["status"] == report(blocks=4)["status"] == report()["status"] == report(blocks=8, need_members=3)["status"] == "NOT_ESTIMABLE"
    ok = report(blocks=8, need_members=3, need_rows=8)
    assert (ok["status"], ok["rows_a_block"], ok["dropped"], ok["splits"]) == ("ESTIMATED", 8, 3, 70)


def test_bad_rows_common_sessions_and_gates(spark):
    from ledgerline.operators import allocation, regimes

    df = spark.createDataFrame(days(1.0, -1.0, float("inf")) + days(2.0, symbol="B") + days(3.0, symbol="B"), "symbol string, session date, close double")
    assert {(r["symbol"], r["reason"]) for r in panel.bad_rows(df, ["close"]).collect()} == {("A", "close is negative or not finite"), ("B", "repeated session")}
    assert {r["session"] for r in panel.common_sessions(df).collect()} == {dt.date(2020, 1, 1)}
    states = spark.createDataFrame([(True, True), (True, False), (None, True)], "bear boolean, high boolean")
    assert [r[0] for r in states.select(regimes.panic_state(F.col("bear"), F.col("high"))).collect()] == ["Panic", "No panic", None]
    rows = [(s, dt.date(2020, 1, 1) + dt.timedelta(days=i), 0.01 * (-1) ** i * (1 + (s == "B")), True, s == "A") for s in "AB" for i in range(40)]
    gated = spark.createDataFrame(rows, "symbol string, session date, ret double, member boolean, open boolean")
    got = allocation.desired_weights(gated, cap=0.9, vol_window=5, book_window=5, gate="open").filter("session = DATE '2020-02-05'").collect()
    assert {r["symbol"]: r["weight"] > 0 for r in got} == {"A": True, "B": False}


def test_illegal_order_transitions(spark):
    rows = [(1, i, e, i) for i, e in enumerate(["OUTBOX", "ACK", "FILL", "OUTBOX"])]
    got = audit.replay_orders(spark.createDataFrame(rows, "key int, event_id int, event string, ts int")).first()
    assert (got["illegal"], got["fills"], got["state"]) == (1, 1, "OUTBOX")


def test_stationary_draws_continue_blocks(spark):
    rows = inference.stationary_draws(spark, 10, 3, 50, 5, 1).orderBy("rep", "step").collect()
    runs = sum((b["position"] - a["position"]) % 10 == 1 for a, b in zip(rows, rows[1:]) if a["rep"] == b["rep"])
    assert all(0 <= r["position"] < 10 for r in rows) and runs > 90


@pytest.mark.parametrize("op", [lambda r: rolling.realized_volatility(r), lambda r: rolling.terciles(rolling.realized_volatility(r), "vol"), lambda r: rolling.compounded(r, 60, 50), lambda r: rolling.moving_average_state(r), lambda r: rolling.ewm_volatility(r)])
def test_truncation_invariance(spark, op):
    whole, cut = panel.simple_returns(bars(spark, S)), "1998-06-30"
    a = op(whole).filter(F.col("session") <= F.lit(cut).cast("date"))
    b = op(panel.truncate(whole, cut))
    columns = [F.round(c, 9) if t == "double" else F.col(c) for c, t in b.dtypes]
    assert a.select(columns).exceptAll(b.select(columns)).count() == 0


def test_episodes_open_resize_flip_close_and_stay_open(spark):
    rows = [("A", d, 10.0 + i, p) for i, (_, d, p) in enumerate(days(2.0, 3.0, -1.0, 0.0, 0.0, 4.0))]
    held = episodes.ledger(spark.createDataFrame(rows, "symbol string, session date, close double, position double"), 1.0)
    got = episodes.trade_episodes(held).orderBy("episode").collect()
    assert [(r["direction"], r["sessions"], r["resizes"], r["exit"] is None) for r in got] == [(1, 2, 1, False), (-1, 1, 0, False), (1, 0, 0, True)]
    # 2 and 3 contracts earn 1 each; the flip costs 4, three quarters of it on the old side.
    assert [(r["gross"], r["cost"]) for r in got] == [(5.0, 6.0), (-1.0, 2.0), (0.0, 4.0)]
    assert (got[0]["mfe"], got[0]["mae"]) == (0.0, -2.0)
    figures = episodes.episode_metrics(episodes.trade_episodes(held)).first()
    assert (figures["closed"], figures["open"], figures["wins"], figures["losses"]) == (2, 1, 0, 2)


def test_episodes_of_a_flat_or_empty_ledger(spark):
    kind = "symbol string, session date, close double, position double"
    for rows in ([], [("A", d, 1.0, 0.0) for _, d, _ in days(0, 0)]):
        assert episodes.trade_episodes(episodes.ledger(spark.createDataFrame(rows, kind), 1.0)).count() == 0


def test_alpha_report_finds_the_line(spark):
    rows = [("base", d, (i * 7 % 11 - 5) / 100) for i, (_, d, _) in enumerate(days(*range(60)))]
    rows += [("own", d, 0.01 + 2 * r) for _, d, r in rows]
    got = inference.alpha_report(spark.createDataFrame(rows, "member string, session date, ret double"), "base").first()
    assert (got["alpha"], got["beta"]) == (pytest.approx(0.01), pytest.approx(2.0)) and (got["se"] < 1e-9 or got["se"] == float("inf"))  # no residual at all


def test_streams_wait_for_the_watermark_and_do_not_depend_on_micro_batches(spark, tmp_path):
    kind = "key long, event_id long, event string, ts timestamp"
    at, hour = dt.datetime(2020, 1, 1), dt.timedelta(hours=1)
    # The second file holds an event that belongs before the last of the first, and one that repeats.
    parts = [[(1, 1, "OUTBOX", at), (1, 3, "FILL", at + 0.8 * hour), (2, 9, "FILL", at)], [(1, 2, "ACK", at + 0.5 * hour), (1, 3, "FILL", at + 0.8 * hour), (1, 4, "OUTBOX", at + hour), (3, 5, "OUTBOX", at + 9 * hour)]]
    found = []
    for name, files in (("two", parts), ("one", [parts[0] + parts[1]])):
        for rows in files:
            spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
        got = streams.finish(streams.illegal_transitions(source, "2 hours"), "illegal").orderBy("key").collect()
        found.append([(r["key"], r["event_id"], r["before"], r["event"]) for r in got])
    assert found[0] == found[1] == [(1, 4, "FILL", "OUTBOX"), (2, 9, None, "FILL")]
