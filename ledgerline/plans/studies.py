"""Queries of signals, allocation, regimes, controls, families, stateful streams and files, with their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.columns import millis
from ledgerline.operators import allocation, controls, families, performance, regimes, rolling, signals
from ledgerline.operators.panel import align, by_symbol, month_end_rows
from ledgerline.plans.catalogue import draws_sql, LEDGER, MONTHS, P, TRADES, WEALTH, W, _r, query, trades
from ledgerline.sources.files import fingerprint, scan_panel, scratch, write_panel
from ledgerline.sources.views import BARS, PATHS, bars, paths, read
from ledgerline.streaming import events as streams
from ledgerline.streaming import folds


def ewm_sql(name: str, source: str, x: str, alpha: float, need: int = 1, adjust: bool = False) -> str:
    """CTE ``name`` (symbol, session, mean, sd): exponentially weighted moments of x as scaled running sums."""
    q = f"{1 - alpha!r}::DOUBLE"
    first = "1.0::DOUBLE" if adjust else f"CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE {alpha!r}::DOUBLE END"
    total = f"((1 - pow({q}, i + 1)) / (1 - {q}))" if adjust else "1.0::DOUBLE"
    squares = f"((1 - pow({q}, 2 * (i + 1))) / (1 - {q} * {q}) / pow({total}, 2))" if adjust else f"(pow({alpha!r}::DOUBLE, 2) * (1 - pow({q}, 2 * i)) / (1 - {q} * {q}) + pow({q}, 2 * i))"
    return f"""{name}0 AS (SELECT symbol, session, {x} AS x, row_number() {W}) - 1 AS i FROM {source} WHERE {x} IS NOT NULL),
{name}1 AS (SELECT symbol, session, i, pow({q}, i) * sum({first} * x * pow({q}, -i)) {W}) / {total} AS m, pow({q}, i) * sum({first} * x * x * pow({q}, -i)) {W}) / {total} AS s FROM {name}0),
{name} AS (SELECT symbol, session, CASE WHEN i + 1 >= {need} THEN m END AS mean, CASE WHEN i + 1 >= {max(need, 2)} THEN sqrt(greatest(s - m * m, 0) / (1 - {squares})) END AS sd FROM {name}1)"""


def clip(x: str, low: float, high: float) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN greatest({low}::DOUBLE, least({high}::DOUBLE, {x})) END"


def over(value: str, of: str, n: int) -> str:
    """The value over the last n rows, null until they hold n values."""
    return f"CASE WHEN count({of}) {W} ROWS {n - 1} PRECEDING) >= {n} THEN {value} {W} ROWS {n - 1} PRECEDING) END"


CHANGES = f"{BARS}, ch AS (SELECT *, (high + low) / 2 AS mid, close - lag(close) {W}) AS change, sign(close - lag(close, 252) {W})) AS trend FROM bars)"


def with_trend(spark, sf_dir) -> DataFrame:
    b = bars(spark, sf_dir).withColumn("mid", (F.col("high") + F.col("low")) / 2)
    return b.withColumn("forecast", F.signum(F.col("close") - F.lag("close", 252).over(by_symbol())))


@query(f"""WITH {CHANGES}, {ewm_sql('ev', 'ch', 'change', signals.span(60), 60)},
g AS (SELECT ch.symbol, ch.session, trend, mid - lag(mid) OVER (PARTITION BY ch.symbol ORDER BY ch.session) - change AS gap, sd FROM ch LEFT JOIN ev ON ev.symbol = ch.symbol AND ev.session = ch.session),
r AS (SELECT *, -({over('sum(gap)', 'gap', 252)}) AS roll FROM g), b AS (SELECT symbol, session, trend, (roll - lag(roll, 252) {W})) / (nullif(sd, 0) * sqrt(252::DOUBLE)) AS raw FROM r),
n AS (SELECT *, raw / nullif({over('stddev_samp(raw)', 'raw', 252)}, 0) AS z FROM b), s AS (SELECT symbol, session, trend, ({clip('z', -2, 2)}) / 2 AS basis FROM n),
f AS (SELECT symbol, session, basis, {clip('trend * 0.5 + coalesce(basis, trend) * 0.5', -1, 1)} AS blended FROM s) SELECT symbol, session, {_r('basis', 'blended')} FROM f""")
def basis_momentum(spark, sf_dir):
    out = signals.basis_momentum(with_trend(spark, sf_dir).withColumnRenamed("mid", "raw"))
    return out.select("symbol", "session", "basis", signals.blend_signals(F.col("forecast"), F.col("basis")).alias("blended"))


@query(f"""WITH {CHANGES}, {ewm_sql('fa', 'ch', 'change', signals.span(20), 20)}, {ewm_sql('sl', 'ch', 'change', signals.span(120), 120)},
s AS (SELECT ch.symbol, ch.session, (fa.sd / nullif(sl.sd, 0) - 1.35) / 0.65 AS p FROM ch LEFT JOIN fa ON fa.symbol = ch.symbol AND fa.session = ch.session LEFT JOIN sl ON sl.symbol = ch.symbol AND sl.session = ch.session),
t AS (SELECT symbol, session, 1 - ({clip('p', 0, 1)}) * 0.25 AS shock FROM s) SELECT symbol, session, {_r('shock')} FROM t""")
def shock_multiplier(spark, sf_dir):
    return signals.shock_multiplier(bars(spark, sf_dir)).select("symbol", "session", "shock")


@query(f"""WITH {CHANGES}, {ewm_sql('ev', 'ch', 'change', signals.span(60), 60)}, v AS (SELECT ch.symbol, ch.session, close, mid, trend, nullif(sd, 0) AS sd FROM ch LEFT JOIN ev ON ev.symbol = ch.symbol AND ev.session = ch.session),
h AS (SELECT *, lag(trend, 2) {W}) / lag(sd, 2) {W}) * (mid - lag(close) {W})) + lag(trend) {W}) / lag(sd) {W}) * (close - mid) AS res FROM v), w AS (SELECT *, sqrt({over('avg(res * res)', 'res', 63)}) AS own FROM h),
m AS (SELECT symbol, session, {clip('trend * CASE WHEN own > 0 THEN least(2.0::DOUBLE, 1 / own) END', -1, 1)} AS managed FROM w) SELECT symbol, session, {_r('managed')} FROM m""")
def managed_forecast(spark, sf_dir):
    return signals.risk_managed_forecast(with_trend(spark, sf_dir).withColumnRenamed("mid", "open")).select("symbol", "session", "managed")


SCALES = ((8, 24), (16, 48), (32, 96))
_MEANS = sorted({n for pair in SCALES for n in pair})


@query(f"""WITH {BARS}, {", ".join(ewm_sql(f"m{n}", "bars", "close", 1.0 / n) for n in _MEANS)},
j AS (SELECT bars.symbol, bars.session, close, {", ".join(f"m{n}.mean AS a{n}" for n in _MEANS)} FROM bars {" ".join(f"JOIN m{n} ON m{n}.symbol = bars.symbol AND m{n}.session = bars.session" for n in _MEANS)}),
q AS (SELECT *, {", ".join(f"(a{a} - a{b}) / nullif({over('stddev_samp(close)', 'close', 63)}, 0) AS q{a}" for a, b in SCALES)} FROM j),
y AS (SELECT *, {", ".join(f"q{a} / nullif({over(f'stddev_samp(q{a})', f'q{a}', 252)}, 0) AS y{a}" for a, _ in SCALES)} FROM q),
s AS (SELECT symbol, session, CASE WHEN count(close) {W} ROWS 349 PRECEDING) >= 350 THEN ({" + ".join(f"y{a} * exp(-y{a} * y{a} / 4) / 0.89" for a, _ in SCALES)}) / 3 END AS macd FROM y) SELECT symbol, session, {_r('macd')} FROM s""")
def macd_signal(spark, sf_dir):
    return signals.macd_signal(bars(spark, sf_dir), SCALES).select("symbol", "session", "macd")


@query(f"""WITH {CHANGES}, {ewm_sql('ev', 'ch', 'change', signals.span(60), 60)}, v AS (SELECT ch.symbol, ch.session, trend, sd * 50 * sqrt(252::DOUBLE) AS dollars FROM ch LEFT JOIN ev ON ev.symbol = ch.symbol AND ev.session = ch.session),
t AS (SELECT *, coalesce(trend IS NOT NULL AND dollars > 0, false) AS live FROM v), p AS (SELECT symbol, session, CASE WHEN live THEN trend * 0.07 * 1e6 * sqrt(1.0::DOUBLE / nullif(sum(live::INT) OVER (PARTITION BY session), 0)) / dollars END AS position FROM t) SELECT symbol, session, {_r('position')} FROM p""")
def target_positions(spark, sf_dir):
    return signals.target_positions(with_trend(spark, sf_dir).withColumn("point_value", F.lit(50.0)), target=0.07e6).select("symbol", "session", "position")


@query(f"""WITH {PATHS}, named AS (SELECT member AS symbol, session, ret FROM paths), {ewm_sql('ev', 'named', 'ret', 1 - 0.94, 20, adjust=True)},
s AS (SELECT symbol, session, coalesce({clip('0.07 / nullif(sd * sqrt(252::DOUBLE), 0)', 0.25, 2)}, 1.0::DOUBLE) AS scalar FROM ev) SELECT symbol, session, {_r('scalar')} FROM s""")
def portfolio_scalar(spark, sf_dir):
    return signals.portfolio_scalar(paths(spark, sf_dir).withColumnRenamed("member", "symbol")).select("symbol", "session", "scalar")


@query(f"""WITH {CHANGES}, {ewm_sql('ev', 'ch', 'change', signals.span(60), 60)}, t AS (SELECT symbol, quantile_cont(5.0::DOUBLE / nullif(sd * 50, 0), 0.5) AS typical FROM ev GROUP BY symbol),
w AS (SELECT symbol, typical, {clip('coalesce(typical * 0.25 / (SELECT avg(typical) FROM t), 0.25)', 0.05, 0.6)} AS width FROM t) SELECT symbol, {_r('typical', 'width')} FROM w""")
def buffer_widths(spark, sf_dir):
    return signals.buffer_widths(bars(spark, sf_dir).withColumn("point_value", F.lit(50.0)).withColumn("one_way_cost", F.lit(2.5)))


@query(f"""WITH RECURSIVE {MONTHS}, d AS (SELECT symbol, session, coalesce(round(close - lag(close) {W}), 6), 0) AS target, row_number() {W}) AS i FROM ends),
h AS (SELECT symbol, session, i, CASE WHEN abs(target) > 0.25 * abs(target) THEN target ELSE 0.0::DOUBLE END AS held FROM d WHERE i = 1
  UNION ALL SELECT d.symbol, d.session, d.i, CASE WHEN abs(target - held) > 0.25 * greatest(abs(target), abs(held)) THEN target ELSE held END FROM h JOIN d ON d.symbol = h.symbol AND d.i = h.i + 1) SELECT symbol, session, {_r('held')} FROM h""")
def no_trade_buffer(spark, sf_dir):
    ends = month_end_rows(bars(spark, sf_dir).select("symbol", "session", "close"))
    return signals.no_trade_buffer(ends.withColumn("target", F.round(F.col("close") - F.lag("close").over(by_symbol()), 6))).select("symbol", "session", "held")


# Allocation ------------------------------------------------------------------


def fill_sql(source: str, raw: str, cap: float) -> str:
    """CTE ``fill`` (columns of source, budget): shares in proportion to raw, none above the cap, as the optimum they are.

    In falling order a symbol is capped if, with all before it at the cap, its
    share of what is left is above the cap; the others share what the capped
    ones leave.
    """
    size, by = f"coalesce(greatest({raw}, 0), 0)::DOUBLE", "PARTITION BY session"
    return f"""ranked AS (SELECT *, {size} AS size, row_number() OVER ({by} ORDER BY {size} DESC, symbol) AS place FROM {source}),
prefix AS (SELECT *, sum(size) OVER ({by} ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_over FROM ranked),
marked AS (SELECT *, size > 0 AND size * (1 - (place - 1) * {cap}::DOUBLE) > {cap}::DOUBLE * left_over AS capped FROM prefix),
shared AS (SELECT *, 1 - {cap}::DOUBLE * count(*) FILTER (capped) OVER ({by}) AS free, sum(size) FILTER (NOT capped) OVER ({by}) AS rest FROM marked),
fill AS (SELECT * EXCLUDE (size, place, left_over, capped, free, rest), CASE WHEN capped THEN {cap}::DOUBLE ELSE coalesce(greatest(free, 0) * size / nullif(rest, 0), 0) END AS budget FROM shared)"""


@query(f"""WITH {BARS}, {fill_sql('bars', 'turnover', 0.3)} SELECT symbol, session, {_r('budget')} FROM fill""")
def capped_budgets(spark, sf_dir):
    return allocation.cap_and_normalise(bars(spark, sf_dir), "turnover", 0.3).select("symbol", "session", "budget")


@query(f"""WITH {BARS}, m AS (SELECT symbol, session, coalesce(({over('quantile_cont(turnover, 0.5)', '1', 63)}) >= 100000 AND count(turnover) {W}) >= 315, false) AS member FROM bars) SELECT symbol, session, coalesce(lag(member) {W}), false) AS member FROM m""")
def membership(spark, sf_dir):
    return allocation.membership(bars(spark, sf_dir), floor=100000.0).select("symbol", "session", "member")


@query(f"""WITH {BARS}, m AS (SELECT symbol, session, {over('quantile_cont(turnover, 0.5)', '1', 63)} AS m FROM bars), c AS (SELECT symbol, session, lag(m) {W}) AS median, lag(m) {W}) * 0.02 AS capacity FROM m) SELECT symbol, session, {_r('median', 'capacity')} FROM c""")
def capacity(spark, sf_dir):
    return allocation.capacity(bars(spark, sf_dir)).select("symbol", "session", "median", "capacity")


@query(f"""WITH {BARS}, v AS (SELECT symbol, session, CASE WHEN volume::BIGINT % 7 <> 0 THEN volume END AS volume FROM bars), f AS (SELECT *, coalesce(volume, 0) AS filled FROM v), m AS (SELECT *, {over('quantile_cont(filled, 0.5)', '1', 60)} AS m FROM f),
b AS (SELECT symbol, session, floor(lag(m) {W}) * 0.125) AS rebalance_bound, floor(coalesce(volume, 0) * 0.125) AS session_bound FROM m)
SELECT symbol, session, {_r('rebalance_bound', 'session_bound')}, round(CASE WHEN rebalance_bound IS NOT NULL THEN least(rebalance_bound, session_bound) END, 6) AS bound FROM b""")
def trade_bounds(spark, sf_dir):
    # Sessions without a volume are needed too: one in seven is taken as missing.
    rows = bars(spark, sf_dir).withColumn("volume", F.when(F.col("volume").cast("long") % 7 != 0, F.col("volume")))
    return allocation.trade_bounds(rows, 0.125).select("symbol", "session", "rebalance_bound", "session_bound", "bound")


@query(f"""WITH {PATHS}, p AS (SELECT member AS symbol, session, ret, row_number() {W.replace('symbol', 'member')}) > 200 AS member FROM paths), g AS (SELECT *, round({over('sum(ret)', 'ret', 63)}, 9) > 0 AS up, {over('stddev_pop(ret)', 'ret', 63)} * sqrt(252::DOUBLE) AS v FROM p),
l AS (SELECT *, lag(v) {W}) AS vol FROM g), r AS (SELECT *, CASE WHEN member AND vol IS NOT NULL THEN 1 / greatest(vol, 0.01::DOUBLE) ELSE 0.0::DOUBLE END AS raw FROM l), {fill_sql('r', 'raw', 0.25)},
b AS (SELECT symbol, session, ret, CASE WHEN coalesce(up, false) THEN budget ELSE 0.0::DOUBLE END AS budget FROM fill), k AS (SELECT *, coalesce(lag(budget) {W}), 0) AS held FROM b),
book AS (SELECT 'book' AS symbol, session, sum(held * ret) AS ret FROM k GROUP BY session), bf AS (SELECT symbol, session, CASE WHEN row_number() {W}) > 1 THEN ret END AS ret FROM book), bv AS (SELECT symbol, session, sqrt({over('avg(ret * ret)', 'ret', 126)}) * sqrt(252::DOUBLE) AS v FROM bf),
sc AS (SELECT session, lag(v) {W}) AS v FROM bv), w AS (SELECT b.symbol, b.session, coalesce(CASE WHEN v > 0 THEN least(1.0::DOUBLE, 0.1 / v) END, 0) AS scale, budget FROM b JOIN sc USING (session)),
x AS (SELECT symbol, session, budget * scale AS weight, scale, 1 - sum(budget * scale) OVER (PARTITION BY session) AS cash FROM w) SELECT symbol, session, {_r('weight', 'scale', 'cash')} FROM x""")
def desired_weights(spark, sf_dir):
    p = paths(spark, sf_dir).withColumnRenamed("member", "symbol").withColumn("member", F.row_number().over(by_symbol()) > 200)
    gated = p.withColumn("up", F.round(rolling.full(F.sum("ret"), "ret", rolling.trailing(63), 63), 9) > 0)
    return allocation.desired_weights(gated, cap=0.25, gate="up")


@query(f"""WITH {BARS}, b AS (SELECT symbol, session, turnover / sum(turnover) OVER (PARTITION BY session) AS want FROM bars), h AS (SELECT *, coalesce(lag(want) {W}), 0) AS held FROM b),
x AS (SELECT symbol, session, CASE WHEN abs(round(want - held, 12)) < 0.05 THEN held ELSE want - sign(want - held) * 0.05 END AS hold FROM h) SELECT symbol, session, {_r('hold')} FROM x""")
def banded_hold(spark, sf_dir):
    b = bars(spark, sf_dir).withColumn("want", F.col("turnover") / F.sum("turnover").over(Window.partitionBy("session")))
    b = b.withColumn("held", F.coalesce(F.lag("want").over(by_symbol()), F.lit(0.0)))
    return allocation.banded_hold(b, 0.05).select("symbol", "session", "hold")


MONTHLY = f"""{PATHS}, mr AS (SELECT member AS symbol, CAST(date_trunc('month', session) AS DATE) AS month, exp(sum(ln(1 + ret))) - 1 AS ret FROM paths GROUP BY ALL)"""
M = "OVER (PARTITION BY symbol ORDER BY month"


def monthly(spark, sf_dir) -> DataFrame:
    return performance.monthly_returns(paths(spark, sf_dir)).select(F.col("member").alias("symbol"), "month", "ret")


@query(f"""WITH {MONTHLY}, d AS (SELECT symbol, month, CASE WHEN count(ret) {M} ROWS 11 PRECEDING) = 12 THEN sign(round(sum(ret) {M} ROWS 11 PRECEDING), 9)) END AS signal, CASE WHEN count(ret) {M} ROWS 11 PRECEDING) = 12 THEN stddev_samp(ret) {M} ROWS 11 PRECEDING) * sqrt(12::DOUBLE) END AS vol FROM mr),
h AS (SELECT d.symbol, d.month, d.signal, d.vol, m.month AS of_month, m.ret, count(m.ret) OVER (PARTITION BY d.symbol, d.month) AS n FROM d JOIN mr m ON m.symbol = d.symbol AND m.month <= d.month AND m.month > d.month - INTERVAL 36 MONTH WHERE d.signal IS NOT NULL AND d.vol > 0),
c AS (SELECT *, count(*) OVER (PARTITION BY month, of_month) AS live FROM h WHERE n = 36), r AS (SELECT *, signal * 0.4 / vol / live AS raw FROM c WHERE live >= 2), t AS (SELECT month, of_month, sum(raw * ret) AS r FROM r GROUP BY ALL), e AS (SELECT month, sqrt(var_samp(r) * 12) AS ex_ante FROM t GROUP BY month HAVING sqrt(var_samp(r) * 12) > 0),
o AS (SELECT DISTINCT r.symbol, r.month, live, ex_ante, raw * 0.1 / ex_ante AS weight FROM r JOIN e USING (month)) SELECT symbol, month, live, {_r('ex_ante', 'weight')} FROM o""")
def volatility_scaled_weights(spark, sf_dir):
    m = monthly(spark, sf_dir)
    year = Window.partitionBy("symbol").orderBy("month").rowsBetween(-11, 0)
    whole = F.count("ret").over(year) == 12
    d = m.select("symbol", "month", F.when(whole, F.signum(F.round(F.sum("ret").over(year), 9))).alias("signal"), F.when(whole, F.stddev_samp("ret").over(year) * 12**0.5).alias("vol"))
    return allocation.scaled_to_volatility(d, m)


# Regimes ---------------------------------------------------------------------


def named_paths(spark, sf_dir) -> DataFrame:
    return paths(spark, sf_dir).withColumnRenamed("member", "symbol")


@query()
def absorption_shift(spark, sf_dir):
    ratios = regimes.absorption_shift(regimes.absorption_ratio(named_paths(spark, sf_dir)))
    return ratios.withColumn("state", regimes.stress_state(F.round("shift", 6)))


@query(f"""WITH {PATHS}, w AS (SELECT member AS symbol, CAST(date_trunc('week', session + 2) AS DATE) + 4 AS week, sum(ln(1 + ret)) AS ret FROM paths GROUP BY ALL), l AS (SELECT *, max(week) OVER (PARTITION BY symbol) AS last FROM w) SELECT symbol, week, {_r('ret')} FROM l WHERE week < last""")
def weekly_log_returns(spark, sf_dir):
    return regimes.weekly_log_returns(named_paths(spark, sf_dir))


@query()
def markov_states(spark, sf_dir):
    weeks = regimes.weekly_log_returns(named_paths(spark, sf_dir)).select(F.col("symbol").alias("series"), F.col("week").alias("session"), F.col("ret").alias("value"))
    fits = regimes.fit_switching(weeks.filter("session <= DATE '1998-12-31'"))
    found = regimes.filtered_states(weeks, fits)
    return found.select("series", "session", "state", F.col("probabilities")[0].alias("low"), F.col("probabilities")[1].alias("high"))


@query(f"""WITH {PATHS}, p AS (SELECT member AS symbol, session, ret, date_trunc('month', session) AS month FROM paths), m AS (SELECT symbol, month, CASE WHEN count(ret) >= 5 AND var_pop(ret) > 0 THEN var_pop(ret) * count(ret) END AS rv FROM p GROUP BY ALL),
b AS (SELECT *, lag(rv) {M}) AS before, row_number() {M}) AS months FROM m), j AS (SELECT p.*, rv, months, ret / before AS managed FROM p JOIN b USING (symbol, month)), c AS (SELECT *, stddev_samp(ret) {W}) / nullif(stddev_samp(managed) {W}), 0) AS c FROM j),
e AS (SELECT symbol, session, CASE WHEN months >= 24 THEN c / rv END AS weight FROM c QUALIFY row_number() OVER (PARTITION BY symbol, month ORDER BY session DESC) = 1) SELECT symbol, session, {_r('weight')} FROM e""")
def managed_variance(spark, sf_dir):
    return regimes.managed_variance(named_paths(spark, sf_dir))


@query(f"""WITH {MONTHLY}, v AS (SELECT *, CASE WHEN count(ret) {M} ROWS 11 PRECEDING) >= 12 THEN stddev_samp(ret) {M} ROWS 11 PRECEDING) * sqrt(12::DOUBLE) END AS v FROM mr), l AS (SELECT *, round(lag(v) {M}), 9) AS vol FROM v),
s AS (SELECT *, CASE WHEN vol IS NOT NULL AND count(vol) {M} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 36 THEN CASE WHEN vol <= quantile_cont(vol, 1/3::DOUBLE) {M} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'Low' WHEN vol > quantile_cont(vol, 2/3::DOUBLE) {M} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'High' ELSE 'Middle' END END AS state FROM l),
k AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM s WHERE state IS NOT NULL),
o AS (SELECT symbol, state, count(ret) AS months, count(ret) / any_value(n) AS share, avg(ret) AS mean, quantile_cont(ret, 0.5) AS median, stddev_samp(ret) AS vol, avg((ret > 0)::INT) AS positive, min(ret) AS worst, min(month) AS "first", max(month) AS "last" FROM k GROUP BY ALL)
SELECT symbol, state, months, {_r('share', 'mean', 'median', 'vol', 'positive', 'worst')}, "first", "last" FROM o""")
def outcomes_by_state(spark, sf_dir):
    return regimes.outcomes_by_state(monthly(spark, sf_dir).withColumnRenamed("month", "session"))


@query(f"""WITH {PATHS}, j AS (SELECT p.member, p.session >= DATE '1998-01-01' AS late, b.ret AS x, p.ret AS y FROM paths p JOIN paths b ON p.session = b.session AND b.member = 'AF' WHERE p.member <> 'AF'),
c AS (SELECT member, corr(x, y) FILTER (late) AS late_corr, corr(x, y) FILTER (NOT late) AS early_corr, var_samp(x) FILTER (late) / var_samp(x) FILTER (NOT late) - 1 AS rise FROM j GROUP BY member),
a AS (SELECT *, CASE WHEN 1 + rise * (1 - late_corr * late_corr) > 0 THEN late_corr / sqrt(1 + rise * (1 - late_corr * late_corr)) END AS adjusted FROM c) SELECT member, {_r('late_corr', 'early_corr', 'rise', 'adjusted')} FROM a""")
def adjusted_correlation(spark, sf_dir):
    p = paths(spark, sf_dir)
    base = p.filter("member = 'AF'").select("session", F.col("ret").alias("x"))
    j = p.filter("member <> 'AF'").join(base, "session").withColumn("late", F.col("session") >= F.lit("1998-01-01").cast("date"))
    late, early = (lambda c: F.when(F.col("late"), F.col(c))), (lambda c: F.when(~F.col("late"), F.col(c)))
    c = j.groupBy("member").agg(F.corr(late("x"), late("ret")).alias("late_corr"), F.corr(early("x"), early("ret")).alias("early_corr"), (F.var_samp(late("x")) / F.var_samp(early("x")) - 1).alias("rise"))
    return c.withColumn("adjusted", regimes.adjusted_correlation(F.col("late_corr"), F.col("rise")))


@query(f"""WITH {WEALTH}, m AS (SELECT member, session, CASE WHEN -drawdown <= 0.05 THEN 1.0::DOUBLE WHEN -drawdown >= 0.15 THEN 0.5::DOUBLE ELSE 1 - (-drawdown - 0.05) / 0.1 * 0.5 END AS exposure FROM wealth) SELECT member, session, {_r('exposure')} FROM m""")
def drawdown_exposure(spark, sf_dir):
    return performance.wealth(paths(spark, sf_dir)).select("member", "session", regimes.drawdown_multiplier(-F.col("drawdown")).alias("exposure"))


# Controls --------------------------------------------------------------------

LABELS = f"""{BARS}, lab AS (SELECT symbol, session, CAST(strftime(CASE WHEN volume::BIGINT % 17 = 0 THEN session - 40 ELSE session END, '%Y%m') AS INTEGER) AS delivery FROM bars)"""


def delivery_labels(spark, sf_dir) -> DataFrame:
    day = F.when(F.col("volume").cast("long") % 17 == 0, F.date_sub("session", 40)).otherwise(F.col("session"))
    return bars(spark, sf_dir).select("symbol", "session", F.date_format(day, "yyyyMM").cast("int").alias("delivery"))


@query(f"""WITH {LABELS}, l AS (SELECT *, coalesce(delivery <> lag(delivery) {W}), false) AS roll, max(delivery) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest FROM lab), n AS (SELECT *, sum(roll::INT) {W}) AS run FROM l),
r AS (SELECT symbol, run, min(session) AS session, count(*) AS n, any_value(delivery) AS d FROM n GROUP BY ALL), b AS (SELECT symbol, session, coalesce(n <= 5 AND lag(d) OVER (PARTITION BY symbol ORDER BY run) = lead(d) OVER (PARTITION BY symbol ORDER BY run), false) AS brief FROM r)
SELECT n.symbol, n.session, delivery, roll, roll AND delivery < highest AS backward, coalesce(brief, false) AS brief FROM n LEFT JOIN b ON b.symbol = n.symbol AND b.session = n.session""")
def roll_events(spark, sf_dir):
    return controls.roll_events(delivery_labels(spark, sf_dir)).select("symbol", "session", "delivery", "roll", F.coalesce("backward", F.lit(False)).alias("backward"), "brief")


@query()
def roll_anomalies(spark, sf_dir):
    return controls.roll_anomalies(delivery_labels(spark, sf_dir))


CONTRACTS = """ct AS (SELECT p_brand || '-' || strftime(l_shipdate, '%Y%m') AS contract, any_value(p_brand) AS root, max(last_day(CAST(l_shipdate AS DATE))) - 3 AS last_trade, max(last_day(CAST(l_shipdate AS DATE))) - 5 AS deadline, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) * 10 AS volume, CAST(sum(l_linenumber) % 15 - 7 AS BIGINT) AS lots FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
po AS (SELECT contract, CASE WHEN contract LIKE '%7-%' THEN contract || 'x' ELSE contract END AS held, lots AS position FROM ct WHERE last_trade BETWEEN DATE '1998-06-20' AND DATE '1998-08-30' AND lots <> 0)"""
PLANS = f"""{CONTRACTS}, hl AS (SELECT po.held AS contract, po.position, c.root, c.last_trade, c.deadline, c.volume FROM po LEFT JOIN ct c ON c.contract = po.held),
cd AS (SELECT hl.*, n.contract AS to_contract, n.volume AS to_volume, row_number() OVER (PARTITION BY hl.contract ORDER BY n.last_trade ASC NULLS LAST, n.contract) AS r FROM hl LEFT JOIN ct n ON n.root = hl.root AND n.last_trade > hl.last_trade AND n.deadline > hl.deadline AND n.deadline >= DATE '1998-07-27'),
pc AS (SELECT *, abs(position) AS requested, CASE WHEN volume IS NULL OR to_volume IS NULL THEN 0 ELSE CAST(floor(least(volume, to_volume) * 0.0005) AS BIGINT) END AS capacity FROM cd WHERE r = 1),
plans AS (SELECT contract, root, position, to_contract, requested, capacity, CASE WHEN root IS NULL OR to_contract IS NULL OR DATE '1998-07-20' >= deadline THEN 'BLOCKED' WHEN DATE '1998-07-20' < deadline - 7 THEN 'NOT_DUE' WHEN capacity < 1 THEN 'BLOCKED' WHEN least(requested, capacity) < requested THEN 'APPROVED_PARTIAL' ELSE 'APPROVED' END AS status FROM pc)"""


def plans(spark, sf_dir) -> DataFrame:
    line = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    end = F.max(F.last_day(F.col("l_shipdate").cast("date")))
    contracts = line.groupBy(F.concat("p_brand", F.lit("-"), F.date_format("l_shipdate", "yyyyMM")).alias("contract")).agg(
        F.first("p_brand").alias("root"), F.date_sub(end, 3).alias("last_trade"), F.date_sub(end, 5).alias("deadline"), (F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double") * 10).alias("volume"), (F.sum("l_linenumber") % 15 - 7).cast("long").alias("lots"),
    )
    held = contracts.filter("last_trade BETWEEN DATE '1998-06-20' AND DATE '1998-08-30' AND lots <> 0")
    positions = held.select(F.when(F.col("contract").like("%7-%"), F.concat("contract", F.lit("x"))).otherwise(F.col("contract")).alias("contract"), F.col("lots").alias("position"))
    return controls.roll_plans(positions, contracts.drop("lots"), "1998-07-20", participation=0.0005)


@query(f"""WITH {PLANS} SELECT contract, root, position, to_contract, requested, capacity, CASE WHEN status LIKE 'APPROVED%' THEN least(requested, capacity) ELSE 0 END AS quantity, status FROM plans""")
def roll_plans(spark, sf_dir):
    return plans(spark, sf_dir).drop("reason")


@query(f"""WITH {PLANS}, a AS (SELECT root, contract, to_contract, sign(position) * least(requested, capacity) AS size FROM plans WHERE status LIKE 'APPROVED%') SELECT root, 'FROM' AS leg, contract AS leg_contract, CAST(-size AS BIGINT) AS signed FROM a UNION ALL SELECT root, 'TO', to_contract, CAST(size AS BIGINT) FROM a""")
def roll_legs(spark, sf_dir):
    return controls.roll_legs(plans(spark, sf_dir)).withColumn("signed", F.col("signed").cast("long"))


@query("""WITH j AS (SELECT p_brand AS symbol, l_returnflag AS flag, CAST(l_quantity AS BIGINT) AS q, CAST(p_retailprice AS DECIMAL(18,2)) AS price FROM lineitem JOIN part ON l_partkey = p_partkey),
cu AS (SELECT symbol, CAST(sum(q) % 41 - 20 AS BIGINT) AS current FROM j WHERE flag = 'R' GROUP BY symbol), ta AS (SELECT symbol, CAST(sum(q) % 37 - 18 AS BIGINT) AS target FROM j WHERE flag = 'A' AND symbol <> 'Brand#3' GROUP BY symbol),
te AS (SELECT symbol, CASE WHEN symbol <> 'Brand#5' THEN CAST(sum(price) AS DOUBLE) / count(*) * 50 END AS notional, CAST(sum(price) AS DOUBLE) / count(*) * 4 AS margin, CAST(sum(q) AS DOUBLE) / 100 AS adv FROM j GROUP BY symbol),
r AS (SELECT symbol, coalesce(current, 0) AS current, coalesce(target, 0) AS target, notional, margin, adv, coalesce(notional > 0 AND margin > 0 AND adv > 0, false) AS valued FROM cu FULL JOIN ta USING (symbol) LEFT JOIN te USING (symbol)),
c AS (SELECT *, CASE WHEN valued THEN CAST(floor(adv * 0.02) AS BIGINT) ELSE 0 END AS capacity FROM r), q AS (SELECT *, CAST(sign(target - current) * least(abs(target - current), capacity) AS BIGINT) AS quantity FROM c), p AS (SELECT *, current + quantity AS projected FROM q),
t AS (SELECT sum(abs(projected) * notional) / 5e7 AS gross, sum(abs(projected) * margin) / 5e7 AS margin_share, count(*) FILTER (NOT valued) AS bad FROM p),
o AS (SELECT p.*, gross, margin_share, bad > 0 OR gross > 5 OR margin_share > 0.35 AS over, abs(projected) < abs(current) AND sign(projected) * sign(current) >= 0 AND quantity <> 0 AS shrinks FROM p CROSS JOIN t)
SELECT symbol, current, target, capacity, quantity, CASE WHEN quantity > 0 THEN 'BUY' WHEN quantity < 0 THEN 'SELL' ELSE 'HOLD' END AS side, projected, round(gross, 6) AS gross, round(margin_share, 6) AS margin_share,
  CASE WHEN NOT valued THEN 'BLOCKED' WHEN target = current THEN 'NO_ACTION' WHEN quantity = 0 THEN 'BLOCKED' WHEN over AND NOT shrinks THEN 'BLOCKED' WHEN over THEN 'APPROVED_REDUCE_ONLY' WHEN abs(quantity) < abs(target - current) THEN 'APPROVED_PARTIAL' ELSE 'APPROVED' END AS status FROM o""")
def order_intents(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    j = line.select(F.col("p_brand").alias("symbol"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").cast("long").alias("q"), F.col("p_retailprice").cast("decimal(18,2)").alias("price"))
    current = j.filter("flag = 'R'").groupBy("symbol").agg((F.sum("q") % 41 - 20).alias("current"))
    target = j.filter("flag = 'A' AND symbol <> 'Brand#3'").groupBy("symbol").agg((F.sum("q") % 37 - 18).alias("target"))
    mean = F.sum("price").cast("double") / F.count(F.lit(1))
    terms = j.groupBy("symbol").agg(F.when(F.col("symbol") != "Brand#5", mean * 50).alias("notional"), (mean * 4).alias("margin"), (F.sum("q").cast("double") / 100).alias("adv"))
    out = controls.order_intents(current, target, terms, 5e7)
    return out.select("symbol", "current", "target", "capacity", F.col("quantity").cast("long").alias("quantity"), "side", F.col("projected").cast("long").alias("projected"), "gross", "margin_share", "status")


FUNDED = f"""{PATHS}, rates AS (SELECT CAST(o_orderdate AS DATE) AS session, 0.01::DOUBLE * (count(*) % 7) AS rate FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1), own AS (SELECT DISTINCT session, true AS own FROM paths), un AS (SELECT session, own, rate FROM own FULL JOIN rates USING (session)),
fi AS (SELECT session, own, last_value(rate IGNORE NULLS) OVER (ORDER BY session ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS rate FROM un), la AS (SELECT session, lag(rate) OVER (ORDER BY session) AS rate, coalesce(session - lag(session) OVER (ORDER BY session), 0) AS days FROM fi WHERE own),
ea AS (SELECT session, days, coalesce(rate, 0.0::DOUBLE) AS rate, rate IS NULL AS unrated, coalesce(greatest(rate - 0.002, 0.0::DOUBLE), 0) * days / 360 AS interest FROM la), fu AS (SELECT member, session, ret, days, rate, unrated, CASE WHEN unrated THEN 0.0::DOUBLE ELSE interest END AS interest, ret + CASE WHEN unrated THEN 0.0::DOUBLE ELSE interest END AS funded FROM paths JOIN ea USING (session)),
fn AS (SELECT *, exp(sum(ln(1 + funded)) {P})) AS nav FROM fu)"""


def funded(spark, sf_dir) -> DataFrame:
    rates = read(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'").groupBy(F.col("o_orderdate").cast("date").alias("session")).agg((F.lit(0.01) * (F.count(F.lit(1)) % 7)).alias("rate"))
    return controls.funded_paths(paths(spark, sf_dir), rates, spread=0.002)


@query(f"""WITH {FUNDED}, d AS (SELECT member, session, CAST(days AS INTEGER) AS days, rate, unrated, interest, funded, nav, nav / greatest(1.0::DOUBLE, max(nav) {P})) - 1 AS drawdown FROM fn) SELECT member, session, days, {_r('rate')}, unrated, {_r('interest', 'funded')}, {_r('nav', places=3)}, {_r('drawdown')} FROM d""")
def funded_paths(spark, sf_dir):
    return funded(spark, sf_dir).select("member", "session", "days", "rate", "unrated", "interest", "funded", F.round("nav", 3).alias("nav"), "drawdown")


@query(f"""WITH {FUNDED}, b AS (SELECT member, CASE WHEN round(rate, 9) <= 0.01 THEN 'low' WHEN round(rate, 9) <= 0.04 THEN 'middle' ELSE 'high' END AS bucket, count(*) AS sessions, sum(ret) AS excess, sum(interest) AS interest, sum(funded) AS funded FROM fn GROUP BY ALL) SELECT member, bucket, sessions, {_r('excess', 'interest', 'funded')} FROM b""")
def funded_by_rate(spark, sf_dir):
    return controls.funded_by_rate(funded(spark, sf_dir).withColumn("rate", F.round("rate", 9)))


@query(f"""WITH {WEALTH}, f AS (SELECT -min(drawdown) AS worst_drawdown, max(abs(ret)) AS largest_move, count(DISTINCT session)::DOUBLE AS sessions, max(CASE WHEN ret > 2 THEN 1.0::DOUBLE END) AS absent FROM wealth),
g AS (SELECT 'worst_drawdown' AS gate, worst_drawdown AS observed, '<=' AS rule, 0.25::DOUBLE AS "limit" FROM f UNION ALL SELECT 'largest_move', largest_move, '<=', 0.05 FROM f UNION ALL SELECT 'sessions', sessions, '>=', 1000 FROM f UNION ALL SELECT 'absent', absent, '<=', 1 FROM f)
SELECT gate, {_r('observed')}, rule, "limit", CASE WHEN observed IS NULL THEN 'BLOCKED' WHEN (rule = '<=' AND observed <= "limit") OR (rule = '>=' AND observed >= "limit") THEN 'PASS' ELSE 'FAIL' END AS status FROM g""")
def production_gates(spark, sf_dir):
    w = performance.wealth(paths(spark, sf_dir))
    figures = w.agg((-F.min("drawdown")).alias("worst_drawdown"), F.max(F.abs("ret")).alias("largest_move"), F.countDistinct("session").alias("sessions"), F.max(F.when(F.col("ret") > 2, 1.0)).alias("absent"))
    return controls.gate_rows(figures, {"worst_drawdown": ("<=", 0.25), "largest_move": ("<=", 0.05), "sessions": (">=", 1000), "absent": ("<=", 1)})


@query(f"""WITH {PATHS}, s AS (SELECT *, coalesce(close = lag(close) {W}), false) AS same FROM grid), r AS (SELECT *, sum((NOT same)::INT) {W}) AS run FROM s), n AS (SELECT *, sum(same::INT) OVER (PARTITION BY symbol, run) AS length FROM r)
SELECT symbol, min(session) FILTER (close IS NOT NULL) AS "first", max(session) FILTER (close IS NOT NULL) AS "last", count(*) AS rows, count(*) FILTER (close IS NULL) AS missing, count(*) FILTER (same) AS unchanged, CAST(max(length) AS BIGINT) AS longest_unchanged FROM n GROUP BY symbol""")
def panel_quality(spark, sf_dir):
    return controls.panel_quality(align(bars(spark, sf_dir).select("symbol", "session", "close"), ["close"], limit=None))


# Families --------------------------------------------------------------------


def _family() -> str:
    return f"""{PATHS}, gp AS MATERIALIZED (SELECT p.member, row_number() OVER (PARTITION BY p.member ORDER BY p.session) - 1 AS position, p.ret - b.ret AS gap FROM paths p JOIN paths b ON b.session = p.session AND b.member = 'AF' WHERE p.member <> 'AF'), {draws_sql('dr', '(SELECT max(position) + 1 FROM gp)', 200, '(SELECT max(position) + 1 FROM gp)', 21, 7)},
ti AS (SELECT rep, position, count(*) AS times FROM dr GROUP BY ALL), ob AS (SELECT member, count(*) AS n, avg(gap) * 252 AS observed FROM gp GROUP BY member), fd AS (SELECT rep, gp.member, sum(gap * times) / sum(times) * 252 AS draw FROM ti JOIN gp USING (position) GROUP BY ALL), fam AS (SELECT rep, member, n, observed, draw FROM fd JOIN ob USING (member))"""


@query(f"""WITH {_family()}, r AS (SELECT rep, max(sqrt(n) * observed) AS statistic, max(sqrt(n) * (draw - observed)) AS resampled FROM fam GROUP BY rep), o AS (SELECT max(statistic) AS statistic, (1 + count(*) FILTER (resampled >= statistic)) / (1 + count(*)) AS p_value, count(*) AS samples FROM r) SELECT {_r('statistic', 'p_value')}, samples FROM o""")
def reality_check(spark, sf_dir):
    return families.reality_check(families.family_draws(paths(spark, sf_dir), "AF"))


@query(f"""WITH {_family()}, w AS (SELECT member, sqrt(avg(pow((draw - observed) * sqrt(n), 2))) AS omega, any_value(observed) AS o, any_value(n) AS n FROM fam GROUP BY member), c AS (SELECT member, omega, n, sqrt(n) * o / omega AS t, o AS upper, CASE WHEN sqrt(n) * o / omega >= -sqrt(2 * ln(ln(n::DOUBLE))) THEN o ELSE 0 END AS consistent, greatest(o, 0) AS lower FROM w),
r AS (SELECT rep, greatest(max(t), 0) AS statistic, greatest(max((draw - upper) * sqrt(c.n) / omega), 0) AS u, greatest(max((draw - consistent) * sqrt(c.n) / omega), 0) AS k, greatest(max((draw - lower) * sqrt(c.n) / omega), 0) AS l FROM fam JOIN c USING (member) GROUP BY rep),
p AS (SELECT max(statistic) AS statistic, (1 + count(*) FILTER (u >= statistic)) / (1 + count(*)) AS p_upper, (1 + count(*) FILTER (k >= statistic)) / (1 + count(*)) AS p_consistent, (1 + count(*) FILTER (l >= statistic)) / (1 + count(*)) AS p_lower FROM r) SELECT {_r('statistic', 'p_upper', 'p_consistent', 'p_lower')} FROM p""")
def superior_ability(spark, sf_dir):
    return families.superior_ability(families.family_draws(paths(spark, sf_dir), "AF"))


@query()
def deflated_sharpe(spark, sf_dir):
    own = paths(spark, sf_dir).groupBy("member").agg((F.avg("ret") / F.stddev_samp("ret")).alias("sharpe"), F.count("ret").alias("sessions"), F.skewness("ret").alias("skew"), F.kurtosis("ret").alias("excess_kurtosis"))
    # A row a member: the family is one row.
    family = own.agg(F.count("sharpe").alias("trials"), F.var_samp("sharpe").alias("trial_variance"))
    return families.deflated_sharpe(own.join(F.broadcast(family)))


def outcomes(spark, sf_dir) -> DataFrame:
    return trades(spark, sf_dir).filter("exit IS NOT NULL").select("symbol", F.col("episode").alias("trade"), F.round(F.col("net") / 1e4, 9).alias("contribution"))


def _sequence_sql(method: str) -> str:
    drawn = "SELECT symbol, rep, contribution, row_number() OVER (PARTITION BY symbol, rep ORDER BY md5(rep || ':' || i)) AS step FROM re"
    if method == "iid":
        drawn = "SELECT re.symbol, rep, re.i AS step, ou.contribution FROM re JOIN ou ON ou.symbol = re.symbol AND ou.i = re.pick"
    by = "OVER (PARTITION BY symbol, rep ORDER BY step)"
    return f"""WITH {TRADES}, ou AS MATERIALIZED (SELECT symbol, round(net / 1e4, 9) AS contribution, row_number() OVER (PARTITION BY symbol ORDER BY episode) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM trades WHERE "exit" IS NOT NULL),
re AS MATERIALIZED (SELECT ou.*, rep, ('0x' || substr(md5(rep || ':' || i), 1, 8))::BIGINT % n AS pick FROM ou CROSS JOIN (SELECT unnest(range(200)) AS rep)), dr AS ({drawn}), c AS (SELECT *, 1 + sum(contribution) {by} AS c, (contribution < 0)::INT AS lost FROM dr),
d AS (SELECT *, c / greatest(1.0::DOUBLE, max(c) {by}) - 1 AS dd, sum(1 - lost) {by} AS run FROM c), s AS (SELECT *, sum(lost) OVER (PARTITION BY symbol, rep, run) AS streak FROM d),
p AS (SELECT symbol, rep, min(c) AS min_capital, min(dd) AS drawdown, max(streak) AS losing_streak FROM s GROUP BY ALL),
q AS (SELECT symbol, quantile_cont(drawdown, 0.05) AS drawdown_p05, quantile_cont(drawdown, 0.5) AS drawdown_p50, min(min_capital) AS worst_capital, quantile_cont(losing_streak::DOUBLE, 0.95) AS streak_p95, avg((drawdown <= -0.1)::INT) AS breach_probability FROM p GROUP BY symbol)
SELECT symbol, {_r('drawdown_p05', 'drawdown_p50', 'worst_capital', 'streak_p95', 'breach_probability')} FROM q"""


@query(_sequence_sql("permutation"))
def trade_permutations(spark, sf_dir):
    return families.sequence_summary(families.sequence_paths(outcomes(spark, sf_dir)))


@query(_sequence_sql("iid"))
def trade_resamples(spark, sf_dir):
    return families.sequence_summary(families.sequence_paths(outcomes(spark, sf_dir), method="iid"))


@query(f"""WITH {LEDGER}, ru AS (SELECT symbol, session, gross, cost, CAST(sum((sign(position) <> sign(before))::INT) {W}) AS BIGINT) AS run FROM ledger), dy AS (SELECT session, sum(gross - cost) AS net FROM ru GROUP BY session), ow AS (SELECT round(avg(net) / stddev_samp(net) * sqrt(252::DOUBLE), 9) AS sharpe FROM dy),
fl AS (SELECT rep, session, sum(CASE WHEN ('0x' || substr(md5(rep || ':' || symbol || ':' || run), 1, 8))::BIGINT % 2 = 1 THEN -gross ELSE gross END - cost) AS net FROM ru CROSS JOIN (SELECT unnest(range(200)) AS rep) GROUP BY ALL), nu AS (SELECT rep, round(avg(net) / stddev_samp(net) * sqrt(252::DOUBLE), 9) AS null_sharpe FROM fl GROUP BY rep),
o AS (SELECT max(sharpe) AS sharpe, avg(null_sharpe) AS null_mean, quantile_cont(null_sharpe, 0.95) AS null_p95, (1 + count(*) FILTER (null_sharpe >= sharpe)) / (1 + count(*)) AS p_value FROM nu CROSS JOIN ow) SELECT {_r('sharpe', 'null_mean', 'null_p95', 'p_value')} FROM o""")
def sign_null(spark, sf_dir):
    whole = F.col("volume").cast("long")
    size = F.when(whole % 11 == 0, 0.0).otherwise(F.coalesce(F.signum(F.col("close") - F.lag("close", 21).over(by_symbol())) * (1 + whole % 3), F.lit(0.0)))
    from ledgerline.operators.episodes import ledger

    held = ledger(bars(spark, sf_dir).select("symbol", "session", "close", size.alias("position")), 0.5)
    turned = F.signum("position") != F.signum(F.coalesce(F.lag("position").over(by_symbol()), F.lit(0.0)))
    rows = held.withColumn("turned", turned.cast("long"))
    return families.sign_null(rows.withColumn("run", F.sum("turned").over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))))


# Streams ---------------------------------------------------------------------

E = "OVER (PARTITION BY key ORDER BY ts, event_id"
VALUES = "ev AS (SELECT user_id AS key, ts, event_id, value FROM events)"
#: Rows that a watermark of an hour has passed.
PASSED = "epoch_ms(ts) < epoch_ms((SELECT max(ts) FROM events)) - 3600000"


def values(spark, sf_dir) -> DataFrame:
    return streams.stream(spark, f"{sf_dir}/events.parquet").select(F.col("user_id").alias("key"), "ts", "event_id", "value")


@query(f"""WITH {VALUES}, n AS (SELECT *, exp(sum(ln(1 + (value - 50) / 1000)) {E})) AS nav FROM ev), p AS (SELECT *, greatest(1.0::DOUBLE, max(nav) {E})) AS peak FROM n), d AS (SELECT key, event_id, nav, nav / peak - 1 AS drawdown FROM p WHERE {PASSED}) SELECT key, event_id, {_r('nav', 'drawdown')} FROM d""")
def stream_drawdown(spark, sf_dir):
    rows = values(spark, sf_dir).select("key", "ts", "event_id", ((F.col("value") - 50) / 1000).alias("ret"))
    return streams.finish(folds.running_drawdown(rows, ["ts", "event_id"]), "drawdown").select("key", "event_id", "nav", "drawdown")


@query(f"""WITH RECURSIVE {VALUES}, n AS (SELECT *, row_number() {E}) AS i FROM ev), h AS (SELECT key, event_id, i, CASE WHEN abs(value) > 0.25 * abs(value) THEN value ELSE 0.0::DOUBLE END AS held FROM n WHERE i = 1
  UNION ALL SELECT n.key, n.event_id, n.i, CASE WHEN abs(value - held) > 0.25 * greatest(abs(value), abs(held)) THEN value ELSE held END FROM h JOIN n ON n.key = h.key AND n.i = h.i + 1) SELECT h.key, h.event_id, {_r('held')} FROM h JOIN ev ON ev.event_id = h.event_id WHERE {PASSED}""")
def stream_dead_band(spark, sf_dir):
    return streams.finish(folds.dead_band(values(spark, sf_dir), ["ts", "event_id"]), "band").select("key", "event_id", "held")


@query(f"""WITH {VALUES}, named AS (SELECT key AS symbol, event_id AS session, value FROM ev), {ewm_sql('em', 'named', 'value', 1 / 15)} SELECT symbol AS key, session AS event_id, {_r('mean')}, round(sd, 6) + 0.0::DOUBLE AS deviation FROM em JOIN ev ON ev.event_id = em.session WHERE {PASSED}""")
def stream_ewm(spark, sf_dir):
    rows = values(spark, sf_dir)
    return streams.finish(folds.ewm_moments(rows, ["event_id"], 1 / 15), "ewm").select("key", "event_id", "mean", "deviation")


@query(f"""WITH c AS (SELECT user_id AS key, ts, event_id AS sequence, sha256(concat(event_id, ':', event_type)) AS record_hash, CASE WHEN event_id % 10 = 0 THEN sha256(concat(event_id, ':', event_type)) ELSE sha256(concat(event_id - 1, ':', event_type)) END AS previous_hash FROM events),
l AS (SELECT *, lag(sequence) OVER (PARTITION BY key ORDER BY sequence) AS s0, lag(record_hash) OVER (PARTITION BY key ORDER BY sequence) AS h0 FROM c) SELECT key, sequence, coalesce(sequence <> s0 + 1, false) AS sequence_break, coalesce(previous_hash <> h0, false) AS hash_break FROM l WHERE {PASSED}""")
def stream_chain_breaks(spark, sf_dir):
    own = lambda n: F.sha2(F.concat_ws(":", n, "event_type"), 256)
    e = streams.stream(spark, f"{sf_dir}/events.parquet")
    rows = e.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("sequence"), own(F.col("event_id")).alias("record_hash"), F.when(F.col("event_id") % 10 == 0, own(F.col("event_id"))).otherwise(own(F.col("event_id") - 1)).alias("previous_hash"))
    return streams.finish(folds.chain_breaks(rows, ["sequence"]), "chain").select("key", "sequence", "sequence_break", "hash_break")


@query(f"""WITH RECURSIVE {VALUES}, n AS (SELECT *, row_number() {E}) AS i, exp(-0.5 * pow(value - 30, 2) / 400) / sqrt(2 * pi() * 400) AS a, exp(-0.5 * pow(value - 90, 2) / 3600) / sqrt(2 * pi() * 3600) AS b FROM ev),
f AS (SELECT key, event_id, ts, i, 0.5 * a / (0.5 * a + 0.5 * b) AS low FROM n WHERE i = 1 UNION ALL SELECT n.key, n.event_id, n.ts, n.i, (low * 0.9 + (1 - low) * 0.2) * a / ((low * 0.9 + (1 - low) * 0.2) * a + (low * 0.1 + (1 - low) * 0.8) * b) FROM f JOIN n ON n.key = f.key AND n.i = f.i + 1)
SELECT key, event_id, {_r('low')}, round(1 - low, 6) + 0.0::DOUBLE AS high FROM f WHERE {PASSED}""")
def stream_markov_states(spark, sf_dir):
    out = folds.filtered_states(values(spark, sf_dir), ["ts", "event_id"], [30.0, 90.0], [400.0, 3600.0], [[0.9, 0.1], [0.2, 0.8]], [0.5, 0.5])
    return streams.finish(out, "states").select("key", "event_id", F.col("probabilities")[0].alias("low"), F.col("probabilities")[1].alias("high"))


ORDERED = """ev AS (SELECT concat(user_id, ':', epoch_ms(ts) // 604800000) AS key, ts, event, concat(event, ':', epoch_ms(ts) // 86400000) AS event_id, CASE WHEN event = 'OUTBOX' THEN 3 + CAST(floor(value) AS BIGINT) % 5 ELSE 1 + CAST(floor(value) AS BIGINT) % 3 END AS quantity
  FROM (SELECT *, CASE event_type WHEN 'signup' THEN 'OUTBOX' WHEN 'view' THEN 'ACK' WHEN 'error' THEN 'REJECT' ELSE 'FILL' END AS event FROM events))"""
#: An event of an order by what the order was: status s, requested q, filled f, ids seen.
_STEP = """CASE WHEN list_contains(ids, n.event_id) THEN 'duplicate' WHEN n.event = 'OUTBOX' AND s IS NULL OR n.event = 'ACK' AND s = 'PERSISTED' OR n.event = 'REJECT' AND s IN ('PERSISTED', 'ACKNOWLEDGED', 'PARTIAL') THEN 'applied'
  WHEN n.event = 'FILL' AND s IN ('ACKNOWLEDGED', 'PARTIAL') THEN CASE WHEN f + n.quantity > q THEN 'overfilled' ELSE 'applied' END ELSE 'illegal' END"""


def order_flow(spark, sf_dir) -> DataFrame:
    e = streams.stream(spark, f"{sf_dir}/events.parquet")
    event = F.when(F.col("event_type") == "signup", "OUTBOX").when(F.col("event_type") == "view", "ACK").when(F.col("event_type") == "error", "REJECT").otherwise("FILL")
    ms, whole = millis(F.col("ts").cast("timestamp")), F.floor("value")
    through = lambda size: ((ms - ms % size) / size).cast("long")  # noqa: E731  (towards zero, as // of the SQL)
    quantity = F.when(event == "OUTBOX", 3 + whole % 5).otherwise(1 + whole % 3)
    return e.select(F.concat_ws(":", "user_id", through(604800000)).alias("key"), "ts", F.concat_ws(":", event, through(86400000)).alias("event_id"), event.alias("event"), quantity.alias("quantity"))


@query(f"""WITH RECURSIVE {ORDERED}, n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS i FROM ev),
w AS (SELECT key, CAST(0 AS BIGINT) AS i, CAST(NULL AS TIMESTAMP) AS ts, '' AS event_id, CAST(NULL AS VARCHAR) AS verdict, CAST(NULL AS VARCHAR) AS s, CAST(0 AS BIGINT) AS q, CAST(0 AS BIGINT) AS f, CAST([] AS VARCHAR[]) AS ids FROM (SELECT DISTINCT key FROM n)
  UNION ALL SELECT key, i, ts, event_id, verdict, CASE WHEN verdict <> 'applied' THEN s WHEN event = 'OUTBOX' THEN 'PERSISTED' WHEN event = 'ACK' THEN 'ACKNOWLEDGED' WHEN event = 'REJECT' THEN 'REJECTED' WHEN f + quantity = q THEN 'FILLED' ELSE 'PARTIAL' END,
    CASE WHEN verdict = 'applied' AND event = 'OUTBOX' THEN quantity ELSE q END, CASE WHEN verdict = 'applied' AND event = 'FILL' THEN f + quantity ELSE f END, list_append(ids, event_id)
  FROM (SELECT n.key, n.i, n.ts, n.event_id, n.event, n.quantity, w.s, w.q, w.f, w.ids, {_STEP} AS verdict FROM w JOIN n ON n.key = w.key AND n.i = w.i + 1))
SELECT key, CAST(epoch_ms(ts) AS BIGINT) AS at_ms, event_id, verdict, s AS status, f AS filled FROM w WHERE i > 0 AND {PASSED}""")
def stream_order_states(spark, sf_dir):
    out = streams.finish(folds.order_states(order_flow(spark, sf_dir)), "orders")
    return out.select("key", millis("ts").alias("at_ms"), "event_id", "verdict", "status", "filled")


@query("SELECT event_type AS component, 'BLOCKED' AS status, CAST(epoch_ms(max(ts)) AS BIGINT) AS last_ms, 'heartbeat is stale' AS reason FROM events GROUP BY event_type")
def stream_freshness(spark, sf_dir):
    """The tables end in the past, so every component is stale by the clock."""
    told = streams.finish(folds.freshness(streams.stream(spark, f"{sf_dir}/events.parquet"), "event_type", 300), "fresh", once=True)
    newest = told.groupBy("component").agg(F.max_by(F.struct("status", "last", "reason"), F.struct("told_at", "last")).alias("m"))
    return newest.select("component", "m.status", millis("m.last").alias("last_ms"), "m.reason")


# Files -----------------------------------------------------------------------


@query(f"""WITH {BARS} SELECT symbol, session, {_r('close', 'volume', places=9)} FROM bars""", places=9)
def csv_round_trip(spark, sf_dir):
    at = scratch(spark, "bars-csv")
    write_panel(bars(spark, sf_dir).select("symbol", "session", "close", "volume"), at)
    return scan_panel(spark, at, {"session": "date", "close": "double", "volume": "double"})[0].select("symbol", "session", "close", "volume")


@query("""WITH h AS (SELECT o_orderpriority, sha256('o_custkey=' || o_custkey || '|o_orderkey=' || o_orderkey || '|o_orderpriority=' || o_orderpriority || '|o_orderstatus=' || o_orderstatus) AS h FROM orders)
SELECT o_orderpriority, count(*) AS rows, sum(('0x' || substr(h, 1, 8))::BIGINT) || '-' || sum(('0x' || substr(h, 9, 8))::BIGINT) || '-' || sum(('0x' || substr(h, 17, 8))::BIGINT) || '-' || sum(('0x' || substr(h, 25, 8))::BIGINT) AS digest FROM h GROUP BY o_orderpriority""")
def table_fingerprint(spark, sf_dir):
    return fingerprint(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), "o_orderpriority")
