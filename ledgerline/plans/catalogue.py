"""Every registered query of the library proper, with its DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.operators import audit, episodes, inference, panel, performance, rolling
from ledgerline.sources.views import BARS, FILLS, PATHS, bars, fills, paths, read
from ledgerline.streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to so many places, without negative zero."""
    return df.select(*((F.round(c, places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def query(sql: str | None = None, places: int = 6):
    """Registers a function as a query under its own name."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir), places)
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _r(*names: str, places: int = 6) -> str:
    return ", ".join(f"round({n}, {places}) + 0.0::DOUBLE AS {n.split('.')[-1]}" for n in names)


def draws_sql(name: str, length: str, samples: int, horizon: int | str, block: int, seed: int) -> str:
    """CTE ``name`` (rep, step, position): the stationary draws of the operators."""
    pick = lambda salt: f"('0x' || substr(md5('{seed}:{salt}:{block}:' || rep || ':' || step), 1, 8))::BIGINT"
    return f"""{name}0 AS MATERIALIZED (SELECT rep, step, step = 0 OR {pick(1)} * {block} < 4294967296 AS fresh, {pick(2)} % {length} AS spot FROM (SELECT unnest(range({samples})) AS rep) CROSS JOIN (SELECT unnest(range({horizon})) AS step)),
{name} AS MATERIALIZED (SELECT rep, step, (last_value(CASE WHEN fresh THEN spot END IGNORE NULLS) OVER (PARTITION BY rep ORDER BY step) + step - last_value(CASE WHEN fresh THEN step END IGNORE NULLS) OVER (PARTITION BY rep ORDER BY step)) % {length} AS position FROM {name}0)"""


W = "OVER (PARTITION BY symbol ORDER BY session"
RETURNS = f"{BARS}, returns AS (SELECT *, close / lag(close) {W}) - 1 AS ret FROM bars)"
MONTHS = f"{BARS}, ends AS (SELECT symbol, session, close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol, date_trunc('month', session) ORDER BY session DESC) = 1)"


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.simple_returns(bars(spark, sf_dir))


@query(f"""WITH {BARS}, days AS (SELECT CAST(d AS DATE) AS session FROM (SELECT unnest(generate_series((SELECT min(session) FROM bars), (SELECT max(session) FROM bars), INTERVAL 1 DAY)) AS d) WHERE isodow(d) <= 5),
grid AS (SELECT symbol, session, last_value(close IGNORE NULLS) {W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS close,
  last_value(volume IGNORE NULLS) {W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS volume
  FROM days CROSS JOIN (SELECT DISTINCT symbol FROM bars) LEFT JOIN bars USING (symbol, session))
SELECT symbol, session, {_r('close', 'volume', places=9)} FROM grid""", places=9)
def bars_calendar_fill(spark, sf_dir):
    b = bars(spark, sf_dir).select("symbol", "session", "close", "volume")
    return panel.align(b, ["close", "volume"], panel.business_days(b), limit=5)


@query(f"""WITH {BARS} SELECT symbol, session, sign(close - lag(close, 252) {W})) + 0.0::DOUBLE AS signal FROM bars""")
def trend_sign(spark, sf_dir):
    return rolling.trend_sign(bars(spark, sf_dir)).select("symbol", "session", "signal")


@query(f"""WITH {BARS}, m AS (SELECT symbol, session, CASE WHEN count(*) {W} ROWS 59 PRECEDING) >= 60 THEN quantile_cont(volume, 0.5) {W} ROWS 59 PRECEDING) END AS median FROM bars),
t AS (SELECT *, coalesce(median > 150, false) AS tradeable, coalesce(median >= 150, false) AS loose FROM m)
SELECT symbol, session, {_r('median')}, tradeable, coalesce(lag(loose) {W}), false) AS admitted FROM t""")
def liquidity_mask(spark, sf_dir):
    strict = rolling.liquidity_mask(bars(spark, sf_dir), floor=150.0)
    loose = rolling.liquidity_mask(strict.withColumn("__t", F.col("tradeable")), floor=150.0, strict=False, lag=1)
    return loose.select("symbol", "session", "median", F.col("__t").alias("tradeable"), F.col("tradeable").alias("admitted"))


VOL = f"vol AS (SELECT symbol, session, ret, CASE WHEN count(ret) {W} ROWS 62 PRECEDING) >= 63 THEN sqrt(avg(ret * ret) {W} ROWS 62 PRECEDING) * 252) END AS vol FROM returns)"


@query(f"""WITH {RETURNS}, {VOL} SELECT symbol, session, {_r('vol')} FROM vol""")
def realized_vol(spark, sf_dir):
    return rolling.realized_volatility(returns(spark, sf_dir)).select("symbol", "session", "vol")


STATE = f"""rv AS (SELECT symbol, session, round(vol, 9) AS vol FROM vol), state AS (SELECT symbol, session, vol, CASE WHEN count(vol) {W} ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING) >= 126 AND vol IS NOT NULL THEN
  CASE WHEN vol <= quantile_cont(vol, 1/3::DOUBLE) {W} ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING) THEN 'Low'
       WHEN vol > quantile_cont(vol, 2/3::DOUBLE) {W} ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING) THEN 'High' ELSE 'Middle' END END AS state FROM rv)"""


def vol_states(spark, sf_dir):
    vol = rolling.realized_volatility(returns(spark, sf_dir)).withColumn("vol", F.round("vol", 9))
    return rolling.terciles(vol, "vol").select("symbol", "session", "vol", "state")


@query(f"""WITH {RETURNS}, {VOL}, {STATE} SELECT symbol, session, state FROM state""")
def vol_tercile_state(spark, sf_dir):
    return vol_states(spark, sf_dir).select("symbol", "session", "state")


@query(f"""WITH {RETURNS}, {VOL}, {STATE}, runs AS (SELECT *, sum(CASE WHEN state IS DISTINCT FROM before THEN 1 ELSE 0 END) {W}) AS run FROM (SELECT *, lag(state) {W}) AS before FROM state)),
spells AS (SELECT symbol, state, run, count(*) AS n FROM runs WHERE state IS NOT NULL GROUP BY ALL),
o AS (SELECT symbol, state, CAST(sum(n) AS BIGINT) AS sessions, count(*) AS spells, avg(n) AS mean_spell, quantile_cont(n, 0.5)::DOUBLE AS median_spell, max(n) AS longest_spell FROM spells GROUP BY ALL),
q AS (SELECT *, sessions / sum(sessions) OVER (PARTITION BY symbol) AS share FROM o)
SELECT symbol, state, sessions, spells, {_r('mean_spell', 'median_spell')}, longest_spell, {_r('share')} FROM q""")
def regime_occupancy(spark, sf_dir):
    return performance.occupancy(vol_states(spark, sf_dir))


@query(f"""WITH {RETURNS}, {VOL}, {STATE}, p AS (SELECT symbol, state AS from_state, lead(state) {W}) AS to_state FROM state),
c AS (SELECT symbol, from_state, to_state, count(*) AS n FROM p WHERE from_state IS NOT NULL AND to_state IS NOT NULL GROUP BY ALL),
q AS (SELECT *, n / sum(n) OVER (PARTITION BY symbol, from_state) AS probability FROM c) SELECT symbol, from_state, to_state, n, {_r('probability')} FROM q""")
def regime_transitions(spark, sf_dir):
    return performance.transitions(vol_states(spark, sf_dir))


@query(f"""WITH {RETURNS}, p AS (SELECT a.symbol AS "left", b.symbol AS "right", a.session, a.ret AS x, b.ret AS y FROM returns a JOIN returns b ON a.session = b.session AND a.symbol < b.symbol WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL),
c AS (SELECT "left", "right", session, CASE WHEN count(*) OVER w >= 63 THEN covar_pop(x, y) OVER w / nullif(stddev_pop(x) OVER w * stddev_pop(y) OVER w, 0) END AS corr FROM p
  WINDOW w AS (PARTITION BY "left", "right" ORDER BY session ROWS 62 PRECEDING)) SELECT "left", "right", session, {_r('corr')} FROM c""")
def pairwise_corr(spark, sf_dir):
    return rolling.pair_correlation(returns(spark, sf_dir))


def _projected(state: str) -> str:
    return f"""joined AS (SELECT symbol, session, last_value(state IGNORE NULLS) {W}) AS carried FROM bars LEFT JOIN {state} USING (symbol, session))
SELECT symbol, session, lag(carried) {W}) AS state FROM joined"""


@query(f"""WITH {MONTHS}, m AS (SELECT symbol, session, close, CASE WHEN count(close) {W} ROWS 9 PRECEDING) >= 10 THEN avg(close) {W} ROWS 9 PRECEDING) END AS mean FROM ends),
s AS (SELECT symbol, session, CASE WHEN mean IS NOT NULL THEN CASE WHEN close > mean THEN 'Risk-on' ELSE 'Risk-off' END END AS state FROM m), {_projected('s')}""")
def faber_state(spark, sf_dir):
    return rolling.moving_average_state(bars(spark, sf_dir))


@query(f"""WITH {MONTHS}, m AS (SELECT symbol, session, lag(close, 1) {W}) / lag(close, 25) {W}) - 1 AS past FROM ends),
s AS (SELECT symbol, session, CASE WHEN past < 0 THEN 'Bear' WHEN past IS NOT NULL THEN 'Not bear' END AS state FROM m), {_projected('s')}""")
def bear_state(spark, sf_dir):
    return rolling.past_return_state(bars(spark, sf_dir))


@query(f"""WITH {RETURNS}, m AS (SELECT symbol, session, {", ".join(f"CASE WHEN row_number() {W}) >= {n} AND count(ret) {W} ROWS {n - 1} PRECEDING) >= {need} THEN exp(sum(coalesce(ln(1 + ret), 0)) {W} ROWS {n - 1} PRECEDING)) - 1 END AS m{n}" for n, need in ((21, 21), (63, 63), (252, 252)))},
  CASE WHEN row_number() {W}) >= 252 AND count(ret) {W} ROWS 251 PRECEDING) >= 200 THEN exp(sum(coalesce(ln(1 + ret), 0)) {W} ROWS 251 PRECEDING)) - 1 END AS momentum FROM returns),
b AS (SELECT *, (sign(m21) + sign(m63) + sign(m252)) / 3.0::DOUBLE AS blend FROM m) SELECT symbol, session, {_r('momentum', 'blend')} FROM b""")
def compounded_momentum(spark, sf_dir):
    r = rolling.compounded(returns(spark, sf_dir), 252, 200)
    return rolling.blended_signs(r).select("symbol", "session", "momentum", "blend")


@query(f"""WITH {RETURNS}, c AS (SELECT symbol, session, sum(coalesce(ln(1 + ret), 0)) {W}) AS c, row_number() {W})::DOUBLE AS s FROM returns),
f AS (SELECT symbol, session, s, sum(c) {W} ROWS 251 PRECEDING) AS y, sum(s * c) {W} ROWS 251 PRECEDING) AS ty, sum(c * c) {W} ROWS 251 PRECEDING) AS yy FROM c),
g AS (SELECT *, ty - (s - 125.5) * y AS sty, yy - y * y / 252 AS syy, 252.0::DOUBLE * (252 * 252 - 1) / 12 AS stt FROM f),
t AS (SELECT symbol, session, CASE WHEN s >= 252 THEN (sty / stt) / nullif(sqrt(greatest(syy - sty * sty / stt, 0) / 250 / stt), 0) END AS t FROM g) SELECT symbol, session, round(t, 4) + 0.0::DOUBLE AS t FROM t""")
def time_trend_t(spark, sf_dir):
    return rolling.time_trend_t(returns(spark, sf_dir)).select("symbol", "session", F.round("t", 4).alias("t"))


@query(f"""WITH {RETURNS}, {VOL}, s AS (SELECT *, sign(close - lag(close, 252) {W})) AS signal FROM bars JOIN vol USING (symbol, session)),
w AS (SELECT symbol, session, CASE WHEN signal IS NOT NULL AND vol > 0 THEN signal * 0.1::DOUBLE / vol / sum(CASE WHEN signal IS NOT NULL AND vol > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY session) END AS weight FROM s)
SELECT symbol, session, {_r('weight')} FROM w""")
def inverse_vol_weights(spark, sf_dir):
    both = rolling.realized_volatility(rolling.trend_sign(returns(spark, sf_dir)))
    return rolling.inverse_vol_weights(both).select("symbol", "session", "weight")


@query(f"""WITH {RETURNS}, v AS (SELECT symbol, session, CASE WHEN count(ret) {W} ROWS 125 PRECEDING) >= 126 THEN sqrt(avg(ret * ret) {W} ROWS 125 PRECEDING) * 252) END AS vol FROM returns),
s AS (SELECT symbol, session, lag(CASE WHEN vol > 0 THEN least(2.0::DOUBLE, greatest(0.0::DOUBLE, 12.0::DOUBLE / vol)) END) {W}) AS scale FROM v) SELECT symbol, session, {_r('scale')} FROM s""")
def barroso_scale(spark, sf_dir):
    r = returns(spark, sf_dir)
    out = rolling.volatility_scale(r, budget=12.0)
    return out.select("symbol", "session", "scale")


@query(f"""WITH RECURSIVE {RETURNS}, n AS (SELECT symbol, session, ret, row_number() {W}) AS i FROM returns),
e AS (SELECT symbol, i, session, 0.0::DOUBLE AS m, 0.0::DOUBLE AS c, 1.0::DOUBLE AS w2, 0 AS k FROM n WHERE i = 1
  UNION ALL SELECT n.symbol, n.i, n.session, CASE WHEN k = 0 THEN n.ret ELSE (60.0/61) * m + n.ret / 61.0 END,
    CASE WHEN k = 0 THEN 0 ELSE (60.0/61) * (c + pow(m - ((60.0/61) * m + n.ret / 61.0), 2)) + pow(n.ret - ((60.0/61) * m + n.ret / 61.0), 2) / 61.0 END,
    CASE WHEN k = 0 THEN 1 ELSE w2 * pow(60.0/61, 2) + pow(1/61.0, 2) END, k + 1 FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1),
v AS (SELECT symbol, session, CASE WHEN k >= 20 THEN sqrt(c / (1 - w2)) * sqrt(252::DOUBLE) END AS vol FROM e) SELECT symbol, session, {_r('vol')} FROM v""")
def ewm_vol(spark, sf_dir):
    return rolling.ewm_volatility(returns(spark, sf_dir)).select("symbol", "session", "vol")


P = "OVER (PARTITION BY member ORDER BY session"
WEALTH = f"""{PATHS}, nav AS (SELECT *, exp(sum(ln(1 + ret)) {P})) AS nav FROM paths), peak AS (SELECT *, greatest(1.0::DOUBLE, max(nav) {P})) AS peak FROM nav),
wealth AS (SELECT *, nav / peak - 1 AS drawdown FROM peak)"""


@query(f"""WITH {PATHS}, m AS (SELECT member, CAST(date_trunc('month', session) AS DATE) AS month, exp(sum(ln(1 + ret))) - 1 AS ret, count(ret) AS n FROM paths GROUP BY ALL) SELECT member, month, {_r('ret')}, n FROM m""")
def monthly_returns(spark, sf_dir):
    return performance.monthly_returns(paths(spark, sf_dir))


_PATH = ("years", "vol", "sharpe", "sortino", "downside", "profit_factor", "win_rate", "skew", "excess_kurtosis", "autocorrelation", "max_drawdown", "best_day", "worst_day", "worst_5", "worst_21", "peak_vol", "cagr", "calmar", "hac_sharpe", "var95", "cvar95", "monthly_sharpe", "positive_months", "best_month", "worst_month")


@query(f"""WITH {PATHS}, f AS (SELECT *, coalesce(lag(session) {P}), session) AS since, row_number() {P}) AS i, lag(ret) {P}) AS before, product(1 + ret) {P}) AS equity, ret - avg(ret) OVER (PARTITION BY member) AS d, quantile_cont(ret, 0.05) OVER (PARTITION BY member) AS cut FROM paths),
g AS (SELECT *, equity / greatest(1.0::DOUBLE, max(equity) {P})) - 1 AS dd, {", ".join(f"lag(d, {k}) {P}) AS l{k}" for k in range(1, 22))}, {", ".join(f"CASE WHEN count(ret) {P} ROWS {k - 1} PRECEDING) = {k} THEN product(1 + ret) {P} ROWS {k - 1} PRECEDING) - 1 END AS w{k}" for k in (5, 21))}, CASE WHEN count(ret) {P} ROWS 62 PRECEDING) = 63 THEN stddev_samp(ret) {P} ROWS 62 PRECEDING) END AS v63 FROM f),
h AS (SELECT *, i - coalesce(max(CASE WHEN NOT dd < -1e-12 THEN i END) {P}), 0) AS streak FROM g), mo AS (SELECT member, date_trunc('month', session) AS m, product(1 + ret) - 1 AS r FROM paths GROUP BY ALL),
mm AS (SELECT member, avg(r) / stddev_samp(r) * sqrt(12::DOUBLE) AS monthly_sharpe, avg((r > 0)::INT) AS positive_months, max(r) AS best_month, min(r) AS worst_month FROM mo GROUP BY member),
a AS (SELECT member, count(*) AS n, min(since) AS period_start, greatest(max(session) - min(since), 1) / 365.2425 AS years, product(1 + ret) AS grown, stddev_samp(ret) * sqrt(252::DOUBLE) AS vol, avg(ret) / stddev_samp(ret) * sqrt(252::DOUBLE) AS sharpe, avg(ret) AS mean, avg(ret) * 252 / (sqrt(avg(pow(least(ret, 0), 2))) * sqrt(252::DOUBLE)) AS sortino, sqrt(avg(pow(least(ret, 0), 2))) * sqrt(252::DOUBLE) AS downside,
  sum(ret) FILTER (ret > 0) / -sum(ret) FILTER (ret < 0) AS profit_factor, avg((ret > 0)::INT) AS win_rate, skewness(ret) AS skew, kurtosis(ret) AS excess_kurtosis, corr(ret, before) AS autocorrelation, min(dd) AS max_drawdown, CAST(max(streak) AS INTEGER) AS max_duration, max(ret) AS best_day, min(ret) AS worst_day, min(w5) AS worst_5, min(w21) AS worst_21, max(v63) * sqrt(252::DOUBLE) AS peak_vol,
  -any_value(cut) AS var95, -avg(ret) FILTER (ret <= cut) AS cvar95, (sum(d * d) + {" + ".join(f"2 * (1 - {k} / 22.0::DOUBLE) * coalesce(sum(d * l{k}), 0)" for k in range(1, 22))}) / (count(*) - 1) AS lrv FROM h GROUP BY member),
z AS (SELECT *, pow(grown, 1 / years) - 1 AS cagr, (pow(grown, 1 / years) - 1) / -max_drawdown AS calmar, mean / sqrt(lrv) * sqrt(252::DOUBLE) AS hac_sharpe FROM a JOIN mm USING (member))
SELECT member, n, period_start, {_r('mean')}, max_duration, {_r(*_PATH)} FROM z""")
def path_metrics(spark, sf_dir):
    return performance.path_metrics(paths(spark, sf_dir))


FLAGSHIP = QUERIES["path_metrics"]


@query(f"""WITH {WEALTH}, x AS (SELECT *, CASE WHEN count(ret) {P} ROWS 20 PRECEDING) = 21 THEN exp(sum(ln(1 + ret)) {P} ROWS 20 PRECEDING)) - 1 END AS w21, CASE WHEN count(ret) {P} ROWS 62 PRECEDING) = 63 THEN exp(sum(ln(1 + ret)) {P} ROWS 62 PRECEDING)) - 1 END AS w63 FROM wealth),
m AS (SELECT member, min(drawdown) / (stddev_samp(ret) * sqrt(252::DOUBLE)) AS drawdown_to_vol, sqrt(avg(drawdown * drawdown)) AS ulcer, avg(-drawdown) AS pain, min(w21) AS worst_21, min(w63) AS worst_63 FROM x GROUP BY member)
SELECT member, {_r('drawdown_to_vol', 'ulcer', 'pain', 'worst_21', 'worst_63')} FROM m""")
def loss_shape(spark, sf_dir):
    return performance.loss_shape(paths(spark, sf_dir))


EPISODES = f"""{WEALTH}, u AS (SELECT *, drawdown < -1e-12 AS under, max(session) OVER (PARTITION BY member) AS last FROM wealth),
s AS (SELECT *, sum(CASE WHEN under THEN 0 ELSE 1 END) {P}) AS spell FROM u),
episodes AS (SELECT member, min(session) AS start, arg_min(session, (drawdown, session)) AS trough, max(session) AS "end", count(*) AS sessions, min(drawdown) AS depth, max(session) < any_value(last) AS recovered FROM s WHERE under GROUP BY member, spell HAVING min(drawdown) < -0.02)"""


@query(f"""WITH {EPISODES} SELECT member, start, trough, "end", sessions, {_r('depth')}, recovered FROM episodes""")
def drawdown_episodes(spark, sf_dir):
    return performance.drawdown_episodes(paths(spark, sf_dir))


@query(f"""WITH {EPISODES}, c AS (SELECT e.member, e.start, p.member AS symbol, sum(p.ret) AS contribution FROM episodes e JOIN paths p ON p.session >= e.start AND p.session <= e.trough GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY member, start ORDER BY round(contribution, 9), symbol) AS rank FROM c) SELECT member, start, symbol, {_r('contribution')}, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 2""")
def episode_attribution(spark, sf_dir):
    p = paths(spark, sf_dir)
    return performance.episode_attribution(performance.drawdown_episodes(p), p.select("session", F.col("member").alias("symbol"), F.col("ret").alias("contribution")))


@query(f"""WITH {PATHS}, s AS (SELECT member, session, multiplier, ret * multiplier AS ret FROM paths CROSS JOIN (SELECT unnest([0.5, 1.0, 2.0]::DOUBLE[]) AS multiplier)),
n AS (SELECT *, exp(sum(ln(1 + ret)) OVER w) AS nav FROM s WINDOW w AS (PARTITION BY member, multiplier ORDER BY session)), d AS (SELECT *, nav / greatest(1.0::DOUBLE, max(nav) OVER (PARTITION BY member, multiplier ORDER BY session)) - 1 AS dd FROM n),
m AS (SELECT member, multiplier, pow(product(1 + ret), 1 / (greatest(max(session) - min(session), 1) / 365.2425)) - 1 AS cagr, stddev_samp(ret) * sqrt(252::DOUBLE) AS vol, min(dd) AS max_drawdown FROM d GROUP BY ALL) SELECT member, {_r('multiplier', 'cagr', 'vol', 'max_drawdown')} FROM m""")
def rescale_frontier(spark, sf_dir):
    return performance.rescale_frontier(paths(spark, sf_dir), [0.5, 1.0, 2.0])


@query(f"""WITH {PATHS}, t AS (SELECT member AS symbol, ret AS contribution, sum(ret) OVER (PARTITION BY session) AS total FROM paths), m AS (SELECT symbol, covar_pop(contribution, total) / var_pop(total) AS risk_share, avg(contribution) AS mean_contribution FROM t GROUP BY symbol) SELECT symbol, {_r('risk_share', 'mean_contribution')} FROM m""")
def risk_share(spark, sf_dir):
    return performance.risk_share(paths(spark, sf_dir).select("session", F.col("member").alias("symbol"), F.col("ret").alias("contribution")))


@query(f"""WITH {BARS}, life AS (SELECT symbol, min(session) AS "first", max(session) AS "last", count(*) AS sessions FROM bars GROUP BY symbol), cal AS (SELECT DISTINCT session FROM bars),
d AS (SELECT l.symbol, c.session, b.symbol IS NOT NULL AS there FROM life l JOIN cal c ON c.session BETWEEN l."first" AND l."last" LEFT JOIN bars b ON b.symbol = l.symbol AND b.session = c.session),
r AS (SELECT symbol, run, count(*) AS n FROM (SELECT *, sum(there::INT) {W}) AS run FROM d) WHERE NOT there GROUP BY ALL)
SELECT l.*, CAST(coalesce((SELECT sum(n) FROM r WHERE r.symbol = l.symbol), 0) AS BIGINT) AS missing, coalesce((SELECT max(n) FROM r WHERE r.symbol = l.symbol), 0) AS longest_gap FROM life l""")
def coverage_gaps(spark, sf_dir):
    return audit.coverage_gaps(bars(spark, sf_dir))


COSTS = f"""{FILLS}, c AS (SELECT *, (bid + ask) / 2 AS mid, (ask - bid) / 2 AS half_spread, quantity / interval_volume AS participation, date_diff('day', arrival, filled) AS latency_days FROM fills),
d AS (SELECT *, CASE WHEN side = 'BUY' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * (price - mid) AS shortfall FROM c),
costs AS (SELECT *, shortfall - half_spread AS residual, (shortfall - half_spread) / mid * 10000 AS residual_bps,
  CASE WHEN participation <= 0.005 THEN '0-0.5%' WHEN participation <= 0.01 THEN '0.5-1%' WHEN participation <= 0.02 THEN '1-2%' WHEN participation <= 0.05 THEN '2-5%' ELSE '>5%' END AS bucket FROM d)"""


@query(f"""WITH {COSTS} SELECT order_id, root, contract, side, {_r('quantity', 'mid', 'half_spread', 'shortfall', 'residual', places=8)}, CAST(latency_days AS INTEGER) AS latency_days, bucket FROM costs""", places=8)
def fill_costs(spark, sf_dir):
    return audit.fill_costs(fills(spark, sf_dir)).select("order_id", "root", "contract", "side", "quantity", "mid", "half_spread", "shortfall", "residual", "latency_days", "bucket")


@query(f"""WITH {COSTS}, o AS (SELECT order_id, sum(quantity) AS quantity, sum(quantity * shortfall) / sum(quantity) AS shortfall, sum(fees) AS fees, max(interval_volume) AS interval_volume, CAST(max(latency_days) AS INTEGER) AS latency_days, count(*) AS fills FROM costs GROUP BY order_id)
SELECT order_id, {_r('quantity', 'shortfall', 'fees', 'interval_volume', places=8)}, latency_days, fills FROM o""", places=8)
def order_costs(spark, sf_dir):
    return audit.order_costs(audit.fill_costs(fills(spark, sf_dir)))


@query(f"""WITH {COSTS}, o AS (SELECT root, count(*) AS fills, count(DISTINCT order_id) AS orders, count(DISTINCT filled) AS sessions, count(DISTINCT bucket) AS buckets, quantile_cont(shortfall, 0.5) AS p50, quantile_cont(shortfall, 0.75) AS p75, quantile_cont(shortfall, 0.95) AS p95, greatest(0.0::DOUBLE, quantile_cont(residual_bps / sqrt(participation), 0.75)) AS impact FROM costs GROUP BY root)
SELECT root, fills, orders, sessions, buckets, {_r('p50', 'p75', 'p95', 'impact')} FROM o""")
def cost_calibration(spark, sf_dir):
    return audit.cost_calibration(audit.fill_costs(fills(spark, sf_dir)))


@query("""WITH a AS (SELECT c_custkey AS customer, CAST(c_acctbal AS DOUBLE) AS amount FROM customer), b AS (SELECT o_custkey AS customer, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM orders GROUP BY 1)
SELECT customer, round(coalesce(a.amount, 0), 6) + 0.0::DOUBLE AS internal, round(coalesce(b.amount, 0), 6) + 0.0::DOUBLE AS external, CASE WHEN abs(coalesce(a.amount, 0) - coalesce(b.amount, 0)) <= 1000 THEN 'PASS' ELSE 'BREAK' END AS status FROM a FULL JOIN b USING (customer)""")
def reconciliation(spark, sf_dir):
    ours = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer"), F.col("c_acctbal").cast("double").alias("amount"))
    theirs = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("customer")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("amount"))
    return audit.reconcile(ours, theirs, "customer", "amount", 1000.0)


@query(f"""WITH {FILLS}, m AS (SELECT root, arrival AS day, 0 AS kind, 1 AS change FROM fills UNION ALL SELECT root, filled, 1, -1 FROM fills), d AS (SELECT root, day, kind, sum(change) AS change FROM m GROUP BY ALL),
l AS (SELECT root, sum(change) OVER (PARTITION BY root ORDER BY day, kind) AS level FROM d) SELECT root, CAST(max(level) AS BIGINT) AS peak FROM l GROUP BY root""")
def peak_concurrency(spark, sf_dir):
    return audit.peak_concurrency(fills(spark, sf_dir), "root", "arrival", "filled")


ORDER_EVENTS = """ev AS (SELECT user_id AS key, event_id, ts, CASE event_type WHEN 'signup' THEN 'OUTBOX' WHEN 'view' THEN 'ACK' WHEN 'error' THEN 'REJECT' ELSE 'FILL' END AS event FROM events)"""


def order_events(spark, sf_dir):
    return _orders(read(spark, sf_dir, "events"))


def _orders(events: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "OUTBOX").when(F.col("event_type") == "view", "ACK").when(F.col("event_type") == "error", "REJECT").otherwise("FILL")
    return events.select(F.col("user_id").alias("key"), "event_id", "ts", kind.alias("event"))


@query(f"""WITH {ORDER_EVENTS}, l AS (SELECT *, lag(event) OVER (PARTITION BY key ORDER BY ts, event_id) AS before, row_number() OVER (PARTITION BY key, event_id ORDER BY ts) AS seen FROM ev)
SELECT key, count(*) AS events, CAST(sum(CASE WHEN (before IS NULL AND event = 'OUTBOX') OR (before = 'OUTBOX' AND event IN ('ACK', 'REJECT')) OR (before = 'ACK' AND event IN ('FILL', 'REJECT', 'ACK')) OR (before = 'FILL' AND event IN ('FILL', 'ACK')) OR (before = 'REJECT' AND event = 'OUTBOX') THEN 0 ELSE 1 END) AS BIGINT) AS illegal,
  CAST(sum(CASE WHEN seen > 1 THEN 1 ELSE 0 END) AS BIGINT) AS repeated, CAST(sum(CASE WHEN event = 'FILL' THEN 1 ELSE 0 END) AS BIGINT) AS fills, arg_max(event, (ts, event_id)) AS state FROM l GROUP BY key""")
def order_state_replay(spark, sf_dir):
    return audit.replay_orders(order_events(spark, sf_dir))


@query("""WITH e AS (SELECT user_id AS journal, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) + CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END AS sequence, ts, sha256(concat(event_id, ':', event_type)) AS record_hash FROM events),
c AS (SELECT *, CASE WHEN ascii(record_hash) = 48 THEN 'tampered' ELSE lag(record_hash) OVER (PARTITION BY journal ORDER BY sequence, ts, record_hash) END AS previous_hash FROM e),
l AS (SELECT *, lag(sequence) OVER w AS s0, lag(record_hash) OVER w AS h0, lag(ts) OVER w AS t0 FROM c WINDOW w AS (PARTITION BY journal ORDER BY sequence, ts, record_hash))
SELECT journal, count(*) AS entries, CAST(sum(CASE WHEN s0 IS NOT NULL AND sequence <> s0 + 1 THEN 1 ELSE 0 END) AS BIGINT) AS sequence_breaks, CAST(sum(CASE WHEN h0 IS NOT NULL AND previous_hash <> h0 THEN 1 ELSE 0 END) AS BIGINT) AS hash_breaks, CAST(sum(CASE WHEN ts < t0 THEN 1 ELSE 0 END) AS BIGINT) AS time_breaks FROM l GROUP BY journal""")
def chain_audit(spark, sf_dir):
    own = Window.partitionBy("journal").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events").withColumn("journal", F.col("user_id"))
    e = e.withColumn("sequence", F.row_number().over(own) + F.when(F.col("event_id") % 97 == 0, 1).otherwise(0)).withColumn("record_hash", F.sha2(F.concat_ws(":", "event_id", "event_type"), 256))
    chained = Window.partitionBy("journal").orderBy("sequence", "ts", "record_hash")
    e = e.withColumn("previous_hash", F.when(F.ascii("record_hash") == 48, "tampered").otherwise(F.lag("record_hash").over(chained)))
    return audit.chain_audit(e, order=("sequence", "ts", "record_hash"))


@query(f"""WITH {PATHS}, d AS (SELECT member, session, ret, ret - avg(ret) OVER (PARTITION BY member) AS d FROM paths), l AS (SELECT *, {", ".join(f"lag(d, {k}) {P}) AS l{k}" for k in range(1, 22))} FROM d),
s AS (SELECT member, count(*) AS n, avg(ret) AS mean, sqrt(greatest(sum(d * d) + {" + ".join(f"2 * (1 - {k} / 22.0::DOUBLE) * coalesce(sum(d * l{k}), 0)" for k in range(1, 22))}, 0)) / count(*) AS se FROM l GROUP BY member),
t AS (SELECT *, mean / se AS t FROM s) SELECT member, n, {_r('mean', 'se', 't')} FROM t""")
def hac_se(spark, sf_dir):
    return inference.hac_standard_error(paths(spark, sf_dir))


_SPLITS = """b AS (SELECT member, ret, 15 - CAST(floor((row_number() OVER (PARTITION BY member ORDER BY session DESC) - 1) / (count(*) OVER (PARTITION BY member) // 16)) AS INTEGER) AS block FROM paths), s AS (SELECT member, block, count(*) AS n, sum(ret) AS s, sum(ret * ret) AS q FROM b WHERE block >= 0 GROUP BY ALL),
h AS (SELECT id FROM (SELECT unnest(range(65536)) AS id) WHERE bit_count(CAST(id AS INTEGER)) = 8), t AS (SELECT id, (id >> (15 - block)) & 1 = 1 AS inside, member, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM s CROSS JOIN h GROUP BY ALL), r AS (SELECT *, round((s / n) / nullif(sqrt(greatest(q / n - pow(s / n, 2), 0)), 0), 12) AS sharpe FROM t),
f AS (SELECT id, member AS chosen FROM r WHERE inside QUALIFY row_number() OVER (PARTITION BY id ORDER BY sharpe DESC, member) = 1),
o AS (SELECT id, member, sharpe, rank() OVER (PARTITION BY id ORDER BY sharpe) - 1 AS below, count(*) OVER (PARTITION BY id, sharpe) AS ties, count(*) OVER (PARTITION BY id) AS many FROM r WHERE NOT inside),
x AS (SELECT 65536 - o.id AS split, chosen, (below + (ties + 1) / 2.0::DOUBLE) / (many + 1) AS relative_rank, sharpe AS outside_sharpe FROM o JOIN f ON o.id = f.id AND o.member = f.chosen), z AS (SELECT *, ln(relative_rank / (1 - relative_rank)) AS logit FROM x)"""


@query(f"""WITH {PATHS}, {_SPLITS} SELECT split, chosen, {_r('relative_rank', 'outside_sharpe', 'logit')}, logit <= 0 AS overfit FROM z""")
def cscv_splits(spark, sf_dir):
    return inference.cscv_splits(paths(spark, sf_dir))


@query(f"""WITH {PATHS}, {_SPLITS}, c AS (SELECT CAST(count(*) AS INTEGER) AS each FROM paths GROUP BY member LIMIT 1)
SELECT 'ESTIMATED' AS status, '' AS reason, 16 AS blocks, CAST(any_value(each) // 16 AS INTEGER) AS rows_a_block, CAST(any_value(each) % 16 AS INTEGER) AS dropped, 6 AS members, count(*) AS splits, round(avg((logit <= 0)::INT), 6) + 0.0::DOUBLE AS pbo, round(avg((outside_sharpe < 0)::INT), 6) + 0.0::DOUBLE AS loss FROM z, c""")
def cscv_pbo(spark, sf_dir):
    return inference.cscv_report(paths(spark, sf_dir), need_members=6, need_rows=12)


YEARS = list(range(1993, 1999))


@query(f"""WITH {PATHS}, y AS (SELECT unnest({YEARS}) AS fold), tr AS (SELECT fold, member, round(avg(ret) / nullif(stddev_pop(ret), 0), 12) AS score, count(*) AS train_n FROM paths JOIN y ON year(session) < fold GROUP BY ALL),
b AS (SELECT * FROM tr QUALIFY row_number() OVER (PARTITION BY fold ORDER BY score DESC, member) = 1), te AS (SELECT fold, member, exp(sum(ln(1 + ret))) - 1 AS test_return, count(*) AS test_n FROM paths JOIN y ON year(session) = fold GROUP BY ALL)
SELECT fold, member, {_r('score')}, train_n, {_r('test_return')}, test_n FROM b JOIN te USING (fold, member)""")
def walk_forward_select(spark, sf_dir):
    return inference.walk_forward(paths(spark, sf_dir), YEARS)


LEDGER = f"""{BARS}, pos AS (SELECT symbol, session, close, CASE WHEN volume::BIGINT % 11 = 0 THEN 0 ELSE coalesce(sign(close - lag(close, 21) {W})) * (1 + volume::BIGINT % 3), 0) END::DOUBLE AS position FROM bars),
ledger AS (SELECT *, coalesce(lag(position) {W}), 0) AS before, coalesce(lag(position) {W}) * (close - lag(close) {W})), 0) AS gross, 0.5::DOUBLE * abs(position - coalesce(lag(position) {W}), 0)) AS cost FROM pos)"""
TRADES = f"""{LEDGER}, o AS (SELECT *, sign(position) <> sign(before) AND position <> 0 AS opens, sign(position) <> sign(before) AND before <> 0 AS closes FROM ledger), k AS (SELECT *, sum(opens::INT) {W}) AS number FROM o),
legs AS (SELECT symbol, session, number - opens::INT AS episode, sign(before)::INT AS direction, gross, cost * CASE WHEN opens AND closes THEN abs(before) / (abs(before) + abs(position)) ELSE 1.0::DOUBLE END AS cost, closes AS closed, NOT closes AND position <> before AS resized FROM k WHERE before <> 0
  UNION ALL SELECT symbol, session, number, sign(position)::INT, 0.0::DOUBLE, cost * CASE WHEN closes THEN abs(position) / (abs(before) + abs(position)) ELSE 1.0::DOUBLE END, false, false FROM k WHERE opens),
r AS (SELECT *, sum(gross - cost) OVER (PARTITION BY symbol, episode ORDER BY session) AS running FROM legs),
trades AS (SELECT symbol, episode::BIGINT AS episode, any_value(direction) AS direction, min(session) AS entry, max(session) FILTER (closed) AS "exit", count(*) - 1 AS sessions, count(*) FILTER (resized) AS resizes, sum(gross) AS gross, sum(cost) AS cost, sum(gross - cost) AS net,
  greatest(max(running), 0) AS mfe, least(min(running), 0) AS mae FROM r GROUP BY symbol, episode)"""


def trades(spark, sf_dir):
    by = Window.partitionBy("symbol").orderBy("session")
    whole = F.col("volume").cast("long")
    size = F.when(whole % 11 == 0, 0.0).otherwise(F.coalesce(F.signum(F.col("close") - F.lag("close", 21).over(by)) * (1 + whole % 3), F.lit(0.0)))
    return episodes.trade_episodes(episodes.ledger(bars(spark, sf_dir).select("symbol", "session", "close", size.alias("position")), 0.5))


@query(f"""WITH {TRADES} SELECT symbol, episode, direction, entry, "exit", sessions, resizes, {_r('gross', 'cost', 'net', 'mfe', 'mae')} FROM trades""")
def trade_episodes(spark, sf_dir):
    return trades(spark, sf_dir)


@query(f"""WITH {TRADES}, m AS (SELECT symbol, count("exit") AS closed, count(*) - count("exit") AS open, count(*) FILTER ("exit" IS NOT NULL AND net > 0.01) AS wins, count(*) FILTER ("exit" IS NOT NULL AND net < -0.01) AS losses,
  sum(net) FILTER ("exit" IS NOT NULL AND net > 0.01) / -sum(net) FILTER ("exit" IS NOT NULL AND net < -0.01) AS profit_factor, avg(net) FILTER ("exit" IS NOT NULL) AS expectancy, avg(net) FILTER ("exit" IS NOT NULL AND net > 0.01) / -avg(net) FILTER ("exit" IS NOT NULL AND net < -0.01) AS payoff,
  quantile_cont(sessions, 0.5) FILTER ("exit" IS NOT NULL)::DOUBLE AS median_holding FROM trades GROUP BY symbol) SELECT symbol, closed, open, wins, losses, {_r('profit_factor', 'expectancy', 'payoff', 'median_holding')} FROM m""")
def trade_episode_metrics(spark, sf_dir):
    return episodes.episode_metrics(trades(spark, sf_dir))


def _hac(source: str) -> str:
    """CTE ``hac`` (member, n, mean, se) of a CTE (member, session, ret)."""
    return f"""hd AS (SELECT member, session, ret, ret - avg(ret) OVER (PARTITION BY member) AS d FROM {source}), hl AS (SELECT *, {", ".join(f"lag(d, {k}) {P}) AS l{k}" for k in range(1, 22))} FROM hd),
hac AS (SELECT member, count(*) AS n, avg(ret) AS mean, sqrt(greatest(sum(d * d) + {" + ".join(f"2 * (1 - {k} / 22.0::DOUBLE) * coalesce(sum(d * l{k}), 0)" for k in range(1, 22))}, 0)) / count(*) AS se FROM hl GROUP BY member)"""


Z90, Z95 = "1.6448536269514722::DOUBLE", "1.959963984540054::DOUBLE"


@query(f"""WITH {PATHS}, gap AS (SELECT p.member, p.session, p.ret - b.ret AS ret FROM paths p JOIN paths b ON p.session = b.session AND b.member = 'AF' WHERE p.member <> 'AF'), {_hac('gap')},
t AS (SELECT *, mean / se AS t, mean - {Z90} * se AS low, mean + {Z90} * se AS high, {Z90} * se AS detectable FROM hac) SELECT member, n, {_r('mean', 'se', 't', 'low', 'high', 'detectable')} FROM t""")
def paired_hac(spark, sf_dir):
    return inference.paired_hac(paths(spark, sf_dir), "AF")


@query(f"""WITH {PATHS}, j AS (SELECT p.member, p.session, p.ret AS y, b.ret AS x FROM paths p JOIN paths b ON p.session = b.session AND b.member = 'AF' WHERE p.member <> 'AF'),
fit AS (SELECT member, avg(x) AS mx, var_pop(x) AS vx, covar_pop(x, y) / var_pop(x) AS beta, avg(y) - covar_pop(x, y) / var_pop(x) * avg(x) AS a FROM j GROUP BY member),
f AS (SELECT member, session, a + (y - a - beta * x) * (1 - mx * (x - mx) / vx) AS ret FROM j JOIN fit USING (member)), {_hac('f')},
t AS (SELECT hac.*, mean AS alpha, mean / se AS t, beta FROM hac JOIN fit USING (member)) SELECT member, n, {_r('alpha', 'se', 't', 'beta')} FROM t""")
def alpha_report(spark, sf_dir):
    return inference.alpha_report(paths(spark, sf_dir), "AF")


@query(f"""WITH {PATHS}, h AS (SELECT member, count(ret) AS n, avg((ret > 0)::INT) AS rate FROM paths GROUP BY member),
w AS (SELECT *, rate + {Z95} * {Z95} / (2 * n) AS c, {Z95} * sqrt(rate * (1 - rate) / n + {Z95} * {Z95} / (4 * n * n)) AS half, 1 + {Z95} * {Z95} / n AS d FROM h),
b AS (SELECT member, n, rate, (c - half) / d AS low, (c + half) / d AS high FROM w) SELECT member, n, {_r('rate', 'low', 'high')} FROM b""")
def hit_rates(spark, sf_dir):
    return inference.hit_rates(paths(spark, sf_dir))


@query("""WITH need AS (SELECT unnest(['signup', 'view', 'click', 'purchase', 'error', 'settlement']) AS component), l AS (SELECT event_type AS component, max(ts) AS seen FROM events GROUP BY 1),
a AS (SELECT component, CAST(floor(epoch((SELECT max(ts) FROM events))) AS BIGINT) - CAST(floor(epoch(seen)) AS BIGINT) AS age_seconds FROM need LEFT JOIN l USING (component)) SELECT component, age_seconds, CASE WHEN age_seconds <= 1800 THEN 'PASS' ELSE 'BLOCKED' END AS status FROM a""")
def heartbeat_freshness(spark, sf_dir):
    beats = read(spark, sf_dir, "events").select(F.col("event_type").alias("component"), F.col("ts").cast("timestamp").alias("ts"))
    as_of = beats.agg(F.max("ts").cast("string")).first()[0]
    return audit.monitoring(beats, ["signup", "view", "click", "purchase", "error", "settlement"], as_of, 1800).select("component", "age_seconds", "status")


def _stamps(df: DataFrame) -> DataFrame:
    return df.select(*(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes))


STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"


@query(f"""WITH {FILLS}, c AS (SELECT root, filled, quantity, CASE WHEN side = 'BUY' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * (price - (bid + ask) / 2) AS shortfall FROM fills), w AS (SELECT root, CAST(floor(date_diff('day', DATE '1970-01-01', filled) / 30) AS INTEGER) * 30 AS d, count(*) AS fills, sum(quantity) AS quantity, sum(quantity * shortfall) AS cost FROM c GROUP BY ALL)
SELECT root, strftime(DATE '1970-01-01' + d, '%Y-%m-%d %H:%M:%S') AS start, strftime(DATE '1970-01-01' + d + 30, '%Y-%m-%d %H:%M:%S') AS "end", fills, round(quantity, 4) + 0.0::DOUBLE AS quantity, round(cost, 4) + 0.0::DOUBLE AS cost FROM w WHERE DATE '1970-01-01' + d + 30 <= (SELECT max(filled) FROM fills) - INTERVAL 1 HOUR""", places=4)
def stream_cost_rollup(spark, sf_dir):
    line = streams.stream(spark, f"{sf_dir}/lineitem.parquet")
    order, part = read(spark, sf_dir, "orders").select("o_orderkey"), read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    joined = line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    sign = F.when(F.col("l_returnflag") == "R", -1.0).otherwise(1.0)
    mid = (F.col("p_retailprice") * 0.999 + F.col("p_retailprice") * 1.001) / 2
    costs = joined.select(F.col("p_brand").alias("root"), F.col("l_shipdate").alias("ts"), F.col("l_quantity").alias("quantity"), (sign * (F.col("l_extendedprice") / F.col("l_quantity") - mid)).alias("shortfall"))
    return _stamps(streams.finish(streams.cost_rollup(costs, "root", "30 days"), "costs"))


@query(f"""WITH g AS (SELECT *, sum(CASE WHEN ts - before <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)),
w AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS events FROM g GROUP BY user_id, s) SELECT user_id, {STAMP.format('start')}, {STAMP.format('"end"')}, events FROM w WHERE "end" <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_sessions(spark, sf_dir):
    return _stamps(streams.finish(streams.activity_sessions(streams.stream(spark, f"{sf_dir}/events.parquet"), "user_id"), "sessions"))


@query(f"""WITH s AS (SELECT event_type, date_trunc('day', ts) - to_days(CAST(k AS INTEGER)) AS start FROM events CROSS JOIN (SELECT unnest(range(7)) AS k)), w AS (SELECT event_type, s.start::TIMESTAMP AS start, (s.start + INTERVAL 7 DAY)::TIMESTAMP AS "end", count(*) AS events FROM s GROUP BY ALL)
SELECT event_type, {STAMP.format('start')}, {STAMP.format('"end"')}, events FROM w WHERE "end" <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_window_counts(spark, sf_dir):
    return _stamps(streams.finish(streams.window_counts(streams.stream(spark, f"{sf_dir}/events.parquet"), "event_type", "7 days", "1 day"), "windows"))


@query(f"""WITH {ORDER_EVENTS}, l AS (SELECT *, lag(event) OVER (PARTITION BY key ORDER BY ts, event_id) AS before FROM ev)
SELECT key, event_id, before, event FROM l WHERE epoch_ms(ts) < epoch_ms((SELECT max(ts) FROM events)) - 3600000 AND NOT ((before IS NULL AND event = 'OUTBOX') OR (before IS NOT NULL AND ((before = 'OUTBOX' AND event IN ('ACK', 'REJECT')) OR (before = 'ACK' AND event IN ('FILL', 'REJECT', 'ACK')) OR (before = 'FILL' AND event IN ('FILL', 'ACK')) OR (before = 'REJECT' AND event = 'OUTBOX'))))""")
def stream_illegal_transitions(spark, sf_dir):
    return streams.finish(streams.illegal_transitions(_orders(streams.stream(spark, f"{sf_dir}/events.parquet"))), "illegal")
