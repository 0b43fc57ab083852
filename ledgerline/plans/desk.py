"""Queries of ledgers, decisions, reports over windows and paths, states and resampling, with their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators import allocation, episodes, inference, ledgers, performance, regimes, reports, rolling, signals, terms
from ledgerline.operators.panel import align, by_symbol, month_end_rows, truncate
from ledgerline.plans.catalogue import draws_sql, LEDGER, MONTHS, P, RETURNS, STATE, TRADES, VOL, WEALTH, W, _r, query, returns, trades, vol_states
from ledgerline.plans.evidence import CATALOGUE, RATES, _catalogue, _rates
from ledgerline.plans.studies import CHANGES, M, clip, ewm_sql, over, with_trend
from ledgerline.sources.views import BARS, PATHS, bars, paths

# Ledgers -----------------------------------------------------------------------

MARKETS = f"""{LEDGER}, mk0 AS (SELECT l.symbol, l.session, l.close, b.volume, l.position, l.before, l.gross, coalesce(strftime(l.session, '%Y%m') <> lag(strftime(l.session, '%Y%m')) OVER (PARTITION BY l.symbol ORDER BY l.session), false) AS roll, b.volume::BIGINT % 5 <> 0 AS tradeable FROM ledger l JOIN bars b ON b.symbol = l.symbol AND b.session = l.session),
mk1 AS (SELECT *, coalesce(sum(tradeable::INT) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM mk0), mk2 AS (SELECT *, abs(position - before) AS rebalance, CASE WHEN tradeable AND bool_or(roll) OVER (PARTITION BY symbol, g) THEN 2 * abs(before) ELSE 0.0::DOUBLE END AS roll_turnover FROM mk1),
mk3 AS (SELECT *, rebalance + roll_turnover AS turnover, (rebalance + roll_turnover) / volume AS participation, (rebalance + roll_turnover) * 0.5 AS fixed, (rebalance + roll_turnover) * abs(close) * 0.001 * sqrt((rebalance + roll_turnover) / volume) AS impact FROM mk2),
markets AS (SELECT *, fixed + impact AS cost, CASE WHEN turnover > 0 THEN (fixed + impact) * rebalance / turnover ELSE 0.0::DOUBLE END AS regular_cost, CASE WHEN turnover > 0 THEN (fixed + impact) * roll_turnover / turnover ELSE 0.0::DOUBLE END AS roll_cost FROM mk3)"""
DAILY = f"""{MARKETS}, dy0 AS (SELECT session, sum(gross) AS gross, sum(fixed) AS fixed, sum(impact) AS impact, sum(cost) AS cost, sum(rebalance) AS rebalance, sum(roll_turnover) AS roll_turnover, sum(turnover) AS turnover, sum(abs(position * close)) AS notional, sum(abs(position) * 150.0) AS margin, max(participation) AS peak_participation, count(*) FILTER (position <> 0) AS markets, sum(rebalance * abs(close)) AS traded_notional FROM markets GROUP BY session),
dy1 AS (SELECT *, gross - cost AS net, 1e8::DOUBLE + coalesce(sum(gross - cost) OVER (ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior_nav FROM dy0), daily AS (SELECT *, prior_nav + net AS nav, net / prior_nav AS ret, notional / (prior_nav + net) AS gross_multiple, margin / (prior_nav + net) AS margin_fraction FROM dy1)"""


def markets(spark, sf_dir) -> DataFrame:
    by, whole = by_symbol(), F.col("volume").cast("long")
    size = F.when(whole % 11 == 0, 0.0).otherwise(F.coalesce(F.signum(F.col("close") - F.lag("close", 21).over(by)) * (1 + whole % 3), F.lit(0.0)))
    rows = bars(spark, sf_dir).select("symbol", "session", "close", "volume", size.alias("position"))
    held = episodes.ledger(rows, 0.5).drop("cost").withColumn("before", F.coalesce(F.lag("position").over(by), F.lit(0.0)))
    month = F.date_format("session", "yyyyMM")
    held = held.withColumn("roll", F.coalesce(month != F.lag(month).over(by), F.lit(False))).withColumn("tradeable", F.col("volume").cast("long") % 5 != 0)
    return ledgers.execution_costs(ledgers.roll_turnover(held), 0.5, 10.0)


def daily(spark, sf_dir) -> DataFrame:
    rows = markets(spark, sf_dir)
    traded = rows.groupBy("session").agg(F.sum(F.col("rebalance") * F.abs("close")).alias("traded_notional"))
    return ledgers.portfolio(rows, 1e8, 150.0).join(traded, "session")


@query(f"WITH {MARKETS} SELECT symbol, session, {_r('position', 'gross')}, roll, tradeable, {_r('roll_turnover', 'participation', 'fixed', 'impact', 'regular_cost', 'roll_cost')} FROM markets")
def market_ledger(spark, sf_dir):
    return markets(spark, sf_dir).select("symbol", "session", "position", "gross", "roll", "tradeable", "roll_turnover", "participation", "fixed", "impact", "regular_cost", "roll_cost")


@query(f"WITH {DAILY} SELECT session, {_r('gross', 'cost', 'net', 'prior_nav', 'nav', places=4)}, {_r('ret', 'gross_multiple', 'margin_fraction', places=9)}, markets FROM daily", places=9)
def portfolio_ledger(spark, sf_dir):
    return daily(spark, sf_dir).select("session", *(F.round(c, 4).alias(c) for c in ("gross", "cost", "net", "prior_nav", "nav")), "ret", "gross_multiple", "margin_fraction", "markets")


@query(f"""WITH {DAILY}, c AS (SELECT unnest(['market_gross_to_portfolio', 'market_costs_to_portfolio', 'fixed_and_impact_to_cost', 'net_result', 'nav_recursion', 'net_return', 'nav_positive', 'costs_not_negative', 'positions_to_trades', 'episodes_to_gross', 'episodes_to_costs']) AS "check")
SELECT "check", CASE WHEN (SELECT min(nav) FROM daily) > 0 AND (SELECT min(cost) FROM daily) >= 0 THEN 'PASS' ELSE 'BLOCKED' END AS status FROM c""")
def ledger_checks(spark, sf_dir):
    rows = markets(spark, sf_dir)
    return ledgers.identity_checks(rows, ledgers.portfolio(rows, 1e8, 150.0), episodes.trade_episodes(rows.select("symbol", "session", "position", "gross", "cost")), tolerance=1e-5).select("check", "status")


@query(f"""WITH {DAILY}, y AS (SELECT greatest((max(session) - min(session)) / 365.2425, 1e-9) AS years FROM daily),
t AS (SELECT sum(rebalance) / any_value(years) AS rebalance_a_year, sum(roll_turnover) / any_value(years) AS roll_a_year, sum(turnover) / any_value(years) AS total_a_year, sum(roll_turnover) / sum(turnover) AS roll_share, quantile_cont(peak_participation, 0.999) AS participation_p999, sum(traded_notional / prior_nav) / any_value(years) AS notional_a_year FROM daily, y) SELECT {_r('rebalance_a_year', 'roll_a_year', 'total_a_year', 'roll_share', 'participation_p999', 'notional_a_year')} FROM t""")
def turnover_report(spark, sf_dir):
    return ledgers.turnover_report(daily(spark, sf_dir))


@query(f"""WITH {DAILY}, e AS (SELECT avg(cost / prior_nav) * 252 AS cost_drag, avg(fixed / prior_nav) * 252 AS fixed_drag, avg(impact / prior_nav) * 252 AS impact_drag, avg(gross_multiple) AS mean_gross, max(gross_multiple) AS peak_gross, avg(margin_fraction) AS mean_margin, max(margin_fraction) AS peak_margin, max(peak_participation) AS peak_participation, avg(markets) AS markets_held FROM daily)
SELECT {_r('cost_drag', 'fixed_drag', 'impact_drag', 'mean_gross', 'peak_gross', 'mean_margin', 'peak_margin', 'peak_participation', 'markets_held', places=9)} FROM e""", places=9)
def exposure_report(spark, sf_dir):
    return ledgers.exposure_report(daily(spark, sf_dir))


@query(f"""WITH {DAILY}, m AS (SELECT CAST(date_trunc('month', session) AS DATE) AS month, product(1 + ret) - 1 AS ret, sum(cost / prior_nav) AS cost, avg(gross_multiple) AS mean_gross, max(gross_multiple) AS peak_gross, max(peak_participation) AS peak_participation, count(*) AS sessions FROM daily GROUP BY 1) SELECT month, {_r('ret', 'cost', 'mean_gross', 'peak_gross', 'peak_participation', places=9)}, sessions FROM m""", places=9)
def month_figures(spark, sf_dir):
    return ledgers.month_figures(daily(spark, sf_dir))


ABS = f"""{WEALTH}, ex AS (SELECT *, abs(ret) * 100 AS exposure FROM wealth)"""


@query(f"""WITH {ABS}, s AS (SELECT member, ret, exposure, unnest([{{'s': 'all'}}, {{'s': CASE WHEN drawdown < -0.03 THEN 'inside' ELSE 'outside' END}}]).s AS sample FROM ex), a AS (SELECT member, sample, count(*) AS sessions, avg(ret) * 252 AS mean, stddev_samp(ret) * sqrt(252::DOUBLE) AS vol, avg((ret > 0)::INT) AS hit_rate, avg(exposure) AS exposure FROM s GROUP BY ALL),
w AS (SELECT member, sessions AS n, vol AS v, hit_rate AS h, exposure AS e FROM a WHERE sample = 'all'), o AS (SELECT a.*, sessions / n AS share, vol / v AS vol_ratio, exposure / e AS exposure_ratio, hit_rate - h AS hit_rate_difference FROM a JOIN w USING (member)) SELECT member, sample, sessions, {_r('mean', 'vol', 'hit_rate', 'exposure', 'share', 'vol_ratio', 'exposure_ratio', 'hit_rate_difference')} FROM o""")
def drawdown_anatomy(spark, sf_dir):
    return ledgers.drawdown_anatomy(paths(spark, sf_dir).withColumn("exposure", F.abs("ret") * 100), "exposure", 0.03)


@query(f"""WITH {PATHS}, c AS (SELECT member, session, ret, abs(coalesce(lag(ret) {P}), 0)) AS x FROM paths), q AS (SELECT member, quantile_cont(x, 0.8) AS threshold FROM c GROUP BY member), l AS (SELECT c.*, threshold, x > threshold AS low, ret * CASE WHEN x > threshold THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS cut FROM c JOIN q USING (member)),
k AS (SELECT member, stddev_samp(ret) / stddev_samp(cut) AS k FROM l GROUP BY member), f AS (SELECT member, session, threshold, low, 'plain' AS form, ret AS r FROM l UNION ALL SELECT member, session, threshold, low, 'conditioned', cut FROM l UNION ALL SELECT l.member, session, threshold, low, 'matched', cut * k FROM l JOIN k USING (member)),
n AS (SELECT *, product(1 + r) OVER (PARTITION BY member, form ORDER BY session) AS nav FROM f), d AS (SELECT *, nav / greatest(1.0::DOUBLE, max(nav) OVER (PARTITION BY member, form ORDER BY session)) - 1 AS dd FROM n),
o AS (SELECT member, form, any_value(threshold) AS threshold, count(*) FILTER (low) AS reduced, pow(product(1 + r), 1 / (greatest(max(session) - min(session), 1) / 365.2425)) - 1 AS cagr, stddev_samp(r) * sqrt(252::DOUBLE) AS vol, avg(r) / stddev_samp(r) * sqrt(252::DOUBLE) AS sharpe, min(dd) AS max_drawdown, -min(dd) / (stddev_samp(r) * sqrt(252::DOUBLE)) AS drawdown_to_vol FROM d GROUP BY ALL)
SELECT member, form, {_r('threshold')}, reduced, {_r('cagr', 'vol', 'sharpe', 'max_drawdown', 'drawdown_to_vol')} FROM o""")
def conditional_exposure(spark, sf_dir):
    p = paths(spark, sf_dir)
    before = F.lag("ret").over(Window.partitionBy("member").orderBy("session"))
    return ledgers.conditional_exposure(p.withColumn("x", F.abs(F.coalesce(before, F.lit(0.0)))), "x")


@query(f"""WITH {MONTHS}, t AS (SELECT symbol, session, round((close - 1500) / 2e8, 12) AS per_dollar, close AS price, 1.0::DOUBLE + ascii(symbol) % 3 AS pv, 150.0::DOUBLE AS margin FROM ends), a AS (SELECT *, per_dollar * 1e8 AS d FROM t),
b AS (SELECT *, least(1.0::DOUBLE, CASE WHEN sum(abs(d * price * pv)) OVER s > 0 THEN 0.012 * 1e8 / sum(abs(d * price * pv)) OVER s ELSE 1.0::DOUBLE END, CASE WHEN sum(abs(d) * margin) OVER s > 0 THEN 0.001 * 1e8 / sum(abs(d) * margin) OVER s ELSE 1.0::DOUBLE END) AS s1 FROM a WINDOW s AS (PARTITION BY session)), c AS (SELECT *, round_even(d * s1, 0) AS w FROM b),
e AS (SELECT *, least(1.0::DOUBLE, CASE WHEN sum(abs(w * price * pv)) OVER s > 0 THEN 0.012 * 1e8 / sum(abs(w * price * pv)) OVER s ELSE 1.0::DOUBLE END, CASE WHEN sum(abs(w) * margin) OVER s > 0 THEN 0.001 * 1e8 / sum(abs(w) * margin) OVER s ELSE 1.0::DOUBLE END) AS s2 FROM c WINDOW s AS (PARTITION BY session))
SELECT symbol, session, CASE WHEN s2 < 1 THEN trunc(w * s2) ELSE w END + 0.0::DOUBLE AS contracts, round(s1 * s2, 6) + 0.0::DOUBLE AS scale FROM e""")
def limited_contracts(spark, sf_dir):
    ends = month_end_rows(bars(spark, sf_dir))
    targets = ends.select("symbol", "session", F.round((F.col("close") - 1500) / 2e8, 12).alias("per_dollar"), F.col("close").alias("price"), (1.0 + F.ascii("symbol") % 3).alias("point_value"), F.lit(150.0).alias("margin"))
    return ledgers.limited_contracts(targets, 1e8, 0.012, 0.001).select("symbol", "session", "contracts", "scale")


SCOPES = f"""{TRADES}, sc AS (SELECT CASE WHEN symbol LIKE 'A%' THEN 'class A' ELSE 'class N' END AS class, * FROM trades)"""


@query(f"""WITH {SCOPES}, m AS (SELECT class, symbol, count("exit") AS closed, count(*) FILTER ("exit" IS NOT NULL AND net > 0.01) AS wins, count(*) FILTER ("exit" IS NOT NULL AND net < -0.01) AS losses, sum(net) FILTER ("exit" IS NOT NULL AND net > 0.01) / -sum(net) FILTER ("exit" IS NOT NULL AND net < -0.01) AS profit_factor, avg(net) FILTER ("exit" IS NOT NULL) AS expectancy, grouping(class, symbol) AS level FROM sc WHERE "exit" BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' GROUP BY GROUPING SETS ((), (class), (symbol)))
SELECT coalesce(class, symbol, 'all') AS scope, closed, wins, losses, {_r('profit_factor', 'expectancy')} FROM m""")
def trade_scopes(spark, sf_dir):
    t = trades(spark, sf_dir).filter("exit BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'").withColumn("class", F.when(F.col("symbol").like("A%"), "class A").otherwise("class N"))
    scopes = F.explode(F.array(F.lit("all"), F.col("class"), F.col("symbol")))
    return episodes.episode_metrics(t.withColumn("symbol", scopes)).select(F.col("symbol").alias("scope"), "closed", "wins", "losses", "profit_factor", "expectancy")


# Decisions ------------------------------------------------------------------------

TERMED = f"""{CATALOGUE}, {RATES}, tm AS (SELECT b.symbol, b.session, b.close, t.point_value * r.rate AS pv FROM bars b JOIN terms t ON t.symbol = 'NATION_' || (ascii(b.symbol) % 3 + 1) LEFT JOIN rates r ON r.currency = t.currency AND r.session = b.session)"""


def _termed(spark, sf_dir, panel: DataFrame) -> DataFrame:
    usd = terms.dollar_terms(_catalogue(spark, sf_dir)[0], _rates(spark, sf_dir)).withColumnRenamed("symbol", "contract")
    name = F.concat(F.lit("NATION_"), F.ascii("symbol") % 3 + 1)
    known = _catalogue(spark, sf_dir)[0].select(F.col("symbol").alias("contract"))
    rows = panel.withColumn("contract", name).join(known, "contract", "left_semi")
    return rows.join(usd.select("contract", "session", "point_value_usd"), ["contract", "session"], "left").drop("contract")


@query(f"""WITH {TERMED}, w AS (SELECT *, row_number() OVER (PARTITION BY symbol, date_trunc('month', session) ORDER BY session DESC) AS r FROM tm), l AS (SELECT symbol, session, close, pv, count(*) OVER (PARTITION BY session) AS n FROM tm)
SELECT l.symbol, l.session, round(coalesce(1.0::DOUBLE / n / nullif(abs(l.close * l.pv), 0), 0) * 1e6, 6) + 0.0::DOUBLE AS per_million FROM l JOIN w ON w.symbol = l.symbol AND w.session = l.session AND r = 1""")
def equal_notional_decisions(spark, sf_dir):
    panel = _termed(spark, sf_dir, bars(spark, sf_dir)).withColumn("weight", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("session")))
    return terms.decisions(panel, "weight").select("symbol", "session", (F.col("per_dollar") * 1e6).alias("per_million"))


@query(f"""WITH {TERMED}, steps AS (SELECT symbol, session, ln(close / lag(close) {W})) AS lr FROM bars), mr AS (SELECT symbol, CAST(date_trunc('month', session) AS DATE) AS month, sum(lr) AS lr, exp(sum(lr)) - 1 AS ret FROM steps WHERE lr IS NOT NULL GROUP BY ALL),
g AS (SELECT symbol, month, count(ret) {M} ROWS 11 PRECEDING) AS n, (sign(round(lr, 9)) + sign(round(sum(lr) {M} ROWS 2 PRECEDING), 9)) + sign(round(sum(lr) {M} ROWS 11 PRECEDING), 9))) / 3.0::DOUBLE AS signal, stddev_samp(ret) {M} ROWS 11 PRECEDING) * sqrt(12::DOUBLE) AS vol FROM mr),
h AS (SELECT g.symbol, g.month, g.signal, g.vol, m.month AS of_month, m.ret, count(m.ret) OVER (PARTITION BY g.symbol, g.month) AS months FROM g JOIN mr m ON m.symbol = g.symbol AND m.month <= g.month AND m.month > g.month - INTERVAL 36 MONTH WHERE n = 12 AND vol > 0),
c AS (SELECT *, count(*) OVER (PARTITION BY month, of_month) AS live FROM h WHERE months = 36), r AS (SELECT *, signal * 0.4 / vol / live AS raw FROM c WHERE live >= 2), t AS (SELECT month, of_month, sum(raw * ret) AS r FROM r GROUP BY ALL), e AS (SELECT month, sqrt(var_samp(r) * 12) AS ex_ante FROM t GROUP BY month HAVING sqrt(var_samp(r) * 12) > 0),
o AS (SELECT DISTINCT r.symbol, r.month, raw * 0.1 / ex_ante AS weight FROM r JOIN e USING (month)), w AS (SELECT *, CAST(date_trunc('month', session) AS DATE) AS month, row_number() OVER (PARTITION BY symbol, date_trunc('month', session) ORDER BY session DESC) AS k FROM tm)
SELECT w.symbol, w.session, round(coalesce(weight, 0), 6) + 0.0::DOUBLE AS weight, round(coalesce(weight / nullif(abs(close * pv), 0), 0) * 1e6, 6) + 0.0::DOUBLE AS per_million FROM w LEFT JOIN o ON o.symbol = w.symbol AND o.month = w.month WHERE k = 1""")
def blended_decisions(spark, sf_dir):
    own = bars(spark, sf_dir)
    step = own.withColumn("lr", F.ln(F.col("close") / F.lag("close").over(by_symbol()))).filter("lr IS NOT NULL")
    m = step.groupBy("symbol", F.trunc("session", "month").alias("month")).agg(F.sum("lr").alias("lr")).withColumn("ret", F.exp("lr") - 1)
    back = lambda n: Window.partitionBy("symbol").orderBy("month").rowsBetween(1 - n, 0)
    signs = [F.signum(F.round(F.sum("lr").over(back(n)), 9)) for n in (1, 3, 12)]
    blend = m.withColumns({"n": F.count("ret").over(back(12)), "signal": sum(signs, F.lit(0.0)) / 3, "vol": F.stddev_samp("ret").over(back(12)) * 12**0.5}).filter("n = 12")
    out = terms.blended_decisions(_termed(spark, sf_dir, own), blend, m.select("symbol", "month", "ret"))
    return out.select("symbol", "session", "weight", (F.col("per_dollar") * 1e6).alias("per_million"))


@query(f"""WITH {TERMED}, ret AS (SELECT symbol, session, close / lag(close) {W}) - 1 AS ret, sign(close - lag(close, 252) {W})) AS signal FROM bars), v AS (SELECT *, CASE WHEN count(ret) {W} ROWS 62 PRECEDING) >= 63 THEN sqrt(avg(ret * ret) {W} ROWS 62 PRECEDING) * 252) END AS vol FROM ret),
u AS (SELECT symbol, session, CASE WHEN signal IS NOT NULL AND vol > 0 THEN signal * 0.1::DOUBLE / vol / sum(CASE WHEN signal IS NOT NULL AND vol > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY session) END AS weight FROM v),
d AS (SELECT tm.symbol, tm.session, coalesce(weight / nullif(abs(close * pv), 0), 0) * 1e6 AS per_million, row_number() OVER (PARTITION BY tm.symbol, date_trunc('month', tm.session) ORDER BY tm.session DESC) AS r FROM tm JOIN u ON u.symbol = tm.symbol AND u.session = tm.session),
o AS (SELECT session, CASE WHEN day(session) % 2 = 0 THEN 0.5::DOUBLE END AS w FROM (SELECT DISTINCT session FROM bars)) SELECT symbol, d.session, round(per_million * coalesce(w, 1), 6) + 0.0::DOUBLE AS per_million FROM d JOIN o ON o.session = d.session WHERE r = 1""")
def overlaid_decisions(spark, sf_dir):
    both = rolling.inverse_vol_weights(rolling.realized_volatility(rolling.trend_sign(returns(spark, sf_dir))))
    decided = terms.decisions(_termed(spark, sf_dir, both), "weight")
    overlay = bars(spark, sf_dir).select("session").distinct().filter("day(session) % 2 = 0").withColumn("weight", F.lit(0.5))
    return terms.overlaid(decided, overlay).select("symbol", "session", (F.col("per_dollar") * 1e6).alias("per_million"))


@query(f"""WITH {RETURNS}, v AS (SELECT session, CASE WHEN count(ret) {W} ROWS 125 PRECEDING) >= 126 THEN sqrt(avg(ret * ret) {W} ROWS 125 PRECEDING) * 252) END AS vol, row_number() OVER (PARTITION BY date_trunc('month', session) ORDER BY session DESC) AS r FROM returns WHERE symbol = 'AF'),
w AS (SELECT session, round(CASE WHEN vol > 0 THEN least(2.0::DOUBLE, 3.0::DOUBLE / vol) ELSE 1.0::DOUBLE END, 9) AS w FROM v WHERE r = 1), o AS (SELECT count(*) AS decisions, min(session) FILTER (w <> 1) AS first_active, min(w) AS least, quantile_cont(w, 0.05) AS p05, quantile_cont(w, 0.5) AS p50, avg(w) AS mean, quantile_cont(w, 0.95) AS p95, quantile_cont(w, 0.99) AS p99, max(w) AS most FROM w)
SELECT decisions, first_active, {_r('least', 'p05', 'p50', 'mean', 'p95', 'p99', 'most')} FROM o""")
def overlay_weights(spark, sf_dir):
    scaled = rolling.volatility_scale(returns(spark, sf_dir).filter("symbol = 'AF'"), budget=3.0, lag=0)
    return terms.weight_report(month_end_rows(scaled).select("session", F.round(F.coalesce("scale", F.lit(1.0)), 9).alias("weight")))


@query(f"""WITH {RETURNS}, m AS (SELECT symbol, session, round((close / nullif(lag(close, 21) {W}), 0) - 1), 9) AS signal, sign(close - lag(close, 252) {W})) AS reference, CASE WHEN volume::BIGINT % 4 = 0 THEN 0.0::DOUBLE ELSE 0.1::DOUBLE END AS weight, row_number() OVER (PARTITION BY symbol, date_trunc('month', session) ORDER BY session DESC) AS r FROM returns),
d AS (SELECT *, signal IS NOT NULL AND weight <> 0 AS live FROM m WHERE r = 1), s AS (SELECT session, count(*) FILTER (live) AS live, sum(abs(weight)) AS gross, sum(abs(signal)) FILTER (live) AS s, max(abs(signal)) FILTER (live) AS m, sum((sign(signal) = sign(reference))::INT) FILTER (live AND reference IS NOT NULL) AS agree, count(*) FILTER (live AND reference IS NOT NULL) AS both_ FROM d GROUP BY session),
o AS (SELECT count(*) AS decisions, avg(live) AS live_symbols, sum(s) / sum(live) AS mean_signal, max(m) AS largest_signal, sum(agree) / sum(both_) AS agreement, avg(gross) AS mean_gross, max(gross) AS largest_gross FROM s) SELECT decisions, {_r('live_symbols', 'mean_signal', 'largest_signal', 'agreement', 'mean_gross', 'largest_gross')} FROM o""")
def signal_report(spark, sf_dir):
    by = by_symbol()
    rows = returns(spark, sf_dir).select("symbol", "session", F.round(F.col("close") / F.lag("close", 21).over(by) - 1, 9).alias("signal"), F.signum(F.col("close") - F.lag("close", 252).over(by)).alias("reference"), F.when(F.col("volume").cast("long") % 4 == 0, 0.0).otherwise(0.1).alias("weight"))
    return terms.signal_report(month_end_rows(rows))


@query(f"WITH {BARS}, a AS (SELECT symbol, session, (close - lag(close) {W})) / nullif(abs(lag(high + low) {W})) / 2, 0) AS ret FROM bars) SELECT symbol, session, {_r('ret')} FROM a")
def adjusted_returns(spark, sf_dir):
    return terms.adjusted_returns(bars(spark, sf_dir).withColumn("raw", (F.col("high") + F.col("low")) / 2)).select("symbol", "session", "ret")


@query(f"""WITH {BARS}, m AS (SELECT symbol, session, count(*) {W}) > 100 AS member FROM bars), n AS (SELECT *, count(*) FILTER (member) OVER (PARTITION BY session) AS many FROM m),
f AS (SELECT symbol, session, CASE WHEN member THEN CASE symbol WHEN 'AF' THEN 0.6::DOUBLE WHEN 'NO' THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END ELSE 0.0::DOUBLE END AS weight, CASE WHEN member THEN 1.0::DOUBLE / many ELSE 0.0::DOUBLE END AS equal FROM n) SELECT symbol, session, {_r('weight')}, round(1 - sum(weight) OVER (PARTITION BY session), 6) + 0.0::DOUBLE AS cash, {_r('equal')} FROM f""")
def fixed_weights(spark, sf_dir):
    rows = bars(spark, sf_dir).select("symbol", "session", (F.count(F.lit(1)).over(by_symbol()) > 100).alias("member"))
    return allocation.equal_weights(allocation.fixed_weights(rows, {"AF": 0.6, "NO": 0.3})).select("symbol", "session", "weight", "cash", "equal")


@query(f"""WITH {BARS}, d AS (SELECT DISTINCT session FROM bars), n AS (SELECT session, lead(session) OVER (ORDER BY session) AS next FROM d) SELECT next AS session FROM n WHERE date_trunc('month', next) > date_trunc('month', session)""")
def rebalance_sessions(spark, sf_dir):
    return performance.rebalance_sessions(bars(spark, sf_dir))


@query(f"""WITH {BARS}, y AS (SELECT CAST(year(session) AS INTEGER) AS year, min(session) AS session FROM bars GROUP BY 1) SELECT year, session, (year - 1993) % 2 = 0 AS boundary FROM y WHERE year BETWEEN 1993 AND 1998""")
def annual_boundaries(spark, sf_dir):
    b = bars(spark, sf_dir)
    steps = [d.year for d in performance.calendar_boundaries("1992-06-01", "1998-12-31", 2)]
    return performance.annual_boundaries(b, 1993, 1998).withColumn("boundary", F.col("year").isin(steps))


# Paths and windows -------------------------------------------------------------------

WINDOWS = {"train": ("1995-01-01", "1996-12-31"), "check": ("1997-01-01", "1997-12-31"), "test": ("1998-01-01", "1999-06-30"), "late": ("1999-07-01", "2001-12-31")}
_MARKS = ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, (a, b) in WINDOWS.items())


def windows_sql(source: str, windows: str) -> str:
    """CTEs ending in ``wm``: window metrics of a CTE (member, session, ret)."""
    return f"""wp AS (SELECT *, coalesce(lag(session) {P}), session) AS before FROM {source}), wr AS (SELECT p.member, p.session, p.ret, w.window, first_value(before) OVER (PARTITION BY p.member, w.window ORDER BY p.session) AS since FROM wp p JOIN (VALUES {windows}) w("window", a, b) ON p.session BETWEEN w.a AND w.b),
wn AS (SELECT *, product(1 + ret) OVER (PARTITION BY member, "window" ORDER BY session) AS nav FROM wr), wd AS (SELECT *, nav / greatest(1.0::DOUBLE, max(nav) OVER (PARTITION BY member, "window" ORDER BY session)) - 1 AS dd FROM wn),
wa AS (SELECT member, "window", min(session) AS start, max(session) AS "end", count(*) AS sessions, greatest(max(session) - min(since), 1) / 365.2425 AS years, product(1 + ret) AS grown, stddev_samp(ret) * sqrt(252::DOUBLE) AS vol, avg(ret) / stddev_samp(ret) * sqrt(252::DOUBLE) AS sharpe, avg(ret) / nullif(sqrt(avg(pow(least(ret, 0), 2))), 0) * sqrt(252::DOUBLE) AS sortino, avg((ret > 0)::INT) AS hit_rate, min(dd) AS max_drawdown FROM wd GROUP BY ALL),
wm AS (SELECT *, pow(grown, 1 / years) - 1 AS cagr, CASE WHEN max_drawdown < 0 THEN (pow(grown, 1 / years) - 1) / -max_drawdown END AS calmar FROM wa)"""


@query(f"""WITH {PATHS}, {windows_sql('paths', _MARKS)}, yc AS (SELECT member, year(session) AS y, count(*) AS n, min(month(session)) AS a, max(month(session)) AS b FROM paths GROUP BY ALL), yw AS (SELECT member, "window", year(session) AS y, count(*) AS k FROM wr GROUP BY ALL),
yr AS (SELECT yw.member, "window", count(*) AS years_touched, count(*) FILTER (k = n AND a = 1 AND b = 12) AS complete_years FROM yw JOIN yc ON yc.member = yw.member AND yc.y = yw.y GROUP BY ALL)
SELECT wm.member, wm.window, start, "end", sessions, {_r('years', 'vol', 'sharpe', 'sortino', 'hit_rate', 'max_drawdown', 'cagr', 'calmar')}, years_touched, complete_years FROM wm JOIN yr ON yr.member = wm.member AND yr.window = wm.window""")
def path_reports(spark, sf_dir):
    p = paths(spark, sf_dir)
    rows = reports.windowed(p, WINDOWS)
    return reports.window_metrics(rows).join(reports.complete_years(rows, p), ["member", "window"])


_FIGURES = ("cagr", "vol", "sharpe", "max_drawdown")


@query(f"""WITH {PATHS}, {windows_sql('paths', _MARKS)}, l AS (SELECT member, "window", unnest([{', '.join(f"{{'f': '{f}', 'v': {f}}}" for f in _FIGURES)}]) AS x FROM wm), p AS (SELECT member, x.f AS figure, {', '.join(f"any_value(x.v) FILTER (\"window\" = '{n}') AS \"{n}\"" for n in WINDOWS)} FROM l GROUP BY ALL), c AS (SELECT *, late - train AS change FROM p)
SELECT member, figure, {_r('train', 'late', 'change')}, round("check", 6) + 0.0::DOUBLE AS "check", round("test", 6) + 0.0::DOUBLE AS "test" FROM c""")
def windows_side_by_side(spark, sf_dir):
    return reports.side_by_side(reports.window_metrics(reports.windowed(paths(spark, sf_dir), WINDOWS)), list(WINDOWS), list(_FIGURES))


@query(f"""WITH {PATHS}, {windows_sql('paths', _MARKS)}, l AS (SELECT unnest([{', '.join(f"{{'f': '{f}', 'v': {f}}}" for f in _FIGURES)}]) AS x FROM wm), o AS (SELECT x.f AS figure, count(x.v) AS folds, avg(x.v) AS mean, quantile_cont(x.v, 0.5) AS median, stddev_samp(x.v) AS deviation, min(x.v) AS least, max(x.v) AS most, count(*) FILTER (x.v > 0) AS positive FROM l WHERE x.v IS NOT NULL GROUP BY 1)
SELECT figure, folds, {_r('mean', 'median', 'deviation', 'least', 'most')}, positive FROM o""")
def fold_dispersion(spark, sf_dir):
    return reports.dispersion(reports.window_metrics(reports.windowed(paths(spark, sf_dir), WINDOWS)), list(_FIGURES))


@query(f"""WITH {PATHS}, d AS (SELECT DISTINCT session FROM paths), n AS (SELECT session, {' + '.join(f"(session BETWEEN DATE '{a}' AND DATE '{b}')::INT" for a, b in WINDOWS.values())} AS n, session >= DATE '1995-06-01' AND day(session) <> 13 AS there FROM d)
SELECT count(*) FILTER (n > 0) AS in_folds, count(*) FILTER (n > 1) AS overlapping, count(*) FILTER (n = 0 AND session BETWEEN DATE '1995-01-01' AND DATE '2001-12-31') AS between_folds, count(*) FILTER (there AND n = 0) AS outside, count(*) FILTER (NOT there AND n > 0) AS missing, 'BLOCKED' AS status FROM n""")
def fold_accounting(spark, sf_dir):
    p = paths(spark, sf_dir)
    return reports.fold_accounting(p, p.filter("session >= DATE '1995-06-01' AND day(session) <> 13"), WINDOWS)


@query(f"""WITH {PATHS}, v AS (SELECT member, stddev_samp(ret) * sqrt(252::DOUBLE) AS vol FROM paths GROUP BY member), k AS (SELECT member, vol, (SELECT vol FROM v WHERE member = 'AF') / vol AS multiplier FROM v WHERE vol > 0), s AS (SELECT p.member, session, ret * multiplier AS ret, vol, multiplier FROM paths p JOIN k USING (member)),
n AS (SELECT *, product(1 + ret) {P}) AS nav FROM s), d AS (SELECT *, nav / greatest(1.0::DOUBLE, max(nav) {P}) ) - 1 AS dd FROM n),
o AS (SELECT member, any_value(vol) AS vol, any_value(multiplier) AS multiplier, pow(product(1 + ret), 1 / (greatest(max(session) - min(session), 1) / 365.2425)) - 1 AS cagr, min(dd) AS max_drawdown, avg(ret) / stddev_samp(ret) * sqrt(252::DOUBLE) AS sharpe, -min(dd) / (stddev_samp(ret) * sqrt(252::DOUBLE)) AS drawdown_to_vol FROM d GROUP BY member) SELECT member, {_r('vol', 'multiplier', 'cagr', 'max_drawdown', 'sharpe', 'drawdown_to_vol')} FROM o""".replace("{P}) )", f"{P}))"))
def risk_matched(spark, sf_dir):
    return reports.risk_matched(paths(spark, sf_dir), "AF")


@query(f"""WITH {WEALTH}, e AS (SELECT member, session, ret, coalesce(lag(CASE WHEN drawdown < -0.03 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) {P}), 1.0::DOUBLE) AS e FROM wealth), sc AS (SELECT member || '/base' AS member, session, ret FROM e UNION ALL SELECT member || '/scaled', session, ret * e FROM e), {windows_sql('sc', "('all', DATE '1900-01-01', DATE '2100-01-01')")}
SELECT split_part(member, '/', 1) AS member, split_part(member, '/', 2) AS form, start, "end", sessions, {_r('years', 'vol', 'sharpe', 'sortino', 'hit_rate', 'max_drawdown', 'cagr', 'calmar')} FROM wm""")
def overlay_report(spark, sf_dir):
    p = paths(spark, sf_dir)
    exposure = performance.wealth(p).select("member", "session", F.when(F.col("drawdown") < -0.03, 0.5).otherwise(1.0).alias("exposure"))
    return reports.overlay_report(p, exposure)


@query(f"""WITH {PATHS}, {windows_sql('paths', "('test', DATE '1998-01-01', DATE '1999-06-30')")}, c AS (SELECT a.member, corr(a.ret, b.ret) AS correlation FROM wr a JOIN wr b ON a.session = b.session AND b.member = 'AF' GROUP BY a.member) SELECT wm.member, {_r('cagr', 'vol', 'sharpe', 'max_drawdown', 'correlation')} FROM wm JOIN c USING (member)""")
def path_comparison(spark, sf_dir):
    rows = reports.windowed(paths(spark, sf_dir), {"test": WINDOWS["test"]})
    return reports.with_reference(reports.window_metrics(rows), rows, "AF").select("member", "cagr", "vol", "sharpe", "max_drawdown", "correlation")


@query(f"""WITH {RETURNS}, {VOL}, {STATE}, c AS (SELECT state, count(*) AS n FROM state WHERE session BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' GROUP BY state) SELECT w.state, coalesce(n, 0) AS sessions, CASE WHEN coalesce(n, 0) > 0 THEN 'PASS' ELSE 'BLOCKED' END AS status FROM (SELECT unnest(['Low', 'Middle', 'High', 'Crisis']) AS state) w LEFT JOIN c ON c.state = w.state""")
def state_coverage(spark, sf_dir):
    return reports.state_coverage(vol_states(spark, sf_dir), ["Low", "Middle", "High", "Crisis"], "1996-01-01", "1996-12-31")


@query(f"""WITH {WEALTH}, v AS (SELECT member AS variant, unnest([{{'s': 'max_drawdown', 'v': min(drawdown)}}, {{'s': 'vol', 'v': stddev_samp(ret) * sqrt(252::DOUBLE)}}]) AS x FROM wealth GROUP BY member), l AS (SELECT variant, x.s AS statistic, x.v AS value FROM v), j AS (SELECT statistic, max(value) - min(value) AS band FROM l WHERE variant IN ('AF', 'AO', 'NF') GROUP BY statistic),
f AS (SELECT statistic, greatest(0.0005::DOUBLE, coalesce(band, 0)) AS floor FROM j), d AS (SELECT l.variant, l.statistic, l.value - b.value AS delta, floor FROM l JOIN l b ON b.statistic = l.statistic AND b.variant = 'AF' JOIN f ON f.statistic = l.statistic WHERE l.variant <> 'AF')
SELECT variant, statistic, round(CASE WHEN abs(delta) > floor THEN delta END, 6) + 0.0::DOUBLE AS delta, {_r('floor')}, CASE WHEN abs(delta) > floor THEN 'RESOLVED' ELSE 'BELOW_FLOOR' END AS status FROM d""")
def published_deltas(spark, sf_dir):
    w = performance.wealth(paths(spark, sf_dir)).groupBy(F.col("member").alias("variant")).agg(F.min("drawdown").alias("max_drawdown"), (F.stddev_samp("ret") * 252**0.5).alias("vol"))
    values = w.select("variant", F.expr("stack(2, 'max_drawdown', max_drawdown, 'vol', vol) AS (statistic, value)"))
    runs = values.filter("variant IN ('AF', 'AO', 'NF')").withColumn("gap", F.lit(0.0)).unionByName(values.withColumn("gap", F.lit(1.0)))
    effects = values.select("statistic").distinct().withColumn("detectable", F.lit(0.0005))
    return reports.published_deltas(values, "AF", reports.resolution_floors(effects, reports.jitter(runs, 0.5)))


@query(f"""WITH {RETURNS}, t AS (SELECT symbol, session FROM returns WHERE session <= DATE '1997-06-30') SELECT symbol, count(*) AS sessions, 0.0::DOUBLE AS drift, 0::BIGINT AS missing FROM t GROUP BY symbol""")
def truncation_drift(spark, sf_dir):
    whole = bars(spark, sf_dir)
    work = lambda panel: rolling.realized_volatility(rolling.compounded(rolling.trend_sign(align(panel.select("symbol", "session", "close"), ["close"], panel.select("session").distinct(), None).withColumn("ret", F.lit(0.001) * F.hash("close") % 7 / 100)), 60, 50))
    keep = whole.select("symbol", "session")
    return performance.truncation_drift(work, whole, truncate, "1997-06-30", ["signal", "momentum", "vol"]).join(keep.filter("session <= DATE '1997-06-30'"), ["symbol", "session"], "left_semi").groupBy("symbol").agg(F.count(F.lit(1)).alias("sessions"), F.max("drift").alias("drift"), F.count_if("missing").alias("missing"))


# States ----------------------------------------------------------------------------


def _carried(name: str, source: str) -> str:
    return f"{name} AS (SELECT symbol, session, lag(carried) {W}) AS {name} FROM (SELECT symbol, session, last_value(state IGNORE NULLS) {W}) AS carried FROM bars LEFT JOIN {source} USING (symbol, session)))"


@query(f"""WITH {RETURNS}, {VOL}, {STATE}, ends AS (SELECT symbol, session, close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol, date_trunc('month', session) ORDER BY session DESC) = 1),
fm AS (SELECT symbol, session, close, CASE WHEN count(close) {W} ROWS 9 PRECEDING) >= 10 THEN avg(close) {W} ROWS 9 PRECEDING) END AS mean FROM ends), f0 AS (SELECT symbol, session, CASE WHEN mean IS NOT NULL THEN CASE WHEN close > mean THEN 'Risk-on' ELSE 'Risk-off' END END AS state FROM fm),
b0 AS (SELECT symbol, session, CASE WHEN lag(close, 1) {W}) / lag(close, 25) {W}) - 1 < 0 THEN 'Bear' WHEN lag(close, 1) {W}) / lag(close, 25) {W}) - 1 IS NOT NULL THEN 'Not bear' END AS state FROM ends), m0 AS (SELECT symbol, session, CASE WHEN lag(close, 1) {W}) / lag(close, 37) {W}) - 1 < 0 THEN 'Down market' WHEN lag(close, 1) {W}) / lag(close, 37) {W}) - 1 IS NOT NULL THEN 'Up market' END AS state FROM ends),
{_carried('trend', 'f0')}, {_carried('bear', 'b0')}, {_carried('market', 'm0')},
mo AS (SELECT symbol, session, lag(CASE WHEN sign(close - lag252) > 0 THEN 'Positive' WHEN sign(close - lag252) <= 0 THEN 'Negative' END) {W}) AS momentum FROM (SELECT *, lag(close, 252) {W}) AS lag252 FROM bars))
SELECT s.symbol, s.session, trend, momentum, state AS volatility, bear, market, CASE WHEN bear IS NOT NULL AND state IS NOT NULL THEN CASE WHEN bear = 'Bear' AND state = 'High' THEN 'Panic' ELSE 'No panic' END END AS panic FROM state s JOIN trend t ON t.symbol = s.symbol AND t.session = s.session JOIN bear b ON b.symbol = s.symbol AND b.session = s.session JOIN market k ON k.symbol = s.symbol AND k.session = s.session JOIN mo ON mo.symbol = s.symbol AND mo.session = s.session""")
def combined_states(spark, sf_dir):
    b = bars(spark, sf_dir)
    keys = ["symbol", "session"]
    labelled = {
        "trend": rolling.moving_average_state(b), "momentum": rolling.momentum_state(b), "volatility": vol_states(spark, sf_dir), "bear": rolling.past_return_state(b), "market": rolling.past_return_state(b, months=36, below="Down market", above="Up market"),
    }
    return regimes.combined_states({name: df.select(*keys, "state") for name, df in labelled.items()})


@query(f"""WITH {RETURNS}, p AS (SELECT a.symbol AS l, b.symbol AS r, a.session, a.ret AS x, b.ret AS y FROM returns a JOIN returns b ON a.session = b.session AND a.symbol < b.symbol WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL), c AS (SELECT l, r, session, CASE WHEN count(*) OVER w >= 63 THEN covar_pop(x, y) OVER w / nullif(stddev_pop(x) OVER w * stddev_pop(y) OVER w, 0) END AS corr FROM p WINDOW w AS (PARTITION BY l, r ORDER BY session ROWS 62 PRECEDING)),
m AS (SELECT session, count(corr) AS pairs, CASE WHEN count(corr) >= 10 THEN avg(corr) END AS mean FROM c GROUP BY session) SELECT session, pairs, round(lag(mean) OVER (ORDER BY session), 6) + 0.0::DOUBLE AS mean FROM m""")
def mean_correlation(spark, sf_dir):
    return rolling.mean_correlation(rolling.pair_correlation(returns(spark, sf_dir)), need=10)


@query(f"""WITH {RETURNS}, c AS (SELECT symbol, session, sum(coalesce(ln(1 + ret), 0)) {W}) AS c, row_number() {W})::DOUBLE AS s FROM returns), f AS (SELECT symbol, session, s, sum(c) {W} ROWS 251 PRECEDING) AS y, sum(s * c) {W} ROWS 251 PRECEDING) AS ty, sum(c * c) {W} ROWS 251 PRECEDING) AS yy FROM c),
g AS (SELECT *, ty - (s - 125.5) * y AS sty, yy - y * y / 252 AS syy, 252.0::DOUBLE * (252 * 252 - 1) / 12 AS stt FROM f), t AS (SELECT symbol, session, round(CASE WHEN s >= 252 THEN (sty / stt) / nullif(sqrt(greatest(syy - sty * sty / stt, 0) / 250 / stt), 0) END, 4) AS t FROM g)
SELECT symbol, session, CASE WHEN t IS NOT NULL THEN greatest(-1.0::DOUBLE, least(1.0::DOUBLE, t / 2)) END + 0.0::DOUBLE AS clipped, CASE WHEN t > 2 THEN 1.0::DOUBLE WHEN t < -2 THEN -1.0::DOUBLE WHEN t IS NOT NULL THEN 0.0::DOUBLE END AS threshold FROM t""")
def trend_t_signals(spark, sf_dir):
    t = rolling.time_trend_t(returns(spark, sf_dir)).withColumn("t", F.round("t", 4))
    return t.select("symbol", "session", rolling.clipped_t(F.col("t"), 2.0).alias("clipped"), rolling.threshold_t(F.col("t"), 2.0).alias("threshold"))


# Resampling ---------------------------------------------------------------------------


NUMBERED = f"""{PATHS}, num AS MATERIALIZED (SELECT member, row_number() {P}) - 1 AS position, ret FROM paths)"""
SESSIONS = "(SELECT count(DISTINCT session) FROM paths)"


def _one(block: int) -> str:
    return f"""{draws_sql(f'd{block}', SESSIONS, 200, 252, block, 7)}, j{block} AS (SELECT member, rep, step, ret, product(1 + ret) OVER (PARTITION BY member, rep ORDER BY step) AS nav FROM d{block} JOIN num USING (position)), k{block} AS (SELECT *, nav / greatest(1.0::DOUBLE, max(nav) OVER (PARTITION BY member, rep ORDER BY step)) - 1 AS dd FROM j{block}),
e{block} AS (SELECT member, {block} AS block, 252 AS horizon, rep, min(dd) AS dd, product(1 + ret) - 1 AS growth FROM k{block} GROUP BY member, rep)"""


@query(f"""WITH {NUMBERED}, {', '.join(_one(b) for b in (21, 63, 126))}, e AS (SELECT * FROM e21 UNION ALL SELECT * FROM e63 UNION ALL SELECT * FROM e126), o AS (SELECT member, block, horizon, quantile_cont(dd, 0.05) AS dd_p05, quantile_cont(dd, 0.5) AS dd_p50, quantile_cont(growth, 0.5) AS growth_p50, avg((dd <= -0.01)::INT) AS breach_probability, count(*) AS samples FROM e GROUP BY ALL)
SELECT member, CAST(block AS INTEGER) AS block, CAST(horizon AS INTEGER) AS horizon, {_r('dd_p05', 'dd_p50', 'growth_p50', 'breach_probability')}, samples FROM o""")
def bootstrap_drawdown(spark, sf_dir):
    return inference.bootstrap_drawdown(paths(spark, sf_dir), breach=0.01)


def _month(block: int) -> str:
    by = "OVER (PARTITION BY member, rep ORDER BY step"
    parts = " UNION ALL ".join(f"""SELECT member, {block} AS block, {h} AS horizon, rep, product(1 + ret) AS terminal, min(dd) AS dd, min(nav) AS low, min(y) AS y, avg(ret) / nullif(stddev_samp(ret), 0) AS s FROM q{block} WHERE step < {h} GROUP BY member, rep""" for h in (60, 36, 12))
    return f"""{draws_sql(f'd{block}', '(SELECT max(position) + 1 FROM num)', 200, 60, block, 11)}, j{block} AS (SELECT member, rep, step, ret, product(1 + ret) {by}) AS nav, CASE WHEN step >= 11 THEN product(1 + ret) {by} ROWS 11 PRECEDING) - 1 END AS y FROM d{block} JOIN num USING (position)), q{block} AS (SELECT *, nav / greatest(1.0::DOUBLE, max(nav) {by})) - 1 AS dd FROM j{block}), e{block} AS ({parts})"""


_QS = ", ".join(f"quantile_cont({x}, {q}) AS {n}_p{round(100 * q):02d}" for n, x in (("cagr", "cagr"), ("sharpe", "sharpe"), ("drawdown", "dd"), ("worst_year", "y")) for q in (0.05, 0.5))
_QN = [f"{n}_p{q}" for n in ("cagr", "sharpe", "drawdown", "worst_year") for q in ("05", "50")]


@query(f"""WITH {PATHS}, mo AS (SELECT member, CAST(date_trunc('month', session) AS DATE) AS session, product(1 + ret) - 1 AS ret FROM paths GROUP BY ALL), num AS MATERIALIZED (SELECT member, row_number() {P}) - 1 AS position, ret FROM mo), {_month(6)}, {_month(12)}, e AS (SELECT *, pow(terminal, 12.0::DOUBLE / horizon) - 1 AS cagr, s * sqrt(12::DOUBLE) AS sharpe FROM (SELECT * FROM e6 UNION ALL SELECT * FROM e12)),
o AS (SELECT member, block, horizon, {_QS}, avg((terminal < 1)::INT) AS loss, avg((low <= 0.5)::INT) AS half_lost, {', '.join(f"avg((dd <= -{d / 100})::INT) AS drawdown_{d}" for d in (15, 20, 30, 40))} FROM e GROUP BY ALL)
SELECT member, CAST(block AS INTEGER) AS block, CAST(horizon AS INTEGER) AS horizon, {_r(*_QN, 'loss', 'half_lost', 'drawdown_15', 'drawdown_20', 'drawdown_30', 'drawdown_40')} FROM o""")
def monthly_bootstrap(spark, sf_dir):
    return inference.monthly_bootstrap(paths(spark, sf_dir))


def _figures(weight: str) -> str:
    m = lambda c: f"(sum({c} * {weight}) / sum({weight}))"
    s = lambda c: f"({m(c)} / nullif(sqrt(greatest(sum({c} * {c} * {weight}) / sum({weight}) - pow({m(c)}, 2), 0)), 0) * sqrt(252::DOUBLE))"
    g = lambda c: f"exp(sum(ln(1 + {c}) * {weight}) * 252 / sum({weight}))"
    return f"[{{'s': 'mean', 'v': ({m('ret')} - {m('base')}) * 252}}, {{'s': 'sharpe', 'v': {s('ret')} - {s('base')}}}, {{'s': 'cagr', 'v': {g('ret')} - {g('base')}}}]"


@query(f"""WITH {PATHS}, num AS MATERIALIZED (SELECT p.member, row_number() OVER (PARTITION BY p.member ORDER BY p.session) - 1 AS position, p.ret, b.ret AS base FROM paths p JOIN paths b ON b.session = p.session AND b.member = 'AF' WHERE p.member <> 'AF'), {draws_sql('d21', SESSIONS, 200, SESSIONS, 21, 13)}, {draws_sql('d63', SESSIONS, 200, SESSIONS, 63, 13)},
t AS (SELECT 21 AS block, rep, position, count(*)::DOUBLE AS times FROM d21 GROUP BY ALL UNION ALL SELECT 63, rep, position, count(*)::DOUBLE FROM d63 GROUP BY ALL), r AS (SELECT member, block, rep, unnest({_figures('times')}) AS x FROM t JOIN num USING (position) GROUP BY member, block, rep), o AS (SELECT member, unnest({_figures('1.0::DOUBLE')}) AS x FROM num GROUP BY member),
s AS (SELECT member, x.s AS statistic, block, count(x.v) AS samples, stddev_samp(x.v) AS se, quantile_cont(x.v, 0.05) AS a, quantile_cont(x.v, 0.95) AS b FROM r GROUP BY ALL), f AS (SELECT s.*, o.x.v AS estimate FROM s JOIN o ON o.member = s.member AND o.x.s = s.statistic), z AS (SELECT *, least(a, 2 * estimate - b) AS low, greatest(b, 2 * estimate - a) AS high, 1.645 * se AS detectable FROM f)
SELECT member, statistic, CAST(block AS INTEGER) AS block, samples, {_r('estimate', 'se', 'low', 'high', 'detectable')} FROM z""")
def paired_bootstrap(spark, sf_dir):
    return inference.paired_bootstrap(paths(spark, sf_dir), "AF")


@query()
def spanning_regression(spark, sf_dir):
    return inference.spanning_regression(paths(spark, sf_dir), "AF")


def _shape(name: str, rows: str, keys: str) -> str:
    """CTEs ending in ``name`` (member, keys, x): loss shapes of rows (member, keys, step, ret), less the incumbent's."""
    k = f", {keys}" if keys else ""
    by = f"OVER (PARTITION BY member{k} ORDER BY step)"
    on = f"a.statistic = b.statistic{f' AND a.{keys} = b.{keys}' if keys else ''}"
    return f"""{name}1 AS (SELECT *, product(1 + ret) {by} AS nav FROM {rows}), {name}2 AS (SELECT *, nav / greatest(1.0::DOUBLE, max(nav) {by}) - 1 AS dd FROM {name}1),
{name}3 AS (SELECT member{k}, unnest([{{'s': 'drawdown_to_vol', 'v': -min(dd) / nullif(stddev_samp(ret) * sqrt(252::DOUBLE), 0)}}, {{'s': 'ulcer', 'v': sqrt(avg(dd * dd))}}, {{'s': 'pain', 'v': avg(-dd)}}]) AS x FROM {name}2 GROUP BY member{k}), {name}4 AS (SELECT member{k}, x.s AS statistic, x.v AS value FROM {name}3),
{name} AS (SELECT a.member{f', a.{keys}' if keys else ''}, a.statistic, a.value - b.value AS delta FROM {name}4 a JOIN {name}4 b ON {on} AND b.member = 'AF' WHERE a.member <> 'AF')"""


@query(f"""WITH {NUMBERED}, {draws_sql('d21', SESSIONS, 100, SESSIONS, 21, 17)}, {draws_sql('d63', SESSIONS, 100, SESSIONS, 63, 17)}, r21 AS (SELECT member, rep, step, ret FROM d21 JOIN num USING (position)), r63 AS (SELECT member, rep, step, ret FROM d63 JOIN num USING (position)), r0 AS (SELECT member, position AS step, ret FROM num),
{_shape('s21', 'r21', 'rep')}, {_shape('s63', 'r63', 'rep')}, {_shape('s0', 'r0', '')}, u AS (SELECT 21 AS block, * FROM s21 UNION ALL SELECT 63, * FROM s63), g AS (SELECT member, statistic, block, stddev_samp(delta) AS se, count(delta) AS samples FROM u GROUP BY ALL), j AS (SELECT g.*, s0.delta AS estimate FROM g JOIN s0 ON s0.member = g.member AND s0.statistic = g.statistic)
SELECT member, statistic, CAST(block AS INTEGER) AS block, samples, {_r('estimate', 'se')}, round(1.645 * se, 6) + 0.0::DOUBLE AS detectable, CASE WHEN abs(estimate) > 1.645 * se THEN 'DETECTED' ELSE 'WITHIN_NOISE' END AS status FROM j""")
def loss_shape_resolution(spark, sf_dir):
    return inference.loss_shape_resolution(paths(spark, sf_dir), "AF")


@query(f"""WITH {PATHS}, y AS (SELECT unnest([1997, 1998, 1999, 2000]) AS fold), b AS (SELECT fold, member, ret, row_number() OVER (PARTITION BY fold, member ORDER BY session DESC) AS back FROM paths JOIN y ON year(session) < fold), t AS (SELECT fold, member, round(avg(ret) / nullif(stddev_pop(ret), 0), 12) AS score, count(*) AS train_n FROM b WHERE back > 44 GROUP BY ALL HAVING count(*) >= 500),
c AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY fold ORDER BY score DESC, member) = 1), te AS (SELECT fold, member, product(1 + ret) - 1 AS test_return, count(*) AS test_n FROM paths JOIN y ON year(session) = fold GROUP BY ALL) SELECT CAST(fold AS INTEGER) AS fold, member, {_r('score')}, train_n, {_r('test_return')}, test_n FROM c JOIN te USING (fold, member)""")
def stand_off_select(spark, sf_dir):
    return inference.walk_forward(paths(spark, sf_dir), [1997, 1998, 1999, 2000], stand_off=44, least=500)


NAMED = f"""{PATHS}, nr AS (SELECT member AS symbol, session, ret FROM paths)"""


@query(f"""WITH {NAMED}, v AS (SELECT *, CASE WHEN count(ret) {W} ROWS 20 PRECEDING) >= 21 THEN avg(ret * ret) {W} ROWS 20 PRECEDING) END AS m FROM nr), l AS (SELECT symbol, session, ret, nullif(lag(m) {W}), 0) AS v FROM v), f AS (SELECT symbol, stddev_samp(ret) / stddev_samp(ret / v) AS c FROM l WHERE session BETWEEN DATE '1995-06-01' AND DATE '1997-12-31' AND v IS NOT NULL GROUP BY symbol)
SELECT symbol, session, round(CASE WHEN v IS NOT NULL THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, c / v)) END, 6) + 0.0::DOUBLE AS scale, 'ESTIMATED' AS status FROM l JOIN f USING (symbol)""")
def fitted_variance_scale(spark, sf_dir):
    rows = paths(spark, sf_dir).withColumnRenamed("member", "symbol")
    return regimes.fitted_variance_scale(rows, "1995-06-01", "1997-12-31").select("symbol", "session", "scale", "status")


@query(f"""WITH {NAMED}, v AS (SELECT symbol, session, CASE WHEN count(ret) {W} ROWS 125 PRECEDING) >= 126 THEN sqrt(21 * avg(ret * ret) {W} ROWS 125 PRECEDING)) END AS s, row_number() OVER (PARTITION BY symbol, date_trunc('month', session) ORDER BY session DESC) AS r FROM nr) SELECT symbol, session, round(CASE WHEN s > 0 THEN 0.12::DOUBLE / sqrt(12::DOUBLE) / s END, 6) + 0.0::DOUBLE AS scale FROM v WHERE r = 1""")
def decision_scale(spark, sf_dir):
    return regimes.decision_scale(paths(spark, sf_dir).withColumnRenamed("member", "symbol"))


@query(f"""WITH {CHANGES}, {ewm_sql('ev', 'ch', 'change', signals.span(60), 60)}, v AS (SELECT ch.symbol, ch.session, close, mid, trend, nullif(sd, 0) AS sd FROM ch LEFT JOIN ev ON ev.symbol = ch.symbol AND ev.session = ch.session),
h AS (SELECT *, lag(trend, 2) {W}) / lag(sd, 2) {W}) * (mid - lag(close) {W})) + lag(trend) {W}) / lag(sd) {W}) * (close - mid) AS res FROM v), w AS (SELECT *, sqrt({over('avg(res * res)', 'res', 63)}) AS own FROM h),
m AS (SELECT symbol, session, {clip('trend * CASE WHEN own > 0 THEN least(0.5::DOUBLE, 1 / own) END', -1, 1)} AS capped, {clip('trend * CASE WHEN own > 0 THEN 1 / own END', -1, 1)} AS relaxed FROM w) SELECT symbol, session, {_r('capped', 'relaxed')}, round(capped - relaxed, 6) + 0.0::DOUBLE AS bound FROM m""")
def forecast_stages(spark, sf_dir):
    panel = with_trend(spark, sf_dir).withColumnRenamed("mid", "open")
    capped = signals.risk_managed_forecast(panel, cap=0.5).select("symbol", "session", F.col("managed").alias("capped"))
    relaxed = signals.risk_managed_forecast(panel, cap=float("inf")).select("symbol", "session", F.col("managed").alias("relaxed"))
    return capped.join(relaxed, ["symbol", "session"]).withColumn("bound", F.col("capped") - F.col("relaxed"))
