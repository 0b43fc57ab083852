"""Queries of evidence checks, contract terms, rates and funds, with their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import audit, evidence, funds, terms
from ledgerline.operators.panel import by_symbol, sessions
from ledgerline.plans.catalogue import COSTS, W, _r, query
from ledgerline.sources.views import BARS, FILLS, bars, fills, read
from ledgerline.streaming import events as streams


# Fills, accounts, journals ----------------------------------------------------


@query(f"""WITH {FILLS}, f AS (SELECT *, order_id || ':' || strftime(filled, '%Y-%m-%d') AS fill_id FROM fills), o AS (SELECT order_id, count(DISTINCT side) > 1 AS sides, count(DISTINCT contract) > 1 AS contracts FROM f GROUP BY order_id),
r AS (SELECT f.*, count(*) OVER (PARTITION BY fill_id) AS times, sides, contracts FROM f JOIN o USING (order_id)),
v AS (SELECT 'repeated id' AS reason FROM r WHERE times > 1 UNION ALL SELECT 'filled before it arrived' FROM r WHERE filled < arrival UNION ALL SELECT 'quantity is not whole' FROM r WHERE NOT (quantity > 0 AND quantity = floor(quantity))
  UNION ALL SELECT 'above the interval''s volume' FROM r WHERE quantity > interval_volume UNION ALL SELECT 'crossed quote' FROM r WHERE NOT (bid > 0 AND bid <= ask) UNION ALL SELECT 'price is not positive' FROM r WHERE NOT price > 0
  UNION ALL SELECT 'order of two sides' FROM r WHERE sides UNION ALL SELECT 'order of two contracts' FROM r WHERE contracts)
SELECT reason, count(*) AS fills FROM v GROUP BY reason""")
def fill_violations(spark, sf_dir):
    rows = fills(spark, sf_dir).withColumn("fill_id", F.concat_ws(":", "order_id", F.date_format("filled", "yyyy-MM-dd")))
    return evidence.fill_violations(rows).groupBy("reason").agg(F.count(F.lit(1)).alias("fills"))


@query("""WITH l AS (SELECT c_nationkey AS account, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS grp, CAST(c_acctbal AS DECIMAL(18,2)) AS value, CAST((c_custkey % 4) / 10.0 AS DECIMAL(4,2)) AS haircut, CAST(9000 * (1 + c_nationkey % 4) AS DECIMAL(18,2)) AS cap FROM customer),
g AS (SELECT account, grp, CAST(sum(value) AS DOUBLE) AS market, CAST(sum(value * (1 - haircut)) AS DOUBLE) AS after, CAST(min(cap) AS DOUBLE) AS cap, min(value) AS least FROM l GROUP BY ALL)
SELECT account, round(sum(market), 2) AS market, round(sum(CASE WHEN grp IS NULL THEN after ELSE least(after, cap) END), 2) AS eligible, CAST(count(*) FILTER (grp IS NOT NULL AND after > cap) AS BIGINT) AS capped_groups, CASE WHEN min(least) >= 0 THEN 'PASS' ELSE 'BLOCKED' END AS status FROM g GROUP BY account""", places=2)
def account_collateral(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    lots = c.select(F.col("c_nationkey").alias("account"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("grp"), F.col("c_acctbal").cast("decimal(18,2)").alias("value"), ((F.col("c_custkey") % 4) / 10).cast("decimal(4,2)").alias("haircut"), (9000 * (1 + F.col("c_nationkey") % 4)).cast("decimal(18,2)").alias("cap"))
    return evidence.account_collateral(lots).select("account", F.col("market").cast("double").alias("market"), F.col("eligible").cast("double").alias("eligible"), "capped_groups", "status")


@query("""WITH p AS (SELECT l_orderkey AS entry, CASE WHEN l_linestatus = 'F' THEN 'USD' ELSE 'EUR' END AS currency, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, CAST(CASE WHEN l_linestatus = 'F' THEN 1.00 ELSE 1.10 END AS DECIMAL(6,2)) AS fx, l_linenumber AS k FROM lineitem),
s AS (SELECT entry, currency, amount AS signed, fx FROM p UNION ALL SELECT entry, currency, -(CASE WHEN k = 3 THEN amount + 1 ELSE amount END), fx FROM p),
b AS (SELECT entry, currency, sum(signed) AS gap, sum(signed * fx) AS base FROM s GROUP BY ALL), e AS (SELECT entry, count(*) AS currencies, count(*) FILTER (gap <> 0) AS unbalanced, CAST(sum(base) AS DOUBLE) AS base_gap FROM b GROUP BY entry)
SELECT entry, currencies, unbalanced, round(base_gap, 6) + 0.0::DOUBLE AS base_gap, CASE WHEN unbalanced = 0 AND base_gap = 0 THEN 'PASS' ELSE 'BLOCKED' END AS status FROM e""")
def journal_balance(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem")
    first = F.col("l_linestatus") == "F"
    amount = F.col("l_extendedprice").cast("decimal(18,2)")
    sides = F.array(F.struct(F.lit("DEBIT").alias("side"), amount.alias("amount")), F.struct(F.lit("CREDIT").alias("side"), F.when(F.col("l_linenumber") == 3, amount + 1).otherwise(amount).cast("decimal(18,2)").alias("amount")))
    rows = line.select(F.col("l_orderkey").alias("entry"), F.when(first, "USD").otherwise("EUR").alias("currency"), F.when(first, 1.0).otherwise(1.1).cast("decimal(6,2)").alias("fx"), F.explode(sides).alias("s")).select("entry", "currency", "s.side", "s.amount", "fx")
    return evidence.journal_balance(rows).withColumn("base_gap", F.col("base_gap").cast("double"))


@query("""WITH o AS (SELECT o_custkey AS c, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS cash, max(o_orderdate) AS seen, count(*) AS n FROM orders GROUP BY 1),
a AS (SELECT c_custkey AS account, seen, coalesce(cash, 0.0::DOUBLE) AS cash, CAST(c_acctbal AS DOUBLE) AS collateral, coalesce(n, 0) AS n, coalesce(cash, 0.0::DOUBLE) + c_acctbal + 10 - 4 - 2 + CASE WHEN c_custkey % 7 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS equity FROM customer LEFT JOIN o ON c = c_custkey),
g AS (SELECT account, 'fresh' AS gate, coalesce(epoch(TIMESTAMP '1998-08-02 00:00:00') - epoch(seen) BETWEEN 0 AND 86400 * 200, false) AS ok FROM a UNION ALL SELECT account, 'equity_roll_forward', abs(cash + collateral + 10 - 4 - 2 + 0 - equity) <= 0.01 FROM a
  UNION ALL SELECT account, 'margins_ordered', 100.0 * n >= 80.0 * n - 5 AND 80.0 * n - 5 >= 0 FROM a UNION ALL SELECT account, 'available_funds', account % 5 <> 0 FROM a UNION ALL SELECT account, 'not_negative', true FROM a)
SELECT gate, CASE WHEN ok THEN 'PASS' ELSE 'BLOCKED' END AS status, count(*) AS accounts FROM g GROUP BY ALL""")
def treasury_gates(spark, sf_dir):
    o = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("cash"), F.max(F.col("o_orderdate").cast("timestamp")).alias("seen"), F.count(F.lit(1)).alias("n"))
    a = read(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").na.fill(0, ["cash", "n"])
    fixed = {"receivable": 10.0, "payable": 4.0, "fees": 2.0, "other": 0.0}
    a = a.select(F.col("c_custkey").alias("account"), "seen", "cash", F.col("c_acctbal").cast("double").alias("collateral"), *(F.lit(v).alias(k) for k, v in fixed.items()), (F.col("n") * 100.0).alias("initial"), (F.col("n") * 80.0 - 5).alias("maintenance"))
    equity = F.col("cash") + F.col("collateral") + 4.0 + F.when(F.col("account") % 7 == 0, 1.0).otherwise(0.0)
    a = a.withColumn("equity", equity).withColumn("available", F.col("equity") - F.col("initial") + F.when(F.col("account") % 5 == 0, 3.0).otherwise(0.0))
    return evidence.treasury_gates(a, "1998-08-02 00:00:00", 86400 * 200).groupBy("gate", "status").agg(F.count(F.lit(1)).alias("accounts"))


EVENTS = """ev AS (SELECT user_id, event_id, ts, event_type, value, CAST(floor(value) AS BIGINT) % 7 AS k FROM events)"""


def _events(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.floor("value") % 7)


@query(f"""WITH {EVENTS}, r AS (SELECT user_id AS batch, k AS candidate, CASE WHEN event_type IN ('signup', 'view') THEN 'REGISTER' ELSE 'RESULT' END AS kind, event_id AS sequence, ts AS seen FROM ev WHERE event_type <> 'error'),
w AS (SELECT *, min(sequence) FILTER (kind = 'REGISTER') OVER (PARTITION BY batch, candidate) AS f, min(sequence) FILTER (kind = 'RESULT') OVER (PARTITION BY batch, candidate) AS g, lag(seen) OVER (PARTITION BY batch ORDER BY sequence) AS b FROM r),
a AS (SELECT batch, count(*) FILTER (kind = 'REGISTER' AND sequence = f) AS candidates, count(*) FILTER (kind = 'REGISTER' AND sequence > f) AS registered_twice, count(*) FILTER (kind = 'RESULT') AS results, count(*) FILTER (kind = 'RESULT' AND (f IS NULL OR sequence < f)) AS results_too_early,
  count(*) FILTER (kind = 'RESULT' AND sequence > g) AS second_results, count(*) FILTER (seen < b) AS backdated FROM w GROUP BY batch), o AS (SELECT *, greatest(candidates - 3, 0) AS over_budget FROM a)
SELECT *, CASE WHEN registered_twice + results_too_early + second_results + backdated + over_budget = 0 THEN 'PASS' ELSE 'BLOCKED' END AS status FROM o""")
def registry_audit(spark, sf_dir):
    e = _events(spark, sf_dir).filter("event_type <> 'error'")
    kind = F.when(F.col("event_type").isin("signup", "view"), "REGISTER").otherwise("RESULT")
    return evidence.registry_audit(e.select(F.col("user_id").alias("batch"), F.col("k").alias("candidate"), kind.alias("kind"), F.col("event_id").alias("sequence"), F.col("ts").alias("seen")))


@query(f"""WITH {EVENTS}, h AS (SELECT user_id || '-' || CAST(floor(value) AS BIGINT) % 31 AS dataset, CASE WHEN event_type = 'signup' THEN 'REGISTER' ELSE 'CONSUME' END AS kind, event_id AS sequence, event_id % 3 AS seal FROM ev WHERE event_type IN ('signup', 'purchase')),
f AS (SELECT dataset, min(sequence) AS s, arg_min(seal, sequence) AS z FROM h WHERE kind = 'REGISTER' GROUP BY dataset),
a AS (SELECT dataset, count(*) FILTER (kind = 'REGISTER') AS registrations, count(*) FILTER (kind = 'CONSUME') AS looks, count(*) FILTER (kind = 'CONSUME' AND (s IS NULL OR sequence < s)) AS too_early, count(*) FILTER (kind = 'CONSUME' AND seal <> z) AS other_seal FROM h LEFT JOIN f USING (dataset) GROUP BY dataset)
SELECT *, CASE WHEN registrations = 1 AND looks <= 1 AND too_early = 0 AND other_seal = 0 THEN 'PASS' ELSE 'BLOCKED' END AS status FROM a""")
def holdout_audit(spark, sf_dir):
    e = _events(spark, sf_dir).filter("event_type IN ('signup', 'purchase')")
    kind = F.when(F.col("event_type") == "signup", "REGISTER").otherwise("CONSUME")
    return evidence.holdout_audit(e.select(F.concat_ws("-", "user_id", F.floor("value") % 31).alias("dataset"), kind.alias("kind"), F.col("event_id").alias("sequence"), (F.col("event_id") % 3).alias("seal")))


@query("""WITH m AS (SELECT max(ts) AS t FROM events), u AS (SELECT user_id AS component, CAST(floor(epoch((SELECT t FROM m))) AS BIGINT) - CAST(floor(epoch(max(ts) FILTER (event_type = 'view'))) AS BIGINT) AS data_age, CAST(floor(epoch((SELECT t FROM m))) AS BIGINT) - CAST(floor(epoch(max(ts) FILTER (event_type = 'click'))) AS BIGINT) AS reconciled_age,
  round(sum(value) FILTER (event_type = 'purchase') / 1000, 6) AS gross, round((max(value) - 100) / 500, 6) AS drawdown FROM events GROUP BY user_id),
r AS (SELECT *, list_filter([CASE WHEN NOT coalesce(data_age BETWEEN 0 AND 86400, false) THEN 'data_age' END, CASE WHEN NOT coalesce(reconciled_age BETWEEN 0 AND 172800, false) THEN 'reconciled_age' END, CASE WHEN NOT coalesce(gross BETWEEN 0 AND 0.8, false) THEN 'gross' END, CASE WHEN NOT coalesce(drawdown BETWEEN 0 AND 0.5, false) THEN 'drawdown' END], lambda x: x IS NOT NULL) AS found FROM u)
SELECT component, data_age, reconciled_age, gross + 0.0::DOUBLE AS gross, drawdown + 0.0::DOUBLE AS drawdown, array_to_string(found, ',') AS reasons, CASE WHEN len(found) = 0 THEN 'PASS' ELSE 'BLOCKED' END AS status FROM r""")
def runtime_health(spark, sf_dir):
    e = _events(spark, sf_dir)
    last = lambda kind: F.max(F.when(F.col("event_type") == kind, F.unix_timestamp("ts")))
    # The time of the newest event is one number.
    now = e.agg(F.max(F.unix_timestamp("ts")).alias("now"))
    rows = e.groupBy(F.col("user_id").alias("component")).agg(last("view").alias("v"), last("click").alias("c"), F.round(F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))) / 1000, 6).alias("gross"), F.round((F.max("value") - 100) / 500, 6).alias("drawdown"))
    rows = rows.join(F.broadcast(now)).select("component", (F.col("now") - F.col("v")).alias("data_age"), (F.col("now") - F.col("c")).alias("reconciled_age"), "gross", "drawdown")
    return evidence.runtime_health(rows, {"data_age": 86400, "reconciled_age": 172800, "gross": 0.8, "drawdown": 0.5})


SNAPSHOT = """sn AS (SELECT p_brand || '-' || strftime(l_shipdate, '%Y%m') AS contract, any_value(p_brand) AS root, max(last_day(CAST(l_shipdate AS DATE))) AS ends, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS volume, CAST(sum(l_linenumber) AS BIGINT) AS lots FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
s AS (SELECT contract, CASE WHEN lots % 13 = 0 THEN contract ELSE root END AS root, CASE WHEN lots % 11 = 0 THEN ' ' ELSE 'EX' END AS exchange, ends - 40 + CAST(lots % 3 AS INTEGER) AS seen, ends - 40 + CAST(lots % 5 AS INTEGER) AS session, volume AS bid, volume + CASE WHEN lots % 7 = 0 THEN -1 ELSE 1 END AS ask, volume, ends - 3 AS last_trade, ends - CASE WHEN lots % 17 = 0 THEN 9 ELSE 0 END AS expiry, ends - 6 AS notice, ends - CAST(lots % 6 AS INTEGER) - 2 AS cutoff,
  CASE WHEN lots % 2 = 0 THEN 'PHYSICAL' ELSE 'CASH_SETTLED' END AS delivery, ends - 300 AS spec_from, ends + 20 AS spec_to FROM sn WHERE ends BETWEEN DATE '1998-03-01' AND DATE '1998-09-01')"""


@query(f"""WITH {SNAPSHOT}, g AS (SELECT unnest([{{'gate': 'available', 'ok': true}}, {{'gate': 'identifiers', 'ok': contract <> root}}, {{'gate': 'venue_currency', 'ok': length(trim(exchange)) > 0}}, {{'gate': 'time_zone', 'ok': true}}, {{'gate': 'fresh', 'ok': DATE '1998-06-20' - seen BETWEEN 0 AND 30}}, {{'gate': 'session', 'ok': abs(seen - session) <= 1}},
  {{'gate': 'market_values', 'ok': ask >= bid AND volume >= 0}}, {{'gate': 'expiry', 'ok': last_trade <= expiry AND notice <= expiry}}, {{'gate': 'delivery', 'ok': cutoff <= last_trade AND (delivery = 'CASH_SETTLED' OR cutoff < notice)}}, {{'gate': 'effective', 'ok': spec_from <= DATE '1998-06-20' AND DATE '1998-06-20' < spec_to}}]) AS x FROM s)
SELECT x.gate AS gate, count(*) FILTER (NOT x.ok) AS failing, CASE WHEN count(*) FILTER (NOT x.ok) = 0 THEN 'PASS' ELSE 'BLOCKED' END AS status FROM g GROUP BY x.gate""")
def snapshot_gates(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    s = line.groupBy(F.concat("p_brand", F.lit("-"), F.date_format("l_shipdate", "yyyyMM")).alias("contract")).agg(F.first("p_brand").alias("root"), F.max(F.last_day(F.col("l_shipdate").cast("date"))).alias("ends"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("volume"), F.sum("l_linenumber").alias("lots"))
    s = s.filter("ends BETWEEN DATE '1998-03-01' AND DATE '1998-09-01'")
    day = lambda n: F.expr(f"date_add(ends, CAST({n} AS INT))")
    at = lambda n: day(n).cast("timestamp")
    odd = lambda n: F.col("lots") % n == 0
    rows = s.select(
        "contract", F.when(odd(13), F.col("contract")).otherwise(F.col("root")).alias("root"), F.when(odd(11), " ").otherwise("EX").alias("exchange"), F.lit("usd").alias("currency"), at("-40 + lots % 3").alias("seen"), day("-40 + lots % 5").alias("session"), F.col("volume").alias("bid"), (F.col("volume") + F.when(odd(7), -1).otherwise(1)).alias("ask"),
        F.col("volume").alias("settlement"), "volume", F.lit(0.0).alias("open_interest"), F.lit(50.0).alias("point_value"), F.lit(0.25).alias("tick_size"), F.lit(100.0).alias("margin"), F.lit(0.0).alias("fee"), F.when(odd(2), "physical").otherwise(" cash_settled").alias("delivery"),
        F.expr("date_add(ends, CASE WHEN lots % 17 = 0 THEN -9 ELSE 0 END)").alias("expiry"), day("-6").alias("notice"), day("-3").alias("last_trade"), at("-2 - lots % 6").alias("cutoff"), at("-300").alias("spec_from"), at("20").alias("spec_to"),
    )
    return evidence.snapshot_gates(rows, "1998-06-20 00:00:00", 86400 * 30)


@query(f"""WITH {COSTS}, o AS (SELECT root, count(*) AS fills, count(DISTINCT order_id) AS orders, count(DISTINCT filled) AS sessions, quantile_cont(shortfall, 0.95) AS p95, count(*) FILTER (filled > DATE '1998-06-30') AS recent_fills FROM costs GROUP BY root),
q AS (SELECT DISTINCT p_brand AS root FROM part UNION SELECT 'Brand#none'), j AS (SELECT q.root, coalesce(fills, 0) AS fills, coalesce(orders, 0) AS orders, coalesce(sessions, 0) AS sessions, coalesce(recent_fills, 0) AS recent_fills, p95 FROM q LEFT JOIN o USING (root)),
r AS (SELECT *, list_filter([CASE WHEN fills < 2350 THEN 'fills under 2350' END, CASE WHEN orders < 2200 THEN 'orders under 2200' END, CASE WHEN sessions < 1500 THEN 'sessions under 1500' END, CASE WHEN recent_fills < 120 THEN 'recent_fills under 120' END, CASE WHEN NOT coalesce(p95 > 0, false) THEN 'p95 is not positive' END], lambda x: x IS NOT NULL) AS found FROM j)
SELECT root, fills, orders, sessions, recent_fills, array_to_string(found, '; ') AS reasons, CASE WHEN len(found) = 0 THEN 'PASS' ELSE 'BLOCKED' END AS status FROM r""")
def cost_readiness(spark, sf_dir):
    costs = audit.fill_costs(fills(spark, sf_dir))
    required = read(spark, sf_dir, "part").select(F.col("p_brand").alias("root")).unionByName(spark.range(1).select(F.lit("Brand#none").alias("root"))).distinct()
    recent = costs.filter("filled > DATE '1998-06-30'").groupBy("root").agg(F.count(F.lit(1)).alias("recent_fills"))
    return evidence.cost_readiness(audit.cost_calibration(costs), required, recent, {"fills": 2350, "orders": 2200, "sessions": 1500}, 120)


# Terms and rates ---------------------------------------------------------------

CATALOGUE = """cat0 AS (SELECT n_nationkey AS k, '&' || n_name || CASE WHEN n_nationkey % 9 = 8 THEN '' ELSE '_CCB' END AS symbol, CASE n_nationkey % 6 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' WHEN 3 THEN 'JPY' WHEN 4 THEN 'XXX' ELSE 'EUR' END AS currency, CAST(0.25 * (n_nationkey % 10) AS VARCHAR) AS tick_size, CAST(10.0 + n_nationkey AS VARCHAR) AS point_value, CASE WHEN n_nationkey = 7 THEN 'n/a' ELSE CAST(100.0 * (1 + n_nationkey % 7) AS VARCHAR) END AS margin FROM nation),
cat1 AS (SELECT * FROM cat0 UNION ALL SELECT * FROM cat0 WHERE k = 3), cat AS (SELECT regexp_replace(regexp_replace(symbol, '^&', ''), '_CCB$', '') AS symbol, currency, TRY_CAST(tick_size AS DOUBLE) AS tick_size, TRY_CAST(point_value AS DOUBLE) AS point_value, TRY_CAST(margin AS DOUBLE) AS margin FROM cat1 WHERE symbol LIKE '%\\_CCB' ESCAPE '\\'),
wanted AS (SELECT n_name AS symbol FROM nation WHERE n_nationkey < 22 UNION ALL SELECT 'NATION_99'), own AS (SELECT * FROM cat WHERE symbol IN (SELECT symbol FROM wanted)),
wrong AS (SELECT symbol, 'repeated' AS reason FROM own GROUP BY symbol HAVING count(*) > 1 UNION SELECT symbol, 'missing' FROM wanted WHERE symbol NOT IN (SELECT symbol FROM own) UNION SELECT symbol, 'no rate for its currency' FROM own WHERE currency NOT IN ('USD', 'EUR', 'GBP', 'JPY') UNION SELECT symbol, 'a term is not positive' FROM own WHERE NOT coalesce(tick_size > 0 AND point_value > 0 AND margin > 0, false)),
terms AS (SELECT * FROM own WHERE symbol NOT IN (SELECT symbol FROM wrong))"""


def _catalogue(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    n = read(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    currency = F.element_at(F.array(*map(F.lit, ("USD", "EUR", "GBP", "JPY", "XXX", "EUR"))), k % 6 + 1)
    rows = n.select(k, F.concat(F.lit("&"), "n_name", F.when(k % 9 == 8, "").otherwise("_CCB")).alias("symbol"), currency.alias("currency"), (0.25 * (k % 10)).cast("string").alias("tick_size"), (10.0 + k).cast("string").alias("point_value"), F.when(k == 7, "n/a").otherwise((100.0 * (1 + k % 7)).cast("string")).alias("margin"))
    rows = rows.unionByName(rows.filter("n_nationkey = 3")).drop("n_nationkey")
    wanted = n.filter("n_nationkey < 22").select(F.col("n_name").alias("symbol")).unionByName(spark.range(1).select(F.lit("NATION_99").alias("symbol")))
    return terms.contract_terms(rows, wanted, ["EUR", "GBP", "JPY"])


@query(f"WITH {CATALOGUE} SELECT * FROM terms")
def contract_terms(spark, sf_dir):
    return _catalogue(spark, sf_dir)[0]


@query(f"WITH {CATALOGUE} SELECT * FROM wrong")
def terms_violations(spark, sf_dir):
    return _catalogue(spark, sf_dir)[1]


RATES = f"""{BARS}, days AS (SELECT DISTINCT session FROM bars), q AS (SELECT CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'EUR' WHEN '2' THEN 'GBP' WHEN '3' THEN 'JPY' END AS currency, CAST(o_orderdate AS DATE) AS session, CAST(count(*) AS DOUBLE) AS quote FROM orders WHERE substr(o_orderpriority, 1, 1) IN ('1', '2', '3') GROUP BY ALL),
rt AS (SELECT currency, session, quote * CASE currency WHEN 'EUR' THEN 0.8::DOUBLE WHEN 'GBP' THEN 1.2::DOUBLE ELSE 0.01::DOUBLE END AS rate FROM q),
ok AS (SELECT currency, bool_and(CASE currency WHEN 'EUR' THEN rate > 0.5 AND rate < 8 WHEN 'GBP' THEN rate > 0.8 AND rate < 3 ELSE rate > 0.003 AND rate < 0.2 END) AS plausible FROM rt GROUP BY currency),
rates AS (SELECT c.currency, d.session, last_value(rt.rate IGNORE NULLS) OVER (PARTITION BY c.currency ORDER BY d.session ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) AS rate, coalesce(plausible, false) AS plausible FROM days d CROSS JOIN (SELECT unnest(['EUR', 'GBP', 'JPY']) AS currency) c LEFT JOIN rt ON rt.currency = c.currency AND rt.session = d.session LEFT JOIN ok ON ok.currency = c.currency
  UNION ALL SELECT 'USD', session, 1.0::DOUBLE, true FROM days)"""


def _quotes(spark, sf_dir) -> DataFrame:
    names = F.create_map(*(F.lit(x) for pair in (("1", "EUR"), ("2", "GBP"), ("3", "JPY")) for x in pair))
    return read(spark, sf_dir, "orders").select(F.try_element_at(names, F.substring("o_orderpriority", 1, 1)).alias("currency"), F.col("o_orderdate").cast("date").alias("session")).filter("currency IS NOT NULL").groupBy("currency", "session").agg(F.count(F.lit(1)).cast("double").alias("quote"))


def _rates(spark, sf_dir) -> DataFrame:
    return terms.dollar_rates(_quotes(spark, sf_dir), sessions(bars(spark, sf_dir)), {"EUR": 0.8, "GBP": 1.2, "JPY": 0.01}, {"EUR": (0.5, 8.0), "GBP": (0.8, 3.0), "JPY": (0.003, 0.2)})


@query(f"WITH {RATES} SELECT currency, session, {_r('rate')}, plausible FROM rates")
def dollar_rates(spark, sf_dir):
    return _rates(spark, sf_dir)


@query(f"WITH {CATALOGUE}, {RATES} SELECT symbol, session, round(point_value * rate, 6) + 0.0::DOUBLE AS point_value_usd, round(margin * rate, 6) + 0.0::DOUBLE AS margin_usd FROM terms JOIN rates USING (currency)")
def dollar_terms(spark, sf_dir):
    return terms.dollar_terms(_catalogue(spark, sf_dir)[0], _rates(spark, sf_dir))


@query(f"""WITH {RATES}, fu AS (SELECT currency, session, rate FROM rt WHERE session <= DATE '1996-06-30'), sp AS (SELECT currency, session, rate * 2 AS spot FROM rt WHERE day(session) % 2 = 1), j AS (SELECT currency, max(session) AS j, arg_max(rate, session) AS f FROM fu GROUP BY currency),
a AS (SELECT sp.currency, arg_max(spot, session) AS s FROM sp JOIN j USING (currency) WHERE session <= j GROUP BY sp.currency), b AS (SELECT currency, j, f / s AS basis FROM j LEFT JOIN a USING (currency)),
al AS (SELECT currency, session, rate FROM fu UNION ALL SELECT sp.currency, session, spot * basis FROM sp JOIN b USING (currency) WHERE session > j),
g AS (SELECT b.currency, d.session, basis, last_value(al.rate IGNORE NULLS) OVER (PARTITION BY b.currency ORDER BY d.session ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) AS rate FROM days d CROSS JOIN b LEFT JOIN al ON al.currency = b.currency AND al.session = d.session) SELECT currency, session, {_r('rate', 'basis')} FROM g""")
def spliced_rates(spark, sf_dir):
    q = _quotes(spark, sf_dir).withColumn("rate", F.col("quote") * F.when(F.col("currency") == "EUR", 0.8).when(F.col("currency") == "GBP", 1.2).otherwise(0.01))
    futures = q.filter("session <= DATE '1996-06-30'").select("currency", "session", "rate")
    spot = q.filter("day(session) % 2 = 1").select("currency", "session", (F.col("rate") * 2).alias("rate"))
    return terms.spliced_rates(futures, spot, sessions(bars(spark, sf_dir)))


@query("""WITH s AS (SELECT CAST(o_orderdate AS DATE) AS session, 100 - CAST(count(*) AS DOUBLE) / 4 AS settle FROM orders GROUP BY 1), r AS (SELECT (100 - settle) / 100 AS rate, session FROM s), g AS (SELECT count(*) AS sessions, min(rate) AS lowest, max(rate) AS highest, (max(session) - min(session)) / 365.2425 AS years FROM r)
SELECT sessions, round(lowest, 6) + 0.0::DOUBLE AS lowest, round(highest, 6) + 0.0::DOUBLE AS highest, round(years, 6) + 0.0::DOUBLE AS years, CASE WHEN lowest < 0 OR highest > 0.2 OR (years > 10 AND lowest >= 0.03) THEN 'BLOCKED' ELSE 'PASS' END AS status FROM g""")
def financing_guard(spark, sf_dir):
    s = read(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("session")).agg((100 - F.count(F.lit(1)).cast("double") / 4).alias("settle"))
    return terms.financing_rates(s)[1]


# Funds ------------------------------------------------------------------------

FUND = f"""{BARS}, fs AS (SELECT symbol, session, close AS unadjusted, volume, turnover, CASE WHEN volume::BIGINT % 997 = 0 THEN 2.0::DOUBLE WHEN volume::BIGINT % 97 = 0 THEN 1.02::DOUBLE ELSE 1.0::DOUBLE END AS s FROM bars),
fund AS (SELECT symbol, session, unadjusted, volume, turnover, exp(sum(ln(s)) {W})) AS factor, unadjusted * exp(sum(ln(s)) {W})) AS close FROM fs),
fl AS (SELECT *, factor / lag(factor) {W}) AS step, lag(unadjusted) {W}) AS before, abs(close / lag(close) {W}) - unadjusted / lag(unadjusted) {W})) AS gap FROM fund)"""


def _fund(spark, sf_dir) -> DataFrame:
    whole = F.col("volume").cast("long")
    step = F.when(whole % 997 == 0, 2.0).when(whole % 97 == 0, 1.02).otherwise(1.0)
    rows = bars(spark, sf_dir).withColumn("f", F.exp(F.sum(F.log(step)).over(by_symbol())))
    raw = rows.select("symbol", "session", (F.col("close") * F.col("f")).alias("close"), F.col("close").alias("unadjusted"), "volume", "turnover")
    return funds.fund_rows(raw)[0]


@query(f"""WITH {FUND} SELECT symbol, session, {_r('step', 'before')}, CASE WHEN abs(step - 1) > 0.15 THEN 'split' ELSE 'distribution' END AS kind, round(CASE WHEN abs(step - 1) <= 0.15 THEN before * (1 - 1 / step) END, 6) + 0.0::DOUBLE AS distribution FROM fl WHERE abs(step - 1) > 1e-6""")
def fund_events(spark, sf_dir):
    return funds.adjustment_events(_fund(spark, sf_dir))


@query(f"""WITH {FUND}, d AS (SELECT symbol, count(*) AS sessions, (max(session) - min(session)) / 365.2425 AS years, count(*) FILTER (abs(step - 1) > 1e-6 AND abs(step - 1) <= 0.15) AS distributions, count(*) FILTER (abs(step - 1) > 0.15) AS splits, coalesce(product(step) FILTER (abs(step - 1) > 0.15), 1.0::DOUBLE) AS split_product,
  arg_max(factor, session) / arg_min(factor, session) AS whole, coalesce(quantile_cont(gap, 0.5) FILTER (NOT coalesce(abs(step - 1) > 1e-6, false)), 0) AS median_gap, coalesce(max(gap) FILTER (NOT coalesce(abs(step - 1) > 1e-6, false)), 0) AS largest_gap FROM fl GROUP BY symbol),
e AS (SELECT *, whole / split_product AS adjustment, distributions / years AS distributions_a_year, pow(whole / split_product, 1 / years) - 1 AS implied_yield FROM d)
SELECT symbol, sessions, {_r('years')}, distributions, splits, {_r('split_product', 'median_gap', 'largest_gap', 'adjustment', 'distributions_a_year', 'implied_yield')} FROM e""")
def fund_dividends(spark, sf_dir):
    return funds.dividend_report(_fund(spark, sf_dir))


@query(f"WITH {BARS} SELECT symbol, CAST(year(session) AS INTEGER) AS year, round(quantile_cont(turnover, 0.5), 6) + 0.0::DOUBLE AS median FROM bars GROUP BY ALL")
def yearly_turnover(spark, sf_dir):
    return funds.yearly_turnover(bars(spark, sf_dir))


@query(f"WITH {BARS}, y AS (SELECT symbol, CAST(year(session) AS INTEGER) AS year, quantile_cont(turnover, 0.5) AS median FROM bars GROUP BY ALL) SELECT symbol, year, {_r('median')} FROM y WHERE median < 190000")
def thin_years(spark, sf_dir):
    return funds.thin_years(bars(spark, sf_dir), 190000.0)


@query(f"""WITH {BARS}, d AS (SELECT symbol, 1000.0::DOUBLE * ascii(symbol) AS declared FROM (SELECT DISTINCT symbol FROM bars)), s AS (SELECT symbol, quantile_cont(turnover, 0.5) FILTER (session BETWEEN DATE '1996-01-01' AND DATE '1997-12-31') AS window_median, quantile_cont(turnover, 0.5) AS life_median FROM bars GROUP BY symbol),
r AS (SELECT *, window_median / declared AS window_ratio, life_median / declared AS life_ratio FROM d LEFT JOIN s USING (symbol)) SELECT symbol, {_r('declared', 'window_median', 'life_median', 'window_ratio', 'life_ratio')} FROM r""")
def turnover_audit(spark, sf_dir):
    b = bars(spark, sf_dir)
    return funds.turnover_audit(b, b.select("symbol").distinct().withColumn("declared", 1000.0 * F.ascii("symbol")), "1996-01-01", "1997-12-31")


@query(f"WITH {BARS}, f AS (SELECT symbol, min(session) AS first FROM bars GROUP BY symbol) SELECT max(first) AS session, count(*) AS symbols FROM f")
def fully_quoted(spark, sf_dir):
    return funds.fully_quoted(bars(spark, sf_dir))


COMMON = f"""{BARS}, ins AS (SELECT * FROM bars WHERE session BETWEEN DATE '1995-06-01' AND DATE '1997-12-31'), seen AS (SELECT session, count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM bars) AS whole FROM ins GROUP BY session)"""


@query(f"WITH {COMMON}, k AS (SELECT i.symbol, i.session, close, close / lag(close) OVER (PARTITION BY i.symbol ORDER BY i.session) - 1 AS ret FROM ins i JOIN seen s ON s.session = i.session AND whole) SELECT symbol, session, {_r('close', 'ret')} FROM k")
def common_panel(spark, sf_dir):
    return funds.common_panel(bars(spark, sf_dir), "1995-06-01", "1997-12-31", "1998-06-30")[0].select("symbol", "session", "close", "ret")


@query(f"WITH {COMMON} SELECT count(*) AS union_sessions, count(*) FILTER (whole) AS common_sessions, count(*) FILTER (NOT whole) AS dropped, max(session) FILTER (whole) AS last_session, 'PASS' AS status FROM seen")
def common_counts(spark, sf_dir):
    return funds.common_panel(bars(spark, sf_dir), "1995-06-01", "1997-12-31", "1998-06-30")[1]


@query("""WITH g AS (SELECT *, sum(CASE WHEN ts - before <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS before FROM events)),
w AS (SELECT event_type AS component, min(ts) AS since, max(ts) + INTERVAL 30 MINUTE AS stale_at, count(*) AS beats FROM g GROUP BY event_type, s) SELECT component, strftime(since, '%Y-%m-%d %H:%M:%S') AS since, strftime(stale_at, '%Y-%m-%d %H:%M:%S') AS stale_at, beats FROM w WHERE stale_at <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_stale_components(spark, sf_dir):
    out = streams.finish(streams.stale_components(streams.stream(spark, f"{sf_dir}/events.parquet"), "event_type"), "stale")
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select(F.col("event_type").alias("component"), at("since"), at("stale_at"), "beats")


# Evidence of release gates -------------------------------------------------------

RELEASE_GATES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("""WITH r AS (SELECT o_orderkey // 4 AS run, o_orderpriority AS gate, o_orderkey % 1100 AS artifact, o_orderdate AS issued, o_orderdate + to_days(CAST(o_orderkey % 2500 - 20 AS INTEGER)) AS expires, sha256(CAST(o_orderkey // 4 + CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS VARCHAR)) AS run_digest,
  CASE WHEN o_custkey % 29 = 0 THEN ' ' ELSE 'a' || o_custkey % 5 END AS author, 'A' || o_orderkey % 5 AS reviewer, o_totalprice > 50000 AS approved, o_orderstatus = 'P' AND o_orderkey % 3 = 0 AS revoked FROM orders),
a AS (SELECT doc_id AS artifact, sha256(text) AS signed, sha256(CASE WHEN doc_id % 17 = 0 THEN text || '!' ELSE text END) AS now FROM documents),
f AS (SELECT run, gate, concat_ws(',', CASE WHEN signed IS NULL THEN 'digest' END, CASE WHEN a.artifact IS NULL THEN 'artifact missing' END, CASE WHEN a.artifact IS NOT NULL AND (now = signed) IS NOT TRUE THEN 'artifact changed' END, CASE WHEN (expires > issued) IS NOT TRUE THEN 'dates' END, CASE WHEN issued > TIMESTAMP '2000-01-01' THEN 'not yet issued' END, CASE WHEN expires <= TIMESTAMP '2000-01-01' THEN 'expired' END,
  CASE WHEN run_digest <> sha256(CAST(run AS VARCHAR)) THEN 'other run' END, CASE WHEN trim(author) = '' THEN 'names' END, CASE WHEN lower(trim(author)) = lower(reviewer) THEN 'own review' END, CASE WHEN approved IS NOT TRUE THEN 'not approved' END, CASE WHEN revoked IS NOT FALSE THEN 'revoked' END) AS found FROM r LEFT JOIN a USING (artifact)),
g AS (SELECT run, gate, count(*) AS records, min(found) AS found FROM f GROUP BY ALL), n AS (SELECT DISTINCT run, unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) AS gate FROM r),
o AS (SELECT run, gate, coalesce(records, 0) AS records, CASE WHEN records IS NULL THEN 'no record' WHEN records > 1 THEN 'several records' ELSE found END AS reasons FROM n LEFT JOIN g USING (run, gate))
SELECT *, CASE WHEN reasons = '' THEN 'PASS' ELSE 'BLOCKED' END AS status FROM o""")
def evidence_gates(spark, sf_dir):
    docs, k = read(spark, sf_dir, "documents"), F.col("o_orderkey")
    signed = docs.select(F.col("doc_id").alias("artifact"), F.sha2("text", 256).alias("digest"))
    now = docs.select(F.col("doc_id").alias("artifact"), F.when(F.col("doc_id") % 17 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content"))
    run = F.floor(k / 4)
    name = lambda prefix, key: F.concat(F.lit(prefix), (F.col(key) % 5).cast("string"))
    records = read(spark, sf_dir, "orders").select(
        run.alias("run"), F.col("o_orderpriority").alias("gate"), (k % 1100).alias("artifact"), F.col("o_orderdate").cast("timestamp").alias("issued"), (F.col("o_orderdate") + F.make_dt_interval(days=(k % 2500 - 20).cast("int"))).cast("timestamp").alias("expires"),
        F.sha2((run + F.when(k % 13 == 0, 1).otherwise(0)).cast("string"), 256).alias("run_digest"), F.when(F.col("o_custkey") % 29 == 0, " ").otherwise(name("a", "o_custkey")).alias("author"), name("A", "o_orderkey").alias("reviewer"),
        (F.col("o_totalprice") > 50000).alias("approved"), ((F.col("o_orderstatus") == "P") & (k % 3 == 0)).alias("revoked"),
    ).join(signed, "artifact", "left")
    runs = records.select("run", F.sha2(F.col("run").cast("string"), 256).alias("digest")).distinct()
    return evidence.evidence_gates(records, now, runs, RELEASE_GATES, "2000-01-01")
