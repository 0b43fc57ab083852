"""Queries of file scans, inputs cut at a date, catalogues, digests, recovery and funded paths, with their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import allocation, controls, evidence, intake, reports, signals, terms
from ledgerline.operators.panel import align, bad_rows, business_days, simple_returns
from ledgerline.plans.catalogue import W, _r, query
from ledgerline.plans.scenarios import figures_sql
from ledgerline.plans.studies import FUNDED, clip, ewm_sql, funded, over
from ledgerline.sources.files import manifest, scan_dated, scan_field, scratch, write_dated, write_panel
from ledgerline.sources.views import BARS, PATHS, bars, parts_for, paths, read

# Fields of files -----------------------------------------------------------------

KINDS = {"session": "date", "high": "double", "close": "double", "volume": "double", "delivery": "int"}
LABELLED = f"{BARS}, b AS (SELECT symbol, session, high, CASE WHEN volume::BIGINT % 13 <> 0 THEN close END AS close, volume, CAST(strftime(session + 20, '%Y%m') AS INTEGER) AS delivery FROM bars)"
WEEKDAYS = f"""{LABELLED}, days AS (SELECT CAST(d AS DATE) AS session FROM (SELECT unnest(generate_series((SELECT min(session) FROM bars), (SELECT max(session) FROM bars), INTERVAL 1 DAY)) AS d) WHERE isodow(d) <= 5),
grid AS (SELECT symbol, session, high, close, volume FROM days CROSS JOIN (SELECT DISTINCT symbol FROM bars) LEFT JOIN b USING (symbol, session))"""


def _files(spark, sf_dir) -> str:
    """Delimited files of the bars; every thirteenth close is blank."""
    at = scratch(spark, "fields-csv")
    close = F.when(F.col("volume").cast("long") % 13 != 0, F.col("close"))
    rows = bars(spark, sf_dir).select("symbol", "session", "high", close.alias("close"), "volume", F.date_format(F.date_add("session", 20), "yyyyMM").cast("int").alias("delivery"))
    write_panel(rows, at)
    return at


@query(f"WITH {WEEKDAYS} SELECT symbol, session, {_r('high', places=9)} FROM grid", places=9)
def observed_prices(spark, sf_dir):
    return scan_field(spark, _files(spark, sf_dir), KINDS, "high", business_days(bars(spark, sf_dir)))


@query(f"""WITH {WEEKDAYS}, f AS (SELECT symbol, session, last_value(close IGNORE NULLS) {W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS close FROM grid) SELECT symbol, session, {_r('close', places=9)} FROM f""", places=9)
def traded_closes(spark, sf_dir):
    return scan_field(spark, _files(spark, sf_dir), KINDS, "close", business_days(bars(spark, sf_dir)), 2)


@query(f"WITH {WEEKDAYS} SELECT symbol, session, {_r('volume')} FROM grid")
def contract_volumes(spark, sf_dir):
    return scan_field(spark, _files(spark, sf_dir), KINDS, "volume", business_days(bars(spark, sf_dir)))


@query(f"WITH {LABELLED} SELECT symbol, session, delivery FROM b")
def delivery_labels(spark, sf_dir):
    return scan_field(spark, _files(spark, sf_dir), KINDS, "delivery")


@query(f"""WITH {BARS}, t AS (SELECT symbol, CAST(year(session) AS INTEGER) AS year, string_agg(strftime(session, '%Y-%m-%d') || ',' || CAST(volume AS BIGINT) || ',' || CAST(CAST(turnover AS DECIMAL(18,2)) AS VARCHAR), chr(10) ORDER BY session) || chr(10) AS content FROM bars GROUP BY 1, 2)
SELECT symbol, year, CAST(strlen(content) AS BIGINT) AS bytes, sha256(content) AS sha256 FROM t""")
def input_manifest(spark, sf_dir):
    """One file for each symbol and year of the bars."""
    at = scratch(spark, "manifest")
    line = F.concat_ws(",", F.date_format("session", "yyyy-MM-dd"), F.col("volume").cast("long").cast("string"), F.col("turnover").cast("decimal(18,2)").cast("string"))
    lines = bars(spark, sf_dir).groupBy("symbol", F.year("session").alias("year")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("value"))
    lines.write.mode("overwrite").partitionBy("symbol", "year").text(at)
    found = manifest(spark, at).filter(F.col("path").rlike("/part-[^/]*$"))
    return found.select(F.regexp_extract("path", "symbol=([^/]*)/", 1).alias("symbol"), F.regexp_extract("path", "year=([^/]*)/", 1).cast("int").alias("year"), "bytes", "sha256")


# Inputs cut at a date --------------------------------------------------------------

CEILING = "1997-06-30"


def _dated(spark, sf_dir) -> str:
    at = scratch(spark, "dated")
    write_dated(bars(spark, sf_dir).select("symbol", "session", "close", "turnover"), at)
    return at


@query(f"""WITH {BARS}, c AS (SELECT symbol, session, close, turnover FROM bars WHERE session <= DATE '{CEILING}'), n AS (SELECT session FROM c GROUP BY session HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM c)),
f AS (SELECT 'traded' AS frame, c.* FROM c SEMI JOIN n USING (session) UNION ALL SELECT 'life', symbol, session, close, turnover FROM (SELECT DISTINCT session FROM c) CROSS JOIN (SELECT DISTINCT symbol FROM c) LEFT JOIN c USING (symbol, session))
SELECT frame, symbol, session, {_r('close', 'turnover')} FROM f""")
def allocation_inputs(spark, sf_dir):
    traded, life = intake.allocation_inputs(scan_dated(spark, _dated(spark, sf_dir), CEILING))
    return traded.withColumn("frame", F.lit("traded")).unionByName(life.withColumn("frame", F.lit("life")))


CUSTODY_YEARS = [1994, 1995, 1996, 1997, 1998]


def _stitched_sql(name: str, source: str) -> str:
    """CTE ``name`` (session, fold, member, ret) of a walk-forward on paths."""
    return f"""{name}t AS (SELECT fold, member, round(avg(ret) / nullif(stddev_pop(ret), 0), 12) AS score FROM {source} JOIN y ON year(session) < fold GROUP BY ALL), {name}c AS (SELECT fold, member FROM {name}t QUALIFY row_number() OVER (PARTITION BY fold ORDER BY score DESC, member) = 1),
{name} AS (SELECT session, fold, member, ret FROM {source} JOIN {name}c USING (member) WHERE year(session) = fold AND session <= DATE '{CEILING}')"""


@query(f"""WITH {PATHS}, y AS (SELECT unnest({CUSTODY_YEARS}) AS fold), cutp AS (SELECT * FROM paths WHERE session <= DATE '{CEILING}'), {_stitched_sql('w', 'paths')}, {_stitched_sql('g', 'cutp')},
j AS (SELECT w.ret AS a, g.ret AS b FROM w FULL JOIN g USING (session))
SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS compared, count(*) FILTER (a IS NULL OR b IS NULL) AS missing, round(max(abs(a - b)), 6) + 0.0::DOUBLE AS drift, (SELECT string_agg(DISTINCT fold || ':' || member, ',' ORDER BY fold || ':' || member) FROM g) AS guarded_choice, (SELECT string_agg(DISTINCT fold || ':' || member, ',' ORDER BY fold || ':' || member) FROM w) AS whole_choice,
  (SELECT max(session) FROM bars WHERE session <= DATE '{CEILING}') AS guarded_last, 'PASS' AS status FROM j""")
def custody_report(spark, sf_dir):
    at = _dated(spark, sf_dir)

    def work(panel: DataFrame) -> DataFrame:
        filled = align(panel.select("symbol", "session", "close"), ["close"], limit=None)
        ret = F.greatest(F.lit(-0.05), F.least(F.lit(0.05), F.col("ret") * 0.01))
        own = simple_returns(filled, "close").select(F.col("symbol").alias("member"), "session", F.coalesce(ret, F.lit(0.0)).alias("ret"))
        return intake.stitched(own, CUSTODY_YEARS)

    return intake.custody_report(work, scan_dated(spark, at), scan_dated(spark, at, CEILING), CEILING)


@query("""WITH p AS (SELECT c_nationkey, o_custkey AS symbol, CAST(o_orderdate AS DATE) AS session, CAST(c_acctbal AS DOUBLE) AS balance FROM orders JOIN customer ON o_custkey = c_custkey),
v AS (SELECT symbol, session, 'repeated session' AS reason FROM p GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT symbol, session, 'balance is negative or not finite' FROM p WHERE balance < 0) SELECT symbol, session, reason, count(*) AS rows FROM v GROUP BY ALL""")
def panel_violations(spark, sf_dir):
    own = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("symbol"), F.col("c_acctbal").cast("double").alias("balance"))
    panel = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("symbol"), F.col("o_orderdate").cast("date").alias("session")).join(own, "symbol")
    return bad_rows(panel, ["balance"]).groupBy("symbol", "session", "reason").agg(F.count(F.lit(1)).alias("rows"))


# Catalogues and membership -----------------------------------------------------------


@query("SELECT p_type AS symbol FROM part EXCEPT SELECT p_type FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_type HAVING 3 * sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS DECIMAL(18,2)) ELSE 0 END) > sum(CAST(l_quantity AS DECIMAL(18,2)))")
def eligible_symbols(spark, sf_dir):
    """Part types but those of which more than a third was returned."""
    part = read(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("symbol"))
    line, q = read(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")), F.col("l_quantity").cast("decimal(18,2)")
    back = line.groupBy("symbol").agg(F.sum(F.when(F.col("l_returnflag") == "R", q).otherwise(0)).alias("back"), F.sum(q).alias("q")).filter("3 * back > q")
    return terms.without(part.select("symbol").distinct(), back)


CATALOGUE = """f0 AS (SELECT l_suppkey AS k, min(CAST(l_shipdate AS DATE)) AS d FROM lineitem GROUP BY 1), f AS (SELECT k, CASE WHEN k % 19 = 5 THEN ' ' WHEN k % 23 = 7 THEN 'F' || (k - 1) ELSE 'F' || k END AS symbol, CASE WHEN k % 17 = 3 THEN '31/2/95' WHEN k % 29 = 4 THEN strftime(d, '%Y-%m-%d') ELSE day(d) || '/' || month(d) || '/' || strftime(d, '%y') END AS text, d FROM f0),
t AS (SELECT nullif(trim(symbol), '') AS symbol, CASE WHEN k % 17 <> 3 AND k % 29 <> 4 THEN d END AS first_quoted FROM f),
bad AS (SELECT DISTINCT symbol, 'no symbol' AS reason FROM t WHERE symbol IS NULL UNION ALL SELECT DISTINCT symbol, 'no date' FROM t WHERE first_quoted IS NULL UNION ALL SELECT symbol, 'repeated' FROM t WHERE symbol IS NOT NULL GROUP BY symbol HAVING count(*) > 1)"""


def _catalogue(spark, sf_dir):
    k, d = F.col("k"), F.col("d")
    first = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.min(F.col("l_shipdate").cast("date")).alias("d"))
    symbol = F.when(k % 19 == 5, " ").when(k % 23 == 7, F.concat(F.lit("F"), (k - 1).cast("string"))).otherwise(F.concat(F.lit("F"), k.cast("string")))
    text = F.when(k % 17 == 3, "31/2/95").when(k % 29 == 4, d.cast("string")).otherwise(F.date_format(d, "d/M/yy"))
    return intake.fund_catalogue(first.select(symbol.alias("symbol"), text.alias("first_quoted")))


@query(f"WITH {CATALOGUE} SELECT symbol, first_quoted FROM t WHERE symbol IS NOT NULL AND symbol NOT IN (SELECT symbol FROM bad WHERE symbol IS NOT NULL)")
def fund_catalogue(spark, sf_dir):
    return _catalogue(spark, sf_dir)[0]


@query(f"WITH {CATALOGUE} SELECT symbol, reason FROM bad")
def fund_catalogue_violations(spark, sf_dir):
    return _catalogue(spark, sf_dir)[1]


@query(f"""WITH {BARS}, m AS (SELECT symbol, session, coalesce(({over('quantile_cont(turnover, 0.5)', '1', 63)}) >= 100000 AND count(turnover) {W}) >= 315, false) AS member FROM bars), g AS (SELECT symbol, session, coalesce(lag(member) {W}), false) AS member FROM m)
SELECT symbol, min(session) FILTER (member) AS entry, count(*) FILTER (member) AS sessions FROM g GROUP BY symbol""")
def entry_sessions(spark, sf_dir):
    return intake.entry_sessions(allocation.membership(bars(spark, sf_dir), floor=100000.0))


@query("""WITH s AS (SELECT o_custkey AS customer, min(CAST(o_orderdate AS DATE)) AS start, max(CAST(o_orderdate AS DATE)) AS "end" FROM orders GROUP BY 1), y AS (SELECT *, unnest(range(CAST(year(start) AS BIGINT) + 1, CAST(year("end") AS BIGINT) + 1, 2)) AS y FROM s)
SELECT customer, start, "end", make_date(y, 1, 1) AS boundary FROM y WHERE make_date(y, 1, 1) < "end" """)
def year_starts(spark, sf_dir):
    spans = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("customer")).agg(F.min(F.col("o_orderdate").cast("date")).alias("start"), F.max(F.col("o_orderdate").cast("date")).alias("end"))
    return intake.year_starts(spans, 2)


# Digests -------------------------------------------------------------------------


def digest_sql(source: str, group: str, key: str, json: str) -> str:
    """The statement of ``canonical_digest`` on a CTE: ``json`` is the row's text."""
    return f"""r AS (SELECT {group}, coalesce(trim({key}), '') AS k, {json} AS j FROM {source}),
p AS (SELECT {group}, substr(md5(k), 1, 2) AS p, count(*) AS n, count(*) - count(DISTINCT nullif(k, '')) AS bad, sha256(string_agg(j, chr(10) ORDER BY k, j)) AS h FROM r GROUP BY ALL)
SELECT {group}, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(bad) AS BIGINT) AS wrong, CASE WHEN sum(bad) = 0 THEN sha256(string_agg(h, chr(10) ORDER BY p)) END AS digest FROM p GROUP BY {group}"""


@query("""WITH f AS (SELECT p_brand AS root, concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) AS fill_id, CAST(l_orderkey AS BIGINT) AS order_id, l_returnflag AS side, CAST(l_quantity AS BIGINT) AS quantity, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount FROM lineitem JOIN part ON l_partkey = p_partkey), """
       + digest_sql("f", "root", "fill_id", """'{"fill_id":"' || fill_id || '","order_id":' || order_id || ',"side":"' || side || '","quantity":' || quantity || ',"amount":' || amount || '}'"""))
def fill_digest(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("root")), F.col("l_partkey") == F.col("p_partkey"))
    own = F.concat_ws(":", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")), F.date_format("l_shipdate", "yyyyMMdd"))
    rows = line.select("root", own.alias("fill_id"), F.col("l_orderkey").cast("long").alias("order_id"), F.col("l_returnflag").alias("side"), F.col("l_quantity").cast("long").alias("quantity"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"))
    return intake.canonical_digest(rows, "root", "fill_id", ["order_id", "side", "quantity", "amount"])


@query("""WITH f AS (SELECT c_nationkey AS account, p_type AS contract, CAST(sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS BIGINT) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2), """
       + digest_sql("f", "account", "contract", """'{"contract":"' || contract || '","quantity":' || quantity || '}'"""))
def position_digest(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("contract")), F.col("l_partkey") == F.col("p_partkey"))
    order = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("account")), F.col("o_custkey") == F.col("c_custkey"))
    q = F.col("l_quantity").cast("long")
    rows = line.join(order, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("account", "contract").agg(F.sum(F.when(F.col("l_returnflag") == "R", -q).otherwise(q)).alias("quantity"))
    return intake.canonical_digest(rows, "account", "contract", ["quantity"])


SERIAL = """s AS (SELECT p_brand || '-' || strftime(l_shipdate, '%Y%m') AS contract, any_value(p_brand) AS root, max(last_day(CAST(l_shipdate AS DATE))) AS ends, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS BIGINT) AS volume FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"""


def _serial(spark, sf_dir) -> DataFrame:
    """A snapshot of contracts that passes its gates, with blanks around its texts."""
    line = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    s = line.groupBy(F.concat("p_brand", F.lit("-"), F.date_format("l_shipdate", "yyyyMM")).alias("contract")).agg(F.first("p_brand").alias("root"), F.max(F.last_day(F.col("l_shipdate").cast("date"))).alias("ends"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("long").alias("volume"))
    at = lambda n: F.date_sub("ends", n)
    instant = lambda text: F.lit(text).cast("timestamp")
    number = F.col("volume").cast("double")
    return s.select(
        F.concat(F.lit(" "), "contract").alias("contract"), F.concat("root", F.lit(" ")).alias("root"), F.lit(" ex").alias("exchange"), F.lit("usd ").alias("currency"), instant("1998-06-19 23:58:00").alias("seen"), F.lit("1998-06-19").cast("date").alias("session"), number.alias("bid"), (number + 1).alias("ask"),
        number.alias("settlement"), number.alias("volume"), F.lit(0.0).alias("open_interest"), F.lit(50.0).alias("point_value"), F.lit(0.25).alias("tick_size"), F.lit(100.0).alias("margin"), F.lit(0.0).alias("fee"), F.when(F.col("volume") % 2 == 0, "physical").otherwise(" cash_settled").alias("delivery"),
        F.col("ends").alias("expiry"), at(2).alias("notice"), at(3).alias("last_trade"), at(5).cast("timestamp").alias("cutoff"), instant("1990-01-01 00:00:00").alias("spec_from"), instant("2030-01-01 00:00:00").alias("spec_to"),
    )


@query(f"WITH {SERIAL} SELECT contract, root, 'EX' AS exchange, 'USD' AS currency, CASE WHEN volume % 2 = 0 THEN 'PHYSICAL' ELSE 'CASH_SETTLED' END AS delivery, volume, ends AS expiry FROM s")
def validated_contracts(spark, sf_dir):
    return evidence.validated_snapshot(_serial(spark, sf_dir), "1998-06-20 00:00:00").select("contract", "root", "exchange", "currency", "delivery", F.col("volume").cast("long").alias("volume"), "expiry")


@query(f"""WITH {SERIAL}, """ + digest_sql("s", "root", "contract", """'{"contract":"' || contract || '","exchange":"EX","delivery":"' || CASE WHEN volume % 2 = 0 THEN 'PHYSICAL' ELSE 'CASH_SETTLED' END || '","lots":' || volume || ',"expiry":"' || strftime(ends, '%Y-%m-%d') || '"}'"""))
def snapshot_digest(spark, sf_dir):
    rows = evidence.validated_snapshot(_serial(spark, sf_dir), "1998-06-20 00:00:00").withColumn("lots", F.col("volume").cast("long"))
    return intake.canonical_digest(rows, "root", "contract", ["exchange", "delivery", "lots", "expiry"])


# Recovery ------------------------------------------------------------------------


@query("""WITH l AS (SELECT o_orderpriority AS book, o_orderkey AS key, o_custkey AS cust, CAST(o_orderdate AS DATE) AS day, CAST(l_quantity AS BIGINT) AS q, l_returnflag = 'R' AS waits FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
o AS (SELECT book, key, any_value(cust) AS cust, sum(q) AS ordered, coalesce(sum(q) FILTER (NOT waits), 0) AS filled, count(*) FILTER (NOT waits) AS fills FROM l GROUP BY ALL),
w AS (SELECT *, book = '1-URGENT' AND cust % 50 = 1 AS unheard FROM o),
b AS (SELECT book, count(*) AS orders, sum(CASE WHEN unheard AND fills > 0 THEN 1 ELSE 0 END) AS faults, count(*) FILTER (book = '5-LOW' AND cust % 97 = 2) AS breaks FROM w GROUP BY book)
SELECT book, 'journal_replay' AS gate, orders AS observed, CASE WHEN faults = 0 THEN 'PASS' ELSE 'BLOCKED' END AS status, CASE WHEN faults = 0 THEN 'order states replay' ELSE CAST(faults AS BIGINT) || ' faults' END AS reason FROM b
UNION ALL SELECT book, 'open_orders', CASE WHEN faults = 0 THEN breaks END, CASE WHEN faults = 0 AND breaks = 0 THEN 'PASS' ELSE 'BLOCKED' END, CASE WHEN faults > 0 THEN 'journal replay failed' WHEN breaks = 0 THEN 'open orders agree' ELSE 'open orders differ' END FROM b""")
def recovery_report(spark, sf_dir):
    """Journals of the orders with a line: returned lines wait; urgent orders of some customers miss their acknowledgement, some low ones differ at the broker."""
    line = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q"), (F.col("l_returnflag") == "R").alias("waits"), F.col("l_shipdate").cast("timestamp").alias("shipped"))
    order = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("book"), F.col("o_custkey").alias("cust"), F.col("o_orderdate").cast("timestamp").alias("day"))
    # The number of lines stands in the files; a task's share of orders stays the same as they grow.
    if parts := parts_for(spark, read(spark, sf_dir, "lineitem").count()):
        line, order = line.repartition(parts, "key"), order.repartition(parts, "key")
    own = line.groupBy("key").agg(F.sum("q").alias("ordered"), F.sum(F.when(F.col("waits"), F.col("q")).otherwise(0)).alias("open"))
    order = order.join(own, "key")
    unheard = (F.col("book") == "1-URGENT") & (F.col("cust") % 50 == 1)
    event = lambda name, key, ts, q: [F.lit(name).alias("event"), key.alias("event_id"), ts.alias("ts"), q.alias("quantity")]
    asked = order.select("book", "key", *event("OUTBOX", F.lit("1"), F.col("day"), F.col("ordered")))
    heard = order.filter(~unheard).select("book", "key", *event("ACK", F.lit("2"), F.col("day"), F.lit(0)))
    each = F.concat_ws(":", F.lit("3"), *(F.col(c).cast("string") for c in ("l_linenumber", "l_partkey", "l_suppkey")), F.col("shipped").cast("string"), F.col("q").cast("string"))
    filled = line.filter("NOT waits").join(order.select("key", "book", "day"), "key").select("book", "key", *event("FILL", each, F.greatest("shipped", "day"), F.col("q")))
    theirs = order.select("book", "key", (F.col("open") + F.when((F.col("book") == "5-LOW") & (F.col("cust") % 97 == 2), 1).otherwise(0)).alias("open"))
    return intake.recovery_report(asked.unionByName(heard).unionByName(filled), theirs, parts)


# Funded and scaled paths -----------------------------------------------------------


@query(f"""WITH {FUNDED}, e AS (SELECT *, interest * CASE WHEN member = 'AF' THEN 1.01::DOUBLE ELSE 1.0::DOUBLE END AS earned, CASE WHEN unrated THEN 0.0::DOUBLE ELSE greatest(rate - 0.002, 0.0::DOUBLE) * days / 360 END AS due, sum((NOT unrated)::INT) OVER (PARTITION BY member ORDER BY session) AS run FROM fn),
x AS (SELECT member, max(abs(earned - due)) AS accrual, max(abs(funded - ret - earned)) AS funded_return, abs(sum(days) - (max(session) - min(session)))::DOUBLE AS days_complete, greatest(0.0::DOUBLE, max(-rate), max(rate - 0.25)) AS rate_bounds FROM e GROUP BY member),
s AS (SELECT member, greatest(max(n) - 0, 0)::DOUBLE AS stale_runs FROM (SELECT member, run, count(*) AS n FROM e WHERE unrated GROUP BY ALL) GROUP BY member),
l AS (SELECT member, unnest([{{'c': 'accrual', 'e': accrual}}, {{'c': 'funded_return', 'e': funded_return}}, {{'c': 'nav_recursion', 'e': 0.0::DOUBLE}}, {{'c': 'days_complete', 'e': days_complete}}, {{'c': 'rate_bounds', 'e': rate_bounds}}, {{'c': 'stale_runs', 'e': coalesce(stale_runs, 0)}}, {{'c': 'spread_monotone', 'e': 0.0::DOUBLE}}]) AS v FROM x LEFT JOIN s USING (member))
SELECT member, v.c AS "check", round(v.e, 6) + 0.0::DOUBLE AS error, CASE WHEN v.e <= 1e-9 THEN 'PASS' ELSE 'BLOCKED' END AS status FROM l""")
def collateral_checks(spark, sf_dir):
    """One member's interest is too high by a hundredth, and no session may be without a rate."""
    rows = funded(spark, sf_dir)
    rates = read(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'").groupBy(F.col("o_orderdate").cast("date").alias("session")).agg((F.lit(0.01) * (F.count(F.lit(1)) % 7)).alias("rate"))
    stressed = controls.funded_paths(paths(spark, sf_dir), rates, spread=0.012)
    return reports.collateral_checks(rows.withColumn("interest", F.col("interest") * F.when(F.col("member") == "AF", 1.01).otherwise(1.0)), stressed, 0.002, 360, 0)


@query(f"""WITH {FUNDED}, u AS (SELECT member, 'excess' AS basis, session, ret FROM fn UNION ALL SELECT member, 'funded', session, funded FROM fn), f AS ({figures_sql('u', 'member, basis')}),
s AS (SELECT member, avg(ret) / nullif(stddev_pop(ret), 0) * sqrt(252::DOUBLE) AS own, avg(rate) AS mean_rate, sum(interest) / (greatest(max(session) - min(session), 1) / 365.2425) AS yearly FROM fn GROUP BY member),
j AS (SELECT member, basis, sessions, cagr, volatility, max_drawdown, own AS sharpe, CASE WHEN basis = 'funded' THEN mean_rate ELSE 0.0::DOUBLE END AS rate, CASE WHEN basis = 'funded' THEN yearly ELSE 0.0::DOUBLE END AS contribution FROM f JOIN s USING (member))
SELECT member, basis, sessions, {_r('cagr', 'volatility', 'max_drawdown', 'sharpe', 'rate', 'contribution')} FROM j""")
def funded_performance(spark, sf_dir):
    return intake.funded_performance(funded(spark, sf_dir))


def _scaled_sql(high: float) -> str:
    return f"""{PATHS}, named AS (SELECT member AS symbol, session, ret FROM paths), {ewm_sql('ev', 'named', 'ret', 1 - 0.94, 20, adjust=True)},
sc AS (SELECT symbol, session, coalesce({clip('0.07 / nullif(sd * sqrt(252::DOUBLE), 0)', 0.25, high)}, 1.0::DOUBLE) AS scalar FROM ev), js AS (SELECT symbol, session, ret, round(scalar, 9) AS scalar FROM named JOIN sc USING (symbol, session))"""


def _scaled(spark, sf_dir, high: float) -> DataFrame:
    out = signals.portfolio_scalar(paths(spark, sf_dir).withColumnRenamed("member", "symbol"), high=high)
    return out.withColumn("scalar", F.round("scalar", 9))


@query(f"""WITH {_scaled_sql(2.0)}, l AS (SELECT *, coalesce(bool_or(ret <> 0) {W}), false) AS live FROM js), w AS (SELECT *, CASE WHEN live AND coalesce(lag(live, 63) {W}), false) THEN scalar ELSE 1.0::DOUBLE END AS v FROM l),
m AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY symbol, date_trunc('month', session) ORDER BY session DESC) = 1 THEN v END AS e FROM w), c AS (SELECT symbol, session, scalar, last_value(e IGNORE NULLS) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM m)
SELECT symbol, session, {_r('scalar')}, round(coalesce(e, 1.0::DOUBLE), 6) + 0.0::DOUBLE AS in_force FROM c""")
def scalar_in_force(spark, sf_dir):
    return intake.scalar_in_force(_scaled(spark, sf_dir, 2.0), "ret").select("symbol", "session", "scalar", "in_force")


@query(f"""WITH {_scaled_sql(1.0)}, l AS (SELECT symbol AS member, ret, scalar AS scale, CASE WHEN ret <> 0 THEN scalar ELSE 0.0::DOUBLE END AS risk FROM js), a AS (SELECT member, count(*) AS sessions, stddev_samp(ret) * sqrt(252::DOUBLE) AS realized, stddev_samp(ret) * sqrt(252::DOUBLE) / 0.07 AS over_budget, avg(scale) AS mean_scale, avg((scale >= 1 - 1e-12)::INT) AS at_ceiling, avg((risk <= 1e-9)::INT) AS no_risk, avg(risk) AS mean_risk, 1 - avg(risk) AS mean_cash, min(scale) < 1 - 1e-12 AS binds FROM l GROUP BY member)
SELECT member, sessions, {_r('realized', 'over_budget', 'mean_scale', 'at_ceiling', 'no_risk', 'mean_risk', 'mean_cash')}, binds FROM a""")
def volatility_budget(spark, sf_dir):
    rows = _scaled(spark, sf_dir, 1.0).select(F.col("symbol").alias("member"), "session", "ret", F.col("scalar").alias("scale"), F.when(F.col("ret") != 0, F.col("scalar")).otherwise(0.0).alias("risk_weight"))
    return intake.volatility_budget(rows)
