"""Queries of cost scenarios, spliced choices, variants, bounds, families, bundles and order batches, with their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators import audit, controls, families, reports, scenarios
from ledgerline.operators.inference import walk_forward
from ledgerline.operators.performance import monthly_returns
from ledgerline.plans.catalogue import _r, draws_sql, query
from ledgerline.sources import bundle
from ledgerline.sources.files import scan_panel, scratch, write_panel
from ledgerline.sources.views import BARS, PATHS, bars, paths, read

#: Paths with recorded costs, by the volume of the session's bar.
COSTED = f"""{PATHS}, costed AS (SELECT p.member, p.session, p.ret AS gross, coalesce(CAST(b.volume AS BIGINT) % 11, 0) * 0.00002::DOUBLE AS fixed, sqrt(coalesce(CAST(b.volume AS BIGINT) % 11, 0)) * 0.00001::DOUBLE AS impact FROM paths p LEFT JOIN bars b ON b.symbol = p.member AND b.session = p.session)"""


def costed(spark, sf_dir) -> DataFrame:
    own = bars(spark, sf_dir).select(F.col("symbol").alias("member"), "session", (F.col("volume").cast("long") % 11).alias("k"))
    k = F.coalesce("k", F.lit(0))
    return paths(spark, sf_dir).join(own, ["member", "session"], "left").select("member", "session", F.col("ret").alias("gross"), (k * 0.00002).alias("fixed"), (F.sqrt(k.cast("double")) * 0.00001).alias("impact"))


def figures_sql(rows: str, keys: str) -> str:
    """CTE body: the figures of ``path_figures``."""
    return f"""SELECT {keys}, count(*) AS sessions, pow(exp(sum(ln(1 + ret))), 365.2425 / greatest(max(session) - min(session), 1)) - 1 AS cagr, stddev_samp(ret) * sqrt(252::DOUBLE) AS volatility, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252::DOUBLE) AS sharpe, min(nav / greatest(1.0::DOUBLE, peak) - 1) AS max_drawdown
  FROM (SELECT *, max(nav) OVER (PARTITION BY {keys} ORDER BY session) AS peak FROM (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY {keys} ORDER BY session)) AS nav FROM {rows})) GROUP BY {keys}"""


COST_YEARS, SEALED = list(range(1994, 1999)), 1997
MULTIPLIERS = [0.0, 0.5, 1.0, 2.0, 4.0]


@query(f"""WITH {COSTED}, pr AS (SELECT m AS multiplier, member, session, gross - m * (fixed + impact) AS ret, m * (fixed + impact) AS paid FROM costed CROSS JOIN (SELECT unnest({MULTIPLIERS}::DOUBLE[]) AS m)),
b AS (SELECT multiplier, fold, member, ret, row_number() OVER (PARTITION BY multiplier, fold, member ORDER BY session DESC) AS back FROM pr JOIN (SELECT unnest({COST_YEARS}) AS fold) ON year(session) < fold),
t AS (SELECT multiplier, fold, member, round(avg(ret) / nullif(stddev_pop(ret), 0), 12) AS score FROM b WHERE back > 21 GROUP BY ALL HAVING count(*) >= 60),
ch AS (SELECT multiplier, fold, member FROM t QUALIFY row_number() OVER (PARTITION BY multiplier, fold ORDER BY score DESC, member) = 1),
sp AS (SELECT pr.*, fold FROM pr JOIN ch ON ch.multiplier = pr.multiplier AND ch.member = pr.member AND fold = year(session)),
fi AS ({figures_sql('sp', 'multiplier')}), pk AS (SELECT multiplier, count(*) AS folds, string_agg(fold || ':' || member, ',' ORDER BY fold) AS selected, CAST(sum(s) AS BIGINT) AS switches FROM (SELECT *, coalesce((lag(member) OVER (PARTITION BY multiplier ORDER BY fold) <> member)::INT, 0) AS s FROM ch) GROUP BY multiplier),
co AS (SELECT multiplier, sum(paid) AS cost FROM sp GROUP BY multiplier), bl AS (SELECT multiplier, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252::DOUBLE) AS block_sharpe FROM sp WHERE fold >= {SEALED} GROUP BY multiplier),
ea AS (SELECT multiplier, avg(s) AS mean_fold_sharpe FROM (SELECT multiplier, fold, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252::DOUBLE) AS s FROM sp WHERE fold >= {SEALED} GROUP BY ALL) GROUP BY multiplier)
SELECT multiplier, sessions, {_r('cagr', 'volatility', 'sharpe', 'max_drawdown')}, folds, selected, switches, {_r('cost', 'block_sharpe', 'mean_fold_sharpe')} FROM fi JOIN pk USING (multiplier) JOIN co USING (multiplier) LEFT JOIN bl USING (multiplier) LEFT JOIN ea USING (multiplier)""")
def cost_sensitivity(spark, sf_dir):
    ledger = costed(spark, sf_dir).select("member", "session", "gross", (F.col("fixed") + F.col("impact")).alias("cost"))
    return scenarios.cost_sensitivity(ledger, MULTIPLIERS, COST_YEARS, SEALED, stand_off=21, least=60)


STRESSES = [("recorded", 1.0, 1.0), ("fixed x 2", 2.0, 1.0), ("impact x 2", 1.0, 2.0), ("both x 2", 2.0, 2.0)]


@query(f"""WITH {COSTED}, sc(scenario, f, i) AS (VALUES {', '.join(f"('{n}', {f}::DOUBLE, {i}::DOUBLE)" for n, f, i in STRESSES)}), pr AS (SELECT member, scenario, session, gross - (f * fixed + i * impact) AS ret, f * fixed + i * impact AS paid FROM costed CROSS JOIN sc),
fi AS ({figures_sql('pr', 'member, scenario')}), co AS (SELECT member, scenario, sum(paid) AS cost FROM pr GROUP BY ALL), j AS (SELECT fi.*, cost FROM fi JOIN co USING (member, scenario))
SELECT j.member, j.scenario, j.sessions, {_r('j.cagr', 'j.volatility', 'j.sharpe', 'j.max_drawdown', 'j.cost')}, round(j.sharpe - b.sharpe, 6) + 0.0::DOUBLE AS sharpe_change, round(j.cagr - b.cagr, 6) + 0.0::DOUBLE AS cagr_change FROM j JOIN j b ON b.member = j.member AND b.scenario = 'recorded'""")
def friction_stress(spark, sf_dir):
    return scenarios.friction_stress(costed(spark, sf_dir), STRESSES)


#: Members as variants: one with a total-loss fault, one with a session twice, one that nobody declared, and one that is only declared.
VARIANTS = f"""{PATHS}, va AS (SELECT member AS variant, session, CASE WHEN member = 'AF' AND day(session) = 13 THEN -1.5::DOUBLE WHEN member = 'NO' AND day(session) = 7 THEN NULL ELSE ret END AS ret FROM paths UNION ALL SELECT member, session, ret FROM paths WHERE member = 'RO' AND day(session) = 1), de AS (SELECT DISTINCT member AS variant FROM paths WHERE member <> 'RF' UNION ALL SELECT 'never run')"""


@query(f"""WITH {VARIANTS}, s AS (SELECT variant, max(n) AS n, max(odd) AS odd, min(low) AS low FROM (SELECT variant, session, count(*) AS n, max((ret IS NULL)::INT) AS odd, min(ret) AS low FROM va GROUP BY ALL) GROUP BY variant),
li AS (SELECT coalesce(de.variant, s.variant) AS variant, CASE WHEN de.variant IS NULL THEN 'not declared' WHEN s.variant IS NULL THEN 'no path' WHEN n > 1 THEN 'a session twice' WHEN odd = 1 THEN 'a return that is not finite' WHEN low < -1 THEN 'a return below -1' ELSE '' END AS reason FROM de FULL JOIN s ON s.variant = de.variant),
gd AS (SELECT * FROM va WHERE variant IN (SELECT variant FROM li WHERE reason = '')), fi AS ({figures_sql('gd', 'variant')})
SELECT li.variant, CASE WHEN reason = '' THEN 'OK' ELSE 'ERROR' END AS status, reason, fi.sessions, {_r('fi.cagr', 'fi.volatility', 'fi.sharpe', 'fi.max_drawdown')}, {', '.join(f"round(fi.{c} - b.{c}, 6) + 0.0::DOUBLE AS {c}_change" for c in ('cagr', 'sharpe', 'max_drawdown'))} FROM li LEFT JOIN fi USING (variant) LEFT JOIN fi b ON b.variant = 'AO'""")
def variant_comparison(spark, sf_dir):
    own, day = paths(spark, sf_dir), F.dayofmonth("session")
    ret = F.when((F.col("member") == "AF") & (day == 13), -1.5).when((F.col("member") == "NO") & (day == 7), None).otherwise(F.col("ret"))
    rows = own.select(F.col("member").alias("variant"), "session", ret.alias("ret")).unionByName(own.filter((F.col("member") == "RO") & (day == 1)).withColumnRenamed("member", "variant"))
    declared = own.filter("member <> 'RF'").select(F.col("member").alias("variant")).distinct().unionByName(spark.range(1).select(F.lit("never run").alias("variant")))
    return scenarios.compare_variants(rows, declared, "AO")


#: Weights of a member: its own bar's volume share and 1 less that; a month without rows is a gap.
SPLICED = f"""{PATHS}, wt AS (SELECT p.member, p.session, s.symbol, CASE s.symbol WHEN 'ONE' THEN (day(p.session) + ascii(p.member)) % 10 / 10.0::DOUBLE ELSE 1 - (day(p.session) + ascii(p.member)) % 10 / 10.0::DOUBLE END AS weight FROM paths p CROSS JOIN (SELECT unnest(['ONE', 'TWO']) AS symbol) s WHERE NOT (month(p.session) = 3 AND p.member LIKE '%F')),
tr AS (SELECT fold, member, round(avg(ret) / nullif(stddev_pop(ret), 0), 12) AS score FROM paths JOIN (SELECT unnest({COST_YEARS}) AS fold) ON year(session) < fold GROUP BY ALL), ch AS (SELECT fold, member, coalesce(lag(member) OVER (ORDER BY fold), 'AF') AS previous FROM (SELECT * FROM tr QUALIFY row_number() OVER (PARTITION BY fold ORDER BY score DESC, member) = 1)),
sp AS (SELECT fold, CAST((fold - 1) || '-07-01' AS DATE) AS "begin", CAST(fold || '-07-01' AS DATE) AS until FROM (SELECT unnest({COST_YEARS}) AS fold)),
st AS (SELECT ch.fold, ch.member, w.session, w.symbol, w.weight FROM wt w JOIN ch ON ch.member = w.member JOIN sp ON sp.fold = ch.fold AND w.session >= sp."begin" AND w.session < sp.until)"""


def _splice(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    own = paths(spark, sf_dir)
    chosen = walk_forward(own, COST_YEARS)
    part = (F.dayofmonth("session") + F.ascii("member")) % 10 / 10.0
    sides = F.array(F.struct(F.lit("ONE").alias("symbol"), part.alias("weight")), F.struct(F.lit("TWO").alias("symbol"), (1 - part).alias("weight")))
    weights = own.filter(~((F.month("session") == 3) & F.col("member").endswith("F"))).select("member", "session", F.inline(sides))
    spans = spark.range(1).select(F.explode(F.array(*map(F.lit, COST_YEARS))).alias("fold"))
    spans = spans.select("fold", F.make_date(F.col("fold") - 1, F.lit(7), F.lit(1)).alias("begin"), F.make_date("fold", F.lit(7), F.lit(1)).alias("until"))
    return weights, chosen, spans


@query(f"WITH {SPLICED} SELECT CAST(fold AS INTEGER) AS fold, member, session, symbol, {_r('weight')} FROM st")
def spliced_weights(spark, sf_dir):
    return scenarios.spliced_weights(*_splice(spark, sf_dir))


@query(f"""WITH {SPLICED}, ca AS (SELECT fold, session FROM (SELECT DISTINCT session FROM wt) JOIN sp ON session >= "begin" AND session < until), co AS (SELECT ca.fold, count(*) AS sessions, count(*) FILTER (h.session IS NULL) AS missing, min(ca.session) AS first FROM ca LEFT JOIN (SELECT DISTINCT fold, session FROM st) h ON h.fold = ca.fold AND h.session = ca.session GROUP BY ca.fold),
mv AS (SELECT fold, sum(abs(d)) AS jump FROM (SELECT ch.fold, w.symbol, sum(w.weight * ((w.member = ch.member)::INT - (w.member = ch.previous)::INT)) AS d FROM ch JOIN co ON co.fold = ch.fold JOIN wt w ON w.session = co.first AND w.member IN (ch.member, ch.previous) GROUP BY ALL) GROUP BY fold)
SELECT CAST(sp.fold AS INTEGER) AS fold, member, previous, member <> previous AS switched, coalesce(sessions, 0) AS sessions, coalesce(missing, 0) AS missing, {_r('jump')} FROM sp LEFT JOIN ch ON ch.fold = sp.fold LEFT JOIN co ON co.fold = sp.fold LEFT JOIN mv ON mv.fold = sp.fold""")
def splice_report(spark, sf_dir):
    return scenarios.splice_report(*_splice(spark, sf_dir), "AF")


BOUNDS = {"volume_cap": ("upper", 250.0, 1e-9), "close_floor": ("lower", 1000.0, 1e-9), "turnover_cap": ("upper", 1e12, 1e-9)}


@query(f"""WITH {BARS}, v AS (SELECT 'volume_cap' AS bound, volume AS value, volume % 7 = 0 AS binding FROM bars UNION ALL SELECT 'close_floor', close, NULL FROM bars UNION ALL SELECT 'turnover_cap', turnover, NULL FROM bars), sp(bound, side, "limit", slack) AS (VALUES {', '.join(f"('{b}', '{s}', {x}::DOUBLE, {t}::DOUBLE)" for b, (s, x, t) in BOUNDS.items())}),
h AS (SELECT v.*, side, "limit", coalesce(binding, CASE side WHEN 'upper' THEN value >= "limit" - slack ELSE value <= "limit" + slack END) AS hit FROM v JOIN sp USING (bound)), a AS (SELECT bound, side, "limit", count(*) AS observations, count(*) FILTER (hit) AS binding, min(value) AS minimum, max(value) AS maximum, quantile_cont(value, 0.5) AS median FROM h GROUP BY ALL)
SELECT bound, side, round("limit", 6) AS "limit", observations, binding, {_r('minimum', 'maximum', 'median')}, round(binding / observations, 6) AS share, round(CASE side WHEN 'upper' THEN "limit" - maximum ELSE minimum - "limit" END, 6) + 0.0::DOUBLE AS headroom, CASE WHEN binding > 0 THEN 'ACTIVE' ELSE 'INERT' END AS activity FROM a""")
def bound_activity(spark, sf_dir):
    b = bars(spark, sf_dir)
    sides = F.array(*(F.struct(F.lit(n).alias("bound"), F.col(c).alias("value"), hit.alias("binding")) for n, c, hit in (("volume_cap", "volume", F.col("volume") % 7 == 0), ("close_floor", "close", F.lit(None).cast("boolean")), ("turnover_cap", "turnover", F.lit(None).cast("boolean")))))
    return scenarios.bound_activity(b.select(F.inline(sides)), BOUNDS)


@query(f"""WITH {PATHS}, v AS (SELECT member, session, CASE WHEN count(*) {'OVER (PARTITION BY member ORDER BY session ROWS 20 PRECEDING)'} = 21 THEN stddev_samp(ret) {'OVER (PARTITION BY member ORDER BY session ROWS 20 PRECEDING)'} END AS vol FROM paths), t AS (SELECT *, 0.005 / nullif(vol, 0) AS wanted FROM v), c AS (SELECT *, least(1.5::DOUBLE, greatest(0.5::DOUBLE, wanted)) AS scale, greatest(0.5::DOUBLE, wanted) AS uncapped, least(1.5::DOUBLE, wanted) AS unfloored FROM t),
g AS (SELECT *, lag(scale) OVER (PARTITION BY member ORDER BY session) AS old FROM c WHERE wanted IS NOT NULL),
u AS (SELECT 'cap' AS bound, scale AS given, scale, uncapped AS free FROM g UNION ALL SELECT 'floor', scale, scale, unfloored FROM g UNION ALL SELECT 'stale cap', old, scale, uncapped FROM g),
a AS (SELECT bound, count(*) AS observations, count(*) FILTER (abs(scale - given) > 1e-12) AS mismatches, count(*) FILTER (abs(scale - free) > 1e-12) AS hit, max(abs(scale - free)) AS most FROM u WHERE given IS NOT NULL GROUP BY bound)
SELECT bound, CASE WHEN mismatches = 0 THEN 'MEASURED' ELSE 'NOT_ESTIMABLE' END AS status, observations, mismatches, CASE WHEN mismatches = 0 THEN hit END AS binding, CASE WHEN mismatches = 0 THEN round(hit / observations, 6) END AS share, CASE WHEN mismatches = 0 THEN round(most, 6) + 0.0::DOUBLE END AS largest_effect FROM a""")
def bound_binding(spark, sf_dir):
    own = Window.partitionBy("member").orderBy("session")
    frame = own.rowsBetween(-20, 0)
    rows = paths(spark, sf_dir).withColumn("wanted", F.try_divide(F.lit(0.005), F.nullif(F.when(F.count("ret").over(frame) == 21, F.stddev_samp("ret").over(frame)), F.lit(0.0)))).filter("wanted IS NOT NULL")
    capped, uncapped, unfloored = F.least(F.lit(1.5), F.greatest(F.lit(0.5), "wanted")), F.greatest(F.lit(0.5), "wanted"), F.least(F.lit(1.5), "wanted")
    rows = rows.withColumn("scale", capped).withColumn("old", F.lag("scale").over(own))
    scale, old = F.col("scale"), F.col("old")
    return scenarios.bound_binding(rows, {"cap": (scale, capped, uncapped), "floor": (scale, capped, unfloored), "stale cap": (old, capped, uncapped)})


# Families --------------------------------------------------------------------

FAMILY = f"""{PATHS}, fa AS (SELECT member, session, CASE WHEN member = 'AO' AND day(session) = 7 THEN NULL ELSE ret END AS ret FROM paths WHERE NOT (member = 'NO' AND day(session) = 13) UNION ALL SELECT member, session, ret FROM paths WHERE member = 'RO' AND day(session) = 1), de AS (SELECT DISTINCT member FROM paths WHERE member <> 'RF' UNION ALL SELECT 'ghost')"""


@query(f"""WITH {FAMILY}, o AS (SELECT member, count(DISTINCT session) AS sessions, min(session) AS first, max(session) AS last, count(*) > count(DISTINCT session) AS twice, count(*) > count(ret) AS odd, list(DISTINCT session ORDER BY session) AS own FROM fa GROUP BY member), b AS (SELECT sessions AS bs, own AS bo FROM o WHERE member = 'AF'),
l AS (SELECT coalesce(de.member, o.member) AS member, de.member IS NULL AS undeclared, o.* EXCLUDE (member), bs, bo FROM de FULL JOIN o ON o.member = de.member LEFT JOIN b ON true)
SELECT member, CASE WHEN undeclared THEN 'UNDECLARED' WHEN sessions IS NULL THEN 'MISSING' WHEN twice THEN 'REPEATED' WHEN odd THEN 'NOT_FINITE' WHEN bs IS NULL OR own <> bo THEN 'UNSYNCHRONISED' ELSE 'SYNCHRONISED' END AS status, coalesce(sessions, 0) AS sessions, strftime(first, '%Y-%m-%d') AS first, strftime(last, '%Y-%m-%d') AS last,
  CASE WHEN undeclared THEN 'not in the declared family' WHEN sessions IS NULL THEN 'declared without a path' WHEN twice THEN 'a session twice' WHEN odd THEN 'a return that is not finite' WHEN bs IS NULL THEN 'the benchmark has no path' WHEN own <> bo THEN sessions || ' sessions against ' || bs ELSE '' END AS reason FROM l""")
def family_members(spark, sf_dir):
    own, day = paths(spark, sf_dir), F.dayofmonth("session")
    rows = own.filter(~((F.col("member") == "NO") & (day == 13))).withColumn("ret", F.when(~((F.col("member") == "AO") & (day == 7)), F.col("ret")))
    rows = rows.unionByName(own.filter((F.col("member") == "RO") & (day == 1)))
    declared = own.filter("member <> 'RF'").select("member").distinct().unionByName(spark.range(1).select(F.lit("ghost").alias("member")))
    return families.family_members(rows, declared, "AF").withColumn("first", F.date_format("first", "yyyy-MM-dd")).withColumn("last", F.date_format("last", "yyyy-MM-dd"))


FAMILY_BLOCKS, FAMILY_SAMPLES = (21, 63, 126), 100


def _family_report_sql() -> str:
    length = "(SELECT max(position) + 1 FROM gp)"
    draws = ", ".join(draws_sql(f"d{b}", length, FAMILY_SAMPLES, length, b, 7) for b in FAMILY_BLOCKS)
    sums = ", ".join(f"sum(t * {c}) AS {c}1, sum(t * {c} * {c}) AS {c}2" for c in "rb")
    sharpe = lambda c: f"CASE WHEN sqrt(greatest({c}2 / n - {c}1 / n * {c}1 / n, 0)) > 1e-12 THEN {c}1 / n / sqrt(greatest({c}2 / n - {c}1 / n * {c}1 / n, 0)) * sqrt(252::DOUBLE) END"
    two = lambda name, keys: f"SELECT {keys}, 'mean' AS statistic, n, (r1 - b1) / n * 252 AS x FROM {name} UNION ALL SELECT {keys}, 'sharpe', n, {sharpe('r')} - {sharpe('b')} FROM {name}"
    times = " UNION ALL ".join(f"SELECT {b} AS block, rep, position, count(*) AS t FROM d{b} GROUP BY ALL" for b in FAMILY_BLOCKS)
    return f"""WITH {PATHS}, gp AS MATERIALIZED (SELECT p.member, row_number() OVER (PARTITION BY p.member ORDER BY p.session) - 1 AS position, p.ret AS r, b.ret AS b FROM paths p JOIN paths b ON b.session = p.session AND b.member = 'AF' WHERE p.member <> 'AF'), {draws},
ti AS ({times}), o1 AS (SELECT member, count(*) AS n, {sums} FROM (SELECT *, 1 AS t FROM gp) GROUP BY member), s1 AS (SELECT block, rep, member, {sums} FROM ti JOIN gp USING (position) GROUP BY ALL), s2 AS (SELECT s1.*, n FROM s1 JOIN (SELECT member, n FROM o1) USING (member)),
ob AS ({two('o1', 'member')}), dr AS ({two('s2', 'block, rep, member')}), fam AS (SELECT dr.block, dr.statistic, dr.rep, dr.member, dr.n, ob.x AS observed, dr.x AS draw FROM dr JOIN ob ON ob.member = dr.member AND ob.statistic = dr.statistic WHERE dr.x IS NOT NULL AND ob.x IS NOT NULL),
rc AS (SELECT statistic, block, rep, max(sqrt(n) * observed) AS v, max(sqrt(n) * (draw - observed)) AS z FROM fam GROUP BY ALL),
w AS (SELECT statistic, block, member, sqrt(avg(pow((draw - observed) * sqrt(n), 2))) AS omega, any_value(observed) AS o, any_value(n) AS n FROM fam GROUP BY ALL), c AS (SELECT *, sqrt(n) * o / omega AS s, o AS upper, CASE WHEN sqrt(n) * o / omega >= -sqrt(2 * ln(ln(n::DOUBLE))) THEN o ELSE 0 END AS consistent, greatest(o, 0) AS lower FROM w WHERE omega > 0),
sa AS (SELECT fam.statistic, fam.block, rep, greatest(max(s), 0) AS v, {', '.join(f'greatest(max((draw - {k}) * sqrt(c.n) / omega), 0) AS {k}' for k in ('upper', 'consistent', 'lower'))} FROM fam JOIN c ON c.member = fam.member AND c.statistic = fam.statistic AND c.block = fam.block GROUP BY ALL),
u AS (SELECT statistic, block, 'reality check' AS procedure, v, z FROM rc {' '.join(f"UNION ALL SELECT statistic, block, 'superior ability, {k}', v, {k} FROM sa" for k in ('lower', 'consistent', 'upper'))})
SELECT statistic, CAST(block AS INTEGER) AS block, procedure, round(max(v), 6) + 0.0::DOUBLE AS value, round((1 + count(*) FILTER (z >= v)) / (1 + count(*)), 6) AS p_value FROM u GROUP BY ALL"""


@query(_family_report_sql())
def family_report(spark, sf_dir):
    return families.family_report(paths(spark, sf_dir), "AF", FAMILY_BLOCKS, FAMILY_SAMPLES)


# Episodes across a boundary, exposures, continuations, bundles -----------------

EPISODE = ("1995-03-01", "1997-06-30", "1996-04-15")


@query(f"""WITH {PATHS}, r AS (SELECT member, session, ret, CASE WHEN session < DATE '{EPISODE[2]}' THEN 'before' ELSE 'after' END AS part FROM paths WHERE session BETWEEN DATE '{EPISODE[0]}' AND DATE '{EPISODE[1]}'),
e AS (SELECT member, part, session, ret FROM r UNION ALL SELECT member, 'whole', session, ret FROM r), n AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY member, part ORDER BY session)) AS nav FROM e), d AS (SELECT *, nav / greatest(1.0::DOUBLE, max(nav) OVER (PARTITION BY member, part ORDER BY session)) - 1 AS down FROM n),
a AS (SELECT member, part, count(*) AS sessions, exp(sum(ln(1 + ret))) - 1 AS growth, stddev_samp(ret) * sqrt(252::DOUBLE) AS volatility, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252::DOUBLE) AS sharpe, min(down) AS max_drawdown FROM d GROUP BY ALL)
SELECT member, part, CASE part WHEN 'whole' THEN 'MIXED' WHEN 'before' THEN 'IN_SAMPLE' ELSE 'OUT_OF_SAMPLE' END AS basis, sessions, {_r('growth', 'volatility', 'sharpe', 'max_drawdown')} FROM a""")
def straddling_episode(spark, sf_dir):
    return reports.straddling_episode(paths(spark, sf_dir), *EPISODE)


@query(f"""WITH {PATHS}, bk AS (SELECT session, member AS symbol, CASE WHEN member LIKE 'A%' THEN 'first' WHEN member LIKE 'N%' THEN 'second' END AS class, (day(session) + ascii(member)) % 7 / 20.0::DOUBLE AS weight, ret FROM paths),
h AS (SELECT session, symbol, coalesce(class, 'unclassified') AS class, weight, coalesce(lag(weight) OVER (PARTITION BY symbol ORDER BY session), 0) * ret AS earned FROM bk), r AS (SELECT * FROM h WHERE session >= DATE '1994-01-01'), t AS (SELECT session, sum(earned) AS total FROM r GROUP BY session),
c AS (SELECT class, symbol, session, sum(weight) AS weight, sum(earned) AS earned FROM r GROUP BY ALL UNION ALL SELECT class, NULL, session, sum(weight), sum(earned) FROM r GROUP BY ALL)
SELECT class, symbol, round(avg(weight), 6) AS mean_weight, round(max(weight), 6) AS largest_weight, round(covar_pop(earned, total) / var_pop(total), 6) + 0.0::DOUBLE AS risk_share FROM c JOIN t USING (session) GROUP BY class, symbol""")
def exposure_shares(spark, sf_dir):
    member = F.col("member")
    kind = F.when(member.startswith("A"), "first").when(member.startswith("N"), "second")
    book = paths(spark, sf_dir).select("session", member.alias("symbol"), kind.alias("class"), ((F.dayofmonth("session") + F.ascii("member")) % 7 / 20.0).alias("weight"), "ret")
    return reports.exposure_shares(book, "1994-01-01")


@query(f"""WITH {BARS}, ex AS (SELECT CASE symbol WHEN 'AF' THEN 'ZZ' ELSE symbol END AS root, CASE symbol WHEN 'RF' THEN session + 100000 ELSE session END AS session, CASE symbol WHEN 'NO' THEN round(close, 6) + 0.25 WHEN 'RO' THEN NULL ELSE round(close, 6) END AS value FROM bars WHERE session >= DATE '1996-01-01'), ca AS (SELECT symbol AS root, session, round(close, 6) AS value FROM bars),
g AS (SELECT ex.root, count(*) AS shared, max(abs(ca.value - ex.value)) AS gap FROM ex JOIN ca ON ca.root = ex.root AND ca.session = ex.session WHERE ex.value IS NOT NULL GROUP BY ex.root)
SELECT r.root, coalesce(shared, 0) AS shared_sessions, round(gap, 6) + 0.0::DOUBLE AS largest_difference, CASE WHEN gap <= 1e-9 THEN 'PASS' ELSE 'BLOCKED' END AS status, CASE WHEN r.root NOT IN (SELECT root FROM ca) THEN 'the root is not in the canonical history' WHEN shared IS NULL THEN 'no shared sessions' WHEN gap > 1e-9 THEN 'the series was anchored anew' ELSE 'continues the canonical series' END AS detail FROM (SELECT DISTINCT root FROM ex) r LEFT JOIN g USING (root)""")
def extension_continuity(spark, sf_dir):
    """The continuation is read from files of its own, by root."""
    own = bars(spark, sf_dir).select("symbol", "session", F.round("close", 6).alias("value"))
    symbol = F.col("symbol")
    moved = own.filter("session >= '1996-01-01'").select(F.when(symbol == "AF", "ZZ").otherwise(symbol).alias("symbol"), F.when(symbol == "RF", F.date_add("session", 100000)).otherwise(F.col("session")).alias("session"), F.when(symbol == "NO", F.col("value") + 0.25).when(symbol == "RO", None).otherwise(F.col("value")).alias("value"))
    at = scratch(spark, "extension")
    write_panel(moved, at)
    extension = scan_panel(spark, at, {"session": "date", "value": "double"})[0]
    return audit.continuity(own.withColumnRenamed("symbol", "root"), extension.withColumnRenamed("symbol", "root"), 1e-9)


@query(f"WITH {PATHS} SELECT 'months' AS name, count(*) AS rows, 'OK' AS status FROM (SELECT DISTINCT member, date_trunc('month', session) FROM paths) UNION ALL SELECT 'bars', count(*), 'OK' FROM bars")
def report_bundle(spark, sf_dir):
    """Published, read back by its pointer, and checked file by file."""
    at = scratch(spark, "bundle")
    bundle.publish({"bars": bars(spark, sf_dir), "months": monthly_returns(paths(spark, sf_dir))}, at)
    folder = bundle.current(spark, at)
    checked = bundle.verify(spark, folder).groupBy("name").agg(F.max("status").alias("status"))
    rows = None
    for name in ("bars", "months"):
        own = bundle.read_table(spark, folder, name).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        rows = own if rows is None else rows.unionByName(own)
    return rows.join(checked, "name")


# Order batches -----------------------------------------------------------------

BATCHES = """li AS (SELECT *, strftime(l_shipdate, '%Y-%m-%d') AS batch FROM lineitem JOIN part ON l_partkey = p_partkey),
ord AS (SELECT batch, concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS order_id, p_type AS contract, CASE WHEN l_quantity = 7 THEN 'other' ELSE substr(p_type, 1, 3) END AS root, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, CAST(l_quantity AS BIGINT) AS quantity, CASE WHEN l_linenumber % 2 = 0 THEN 'MARKETABLE_LIMIT' ELSE 'MARKET' END AS order_type,
  CAST(p_retailprice AS DOUBLE) AS limit_price, CAST(l_shipdate AS TIMESTAMP) + INTERVAL 12 HOUR - INTERVAL 1 SECOND * (50 * l_linenumber - 20) AS decided_at, l_linestatus = 'F' AS reduce_only, CASE WHEN l_linenumber <= 2 THEN l_orderkey END AS roll_id FROM li),
bat AS (SELECT batch, CAST(batch AS TIMESTAMP) + INTERVAL 12 HOUR AS as_of, 1e6 * (1 + count(*) % 5) AS nav FROM li GROUP BY batch),
snap AS (SELECT p_type AS contract, substr(p_type, 1, 3) AS root, CAST(sum(p_size) AS DOUBLE) * 10 AS volume, CAST(min(p_retailprice) AS DOUBLE) + 300 AS bid, CAST(min(p_retailprice) AS DOUBLE) + 400 AS ask, CAST(max(p_retailprice) AS DOUBLE) * 5 AS notional, CAST(max(p_retailprice) AS DOUBLE) / 2 AS margin, TIMESTAMP '1992-01-01' + INTERVAL 1 DAY * CAST(sum(p_partkey) % 2600 AS BIGINT) AS deadline, substr(p_type, 1, 1) AS exchange, 'USD' AS currency FROM part WHERE p_size < 49 GROUP BY p_type),
pos AS (SELECT batch, p_type AS contract, CAST(sum(l_partkey) % 121 - 60 AS BIGINT) AS position FROM li GROUP BY ALL)"""
_REASONS = [
    ("the batch repeats an order id", "twice"), ("the batch has several orders for one contract", "shared"), ("decided in the future", "age < 0"), ("the decision is stale", "age > 300"), ("the contract is not in the snapshot", "NOT known"), ("another root than the contract''s", "known AND root <> own_root"),
    ("too large a share of volume", "known AND coalesce(part > 0.02, true)"), ("the buy limit is below the ask", "known AND order_type = 'MARKETABLE_LIMIT' AND side = 'BUY' AND limit_price < ask"), ("the sell limit is above the bid", "known AND order_type = 'MARKETABLE_LIMIT' AND side = 'SELL' AND limit_price > bid"),
    ("marked as reducing, but is not", "known AND reduce_only AND NOT reduces"), ("opens within the safety days of the deadline", "known AND NOT reduces AND deadline < as_of + INTERVAL 5 DAY"), ("the batch holds contracts without terms", "unknown"), ("gross notional beyond the limit", "NOT reduces AND g / nav > 5"), ("margin beyond the limit", "NOT reduces AND m / nav > 0.35"),
    ("a roll has two legs", "roll_id IS NOT NULL AND legs <> 2"), ("roll legs do not match", "legs = 2 AND NOT pair"), ("a roll closes one leg and opens the other", "legs = 2 AND pair AND closing <> 1"), ("the roll does not lead to a later contract", "legs = 2 AND pair AND closing = 1 AND NOT coalesce(later, false)"),
]
_ASSESSED = f"""WITH {BATCHES}, r0 AS (SELECT o.*, as_of, nav, s.root AS own_root, volume, bid, ask, notional, margin, deadline, exchange, currency, s.contract IS NOT NULL AS known, coalesce(position, 0) AS position, CASE side WHEN 'BUY' THEN quantity ELSE -quantity END AS signed FROM ord o JOIN bat USING (batch) LEFT JOIN snap s ON s.contract = o.contract LEFT JOIN pos p ON p.batch = o.batch AND p.contract = o.contract),
r AS (SELECT *, known AND reduce_only AND position <> 0 AND abs(position + signed) < abs(position) AND sign(position + signed) * sign(position) >= 0 AS reduces, CASE WHEN known AND volume > 0 THEN quantity / volume END AS part, epoch(as_of) - epoch(decided_at) AS age FROM r0),
rep AS (SELECT batch, count(*) > count(DISTINCT order_id) AS twice, count(*) > count(DISTINCT contract) AS shared FROM r GROUP BY batch), mv AS (SELECT batch, contract, sum(signed) AS moved FROM r WHERE known GROUP BY ALL),
tot AS (SELECT batch, sum(abs(position + coalesce(moved, 0)) * notional) AS g, sum(abs(position + coalesce(moved, 0)) * margin) AS m, bool_or(s.contract IS NULL AND (position <> 0 OR coalesce(moved, 0) <> 0)) AS unknown FROM pos LEFT JOIN mv USING (batch, contract) LEFT JOIN snap s USING (contract) GROUP BY batch),
rl AS (SELECT batch, roll_id, count(*) AS legs, min(root) = max(root) AND min(quantity) = max(quantity) AND min(contract) <> max(contract) AND min(side) <> max(side) AS pair, count(*) FILTER (reduces) AS closing, max(exchange) FILTER (reduces) = max(exchange) FILTER (NOT reduces) AND max(currency) FILTER (reduces) = max(currency) FILTER (NOT reduces) AND max(deadline) FILTER (NOT reduces) > max(deadline) FILTER (reduces) AS later FROM r WHERE roll_id IS NOT NULL GROUP BY ALL),
f AS (SELECT r.*, twice, shared, g, m, unknown, legs, pair, closing, later FROM r JOIN rep USING (batch) LEFT JOIN tot USING (batch) LEFT JOIN rl ON rl.batch = r.batch AND rl.roll_id = r.roll_id),
z AS (SELECT *, concat_ws('; ', {', '.join(f"CASE WHEN {test} THEN '{text}' END" for text, test in _REASONS)}) AS reasons FROM f)
SELECT batch, order_id, contract, round(part, 12) AS participation, reduces, round(g / nav, 12) AS gross, round(m / nav, 12) AS margin_share, CASE WHEN reasons = '' THEN 'PASS' ELSE 'BLOCKED' END AS status, reasons FROM z"""


@query(_ASSESSED, places=12)
def order_batches(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    line = read(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).withColumn("batch", F.date_format("l_shipdate", "yyyy-MM-dd"))
    noon = F.to_timestamp("batch") + F.expr("INTERVAL 12 HOURS")
    orders = line.select(
        "batch", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("order_id"), F.col("p_type").alias("contract"), F.when(F.col("l_quantity") == 7, "other").otherwise(F.substring("p_type", 1, 3)).alias("root"), F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"),
        F.col("l_quantity").cast("long").alias("quantity"), F.when(F.col("l_linenumber") % 2 == 0, "MARKETABLE_LIMIT").otherwise("MARKET").alias("order_type"), F.col("p_retailprice").cast("double").alias("limit_price"), (noon - F.make_interval(secs=50 * F.col("l_linenumber") - 20)).alias("decided_at"), (F.col("l_linestatus") == "F").alias("reduce_only"), F.when(F.col("l_linenumber") <= 2, F.col("l_orderkey")).alias("roll_id"),
    )
    batches = line.groupBy("batch").agg((1e6 * (1 + F.count(F.lit(1)) % 5)).alias("nav")).select("batch", noon.alias("as_of"), "nav")
    price = F.col("p_retailprice").cast("double")
    deadline = F.lit("1992-01-01").cast("timestamp") + F.make_interval(days=(F.sum("p_partkey") % 2600).cast("int"))
    snapshot = part.filter("p_size < 49").groupBy(F.col("p_type").alias("contract")).agg((F.sum("p_size").cast("double") * 10).alias("volume"), (F.min(price) + 300).alias("bid"), (F.min(price) + 400).alias("ask"), (F.max(price) * 5).alias("notional"), (F.max(price) / 2).alias("margin"), deadline.alias("deadline"))
    snapshot = snapshot.select("*", F.substring("contract", 1, 3).alias("root"), F.substring("contract", 1, 1).alias("exchange"), F.lit("USD").alias("currency"))
    positions = line.groupBy("batch", F.col("p_type").alias("contract")).agg((F.sum("l_partkey") % 121 - 60).alias("position"))
    return controls.assess_batches(orders, batches, snapshot, positions)
