"""What-if reports over recorded ledgers: costs at other levels, choices spliced by fold, variants side by side, and how often bounds bind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.columns import elapsed_years, grown
from ledgerline.operators.audit import exact_quantiles
from ledgerline.operators.inference import walk_forward


def _sharpe(periods: int) -> Column:
    return F.try_divide(F.avg("ret"), F.nullif(F.stddev_samp("ret"), F.lit(0.0))) * periods**0.5


def path_figures(paths: DataFrame, by: list[str], periods: int = 252) -> DataFrame:
    """sessions, cagr (by the calendar between the first and the last session), volatility, sharpe and max_drawdown of (``by``, session, ret)."""
    own = Window.partitionBy(*by).orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    rows = paths.withColumn("__nav", grown("ret", own))
    rows = rows.withColumn("__down", F.col("__nav") / F.greatest(F.lit(1.0), F.max("__nav").over(own)) - 1)
    cagr = F.pow(grown("ret"), 1 / elapsed_years(F.min("session"), F.max("session"))) - 1
    return rows.groupBy(*by).agg(F.count("ret").alias("sessions"), cagr.alias("cagr"), (F.stddev_samp("ret") * periods**0.5).alias("volatility"), _sharpe(periods).alias("sharpe"), F.min("__down").alias("max_drawdown"))


def cost_sensitivity(ledger: DataFrame, multipliers: list[float], years: list[int], sealed: int, stand_off: int = 0, least: int = 1, periods: int = 252) -> DataFrame:
    """Selection and result of a walk-forward at each level of costs, from (member, session, gross, cost).

    Every path is priced at every multiplier before the choice, so the chosen
    members may differ between levels; ``selected`` lists them by fold and
    ``switches`` counts the folds that choose another member than the fold
    before.  ``block_sharpe`` is that of the returns from the year ``sealed`` on
    as one block, ``mean_fold_sharpe`` the mean of its yearly ones.  Negative or
    repeated multipliers are refused; a level without a fold has no row.
    """
    if not multipliers or min(multipliers) < 0 or len(set(multipliers)) != len(multipliers):
        raise ValueError("cost multipliers must be different, and not negative")
    levels = F.explode(F.array(*(F.lit(float(m)) for m in multipliers)))
    priced = ledger.withColumn("multiplier", levels).select("multiplier", "member", "session", (F.col("gross") - F.col("multiplier") * F.col("cost")).alias("ret"), (F.col("multiplier") * F.col("cost")).alias("paid"))
    chosen = walk_forward(priced, years, stand_off, least, ["multiplier"]).select("multiplier", "fold", "member")
    spliced = priced.withColumn("fold", F.year("session")).join(chosen, ["multiplier", "fold", "member"])
    before = F.lag("member").over(Window.partitionBy("multiplier").orderBy("fold"))
    steps = chosen.withColumn("__s", F.coalesce((before != F.col("member")).cast("int"), F.lit(0)))
    # A level has a row for each fold.
    named = F.transform(F.array_sort(F.collect_list(F.struct("fold", "member"))), lambda f: F.concat_ws(":", f["fold"], f["member"]))
    picks = steps.groupBy("multiplier").agg(F.count(F.lit(1)).alias("folds"), F.concat_ws(",", named).alias("selected"), F.sum("__s").alias("switches"))
    late = spliced.filter(F.col("fold") >= sealed)
    block = late.groupBy("multiplier").agg(_sharpe(periods).alias("block_sharpe"))
    each = late.groupBy("multiplier", "fold").agg(_sharpe(periods).alias("s")).groupBy("multiplier").agg(F.avg("s").alias("mean_fold_sharpe"))
    paid = spliced.groupBy("multiplier").agg(F.sum("paid").alias("cost"))
    out = path_figures(spliced, ["multiplier"], periods).join(picks, "multiplier").join(paid, "multiplier")
    return out.join(block, "multiplier", "left").join(each, "multiplier", "left")


def _on_spans(rows: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Rows joined to the spans (fold, begin, until; until is not in it) that hold their session: an equal join on keys and year, then the exact bounds."""
    yearly = spans.withColumn("__y", F.explode(F.sequence(F.year("begin"), F.year(F.date_sub("until", 1)))))
    return rows.withColumn("__y", F.year("session")).join(yearly, [*keys, "__y"]).filter((F.col("session") >= F.col("begin")) & (F.col("session") < F.col("until"))).drop("__y")


def spliced_weights(weights: DataFrame, chosen: DataFrame, spans: DataFrame) -> DataFrame:
    """(fold, member, session, symbol, weight): in every span the weight rows of its chosen member.

    ``weights`` are (member, session, symbol, weight), ``chosen`` (fold, member),
    ``spans`` (fold, begin, until), which do not overlap.
    """
    own = spans.join(chosen.select("fold", "member"), "fold")
    return _on_spans(weights, own, ["member"]).select("fold", "member", "session", "symbol", "weight")


def splice_report(weights: DataFrame, chosen: DataFrame, spans: DataFrame, warm_up: str) -> DataFrame:
    """One row per span: member, previous (``warm_up`` before the first), switched, sessions of the calendar, those without a weight of the member, and jump.

    ``jump`` is the summed absolute change of the wanted weights at the first
    session, from the previous member's row of that session to the new one's.
    A span without a choice has no member and misses all its sessions.
    """
    calendar = _on_spans(weights.select("session").distinct(), spans, [])
    held = spliced_weights(weights, chosen, spans).select("fold", "session").distinct().withColumn("__has", F.lit(1))
    counts = calendar.join(held, ["fold", "session"], "left").groupBy("fold").agg(F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("__has").isNull()).alias("missing"), F.min("session").alias("__first"))
    # A row for each fold.
    marks = chosen.select("fold", "member").withColumn("previous", F.coalesce(F.lag("member").over(Window.orderBy("fold")), F.lit(warm_up)))
    out = spans.select("fold").join(marks, "fold", "left").join(counts, "fold", "left")
    sides = out.filter("member IS NOT NULL AND __first IS NOT NULL").select("fold", F.col("__first").alias("session"), F.explode(F.array(F.struct(F.col("member").alias("m"), F.lit(1.0).alias("s")), F.struct(F.col("previous").alias("m"), F.lit(-1.0).alias("s")))).alias("side"))
    sides = sides.select("fold", "session", F.col("side.m").alias("member"), F.col("side.s").alias("sign"))
    moved = weights.join(sides, ["member", "session"]).groupBy("fold", "symbol").agg(F.sum(F.col("weight") * F.col("sign")).alias("d")).groupBy("fold").agg(F.sum(F.abs("d")).alias("jump"))
    return out.join(moved, "fold", "left").select("fold", "member", "previous", (F.col("member") != F.col("previous")).alias("switched"), F.coalesce("sessions", F.lit(0)).alias("sessions"), F.coalesce("missing", F.lit(0)).alias("missing"), "jump")


def friction_stress(ledger: DataFrame, scenarios: list[tuple[str, float, float]], periods: int = 252) -> DataFrame:
    """Figures of (member, session, gross, fixed, impact) at multiples (name, of fixed, of impact) of its costs, and the change of sharpe and cagr from the first scenario."""
    levels = F.array(*(F.struct(F.lit(n).alias("scenario"), F.lit(float(f)).alias("f"), F.lit(float(i)).alias("i")) for n, f, i in scenarios))
    rows = ledger.withColumn("__s", F.explode(levels))
    cost = F.col("__s.f") * F.col("fixed") + F.col("__s.i") * F.col("impact")
    rows = rows.select("member", F.col("__s.scenario").alias("scenario"), "session", (F.col("gross") - cost).alias("ret"), cost.alias("paid"))
    out = path_figures(rows, ["member", "scenario"], periods).join(rows.groupBy("member", "scenario").agg(F.sum("paid").alias("cost")), ["member", "scenario"])
    base = out.filter(F.col("scenario") == scenarios[0][0]).select("member", F.col("sharpe").alias("__s"), F.col("cagr").alias("__c"))
    return out.join(base, "member").withColumn("sharpe_change", F.col("sharpe") - F.col("__s")).withColumn("cagr_change", F.col("cagr") - F.col("__c")).drop("__s", "__c")


def compare_variants(paths: DataFrame, declared: DataFrame, baseline: str, periods: int = 252) -> DataFrame:
    """One row per declared or supplied variant: status, reason, figures and their change from the baseline.

    ``paths`` are (variant, session, ret), ``declared`` has variant.  A variant
    that cannot be measured keeps its row with status ERROR and null figures: no
    path, not declared, a session twice, a return that is null, not finite or
    below -1.
    """
    ret = F.col("ret")
    once = paths.groupBy("variant", "session").agg(F.count(F.lit(1)).alias("__n"), F.max((ret.isNull() | F.isnan(ret) | (F.abs(ret) == float("inf"))).cast("int")).alias("__odd"), F.min("ret").alias("__least"))
    seen = once.groupBy("variant").agg(F.max("__n").alias("__n"), F.max("__odd").alias("__odd"), F.min("__least").alias("__least"))
    listed = declared.select("variant").distinct().withColumn("__d", F.lit(True)).join(seen, "variant", "full_outer")
    reason = F.when(F.col("__d").isNull(), "not declared").when(F.col("__n").isNull(), "no path").when(F.col("__n") > 1, "a session twice").when(F.col("__odd") == 1, "a return that is not finite").when(F.col("__least") < -1, "a return below -1").otherwise("")
    listed = listed.select("variant", reason.alias("reason"))
    good = path_figures(paths.join(listed.filter("reason = ''").select("variant"), "variant", "left_semi"), ["variant"], periods)
    base = good.filter(F.col("variant") == baseline).select(*(F.col(c).alias(f"__{c}") for c in ("cagr", "sharpe", "max_drawdown")))
    # The baseline is one row.
    out = listed.join(good, "variant", "left").join(F.broadcast(base), how="left")
    changes = [(F.col(c) - F.col(f"__{c}")).alias(f"{c}_change") for c in ("cagr", "sharpe", "max_drawdown")]
    return out.select("variant", F.when(F.col("reason") == "", "OK").otherwise("ERROR").alias("status"), "reason", "sessions", "cagr", "volatility", "sharpe", "max_drawdown", *changes)


def bound_activity(values: DataFrame, specs: dict[str, tuple[str, float, float]]) -> DataFrame:
    """One row per bound with observations, from (bound, value, optional binding): share at the limit, range, headroom, and whether it is ACTIVE or INERT.

    ``specs``: bound to (side upper or lower, limit, tolerance); values of other
    bounds are refused.  ``binding``, where a row has it, tells of an
    intervention and goes before the comparison with the limit; null values do
    not count.  Headroom is the way from the most extreme value to the limit.
    """
    at = lambda k: F.try_element_at(F.create_map(*(F.lit(x) for name, spec in specs.items() for x in (name, spec[k]))), F.col("bound"))
    known = F.when(at(0).isin("upper", "lower"), at(0)).otherwise(F.raise_error(F.concat(F.lit("no such bound: "), F.col("bound"))).cast("string"))
    rows = values.filter("value IS NOT NULL").withColumn("__side", known).withColumn("__limit", at(1)).withColumn("__slack", at(2))
    hit = F.when(F.col("__side") == "upper", F.col("value") >= F.col("__limit") - F.col("__slack")).otherwise(F.col("value") <= F.col("__limit") + F.col("__slack"))
    rows = rows.withColumn("__hit", F.coalesce(F.col("binding"), hit) if "binding" in values.columns else hit)
    out = rows.groupBy("bound").agg(F.first("__side").alias("side"), F.first("__limit").alias("limit"), F.count("value").alias("observations"), F.count_if("__hit").alias("binding"), F.min("value").alias("minimum"), F.max("value").alias("maximum"))
    out = out.join(exact_quantiles(rows, "bound", "value", {"median": 0.5}), "bound").withColumn("share", F.col("binding") / F.col("observations"))
    headroom = F.when(F.col("side") == "upper", F.col("limit") - F.col("maximum")).otherwise(F.col("minimum") - F.col("limit"))
    return out.withColumn("headroom", headroom).withColumn("activity", F.when(F.col("binding") > 0, "ACTIVE").otherwise("INERT"))


def bound_binding(rows: DataFrame, bounds: dict[str, tuple[Column, Column, Column]], tolerance: float = 1e-12) -> DataFrame:
    """One row per bound: how often it changes a decision, in one pass over the rows.

    ``bounds``: name to (recorded value, the expression with the bound, the same
    without it).  If the expression with the bound does not give the recorded
    value everywhere, the bound's row is NOT_ESTIMABLE and holds no share.  Rows
    whose recorded value is null do not count.
    """
    aggs = []
    for i, (given, capped, relaxed) in enumerate(bounds.values()):
        there = given.isNotNull()
        off = F.coalesce(F.abs(capped - given) > tolerance, F.lit(True))
        aggs += [F.count_if(there).alias(f"n{i}"), F.count_if(there & off).alias(f"off{i}"), F.count_if(there & (F.abs(capped - relaxed) > tolerance)).alias(f"hit{i}"), F.max(F.when(there, F.abs(capped - relaxed))).alias(f"most{i}")]
    one = rows.agg(*aggs)
    parts = [F.struct(F.lit(name).alias("bound"), F.col(f"n{i}").alias("observations"), F.col(f"off{i}").alias("mismatches"), F.col(f"hit{i}").alias("hit"), F.col(f"most{i}").alias("most")) for i, name in enumerate(bounds)]
    out = one.select(F.inline(F.array(*parts)))
    good = (F.col("mismatches") == 0) & (F.col("observations") > 0)
    return out.select("bound", F.when(good, "MEASURED").otherwise("NOT_ESTIMABLE").alias("status"), "observations", "mismatches", F.when(good, F.col("hit")).alias("binding"), F.when(good, F.col("hit") / F.col("observations")).alias("share"), F.when(good, F.col("most")).alias("largest_effect"))
