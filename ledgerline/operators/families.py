"""Tests over families of paths and sequences of trades: reality check, superior ability, deflated Sharpe, reshuffled sequences, flipped signs."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.columns import uniform
from ledgerline.operators.inference import shared_length, stationary_draws
from ledgerline.sources.files import scratch

EULER = 0.5772156649015329


def family_draws(paths: DataFrame, benchmark: str, samples: int = 200, block: int = 21, seed: int = 7, periods: int = 252) -> DataFrame:
    """(rep, member, n, observed, draw): annualised mean lead of every member over the benchmark, and in each resampled history.

    All members see one history per repetition.  Paths that do not share their
    sessions are refused.
    """
    base = paths.filter(F.col("member") == benchmark).select("session", F.col("ret").alias("__base"))
    gap = paths.filter(F.col("member") != benchmark).join(base, "session").select("member", "session", (F.col("ret") - F.col("__base")).alias("gap"))
    placed = gap.withColumn("position", (F.row_number().over(Window.partitionBy("member").orderBy("session")) - 1).cast("int"))
    observed = gap.groupBy("member").agg(F.count("gap").alias("n"), (F.avg("gap") * periods).alias("observed"))
    length = shared_length(paths)
    if not length:
        return observed.select(F.lit(0).cast("long").alias("rep"), "member", "n", "observed", F.col("observed").alias("draw"))
    # A repetition takes each position a number of times; the sums need no order.
    times = stationary_draws(paths.sparkSession, length, samples, length, block, seed).groupBy("rep", "position").agg(F.count(F.lit(1)).alias("times"))
    drawn = times.join(placed, "position").groupBy("rep", "member").agg((F.sum(F.col("gap") * F.col("times")) / F.lit(float(length)) * periods).alias("draw"))
    return drawn.join(observed, "member").select("rep", "member", "n", "observed", "draw")


def family_members(paths: DataFrame, declared: DataFrame, benchmark: str) -> DataFrame:
    """(member, status, sessions, first, last, reason): one row for each declared (member) or supplied one.

    UNDECLARED, MISSING, REPEATED (a session twice), NOT_FINITE, UNSYNCHRONISED
    (other sessions than the benchmark's, by count and digest), or SYNCHRONISED.
    Without a benchmark path no member is synchronised.
    """
    ret = F.col("ret")
    odd = ret.isNull() | F.isnan(ret) | (F.abs(ret) == float("inf"))
    once = paths.groupBy("member", "session").agg(F.count(F.lit(1)).alias("__n"), F.max(odd.cast("int")).alias("__odd"))
    own = once.groupBy("member").agg(F.count(F.lit(1)).alias("sessions"), F.min("session").alias("first"), F.max("session").alias("last"), F.max("__n").alias("__n"), F.max("__odd").alias("__odd"), F.sum(F.xxhash64("session").cast("decimal(38,0)")).alias("__h"))
    # The benchmark is one row.
    base = own.filter(F.col("member") == benchmark).select(F.col("sessions").alias("__bs"), F.col("__h").alias("__bh"))
    listed = declared.select("member").distinct().withColumn("__d", F.lit(True)).join(own, "member", "full_outer").join(F.broadcast(base), how="left")
    same = F.coalesce((F.col("sessions") == F.col("__bs")) & (F.col("__h") == F.col("__bh")), F.lit(False))
    checks = [
        (F.col("__d").isNull(), "UNDECLARED", F.lit("not in the declared family")),
        (F.col("sessions").isNull(), "MISSING", F.lit("declared without a path")),
        (F.col("__n") > 1, "REPEATED", F.lit("a session twice")),
        (F.col("__odd") == 1, "NOT_FINITE", F.lit("a return that is not finite")),
        (F.col("__bs").isNull(), "UNSYNCHRONISED", F.lit("the benchmark has no path")),
        (~same, "UNSYNCHRONISED", F.concat_ws(" ", "sessions", F.lit("sessions against"), "__bs")),
    ]
    status, reason = F.lit("SYNCHRONISED"), F.lit("")
    for test, name, text in reversed(checks):
        status, reason = F.when(test, name).otherwise(status), F.when(test, text).otherwise(reason)
    return listed.select("member", status.alias("status"), F.coalesce("sessions", F.lit(0)).alias("sessions"), "first", "last", reason.alias("reason"))


def family_report(paths: DataFrame, benchmark: str, blocks: tuple[int, ...] = (21, 63, 126), samples: int = 200, seed: int = 7, periods: int = 252) -> DataFrame:
    """(statistic, block, procedure, value, p_value): reality check and superior ability of mean leads and of leads in Sharpe ratio, on one set of draws a block length.

    A draw counts how often each session occurs, so one aggregate gives every
    member's and the benchmark's moments of a repetition, and both statistics
    from them.  Unequal sessions are refused; a draw without variance has no
    Sharpe ratio and counts in neither.
    """
    length = shared_length(paths)
    base = paths.filter(F.col("member") == benchmark).select("session", F.col("ret").alias("__b"))
    rows = paths.filter(F.col("member") != benchmark).join(base, "session")
    placed = rows.withColumn("position", (F.row_number().over(Window.partitionBy("member").orderBy("session")) - 1).cast("int")).select("member", "position", F.col("ret").alias("r"), F.col("__b").alias("b"))
    times = None
    for block in blocks:
        own = stationary_draws(paths.sparkSession, max(length, 1), samples, max(length, 1), block, seed).groupBy("rep", "position").agg(F.count(F.lit(1)).alias("times")).withColumn("block", F.lit(block))
        times = own if times is None else times.unionByName(own)
    t = F.col("times")
    sums = [F.sum(t * F.col(c) ** k).alias(f"{c}{k}") for c in "rb" for k in (1, 2)]
    lead = lambda d: _leads(d, length, periods)
    observed = lead(placed.withColumn("times", F.lit(1)).groupBy("member").agg(*sums)).select("member", F.col("lead").alias("observed"))
    drawn = lead(times.join(placed, "position").groupBy("block", "rep", "member").agg(*sums)).select("block", "rep", "member", F.col("lead").alias("draw"))
    both = drawn.join(observed, "member").select("block", "rep", "member", F.lit(length).cast("long").alias("n"), F.inline(F.array(*(F.struct(F.lit(s).alias("statistic"), F.col(f"observed.{s}").alias("observed"), F.col(f"draw.{s}").alias("draw")) for s in ("mean", "sharpe")))))
    # The draws are read four times.
    at = scratch(paths.sparkSession, "family-draws")
    both.filter("draw IS NOT NULL AND observed IS NOT NULL").write.parquet(at)
    draws, by = paths.sparkSession.read.schema(both.schema).parquet(at), ["statistic", "block"]
    checked = reality_check(draws, by).select(*by, F.lit("reality check").alias("procedure"), F.col("statistic_value").alias("value"), "p_value")
    able = superior_ability(draws, by)
    three = F.inline(F.array(*(F.struct(F.lit(f"superior ability, {k}").alias("procedure"), F.col("statistic_value").alias("value"), F.col(f"p_{k}").alias("p_value")) for k in ("lower", "consistent", "upper"))))
    return checked.unionByName(able.select(*by, three))


def _leads(sums: DataFrame, n: int, periods: int) -> DataFrame:
    """``lead``: struct of the annualised mean lead and the lead in Sharpe ratio, from first and second moments."""
    mean = {c: F.col(f"{c}1") / n for c in "rb"}
    spread = {c: F.sqrt(F.greatest(F.col(f"{c}2") / n - mean[c] * mean[c], F.lit(0.0))) for c in "rb"}
    sharpe = {c: F.when(spread[c] > 1e-12, mean[c] / spread[c] * math.sqrt(periods)) for c in "rb"}
    return sums.withColumn("lead", F.struct(((mean["r"] - mean["b"]) * periods).alias("mean"), (sharpe["r"] - sharpe["b"]).alias("sharpe")))


def reality_check(draws: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row (``by``: one for each value, and the figure is ``statistic_value``): the largest scaled lead, and its p-value against the largest recentred one of each repetition."""
    by, root = by or [], F.sqrt("n")
    name = "statistic_value" if by else "statistic"
    reps = draws.groupBy(*by, "rep").agg(F.max(root * F.col("observed")).alias("__s"), F.max(root * (F.col("draw") - F.col("observed"))).alias("resampled"))
    return reps.groupBy(*by).agg(F.max("__s").alias(name), ((1 + F.count_if(F.col("resampled") >= F.col("__s"))) / (1 + F.count(F.lit(1)))).alias("p_value"), F.count(F.lit(1)).alias("samples"))


def superior_ability(draws: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row (``by``: one for each value, and the figure is ``statistic_value``): the largest studentised lead (at least 0) and three p-values, by which members keep their lead as the centre of the null.

    ``lower``: those that lead; ``consistent``: those that trail by no more than
    sampling explains, a t of at least -sqrt(2 log log n); ``upper``: all.  The
    others have the centre 0.  Members whose draws do not vary are left out;
    under three sessions, where that limit has no value, the p-values are null.
    """
    by = by or []
    noise = F.sqrt(F.col("n")) * (F.col("draw") - F.col("observed"))
    scale = draws.groupBy(*by, "member").agg(F.sqrt(F.avg(noise * noise)).alias("scale"), F.first("n").alias("sessions"), F.first("observed").alias("lead")).filter("scale > 0")
    scale = scale.withColumn("t", F.sqrt("sessions") * F.col("lead") / F.col("scale"))
    bar = F.when(F.col("sessions") >= 3, -F.sqrt(2 * F.log(F.log(F.col("sessions").cast("double")))))
    keeps = {"upper": F.lit(True), "consistent": F.col("t") >= bar, "lower": F.col("lead") > 0}
    scale = scale.select(*by, "member", "sessions", "scale", "t", *(F.when(test, F.col("lead")).when(~test, 0.0).alias(k) for k, test in keeps.items()))
    # The scale of a family is a row a member; every repetition takes the largest excess over each centre.
    rows = draws.select(*by, "rep", "member", "draw").join(scale, [*by, "member"])
    excess = [F.greatest(F.max(F.sqrt("sessions") * (F.col("draw") - F.col(k)) / F.col("scale")), F.lit(0.0)).alias(k) for k in keeps]
    reps = rows.groupBy(*by, "rep").agg(F.greatest(F.max("t"), F.lit(0.0)).alias("__s"), F.min("sessions").alias("sessions"), *excess)
    p = [F.when(F.min("sessions") >= 3, (1 + F.count_if(F.col(k) >= F.col("__s"))) / (1 + F.count(F.lit(1)))).alias(f"p_{k}") for k in keeps]
    return reps.groupBy(*by).agg(F.max("__s").alias("statistic_value" if by else "statistic"), *p)


def expected_maximum(trials: float, variance: float) -> float:
    """Expected largest Sharpe ratio of so many trials without skill."""
    if trials <= 1:
        return 0.0
    normal = NormalDist()
    return math.sqrt(variance) * ((1 - EULER) * normal.inv_cdf(1 - 1 / trials) + EULER * normal.inv_cdf(1 - 1 / (trials * math.e)))


def deflated_sharpe(figures: DataFrame) -> DataFrame:
    """Adds ``status`` and ``deflated`` to (sharpe, trials, trial_variance, sessions, skew, excess_kurtosis): the chance that the Sharpe ratio per session beats the best of the trials.

    NOT_ESTIMABLE without trials or their variance, or if the correction for
    higher moments is not positive.
    """

    @F.pandas_udf("double")
    def chance(sharpe: pd.Series, trials: pd.Series, variance: pd.Series, sessions: pd.Series, under: pd.Series) -> pd.Series:
        normal = NormalDist()
        rows = zip(sharpe, trials, variance, sessions, under, strict=True)
        return pd.Series([normal.cdf((s - expected_maximum(k, v)) * math.sqrt(n - 1) / math.sqrt(u)) if u > 0 and v > 0 and k >= 1 and n >= 2 else None for s, k, v, n, u in rows], dtype="float64")

    under = 1 - F.col("skew") * F.col("sharpe") + (F.col("excess_kurtosis") + 2) / 4 * F.col("sharpe") * F.col("sharpe")
    out = figures.withColumn("deflated", chance("sharpe", F.col("trials").cast("double"), "trial_variance", F.col("sessions").cast("double"), under))
    return out.withColumn("status", F.when(F.col("deflated").isNull() | F.isnan("deflated"), "NOT_ESTIMABLE").otherwise("ESTIMATED"))


def sequence_paths(outcomes: DataFrame, samples: int = 200, method: str = "permutation") -> DataFrame:
    """(symbol, rep, terminal, min_capital, drawdown, losing_streak) of reordered outcomes (symbol, trade, contribution).

    Capital is 1 plus the sum so far.  ``permutation`` takes each outcome once,
    ``iid`` as many with replacement.  One repetition of one symbol is the unit
    of work.
    """
    by = Window.partitionBy("symbol").orderBy("trade")
    rows = outcomes.withColumn("i", F.row_number().over(by) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("symbol")))
    reps = rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    if method == "permutation":
        drawn = reps.withColumn("step", F.row_number().over(Window.partitionBy("symbol", "rep").orderBy(F.md5(F.concat_ws(":", "rep", "i")))))
    else:
        picks = reps.select("symbol", "rep", F.col("i").alias("step"), (uniform("rep", "i") % F.col("n")).cast("int").alias("i"))
        drawn = picks.join(rows.select("symbol", "i", "contribution"), ["symbol", "i"])
    order = Window.partitionBy("symbol", "rep").orderBy("step")
    past = order.rowsBetween(Window.unboundedPreceding, 0)
    drawn = drawn.withColumn("__c", 1 + F.sum("contribution").over(past)).withColumn("__lost", (F.col("contribution") < 0).cast("int"))
    drawn = drawn.withColumn("__dd", F.col("__c") / F.greatest(F.lit(1.0), F.max("__c").over(past)) - 1).withColumn("__run", F.sum(1 - F.col("__lost")).over(past))
    drawn = drawn.withColumn("__streak", F.sum("__lost").over(Window.partitionBy("symbol", "rep", "__run")))
    return drawn.groupBy("symbol", "rep").agg((1 + F.sum("contribution")).alias("terminal"), F.min("__c").alias("min_capital"), F.min("__dd").alias("drawdown"), F.max("__streak").alias("losing_streak"))


def sequence_summary(simulated: DataFrame, breach: float = 0.1) -> DataFrame:
    """Per symbol: quantiles of drawdown, worst capital, longest losing streak and the chance of a drawdown of at least ``breach``."""
    return simulated.groupBy("symbol").agg(F.percentile("drawdown", 0.05).alias("drawdown_p05"), F.percentile("drawdown", 0.5).alias("drawdown_p50"), F.min("min_capital").alias("worst_capital"), F.percentile("losing_streak", 0.95).alias("streak_p95"), F.avg((F.col("drawdown") <= -breach).cast("double")).alias("breach_probability"))


def sign_null(ledger: DataFrame, repetitions: int = 200, periods: int = 252) -> DataFrame:
    """One row: the Sharpe ratio of a given ledger (symbol, session, run, gross, cost) among those with the gross result of whole runs flipped at random.

    ``run`` is the number of a spell of one direction.  Costs stay.  The p-value
    is (1 + those at least as good) / (1 + repetitions).
    """
    daily = lambda rows, *keys: rows.groupBy(*keys, "session").agg(F.sum(F.col("gross") - F.col("cost")).alias("net"))
    sharpe = F.round(F.try_divide(F.avg("net"), F.stddev_samp("net")) * periods**0.5, 9)
    own = daily(ledger).agg(sharpe.alias("sharpe"))
    flipped = ledger.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))))
    flipped = flipped.withColumn("gross", F.when(uniform("rep", "symbol", "run") % 2 == 1, -F.col("gross")).otherwise(F.col("gross")))
    null = daily(flipped, "rep").groupBy("rep").agg(sharpe.alias("null_sharpe"))
    # ``own`` is a single row.
    both = null.join(F.broadcast(own))
    return both.agg(F.max("sharpe").alias("sharpe"), F.avg("null_sharpe").alias("null_mean"), F.percentile("null_sharpe", 0.95).alias("null_p95"), ((1 + F.count_if(F.col("null_sharpe") >= F.col("sharpe"))) / (1 + F.count(F.lit(1)))).alias("p_value"))
