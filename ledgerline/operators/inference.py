"""Resampling inference: replicates are keys, so their number scales out.

A stationary bootstrap's draws come from a hash of (seed, replicate, step), so
every path of a family sees the same draws and any task can make them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions.columns import grown, uniform
from ledgerline.operators.performance import autocovariances, lagged, monthly_returns


def hac_standard_error(paths: DataFrame, lags: int = 21) -> DataFrame:
    """Newey-West standard error of the mean per member, Bartlett weights, divided by n; infinite (and no t) where the long-run variance is not positive."""
    products, long_run = autocovariances(lags)
    out = lagged(paths.select("member", "session", "ret"), lags).groupBy("member").agg(F.count("ret").alias("n"), F.avg("ret").alias("mean"), *products)
    out = out.withColumn("__v", long_run).withColumn("se", F.when(F.col("__v") > 0, F.sqrt("__v") / F.col("n")).otherwise(float("inf")))
    return out.select("member", "n", "mean", "se", F.when(F.col("__v") > 0, F.col("mean") / F.col("se")).alias("t"))


def paired_hac(paths: DataFrame, benchmark: str, z: float = 1.6448536269514722) -> DataFrame:
    """Every other member against the benchmark on common sessions: mean difference, its HAC error, t, 90 % bounds and the least effect that could be told from 0."""
    base = paths.filter(F.col("member") == benchmark).select("session", F.col("ret").alias("__base"))
    gap = paths.filter(F.col("member") != benchmark).join(base, "session").select("member", "session", (F.col("ret") - F.col("__base")).alias("ret"))
    return hac_standard_error(gap).withColumn("low", F.col("mean") - z * F.col("se")).withColumn("high", F.col("mean") + z * F.col("se")).withColumn("detectable", z * F.col("se"))


def alpha_report(paths: DataFrame, benchmark: str) -> DataFrame:
    """Regression of every other member on the benchmark: beta, and alpha with its HAC error.

    The error of alpha is that of the mean of its influence values
    alpha + e * (1 - mx * (x - mx) / vx), whose mean is alpha.
    """
    base = paths.filter(F.col("member") == benchmark).select("session", F.col("ret").alias("x"))
    both = paths.filter(F.col("member") != benchmark).join(base, "session")
    fit = both.groupBy("member").agg(F.avg("x").alias("mx"), F.avg("ret").alias("my"), F.var_pop("x").alias("vx"), F.try_divide(F.covar_pop("x", "ret"), F.var_pop("x")).alias("beta"))
    fit = fit.withColumn("alpha", F.col("my") - F.col("beta") * F.col("mx"))
    error = F.col("ret") - F.col("alpha") - F.col("beta") * F.col("x")
    influence = F.col("alpha") + error * (1 - F.try_divide(F.col("mx") * (F.col("x") - F.col("mx")), F.col("vx")))
    hac = hac_standard_error(both.join(fit, "member").select("member", "session", influence.alias("ret")))
    return hac.withColumnRenamed("mean", "alpha").join(fit.select("member", "beta"), "member")


def hit_rates(paths: DataFrame, z: float = 1.959963984540054) -> DataFrame:
    """Share of sessions above 0 per member, with its 95 % Wilson bounds."""
    n, p = F.col("n"), F.col("rate")
    out = paths.groupBy("member").agg(F.count("ret").alias("n"), F.avg((F.col("ret") > 0).cast("double")).alias("rate"))
    centre, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return out.withColumn("low", (centre - half) / (1 + z * z / n)).withColumn("high", (centre + half) / (1 + z * z / n))


def stationary_draws(spark: SparkSession, length: int, samples: int, horizon: int, block: int, seed: int) -> DataFrame:
    """(rep, step, position): circular blocks of geometric length, mean ``block``."""
    grid = spark.range(samples).select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))).alias("step"))
    draw = lambda salt: uniform(F.lit(f"{seed}:{salt}:{block}"), "rep", "step")
    restart = (F.col("step") == 0) | (draw(1) * block < 2**32)
    by = Window.partitionBy("rep").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    start = F.last(F.when(restart, F.struct((draw(2) % length).alias("at"), F.col("step").alias("since"))), True).over(by)
    return grid.withColumn("__s", start).select("rep", "step", F.pmod(F.col("__s.at") + F.col("step") - F.col("__s.since"), F.lit(length)).cast("int").alias("position"))


def shared_length(paths: DataFrame) -> int:
    """Number of sessions of every member; members that do not share their sessions, or have one twice, are refused."""
    # Equal sums of hashes and equal counts stand for equal sets.
    each = paths.groupBy("member").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("session").alias("d"), F.sum(F.xxhash64("session").cast("decimal(38,0)")).alias("h"))
    seen = each.agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("d").alias("once"), F.min("h") == F.max("h")).first()
    if seen[0] is not None and not (seen[0] == seen[1] == seen[2] and seen[3]):
        raise ValueError("members do not share their sessions; families.family_members tells which")
    return seen[1] or 0


def _numbered(paths: DataFrame) -> tuple[DataFrame, int]:
    """(member, position, ret) and the number of positions, which all members share."""
    rows = paths.select("member", (F.row_number().over(Window.partitionBy("member").orderBy("session")) - 1).cast("int").alias("position"), "ret")
    return rows, shared_length(paths)


def bootstrap_drawdown(paths: DataFrame, samples: int = 200, horizons: tuple[int, ...] = (252,), blocks: tuple[int, ...] = (21, 63, 126), seed: int = 7, breach: float = 0.1) -> DataFrame:
    """Quantiles of growth and drawdown, and breach probability (<= -breach), per member, mean block length and horizon, on draws that all members share."""
    numbered, length = _numbered(paths)
    parts = []
    for block in blocks if length else ():
        # A shorter horizon is the beginning of the longest.
        drawn = stationary_draws(paths.sparkSession, length, samples, max(horizons), block, seed).join(numbered, "position")
        by = Window.partitionBy("member", "rep").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
        rows = drawn.withColumn("nav", grown("ret", by))
        rows = rows.withColumn("dd", F.col("nav") / F.greatest(F.lit(1.0), F.max("nav").over(by)) - 1)
        for horizon in horizons:
            ends = rows.filter(F.col("step") < horizon).groupBy("member", "rep").agg(F.min("dd").alias("dd"), (grown("ret") - 1).alias("growth"))
            parts.append(ends.select("*", F.lit(block).alias("block"), F.lit(horizon).alias("horizon")))
    if not parts:
        parts = [paths.filter("1 = 0").selectExpr("member", "0L AS rep", "0D AS dd", "0D AS growth", "0 AS block", "0 AS horizon")]
    ends = parts[0]
    for part in parts[1:]:
        ends = ends.unionByName(part)
    return ends.groupBy("member", "block", "horizon").agg(F.percentile("dd", 0.05).alias("dd_p05"), F.percentile("dd", 0.5).alias("dd_p50"), F.percentile("growth", 0.5).alias("growth_p50"), F.avg((F.col("dd") <= -breach).cast("double")).alias("breach_probability"), F.count(F.lit(1)).alias("samples"))


def monthly_bootstrap(paths: DataFrame, samples: int = 200, horizons: tuple[int, ...] = (60, 36, 12), blocks: tuple[int, ...] = (6, 12), seed: int = 11) -> DataFrame:
    """Resampled months per member, block and horizon: 5 % and 50 % quantiles of growth a year, Sharpe, month-end drawdown and the worst twelve months, and chances of loss, half the capital and drawdowns of 15 to 40 %.

    Horizons and blocks beyond the months there are drop out.
    """
    months = monthly_returns(paths).filter("ret IS NOT NULL").select("member", F.col("month").alias("session"), "ret")
    numbered, length = _numbered(months)
    out = None
    for block in (b for b in blocks if b <= length):
        fitting = [h for h in horizons if 12 <= h <= length]
        if not fitting:
            break
        drawn = stationary_draws(paths.sparkSession, length, samples, max(fitting), block, seed).join(numbered, "position")
        by = Window.partitionBy("member", "rep").orderBy("step")
        past, year = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(-11, 0)
        rows = drawn.withColumn("nav", grown("ret", past))
        rows = rows.withColumn("dd", F.col("nav") / F.greatest(F.lit(1.0), F.max("nav").over(past)) - 1).withColumn("year", F.when(F.col("step") >= 11, grown("ret", year) - 1))
        for horizon in fitting:
            ends = rows.filter(F.col("step") < horizon).groupBy("member", "rep").agg(
                grown("ret").alias("terminal"), F.min("dd").alias("dd"), F.min("nav").alias("least"), F.min("year").alias("year"), F.try_divide(F.avg("ret"), F.nullif(F.stddev_samp("ret"), F.lit(0.0))).alias("sharpe")
            )
            cagr, sharpe = F.pow("terminal", 12 / horizon) - 1, F.col("sharpe") * 12**0.5
            figures = {"cagr": cagr, "sharpe": sharpe, "drawdown": F.col("dd"), "worst_year": F.col("year")}
            quantiles = [F.percentile(c, q).alias(f"{n}_p{round(100 * q):02d}") for n, c in figures.items() for q in (0.05, 0.5)]
            chance = lambda test: F.avg(test.cast("double"))
            deep = [chance(F.col("dd") <= -d / 100).alias(f"drawdown_{d}") for d in (15, 20, 30, 40)]
            part = ends.groupBy("member").agg(*quantiles, chance(F.col("terminal") < 1).alias("loss"), chance(F.col("least") <= 0.5).alias("half_lost"), *deep)
            part = part.select("member", F.lit(block).alias("block"), F.lit(horizon).alias("horizon"), *part.columns[1:])
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("under twelve months, or fewer than a block")
    return out


def paired_bootstrap(paths: DataFrame, incumbent: str, samples: int = 200, blocks: tuple[int, ...] = (21, 63), seed: int = 13, periods: int = 252) -> DataFrame:
    """Every other member less the incumbent, resampled by one draw for both: annual mean, Sharpe and growth, their errors and bounds, per mean block length.

    A bound is the more careful of the percentile and the basic bootstrap one.
    Sharpe ratios take the population deviation; growth a year is by sessions.
    """
    base = paths.filter(F.col("member") == incumbent).select("session", F.col("ret").alias("base"))
    both = paths.filter(F.col("member") != incumbent).join(base, "session")
    numbered = both.select("member", (F.row_number().over(Window.partitionBy("member").orderBy("session")) - 1).cast("int").alias("position"), "ret", "base")
    length = numbered.agg(F.count_distinct("position")).first()[0]
    if not length:
        raise ValueError("the members share no session")
    n = F.sum("times")
    mean = lambda c: F.sum(F.col(c) * F.col("times")) / n
    square = lambda c: F.sum(F.col(c) * F.col(c) * F.col("times")) / n
    sharpe = lambda c: F.try_divide(mean(c), F.nullif(F.sqrt(F.greatest(square(c) - mean(c) * mean(c), F.lit(0.0))), F.lit(0.0))) * periods**0.5
    growth = lambda c: F.exp(F.sum(F.log1p(c) * F.col("times")) * periods / n) - 1
    figures = [((mean("ret") - mean("base")) * periods).alias("mean"), (sharpe("ret") - sharpe("base")).alias("sharpe"), (growth("ret") - growth("base")).alias("cagr")]
    long = F.expr("stack(3, 'mean', mean, 'sharpe', sharpe, 'cagr', cagr) AS (statistic, value)")
    observed = numbered.withColumn("times", F.lit(1)).groupBy("member").agg(*figures).select("member", long).withColumnRenamed("value", "estimate")
    out = None
    for block in blocks:
        # A repetition takes each session a number of times; these figures need no order.
        times = stationary_draws(paths.sparkSession, length, samples, length, block, seed).groupBy("rep", "position").agg(F.count(F.lit(1)).alias("times"))
        part = times.join(numbered, "position").groupBy("rep", "member").agg(*figures).select("member", long, F.lit(block).alias("block"))
        out = part if out is None else out.unionByName(part)
    spread = out.groupBy("member", "statistic", "block").agg(F.count("value").alias("samples"), F.stddev_samp("value").alias("se"), F.percentile("value", 0.05).alias("p05"), F.percentile("value", 0.95).alias("p95"))
    e = F.col("estimate")
    return spread.join(observed, ["member", "statistic"]).select("member", "statistic", "block", "samples", "estimate", "se", F.least("p05", 2 * e - F.col("p95")).alias("low"), F.greatest("p95", 2 * e - F.col("p05")).alias("high"), (1.645 * F.col("se")).alias("detectable"))


def loss_shape_resolution(paths: DataFrame, incumbent: str, samples: int = 100, blocks: tuple[int, ...] = (21, 63), seed: int = 17, periods: int = 252) -> DataFrame:
    """Every other member less the incumbent in drawdown over volatility, ulcer and pain index, on histories that all of them share: estimate, error, detectable effect and status per mean block length.

    The draws depend on the block length and the number of sessions only, so
    floors of different members can be compared.  UNRESOLVED without spread.
    """
    numbered, length = _numbered(paths)
    if not length:
        raise ValueError("the members share no session")

    def shapes(rows: DataFrame, *keys: str) -> DataFrame:
        by = Window.partitionBy("member", *keys).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
        out = rows.withColumn("nav", grown("ret", by))
        out = out.withColumn("dd", F.col("nav") / F.greatest(F.lit(1.0), F.max("nav").over(by)) - 1)
        depth = F.try_divide(-F.min("dd"), F.nullif(F.stddev_samp("ret") * periods**0.5, F.lit(0.0)))
        out = out.groupBy("member", *keys).agg(depth.alias("a"), F.sqrt(F.avg(F.pow("dd", 2))).alias("b"), F.avg(-F.col("dd")).alias("c"))
        long = out.select("member", *keys, F.expr("stack(3, 'drawdown_to_vol', a, 'ulcer', b, 'pain', c) AS (statistic, value)"))
        base = long.filter(F.col("member") == incumbent).select(*keys, "statistic", F.col("value").alias("__b"))
        return long.filter(F.col("member") != incumbent).join(base, [*keys, "statistic"]).select("member", *keys, "statistic", (F.col("value") - F.col("__b")).alias("delta"))

    observed = shapes(numbered.withColumnRenamed("position", "step")).withColumnRenamed("delta", "estimate")
    out = None
    for block in blocks:
        drawn = stationary_draws(paths.sparkSession, length, samples, length, block, seed).join(numbered, "position")
        part = shapes(drawn, "rep").withColumn("block", F.lit(block))
        out = part if out is None else out.unionByName(part)
    spread = out.groupBy("member", "statistic", "block").agg(F.stddev_samp("delta").alias("se"), F.count("delta").alias("samples"))
    known = F.coalesce(F.col("se") > 0, F.lit(False))
    rows = spread.join(observed, ["member", "statistic"])
    return rows.select("member", "statistic", "block", "samples", "estimate", "se", F.when(known, 1.645 * F.col("se")).alias("detectable"), F.when(~known, "UNRESOLVED").when(F.abs("estimate") > 1.645 * F.col("se"), "DETECTED").otherwise("WITHIN_NOISE").alias("status"))


def spanning_regression(paths: DataFrame, subject: str, lags: int = 21, periods: int = 252) -> DataFrame:
    """The subject on all other members at once: one row for each term (intercept first) with its coefficient, Newey-West error and t, and R2, residual volatility and the condition number of the design.

    The cross products of k regressors are one row of (k + 1)^2 sums; only that
    row is solved in Python.  A coefficient's error is that of the mean of its
    influence values.
    """
    names = [r["member"] for r in paths.filter(F.col("member") != subject).select("member").distinct().orderBy("member").collect()]
    if not names:
        raise ValueError("a spanning regression needs at least one other member")
    wide = paths.groupBy("session").pivot("member", [subject, *names]).agg(F.first("ret")).dropna()
    x = [F.lit(1.0), *(F.col(f"`{m}`") for m in names)]
    sums = wide.agg(F.array(*(F.sum(a * b) for a in x for b in x)).alias("xx"), F.array(*(F.sum(a * F.col(f"`{subject}`")) for a in x)).alias("xy"), F.count(F.lit(1)).alias("n"))

    @F.pandas_udf("coefficients array<double>, inverse array<double>, condition double")
    def solve(xx: pd.Series, xy: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in zip(xx, xy, strict=True):
            m = np.asarray(a, float).reshape(len(b), -1)
            inverse = np.linalg.pinv(m)
            values = np.sqrt(np.clip(np.linalg.eigvalsh(m), 0, None))
            rows.append(((inverse @ np.asarray(b, float)).tolist(), inverse.ravel().tolist(), float(values[-1] / values[0]) if values[0] > 0 else float("inf")))
        return pd.DataFrame(rows, columns=["coefficients", "inverse", "condition"])

    fit = sums.select("n", solve("xx", "xy").alias("f")).select("n", "f.*")
    k = len(x)
    # ``fit`` is one row.
    rows = wide.join(F.broadcast(fit))
    error = F.col(f"`{subject}`") - sum((F.get("coefficients", F.lit(i)) * a for i, a in enumerate(x)), F.lit(0.0))
    rows = rows.withColumn("__e", error)
    influence = [F.get("coefficients", F.lit(i)) + F.col("n") * F.col("__e") * sum((F.get("inverse", F.lit(i * k + j)) * a for j, a in enumerate(x)), F.lit(0.0)) for i in range(k)]
    terms = F.array(*(F.struct(F.lit(m).alias("member"), v.alias("ret")) for m, v in zip(["intercept", *names], influence, strict=True)))
    hac = hac_standard_error(rows.select("session", F.explode(terms).alias("t")).select("session", "t.*"), lags)
    whole = rows.agg(F.first("condition").alias("condition"), (F.stddev_samp("__e") * periods**0.5).alias("residual_vol"), (1 - F.sum(F.col("__e") * F.col("__e")) / (F.var_pop(f"`{subject}`") * F.count(F.lit(1)))).alias("r2"))
    return hac.withColumnRenamed("member", "term").withColumnRenamed("mean", "coefficient").join(F.broadcast(whole))


def cscv_splits(paths: DataFrame, blocks: int = 16) -> DataFrame:
    """Combinatorial cross-validation on block sums: for every half of the blocks the member of the best in-sample Sharpe ratio, ranked out of sample.

    Blocks hold equally many rows in order; what does not divide evenly is left
    out at the front.  Splits are numbered from the one that takes the first
    blocks.
    """
    by = Window.partitionBy("member").orderBy(F.desc("session"))
    size = F.floor(F.col("__n") / blocks)
    rows = paths.withColumn("__back", F.row_number().over(by) - 1).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("member")))
    cut = rows.filter(F.col("__back") < size * blocks).withColumn("block", (blocks - 1 - F.floor(F.col("__back") / size)).cast("int"))
    sums = cut.groupBy("member", "block").agg(F.count("ret").alias("n"), F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("q"))
    masks = paths.sparkSession.range(1 << blocks).filter(F.bit_count("id") == blocks // 2)
    splits = masks.select("id", F.posexplode(F.expr(f"transform(sequence(0, {blocks - 1}), i -> shiftright(id, {blocks - 1} - i) & 1 = 1)")).alias("block", "inside"))
    total = splits.join(sums, "block").groupBy("id", "inside", "member").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("n")
    total = total.withColumn("sharpe", F.round(F.try_divide(mean, F.nullif(F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))), F.lit(0.0))), 12))
    w = Window.partitionBy("id", "inside")
    ranked = total.withColumn("__below", F.rank().over(w.orderBy("sharpe")) - 1).withColumn("__ties", F.count(F.lit(1)).over(Window.partitionBy("id", "inside", "sharpe"))).withColumn("__many", F.count(F.lit(1)).over(w))
    best = ranked.filter("inside").groupBy("id").agg(F.min_by("member", F.struct(-F.col("sharpe"), "member")).alias("member"))
    chosen = ranked.filter("NOT inside").join(best, ["id", "member"])
    chosen = chosen.select((1 << blocks) - F.col("id"), F.col("member").alias("chosen"), ((F.col("__below") + (F.col("__ties") + 1) / 2) / (F.col("__many") + 1)).alias("relative_rank"), F.col("sharpe").alias("outside_sharpe")).toDF("split", "chosen", "relative_rank", "outside_sharpe")
    return chosen.withColumn("logit", F.log(F.col("relative_rank") / (1 - F.col("relative_rank")))).withColumn("overfit", F.col("logit") <= 0)


def cscv_report(paths: DataFrame, blocks: int = 16, need_members: int = 10, need_rows: int = 252, least_blocks: int = 8) -> DataFrame:
    """One row: status, reason, blocks, rows a block, rows left out, members, splits, the probability of backtest overfitting and the share of losing choices.

    NOT_ESTIMABLE with an odd or small number of blocks, few members, short
    blocks, or members that do not share their sessions.
    """
    lengths = paths.groupBy("member").agg(F.count("ret").alias("n"))
    seen = lengths.agg(F.count(F.lit(1)).alias("members"), F.coalesce(F.min("n"), F.lit(0)).alias("low"), F.coalesce(F.max("n"), F.lit(0)).alias("high")).first()
    each = seen["low"] // blocks
    refusal = None
    if blocks % 2:
        refusal = "an odd number of blocks has no equal halves"
    elif blocks < least_blocks:
        refusal = f"under {least_blocks} blocks"
    elif seen["members"] < need_members:
        refusal = f"under {need_members} members"
    elif seen["low"] != seen["high"]:
        refusal = "members do not share their sessions"
    elif each < need_rows:
        refusal = f"under {need_rows} rows a block"
    head = [F.lit(v).alias(k) for k, v in (("status", "NOT_ESTIMABLE" if refusal else "ESTIMATED"), ("reason", refusal or ""), ("blocks", blocks), ("rows_a_block", each), ("dropped", seen["low"] - each * blocks), ("members", seen["members"]))]
    if refusal:
        return paths.sparkSession.range(1).select(*head, F.lit(0).cast("long").alias("splits"), F.lit(None).cast("double").alias("pbo"), F.lit(None).cast("double").alias("loss"))
    return cscv_splits(paths, blocks).agg(F.count(F.lit(1)).alias("splits"), F.avg(F.col("overfit").cast("double")).alias("pbo"), F.avg((F.col("outside_sharpe") < 0).cast("double")).alias("loss")).select(*head, "splits", "pbo", "loss")


def walk_forward(paths: DataFrame, years: list[int], stand_off: int = 0, least: int = 1, by: list[str] | None = None) -> DataFrame:
    """Anchored walk-forward: for each test year the member of the best Sharpe ratio on all earlier sessions but the last ``stand_off``, and its result in that year.

    Ties go to the first member by name; folds with fewer than ``least`` training
    rows are left out.  ``by``: columns whose values each choose on their own.
    """
    folds = paths.withColumn("fold", F.explode(F.array(*map(F.lit, years))))
    key, year = [*(by or []), "fold"], F.year("session")
    own = [*key, "member"]
    train = folds.filter(year < F.col("fold"))
    if stand_off or least > 1:
        back = Window.partitionBy(*own).orderBy(F.desc("session"))
        train = train.withColumn("__back", F.row_number().over(back)).filter(F.col("__back") > stand_off)
        train = train.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*own))).filter(F.col("__n") >= least)
    train = train.groupBy(*own).agg(F.round(F.try_divide(F.avg("ret"), F.stddev_pop("ret")), 12).alias("score"), F.count("ret").alias("train_n"))
    best = train.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "member"))).filter("__r = 1").drop("__r")
    test = folds.filter(year == F.col("fold")).groupBy(*own).agg((grown("ret") - 1).alias("test_return"), F.count("ret").alias("test_n"))
    return best.join(test, own)
