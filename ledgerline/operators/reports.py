"""Reports over several windows or paths: windows side by side, folds, risk-matched paths, overlays, collateral identities and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.columns import elapsed_years, grown
from ledgerline.operators.performance import wealth


def windowed(paths: DataFrame, windows: dict[str, tuple[str, str]]) -> DataFrame:
    """Paths in every window (first and last day) that holds them, with ``window`` and ``since``: the session before the window, or its first."""
    by = Window.partitionBy("member").orderBy("session")
    rows = paths.withColumn("__before", F.lag("session").over(by))
    marks = F.array(*(F.struct(F.lit(n).alias("window"), F.lit(a).cast("date").alias("a"), F.lit(b).cast("date").alias("b")) for n, (a, b) in windows.items()))
    rows = rows.withColumn("w", F.explode(marks)).filter("session BETWEEN w.a AND w.b AND ret IS NOT NULL")
    rows = rows.select("member", "session", "ret", F.col("w.window").alias("window"), "__before")
    first = Window.partitionBy("member", "window").orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("since", F.first(F.coalesce("__before", "session")).over(first)).drop("__before")


def window_metrics(rows: DataFrame, periods: int = 252) -> DataFrame:
    """Per member and window of ``windowed`` rows: sessions, years, growth a year, volatility, Sharpe, Sortino, drawdown, Calmar, hit rate."""
    keyed = rows.withColumn("key", F.concat_ws("|", "member", "window"))
    deep = wealth(keyed.select(F.col("key").alias("member"), "session", "ret")).groupBy(F.col("member").alias("key")).agg(F.min("drawdown").alias("max_drawdown"))
    root, down = periods**0.5, F.sqrt(F.avg(F.pow(F.least("ret", F.lit(0.0)), 2)))
    out = keyed.groupBy("key", "member", "window").agg(
        F.min("session").alias("start"), F.max("session").alias("end"), F.count(F.lit(1)).alias("sessions"), elapsed_years(F.min("since"), F.max("session")).alias("years"), grown("ret").alias("__grown"), (F.stddev_samp("ret") * root).alias("vol"),
        (F.try_divide(F.avg("ret"), F.nullif(F.stddev_samp("ret"), F.lit(0.0))) * root).alias("sharpe"), F.when(down > 0, F.avg("ret") / down * root).alias("sortino"), F.avg((F.col("ret") > 0).cast("double")).alias("hit_rate"),
    )
    out = out.join(deep, "key").withColumn("cagr", F.pow("__grown", 1 / F.col("years")) - 1)
    return out.withColumn("calmar", F.when(F.col("max_drawdown") < 0, F.col("cagr") / -F.col("max_drawdown"))).drop("key", "__grown")


def complete_years(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """Per member and window: calendar years it touches, and those of which it holds every session of a calendar that runs from January to December."""
    whole = paths.groupBy("member", F.year("session").alias("year")).agg(F.count(F.lit(1)).alias("__all"), F.min(F.month("session")).alias("__a"), F.max(F.month("session")).alias("__b"))
    held = rows.groupBy("member", "window", F.year("session").alias("year")).agg(F.count(F.lit(1)).alias("__n")).join(whole, ["member", "year"])
    return held.groupBy("member", "window").agg(F.count(F.lit(1)).alias("years_touched"), F.count_if((F.col("__n") == F.col("__all")) & (F.col("__a") == 1) & (F.col("__b") == 12)).alias("complete_years"))


def side_by_side(metrics: DataFrame, windows: list[str], figures: list[str]) -> DataFrame:
    """(member, figure, one column a window, change from the first to the last)."""
    long = metrics.select("member", "window", F.explode(F.array(*(F.struct(F.lit(f).alias("figure"), F.col(f).cast("double").alias("value")) for f in figures))).alias("x")).select("member", "window", "x.*")
    wide = long.groupBy("member", "figure").pivot("window", windows).agg(F.first("value"))
    return wide.withColumn("change", F.col(f"`{windows[-1]}`") - F.col(f"`{windows[0]}`"))


def dispersion(folds: DataFrame, figures: list[str]) -> DataFrame:
    """Per figure of fold rows: folds, mean, median, deviation, least, most and how many are above 0."""
    long = folds.select(F.explode(F.array(*(F.struct(F.lit(f).alias("figure"), F.col(f).cast("double").alias("v")) for f in figures))).alias("x")).select("x.*").filter("v IS NOT NULL")
    return long.groupBy("figure").agg(F.count("v").alias("folds"), F.avg("v").alias("mean"), F.percentile("v", 0.5).alias("median"), F.stddev_samp("v").alias("deviation"), F.min("v").alias("least"), F.max("v").alias("most"), F.count_if(F.col("v") > 0).alias("positive"))


def fold_accounting(paths: DataFrame, stitched: DataFrame, folds: dict[str, tuple[str, str]]) -> DataFrame:
    """One row: sessions in some fold, in several, in none of those between the first fold and the last, and of the stitched path outside its folds or missing from it."""
    marks = F.array(*(F.struct(F.lit(a).cast("date").alias("a"), F.lit(b).cast("date").alias("b")) for a, b in folds.values()))
    inside = lambda day: F.size(F.filter(marks, lambda f: (day >= f["a"]) & (day <= f["b"])))
    days = paths.select("session").distinct().withColumn("n", inside(F.col("session")))
    first, last = min(a for a, _ in folds.values()), max(b for _, b in folds.values())
    both = days.join(stitched.select("session").distinct().withColumn("there", F.lit(1)), "session", "full_outer")
    due = F.col("session").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return both.agg(
        F.count_if(F.col("n") > 0).alias("in_folds"), F.count_if(F.col("n") > 1).alias("overlapping"), F.count_if((F.coalesce("n", F.lit(0)) == 0) & due & F.col("n").isNotNull()).alias("between_folds"),
        F.count_if(F.col("there").isNotNull() & (F.coalesce("n", F.lit(0)) == 0)).alias("outside"), F.count_if(F.col("there").isNull() & (F.col("n") > 0)).alias("missing"),
    ).withColumn("status", F.when(F.greatest("overlapping", "outside", "missing") == 0, "PASS").otherwise("BLOCKED"))


def risk_matched(paths: DataFrame, reference: str, periods: int = 252) -> DataFrame:
    """Per member: the multiplier that gives the reference's volatility, and growth, drawdown and Sharpe of the path times it; members without volatility are left out."""
    vols = paths.groupBy("member").agg((F.stddev_samp("ret") * periods**0.5).alias("vol"))
    # The reference's volatility is one number.
    own = vols.filter(F.col("member") == reference).select(F.col("vol").alias("matched"))
    scale = vols.filter("vol > 0").join(F.broadcast(own)).withColumn("multiplier", F.col("matched") / F.col("vol"))
    rows = wealth(paths.join(scale, "member").withColumn("ret", F.col("ret") * F.col("multiplier")))
    years = elapsed_years(F.min("session"), F.max("session"))
    out = rows.groupBy("member").agg(F.first("vol").alias("vol"), F.first("multiplier").alias("multiplier"), (F.pow(grown("ret"), 1 / years) - 1).alias("cagr"), F.min("drawdown").alias("max_drawdown"), (F.avg("ret") / F.stddev_samp("ret") * periods**0.5).alias("sharpe"), F.try_divide(-F.min("drawdown"), F.stddev_samp("ret") * periods**0.5).alias("drawdown_to_vol"))
    return out


def overlay_report(paths: DataFrame, exposure: DataFrame) -> DataFrame:
    """Base and scaled path side by side: each member's metrics with and without the exposure (member, session, exposure) of the session before."""
    by = Window.partitionBy("member").orderBy("session")
    joined = paths.join(exposure, ["member", "session"], "left").withColumn("__e", F.coalesce(F.lag("exposure").over(by), F.lit(1.0)))
    forms = F.array(F.struct(F.lit("base").alias("window"), F.col("ret").alias("ret")), F.struct(F.lit("scaled").alias("window"), (F.col("ret") * F.col("__e")).alias("ret")))
    rows = joined.select("member", "session", F.explode(forms).alias("x")).select("member", "session", "x.ret", "x.window")
    return window_metrics(rows.withColumn("since", F.min("session").over(Window.partitionBy("member", "window")))).withColumnRenamed("window", "form")


def with_reference(metrics: DataFrame, paths: DataFrame, reference: str) -> DataFrame:
    """Metrics of paths with their correlation to the reference on shared sessions."""
    base = paths.filter(F.col("member") == reference).select("session", F.col("ret").alias("__r"))
    own = paths.join(base, "session").groupBy("member").agg(F.when(F.count(F.lit(1)) > 2, F.try_divide(F.covar_pop("ret", "__r"), F.nullif(F.stddev_pop("ret") * F.stddev_pop("__r"), F.lit(0.0)))).alias("correlation"))
    return metrics.join(own, "member", "left")


def state_coverage(states: DataFrame, wanted: list[str], first: str, last: str) -> DataFrame:
    """Per wanted state: sessions in the window; BLOCKED without any, so that nothing is concluded on a state that was not there."""
    inside = states.filter(F.col("session").between(F.lit(first).cast("date"), F.lit(last).cast("date"))).groupBy("state").agg(F.count(F.lit(1)).alias("sessions"))
    need = states.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, wanted))).alias("state"))
    out = need.join(inside, "state", "left").na.fill(0, ["sessions"])
    return out.withColumn("status", F.when(F.col("sessions") > 0, "PASS").otherwise("BLOCKED"))


def collateral_checks(funded: DataFrame, stressed: DataFrame, spread: float, daycount: int, stale: int, tolerance: float = 1e-9) -> DataFrame:
    """One row per member and check of funded paths (member, session, ret, days, rate, unrated, interest, funded, nav): error and status.

    Interest is rate x days / daycount, funded is return plus interest, the NAV
    compounds it, every day of the span accrues once, runs without a rate are at
    most ``stale``, rates lie in 0 to 25 %, and a wider spread (``stressed``)
    never ends higher.
    """
    by = Window.partitionBy("member").orderBy("session")
    earned = F.when(F.col("unrated"), 0.0).otherwise(F.greatest(F.col("rate") - spread, F.lit(0.0)) * F.col("days") / daycount)
    rows = funded.withColumn("__e", earned).withColumn("__nav", F.coalesce(F.lag("nav").over(by), F.lit(1.0)) * (1 + F.col("funded")))
    rows = rows.withColumn("__run", F.sum((~F.col("unrated")).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.filter("unrated").groupBy("member", "__run").agg(F.count(F.lit(1)).alias("n")).groupBy("member").agg(F.max("n").alias("__longest"))
    worst = lambda x: F.max(F.abs(x))
    out = rows.groupBy("member").agg(
        worst(F.col("interest") - F.col("__e")).alias("accrual"), worst(F.col("funded") - F.col("ret") - F.col("interest")).alias("funded_return"), worst(F.col("nav") / F.col("__nav") - 1).alias("nav_recursion"),
        F.abs(F.sum("days") - F.datediff(F.max("session"), F.min("session"))).cast("double").alias("days_complete"), F.greatest(F.lit(0.0), F.max(-F.col("rate")), F.max(F.col("rate") - 0.25)).alias("rate_bounds"), F.max_by("nav", "session").alias("__end"),
    )
    ends = stressed.groupBy("member").agg(F.max_by("nav", "session").alias("__stress"))
    out = out.join(ends, "member").join(runs, "member", "left")
    out = out.withColumn("stale_runs", F.greatest(F.coalesce("__longest", F.lit(0)) - stale, F.lit(0)).cast("double")).withColumn("spread_monotone", F.greatest(F.lit(0.0), F.col("__stress") - F.col("__end")))
    names = ["accrual", "funded_return", "nav_recursion", "days_complete", "rate_bounds", "stale_runs", "spread_monotone"]
    long = out.select("member", F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).alias("error")) for n in names))).alias("x")).select("member", "x.*")
    return long.withColumn("status", F.when(F.col("error") <= tolerance, "PASS").otherwise("BLOCKED"))


def jitter(runs: DataFrame, tolerance: float) -> DataFrame:
    """Per statistic of (statistic, gap, value): the range of values over runs whose gap is within the tolerance."""
    return runs.filter(F.abs("gap") <= tolerance).groupBy("statistic").agg(F.count(F.lit(1)).alias("runs"), F.min("value").alias("least"), F.max("value").alias("most"), (F.max("value") - F.min("value")).alias("band"))


def resolution_floors(effects: DataFrame, bands: DataFrame) -> DataFrame:
    """Per statistic: the largest detectable effect over its blocks (null if one is unknown), the jitter band, and the larger of both."""
    detect = effects.groupBy("statistic").agg(F.when(F.count_if(F.col("detectable").isNull()) == 0, F.max("detectable")).alias("detectable"))
    out = detect.join(bands.select("statistic", "band"), "statistic", "left")
    return out.withColumn("floor", F.when(F.col("detectable").isNotNull(), F.greatest("detectable", F.coalesce("band", F.lit(0.0)))))


def published_deltas(values: DataFrame, baseline: str, floors: DataFrame) -> DataFrame:
    """Differences of (variant, statistic, value) from the baseline, published only beyond the statistic's floor."""
    base = values.filter(F.col("variant") == baseline).select("statistic", F.col("value").alias("__b"))
    rows = values.filter(F.col("variant") != baseline).join(base, "statistic").join(floors.select("statistic", "floor"), "statistic", "left")
    delta = F.col("value") - F.col("__b")
    status = F.when(F.col("floor").isNull(), "NO_FLOOR").when(F.abs(delta) > F.col("floor"), "RESOLVED").otherwise("BELOW_FLOOR")
    return rows.select("variant", "statistic", F.when(F.abs(delta) > F.col("floor"), delta).alias("delta"), "floor", status.alias("status"))


def straddling_episode(paths: DataFrame, start: str, end: str, boundary: str, periods: int = 252) -> DataFrame:
    """Three rows a member over an episode that crosses a boundary: whole, before it, and from it on.

    One pass with grouping sets gives sessions, growth, volatility, Sharpe ratio
    and the drawdown within each part.  ``basis`` names what a part may be used
    for: MIXED, IN_SAMPLE or OUT_OF_SAMPLE; a member whose sessions lie on one
    side only is NOT_STRADDLING and has no figures.
    """
    rows = paths.filter(F.col("session").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & F.col("ret").isNotNull())
    rows = rows.withColumn("part", F.when(F.col("session") < F.lit(boundary).cast("date"), "before").otherwise("after"))
    for name, keys in (("__whole", ["member"]), ("__part", ["member", "part"])):
        own = Window.partitionBy(*keys).orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn(name, grown("ret", own))
        rows = rows.withColumn(name, F.col(name) / F.greatest(F.lit(1.0), F.max(name).over(own)) - 1)
    out = rows.groupingSets([["member"], ["member", "part"]], "member", "part").agg(
        F.grouping("part").alias("__all"), F.count("ret").alias("sessions"), F.count_if(F.col("session") < F.lit(boundary).cast("date")).alias("__before"), (grown("ret") - 1).alias("growth"), (F.stddev_samp("ret") * periods**0.5).alias("volatility"),
        (F.try_divide(F.avg("ret"), F.nullif(F.stddev_samp("ret"), F.lit(0.0))) * periods**0.5).alias("sharpe"), F.min("__whole").alias("__dw"), F.min("__part").alias("__dp"),
    )
    sides = F.count_if(F.col("__all") == 0).over(Window.partitionBy("member"))
    whole, figures = F.col("__all") == 1, ["growth", "volatility", "sharpe", "max_drawdown"]
    out = out.withColumn("max_drawdown", F.when(whole, F.col("__dw")).otherwise(F.col("__dp"))).withColumn("__ok", sides == 2)
    basis = F.when(~F.col("__ok"), "NOT_STRADDLING").when(whole, "MIXED").when(F.col("part") == "before", "IN_SAMPLE").otherwise("OUT_OF_SAMPLE")
    return out.select("member", F.coalesce("part", F.lit("whole")).alias("part"), basis.alias("basis"), "sessions", *(F.when(F.col("__ok"), F.col(c)).alias(c) for c in figures))


def exposure_shares(book: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Mean and largest weight share and risk share by class and by symbol, from (session, symbol, class, weight after trading, ret).

    A session is earned by the weights of the session before, whatever the
    window; risk share is cov(weight x return, portfolio) / var(portfolio), so
    the classes add up to 1, and so do the symbols.  A null class is
    ``unclassified``; rows of symbols have theirs, rows of classes have none.
    """
    held = F.coalesce(F.lag("weight").over(Window.partitionBy("symbol").orderBy("session")), F.lit(0.0))
    rows = book.withColumn("__earned", held * F.coalesce("ret", F.lit(0.0))).withColumn("class", F.coalesce("class", F.lit("unclassified")))
    rows = rows.filter(F.col("session") >= F.lit(start).cast("date")) if start else rows
    rows = rows.filter(F.col("session") <= F.lit(end).cast("date")) if end else rows
    # A row for each session, class and symbol, and one for each session and class.
    cells = rows.groupingSets([["session", "class"], ["session", "class", "symbol"]], "session", "class", "symbol").agg(F.sum("weight").alias("weight"), F.sum("__earned").alias("earned"))
    total = rows.groupBy("session").agg(F.sum("__earned").alias("total"))
    # A symbol that has no row in a session holds nothing there, so means go over all sessions.
    many = total.agg(F.count(F.lit(1)).alias("__n"), F.avg("total").alias("__mean"), F.var_pop("total").alias("__var"))
    each = cells.join(total, "session").groupBy("class", "symbol").agg(F.sum("weight").alias("__w"), F.count(F.lit(1)).alias("__k"), F.max("weight").alias("__m"), F.sum(F.col("earned") * F.col("total")).alias("__et"), F.sum("earned").alias("__e"))
    each = each.join(F.broadcast(many))
    covariance = F.col("__et") / F.col("__n") - F.col("__e") / F.col("__n") * F.col("__mean")
    largest = F.when(F.col("__k") < F.col("__n"), F.greatest("__m", F.lit(0.0))).otherwise(F.col("__m"))
    return each.select("class", "symbol", (F.col("__w") / F.col("__n")).alias("mean_weight"), largest.alias("largest_weight"), F.try_divide(covariance, F.nullif("__var", F.lit(0.0))).alias("risk_share"))
