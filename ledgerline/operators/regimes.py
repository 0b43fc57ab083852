"""Regimes: absorption ratio, Markov switching, managed variance, stress adjustment and outcomes by state."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.panel import by_symbol, month_end_rows
from ledgerline.operators.rolling import full, terciles, trailing


def absorption_ratio(returns: DataFrame, window: int = 252, components: int | None = None, lag: int = 1) -> DataFrame:
    """(session, ratio): share of the variance of all symbols in the leading components over the last ``window`` sessions, ``lag`` sessions later.

    A session whose window lacks a value of any symbol has none; by default a
    fifth of the components lead.  Pairs of symbols are windowed apart; a
    session's covariances (the square of the number of symbols) meet in a row.
    """
    a = returns.select("session", F.col("symbol").alias("i"), F.col("ret").alias("x"))
    b = returns.select("session", F.col("symbol").alias("j"), F.col("ret").alias("y"))
    frame = Window.partitionBy("i", "j").orderBy("session").rowsBetween(-(window - 1), 0)
    both = a.join(b, "session").filter("i <= j")
    known = F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)).over(frame) >= window
    cov = both.withColumn("cov", F.when(known, F.covar_samp("x", "y").over(frame)))
    rows = cov.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "cov"))), lambda s: s["cov"]).alias("upper"))

    @F.pandas_udf("double")
    def share(upper: pd.Series) -> pd.Series:
        def one(v):
            v = np.array(v, dtype=np.float64)
            n = int((8 * len(v) + 1) ** 0.5 - 1) // 2
            if n < 2 or n * (n + 1) // 2 != len(v) or not np.isfinite(v).all():
                return None
            m = np.zeros((n, n))
            m[np.triu_indices(n)] = v
            values = np.clip(np.linalg.eigvalsh(m, UPLO="U")[::-1], 0.0, None)
            lead = components or max(1, round(n / 5))
            return float(values[:lead].sum() / values.sum()) if values.sum() > 0 else None

        return upper.map(one).astype("float64")

    # One row a session from here on.
    order = Window.orderBy("session")
    return rows.select("session", share("upper").alias("ratio")).withColumn("ratio", F.lag("ratio", lag).over(order))


def absorption_shift(ratios: DataFrame, fast: int = 15, slow: int = 252) -> DataFrame:
    """Adds ``shift``: (fast mean - slow mean) / slow deviation of ``ratio``."""
    order = Window.orderBy("session")
    mean = lambda n: full(F.avg("ratio"), "ratio", order.rowsBetween(-(n - 1), 0), n)
    spread = full(F.stddev_samp("ratio"), "ratio", order.rowsBetween(-(slow - 1), 0), slow)
    return ratios.withColumn("shift", F.try_divide(mean(fast) - mean(slow), F.when(spread != 0, spread)))


def stress_state(shift: Column, threshold: float = 1.0, above: str = "Stress", below: str = "Calm") -> Column:
    """Null stays null."""
    return F.when(shift.isNotNull(), F.when(shift >= threshold, above).otherwise(below))


def combined_states(labelled: dict[str, DataFrame]) -> DataFrame:
    """One column of labels for each frame (symbol, session, state), on the rows of all, and ``panic`` from those called bear and volatility."""
    out = None
    for name, df in labelled.items():
        part = df.withColumnRenamed("state", name)
        out = part if out is None else out.join(part, ["symbol", "session"], "full_outer")
    return out.withColumn("panic", panic_state(F.col("bear") == "Bear", F.col("volatility") == "High"))


def panic_state(bear: Column, high: Column) -> Column:
    """Panic where both flags hold, No panic where one does not; null if either is unknown."""
    return F.when(bear.isNotNull() & high.isNotNull(), F.when(bear & high, "Panic").otherwise("No panic"))


def adjusted_correlation(rho: Column, variance_ratio: Column) -> Column:
    """Correlation free of a rise in variance: rho / sqrt(1 + d (1 - rho^2)); null where that has no root."""
    under = 1 + variance_ratio * (1 - rho * rho)
    return F.when(under > 0, rho / F.sqrt(under))


def drawdown_multiplier(drawdown: Column, soft: float = 0.05, hard: float = 0.15, least: float = 0.5) -> Column:
    """Exposure 1 down to a drawdown of ``soft``, ``least`` from ``hard`` on, a line between; drawdown as a fraction of at least 0."""
    return F.when(drawdown <= soft, 1.0).when(drawdown >= hard, least).otherwise(1 - (drawdown - soft) / (hard - soft) * (1 - least))


def weekly_log_returns(returns: DataFrame) -> DataFrame:
    """(symbol, week, ret): log return of weeks that end on Friday; the last week, which may be open, is left out."""
    weeks = returns.withColumn("week", F.date_add(F.date_trunc("week", F.date_add("session", 2)).cast("date"), 4))
    out = weeks.groupBy("symbol", "week").agg(F.sum(F.when(F.col("ret") > -1, F.log1p("ret"))).alias("ret"))
    return out.withColumn("__last", F.max("week").over(Window.partitionBy("symbol"))).filter("week < __last").drop("__last")


def managed_variance(returns: DataFrame, need_days: int = 5, need_months: int = 24) -> DataFrame:
    """(symbol, session, weight) at month ends: c / the month's variance (sum of squares about its mean).

    c is the deviation of returns over that of returns divided by the variance
    of the month before, both up to the decision; no weight before
    ``need_months`` months.
    """
    monthly = returns.filter("ret IS NOT NULL").groupBy("symbol", F.trunc("session", "MM").alias("month")).agg(F.count("ret").alias("n"), (F.var_pop("ret") * F.count("ret")).alias("rv"))
    monthly = monthly.withColumn("rv", F.when((F.col("n") >= need_days) & (F.col("rv") > 0), F.col("rv")))
    by = Window.partitionBy("symbol").orderBy("month")
    monthly = monthly.withColumn("before", F.lag("rv").over(by)).withColumn("months", F.row_number().over(by))
    rows = returns.withColumn("month", F.trunc("session", "MM")).join(monthly.drop("n"), ["symbol", "month"])
    rows = rows.withColumn("managed", F.col("ret") / F.col("before"))
    so_far = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("c", F.try_divide(F.stddev_samp("ret").over(so_far), F.when(F.stddev_samp("managed").over(so_far) > 0, F.stddev_samp("managed").over(so_far))))
    return month_end_rows(rows).withColumn("weight", F.when(F.col("months") >= need_months, F.try_divide(F.col("c"), F.col("rv")))).select("symbol", "session", "weight")


def fitted_variance_scale(returns: DataFrame, first: str, last: str, window: int = 21, high: float = 1.0, low: float = 0.0, lag: int = 1) -> DataFrame:
    """Adds ``scale`` and ``status``: c / the mean square of the last ``window`` returns, ``lag`` rows before, clipped.

    c is the deviation of returns over that of returns divided by that variance,
    on the rows from ``first`` to ``last`` only, and frozen after it.  A symbol
    with fewer than two such rows, or without spread, is NOT_ESTIMABLE and has no
    scale.
    """
    square = F.col("ret") * F.col("ret")
    variance = full(F.avg(square), square, trailing(window), window)
    rows = returns.withColumn("__v", variance).withColumn("__v", F.nullif(F.lag("__v", lag).over(by_symbol()), F.lit(0.0)))
    inside = F.col("session").between(F.lit(first).cast("date"), F.lit(last).cast("date")) & F.col("__v").isNotNull() & F.col("ret").isNotNull()
    own, managed = F.when(inside, F.col("ret")), F.when(inside, F.col("ret") / F.col("__v"))
    # One number a symbol, joined back.
    fit = rows.groupBy("symbol").agg(F.count(own).alias("__n"), F.stddev_samp(own).alias("__a"), F.stddev_samp(managed).alias("__b"))
    fit = fit.select("symbol", F.when((F.col("__n") >= 2) & (F.col("__b") > 0), F.col("__a") / F.col("__b")).alias("__c"))
    scale = F.greatest(F.lit(low), F.least(F.lit(high), F.col("__c") / F.col("__v")))
    rows = rows.join(fit, "symbol", "left").withColumn("scale", F.when(F.col("__c").isNotNull() & F.col("__v").isNotNull(), scale))
    return rows.withColumn("status", F.when(F.col("__c").isNotNull(), "ESTIMATED").otherwise("NOT_ESTIMABLE")).drop("__v", "__c")


def decision_scale(returns: DataFrame, target: float = 0.12, window: int = 126, month: int = 21) -> DataFrame:
    """(symbol, session, scale) at month ends: the monthly target over the volatility of a month, from the mean square of the last ``window`` returns; not capped."""
    square = F.col("ret") * F.col("ret")
    spread = F.sqrt(month * full(F.avg(square), square, trailing(window), window))
    rows = returns.withColumn("scale", F.when(spread > 0, target / 12**0.5 / spread))
    return month_end_rows(rows).select("symbol", "session", "scale")


def outcomes_by_state(monthly: DataFrame, window: int = 12, need: int = 36) -> DataFrame:
    """Per symbol and state of (symbol, session, ret), one row a month: outcomes under expanding thirds of the volatility known a month before."""
    vol = full(F.stddev_samp("ret"), "ret", trailing(window), window) * 12**0.5
    rows = monthly.withColumn("vol", vol).withColumn("vol", F.round(F.lag("vol").over(by_symbol()), 9))
    labelled = terciles(rows, "vol", history=None, need=need).filter("state IS NOT NULL")
    labelled = labelled.withColumn("__all", F.count(F.lit(1)).over(Window.partitionBy("symbol")))
    return labelled.groupBy("symbol", "state").agg(
        F.count("ret").alias("months"), (F.count("ret") / F.first("__all")).alias("share"), F.avg("ret").alias("mean"), F.percentile("ret", 0.5).alias("median"), F.stddev_samp("ret").alias("vol"),
        F.avg((F.col("ret") > 0).cast("double")).alias("positive"), F.min("ret").alias("worst"), F.min("session").alias("first"), F.max("session").alias("last"),
    )


# Markov switching ------------------------------------------------------------

FIT = "series string, status string, observations int, means array<double>, variances array<double>, transition array<array<double>>, initial array<double>, log_likelihood double, iterations int"


def log_likelihoods(y: np.ndarray, means: np.ndarray, variances: np.ndarray) -> np.ndarray:
    """Normal log densities (time, fit, state) of the values under every fit's states."""
    return -0.5 * (np.log(2 * np.pi * variances) + (y[:, None, None] - means) ** 2 / variances)


def log_filter(seen: np.ndarray, start: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Log of the joint mass of the values so far and the state, (time, fit, state); all in logs, so nothing underflows."""
    mass = np.empty_like(seen)
    mass[0] = start + seen[0]
    for t in range(1, len(seen)):
        mass[t] = np.logaddexp.reduce(mass[t - 1][:, :, None] + moves, axis=1) + seen[t]
    return mass


def _log_ahead(seen: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Log of the mass of later values given the state."""
    mass = np.zeros_like(seen)
    for t in range(len(seen) - 1, 0, -1):
        mass[t - 1] = np.logaddexp.reduce(moves + (seen[t] + mass[t])[:, None, :], axis=2)
    return mass


def expectation_maximisation(y, means, variances, iterations: int, tolerance: float, floor: float):
    """Normal mixtures with a Markov state, from many starts (fit, state); returns parameters, log-likelihoods and each fit's own number of steps.

    Baum-Welch in logs on standardised values.  A step needs three expected
    sums for each state (its weight, its values, their squares) and the expected
    moves; a fit whose likelihood gains less than the tolerance leaves the batch.
    """
    y = np.asarray(y, dtype=float)
    centre, unit = y.mean(), max(float(y.std()), 1e-300)
    z = (y - centre) / unit
    mu, var, least = (means - centre) / unit, variances / unit**2, floor / unit**2
    fits, states = mu.shape
    stay = np.eye(states, dtype=bool)
    moves = np.log(np.broadcast_to(np.where(stay, 0.9, 0.1 / max(states - 1, 1)), (fits, states, states)).copy())
    start = np.full((fits, states), -np.log(states))
    likelihood, steps = np.full(fits, -np.inf), np.zeros(fits, int)
    live = np.arange(fits)
    powers = np.stack([np.ones_like(z), z, z * z])
    for _ in range(iterations):
        seen = log_likelihoods(z, mu[live], var[live])
        so_far, ahead = log_filter(seen, start[live], moves[live]), _log_ahead(seen, moves[live])
        total = np.logaddexp.reduce(so_far[-1], axis=1)
        weight = np.exp(so_far + ahead - total[:, None])
        between = so_far[:-1, :, :, None] + moves[live] + (seen[1:] + ahead[1:])[:, :, None, :] - total[:, None, None]
        moved = np.exp(between).sum(axis=0)
        n, s, q = np.einsum("kt,tfs->kfs", powers, weight)
        n = np.maximum(n, np.finfo(float).tiny)
        mu[live], var[live] = s / n, np.maximum(q / n - (s / n) ** 2, least)
        with np.errstate(divide="ignore"):
            start[live] = np.log(weight[0])
            moves[live] = np.log(moved / np.maximum(moved.sum(axis=2, keepdims=True), np.finfo(float).tiny))
        gained = total - likelihood[live]
        likelihood[live] = total
        steps[live] += 1
        live = live[~(np.abs(gained) < tolerance)]
        if not len(live):
            break
    return mu * unit + centre, var * unit**2, np.exp(moves), np.exp(start), likelihood - len(y) * np.log(unit), steps


def fit_switching(observations: DataFrame, states: int = 2, restarts: int = 20, iterations: int = 500, tolerance: float = 1e-8, floor: float = 1e-12, seed: int = 7) -> DataFrame:
    """One row of parameters per series of (series, session, value), states in order of their means; NOT_ESTIMABLE with under 20 values a state or no spread.

    Cut the observations at the end of the fit window first: a fit on rows that
    the states are read on would look ahead.  A series is one task; its
    restarts run together.
    """

    def fit(pdf):
        name, y = pdf["series"].iloc[0], pdf.sort_values("session")["value"].dropna().to_numpy(float)
        if len(y) < 20 * states or y.std(ddof=1) <= 0:
            return pd.DataFrame([[name, "NOT_ESTIMABLE", len(y), None, None, None, None, None, None]], columns=names)
        rng = np.random.default_rng([seed, zlib.crc32(str(name).encode())])
        part = np.digitize(y, np.quantile(y, np.linspace(0, 1, states + 1)[1:-1]))
        base = np.array([y[part == k].mean() if (part == k).any() else y.mean() for k in range(states)])
        spread = max(y.var(ddof=1), floor)
        means = base + np.vstack([np.zeros(states), rng.normal(0, spread**0.5, (restarts - 1, states))])
        variances = np.maximum(spread * np.exp(np.vstack([np.zeros(states), rng.normal(0, 0.5, (restarts - 1, states))])), floor)
        means, variances, transition, initial, likelihood, steps = expectation_maximisation(y, means, variances, iterations, tolerance, floor)
        best = int(np.argmax(np.where(np.isfinite(likelihood), likelihood, -np.inf)))
        order = np.argsort(means[best])
        moves = transition[best][np.ix_(order, order)]
        row = [name, "ESTIMATED", len(y), means[best][order].tolist(), variances[best][order].tolist(), (moves / moves.sum(axis=1, keepdims=True)).tolist(), initial[best][order].tolist(), float(likelihood[best]), int(steps[best])]
        return pd.DataFrame([row], columns=names)

    names = [part.split()[0] for part in FIT.split(", ")]
    return observations.select("series", "session", "value").groupBy("series").applyInPandas(fit, FIT)


def filtered_states(observations: DataFrame, fits: DataFrame) -> DataFrame:
    """(series, session, probabilities, state): probabilities of the states given the values so far, by frozen parameters; null without a fit."""

    def run(rows, fit):
        rows = rows.sort_values("session")
        if fit.empty or fit["status"].iloc[0] != "ESTIMATED" or rows.empty:
            return rows[["series", "session"]].assign(probabilities=None, state=None)
        one = fit.iloc[0]
        means, variances, initial = (np.asarray(one[c], dtype=float)[None] for c in ("means", "variances", "initial"))
        transition = np.vstack(list(one["transition"])).astype(float)[None]
        with np.errstate(divide="ignore"):
            mass = log_filter(log_likelihoods(rows["value"].to_numpy(float), means, variances), np.log(initial), np.log(transition))[:, 0]
        share = np.exp(mass - np.logaddexp.reduce(mass, axis=1)[:, None])
        return rows[["series", "session"]].assign(probabilities=list(share), state=share.argmax(axis=1))

    kind = dict(observations.dtypes)["session"]
    seen = observations.filter("value IS NOT NULL").groupBy("series")
    return seen.cogroup(fits.groupBy("series")).applyInPandas(run, f"series string, session {kind}, probabilities array<double>, state int")
