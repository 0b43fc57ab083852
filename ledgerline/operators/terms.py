"""Contract terms, exchange rates and their use: catalogues with violations as rows, values in dollars, decision frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.allocation import scaled_to_volatility
from ledgerline.operators.panel import by_symbol, month_end_rows


def without(symbols: DataFrame, excluded: DataFrame) -> DataFrame:
    """The symbols that are not excluded."""
    return symbols.join(excluded.select("symbol"), "symbol", "left_anti")


def contract_terms(catalogue: DataFrame, wanted: DataFrame, currencies: list[str], mark: str = "&", suffix: str = "_CCB") -> tuple[DataFrame, DataFrame]:
    """(terms, violations) of a catalogue (symbol, currency, tick_size, point_value, margin) for the wanted symbols.

    Only symbols that end in the suffix count; mark and suffix are taken off.
    Violations are (symbol, reason): repeated, missing, a currency without a
    rate, a term that is not a positive number.  Terms hold the symbols without
    one.
    """
    clean = F.regexp_replace(F.regexp_replace("symbol", f"^{mark}", ""), f"{suffix}$", "")
    rows = catalogue.filter(F.col("symbol").endswith(suffix)).withColumn("symbol", clean).join(wanted.select("symbol").distinct(), "symbol", "left_semi")
    fields = ("tick_size", "point_value", "margin")
    rows = rows.select("symbol", "currency", *(F.col(f).try_cast("double").alias(f) for f in fields))
    good = lambda f: F.coalesce((F.col(f) > 0) & (F.col(f) < float("inf")), F.lit(False))
    reason = lambda df, text: df.select("symbol", F.lit(text).alias("reason"))
    wrong = reason(rows.groupBy("symbol").count().filter("count > 1"), "repeated")
    wrong = wrong.unionByName(reason(wanted.select("symbol").distinct().join(rows, "symbol", "left_anti"), "missing"))
    wrong = wrong.unionByName(reason(rows.filter(~F.coalesce(F.col("currency").isin(["USD", *currencies]), F.lit(False))), "no rate for its currency"))
    wrong = wrong.unionByName(reason(rows.filter(~(good("tick_size") & good("point_value") & good("margin"))), "a term is not positive")).distinct()
    return rows.join(wrong, "symbol", "left_anti"), wrong


def dollar_rates(quotes: DataFrame, calendar: DataFrame, scale: dict[str, float], bounds: dict[str, tuple[float, float]], limit: int = 10) -> DataFrame:
    """(currency, session, rate, plausible): quotes (currency, session, quote) times their scale on the calendar, filled forward at most ``limit`` rows; USD is 1.

    ``plausible`` is false on every row of a currency that was ever quoted
    outside its bounds.
    """
    pick = lambda values: F.coalesce(*(F.when(F.col("currency") == c, F.lit(float(v))) for c, v in values.items()))
    rates = quotes.filter(F.col("currency").isin(list(scale))).withColumn("rate", F.col("quote") * pick(scale))
    inside = (F.col("rate") > pick({c: b[0] for c, b in bounds.items()})) & (F.col("rate") < pick({c: b[1] for c, b in bounds.items()}))
    sound = rates.filter("rate IS NOT NULL").groupBy("currency").agg(F.min(inside.cast("int")).alias("__ok"))
    by = Window.partitionBy("currency").orderBy("session").rowsBetween(-limit, 0)
    grid = calendar.select("session").distinct().select("session", F.explode(F.array(*map(F.lit, scale))).alias("currency"))
    filled = grid.join(rates.select("currency", "session", "rate"), ["currency", "session"], "left").withColumn("rate", F.last("rate", True).over(by))
    filled = filled.join(sound, "currency", "left").select("currency", "session", "rate", F.coalesce(F.col("__ok") == 1, F.lit(False)).alias("plausible"))
    dollar = calendar.select("session").distinct().select(F.lit("USD").alias("currency"), "session", F.lit(1.0).alias("rate"), F.lit(True).alias("plausible"))
    return filled.unionByName(dollar)


def dollar_terms(terms: DataFrame, rates: DataFrame) -> DataFrame:
    """(symbol, session, point_value_usd, margin_usd); null where there is no rate."""
    both = terms.select("symbol", "currency", "point_value", "margin").join(rates.select("currency", "session", "rate"), "currency")
    return both.select("symbol", "session", (F.col("point_value") * F.col("rate")).alias("point_value_usd"), (F.col("margin") * F.col("rate")).alias("margin_usd"))


def spliced_rates(futures: DataFrame, spot: DataFrame, calendar: DataFrame, limit: int = 10) -> DataFrame:
    """(currency, session, rate, basis): futures rates up to their last one, then spot times the ratio of both on that day, filled forward.

    The ratio takes the last spot rate at or before the join.  A currency
    without one has no rate after the join.
    """
    join = futures.filter("rate IS NOT NULL").groupBy("currency").agg(F.max("session").alias("__join"), F.max_by("rate", "session").alias("__future"))
    known = spot.filter("rate IS NOT NULL").select("currency", "session", F.col("rate").alias("spot"))
    at = known.join(join, "currency").filter(F.col("session") <= F.col("__join")).groupBy("currency").agg(F.max_by("spot", "session").alias("__spot"))
    scale = join.join(at, "currency", "left").withColumn("basis", F.try_divide(F.col("__future"), F.nullif(F.col("__spot"), F.lit(0.0))))
    later = known.join(scale, "currency").filter(F.col("session") > F.col("__join")).select("currency", "session", (F.col("spot") * F.col("basis")).alias("rate"))
    rates = futures.filter("rate IS NOT NULL").select("currency", "session", "rate").unionByName(later.filter("rate IS NOT NULL"))
    grid = calendar.select("session").distinct().join(F.broadcast(scale.select("currency", "basis")))  # a row a currency
    by = Window.partitionBy("currency").orderBy("session").rowsBetween(-limit, 0)
    return grid.join(rates, ["currency", "session"], "left").withColumn("rate", F.last("rate", True).over(by)).select("currency", "session", "rate", "basis")


def financing_rates(settles: DataFrame, most: float = 0.2, span_years: float = 10.0, low: float = 0.03) -> tuple[DataFrame, DataFrame]:
    """((session, rate), one guard row) of settlement prices: rate = (100 - settle) / 100.

    The guard is BLOCKED with a price above 100, a rate above ``most``, or over
    ``span_years`` of prices that never imply less than ``low``, as those of a
    back-adjusted series do.
    """
    rates = settles.filter("settle IS NOT NULL").select("session", ((100 - F.col("settle")) / 100).alias("rate"))
    guard = rates.agg(F.count(F.lit(1)).alias("sessions"), F.min("rate").alias("lowest"), F.max("rate").alias("highest"), (F.datediff(F.max("session"), F.min("session")) / 365.2425).alias("years"))
    adjusted = (F.col("years") > span_years) & (F.col("lowest") >= low)
    bad = (F.col("sessions") == 0) | (F.col("lowest") < 0) | (F.col("highest") > most) | adjusted
    return rates, guard.withColumn("status", F.when(F.coalesce(bad, F.lit(True)), "BLOCKED").otherwise("PASS"))


def contracts_per_dollar(weight: Column, price: Column, point_value: Column) -> Column:
    """Contracts for a dollar of NAV; 0 where they cannot be valued."""
    return F.coalesce(F.try_divide(weight, F.nullif(F.abs(price * point_value), F.lit(0.0))), F.lit(0.0))


def decisions(panel: DataFrame, weight: str, price: str = "close", point_value: str = "point_value_usd") -> DataFrame:
    """(symbol, session, per_dollar) at month ends of a panel with weights, prices and point values."""
    return month_end_rows(panel).select("symbol", "session", contracts_per_dollar(F.col(weight), F.col(price), F.col(point_value)).alias("per_dollar"))


def blended_decisions(panel: DataFrame, blend: DataFrame, monthly: DataFrame) -> DataFrame:
    """(symbol, session, weight, per_dollar) at month ends: a ``blend`` (symbol, month, signal, vol) under one volatility target, in contracts; 0 where a symbol takes no part."""
    weights = scaled_to_volatility(blend.select("symbol", "month", "signal", "vol"), monthly).select("symbol", "month", "weight")
    ends = month_end_rows(panel).withColumn("month", F.trunc("session", "month")).join(weights, ["symbol", "month"], "left")
    weight = F.coalesce("weight", F.lit(0.0))
    return ends.select("symbol", "session", weight.alias("weight"), contracts_per_dollar(weight, F.col("close"), F.col("point_value_usd")).alias("per_dollar"))


def overlaid(decided: DataFrame, overlay: DataFrame) -> DataFrame:
    """Decisions times the overlay's (session, weight); 1 where it has none."""
    joined = decided.join(overlay.select("session", F.col("weight").alias("__w")), "session", "left")
    return joined.select("symbol", "session", (F.col("per_dollar") * F.coalesce("__w", F.lit(1.0))).alias("per_dollar"))


def weight_report(weights: DataFrame) -> DataFrame:
    """One row on an overlay (session, weight): decisions, first active one, least, 5, 50, 95 and 99 % and largest weight."""
    finite = F.when((F.abs("weight") < float("inf")), F.col("weight"))
    rows = weights.select("session", finite.alias("w")).filter("w IS NOT NULL")
    q = lambda p: F.percentile("w", p)
    return rows.agg(F.count(F.lit(1)).alias("decisions"), F.min(F.when(F.col("w") != 1, F.col("session"))).alias("first_active"), F.min("w").alias("least"), q(0.05).alias("p05"), q(0.5).alias("p50"), F.avg("w").alias("mean"), q(0.95).alias("p95"), q(0.99).alias("p99"), F.max("w").alias("most"))


def signal_report(signals: DataFrame) -> DataFrame:
    """One row on decisions (symbol, session, signal, reference, weight): live symbols a decision, mean and largest signal, agreement in sign with the reference, mean and largest gross weight."""
    live = F.col("signal").isNotNull() & (F.coalesce("weight", F.lit(0.0)) != 0)
    by_date = signals.groupBy("session").agg(F.count_if(live).alias("live"), F.sum(F.abs("weight")).alias("gross"), F.sum(F.when(live, F.abs("signal"))).alias("s"), F.max(F.when(live, F.abs("signal"))).alias("m"), F.sum(F.when(live & F.col("reference").isNotNull(), (F.signum("signal") == F.signum("reference")).cast("int"))).alias("agree"), F.count(F.when(live & F.col("reference").isNotNull(), 1)).alias("both"))
    return by_date.agg(
        F.count(F.lit(1)).alias("decisions"), F.avg("live").alias("live_symbols"), F.try_divide(F.sum("s"), F.sum("live")).alias("mean_signal"), F.max("m").alias("largest_signal"), F.try_divide(F.sum("agree"), F.sum("both")).alias("agreement"),
        F.avg(F.coalesce("gross", F.lit(0.0))).alias("mean_gross"), F.max(F.coalesce("gross", F.lit(0.0))).alias("largest_gross"),
    )


def adjusted_returns(panel: DataFrame) -> DataFrame:
    """Adds ``ret``: change of the adjusted ``close`` over the price that was traded the row before (``raw``)."""
    change = F.col("close") - F.lag("close").over(by_symbol())
    return panel.withColumn("ret", F.try_divide(change, F.nullif(F.abs(F.lag("raw").over(by_symbol())), F.lit(0.0))))
