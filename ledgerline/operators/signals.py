"""Signals and sizing over (symbol, session): basis momentum, MACD, shocks, forecasts, targets and no-trade bands.

Recursive averages have no built-in form; each symbol's path is folded in a
grouped map, so a path (one row a session) is the unit of work.  Everything
else is windows on the same partitioning by symbol.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.panel import by_symbol
from ledgerline.operators.rolling import full, trailing


@dataclass(frozen=True)
class Ewm:
    """An exponentially weighted mean, or bias-corrected deviation, of ``field``.

    With ``adjust`` the weights of the rows so far are scaled to one; without,
    the first row starts the recursion.  Null until ``need`` values.
    """

    field: str
    out: str
    alpha: float
    need: int = 1
    deviation: bool = False
    adjust: bool = False


def span(n: int) -> float:
    return 2.0 / (n + 1.0)


def ewm(panel: DataFrame, *averages: Ewm) -> DataFrame:
    """The panel with one column for each average, all in one pass by symbol."""

    def fold(pdf):
        pdf = pdf.sort_values("session")
        for a in averages:
            run = pdf[a.field].astype("float64").ewm(alpha=a.alpha, adjust=a.adjust, min_periods=a.need)
            pdf[a.out] = run.std() if a.deviation else run.mean()
        return pdf

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in panel.schema)
    return panel.groupBy("symbol").applyInPandas(fold, ", ".join([kept, *(f"`{a.out}` double" for a in averages)]))


def _change(field: str) -> Column:
    return F.col(field) - F.lag(field).over(by_symbol())


def _clip(value: Column, low: float, high: float) -> Column:
    """Null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def _nonzero(value: Column) -> Column:
    return F.when(value != 0, value)


def changes(panel: DataFrame) -> DataFrame:
    """Adds ``change``, the close less the close before."""
    return panel.withColumn("change", _change("close"))


def basis_momentum(panel: DataFrame, vol_span: int = 60, cap: float = 2.0, roll_window: int = 252, lookback: int = 252, normalization: int = 252) -> DataFrame:
    """Adds ``basis``: change of the trailing roll yield of (close adjusted, raw), by volatility and by its own deviation, in [-1, 1]."""
    rows = ewm(changes(panel), Ewm("change", "__vol", span(vol_span), vol_span, deviation=True))
    rows = rows.withColumn("__gap", _change("raw") - F.col("change"))
    rows = rows.withColumn("__roll", -full(F.sum("__gap"), "__gap", trailing(roll_window), roll_window))
    rows = rows.withColumn("__raw", (F.col("__roll") - F.lag("__roll", lookback).over(by_symbol())) / (_nonzero(F.col("__vol")) * 252**0.5))
    scale = _nonzero(full(F.stddev_samp("__raw"), "__raw", trailing(normalization), normalization))
    return rows.withColumn("basis", _clip(F.col("__raw") / scale, -cap, cap) / cap).drop("change", "__vol", "__gap", "__roll", "__raw")


def blend_signals(trend: Column, basis: Column, weight: float = 0.5) -> Column:
    """trend and basis by weight, in [-1, 1]; trend alone where basis is null, null where trend is."""
    return _clip(trend * (1 - weight) + F.coalesce(basis, trend) * weight, -1.0, 1.0)


def shock_multiplier(panel: DataFrame, fast: int = 20, slow: int = 120, start: float = 1.35, end: float = 2.0, floor: float = 0.75) -> DataFrame:
    """Adds ``shock``: 1 while fast volatility is below ``start`` times the slow one, falling to ``floor`` at ``end`` times."""
    rows = ewm(changes(panel), Ewm("change", "__fast", span(fast), fast, deviation=True), Ewm("change", "__slow", span(slow), slow, deviation=True))
    progress = _clip((F.col("__fast") / _nonzero(F.col("__slow")) - start) / (end - start), 0.0, 1.0)
    return rows.withColumn("shock", 1 - progress * (1 - floor)).drop("change", "__fast", "__slow")


def risk_managed_forecast(panel: DataFrame, vol_span: int = 60, window: int = 63, cap: float = 2.0) -> DataFrame:
    """Adds ``managed``: forecast by the root mean square of its own result of the last ``window`` rows, at most ``cap`` times, in [-1, 1].

    With a column ``open``, the forecast of the row before earns the move from
    open to close and the older one the move before it; without, or where open
    is null, the older one earns all.
    """
    rows = ewm(changes(panel), Ewm("change", "__vol", span(vol_span), vol_span, deviation=True))
    lag = lambda c, n: F.lag(c, n).over(by_symbol())
    rows = rows.withColumn("__held", F.try_divide(lag("forecast", 2), lag("__vol", 2))).withColumn("__new", F.try_divide(lag("forecast", 1), lag("__vol", 1)))
    result = F.col("__held") * F.col("change")
    if "open" in panel.columns:
        split = F.col("__held") * (F.col("open") - lag("close", 1)) + F.col("__new") * (F.col("close") - F.col("open"))
        result = F.when(F.col("open").isNotNull(), split).otherwise(result)
    rows = rows.withColumn("__result", result)
    rows = rows.withColumn("__square", F.col("__result") * F.col("__result"))
    own = F.sqrt(full(F.avg("__square"), "__square", trailing(window), window))
    weight = F.when(own > 0, F.least(F.lit(cap), 1 / own))
    return rows.withColumn("managed", _clip(F.col("forecast") * weight, -1.0, 1.0)).drop("change", "__vol", "__held", "__new", "__result", "__square")


def macd_signal(panel: DataFrame, scales: tuple[tuple[int, int], ...] = ((8, 24), (16, 48), (32, 96)), price_window: int = 63, signal_window: int = 252, warm_up: int = 350, norm: float = 0.89) -> DataFrame:
    """Adds ``macd``: mean over the scales of y exp(-y^2 / 4) / norm, y the twice normalised gap of two averages with alpha 1/n."""
    rows = ewm(panel, *(Ewm("close", f"__m{n}", 1.0 / n) for n in sorted({n for pair in scales for n in pair})))
    spread = _nonzero(full(F.stddev_samp("close"), "close", trailing(price_window), price_window))
    rows = rows.withColumns({f"__q{k}": (F.col(f"__m{a}") - F.col(f"__m{b}")) / spread for k, (a, b) in enumerate(scales)})
    y = [F.col(f"__q{k}") / _nonzero(full(F.stddev_samp(f"__q{k}"), f"__q{k}", trailing(signal_window), signal_window)) for k in range(len(scales))]
    rows = rows.withColumns({f"__y{k}": v for k, v in enumerate(y)})
    mean = sum((F.col(f"__y{k}") * F.exp(-F.col(f"__y{k}") * F.col(f"__y{k}") / 4) / norm for k in range(len(scales))), F.lit(0.0)) / len(scales)
    warm = (F.count("close").over(trailing(warm_up)) >= warm_up) & F.col("close").isNotNull()
    return rows.withColumn("macd", F.when(warm, mean)).select(*panel.columns, "macd")


def target_positions(panel: DataFrame, target: float = 0.07, vol_span: int = 60, periods: int = 252, group: str | None = None, groups: int = 1) -> DataFrame:
    """Adds ``position`` of (forecast, close, point_value): each live symbol of a session gets target x sqrt(1 / groups / live) of risk.

    Live: a forecast and a positive volatility.  ``group`` counts the live ones by class.
    """
    rows = ewm(changes(panel), Ewm("change", "__vol", span(vol_span), vol_span, deviation=True))
    dollars = F.col("__vol") * F.col("point_value") * periods**0.5
    live = F.col("forecast").isNotNull() & (dollars > 0)
    of = Window.partitionBy("session", group) if group else Window.partitionBy("session")
    budget = target * F.sqrt(F.lit(1.0 / groups) / F.sum(F.when(live, 1).otherwise(0)).over(of))
    return rows.withColumn("position", F.when(live, F.col("forecast") * budget / dollars)).drop("change", "__vol")


def portfolio_scalar(returns: DataFrame, target: float = 0.07, decay: float = 0.94, need: int = 20, low: float = 0.25, high: float = 2.0, periods: int = 252) -> DataFrame:
    """Adds ``scalar``: target over exponentially weighted volatility of (symbol, session, ret), clipped; 1 while that is unknown or 0."""
    rows = ewm(returns, Ewm("ret", "__vol", 1 - decay, need, deviation=True, adjust=True))
    ratio = _clip(target / _nonzero(F.col("__vol") * periods**0.5), low, high)
    return rows.withColumn("scalar", F.coalesce(ratio, F.lit(1.0))).drop("__vol")


def buffer_widths(panel: DataFrame, mean_width: float = 0.25, low: float = 0.05, high: float = 0.6, vol_span: int = 60) -> DataFrame:
    """Per symbol of (close, point_value, one_way_cost): median round-trip cost per unit of risk, scaled to the mean width and clipped.

    A symbol without a known ratio gets the mean width.
    """
    rows = ewm(changes(panel), Ewm("change", "__vol", span(vol_span), vol_span, deviation=True))
    ratio = F.try_divide(2 * F.col("one_way_cost"), F.col("__vol") * F.col("point_value"))
    typical = rows.groupBy("symbol").agg(F.percentile(ratio, 0.5).alias("typical"))
    # One row a symbol: the mean over all symbols is joined back from a single row.
    mean = typical.agg(F.avg("typical").alias("__mean"))
    width = F.coalesce(F.try_divide(F.col("typical") * mean_width, F.col("__mean")), F.lit(mean_width))
    return typical.join(F.broadcast(mean)).select("symbol", "typical", _clip(width, low, high).alias("width"))


def no_trade_buffer(decisions: DataFrame, width: float = 0.25) -> DataFrame:
    """Adds ``held`` to (symbol, session, target): the target held before stays unless the change exceeds width x the larger of the two.

    A null target counts as 0.  Each decision depends on the one before, so a
    symbol's decisions (a row a month) are folded together.
    """

    def fold(pdf):
        pdf = pdf.sort_values("session")
        held, out = 0.0, []
        for target in pdf["target"].fillna(0.0):
            if abs(target - held) > width * max(abs(target), abs(held)):
                held = target
            out.append(held)
        return pdf.assign(held=out)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in decisions.schema)
    return decisions.groupBy("symbol").applyInPandas(fold, f"{kept}, held double")
