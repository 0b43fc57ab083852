"""Execution costs, reconciliations, coverage audits and event-log checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fill_costs(fills: DataFrame) -> DataFrame:
    """Per fill: arrival mid, signed shortfall, half spread, residual, basis points, latency and participation bucket (right-closed)."""
    sign = F.when(F.col("side") == "BUY", 1.0).otherwise(-1.0)
    out = fills.withColumn("mid", (F.col("bid") + F.col("ask")) / 2).withColumn("half_spread", (F.col("ask") - F.col("bid")) / 2)
    out = out.withColumn("shortfall", sign * (F.col("price") - F.col("mid"))).withColumn("residual", F.col("shortfall") - F.col("half_spread"))
    out = out.withColumn("residual_bps", F.try_divide(F.col("residual"), F.col("mid")) * 10000).withColumn("latency_days", F.datediff("filled", "arrival"))
    share = F.try_divide(F.col("quantity"), F.col("interval_volume"))
    bucket = F.when(share <= 0.005, "0-0.5%").when(share <= 0.01, "0.5-1%").when(share <= 0.02, "1-2%").when(share <= 0.05, "2-5%").otherwise(">5%")
    return out.withColumn("participation", share).withColumn("bucket", bucket)


def order_costs(costs: DataFrame) -> DataFrame:
    """One row per order: quantity, quantity-weighted shortfall, fees, largest interval volume and latency."""
    return costs.groupBy("order_id").agg(F.sum("quantity").alias("quantity"), F.try_divide(F.sum(F.col("quantity") * F.col("shortfall")), F.sum("quantity")).alias("shortfall"), F.sum("fees").alias("fees"), F.max("interval_volume").alias("interval_volume"), F.max("latency_days").alias("latency_days"), F.count(F.lit(1)).alias("fills"))


def exact_quantiles(df: DataFrame, group: str, value: str, shares: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """Interpolated quantiles of ``value`` by ``group``: one column for each named share.

    A mergeable sketch brackets each quantile, a second pass counts what lies
    below the bracket, and only the values inside are sorted: some ten in
    ``accuracy`` rows of a group and share, so a group is no single task.  The
    brackets, a row for each group, go to all tasks, and the rows stay where they are.
    """
    rows = df.select(group, F.col(value).cast("double").alias("__v")).filter("__v IS NOT NULL")
    wide = 4 / accuracy
    edges = [e for q in shares.values() for e in (max(q - wide, 0.0), min(q + wide, 1.0))]
    marks = rows.groupBy(group).agg(F.percentile_approx("__v", edges, accuracy).alias("__m"), F.count(F.lit(1)).alias("__n"))
    # A group that is smaller than the sketch is sorted whole.
    small, infinite = F.col("__n") <= accuracy, float("inf")
    low = lambda i: F.when(small, -infinite).otherwise(F.get("__m", F.lit(2 * i)))
    high = lambda i: F.when(small, infinite).otherwise(F.get("__m", F.lit(2 * i + 1)))
    seen, many = rows.join(F.broadcast(marks), group), range(len(shares))
    below = seen.groupBy(group).agg(F.array(*(F.count_if(F.col("__v") < low(i)) for i in many)).alias("__b"))
    tagged = F.array_compact(F.array(*(F.when((F.col("__v") >= low(i)) & (F.col("__v") <= high(i)), F.lit(i)) for i in many)))
    inside = seen.select(group, "__v", "__n", F.explode(tagged).alias("__i"))
    inside = inside.withColumn("__k", F.row_number().over(Window.partitionBy(group, "__i").orderBy("__v")) - 1).join(F.broadcast(below), group)
    place = (F.col("__n") - 1) * F.get(F.array(*map(F.lit, shares.values())), F.col("__i"))
    at = lambda rank: F.max(F.when(F.col("__k") + F.get("__b", F.col("__i")) == rank, F.col("__v")))
    first, second, part = at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))
    picks = inside.groupBy(group, "__i").agg((first + (second - first) * part).alias("__q"))
    return picks.groupBy(group).agg(*(F.max(F.when(F.col("__i") == i, F.col("__q"))).alias(name) for i, name in enumerate(shares)))


def _distinct(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """Different values by group, counted after they are told apart, so that a group is spread over its values."""
    return df.select(group, value).distinct().groupBy(group).agg(F.count(value).alias(name))


def cost_calibration(costs: DataFrame) -> DataFrame:
    """Per root: counts, coverage and quantiles; impact is the upper quartile of residual bps over the root of participation, at least 0."""
    costs = costs.withColumn("__impact", F.try_divide(F.col("residual_bps"), F.sqrt("participation")))
    out = costs.groupBy("root").agg(F.count(F.lit(1)).alias("fills"))
    for value, name in (("order_id", "orders"), ("filled", "sessions"), ("bucket", "buckets")):
        out = out.join(_distinct(costs, "root", value, name), "root")
    out = out.join(exact_quantiles(costs, "root", "shortfall", {"p50": 0.5, "p75": 0.75, "p95": 0.95}), "root", "left")
    impact = exact_quantiles(costs, "root", "__impact", {"impact": 0.75})
    return out.join(impact, "root", "left").withColumn("impact", F.greatest(F.lit(0.0), F.col("impact")))


def reconcile(internal: DataFrame, external: DataFrame, key: str, amount: str, tolerance: float) -> DataFrame:
    """Full-outer comparison of two position tables; a missing side counts as 0."""
    a, b = internal.select(key, F.col(amount).alias("internal")), external.select(key, F.col(amount).alias("external"))
    joined = a.join(b, key, "full_outer").select(key, F.coalesce("internal", F.lit(0.0)).alias("internal"), F.coalesce("external", F.lit(0.0)).alias("external"))
    gap = F.abs(F.col("internal") - F.col("external"))
    return joined.withColumn("status", F.when(gap <= tolerance, "PASS").otherwise("BREAK"))


def coverage_gaps(panel: DataFrame) -> DataFrame:
    """Per symbol: life, sessions, sessions of the union calendar missing inside its life, and the longest run of them."""
    life = panel.groupBy("symbol").agg(F.min("session").alias("first"), F.max("session").alias("last"), F.count(F.lit(1)).alias("sessions"))
    calendar = panel.select("session").distinct()
    # Lives are split into calendar years, so that the range join has an equality to be dealt by.
    yearly = life.select("symbol", "first", "last", F.explode(F.sequence(F.year("first"), F.year("last"))).alias("__year"))
    due = yearly.join(calendar.withColumn("__year", F.year("session")), "__year").filter("session BETWEEN first AND last").select("symbol", "session")
    marks = due.join(panel.select("symbol", "session", F.lit(1).alias("there")), ["symbol", "session"], "left")
    by = Window.partitionBy("symbol").orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    runs = marks.withColumn("__run", F.sum(F.coalesce("there", F.lit(0))).over(by)).filter("there IS NULL").groupBy("symbol", "__run").count()
    gaps = runs.groupBy("symbol").agg(F.sum("count").alias("missing"), F.max("count").alias("longest_gap"))
    return life.join(gaps, "symbol", "left").na.fill(0, ["missing", "longest_gap"])


def peak_concurrency(intervals: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """Most intervals open at once per group; on one day starts count before ends."""
    marks = intervals.select(group, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(0).alias("kind"), F.lit(1).alias("step")), F.struct(F.col(end).alias("at"), F.lit(1).alias("kind"), F.lit(-1).alias("step")))).alias("m")).select(group, "m.*")
    daily = marks.groupBy(group, "at", "kind").agg(F.sum("step").alias("step"))
    level = F.sum("step").over(Window.partitionBy(group).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    return daily.withColumn("level", level).groupBy(group).agg(F.max("level").alias("peak"))


#: Events that may follow each event of an order; the first must be OUTBOX.
NEXT = {"OUTBOX": ["ACK", "REJECT"], "ACK": ["FILL", "REJECT", "ACK"], "FILL": ["FILL", "ACK"], "REJECT": ["OUTBOX"]}


def replay_orders(events: DataFrame, key: str | list[str] = "key", order: tuple[str, ...] = ("ts", "event_id"), figures: tuple[Column, ...] = ()) -> DataFrame:
    """Per key: events, illegal transitions, repeated ids, fills and last state, from (key, event_id, event, ts), and further ``figures`` of its events."""
    keys = [key] if isinstance(key, str) else key
    by = Window.partitionBy(*keys).orderBy(*order)
    before = F.lag("event").over(by)
    legal = F.when(before.isNull(), F.col("event") == "OUTBOX")
    for state, following in NEXT.items():
        legal = legal.when(before == state, F.col("event").isin(following))
    rows = events.withColumn("__ok", F.coalesce(legal, F.lit(False))).withColumn("__seen", F.row_number().over(Window.partitionBy(*keys, "event_id").orderBy(*order)))
    last = F.max_by("event", F.struct(*order))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("events"), F.sum(F.when(F.col("__ok"), 0).otherwise(1)).alias("illegal"), F.sum(F.when(F.col("__seen") > 1, 1).otherwise(0)).alias("repeated"), F.sum(F.when(F.col("event") == "FILL", 1).otherwise(0)).alias("fills"), last.alias("state"), *figures)


def chain_audit(entries: DataFrame, journal: str = "journal", order: tuple[str, ...] = ("sequence",)) -> DataFrame:
    """Per journal of (sequence, ts, previous_hash, record_hash): breaks of sequence, hash links and time, repeated sequences."""
    by = Window.partitionBy(journal).orderBy(*order)
    lag = lambda c: F.lag(c).over(by)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    rows = entries.select(journal, "sequence", "ts", "previous_hash", "record_hash", lag("sequence").alias("s0"), lag("record_hash").alias("h0"), lag("ts").alias("t0"))
    return rows.groupBy(journal).agg(F.count(F.lit(1)).alias("entries"), count(F.col("s0").isNotNull() & (F.col("sequence") != F.col("s0") + 1)).alias("sequence_breaks"), count(F.col("h0").isNotNull() & (F.col("previous_hash") != F.col("h0"))).alias("hash_breaks"), count(F.col("ts") < F.col("t0")).alias("time_breaks"))


def monitoring(heartbeats: DataFrame, required: list[str], as_of: str, limit_seconds: int, component: str = "component") -> DataFrame:
    """Age of each required component's last heartbeat against the limit; a missing one is blocked."""
    wanted = heartbeats.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, required))).alias(component))
    last = heartbeats.groupBy(component).agg(F.max("ts").alias("last"))
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("last")
    joined = wanted.join(last, component, "left").withColumn("age_seconds", age)
    return joined.withColumn("status", F.when((age >= 0) & (age <= limit_seconds), "PASS").otherwise("BLOCKED"))


def continuity(canonical: DataFrame, extension: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """One row per root of the extension: shared_sessions, largest_difference, status and detail, from two frames of (root, session, value).

    PASS if both agree within the tolerance where they overlap; BLOCKED if they
    differ, share no session with values, or the root is unknown.
    """
    known = canonical.select("root").distinct().withColumn("__known", F.lit(True))
    joined = extension.select("root", "session", F.col("value").alias("__e")).join(canonical.select("root", "session", F.col("value").alias("__c")), ["root", "session"]).dropna()
    gaps = joined.groupBy("root").agg(F.count(F.lit(1)).alias("shared_sessions"), F.max(F.abs(F.col("__c") - F.col("__e"))).alias("largest_difference"))
    out = extension.select("root").distinct().join(known, "root", "left").join(gaps, "root", "left")
    detail = F.when(F.col("__known").isNull(), "the root is not in the canonical history").when(F.col("shared_sessions").isNull(), "no shared sessions").when(F.col("largest_difference") > tolerance, "the series was anchored anew").otherwise("continues the canonical series")
    status = F.when(F.col("largest_difference") <= tolerance, "PASS").otherwise("BLOCKED")
    return out.select("root", F.coalesce("shared_sessions", F.lit(0)).alias("shared_sessions"), "largest_difference", status.alias("status"), detail.alias("detail"))
