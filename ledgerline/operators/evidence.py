"""Checks of evidence kept as tables: fills, accounts and collateral, journals, trial registries, sealed data, runtime health, contract snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _no(test: Column) -> Column:
    """Where the test is false or unknown."""
    return ~F.coalesce(test, F.lit(False))


def fill_violations(fills: DataFrame) -> DataFrame:
    """(fill_id, order_id, reason), a row for each rule that a fill breaks.

    Ids blank or repeated, filled before it arrived, a side other than BUY or
    SELL, a quantity that is not a whole number above 0 or exceeds the volume of
    its interval, a crossed quote, a price that is not positive, and orders
    with two sides or contracts.
    """
    same = Window.partitionBy("fill_id")
    rows = fills.withColumn("__times", F.count(F.lit(1)).over(same))
    orders = fills.groupBy("order_id").agg((F.count_distinct("side") > 1).alias("__sides"), (F.count_distinct("contract") > 1).alias("__contracts"))
    rows = rows.join(orders, "order_id", "left")
    q, volume = F.col("quantity"), F.col("interval_volume")
    rules = {
        "blank id": _no(F.length(F.trim("fill_id")) > 0) | _no(F.length(F.trim(F.col("order_id").cast("string"))) > 0),
        "repeated id": F.col("__times") > 1,
        "filled before it arrived": _no(F.col("filled") >= F.col("arrival")),
        "unknown side": _no(F.col("side").isin("BUY", "SELL")),
        "quantity is not whole": _no((q > 0) & (q == F.floor(q))),
        "above the interval's volume": _no(q <= volume),
        "crossed quote": _no((F.col("bid") > 0) & (F.col("bid") <= F.col("ask"))),
        "price is not positive": _no((F.col("price") > 0) & (F.col("price") < float("inf"))),
        "order of two sides": F.coalesce("__sides", F.lit(False)),
        "order of two contracts": F.coalesce("__contracts", F.lit(False)),
    }
    found = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in rules.items())))
    return rows.select("fill_id", "order_id", F.explode(found).alias("reason"))


def account_collateral(lots: DataFrame) -> DataFrame:
    """Per account of (account, grp, value, haircut, cap): market value, eligible value and status.

    The value after haircut of a concentration group counts up to its cap, that
    of lots without a group whole.  BLOCKED where a group has two caps or a value
    is negative.
    """
    rows = lots.withColumn("__after", F.col("value") * (1 - F.col("haircut")))
    groups = rows.groupBy("account", "grp").agg(F.sum("value").alias("market"), F.sum("__after").alias("__after"), F.min("cap").alias("__cap"), F.max("cap").alias("__high"), F.min("value").alias("__least"))
    counted = F.when(F.col("grp").isNull(), F.col("__after")).otherwise(F.least("__after", "__cap"))
    bad = (F.col("grp").isNotNull() & _no(F.col("__cap") == F.col("__high"))) | _no(F.col("__least") >= 0)
    out = groups.groupBy("account").agg(F.sum("market").alias("market"), F.sum(counted).alias("eligible"), F.count_if(F.col("grp").isNotNull() & (F.col("__after") > F.col("__cap"))).alias("capped_groups"), F.max(bad.cast("int")).alias("__bad"))
    return out.withColumn("status", F.when(F.col("__bad") == 0, "PASS").otherwise("BLOCKED")).drop("__bad")


def journal_balance(postings: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Per entry of (entry, currency, side, amount, fx): currencies, those whose debits differ from their credits, the difference in base currency, and status."""
    signed = F.when(F.col("side") == "DEBIT", F.col("amount")).when(F.col("side") == "CREDIT", -F.col("amount"))
    by = postings.groupBy("entry", "currency").agg(F.sum(signed).alias("gap"), F.sum(signed * F.col("fx")).alias("base"), F.count_if(signed.isNull()).alias("__bad"))
    out = by.groupBy("entry").agg(F.count(F.lit(1)).alias("currencies"), F.count_if(F.abs("gap") > tolerance).alias("unbalanced"), F.sum("base").alias("base_gap"), F.sum("__bad").alias("__bad"))
    return out.withColumn("status", F.when((F.col("unbalanced") == 0) & (F.abs("base_gap") <= tolerance) & (F.col("__bad") == 0), "PASS").otherwise("BLOCKED")).drop("__bad")


def treasury_gates(accounts: DataFrame, as_of: str, limit_seconds: int, tolerance: float = 0.01) -> DataFrame:
    """(account, gate, status) of account rows (account, seen, cash, collateral, receivable, payable, fees, other, equity, initial, maintenance, available).

    Fresh within the limit and not from the future; equity equals its parts;
    initial margin at least the maintenance margin; available funds equal equity
    less initial margin; no negative receivable, payable or fee.
    """
    c = F.col
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("seen")
    parts = c("cash") + c("collateral") + c("receivable") - c("payable") - c("fees") + c("other")
    gates = {
        "fresh": (age >= 0) & (age <= limit_seconds),
        "equity_roll_forward": F.abs(parts - c("equity")) <= tolerance,
        "margins_ordered": (c("initial") >= c("maintenance")) & (c("maintenance") >= 0),
        "available_funds": F.abs(c("equity") - c("initial") - c("available")) <= tolerance,
        "not_negative": (c("receivable") >= 0) & (c("payable") >= 0) & (c("fees") >= 0),
    }
    rows = F.array(*(F.struct(F.lit(g).alias("gate"), F.when(F.coalesce(t, F.lit(False)), "PASS").otherwise("BLOCKED").alias("status")) for g, t in gates.items()))
    return accounts.select("account", F.explode(rows).alias("g")).select("account", "g.*")


def registry_audit(events: DataFrame, budget: int = 3) -> DataFrame:
    """Per batch of (batch, candidate, kind, sequence, seen): candidates, registrations repeated, candidates beyond the budget, results, results before their registration or repeated, backdated events, status.

    ``kind`` is REGISTER or RESULT; the sequence numbers a batch's events.
    """
    own = Window.partitionBy("batch", "candidate")
    order = Window.partitionBy("batch").orderBy("sequence")
    register, result = F.col("kind") == "REGISTER", F.col("kind") == "RESULT"
    rows = events.withColumn("__first", F.min(F.when(register, F.col("sequence"))).over(own)).withColumn("__result", F.min(F.when(result, F.col("sequence"))).over(own)).withColumn("__before", F.lag("seen").over(order))
    count = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    out = rows.groupBy("batch").agg(
        count(register & (F.col("sequence") == F.col("__first"))).alias("candidates"), count(register & (F.col("sequence") > F.col("__first"))).alias("registered_twice"), count(result).alias("results"),
        count(result & (F.col("__first").isNull() | (F.col("sequence") < F.col("__first")))).alias("results_too_early"), count(result & (F.col("sequence") > F.col("__result"))).alias("second_results"), count(F.col("seen") < F.col("__before")).alias("backdated"),
    )
    out = out.withColumn("over_budget", F.greatest(F.col("candidates") - budget, F.lit(0)))
    bad = sum((F.col(c) for c in ("registered_twice", "results_too_early", "second_results", "backdated", "over_budget")), F.lit(0))
    return out.withColumn("status", F.when(bad == 0, "PASS").otherwise("BLOCKED"))


def holdout_audit(events: DataFrame) -> DataFrame:
    """Per dataset of (dataset, kind, sequence, seal): registrations, looks, looks before the registration or under another seal, and status: each dataset is registered once, then looked at once at most."""
    own = Window.partitionBy("dataset")
    register = F.col("kind") == "REGISTER"
    first = F.min(F.when(register, F.struct("sequence", "seal"))).over(own)
    rows = events.withColumn("__r", first)
    look = F.col("kind") == "CONSUME"
    count = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    out = rows.groupBy("dataset").agg(count(register).alias("registrations"), count(look).alias("looks"), count(look & (F.col("__r").isNull() | (F.col("sequence") < F.col("__r.sequence")))).alias("too_early"), count(look & (F.col("seal") != F.col("__r.seal"))).alias("other_seal"))
    ok = (F.col("registrations") == 1) & (F.col("looks") <= 1) & (F.col("too_early") == 0) & (F.col("other_seal") == 0)
    return out.withColumn("status", F.when(ok, "PASS").otherwise("BLOCKED"))


def runtime_health(rows: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Adds ``reasons`` and ``status`` to health rows: each column that is null, negative or above its limit is a reason."""
    found = F.array_compact(F.array(*(F.when(_no((F.col(c) >= 0) & (F.col(c) <= limit)), F.lit(c)) for c, limit in limits.items())))
    return rows.withColumn("reasons", F.array_join(found, ",")).withColumn("status", F.when(F.size(found) == 0, "PASS").otherwise("BLOCKED"))


#: Columns of a contract snapshot.
SNAPSHOT = ("contract", "root", "exchange", "currency", "seen", "session", "bid", "ask", "settlement", "volume", "open_interest", "point_value", "tick_size", "margin", "fee", "delivery", "expiry", "notice", "last_trade", "cutoff", "spec_from", "spec_to")


def snapshot_gates(snapshot: DataFrame, as_of: str, limit_seconds: int = 300) -> DataFrame:
    """(gate, failing, status) of a contract snapshot: how many rows break each gate; a gate without rows, or with one that breaks it, is BLOCKED.

    Instants must be of a type with a time zone.  Prices may be negative, quotes
    may not cross; the cutoff comes no later than the last trade and, for
    physical delivery, before first notice.
    """
    missing = [c for c in SNAPSHOT if c not in snapshot.columns]
    if missing:
        return snapshot.sparkSession.createDataFrame([("columns", len(missing), "BLOCKED")], "gate string, failing long, status string")
    kinds = dict(snapshot.dtypes)
    zoned = all(kinds[c] == "timestamp" for c in ("seen", "cutoff", "spec_from", "spec_to"))
    c = F.col
    now = F.lit(as_of).cast("timestamp")
    text = lambda n: F.length(F.trim(c(n))) > 0
    number = lambda n: (F.abs(c(n)) < float("inf")) & ~F.isnan(c(n).cast("double"))
    age = F.unix_timestamp(now) - F.unix_timestamp("seen")
    repeated = F.count(F.lit(1)).over(Window.partitionBy(F.trim("contract"))) > 1
    rows = snapshot.withColumn("__repeated", repeated)
    kind = F.upper(F.trim("delivery"))
    cut = F.to_date("cutoff")
    gates = {
        "identifiers": text("contract") & text("root") & ~c("__repeated") & (F.trim("contract") != F.trim("root")),
        "venue_currency": text("exchange") & text("currency"),
        "time_zone": F.lit(zoned),
        "fresh": (age >= 0) & (age <= limit_seconds),
        "session": F.abs(F.datediff(F.to_date("seen"), "session")) <= 1,
        "market_values": number("bid") & number("ask") & number("settlement") & (c("ask") >= c("bid")) & (c("volume") >= 0) & (c("open_interest") >= 0) & (c("point_value") > 0) & (c("tick_size") > 0) & (c("margin") > 0) & (c("fee") >= 0),
        "expiry": (c("last_trade") <= c("expiry")) & (c("notice").isNull() | (c("notice") <= c("expiry"))),
        "delivery": (cut <= c("last_trade")) & ((kind == "CASH_SETTLED") | ((kind == "PHYSICAL") & (cut < c("notice")))),
        "effective": (c("spec_from") <= now) & (now < c("spec_to")),
    }
    one = rows.agg(F.count(F.lit(1)).alias("__n"), *(F.count_if(_no(test)).alias(g) for g, test in gates.items()))
    long = one.select("__n", F.explode(F.array(F.struct(F.lit("available").alias("gate"), F.when(c("__n") > 0, 0).otherwise(1).cast("long").alias("failing")), *(F.struct(F.lit(g).alias("gate"), c(g).alias("failing")) for g in gates))).alias("g")).select("__n", "g.*")
    return long.select("gate", "failing", F.when((c("failing") == 0) & (c("__n") > 0), "PASS").otherwise("BLOCKED").alias("status"))


def validated_snapshot(snapshot: DataFrame, as_of: str, limit_seconds: int = 300) -> DataFrame:
    """The snapshot with texts trimmed and codes in upper case; raises ValueError naming the gates that fail."""
    failed = [r["gate"] for r in snapshot_gates(snapshot, as_of, limit_seconds).filter("status <> 'PASS'").collect()]
    if failed:
        raise ValueError(f"snapshot gates failed: {', '.join(sorted(failed))}")
    return snapshot.withColumns({**{c: F.trim(c) for c in ("contract", "root")}, **{c: F.upper(F.trim(c)) for c in ("exchange", "currency", "delivery")}})


def cost_readiness(calibration: DataFrame, required: DataFrame, recent: DataFrame, least: dict[str, int], recent_fills: int) -> DataFrame:
    """Per required root: its calibration's counts, fills of the last days, the reasons why it is not ready, and status.

    A missing root fails everything; ``least`` holds the counts it needs.
    """
    rows = required.join(calibration, "root", "left").join(recent, "root", "left")
    tests = [F.when(_no(F.col(c) >= n), F.lit(f"{c} under {n}")) for c, n in least.items()]
    tests += [F.when(_no(F.col("recent_fills") >= recent_fills), F.lit(f"recent_fills under {recent_fills}")), F.when(_no(F.col("p95") > 0), F.lit("p95 is not positive"))]
    reasons = F.array_compact(F.array(*tests))
    return rows.select("root", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in [*least, "recent_fills"]), F.array_join(reasons, "; ").alias("reasons"), F.when(F.size(reasons) == 0, "PASS").otherwise("BLOCKED").alias("status"))


def evidence_gates(records: DataFrame, artifacts: DataFrame, runs: DataFrame, gates: list[str], as_of: str) -> DataFrame:
    """(run, gate, records, reasons, status) for every run and every gate that it needs evidence for.

    ``records``: run, gate, artifact, digest, issued, expires, run_digest,
    author, reviewer, approved, revoked; ``artifacts``: artifact and its content
    as it stands now; ``runs``: run and the digest it was frozen under.  A gate
    passes by exactly one record whose artifact still has the signed SHA-256,
    that is in force, bound to the run, reviewed by another than its author,
    approved and not revoked.  Unknown fields, and a gate without a record or
    with several, are BLOCKED; an artifact kept twice with different contents
    has changed.  Records of other gates or runs are not read.
    """
    c, now = F.col, F.lit(as_of).cast("timestamp")
    kept = artifacts.groupBy("artifact").agg(F.min(F.sha2("content", 256)).alias("__low"), F.max(F.sha2("content", 256)).alias("__high"), F.count_if(c("content").isNull()).alias("__empty"))
    own = runs.groupBy("run").agg(F.min(F.lower("digest")).alias("__frozen"))
    signed, name = F.lower("digest"), lambda col: F.nullif(F.lower(F.trim(col)), F.lit(""))
    sound = signed.rlike("^[0-9a-f]{64}$")
    faults = {
        "digest": _no(sound),
        "artifact missing": c("__empty").isNull(),
        "artifact changed": c("__empty").isNotNull() & _no((c("__empty") == 0) & (c("__low") == c("__high")) & (c("__low") == signed)),
        "dates": _no(c("expires") > c("issued")),
        "not yet issued": F.coalesce(c("issued") > now, F.lit(False)),
        "expired": F.coalesce(c("expires") <= now, F.lit(False)),
        "other run": _no(F.lower("run_digest") == c("__frozen")),
        "names": name("author").isNull() | name("reviewer").isNull(),
        "own review": F.coalesce(name("author") == name("reviewer"), F.lit(False)),
        "not approved": _no(c("approved")),
        "revoked": _no(~c("revoked")),
    }
    found = F.array_join(F.array_compact(F.array(*(F.when(test, F.lit(reason)) for reason, test in faults.items()))), ",")
    rows = records.filter(c("gate").isin(gates)).join(own, "run").join(kept, "artifact", "left").select("run", "gate", found.alias("__found"))
    # One row a gate before the last join; the text counts only where the record is the only one.
    by_gate = rows.groupBy("run", "gate").agg(F.count(F.lit(1)).alias("records"), F.min("__found").alias("__found"))
    needed = own.select("run", F.explode(F.array(*(F.lit(g) for g in gates))).alias("gate"))
    out = needed.join(by_gate, ["run", "gate"], "left").withColumn("records", F.coalesce("records", F.lit(0).cast("long")))
    reasons = F.when(c("records") == 0, "no record").when(c("records") > 1, "several records").otherwise(c("__found"))
    return out.select("run", "gate", "records", reasons.alias("reasons"), F.when(reasons == "", "PASS").otherwise("BLOCKED").alias("status"))
