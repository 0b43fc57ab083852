"""Rolls, order intents, funded paths and gate rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.columns import grown
from ledgerline.operators.panel import by_symbol


def roll_events(labels: DataFrame, short: int = 5) -> DataFrame:
    """Adds ``roll``, ``backward`` and ``brief`` to (symbol, session, delivery): label changes, those below a label seen before, and first rows of runs of at most ``short`` rows between two runs of one label.

    Rows without a label are left out.
    """
    rows = labels.filter("delivery IS NOT NULL")
    before = F.lag("delivery").over(by_symbol())
    rows = rows.withColumn("roll", F.coalesce(F.col("delivery") != before, F.lit(False)))
    highest = F.max("delivery").over(by_symbol().rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("backward", F.col("roll") & (F.col("delivery") < highest))
    rows = rows.withColumn("__run", F.sum(F.col("roll").cast("int")).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy("symbol", "__run").agg(F.min("session").alias("session"), F.count(F.lit(1)).alias("__n"), F.first("delivery").alias("__d"))
    by = Window.partitionBy("symbol").orderBy("__run")
    brief = (F.col("__n") <= short) & (F.lag("__d").over(by) == F.lead("__d").over(by))
    marked = runs.select("symbol", "session", F.coalesce(brief, F.lit(False)).alias("brief"))
    return rows.join(marked, ["symbol", "session"], "left").withColumn("brief", F.coalesce("brief", F.lit(False))).drop("__run")


def roll_anomalies(labels: DataFrame, short: int = 5) -> DataFrame:
    """(symbol, session) of suspicious label changes: brief reversals, repaired one at a time from the left, then switches to an earlier label in what is repaired.

    Each repair can make the next one possible, so a symbol's runs (a few a
    year) are folded together; the runs are made before.
    """
    rows = labels.filter("delivery IS NOT NULL")
    changed = F.coalesce(F.col("delivery") != F.lag("delivery").over(by_symbol()), F.lit(False))
    rows = rows.withColumn("__run", F.sum(changed.cast("int")).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy("symbol", "__run").agg(F.min("session").alias("session"), F.count(F.lit(1)).alias("n"), F.first("delivery").alias("delivery"))

    def fold(pdf):
        pdf = pdf.sort_values("session")
        found, done, ahead = [], [], [[d, n, s] for d, n, s in zip(pdf["delivery"], pdf["n"], pdf["session"], strict=True)][::-1]
        while ahead:
            done.append(ahead.pop())
            # The run on top may be brief between two runs of one label.
            while len(done) >= 2 and ahead and done[-1][1] <= short and done[-2][0] == ahead[-1][0]:
                _, n, first = done.pop()
                found.append(first)
                left, right = done.pop(), ahead.pop()
                done.append([left[0], left[1] + n + right[1], left[2]])
        highest = None
        for previous, (label, _, session) in zip([None, *done], done, strict=False):
            if previous is not None and label < highest:
                found.append(session)
            highest = label if highest is None else max(highest, label)
        return pd.DataFrame({"symbol": pdf["symbol"].iloc[0], "session": found})

    return runs.groupBy("symbol").applyInPandas(fold, f"symbol string, session {dict(labels.dtypes)['session']}").distinct()


def roll_plans(positions: DataFrame, contracts: DataFrame, as_of: str, participation: float = 0.02, days: int = 7) -> DataFrame:
    """A plan for each held contract of (contract, position): to the next later contract of its root that can still be held ``days`` days, within the volume of the thinner leg.

    ``contracts`` holds (contract, root, last_trade, deadline, volume).  NOT_DUE
    before the trigger, ``days`` before the deadline; BLOCKED from the deadline
    on, without a later contract, without capacity, or if the contract is not in
    the table.
    """
    now = F.lit(as_of).cast("date")
    held = positions.filter("position <> 0").join(contracts, "contract", "left")
    later = contracts.select(F.col("root").alias("__root"), F.col("contract").alias("to_contract"), F.col("last_trade").alias("__last"), F.col("deadline").alias("to_deadline"), F.col("volume").alias("to_volume"))
    later = later.filter(F.col("to_deadline") >= F.date_add(now, days))
    pairs = held.join(later, (F.col("root") == F.col("__root")) & (F.col("__last") > F.col("last_trade")) & (F.col("to_deadline") > F.col("deadline")), "left")
    nearest = Window.partitionBy("contract").orderBy(F.col("__last").asc_nulls_last(), "to_contract")
    rows = pairs.withColumn("__r", F.row_number().over(nearest)).filter("__r = 1").drop("__r", "__root", "__last")
    rows = rows.withColumn("requested", F.abs("position")).withColumn("capacity", F.coalesce(F.least(F.floor(F.col("volume") * participation), F.floor(F.col("to_volume") * participation)), F.lit(0)))
    wanted = F.least(F.col("requested"), F.col("capacity"))
    ladder = [
        (F.col("root").isNull(), "BLOCKED", "held contract is not in the table"), (F.col("to_contract").isNull(), "BLOCKED", "no later contract can be held"), (now >= F.col("deadline"), "BLOCKED", "deadline has passed"),
        (now < F.date_sub("deadline", days), "NOT_DUE", "trigger date is ahead"), (F.col("capacity") < 1, "BLOCKED", "capacity is below one contract"), (wanted < F.col("requested"), "APPROVED_PARTIAL", "capped by the thinner leg"),
    ]
    status, reason = F.lit("APPROVED"), F.lit("both legs pass")
    for test, s, r in reversed(ladder):
        status, reason = F.when(test, s).otherwise(status), F.when(test, r).otherwise(reason)
    rows = rows.withColumn("status", status).withColumn("reason", reason)
    return rows.select("contract", "root", "position", "to_contract", "requested", "capacity", F.when(F.col("status").startswith("APPROVED"), wanted).otherwise(0).alias("quantity"), "status", "reason")


def roll_legs(plans: DataFrame) -> DataFrame:
    """Two rows for each approved plan: the contract left and the one entered, with signed quantities."""
    size = F.signum("position") * F.col("quantity")
    legs = F.array(F.struct(F.lit("FROM").alias("leg"), F.col("contract").alias("leg_contract"), (-size).alias("signed")), F.struct(F.lit("TO").alias("leg"), F.col("to_contract").alias("leg_contract"), size.alias("signed")))
    return plans.filter(F.col("status").startswith("APPROVED")).select("root", F.explode(legs).alias("l")).select("root", "l.leg", "l.leg_contract", "l.signed")


def order_intents(current: DataFrame, target: DataFrame, terms: DataFrame, nav: float, participation: float = 0.02, gross_limit: float = 5.0, margin_limit: float = 0.35) -> DataFrame:
    """Orders from (symbol, current) to (symbol, target), a missing side 0, under (symbol, notional, margin, adv).

    Quantities are capped by the share of daily volume.  If all orders together
    exceed a limit, or one cannot be valued, only those pass that shrink a
    position without crossing zero.
    """
    rows = current.join(target, "symbol", "full_outer").join(terms, "symbol", "left").na.fill(0, ["current", "target"])
    valued = (F.col("notional") > 0) & (F.col("margin") > 0) & (F.col("adv") > 0)
    rows = rows.withColumn("__valued", F.coalesce(valued, F.lit(False))).withColumn("requested", F.col("target") - F.col("current"))
    capacity = F.when(F.col("__valued"), F.floor(F.col("adv") * participation)).otherwise(0)
    rows = rows.withColumn("capacity", capacity).withColumn("quantity", F.signum("requested") * F.least(F.abs("requested"), F.col("capacity")))
    rows = rows.withColumn("projected", F.col("current") + F.col("quantity"))
    # The totals are one row; each order is compared with them.
    total = rows.agg(F.try_divide(F.sum(F.abs("projected") * F.col("notional")), F.lit(nav)).alias("gross"), F.try_divide(F.sum(F.abs("projected") * F.col("margin")), F.lit(nav)).alias("margin_share"), F.count_if(~F.col("__valued")).alias("__bad"))
    rows = rows.join(F.broadcast(total))
    over = (F.col("__bad") > 0) | (F.col("gross") > gross_limit) | (F.col("margin_share") > margin_limit)
    shrinks = (F.abs("projected") < F.abs("current")) & (F.signum("projected") * F.signum("current") >= 0) & (F.col("quantity") != 0)
    status = F.when(~F.col("__valued"), "BLOCKED").when(F.col("requested") == 0, "NO_ACTION").when(F.col("quantity") == 0, "BLOCKED").when(over & ~shrinks, "BLOCKED").when(over, "APPROVED_REDUCE_ONLY").when(F.abs("quantity") < F.abs("requested"), "APPROVED_PARTIAL").otherwise("APPROVED")
    side = F.when(F.col("quantity") > 0, "BUY").when(F.col("quantity") < 0, "SELL").otherwise("HOLD")
    return rows.select("symbol", "current", "target", "capacity", "quantity", side.alias("side"), "projected", "gross", "margin_share", status.alias("status"))


def funded_paths(paths: DataFrame, rates: DataFrame, spread: float = 0.0, daycount: int = 360, stale: int = 5) -> DataFrame:
    """(member, session, ret) with interest on collateral by calendar days, at the rate (session, rate) known one session before.

    A rate holds for at most ``stale`` rows of the union of both calendars; a
    session without one earns nothing and is marked ``unrated``.
    """
    own = paths.select("session").distinct().withColumn("__own", F.lit(True))
    # Calendars have a row a day, so one ordered window over them is small.
    order = Window.orderBy("session")
    days = own.join(rates.select("session", "rate"), "session", "full_outer")
    days = days.withColumn("rate", F.last("rate", True).over(order.rowsBetween(-stale, 0))).filter("__own")
    days = days.withColumn("rate", F.lag("rate").over(order)).withColumn("days", F.coalesce(F.datediff("session", F.lag("session").over(order)), F.lit(0)))
    earned = F.coalesce(F.greatest(F.col("rate") - spread, F.lit(0.0)), F.lit(0.0))
    days = days.select("session", "days", F.coalesce("rate", F.lit(0.0)).alias("rate"), F.col("rate").isNull().alias("unrated"), (earned * F.col("days") / daycount).alias("interest"))
    rows = paths.join(days, "session").withColumn("funded", F.col("ret") + F.col("interest"))
    by = Window.partitionBy("member").orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("nav", grown("funded", by))
    return rows.withColumn("drawdown", F.col("nav") / F.greatest(F.lit(1.0), F.max("nav").over(by)) - 1)


def funded_by_rate(funded: DataFrame, low: float = 0.01, high: float = 0.04) -> DataFrame:
    """Per member and bucket of the rate: sessions, result with and without interest, and the interest."""
    bucket = F.when(F.col("rate") <= low, "low").when(F.col("rate") <= high, "middle").otherwise("high")
    return funded.groupBy("member", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("sessions"), F.sum("ret").alias("excess"), F.sum("interest").alias("interest"), F.sum("funded").alias("funded"))


def gate_rows(figures: DataFrame, gates: dict[str, tuple[str, float]]) -> DataFrame:
    """One row per gate from a one-row table: the column ``gate`` must be at most (``<=``) or at least (``>=``) its limit; null is BLOCKED."""

    def one(name: str, rule: str, limit: float) -> Column:
        seen = F.col(name).cast("double")
        ok = seen <= limit if rule == "<=" else seen >= limit
        return F.struct(F.lit(name).alias("gate"), seen.alias("observed"), F.lit(rule).alias("rule"), F.lit(float(limit)).alias("limit"), F.when(ok, "PASS").when(seen.isNull(), "BLOCKED").otherwise("FAIL").alias("status"))

    return figures.select(F.explode(F.array(*(one(n, *g) for n, g in gates.items()))).alias("g")).select("g.*")


def panel_quality(panel: DataFrame, field: str = "close") -> DataFrame:
    """Per symbol: first and last value, rows, rows without a value, unchanged values and their longest run."""
    by = by_symbol()
    rows = panel.withColumn("__same", F.coalesce(F.col(field) == F.lag(field).over(by), F.lit(False)))
    rows = rows.withColumn("__run", F.sum((~F.col("__same")).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("__length", F.sum(F.col("__same").cast("int")).over(Window.partitionBy("symbol", "__run")))
    there = F.when(F.col(field).isNotNull(), F.col("session"))
    return rows.groupBy("symbol").agg(F.min(there).alias("first"), F.max(there).alias("last"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col(field).isNull()).alias("missing"), F.count_if("__same").alias("unchanged"), F.max("__length").alias("longest_unchanged"))


def assess_batches(orders: DataFrame, batches: DataFrame, snapshot: DataFrame, positions: DataFrame, participation: float = 0.02, max_age_seconds: float = 300.0, safety_days: int = 5, gross_limit: float = 5.0, margin_limit: float = 0.35) -> DataFrame:
    """One row per order with what blocks it: participation, reduces, gross and margin multiples of its batch, status, reasons.

    ``orders``: batch, order_id, contract, root, side (BUY or SELL), quantity,
    order_type, limit_price, decided_at, reduce_only, roll_id.  ``batches``:
    batch, as_of, nav.  ``snapshot``: one row a contract with root, volume, bid,
    ask, notional, margin, deadline, exchange, currency.  ``positions``: one row
    a (batch, contract) with position.

    An order reduces if it is marked so and, by the position, shrinks it without
    crossing zero; others may not lie within the safety days of the deadline.
    Totals are those of the batch if all its orders on known contracts pass;
    beyond a limit only reducing orders go on.  A roll is one reducing and one
    opening leg of one root and quantity, into a later contract of the same
    exchange and currency.  Order ids and contracts may not repeat in a batch.
    """
    terms = snapshot.select("contract", F.col("root").alias("__root"), "volume", "bid", "ask", "notional", "margin", "deadline", "exchange", "currency", F.lit(True).alias("__known"))
    # Terms and figures of whole batches are small beside the orders, which are not shuffled for them.
    terms, batches = F.broadcast(terms), F.broadcast(batches)
    rows = orders.join(batches, "batch").join(terms, "contract", "left").join(positions.select("batch", "contract", "position"), ["batch", "contract"], "left")
    rows = rows.withColumn("position", F.coalesce("position", F.lit(0))).withColumn("__known", F.coalesce("__known", F.lit(False)))
    signed = F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))
    rows = rows.withColumn("__signed", signed).withColumn("__after", F.col("position") + F.col("__signed"))
    shrinks = (F.col("position") != 0) & (F.abs("__after") < F.abs("position")) & (F.signum("__after") * F.signum("position") >= 0)
    rows = rows.withColumn("reduces", F.col("__known") & F.coalesce(F.col("reduce_only"), F.lit(False)) & shrinks).withColumn("participation", F.when(F.col("__known") & (F.col("volume") > 0), F.col("quantity") / F.col("volume")))

    # What repeats within a batch: counted by the key that repeats, then by batch.
    def repeats(column: str, name: str) -> DataFrame:
        return F.broadcast(orders.groupBy("batch", column).agg(F.count(F.lit(1)).alias("__c")).groupBy("batch").agg((F.max("__c") > 1).alias(name)))

    moved = orders.join(batches.select("batch"), "batch").join(terms.select("contract"), "contract").groupBy("batch", "contract").agg(F.sum(signed).alias("__moved"))
    held = positions.select("batch", "contract", "position").join(moved, ["batch", "contract"], "full_outer").na.fill(0, ["position", "__moved"]).join(terms.select("contract", "notional", "margin", "__known"), "contract", "left")
    now, then = F.abs("position"), F.abs(F.col("position") + F.col("__moved"))
    unknown = F.col("__known").isNull() & ((now != 0) | (then != 0))
    total = held.groupBy("batch").agg(F.sum(now * F.col("notional")).alias("__g0"), F.sum(then * F.col("notional")).alias("__g"), F.sum(then * F.col("margin")).alias("__m"), F.max(unknown.cast("int")).alias("__unknown"))

    leg = lambda c, reducing: F.max(F.when(F.col("reduces") == reducing, F.col(c)))
    same = lambda c: F.min(c) == F.max(c)
    rolls = rows.filter("roll_id IS NOT NULL").groupBy("batch", "roll_id").agg(
        F.count(F.lit(1)).alias("__legs"), (same("root") & same("quantity") & ~same("contract") & ~same("side")).alias("__pair"), F.count_if("reduces").alias("__closing"),
        ((leg("exchange", True) == leg("exchange", False)) & (leg("currency", True) == leg("currency", False)) & (leg("deadline", False) > leg("deadline", True))).alias("__later"),
    )
    out = rows.join(repeats("order_id", "__twice"), "batch").join(repeats("contract", "__shared"), "batch").join(F.broadcast(total), "batch", "left").join(rolls, ["batch", "roll_id"], "left")
    age = F.col("as_of").cast("double") - F.col("decided_at").cast("double")
    gross, margin = F.try_divide(F.col("__g"), F.col("nav")), F.try_divide(F.col("__m"), F.col("nav"))
    limited = F.col("order_type") == "MARKETABLE_LIMIT"
    known, opens = F.col("__known"), ~F.col("reduces")
    reasons = [
        ("the batch repeats an order id", F.col("__twice")),
        ("the batch has several orders for one contract", F.col("__shared")),
        ("decided in the future", age < 0),
        ("the decision is stale", age > max_age_seconds),
        ("the contract is not in the snapshot", ~known),
        ("another root than the contract's", known & (F.col("root") != F.col("__root"))),
        ("too large a share of volume", known & F.coalesce(F.col("participation") > participation, F.lit(True))),
        ("the buy limit is below the ask", known & limited & (F.col("side") == "BUY") & F.coalesce(F.col("limit_price") < F.col("ask"), F.lit(True))),
        ("the sell limit is above the bid", known & limited & (F.col("side") == "SELL") & F.coalesce(F.col("limit_price") > F.col("bid"), F.lit(True))),
        ("marked as reducing, but is not", known & F.col("reduce_only") & opens),
        ("opens within the safety days of the deadline", known & opens & (F.col("deadline") < F.col("as_of") + F.make_interval(days=F.lit(safety_days)))),
        ("the batch holds contracts without terms", F.col("__unknown") == 1),
        ("gross notional beyond the limit", opens & (gross > gross_limit)),
        ("margin beyond the limit", opens & (margin > margin_limit)),
        ("a roll has two legs", F.col("roll_id").isNotNull() & (F.col("__legs") != 2)),
        ("roll legs do not match", (F.col("__legs") == 2) & ~F.col("__pair")),
        ("a roll closes one leg and opens the other", (F.col("__legs") == 2) & F.col("__pair") & (F.col("__closing") != 1)),
        ("the roll does not lead to a later contract", (F.col("__legs") == 2) & F.col("__pair") & (F.col("__closing") == 1) & ~F.coalesce(F.col("__later"), F.lit(False))),
    ]
    found = F.array_compact(F.array(*(F.when(test, F.lit(text)) for text, test in reasons)))
    out = out.withColumn("reasons", found)
    return out.select("batch", "order_id", "contract", "participation", "reduces", gross.alias("gross"), margin.alias("margin_share"), F.when(F.size("reasons") == 0, "PASS").otherwise("BLOCKED").alias("status"), F.concat_ws("; ", "reasons").alias("reasons"))
