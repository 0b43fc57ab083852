"""Inputs cut at a date and what is recomputed from them, catalogues, entries, digests in a canonical form, recovery, and two reports on funded and scaled paths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.audit import replay_orders
from ledgerline.operators.inference import walk_forward
from ledgerline.operators.panel import by_symbol, common_sessions, month_end_rows, project, sessions
from ledgerline.operators.scenarios import path_figures


def allocation_inputs(panel: DataFrame, first: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(traded, life) of one panel (symbol, session, fields).

    ``traded`` has the sessions that every symbol has, from ``first`` on, or from
    the first session by which every symbol has been quoted.  ``life`` has every
    symbol on every session of any symbol; fields of a symbol that was not quoted
    are null, nothing is filled.  A ceiling belongs into the scan of the panel.
    """
    traded = common_sessions(panel)
    if first is not None:
        traded = traded.filter(F.col("session") >= F.lit(first).cast("date"))
    # Without a date: a common session is never before the last of the first quotes.
    life = sessions(panel).join(panel.select("symbol").distinct(), how="cross").join(panel, ["symbol", "session"], "left")
    return traded, life


def stitched(paths: DataFrame, years: list[int]) -> DataFrame:
    """(fold, member, session, ret): the returns of each test year's chosen member, as ``walk_forward`` chooses."""
    chosen = walk_forward(paths, years).select("fold", "member")
    return paths.withColumn("fold", F.year("session")).join(chosen, ["fold", "member"]).select("fold", "member", "session", "ret")


def custody_report(work: Callable[[DataFrame], DataFrame], whole: DataFrame, guarded: DataFrame, last: str) -> DataFrame:
    """One row on whether sessions after ``last`` could have informed what was chosen before.

    ``work`` gives ``stitched`` rows of a panel.  It runs on the ``whole`` panel
    and on the ``guarded`` one, which is read from files with its ceiling in the
    scan; the returns and the choices up to ``last`` must be the same to the bit.
    A guarded panel that reaches beyond ``last``, and a comparison of nothing,
    are BLOCKED.
    """
    day = F.lit(last).cast("date")
    a = work(whole).filter(F.col("session") <= day).select("session", F.col("ret").alias("__a"), F.col("member").alias("__m"), F.year("session").alias("__y"))
    b = work(guarded).select("session", F.col("ret").alias("__b"), F.col("member").alias("__n"))
    both = a.join(b, "session", "full_outer").withColumn("__fold", F.year("session"))
    one = lambda c: F.array_join(F.transform(F.array_sort(F.collect_set(F.when(F.col(c).isNotNull(), F.struct(F.col("__fold").alias("f"), F.col(c).alias("m"))))), lambda x: F.concat_ws(":", x["f"].cast("string"), x["m"])), ",")
    out = both.agg(
        F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("compared"), F.count_if(F.col("__a").isNull() != F.col("__b").isNull()).alias("missing"),
        F.max(F.abs(F.col("__a") - F.col("__b"))).alias("drift"), one("__n").alias("guarded_choice"), one("__m").alias("whole_choice"),
    )
    edge = guarded.agg(F.max("session").alias("guarded_last"))
    good = (F.col("compared") > 0) & (F.col("missing") == 0) & (F.col("drift") == 0) & (F.col("guarded_choice") == F.col("whole_choice")) & (F.col("guarded_last") <= day)
    # Both are one row.
    return out.join(F.broadcast(edge)).withColumn("status", F.when(good, "PASS").otherwise("BLOCKED"))


def fund_catalogue(rows: DataFrame, date: str = "first_quoted", pivot: int = 69) -> tuple[DataFrame, DataFrame]:
    """(catalogue, violations) of (symbol, ``date`` as text D/M/YY): the date read strictly, years under ``pivot`` in this century.

    Violations are (symbol, reason): no symbol, repeated, no date.  The catalogue
    holds the rows of symbols without one.
    """
    text = F.trim(date)
    part = lambda k: F.regexp_extract(text, r"^(\d{1,2})/(\d{1,2})/(\d{2})$", k)
    year = F.when(part(3) != "", part(3).cast("int") + F.when(part(3).cast("int") < pivot, 2000).otherwise(1900))
    read = F.concat_ws("-", year.cast("string"), F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0")).try_cast("date")
    typed = rows.withColumn("symbol", F.nullif(F.trim("symbol"), F.lit(""))).withColumn(date, F.when(year.isNotNull(), read))
    reason = lambda test, text: typed.filter(test).select("symbol", F.lit(text).alias("reason"))
    twice = typed.filter("symbol IS NOT NULL").groupBy("symbol").count().filter("count > 1").select("symbol", F.lit("repeated").alias("reason"))
    wrong = reason(F.col("symbol").isNull(), "no symbol").unionByName(reason(F.col(date).isNull(), "no date")).distinct().unionByName(twice)
    return typed.filter("symbol IS NOT NULL").join(wrong.select("symbol"), "symbol", "left_anti"), wrong


def entry_sessions(members: DataFrame) -> DataFrame:
    """(symbol, entry, sessions): the first session on which each symbol of (symbol, session, member) is admitted, null for one that never is, and how many there are."""
    return members.groupBy("symbol").agg(F.min(F.when(F.col("member"), F.col("session"))).alias("entry"), F.count_if("member").alias("sessions"))


def year_starts(spans: DataFrame, step: int = 1) -> DataFrame:
    """Adds ``boundary`` to (start, end), one row for each January 1 strictly between them, every ``step`` years from the first."""
    first = F.add_months(F.trunc("start", "year"), 12)
    steps = F.when(first < F.col("end"), F.expr(f"sequence(add_months(trunc(start, 'year'), 12), date_sub(end, 1), interval {int(step)} year)"))
    return spans.withColumn("boundary", F.explode(steps))


def canonical_digest(rows: DataFrame, group: str, key: str, fields: list[str], digits: int = 2) -> DataFrame:
    """(group, rows, wrong, digest): SHA-256 of each group's rows in a form that does not depend on their order.

    A row is its JSON object of key and fields in the order given, nulls written;
    pass decimals, integers, dates or texts, whose text is exact.  Rows are put in
    parts by the first ``digits`` of the key's MD5, a part is hashed over its
    rows by key, and the group over its parts in order, so no task holds a group.
    Blank and repeated keys are counted in ``wrong`` and leave no digest.
    """
    # Rows are shuffled once, as they are; the JSON is written and keys are counted where a part stands together.
    own = rows.select(group, F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")).alias("__k"), *fields)
    own = own.withColumn("__p", F.substring(F.md5("__k"), 1, digits))
    parts = own.groupBy(group, "__p").agg(F.array_sort(F.collect_list(F.struct("__k", *fields))).alias("__rows"))
    json = lambda x: F.to_json(F.struct(x["__k"].alias(key), *(x[f].alias(f) for f in fields)), {"ignoreNullFields": "false"})
    keys = F.array_distinct(F.transform("__rows", lambda x: x["__k"]))
    parts = parts.select(
        group, "__p", F.size("__rows").cast("long").alias("__n"), (F.size("__rows") - F.size(F.array_remove(keys, ""))).cast("long").alias("__bad"),
        F.sha2(F.array_join(F.transform("__rows", json), "\n"), 256).alias("__h"),
    )
    whole = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__p", "__h"))), lambda x: x["__h"]), "\n"), 256)
    out = parts.groupBy(group).agg(F.sum("__n").alias("rows"), F.sum("__bad").alias("wrong"), whole.alias("digest"))
    return out.withColumn("digest", F.when(F.col("wrong") == 0, F.col("digest")))


def scalar_in_force(scalars: DataFrame, exposure: str, warm_up: int = 63) -> DataFrame:
    """Adds ``in_force`` to (symbol, session, scalar, exposure): the scalar of the month end before, one session later.

    The scalar counts as 1 until there has been exposure for ``warm_up``
    sessions, and so does what is in force before the first month end.
    """
    so_far = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    live = F.max(F.coalesce(F.abs(exposure) > 0, F.lit(False))).over(so_far)
    rows = scalars.withColumn("__live", live).withColumn("__warm", F.col("__live") & F.lag("__live", warm_up, False).over(by_symbol()))
    rows = rows.withColumn("in_force", F.when(F.col("__warm"), F.col("scalar")).otherwise(1.0))
    carried = project(month_end_rows(rows.select("symbol", "session", "in_force")), rows, "in_force")
    return scalars.join(carried.withColumn("in_force", F.coalesce("in_force", F.lit(1.0))), ["symbol", "session"])


def recovery_report(events: DataFrame, broker: DataFrame, parts: int | None = None) -> DataFrame:
    """Two rows per book after a restart: whether its journal replays, and whether the open orders are those of the broker.

    ``events`` are (book, key, event_id, event, ts, quantity), where quantity is
    what an OUTBOX orders and a FILL fills; ``broker`` is (book, key, open).
    ``observed`` counts orders replayed, and orders that differ (null where the
    replay fails).  An order is open in the states OUTBOX, ACK and FILL while
    something remains.  With ``parts`` the orders are dealt over so many tasks.
    """
    amount = lambda kind: F.sum(F.when(F.col("event") == kind, F.col("quantity")).otherwise(0))
    remaining = F.col("remaining")
    states = replay_orders(events.repartition(parts, "book", "key") if parts else events, ["book", "key"], figures=((amount("OUTBOX") - amount("FILL")).alias("remaining"),))
    orders = states.select("book", "key", "illegal", "repeated", F.when(F.col("state") != "REJECT", F.greatest(remaining, F.lit(0))).otherwise(0).alias("ours"), (remaining < 0).cast("int").alias("over"))
    both = orders.join(broker.select("book", "key", F.col("open").alias("theirs")), ["book", "key"], "full_outer")
    breaks = F.coalesce("ours", F.lit(0)) != F.coalesce("theirs", F.lit(0))
    out = both.groupBy("book").agg(F.count("illegal").alias("orders"), F.coalesce(F.sum(F.col("illegal") + F.col("repeated") + F.col("over")), F.lit(0)).alias("faults"), F.count_if(breaks).alias("breaks"))
    replayed = (F.col("faults") == 0) & (F.col("orders") > 0)
    gates = F.array(
        F.struct(F.lit("journal_replay").alias("gate"), F.col("orders").alias("observed"), F.when(replayed, "PASS").otherwise("BLOCKED").alias("status"), F.when(replayed, "order states replay").when(F.col("orders") == 0, "no journal").otherwise(F.concat(F.col("faults").cast("string"), F.lit(" faults"))).alias("reason")),
        F.struct(F.lit("open_orders").alias("gate"), F.when(replayed, F.col("breaks")).alias("observed"), F.when(replayed & (F.col("breaks") == 0), "PASS").otherwise("BLOCKED").alias("status"), F.when(~replayed, "journal replay failed").when(F.col("breaks") == 0, "open orders agree").otherwise("open orders differ").alias("reason")),
    )
    return out.select("book", F.explode(gates).alias("g")).select("book", "g.*")


def funded_performance(funded: DataFrame, periods: int = 252) -> DataFrame:
    """Two rows per member of ``funded_paths``, basis excess and funded: sessions, cagr, volatility, max_drawdown, sharpe, rate, contribution.

    The Sharpe ratio is that of the excess return on both rows, since interest is
    taken off again; rate is the mean rate, contribution the interest a year; both
    are 0 on the excess row.
    """
    pair = F.array(F.struct(F.lit("excess").alias("basis"), F.col("ret").alias("ret")), F.struct(F.lit("funded").alias("basis"), F.col("funded").alias("ret")))
    long = funded.select("member", "session", F.explode(pair).alias("x")).select("member", "session", "x.*")
    figures = path_figures(long, ["member", "basis"], periods).drop("sharpe")
    years = F.greatest(F.datediff(F.max("session"), F.min("session")), F.lit(1)) / 365.2425
    shared = funded.groupBy("member").agg((F.try_divide(F.avg("ret"), F.nullif(F.stddev_pop("ret"), F.lit(0.0))) * periods**0.5).alias("sharpe"), F.avg("rate").alias("rate"), (F.sum("interest") / years).alias("contribution"))
    on = lambda c: F.when(F.col("basis") == "funded", F.col(c)).otherwise(0.0).alias(c)
    return figures.join(shared, "member").select("member", "basis", "sessions", "cagr", "volatility", "max_drawdown", "sharpe", on("rate"), on("contribution"))


def volatility_budget(ledger: DataFrame, budget: float = 0.07, ceiling: float = 1.0, periods: int = 252) -> DataFrame:
    """Per member of (member, session, ret, scale, risk_weight): whether the budget binds.

    realized volatility and its ratio to the budget, mean scale, shares of sessions
    at the ceiling of the scale and without a risk position, mean risk and cash weight.
    A scale of at most the ceiling cannot lift a calm book to its budget; ``binds``
    is true where the scale was below the ceiling on some session.
    """
    share = lambda test: F.avg(test.cast("double"))
    realized = F.stddev_samp("ret") * periods**0.5
    return ledger.groupBy("member").agg(
        F.count("ret").alias("sessions"), realized.alias("realized"), (realized / budget).alias("over_budget"), F.avg("scale").alias("mean_scale"),
        share(F.col("scale") >= ceiling - 1e-12).alias("at_ceiling"), share(F.abs("risk_weight") <= 1e-9).alias("no_risk"), F.avg("risk_weight").alias("mean_risk"), (1 - F.avg("risk_weight")).alias("mean_cash"),
        F.coalesce(F.min("scale") < ceiling - 1e-12, F.lit(False)).alias("binds"),
    )
