"""Stateful streams that carry a small state per key: drawdown, hash chain, dead band, exponential moments, filtered states, orders.

Each takes a stream of (key, ts, order columns, values) and returns a row for
each row that comes in, with its ``outcome``:

* ``seen``: the fold has taken it.  Rows wait in the state until the watermark
  has passed them, and are taken in order, so the result does not depend on how
  the stream is cut into micro-batches.  Rows that share their order columns are
  all taken, in the order of their values.
* ``repeat``: it repeats the ``unique`` columns of a row of its key that waits
  beside it; its values of the fold are null.
* ``late``: the watermark had passed it when it came; values null as well.

Nothing is dropped: ``events.finish`` writes the outcomes into folders of their
own.  Keys are dealt to ``GROUPS`` groups, whose number is part of a stream's
state.  A group's waiting rows span the watermark's delay only, in pieces as they
came, and a trigger reads the pieces that hold a row it can take, and the states
of the keys whose rows it takes.  What a fold has seen of a key stays, as a chain
or a drawdown has no end.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import IntegralType

from ledgerline.functions.columns import millis


#: Groups of keys that a stream's fold is dealt to: a call into Python for each key would cost more than its rows.
GROUPS = 1024


class _Fold(StatefulProcessor):
    """State of a group of keys: what ``step`` returned last for each key, and the rows that wait, in pieces by their earliest millisecond."""

    def __init__(self, columns: list[str], whole: set[str], names: list[str], order: list[str], unique: list[str], added: list[str], step: Callable) -> None:
        self.columns, self.whole, self.added, self.step = columns, whole, added, step
        at = columns.index
        self.own, self.names, self.order, self.unique, self.key, self.stamp = [at(c) for c in names], names, [at(c) for c in order], [at(c) for c in unique], at("key__"), at("ms__")

    def init(self, handle) -> None:
        self.handle = handle
        self.now = handle.getMapState("now", "key string", "value binary")
        self.waiting = handle.getMapState("waiting", "earliest long", "rows binary")

    def _rows(self, frame: pd.DataFrame) -> Iterator[tuple]:
        """Rows as tuples; whole numbers come as text, as pandas makes them fractions beside a null."""
        each = (([int(v) if isinstance(v, str) else None for v in frame[c]] if c in self.whole else frame[c].tolist()) for c in self.columns)
        return zip(*each, strict=True)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[*self.names, *self.added, "outcome"], dtype=object)

    def _own(self, row: tuple) -> tuple:
        return tuple(row[i] for i in self.own)

    def _wait(self, rows: list[tuple]) -> None:
        """Keep the rows as one piece, and wake up at its earliest row."""
        if not rows:
            return
        earliest = min(row[self.stamp] for row in rows)
        kept = self.waiting.getValue((earliest,)) if self.waiting.containsKey((earliest,)) else None
        if kept is not None:
            rows = pickle.loads(kept[0]) + rows
        self.waiting.updateValue((earliest,), (pickle.dumps(rows),))
        self.handle.registerTimer(earliest)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark, fresh, late = timerValues.getCurrentWatermarkInMs(), [], []
        for frame in rows:
            for row in self._rows(frame):
                if row[self.stamp] is None or row[self.stamp] < mark:
                    late.append((*self._own(row), *[None] * len(self.added), "late"))
                else:
                    fresh.append(row)
        self._wait(fresh)
        if late:
            yield self._frame(late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark, passed, rest = timerValues.getCurrentWatermarkInMs(), {}, []
        for earliest in [k[0] for k in self.waiting.keys()]:
            if earliest < mark:
                for row in pickle.loads(self.waiting.getValue((earliest,))[0]):
                    if row[self.stamp] < mark:
                        passed.setdefault(row[self.key], []).append(row)
                    else:
                        rest.append(row)
                self.waiting.removeKey((earliest,))
        self._wait(rest)
        if not passed:
            return
        values = []
        for mine, rows in passed.items():
            values.extend(self._fold(mine, rows))
        yield self._frame(values)

    def _fold(self, key: str, rows: list[tuple]) -> Iterator[tuple]:
        """Take a key's rows in order, from and to its state."""
        before = self.now.getValue((key,)) if self.now.containsKey((key,)) else None
        now, seen = None if before is None else pickle.loads(before[0]), set()
        # Nulls first; rows that tie are in the order of what they hold.
        for row in sorted(rows, key=lambda r: ([(r[i] is not None, r[i]) for i in self.order], repr(r))):
            if self.unique:
                mine = tuple(row[i] for i in self.unique)
                if mine in seen:
                    yield (*self._own(row), *[None] * len(self.added), "repeat")
                    continue
                seen.add(mine)
            now, value = self.step(now, dict(zip(self.columns, row, strict=True)))
            yield (*self._own(row), *value, "seen")
        self.now.updateValue((key,), (pickle.dumps(now),))

    def close(self) -> None:
        pass


def fold(rows: DataFrame, order: list[str], out: str, step: Callable, late: str = "1 hour", unique: list[str] | None = None) -> DataFrame:
    """Rows (key, ts, ``order``, others) with what ``step(state or None, row)`` returns (the next state, and the values of ``out`` as a tuple) and ``outcome``.

    A row of ``step`` has its ``ts`` in microseconds, and ``ms__`` in milliseconds.
    """
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    names, kinds = rows.columns, {f.name: f.dataType for f in rows.schema}
    # The watermark goes by the nearest millisecond, like every time of the fold; its column is left out, as Spark would drop late rows by it before the fold sees them.
    rows = rows.withColumn("at__", F.timestamp_millis(millis("ts"))).withWatermark("at__", late).withColumn("ms__", F.unix_millis(F.timestamp_micros(F.unix_micros("at__")))).drop("at__")
    rows = rows.withColumn("ts", F.unix_micros("ts")).withColumn("key__", F.coalesce(F.concat(F.lit("="), F.col("key").cast("string")), F.lit("")))
    columns, whole = rows.columns, {f.name for f in rows.schema if isinstance(f.dataType, IntegralType)}
    rows = rows.select(F.pmod(F.xxhash64("key"), F.lit(GROUPS)).cast("int").alias("group__"), *(F.col(c).cast("string").alias(c) if c in whole else F.col(c) for c in columns))
    kept = ", ".join(f"`{n}` {'long' if n == 'ts' else kinds[n].simpleString()}" for n in names)
    added = [part.split()[0] for part in out.split(", ")]
    done = rows.groupBy("group__").transformWithStateInPandas(_Fold(columns, whole, names, order, unique or [], added, step), f"{kept}, {out}, outcome string", "Append", "EventTime")
    return done.withColumn("ts", F.timestamp_micros("ts"))


def running_drawdown(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds nav, drawdown and the rows since the last peak, of the return ``ret``."""

    def step(state, row):
        nav, peak, under = state or (1.0, 1.0, 0)
        nav *= 1.0 + row["ret"]
        peak = max(peak, nav)
        under = 0 if nav >= peak else under + 1
        return (nav, peak, under), (nav, nav / peak - 1.0, under)

    return fold(rows, order, "nav double, drawdown double, under int", step)


def chain_breaks(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds whether (sequence, previous_hash, record_hash) breaks the numbers or the links of its chain."""

    def step(state, row):
        broken = (False, False) if state is None else (row["sequence"] != state[0] + 1, row["previous_hash"] != state[1])
        return (int(row["sequence"]), row["record_hash"]), broken

    return fold(rows, order, "sequence_break boolean, hash_break boolean", step)


def dead_band(rows: DataFrame, order: list[str], width: float = 0.25) -> DataFrame:
    """Adds ``held``: the value held before unless ``value`` is further off than width x the larger of the two."""

    def step(state, row):
        held = state[0] if state else 0.0
        held = float(row["value"]) if abs(row["value"] - held) > width * max(abs(row["value"]), abs(held)) else held
        return (held,), (held,)

    return fold(rows, order, "held double", step)


def ewm_moments(rows: DataFrame, order: list[str], alpha: float) -> DataFrame:
    """Adds the exponentially weighted mean and bias-corrected deviation of ``value``, the first row with all the weight."""

    def step(state, row):
        x = float(row["value"])
        if state is None:
            return (x, 0.0, 1.0), (x, None)
        mean, var, squares = state
        off = x - mean
        mean, var, squares = mean + alpha * off, (1 - alpha) * (var + alpha * off * off), (1 - alpha) ** 2 * squares + alpha**2
        return (mean, var, squares), (mean, (var / (1 - squares)) ** 0.5)

    return fold(rows, order, "mean double, deviation double", step)


def filtered_states(rows: DataFrame, order: list[str], means: list[float], variances: list[float], transition: list[list[float]], initial: list[float]) -> DataFrame:
    """Adds the probabilities of the states given the values so far, by frozen parameters."""
    mu, var, moves, start = (np.asarray(v, dtype=float) for v in (means, variances, transition, initial))

    def step(state, row):
        before = start if state is None else np.asarray(state[0]) @ moves
        now = before * np.exp(-0.5 * (row["value"] - mu) ** 2 / var) / np.sqrt(2 * np.pi * var)
        now = (now / max(now.sum(), np.finfo(float).tiny)).tolist()
        return (now,), (now,)

    return fold(rows, order, "probabilities array<double>", step)


_TERMINAL = {"FILLED", "REJECTED", "CANCELLED"}


def order_states(events: DataFrame, late: str = "1 hour", remember_ms: int = 30 * 86_400_000) -> DataFrame:
    """What every event of an order does: a stream of (key: the order, ts, event_id, event, quantity) with verdict, status and filled after it.

    An order is OUTBOX (its quantity is the requested one), ACK, FILL until
    that is reached, or REJECT or CANCEL.  ``verdict``: applied; duplicate (the
    order has had that event id within ``remember_ms``); overfilled (a fill
    beyond the requested quantity); illegal (any other event that may not come
    now, and unknown ones).  Only applied events change the order.  Late ones
    have the outcome ``late`` and no verdict.
    """

    def step(state, row):
        status, requested, filled, ids = state or (None, 0, 0, {})
        ids = {k: at for k, at in ids.items() if at >= row["ms__"] - remember_ms}
        event, quantity = row["event"], 0 if pd.isna(row["quantity"]) else int(row["quantity"])
        if row["event_id"] is not None and row["event_id"] in ids:
            return (status, requested, filled, ids), ("duplicate", status, filled)
        if row["event_id"] is not None:
            ids[row["event_id"]] = row["ms__"]
        verdict = "illegal"
        if event == "OUTBOX" and status is None:
            status, requested, verdict = "PERSISTED", quantity, "applied"
        elif event == "ACK" and status == "PERSISTED":
            status, verdict = "ACKNOWLEDGED", "applied"
        elif event == "FILL" and status in ("ACKNOWLEDGED", "PARTIAL"):
            verdict = "overfilled" if filled + quantity > requested else "applied"
            if verdict == "applied":
                filled += quantity
                status = "FILLED" if filled == requested else "PARTIAL"
        elif event in ("REJECT", "CANCEL") and status is not None and status not in _TERMINAL:
            status, verdict = "REJECTED" if event == "REJECT" else "CANCELLED", "applied"
        return (status, requested, filled, ids), (verdict, status, filled)

    return fold(events.select("key", "ts", "event_id", "event", "quantity"), ["ts", "event_id"], "verdict string, status string, filled long", step, late)


class _Freshness(StatefulProcessor):
    """State: the newest heartbeat, in microseconds; a processing-time timer for when it grows stale."""

    def __init__(self, limit_ms: int) -> None:
        self.limit = limit_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long")

    def _told(self, key, last: int, now: int) -> pd.DataFrame:
        age = 1000 * now - last
        reason = "heartbeat is in the future" if age < 0 else "heartbeat is stale" if age > 1000 * self.limit else "heartbeat is healthy"
        row = (key[0], "PASS" if 0 <= age <= 1000 * self.limit else "BLOCKED", last, 1000 * now, age / 1e6, reason)
        return pd.DataFrame([row], columns=["component", "status", "last", "told_at", "age_seconds", "reason"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        before = self.last.get()[0] if self.last.exists() else None
        last = max([int(frame["us__"].max()) for frame in rows if len(frame)] + ([before] if before is not None else []))
        self.last.update((last,))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        stale = last // 1000 + self.limit + 1
        if stale > now:
            self.handle.registerTimer(stale)
        yield self._told(key, last, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._told(key, self.last.get()[0], timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def freshness(heartbeats: DataFrame, component: str, limit_seconds: float) -> DataFrame:
    """(component, status, last, told_at, age_seconds, reason) of a stream with ``ts``, by the clock of the machine.

    A row is told for each trigger that brings a component's heartbeats, and one
    without any further event once the newest is older than the limit: PASS, or
    BLOCKED as stale or from the future.  Heartbeats without a component or a
    time tell nothing.
    """
    rows = heartbeats.select(F.col(component).cast("string").alias("component"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us__")).filter("component IS NOT NULL AND us__ IS NOT NULL")
    out = "component string, status string, last long, told_at long, age_seconds double, reason string"
    told = rows.groupBy("component").transformWithStateInPandas(_Freshness(round(limit_seconds * 1000)), out, "Append", "ProcessingTime")
    return told.withColumns({c: F.timestamp_micros(c) for c in ("last", "told_at")})
