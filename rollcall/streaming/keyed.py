"""Folds with keyed state across micro-batches.

An :class:`OrderedFold` applies the rows of each key in the order of their event time, in whatever order they come: rows above the watermark
wait in the state, those at or below it are folded in for good, and what is told of a key is the fold with its waiting rows on top. A row that is read
again counts once: while its first reading waits it is known, and afterwards it is late. Late rows are dropped by Spark; ``jobs.corrected``
takes those in. Each batch reads the state of its own keys only. A key's state is one value, which is read and written once for a key and batch, as each
call from Python costs more than many rows; rows that wait are folded for good when the key next has rows, and a timer rings only for what happens without any.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rollcall.functions.u256 import ZERO_ADDRESS
from rollcall.streaming.rules import Rules

State = dict[str, Any]


class OrderedFold(StatefulProcessor):
    """What subclasses say: ``key``, the columns of ``events`` (``pos`` first, a number that tells rows of a key apart, and ``at_ms``), of ``held`` and of ``told``, as DDL."""

    key: str
    events: str
    held: str
    told: str

    def start(self) -> State:
        """The state of a key without rows."""
        raise NotImplementedError

    def step(self, state: State, row: State) -> None:
        """Takes one row in."""
        raise NotImplementedError

    def wake(self, state: State) -> int | None:
        """When something is to happen without a row, if ever."""
        return None

    def woken(self, state: State) -> None:
        """What happens then."""

    def tell(self, key: object, state: State) -> State:
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = [c.split()[0] for c in self.events.split(", ")]
        self.fields = [c.split()[0] for c in self.held.split(", ")]
        self.columns = [c.split()[0] for c in self.told.split(", ")]
        self.kept = handle.getValueState("kept", f"{self.held}, waiting string")

    def taken(self, state: State, rows: list[State], until: int | None = None) -> State:
        """The state after rows in order, and after all that happens without a row up to the time of each, or up to ``until``."""
        for row in rows:
            self.elapse(state, row["at_ms"])
            self.step(state, row)
        if until is not None:
            self.elapse(state, until)
        return state

    def elapse(self, state: State, now: int) -> None:
        while (at := self.wake(state)) is not None and at <= now:
            self.woken(state)

    def moved(self, key: object, new: list[State], watermark: int) -> Row:
        kept = self.kept.get()
        state = dict(zip(self.fields, kept, strict=False)) if kept else self.start()
        known = {r["pos"]: r for r in (dict(zip(self.names, row, strict=True)) for row in json.loads(kept[-1]))} if kept and kept[-1] else {}
        for row in new:
            known.setdefault(row["pos"], row)
        rows = sorted(known.values(), key=lambda r: (r["at_ms"], r["pos"]))
        final, rest = [r for r in rows if r["at_ms"] <= watermark], [r for r in rows if r["at_ms"] > watermark]
        state = self.taken(state, final, watermark)
        self.kept.update((*(state[f] for f in self.fields), json.dumps([[r[n] for n in self.names] for r in rest]) if rest else None))
        state = self.taken(dict(state), rest)
        if (at := self.wake(state)) is not None:
            self.handle.registerTimer(at + 1)
        told = self.tell(key, state)
        return Row(**{c: told[c] for c in self.columns})

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        new = [dict(zip(self.names, row[1:], strict=False)) for row in rows]
        yield self.moved(key[0], new, timerValues.getCurrentWatermarkInMs() - 1)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        yield self.moved(key[0], [], timerValues.getCurrentWatermarkInMs() - 1)

    def close(self) -> None:
        pass


class DelegationFold(OrderedFold):
    """The delegation of each delegator, by the rules of ``folds.delegation_fold``. Powers are whole numbers of any size, as text."""

    key = "delegator"
    events = "pos long, at_ms long, kind string, from_delegate string, to_delegate string, delta string"
    held = "segment long, before string, delegate string, power string"
    told = "delegator long, segment long, delegate string, power string, is_current boolean"

    def __init__(self, zero: str = ZERO_ADDRESS, saturating: bool = False):
        self.zero, self.saturating = zero, saturating

    def start(self) -> State:
        return {"segment": 0, "before": None, "delegate": None, "power": "0"}

    def step(self, state: State, row: State) -> None:
        target, source = row["to_delegate"], row["from_delegate"]
        if row["kind"] == "change":
            again = state["before"] == target and (source is None or target is None or source == target != self.zero)
            if not again:
                state |= {"segment": state["segment"] + 1, "delegate": target, "power": "0"}
            state["before"] = target if target is not None else state["before"]
        elif state["segment"] and row["delta"] is not None and (target is None or target == state["delegate"]):
            power = int(state["power"]) + int(row["delta"])
            state["power"] = str(max(power, 0) if self.saturating else power)

    def tell(self, key: object, state: State) -> State:
        current = state["segment"] > 0 and state["delegate"] is not None and state["delegate"] != self.zero
        return state | {"delegator": key, "is_current": current}


class RefreshTasks(OrderedFold):
    """The refresh task of each account. Kinds of rows: ``seen`` (something happened to the account in a block), ``run`` (a worker looks for work),
    ``ok`` and ``error`` (it reports on the task that it holds). A lock that outlives its lease is given up by a timer."""

    key = "account"
    events = "pos long, at_ms long, kind string, block long, error string"
    held = "status string, attempts long, next_run_at long, locked_at long, again boolean, again_block long, first_block long, last_block long, error string, processed_at long"
    told = "account long, status string, attempts long, next_run_at long, locked_at long, again boolean, first_block long, last_block long, error string"

    def __init__(self, rules: Rules):
        self.rules = rules

    def start(self) -> State:
        return dict.fromkeys(c.split()[0] for c in self.held.split(", ")) | {"attempts": 0, "again": False}

    def wake(self, state: State) -> int | None:
        lost = state["status"] == "processing" and state["locked_at"] is not None and state["attempts"] >= self.rules.max_attempts
        return state["locked_at"] + self.rules.lease_ms if lost else None

    def woken(self, state: State) -> None:
        self.rules.swept(state, state["locked_at"] + self.rules.lease_ms)

    def step(self, state: State, row: State) -> None:
        now = row["at_ms"]
        if row["kind"] == "seen":
            self.rules.enqueued(state, now, row["block"])
        elif row["kind"] == "run":
            self.rules.swept(state, now)
            self.rules.claimed(state, now)
        elif row["kind"] == "ok":
            self.rules.completed(state, now)
        elif row["kind"] == "error":
            self.rules.failed(state, now, row["error"])

    def tell(self, key: object, state: State) -> State:
        return state | {"account": key}


def folded(stream: DataFrame, fold: OrderedFold, delay: str) -> DataFrame:
    """The told row of each key whenever one of its rows came or its timer rang. ``at_ms`` (0 or more) is the event time; for Spark it is a millisecond
    later, as what is at the epoch is late from the start."""
    columns = [c.split()[0] for c in fold.events.split(", ")]
    rows = stream.select(fold.key, *columns, F.timestamp_millis(F.col("at_ms") + 1).alias("event_time")).withWatermark("event_time", delay)
    return rows.groupBy(fold.key).transformWithState(fold, fold.told, "Update", "EventTime")
