"""Approval items under review: lock, renew, release, approve, reject.

The transition of one item is a small pure function; the stream keeps its state
per item, the batch twin streams the sorted actions of each item through it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LOCK_SECONDS = 30
STATE = "status string, locked_by string, locked_until_us long"
OUTCOME = "approval_id long, action_id long, action string, actor string, outcome string, status string"

_START = ("pending", None, None)


def act(state: tuple, action: str, actor: str, now_us: int) -> tuple[tuple, str]:
    """New state and outcome of one action on one item."""
    status, owner, until = state
    resolved = status in ("approved", "rejected")
    held = status == "locked" and owner is not None and owner != actor and until is not None and until >= now_us
    mine = status == "locked" and owner == actor
    lock_end = now_us + LOCK_SECONDS * 1_000_000

    if action == "lock":
        if resolved:
            return state, "already_resolved"
        return (state, "locked_by_other") if held else (("locked", actor, lock_end), "locked")
    if action == "renew":
        return (("locked", actor, lock_end), "renewed") if mine else (state, "not_held")
    if action == "release":
        return (_START, "released") if mine else (state, "ignored")
    if action == "approve" and held:
        return state, "locked_by_other"
    if action in ("approve", "reject"):
        if resolved:
            return state, "already_resolved"
        done = "approved" if action == "approve" else "rejected"
        return (done, None, None), done
    return state, "unknown_action"


def _micros(column: pd.Series) -> pd.Series:
    return column.astype("datetime64[us]").astype("int64")


class ApprovalProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.item = handle.getValueState("item", STATE)

    def handleInputRows(self, key, rows, timerValues):
        state = tuple(self.item.get()) if self.item.exists() else _START
        batch = pd.concat(list(rows)).sort_values(["ts", "action_id"])
        out = []
        for a, actor, i, t in zip(batch["action"], batch["actor"], batch["action_id"], _micros(batch["ts"])):
            state, outcome = act(state, a, actor, int(t))
            out.append((key[0], i, a, actor, outcome, state[0]))
        self.item.update(state)
        yield pd.DataFrame(out, columns=["approval_id", "action_id", "action", "actor", "outcome", "status"])

    def close(self) -> None:
        pass


def approval_stream(actions: DataFrame) -> DataFrame:
    """Outcome per action (approval_id, action_id, ts, action, actor); needs the RocksDB state store."""
    return actions.groupBy("approval_id").transformWithStateInPandas(
        statefulProcessor=ApprovalProcessor(),
        outputStructType=OUTCOME,
        outputMode="Append",
        timeMode="None",
    )


class TimedApprovalProcessor(StatefulProcessor):
    """Holds the actions of an item until the watermark has passed them, then applies them in the order of their times."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", STATE)
        self.held = handle.getMapState("held", "us long, action_id long", "action string, actor string")

    def handleInputRows(self, key, rows, timerValues):
        for chunk in rows:
            for a, actor, i, t in zip(chunk["action"], chunk["actor"], chunk["action_id"], _micros(chunk["ts"])):
                self.held.updateValue((int(t), int(i)), (a, actor))
                self.handle.registerTimer(int(t) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        until = expiredTimerInfo.getExpiryTimeInMs() * 1000
        due = sorted((k, v) for k, v in self.held.iterator() if k[0] < until)
        state = tuple(self.item.get()) if self.item.exists() else _START
        out = []
        for (us, number), (action, actor) in due:
            state, outcome = act(state, action, actor, us)
            out.append((key[0], number, action, actor, outcome, state[0]))
            self.held.removeKey((us, number))
        if due:
            self.item.update(state)
        yield pd.DataFrame(out, columns=["approval_id", "action_id", "action", "actor", "outcome", "status"])

    def close(self) -> None:
        pass


def timed_approval_stream(actions: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Outcome per action in the order of the actions' times, however they arrive within ``delay``.

    An action is answered once the watermark has passed it; what comes later than ``delay`` is dropped, as by any
    watermark.  The answers are those of ``approval_outcomes`` over the same actions.  ``action_id`` tells actions of
    one time apart.
    """
    return actions.withWatermark("ts", delay).groupBy("approval_id").transformWithStateInPandas(
        statefulProcessor=TimedApprovalProcessor(),
        outputStructType=OUTCOME,
        outputMode="Append",
        timeMode="EventTime",
    )


def approval_outcomes(actions: DataFrame) -> DataFrame:
    """Batch twin: actions sorted per item by Spark, streamed through with one state at a time."""
    ordered = (
        actions.select("approval_id", "ts", "action_id", "action", "actor")
        .repartition("approval_id")
        .sortWithinPartitions("approval_id", "ts", "action_id")
    )

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        item, state = None, _START
        for b in batches:
            out = []
            for k, i, a, actor, t in zip(b["approval_id"], b["action_id"], b["action"], b["actor"], _micros(b["ts"])):
                if k != item:
                    item, state = k, _START
                state, outcome = act(state, a, actor, int(t))
                out.append((k, i, a, actor, outcome, state[0]))
            yield pd.DataFrame(out, columns=["approval_id", "action_id", "action", "actor", "outcome", "status"])

    return ordered.mapInPandas(fold, OUTCOME)
