"""Event streams: repeats, age limits, request limits, subscription state.

Every operator has a batch twin that gives the same answer on a finished input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MEMORY_HOURS = 24
STRETCH = 8
MAX_AGE_SECONDS, MAX_AHEAD_SECONDS = 300, 30

# Requests allowed per window, by kind of request.
REQUEST_LIMITS = {
    "global": ("15 minutes", 200),
    "auth": ("15 minutes", 10),
    "upload": ("1 hour", 50),
    "voice": ("5 minutes", 30),
    "ai": ("1 hour", 100),
}


# --- repeats ----------------------------------------------------------------


def drop_repeats(stream: DataFrame, event_id: str = "event_id", ts: str = "ts", hours: int = MEMORY_HOURS) -> DataFrame:
    """Drop events whose id was seen within the last ``hours`` (event time)."""
    return stream.withWatermark(ts, f"{hours} hours").dropDuplicatesWithinWatermark([event_id])


def first_sightings(
    events: DataFrame, event_id: str = "event_id", ts: str = "ts", hours: int = MEMORY_HOURS, stretch: int = STRETCH
) -> DataFrame:
    """Batch twin: (id, time) of the events kept.

    An event is kept when its id was not kept within the ``hours`` before; a
    repeat does not renew the memory.  Equal (id, time) rows are merged before the
    shuffle.  An id's times are cut into stretches of ``stretch`` times the
    memory, and each (id, stretch) is walked apart, so an id that holds much of
    the table is spread over tasks, gaps or none:

    1. What a stretch does to the memory it is entered with is a step function:
       only its first ``hours`` can be inside that memory, and walks that meet in
       one event go on as one.  A stretch gives one row per step.
    2. Per id these rows, at most one per event of a stretch's first ``hours``,
       are streamed through in order and say which memory enters each stretch.
    3. Each stretch is walked from there.

    A task holds the times of one (id, stretch), or of a batch of short ones.  Rows without
    an id are one id; those without a time are not kept.  Empty in, empty out.
    """
    span = hours * 3_600_000_000
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    times = (
        events.filter(F.col(ts).isNotNull())
        .select(F.col(event_id).alias("id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
        .distinct()
        .withColumn("stretch", F.expr(f"(us - pmod(us, {span * stretch})) div {span * stretch}"))
    )
    walked = f"id {kinds[event_id]}, stretch long, "
    steps = times.select("id", "stretch", "us").repartition("id", "stretch").sortWithinPartitions("id", "stretch", "us")
    steps = steps.mapInArrow(lambda batches: map(lambda b: _steps(b, span), _whole_groups(batches)), walked + "upto long, left long")
    entered = steps.repartition("id").sortWithinPartitions("id", "stretch", "upto")
    entered = entered.mapInArrow(lambda batches: _carried(batches, span, span * stretch), walked + "us long")
    # The memory comes first in its stretch: it is told from a time by its kind.
    both = times.select("id", "stretch", F.lit(1).alias("kind"), "us").unionByName(entered.withColumn("kind", F.lit(0)))
    both = both.repartition("id", "stretch").sortWithinPartitions("id", "stretch", "kind", "us")
    kept = both.mapInArrow(lambda batches: map(lambda b: _walk(b, span), _whole_groups(batches)), walked + "us long")
    return kept.select(F.col("id").alias(event_id), F.timestamp_micros("us").cast(kinds[ts]).alias(ts))


def _starts(batch: pa.RecordBatch, keys: tuple[str, ...] = ("id", "stretch")) -> np.ndarray:
    """Where a row of a sorted batch differs from the one before in its keys; the first does."""
    new = np.ones(batch.num_rows, bool)
    codes = [pc.fill_null(pc.dictionary_encode(batch.column(k)).indices, -1).to_numpy(zero_copy_only=False) for k in keys]
    new[1:] = np.any([c[1:] != c[:-1] for c in codes], axis=0)
    return new


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by id and stretch, cut anew so that none ends inside a group."""
    joined = lambda parts: pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    last_key = lambda batch, i: (batch.column("id")[i].as_py(), batch.column("stretch")[i].as_py())
    pending: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        last = int(np.flatnonzero(_starts(batch))[-1])
        if last == 0 and pending and last_key(pending[-1], pending[-1].num_rows - 1) == last_key(batch, 0):
            pending.append(batch)
            continue
        if last or pending:
            yield joined([*pending, batch.slice(0, last)])
        pending = [batch.slice(last)]
    if pending:
        yield joined(pending)


def _placed(batch: pa.RecordBatch, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Times of all groups on one axis, more than ``span`` apart from group to group; group of each row; what was added."""
    us = batch.column("us").to_numpy()
    starts = _starts(batch)
    group = np.cumsum(starts) - 1
    low = np.minimum.reduceat(us, np.flatnonzero(starts))
    high = np.maximum.reduceat(us, np.flatnonzero(starts))
    ends = np.cumsum(high - low + 2 * span)
    shift = (np.append(0, ends[:-1]) - low)[group]
    return us + shift, group, shift


def _steps(batch: pa.RecordBatch, span: int) -> pa.RecordBatch:
    """Stretches as step functions: entered with a memory that ends before ``upto``, one is left with the event ``left``.

    Each walk starts at a time of a stretch's first ``span``, or at the first time after it; all go on side by side.
    """
    at, group, shift = _placed(batch, span)
    begins = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    before = np.append(at[0], at[:-1])
    first = np.flatnonzero((before - at[begins][group] <= span) | (np.arange(len(at)) == begins[group]))
    place, going = first.copy(), np.arange(len(first))
    while len(going):
        ahead = np.searchsorted(at, at[place[going]] + span, side="right")
        goes = ahead < len(at)
        goes[goes] = group[ahead[goes]] == group[place[going[goes]]]
        going, ahead = going[goes], ahead[goes]
        place[going] = ahead
    # Walks that end in the same event are one step; its largest start bounds it.
    last = np.append(place[1:] != place[:-1], True)
    first, place = first[last], place[last]
    rows = batch.take(pa.array(first))
    return pa.RecordBatch.from_arrays(
        [rows.column("id"), rows.column("stretch"), rows.column("us"), pa.array(at[place] - shift[place])], names=["id", "stretch", "upto", "left"]
    )


def _carried(batches: Iterator[pa.RecordBatch], span: int, length: int) -> Iterator[pa.RecordBatch]:
    """From step rows in the order of an id: the memory's end with which a stretch is entered, where it reaches into it."""
    last_id, memory, seen, settled = object(), None, None, None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        begins = np.flatnonzero(_starts(batch))
        of_id = np.cumsum(_starts(batch, ("id",)))[begins].tolist()
        stretches = batch.column("stretch").to_numpy()[begins].tolist()
        upto, left = batch.column("upto").to_numpy(), batch.column("left").to_numpy()
        ends = np.append(begins[1:], batch.num_rows).tolist()
        now = of_id[0] if batch.column("id")[0].as_py() == last_id else None
        rows: list[int] = []
        memories: list[int] = []
        for own, stretch, start, end in zip(of_id, stretches, begins.tolist(), ends):
            if own != now:
                now, memory, seen, settled = own, None, None, None
            if seen != stretch and memory is not None and memory >= stretch * length:
                rows.append(start)
                memories.append(memory)
            seen = stretch
            # A stretch's steps may go on in the next batch; with none left, the memory outlasts the stretch.
            if settled != stretch:
                i = start if memory is None else start + int(np.searchsorted(upto[start:end], memory, side="right"))
                if i < end:
                    memory, settled = int(left[i]) + span, stretch
        last_id = batch.column("id")[batch.num_rows - 1].as_py()
        picked = batch.take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [picked.column("id"), picked.column("stretch"), pa.array(memories, pa.int64())], names=["id", "stretch", "us"]
        )


def _walk(batch: pa.RecordBatch, span: int) -> pa.RecordBatch:
    """The times kept in each stretch, from the memory it is entered with, if any."""
    at, group, _ = _placed(batch, span)
    is_time = batch.column("kind").to_numpy() == 1
    begins = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    rows = np.flatnonzero(is_time)
    times, of = at[rows], group[rows]
    place = np.where(is_time[begins], np.searchsorted(rows, begins), 0)
    entered = ~is_time[begins]
    lows = np.searchsorted(of, np.flatnonzero(entered), side="left")
    highs = np.searchsorted(of, np.flatnonzero(entered), side="right")
    place[entered] = [lo + int(np.searchsorted(times[lo:hi], m, side="right")) for lo, hi, m in zip(lows, highs, at[begins[entered]])]
    wanted = np.arange(len(begins))
    kept = []
    while len(place):
        goes = place < len(times)
        goes[goes] = of[place[goes]] == wanted[goes]
        place, wanted = place[goes], wanted[goes]
        kept.append(place)
        place = np.searchsorted(times, times[place] + span, side="right") if len(place) else place
    found = np.sort(np.concatenate(kept)) if kept else np.zeros(0, np.int64)
    return batch.take(pa.array(rows[found])).select(["id", "stretch", "us"])


# --- age --------------------------------------------------------------------


def age_verdict(event_ts: Column, seen_ts: Column) -> Column:
    """``ok``, ``too_old`` (over 5 minutes) or ``in_future`` (over 30 seconds ahead)."""
    age = F.unix_timestamp(seen_ts) - F.unix_timestamp(event_ts)
    return (
        F.when(age > MAX_AGE_SECONDS, "too_old").when(age < -MAX_AHEAD_SECONDS, "in_future").otherwise("ok")
    )


# --- request limits ---------------------------------------------------------


def over_limit(requests: DataFrame, key: str, ts: str, window: str, limit: int) -> DataFrame:
    """Keys with more than ``limit`` requests in a fixed window (batch or stream).

    On a stream put a watermark on ``ts`` before.  Windows are aligned to the clock.
    """
    return (
        requests.groupBy(F.window(ts, window).alias("w"), F.col(key))
        .agg(F.count(F.lit(1)).alias("requests"))
        .filter(F.col("requests") > limit)
        .select(key, F.col("w.start").alias("window_start"), "requests", (F.col("requests") - limit).alias("refused"))
    )


def over_request_limit(requests: DataFrame, kind: str, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """``over_limit`` with the window and limit of a kind of request (``REQUEST_LIMITS``)."""
    window, limit = REQUEST_LIMITS[kind]
    return over_limit(requests, key, ts, window, limit)


# --- subscription state -----------------------------------------------------

# Which event kinds set which field.
STARTS = ("subscription.created", "subscription.activated")
SETS = {
    "active": (*STARTS, "subscription.canceled"),
    "plan": (*STARTS, "subscription.updated"),
    "status": (*STARTS, "subscription.updated", "subscription.canceled", "subscription.past_due"),
    "renews_at": (*STARTS, "subscription.updated"),
    "subscription_id": STARTS,
    "canceled_at": (*STARTS, "subscription.canceled"),
}


def _event_value(field: str) -> Column:
    kind = F.col("event_type")
    if field == "active":
        return kind != "subscription.canceled"
    if field == "status":
        return (
            F.when(kind == "subscription.canceled", "canceled")
            .when(kind == "subscription.past_due", "past_due")
            .otherwise(F.col("status"))
        )
    if field == "canceled_at":
        return F.when(kind == "subscription.canceled", F.col("canceled_at"))
    return F.col(field)


def subscription_state(events: DataFrame, user: str = "user_id", order: list[str] | None = None) -> DataFrame:
    """Latest subscription record per user.

    An activation sets every field and the other events some of them, so each
    field is the value of the last event that sets it: one aggregation with a
    maximum per field, no ordered walk through a user's events.  An update
    without a plan leaves the plan.
    """
    at = F.struct(*(order or ["ts"]))
    aggs = []
    for name, kinds in SETS.items():
        sets = F.col("event_type").isin(*kinds)
        if name == "plan":
            sets = sets & (F.col("event_type").isin(*STARTS) | F.col("plan").isNotNull())
        # The value travels in a struct, so a NULL set on purpose also counts.
        boxed = F.when(sets, F.struct(_event_value(name).alias("v")))
        aggs.append(F.max_by(boxed, F.when(sets, at))["v"].alias(name))
    touching = events.filter(F.col("event_type").isin(*SETS["status"]))
    return touching.groupBy(user).agg(*aggs)


SUBSCRIPTION_STATE = (
    "active boolean, plan string, status string, renews_at string, subscription_id string, canceled_at string"
)
_FIELDS = tuple(p.split()[0] for p in SUBSCRIPTION_STATE.split(", "))


class SubscriptionProcessor(StatefulProcessor):
    """Stream form: keeps, per user and field, the value and when it was set; emits the record after each batch.

    A field is overwritten only by a later event (time, then event id), so events
    may arrive in any order, in one batch or in several, and the record is that
    of ``subscription_state`` over all of them.  Rows are read chunk by chunk.

    With ``idle_us`` a user's record is forgotten once the watermark is that far
    behind the user's newest event: one timer per user, moved with each batch that
    brings a newer event.
    """

    def __init__(self, idle_us: int | None = None) -> None:
        self.idle_us = idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        times = ", ".join(f"{f}_us long, {f}_id long" for f in _FIELDS)
        self.handle = handle
        self.record = handle.getValueState("record", f"{SUBSCRIPTION_STATE}, {times}")
        if self.idle_us is not None:
            self.newest = handle.getValueState("newest", "us long, timer_ms long")

    def _move_timer(self, newest: int, watermark_ms: int) -> None:
        known = self.newest.get() if self.newest.exists() else None
        if known is not None and known[0] >= newest:
            return
        if known is not None:
            self.handle.deleteTimer(known[1])
        # Rounded up, and never behind the watermark, where a timer would not fire.
        timer = max(-(-(newest + self.idle_us) // 1000), watermark_ms + 1)
        self.handle.registerTimer(timer)
        self.newest.update((newest, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.record.clear()
        self.newest.clear()
        return iter(())

    def handleInputRows(self, key, rows, timerValues):
        kept = self.record.get() if self.record.exists() else None
        n = len(_FIELDS)
        record = list(kept[:n]) if kept else [None] * n
        since = [(kept[n + 2 * i], kept[n + 2 * i + 1]) for i in range(n)] if kept else [(None, None)] * n
        newest = None
        for chunk in rows:
            times = chunk["ts"].astype("datetime64[us]").astype("int64")
            newest = max(times) if newest is None else max(newest, max(times))
            for e, us in zip(chunk.itertuples(index=False), times):
                value = lambda name: None if pd.isna(getattr(e, name)) else getattr(e, name)
                at = (int(us), int(e.event_id))
                for i, (field, new) in enumerate(_fields_set(e.event_type, value)):
                    if new is not _KEEP and (since[i][0] is None or at > since[i]):
                        record[i], since[i] = new, at
        self.record.update((*record, *[x for at in since for x in at]))
        if self.idle_us is not None:
            self._move_timer(int(newest), timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame({"user_id": [key[0]], **{f: [v] for f, v in zip(_FIELDS, record)}})

    def close(self) -> None:
        pass


_KEEP = object()


def _fields_set(kind: str, value) -> list[tuple]:
    """What an event of this kind sets, field by field; ``_KEEP`` where it sets nothing."""
    out = dict.fromkeys(_FIELDS, _KEEP)
    for name, kinds in SETS.items():
        if kind not in kinds or name == "plan" and kind not in STARTS and value("plan") is None:
            continue
        if name == "active":
            out[name] = kind in STARTS
        elif name == "status":
            fixed = {"subscription.canceled": "canceled", "subscription.past_due": "past_due"}
            out[name] = fixed.get(kind) or value("status")
        elif name == "canceled_at":
            out[name] = value("canceled_at") if kind == "subscription.canceled" else None
        else:
            out[name] = value(name)
    return list(out.items())


def subscription_stream(stream: DataFrame, idle: str | None = None, late: str = "1 day") -> DataFrame:
    """Records per user as the stream goes on (needs the RocksDB state store).

    Without ``idle`` every user's record is kept for good.  With it (``"400 days"``)
    a user without events for that long is forgotten, so the state holds the users of
    the last ``idle`` + ``late`` only: the last record in the sink stands, and a user
    who comes back starts from an empty one.  Events more than ``late`` behind the
    newest are then dropped, as a watermark does.
    """
    us = None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1_000_000)
    timed = stream if idle is None else stream.withWatermark("ts", late)
    return timed.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=SubscriptionProcessor(us),
        outputStructType=f"user_id long, {SUBSCRIPTION_STATE}",
        outputMode="Update",
        timeMode="None" if idle is None else "EventTime",
    )
