"""Whether what was published is up to date, derived from events, in batch and in streams.

A key's events are change (of an input), update and updated (a preview begins and ends), publish and published. It is
Publishing between publish and published, else Updating between update and updated, else Stale if an input changed after the
last update began, else Ok. When changes have been quiet for a while an update begins of itself: that is a timer. Both
operators give a row where the state changes; a key begins as Ok.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Events of one time count in this order; a timer comes after what happened at its time.
KINDS = ("published", "updated", "change", "publish", "update", "quiet")
RESULT = "before string, after string"


def with_timers(events: DataFrame, key: str, time: str, kind: str, quiet_ms: int) -> DataFrame:
    """key, time, kind of the events that count, and of a quiet event where changes have been quiet so long.

    A change's quiet time ends unless another change comes before, or an update begins.
    """
    known = events.where(F.col(kind).isin(*KINDS[:-1]) & F.col(time).isNotNull()).select(key, F.col(time).alias("_t"), F.col(kind).alias("_k"))
    ahead = Window.partitionBy(key).orderBy("_t", rank_of("_k")).rowsBetween(1, Window.unboundedFollowing)
    after = F.first(F.when(F.col("_k").isin("change", "update"), F.col("_t")), ignorenulls=True).over(ahead)
    due = F.timestamp_micros(F.unix_micros("_t") + quiet_ms * 1000)
    timers = known.withColumn("_next", after).where((F.col("_k") == "change") & (F.col("_next").isNull() | (F.col("_next") > due)))
    return known.unionByName(timers.select(key, due.alias("_t"), F.lit("quiet").alias("_k")))


def rank_of(kind: str):
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col(kind))


def freshness(events: DataFrame, key: str, time: str, kind: str, quiet_ms: int) -> DataFrame:
    """key, time, before, after of a bounded table. Events of other kinds and without a time don't count."""
    upto = Window.partitionBy(key).orderBy("_t", "_r").rowsBetween(Window.unboundedPreceding, 0)
    rows = with_timers(events, key, time, kind, quiet_ms).withColumn("_r", rank_of("_k"))
    begun = lambda start, end: F.last(F.when(F.col("_k").isin(*start), True).when(F.col("_k") == end, False), ignorenulls=True).over(upto)
    # Of change and the beginning of an update, which came last.
    stale = F.last(F.when(F.col("_k") == "change", True).when(F.col("_k").isin("update", "quiet"), False), ignorenulls=True).over(upto)
    state = F.when(begun(["publish"], "published"), "Publishing").when(begun(["update", "quiet"], "updated"), "Updating").when(stale, "Stale").otherwise("Ok")
    told = rows.withColumn("after", state)
    before = F.coalesce(F.lag("after").over(Window.partitionBy(key).orderBy("_t", "_r")), F.lit("Ok"))
    return told.withColumn("before", before).where("before != after").select(key, F.col("_t").alias(time), "before", "after")


class Follower(StatefulProcessor):
    """Holds back events until the watermark has passed them, so late rows find their place; flags, the quiet time's end and what waits are a key's state."""

    def __init__(self, key: str, time: str, kind: str, quiet_ms: int, forget_ms: int):
        self.key, self.time, self.kind, self.quiet_ms, self.forget_ms = key, time, kind, quiet_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flags = handle.getValueState("flags", "publishing boolean, updating boolean, stale boolean, due bigint, last bigint")
        self.waiting = handle.getListState("waiting", "at bigint, kind string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for part in rows:
            part = part[part[self.kind].isin(KINDS[:-1]) & part[self.time].notna()]
            # Microseconds whatever the unit of the column.
            new += list(zip(part[self.time].astype("datetime64[us]").astype("int64").tolist(), part[self.kind].tolist(), strict=True))
        if new:
            self.waiting.appendList(new)
            for ms in sorted({at // 1000 + 1 for at, _ in new}):
                self.handle.registerTimer(ms)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        publishing, updating, stale, due, last = self.flags.get() if self.flags.exists() else (False, False, False, None, now)
        held = sorted(((int(at), k) for at, k in self.waiting.get()), key=lambda e: (e[0], KINDS.index(e[1])))
        ready, rest = [e for e in held if e[0] < now], [e for e in held if e[0] >= now]
        out = []

        def state() -> str:
            return "Publishing" if publishing else "Updating" if updating else "Stale" if stale else "Ok"

        # What happened, and the quiet times that ended between.
        while ready or (due is not None and due < now):
            if due is not None and due < now and (not ready or due < ready[0][0]):
                at, what = due, "quiet"
            else:
                at, what = ready.pop(0)
            before, last = state(), max(last, at)
            if what in ("publish", "published"):
                publishing = what == "publish"
            elif what == "updated":
                updating = False
            elif what == "change":
                stale, due = True, at + self.quiet_ms * 1000
            else:
                updating, stale, due = True, False, None
            if state() != before:
                out.append((key[0], pd.Timestamp(at, unit="us"), before, state()))
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        if due is not None:
            self.handle.registerTimer(due // 1000 + 1)
        idle = last + self.forget_ms * 1000
        if not rest and due is None and state() == "Ok" and idle < now:
            self.flags.clear()
        else:
            self.flags.update((publishing, updating, stale, due, last))
            if not rest and due is None and state() == "Ok":
                self.handle.registerTimer(idle // 1000 + 1)
        yield pd.DataFrame(out, columns=[self.key, self.time, "before", "after"])

    def close(self) -> None:
        pass


def freshness_stream(events: DataFrame, key: str, time: str, kind: str, quiet_ms: int, late: str = "10 seconds", forget_ms: int = 86_400_000) -> DataFrame:
    """freshness() of a stream: transitions come once the watermark has passed them, whatever order the events came in within the lateness.

    Needs the RocksDB state store. A key that has been Ok so long is forgotten; one that has no other events than late ones
    beyond the watermark never changes.
    """
    schema = f"{key} {dict(events.dtypes)[key]}, {time} timestamp, {RESULT}"
    rows = events.select(key, time, kind).withWatermark(time, late)
    return rows.groupBy(key).transformWithStateInPandas(Follower(key, time, kind, quiet_ms, forget_ms), schema, "append", "EventTime")
