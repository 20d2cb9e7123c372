"""Change events: bursts, repeated messages, state changes, snapshots. Each batch operator has a streaming twin."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def bursts(events: DataFrame, key: str, time: str, gap_seconds: float) -> DataFrame:
    """key, burst, events, first, last: events of a key less than a gap apart are one burst; bursts are numbered from 0."""
    order = Window.partitionBy(key).orderBy(time)
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    late = micros - F.lag(micros).over(order) >= int(gap_seconds * 1_000_000)
    marked = events.withColumn("_new", F.coalesce(late, F.lit(False)).cast("long"))
    marked = marked.withColumn("burst", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "burst").agg(F.count("*").alias("events"), F.min(time).alias("first"), F.max(time).alias("last"))


def bursts_stream(events: DataFrame, key: str, time: str, gap_seconds: int, late_seconds: int) -> DataFrame:
    """bursts() of a stream: session windows that close when the watermark has passed the gap."""
    window = F.session_window(time, f"{gap_seconds} seconds")
    found = events.withWatermark(time, f"{late_seconds} seconds").groupBy(key, window).agg(F.count("*").alias("events"), F.min(time).alias("first"), F.max(time).alias("last"))
    return found.select(key, "events", "first", "last")


def without_repeats(events: DataFrame, key: str, order: list[str], columns: list[str], newest: int | None = None) -> DataFrame:
    """Events that differ in columns from the one before of their key; with newest, only so many of the last of a key."""
    window = Window.partitionBy(key).orderBy(*order)
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(window))
    first = F.row_number().over(window) == 1
    kept = events.withColumn("_keep", first | ~same).where("_keep").drop("_keep")
    if newest is None:
        return kept
    back = F.row_number().over(Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order]))
    return kept.withColumn("_back", back).where(F.col("_back") <= newest).drop("_back")


def transitions(events: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """key, at (the order columns), before, after: the points where a key's state changes; before is null at its first."""
    window = Window.partitionBy(key).orderBy(*order)
    marked = events.select(key, *order, F.lag(state).over(window).alias("before"), F.col(state).alias("after"))
    return marked.where(~F.col("before").eqNullSafe(F.col("after")))


def transitions_stream(events: DataFrame, key: str, time: str, state: str) -> DataFrame:
    """transitions() of a stream: the last state of each key is kept between batches."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    kind = dict(events.dtypes)[key]

    def follow(name: tuple, parts: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        (last,) = held.get if held.exists else (None,)
        rows = pd.concat(list(parts)).sort_values(time, kind="stable")
        out = []
        for at, now in zip(rows[time], rows[state], strict=True):
            if now != last:
                out.append((name[0], at, last, now))
                last = now
        held.update((last,))
        yield pd.DataFrame(out, columns=[key, time, "before", "after"])

    return events.groupBy(key).applyInPandasWithState(follow, f"{key} {kind}, {time} timestamp, before string, after string", "last string", "append", GroupStateTimeout.NoTimeout)


def running_share(steps: DataFrame, key: list[str], order: str, weight: str) -> DataFrame:
    """steps with done: the share of all weights of the key up to and with the step."""
    part = Window.partitionBy(*key)
    upto = F.sum(weight).over(part.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return steps.withColumn("done", upto / F.sum(weight).over(part))


def newest_snapshot(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last event of each key: the table that a log of changes leaves."""
    columns = [c for c in events.columns if c != key]
    best = events.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_last"))
    return best.select(key, *[F.col(f"_last.{c}").alias(c) for c in columns])


def watched(spark: SparkSession, folder: str, pattern: str = "*", per_batch: int = 1000) -> DataFrame:
    """A stream of the files that come to a folder: path, modificationTime, length, content; so many in a batch at most."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_batch).load(folder)


def retries(events: DataFrame, key: str, order: list[str], kind: str, change: str, failure: str) -> DataFrame:
    """key, the order columns and action, for each failure: retry for the first since the key last changed, wait for later ones."""
    upto = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = events.where(F.col(kind).isin(change, failure)).withColumn("_since", F.sum((F.col(kind) == change).cast("long")).over(upto))
    failed = marked.where(F.col(kind) == failure).withColumn("_nth", F.row_number().over(Window.partitionBy(key, "_since").orderBy(*order)))
    return failed.select(key, *order, F.when(F.col("_nth") == 1, "retry").otherwise("wait").alias("action"))


def retries_stream(events: DataFrame, key: str, time: str, kind: str, change: str, failure: str, forget_ms: int = 86_400_000) -> DataFrame:
    """retries() of a stream: whether a key has been retried since its last change is kept, and forgotten after a time without events."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def follow(name: tuple, parts: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        (tried,) = held.get if held.exists else (False,)
        out = []
        for part in [pd.concat(list(parts)).sort_values(time, kind="stable")]:
            for at, what in zip(part[time], part[kind], strict=True):
                if what == failure:
                    out.append((name[0], at, "wait" if tried else "retry"))
                tried = what == failure or tried and what != change
        held.update((tried,))
        held.setTimeoutDuration(forget_ms)
        yield pd.DataFrame(out, columns=[key, time, "action"])

    schema = f"{key} {dict(events.dtypes)[key]}, {time} timestamp, action string"
    return events.groupBy(key).applyInPandasWithState(follow, schema, "tried boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)
