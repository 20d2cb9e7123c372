"""The state machine in batch and in a stream: late rows, timers, and a restart from the checkpoint."""

import random
from datetime import datetime, timedelta

import pytest

from quiltwork.streaming.freshness import freshness, freshness_stream

START = datetime(2024, 1, 1)
SHAPE = "user string, ts timestamp, kind string"


def at(seconds):
    return START + timedelta(seconds=seconds)


def followed(rows, quiet):
    """The machine, event by event."""
    out = []
    order = ["published", "updated", "change", "publish", "update", "quiet"]
    for user in sorted({r[0] for r in rows}):
        left = sorted((t, order.index(k), k) for u, t, k in rows if u == user)
        publishing = updating = stale = False
        due = None
        state = lambda: "Publishing" if publishing else "Updating" if updating else "Stale" if stale else "Ok"
        while left or due is not None:
            if due is not None and (not left or due < left[0][0]):
                t, k = due, "quiet"
            else:
                t, _, k = left.pop(0)
            before = state()
            if k == "publish" or k == "published":
                publishing = k == "publish"
            elif k == "updated":
                updating = False
            elif k == "change":
                stale, due = True, t + timedelta(seconds=quiet)
            else:
                updating, stale, due = True, False, None
            if state() != before:
                out.append((user, t, before, state()))
    return out


def events_of(seed, n=120):
    r = random.Random(seed)
    return sorted(((r.choice("abc"), at(r.randrange(0, 3000) / 2), r.choice(["change", "change", "update", "updated", "publish", "published"])) for _ in range(n)), key=lambda e: e[1])


@pytest.mark.parametrize("seed", range(4))
def test_batch(spark, seed):
    rows = list(dict.fromkeys(events_of(seed)))
    df = spark.createDataFrame([*rows, ("a", None, "change"), ("a", at(3), "other")], SHAPE)
    assert sorted(map(tuple, freshness(df, "user", "ts", "kind", 20_000).collect())) == sorted(followed(rows, 20))


def test_stream(spark, tmp_path):
    """Batches with rows out of order within the lateness, stopped and started again between them, give what the batch operator gives."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = list(dict.fromkeys(events_of(9)))
    r = random.Random(3)
    shuffled = [e for k in range(0, len(rows), 40) for e in r.sample(rows[k : k + 40], len(rows[k : k + 40]))]
    # Events far ahead push the watermark on, so that all timers come.
    batches = [shuffled[:40], shuffled[40:80], shuffled[80:], [("z", at(100_000), "publish")], [("z", at(200_000), "published")]]
    found = tmp_path / "out"
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, SHAPE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k in (1, 2, 4):
            stream = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            query = freshness_stream(stream, "user", "ts", "kind", 20_000, "2000 seconds").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint")).option("path", str(found)).trigger(availableNow=True).start()
            query.awaitTermination(120)
    got = sorted(tuple(x) for x in spark.read.parquet(str(found)).where("user != 'z'").select("user", "ts", "before", "after").collect())
    assert got == sorted(followed(rows, 20))
