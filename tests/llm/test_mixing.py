import random

import numpy as np
from pyspark.sql import functions as F

from quiltwork.llm.mixing import MixOptions, fill_targets, mix, plan_mix, shard_ranges


def test_targets():
    assert fill_targets([100, 100, 100], [5, 2, 1], 3) == [187.5, 75.0, 37.5]
    assert fill_targets([10, 100, 100], [5, 2, 1], 3) == [30.0, 120.0, 60.0]
    assert fill_targets([0, 5], [5, 2], 3) == [0.0, 5.0] and fill_targets([], [], 3) == []


def test_tree_deals_every_block_once():
    quotas = [17, 0, 5, 120]
    ranges = [shard_ranges(k, 9, quotas, 3) for k in range(9)]
    for source, n in enumerate(quotas):
        covered = sorted(i for r in ranges for i in range(r[source][0], r[source][0] + r[source][1]))
        assert covered == list(range(n))
    totals = [sum(n for _, n in r) for r in ranges]
    assert max(totals) - min(totals) <= 5 and ranges == [shard_ranges(k, 9, quotas, 3) for k in range(9)]


def rows(seed=1):
    r = random.Random(seed)
    out = [(k, "w " * r.choice([0, 1, 3, 20, 100]), r.choice(["a", "a", "a", "b", "c", "é", None])) for k in range(500)]
    return out + [(900, None, "b"), (901, "x", "tiny"), (901, "x", "tiny"), (None, "y z", "a")]


def test_plan(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as rank", "3 as key")
    for options in (MixOptions(), MixOptions(block_words=60, shard_words=700), MixOptions(weights=(1, 50), block_words=10)):
        found = plan_mix(docs, options).collect()
        assert len(found) == len(rows())
        sizes, taken, target, biggest = {}, {}, {}, {}
        for r in found:
            assert r.size == len((dict((d, t) for d, t, _ in rows())[r.doc_id] or "").split())
            assert r.taken == r.size * len(r.copies) and r.taken <= 3 * r.size and len({c.epoch for c in r.copies}) == len(r.copies)
            sizes[r.source], taken[r.source] = sizes.get(r.source, 0) + r.size, taken.get(r.source, 0) + r.taken
            target[r.source], biggest[r.source] = r.target, max(biggest.get(r.source, 0), r.size)
        names = sorted(sizes, key=lambda s: (s is None, s or ""))
        want = fill_targets([sizes[s] for s in names], [options.weights[k % len(options.weights)] for k in range(len(names))], 3)
        assert np.allclose([target[s] for s in names], want)
        assert all(r.source_size == sizes[r.source] for r in found)
        assert all(abs(taken[s] - target[s]) <= biggest[s] for s in names)
        assert sorted(map(str, plan_mix(docs.repartition(7), options).collect())) == sorted(map(str, found))


def test_mix_repeats_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (2, "c", "t")], "doc_id long, text string, source string")
    plan = {r.doc_id: len(r.copies) for r in plan_mix(docs).collect()}
    found = mix(docs)
    assert found.columns == ["doc_id", "text", "source", "epoch", "shard", "place"]
    got = [r.doc_id for r in found.collect()]
    assert {k: got.count(k) for k in plan} == plan
    assert plan_mix(docs.limit(0)).collect() == []


def test_mix_goes_by_row(spark):
    r = random.Random(4)
    rows = [(r.choice([None, 1, 2, k]), f"t{k} " * r.choice([1, 3, 9]), r.choice("abc")) for k in range(300)] + [(None, "same", "c")] * 20 + [(None, None, "a")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    options = MixOptions(block_words=50)
    plan = plan_mix(docs, options).collect()
    taken, target, biggest = {}, {}, {}
    for x in mix(docs, options).collect():
        taken[x.source] = taken.get(x.source, 0) + len((x.text or "").split())
    for x in plan:
        target[x.source], biggest[x.source] = x.target, max(biggest.get(x.source, 0), x.size)
    assert all(abs(taken.get(s, 0) - target[s]) <= biggest[s] for s in target)
    want = sorted((str(x.doc_id), x.source, x.size) for x in plan for _ in x.copies)
    assert sorted((str(x.doc_id), x.source, len((x.text or "").split())) for x in mix(docs, options).collect()) == want


def test_shards_are_shuffled_within(spark):
    docs = spark.createDataFrame(rows(3), "doc_id long, text string, source string")
    options = MixOptions(block_words=60, shard_words=700)
    found = mix(docs, options).withColumn("task", F.spark_partition_id()).collect()
    shards = {x.shard for x in found}
    assert len(shards) > 10
    for shard in shards:
        own = [x for x in found if x.shard == shard]
        assert len({x.task for x in own}) == 1 and [x.place for x in own] == sorted(x.place for x in own) and [x.doc_id for x in own] != sorted(str(x.doc_id) for x in own)
    # The tree deals every source over all shards, by its quotas.
    words = sum(len((x.text or "").split()) for x in found)
    assert all(abs(sum(len((x.text or "").split()) for x in found if x.shard == shard) - words / len(shards)) < 0.6 * words / len(shards) for shard in shards)


def test_small_tables_are_dealt_by_the_tree(spark):
    """Shards get what a direct walk of the tree says: block by block, and each about its share."""
    from collections import Counter

    docs = spark.createDataFrame([(k, " ".join(["w"] * 50), f"s{k % 3}") for k in range(3000)], "doc_id long, text string, source string")
    o = MixOptions(block_words=500)
    rows = plan_mix(docs, o).collect()
    dealt = Counter((c.shard, r.source) for r in rows for c in r.copies)
    assert {s for s, _ in dealt} == set(range(8))
    words = Counter()
    for (shard, _), n in dealt.items():
        words[shard] += n
    even = sum(words.values()) / 8
    assert all(0.7 * even < n < 1.3 * even for n in words.values())
    one = plan_mix(docs, MixOptions(block_words=500, least_shards=1)).collect()
    assert {c.shard for r in one for c in r.copies} == {0} and sorted((r.doc_id, r.taken) for r in one) == sorted((r.doc_id, r.taken) for r in rows)
