"""Mixing sources to target weights.

Words are shared out among the sources by weight, no source beyond max_epochs times its size. Each source is cut into
blocks by a keyed hash of its documents, so that the order of its blocks is a random permutation; a target takes whole
passes over all blocks, then the first blocks that fit, then documents of the next block that fit. The drawn blocks are
dealt to output shards by a splitting tree: each node parts its exact block quotas between its two halves by a
multivariate hypergeometric draw, so every shard knows its quotas from the path to it and nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from quiltwork.llm.common import materialise, word_count


@dataclass(frozen=True)
class MixOptions:
    """weights repeat over the sources in code point order, null last. One source has at most max_blocks blocks. Small tables are dealt to least_shards too."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    max_epochs: int = 3
    block_words: int = 50_000
    max_blocks: int = 1 << 22
    shard_words: int = 5_000_000
    least_shards: int = 8
    seed: int = 17


def fill_targets(sizes: list[int], weights: list[float], max_epochs: int) -> list[float]:
    """Shares of all sizes by weight; what a source can't take goes to the others by weight, until none is above."""
    caps, total = [float(max_epochs * s) for s in sizes], float(sum(sizes))
    targets, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        weight = sum(weights[k] for k in open_)
        over = [k for k in open_ if total * weights[k] / weight > caps[k]]
        if not over:
            for k in open_:
                targets[k] = total * weights[k] / weight
            break
        for k in over:
            targets[k] = caps[k]
            total -= caps[k]
            open_.remove(k)
    return targets


def shard_ranges(shard: int, shards: int, quotas: list[int], seed: int) -> list[tuple[int, int]]:
    """For each source, the first of its drawn blocks that a shard gets, and how many.

    Walks from the root to the shard. At each node the left half gets its exact share of all blocks, drawn without
    replacement from the node's quotas; the generator's seed is the node, so all shards see the same draws.
    """
    low, high = 0, shards
    left_quota, start = np.array(quotas, np.int64), np.zeros(len(quotas), np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        node = hashlib.sha256(f"{seed}:{low}:{high}".encode()).digest()
        take = int(left_quota.sum()) * (middle - low) // (high - low)
        draw = np.random.Generator(np.random.PCG64(int.from_bytes(node[:16], "big"))).multivariate_hypergeometric(left_quota, take, method="marginals")
        if shard < middle:
            left_quota, high = draw, middle
        else:
            start, left_quota, low = start + draw, left_quota - draw, middle
    return list(zip(start.tolist(), left_quota.tolist(), strict=True))


def first_fit(block: pd.DataFrame) -> pd.DataFrame:
    """Documents of a block in keyed order, each taken once more if it still fits into what is left of the target.

    A row stands for n documents alike in id and text; the first more of them fit.
    """
    block = block.sort_values("key", kind="stable")
    left, extra = float(block["room"].iloc[0]), []
    for size, n in zip(block["size"], block["n"], strict=True):
        fits = max(0, min(int(n), int((left + 0.5) // size)))
        left -= size * fits
        extra.append(fits)
    block["more_of"] = extra
    return block


def plan_mix(docs: DataFrame, options: MixOptions = MixOptions(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken, copies.

    copies has for each time that the document is taken (never more than max_epochs times) the epoch, the shard and its
    place in the shard's local shuffle (shards are written sorted by place). Null texts have size 0; empty tables give no
    rows; null sources are one source, the last; rows alike in id and text share a place in the order. Repeated rows are separate
    documents; other columns are left out. Only one row per source goes through the driver.
    """
    rows = materialise(keyed(docs, options, id_col, text_col, source_col))
    return planned(rows, rows, options).select("doc_id", "source", "size", "source_size", "target", "taken", "copies")


def keyed(docs: DataFrame, o: MixOptions, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    """doc_id, source, size, the key of the order, and what else is asked for, of each row."""
    named = F.concat(F.lit(f"{o.seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.xxhash64(text_col).cast("string"))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.md5(named).alias("key"), *more)


def planned(rows: DataFrame, carried: DataFrame, o: MixOptions) -> DataFrame:
    """The rows of carried (keyed, of the same documents as rows, which are read several times) with the columns of the plan."""
    spark = rows.sparkSession
    sums = sorted(rows.groupBy("source").agg(F.sum("size").alias("size")).collect(), key=lambda r: (r.source is None, (r.source or "").encode()))
    weights = [o.weights[k % len(o.weights)] for k in range(len(sums))]
    targets = fill_targets([r["size"] for r in sums], weights, o.max_epochs)
    blocks = [min(o.max_blocks, max(1, -(-r["size"] // o.block_words))) for r in sums]
    whole = [min(o.max_epochs, int(t // r["size"])) if r["size"] else 0 for r, t in zip(sums, targets, strict=True)]
    sources = spark.createDataFrame(
        [Row(rank=k, of=r.source, source_size=r["size"], target=t, blocks=b, whole=e, rest=max(0.0, t - e * r["size"])) for k, (r, t, b, e) in enumerate(zip(sums, targets, blocks, whole, strict=True))],
        "rank int, of string, source_size bigint, target double, blocks int, whole int, rest double",
    )
    share = F.conv(F.substring("key", 1, 12), 16, 10).cast("double") / float(16**12)
    place_in = lambda df: df.join(F.broadcast(sources), df.source.eqNullSafe(sources.of), "left").drop("of").withColumn("block", F.least(F.floor(share * F.col("blocks")), F.col("blocks") - 1).cast("int"))
    placed = place_in(rows)
    # A source's blocks are few (max_blocks), so running sums over them are small.
    filled = placed.groupBy("rank", "block", "rest", "whole").agg(F.sum("size").alias("words"))
    end = F.expr("sum(words) over (partition by rank order by block)")
    drawn = filled.withColumn("end", end).select(
        "rank", "block", "whole", (F.col("end") <= F.col("rest")).alias("inside"), ((F.col("end") > F.col("rest")) & (F.col("end") - F.col("words") < F.col("rest"))).alias("edge"), (F.col("rest") - F.col("end") + F.col("words")).alias("room")
    )
    drawn = materialise(drawn.withColumn("nth", F.expr("row_number() over (partition by rank order by block) - 1")))
    counts = {r["rank"]: r for r in drawn.groupBy("rank").agg(F.count("*").alias("n"), F.sum((F.col("inside") | F.col("edge")).cast("int")).alias("more")).collect()}
    per_source = [counts[k]["n"] if k in counts else 0 for k in range(len(sums))]
    quotas = [whole[k] * n + (counts[k]["more"] if k in counts else 0) for k, n in enumerate(per_source)]
    shards = max(1, o.least_shards, -(-sum(r["size"] for r in sums) // o.shard_words))

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = [(k, start, start + n, int(shard)) for shard in part["id"] for k, (start, n) in enumerate(shard_ranges(int(shard), shards, quotas, o.seed)) if n]
            yield pd.DataFrame(out, columns=["rank", "start", "stop", "shard"])

    counted = spark.createDataFrame([(k, n) for k, n in enumerate(per_source) if n], "rank int, n int")
    dealt = (
        spark.range(shards).mapInPandas(walk, "rank int, start long, stop long, shard int").join(counted, "rank")
        .select("rank", "shard", "n", F.explode(F.sequence("start", F.col("stop") - 1)).alias("i"))
        .groupBy("rank", (F.col("i") % F.col("n")).cast("int").alias("nth"))
        .agg(F.sort_array(F.collect_list(F.struct(F.floor(F.col("i") / F.col("n")).cast("int").alias("epoch"), "shard"))).alias("dealt"))
    )
    cards = drawn.drop("whole").join(dealt, ["rank", "nth"], "left")
    edge = (placed.join(cards.drop("dealt").where("edge"), ["rank", "block"]).where("size > 0").groupBy("rank", "key", "size", "room").agg(F.count("*").alias("n")))
    fits = edge.groupBy("rank").applyInPandas(lambda g: first_fit(g)[["rank", "key", "more_of"]], "rank int, key string, more_of long")
    known = place_in(carried).join(cards, ["rank", "block"], "left")
    plain = known.where(~F.col("edge") | (F.col("size") == 0)).withColumn("more", F.col("inside") | F.col("edge"))
    # Of rows alike in id and text the first ones; all other rows stay where they are.
    alike = known.where("edge and size > 0").withColumn("turn", F.expr("row_number() over (partition by rank, key order by size)"))
    last = alike.join(fits, ["rank", "key"]).withColumn("more", F.col("turn") <= F.col("more_of")).drop("turn", "more_of")
    times = F.col("whole") + F.col("more").cast("int")
    place = lambda x: F.xxhash64(F.lit(o.seed), x["shard"], x["epoch"], F.col("key"))
    copies = F.transform(F.filter("dealt", lambda x: x["epoch"] < times), lambda x: F.struct(x["epoch"].alias("epoch"), x["shard"].alias("shard"), place(x).alias("place")))
    none = F.expr("cast(array() as array<struct<epoch:int,shard:int,place:bigint>>)")
    return plain.unionByName(last).withColumn("taken", F.col("size") * times).withColumn("copies", F.when(times > 0, copies).otherwise(none))


def mix(docs: DataFrame, options: MixOptions = MixOptions(), arranged: bool = True) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it takes them, with shard, epoch and place.

    If arranged, a shard's rows stand together and in the order of their place: shards are dealt over tasks and shuffled
    within. Null texts have no words, so they are taken with whole passes alone; repeated rows are separate documents; ties
    of place go by epoch. Texts of any length move whole, as rows of Spark's.
    """
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    columns = ("doc_id", "text", "source")
    found = planned(materialise(keyed(docs, options, *columns)), keyed(docs, options, *columns, whole), options)
    found = found.select("row", F.explode("copies").alias("_copy"))
    if arranged:
        found = found.repartition("_copy.shard").sortWithinPartitions("_copy.shard", "_copy.place", "_copy.epoch")
    return found.select("row.*", "_copy.*")
