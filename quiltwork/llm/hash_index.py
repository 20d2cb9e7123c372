"""Nearest neighbours by multi-index hashing.

Vectors become binary codes by learned rotations. A code is cut into substrings and each substring is indexed; two codes
within a Hamming radius agree in some substring up to radius // substrings bits, so probing every bucket that near in
every table retrieves each code within the radius. Those are ranked by inner products of the original vectors.

Rows are cut into shards and queries into blocks; each pair is searched on its own and the best of all shards are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiltwork.llm.common import materialise, near_least

RESULT = "query_id bigint, vec_id bigint, score double"


@dataclass(frozen=True)
class IndexOptions:
    """The rotations are learned from at most sample_rows rows; every row is indexed.

    A query for which fewer than enough codes of a shard lie within the radius is searched again with a radius larger by
    a substring's worth of bits, until enough are found or all rows of the shard are.
    """

    k: int = 20
    bits: int = 128
    substring: int = 16
    radius: int = 56
    enough: int = 40
    sample_rows: int = 10_000
    rounds: int = 15
    shard_rows: int = 65_536
    least_shards: int = 6
    query_rows: int = 8_192
    seed: int = 5


@dataclass(frozen=True)
class Codes:
    """Sign codes under learned rotations. Rows get one more component that makes all of them as long as the longest."""

    rotation: np.ndarray
    longest: float
    bits: int

    def of(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        square = (vectors**2).sum(axis=1)
        last = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(self.longest**2 - square, 0))
        signs = np.hstack([vectors, last[:, None]]) @ self.rotation > 0
        return np.packbits(signs, axis=1)


def learn_codes(sample: np.ndarray, longest: float, options: IndexOptions) -> Codes:
    """Iterative quantisation: rotations that bring the components close to their signs, several of them until there are enough bits."""
    square = (sample**2).sum(axis=1)
    rows = np.hstack([sample, np.sqrt(np.maximum(longest**2 - square, 0))[:, None]])
    value, axes = np.linalg.eigh(rows.T @ rows)
    axes = axes[:, np.argsort(-value)]
    rng, parts = np.random.default_rng(options.seed), []
    while sum(p.shape[1] for p in parts) < options.bits:
        turn, _ = np.linalg.qr(rng.standard_normal((axes.shape[1],) * 2))
        flat = rows @ axes
        for _ in range(options.rounds if len(rows) else 0):
            u, _, v = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
            turn = (u @ v).T
        parts.append(axes @ turn)
    return Codes(np.hstack(parts)[:, : options.bits], longest, options.bits)


POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class Tables:
    """For each substring, the rows of a shard by the substring's value."""

    def __init__(self, codes: np.ndarray, options: IndexOptions) -> None:
        self.codes, self.width = codes, options.substring // 8
        self.tables = []
        for at in range(0, codes.shape[1], self.width):
            value = self.substring(codes, at)
            order = np.argsort(value, kind="stable")
            present, first, many = np.unique(value[order], return_index=True, return_counts=True)
            self.tables.append((at, order, present, first, many))

    def substring(self, codes: np.ndarray, at: int) -> np.ndarray:
        part = codes[:, at : at + self.width].astype(np.int64)
        return part @ (256 ** np.arange(part.shape[1] - 1, -1, -1))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is within the radius of a code."""
        near, hit = radius // len(self.tables), np.zeros(len(self.codes), bool)
        for at, order, present, first, many in self.tables:
            differ = present ^ self.substring(code[None], at)[0]
            distance = sum(POPCOUNT[(differ >> (8 * b)) & 255].astype(np.int64) for b in range(self.width))
            bucket = np.flatnonzero(distance <= near)
            n = many[bucket]
            hit[order[np.repeat(first[bucket] - np.cumsum(n) + n, n) + np.arange(n.sum())]] = True
        rows = np.flatnonzero(hit)
        return rows[POPCOUNT[self.codes[rows] ^ code].sum(axis=1, dtype=np.int64) <= radius]


def search(ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, query_codes: np.ndarray, options: IndexOptions) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows found for each query: query ids, row ids and inner products."""
    tables, out = Tables(codes, options), []
    for q, vector, code in zip(query_ids, queries, query_codes, strict=True):
        radius, others = options.radius, int((ids != q).sum())
        while True:
            rows = tables.within(code, radius)
            rows = rows[ids[rows] != q]
            if len(rows) >= min(max(options.k, options.enough), others):
                break
            radius += options.substring
        score = vectors[rows] @ vector
        if len(rows) > 4 * options.k:
            keep = score >= np.partition(score, -options.k)[-options.k]
            rows, score = rows[keep], score[keep]
        best = np.lexsort((ids[rows], -score))[: options.k]
        out.append((np.full(len(best), q), ids[rows[best]], score[best]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    a, b, c = zip(*out, strict=True)
    return np.concatenate(a), np.concatenate(b), np.concatenate(c)


def usable(vector: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(good(x), F.lit(False))) & F.exists(vector, lambda x: x != 0)


def nearest(rows: DataFrame, is_query: Column, options: IndexOptions = IndexOptions(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row where is_query (on vec_id) holds, its nearest other rows.

    Vectors that are null, zero, or have null or non-finite components take no part, nor do rows without an id or of
    another length than most (the least such length, if several are as frequent). Rows with the query's id are its own; of
    queries that share an id the row with the least vector counts. Equal scores go by the lesser id. Other columns are
    left out.
    """
    spark, o = rows.sparkSession, options
    every = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    lengths = every.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("longest")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    d, n, longest = lengths[0].d, lengths[0].n, lengths[0].longest
    every = every.where(F.size("v") == d)
    hashed = F.xxhash64("vec_id")
    sample = every.where(near_least(hashed, o.sample_rows, F.lit(n))).orderBy(F.shiftrightunsigned(hashed, 34), hashed, "vec_id", "v").limit(o.sample_rows).select("v").collect()
    codes = learn_codes(np.array([r.v for r in sample], float).reshape(-1, d), longest, o)
    shards = max(o.least_shards, -(-n // o.shard_rows))

    def encode(query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes.of(vectors, query)], pa.binary())], ["vec_id", "v", "code"])

        return run

    kinds = "vec_id bigint, v array<double>, code binary"
    asked = materialise(every.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")).mapInArrow(encode(True), kinds))
    blocks = max(1, -(-asked.count() // o.query_rows))
    indexed = every.mapInArrow(encode(False), kinds).withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    indexed = indexed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def unpack(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return part["vec_id"].to_numpy(np.int64), np.array(part["v"].tolist(), float).reshape(-1, d), np.frombuffer(b"".join(part["code"]), np.uint8).reshape(len(part), -1)

    def both(own: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if own.empty or queries.empty:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        own, queries = own.sort_values("vec_id", kind="stable"), queries.sort_values("vec_id")
        return pd.DataFrame(dict(zip(["query_id", "vec_id", "score"], search(*unpack(own), *unpack(queries), o), strict=True)))

    found = indexed.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(both, RESULT)
    ranked = found.withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, vec_id)"))
    return ranked.where(F.col("rank") <= o.k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
