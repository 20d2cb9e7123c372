"""Whitening against plain numpy over the distinct vectors."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiltwork.llm.whitening import Whitening, WhiteningOptions, fit_whitening, whiten, whitened_rows

SHAPE = "vec_id long, embedding array<float>, whitened int, n string"


def rows_of(vectors, first=0):
    return [(first + k, None if v is None else [None if x is None else float(x) for x in v], k, "x") for k, v in enumerate(vectors)]


def plain(vectors):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], dtype=np.int64)
    own = np.unique(x, axis=0)
    n, sums = len(own), own.sum(axis=0)
    centred = own - sums / n
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    return x, n, sums, values[::-1], vecs[:, ::-1].T


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(5)
    base = r.normal(0, 0.2, (300, 20)) * np.linspace(3, 0.5, 20) + r.normal(0, 1, 20)
    return [*base.tolist(), *base[:40].tolist(), *[base[0].tolist()] * 30]


def test_against_numpy(spark, vectors):
    odd = [None, [], [1.0] * 19 + [None], [1.0] * 19 + [float("nan")], [float("inf")] + [1.0] * 19]
    df = spark.createDataFrame(rows_of(vectors) + rows_of(odd, 1000), SHAPE).repartition(5)
    x, n, sums, values, vecs = plain(vectors)
    found = whitened_rows(df).collect()
    assert len(found) == 16 * len(vectors) and {r.n for r in found} == {n} and max(r.identity_error for r in found) < 1e-9
    w = np.zeros((len(vectors), 16))
    for r in found:
        w[r.vec_id, r.component - 1] = r.whitened
        assert r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[r.vec_id], sums)) and abs(r.explained - values[r.component - 1] / values.sum()) < 1e-12
    own = (x - sums / n) @ vecs[:16].T / np.sqrt(values[:16])
    assert np.allclose(np.abs(w), np.abs(own), atol=1e-8)
    assert np.allclose(w * np.sign((w * own).sum(axis=0)), own, atol=1e-8)


def test_columns_stay(spark, vectors):
    done = whiten(spark.createDataFrame(rows_of(vectors[:50]), SHAPE), WhiteningOptions(components=3))
    assert done.columns == ["vec_id", "embedding", "whitened", "n", "_whitening"]
    assert {(r.whitened == r.vec_id, len(r._whitening.whitened)) for r in done.collect()} == {(True, 3)}


def test_small_fits(spark):
    assert whitened_rows(spark.createDataFrame([], SHAPE)).count() == 0
    assert whitened_rows(spark.createDataFrame(rows_of([[1.0, 2.0]] * 3), SHAPE)).count() == 0  # One distinct vector has no spread.
    line = whitened_rows(spark.createDataFrame(rows_of([[k / 64, 2 * k / 64] for k in range(9)]), SHAPE)).collect()
    assert len(line) == 9 and {r.component for r in line} == {1} and abs(sum(r.whitened for r in line)) < 1e-9 and all(abs(r.explained - 1) < 1e-12 for r in line)


def test_lengths_are_spaces_of_their_own(spark):
    r = random.Random(2)
    mixed = [[r.random() for _ in range(2 + k % 2)] for k in range(60)]
    found = whitened_rows(spark.createDataFrame(rows_of(mixed), SHAPE))
    assert {(r.components, r.n) for r in found.groupBy(F.col("vec_id") % 2).agg(F.max("component").alias("components"), F.max("n").alias("n")).collect()} == {(2, 30), (3, 30)}


def test_large_entries(spark):
    """Deviations that a long can't hold are null; far entries count exactly."""
    df = spark.createDataFrame([(k, [1e9 * k, 0.5 * (k % 3)], 0, "") for k in range(8)] + [(9, [1e300, 0.0], 0, "")], "vec_id long, embedding array<double>, whitened int, n string")
    found = whitened_rows(df).collect()
    assert {r.vec_id for r in found} == set(range(8)) and all(r.deviation is None for r in found)
    fit = fit_whitening(df)[2]
    assert isinstance(fit, Whitening) and fit.sums[0] == sum(64 * 10**9 * k + 1_000_000 for k in range(8))
    near = Whitening(10, [5, 7], np.zeros((0, 2)), np.zeros(0), 0.0)
    assert near.deviations(np.array([[1, 2], [1 << 40, 3]], dtype=np.int64)) == [25 + 169, None]
    assert near.deviations(np.array([[200_000_000, 2]], dtype=np.int64)) == [(2_000_000_000 - 5) ** 2 + 169]
