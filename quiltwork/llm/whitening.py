"""Whitens embeddings by the covariance of their distinct vectors.

Entries become integers first, so equal vectors are equal exactly and each counts once. One aggregation of generated SQL
expressions, one for each column of the covariance, sums the products of every pair of dimensions (the upper triangle),
centred at the integers next to the means; what is left of the means is taken off in exact integers on the driver, which
holds one dimensions by dimensions matrix and decomposes it with LAPACK. A task sends that many sums, whatever its number
of vectors.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiltwork.llm.common import materialise

_MOST = 2.0**62
FOUND = "n bigint, deviation bigint, whitened array<double>, explained array<double>, identity_error double"


@dataclass(frozen=True)
class WhiteningOptions:
    """An entry c becomes floor(scale * c) + offset."""

    scale: int = 64
    offset: int = 1_000_000
    components: int = 16


@dataclass(frozen=True)
class Whitening:
    """The fit of vectors of one length: n vectors with sums per dimension, unit eigenvectors by falling eigenvalue."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def centre(self) -> list[int]:
        return [round(Fraction(s, self.n)) for s in self.sums]

    def project(self, x: np.ndarray) -> np.ndarray:
        """x - S / n on the components, over the root of their eigenvalues. The integer part of the mean goes first, so nothing is lost to rounding."""
        centre = self.centre
        rest = np.array([float(Fraction(s, self.n) - c) for s, c in zip(self.sums, centre, strict=True)])
        return ((x - np.array(centre, np.int64)).astype(np.float64) - rest) @ self.vectors.T / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums over the dimensions of (n x - S)^2, exactly; null where a long can't hold them."""
        sums = np.array([float(s) for s in self.sums])
        near = (np.abs(self.n * x.astype(np.float64)) + np.abs(sums)).max(axis=1)
        about = ((self.n * x.astype(np.float64) - sums) ** 2).sum(axis=1)
        easy = (near < _MOST) & (about + near * 1e-3 < _MOST / 2)
        out: list[int | None] = [None] * len(x)
        if easy.any():
            z = self.n * x[easy] - np.array(self.sums, np.int64)
            for k, d in zip(np.flatnonzero(easy).tolist(), (z * z).sum(axis=1).tolist(), strict=True):
                out[k] = d
        for k in np.flatnonzero(~easy).tolist():
            d = sum((self.n * v - s) ** 2 for v, s in zip(x[k].tolist(), self.sums, strict=True))
            out[k] = d if d < 1 << 63 else None
        return out


def quantised(vector: Column, o: WhiteningOptions) -> Column:
    """A vector's entries as integers; null if it is null, empty, or has an entry that is null, not finite or beyond 2^62."""
    scaled = lambda e: e.cast("double") * F.lit(float(o.scale))
    sound = F.forall(vector, lambda e: F.coalesce(F.abs(scaled(e)) < F.lit(_MOST), F.lit(False)))
    return F.when((F.size(vector) > 0) & sound, F.transform(vector, lambda e: F.floor(scaled(e)).cast("long") + F.lit(o.offset).cast("long")))


def decompose(n: int, sums: list[int], products: dict[tuple[int, int], int], o: WhiteningOptions) -> Whitening:
    """The eigenvectors of the covariance. products are sums of (x_i - c_i)(x_j - c_j) with c the integers next to the means.

    Eigenvalues that doubles can't tell from nothing (below 1e-10 of the largest) have no component. Of the two signs the
    one whose largest entry is positive.
    """
    d = len(sums)
    left = [s - n * round(Fraction(s, n)) for s in sums]
    cov = np.empty((d, d))
    for (i, j), p in products.items():
        cov[i, j] = cov[j, i] = (n * p - left[i] * left[j]) / n**2
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1].T
    keep = min(o.components, int((values > max(1e-10 * values[0], 0)).sum()))
    vectors = np.ascontiguousarray(vectors[:keep])
    largest = np.abs(vectors).argmax(axis=1)
    return Whitening(n, sums, vectors * np.sign(vectors[np.arange(keep), largest])[:, None], values[:keep].copy(), float(np.trace(cov)))


def centred_products(own: DataFrame, centre: list[int]) -> dict[tuple[int, int], int]:
    """Sums of (x_i - c_i)(x_j - c_j) for i <= j. A vector gives a row for each dimension i, and the rows of a task are summed there; one expression for all pairs would be too large for generated code."""
    d = len(centre)
    y = F.expr(f"array({', '.join(f'cast(x[{i}] - {c}L as double)' for i, c in enumerate(centre))})")
    rows = own.select(y.alias("y")).select("y", F.posexplode("y").alias("i", "v"))
    found = rows.groupBy("i").agg(*[F.expr(f"sum(if(i <= {j}, v * y[{j}], 0D))").alias(f"s{j}") for j in range(d)])
    return {(r["i"], j): int(r[f"s{j}"]) for r in found.collect() for j in range(r["i"], d)}


def fit_whitening(vectors: DataFrame, vector_col: str = "embedding", o: WhiteningOptions = WhiteningOptions()) -> dict[int, Whitening]:
    """The fits by vector length: lengths are spaces of their own. Each distinct vector counts once; an empty table has no fit."""
    x = vectors.select(quantised(F.col(vector_col), o).alias("x")).where("x is not null")
    each = materialise(x.distinct())
    fits = {}
    for d, n in sorted(tuple(r) for r in each.groupBy(F.size("x")).count().collect()):
        own = each.where(F.size("x") == d)
        sums = [int(s) for s in own.agg(*[F.expr(f"sum(cast(x[{i}] as decimal(20,0)))").alias(f"s{i}") for i in range(d)]).first()]
        fit = decompose(n, sums, centred_products(own, [round(Fraction(s, n)) for s in sums]), o)
        fits[d] = replace(fit, identity_error=measure_identity(own, d, fit))
    return fits


def measure_identity(own: DataFrame, d: int, fit: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, from the whitened vectors themselves."""
    k = len(fit.values)
    if not k:
        return 0.0
    rows = own.select(whitened_of({d: fit})(F.col("x"))["whitened"].alias("w")).select("w", F.posexplode("w").alias("i", "v"))
    found = {r["i"]: r for r in rows.groupBy("i").agg(F.sum("v").alias("mean"), *[F.expr(f"sum(v * w[{j}])").alias(f"s{j}") for j in range(k)]).collect()}
    means = [found[i]["mean"] / fit.n for i in range(k)]
    return max(abs(found[i][f"s{j}"] / fit.n - means[i] * means[j] - (i == j)) for i in range(k) for j in range(k))


def whitened_of(fits: dict[int, Whitening]):
    """A function from the column of integers to a struct of n, deviation, whitened, explained, identity_error; batches of vectors go through one product of matrices."""

    @F.pandas_udf(FOUND)
    def of(xs: pd.Series) -> pd.DataFrame:
        out: list[tuple] = [(None,) * 5] * len(xs)
        sizes = xs.map(len).to_numpy()
        for d in np.unique(sizes):
            at, fit = np.flatnonzero(sizes == d), fits[int(d)]
            x = np.stack([xs.iloc[k] for k in at])
            shares = (fit.values / fit.trace).tolist() if len(fit.values) else []
            for k, deviation, w in zip(at.tolist(), fit.deviations(x), fit.project(x).tolist(), strict=True):
                out[k] = (fit.n, deviation, w, shares, fit.identity_error)
        found = pd.DataFrame(out, columns=["n", "deviation", "whitened", "explained", "identity_error"])
        return found.astype({"n": "Int64", "deviation": "Int64"})

    return of


def whiten(vectors: DataFrame, o: WhiteningOptions = WhiteningOptions(), vector_col: str = "embedding") -> DataFrame:
    """The rows with vectors that take part, with one more column, _whitening: struct of n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, or holds null or non-finite entries go. Vectors of other lengths are fitted and whitened
    among themselves. Repeated rows and copies of vectors count once in the fit, and each is whitened. A fit of fewer distinct
    vectors than components, or of dependent dimensions, has as many components as the covariance has rank, none for a single
    vector. Components of equal eigenvalues are any basis of their space. Columns of the input stay as they are.
    """
    fits = fit_whitening(vectors, vector_col, o)
    rows = vectors.withColumn("_whitening", quantised(F.col(vector_col), o)).where("_whitening is not null")
    return rows.withColumn("_whitening", whitened_of(fits)(F.col("_whitening")))


def whitened_rows(vectors: DataFrame, o: WhiteningOptions = WhiteningOptions(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row of each vector and component, numbered from 1."""
    done = whiten(vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding")), o)
    w = F.col("_whitening")
    flat = done.select("vec_id", w["n"].alias("n"), w["deviation"].alias("deviation"), F.posexplode(F.arrays_zip(w["whitened"].alias("whitened"), w["explained"].alias("explained"))).alias("at", "part"), w["identity_error"].alias("identity_error"))
    return flat.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "part.whitened", "part.explained", "identity_error")
