"""Language identification with blended-spectrum string kernels.

Two texts are compared by the character n-grams (1 to 3) that occur in both: for each n the number of shared n-grams over
the geometric mean of both numbers, summed over n. A Nyström map over landmark documents turns the kernel into a few
features, ridge regression of each language against the rest is fitted on them, and texts are scored in batches by two
matrix products.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiltwork.llm.common import id_bucket, near_least

UNKNOWN = "und"


@dataclass(frozen=True)
class KernelOptions:
    """The classifier is fitted on at most rows_per_language labelled rows of each language, with landmarks shared out among all, two of each at least."""

    rows_per_language: int = 300
    landmarks: int = 128
    max_n: int = 3
    slots: int = 8192
    ridge: float = 1e-3


@dataclass(frozen=True)
class KernelModel:
    options: KernelOptions
    languages: tuple[str, ...]
    landmarks: np.ndarray  # slots of all n side by side, scaled
    weights: np.ndarray  # landmarks + 1 by languages


@functools.cache
def letter_table() -> np.ndarray:
    """For code points below 65536: itself if it is a letter, else 32."""
    return np.array([i if chr(i).isalpha() else 32 for i in range(1 << 16)], np.uint64)


def presence(texts: list[str], options: KernelOptions) -> np.ndarray:
    """A row for each text: for each n, which slots its n-grams fall into, scaled to length one."""
    out = np.zeros((len(texts), options.max_n * options.slots), np.float32)
    lowered = [t.lower() for t in texts]
    # Every text ends in a blank, so its n-grams don't depend on what stands beside it.
    codes = np.frombuffer("".join([t + " " for t in lowered]).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return out
    table = letter_table()
    codes = np.where(codes < 1 << 16, table[np.minimum(codes, 0xFFFF)], codes)
    row = np.repeat(np.arange(len(texts), dtype=np.int64), [len(t) + 1 for t in lowered])
    base = row * out.shape[1]
    flat, mixed = out.reshape(-1), np.zeros(len(codes), np.uint64)
    for n in range(options.max_n):
        mixed = mixed[: len(codes) - n] * np.uint64(0x9E3779B97F4A7C15) + codes[n:]
        slot = ((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)) % np.uint64(options.slots)
        inside = row[: len(mixed)] == row[n:]
        flat[(base[: len(mixed)] + slot.astype(np.int64) + n * options.slots)[inside]] = 1
    for n in range(options.max_n):
        part = out[:, n * options.slots : (n + 1) * options.slots]
        part /= np.sqrt(np.maximum(part.sum(axis=1, keepdims=True), 1))
    return out


def chunks(texts: list[str], rows: int = 96, chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Neighbouring texts, so many that a chunk stays small; a longer text is a chunk of its own."""
    start = size = 0
    for k, t in enumerate(texts):
        if k > start and (k - start == rows or size + len(t) > chars):
            yield start, k
            start, size = k, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def fit(rows: list[tuple[str, str]], options: KernelOptions) -> KernelModel:
    """rows: text and language, in an order that doesn't depend on how Spark read them."""
    languages = tuple(sorted({lang for _, lang in rows}))
    by = [[t for t, lang in rows if lang == want] for want in languages]
    each = max(2, options.landmarks // max(1, len(languages)))
    marks = presence([t for texts in by for t in texts[:each]], options)
    inner = marks @ marks.T
    value, vector = np.linalg.eigh(inner.astype(np.float64))
    keep = value > max(value.max(initial=0), 1e-9) * 1e-6
    nystroem = vector[:, keep] / np.sqrt(value[keep])
    # The normal equations add up over chunks, so that memory doesn't grow with rows times landmarks.
    at = {lang: k for k, lang in enumerate(languages)}
    squares, mixed = np.zeros((keep.sum() + 1,) * 2), np.zeros((keep.sum() + 1, len(languages)))
    for a, b in chunks([t for t, _ in rows]):
        phi = np.hstack([presence([t for t, _ in rows[a:b]], options) @ marks.T @ nystroem, np.ones((b - a, 1))])
        target = np.full((b - a, len(languages)), -1.0)
        target[np.arange(b - a), [at[lang] for _, lang in rows[a:b]]] = 1
        squares += phi.T @ phi
        mixed += phi.T @ target
    solved = np.linalg.solve(squares + options.ridge * len(rows) * np.eye(len(squares)), mixed)
    weights = np.vstack([nystroem @ solved[:-1], solved[-1:]]).astype(np.float32)
    return KernelModel(options, languages, marks, weights)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def predict(model: KernelModel | None, texts: list[str]) -> tuple[list[str], list[float]]:
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    known = [k for k, t in enumerate(texts) if model and has_letter(t)]
    picked = [texts[k] for k in known]
    for a, b in chunks(picked):
        margin = (presence(picked[a:b], model.options) @ model.landmarks.T) @ model.weights[:-1] + model.weights[-1]
        best = margin.argmax(axis=1)
        for k, i, m in zip(known[a:b], best, margin[np.arange(b - a), best], strict=True):
            names[k], scores[k] = model.languages[i], float(min(1.0, max(0.0, (m + 1) / 2)))
    return names, scores


def learn(df: DataFrame, usable: Column, options: KernelOptions, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> KernelModel | None:
    """Fits on the rows where usable holds and text and language aren't null; None if there are none.

    Of each language the rows with the least hash of id and text are taken, so reruns agree; tasks keep that many rows of
    each language before anything is shuffled.
    """
    rows = df.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).alias("text")
    )
    counts = rows.groupBy("lang").agg(F.count("*").alias("total"))  # a row for each language
    rows = rows.join(F.broadcast(counts), "lang").where(near_least(F.col("h"), options.rows_per_language, F.col("total")))
    order = F.shiftrightunsigned("h", 34)
    first = F.row_number().over(Window.partitionBy("lang").orderBy(order, "h", "text"))
    found = rows.withColumn("k", first).where(F.col("k") <= options.rows_per_language).select("lang", "k", "text").collect()
    ordered = sorted((r.k, r.lang, r.text) for r in found)
    return fit([(text, lang) for _, lang, text in ordered], options) if ordered else None


def identify(df: DataFrame, usable: Column, options: KernelOptions = KernelOptions(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of df: doc_id, lang_pred, score. Null texts and texts without a letter are und with score 0.

    The language column is read for fitting alone. Without rows to learn from, all texts are und. Repeated rows stay;
    other columns are left out, so their names can't clash.
    """
    model = learn(df, usable, options, id_col, text_col, lang_col)
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = predict(model, [t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double")


def identify_held_out(df: DataFrame, options: KernelOptions = KernelOptions()) -> DataFrame:
    """identify() with a fourth of the documents (crc32 of the id modulo 4 is 2) kept out of the fit."""
    found = identify(df, id_bucket(F.col("doc_id"), 4) != 2, options)
    return found.select("doc_id", (id_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
