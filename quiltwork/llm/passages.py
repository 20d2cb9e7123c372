"""Which passages of a table recur, found without sorting all of them.

Every passage of a given length holds an anchor: of the short strings in it the one with the least hash, chosen by the
passage alone, so equal passages hold equal anchors. Anchors are few. Those that occur once rule out every passage that
they were chosen for; only the others are looked at again.

Hashes travel packed: a task cuts its own into buckets by hash and sends one row for each bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries that a task gathers before it sends them on.
GATHER = 4_000_000
PACKED = "bucket int, hashes binary, keys binary, counts binary, flags binary"
DEALT = "bucket int, keys binary, hashes binary"
FOUND = "tkey bigint, hashes binary"
#: Entry flags: counts as two occurrences; needs no answer.
TWICE, SILENT = 1, 2


def text_key(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with tkey and twin, which together tell texts apart. tkey alone routes hashes: texts that share it get each other's, which finds no less."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.withColumn("tkey", F.xxhash64(text)).withColumn("twin", F.xxhash64(F.crc32(text.cast("binary")), F.octet_length(text)))


def buckets_for(df: DataFrame) -> int:
    """As many buckets as the input has partitions, so a bucket's share is about a partition's."""
    return max(8, df.rdd.getNumPartitions())


def squeezed(values: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as their differences, least bytes first: how many there are to a bucket decides what a number costs, not how large it is."""
    values = np.ascontiguousarray(values).view(np.uint64)
    steps = np.append(values[:1], values[1:] - values[:-1])
    return zstandard.ZstdCompressor(level=1, write_content_size=True).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def restored(packed: bytes) -> np.ndarray:
    """The numbers of squeezed()."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64).view(np.int64)


def pack(hashes: np.ndarray, keys: np.ndarray, flags: np.ndarray, buckets: int, width: int) -> Iterator[pa.RecordBatch]:
    """Entries (hash, text key, flags) by bucket; of a hash its `width` high bytes are kept, equal entries of a text once."""
    bucket = (hashes % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((hashes, keys, bucket))
    hashes, keys, flags, bucket = hashes[order], keys[order], flags[order], bucket[order]
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (keys[1:] != keys[:-1]))
    at = np.flatnonzero(new)
    many = np.diff(np.append(at, len(new)))
    silent = np.minimum.reduceat(flags & SILENT, at) if len(at) else flags[:0]
    flags = (np.bitwise_or.reduceat(flags, at) & TWICE) | (many > 1) * TWICE | silent if len(at) else flags[:0]
    hashes, keys, bucket = hashes[at], keys[at], bucket[at]
    edge = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)) if len(bucket) else np.zeros(1, int)
    rows = []
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        own = keys[a:b]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        high = hashes[a:b].astype(">u8").view(np.uint8).reshape(-1, 8)[:, :width]
        rows.append((int(bucket[a]), high.tobytes(), squeezed(own[first]), squeezed(np.append(first[1:], b - a)), flags[a:b].astype(np.uint8).tobytes()))
    if rows:
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "hashes", "keys", "counts", "flags"])


def unpack(part: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (the bytes kept, as the high ones), keys and flags of a bucket's rows."""
    hashes, keys, flags = [], [], []
    for h, k, c, f in zip(*(part.column(x).to_pylist() for x in ("hashes", "keys", "counts", "flags")), strict=True):
        raw = np.zeros((len(h) // width, 8), np.uint8)
        raw[:, :width] = np.frombuffer(h, np.uint8).reshape(-1, width)
        hashes.append(raw.view(">u8").ravel().astype(np.uint64))
        keys.append(np.repeat(restored(k), np.diff(restored(c), prepend=0)))
        flags.append(np.frombuffer(f, np.uint8))
    return np.concatenate(hashes), np.concatenate(keys), np.concatenate(flags)


def recurring(rows: DataFrame, entries: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]], buckets: int, width: int, alone: int = 0) -> DataFrame:
    """tkey, hashes: for each text, packed, those of its entries whose hash occurs twice or more; entries: hashes, text keys and flags of a batch.

    Hashes meet by bucket of the hash, what was found travels on by bucket of the text key. With width below 8, hashes that differ may count as one: that finds more, never less.
    With a bit for them, those that only occur under one key, as exact copies' do, are told in a row of their own, with the bit set in its key.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(entries(batch))
                size += len(held[-1][0])
            if size >= GATHER:
                yield from pack(*map(np.concatenate, zip(*held, strict=True)), buckets, width)
                held, size = [], 0
        if size:
            yield from pack(*map(np.concatenate, zip(*held, strict=True)), buckets, width)

    def match(part: pa.Table) -> pa.Table:
        hashes, keys, flags = unpack(part, width)
        order = np.lexsort((keys, hashes))
        hashes, keys, flags = hashes[order], keys[order], flags[order]
        at = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        many = np.diff(np.append(at, len(hashes)))
        again = (many > 1) | (np.bitwise_or.reduceat(flags, at) & TWICE > 0)
        take = np.repeat(again, many) & (flags & SILENT == 0)
        take &= np.append(True, (hashes[1:] != hashes[:-1]) | (keys[1:] != keys[:-1]) | ~take[:-1])
        if alone:
            keys = keys | np.repeat(keys[at] == keys[at + many - 1], many) * np.int64(alone)
        hashes, keys = hashes[take], keys[take]
        bucket = (keys.view(np.uint64) % np.uint64(buckets)).astype(np.int32)
        order = np.lexsort((keys, bucket))
        high, keys, bucket = hashes[order].astype(">u8").view(np.uint8).reshape(-1, 8)[:, :width], keys[order], bucket[order]
        at, ends = runs(bucket)
        pick = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary())
        return pa.table({"bucket": pa.array(bucket[at], pa.int32()), "keys": pa.array([squeezed(keys[a:b]) for a, b in zip(at, ends, strict=True)], pa.binary()), "hashes": pick(high)})

    def gather(part: pa.Table) -> pa.Table:
        keys = np.concatenate([restored(k) for k in part.column("keys").to_pylist()])
        high = np.frombuffer(b"".join(part.column("hashes").to_pylist()), np.uint8).reshape(-1, width)
        order = np.argsort(keys, kind="stable")
        keys, high = keys[order], high[order]
        at, ends = runs(keys)
        return pa.table({"tkey": pa.array(keys[at], pa.int64()), "hashes": pa.array([high[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary())})

    met = rows.mapInArrow(send, PACKED).groupBy("bucket").applyInArrow(match, DEALT)
    return met.groupBy("bucket").applyInArrow(gather, FOUND)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of runs of equal values."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    return at, np.append(at[1:], len(values))


def contains(values: np.ndarray, packed: bytes, width: int) -> np.ndarray:
    """Which values are among packed hashes."""
    raw = np.zeros((len(packed) // width, 8), np.uint8)
    raw[:, :width] = np.frombuffer(packed, np.uint8).reshape(-1, width)
    known = np.unique(raw.view(">u8").ravel().astype(np.uint64))
    if not len(known) or not len(values):
        return np.zeros(len(values), bool)
    cut = values & (~np.uint64(0) << np.uint64(8 * (8 - width)))
    at = np.minimum(np.searchsorted(known, cut), len(known) - 1)
    return known[at] == cut


def distinct_texts(keyed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """For each text (tkey, twin) the least id (null ids last) and the number of rows."""
    return keyed.groupBy("tkey", "twin").agg(F.min(F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))).alias("first"), F.count("*").alias("times"))
