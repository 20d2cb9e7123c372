"""Colours of pixel tables: histograms, palettes, nearest entries; and dithering of single images."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(pixels: DataFrame, channels: list[str]) -> DataFrame:
    return pixels.groupBy(*channels).agg(F.count("*").alias("n"))


def top_colours(pixels: DataFrame, channels: list[str], n: int) -> DataFrame:
    """The n most frequent colours, equal counts by channels; place from 1."""
    found = histogram(pixels, channels).orderBy(F.desc("n"), *channels).limit(n)
    return found.withColumn("place", F.expr(f"row_number() over (order by n desc, {', '.join(channels)})").cast("long"))


def fill_ratio(pixels: DataFrame, keys: list[str], alpha: str, threshold: int = 0) -> DataFrame:
    """keys, solid, pixels: how many pixels have an alpha above the threshold."""
    return pixels.groupBy(*keys).agg(F.sum((F.col(alpha) > threshold).cast("long")).alias("solid"), F.count("*").alias("pixels"))


def nearest(channels: list[Column], palette: list[tuple[int, ...]]) -> tuple[Column, Column]:
    """Place in a small palette of the nearest colour, the first of equally near ones, and the squared distance."""
    far = [sum(((c - v) * (c - v) for c, v in zip(channels, entry, strict=True)), F.lit(0)) for entry in palette]
    least = F.least(*far)
    place = F.lit(len(palette) - 1)
    for k in range(len(palette) - 2, -1, -1):
        place = F.when(far[k] == least, k).otherwise(place)
    return place.cast("long"), least.cast("long")


def refined(pixels: DataFrame, channels: list[str], palette: list[tuple[int, ...]]) -> DataFrame:
    """One step of palette refinement: for each entry that is some pixel's nearest, the rounded mean of those pixels."""
    place, _ = nearest([F.col(c) for c in channels], palette)
    means = [F.floor((F.sum(c) * 2 + F.count("*")) / (F.count("*") * 2)).cast("long").alias(c) for c in channels]
    return pixels.withColumn("entry", place).groupBy("entry").agg(*means, F.count("*").alias("n"))


def border_colour(pixels: DataFrame, keys: list[str], x: str, y: str, w: Column, h: Column, channels: list[str]) -> DataFrame:
    """keys and the most frequent colour of each image's outermost pixels, of equally frequent ones the least."""
    ring = pixels.where((F.col(x) == 0) | (F.col(y) == 0) | (F.col(x) == w - 1) | (F.col(y) == h - 1))
    counted = ring.groupBy(*keys, *channels).agg(F.count("*").alias("_n"))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_n"), *channels))
    return counted.withColumn("_k", first).where("_k = 1").select(*keys, *channels)


def without_background(pixels: DataFrame, keys: list[str], x: str, y: str, w: Column, h: Column, channels: list[str], alpha: str) -> DataFrame:
    """pixels with the border's most frequent colour made clear, in images that have no clear pixel yet (255 is opaque)."""
    ground = border_colour(pixels, keys, x, y, w, h, channels)
    opaque = pixels.groupBy(*keys).agg(F.min(alpha).alias("_least")).where("_least = 255").drop("_least")
    told = ground.join(opaque, keys, "left_semi").select(*keys, F.struct(*channels).alias("_ground"))
    found = pixels.join(told, keys, "left")
    return found.withColumn(alpha, F.when(F.struct(*channels) == F.col("_ground"), F.lit(0)).otherwise(F.col(alpha))).select(*pixels.columns)



# How kernels pass errors on, as (right, down, share), and the shares' whole.
KERNELS = {
    "floyd-steinberg": ([(1, 0, 7), (-1, 1, 3), (0, 1, 5), (1, 1, 1)], 16),
    "atkinson": ([(1, 0, 1), (2, 0, 1), (-1, 1, 1), (0, 1, 1), (1, 1, 1), (0, 2, 1)], 8),
    "linear": ([(1, 0, 1)], 1), "nearest": ([], 1), "none": ([], 1),
}


def diffused(images: np.ndarray, bits: int, kernel: str = "floyd-steinberg") -> np.ndarray:
    """Images of one size (image, row, column, channel; 0 to 255) at fewer bits, errors passed on by a kernel in reading order.

    Alpha, the fourth channel, gets fewer bits as well, but its errors go on only under kernels that end in -alpha. A pixel
    of all images is done at once, so the steps are those of one image.
    """
    shares, whole = KERNELS[kernel.removesuffix("-alpha")]
    step = np.float32(255) / np.float32((1 << bits) - 1)
    many, height, width, channels = images.shape
    # A margin takes what would go beyond the edges.
    work = np.zeros((many, height + 2, width + 3, channels), np.float32)
    work[:, :height, 1 : width + 1] = images
    passed = np.ones(channels, np.float32)
    if not kernel.endswith("-alpha"):
        passed[3:] = 0
    for y in range(height):
        for x in range(1, width + 1):
            old = work[:, y, x].copy()
            new = np.clip(np.floor(old / step + np.float32(0.5)), 0, (1 << bits) - 1) * step
            work[:, y, x] = new
            error = (old - new) * passed
            for dx, dy, share in shares:
                work[:, y + dy, x + dx] += error * np.float32(share / whole)
    return np.clip(np.floor(work[:, :height, 1 : width + 1] + np.float32(0.5)), 0, 255).astype(np.uint8)


def dithered(df: DataFrame, image: str, width: str, bits: int = 4, kernel: str = "floyd-steinberg") -> DataFrame:
    """df with image, binary RGBA rows, at fewer bits for each channel. Null images and images that don't fit their width stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, alike = batch.column(image).to_pylist(), {}
            for k, (raw, w) in enumerate(zip(out, batch.column(width).to_pylist(), strict=True)):
                if raw and w and len(raw) % (4 * w) == 0:
                    alike.setdefault((len(raw), w), []).append(k)
            for (size, w), places in alike.items():
                stacked = np.frombuffer(b"".join([out[k] for k in places]), np.uint8).reshape(len(places), size // (4 * w), w, 4)
                for k, found in zip(places, diffused(stacked, bits, kernel), strict=True):
                    out[k] = found.tobytes()
            at = batch.schema.get_field_index(image)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, pa.binary()))

    return df.mapInArrow(run, df.schema)


def normal_map_like(pixels: DataFrame, keys: list[str], channels: list[str], alpha: str) -> DataFrame:
    """keys and is_normal: whether the whole means of an image's visible pixels are those of a normal map, mostly blue around the middle of red and green."""
    seen = pixels.where(F.col(alpha) != 0).groupBy(*keys).agg(*[F.floor(F.sum(c) / F.count("*")).alias(c) for c in channels])
    r, g, b = (F.col(c) for c in channels)
    is_normal = (b > r) & (b > g) & (b >= 160) & (F.abs(r - 128) <= 48) & (F.abs(g - 128) <= 48)
    return seen.select(*keys, is_normal.alias("is_normal"))


def median_cut(counts: list[tuple[tuple[int, ...], int]], size: int) -> list[tuple[int, ...]]:
    """A palette of a histogram: the box with the widest channel is cut at its weighted median until there are enough, then averaged.

    Of equally wide boxes the first is cut, at the first of equally wide channels; colours are taken in their own order.
    """
    boxes = [sorted(counts)] if counts else []
    while boxes and len(boxes) < size:
        widths = [[max(c[k] for c, _ in box) - min(c[k] for c, _ in box) for k in range(len(box[0][0]))] for box in boxes]
        best = max(range(len(boxes)), key=lambda i: max(widths[i]))
        if max(widths[best]) == 0:
            break
        k = widths[best].index(max(widths[best]))
        box = sorted(boxes[best], key=lambda e: (e[0][k], e[0]))
        half, run, cut = sum(n for _, n in box) / 2, 0, 1
        for i, (_, n) in enumerate(box[:-1]):
            run += n
            cut = i + 1
            if run >= half:
                break
        boxes[best : best + 1] = [box[:cut], box[cut:]]
    total = lambda box: sum(n for _, n in box)
    return sorted(tuple((2 * sum(c[k] * n for c, n in box) + total(box)) // (2 * total(box)) for k in range(len(box[0][0]))) for box in boxes)


def palettes(pixels: DataFrame, key: str, channels: list[str], size: int) -> DataFrame:
    """key, entry and channels: a palette of each image by median cut over its histogram, which is counted before it is gathered."""
    kind = dict(pixels.dtypes)[key]

    def cut(part: pa.Table) -> pa.Table:
        name = part.column(key)[0]
        colours = list(zip(*(part.column(c).to_pylist() for c in channels), strict=True))
        found = median_cut(list(zip(colours, part.column("n").to_pylist(), strict=True)), size)
        columns = {key: pa.array([name.as_py()] * len(found), name.type), "entry": pa.array(range(len(found)), pa.int64())}
        return pa.table(columns | {c: pa.array([f[k] for f in found], pa.int64()) for k, c in enumerate(channels)})

    return histogram(pixels, [key, *channels]).groupBy(key).applyInArrow(cut, f"{key} {kind}, entry bigint, " + ", ".join(f"{c} bigint" for c in channels))
