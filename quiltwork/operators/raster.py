"""Images as tables of pixels (x, y and channels): turns, crops, borders, scaling and composition, all as joins and projections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def turned(pixels: DataFrame, height: Column) -> DataFrame:
    """A quarter turn clockwise: what was at (x, y) comes to (height - 1 - y, x)."""
    return pixels.withColumns({"x": height - 1 - F.col("y"), "y": F.col("x")})


def flipped(pixels: DataFrame, height: Column) -> DataFrame:
    return pixels.withColumn("y", height - 1 - F.col("y"))


def cropped(pixels: DataFrame, left: Column, top: Column, width: Column, height: Column) -> DataFrame:
    inside = (F.col("x") >= left) & (F.col("x") < left + width) & (F.col("y") >= top) & (F.col("y") < top + height)
    return pixels.where(inside).withColumns({"x": F.col("x") - left, "y": F.col("y") - top})


def extruded(pixels: DataFrame, by: int, width: Column, height: Column) -> DataFrame:
    """A border around each image that repeats its outermost pixels; the image moves right and down by as much."""

    def spread(at: Column, size: Column) -> Column:
        first = F.when(at == 0, F.lit(0)).otherwise(at + by)
        last = F.when(at == size - 1, size - 1 + 2 * by).otherwise(at + by)
        return F.explode(F.sequence(first.cast("long"), last.cast("long")))

    return pixels.withColumn("x", spread(F.col("x"), width)).withColumn("y", spread(F.col("y"), height))


def composed(pixels: DataFrame, placed: DataFrame, image: str, keys: list[str], order: str, channels: list[str], alpha: str) -> DataFrame:
    """keys, x, y and channels of pages: images' pixels at their places (image, keys, left, top, order).

    Fully transparent pixels overwrite nothing; where images meet, the one later in order is seen. Pixels meet by place, so
    a page is as many groups as it has pixels.
    """
    moved = pixels.where(F.col(alpha) > 0).join(placed, image).withColumns({"x": F.col("x") + F.col("left"), "y": F.col("y") + F.col("top")})
    top = moved.groupBy(*keys, "x", "y").agg(F.max_by(F.struct(*channels), order).alias("_top"))
    return top.select(*keys, "x", "y", *[F.col(f"_top.{c}").alias(c) for c in channels])


def _sources(size: int, factor: float) -> list[float]:
    many = max(1, int(np.floor(np.float32(size) * np.float32(factor) + 0.5)))
    return [(i + 0.5) / factor - 0.5 for i in range(many)]


def scaled_fast(pixels: DataFrame, size: tuple[int, int], factor: float) -> DataFrame:
    """Nearest pixels: each output pixel's middle names the pixel that it takes. All images have one size."""
    steps = {}
    for c, n in zip("xy", size, strict=True):
        near = [int(min(max(np.copysign(np.floor(abs(s) + 0.5), s), 0), n - 1)) for s in _sources(n, factor)]
        take = [[i for i, s in enumerate(near) if s == k] for k in range(n)]
        steps[c] = F.explode(F.get(F.array(*[F.array(*[F.lit(i).cast("long") for i in t]) if t else F.expr("cast(array() as array<bigint>)") for t in take]), F.col(c).cast("int")))
    return pixels.withColumn("x", steps["x"]).withColumn("y", steps["y"])


def scaled_smooth(pixels: DataFrame, keys: list[str], size: tuple[int, int], factor: float, channels: list[str]) -> DataFrame:
    """Bilinear: each pixel sends its share to the output pixels near it, and these are summed. All images have one size."""
    shares = {}
    for c, n in zip("xy", size, strict=True):
        sends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for i, s in enumerate(_sources(n, factor)):
            low = max(0, int(np.floor(s)))
            part = s - low
            for at, weight in ((low, 1 - part), (min(low + 1, n - 1), part)):
                sends[at].append((i, weight))
        entry = lambda own: F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(float(w)).alias("w")) for i, w in own])
        shares[c] = F.explode(F.get(F.array(*[entry(own) for own in sends]), F.col(c).cast("int")))
    each = pixels.withColumn("_x", shares["x"]).withColumn("_y", shares["y"])
    weight = F.col("_x.w") * F.col("_y.w")
    summed = each.groupBy(*keys, F.col("_x.i").alias("x"), F.col("_y.i").alias("y")).agg(*[F.sum(F.col(c) * weight).alias(c) for c in channels])
    return summed.select(*keys, "x", "y", *[F.least(F.greatest(F.round(c), F.lit(0)), F.lit(255)).cast("long").alias(c) for c in channels])


def scaled_twice(pixels: DataFrame, keys: list[str], size: tuple[int, int], colour: str) -> DataFrame:
    """Pixel art at twice the size: corners take a neighbour's colour where neighbours agree. Edges repeat outwards; colour is one column."""
    w, h = size
    around = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 1), (0, 1), (-1, 1), (1, 0), (0, 0))])
    # Each pixel goes to those that see it as a (north-west), b (north), c (north-east), d (west) and e (itself); at an edge a pixel stands for those beyond too.
    sent = pixels.select(*keys, "x", "y", colour, F.posexplode(around).alias("role", "to"))
    tx, ty = F.col("x") + F.col("to.dx"), F.col("y") + F.col("to.dy")
    xs = F.when((F.col("to.dx") == 1) & (F.col("x") == 0), F.array(F.lit(0).cast("long"), tx)).when((F.col("to.dx") == -1) & (F.col("x") == w - 1), F.array(tx, F.lit(w - 1).cast("long"))).otherwise(F.array(tx))
    ys = F.when((F.col("to.dy") == 1) & (F.col("y") == 0), F.array(F.lit(0).cast("long"), ty)).otherwise(F.array(ty))
    met = sent.withColumn("x", F.explode(xs)).withColumn("y", F.explode(ys)).where((F.col("x") >= 0) & (F.col("x") < w) & (F.col("y") >= 0) & (F.col("y") < h))
    seen = met.groupBy(*keys, "x", "y").agg(*[F.max(F.when(F.col("role") == k, F.col(colour))).alias(n) for k, n in enumerate(("_a", "_b", "_c", "_d", "_e"))])
    a, b, c, d, e = (F.col(n) for n in ("_a", "_b", "_c", "_d", "_e"))
    corners = [
        (0, 0, F.when((c == a) & (c != d) & (a != b), a).otherwise(e)), (1, 0, F.when((a == b) & (a != c) & (b != d), b).otherwise(e)),
        (0, 1, F.when((d == c) & (d != b) & (c != a), c).otherwise(e)), (1, 1, F.when((b == d) & (b != a) & (d != c), d).otherwise(e)),
    ]
    each = seen.select(*keys, "x", "y", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), v.alias("v")) for i, j, v in corners])).alias("p"))
    return each.select(*keys, (2 * F.col("x") + F.col("p.i")).alias("x"), (2 * F.col("y") + F.col("p.j")).alias("y"), F.col("p.v").alias(colour))


def bled(pixels: np.ndarray, passes: int = 16) -> np.ndarray:
    """Colours of solid pixels spread into transparent ones, pass by pass; within a pass later pixels see what earlier ones got."""
    out, (height, width) = pixels.copy(), pixels.shape[:2]
    known = out[:, :, 3] > 0
    for _ in range(min(passes, max(height, width, 1))):
        changed = False
        for y, x in zip(*np.nonzero(~known), strict=True):
            for nx, ny in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if 0 <= nx < width and 0 <= ny < height and known[ny, nx]:
                    out[y, x, :3], known[y, x], changed = out[ny, nx, :3], True, True
                    break
        if not changed:
            break
    return out


def with_bleeding(df: DataFrame, image: str, width: str) -> DataFrame:
    """df with image, binary RGBA rows, whose transparent pixels have a near solid pixel's colour. Images that don't fit their width stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, w in zip(batch.column(image).to_pylist(), batch.column(width).to_pylist(), strict=True):
                fits = raw and w and len(raw) % (4 * w) == 0
                out.append(bled(np.frombuffer(raw, np.uint8).reshape(-1, w, 4)).tobytes() if fits else raw)
            at = batch.schema.get_field_index(image)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, pa.binary()))

    return df.mapInArrow(run, df.schema)


def line_pixels(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, x, y: the pixels of lines (x0, y0, x1, y1, whole numbers), one for each step along the longer axis; halves across it go away from the start, as Bresenham's do."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    steps = lines.withColumn("_n", F.greatest(F.abs(dx), F.abs(dy)).cast("long")).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n"))))

    def at(start: str, apart: Column) -> Column:
        way = F.floor((2 * F.col("_k") * F.abs(apart) + F.col("_n")) / F.greatest(2 * F.col("_n"), F.lit(1)))
        return (F.col(start) + F.signum(apart.cast("double")).cast("long") * way).cast("long")

    return steps.select(*keys, at("x0", dx).alias("x"), at("y0", dy).alias("y"))


def shape_lines(frames: DataFrame, keys: list[str], contours: str | None = None) -> DataFrame:
    """keys and the lines around placed frames (x, y, w, h) and, if there are any, their contours: an array of arrays of (x, y) within the upright frame, turned with it where rotated.

    Frames without area have no lines.
    """
    seen = frames.where("w > 0 and h > 0")
    x, y, right, low = F.col("x"), F.col("y"), F.col("x") + F.col("w") - 1, F.col("y") + F.col("h") - 1
    side = lambda *ends: F.struct(*[e.cast("long").alias(n) for n, e in zip(("x0", "y0", "x1", "y1"), ends, strict=True)])
    box = F.array(side(x, y, right, y), side(x, low, right, low), side(x, y, x, low), side(right, y, right, low))
    if contours is not None:
        place = lambda p: F.struct(F.round(x + F.when(F.col("rotated"), F.col("h") - p["y"]).otherwise(p["x"])).alias("x"), F.round(y + F.when(F.col("rotated"), p["x"]).otherwise(p["y"])).alias("y"))

        def around(ring: Column) -> Column:
            placed = F.transform(ring, place)
            return F.zip_with(placed, F.concat(F.slice(placed, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(placed, 1, 1)), lambda a, b: side(a["x"], a["y"], b["x"], b["y"]))

        box = F.concat(box, F.flatten(F.transform(F.filter(F.coalesce(F.col(contours), F.array().cast(dict(frames.dtypes)[contours])), lambda r: F.size(r) >= 2), around)))
    return seen.select(*keys, F.explode(box).alias("_line")).select(*keys, "_line.*")


def outlined(pixels: DataFrame, lines: DataFrame, keys: list[str], channels: tuple[str, ...] = ("r", "g", "b", "a"), colour: tuple[int, ...] = (255, 0, 255, 255)) -> DataFrame:
    """pixels with those on lines in one colour. What lines have beyond the pixels is cut off."""
    hit = line_pixels(lines, keys).distinct().withColumn("_hit", F.lit(True))
    found = pixels.join(hit, [*keys, "x", "y"], "left")
    return found.select(*[F.when(F.col("_hit"), F.lit(colour[channels.index(c)]).cast(k)).otherwise(F.col(c)).alias(c) if c in channels else F.col(c) for c, k in pixels.dtypes])
