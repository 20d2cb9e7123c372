"""Contours and meshes of alpha masks, one row at a time, and formulas on rectangles and point arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StructType

Point = tuple[float, float]


def twice_area(points: Column) -> Column:
    """Twice the signed area of a closed ring, an array of (x, y) structs, by the shoelace formula."""
    after = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    terms = F.zip_with(points, after, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)


def texture_points(points: Column, x: Column, y: Column, h: Column, width: Column, height: Column, rotated: Column) -> Column:
    """Points of a sprite as shares of its page; a turned sprite's point (x, y) stands at (h - y, x)."""
    px = lambda p: F.when(rotated, h - p["y"]).otherwise(p["x"])
    py = lambda p: F.when(rotated, p["x"]).otherwise(p["y"])
    return F.transform(points, lambda p: F.struct(((x + px(p)) / width).alias("x"), ((y + py(p)) / height).alias("y")))


# Of a square's solid corners the sides (0 top, 1 right, 2 bottom, 3 left) that lines join.
JOINED = {
    1: [(3, 2)], 2: [(2, 1)], 3: [(3, 1)], 4: [(0, 1)], 5: [(3, 0), (2, 1)], 6: [(0, 2)], 7: [(3, 0)],
    8: [(3, 0)], 9: [(0, 2)], 10: [(0, 1), (3, 2)], 11: [(0, 1)], 12: [(3, 1)], 13: [(2, 1)], 14: [(3, 2)],
}


def segments(mask: np.ndarray) -> list[tuple[Point, Point]]:
    """Marching squares over a mask with a blank ring around it; diagonal neighbours are joined. Points are pixel edges' middles."""
    solid = np.pad(mask, 1).astype(np.int64)
    out = []
    case = solid[:-1, :-1] * 8 + solid[:-1, 1:] * 4 + solid[1:, 1:] * 2 + solid[1:, :-1] * 1
    ys, xs = np.nonzero((case > 0) & (case < 15))
    for y, x, n in zip(ys.tolist(), xs.tolist(), case[ys, xs].tolist(), strict=True):
        # A pixel's own corner is half a pixel before its middle, and the blank ring is one pixel.
        at = (float(x), y - 0.5), (x + 0.5, float(y)), (float(x), y + 0.5), (x - 0.5, float(y))
        out.extend([(at[a], at[b]) for a, b in JOINED[n]])
    return out


#: Of each case its segments, the first and the second, as x and y of both ends in halves from a square's middle; the last number tells whether there is one.
ENDS = np.zeros((16, 2, 5), np.int64)
for _case, _pairs in JOINED.items():
    for _k, (_a, _b) in enumerate(_pairs):
        ENDS[_case, _k] = (*((0, -1), (1, 0), (0, 1), (-1, 0))[_a], *((0, -1), (1, 0), (0, 1), (-1, 0))[_b], 1)


def mask_loops(mask: np.ndarray) -> list[list[Point]]:
    """stitched() of segments(), in numbers: every point is an end of two segments."""
    solid = np.pad(mask, 1).astype(np.uint8)
    case = solid[:-1, :-1] * 8 + solid[:-1, 1:] * 4 + solid[1:, 1:] * 2 + solid[1:, :-1]
    ys, xs = ((case > 0) & (case < 15)).nonzero()
    found = ENDS[case[ys, xs]]
    found[:, :, 0:3:2] += (2 * xs)[:, None, None]
    found[:, :, 1:4:2] += (2 * ys)[:, None, None]
    ends = found[found[:, :, 4] > 0][:, :4].reshape(-1, 2)
    order = (ends[:, 1] * (2 * solid.shape[1] + 2) + ends[:, 0]).argsort(kind="stable")
    mate = np.empty(len(ends), np.int64)
    mate[order[::2]], mate[order[1::2]] = order[1::2], order[::2]
    mate, points = mate.tolist(), list(zip(*(ends / 2).T.tolist(), strict=True))
    used, loops = [False] * len(points), []
    for first in range(0, len(points), 2):
        if used[first]:
            continue
        loop, at = [], first
        while not used[at & -2]:
            used[at & -2] = True
            loop.append(points[at])
            at = mate[at ^ 1]
        loops.append(loop)
    return loops


def stitched(parts: list[tuple[Point, Point]]) -> list[list[Point]]:
    """Closed loops of segments that share end points."""
    at: dict[Point, list[int]] = {}
    for k, (a, b) in enumerate(parts):
        at.setdefault(a, []).append(k)
        at.setdefault(b, []).append(k)
    used, loops = [False] * len(parts), []
    for k, (start, here) in enumerate(parts):
        if used[k]:
            continue
        used[k], loop = True, [start]
        while here != start:
            loop.append(here)
            step = next((i for i in at[here] if not used[i]), None)
            if step is None:
                break
            used[step] = True
            a, b = parts[step]
            here = b if a == here else a
        loops.append(loop)
    return loops


def simplified(points: list[Point], tolerance: float) -> list[Point]:
    """Ramer-Douglas-Peucker: the ends stay, and every point further than the tolerance from the line between kept ones."""
    if len(points) <= 2 or tolerance <= 0:
        return list(points)
    keep, stack, p = {0, len(points) - 1}, [(0, len(points) - 1)], np.array(points, float)
    plain = p.tolist()
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        (x, y), (dx, dy) = plain[a], plain[b]
        dx, dy = dx - x, dy - y
        length = float(np.hypot(dx, dy))
        if length and b - a < 40:
            # A few points are looked at faster one by one.
            most, k, at = -1.0, a, a
            for u, v in plain[a + 1 : b]:
                at += 1
                away = abs(dx * (v - y) - dy * (u - x)) / length
                if away > most:
                    most, k = away, at
            if most > tolerance:
                keep.add(k)
                stack += [(a, k), (k, b)]
            continue
        inner = p[a + 1 : b] - p[a]
        far = np.abs(dx * inner[:, 1] - dy * inner[:, 0]) / length if length else np.hypot(inner[:, 0], inner[:, 1])
        k = int(far.argmax())
        if far[k] > tolerance:
            keep.add(a + 1 + k)
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return [points[k] for k in sorted(keep)]


def inside(point: Point, loop: list[Point]) -> bool:
    """Even-odd rule."""
    x, y = point
    odd = False
    for (x0, y0), (x1, y1) in zip(loop, loop[1:] + loop[:1], strict=True):
        if (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0:
            odd = not odd
    return odd


def nested(loops: list[list[Point]]) -> list[tuple[list[Point], bool]]:
    """Loops with whether they are holes: those inside an odd number of others."""
    return [(loop, sum(inside(loop[0], other) for other in loops if other is not loop) % 2 == 1) for loop in loops]


def triangles(ring: list[Point]) -> list[tuple[int, int, int]]:
    """Ear clipping of a simple ring, as places in it."""
    def cross(a: Point, b: Point, c: Point) -> float:
        return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])

    area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
    left = list(range(len(ring))) if area > 0 else list(range(len(ring)))[::-1]
    out = []
    while len(left) > 3:
        for k in range(len(left)):
            i, j, m = left[k - 1], left[k], left[(k + 1) % len(left)]
            turn = cross(ring[i], ring[j], ring[m])
            if turn == 0 or turn > 0 and not any(cross(ring[i], ring[j], ring[q]) >= 0 and cross(ring[j], ring[m], ring[q]) >= 0 and cross(ring[m], ring[i], ring[q]) >= 0 for q in left if q not in (i, j, m)):
                if turn:
                    out.append((i, j, m))
                del left[k]
                break
        else:
            out.append((left[-1], left[0], left[1]))
            del left[0]
    if len(left) == 3 and cross(*(ring[k] for k in left)):
        out.append(tuple(left))
    return out


def outline(mask: np.ndarray, tolerance: float) -> list[tuple[list[Point], bool]]:
    """Simplified contours of a mask, with whether each is a hole."""
    loops = []
    for loop in stitched(segments(mask)):
        closed = simplified([*loop, loop[0]], tolerance)[:-1]
        if len(closed) >= 3:
            loops.append(closed)
    return nested(loops)


def with_contours(df: DataFrame, mask: str, width: str, tolerance: float = 1.0) -> DataFrame:
    """df with contours of a mask: a binary of one byte for each pixel, solid where it isn't 0, in rows of `width`.

    Null or empty masks, and widths that don't divide them, give no contours.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("points", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))), ("is_hole", pa.bool_())]))
        for batch in batches:
            found = []
            for raw, w in zip(batch.column(mask).to_pylist(), batch.column(width).to_pylist(), strict=True):
                if not raw or not w or len(raw) % w:
                    found.append([])
                    continue
                loops = outline(np.frombuffer(raw, np.uint8).reshape(-1, w) > 0, tolerance)
                found.append([{"points": [{"x": x, "y": y} for x, y in loop], "is_hole": hole} for loop, hole in loops])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, "contours"])

    point = StructType().add("x", DoubleType()).add("y", DoubleType())
    schema = StructType([*df.schema.fields]).add("contours", ArrayType(StructType().add("points", ArrayType(point)).add("is_hole", BooleanType())))
    return df.mapInArrow(run, schema)


def bounds(df: DataFrame, keys: list[str], x: str, y: str, alpha: str, threshold: int = 0) -> DataFrame:
    """keys and left, top, width, height of the pixels (a row each) whose alpha is above the threshold; keys without any are left out."""
    found = df.where(F.col(alpha) > threshold).groupBy(*keys).agg(F.min(x).alias("left"), F.min(y).alias("top"), F.max(x).alias("_r"), F.max(y).alias("_b"))
    return found.select(*keys, "left", "top", (F.col("_r") - F.col("left") + 1).alias("width"), (F.col("_b") - F.col("top") + 1).alias("height"))


def with_margin(bounds_: DataFrame, margin: int, raw_w: Column, raw_h: Column) -> DataFrame:
    """Trim bounds grown on all sides, within the raw size."""
    left, top = F.greatest(F.col("left") - margin, F.lit(0)), F.greatest(F.col("top") - margin, F.lit(0))
    right, low = F.least(F.col("left") + F.col("width") + margin, raw_w), F.least(F.col("top") + F.col("height") + margin, raw_h)
    return bounds_.withColumns({"left": left, "top": top, "width": right - left, "height": low - top})


def to_multiple(size: Column, divisor: int) -> Column:
    """A size rounded up to what a divisor divides; divisors below 2 change nothing."""
    return (F.ceil(size / divisor) * divisor).cast("long") if divisor > 1 else size
