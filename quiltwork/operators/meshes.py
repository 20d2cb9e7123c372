"""Meshes of alpha masks: contours with their parents, holes joined to what holds them, triangles, and texture coordinates.

A mask is one row, as its triangles are one sprite's; rows are spread over tasks and go through in Arrow batches.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiltwork.operators.geometry import Point, inside, mask_loops, simplified, texture_points

POINTS = "array<struct<x:double,y:double>>"
MESHED = f"struct<contours:array<struct<points:{POINTS},is_hole:boolean,parent:int>>,mesh:struct<vertices:{POINTS},indices:array<int>>>"


def ring_area(ring: list[Point]) -> float:
    """Twice the signed area, positive if x turns towards y."""
    out, (x, y) = 0, ring[-1]
    for u, v in ring:
        out += x * v - u * y
        x, y = u, v
    return out


def families(loops: list[list[Point]]) -> list[tuple[int, int | None]]:
    """Of each loop how many others hold it, and which of them does so directly. Loops share no points and don't cross."""
    boxes = [(min(x for x, _ in p), min(y for _, y in p), max(x for x, _ in p), max(y for _, y in p)) for p in loops]
    holders = []
    for i, loop in enumerate(loops):
        x, y = loop[0]
        holders.append([k for k, (x0, y0, x1, y1) in enumerate(boxes) if k != i and x0 <= x <= x1 and y0 <= y <= y1 and inside(loop[0], loops[k])])
    return [(len(h), max(h, key=lambda k: len(holders[k])) if h else None) for h in holders]


# Rings have some tens of points, for which plain numbers are faster than arrays.
def side(a: Point, b: Point, c: Point) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def sees(p: Point, q: Point, edges: list[tuple[float, float, float, float]]) -> bool:
    """Whether no edge stands between two points: none crosses their line, and none of the edges' points lies within it."""
    (px, py), (qx, qy) = p, q
    dx, dy = qx - px, qy - py
    left, right, low, high = min(px, qx), max(px, qx), min(py, qy), max(py, qy)
    for ax, ay, bx, by in edges:
        if (ax > right and bx > right) or (ax < left and bx < left) or (ay > high and by > high) or (ay < low and by < low):
            continue
        one = dx * (ay - py) - dy * (ax - px)
        if one == 0:
            if (ax - px) * dx + (ay - py) * dy > 0 and (ax - qx) * dx + (ay - qy) * dy < 0:
                return False
        elif one * (dx * (by - py) - dy * (bx - px)) < 0:
            ex, ey = bx - ax, by - ay
            if (ex * (py - ay) - ey * (px - ax)) * (ex * (qy - ay) - ey * (qx - ax)) < 0:
                return False
    return True


def leaves_inwards(ring: list[Point], k: int, to: Point) -> bool:
    """Whether a line from a corner of a ring with positive area begins on the ring's inner side. Corners may be there more than once."""
    a, b, c = ring[k - 1], ring[k], ring[(k + 1) % len(ring)]
    left_of_in, left_of_out = side(a, b, to) > 0, side(b, c, to) > 0
    return left_of_in and left_of_out if side(a, b, c) > 0 else left_of_in or left_of_out


def bridged(outer: list[Point], holes: list[list[Point]]) -> list[Point] | None:
    """One ring through the outer loop and all holes: each hole hangs on the shortest line of sight between it and the ring; None if one can't be seen.

    Holes are joined from right to left, so one that hides another stands in its way only until it is part of the ring.
    """
    ring = outer if ring_area(outer) > 0 else outer[::-1]
    left = sorted((h if ring_area(h) < 0 else h[::-1] for h in holes), key=lambda h: -max(x for x, _ in h))
    for i, hole in enumerate(left):
        edges = [(*p, *q) for w in (ring, *left[i:]) for p, q in zip(w, w[1:] + w[:1], strict=True)]
        many = len(hole)
        # The shortest come first; of equal ones those at earlier places of the ring, then of the hole.
        near = [((x - u) ** 2 + (y - v) ** 2, a * many + b) for a, (x, y) in enumerate(ring) for b, (u, v) in enumerate(hole)]
        heapq.heapify(near)
        while near:
            a, b = divmod(heapq.heappop(near)[1], many)
            if leaves_inwards(ring, a, hole[b]) and sees(ring[a], hole[b], edges):
                ring = ring[: a + 1] + hole[b:] + hole[: b + 1] + ring[a:]
                break
        else:
            return None
    return ring


def clipped(ring: list[Point]) -> list[tuple[int, int, int]]:
    """Ears of a ring with positive area, which may touch itself where holes were joined; places in the ring. Ends early where no ear is left.

    In each round the first flat corner goes, or else the first ear. Only neighbours of what went change, so turns are kept.
    """
    left, out = list(range(len(ring))), []
    turns = [side(ring[k - 1], p, ring[(k + 1) % len(ring)]) for k, p in enumerate(ring)]

    def drop(k: int) -> None:
        del left[k], turns[k]
        n = len(left)
        for i in ((k - 1) % n, k % n):
            turns[i] = side(ring[left[i - 1]], ring[left[i]], ring[left[(i + 1) % n]])

    while len(left) > 3:
        if 0 in turns:
            drop(turns.index(0))
            continue
        blunt = [ring[i] for i, t in zip(left, turns, strict=True) if t < 0]
        for k, turn in enumerate(turns):
            if turn <= 0:
                continue
            a, b, c = ring[left[k - 1]], ring[left[k]], ring[left[(k + 1) % len(left)]]
            (ax, ay), (bx, by), (cx, cy) = a, b, c
            for p in blunt:
                x, y = p
                if (bx - ax) * (y - ay) - (by - ay) * (x - ax) >= 0 and (cx - bx) * (y - by) - (cy - by) * (x - bx) >= 0 and (ax - cx) * (y - cy) - (ay - cy) * (x - cx) >= 0 and p != a and p != b and p != c:
                    break
            else:
                out.append((left[k - 1], left[k], left[(k + 1) % len(left)]))
                drop(k)
                break
        else:
            return out
    if len(left) == 3 and side(*(ring[k] for k in left)) > 0:
        out.append(tuple(left))
    return out


class Chain:
    """A polygon that is cut in triangles while its points come by height: those that are not cut off yet bend inwards. Places are triangles' corners, with positive areas."""

    def __init__(self, points: list[Point], out: list[int], first: int) -> None:
        self.points, self.out, self.stack, self.right, self.area, self.sound = points, out, [first], 0, 0.0, True

    def add(self, v: int, right: int) -> None:
        """The next point; right: 1 on the right side, -1 on the left one, 0 where both sides end."""
        points, out, stack = self.points, self.out, self.stack
        x, y = points[v]
        if right == self.right:
            b = stack.pop()
            bx, by = points[b]
            while stack:
                a = stack[-1]
                ax, ay = points[a]
                turn = ((bx - ax) * (y - ay) - (by - ay) * (x - ax)) * right
                if turn <= 0:
                    break
                self.area += turn
                out += (a, b, v) if right > 0 else (b, a, v)
                b, bx, by = stack.pop(), ax, ay
            stack += (b, v)
            return
        own = self.right
        a = stack[0]
        ax, ay = points[a]
        for b in stack[1:]:
            bx, by = points[b]
            turn = ((bx - ax) * (y - ay) - (by - ay) * (x - ax)) * own
            if turn > 0:
                self.area += turn
                out += (a, b, v) if own > 0 else (b, a, v)
            elif turn < 0:
                self.sound = False
            a, ax, ay = b, bx, by
        self.stack, self.right = [a, v], right


def swept(loops: list[list[Point]]) -> tuple[list[int], float] | None:
    """Triangles of an outer loop with positive area and holes with negative ones, as places in all their points, and twice their area; None if loops cross.

    Points are taken by height. Between a left and a right side that are open stands a chain, or two where sides met above; the
    next point in between joins both, or the last point of the one.
    """
    points, before, after = [], [], []
    for loop in loops:
        n, m = len(points), len(loop)
        points += loop
        before += [n + m - 1, *range(n, n + m - 1)]
        after += [*range(n + 1, n + m), n]
    order = sorted(range(len(points)), key=lambda k: (points[k][1], points[k][0]))
    rank = [0] * len(points)
    for k, v in enumerate(order):
        rank[v] = k
    out: list[int] = []
    chains: list[Chain] = []

    def begun(v: int) -> Chain:
        chains.append(Chain(points, out, v))
        return chains[-1]

    # A part that is open: its left side's upper and lower point, its right one's, the chain, and the one to its right where two met. It is known by its sides' lower points.
    lefts: dict[int, list] = {}
    rights: dict[int, list] = {}
    for v in order:
        p, n, at = before[v], after[v], rank[v]
        up, down = rank[p] < at, rank[n] < at  # whether the side to the point before, and after, stands above
        if up and down:
            a, b = rights.pop(v, None), lefts.pop(v, None)
            if a is None or b is None:
                return None
            if a is b:
                a[4].add(v, 0)
                if a[5]:
                    a[5].add(v, 0)
                continue
            if a[5]:
                a[5].add(v, 0)
            a[4].add(v, 1)
            if b[5]:
                b[4].add(v, 0)
                b[4] = b[5]
            b[4].add(v, -1)
            a[2], a[3], a[5] = b[2], b[3], b[4]
            rights[a[3]] = a
        elif up:
            a = rights.pop(v, None)
            if a is None:
                return None
            if a[5]:
                a[5].add(v, 0)
                a[5] = None
            a[4].add(v, 1)
            a[2], a[3] = v, n
            rights[n] = a
        elif down:
            b = lefts.pop(v, None)
            if b is None:
                return None
            if b[5]:
                b[4].add(v, 0)
                b[4], b[5] = b[5], None
            b[4].add(v, -1)
            b[0], b[1] = v, p
            lefts[p] = b
        elif side(points[p], points[v], points[n]) > 0:
            lefts[p] = rights[n] = [v, p, v, n, begun(v), None]
        else:
            for a in lefts.values():
                if side(points[a[0]], points[a[1]], points[v]) < 0 < side(points[a[2]], points[a[3]], points[v]):
                    break
            else:
                return None
            one, two = a[4], a[5]
            if two:
                one.add(v, 1)
                two.add(v, -1)
            elif one.right > 0:
                two = begun(one.stack[-1])
                two.add(v, -1)
                one.add(v, 1)
            else:
                one, two = begun(one.stack[-1]), one
                one.add(v, 1)
                two.add(v, -1)
            b = [v, p, a[2], a[3], two, None]
            lefts[p] = rights[a[3]] = b
            a[2], a[3], a[4], a[5] = v, n, one, None
            rights[n] = a
    return (out, sum(c.area for c in chains)) if all(c.sound for c in chains) else None


def covered(ring: list[Point], ears: list[tuple[int, int, int]]) -> float:
    return sum(ring_area([ring[k] for k in ear]) for ear in ears)


def meshed(mask: np.ndarray, tolerance: float, triangulate: bool = True) -> tuple[list[tuple[list[Point], bool, int | None]], list[Point], list[int]]:
    """Contours (points, whether a hole, their parent's place), vertices and the triangles' places of a mask.

    Loops that simplifying leaves with under three points go. Triangles of a solid and its holes cover as much as the one
    without the others; where simplified loops cross, so that they can't, the solid is covered without its holes.
    """
    full = mask_loops(mask)
    small = [simplified([*loop, loop[0]], tolerance)[:-1] for loop in full]
    kept = [k for k, loop in enumerate(small) if len(loop) >= 3]
    of = families([full[k] for k in kept])
    loops = [small[k] for k in kept]
    vertices: list[Point] = []
    indices: list[int] = []
    for k, (depth, _) in enumerate(of):
        if depth % 2 or not triangulate:
            continue
        holes = [loops[i] for i, (_, parent) in enumerate(of) if parent == k and of[i][0] % 2]
        areas = [ring_area(loop) for loop in (loops[k], *holes)]
        wanted = abs(areas[0]) - sum(map(abs, areas[1:]))
        turned = [loop if (area > 0) == (n == 0) else loop[::-1] for n, (loop, area) in enumerate(zip((loops[k], *holes), areas, strict=True))]
        found = swept(turned)
        if found and abs(found[1] - wanted) <= 1e-6 * max(1.0, wanted):
            indices += [len(vertices) + i for i in found[0]]
            for loop in turned:
                vertices += loop
            continue
        # Loops that touch or cross: holes are joined, then ears are cut.
        ring = bridged(loops[k], holes)
        ears = clipped(ring) if ring else []
        if ring is None or abs(covered(ring, ears) - wanted) > 1e-6 * max(1.0, wanted):
            ring = loops[k] if ring_area(loops[k]) > 0 else loops[k][::-1]
            ears = clipped(ring)
        indices += [len(vertices) + i for ear in ears for i in ear]
        vertices += ring
    return [(loop, depth % 2 == 1, parent) for loop, (depth, parent) in zip(loops, of, strict=True)], vertices, indices


def with_meshes(df: DataFrame, mask: str, width: str, tolerance: float = 1.0, to: str = "shape", triangulate: bool = True) -> DataFrame:
    """df with a struct of contours and mesh of a mask: a binary of one byte for each pixel, solid where it isn't 0, in rows of `width`.

    A contour says whether it is a hole and which contour holds it directly. Contours alone cost much less than triangles. Null and empty masks, masks without a solid
    pixel, and widths that don't divide them, have null.
    """
    kind = T._parse_datatype_string(MESHED)
    def lists(ends: list[int], values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

    def points(told: list[Point]) -> pa.Array:
        flat = np.fromiter(chain.from_iterable(told), float, 2 * len(told))
        return pa.StructArray.from_arrays([pa.array(flat[::2]), pa.array(flat[1::2])], ["x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            none, around, hole, held, corners, places = [], [], [], [], [], []
            # Where loops, rows' loops, rows' vertices and rows' triangles end.
            ring_ends, loop_ends, corner_ends, place_ends = [0], [0], [0], [0]
            for raw, w in zip(batch.column(mask).to_pylist(), batch.column(width).to_pylist(), strict=True):
                none.append(not raw or not w or len(raw) % w != 0 or not any(raw))
                if not none[-1]:
                    loops, vertices, indices = meshed(np.frombuffer(raw, np.uint8).reshape(-1, w) > 0, tolerance, triangulate)
                    for loop, is_hole, parent in loops:
                        around += loop
                        ring_ends.append(len(around))
                        hole.append(is_hole)
                        held.append(parent)
                    corners += vertices
                    places += indices
                loop_ends.append(len(hole))
                corner_ends.append(len(corners))
                place_ends.append(len(places))
            contour = pa.StructArray.from_arrays([lists(ring_ends, points(around)), pa.array(hole, pa.bool_()), pa.array(held, pa.int32())], ["points", "is_hole", "parent"])
            mesh = pa.StructArray.from_arrays([lists(corner_ends, points(corners)), lists(place_ends, pa.array(places, pa.int32()))], ["vertices", "indices"])
            shape = pa.StructArray.from_arrays([lists(loop_ends, contour), mesh], ["contours", "mesh"], mask=pa.array(none, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*batch.columns, shape], [*batch.schema.names, to])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(to, kind)]))


def mesh_area(mesh: Column) -> Column:
    """The sum of a mesh's triangles."""
    corner = lambda k, n: F.get(mesh["vertices"], F.get(mesh["indices"], 3 * k + n))
    cross = lambda a, b, c: (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])
    many = F.floor(F.size(mesh["indices"]) / 3).cast("int")
    each = F.when(many > 0, F.transform(F.sequence(F.lit(0), many - 1), lambda k: F.abs(cross(corner(k, 0), corner(k, 1), corner(k, 2))) / 2)).otherwise(F.array().cast("array<double>"))
    return F.aggregate(each, F.lit(0.0), lambda s, t: s + t)


def with_texture_points(mesh: Column, x: Column, y: Column, h: Column, width: Column, height: Column, rotated: Column) -> Column:
    """The mesh with uvs: where its vertices stand on a page of a width and height, to four digits."""
    uvs = texture_points(mesh["vertices"], x, y, h, width, height, rotated)
    return mesh.withField("uvs", F.transform(uvs, lambda p: F.struct(F.round(p["x"], 4).alias("x"), F.round(p["y"], 4).alias("y"))))
