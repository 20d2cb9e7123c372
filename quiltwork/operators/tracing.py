"""Contours over tables of pixels: edges are rows, so an image doesn't have to fit one row or task.

A square of four pixels' middles that is partly solid gives one or two directed edges with the solid on their left, so every
point has one edge in and one out. Loops are found by pointer doubling: in each round a point learns of twice as many
points ahead, so rounds are logarithmic in the longest loop, whatever the number of images. Images of up to some points are
done in the task that gets them, many at once, from pixels that come as tiles; only the points of larger ones go through
rounds of joins.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Of a square's solid corners (8 top left, 4 top right, 2 bottom right, 1 bottom left; diagonal ones are joined)
# the edges between the middles of its sides, as (x, y) in halves of a square.
TOP, RIGHT, BOTTOM, LEFT = (1, 0), (2, 1), (1, 2), (0, 1)
EDGES = {
    8: [(LEFT, TOP)], 4: [(TOP, RIGHT)], 2: [(RIGHT, BOTTOM)], 1: [(BOTTOM, LEFT)], 7: [(TOP, LEFT)], 11: [(RIGHT, TOP)], 13: [(BOTTOM, RIGHT)], 14: [(LEFT, BOTTOM)], 12: [(LEFT, RIGHT)], 6: [(TOP, BOTTOM)],
    3: [(RIGHT, LEFT)], 9: [(BOTTOM, TOP)], 5: [(TOP, LEFT), (BOTTOM, RIGHT)], 10: [(RIGHT, TOP), (LEFT, BOTTOM)],
}
#: Of each case its edges, the first and the second, as the halves of a square where they begin and end; -1 if it has none.
STEPS = np.full((2, 16, 4), -1, np.int64)
for _case, _pairs in EDGES.items():
    for _k, (_a, _b) in enumerate(_pairs):
        STEPS[_k, _case] = (*_a, *_b)


def settled(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a checkpoint in the folder that the cluster names; only sessions of one process may leave it out."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or f"file:///tmp/checkpoints/{uuid.uuid4().hex}")
    return df.checkpoint(eager=True)


def point(x: Column, y: Column) -> Column:
    """A point's number from its place in halves of a pixel, from a pixel before the first on."""
    return (F.shiftleft(y.cast("long") + 2, 32) + x.cast("long") + 2).cast("long")


def edges(solid: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """keys, here, ahead: the points of all contours with the next one. solid: a row for each solid pixel; repeated rows count once."""
    corners = F.array(*[F.struct((F.col(x) - dx).alias("cx"), (F.col(y) - dy).alias("cy"), F.lit(bit).alias("bit")) for dx, dy, bit in ((0, 0, 8), (1, 0, 4), (1, 1, 2), (0, 1, 1))])
    squares = solid.select(*keys, F.explode(corners).alias("c")).groupBy(*keys, "c.cx", "c.cy").agg(F.bit_or("c.bit").alias("case"))
    place = lambda p: point(F.col("cx") * 2 + p[0], F.col("cy") * 2 + p[1])
    made = F.lit(None).cast("array<struct<here:bigint,ahead:bigint>>")
    for case, pairs in EDGES.items():
        made = F.when(F.col("case") == case, F.array(*[F.struct(place(a).alias("here"), place(b).alias("ahead")) for a, b in pairs])).otherwise(made)
    return squares.select(*keys, F.explode(made).alias("e")).select(*keys, "e.here", "e.ahead")


def loops(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, loop (its least point), position (from 0 at that point) and here, of edges."""
    now = settled(found.withColumn("least", F.least("here", "ahead")))
    while True:
        far = now.select(*keys, F.col("here").alias("ahead"), F.col("ahead").alias("_ahead"), F.col("least").alias("_least"))
        step = settled(now.join(far, [*keys, "ahead"]).select(*keys, "here", F.col("_ahead").alias("ahead"), F.least("least", "_least").alias("least"), (F.col("_least") < F.col("least")).alias("_new")))
        now = step.drop("_new")
        # While a point hasn't seen its whole loop, some point still learns of a lesser one.
        if step.where("_new").isEmpty():
            break
    of = now.select(*keys, "here", F.col("least").alias("loop"))
    # Each loop is cut before its least point; a point's way to the cut gives its position.
    way = settled(found.join(of, [*keys, "here"]).withColumn("ahead", F.when(F.col("ahead") != F.col("loop"), F.col("ahead"))).withColumn("left", F.col("ahead").isNotNull().cast("long")))
    while not way.where("ahead is not null").isEmpty():
        far = way.select(*keys, F.col("here").alias("ahead"), F.col("ahead").alias("_ahead"), F.col("left").alias("_left"))
        way = settled(way.join(far, [*keys, "ahead"], "left").select(*keys, "here", F.col("_ahead").alias("ahead"), "loop", (F.col("left") + F.coalesce("_left", F.lit(0))).alias("left")))
    size = way.where("here = loop").select(*keys, "loop", F.col("left").alias("_most"))
    return way.join(size, [*keys, "loop"]).select(*keys, "loop", (F.col("_most") - F.col("left")).alias("position"), "here")


def closed(image: np.ndarray, here: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of whole images' edges the loop (its least point) and the position in it."""
    points, at = np.unique(np.concatenate([here, ahead]), return_inverse=True)
    own, to = image * len(points) + at[: len(here)], image * len(points) + at[len(here) :]
    order = np.argsort(own)
    row = lambda code: order[np.searchsorted(own[order], code)]
    after = row(to)
    least, jump = np.minimum(here, ahead), after
    while not np.array_equal(less := np.minimum(least, least[jump]), least):
        least, jump = less, jump[jump]
    # Each loop is cut before its least point.
    left = (ahead != least).astype(np.int64)
    jump = np.where(left > 0, after, np.arange(len(here)))
    while (more := left[jump]).any():
        left, jump = left + more, jump[jump]
    return least, left[row(image * len(points) + np.searchsorted(points, least))] - left


def by_images(batches: Iterator[pa.RecordBatch], keys: list[str], most: int, done: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], passed: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """done() of rows of whole images and of each row's image, from 0 on, many images at once; passed() of rows of images with more than so many. Rows come sorted by keys."""
    held: list[pa.RecordBatch] = []
    size, large = 0, None  # rows that are held; the keys of an image that is being passed on

    def ended(last: bool) -> Iterator[pa.RecordBatch]:
        """What is held, but for the last image if more of it may come."""
        nonlocal held, size, large
        part = pa.Table.from_batches(held).combine_chunks()
        change = np.zeros(len(part), bool)
        for k in keys:
            change[1:] |= pc.not_equal(part.column(k).slice(1), part.column(k).slice(0, len(part) - 1)).to_numpy(zero_copy_only=False)
        begins = np.append(0, np.flatnonzero(change))
        if large is not None and large == [part.column(k)[0].as_py() for k in keys]:
            end = len(part) if len(begins) == 1 else int(begins[1])
            yield from passed(part.slice(0, end))
            part, change, begins = part.slice(end), change[end:], begins[1:] - end
        end = len(part) if last or not len(begins) else int(begins[-1])
        if len(part) - end > most:
            large = [part.column(k)[len(part) - 1].as_py() for k in keys]
            yield from passed(part.slice(end))
            part, change = part.slice(0, end), change[:end]
        if end:
            image = np.cumsum(change[:end])
            yield from done(part.slice(0, end), image - image[0])
        held = part.slice(end).to_batches()
        size = len(part) - end

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
            if size > most:
                yield from ended(False)
    if size:
        yield from ended(True)


def looped(found: DataFrame, keys: list[str], most: int = 200_000) -> DataFrame:
    """loops() of edges, with images of at most so many points closed where they stand."""
    kept = [T.StructField(k, found.schema[k].dataType) for k in keys]
    kind = T.StructType([*kept, *(T.StructField(c, T.LongType()) for c in ("here", "ahead", "loop", "position"))])

    def passed(part: pa.Table) -> Iterator[pa.RecordBatch]:
        none = pa.nulls(len(part), pa.int64())
        yield from part.append_column("loop", none).append_column("position", none).to_batches()

    def done(part: pa.Table, image: np.ndarray) -> Iterator[pa.RecordBatch]:
        loop, position = closed(image, *(part.column(c).to_numpy() for c in ("here", "ahead")))
        yield from part.append_column("loop", pa.array(loop)).append_column("position", pa.array(position)).to_batches()

    told = settled(found.select(*keys, "here", "ahead").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lambda batches: by_images(batches, keys, most, done, passed), kind))
    out = told.where("loop is not null").select(*keys, "loop", "position", "here")
    large = told.where("loop is null").select(*keys, "here", "ahead")
    return out if large.isEmpty() else out.unionByName(loops(large, keys))


def tiles(solid: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """keys, tx, ty, bits: solid pixels by squares of eight by eight, a bit each from the top left on, row by row. Repeated pixels count once."""
    x, y = F.col(x).cast("long"), F.col(y).cast("long")
    place = (y.bitwiseAND(F.lit(7).cast("long")) * 8 + x.bitwiseAND(F.lit(7).cast("long"))).cast("int")
    one = solid.select(*keys, F.shiftright(x, 3).alias("tx"), F.shiftright(y, 3).alias("ty"), place.alias("_k"))
    return one.groupBy(*keys, "tx", "ty").agg(F.bit_or(F.expr("shiftleft(1L, _k)")).alias("bits"))


def tile_edges(image: np.ndarray, tx: np.ndarray, ty: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """edges() of tiles: the image, here and ahead."""
    solid = np.unpackbits(bits.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").reshape(-1, 8, 8)
    case = np.zeros((len(bits), 9, 9), np.uint8)  # squares from a pixel before a tile on
    for dx, dy, bit in ((0, 0, 8), (1, 0, 4), (1, 1, 2), (0, 1, 1)):
        case[:, 1 - dy : 9 - dy, 1 - dx : 9 - dx] |= solid * np.uint8(bit)
    t, j, i = case.nonzero()
    case, image, cx, cy = case[t, j, i], image[t], tx[t] * 8 + i - 1, ty[t] * 8 + j - 1
    # Squares at a tile's sides are parts of up to four tiles.
    shared = (i == 0) | (i == 8) | (j == 0) | (j == 8)
    own = [v[shared] for v in (image, cy, cx, case)]
    order = np.lexsort((own[2], own[1], own[0]))
    own = [v[order] for v in own]
    begin = np.flatnonzero(np.append(True, (own[0][1:] != own[0][:-1]) | (own[1][1:] != own[1][:-1]) | (own[2][1:] != own[2][:-1])) if len(order) else [])
    whole = np.bitwise_or.reduceat(own[3], begin) if len(begin) else own[3]
    image, cy, cx, case = (np.concatenate([v[~shared], w]) for v, w in zip((image, cy, cx, case), (*(v[begin] for v in own[:3]), whole), strict=True))
    out = []
    for k in (0, 1):
        at = np.flatnonzero(STEPS[k, case, 0] >= 0)
        (ax, ay, bx, by), u, v = STEPS[k, case[at]].T, cx[at] * 2 + 2, cy[at] * 2 + 2
        out.append((image[at], (v + ay << 32) + u + ax, (v + by << 32) + u + bx))
    return tuple(np.concatenate(v) for v in zip(*out, strict=True))


def traced(solid: DataFrame, keys: list[str], x: str, y: str, most: int) -> tuple[DataFrame, DataFrame | None]:
    """keys, loop, points (x, y, in order) of images' contours; and, if an image has more tiles than would have so many points, loops() of such ones.

    Pixels travel as tiles, and points don't travel at all.
    """
    most = max(1, most // 64)
    kept = [T.StructField(k, solid.schema[k].dataType) for k in keys]
    kind = T.StructType([*kept, T.StructField("loop", T.LongType()), T.StructField("points", T._parse_datatype_string("array<struct<x:double,y:double>>"))])
    place = lambda c: (c - 2) / 2 + 0.5

    def done(part: pa.Table, image: np.ndarray) -> Iterator[pa.RecordBatch]:
        near = np.flatnonzero(np.bincount(image)[image] <= most)
        if not len(near):
            return
        own, here, ahead = tile_edges(image[near], *(part.column(c).to_numpy()[near] for c in ("tx", "ty", "bits")))
        loop, position = closed(own, here, ahead)
        order = np.lexsort((position, loop, own))
        own, here, loop = own[order], here[order], loop[order]
        begin = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (loop[1:] != loop[:-1])))
        points = pa.StructArray.from_arrays([pa.array(place(here & 0xFFFFFFFF)), pa.array(place(here >> 32))], ["x", "y"])
        rings = pa.ListArray.from_arrays(pa.array(np.append(begin, len(own)), pa.int32()), points)
        row = np.searchsorted(image, own[begin])
        columns = [part.column(k).combine_chunks().take(pa.array(row)) for k in keys]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(loop[begin]), rings], [*keys, "loop", "points"])

    # By number: tiles are few bytes for what there is to do with them, so by their size they would meet in a task or two.
    parts = 8 * solid.sparkSession.sparkContext.defaultParallelism
    held = settled(tiles(solid, keys, x, y).repartition(parts, *keys).sortWithinPartitions(*keys))
    out = held.mapInArrow(lambda batches: by_images(batches, keys, most, done, lambda part: iter(())), kind)
    many = held.groupBy(*keys).count().where(F.col("count") > most).drop("count")
    if many.isEmpty():
        return out, None
    bit = held.join(many, keys).select(*keys, "tx", "ty", "bits", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("_k")).where("shiftrightunsigned(bits, _k) & 1 = 1")
    pixels = bit.select(*keys, (F.col("tx") * 8 + F.col("_k") % 8).alias("x"), (F.col("ty") * 8 + F.floor(F.col("_k") / 8)).alias("y"))
    half = lambda c: (c - 2) / 2 + 0.5
    far = loops(edges(pixels, keys), keys)
    return out, far.select(*keys, "loop", "position", half(F.pmod("here", F.lit(1 << 32))).alias("px"), half(F.shiftright("here", 32)).alias("py"))


def contours(solid: DataFrame, keys: list[str], x: str = "x", y: str = "y", most: int = 200_000) -> DataFrame:
    """keys, loop, position, px, py: contours' points in order, in pixels; a pixel's own corner is half a pixel before its middle. Images without a solid pixel have none; keys aren't null."""
    near, far = traced(solid, keys, x, y, most)
    out = near.select(*keys, "loop", F.posexplode("points").alias("position", "p")).select(*keys, "loop", F.col("position").cast("long").alias("position"), F.col("p.x").alias("px"), F.col("p.y").alias("py"))
    return out if far is None else out.unionByName(far)


def rings(solid: DataFrame, keys: list[str], x: str = "x", y: str = "y", most: int = 200_000) -> DataFrame:
    """keys, loop, points: contours() with a row for each loop, its points (x, y) in order."""
    near, far = traced(solid, keys, x, y, most)
    if far is None:
        return near
    order = F.sort_array(F.collect_list(F.struct("position", F.struct(F.col("px").alias("x"), F.col("py").alias("y")).alias("p"))))
    return near.unionByName(far.groupBy(*keys, "loop").agg(order["p"].alias("points")))
