"""Placement with closed formulas: the grid, page sizes, and audits of placed rectangles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiltwork.functions.numeric import ceil_to, next_pot, snap_nearest


@dataclass(frozen=True)
class PageOptions:
    width: int = 1024
    height: int = 1024
    padding: int = 1
    border: int = 0
    align: int = 0


def ranked(df: DataFrame, keys: list[str], area: str, id_: str) -> DataFrame:
    """df with _rank, from 0: within keys by area and then by id, both descending.

    Ranks within an area are a window's, how many rows have a greater area is a running sum over areas; so no window
    holds more than one area's rows.
    """
    by = ", ".join(keys + [area])
    part = f"partition by {', '.join(keys)} " if keys else ""
    many = df.groupBy(*keys, area).agg(F.count("*").alias("_n"))
    before = many.withColumn("_before", F.expr(f"coalesce(sum(_n) over ({part}order by {area} desc rows between unbounded preceding and 1 preceding), 0)")).drop("_n")
    own = df.withColumn("_own", F.expr(f"row_number() over (partition by {by} order by {id_} desc)"))
    return own.join(before, [*keys, area]).withColumn("_rank", F.col("_before") + F.col("_own") - 1).drop("_before", "_own")


def grid(df: DataFrame, options: PageOptions = PageOptions(), keys: list[str] | None = None, id_: str = "id", w: str = "w", h: str = "h") -> DataFrame:
    """df with page, x, y, frame_w, frame_h: cells of the largest padded size, filled by descending area and id.

    With keys, each group has its own cells and pages. Cells that exceed the page give null places.
    """
    o, keys = options, keys or []
    padded = df.withColumn("frame_w", F.col(w) + 2 * o.padding).withColumn("frame_h", F.col(h) + 2 * o.padding).withColumn("_area", F.col(w) * F.col(h))
    cell = padded.groupBy(*keys).agg(ceil_to(F.max("frame_w"), o.align).alias("_cw"), ceil_to(F.max("frame_h"), o.align).alias("_ch"))
    rows = ranked(padded, keys, "_area", id_)
    rows = rows.join(cell, keys) if keys else rows.join(F.broadcast(cell))  # without keys, one row
    origin = -(-o.border // o.align) * o.align if o.align > 1 else o.border
    iw, ih = o.width - 2 * o.border, o.height - 2 * o.border
    fits = (F.col("_cw") <= o.border + iw - origin) & (F.col("_ch") <= o.border + ih - origin)
    columns = F.floor((o.border + iw - origin) / F.col("_cw")).cast("long")
    per_page = columns * F.floor((o.border + ih - origin) / F.col("_ch")).cast("long")
    rows = rows.withColumn("_cols", F.when(fits, columns)).withColumn("_per", F.when(fits, per_page))
    slot = F.pmod("_rank", F.col("_per"))
    return rows.select(
        *df.columns, F.floor(F.col("_rank") / F.col("_per")).cast("long").alias("page"), (origin + F.pmod(slot, F.col("_cols")) * F.col("_cw")).cast("long").alias("x"),
        (origin + F.floor(slot / F.col("_cols")) * F.col("_ch")).cast("long").alias("y"), F.col("frame_w").cast("long").alias("frame_w"), F.col("frame_h").cast("long").alias("frame_h"),
    )


def page_sizes(placed: DataFrame, keys: list[str], border: int = 0, rule: str = "any") -> DataFrame:
    """keys, width, height, sprites: the extents of each page plus the border, by rule any, pot, x4 or square."""
    found = placed.groupBy(*keys).agg((F.max(F.col("x") + F.col("frame_w")) + border).alias("width"), (F.max(F.col("y") + F.col("frame_h")) + border).alias("height"), F.count("*").alias("sprites"))
    for side in ("width", "height"):
        if rule == "pot":
            found = found.withColumn(side, next_pot(F.col(side)))
        if rule == "x4":
            found = found.withColumn(side, ceil_to(F.col(side), 4))
    if rule == "square":
        found = found.withColumn("width", F.greatest("width", "height")).withColumn("height", F.col("width"))
    return found


def overlaps(placed: DataFrame, keys: list[str], id_: str = "id", cell: int = 64) -> DataFrame:
    """Pairs of rectangles on a page that have area in common: a, b with a < b.

    Rectangles meet in the squares of a coarse raster that they cover; a pair counts in the first square that both cover,
    so it comes once, and pages with very many rectangles are joined square by square.
    """
    low, high = (lambda c: F.floor(F.col(c) / cell)), (lambda c, s: F.floor((F.col(c) + F.col(s) - 1) / cell))
    spread = placed.where("frame_w > 0 and frame_h > 0").select(*keys, id_, "x", "y", "frame_w", "frame_h", F.explode(F.sequence(low("x"), high("x", "frame_w"))).alias("_i"))
    spread = spread.withColumn("_j", F.explode(F.sequence(low("y"), high("y", "frame_h"))))
    a, b = (spread.select(*keys, "_i", "_j", *[F.col(c).alias(f"{s}_{c}") for c in (id_, "x", "y", "frame_w", "frame_h")]) for s in "ab")
    c = F.col
    meet = (c("a_x") < c("b_x") + c("b_frame_w")) & (c("b_x") < c("a_x") + c("a_frame_w")) & (c("a_y") < c("b_y") + c("b_frame_h")) & (c("b_y") < c("a_y") + c("a_frame_h"))
    once = (F.floor(F.greatest("a_x", "b_x") / cell) == c("_i")) & (F.floor(F.greatest("a_y", "b_y") / cell) == c("_j"))
    return a.join(b, [*keys, "_i", "_j"]).where((c(f"a_{id_}") < c(f"b_{id_}")) & meet & once).select(*keys, c(f"a_{id_}").alias("a"), c(f"b_{id_}").alias("b"))


def containing(outer: DataFrame, inner: DataFrame, keys: list[str], id_: str = "id", cell: int = 64) -> DataFrame:
    """Pairs (outer, inner) of a page where the outer rectangle holds the inner one; they meet where the inner one begins."""
    low, high = (lambda c: F.floor(F.col(c) / cell)), (lambda c, s: F.floor((F.col(c) + F.col(s)) / cell))
    names = (id_, "x", "y", "frame_w", "frame_h")
    a = outer.select(*keys, *[F.col(c).alias(f"a_{c}") for c in names], F.explode(F.sequence(low("x"), high("x", "frame_w"))).alias("_i"), low("y").alias("_j0"), high("y", "frame_h").alias("_j1"))
    a = a.withColumn("_j", F.explode(F.sequence("_j0", "_j1"))).drop("_j0", "_j1")
    b = inner.select(*keys, *[F.col(c).alias(f"b_{c}") for c in names], low("x").alias("_i"), low("y").alias("_j"))
    c = F.col
    holds = (c("a_x") <= c("b_x")) & (c("a_y") <= c("b_y")) & (c("a_x") + c("a_frame_w") >= c("b_x") + c("b_frame_w")) & (c("a_y") + c("a_frame_h") >= c("b_y") + c("b_frame_h"))
    return a.join(b, [*keys, "_i", "_j"]).where(holds).select(*keys, c(f"a_{id_}").alias("outer"), c(f"b_{id_}").alias("inner"))


def slices(df: DataFrame, w: str, h: str, margin: int, spacing: int, cells: tuple[int, int] | None = None, cell: tuple[int, int] | None = None) -> DataFrame:
    """df with row, col, x, y, cell_w, cell_h for each cell of a sheet: so many columns and rows, or cells of a size.

    Cells that would pass the sheet's edge are left out.
    """
    usable_w, usable_h = F.col(w) - 2 * margin, F.col(h) - 2 * margin
    if cells:
        many_x, many_y = F.lit(cells[0]).cast("long"), F.lit(cells[1]).cast("long")
        size_x, size_y = (F.floor((u - spacing * (n - 1)) / n).cast("long") for u, n in ((usable_w, cells[0]), (usable_h, cells[1])))
    else:
        size_x, size_y = F.lit(cell[0]).cast("long"), F.lit(cell[1]).cast("long")
        many_x, many_y = (F.floor((u + spacing) / (n + spacing)).cast("long") for u, n in ((usable_w, cell[0]), (usable_h, cell[1])))
    sized = df.withColumn("cell_w", size_x).withColumn("cell_h", size_y).withColumn("_nx", many_x).withColumn("_ny", many_y).where("_nx > 0 and _ny > 0 and cell_w > 0 and cell_h > 0")
    each = sized.withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_ny") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nx") - 1)))
    each = each.withColumn("x", margin + F.col("col") * (F.col("cell_w") + spacing)).withColumn("y", margin + F.col("row") * (F.col("cell_h") + spacing))
    return each.where((F.col("x") + F.col("cell_w") <= F.col(w)) & (F.col("y") + F.col("cell_h") <= F.col(h))).drop("_nx", "_ny")


def dropped(frames: DataFrame, keys: list[str], id_: str, at_x: Column, at_y: Column, canvas: tuple[int, int], border: int = 0, padding: int = 0, step: int = 0) -> DataFrame:
    """keys, id and wish_x, wish_y: where placed frames (x, y, w, h) land that are dropped together at a point.

    The first by id lands with its pixels under the point, on a grid of `step` if there is one; the others keep their places
    relative to it, and each stays on the canvas with its padding. The point is one for each of the keys' groups.
    """
    first = frames.groupBy(*keys).agg(F.min(F.struct(id_, "x", "y")).alias("_first"))
    inset = border + padding
    landed = frames.join(first, keys) if keys else frames.crossJoin(first)

    def wish(c: str, at: Column, size: str, side: int) -> Column:
        anchor = F.greatest(at.cast("long") - inset, F.lit(0).cast("long"))
        anchor = snap_nearest(anchor, step) if step > 1 else anchor
        most = F.greatest(F.lit(side - 2 * border - 2 * padding) - F.col(size), F.lit(0))
        return F.greatest(F.least(anchor + F.col(c) - F.col(f"_first.{c}"), most), F.lit(0)).cast("long")

    return landed.select(*keys, id_, wish("x", at_x, "w", canvas[0]).alias("wish_x"), wish("y", at_y, "h", canvas[1]).alias("wish_y"))
