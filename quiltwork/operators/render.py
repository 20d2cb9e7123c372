"""Metadata of placed sprites as text, one row or one document for each page."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: id, page and frame columns that the renderers read.
FRAME = ("x", "y", "frame_w", "frame_h")


def tsv_row(id_: Column, page: Column) -> Column:
    return F.concat_ws("\t", id_, page.cast("string"), *[F.col(c).cast("string") for c in FRAME])


def plain_row(id_: Column) -> Column:
    return F.concat(id_, F.lit(" = "), F.concat_ws(" ", *[F.col(c).cast("string") for c in FRAME]))


def json_frame() -> Column:
    return F.to_json(F.struct(F.col("x").alias("x"), F.col("y").alias("y"), F.col("frame_w").alias("w"), F.col("frame_h").alias("h")))


def json_row(id_: Column) -> Column:
    return F.concat(F.lit('{"filename":'), F.to_json(F.array(id_)).substr(F.lit(2), F.length(F.to_json(F.array(id_))) - 2), F.lit(',"frame":'), json_frame(), F.lit("}"))


def escaped(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def xml_row(id_: Column) -> Column:
    return F.concat(F.lit('<SubTexture name="'), escaped(id_), *[F.concat(F.lit(f'" {n}="'), F.col(c).cast("string")) for n, c in zip(("x", "y", "width", "height"), FRAME, strict=True)], F.lit('"/>'))


def css_row(id_: Column) -> Column:
    name = F.regexp_replace(id_, "[^A-Za-z0-9_-]", "-")
    return F.concat(F.lit("."), name, F.lit(" { background-position: "), (-F.col("x")).cast("string"), F.lit("px "), (-F.col("y")).cast("string"), F.lit("px; width: "), F.col("frame_w").cast("string"), F.lit("px; height: "), F.col("frame_h").cast("string"), F.lit("px; }"))


def json_hash_row(id_: Column) -> Column:
    quoted = F.to_json(F.array(id_))
    return F.concat(quoted.substr(F.lit(2), F.length(quoted) - 2), F.lit(':{"frame":'), json_frame(), F.lit("}"))


def plist_row(id_: Column) -> Column:
    c = lambda name: F.col(name).cast("string")
    return F.concat(F.lit("<key>"), escaped(id_), F.lit("</key><dict><key>frame</key><string>{{"), c("x"), F.lit(","), c("y"), F.lit("},{"), c("frame_w"), F.lit(","), c("frame_h"), F.lit("}}</string></dict>"))


def atlas_row(id_: Column) -> Column:
    c = lambda name: F.col(name).cast("string")
    return F.concat(id_, F.lit("\n  rotate: false\n  xy: "), c("x"), F.lit(", "), c("y"), F.lit("\n  size: "), c("frame_w"), F.lit(", "), c("frame_h"), F.lit("\n  index: -1"))


def header_row(id_: Column) -> Column:
    plain = F.regexp_replace(id_, "[^A-Za-z0-9]", "_")
    return F.concat(F.lit("inline constexpr Frame "), F.when(plain.rlike("^[0-9]"), F.concat(F.lit("_"), plain)).otherwise(plain), F.lit("{"), F.concat_ws(", ", *[F.col(c).cast("string") for c in FRAME]), F.lit("};"))


#: How each family writes a sprite; more can be added under other names.
ROWS = {"tsv": None, "plain": plain_row, "json": json_row, "json-hash": json_hash_row, "xml": xml_row, "css": css_row, "plist": plist_row, "atlas": atlas_row, "header": header_row}
ENDS = {
    "plain": ("", "\n", "\n"), "tsv": ("", "\n", "\n"), "json": ('{"frames":[', ",", "]}"), "json-hash": ('{"frames":{', ",", "}}"), "xml": ("<TextureAtlas>\n", "\n", "\n</TextureAtlas>\n"),
    "css": ("", "\n", "\n"), "plist": ('<plist version="1.0"><dict><key>frames</key><dict>', "", "</dict></dict></plist>"), "atlas": ("", "\n", "\n"), "header": ("#pragma once\nstruct Frame { int x, y, w, h; };\n", "\n", "\n"),
}


def register(family: str, row: Callable[[Column], Column], before: str = "", between: str = "\n", after: str = "\n") -> None:
    """Adds a family of one's own: how it writes a sprite (from its id and the frame columns), and what stands around."""
    ROWS[family], ENDS[family] = row, (before, between, after)


def rendered_rows(placed: DataFrame, family: str, id_: str = "id") -> DataFrame:
    """placed with line: each sprite in a family's format (tsv, plain, json, xml or css)."""
    line = tsv_row(F.col(id_), F.col("page")) if family == "tsv" else ROWS[family](F.col(id_))
    return placed.withColumn("line", line)


def documents_of(placed: DataFrame, family: str, keys: list[str], id_: str = "id") -> DataFrame:
    """keys and document: the lines of a page in order of id, with what the format puts around them. A page bounds a document."""
    before, between, after = ENDS[family]
    lines = rendered_rows(placed, family, id_).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(id_).alias("i"), "line"))).alias("_l"))
    return lines.select(*keys, F.concat(F.lit(before), F.array_join("_l.line", between), F.lit(after)).alias("document"))


def offsets(raw_w: Column, raw_h: Column, left: Column, top: Column, width: Column, height: Column) -> dict[str, Column]:
    """How a trimmed part sits in its raw image: from the middle (twice, so it is whole), from the bottom left, and negative from the top left."""
    return {
        "centre_x2": 2 * left + width - raw_w, "centre_y2": 2 * top + height - raw_h, "bottom_left_x": left, "bottom_left_y": raw_h - top - height, "frame_x": -left, "frame_y": -top,
    }


def cropped_pivot(pivot: Column, raw: Column, start: Column, size: Column) -> Column:
    """A pivot, a share of the raw side, as a share of the trimmed side, within 0 and 1."""
    return F.when(size > 0, F.least(F.greatest((pivot * raw - start) / size, F.lit(0.0)), F.lit(1.0))).otherwise(pivot)


def pivot_on_page(pivot: Column, frame: Column, start: Column, raw: Column) -> Column:
    """Where a pivot, a share of the raw side, stands on a page: its frame begins there, and the trimmed part `start` into the raw one."""
    return frame + pivot * F.greatest(raw, F.lit(1)) - start


def pivot_from_page(place: Column, start: Column, raw: Column) -> Column:
    """The pivot of a place within a frame, within 0 and 1."""
    return F.least(F.greatest((place + start).cast("double") / F.greatest(raw, F.lit(1)), F.lit(0.0)), F.lit(1.0))
