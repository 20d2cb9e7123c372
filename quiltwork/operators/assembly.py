"""What a run puts together: places for sprites and their aliases, names of files, references, checks and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiltwork.functions.text import expand_name, file_name, with_extension, without_extension

PLACE = ("page", "x", "y", "frame_w", "frame_h")


def canonical_path(path: Column) -> Column:
    """A path without empty and . components, each .. taken back; whether it begins at the root stays. Links aren't followed."""
    start = F.array().cast("array<string>")
    step = lambda done, part: (
        F.when(part.isin("", "."), done).when((part == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != ".."), F.slice(done, 1, F.size(done) - 1))
        .when((part == "..") & path.startswith("/"), done).otherwise(F.array_append(done, part))
    )
    body = F.array_join(F.aggregate(F.split(path, "/"), start, step), "/")
    return F.when(path.startswith("/"), F.concat(F.lit("/"), body)).otherwise(F.when(body == "", ".").otherwise(body))


def in_path_order(df: DataFrame, path: str, id_: str) -> DataFrame:
    """df with rank, from 0: by the path's components, then by id_.

    The first component's rows are counted and summed up, ranks within a first component are a window's: no window holds the table
    unless all paths begin alike.
    """
    parted = df.withColumn("_parts", F.split(path, "/")).withColumn("_head", F.get("_parts", F.lit(0)))
    before = parted.groupBy("_head").agg(F.count("*").alias("_n")).withColumn("_before", F.expr("coalesce(sum(_n) over (order by _head rows between unbounded preceding and 1 preceding), 0)"))
    own = parted.withColumn("_own", F.expr(f"row_number() over (partition by _head order by _parts, {id_})"))
    return own.join(before.drop("_n"), "_head").withColumn("rank", (F.col("_before") + F.col("_own") - 1).cast("long")).drop("_parts", "_head", "_before", "_own")


def is_normal_map(rel: Column, suffix: str, part: str = "") -> Column:
    """Whether an id names a normal map: it holds `part`, whatever the case, or its file name ends in the suffix. Empty ones match nothing."""
    found = F.lit(False)
    if part:
        found = F.contains(F.lower(rel), F.lit(part.lower()))
    return found | file_name(rel).endswith(suffix) if suffix else found


def is_normal_file(path: Column, suffix: str) -> Column:
    """Whether a file's name without extension ends in the suffix."""
    return without_extension(file_name(path)).endswith(suffix) if suffix else F.lit(False)


def holds_ignoring_case(name: Column, part: str) -> Column:
    return F.contains(F.lower(name), F.lit(part.lower()))


def content_hash(content: Column, digits: int = 16) -> Column:
    """The first hexadecimal digits of a content's SHA-256: 16 for equality, 8 as a short version mark."""
    return F.substring(F.sha2(content.cast("binary"), 256), 1, digits)


def with_places(sprites: DataFrame, placed: DataFrame, id_: str = "id") -> DataFrame:
    """sprites (id, alias_of) with page, x, y, frame_w, frame_h: owners have their own place, aliases their owner's.

    One join by the id that has the place. Sprites that nothing places keep nulls.
    """
    places = placed.select(F.col(id_).alias("_owner"), *PLACE)
    return sprites.withColumn("_owner", F.coalesce("alias_of", id_)).join(places, "_owner", "left").drop("_owner")


def sprites_of_paths(paths: DataFrame, sprites: DataFrame, path: str) -> DataFrame:
    """paths with the id of the sprite that came from each; null for others. A path is one sprite's."""
    return paths.join(sprites.select(path, "id"), path, "left")


def first_named(df: DataFrame, name: str, named: int = 8) -> Column:
    """An aggregate for messages: the first names in order, and how many more there are."""
    names = F.sort_array(F.collect_set(name))
    return F.concat(F.array_join(F.slice(names, 1, named), ", "), F.when(F.size(names) > named, F.concat(F.lit(" and "), (F.size(names) - named).cast("string"), F.lit(" more"))).otherwise(F.lit("")))


def unsupported_keys(df: DataFrame, key: str, supported: list[str], named: int = 8) -> DataFrame:
    """Keys that occur and aren't supported, the first of them in order."""
    return df.where(~F.col(key).isin(supported)).select(key).distinct().orderBy(key).limit(named)


def repeated_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """field, value, times: what should be distinct and isn't."""
    each = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("e"))
    return each.groupBy("e.field", "e.value").agg(F.count("*").alias("times")).where("times > 1")


def page_file(base: str, index: Column, suffix: Column, extension: str) -> Column:
    return with_extension(expand_name(base, index, suffix), extension)


def normal_page_file(base: str, index: Column, suffix: Column, extension: str, sheet: str = "") -> Column:
    """The file of a page's normal map: its own base name, or the page's with _normal."""
    return page_file(sheet if sheet.strip() else f"{base}_normal", index, suffix, extension)


def metadata_file(base: str, index: Column, suffix: Column, extension: str, per_page: bool) -> Column:
    """The file of a page's metadata; one for all pages goes by the first page's name."""
    return page_file(base, index if per_page else F.lit(0).cast("long"), suffix, extension)


def texture_reference(file: Column, folder: str | None = None, version: Column | None = None) -> Column:
    """How metadata refer to a texture: below a folder, and with a version behind it so that caches notice changes."""
    prefix = (folder or "").strip()
    named = F.concat(F.lit(prefix.rstrip("/") + "/"), file) if prefix else file
    return named if version is None else F.when(version == "", named).otherwise(F.concat(named, F.lit("?v="), version))


def rounded(x: Column, digits: int) -> Column:
    """A number in single precision, scaled, rounded half away from zero and scaled back."""
    scale = F.lit(float(10**digits)).cast("float")
    return (F.round((x.cast("float") * scale).cast("double")).cast("float") / scale).cast("float").cast("double")


def size_bounds(items: DataFrame, keys: list[str], padding: int, border: int) -> DataFrame:
    """keys with the least width, height and area that a page for all items can have."""
    w, h = F.col("w") + 2 * padding, F.col("h") + 2 * padding
    return items.groupBy(*keys).agg((F.max(w) + 2 * border).alias("least_w"), (F.max(h) + 2 * border).alias("least_h"), F.sum(w * h).alias("area"))


def run_summary(sprites: DataFrame) -> DataFrame:
    """One row of a run's sprites (with_places()): sprites, aliases, pages, those without a place, and the area of frames that are drawn."""
    own = F.col("alias_of").isNull() & F.col("page").isNotNull()
    return sprites.agg(
        F.count("*").alias("sprites"), F.count("alias_of").alias("aliases"), F.coalesce(F.max("page") + 1, F.lit(0)).cast("long").alias("pages"),
        F.sum(F.col("page").isNull().cast("long")).alias("unplaced"), F.sum(F.when(own, F.col("frame_w") * F.col("frame_h")).otherwise(0)).cast("long").alias("area"),
    )


def ordered_frames(df: DataFrame, keys: list[str], order: str, frame: str, between: str = ">") -> DataFrame:
    """keys, frames and n: the frames of each group in order. A group bounds a row."""
    found = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, frame))).alias("_f"))
    return found.select(*keys, F.array_join(F.col(f"_f.{frame}"), between).alias("frames"), F.size("_f").cast("long").alias("n"))


def crc16(content: Column) -> Column:
    """CRC-16 with the polynomial 0x1021, beginning at 0, of a content's bytes."""

    def shift(crc: Column, _: Column) -> Column:
        return F.when(crc >= 0x8000, F.shiftleft(crc, 1).bitwiseXOR(0x1021)).otherwise(F.shiftleft(crc, 1)).bitwiseAND(0xFFFF)

    pairs = F.regexp_extract_all(F.hex(content), F.lit(".."), F.lit(0))
    byte = lambda pair: F.conv(pair, 16, 10).cast("int")
    return F.aggregate(pairs, F.lit(0), lambda crc, pair: F.aggregate(F.sequence(F.lit(1), F.lit(8)), crc.bitwiseXOR(F.shiftleft(byte(pair), 8)), shift))


def rasterised(shapes: DataFrame, keys: list[str], points: str, width: Column, height: Column) -> DataFrame:
    """keys, y, first and last: runs of the pixels that a polygon (array of x, y) fills by the even-odd rule, within width and height.

    A row is cut at its middle; a run has each pixel of which the cut covers a part. Edges at crossings that aren't numbers paint nothing.
    """
    rows = shapes.select(*keys, points, width.alias("_w"), F.explode(F.sequence(F.lit(0).cast("long"), height.cast("long") - 1)).alias("y")).where(F.size(points) >= 3)
    at = F.col("y") + 0.5
    edge = lambda a, i: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), F.get(F.col(points), (i + 1) % F.size(points))["x"].alias("bx"), F.get(F.col(points), (i + 1) % F.size(points))["y"].alias("by"))
    crossed = F.filter(F.transform(F.col(points), edge), lambda e: (e["ay"] <= at) != (e["by"] <= at))
    xs = F.sort_array(F.transform(crossed, lambda e: e["ax"] + (at - e["ay"]) / (e["by"] - e["ay"]) * (e["bx"] - e["ax"])))
    # The crossings are an argument, so that they are found once a row and not once for each of them.
    pairs = lambda c: F.filter(F.transform(c, lambda x, i: F.when(i % 2 == 0, F.struct(x.alias("a"), F.get(c, i + 1).alias("b")))), lambda r: r.isNotNull() & r["b"].isNotNull())
    runs = F.flatten(F.transform(F.array(xs), pairs))
    found = rows.select(*keys, "_w", "y", F.explode(runs).alias("r")).where(~F.isnan("r.a") & ~F.isnan("r.b") & (F.col("r.b") > 0) & (F.col("r.a") < F.col("_w")))
    return found.select(*keys, "y", F.greatest(F.floor("r.a"), F.lit(0)).cast("long").alias("first"), F.least(F.greatest(F.ceil("r.b") - 1, F.lit(0)), F.col("_w") - 1).cast("long").alias("last"))


def solid_borders(pixels: DataFrame, keys: list[str], width: Column, height: Column, threshold: int, tolerance: int, most: int) -> DataFrame:
    """keys with left, top, right and bottom: how many lines in a row from each side are bars of one colour.

    A line is a bar if it has a visible pixel (alpha above the threshold) and all visible ones agree with its first in every
    channel within the tolerance. pixels: x, y, r, g, b, a.
    """
    seen = pixels.where(F.col("a") > threshold)

    def bars(line: str, along: str) -> DataFrame:
        near = [F.abs(F.col(c) - F.col(f"_f.{c}")) <= tolerance for c in "rgba"]
        first = seen.groupBy(*keys, line).agg(F.min_by(F.struct(*"rgba"), along).alias("_f"))
        good = seen.join(first, [*keys, line]).groupBy(*keys, line).agg(F.bool_and(near[0] & near[1] & near[2] & near[3]).alias("_bar"))
        return good.where("_bar").groupBy(*keys).agg(F.collect_set(line).alias(f"_{line}"))

    def run(bar: str, size: Column, from_start: bool) -> Column:
        lines = F.sequence(F.lit(0).cast("long"), F.least(size, F.lit(most)).cast("long") - 1)
        missing = F.filter(lines, lambda k: ~F.array_contains(F.col(bar), k if from_start else size - 1 - k))
        return F.coalesce(F.array_min(missing), F.least(size, F.lit(most))).cast("long")

    sizes = pixels.groupBy(*keys).agg(F.max(width).cast("long").alias("_w"), F.max(height).cast("long").alias("_h"))
    both = sizes.join(bars("x", "y"), keys, "left").join(bars("y", "x"), keys, "left")
    none = F.array().cast("array<bigint>")
    both = both.withColumns({"_x": F.coalesce("_x", none), "_y": F.coalesce("_y", none)})
    w, h = F.col("_w"), F.col("_h")
    return both.select(*keys, run("_x", w, True).alias("left"), run("_y", h, True).alias("top"), run("_x", w, False).alias("right"), run("_y", h, False).alias("bottom"))


def normal_part(normals: DataFrame, sprites: DataFrame, keys: list[str], channels: list[str]) -> DataFrame:
    """keys, x, y and channels of what a trimmed sprite shows of its normal map.

    sprites: keys, raw_w, raw_h, left, top, w, h, and normal_w, normal_h of the map, of which the nearest pixel is taken where its size isn't the sprite's.
    """
    near = lambda v, raw, size: F.least(F.floor(v * F.col(size) / F.col(raw)), F.col(size) - 1).cast("long")
    wanted = sprites.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("w") - 1))).withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("h") - 1)))
    wanted = wanted.select(*keys, "x", "y", near(F.col("left") + F.col("x"), "raw_w", "normal_w").alias("_x"), near(F.col("top") + F.col("y"), "raw_h", "normal_h").alias("_y"))
    return wanted.join(normals.select(*keys, F.col("x").alias("_x"), F.col("y").alias("_y"), *channels), [*keys, "_x", "_y"]).drop("_x", "_y")


def around(pixels: DataFrame, keys: list[str], size: tuple[int, int], colour: str) -> DataFrame:
    """keys, x, y and p, an array of a pixel's colour (in the middle) and those of its eight neighbours by rows; edges repeat outwards."""
    w, h = size

    def sent(at: str, last: int) -> Column:
        """Lines that see this one, with the place (0 to 2) at which they do."""
        near = [F.struct((F.col(at) + 1 - k).alias("to"), F.lit(k).alias("k")) for k in range(3)]
        beyond = [F.when(F.col(at) == 0, F.struct(F.col(at).alias("to"), F.lit(0).alias("k"))), F.when(F.col(at) == last, F.struct(F.col(at).alias("to"), F.lit(2).alias("k")))]
        return F.explode(F.filter(F.array(*near, *beyond), lambda s: s.isNotNull() & (s["to"] >= 0) & (s["to"] <= last)))

    met = pixels.select(*keys, "x", "y", F.col(colour).alias("_v")).withColumn("_x", sent("x", w - 1)).withColumn("_y", sent("y", h - 1))
    seen = met.groupBy(*keys, F.col("_x.to").alias("x"), F.col("_y.to").alias("y")).agg(F.sort_array(F.collect_list(F.struct((F.col("_y.k") * 3 + F.col("_x.k")).alias("k"), "_v"))).alias("_p"))
    return seen.select(*keys, "x", "y", F.col("_p._v").alias("p"))


def art(pixels: DataFrame, keys: list[str], size: tuple[int, int], colour: str, how: str) -> DataFrame:
    """Pixel art enlarged by a rule: scale3 (three times), scale4 (scale2 twice) or eagle (twice). Colour is one column.

    scale3 and scale2: a corner takes the colour of the two sides that meet there if they agree and differ from the sides
    opposite; the middle of a side takes its own side's colour if a corner beside it did and the pixel beyond the other
    corner differs from the middle. eagle: a corner takes the colour of the three pixels around it if they are alike.
    """
    if how == "scale4":
        return art(art(pixels, keys, size, colour, "scale2"), keys, (2 * size[0], 2 * size[1]), colour, "scale2")
    p = [F.get("p", F.lit(k)) for k in range(9)]
    middle, up, left, right, down = p[4], p[1], p[3], p[5], p[7]
    # Corners by their two sides and the sides opposite; the corner pixels of the neighbourhood by the same numbers.
    corners = {(0, 0): (left, up, down, right), (1, 0): (up, right, left, down), (0, 1): (down, left, right, up), (1, 1): (right, down, up, left)}
    takes = {at: (a == b) & (a != c) & (b != d) for at, (a, b, c, d) in corners.items()}
    diagonal = {(0, 0): p[0], (1, 0): p[2], (0, 1): p[6], (1, 1): p[8]}
    if how == "eagle":
        out = {at: F.when((corners[at][0] == diagonal[at]) & (corners[at][1] == diagonal[at]), diagonal[at]).otherwise(middle) for at in corners}
        times = 2
    elif how == "scale2":
        out, times = {at: F.when(takes[at], corners[at][0]).otherwise(middle) for at in corners}, 2
    else:
        out, times = {(2 * i, 2 * j): F.when(takes[i, j], corners[i, j][0]).otherwise(middle) for i, j in corners}, 3
        out[1, 1] = middle
        for spot, side, one, two in (((1, 0), up, (0, 0), (1, 0)), ((0, 1), left, (0, 0), (0, 1)), ((2, 1), right, (1, 0), (1, 1)), ((1, 2), down, (0, 1), (1, 1))):
            out[spot] = F.when((takes[one] & (middle != diagonal[two])) | (takes[two] & (middle != diagonal[one])), side).otherwise(middle)
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), v.alias("v")) for (i, j), v in out.items()])).alias("c")
    each = around(pixels, keys, size, colour).select(*keys, "x", "y", cells)
    return each.select(*keys, (times * F.col("x") + F.col("c.i")).alias("x"), (times * F.col("y") + F.col("c.j")).alias("y"), F.col("c.v").alias(colour))
