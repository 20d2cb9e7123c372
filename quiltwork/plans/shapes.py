"""Queries of meshes, masks, text images and smaller formulas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltwork.functions import text as tx
from quiltwork.operators import blocks, colour, geometry, indexed, meshes, packing, raster, render, select, tracing
from quiltwork.plans.assembly import _MIXED, _WIDE
from quiltwork.plans.catalogue import _GRID, _XY, _grid, _image, query
from quiltwork.plans.views import PATHS, SPRITES, paths, sprites, table
from quiltwork.sources import images, text_images

_BIT = "CASE WHEN {0} < 0 OR {0} > 7 OR {1} < 0 OR {1} > 15 THEN 0 ELSE bits[{0} * 16 + {1} + 1] END"
_MASKS = f"""code AS (SELECT p_partkey, md5(CAST(p_partkey AS VARCHAR)) AS code FROM part),
    masks AS (SELECT p_partkey, list_transform(range(128), lambda k: CAST(((instr('0123456789abcdef', substr(code, CAST(k // 4 + 1 AS INT), 1)) - 1) >> (3 - k % 4)) & 1 AS INT)) AS bits FROM code),
    cells AS (SELECT p_partkey, bits, c // 17 AS y, c % 17 AS x FROM masks, (SELECT unnest(range(153)) AS c)),
    corners AS (SELECT p_partkey, {_BIT.format("(y - 1)", "(x - 1)")} AS a, {_BIT.format("(y - 1)", "x")} AS b, {_BIT.format("y", "x")} AS c, {_BIT.format("y", "(x - 1)")} AS d FROM cells),
    areas AS (SELECT p_partkey, CASE a + b + c + d WHEN 0 THEN 0 WHEN 1 THEN 0.125 WHEN 3 THEN 0.875 WHEN 4 THEN 1 ELSE CASE WHEN a = c THEN 0.75 ELSE 0.5 END END AS area FROM corners)"""


def _masks(spark: SparkSession, d: str) -> DataFrame:
    """A mask of 16 by 8 pixels for each part, by the bits of a digest."""
    code = F.md5(F.col("p_partkey").cast("string"))
    bits = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.lpad(F.conv(F.substring(code, k + 1, F.lit(1)), 16, 2), 4, "0")), "")
    mask = F.unhex(F.regexp_replace(bits, "([01])", "0$1"))
    # Masks are small and take long, so parts are dealt out before.
    parts = table(spark, d, "part").select("p_partkey").repartition(4 * spark.sparkContext.defaultParallelism)
    return parts.select("p_partkey", mask.alias("mask"), F.lit(16).alias("width"))


@query(f"WITH {_MASKS} SELECT p_partkey, CAST(sum(area) AS DOUBLE) AS area FROM areas GROUP BY p_partkey")
def mesh_areas(spark: SparkSession, d: str) -> DataFrame:
    """What the triangles of masks with holes and islands cover: as much as the squares that a contour cuts."""
    return meshes.with_meshes(_masks(spark, d), "mask", "width", 0.0).select("p_partkey", meshes.mesh_area(F.col("shape.mesh")).alias("area"))


@query(f"WITH {_MASKS} SELECT p_partkey, CAST(sum(area) AS DOUBLE) AS area, CAST(sum(area) AS DOUBLE) AS straight, true AS sound FROM areas GROUP BY p_partkey")
def mesh_families(spark: SparkSession, d: str) -> DataFrame:
    """Contours' areas, holes taken off; triangles of contours without the points that lie on a line; and whether each hole's parent is a solid and each solid's a hole or none."""
    signed = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + F.when(x["is_hole"], -1).otherwise(1) * F.abs(geometry.twice_area(x["points"])) / 2)
    full = meshes.with_meshes(_masks(spark, d), "mask", "width", 0.0, "full", triangulate=False)
    both = meshes.with_meshes(full, "mask", "width", 0.3).select("p_partkey", F.col("full.contours").alias("c"), meshes.mesh_area(F.col("shape.mesh")).alias("straight"))
    sound = F.forall("c", lambda x: F.when(x["parent"].isNull(), ~x["is_hole"]).otherwise(F.get("c", x["parent"])["is_hole"] != x["is_hole"]))
    return both.select("p_partkey", signed(F.col("c")).alias("area"), "straight", sound.alias("sound"))


@query(f"WITH {SPRITES} SELECT ord, [round(CAST(ord % 100 + CASE WHEN ord % 3 = 0 THEN h ELSE 0 END AS DOUBLE) / 256, 4), round(CAST(ord % 50 AS DOUBLE) / 128, 4), round(CAST(ord % 100 + CASE WHEN ord % 3 = 0 THEN h - h ELSE w END AS DOUBLE) / 256, 4), round(CAST(ord % 50 + CASE WHEN ord % 3 = 0 THEN w ELSE h END AS DOUBLE) / 128, 4)] AS uvs FROM sprites")
def mesh_texture_points(spark: SparkSession, d: str) -> DataFrame:
    """Two corners of sprites, some turned, as shares of a page."""
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    mesh = F.struct(F.array(point(F.lit(0), F.lit(0)), point(F.col("w"), F.col("h"))).alias("vertices"), F.array().cast("array<int>").alias("indices"))
    found = meshes.with_texture_points(mesh, F.col("ord") % 100, F.col("ord") % 50, F.col("h"), F.lit(256), F.lit(128), F.col("ord") % 3 == 0)
    return sprites(spark, d).select("ord", F.flatten(F.transform(found["uvs"], lambda p: F.array(p["x"], p["y"]))).alias("uvs"))


_RING = "(x = 0 OR y = 0 OR x = 3 OR y = 3)"


@query(f"""WITH {_XY}, flat AS (SELECT vec_id, x, y, r // 128 AS r, g // 128 AS g, b // 128 AS b, CASE WHEN vec_id % 5 = 0 AND x = 1 THEN 9 ELSE 255 END AS a FROM image), n AS (SELECT vec_id, r, g, b, count(*) AS n FROM flat WHERE {_RING} GROUP BY ALL),
    best AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, r, g, b) AS k FROM n)
    SELECT f.vec_id, f.x, f.y, CAST(CASE WHEN f.vec_id % 5 <> 0 AND f.r = t.r AND f.g = t.g AND f.b = t.b THEN 0 ELSE f.a END AS BIGINT) AS a FROM flat f JOIN best t ON t.vec_id = f.vec_id AND t.k = 1""")
def heuristic_mask(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of few colours: the most frequent one of the border is made clear, unless the block has clear pixels already."""
    own = _image(spark, d).select("vec_id", "x", "y", *[F.floor(F.col(c) / 128).cast("long").alias(c) for c in "rgb"], F.when((F.col("vec_id") % 5 == 0) & (F.col("x") == 1), 9).otherwise(255).cast("long").alias("a"))
    return colour.without_background(own, ["vec_id"], "x", "y", F.lit(4), F.lit(4), list("rgb"), "a").select("vec_id", "x", "y", "a")


@query(f"""WITH {_XY}, t AS (SELECT vec_id, min(x) AS l, min(y) AS t, max(x) AS r, max(y) AS b FROM image WHERE a > 140 GROUP BY vec_id), m AS (SELECT vec_id, greatest(l - 1, 0) AS l, greatest(t - 1, 0) AS t, least(r + 2, 4) AS r, least(b + 2, 4) AS b FROM t)
    SELECT vec_id, l AS "left", t AS top, r - l AS width, b - t AS height, CAST(ceil((r - l) / 3.0) * 3 AS BIGINT) AS wide, CAST(ceil((b - t) / 2.0) * 2 AS BIGINT) AS high FROM m""")
def trim_margin_divisor(spark: SparkSession, d: str) -> DataFrame:
    """Trim bounds with a pixel around within the image, and the sides after them that can be divided."""
    found = geometry.with_margin(geometry.bounds(_image(spark, d), ["vec_id"], "x", "y", "a", 140), 1, F.lit(4).cast("long"), F.lit(4).cast("long"))
    return found.select("*", geometry.to_multiple(F.col("width"), 3).alias("wide"), geometry.to_multiple(F.col("height"), 2).alias("high"))


@query(f"""WITH {SPRITES}, p AS (SELECT ord, CAST(ord % 5 AS DOUBLE) / 4 AS pv, ord % 90 AS x, w + ord % 4 AS raw, ord % 4 AS off FROM sprites) SELECT ord, x + pv * raw - off AS at, least(greatest((x + off - 30) / CAST(raw AS DOUBLE), 0), 1) AS back FROM p""")
def page_pivots(spark: SparkSession, d: str) -> DataFrame:
    """Pivots as places on a page, and places within a frame as pivots of the whole sprite."""
    raw, off, x = F.col("w") + F.col("ord") % 4, F.col("ord") % 4, F.col("ord") % 90
    return sprites(spark, d).select("ord", render.pivot_on_page((F.col("ord") % 5).cast("double") / 4, x, off, raw).alias("at"), render.pivot_from_page(x - 30, off, raw).alias("back"))


@query(f"WITH {PATHS} SELECT page_id, CASE WHEN path LIKE 'site%' THEN regexp_replace(regexp_extract(path, '/(.*)$', 1), '([^/])\\.[^./]*$', '\\1') ELSE regexp_replace(regexp_extract(path, '[^/]*$'), '([^/])\\.[^./]*$', '\\1') END AS id, regexp_extract(path, '[^/]*$') AS name FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'site/' ELSE 'other/' END || path || '.png' AS path FROM paths)")
def relative_ids_of_roots(spark: SparkSession, d: str) -> DataFrame:
    """Ids below a root, with and without folders and extensions."""
    path = F.concat(F.when(F.col("page_id") % 2 == 0, "site/").otherwise("other/"), F.col("path"), F.lit(".png"))
    return paths(spark, d).select("page_id", tx.relative_id(path, ["nowhere", "site/"]).alias("id"), tx.relative_id(path, ["site"], keep_extension=True, prefix=False).alias("name"))


@query(r"SELECT p_partkey, regexp_replace(regexp_replace(printf('%.2f', round(p_size / 8.0, 2)), '(\.[0-9]*?)0+$', '\1'), '\.$', '') AS short FROM part")
def short_numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", tx.short_number(F.col("p_size") / F.lit(8.0)).alias("short"))


@query("SELECT p_partkey, p_name FROM part WHERE p_size % 3 = 0 AND NOT (p_partkey % 2 = 0 AND p_type LIKE 'S%')")
def restored_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Parts that were excluded, less those that are restored by name or by folder."""
    own = table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_size")
    return select.restored(own.where("p_size % 3 = 0"), own.where("p_partkey % 2 = 0 and p_type like 'S%'"), "p_partkey").select("p_partkey", "p_name")


_LETTERS = "abcdefghijklmnop"


@query(f"WITH {_XY} SELECT vec_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(CASE WHEN (4 * y + x) % 5 = 4 THEN 0 ELSE r END AS INT) AS r, CAST(CASE WHEN (4 * y + x) % 5 = 4 THEN 0 ELSE g END AS INT) AS g, CAST(CASE WHEN (4 * y + x) % 5 = 4 THEN 0 ELSE b END AS INT) AS b, CASE WHEN (4 * y + x) % 5 = 4 THEN 0 ELSE 255 END AS a FROM image")
def xpm_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Pixel blocks as XPM files of one or two characters a pixel, every fifth pixel clear, other colours in one, two or four digits a channel or by several keys."""
    per, k = F.col("vec_id") % 2 + 1, F.col("y") * 4 + F.col("x")
    letter = F.rpad(F.substring(F.lit(_LETTERS), (k + 1).cast("int"), F.lit(1)), per.cast("int"), "#")
    pair = lambda c: F.lpad(F.hex(F.col(c).cast("long")), 2, "0")
    spec = F.when(k % 5 == 4, "None").when(k % 5 == 0, F.concat(F.lit("#"), *[F.repeat(pair(c), 2) for c in "rgb"])).otherwise(F.concat(F.lit("#"), *[F.lower(pair(c)) for c in "rgb"]))
    entry = F.concat(F.lit('"'), letter, F.when(k % 2 == 0, F.lit("\tc ")).otherwise(" s name m black c  "), spec, F.lit('",'))
    rows = _image(spark, d).withColumns({"_k": k, "_e": entry, "_l": letter}).groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct("_k", "_e", "_l"))).alias("p"))
    lines = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda y: F.concat(F.lit('"'), F.array_join(F.transform(F.slice("p", y * 4 + 1, F.lit(4)), lambda p: p["_l"]), ""), F.lit('"'))), ",\n")
    content = F.concat(F.lit('/* XPM */\nstatic char *a[] = {\n" 4  4 16 '), (F.col("vec_id") % 2 + 1).cast("string"), F.lit('",\n'), F.array_join(F.transform("p", lambda p: p["_e"]), "\n"), F.lit("\n"), lines, F.lit("};\n"))
    return text_images.pixel_rows(text_images.xpm(rows.select("vec_id", content.alias("content"))), ["vec_id"])


@query(f"WITH {_MASKS} SELECT p_partkey, CAST(k % 16 AS INT) AS x, CAST(k // 16 AS INT) AS y, 0 AS r, 0 AS g, 0 AS b, bits[k + 1] * 255 AS a FROM masks, (SELECT unnest(range(128)) AS k)")
def xbm_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Digests' bits as XBM files."""
    code = F.md5(F.col("p_partkey").cast("string"))
    byte = lambda k: F.reverse(F.lpad(F.conv(F.substring(code, 2 * k + 1, F.lit(2)), 16, 2), 8, "0"))
    body = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.concat(F.lit("0x"), F.lower(F.conv(byte(k), 2, 16)))), ", ")
    content = F.concat(F.lit("#define a_width 16\n#define a_height 8\nstatic unsigned char a_bits[] = {\n"), body, F.lit(" };\n"))
    return text_images.pixel_rows(text_images.xbm(table(spark, d, "part").select("p_partkey", content.alias("content"))), ["p_partkey"])


@query(f"""WITH {_MASKS}, sides AS (SELECT p_partkey, CAST(sum(CAST(b <> c AS INT) + CAST(d <> c AS INT)) AS BIGINT) AS points FROM corners GROUP BY p_partkey), sums AS (SELECT p_partkey, CAST(sum(area) AS DOUBLE) AS area FROM areas GROUP BY p_partkey)
    SELECT p_partkey, points, area FROM sides JOIN sums USING (p_partkey)""")
def traced_contours(spark: SparkSession, d: str) -> DataFrame:
    """Contours of masks over a table of pixels: how many points they have, and what their loops hold, holes taken off."""
    byte = F.explode(F.sequence(F.lit(0), F.lit(127)))
    bit = F.expr("cast(conv(substring(code, cast(k / 4 as int) + 1, 1), 16, 10) as int) >> (3 - k % 4) & 1")
    parts = table(spark, d, "part").select("p_partkey").repartition(4 * spark.sparkContext.defaultParallelism)
    solid = parts.select("p_partkey", F.md5(F.col("p_partkey").cast("string")).alias("code"), byte.alias("k")).where(bit == 1).select("p_partkey", (F.col("k") % 16).alias("x"), F.floor(F.col("k") / 16).alias("y"))
    each = tracing.rings(solid, ["p_partkey"]).select("p_partkey", F.size("points").alias("n"), (geometry.twice_area(F.col("points")) / 2).alias("area"))
    return each.groupBy("p_partkey").agg(F.sum("n").alias("points"), F.abs(F.sum("area")).alias("area"))


@query(f"""WITH {_XY}, entries AS (SELECT vec_id, x AS e, r, g, b, a FROM image WHERE x = y), far AS (SELECT i.vec_id, 4 * i.y + i.x AS k, e, p.r, p.g, p.b, p.a, row_number() OVER (PARTITION BY i.vec_id, i.y, i.x ORDER BY (i.r - p.r) ** 2 + (i.g - p.g) ** 2 + (i.b - p.b) ** 2 + (i.a - p.a) ** 2, e) AS n FROM image i JOIN entries p ON p.vec_id = i.vec_id)
    SELECT vec_id, string_agg(format('{{:02X}}', e), '' ORDER BY k) AS places, string_agg(format('{{:02X}}{{:02X}}{{:02X}}{{:02X}}', r, g, b, a), '' ORDER BY k) AS pixels FROM far WHERE n = 1 GROUP BY vec_id""")
def palette_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Pixel blocks by palettes of four of their own pixels."""
    own = _image(spark, d)
    corner = (F.col("x") == F.col("y"))
    entry = own.where(corner).groupBy("vec_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("x", F.array(*[F.col(c).cast("int") for c in "rgba"]).alias("c")))), lambda e: e["c"]).alias("palette"))
    found = indexed.indexed(images.images_of(own, ["vec_id"]).join(entry, "vec_id"), "rgba", "width", "palette")
    return found.select("vec_id", F.hex("indices").alias("places"), F.hex("rgba").alias("pixels"))


def _block_sql(alpha: str) -> str:
    """Digests as blocks of 16 bytes: alpha in the first eight, four colours in the others."""
    return f"""WITH h AS (SELECT p_partkey, md5(CAST(p_partkey AS VARCHAR)) AS x FROM part), b AS (SELECT p_partkey, list_transform(range(16), lambda i: CAST('0x' || substr(x, 2 * CAST(i AS INT) + 1, 2) AS BIGINT)) AS b FROM h),
    e AS (SELECT p_partkey, b, b[9] + 256 * b[10] AS o, b[11] + 256 * b[12] AS t FROM b), w AS (SELECT *, {_WIDE('o')} AS p, {_WIDE('t')} AS q FROM e), c AS (SELECT *, {_MIXED('(2 * p[{k}] + q[{k}]) // 3')} AS third, {_MIXED('(p[{k}] + 2 * q[{k}]) // 3')} AS fourth FROM w),
    k AS (SELECT *, unnest(range(16)) AS k FROM c), n AS (SELECT *, (b[13 + k // 4] >> (2 * (k % 4))) & 3 AS n FROM k), s AS (SELECT p_partkey, k, CASE n WHEN 0 THEN p WHEN 1 THEN q WHEN 2 THEN third ELSE fourth END AS v, {alpha} AS a FROM n)
    SELECT p_partkey, string_agg(format('{{:02X}}{{:02X}}{{:02X}}{{:02X}}', v[1], v[2], v[3], a), '' ORDER BY k) AS pixels FROM s GROUP BY p_partkey"""


def _block_pixels(spark: SparkSession, d: str, kind: str) -> DataFrame:
    code = table(spark, d, "part").select("p_partkey", F.unhex(F.md5(F.col("p_partkey").cast("string"))).alias("block"))
    return blocks.pixels_of_blocks(code, kind).select("p_partkey", F.hex("pixels").alias("pixels"))


_AT = "((b[3 + (3 * k) // 8] + (CASE WHEN (3 * k) // 8 < 5 THEN b[4 + (3 * k) // 8] ELSE 0 END) * 256) >> ((3 * k) % 8)) & 7"
_RAMP = f"CASE WHEN ({_AT}) = 0 THEN b[1] WHEN ({_AT}) = 1 THEN b[2] WHEN b[1] > b[2] THEN ((8 - ({_AT})) * b[1] + (({_AT}) - 1) * b[2]) // 7 WHEN ({_AT}) = 6 THEN 0 WHEN ({_AT}) = 7 THEN 255 ELSE ((6 - ({_AT})) * b[1] + (({_AT}) - 1) * b[2]) // 5 END"


@query(_block_sql("((b[1 + k // 2] >> (4 * (k % 2))) & 15) * 17"))
def dxt3_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Digests of part numbers as DXT3 blocks: alpha at four bits."""
    return _block_pixels(spark, d, "dxt3")


@query(_block_sql(_RAMP))
def dxt5_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Digests of part numbers as DXT5 blocks: alpha between two ends, in both of its modes."""
    return _block_pixels(spark, d, "dxt5")


@query(f"""WITH RECURSIVE {SPRITES}, lines AS (SELECT ord, ord % 50 AS x, ord % 31 AS y, 3 * w - 40 AS x1, 2 * h - 30 AS y1 FROM sprites),
    walk AS (SELECT ord, x, y, x1, y1, abs(x1 - x) AS dx, -abs(y1 - y) AS dy, abs(x1 - x) - abs(y1 - y) AS err FROM lines UNION ALL
        SELECT ord, CASE WHEN 2 * err >= dy THEN x + sign(x1 - x) ELSE x END, CASE WHEN 2 * err <= dx THEN y + sign(y1 - y) ELSE y END, x1, y1, dx, dy, err + CASE WHEN 2 * err >= dy THEN dy ELSE 0 END + CASE WHEN 2 * err <= dx THEN dx ELSE 0 END FROM walk WHERE x <> x1 OR y <> y1)
    SELECT ord, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y FROM walk""")
def line_steps(spark: SparkSession, d: str) -> DataFrame:
    """Lines in all directions, pixel by pixel."""
    lines = sprites(spark, d).select("ord", (F.col("ord") % 50).alias("x0"), (F.col("ord") % 31).alias("y0"), (F.col("w") * 3 - 40).alias("x1"), (F.col("h") * 2 - 30).alias("y1"))
    return raster.line_pixels(lines, ["ord"])


@query(f"""WITH {_XY}, f AS (SELECT vec_id, vec_id % 3 AS fx, vec_id % 2 AS fy, 1 + vec_id % 4 AS fw, vec_id % 4 AS fh FROM embeddings)
    SELECT i.vec_id, i.x, i.y, CASE WHEN hit THEN 255 ELSE r END AS r, CASE WHEN hit THEN 0 ELSE g END AS g, CASE WHEN hit THEN 255 ELSE b END AS b, CASE WHEN hit THEN 255 ELSE a END AS a
    FROM (SELECT i.*, fh > 0 AND x BETWEEN fx AND fx + fw - 1 AND y BETWEEN fy AND fy + fh - 1 AND (x IN (fx, fx + fw - 1) OR y IN (fy, fy + fh - 1)) AS hit FROM image i JOIN f USING (vec_id)) i""")
def shape_outlines(spark: SparkSession, d: str) -> DataFrame:
    """Frames drawn over pixel blocks, some beyond their edges, some without area."""
    n = F.col("vec_id")
    frames = table(spark, d, "embeddings").select("vec_id", (n % 3).alias("x"), (n % 2).alias("y"), (n % 4 + 1).alias("w"), (n % 4).alias("h"))
    return raster.outlined(_image(spark, d).select("vec_id", "x", "y", "r", "g", "b", "a"), raster.shape_lines(frames, ["vec_id"]), ["vec_id"])


@query(f"""WITH {_GRID}, f AS (SELECT page, id, x, y, w, h, first_value(x) OVER p AS fx, first_value(y) OVER p AS fy FROM placed WINDOW p AS (PARTITION BY page ORDER BY id)), a AS (SELECT *, (greatest(500 + 13 * page - 3, 0) + 8) // 16 * 16 AS ax, (greatest(2 - 3, 0) + 8) // 16 * 16 AS ay FROM f)
    SELECT CAST(page AS BIGINT) AS page, id, CAST(greatest(least(ax + x - fx, greatest(1000 - 4 - 2 - w, 0)), 0) AS BIGINT) AS wish_x, CAST(greatest(least(ay + y - fy, greatest(900 - 4 - 2 - h, 0)), 0) AS BIGINT) AS wish_y FROM a""")
def drop_plan(spark: SparkSession, d: str) -> DataFrame:
    """All sprites of a page dropped together, on a grid."""
    return packing.dropped(_grid(spark, d).withColumn("page", F.col("page").cast("long")), ["page"], "id", F.lit(500) + F.col("page") * 13, F.lit(2), (1000, 900), 2, 1, 16)
