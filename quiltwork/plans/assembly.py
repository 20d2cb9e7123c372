"""Queries of the assembly operators, beside those of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltwork.functions import pixels as px
from quiltwork.operators import assembly, blocks, colour, dedup, frames
from quiltwork.plans import config
from quiltwork.plans.catalogue import _GRID, _Q, _XY, ORACLE_SQL, QUERIES, _grid, _image, query
from quiltwork.plans.views import PATHS, PIXELS, SPRITES, paths, pixels, sprites, table
from quiltwork.sources import images
from quiltwork.streaming import events as ev

__all__ = ["ORACLE_SQL", "QUERIES"]
_NAMES = "names AS (SELECT p_partkey, p_type || '/' || replace(p_name, ' ', '_') AS rel FROM part)"


def _names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.concat("p_type", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("rel"))


@query(f"WITH {PATHS} SELECT page_id, regexp_replace(path, '/+$', '') AS plain, '/' || regexp_replace(path, '/+$', '') AS rooted, '../' || regexp_replace(path, '/+$', '') AS above FROM paths")
def canonical_paths(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    noisy = F.concat(F.lit("./a/.."), F.lit("/"), F.replace(p, F.lit("/"), F.lit("//./")), F.lit("/b/c/../.."))
    of = assembly.canonical_path
    return paths(spark, d).select("page_id", of(noisy).alias("plain"), of(F.concat(F.lit("/../"), noisy)).alias("rooted"), of(F.concat(F.lit("x/../../"), noisy)).alias("above"))


@query(f"WITH {PATHS} SELECT page_id, row_number() OVER (ORDER BY string_split(path, '/'), page_id) - 1 AS rank FROM paths")
def discovery_order(spark: SparkSession, d: str) -> DataFrame:
    return assembly.in_path_order(paths(spark, d), "path", "page_id").select("page_id", "rank")


@query(f"WITH {_NAMES} SELECT p_partkey, contains(lower(rel), 'large') OR ends_with(regexp_extract(rel, '[^/]*$'), '_widget') AS normal, ends_with(rel, 'bolt') AS file, contains(lower(rel), 'ed_') AS found FROM names")
def normal_map_names(spark: SparkSession, d: str) -> DataFrame:
    rel = F.col("rel")
    return _names(spark, d).select("p_partkey", assembly.is_normal_map(rel, "_widget", "LARGE").alias("normal"), assembly.is_normal_file(F.concat(rel, F.lit(".png")), "bolt").alias("file"), assembly.holds_ignoring_case(rel, "ED_").alias("found"))


_OWNED = f"""{SPRITES}, owned AS (SELECT *, CASE WHEN first_value(id) OVER (PARTITION BY folder, w, h ORDER BY ord) <> id THEN first_value(id) OVER (PARTITION BY folder, w, h ORDER BY ord) END AS alias_of FROM sprites),
    cell AS (SELECT max(w + 2) AS cw, max(h + 2) AS ch FROM owned WHERE alias_of IS NULL),
    ranked AS (SELECT s.*, row_number() OVER (ORDER BY w * h DESC, id DESC) - 1 AS i, cw, ch, 1024 // cw AS cols, (1024 // cw) * (1024 // ch) AS per FROM owned s, cell WHERE alias_of IS NULL),
    placed AS (SELECT id, CAST(i // per AS BIGINT) AS page, CAST(((i % per) % cols) * cw AS BIGINT) AS x, CAST(((i % per) // cols) * ch AS BIGINT) AS y, w + 2 AS frame_w, h + 2 AS frame_h FROM ranked),
    spots AS (SELECT o.id, o.alias_of, page, x, y, frame_w, frame_h FROM owned o LEFT JOIN placed p ON p.id = coalesce(o.alias_of, o.id))"""


def _spots(spark: SparkSession, d: str) -> DataFrame:
    from quiltwork.operators import packing

    own = sprites(spark, d).withColumn("size", F.concat_ws("x", "w", "h"))
    aliased = dedup.aliases(own, "size", "id", "ord", ["folder"]).select("id", "alias_of")
    owners = own.join(aliased.where("alias_of is null").select("id"), "id", "left_semi")
    return assembly.with_places(aliased, packing.grid(owners, packing.PageOptions()))


@query(f"WITH {_OWNED} SELECT * FROM spots")
def sprite_places(spark: SparkSession, d: str) -> DataFrame:
    """Sprites of a folder that look alike are placed once; all have a place."""
    return _spots(spark, d)


@query(f"WITH {_OWNED} SELECT count(*) AS sprites, count(alias_of) AS aliases, max(page) + 1 AS pages, count(*) FILTER (page IS NULL) AS unplaced, CAST(sum(frame_w * frame_h) FILTER (alias_of IS NULL) AS BIGINT) AS area FROM spots")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    return assembly.run_summary(_spots(spark, d))


@query(f"WITH {SPRITES} SELECT 'in/' || folder || '/' || CASE WHEN ord % 3 = 0 THEN 'gone' ELSE id END || '.png' AS path, CASE WHEN ord % 3 <> 0 THEN id END AS id FROM sprites")
def path_lookup(spark: SparkSession, d: str) -> DataFrame:
    own = sprites(spark, d)
    path = lambda name: F.concat(F.lit("in/"), F.col("folder"), F.lit("/"), name, F.lit(".png")).alias("path")
    return assembly.sprites_of_paths(own.select(path(F.when(F.col("ord") % 3 == 0, "gone").otherwise(F.col("id")))), own.select(path(F.col("id")), "id"), "path")


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS hash, substr(sha256(text), 1, 8) AS short FROM documents")
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", assembly.content_hash(F.col("text")).alias("hash"), assembly.content_hash(F.col("text"), 8).alias("short"))


@query("""WITH named AS (SELECT p_brand, replace(p_name, ' ', '_') AS id FROM part), twice AS (SELECT p_brand, id, row_number() OVER (PARTITION BY p_brand ORDER BY id) AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM (SELECT p_brand, id FROM named GROUP BY p_brand, id HAVING count(*) > 1))
    SELECT p_brand, string_agg(id, ', ' ORDER BY id) FILTER (k <= 3) || CASE WHEN max(n) > 3 THEN ' and ' || (max(n) - 3) || ' more' ELSE '' END AS message FROM twice GROUP BY p_brand""")
def duplicate_messages(spark: SparkSession, d: str) -> DataFrame:
    """Of each brand the first three names that several parts have."""
    named = table(spark, d, "part").select("p_brand", F.replace("p_name", F.lit(" "), F.lit("_")).alias("id"))
    again = named.groupBy("p_brand", "id").agg(F.count("*").alias("times")).where("times > 1")
    return again.groupBy("p_brand").agg(assembly.first_named(again, "id", 3).alias("message"))


@query("SELECT DISTINCT event_type FROM events WHERE event_type NOT IN ('click', 'view') ORDER BY event_type LIMIT 8")
def unsupported_keys(spark: SparkSession, d: str) -> DataFrame:
    return assembly.unsupported_keys(table(spark, d, "events"), "event_type", ["click", "view"])


@query("WITH p AS (SELECT CAST(p_partkey % 1500 AS VARCHAR) || p_brand AS preset, p_type || p_size AS extension FROM part), e AS (SELECT 'preset' AS field, preset AS value FROM p UNION ALL SELECT 'extension', extension FROM p) SELECT field, value, count(*) AS times FROM e GROUP BY ALL HAVING count(*) > 1")
def preset_distinctness(spark: SparkSession, d: str) -> DataFrame:
    """Values that several rows have where each should be one's own, parts seen as presets."""
    presets = table(spark, d, "part").select(F.concat((F.col("p_partkey") % 1500).cast("string"), "p_brand").alias("preset"), F.concat("p_type", F.col("p_size").cast("string")).alias("extension"))
    return assembly.repeated_values(presets, ["preset", "extension"])


@query(f"""WITH {_GRID}, pages AS (SELECT DISTINCT CAST(page AS BIGINT) AS page FROM placed), n AS (SELECT page, CASE WHEN page > 0 THEN '_' || page ELSE '' END AS k FROM pages)
    SELECT page, 'tex/sheet' || k || '@2x.png' AS texture, 'tex/sheet' || k || '@2x.png?v=' || substr(md5(CAST(page AS VARCHAR)), 1, 8) AS marked, 'sheet_normal' || k || '@2x.png' AS normal, 'bump' || k || '@2x.png' AS own, 'sheet' || k || '@2x.json' AS each, 'sheet@2x.json' AS one FROM n""")
def page_files(spark: SparkSession, d: str) -> DataFrame:
    n, s = F.col("page"), F.lit("@2x")
    file, version = assembly.page_file("sheet", n, s, "png"), F.substring(F.md5(n.cast("string")), 1, 8)
    return _grid(spark, d).select("page").distinct().select(
        "page", assembly.texture_reference(file, " tex/ ").alias("texture"), assembly.texture_reference(file, "tex", version).alias("marked"), assembly.normal_page_file("sheet", n, s, "png").alias("normal"),
        assembly.normal_page_file("sheet", n, s, "png", "bump").alias("own"), assembly.metadata_file("sheet", n, s, "json", True).alias("each"), assembly.metadata_file("sheet", n, s, "json", False).alias("one"),
    )


@query("SELECT o_orderkey, CAST(CAST(round(CAST(CAST(o_totalprice AS FLOAT) / 1000 * CAST(100 AS FLOAT) AS DOUBLE)) AS FLOAT) / CAST(100 AS FLOAT) AS DOUBLE) AS two FROM (SELECT o_orderkey, o_totalprice FROM orders)")
def rounded_numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", assembly.rounded(F.col("o_totalprice").cast("float") / F.lit(1000).cast("float"), 2).alias("two"))


@query(f"WITH {SPRITES} SELECT folder, max(w) + 10 AS least_w, max(h) + 10 AS least_h, CAST(sum((w + 4) * (h + 4)) AS BIGINT) AS area FROM sprites GROUP BY folder")
def search_bounds(spark: SparkSession, d: str) -> DataFrame:
    return assembly.size_bounds(sprites(spark, d), ["folder"], 2, 3)


@query("SELECT conv_id, string_agg(role, '>' ORDER BY turn, role) AS frames, count(*) AS n FROM conversations GROUP BY conv_id")
def ordered_frames(spark: SparkSession, d: str) -> DataFrame:
    return assembly.ordered_frames(table(spark, d, "conversations"), ["conv_id"], "turn", "role")





@query()
def crc_marks(spark: SparkSession, d: str) -> DataFrame:
    """CRC-16 and CRC-32 of names; tested against Python's own."""
    name = F.col("p_name").cast("binary")
    return table(spark, d, "part").select("p_partkey", "p_name", assembly.crc16(name).alias("crc16"), F.crc32(name).alias("crc32"))


@query(f"""WITH {SPRITES}, t AS (SELECT ord, w, h, [[0.0, 0.25], [w * 1.0, h * 0.5], [w * 0.25, h * 1.0]] AS p FROM sprites),
    cuts AS (SELECT ord, w, y, p[i][1] AS ax, p[i][2] AS ay, p[i % 3 + 1][1] AS bx, p[i % 3 + 1][2] AS "by" FROM (SELECT ord, w, p, unnest(range(h)) AS y FROM t), (SELECT unnest(range(1, 4)) AS i)),
    xs AS (SELECT ord, w, y, CAST(ax AS DOUBLE) + (y + CAST(0.5 AS DOUBLE) - CAST(ay AS DOUBLE)) / (CAST("by" AS DOUBLE) - CAST(ay AS DOUBLE)) * (CAST(bx AS DOUBLE) - CAST(ax AS DOUBLE)) AS x FROM cuts WHERE (ay <= y + 0.5) <> ("by" <= y + 0.5))
    SELECT ord, y, CAST(greatest(floor(min(x)), 0) AS BIGINT) AS "first", CAST(least(greatest(ceil(max(x)) - 1, 0), w - 1) AS BIGINT) AS "last" FROM xs GROUP BY ord, w, y HAVING max(x) > 0 AND min(x) < w""")
def polygon_runs(spark: SparkSession, d: str) -> DataFrame:
    """A triangle within each sprite, as runs of pixels."""
    w, h = F.col("w").cast("double"), F.col("h").cast("double")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    shapes = sprites(spark, d).select("ord", "w", "h", F.array(point(F.lit(0.0), F.lit(0.25)), point(w, h * 0.5), point(w * 0.25, h)).alias("p"))
    return assembly.rasterised(shapes, ["ord"], "p", F.col("w"), F.col("h"))


_FLAT = f"{_XY}, flat AS (SELECT vec_id, x, y, CASE WHEN vec_id % 3 > x THEN 7 ELSE r END AS r, CASE WHEN vec_id % 3 > x THEN 7 ELSE g // 128 END AS g, b // 255 AS b, CASE WHEN vec_id % 5 = y THEN 0 ELSE 255 END AS a FROM image)"


@query(f"""WITH {_FLAT}, seen AS (SELECT *, first_value(r) OVER c AS cr, first_value(g) OVER c AS cg, first_value(b) OVER c AS cb, first_value(r) OVER l AS lr, first_value(g) OVER l AS lg, first_value(b) OVER l AS lb FROM flat WHERE a > 1
        WINDOW c AS (PARTITION BY vec_id, x ORDER BY y), l AS (PARTITION BY vec_id, y ORDER BY x)),
    cols AS (SELECT vec_id, x AS k, bool_and(abs(r - cr) <= 20 AND abs(g - cg) <= 20 AND abs(b - cb) <= 20) AS bar FROM seen GROUP BY vec_id, x), lines AS (SELECT vec_id, y AS k, bool_and(abs(r - lr) <= 20 AND abs(g - lg) <= 20 AND abs(b - lb) <= 20) AS bar FROM seen GROUP BY vec_id, y),
    ids AS (SELECT DISTINCT vec_id FROM flat), ks AS (SELECT vec_id, unnest(range(3)) AS k FROM ids)
    SELECT ids.vec_id, coalesce((SELECT min(k) FROM ks WHERE ks.vec_id = ids.vec_id AND NOT EXISTS (SELECT 1 FROM cols c WHERE c.vec_id = ks.vec_id AND c.bar AND c.k = ks.k)), 3) AS "left", coalesce((SELECT min(k) FROM ks WHERE ks.vec_id = ids.vec_id AND NOT EXISTS (SELECT 1 FROM lines c WHERE c.vec_id = ks.vec_id AND c.bar AND c.k = ks.k)), 3) AS top,
        coalesce((SELECT min(k) FROM ks WHERE ks.vec_id = ids.vec_id AND NOT EXISTS (SELECT 1 FROM cols c WHERE c.vec_id = ks.vec_id AND c.bar AND c.k = 3 - ks.k)), 3) AS "right", coalesce((SELECT min(k) FROM ks WHERE ks.vec_id = ids.vec_id AND NOT EXISTS (SELECT 1 FROM lines c WHERE c.vec_id = ks.vec_id AND c.bar AND c.k = 3 - ks.k)), 3) AS bottom FROM ids""")
def solid_borders(spark: SparkSession, d: str) -> DataFrame:
    """Bars of one colour around pixel blocks, up to three lines deep."""
    own, marked = _image(spark, d), F.col("vec_id") % 3 > F.col("x")
    flat = own.select("vec_id", "x", "y", F.when(marked, 7).otherwise(F.col("r")).alias("r"), F.when(marked, 7).otherwise(px.div(F.col("g"), 128)).alias("g"), px.div(F.col("b"), 255).alias("b"), F.when(F.col("vec_id") % 5 == F.col("y"), 0).otherwise(255).alias("a"))
    return assembly.solid_borders(flat, ["vec_id"], F.lit(4), F.lit(4), 1, 20, 3)


@query(f"""WITH {_XY}, want AS (SELECT vec_id, x, y, CASE WHEN vec_id % 2 = 0 THEN 1 + x ELSE (1 + x) * 4 // 7 END AS sx, CASE WHEN vec_id % 2 = 0 THEN y ELSE (2 + y) * 4 // 6 END AS sy FROM (SELECT DISTINCT vec_id FROM image), (SELECT unnest(range(3)) AS x), (SELECT unnest(range(2)) AS y))
    SELECT w.vec_id, w.x, w.y, r, g, b FROM want w JOIN image i ON i.vec_id = w.vec_id AND i.x = sx AND i.y = sy""")
def normal_map_part(spark: SparkSession, d: str) -> DataFrame:
    """Pixel blocks as normal maps of trimmed sprites: as large as the sprite, or stretched to it."""
    even = F.col("vec_id") % 2 == 0
    size = lambda a, b: F.when(even, a).otherwise(b).cast("long")
    own = _image(spark, d).select("vec_id").distinct().select("vec_id", size(4, 7).alias("raw_w"), size(4, 6).alias("raw_h"), F.lit(1).alias("left"), size(0, 2).alias("top"), F.lit(3).alias("w"), F.lit(2).alias("h"), F.lit(4).alias("normal_w"), F.lit(4).alias("normal_h"))
    return assembly.normal_part(_image(spark, d), own, ["vec_id"], list("rgb"))


_SEE = lambda n, dx, dy: f"JOIN art {n} ON {n}.vec_id = e.vec_id AND {n}.x = least(greatest(e.x + {dx}, 0), 3) AND {n}.y = least(greatest(e.y + {dy}, 0), 3)"
_NEAR = f"""{_XY}, art AS (SELECT vec_id, x, y, r // 64 AS v FROM image), seen AS (SELECT e.vec_id, e.x, e.y, a.v AS a, b.v AS b, c.v AS c, d.v AS d, e.v AS e, f.v AS f, g.v AS g, h.v AS h, i.v AS i FROM art e
    {_SEE('a', -1, -1)} {_SEE('b', 0, -1)} {_SEE('c', 1, -1)} {_SEE('d', -1, 0)} {_SEE('f', 1, 0)} {_SEE('g', -1, 1)} {_SEE('h', 0, 1)} {_SEE('i', 1, 1)})"""
_DB, _BF, _HD, _FH = "d = b AND d <> h AND b <> f", "b = f AND b <> d AND f <> h", "h = d AND h <> f AND d <> b", "f = h AND f <> b AND h <> d"
_THREE = [
    ("d", _DB), ("b", f"({_DB} AND e <> c) OR ({_BF} AND e <> a)"), ("f", _BF), ("d", f"({_HD} AND e <> a) OR ({_DB} AND e <> g)"), ("e", "true"), ("f", f"({_BF} AND e <> i) OR ({_FH} AND e <> c)"),
    ("d", _HD), ("h", f"({_FH} AND e <> g) OR ({_HD} AND e <> i)"), ("f", _FH),
]


def _art(spark: SparkSession, d: str, how: str) -> DataFrame:
    return assembly.art(_image(spark, d).select("vec_id", "x", "y", px.div(F.col("r"), 64).alias("v")), ["vec_id"], (4, 4), "v", how)


@query(f"WITH {_NEAR} " + " UNION ALL ".join(f"SELECT vec_id, 3 * x + {k % 3} AS x, 3 * y + {k // 3} AS y, CASE WHEN {when} THEN {v} ELSE e END AS v FROM seen" for k, (v, when) in enumerate(_THREE)))
def pixel_scale_thrice(spark: SparkSession, d: str) -> DataFrame:
    return _art(spark, d, "scale3")


@query(f"WITH {_NEAR} " + " UNION ALL ".join(f"SELECT vec_id, 2 * x + {k % 2} AS x, 2 * y + {k // 2} AS y, CASE WHEN {a} = {b} AND {b} = {c} THEN {b} ELSE e END AS v FROM seen" for k, (a, b, c) in enumerate(["dab", "bcf", "dgh", "fih"])))
def pixel_eagle(spark: SparkSession, d: str) -> DataFrame:
    return _art(spark, d, "eagle")


@query()
def pixel_scale_four(spark: SparkSession, d: str) -> DataFrame:
    return _art(spark, d, "scale4")


_LUMA = "((r * 77 + g * 150 + b * 29 + 128) // 256)"


@query(f"WITH {PIXELS} SELECT vec_id, k, r * 65536 + g * 256 + b AS rgb888, a AS alpha8, {_LUMA} AS intensity8, {_LUMA} * 256 + a AS ai88, b * 16777216 + g * 65536 + r * 256 + a AS bgra8888, {_Q('r', 5)} * 2048 + {_Q('g', 5)} * 64 + {_Q('b', 5)} * 2 + CAST(a >= 128 AS BIGINT) AS rgba5551 FROM pixels")
def pixel_formats(spark: SparkSession, d: str) -> DataFrame:
    r, g, b, a = (F.col(c) for c in "rgba")
    light = px.luma(r, g, b)
    return pixels(spark, d).select("vec_id", "k", (r * 65536 + g * 256 + b).alias("rgb888"), a.alias("alpha8"), light.alias("intensity8"), (light * 256 + a).alias("ai88"), px.packed_rgba(b, g, r, a).alias("bgra8888"), px.packed_rgba5551(r, g, b, a).alias("rgba5551"))


def _round_trip(spark: SparkSession, d: str, kind: str) -> DataFrame:
    made = images.encoded(images.images_of(_image(spark, d), ["vec_id"]), kind)
    return images.pixels_of(images.decoded(made.select("vec_id", "content")), ["vec_id"])


@query(f"WITH {_XY} SELECT vec_id, x, y, r, g, b, a FROM image")
def png_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Pixel blocks written as PNG files, with a palette or without, and read again."""
    return _round_trip(spark, d, "png")


@query(f"WITH {_XY} SELECT vec_id, x, y, r, g, b, a FROM image")
def bmp_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return _round_trip(spark, d, "bmp")


@query(f"WITH {_XY} SELECT vec_id, x, y, r, g, b, a FROM image")
def tga_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return _round_trip(spark, d, "tga")


@query(f"WITH {_XY}, coded AS (SELECT vec_id, string_agg(format('{{:02X}}{{:02X}}{{:02X}}{{:02X}}', r, g, b, a), '' ORDER BY y, x) AS p FROM image GROUP BY vec_id) SELECT vec_id, CAST(4 AS INT) AS width, CAST(4 AS INT) AS height, p AS pixels FROM coded")
def image_buffers(spark: SparkSession, d: str) -> DataFrame:
    return images.images_of(_image(spark, d), ["vec_id"]).select("vec_id", "width", "height", F.hex("rgba").alias("pixels"))


_CASES = {
    "nothing is dithered at eight bits a channel": "p_partkey % 2 = 1 AND p_size % 3 = 0", "the template isn't there": "p_size = 7", "the folder holds no exporters": "p_size % 6 = 0", "a class prefix counts for css alone": "p_partkey % 4 <> 1 AND p_size % 7 = 1",
    "only textures of hardware formats are turned upside down": "p_size % 4 = 0 AND p_partkey % 3 <> 0", "the texture can't hold the pixel format; it gets eight bits a channel": "p_size % 11 = 3", "coordinates of fractional scales are rounded": "p_size % 5 = 2",
    "pixel art is enlarged at its own factor alone; other scales are smooth": "p_size % 5 = 2 AND p_partkey % 2 = 0", "distances are rounded up to the alignment": "p_size % 3 = 1 AND (p_size % 4 <> 0 OR p_partkey % 40 % 4 <> 0)", "the border leaves no room": "2 * (p_partkey % 40) >= 64",
    "the texture's sides have to be powers of two": "p_partkey % 3 = 0 AND p_size % 2 = 0", "a fixed side leaves no room within the border": "p_size <= 2 * (p_partkey % 40)", "sprites get clear pixels until their sides can be divided": "p_size % 9 > 1",
}


@query("SELECT p_partkey, concat_ws('; ', " + ", ".join(f"CASE WHEN {when} THEN '{said.replace(chr(39), chr(39) * 2)}' END" for said, when in _CASES.items()) + ") AS advice FROM part")
def config_advice_rest(spark: SparkSession, d: str) -> DataFrame:
    """What full_advice() says beyond advice()."""
    size, key = F.col("p_size").cast("long"), F.col("p_partkey")
    rows = table(spark, d, "part").select(
        "p_partkey", F.lit(0).alias("extrude"), (size % 4).alias("padding"), (key % 40).alias("border"), F.lit(False).alias("rotate"), F.when(key % 4 == 1, "css").otherwise("json").alias("data_format"), (size % 2 == 1).alias("power_of_two"), F.lit(0).alias("fixed_height"),
        size.alias("fixed_width"), F.when(size % 3 == 1, 4).otherwise(0).alias("align"), F.lit(64).alias("max_width"), F.lit(64).alias("max_height"), F.lit(1.0).alias("scale"), F.when(key % 2 == 1, "atkinson").otherwise("none").alias("dither"),
        F.when(size % 3 == 0, "rgba8888").otherwise("rgb565").alias("colours"), (size != 7).alias("template_found"), (size % 6).alias("exporters"), (size % 7 == 1).alias("css_prefix"), F.when(key % 3 == 0, "pvrtc").otherwise("png").alias("texture"),
        (size % 4 == 0).alias("flip"), (size % 11 != 3).alias("pixels_fit"), F.when(size % 5 == 2, F.array(F.lit(1.0), F.lit(1.5))).otherwise(F.array(F.lit(1.0), F.lit(2.0))).alias("scales"), F.when(key % 2 == 0, 2).otherwise(0).alias("art_factor"),
        F.lit(1).alias("divisor_x"), (size % 9).alias("divisor_y"),
    )
    more = F.array_except(config.full_advice(["css"]), config.advice(["css"]))
    return rows.select("p_partkey", F.array_join(more, "; ").alias("advice"))


def _framed(spark: SparkSession, d: str) -> DataFrame:
    """The grid with trims, turns and pivots made up from the sprites' numbers."""
    c = F.col
    own = _grid(spark, d).select("id", "page", "x", "y", "w", "h", "ord")
    own = own.select("*", (c("ord") % 3 == 0).alias("rotated"), (c("ord") % 4).alias("left"), (c("ord") % 5).alias("top"), (c("w") + c("ord") % 4).alias("raw_w"), (c("h") + c("ord") % 5).alias("raw_h"), F.lit(0.5).alias("pivot_x"), (c("ord") % 5 / 4).alias("pivot_y"))
    return frames.described(own, 1)


_FRAMED = f"""{_GRID}, f AS (SELECT id, CAST(page AS BIGINT) AS page, CAST(x + 1 AS BIGINT) AS fx, CAST(y + 1 AS BIGINT) AS fy, w, h, ord % 3 = 0 AS rotated, ord % 4 <> 0 OR ord % 5 <> 0 AS trimmed, ord % 4 AS l, ord % 5 AS t, w + ord % 4 AS rw, h + ord % 5 AS rh, (ord % 5) / 4 AS py FROM placed),
    j AS (SELECT *, to_json(struct_pack(filename := id, frame := struct_pack(x := fx, y := fy, w := w, h := h), rotated := rotated, trimmed := trimmed, "spriteSourceSize" := struct_pack(x := l, y := t, w := w, h := h), "sourceSize" := struct_pack(w := rw, h := rh), "pivot" := struct_pack(x := CAST(0.5 AS DOUBLE), y := CAST(py AS DOUBLE)))) AS o FROM f)"""


def _lines(spark: SparkSession, d: str, family: str) -> DataFrame:
    return _framed(spark, d).select("id", frames.line(family, F.concat(F.lit("page"), F.col("page"), F.lit(".png"))).alias("line"))


@query(f"WITH {_FRAMED} SELECT id, CAST(o AS VARCHAR) AS line FROM j")
def metadata_frames_json(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d, "json")


@query(f"WITH {_FRAMED} SELECT id, '\"' || id || '\":{{' || substr(CAST(o AS VARCHAR), length(id) + 16) AS line FROM j")
def metadata_frames_hash(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d, "json-hash")


@query(f"WITH {_FRAMED} SELECT id, '\"' || id || '\":{{' || substr(CAST(o AS VARCHAR), length(id) + 16, length(CAST(o AS VARCHAR)) - length(id) - 16) || ',\"image\":\"page' || page || '.png\"}}' AS line FROM j")
def metadata_frames_pixi(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d, "pixi")


@query(f"""WITH {_FRAMED} SELECT id, '<sprite n="' || id || '" x="' || fx || '" y="' || fy || '" w="' || w || '" h="' || h || '" oX="' || l || '" oY="' || t || '" oW="' || rw || '" oH="' || rh || '"' || CASE WHEN rotated THEN ' r="y"' ELSE '' END || CASE WHEN trimmed THEN ' t="y"' ELSE '' END || '/>' AS line FROM f""")
def metadata_frames_xml(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d, "xml")


@query(f"""WITH {_FRAMED} SELECT id, '<SubTexture name="' || id || '" x="' || fx || '" y="' || fy || '" width="' || w || '" height="' || h || '"' || CASE WHEN rotated THEN ' rotated="true"' ELSE '' END || CASE WHEN trimmed THEN ' frameX="' || -l || '" frameY="' || -t || '" frameWidth="' || rw || '" frameHeight="' || rh || '"' ELSE '' END || '/>' AS line FROM f""")
def metadata_frames_starling(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d, "starling")


@query(f"WITH {_FRAMED} SELECT id, '<key>' || id || '</key><dict><key>x</key><integer>' || fx || '</integer><key>y</key><integer>' || fy || '</integer><key>w</key><integer>' || w || '</integer><key>h</key><integer>' || h || '</integer></dict>' AS line FROM f")
def metadata_frames_uikit(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d, "uikit")


_ATLAS_LINE = "id || chr(10) || '  rotate: ' || CAST(rotated AS VARCHAR) || chr(10) || '  xy: ' || fx || ', ' || fy || chr(10) || '  size: ' || w || ', ' || h || chr(10) || '  orig: ' || rw || ', ' || rh || chr(10) || '  offset: ' || l || ', ' || (rh - t - h) || chr(10) || '  index: -1'"
_SHEET = "s AS (SELECT *, max(fx + w + 1) OVER (PARTITION BY page) AS pw, max(fy + h + 1) OVER (PARTITION BY page) AS ph FROM {0})"


def _pages(framed: DataFrame) -> DataFrame:
    found = framed.groupBy("page").agg(F.max(F.col("frame.frame.x") + F.col("frame.frame.w") + 1).alias("width"), F.max(F.col("frame.frame.y") + F.col("frame.frame.h") + 1).alias("height"))
    return found.withColumn("file", F.concat(F.lit("page"), F.col("page"), F.lit(".png")))


def _sheets(spark: SparkSession, d: str, family: str) -> DataFrame:
    framed = _framed(spark, d)
    return frames.sheets(framed, _pages(framed), family)


@query(f"WITH {_FRAMED}, {_SHEET.format('f')} SELECT page, 'page' || page || '.png' || chr(10) || 'size: ' || max(pw) || ',' || max(ph) || chr(10) || 'format: RGBA8888' || chr(10) || 'filter: Linear, Linear' || chr(10) || 'repeat: none' || chr(10) || string_agg({_ATLAS_LINE}, chr(10) ORDER BY id) || chr(10) AS document FROM s GROUP BY page")
def metadata_libgdx(spark: SparkSession, d: str) -> DataFrame:
    return _sheets(spark, d, "libgdx")


@query(f"WITH {_FRAMED}, {_SHEET.format('f')} SELECT page, chr(10) || 'page' || page || '.png' || chr(10) || 'size: ' || max(pw) || ',' || max(ph) || chr(10) || 'format: RGBA8888' || chr(10) || 'filter: Linear, Linear' || chr(10) || 'repeat: none' || chr(10) || string_agg({_ATLAS_LINE}, chr(10) ORDER BY id) || chr(10) AS document FROM s GROUP BY page")
def metadata_spine(spark: SparkSession, d: str) -> DataFrame:
    return _sheets(spark, d, "spine")


@query(f"""WITH {_FRAMED}, {_SHEET.format('j')} SELECT page, '{{"textures":[{{"image":"page' || page || '.png","format":"RGBA8888","size":{{"w":' || max(pw) || ',"h":' || max(ph) || '}},"scale":1,"frames":[' || string_agg(CAST(o AS VARCHAR), ',' ORDER BY id) || ']}}]}}' AS document FROM s GROUP BY page""")
def metadata_phaser(spark: SparkSession, d: str) -> DataFrame:
    return _sheets(spark, d, "phaser")


@query(f"""WITH {_FRAMED}, {_SHEET.format('j')} SELECT page, '{{"frames":[' || string_agg(CAST(o AS VARCHAR), ',' ORDER BY id) || '],"meta":{{"image":"page' || page || '.png","format":"RGBA8888","size":{{"w":' || max(pw) || ',"h":' || max(ph) || '}},"scale":"1"}}}}' AS document FROM s GROUP BY page""")
def metadata_frames_document(spark: SparkSession, d: str) -> DataFrame:
    return _sheets(spark, d, "json")


_ALL = frames.presets()
_VALUES = ", ".join(f"('{a}', '{b}', '{c}', {'NULL' if t is None else str(t).lower()}, {str(m).lower()}, {str(p).lower()})" for a, b, c, t, m, p in _ALL)


@query(f"""WITH presets(preset, family, extension, turns, animations, polygons) AS (VALUES {_VALUES}), wanted AS (SELECT p_partkey, CASE WHEN p_partkey % 64 = 0 THEN 'unknown' ELSE upper([{', '.join(f"'{p[0]}'" for p in _ALL)}][CAST(p_partkey % 64 AS INT)]) END AS preset FROM part)
    SELECT p_partkey, w.preset, family, extension, turns, animations, polygons FROM wanted w LEFT JOIN presets p ON lower(p.preset) = lower(w.preset)""")
def preset_table(spark: SparkSession, d: str) -> DataFrame:
    """Data formats by id, whatever the case."""
    known = spark.createDataFrame(_ALL, "known string, family string, extension string, turns boolean, animations boolean, polygons boolean")
    wanted = F.coalesce(F.upper(F.get(F.array(*[F.lit(p[0]) for p in _ALL]), (F.col("p_partkey") % 64 - 1).cast("int"))), F.lit("unknown"))
    return table(spark, d, "part").select("p_partkey", wanted.alias("preset")).join(F.broadcast(known), F.lower("preset") == F.lower("known"), "left").drop("known")


@query("""WITH e AS (SELECT user_id, ts, event_id, event_type, sum(CAST(event_type = 'purchase' AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS since FROM events WHERE event_type IN ('purchase', 'error'))
    SELECT user_id, ts, event_id, CASE WHEN row_number() OVER (PARTITION BY user_id, since ORDER BY ts, event_id) = 1 THEN 'retry' ELSE 'wait' END AS action FROM e WHERE event_type = 'error'""")
def retry_actions(spark: SparkSession, d: str) -> DataFrame:
    """Errors as failures, purchases as changes of what failed."""
    return ev.retries(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", "purchase", "error")


_LEVEL = lambda c: f"CAST(floor(floor(CAST({c} AS FLOAT) / CAST(17 AS FLOAT) + 0.5) * 17 + 0.5) AS BIGINT)"


@query(f"WITH {_XY} SELECT vec_id, x, y, {_LEVEL('r')} AS r, {_LEVEL('g')} AS g, {_LEVEL('b')} AS b, {_LEVEL('a')} AS a FROM image")
def dither_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Pixel blocks at four bits a channel, each pixel on its own."""
    own = images.images_of(_image(spark, d), ["vec_id"]).withColumnRenamed("rgba", "image")
    return images.pixels_of(colour.dithered(own, "image", "width", 4, "nearest").withColumnRenamed("image", "rgba"), ["vec_id"])


@query()
def dither_linear(spark: SparkSession, d: str) -> DataFrame:
    own = images.images_of(_image(spark, d), ["vec_id"]).withColumnRenamed("rgba", "image")
    return images.pixels_of(colour.dithered(own, "image", "width", 2, "linear").withColumnRenamed("image", "rgba"), ["vec_id"])


_WIDE = lambda e: f"[({e} >> 11) * 8 + (({e} >> 11) >> 2), (({e} >> 5) & 63) * 4 + ((({e} >> 5) & 63) >> 4), ({e} & 31) * 8 + (({e} & 31) >> 2)]"
_MIXED = lambda f: "[" + ", ".join(f.format(k=k) for k in (1, 2, 3)) + "]"


@query(f"""WITH h AS (SELECT p_partkey, substr(md5(CAST(p_partkey AS VARCHAR)), 1, 16) AS x FROM part), b AS (SELECT p_partkey, list_transform(range(8), lambda i: CAST('0x' || substr(x, 2 * CAST(i AS INT) + 1, 2) AS BIGINT)) AS b FROM h),
    e AS (SELECT p_partkey, b, b[1] + 256 * b[2] AS o, b[3] + 256 * b[4] AS t FROM b), w AS (SELECT *, {_WIDE('o')} AS p, {_WIDE('t')} AS q FROM e),
    c AS (SELECT *, CASE WHEN o > t THEN {_MIXED('(2 * p[{k}] + q[{k}]) // 3')} ELSE {_MIXED('(p[{k}] + q[{k}]) // 2')} END AS third, CASE WHEN o > t THEN {_MIXED('(p[{k}] + 2 * q[{k}]) // 3')} ELSE [0, 0, 0] END AS fourth FROM w),
    k AS (SELECT *, unnest(range(16)) AS k FROM c), n AS (SELECT *, (b[5 + k // 4] >> (2 * (k % 4))) & 3 AS n FROM k), s AS (SELECT p_partkey, k, CASE n WHEN 0 THEN p WHEN 1 THEN q WHEN 2 THEN third ELSE fourth END AS v, CASE WHEN n = 3 AND o <= t THEN 0 ELSE 255 END AS a FROM n)
    SELECT p_partkey, string_agg(format('{{:02X}}{{:02X}}{{:02X}}{{:02X}}', v[1], v[2], v[3], a), '' ORDER BY k) AS pixels FROM s GROUP BY p_partkey""")
def dxt1_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Digests of part numbers seen as DXT1 blocks."""
    code = table(spark, d, "part").select("p_partkey", F.unhex(F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 16)).alias("block"))
    return blocks.pixels_of_blocks(code, "dxt1").select("p_partkey", F.hex("pixels").alias("pixels"))


def _texture_error(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """How far pixel blocks are from themselves after a texture, on average over all."""
    own = _image(spark, d).withColumn("a", F.lit(255).cast("long"))
    back = images.pixels_of(images.decoded(blocks.textured(images.images_of(own, ["vec_id"]), kind).select("vec_id", "content")), ["vec_id"])
    both = own.join(back.select("vec_id", "x", "y", *[F.col(c).alias(f"_{c}") for c in "rgba"]), ["vec_id", "x", "y"])
    apart = sum(F.abs(F.col(c) - F.col(f"_{c}")) for c in "rgb")
    return both.groupBy("vec_id").agg(F.count("*").alias("pixels"), (F.avg(apart / 3) < 96).alias("near"), F.max(F.abs(F.col("a") - F.col("_a"))).alias("alpha_apart"))


@query("SELECT vec_id, CAST(16 AS BIGINT) AS pixels, true AS near, CAST(0 AS BIGINT) AS alpha_apart FROM embeddings")
def dxt1_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return _texture_error(spark, d, "dxt1")


@query("SELECT vec_id, CAST(16 AS BIGINT) AS pixels, true AS near, CAST(0 AS BIGINT) AS alpha_apart FROM embeddings")
def dxt5_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return _texture_error(spark, d, "dxt5")
