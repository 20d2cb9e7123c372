"""Every query of the library's own operators, with DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltwork.functions import numeric, pixels as px, text
from quiltwork.operators import colour, dedup, flow, geometry, grouping, packing, pairing, raster, render, select
from quiltwork.operators.tracing import settled
from quiltwork.plans import config
from quiltwork.plans.views import PATHS, PIXELS, SPRITES, paths, pixels, sprites, table
from quiltwork.streaming import events as ev

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


PAGE = packing.PageOptions()
_CELL = "cell AS (SELECT max(w + 2) AS cw, max(h + 2) AS ch FROM sprites)"
#: The grid of all sprites on pages of 1024 by 1024, and its SQL.
_GRID = f"""{SPRITES}, {_CELL},
    ranked AS (SELECT s.*, row_number() OVER (ORDER BY w * h DESC, id DESC) - 1 AS i, cw, ch, 1024 // cw AS cols, (1024 // cw) * (1024 // ch) AS per FROM sprites s, cell),
    placed AS (SELECT id, w, h, folder, ord, i // per AS page, ((i % per) % cols) * cw AS x, ((i % per) // cols) * ch AS y, w + 2 AS frame_w, h + 2 AS frame_h FROM ranked)"""
_BY_FOLDER = f"""{SPRITES}, cell AS (SELECT folder, max(w + 2) AS cw, max(h + 2) AS ch FROM sprites GROUP BY folder),
    ranked AS (SELECT s.*, row_number() OVER (PARTITION BY s.folder ORDER BY w * h DESC, id DESC) - 1 AS i, cw, ch, 256 // cw AS cols, (256 // cw) * (256 // ch) AS per FROM sprites s JOIN cell USING (folder)),
    placed AS (SELECT id, folder, i // per AS page, ((i % per) % cols) * cw AS x, ((i % per) // cols) * ch AS y, w + 2 AS frame_w, h + 2 AS frame_h FROM ranked)"""


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return packing.grid(sprites(spark, d), PAGE)


def _by_folder(spark: SparkSession, d: str) -> DataFrame:
    return packing.grid(sprites(spark, d), packing.PageOptions(width=256, height=256), ["folder"])


@query(f"WITH {_GRID} SELECT id, CAST(page AS BIGINT) AS page, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, frame_w, frame_h FROM placed")
def grid_pack(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).select("id", "page", "x", "y", "frame_w", "frame_h")


@query(f"""WITH {_BY_FOLDER}, pages AS (SELECT folder, max(page) + 1 AS n FROM placed GROUP BY folder),
    firsts AS (SELECT folder, coalesce(sum(n) OVER (ORDER BY folder ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_page FROM pages)
    SELECT id, folder, CAST(page + first_page AS BIGINT) AS page, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y FROM placed JOIN firsts USING (folder)""")
def grid_pack_by_folder(spark: SparkSession, d: str) -> DataFrame:
    placed = _by_folder(spark, d)
    firsts = grouping.page_offsets(placed.groupBy("folder").agg((F.max("page") + 1).alias("n")), "folder", "n")
    return placed.join(firsts, "folder").select("id", "folder", (F.col("page") + F.col("first_page")).alias("page"), "x", "y")


def _sizes(rule: str, width: str, height: str) -> str:
    return f"""SELECT page, '{rule}' AS rule, CAST({width} AS BIGINT) AS width, CAST({height} AS BIGINT) AS height, sprites FROM extents"""


@query(f"""WITH {_GRID}, extents AS (SELECT CAST(page AS BIGINT) AS page, max(x + frame_w) AS w, max(y + frame_h) AS h, count(*) AS sprites FROM placed GROUP BY page)
    {_sizes('any', 'w', 'h')} UNION ALL {_sizes('pot', 'CAST(1 AS BIGINT) << length(bin(w - 1))', 'CAST(1 AS BIGINT) << length(bin(h - 1))')}
    UNION ALL {_sizes('x4', '(w + 3) // 4 * 4', '(h + 3) // 4 * 4')} UNION ALL {_sizes('square', 'greatest(w, h)', 'greatest(w, h)')}""")
def finalize_pages(spark: SparkSession, d: str) -> DataFrame:
    placed, found = _grid(spark, d), None
    for rule in ("any", "pot", "x4", "square"):
        one = packing.page_sizes(placed, ["page"], rule=rule).select("page", F.lit(rule).alias("rule"), "width", "height", "sprites")
        found = one if found is None else found.union(one)
    return found


_FLOW = """{sprites}, n AS (SELECT folder, id, w + 2 AS w, h + 2 AS h, row_number() OVER (PARTITION BY folder ORDER BY id, ord) AS k FROM sprites),
    flow AS (
        SELECT folder, id, w, h, k, CAST(0 AS BIGINT) AS page, CAST(0 AS BIGINT) AS x, CAST(0 AS BIGINT) AS y, w AS nx, CAST(0 AS BIGINT) AS ny, h AS low FROM n WHERE k = 1
        UNION ALL
        SELECT folder, id, w, h, k, page, x, y, x + w, y, greatest(CASE WHEN page > before THEN 0 ELSE low END, y + h) FROM (
            SELECT folder, id, w, h, k, before, CASE WHEN wy + h > 512 THEN before + 1 ELSE before END AS page, CASE WHEN wy + h > 512 THEN 0 ELSE wx END AS x, CASE WHEN wy + h > 512 THEN 0 ELSE wy END AS y, low
            FROM (SELECT n.folder, n.id, n.w, n.h, n.k, f.page AS before, CASE WHEN f.nx + n.w > 512 THEN 0 ELSE f.nx END AS wx, CASE WHEN f.nx + n.w > 512 THEN f.low ELSE f.ny END AS wy, f.low
                FROM flow f JOIN n ON n.folder = f.folder AND n.k = f.k + 1)))"""


@query(f"WITH RECURSIVE {_FLOW.format(sprites=SPRITES)} SELECT folder, id, page, x, y, w AS frame_w, h AS frame_h FROM flow")
def basic_pack_rows(spark: SparkSession, d: str) -> DataFrame:
    return flow.pack(sprites(spark, d), "folder", "rows").drop("rotated")


def _audited(placed: DataFrame) -> DataFrame:
    """Counts that depend on the input alone when the placement is valid: sprites, their area, overlaps, and frames beyond the page."""
    checked = placed.groupBy("folder").agg(F.count("*").alias("sprites"), F.sum(F.col("frame_w") * F.col("frame_h")).alias("area"), F.sum(((F.col("x") < 0) | (F.col("y") < 0) | (F.col("x") + F.col("frame_w") > 512) | (F.col("y") + F.col("frame_h") > 512)).cast("long")).alias("beyond"))
    met = packing.overlaps(placed, ["folder", "page"]).groupBy("folder").agg(F.count("*").alias("overlaps"))
    return checked.join(met, "folder", "left").select("folder", "sprites", "area", "beyond", F.coalesce("overlaps", F.lit(0).cast("long")).alias("overlaps"))


_AUDIT = f"WITH {SPRITES} SELECT folder, count(*) AS sprites, CAST(sum((w + 2) * (h + 2)) AS BIGINT) AS area, CAST(0 AS BIGINT) AS beyond, CAST(0 AS BIGINT) AS overlaps FROM sprites GROUP BY folder"


@query()
def maxrects_pack(spark: SparkSession, d: str) -> DataFrame:
    return flow.pack(sprites(spark, d), "folder", "maxrects")


@query()
def guillotine_pack(spark: SparkSession, d: str) -> DataFrame:
    return flow.pack(sprites(spark, d), "folder", "guillotine")


@query(_AUDIT)
def maxrects_audit(spark: SparkSession, d: str) -> DataFrame:
    return _audited(maxrects_pack(spark, d))


@query(_AUDIT)
def guillotine_audit(spark: SparkSession, d: str) -> DataFrame:
    return _audited(guillotine_pack(spark, d))


@query(_AUDIT)
def best_rows_audit(spark: SparkSession, d: str) -> DataFrame:
    return _audited(flow.best_rows(sprites(spark, d), "folder"))


_ALIAS = "aliased AS (SELECT doc_id, source, CASE WHEN first_value(doc_id) OVER (PARTITION BY text ORDER BY doc_id) <> doc_id THEN first_value(doc_id) OVER (PARTITION BY text ORDER BY doc_id) END AS alias_of FROM documents)"


def _aliases(spark: SparkSession, d: str, within: list[str] | None = None) -> DataFrame:
    return dedup.aliases(table(spark, d, "documents").withColumn("ord", F.col("doc_id")), "text", "doc_id", "ord", within).drop("ord")


@query(f"WITH {_ALIAS} SELECT doc_id, alias_of FROM aliased")
def alias_resolve(spark: SparkSession, d: str) -> DataFrame:
    return _aliases(spark, d)


@query("""SELECT doc_id, source, CASE WHEN first_value(doc_id) OVER w <> doc_id THEN first_value(doc_id) OVER w END AS alias_of
    FROM documents WINDOW w AS (PARTITION BY source, text ORDER BY doc_id)""")
def alias_within_folder(spark: SparkSession, d: str) -> DataFrame:
    return _aliases(spark, d, ["source"])


@query(f"WITH {_ALIAS} SELECT count(*) AS items, count(*) FILTER (alias_of IS NULL) AS owners, count(alias_of) AS aliases, count(DISTINCT alias_of) AS shared FROM aliased")
def alias_summary(spark: SparkSession, d: str) -> DataFrame:
    return dedup.alias_summary(_aliases(spark, d), "doc_id")


@query(f"WITH {_ALIAS} SELECT doc_id FROM aliased WHERE doc_id IN (SELECT alias_of FROM aliased WHERE alias_of IS NOT NULL)")
def alias_target_semi(spark: SparkSession, d: str) -> DataFrame:
    return dedup.alias_targets(_aliases(spark, d), "doc_id").select("doc_id")


@query("SELECT replace(p_name, ' ', '_') AS id, count(*) AS times FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    return dedup.duplicate_ids(table(spark, d, "part").select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("id")), "id")


@query(f"""WITH {PATHS}, named AS (SELECT page_id, path, regexp_extract(path, '[^/]*$') AS name FROM paths)
    SELECT page_id, path FROM named WHERE NOT (path LIKE '%/en/%' OR regexp_full_match(name, '1.*') OR regexp_full_match(path, 'm\\..*'))""")
def ignore_globs(spark: SparkSession, d: str) -> DataFrame:
    patterns = ["*/en/*", "1*", "m.*"]
    return select.without_ignored(paths(spark, d), "path", patterns)


@query(f"WITH {SPRITES} SELECT id FROM sprites WHERE id LIKE 'red^_%' ESCAPE '^' OR regexp_full_match(id, '.*_widget_.*') OR regexp_full_match(id, '.*_00000000.')")
def variant_filter(spark: SparkSession, d: str) -> DataFrame:
    return select.included(sprites(spark, d), "id", "red_*, *_widget_*,*_00000000?,").select("id")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def exclude_inputs(spark: SparkSession, d: str) -> DataFrame:
    return select.discover([table(spark, d, "documents").select("doc_id")], "doc_id", table(spark, d, "labels"))


@query("SELECT text, min(root) AS root FROM (SELECT text, 0 AS root FROM documents UNION ALL SELECT text, 1 FROM benchmark) GROUP BY text")
def discover_union_distinct(spark: SparkSession, d: str) -> DataFrame:
    roots = [table(spark, d, n).select("text", F.lit(k).alias("root")) for k, n in enumerate(("documents", "benchmark"))]
    return select.discover(roots, "text")


@query(f"""WITH {PATHS}, below AS (SELECT page_id, regexp_extract(path, '^[^/]*/(.*)$', 1) AS p FROM paths WHERE path LIKE '%/%')
    SELECT page_id, regexp_replace(p, '([^/])\\.[^./]*$', '\\1') AS rel, regexp_extract(p, '[^/]*$') AS name, regexp_extract(p, '^(.*)/[^/]*$', 1) AS folder FROM below""")
def relative_ids(spark: SparkSession, d: str) -> DataFrame:
    below = paths(spark, d).where(F.contains("path", F.lit("/"))).select("page_id", F.regexp_extract("path", "^[^/]*/(.*)$", 1).alias("p"))
    return below.select("page_id", text.without_extension(F.col("p")).alias("rel"), text.file_name(F.col("p")).alias("name"), text.parent_folder(F.col("p")).alias("folder"))


@query(f"WITH {SPRITES} SELECT ord, regexp_replace(regexp_replace(regexp_replace(id, '_0+', '_', 'g'), '^(red|blue)_', '\\1-', 'g'), '[aeiou]', '', 'g') AS renamed FROM sprites")
def rename_chain(spark: SparkSession, d: str) -> DataFrame:
    return sprites(spark, d).select("ord", text.rename(F.col("id"), [("_0+", "_"), ("^(red|blue)_", "$1-"), ("[aeiou]", "")]).alias("renamed"))


@query("""SELECT raw, CASE WHEN s = '' THEN '_' WHEN regexp_matches(s, '^[0-9]') THEN '_' || s ELSE s END AS ident FROM
    (SELECT raw, regexp_replace(raw, '[^A-Za-z0-9]', '_', 'g') AS s FROM (SELECT p_brand AS raw FROM part UNION SELECT c_name FROM customer UNION SELECT o_orderpriority FROM orders))""")
def sanitize_ident(spark: SparkSession, d: str) -> DataFrame:
    raw = None
    for name, column in (("part", "p_brand"), ("customer", "c_name"), ("orders", "o_orderpriority")):
        one = table(spark, d, name).select(F.col(column).alias("raw"))
        raw = one if raw is None else raw.union(one)
    return raw.distinct().select("raw", text.identifier(F.col("raw")).alias("ident"))


@query("""SELECT doc_id, contains(f, 'cion') AS hit, CAST(length(f) AS BIGINT) AS n FROM
    (SELECT doc_id, trim(regexp_replace(translate(lower(text), 'áàäâéèëêíìïîóòöôúùüûñç', 'aaaaeeeeiiiioooouuuunc'), '[ \\t\\r\\n]+', ' ', 'g'), ' ') AS f FROM documents)""")
def accent_fold_search(spark: SparkSession, d: str) -> DataFrame:
    f = text.folded(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.contains(f, F.lit("cion")).alias("hit"), F.length(f).cast("long").alias("n"))


def _frames(df: DataFrame) -> DataFrame:
    return df.select("base", "name", F.array_join("frames", ",").alias("frames"), F.size("frames").cast("long").alias("n"))


_SPLIT = "regexp_extract(id, '^((?s:.)*[_\\-. ])([0-9]+)$', 1) AS base, TRY_CAST(regexp_extract(id, '^((?s:.)*[_\\-. ])([0-9]+)$', 2) AS BIGINT) AS number"


@query(f"""WITH {SPRITES}, ids AS (SELECT id, ord FROM sprites UNION ALL SELECT n_name, n_nationkey FROM nation), parts AS (SELECT id, ord, {_SPLIT} FROM ids)
    SELECT base, regexp_replace(base, '[_\\-. ]+$', '') AS name, string_agg(id, ',' ORDER BY number, ord) AS frames, count(*) AS n FROM parts WHERE base <> '' GROUP BY base HAVING count(*) >= 2""")
def animations_detect(spark: SparkSession, d: str) -> DataFrame:
    ids = sprites(spark, d).select("id", "ord").union(table(spark, d, "nation").select("n_name", F.col("n_nationkey").cast("long")))
    base, number = text.frame_suffix(F.col("id"))
    return _frames(grouping.animations(ids, base, number, "id", "ord"))


@query("""WITH ids AS (SELECT c_name AS id, c_custkey AS ord FROM customer UNION ALL SELECT s_name, s_suppkey FROM supplier),
    parts AS (SELECT id, ord, regexp_extract(id, '^(.*?)([0-9]+)$', 1) AS base, CAST(regexp_extract(id, '^(.*?)([0-9]+)$', 2) AS BIGINT) AS number FROM ids WHERE regexp_matches(id, '[0-9]$'))
    SELECT base, base AS name, string_agg(id, ',' ORDER BY number, ord) AS frames, count(*) AS n FROM parts GROUP BY base HAVING count(*) >= 2""")
def animation_gui_groups(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "customer").select(F.col("c_name").alias("id"), F.col("c_custkey").alias("ord")).union(table(spark, d, "supplier").select("s_name", "s_suppkey"))
    base, number = text.loose_suffix(F.col("id"))
    return _frames(grouping.animations(ids, base, number, "id", "ord"))


@query("SELECT conv_id, string_agg(role, '>' ORDER BY turn, role) AS roles, count(*) AS turns FROM conversations GROUP BY conv_id")
def frames_in_order(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("f"))
    return found.select("conv_id", F.array_join("f.role", ">").alias("roles"), F.size("f").cast("long").alias("turns"))


_PAIRS = """items AS (SELECT p_partkey AS item, p_brand || '/' || p_name AS key, p_name AS name FROM part WHERE p_size <= 25),
    companions AS (SELECT p_brand || '/' || p_name AS key, p_name AS name, 'n' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS path FROM part WHERE p_size > 25),
    by_key AS (SELECT key, min(path) AS path FROM companions GROUP BY key),
    by_name AS (SELECT name, min(path) AS path FROM companions GROUP BY name HAVING count(*) = 1),
    lone AS (SELECT name FROM items GROUP BY name HAVING count(*) = 1),
    paired AS (SELECT i.item, coalesce(k.path, n.path) AS companion FROM items i LEFT JOIN by_key k USING (key) LEFT JOIN (SELECT * FROM by_name WHERE name IN (SELECT name FROM lone)) n USING (name))"""


def _companions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, d, "part").select("p_partkey", "p_size", F.concat("p_brand", F.lit("/"), "p_name").alias("key"), F.col("p_name").alias("name"))
    items = part.where("p_size <= 25").select(F.col("p_partkey").alias("item"), "key", "name")
    return items, part.where("p_size > 25").select("key", "name", F.concat(F.lit("n"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("path"))


@query(f"WITH {_PAIRS} SELECT item, companion FROM paired")
def normal_pairing(spark: SparkSession, d: str) -> DataFrame:
    return pairing.pair(*_companions(spark, d), "key", "name", "path").select("item", "companion")


@query(f"WITH {_PAIRS} SELECT path FROM companions WHERE path NOT IN (SELECT companion FROM paired WHERE companion IS NOT NULL)")
def orphan_normals(spark: SparkSession, d: str) -> DataFrame:
    items, companions = _companions(spark, d)
    return pairing.orphans(companions, pairing.pair(items, companions, "key", "name", "path"), "path").select("path")


@query("""SELECT d.doc_id, coalesce(CASE WHEN l.toxic = 1 THEN 'config' END, CASE WHEN d.lang <> 'en' THEN 'sidecar' END, 'default') AS pivot
    FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)""")
def override_precedence(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    config = table(spark, d, "labels").where("toxic = 1").select("doc_id", F.lit("config").alias("v")).distinct()
    sidecar = docs.where("lang <> 'en'").select("doc_id", F.lit("sidecar").alias("v"))
    return pairing.with_overrides(docs.select("doc_id"), [(config, "v"), (sidecar, "v")], "doc_id", "pivot", "default")


@query("""SELECT c_custkey, CAST(coalesce(min(n_regionkey), 99) AS BIGINT) AS group_index FROM customer LEFT JOIN (SELECT n_nationkey, n_regionkey FROM nation WHERE n_regionkey > 0) n ON n_nationkey = c_nationkey GROUP BY c_custkey""")
def group_ownership(spark: SparkSession, d: str) -> DataFrame:
    listed = table(spark, d, "nation").where("n_regionkey > 0").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").cast("long").alias("g"))
    return pairing.owned(table(spark, d, "customer").select("c_custkey", "c_nationkey"), listed, "c_nationkey", "g", 99).select("c_custkey", F.col("group_index").cast("long").alias("group_index"))


@query(f"WITH {PATHS}, found AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, count(*) AS items FROM paths GROUP BY 1) SELECT folder, items, row_number() OVER (ORDER BY folder) - 1 AS rank FROM found")
def folder_groups(spark: SparkSession, d: str) -> DataFrame:
    return grouping.folders(paths(spark, d), text.parent_folder(F.col("path")))


@query(f"""WITH {PATHS}, parts AS (SELECT string_split(path, '/') AS p FROM paths), each AS (SELECT array_to_string(p[1 : n], '/') AS folder FROM (SELECT p, unnest(range(0, len(p))) AS n FROM parts))
    SELECT folder, count(*) AS files FROM each GROUP BY folder""")
def tree_counts(spark: SparkSession, d: str) -> DataFrame:
    return grouping.tree_counts(paths(spark, d), "path")


@query(f"WITH {_BY_FOLDER}, pages AS (SELECT folder, max(page) + 1 AS n FROM placed GROUP BY folder) SELECT folder, CAST(n AS BIGINT) AS n, CAST(coalesce(sum(n) OVER (ORDER BY folder ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_page FROM pages")
def page_offsets(spark: SparkSession, d: str) -> DataFrame:
    return grouping.page_offsets(_by_folder(spark, d).groupBy("folder").agg((F.max("page") + 1).alias("n")), "folder", "n")


@query(f"WITH {_GRID} SELECT CAST(page AS BIGINT) AS page, count(*) AS sprites, string_agg(id || '@' || CAST(x AS VARCHAR) || ',' || CAST(y AS VARCHAR), ';' ORDER BY id) AS listing FROM placed GROUP BY page")
def sheets_nested(spark: SparkSession, d: str) -> DataFrame:
    spot = F.concat("id", F.lit("@"), F.col("x").cast("string"), F.lit(","), F.col("y").cast("string"))
    found = _grid(spark, d).groupBy("page").agg(F.sort_array(F.collect_list(F.struct("id", spot.alias("s")))).alias("l"))
    return found.select("page", F.size("l").cast("long").alias("sprites"), F.array_join("l.s", ";").alias("listing"))


#: Data formats by id, with the family that writes them, the file's extension and whether frames may be turned.
PRESETS = [("json-array", "json", "json", True), ("css", "css", "css", False), ("tsv", "tsv", "tsv", True), ("starling", "xml", "xml", True), ("plain", "plain", "txt", False)]
_PRESETS = ", ".join(f"('{a}', '{b}', '{c}', {str(t).lower()})" for a, b, c, t in PRESETS)


@query(f"""WITH {SPRITES}, presets AS (SELECT * FROM (VALUES {_PRESETS}) t(preset, family, extension, turns)),
    wanted AS (SELECT id, CASE CAST(ord % 6 AS INT) WHEN 0 THEN 'json-array' WHEN 1 THEN 'css' WHEN 2 THEN 'tsv' WHEN 3 THEN 'starling' WHEN 4 THEN 'plain' ELSE 'unknown' END AS preset FROM sprites)
    SELECT id, w.preset, family, extension, turns FROM wanted w LEFT JOIN presets p USING (preset)""")
def preset_lookup(spark: SparkSession, d: str) -> DataFrame:
    presets = spark.createDataFrame(PRESETS, "preset string, family string, extension string, turns boolean")
    wanted = F.coalesce(F.get(F.array(*[F.lit(p[0]) for p in PRESETS]), (F.col("ord") % 6).cast("int")), F.lit("unknown"))
    return sprites(spark, d).select("id", wanted.alias("preset")).join(F.broadcast(presets), "preset", "left")


@query(f"WITH {_GRID} SELECT count(*) AS sprites, CAST(0 AS BIGINT) AS overlaps FROM placed")
def overlap_audit(spark: SparkSession, d: str) -> DataFrame:
    placed = _grid(spark, d)
    counts = placed.agg(F.count("*").alias("sprites")).withColumn("k", F.lit(0))
    met = packing.overlaps(placed, ["page"]).agg(F.count("*").alias("overlaps")).withColumn("k", F.lit(0))
    return counts.join(met, "k").drop("k")


@query(f"WITH {_GRID} SELECT id, CAST(page AS BIGINT) AS page FROM placed WHERE x < 700 AND x + frame_w > 100 AND y < 450 AND y + frame_h > 200")
def marquee_select(spark: SparkSession, d: str) -> DataFrame:
    hit = select.inside(F.col("x"), F.col("y"), F.col("frame_w"), F.col("frame_h"), (700, 200, 100, 450))
    return _grid(spark, d).where(hit).select("id", "page")


#: Line items as rectangles on their order's page.
_RECTS = "rects AS (SELECT l_orderkey AS page, l_linenumber AS id, CAST(l_quantity AS BIGINT) * 4 AS x, CAST(l_partkey % 97 AS BIGINT) AS y, CAST(l_suppkey % 60 + 5 AS BIGINT) AS frame_w, CAST(round(l_tax * 1000) AS BIGINT) + 5 AS frame_h FROM lineitem)"


@query(f"""WITH {_RECTS} SELECT a.page, a.id AS "outer", b.id AS "inner" FROM rects a JOIN rects b ON a.page = b.page AND a.id <> b.id
    AND a.x <= b.x AND a.y <= b.y AND a.x + a.frame_w >= b.x + b.frame_w AND a.y + a.frame_h >= b.y + b.frame_h""")
def contains_pairs(spark: SparkSession, d: str) -> DataFrame:
    rects = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("id"), (F.col("l_quantity").cast("long") * 4).alias("x"), (F.col("l_partkey") % 97).cast("long").alias("y"),
        (F.col("l_suppkey") % 60 + 5).cast("long").alias("frame_w"), (F.round(F.col("l_tax") * 1000).cast("long") + 5).alias("frame_h"),
    )
    return packing.containing(rects, rects, ["page"], cell=128).where("outer <> inner")


@query(f"""WITH {_RECTS} SELECT a.page, a.id AS a, b.id AS b FROM rects a JOIN rects b ON a.page = b.page AND a.id < b.id
    AND a.x < b.x + b.frame_w AND b.x < a.x + a.frame_w AND a.y < b.y + b.frame_h AND b.y < a.y + a.frame_h""")
def overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    rects = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("id"), (F.col("l_quantity").cast("long") * 4).alias("x"), (F.col("l_partkey") % 97).cast("long").alias("y"),
        (F.col("l_suppkey") % 60 + 5).cast("long").alias("frame_w"), (F.round(F.col("l_tax") * 1000).cast("long") + 5).alias("frame_h"),
    )
    return packing.overlaps(rects, ["page"])


_SHEET = "sheets AS (SELECT ord, w * 4 + 20 AS sw, h * 4 + 12 AS sh FROM sprites)"


@query(f"""WITH {SPRITES}, {_SHEET}, sized AS (SELECT *, (sw - 8 + 2) // 18 AS nx, (sh - 8 + 2) // 18 AS ny FROM sheets)
    SELECT ord, CAST("row" AS BIGINT) AS "row", CAST(col AS BIGINT) AS col, CAST(4 + col * 18 AS BIGINT) AS x, CAST(4 + "row" * 18 AS BIGINT) AS y FROM (SELECT ord, nx, "row", unnest(range(nx)) AS col FROM (SELECT ord, nx, unnest(range(ny)) AS "row" FROM sized))""")
def sheet_slices(spark: SparkSession, d: str) -> DataFrame:
    sheets = sprites(spark, d).select("ord", (F.col("w") * 4 + 20).alias("sw"), (F.col("h") * 4 + 12).alias("sh"))
    return packing.slices(sheets, "sw", "sh", 4, 2, cell=(16, 16)).select("ord", "row", "col", "x", "y")


@query(f"""WITH {SPRITES}, {_SHEET}, sized AS (SELECT *, (sw - 2 - 2) // 3 AS cell_w, (sh - 2 - 1) // 2 AS cell_h FROM sheets)
    SELECT ord, CAST("row" AS BIGINT) AS "row", CAST(col AS BIGINT) AS col, 1 + col * (cell_w + 1) AS x, 1 + "row" * (cell_h + 1) AS y, cell_w, cell_h FROM sized, (SELECT unnest(range(2)) AS "row"), (SELECT unnest(range(3)) AS col)""")
def sheet_slices_by_count(spark: SparkSession, d: str) -> DataFrame:
    sheets = sprites(spark, d).select("ord", (F.col("w") * 4 + 20).alias("sw"), (F.col("h") * 4 + 12).alias("sh"))
    return packing.slices(sheets, "sw", "sh", 1, 1, cells=(3, 2)).select("ord", "row", "col", "x", "y", "cell_w", "cell_h")


@query(f"""WITH {SPRITES} SELECT ord, (w + 3) // 4 * 4 AS up4, w // 4 * 4 AS down4, (h + 6) // 7 * 7 AS up7, CASE WHEN w <= 1 THEN CAST(1 AS BIGINT) ELSE CAST(1 AS BIGINT) << length(bin(w - 1)) END AS pot,
    CAST(1 AS BIGINT) << (length(bin(h)) - 1) AS pot_below FROM sprites""")
def align_and_pot(spark: SparkSession, d: str) -> DataFrame:
    w, h = F.col("w"), F.col("h")
    return sprites(spark, d).select("ord", numeric.ceil_to(w, 4).alias("up4"), numeric.floor_to(w, 4).alias("down4"), numeric.ceil_to(h, 7).alias("up7"), numeric.next_pot(w).alias("pot"), numeric.prev_pot(h).alias("pot_below"))


@query("SELECT c_custkey, CAST(greatest(floor((v + 8) / 16.0) * 16, 0) AS BIGINT) AS snapped FROM (SELECT c_custkey, CAST(floor(c_acctbal) AS BIGINT) AS v FROM customer)")
def manual_snap(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", numeric.snap_nearest(F.floor("c_acctbal").cast("long"), 16).alias("snapped"))


@query("""SELECT p_size, CAST(min(q) AS BIGINT) AS denominator FROM (SELECT DISTINCT p_size, CAST(p_size AS DOUBLE) / 48 AS s FROM part), (SELECT unnest(range(1, 65)) AS q)
    WHERE abs(round(s * q) / q - s) <= 5e-4 GROUP BY p_size""")
def scale_denominators(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "part").select("p_size").distinct()
    return sizes.select("p_size", numeric.scale_denominator(F.col("p_size").cast("double") / 48).cast("long").alias("denominator"))


SCALES = [1.0, 0.5, 0.25, 2.0, 0.75]
_SCALES = ", ".join(f"({k}, CAST({s} AS FLOAT), '{text.variant_suffix(s)}')" for k, s in enumerate(SCALES))


@query(f"WITH {SPRITES}, scales AS (SELECT * FROM (VALUES {_SCALES}) t(k, s, suffix)) SELECT ord, suffix, CAST(round(CAST(w AS FLOAT) * s) AS BIGINT) AS w, CAST(round(CAST(h AS FLOAT) * s) AS BIGINT) AS h FROM sprites, scales")
def variant_scale(spark: SparkSession, d: str) -> DataFrame:
    scales = F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.lit(text.variant_suffix(s)).alias("suffix")) for s in SCALES]))
    rows = sprites(spark, d).select("ord", "w", "h", scales.alias("v"))
    return rows.select("ord", "v.suffix", numeric.scaled(F.col("w"), F.col("v.s")).alias("w"), numeric.scaled(F.col("h"), F.col("v.s")).alias("h"))


@query(f"""WITH {_GRID}, pages AS (SELECT DISTINCT CAST(page AS BIGINT) AS page FROM placed)
    SELECT page, 'sheet' || CASE WHEN page > 0 THEN '_' || CAST(page AS VARCHAR) ELSE '' END || '-hd.png' AS plain, 'sheet' || CAST(page + 1 AS VARCHAR) || '-hd.png' AS counted,
        'a' || CASE WHEN page > 0 THEN '_' || CAST(page AS VARCHAR) ELSE '' END || '-hdz.png' AS marked FROM pages""")
def expand_names(spark: SparkSession, d: str) -> DataFrame:
    n, s = F.col("page"), F.lit("-hd")
    named = lambda base: text.with_extension(text.expand_name(base, n, s), "png")
    return _grid(spark, d).select("page").distinct().select("page", named("sheet").alias("plain"), named("sheet{n1}").alias("counted"), named("a{v}z").alias("marked"))


_TRIM = "trims AS (SELECT ord, w + 6 AS raw_w, h + 9 AS raw_h, ord % 4 AS lft, ord % 5 AS top, w, h FROM sprites)"


def _trims(spark: SparkSession, d: str) -> DataFrame:
    return sprites(spark, d).select("ord", (F.col("w") + 6).alias("raw_w"), (F.col("h") + 9).alias("raw_h"), (F.col("ord") % 4).alias("lft"), (F.col("ord") % 5).alias("top"), "w", "h")


@query(f"WITH {SPRITES}, {_TRIM} SELECT ord, 2 * lft + w - raw_w AS centre_x2, 2 * top + h - raw_h AS centre_y2, lft AS bottom_left_x, raw_h - top - h AS bottom_left_y, -lft AS frame_x, -top AS frame_y FROM trims")
def frame_offsets(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    found = render.offsets(c("raw_w"), c("raw_h"), c("lft"), c("top"), c("w"), c("h"))
    return _trims(spark, d).select("ord", *[v.alias(k) for k, v in found.items()])


@query(f"WITH {SPRITES}, {_TRIM} SELECT ord, CAST(round(1000 * least(greatest((0.25 * raw_w - lft) / w, 0.0), 1.0)) AS BIGINT) AS pivot_x, CAST(round(1000 * least(greatest((1.0 * raw_h - top) / h, 0.0), 1.0)) AS BIGINT) AS pivot_y FROM trims")
def pivot_crop(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    thousandths = lambda v: F.round(v * 1000).cast("long")
    return _trims(spark, d).select("ord", thousandths(render.cropped_pivot(F.lit(0.25), c("raw_w"), c("lft"), c("w"))).alias("pivot_x"), thousandths(render.cropped_pivot(F.lit(1.0), c("raw_h"), c("top"), c("h"))).alias("pivot_y"))


_Q = lambda c, bits: f"(({c} * {2**bits - 1} + 127) // 255)"


@query(f"WITH {PIXELS} SELECT vec_id, k, {_Q('r', 4)} * 4096 + {_Q('g', 4)} * 256 + {_Q('b', 4)} * 16 + {_Q('a', 4)} AS packed, {_Q('r', 4)} * 17 AS r FROM pixels")
def pixel_rgba4444(spark: SparkSession, d: str) -> DataFrame:
    r, g, b, a = (F.col(c) for c in "rgba")
    return pixels(spark, d).select("vec_id", "k", px.packed_rgba4444(r, g, b, a).alias("packed"), px.expanded(px.quantised(r, 4), 4).alias("r"))


@query(f"""WITH {PIXELS} SELECT vec_id, k, {_Q('r', 5)} * 2048 + {_Q('g', 6)} * 32 + {_Q('b', 5)} AS packed, {_Q('r', 5)} * 8 + {_Q('r', 5)} // 4 AS r, {_Q('g', 6)} * 4 + {_Q('g', 6)} // 16 AS g,
    {_Q('r', 5)} * 2048 + {_Q('g', 5)} * 64 + {_Q('b', 5)} * 2 + CASE WHEN a >= 128 THEN 1 ELSE 0 END AS packed5551 FROM pixels""")
def pixel_rgb565(spark: SparkSession, d: str) -> DataFrame:
    r, g, b, a = (F.col(c) for c in "rgba")
    return pixels(spark, d).select("vec_id", "k", px.packed_rgb565(r, g, b).alias("packed"), px.expanded(px.quantised(r, 5), 5).alias("r"), px.expanded(px.quantised(g, 6), 6).alias("g"), px.packed_rgba5551(r, g, b, a).alias("packed5551"))


@query(f"WITH {PIXELS} SELECT vec_id, k, (77 * r + 150 * g + 29 * b + 128) // 256 AS luma FROM pixels")
def pixel_luma(spark: SparkSession, d: str) -> DataFrame:
    return pixels(spark, d).select("vec_id", "k", px.luma(F.col("r"), F.col("g"), F.col("b")).alias("luma"))


@query(f"WITH {PIXELS} SELECT vec_id, k, (r * a + 127) // 255 AS r, (g * a + 127) // 255 AS g, (b * a + 127) // 255 AS b, a FROM pixels")
def pixel_premultiply(spark: SparkSession, d: str) -> DataFrame:
    return pixels(spark, d).select("vec_id", "k", *[px.over_black(F.col(c), F.col("a")).alias(c) for c in "rgb"], "a")


@query(f"WITH {PIXELS} SELECT vec_id, k, (r * a + (255 - a) * 40 + 127) // 255 AS r, (g * a + (255 - a) * 80 + 127) // 255 AS g, (b * a + (255 - a) * 120 + 127) // 255 AS b FROM pixels")
def pixel_background(spark: SparkSession, d: str) -> DataFrame:
    return pixels(spark, d).select("vec_id", "k", *[px.over(F.col(c), F.col("a"), back).alias(c) for c, back in zip("rgb", (40, 80, 120), strict=True)])


@query(f"WITH {PIXELS} SELECT r // 32 AS r, g // 32 AS g, b // 32 AS b, count(*) AS n FROM pixels GROUP BY 1, 2, 3")
def color_histogram(spark: SparkSession, d: str) -> DataFrame:
    return colour.histogram(pixels(spark, d).select(*[px.div(F.col(c), 32).alias(c) for c in "rgb"]), list("rgb"))


@query(f"WITH {PIXELS}, h AS (SELECT r // 32 AS r, g // 32 AS g, b // 32 AS b, count(*) AS n FROM pixels GROUP BY 1, 2, 3) SELECT r, g, b, n, row_number() OVER (ORDER BY n DESC, r, g, b) AS place FROM h QUALIFY place <= 16")
def palette_topk(spark: SparkSession, d: str) -> DataFrame:
    return colour.top_colours(pixels(spark, d).select(*[px.div(F.col(c), 32).alias(c) for c in "rgb"]), list("rgb"), 16)


@query(f"WITH {PIXELS} SELECT vec_id, count(*) FILTER (a > 127) AS solid, count(*) AS pixels FROM pixels GROUP BY vec_id")
def fill_ratio(spark: SparkSession, d: str) -> DataFrame:
    return colour.fill_ratio(pixels(spark, d), ["vec_id"], "a", 127)


PALETTE = [(96, 96, 96), (128, 128, 128), (160, 128, 96), (96, 128, 160), (128, 160, 128), (144, 112, 144)]
_FAR = "least({})".format(", ".join(f"(r - {a}) * (r - {a}) + (g - {b}) * (g - {b}) + (b - {c}) * (b - {c})" for a, b, c in PALETTE))
_NEAR = "CASE {} END".format(" ".join(f"WHEN (r - {a}) * (r - {a}) + (g - {b}) * (g - {b}) + (b - {c}) * (b - {c}) = far THEN {k}" for k, (a, b, c) in enumerate(PALETTE)))


@query(f"WITH {PIXELS}, d AS (SELECT *, {_FAR} AS far FROM pixels) SELECT vec_id, k, CAST({_NEAR} AS BIGINT) AS entry, CAST(far AS BIGINT) AS distance FROM d")
def nearest_palette(spark: SparkSession, d: str) -> DataFrame:
    place, far = colour.nearest([F.col(c) for c in "rgb"], PALETTE)
    return pixels(spark, d).select("vec_id", "k", place.alias("entry"), far.alias("distance"))


@query(f"""WITH {PIXELS}, d AS (SELECT *, {_FAR} AS far FROM pixels), e AS (SELECT *, CAST({_NEAR} AS BIGINT) AS entry FROM d)
    SELECT entry, CAST((sum(r) * 2 + count(*)) // (count(*) * 2) AS BIGINT) AS r, CAST((sum(g) * 2 + count(*)) // (count(*) * 2) AS BIGINT) AS g, CAST((sum(b) * 2 + count(*)) // (count(*) * 2) AS BIGINT) AS b, count(*) AS n FROM e GROUP BY entry""")
def palette_refine(spark: SparkSession, d: str) -> DataFrame:
    return colour.refined(pixels(spark, d), list("rgb"), PALETTE)


@query(f"WITH {PIXELS} SELECT vec_id, min(k % 4) AS \"left\", min(k // 4) AS top, max(k % 4) - min(k % 4) + 1 AS width, max(k // 4) - min(k // 4) + 1 AS height FROM pixels WHERE a > 130 GROUP BY vec_id")
def trim_bounds(spark: SparkSession, d: str) -> DataFrame:
    rows = pixels(spark, d).withColumn("x", F.col("k") % 4).withColumn("y", px.div(F.col("k"), 4))
    return geometry.bounds(rows, ["vec_id"], "x", "y", "a", 130)


@query(f"""WITH {PIXELS}, ring AS (SELECT vec_id, r // 64 AS r, g // 64 AS g, b // 64 AS b FROM pixels WHERE k % 4 IN (0, 3) OR k // 4 IN (0, 3)), n AS (SELECT vec_id, r, g, b, count(*) AS n FROM ring GROUP BY ALL)
    SELECT vec_id, r, g, b FROM n QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, r, g, b) = 1""")
def border_colour(spark: SparkSession, d: str) -> DataFrame:
    rows = pixels(spark, d).select("vec_id", (F.col("k") % 4).alias("x"), px.div(F.col("k"), 4).alias("y"), *[px.div(F.col(c), 64).alias(c) for c in "rgb"])
    return colour.border_colour(rows, ["vec_id"], "x", "y", F.lit(4), F.lit(4), list("rgb"))


_XYWH = "CAST(x AS VARCHAR) || '{0}' || CAST(y AS VARCHAR) || '{0}' || CAST(frame_w AS VARCHAR) || '{0}' || CAST(frame_h AS VARCHAR)"


@query(f"WITH {_GRID} SELECT id, id || chr(9) || CAST(page AS VARCHAR) || chr(9) || {_XYWH.format('	')} AS line FROM placed")
def metadata_tsv(spark: SparkSession, d: str) -> DataFrame:
    return render.rendered_rows(_grid(spark, d), "tsv").select("id", "line")


@query(f"WITH {_GRID} SELECT CAST(page AS BIGINT) AS page, string_agg(id || ' = ' || {_XYWH.format(' ')}, chr(10) ORDER BY id) || chr(10) AS document FROM placed GROUP BY page")
def metadata_plain(spark: SparkSession, d: str) -> DataFrame:
    return render.documents_of(_grid(spark, d), "plain", ["page"])


_FRAME_JSON = "'{\"x\":' || CAST(x AS VARCHAR) || ',\"y\":' || CAST(y AS VARCHAR) || ',\"w\":' || CAST(frame_w AS VARCHAR) || ',\"h\":' || CAST(frame_h AS VARCHAR) || '}'"


@query(f"WITH {_GRID} SELECT id, '{{\"filename\":\"' || id || '\",\"frame\":' || {_FRAME_JSON} || '}}' AS line FROM placed")
def metadata_json_rows(spark: SparkSession, d: str) -> DataFrame:
    return render.rendered_rows(_grid(spark, d), "json").select("id", "line")


@query(f"WITH {_GRID} SELECT CAST(page AS BIGINT) AS page, '{{\"frames\":[' || string_agg('{{\"filename\":\"' || id || '\",\"frame\":' || {_FRAME_JSON} || '}}', ',' ORDER BY id) || ']}}' AS document FROM placed GROUP BY page")
def metadata_json(spark: SparkSession, d: str) -> DataFrame:
    return render.documents_of(_grid(spark, d), "json", ["page"])


@query(f"WITH {_GRID} SELECT id, '<SubTexture name=\"' || id || '\" x=\"' || x || '\" y=\"' || y || '\" width=\"' || frame_w || '\" height=\"' || frame_h || '\"/>' AS line FROM placed")
def metadata_xml_rows(spark: SparkSession, d: str) -> DataFrame:
    return render.rendered_rows(_grid(spark, d), "xml").select("id", "line")


@query(f"WITH {_GRID} SELECT id, '.' || regexp_replace(id, '[^A-Za-z0-9_-]', '-', 'g') || ' {{ background-position: ' || CAST(-x AS VARCHAR) || 'px ' || CAST(-y AS VARCHAR) || 'px; width: ' || frame_w || 'px; height: ' || frame_h || 'px; }}' AS line FROM placed")
def metadata_css_rows(spark: SparkSession, d: str) -> DataFrame:
    return render.rendered_rows(_grid(spark, d), "css").select("id", "line")


@query("""WITH m AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) >= 3600000000 THEN 1 ELSE 0 END AS new FROM events),
    n AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM m)
    SELECT user_id, CAST(burst AS BIGINT) AS burst, count(*) AS events, CAST(epoch_us(min(ts)) AS BIGINT) AS first_us, CAST(epoch_us(max(ts)) AS BIGINT) AS last_us FROM n GROUP BY user_id, burst""")
def debounce_sessions(spark: SparkSession, d: str) -> DataFrame:
    found = ev.bursts(table(spark, d, "events"), "user_id", "ts", 3600)
    return found.select("user_id", "burst", "events", F.unix_micros(F.col("first").cast("timestamp")).alias("first_us"), F.unix_micros(F.col("last").cast("timestamp")).alias("last_us"))


@query("""WITH m AS (SELECT event_id, user_id, ts, event_type, lag(event_type) OVER w AS before, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    k AS (SELECT * FROM m WHERE n = 1 OR event_type IS DISTINCT FROM before)
    SELECT event_id, user_id, event_type FROM k QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 2000""")
def log_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return ev.without_repeats(table(spark, d, "events"), "user_id", ["ts", "event_id"], ["event_type"], newest=2000).select("event_id", "user_id", "event_type")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS place FROM events QUALIFY place <= 32")
def undo_stack(spark: SparkSession, d: str) -> DataFrame:
    return select.newest(table(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id", 32)


_HALF = "(SELECT make_timestamp((epoch_us(min(ts)) + epoch_us(max(ts))) // 2) FROM events)"


@query(f"""WITH a AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE ts < {_HALF} GROUP BY ALL), b AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE ts >= {_HALF} GROUP BY ALL)
    SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, CASE WHEN coalesce(b.n, 0) > coalesce(a.n, 0) THEN 'added' ELSE 'removed' END AS change, abs(coalesce(b.n, 0) - coalesce(a.n, 0)) AS times
    FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    half = events.agg(F.floor((F.min("us") + F.max("us")) / 2).alias("half"))
    split = events.join(F.broadcast(half))  # one row
    return select.difference(split.where("us < half").select("user_id", "event_type"), split.where("us >= half").select("user_id", "event_type"))


@query("""SELECT user_id, event_id, before, after FROM (SELECT user_id, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before, event_type AS after FROM events) WHERE before IS DISTINCT FROM after""")
def freshness_transitions(spark: SparkSession, d: str) -> DataFrame:
    return ev.transitions(table(spark, d, "events"), "user_id", ["event_id"], "event_type")


@query("""SELECT o_custkey, o_orderkey, CAST(floor(1000000 * (sum(c) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) / CAST(sum(c) OVER (PARTITION BY o_custkey) AS DOUBLE))) AS BIGINT) AS done
    FROM (SELECT o_custkey, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders)""")
def progress_fraction(spark: SparkSession, d: str) -> DataFrame:
    steps = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("c"))
    return ev.running_share(steps, ["o_custkey"], "o_orderkey", "c").select("o_custkey", "o_orderkey", F.floor(F.col("done") * 1000000).cast("long").alias("done"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def newest_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return ev.newest_snapshot(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT user_id, last(event_type ORDER BY event_id) AS event_type FROM events GROUP BY user_id")
def last_flag_wins(spark: SparkSession, d: str) -> DataFrame:
    return select.last_wins(table(spark, d, "events"), "user_id", "event_id", "event_type")


@query("""WITH members AS (SELECT c_custkey AS item, c_mktsegment AS g FROM customer), taken AS (SELECT c_custkey AS item, 'moved' AS g FROM customer WHERE c_acctbal < 0)
    SELECT item, g FROM members WHERE item NOT IN (SELECT item FROM taken) UNION SELECT item, g FROM taken""")
def group_move(spark: SparkSession, d: str) -> DataFrame:
    customer = table(spark, d, "customer")
    members = customer.select(F.col("c_custkey").alias("item"), F.col("c_mktsegment").alias("g"))
    return select.moved(members, customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("item"), F.lit("moved").alias("g")), "item", "g")


@query(f"WITH {SPRITES} SELECT ord, CAST(2 * w * h AS BIGINT) AS twice_area FROM sprites")
def shoelace_area(spark: SparkSession, d: str) -> DataFrame:
    w, h, o = F.col("w").cast("double"), F.col("h").cast("double"), F.lit(0.0)
    ring = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((o, o), (w, o), (w, h), (o, h))])
    return sprites(spark, d).select("ord", geometry.twice_area(ring).cast("long").alias("twice_area"))


@query()
def mesh_contours(spark: SparkSession, d: str) -> DataFrame:
    """Contours of each pixel block's mask: vec_id, loops, holes, points."""
    mask = F.array_join(F.transform("m", lambda v: F.when(v > 130, "01").otherwise("00")), "")
    rows = pixels(spark, d).groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct("k", "a"))).alias("p")).select("vec_id", F.col("p.a").alias("m"))
    found = geometry.with_contours(rows.select("vec_id", F.unhex(mask).alias("mask"), F.lit(4).alias("width")), "mask", "width", 0.0)
    return found.select("vec_id", F.size("contours").cast("long").alias("loops"), F.size(F.filter("contours", lambda c: c["is_hole"])).cast("long").alias("holes"), F.aggregate("contours", F.lit(0), lambda n, c: n + F.size(c["points"])).cast("long").alias("points"))


@query()
def dither_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Each pixel block at four bits for each channel with diffused errors, in hex."""
    code = F.array_join(F.transform("p", lambda v: F.concat(*[F.lpad(F.hex(v[c]), 2, "0") for c in "rgba"])), "")
    rows = pixels(spark, d).groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct("k", "r", "g", "b", "a"))).alias("p"))
    images = rows.select("vec_id", F.unhex(code).alias("image"), F.lit(4).alias("width"))
    return colour.dithered(images, "image", "width").select("vec_id", F.hex("image").alias("image"))


_XY = f"{PIXELS}, image AS (SELECT vec_id, k % 4 AS x, k // 4 AS y, r, g, b, a FROM pixels)"


def _image(spark: SparkSession, d: str) -> DataFrame:
    return pixels(spark, d).select("vec_id", (F.col("k") % 4).alias("x"), px.div(F.col("k"), 4).alias("y"), *"rgba")


@query(f"WITH {_XY} SELECT vec_id, 3 - y AS x, x AS y, r, g, b, a FROM image")
def pixel_turn(spark: SparkSession, d: str) -> DataFrame:
    return raster.turned(_image(spark, d), F.lit(4).cast("long"))


@query(f"WITH {_XY} SELECT vec_id, x, 3 - y AS y, r, g, b, a FROM image")
def pixel_flip(spark: SparkSession, d: str) -> DataFrame:
    return raster.flipped(_image(spark, d), F.lit(4).cast("long"))


@query(f"WITH {_XY} SELECT vec_id, x - 1 AS x, y - 2 AS y, r, g, b, a FROM image WHERE x BETWEEN 1 AND 3 AND y BETWEEN 2 AND 3")
def pixel_crop(spark: SparkSession, d: str) -> DataFrame:
    one, two, three = (F.lit(n).cast("long") for n in (1, 2, 3))
    return raster.cropped(_image(spark, d), one, two, three, two)


@query(f"""WITH {_XY}, spots AS (SELECT CAST(i AS BIGINT) AS x, CAST(j AS BIGINT) AS y FROM (SELECT unnest(range(8)) AS i), (SELECT unnest(range(8)) AS j))
    SELECT vec_id, s.x, s.y, r, g, b, a FROM spots s JOIN image p ON p.x = least(greatest(s.x - 2, 0), 3) AND p.y = least(greatest(s.y - 2, 0), 3)""")
def pixel_extrude(spark: SparkSession, d: str) -> DataFrame:
    four = F.lit(4).cast("long")
    return raster.extruded(_image(spark, d), 2, four, four)


@query(f"""WITH {_XY}, placed AS (SELECT vec_id, vec_id // 64 AS page, (vec_id % 8) * 3 AS lft, (vec_id // 8 % 8) * 3 AS top FROM embeddings),
    moved AS (SELECT page, x + lft AS x, y + top AS y, r, g, b, a, row_number() OVER (PARTITION BY page, x + lft, y + top ORDER BY vec_id DESC) AS k FROM image JOIN placed USING (vec_id) WHERE a > 120)
    SELECT page, x, y, r, g, b, a FROM moved WHERE k = 1""")
def compose_pages(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("vec_id")
    placed = table(spark, d, "embeddings").select("vec_id", px.div(v, 64).alias("page"), (v % 8 * 3).alias("left"), (px.div(v, 8) % 8 * 3).alias("top"), v.alias("nth"))
    solid = _image(spark, d).withColumn("solid", F.when(F.col("a") > 120, F.col("a")).otherwise(0))
    return raster.composed(solid, placed, "vec_id", ["page"], "nth", list("rgba"), "solid")


@query(f"""WITH {_XY}, spots AS (SELECT CAST(i AS BIGINT) AS x, CAST(j AS BIGINT) AS y FROM (SELECT unnest(range(6)) AS i), (SELECT unnest(range(6)) AS j))
    SELECT vec_id, s.x, s.y, r, g, b, a FROM spots s JOIN image p ON p.x = least(greatest(round((s.x + 0.5) / 1.5 - 0.5), 0), 3) AND p.y = least(greatest(round((s.y + 0.5) / 1.5 - 0.5), 0), 3)""")
def pixel_scale_fast(spark: SparkSession, d: str) -> DataFrame:
    return raster.scaled_fast(_image(spark, d), (4, 4), 1.5)


@query(f"""WITH {_XY}, spots AS (SELECT CAST(i AS BIGINT) AS x, CAST(j AS BIGINT) AS y, greatest(floor((i + 0.5) / 2 - 0.5), 0) AS x0, greatest(floor((j + 0.5) / 2 - 0.5), 0) AS y0, (i + 0.5) / 2 - 0.5 AS sx, (j + 0.5) / 2 - 0.5 AS sy
        FROM (SELECT unnest(range(8)) AS i), (SELECT unnest(range(8)) AS j)),
    mixed AS (SELECT p.vec_id, s.x, s.y, sx - x0 AS fx, sy - y0 AS fy, p.r AS r00, q.r AS r10, u.r AS r01, v.r AS r11, p.a AS a00, q.a AS a10, u.a AS a01, v.a AS a11 FROM spots s JOIN image p ON p.x = x0 AND p.y = y0
        JOIN image q ON q.vec_id = p.vec_id AND q.x = least(x0 + 1, 3) AND q.y = y0 JOIN image u ON u.vec_id = p.vec_id AND u.x = x0 AND u.y = least(y0 + 1, 3) JOIN image v ON v.vec_id = p.vec_id AND v.x = least(x0 + 1, 3) AND v.y = least(y0 + 1, 3))
    SELECT vec_id, x, y, CAST(least(greatest(round((r00 * (1 - fx) + r10 * fx) * (1 - fy) + (r01 * (1 - fx) + r11 * fx) * fy), 0), 255) AS BIGINT) AS r,
        CAST(least(greatest(round((a00 * (1 - fx) + a10 * fx) * (1 - fy) + (a01 * (1 - fx) + a11 * fx) * fy), 0), 255) AS BIGINT) AS a FROM mixed""")
def pixel_scale_smooth(spark: SparkSession, d: str) -> DataFrame:
    return raster.scaled_smooth(_image(spark, d), ["vec_id"], (4, 4), 2.0, ["r", "a"])


_AT = lambda n, dx, dy: f"JOIN art {n} ON {n}.vec_id = e.vec_id AND {n}.x = least(greatest(e.x + {dx}, 0), 3) AND {n}.y = greatest(e.y + {dy}, 0)"


@query(f"""WITH {_XY}, art AS (SELECT vec_id, x, y, r // 32 * 8 + a // 64 AS v FROM image),
    seen AS (SELECT e.vec_id, e.x, e.y, a.v AS a, b.v AS b, c.v AS c, d.v AS d, e.v AS e FROM art e {_AT('a', -1, -1)} {_AT('b', 0, -1)} {_AT('c', 1, -1)} {_AT('d', -1, 0)})
    SELECT vec_id, 2 * x AS x, 2 * y AS y, CASE WHEN c = a AND c <> d AND a <> b THEN a ELSE e END AS v FROM seen UNION ALL SELECT vec_id, 2 * x + 1, 2 * y, CASE WHEN a = b AND a <> c AND b <> d THEN b ELSE e END FROM seen
    UNION ALL SELECT vec_id, 2 * x, 2 * y + 1, CASE WHEN d = c AND d <> b AND c <> a THEN c ELSE e END FROM seen UNION ALL SELECT vec_id, 2 * x + 1, 2 * y + 1, CASE WHEN b = d AND b <> a AND d <> c THEN d ELSE e END FROM seen""")
def pixel_scale_twice(spark: SparkSession, d: str) -> DataFrame:
    art = _image(spark, d).select("vec_id", "x", "y", (px.div(F.col("r"), 32) * 8 + px.div(F.col("a"), 64)).alias("v"))
    return raster.scaled_twice(art, ["vec_id"], (4, 4), "v")


@query()
def pixel_bleed(spark: SparkSession, d: str) -> DataFrame:
    """Each pixel block with the colours of its solid pixels (alpha above 127) spread into the others, in hex."""
    alpha = F.when(F.col("a") > 127, F.col("a")).otherwise(0)
    rows = pixels(spark, d).withColumn("a", alpha).groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct("k", "r", "g", "b", "a"))).alias("p"))
    code = F.array_join(F.transform("p", lambda v: F.concat(*[F.lpad(F.hex(v[c]), 2, "0") for c in "rgba"])), "")
    return raster.with_bleeding(rows.select("vec_id", F.unhex(code).alias("image"), F.lit(4).alias("width")), "image", "width").select("vec_id", F.hex("image").alias("image"))


@query(f"""WITH {SPRITES}, s AS (SELECT folder, id, w + 2 AS w, h + 2 AS h, ord % 600 AS px, ord % 555 AS py FROM sprites),
    f AS (SELECT folder, id, w, h, least(px, 512 - w) AS fx, least(py, 512 - h) AS fy FROM s), u AS (SELECT *, (fx + 7) // 8 * 8 AS ux, (fy + 7) // 8 * 8 AS uy FROM f)
    SELECT folder, id, CAST(CASE WHEN ux + w <= 512 AND uy + h <= 512 THEN ux ELSE fx // 8 * 8 END AS BIGINT) AS x, CAST(CASE WHEN ux + w <= 512 AND uy + h <= 512 THEN uy ELSE fy // 8 * 8 END AS BIGINT) AS y FROM u""")
def manual_pack(spark: SparkSession, d: str) -> DataFrame:
    wishes = sprites(spark, d).withColumns({"want_x": F.col("ord") % 600, "want_y": F.col("ord") % 555})
    return flow.pack_manual(wishes, "folder", flow.FlowOptions(align=8)).select("folder", "id", "x", "y")


@query(_AUDIT)
def manual_flow_audit(spark: SparkSession, d: str) -> DataFrame:
    wishes = sprites(spark, d).withColumns({"want_x": F.lit(None).cast("long"), "want_y": F.lit(None).cast("long")})
    return _audited(flow.pack_manual(wishes, "folder"))


def _by_brand(spark: SparkSession, d: str) -> DataFrame:
    return sprites(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("ord"), "p_brand"), "ord")


@query()
def page_size_search(spark: SparkSession, d: str) -> DataFrame:
    """Sprites of each brand on the smallest page of powers of two that holds them."""
    return flow.smallest_page(_by_brand(spark, d), "p_brand", [64, 128, 256, 512, 1024])


@query()
def pack_search(spark: SparkSession, d: str) -> DataFrame:
    """The whole placement of each brand's sprites: the best of all scores, on the smallest page that a search finds."""
    return flow.pack_pages(_by_brand(spark, d), "p_brand", "maxrects", flow.FlowOptions(width=2048, height=2048, score="best"))


@query("SELECT p_brand, count(*) AS sprites, CAST(0 AS BIGINT) AS beyond, CAST(0 AS BIGINT) AS overlaps, true AS compact FROM part GROUP BY p_brand")
def pack_search_audit(spark: SparkSession, d: str) -> DataFrame:
    """Of each brand: nothing beyond its page, nothing overlaps, and, if it is alone, its page is at most a third larger than its sprites."""
    # Two steps read the placement, which takes long.
    placed = settled(pack_search(spark, d))
    beyond = ((F.col("x") + F.col("frame_w") > F.col("page_w")) | (F.col("y") + F.col("frame_h") > F.col("page_h"))).cast("long")
    compact = (F.max("page") > 0) | (F.max(F.col("page_w") * F.col("page_h")) <= F.sum(F.col("frame_w") * F.col("frame_h")) * 4 / 3 + 4096)
    found = placed.groupBy("p_brand").agg(F.count("*").alias("sprites"), F.sum(beyond).alias("beyond"), compact.alias("compact"))
    pairs = packing.overlaps(placed, ["p_brand", "page"]).groupBy("p_brand").agg(F.count("*").alias("overlaps"))
    return found.join(pairs, "p_brand", "left").select("p_brand", "sprites", "beyond", F.coalesce("overlaps", F.lit(0).cast("long")).alias("overlaps"), "compact")


@query()
def pack_600(spark: SparkSession, d: str) -> DataFrame:
    """600 sprites of 64 by 64 on the smallest page that a search finds, with one score."""
    sprites_ = spark.range(600).select(F.lit("all").alias("folder"), F.col("id").alias("ord"), F.concat(F.lit("s"), F.col("id")).alias("id"), F.lit(64).cast("long").alias("w"), F.lit(64).cast("long").alias("h"))
    return flow.pack_pages(sprites_, "folder", "maxrects", flow.FlowOptions(width=4096, height=4096))


@query(f"WITH {PIXELS}, m AS (SELECT vec_id, sum(r) // count(*) AS r, sum(g) // count(*) AS g, sum(b + 30) // count(*) AS b FROM pixels WHERE a <> 0 GROUP BY vec_id) SELECT vec_id, b > r AND b > g AND b >= 160 AND abs(r - 128) <= 48 AND abs(g - 128) <= 48 AS is_normal FROM m")
def normal_map_audit(spark: SparkSession, d: str) -> DataFrame:
    """Blocks whose means, with 30 more blue, look like a normal map's."""
    return colour.normal_map_like(pixels(spark, d).withColumn("b", F.col("b") + 30), ["vec_id"], list("rgb"), "a")


@query()
def palette_median_cut(spark: SparkSession, d: str) -> DataFrame:
    return colour.palettes(pixels(spark, d), "vec_id", list("rgb"), 4)


@query()
def dither_atkinson(spark: SparkSession, d: str) -> DataFrame:
    """Each pixel block at two bits for each channel, in hex."""
    code = F.array_join(F.transform("p", lambda v: F.concat(*[F.lpad(F.hex(v[c]), 2, "0") for c in "rgba"])), "")
    rows = pixels(spark, d).groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct("k", "r", "g", "b", "a"))).alias("p"))
    return colour.dithered(rows.select("vec_id", F.unhex(code).alias("image"), F.lit(4).alias("width")), "image", "width", 2, "atkinson").select("vec_id", F.hex("image").alias("image"))


@query("""WITH named AS (SELECT p_brand, p_partkey, regexp_replace(p_name, '[^A-Za-z0-9]', '_', 'g') AS name FROM part),
    n AS (SELECT *, row_number() OVER (PARTITION BY p_brand, name ORDER BY p_partkey) - 1 AS k FROM named) SELECT p_brand, p_partkey, name || repeat('_', CAST(k AS INT)) AS name FROM n""")
def unique_idents(spark: SparkSession, d: str) -> DataFrame:
    """No part name ends in _, so names here differ by how many there were before; in general that isn't enough."""
    named = table(spark, d, "part").select("p_brand", "p_partkey", text.identifier(F.col("p_name")).alias("name"))
    return grouping.unique_names(named, "p_brand", "name", "p_partkey")


@query("SELECT p_partkey, CAST(least(lcm(CAST(p_size AS BIGINT), CAST(p_partkey % 360 + 1 AS BIGINT)), 10000) AS BIGINT) AS steps FROM part")
def lcm_steps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", numeric.lcm_capped(F.col("p_size"), F.col("p_partkey") % 360 + 1, 10000).alias("steps"))


@query("""WITH c AS (SELECT doc_id, substr(md5(text), 1, CAST([3, 6, 8, 5][doc_id % 4 + 1] AS INT)) AS code FROM documents), f AS (SELECT doc_id, CASE length(code) WHEN 3 THEN code[1] || code[1] || code[2] || code[2] || code[3] || code[3] || 'ff' WHEN 6 THEN code || 'ff' WHEN 8 THEN code END AS x FROM c)
    SELECT doc_id, CAST(CAST('0x' || x[1:2] AS INT) AS BIGINT) AS r, CAST(CAST('0x' || x[3:4] AS INT) AS BIGINT) AS g, CAST(CAST('0x' || x[5:6] AS INT) AS BIGINT) AS b, CAST(CAST('0x' || x[7:8] AS INT) AS BIGINT) AS a FROM f""")
def hex_colours(spark: SparkSession, d: str) -> DataFrame:
    size = F.get(F.array(F.lit(3), F.lit(6), F.lit(8), F.lit(5)), (F.col("doc_id") % 4).cast("int"))
    code = F.concat(F.lit("#"), F.substring(F.upper(F.md5("text")), F.lit(1), size))
    found = table(spark, d, "documents").select("doc_id", text.colour_channels(code).alias("c"))
    return found.select("doc_id", *[F.col(f"c.{x}").cast("long").alias(x) for x in "rgba"])


@query("SELECT event_id, CASE WHEN event_type IN ('view', 'signup') THEN NULL ELSE event_type = 'click' END AS flag FROM events")
def boolean_words(spark: SparkSession, d: str) -> DataFrame:
    word = F.when(F.col("event_type") == "click", " Yes").when(F.col("event_type").isin("error", "purchase"), "OFF").otherwise("maybe")
    return table(spark, d, "events").select("event_id", text.truth(word).alias("flag"))


@query("""SELECT p_partkey, concat_ws('; ', CASE WHEN p_size % 5 > p_size % 3 THEN 'extrude exceeds padding' END, CASE WHEN p_size % 2 = 0 AND p_partkey % 4 = 1 THEN 'the data format can''t say that a sprite is turned' END,
    CASE WHEN p_size > 0 AND bit_count(p_size) <> 1 AND p_partkey % 2 = 0 THEN 'a fixed side is no power of two' END, CASE WHEN p_size % 3 = 0 AND p_size % 5 > 2 THEN 'without padding, scaled sprites bleed into each other' END) AS advice FROM part""")
def config_advice(spark: SparkSession, d: str) -> DataFrame:
    size, key = F.col("p_size").cast("long"), F.col("p_partkey")
    rows = table(spark, d, "part").select(
        "p_partkey", (size % 5).alias("extrude"), (size % 3).alias("padding"), (size % 2 == 0).alias("rotate"), F.when(key % 4 == 1, "css").otherwise("json").alias("data_format"), (key % 2 == 0).alias("power_of_two"),
        size.alias("fixed_width"), F.lit(0).cast("long").alias("fixed_height"), F.lit(0).alias("align"), F.lit(2048).alias("max_width"), F.lit(2048).alias("max_height"), F.when(size % 5 > 2, 2.0).otherwise(1.0).alias("scale"),
    )
    return rows.select("p_partkey", F.array_join(config.advice(["css"]), "; ").alias("advice"))


@query(f"WITH {_GRID} SELECT CAST(page AS BIGINT) AS page, '{{\"frames\":{{' || string_agg('\"' || id || '\":{{\"frame\":' || {_FRAME_JSON} || '}}', ',' ORDER BY id) || '}}}}' AS document FROM placed GROUP BY page")
def metadata_json_hash(spark: SparkSession, d: str) -> DataFrame:
    return render.documents_of(_grid(spark, d), "json-hash", ["page"])


@query(f"WITH {_GRID} SELECT id, '<key>' || id || '</key><dict><key>frame</key><string>{{{{' || x || ',' || y || '}},{{' || frame_w || ',' || frame_h || '}}}}</string></dict>' AS line FROM placed")
def metadata_plist_rows(spark: SparkSession, d: str) -> DataFrame:
    return render.rendered_rows(_grid(spark, d), "plist").select("id", "line")


@query(f"WITH {_GRID} SELECT CAST(page AS BIGINT) AS page, string_agg(id || chr(10) || '  rotate: false' || chr(10) || '  xy: ' || x || ', ' || y || chr(10) || '  size: ' || frame_w || ', ' || frame_h || chr(10) || '  index: -1', chr(10) ORDER BY id) || chr(10) AS document FROM placed GROUP BY page")
def metadata_atlas(spark: SparkSession, d: str) -> DataFrame:
    return render.documents_of(_grid(spark, d), "atlas", ["page"])


@query(f"WITH {_GRID} SELECT id, 'inline constexpr Frame ' || regexp_replace(id, '[^A-Za-z0-9]', '_', 'g') || '{{' || x || ', ' || y || ', ' || frame_w || ', ' || frame_h || '}};' AS line FROM placed")
def metadata_header_rows(spark: SparkSession, d: str) -> DataFrame:
    return render.rendered_rows(_grid(spark, d), "header").select("id", "line")
