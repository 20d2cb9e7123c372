"""Queries of project files: a project for each part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltwork.plans.catalogue import query
from quiltwork.plans.views import table
from quiltwork.sources import projects

_MISSING = ["output_directory", "trim_threshold", "enable_polygon", "enable_aliasing", "dithering_algorithm", "gpu_format", "template_format", "packing_strategy", "scale_variants", "enable_normal_maps", "default_pivot_x", "default_pivot_y", "recursive"]


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query(f"""SELECT 'p/' || p_partkey || '.tpproj' AS path, p_type AS input_directory, CAST(256 + p_size AS INT) AS max_texture_size, CASE WHEN p_size % 4 <> 1 THEN CAST(p_partkey % 5 AS INT) END AS padding, p_size % 2 = 0 AS allow_rotation, CAST(p_size AS DOUBLE) / 2 AS polygon_tolerance, [p_brand, 'b'] AS extra_inputs,
    'missing: {", ".join(_MISSING)}' || CASE WHEN p_size % 4 = 1 THEN '; of another type: padding' ELSE '' END AS errors, CASE WHEN p_size % 3 = 0 THEN ['later'] ELSE [] END AS unsupported FROM part""")
def project_toml_read(spark: SparkSession, d: str) -> DataFrame:
    """Projects with settings missing, of another type and unknown: all of it is said at once."""
    size, key = F.col("p_size"), F.col("p_partkey")
    content = _text(
        "# a project\ninput_directory = '", F.col("p_type"), "'\nmax_texture_size = ", size + 256, "\npadding = ", F.when(size % 4 == 1, F.lit('"wide"')).otherwise((key % 5).cast("string")), "\nextrude = 0x10\nallow_rotation = ", size % 2 == 0, "\nenable_trim = true\npolygon_tolerance = ",
        size.cast("double") / 2, '\ncolor_depth = """RGBA8888"""\nbase_file_name = "a"\nextra_inputs = [\n  "', F.col("p_brand"), '", # one\n  "b",\n]\n', F.when(size % 3 == 0, "[later]\nx = 1\n").otherwise(""),
    )
    rows = table(spark, d, "part").select(_text("p/", key, ".tpproj").alias("path"), content.alias("content"))
    return projects.parsed(rows).select("path", "input_directory", "max_texture_size", "padding", "allow_rotation", "polygon_tolerance", "extra_inputs", "errors", "unsupported")


@query("""SELECT 'p/' || p_partkey || '.tps' AS path, CAST(256 + p_size AS INT) AS max_texture_size, CAST(p_partkey % 5 AS INT) AS padding, p_size % 2 = 0 AS allow_rotation, p_name || ' & <' || p_size || '>' AS texture_path, CAST(p_size % 7 AS INT) AS extrude, CASE p_size % 3 WHEN 0 THEN false ELSE true END AS enable_trim, p_size % 3 = 2 AS enable_polygon,
    CASE WHEN p_size % 4 <> 0 THEN CAST(p_size AS INT) END AS fixed_width, [p_brand || '/a.png', 'b'] AS extra_inputs, ['allowFlip', 'tracer'] AS unsupported, p_brand || '.png 0.25 0.75; other.png 0.25 0.75' AS pivots FROM part""")
def project_tps_read(spark: SparkSession, d: str) -> DataFrame:
    """The other format: nested keys, keys that share a value, arrays, points, and what isn't known at any level."""
    size, key, brand = F.col("p_size"), F.col("p_partkey"), F.col("p_brand")
    name = F.replace(F.replace(F.replace(_text(F.col("p_name"), " & <", size, ">"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    flag = lambda c: F.when(c, F.lit("<true/>")).otherwise("<false/>")
    content = _text(
        '<?xml version="1.0"?><data version="1.0"><struct type="Settings"><key>fileFormatVersion</key><int>4</int><key>maxTextureSize</key><QSize><key>width</key><int>', size + 256, "</int><key>height</key><int>9</int></QSize><key>shapePadding</key><uint>", key % 5, "</uint><key>allowRotation</key>", flag(size % 2 == 0),
        "<key>textureSubPath</key><string>", name, "</string><key>allowFlip</key><true/><key>globalSpriteSettings</key><struct><key>extrude</key><uint>", size % 7, '</uint><key>trimMode</key><enum type="T">', F.when(size % 3 == 0, "None").when(size % 3 == 2, "Polygon").otherwise("Crop"), "</enum><key>tracer</key><int>3</int></struct>",
        "<key>fixedTextureSize</key><QSize><key>width</key><int>", F.when(size % 4 == 0, -1).otherwise(size), "</int></QSize><key>fileList</key><array><filename>", brand, "/a.png</filename><filename>b</filename></array><key>individualSpriteSettings</key><map><key>", brand, ".png</key><key>other.png</key><struct><key>pivotPoint</key><point_f>0.25,0.75</point_f></struct></map></struct></data>",
    )
    rows = table(spark, d, "part").select(_text("p/", key, ".tps").alias("path"), content.alias("content"))
    pivots = F.array_join(F.transform("sprites", lambda s: F.concat_ws(" ", s["file"], s["pivot_x"].cast("string"), s["pivot_y"].cast("string"))), "; ")
    return projects.parsed(rows).select("path", "max_texture_size", "padding", "allow_rotation", "texture_path", "extrude", "enable_trim", "enable_polygon", "fixed_width", "extra_inputs", "unsupported", pivots.alias("pivots"))


def _wanted(spark: SparkSession, d: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    sprite = F.struct(F.col("p_brand").alias("file"), F.lit(0.5).alias("pivot_x"), F.when(size % 2 == 0, 0.25).alias("pivot_y"))
    return table(spark, d, "part").select(_text("p/", key).alias("path"), F.concat(F.col("p_type"), F.lit('"')).alias("input_directory"), (size + 256).cast("int").alias("max_texture_size"), (size % 2 == 0).alias("allow_rotation"), (size.cast("double") / 2).alias("polygon_tolerance"), F.array(F.col("p_brand"), F.lit("b")).alias("extra_inputs"), F.when(size % 3 == 0, key.cast("int")).alias("dpi"), F.array(sprite).alias("sprites"))


@query("""SELECT 'p/' || p_partkey AS path, 'input_directory = "' || p_type || '\\""' || chr(10) || 'max_texture_size = ' || (p_size + 256) || chr(10) || 'allow_rotation = ' || CAST(p_size % 2 = 0 AS VARCHAR) || chr(10) || 'polygon_tolerance = ' || CAST(CAST(p_size AS DOUBLE) / 2 AS VARCHAR) || chr(10) ||
    CASE WHEN p_size % 3 = 0 THEN 'dpi = ' || p_partkey || chr(10) ELSE '' END || 'extra_inputs = ["' || p_brand || '", "b"]' || chr(10) || chr(10) || '[sprites."' || p_brand || '"]' || chr(10) || 'pivot_x = 0.5' || CASE WHEN p_size % 2 = 0 THEN chr(10) || 'pivot_y = 0.25' ELSE '' END || chr(10) AS document FROM part""")
def project_toml_text(spark: SparkSession, d: str) -> DataFrame:
    return projects.project_files(_wanted(spark, d)).select("path", F.col("content").cast("string").alias("document"))


@query("""SELECT 'p/' || p_partkey AS path, '<?xml version="1.0" encoding="UTF-8"?>\n<data version="1.0">\n    <struct type="Settings">\n        <key>fileFormatVersion</key>\n        <int>4</int>\n        <key>maxTextureSize</key>\n        <QSize>\n            <key>width</key>\n            <int>' || (p_size + 256) || '</int>\n            <key>height</key>\n            <int>' || (p_size + 256) || '</int>\n        </QSize>\n        <key>allowRotation</key>\n        <' || CAST(p_size % 2 = 0 AS VARCHAR) || '/>\n'
    || CASE WHEN p_size % 3 = 0 THEN '        <key>dpi</key>\n        <int>' || p_partkey || '</int>\n' ELSE '' END || '        <key>fileList</key>\n        <array>\n            <filename>' || p_brand || '</filename>\n            <filename>b</filename>\n        </array>\n        <key>globalSpriteSettings</key>\n        <struct>\n        </struct>\n        <key>individualSpriteSettings</key>\n        <map>\n            <key>' || p_brand || '</key>\n            <struct>\n'
    || CASE WHEN p_size % 2 = 0 THEN '                <key>pivotPoint</key>\n                <point_f>0.5,0.25</point_f>\n' ELSE '' END || '            </struct>\n        </map>\n    </struct>\n</data>\n' AS document FROM part""")
def project_tps_text(spark: SparkSession, d: str) -> DataFrame:
    return projects.project_files(_wanted(spark, d), "tps").select("path", F.col("content").cast("string").alias("document"))


@query("SELECT event_type AS setting, count(*) AS files FROM events GROUP BY event_type")
def unsupported_settings(spark: SparkSession, d: str) -> DataFrame:
    """Projects with one unknown setting each, named after an event's type."""
    rows = table(spark, d, "events").select(_text("p/", F.col("event_id"), ".toml").alias("path"), F.concat("event_type", F.lit(" = 1")).alias("content"))
    return projects.audit(projects.parsed(rows))


@query("SELECT 'w/' || p_partkey || '/a.toml' AS path, CASE WHEN p_size % 2 = 0 THEN '/abs' ELSE 'w/' || p_partkey || '/' || p_type END AS input_directory, ['w/' || p_partkey || '/' || p_brand, 's3://b/c', ''] AS extra_inputs FROM part")
def project_paths(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(_text("w/", F.col("p_partkey"), "/a.toml").alias("path"), F.when(F.col("p_size") % 2 == 0, "/abs").otherwise(F.col("p_type")).alias("input_directory"), F.lit("").alias("output_directory"), F.array(F.col("p_brand"), F.lit("s3://b/c"), F.lit("")).alias("extra_inputs"), F.lit(None).cast("array<string>").alias("excluded_inputs"))
    return projects.with_resolved_paths(rows).select("path", "input_directory", "extra_inputs")
