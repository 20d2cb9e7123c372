"""Documents by template: what a template can name of a sheet, templates of the text families in full, folders of a user's own, and plain JSON."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiltwork.functions.templates import rendered
from quiltwork.functions.text import identifier, short_number

#: Bounds on a folder of templates, which the driver reads whole.
MOST_TEMPLATES, MOST_BYTES = 1000, 1 << 20
#: What templates can name of a frame beyond the JSON array format, which leaves these out.
INNER = ("frameX", "frameY", "frameWidth", "frameHeight", "offset", "offsetBottomLeft", "cssClass")


def in_full(framed: DataFrame, alias_of: Column | None = None, border: Column | None = None, normal: Column | None = None) -> DataFrame:
    """framed (as frames.described gives it) with all that templates can name in frame.

    Beside the JSON fields: the page, whether and of what the sprite is an alias, its border and whether it has a normal map; the
    raw size and the trimmed part's place as frameX to frameHeight (negative from the top left), offset (from the middle, as
    "x,y") and offsetBottomLeft; and the id as a CSS class.
    """
    part = lambda *path: F.col(".".join(["frame", *path]))
    own, raw = "spriteSourceSize", "sourceSize"
    middle = [short_number(part(own, a) + part(own, b) / 2 - part(raw, b) / 2, 1) for a, b in ("xw", "yh")]
    target = F.lit(None).cast("string") if alias_of is None else alias_of.cast("string")
    fields = {
        "page": F.col("page").cast("long"), "aliased": target.isNotNull(), "aliasTarget": target, "border": F.lit(None).cast("struct<left:int,top:int,right:int,bottom:int>") if border is None else border,
        "hasNormalMap": F.lit(False) if normal is None else normal.isNotNull(), "frameX": -part(own, "x"), "frameY": -part(own, "y"), "frameWidth": part(raw, "w"), "frameHeight": part(raw, "h"), "offset": F.concat_ws(",", *middle),
        "offsetBottomLeft": F.struct(part(own, "x").alias("x"), (part(raw, "h") - part(own, "y") - part(own, "h")).alias("y")), "cssClass": identifier(part("filename")),
    }
    frame = F.col("frame")
    for name, value in fields.items():
        frame = frame.withField(name, value)
    return framed.withColumn("frame", frame)


def contexts(framed: DataFrame, pages: DataFrame, keys: list[str], animations: DataFrame | None = None, pixel_format: str = "RGBA8888", scale: str = "1", nearest: bool = False, app: str = "quiltwork") -> DataFrame:
    """keys and context, a struct that templates are given: animations, filter, meta, frames and sheets.

    framed: page, id and frame in full, and the keys of its document; pages: page, file, width, height. Frames stand by page and
    id. animations: the keys, name and frames (ids in order). A document is one row, so its frames have to fit one; keys that
    hold the page give a document for each.
    """
    sheet = framed.groupBy(*dict.fromkeys([*keys, "page"])).agg(F.sort_array(F.collect_list(F.struct("id", "frame"))).alias("_f")).join(pages.select("page", "file", "width", "height"), "page")
    sheet = sheet.withColumn("_sheet", F.struct(F.col("page").cast("long").alias("index"), "file", "width", "height", F.col("_f.frame").alias("frames")))
    one = sheet.groupBy(*keys).agg(F.array_sort(F.collect_list("_sheet"), lambda a, b: (a["index"] > b["index"]).cast("int") - (a["index"] < b["index"]).cast("int")).alias("_sheets"))
    empty = F.expr("cast(array() as array<struct<name:string,frames:array<string>>>)")
    if animations is None:
        one = one.withColumn("_animations", empty)
    else:
        found = animations.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("name", "frames"))).alias("_animations"))
        one = (one.join(found, keys, "left") if keys else one.crossJoin(found)).withColumn("_animations", F.coalesce("_animations", empty))
    first, sheets = F.get("_sheets", F.lit(0)), F.col("_sheets")
    meta = F.struct(
        F.lit(app).alias("app"), F.lit("1").alias("version"), first["file"].alias("image"), F.lit(pixel_format).alias("format"), F.struct(first["width"].alias("w"), first["height"].alias("h")).alias("size"), F.lit(scale).alias("scale"),
        F.transform(sheets, lambda s: s.dropFields("frames")).alias("pages"),
    )
    context = F.struct(F.col("_animations").alias("animations"), F.lit("Nearest, Nearest" if nearest else "Linear, Linear").alias("filter"), meta.alias("meta"), F.flatten(F.transform(sheets, lambda s: s["frames"])).alias("frames"), sheets.alias("sheets"))
    return one.select(*keys, context.alias("context"))


def with_properties(context: Column, text: str | None = None, flag: bool | None = None) -> Column:
    """The context with an exporter's properties, and marks of which there are."""
    found = {"string_property": text, "bool_property": flag}
    given = [x for name, value in found.items() if value is not None for x in (F.lit(value).alias(name), F.lit(True).alias("has_" + name.split("_")[0]))]
    return context.withField("exporterProperties", F.struct(*given)) if given else context


def with_class_prefix(context: Column, prefix: str) -> Column:
    """The context with a prefix before each CSS class."""
    named = lambda frames: F.transform(frames, lambda f: f.withField("cssClass", F.concat(F.lit(prefix), f["cssClass"])))
    return context.withField("frames", named(context["frames"])).withField("sheets", F.transform(context["sheets"], lambda s: s.withField("frames", named(s["frames"]))))


def in_media_query(document: Column, query: str | None, scale: float) -> Column:
    """A style sheet of a scale above 1 within a media query, if there is one."""
    return F.concat(F.lit(f"@media {query.strip()} {{\n"), document, F.lit("}\n")) if query and query.strip() and scale > 1 else document


def exported(context: DataFrame, template: str, column: str = "context", to: str = "document", change=lambda c: c) -> DataFrame:
    """The rows with one more column: what the template makes of each context. change: a function on the context, as with_properties."""
    ready = context.withColumn("_context", change(F.col(column)))
    kind = ready.schema["_context"].dataType
    return ready.withColumn(to, rendered(template, F.col("_context"), kind)).drop("_context")


def custom_exporters(spark: SparkSession, folder: str) -> dict[str, str]:
    """Templates by id of the files id.hbs of a folder, in order of id, without empty files; none if the folder isn't there. Spark reads them, so any store will do."""
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.hbs").load(folder).select("path", "length", "content")
        rows = files.limit(MOST_TEMPLATES + 1).collect()
    except AnalysisException:
        return {}
    if len(rows) > MOST_TEMPLATES or any(r["length"] > MOST_BYTES for r in rows):
        raise ValueError(f"more than {MOST_TEMPLATES} templates in {folder}, or one of more than {MOST_BYTES} bytes")
    found = {r["path"].rsplit("/", 1)[-1].removesuffix(".hbs"): bytes(r["content"]).decode() for r in rows}
    return dict(sorted((k, v) for k, v in found.items() if k))


# The columns of the table of sprites and what they hold.
COLUMNS = [
    ("name", "filename"), ("x", "frame.x"), ("y", "frame.y"), ("w", "frame.w"), ("h", "frame.h"), ("offsetX", "spriteSourceSize.x"), ("offsetY", "spriteSourceSize.y"), ("originalWidth", "sourceSize.w"),
    ("originalHeight", "sourceSize.h"), ("rotated", ""), ("page", "page"), ("pivotX", "pivot.x"), ("pivotY", "pivot.y"),
]


def _flag(name: str, yes: str, no: str) -> str:
    return f"{{{{#if {name}}}}}{yes}{{{{else}}}}{no}{{{{/if}}}}"


def _value(name: str) -> str:
    return f"{{{{{name}}}}}"


def _each(name: str, body: str) -> str:
    return f"{{{{#each {name}}}}}{body}{{{{/each}}}}"


def _tsv() -> str:
    cells = [_value(path) if path else _flag("rotated", "1", "0") for _, path in COLUMNS]
    return "\t".join(name for name, _ in COLUMNS) + "\n" + _each("frames", "\t".join(cells) + "\n")


def _plain() -> str:
    group = lambda of, keys: "(" + ",".join(_value(f"{of}.{k}") for k in keys) + ")"
    told = {"frame": group("frame", "xywh"), "rotated": _flag("rotated", "true", "false"), "page": _value("page"), "pivot": group("pivot", "xy"), "offset": group("spriteSourceSize", "xy"), "size": group("sourceSize", "wh")}
    properties = "".join(f"{{{{#if exporterProperties.has_{k}}}}}{k}_property: {_value(f'exporterProperties.{k}_property')}\n{{{{/if}}}}" for k in ("string", "bool"))
    return _each("frames", "{{filename}}: " + " ".join(f"{k}={v}" for k, v in told.items()) + "{{#if aliased}} alias-of={{aliasTarget}}{{/if}}\n") + properties


def _plist() -> str:
    text = lambda *names: f"<string>{','.join(map(_value, names))}</string>"
    entry = lambda key, value, depth: "\t" * depth + f"<key>{key}</key>\n" + "\t" * depth + value + "\n"
    box = lambda of, keys: [f"{of}.{k}" for k in keys]
    frame = "".join(
        entry(key, value, 3)
        for key, value in (
            ("frame", text(*box("frame", "xywh"))), ("offset", text("offset")), ("rotated", _flag("rotated", "<true/>", "<false/>")), ("sourceSize", text(*box("sourceSize", "wh"))),
            ("trimmed", _flag("trimmed", "<true/>", "<false/>")), ("pivot", text(*box("pivot", "xy"))), ("page", f"<integer>{_value('page')}</integer>"),
        )
    )
    alias = "{{#if aliased}}" + entry("alias", text("aliasTarget"), 3) + "{{/if}}"
    frames = _each("frames", "\t\t<key>{{filename}}</key>\n\t\t<dict>\n" + frame + alias + "\t\t</dict>\n")
    animation = "\t\t\t<key>{{name}}</key>\n\t\t\t<array>\n" + _each("frames", "\t\t\t\t<string>{{this}}</string>\n") + "\t\t\t</array>\n"
    animations = "{{#if animations}}\t\t<key>animations</key>\n\t\t<dict>\n" + _each("animations", animation) + "\t\t</dict>\n{{/if}}"
    meta = entry("format", "<integer>3</integer>", 2) + animations + entry("realTextureFileName", text("meta.image"), 2) + entry("size", text("meta.size.w", "meta.size.h"), 2) + entry("textureFileName", text("meta.image"), 2)
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE plist PUBLIC "-//Apple//DTD PLIST 1.0//EN" "http://www.apple.com/DTDs/PropertyList-1.0.dtd">\n<plist version="1.0">\n<dict>\n'
    return head + f"\t<key>frames</key>\n\t<dict>\n{frames}\t</dict>\n\t<key>metadata</key>\n\t<dict>\n{meta}\t</dict>\n</dict>\n</plist>\n"


def _css() -> str:
    size = _flag("rotated", "  width: {{frame.h}}px;\n  height: {{frame.w}}px;\n", "  width: {{frame.w}}px;\n  height: {{frame.h}}px;\n")
    rule = ".{{cssClass}} {\n" + size + "  background-image: url({{../file}});\n  background-position: -{{frame.x}}px -{{frame.y}}px;\n}\n"
    return _each("sheets", "/* {{index}}: {{file}} */\n" + _each("frames", rule))


def _header() -> str:
    kinds = {"rotated": "bool"} | {name: "float" for name, _ in COLUMNS if name.startswith(("offset", "original", "pivot"))}
    members = "".join(f"    {kinds.get(name, 'int')} {name};\n" for name, _ in COLUMNS[1:])
    cells = [f'"{_value(COLUMNS[0][1])}"', *[_flag("rotated", "true", "false") if not path else _value(path) + ("f" if kinds.get(name) == "float" else "") for name, path in COLUMNS[1:]]]
    rows = _each("frames", "    { " + ", ".join(cells) + " },\n")
    return f"#pragma once\n\nnamespace atlas {{\nstruct Sprite {{\n    const char* {COLUMNS[0][0]};\n{members}}};\n\nstatic constexpr Sprite kSprites[] = {{\n{rows}}};\n\nstatic constexpr int kSpriteCount = {_value('frames.length')};\n}} // namespace atlas\n"


#: Families of plain text in full: turn, trim, pivot and page of each sprite.
FAMILIES = {"tsv": _tsv(), "plain": _plain(), "plist": _plist(), "css": _css(), "header": _header()}


def pretty(value: Column, kind: T.DataType, depth: int = 0) -> Column:
    """A value as JSON over several lines, two blanks a level, by its type. Nulls are said; empty arrays and structs stay on their line."""
    outer, inner = "  " * depth, "  " * (depth + 1)
    around = lambda a, middle, b: F.concat(F.lit(f"{a}\n"), middle, F.lit(f"\n{outer}{b}"))
    if isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(("" if k == 0 else ",\n") + f"{inner}{_quoted_name(f.name)}: "), pretty(value.getField(f.name), f.dataType, depth + 1)) for k, f in enumerate(kind.fields)]
        text = F.when(value.isNotNull(), around("{", F.concat(*parts), "}") if parts else F.lit("{}"))
    elif isinstance(kind, T.ArrayType):
        rows = F.transform(value, lambda x: F.concat(F.lit(inner), pretty(x, kind.elementType, depth + 1)))
        text = F.when(F.size(value) == 0, "[]").otherwise(around("[", F.array_join(rows, ",\n"), "]"))
    elif isinstance(kind, T.MapType):
        rows = F.transform(F.map_entries(value), lambda e: F.concat(F.lit(inner), _quoted(e["key"].cast("string")), F.lit(": "), pretty(e["value"], kind.valueType, depth + 1)))
        text = F.when(F.size(value) == 0, "{}").otherwise(around("{", F.array_join(rows, ",\n"), "}"))
    elif isinstance(kind, (T.NumericType, T.BooleanType)):
        text = value.cast("string")
    elif isinstance(kind, T.NullType):
        return F.lit("null")
    else:
        text = _quoted(value.cast("string"))
    return F.coalesce(text, F.lit("null"))


def _quoted(text: Column) -> Column:
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.char_length(listed) - 2)


def _quoted_name(name: str) -> str:
    return '"' + name.replace("\\", "\\\\").replace('"', '\\"') + '"'


def json_documents(context: DataFrame, column: str = "context", to: str = "document") -> DataFrame:
    """The rows with the JSON array format of each context: without sheets, and without what only templates name of a frame."""
    c = F.col(column)
    lean = F.transform(c["frames"], lambda f: f.dropFields(*INNER))
    ready = context.withColumn("_context", F.struct(c["animations"].alias("animations"), c["filter"].alias("filter"), c["meta"].alias("meta"), lean.alias("frames")))
    return ready.withColumn(to, pretty(F.col("_context"), ready.schema["_context"].dataType)).drop("_context")
