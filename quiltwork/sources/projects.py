"""Project files as rows and back: one typed row for each file, whichever of two formats it has.

TOML projects hold settings by name; .tps projects are XML of keys and values, some within others. What a file lacks stands
in one column, what isn't known in another, so a folder of projects is audited in one pass. Parsing needs a file's whole
text; a row is one file, and files are shared out over tasks.
"""

from __future__ import annotations

import json
import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quiltwork.sources import store as st

KINDS = {"string": str, "int": int, "double": float, "boolean": bool, "array<double>": list, "array<string>": list}


@dataclass(frozen=True)
class Setting:
    """A setting's name in TOML and in rows, its type, whether TOML has to say it, and its key in .tps (levels by points)."""

    name: str
    kind: str
    needed: bool = False
    key: str = ""


# Settings of projects, those that TOML has to say first, and where .tps says them.
SETTINGS = [
    Setting("input_directory", "string", True), Setting("output_directory", "string", True), Setting("max_texture_size", "int", True, "maxTextureSize.width"), Setting("padding", "int", True, "shapePadding"),
    Setting("extrude", "int", True, "globalSpriteSettings.extrude"), Setting("allow_rotation", "boolean", True, "allowRotation"), Setting("enable_trim", "boolean", True), Setting("trim_threshold", "int", True, "globalSpriteSettings.trimThreshold"),
    Setting("enable_polygon", "boolean", True), Setting("polygon_tolerance", "double", True), Setting("enable_aliasing", "boolean", True, "autoAliasEnabled"), Setting("color_depth", "string", True, "outputFormat"),
    Setting("dithering_algorithm", "string", True, "ditherType"), Setting("gpu_format", "string", True), Setting("template_format", "string", True), Setting("packing_strategy", "string", True), Setting("scale_variants", "array<double>", True),
    Setting("enable_normal_maps", "boolean", True, "packNormalMaps"), Setting("default_pivot_x", "double", True), Setting("default_pivot_y", "double", True), Setting("base_file_name", "string", True), Setting("recursive", "boolean", True),
    Setting("data_format", "string", False, "dataFormat"), Setting("border_padding", "int", False, "borderPadding"), Setting("fixed_width", "int", False, "fixedTextureSize.width"), Setting("fixed_height", "int", False, "fixedTextureSize.height"),
    Setting("multipack", "boolean", False, "multiPack"), Setting("dpi", "int", False, "dpi"), Setting("jpg_quality", "int", False, "jpgQuality"), Setting("png_opt_level", "int", False, "pngOptimizationLevel"), Setting("texture_path", "string", False, "textureSubPath"),
    Setting("alpha_handling", "string", False, "alphaHandling"), Setting("trim_sprite_names", "boolean", False, "trimSpriteNames"), Setting("prepend_folder_name", "boolean", False, "prependSmartFolderName"), Setting("shape_debug", "boolean", False, "shapeDebug"),
    Setting("enable_auto_detect_animations", "boolean", False, "autodetectAnimations"), Setting("common_divisor_x", "int", False, "commonDivisorX"), Setting("common_divisor_y", "int", False, "commonDivisorY"), Setting("normal_map_suffix", "string", False, "normalMapSuffix"),
    Setting("extra_inputs", "array<string>", False, "fileList"), Setting("excluded_inputs", "array<string>"), Setting("ignore_patterns", "array<string>", False, "ignoreFileList"),
]
# Keys of .tps that say nothing of the sheet, and tags of values within values.
SILENT = {"fileFormatVersion", "texturePackerVersion", "individualSpriteSettings", "x", "y", "width", "height"}
ROWS = ", ".join(["path string", "format string", *(f"{s.name} {s.kind}" for s in SETTINGS), "sprites array<struct<file:string,pivot_x:double,pivot_y:double>>", "errors string", "unsupported array<string>"])
COLUMNS = [part.split(" ")[0] for part in ROWS.replace("array<struct<file:string,pivot_x:double,pivot_y:double>>", "a").split(", ")]


def typed(value: object, kind: str) -> object:
    """A value of the type asked for; None if it isn't one. Whole numbers are numbers too."""
    if kind == "double" and isinstance(value, (int, float)) and not isinstance(value, bool):
        return float(value)
    if kind.startswith("array"):
        one = kind[6:-1]
        parts = [typed(v, one) for v in value] if isinstance(value, list) else [None]
        return None if None in parts else parts
    if kind == "int" and (isinstance(value, bool) or not isinstance(value, int) or not -(1 << 31) <= value < 1 << 31):
        return None
    return value if isinstance(value, KINDS[kind]) else None


def from_toml(text: str) -> dict[str, object]:
    """A row's values. All settings that are needed and missing, and all of a wrong type, are said at once."""
    table = tomllib.loads(text)
    row: dict[str, object] = {}
    missing = [s.name for s in SETTINGS if s.needed and s.name not in table]
    wrong = []
    for s in SETTINGS:
        if s.name in table:
            row[s.name] = typed(table[s.name], s.kind)
            if row[s.name] is None:
                wrong.append(s.name)
    said = [f"{what}: {', '.join(names)}" for what, names in (("missing", missing), ("of another type", wrong)) if names]
    sprites = [(k, *(typed(v.get(c), "double") for c in ("pivot_x", "pivot_y"))) for k, v in sorted(table.get("sprites", {}).items()) if isinstance(v, dict)] if isinstance(table.get("sprites", {}), dict) else []
    return row | {"sprites": sprites, "errors": "; ".join(said) or None, "unsupported": sorted(set(table) - {s.name for s in SETTINGS} - {"sprites"})}


def tps_value(node: ET.Element) -> object:
    """A value by its tag: numbers, truth, texts, points and rectangles as lists, arrays as lists, structs as pairs."""
    text = (node.text or "").strip()
    if node.tag in ("true", "false"):
        return node.tag == "true"
    if node.tag in ("int", "uint"):
        return int(text) if text.lstrip("-").isdigit() else 0
    if node.tag == "double":
        return float(text or 0)
    if node.tag in ("point_f", "rect"):
        return [float(p) for p in text.split(",")]
    if node.tag == "array":
        return [tps_value(x) for x in node]
    if node.tag in ("struct", "map", "QSize"):
        return tps_pairs(node)
    return text


def tps_pairs(node: ET.Element) -> list[tuple[str, object]]:
    """Keys and values; keys that follow one another share the next value."""
    out, waiting = [], []
    for child in node:
        if child.tag == "key":
            waiting.append((child.text or "").strip())
        else:
            value = tps_value(child)
            out += [(k, value) for k in waiting]
            waiting = []
    return out


def from_tps(text: str) -> dict[str, object]:
    """A row's values. Settings that it doesn't say are null; keys that mean nothing here, at any level, are listed."""
    if "<!DOCTYPE" in text or "<!ENTITY" in text:
        raise ValueError("projects declare no entities")
    root = ET.fromstring(text)
    settings = root.find("struct")
    if root.tag != "data" or settings is None:
        raise ValueError("no project: data with a struct of settings is expected")
    pairs, known = tps_pairs(settings), {s.key: s for s in SETTINGS if s.key}
    row: dict[str, object] = {}
    unsupported, wrong = set(), []
    sprites: list[tuple] = []

    def walk(inner: list[tuple[str, object]], above: str) -> None:
        for key, value in inner:
            place = above + key
            nested = isinstance(value, list) and value and all(isinstance(p, tuple) for p in value)
            if place in known:
                s = known[place]
                value = [str(x) for x in value] if s.kind == "array<string>" and isinstance(value, list) else value
                row[s.name] = typed(None if s.name.startswith("fixed_") and value == -1 else value, s.kind)
                if row[s.name] is None and value != -1:
                    wrong.append(key)
            elif place == "individualSpriteSettings" and nested:
                for file, own in value:
                    point = dict(own).get("pivotPoint") if isinstance(own, list) else None
                    sprites.append((file, *(point if isinstance(point, list) and len(point) == 2 else (None, None))))
            elif place == "globalSpriteSettings.defaultPivotPoint" and isinstance(value, list) and len(value) == 2:
                row["default_pivot_x"], row["default_pivot_y"] = value
            elif place == "globalSpriteSettings.trimMode":
                row["enable_trim"], row["enable_polygon"] = value != "None", value == "Polygon"
            elif nested:
                walk(value, f"{place}.")
            elif key not in SILENT:
                unsupported.add(key)

    walk(pairs, "")
    return row | {"sprites": sorted(sprites), "errors": f"of another type: {', '.join(wrong)}" if wrong else None, "unsupported": sorted(unsupported)}


def row_of(path: str, content: bytes) -> tuple:
    """A file's row; files that can't be read have what is wrong with them in errors, and nothing else."""
    kind = "tps" if path.lower().endswith(".tps") else "toml"
    try:
        text = content.decode("utf-8-sig")
        found = from_tps(text) if kind == "tps" else from_toml(text)
    except (ValueError, ET.ParseError, RecursionError) as error:
        found = {"errors": f"not read: {str(error).splitlines()[0] if str(error) else type(error).__name__}"}
    found |= {"path": path, "format": kind}
    return tuple(found.get(c) for c in COLUMNS)


def to_toml(row: dict) -> str:
    """The settings that a row says, in the order of SETTINGS, and its sprites. JSON texts and numbers are TOML's too."""
    shown = lambda v: json.dumps(v, ensure_ascii=False).replace("\x7f", "\\u007f")
    lines = [f"{s.name} = {shown(list(v) if s.kind.startswith('array') else v)}" for s in SETTINGS if (v := row.get(s.name)) is not None]
    for file, x, y in row.get("sprites") or ():
        lines.append("\n".join([f"\n[sprites.{shown(file)}]", *(f"{n} = {shown(v)}" for n, v in (("pivot_x", x), ("pivot_y", y)) if v is not None)]))
    return "\n".join(lines) + "\n"


def to_tps(row: dict) -> str:
    """The settings that a row says and .tps has a key for."""
    tree: dict[str, object] = {}
    for s in SETTINGS:
        value = row.get(s.name)
        if s.key and value is not None:
            *above, last = s.key.split(".")
            inner = tree
            for key in above:
                inner = inner.setdefault(key, {})
            inner[last] = value
    # A size has both sides; what a row doesn't say is -1, or for the largest size the other side.
    if "fixedTextureSize" in tree:
        tree["fixedTextureSize"] = {"width": -1, "height": -1} | tree["fixedTextureSize"]
    if "maxTextureSize" in tree:
        tree["maxTextureSize"] |= {"height": tree["maxTextureSize"]["width"]}
    sprite = tree.setdefault("globalSpriteSettings", {})
    if row.get("default_pivot_x") is not None and row.get("default_pivot_y") is not None:
        sprite["defaultPivotPoint"] = (row["default_pivot_x"], row["default_pivot_y"])
    if row.get("enable_trim") is not None:
        sprite["trimMode"] = "Polygon" if row.get("enable_polygon") else "Trim" if row["enable_trim"] else "None"
    if row.get("sprites"):
        tree["individualSpriteSettings"] = {file: {} if x is None or y is None else {"pivotPoint": (x, y)} for file, x, y in row["sprites"]}

    def told(value: object, depth: int, tag: str = "struct") -> str:
        pad = "    " * depth
        if isinstance(value, dict):
            tag = "QSize" if set(value) == {"width", "height"} else tag
            inner = "".join(f"{pad}    <key>{escape(k)}</key>\n{told(v, depth + 1, 'map' if k == 'individualSpriteSettings' else 'struct')}" for k, v in value.items())
            return f"{pad}<{tag}>\n{inner}{pad}</{tag}>\n"
        if isinstance(value, tuple):
            return f"{pad}<point_f>{value[0]!r},{value[1]!r}</point_f>\n"
        if isinstance(value, bool):
            return f"{pad}<{str(value).lower()}/>\n"
        if isinstance(value, (int, float)):
            return f"{pad}<{'int' if isinstance(value, int) else 'double'}>{value}</{'int' if isinstance(value, int) else 'double'}>\n"
        if isinstance(value, str):
            return f"{pad}<string>{escape(value)}</string>\n"
        return f"{pad}<array>\n" + "".join(f"{pad}    <filename>{escape(str(x))}</filename>\n" for x in value) + f"{pad}</array>\n"

    return f'<?xml version="1.0" encoding="UTF-8"?>\n<data version="1.0">\n{told({"fileFormatVersion": 4} | tree, 1).replace("<struct>", chr(60) + "struct type=" + chr(34) + "Settings" + chr(34) + ">", 1)}</data>\n'


def parsed(files: DataFrame) -> DataFrame:
    """A typed row for each file of path and content, as Spark's binaryFile reader gives them from any store. Null contents are empty files."""

    kinds = to_arrow_schema(T._parse_datatype_string(ROWS))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                rows = [row_of(p, c or b"") for p, c in zip(*(part.column(k).to_pylist() for k in (0, 1)), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, ROWS)


def project_files(projects: DataFrame, format_: str = "toml") -> DataFrame:
    """path and content of projects: rows with a path and any of the settings, missing columns and nulls being unsaid."""
    here = [c for c in projects.columns if c in COLUMNS and c not in ("format", "errors", "unsupported")]

    @F.udf("string")
    def text(row):
        return (to_tps if format_ == "tps" else to_toml)(row.asDict())

    # One small text for each file; Rows keep whole numbers whole beside nulls.
    return projects.select("path", text(F.struct(*here)).cast("binary").alias("content"))


@dataclass
class Batch(InputPartition):
    paths: list[str]


class ProjectReader(DataSourceReader):
    def __init__(self, folder: str, most: int):
        self.folder, self.most = folder, most

    def partitions(self) -> list[InputPartition]:
        paths = [p for p, _ in st.listed(self.folder, (".tps", ".tpproj", ".toml"))]
        return [Batch(paths[k : k + self.most]) for k in range(0, len(paths), self.most)] or [Batch([])]

    def read(self, partition: Batch) -> Iterator[tuple]:
        store, _ = st.opened(self.folder)
        for path in partition.paths:
            yield row_of(path, st.read(store, path))


class Projects(DataSource):
    """Format `projects`: spark.read.format("projects").load(folder) has a row for each project file below it.

    files_per_task (16): files are small, so a task takes some.
    """

    @classmethod
    def name(cls) -> str:
        return "projects"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema: T.StructType) -> ProjectReader:
        return ProjectReader(self.options["path"], int(self.options.get("files_per_task", 16)))


def with_resolved_paths(projects: DataFrame) -> DataFrame:
    """Relative inputs and outputs as paths beside the project's file; absolute and empty ones stay, so doing it twice changes nothing."""
    folder = F.regexp_replace("path", "/[^/]*$", "")

    def full(p):
        return F.when((p == "") | p.startswith("/") | p.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), p).otherwise(F.concat(folder, F.lit("/"), p))

    lists = {c: F.transform(c, full) for c in ("extra_inputs", "excluded_inputs")}
    return projects.withColumns({c: full(F.col(c)) for c in ("input_directory", "output_directory")} | lists)


def audit(projects: DataFrame) -> DataFrame:
    """setting and files: how many projects say something that isn't known, most first."""
    keys = projects.select("path", F.explode("unsupported").alias("setting"))
    return keys.groupBy("setting").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "setting")
