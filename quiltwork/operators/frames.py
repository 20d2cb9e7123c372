"""What metadata say of a placed sprite in full: its frame, whether it is turned and trimmed, its raw size and pivot; and the formats that say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiltwork.operators.render import escaped

# Data formats by the family that writes them and their file's extension.
FORMATS = {
    ("json-hash", "json"): """json phaser-json-hash egret spriter melonjs vplay mapbox panda x2d monogame corona-imagesheet easeljs zim spark spritestudio gamemaker-texturegroup amethyst
        2dtoolkit agk batterytech bhive caat cegui gideros kwik libRocket molecule moai orx shiva3d shiva3d-jpsprite slick2d tresensa wave-engine-1""",
    ("json", "json"): "json-array phaser-json-array", ("xml", "xml"): "xml", ("plain", "txt"): "plain", ("sheet-only", ""): "spritesheet-only", ("libgdx", "atlas"): "libgdx", ("spine", "atlas"): "spine",
    ("css", "css"): "css css-simple", ("css", "less"): "less", ("css", "sass"): "sass-mixins", ("phaser", "json"): "phaser", ("pixi", "json"): "pixijs4", ("json-hash", "txt"): "unity",
    ("json-hash", "tpsheet"): "unity-texture2d godot-spritesheet godot3-spritesheet", ("json-hash", "tpset"): "godot-tileset godot3-tileset", ("json-hash", "paper2dsprites"): "unreal-paper2d",
    ("plist", "plist"): "cocos2d cocos2d-v2 cocos2d-x spritekit spritekit-swift", ("starling", "xml"): "sparrow", ("uikit", "plist"): "uikit", ("header", "h"): "cpp-header", ("tsv", "tsv"): "tsv",
}
# Formats that list animations, that say sprites are turned whatever is asked for, and that pack polygons.
ANIMATED, TURNED, POLYGONS = ("libgdx", "cocos2d", "cocos2d-v2", "cocos2d-x", "spritekit", "spritekit-swift"), ("cocos2d-x",), ("unity-texture2d",)


def presets() -> list[tuple[str, str, str, bool | None, bool, bool]]:
    """id, family, extension, turns (null: as asked for), animations and polygons of every data format."""
    return [
        (name, family, extension, False if family == "css" else True if name in TURNED else None, name in ANIMATED, name in POLYGONS)
        for (family, extension), names in FORMATS.items() for name in names.split()
    ]


def described(placed: DataFrame, padding: int = 0) -> DataFrame:
    """placed (id, page, x, y, rotated, w, h: trimmed size, left, top, raw_w, raw_h, pivot_x, pivot_y) with frame, a struct as the JSON formats have it.

    The frame lies within its padding and has the sprite's own width and height, turned or not.
    """
    c = F.col
    frame = F.struct(
        c("id").alias("filename"), F.struct((c("x") + padding).alias("x"), (c("y") + padding).alias("y"), c("w"), c("h")).alias("frame"), c("rotated"), ((c("w") != c("raw_w")) | (c("h") != c("raw_h"))).alias("trimmed"),
        F.struct(c("left").alias("x"), c("top").alias("y"), c("w"), c("h")).alias("spriteSourceSize"), F.struct(c("raw_w").alias("w"), c("raw_h").alias("h")).alias("sourceSize"), F.struct(c("pivot_x").alias("x"), c("pivot_y").alias("y")).alias("pivot"),
    )
    return placed.withColumn("frame", frame)


def part(*path: str) -> Column:
    return F.col(".".join(["frame", *path]))


def numbers(pattern: str, *values: Column) -> Column:
    return F.format_string(pattern, *values)


def box(name: str) -> list[Column]:
    return [part(name, k) for k in "xywh"]


def line(family: str, image: Column) -> Column:
    """A sprite's text in a family's format, from its frame and the page's image file."""
    named, turned, trimmed = part("filename"), part("rotated"), part("trimmed")
    flag = lambda when, text: F.when(when, text).otherwise("")
    raw = [part("sourceSize", k) for k in "wh"]
    below = part("sourceSize", "h") - part("spriteSourceSize", "y") - part("spriteSourceSize", "h")
    if family == "json":
        return F.to_json("frame")
    if family in ("json-hash", "pixi"):
        fields = [part(k).alias(k) for k in ("frame", "rotated", "trimmed", "spriteSourceSize", "sourceSize", "pivot")]
        quoted = F.to_json(F.array(named))
        return F.concat(F.substring(quoted, F.lit(2), F.length(quoted) - 2), F.lit(":"), F.to_json(F.struct(*fields, *[image.alias("image")] * (family == "pixi"))))
    if family == "xml":
        return F.concat(numbers('<sprite n="%s" x="%d" y="%d" w="%d" h="%d" oX="%d" oY="%d" oW="%d" oH="%d"', escaped(named), *box("frame"), *box("spriteSourceSize")[:2], *raw), flag(turned, ' r="y"'), flag(trimmed, ' t="y"'), F.lit("/>"))
    if family == "starling":
        return F.concat(
            numbers('<SubTexture name="%s" x="%d" y="%d" width="%d" height="%d"', escaped(named), *box("frame")), flag(turned, ' rotated="true"'),
            F.when(trimmed, numbers(' frameX="%d" frameY="%d" frameWidth="%d" frameHeight="%d"', -part("spriteSourceSize", "x"), -part("spriteSourceSize", "y"), *raw)).otherwise(""), F.lit("/>"),
        )
    if family == "uikit":
        return numbers("<key>%s</key><dict><key>x</key><integer>%d</integer><key>y</key><integer>%d</integer><key>w</key><integer>%d</integer><key>h</key><integer>%d</integer></dict>", escaped(named), *box("frame"))
    if family in ("libgdx", "spine"):
        return F.concat(numbers("%s\n  rotate: %s\n  xy: %d, %d\n  size: %d, %d\n  orig: %d, %d\n  offset: %d, %d\n  index: -1", named, turned.cast("string"), *box("frame"), *raw, part("spriteSourceSize", "x"), below))
    raise ValueError(f"no family {family}")


#: What stands around a page's lines; {file}, {width} and {height} are the page's.
AROUND = {
    "json": ('{"frames":[', ",", '],"meta":{meta}}'), "json-hash": ('{"frames":{', ",", '},"meta":{meta}}'), "pixi": ('{"frames":{', ",", '},"meta":{meta}}'), "xml": ('<TextureAtlas imagePath="{file}">\n', "\n", "\n</TextureAtlas>\n"),
    "starling": ('<TextureAtlas imagePath="{file}">\n', "\n", "\n</TextureAtlas>\n"), "uikit": ('<plist version="1.0"><dict><key>frames</key><dict>', "", "</dict></dict></plist>\n"),
    "libgdx": ("{file}\nsize: {width},{height}\nformat: RGBA8888\nfilter: Linear, Linear\nrepeat: none\n", "\n", "\n"), "spine": ("\n{file}\nsize: {width},{height}\nformat: RGBA8888\nfilter: Linear, Linear\nrepeat: none\n", "\n", "\n"),
}


def sheets(framed: DataFrame, pages: DataFrame, family: str) -> DataFrame:
    """page and document of each page (page, file, width, height): its sprites' lines in order of id within what the format puts around. A page bounds a document."""
    rows = framed.join(pages, "page")
    size = F.struct(F.col("width").alias("w"), F.col("height").alias("h"))
    if family == "phaser":
        lines = rows.groupBy("page", "file", "width", "height").agg(F.sort_array(F.collect_list(F.struct("id", "frame"))).alias("_l"))
        texture = F.struct(F.col("file").alias("image"), F.lit("RGBA8888").alias("format"), size.alias("size"), F.lit(1).alias("scale"), F.col("_l.frame").alias("frames"))
        return lines.select("page", F.to_json(F.struct(F.array(texture).alias("textures"))).alias("document"))
    before, between, after = AROUND[family]
    meta = F.to_json(F.struct(F.col("file").alias("image"), F.lit("RGBA8888").alias("format"), size.alias("size"), F.lit("1").alias("scale")))

    def filled(text: str) -> Column:
        out = F.lit(text)
        for mark, value in (("{meta}", meta), ("{file}", F.col("file")), ("{width}", F.col("width").cast("string")), ("{height}", F.col("height").cast("string"))):
            out = F.replace(out, F.lit(mark), value) if mark in text else out
        return out

    lines = rows.withColumn("line", line(family, F.col("file"))).groupBy("page", "file", "width", "height").agg(F.sort_array(F.collect_list(F.struct("id", "line"))).alias("_l"))
    return lines.select("page", F.concat(filled(before), F.array_join("_l.line", between), filled(after)).alias("document"))
