"""Packing configurations as rows, and advice on them as expressions."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PackConfig:
    """What a packing run is asked for. Sides of 0 are automatic."""

    name: str = "sheet"
    max_width: int = 2048
    max_height: int = 2048
    fixed_width: int = 0
    fixed_height: int = 0
    padding: int = 1
    border: int = 0
    extrude: int = 0
    align: int = 0
    scale: float = 1.0
    rotate: bool = True
    power_of_two: bool = False
    trim_threshold: int = 1
    data_format: str = "json"

    def problems(self) -> list[str]:
        """What makes a run impossible."""
        found = []
        for side in ("width", "height"):
            most, fixed = getattr(self, f"max_{side}"), getattr(self, f"fixed_{side}")
            if most < 1 or fixed < 0:
                found.append(f"the {side} has to be positive")
            if fixed > most:
                found.append(f"the fixed {side} exceeds the largest")
            if 2 * self.border >= (fixed or most):
                found.append(f"the border leaves no {side}")
        if min(self.padding, self.border, self.extrude, self.align) < 0:
            found.append("distances can't be negative")
        if not 0 < self.scale <= 16:
            found.append("the scale has to be above 0 and at most 16")
        if not 1 <= self.trim_threshold <= 255:
            found.append("the trim threshold has to be from 1 to 255")
        return found


def configurations(spark: SparkSession, configs: list[PackConfig]) -> DataFrame:
    kinds = {"str": "string", "int": "bigint", "float": "double", "bool": "boolean"}
    return spark.createDataFrame([tuple(asdict(c).values()) for c in configs], ", ".join(f"{f.name} {kinds[f.type]}" for f in fields(PackConfig)))


def advice(families_without_turns: list[str]) -> Column:
    """An array of what may be unwanted in a configuration row, in this order. Rules whose columns the row lacks are left to full_advice()."""
    c = F.col
    rules = [
        (c("extrude") > c("padding"), "extrude exceeds padding"),
        (c("rotate") & c("data_format").isin(families_without_turns), "the data format can't say that a sprite is turned"),
        (c("power_of_two") & ((c("fixed_width") > 0) & (F.bit_count("fixed_width") != 1) | (c("fixed_height") > 0) & (F.bit_count("fixed_height") != 1)), "a fixed side is no power of two"),
        ((c("align") > 1) & (c("max_width") % F.greatest(c("align"), F.lit(1)) != 0), "the largest width is no multiple of the alignment"),
        (c("scale") != F.round("scale"), "a scale that isn't whole blurs pixels"),
        (F.greatest("max_width", "max_height") > 4096, "many devices load no page above 4096"),
        ((c("padding") == 0) & (c("scale") != 1), "without padding, scaled sprites bleed into each other"),
    ]
    return F.filter(F.array(*[F.when(when, F.lit(said)) for when, said in rules]), lambda x: x.isNotNull())


def full_advice(families_without_turns: list[str]) -> Column:
    """advice() and what rows with all columns can say: dither, colours, template_found, exporters, css_prefix, texture, flip, pixels_fit, scales, art_factor, divisor_x and divisor_y beside advice()'s."""
    c = F.col
    least = F.least(F.when(c("fixed_width") > 0, c("fixed_width")), F.when(c("fixed_height") > 0, c("fixed_height")))
    others = F.filter("scales", lambda s: (F.abs(s - 1) > 1e-6) & (F.abs(s - c("art_factor")) > 1e-6))
    align = F.greatest(c("align"), F.lit(1))
    rules = [
        ((c("dither") != "none") & (c("colours") == "rgba8888"), "nothing is dithered at eight bits a channel"),
        (~c("template_found"), "the template isn't there"),
        (c("exporters") == 0, "the folder holds no exporters"),
        ((c("data_format") != "css") & c("css_prefix"), "a class prefix counts for css alone"),
        (c("flip") & ~c("texture").isin("astc", "etc1", "etc2", "pvrtc"), "only textures of hardware formats are turned upside down"),
        (~c("pixels_fit"), "the texture can't hold the pixel format; it gets eight bits a channel"),
        (F.exists("scales", lambda s: s != F.floor(s)), "coordinates of fractional scales are rounded"),
        ((c("art_factor") > 0) & (F.size(others) > 0), "pixel art is enlarged at its own factor alone; other scales are smooth"),
        ((c("align") > 1) & ((c("padding") % align != 0) | (c("border") % align != 0)), "distances are rounded up to the alignment"),
        (2 * c("border") >= F.greatest("max_width", "max_height"), "the border leaves no room"),
        ((c("texture") == "pvrtc") & ~c("power_of_two"), "the texture's sides have to be powers of two"),
        (least <= 2 * c("border"), "a fixed side leaves no room within the border"),
        ((c("divisor_x") > 1) | (c("divisor_y") > 1), "sprites get clear pixels until their sides can be divided"),
    ]
    return F.concat(advice(families_without_turns), F.filter(F.array(*[F.when(when, F.lit(said)) for when, said in rules]), lambda x: x.isNotNull()))
