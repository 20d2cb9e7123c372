"""Images written as C source, XPM and XBM, as expressions: tokens by pattern, the palette as a map, pixels by exploding rows.

Both end as rows of pixels; what can't be read is said in a column of its own, one row a file.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of colours and their codes.
NAMED = {
    "black": "000000", "white": "FFFFFF", "red": "FF0000", "green": "00FF00", "lime": "00FF00", "blue": "0000FF", "yellow": "FFFF00", "cyan": "00FFFF", "aqua": "00FFFF", "magenta": "FF00FF", "fuchsia": "FF00FF",
    "gray": "BEBEBE", "grey": "BEBEBE", "lightgray": "BEBEBE", "lightgrey": "BEBEBE", "darkgray": "696969", "darkgrey": "696969", "dimgray": "696969", "dimgrey": "696969", "orange": "FFA500", "brown": "A52A2A",
    "pink": "FFC0CB", "purple": "A020F0", "navy": "000080", "teal": "008080", "maroon": "800000", "olive": "808000", "silver": "C0C0C0",
}


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns that are computed once a row: expressions that name them don't take them in, as they would else within each lambda."""
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select("*", made.alias("_once")).select(*df.columns, *[F.col(f"_once.{n}").alias(n) for n in columns])


def xpm_colour(spec: Column) -> Column:
    """A colour's r, g, b, a: none is clear, # stands before 1 to 4 hexadecimal digits a channel, others go by name; null for other texts."""
    code, word = F.substring(spec, F.lit(2), F.char_length(spec) - 1), F.lower(spec)
    size = F.floor(F.char_length(code) / 3).cast("int")
    digits = F.when((size > 0) & (F.char_length(code) % 3 == 0) & (size <= 4) & code.rlike("^[0-9A-Fa-f]+$"), size)
    channel = lambda k: F.floor(F.conv(F.substring(code, digits * k + 1, digits), 16, 10).cast("long") * 255 / (F.pow(F.lit(16), digits) - 1)).cast("int")
    by_name = F.element_at(F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair]), word)
    part = lambda c, k: F.conv(F.substring(c, 2 * k + 1, 2), 16, 10).cast("int")
    told = lambda of: F.struct(*[of(k).alias(c) for k, c in enumerate("rgb")], F.lit(255).alias("a"))
    clear = F.lit(0)
    return (
        F.when(word == "none", F.struct(*[clear.alias(c) for c in "rgba"])).when(spec.startswith("#") & digits.isNotNull(), told(channel)).when(by_name.isNotNull(), told(lambda k: part(by_name, k)))
    )


def xpm(files: DataFrame, content: str = "content") -> DataFrame:
    """files with width, height, rows (of r, g, b, a) and error in place of the content, a text."""
    rest = [c for c in files.columns if c != content]
    words = once(files, _s=F.regexp_extract_all(F.col(content), F.lit('"([^"]*)"'), F.lit(1)), _n=F.octet_length(content))
    head = F.regexp_extract_all(F.get("_s", F.lit(0)), F.lit(r"(\S+)"), F.lit(1))
    sized = once(words, **{c: F.get(head, F.lit(k)).try_cast("int") for k, c in enumerate(("width", "height", "_colours", "_per"))})
    w, h, n, per = (F.col(c) for c in ("width", "height", "_colours", "_per"))
    sound = F.coalesce((w > 0) & (h > 0) & (n >= 0) & per.between(1, 4) & (w.cast("long") * h <= F.col("_n")), F.lit(False))
    whole = F.coalesce(F.size("_s") >= n.cast("long") + h + 1, F.lit(False))
    judged = once(sized, _sound=sound, _whole=sound & whole)
    spec = lambda e: F.regexp_extract(F.substring(e, per + 1, F.lit(1 << 20)), r"(?:^|\s)c\s+(\S+)", 1)
    entries = F.transform(F.slice("_s", 2, n), lambda e: F.struct(F.substring(e, F.lit(1), per).alias("k"), xpm_colour(spec(e)).alias("v"), e.alias("e")))
    listed = once(judged, _p=F.when(F.col("_whole"), entries), _l=F.when(F.col("_whole"), F.slice("_s", n + 2, h)))
    # The first of entries that share their characters counts.
    first = F.filter("_p", lambda e, i: F.array_position("_p.k", e["k"]) == i + 1)
    short = F.exists("_l", lambda line: F.char_length(line) < w * per)
    bad = F.get(F.filter("_p", lambda e: e["v"].isNull())["e"], F.lit(0))
    known = once(listed, _bad=bad, _short=short, _m=F.map_from_entries(F.transform(first, lambda e: F.struct(e["k"], e["v"]))))
    pixels = F.transform("_l", lambda line: F.transform(F.sequence(F.lit(0), w - 1), lambda x: F.try_element_at("_m", F.substring(line, x * per + 1, per))))
    ready = once(known, rows=F.when(F.col("_whole") & F.col("_bad").isNull() & ~F.col("_short"), pixels))
    unknown = F.exists("rows", lambda r: F.exists(r, lambda p: p.isNull()))
    error = (
        F.when(F.coalesce(F.size("_s"), F.lit(0)) == 0, "no header").when(~F.col("_sound"), F.concat(F.lit("no size that the file can hold: "), F.get("_s", F.lit(0)))).when(~F.col("_whole"), "colours or rows are missing")
        .when(F.col("_bad").isNotNull(), F.concat(F.lit("no colour in: "), F.col("_bad"))).when(F.col("_short"), "a row is too short").when(unknown, "a pixel without a colour")
    )
    told = once(ready, error=error)
    return told.select(*rest, *[F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in ("width", "height", "rows")], "error")


def xbm(files: DataFrame, content: str = "content") -> DataFrame:
    """files with width, height, rows (of r, g, b, a) and error in place of the content, a text: set bits are black, others clear, the first of a byte is its lowest."""
    rest, text = [c for c in files.columns if c != content], F.col(content)
    side = lambda name: F.regexp_extract(text, rf"(?m)^\s*#define[ \t]+\S*{name}[ \t]+(\d{{1,6}})\s*$", 1).try_cast("int")
    body = F.regexp_extract(text, r"(?s)\{([^}]*)\}", 1)
    tokens = F.filter(F.split(body, r"[,\s]+"), lambda t: t != "")
    sized = once(files, width=side("width"), height=side("height"), _t=F.when(text.rlike(r"(?s)\{[^}]*\}"), tokens))
    w, h = F.col("width"), F.col("height")
    wide = F.floor((w + 7) / 8).cast("int")
    wrong = F.get(F.filter("_t", lambda t: ~t.rlike("^(0[xX])?[0-9A-Fa-f]{1,2}$")), F.lit(0))
    error = (
        F.when(F.coalesce((w <= 0) | (h <= 0), F.lit(True)), "no width and height").when(F.col("_t").isNull(), "no bits").when(wrong.isNotNull(), F.concat(F.lit("no byte: "), wrong)).when(F.size("_t") < wide.cast("long") * h, "bytes are missing")
    )
    judged = once(sized, error=error, _wide=wide)
    ready = once(judged, _b=F.when(F.col("error").isNull(), F.transform("_t", lambda t: F.conv(F.regexp_replace(t, "^0[xX]", ""), 16, 10).cast("int"))))
    # Eight pixels at a time, by a table of all bytes: a constant, which a lambda would not be.
    pixels = F.from_json(F.lit(json.dumps([[{"r": 0, "g": 0, "b": 0, "a": (b >> k & 1) * 255} for k in range(8)] for b in range(256)])), "array<array<struct<r:int,g:int,b:int,a:int>>>")
    line = lambda y: F.slice(F.flatten(F.transform(F.slice("_b", y * F.col("_wide") + 1, F.col("_wide")), lambda b: F.get(pixels, b))), 1, w)
    rows = F.when(F.col("error").isNull(), F.transform(F.sequence(F.lit(0), h - 1), line))
    return ready.select(*rest, *[F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in ("width", "height")], rows.alias("rows"), "error")


def pixel_rows(images: DataFrame, keys: list[str]) -> DataFrame:
    """keys, x, y, r, g, b, a of images that could be read."""
    lines = images.where("error is null").select(*keys, F.posexplode("rows").alias("y", "_line")).select(*keys, "y", F.posexplode("_line").alias("x", "_p"))
    return lines.select(*keys, "x", "y", "_p.*")
