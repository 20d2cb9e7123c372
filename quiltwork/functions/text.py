"""Names, patterns and number texts as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and what they fold to.
ACCENTS = ("áàäâéèëêíìïîóòöôúùüûñç", "aaaaeeeeiiiioooouuuunc")


def glob_regex(pattern: str) -> str:
    """A whole-string regular expression: * is any run, / included, ? one character; case counts."""
    parts = [".*" if ch == "*" else "." if ch == "?" else re.escape(ch) for ch in pattern]
    return "^(?s)" + "".join(parts) + "$"


def any_glob(text: Column, patterns: list[str]) -> Column:
    """Whether a text matches one of the patterns; null texts match none."""
    return F.coalesce(reduce(lambda a, b: a | b, (text.rlike(glob_regex(p)) for p in patterns), F.lit(False)), F.lit(False))


def pattern_list(names: str) -> list[str]:
    """Patterns of a comma list, trimmed, without empty ones."""
    return [p.strip() for p in names.split(",") if p.strip()]


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_folder(path: Column) -> Column:
    """What stands before the last separator; empty without one."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def without_extension(path: Column) -> Column:
    """Drops what follows the last dot of the file name, if the dot isn't the name's first character."""
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")


def relative_id(path: Column, roots: list[str], keep_extension: bool = False, prefix: bool = True) -> Column:
    """The path below the first root that holds it, without extension unless kept; the file's own name if none does.

    With prefix off, the folders are left out too.
    """
    below = F.lit(None).cast("string")
    for root in reversed(roots):
        start = root.rstrip("/") + "/"
        below = F.when(path.startswith(start), F.substring(path, len(start) + 1, 1 << 20)).otherwise(below)
    below = F.coalesce(below, file_name(path))
    below = below if prefix else file_name(below)
    return below if keep_extension else without_extension(below)


def rename(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Regular-expression replacements one after the other, each everywhere. Groups are written $1, $2 and so on."""
    return reduce(lambda c, rule: F.regexp_replace(c, rule[0], rule[1]), rules, text)


def identifier(text: Column) -> Column:
    """Letters and digits of ASCII stay, all else becomes _; a leading digit gets one before it; empty becomes _."""
    plain = F.regexp_replace(text, "[^A-Za-z0-9]", "_")
    return F.when(plain == "", "_").when(plain.rlike("^[0-9]"), F.concat(F.lit("_"), plain)).otherwise(plain)


def folded(text: Column) -> Column:
    """Lower case without accents, runs of blanks as one, none at the ends."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), *ACCENTS), "[ \\t\\r\\n]+", " "))


def frame_suffix(id_: Column) -> tuple[Column, Column]:
    """Base (with its separator) and number of an id such as walk_001; null without a separator, or if the number has over 18 digits."""
    shape = r"^(?s)(.*[_\-. ])([0-9]+)$"
    fits = id_.rlike(shape) & (F.length(F.regexp_extract(id_, shape, 2)) <= 18)
    return F.when(fits, F.regexp_extract(id_, shape, 1)), F.when(fits, F.regexp_extract(id_, shape, 2).cast("long"))


def loose_suffix(id_: Column) -> tuple[Column, Column]:
    """Base and number of an id that ends in digits, separator or not; the whole id and null otherwise."""
    shape = "^(?s)(.*?)([0-9]+)$"
    ends = id_.rlike(shape) & (F.length(F.regexp_extract(id_, shape, 2)) <= 18)
    return F.when(ends, F.regexp_extract(id_, shape, 1)).otherwise(id_), F.when(ends, F.regexp_extract(id_, shape, 2).cast("long"))


def variant_suffix(scale: float) -> str:
    """The suffix of a scale's files."""
    named = {2.0: "@2x", 4.0: "@4x", 0.5: "-hd", 0.25: "-lhd", 1.0: ""}
    if abs(scale - 1 / 3) < 1e-3:
        return "-sd"
    return named.get(scale, f"@{scale:g}x")


def expand_name(base: str, index: Column, suffix: Column) -> Column:
    """A page's name: {n} and {n0} count from 0, {n1} from 1, {v} is the variant's suffix.

    Without a counter, pages after the first get _index, before {v} if it is there; without {v} the suffix ends the name.
    """
    if any(p in base for p in ("{n}", "{n0}", "{n1}")):
        name = F.lit(base)
    else:
        later = base.replace("{v}", "\x00{v}", 1) if "{v}" in base else base + "\x00"
        numbered = F.replace(F.lit(later), F.lit("\x00"), F.concat(F.lit("_"), index.cast("string")))
        name = F.when(index > 0, numbered).otherwise(F.lit(base))
    name = F.replace(name, F.lit("{n1}"), (index + 1).cast("string"))
    for mark in ("{n0}", "{n}"):
        name = F.replace(name, F.lit(mark), index.cast("string"))
    return F.replace(name, F.lit("{v}"), suffix) if "{v}" in base else F.concat(name, suffix)


def with_extension(name: Column, extension: str) -> Column:
    """Adds the extension unless the name ends in it, whatever the case."""
    return F.when(F.lower(name).endswith("." + extension.lower()), name).otherwise(F.concat(name, F.lit("." + extension)))


def short_number(x: Column, digits: int = 2) -> Column:
    """A number rounded, without zeros at the end."""
    return F.regexp_replace(F.regexp_replace(F.format_string(f"%.{digits}f", F.round(x.cast("double"), digits)), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def colour_channels(code: Column) -> Column:
    """r, g, b, a of a colour in 3, 6 or 8 hexadecimal digits, with or without #; null for other texts."""
    bare = F.regexp_replace(F.lower(F.trim(code)), "^#", "")
    full = F.when(F.length(bare) == 3, F.regexp_replace(bare, "(.)", "$1$1")).otherwise(bare)
    full = F.when(F.length(full) == 6, F.concat(full, F.lit("ff"))).otherwise(full)
    parts = F.struct(*[F.conv(F.substring(full, 2 * k + 1, 2), 16, 10).cast("int").alias(c) for k, c in enumerate("rgba")])
    return F.when(bare.rlike("^([0-9a-f]{3}|[0-9a-f]{6}|[0-9a-f]{8})$"), parts)


def truth(word: Column) -> Column:
    """Whether a word says yes or no, whatever the case; null for other words."""
    plain = F.lower(F.trim(word))
    return F.when(plain.isin("1", "true", "yes", "on", "y"), True).when(plain.isin("0", "false", "no", "off", "n"), False)
