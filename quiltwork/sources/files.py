"""Files as tables: discovery, what their headers say, sidecar files, and writers that touch only what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltwork.functions.text import any_glob, file_name

# File name extensions of images.
IMAGES = ["png", "jpg", "jpeg", "bmp", "tga", "gif", "webp", "tif", "tiff", "ico", "pnm", "pbm", "pgm", "ppm", "pam", "qoi", "dds", "ktx", "ktx2", "zktx", "pkm", "pvr", "astc", "basis", "psd", "svg", "svgz", "xbm", "xpm"]


def scan(spark: SparkSession, roots: list[str], recursive: bool = True, ignore: list[str] | None = None, content: bool = True) -> DataFrame:
    """path, modificationTime, length and, if asked for, content of files below the roots, each once, without ignored and empty ones (Spark reads no empty files)."""
    found = None
    for root in roots:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
        part = reader.load(root).select("path", "modificationTime", "length", *["content"] * content)
        found = part if found is None else found.union(part)
    found = found.dropDuplicates(["path"])
    return found.where(~any_glob(F.col("path"), ignore) & ~any_glob(file_name(F.col("path")), ignore)) if ignore else found


def is_image(path: Column) -> Column:
    """Whether the extension is an image's; .gz and .ccz count after .pvr."""
    name = F.lower(path)
    return F.regexp_extract(name, r"\.([^./]+)$", 1).isin(*IMAGES) | name.rlike(r"\.pvr\.(gz|ccz)$")


def number(content: Column, at: int, size: int, big: bool) -> Column:
    """The whole number of `size` bytes that begins at a byte (from 0); null if the content is shorter."""
    part = F.substring(content, at + 1, size)
    code = F.hex(part)
    if not big:
        code = F.array_join(F.reverse(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.substring(code, i * 2 + 1, F.lit(2)))), "")
    return F.when(F.octet_length(part) == size, F.conv(code, 16, 10).cast("long"))


def image_size(content: Column) -> Column:
    """kind, width and height of an image by its first bytes; null for other contents."""
    start = lambda code: F.hex(F.substring(content, 1, len(code) // 2)) == code
    said = lambda kind, w, h: F.struct(F.lit(kind).alias("kind"), w.alias("width"), h.alias("height"))
    n = lambda at, size, big=False: number(content, at, size, big)
    return (
        F.when(start("89504E470D0A1A0A"), said("png", n(16, 4, True), n(20, 4, True))).when(start("474946"), said("gif", n(6, 2), n(8, 2))).when(start("424D"), said("bmp", n(18, 4), n(22, 4)))
        .when(start("44445320"), said("dds", n(16, 4), n(12, 4))).when(start("716F6966"), said("qoi", n(4, 4, True), n(8, 4, True))).when(start("504B4D20"), said("pkm", n(12, 2, True), n(14, 2, True)))
        .when(start("AB4B5458203230BB"), said("ktx2", n(20, 4), n(24, 4))).when(start("AB4B5458203131BB"), said("ktx", n(36, 4), n(40, 4))).when(start("50565203"), said("pvr", n(28, 4), n(24, 4))).when(start("13ABA15C"), said("astc", n(7, 3), n(10, 3)))
    )


def pivots(content: Column) -> Column:
    """An array of (id, x, y) from a sidecar's JSON: an object of ids with x and y."""
    parsed = F.map_entries(F.from_json(content, "map<string,struct<x:double,y:double>>"))
    return F.transform(parsed, lambda e: F.struct(e["key"].alias("id"), e["value"]["x"].alias("x"), e["value"]["y"].alias("y")))


def borders(content: Column) -> Column:
    """An array of (id, left, top, right, bottom) from a sidecar's JSON: an object of ids with four numbers."""
    parsed = F.map_entries(F.from_json(content, "map<string,array<int>>"))
    return F.transform(parsed, lambda e: F.struct(e["key"].alias("id"), *[F.get(e["value"], F.lit(k)).alias(c) for k, c in enumerate(("left", "top", "right", "bottom"))]))


def sidecar(rows: DataFrame, id_: str, values: list[str]) -> DataFrame:
    """One row, document: the JSON object of ids with their values, in order of id. A sidecar is one document by nature."""
    entry = F.struct(F.col(id_).alias("key"), F.struct(*values).alias("value"))
    return rows.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(entry)))).alias("document"))


def changed(new: DataFrame, old: DataFrame, key: str, content: str) -> DataFrame:
    """Rows of new whose content isn't what old has for their key: what a writer has to touch. Contents meet by digest."""
    digest = lambda df: df.select(key, F.sha2(F.col(content).cast("binary"), 256).alias("_d"))
    same = digest(new).join(digest(old), [key, "_d"], "left_semi").select(key)
    return new.join(same, key, "left_anti")


def sealed(content: Column, key: Column, mark: str = "QWSEAL1") -> Column:
    """Content encrypted with AES-256 in GCM under a 32-byte key, behind a mark."""
    return F.concat(F.lit(mark).cast("binary"), F.aes_encrypt(content.cast("binary"), key, F.lit("GCM")))


def opened(content: Column, key: Column, mark: str = "QWSEAL1") -> Column:
    """The content behind the mark; null for other contents and wrong keys."""
    body = F.substring(content, len(mark) + 1, 1 << 30)
    return F.when(F.substring(content, 1, len(mark)) == F.lit(mark).cast("binary"), F.try_aes_decrypt(body, key, F.lit("GCM")))
