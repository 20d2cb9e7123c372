"""Image files as rows of pixels and back: PNG, BMP, TGA, PNM and DDS. Files are decoded where Spark reads them, batch by batch; a row is one image."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiltwork.operators import blocks

# What begins a PNG file, channels by colour type, and the passes of interlaced ones (first row and column, steps).
PNG = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = [(0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1)]
DECODED = "width int, height int, rgba binary, error string"
#: Images with more pixels aren't decoded, as their headers may lie.
MOST_PIXELS = 1 << 28


def chunks(content: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Kind and data of a PNG file's chunks."""
    at = len(PNG)
    while at + 12 <= len(content):
        (size,) = struct.unpack_from(">I", content, at)
        yield content[at + 4 : at + 8], content[at + 8 : at + 8 + size]
        at += size + 12


def unfiltered(raw: np.ndarray, rows: int, stride: int, step: int) -> np.ndarray:
    """Rows of bytes without the filters that each names first. A byte's left neighbour is `step` bytes before it."""
    lines, out = raw[: rows * (stride + 1)].reshape(rows, stride + 1), np.zeros((rows + 1, stride + step), np.uint8)
    for y in range(rows):
        kind, line, above, own = lines[y, 0], lines[y, 1:], out[y], out[y + 1]
        if kind == 0:
            own[step:] = line
        elif kind == 1:
            # Sums along each channel, modulo 256.
            padded = np.zeros(-(-stride // step) * step, np.uint8)
            padded[:stride] = line
            own[step:] = np.cumsum(padded.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[:stride]
        elif kind == 2:
            own[step:] = line + above[step:]
        else:
            left, up, value = own.tolist(), above.tolist(), line.tolist()
            for x in range(stride):
                a, b, c = left[x], up[x + step], up[x]
                if kind == 3:
                    near = (a + b) >> 1
                else:
                    p, q, r = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    near = a if p <= q and p <= r else b if q <= r else c
                left[x + step] = (value[x] + near) & 255
            own[:] = left
    return out[1:, step:]


def decode_png(content: bytes) -> np.ndarray:
    parts = dict.fromkeys((b"PLTE", b"tRNS"), b"")
    data = []
    for kind, body in chunks(content):
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind in parts:
            parts[kind] = body
    check(width, height)
    many, raw, at = CHANNELS[colour], np.frombuffer(zlib.decompress(b"".join(data)), np.uint8), 0
    samples = np.zeros((height, width, many), np.int64)
    for y0, x0, dy, dx in PASSES if interlaced else [(0, 0, 1, 1)]:
        rows, columns = len(range(y0, height, dy)), len(range(x0, width, dx))
        if not rows or not columns:
            continue
        stride = (columns * many * depth + 7) // 8
        lines = unfiltered(raw[at:], rows, stride, max(1, many * depth // 8))
        at += rows * (stride + 1)
        if depth == 16:
            part = lines.reshape(rows, -1, 2)[:, :, 0]
        elif depth == 8:
            part = lines
        else:
            part = np.unpackbits(lines, axis=1).reshape(rows, -1, depth) @ (1 << np.arange(depth - 1, -1, -1))
        samples[y0::dy, x0::dx] = part[:, : columns * many].reshape(rows, columns, many)
    out = np.full((height, width, 4), 255, np.uint8)
    clear = parts[b"tRNS"]
    if colour == 3:
        palette = np.zeros((256, 4), np.uint8)
        own = np.frombuffer(parts[b"PLTE"], np.uint8).reshape(-1, 3)
        palette[: len(own), :3], palette[:, 3] = own, 255
        palette[: len(clear), 3] = np.frombuffer(clear, np.uint8)
        return palette[samples[:, :, 0]]
    # Greys of few bits are spread over 0 to 255; a clear colour is compared as it is stored.
    spread = samples * (255 // ((1 << depth) - 1)) if depth < 8 else samples
    if colour in (0, 4):
        out[:, :, :3] = spread[:, :, :1]
    else:
        out[:, :, :3] = spread[:, :, :3]
    if colour in (4, 6):
        out[:, :, 3] = spread[:, :, -1]
    elif clear:
        wanted = np.frombuffer(clear, ">u2").astype(np.int64) >> (8 if depth == 16 else 0)
        out[(samples == wanted).all(axis=2), 3] = 0
    return out


def check(width: int, height: int) -> None:
    if width < 1 or height < 1 or width * height > MOST_PIXELS:
        raise ValueError(f"{width} x {height} pixels")


def decode_bmp(content: bytes) -> np.ndarray:
    """Plain BMP files of 8 (with a palette), 24 or 32 bits, either way up."""
    (start,), (header, width, height, _, bits, packing) = struct.unpack_from("<I", content, 10), struct.unpack_from("<IiiHHI", content, 14)
    check(width, abs(height))
    if packing not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError(f"BMP with {bits} bits, packing {packing}")
    stride, step = (width * bits + 31) // 32 * 4, bits // 8
    lines = np.frombuffer(content, np.uint8, stride * abs(height), start).reshape(-1, stride)[:, : width * step].reshape(abs(height), width, step)
    lines = lines[::-1] if height > 0 else lines
    if bits == 8:
        used = struct.unpack_from("<I", content, 46)[0] or 256
        lines = np.frombuffer(content, np.uint8, 4 * used, 14 + header).reshape(-1, 4)[lines[:, :, 0]][:, :, :3]
    out = np.full((abs(height), width, 4), 255, np.uint8)
    out[:, :, :3] = lines[:, :, 2::-1]
    # Alpha counts if any pixel has some.
    if bits == 32 and lines[:, :, 3].any():
        out[:, :, 3] = lines[:, :, 3]
    return out


def decode_tga(content: bytes) -> np.ndarray:
    """TGA files of grey or true colour, in runs or not."""
    skip, _, kind, *_, width, height, bits, flags = struct.unpack_from("<BBBHHBHHHHBB", content)
    check(width, height)
    if kind & 7 not in (2, 3) or bits not in (8, 24, 32):
        raise ValueError(f"TGA of type {kind} with {bits} bits")
    step, at = bits // 8, 18 + skip
    if kind & 8:
        parts, have = [], 0
        while have < width * height:
            many, repeated = (content[at] & 127) + 1, content[at] >> 7
            size = step if repeated else step * many
            parts.append(content[at + 1 : at + 1 + size] * (many if repeated else 1))
            have, at = have + many, at + 1 + size
        raw = np.frombuffer(b"".join(parts), np.uint8)[: width * height * step]
    else:
        raw = np.frombuffer(content, np.uint8, width * height * step, at)
    lines = raw.reshape(height, width, step)
    lines = lines if flags & 0x20 else lines[::-1]
    lines = lines[:, ::-1] if flags & 0x10 else lines
    out = np.full((height, width, 4), 255, np.uint8)
    out[:, :, :3] = lines if step == 1 else lines[:, :, 2::-1]
    if step == 4:
        out[:, :, 3] = lines[:, :, 3]
    return out


def decode_pnm(content: bytes) -> np.ndarray:
    """Binary PGM and PPM files of one byte a channel."""
    words, at = [], 2
    while len(words) < 3:
        if content[at : at + 1] == b"#":
            at = content.index(b"\n", at)
        elif content[at : at + 1].isspace():
            at += 1
        else:
            end = at
            while not content[end : end + 1].isspace():
                end += 1
            words.append(int(content[at:end]))
            at = end
    width, height, top = words
    check(width, height)
    if top > 255:
        raise ValueError(f"levels up to {top}")
    step = 3 if content[1:2] == b"6" else 1
    lines = np.frombuffer(content, np.uint8, width * height * step, at + 1).reshape(height, width, step)
    out = np.full((height, width, 4), 255, np.uint8)
    out[:, :, :3] = (lines.astype(np.int64) * 255 + top // 2) // top
    return out


def decode(content: bytes) -> np.ndarray:
    """An image's pixels: height, width, and red, green, blue, alpha."""
    start = content[:8]
    if start == PNG:
        return decode_png(content)
    if start[:4] == b"DDS ":
        return blocks.decode_dds(content)
    if start[:2] == b"BM":
        return decode_bmp(content)
    return decode_pnm(content) if start[:2] in (b"P5", b"P6") else decode_tga(content)


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(pixels: np.ndarray, dpi: int = 0) -> bytes:
    """PNG of the pixels, by a palette if they have no more than 256 colours; every line is written as its difference from the one above."""
    height, width = pixels.shape[:2]
    colours, index = np.unique(np.ascontiguousarray(pixels).view(">u4").reshape(-1), return_inverse=True)
    few = len(colours) <= 256
    lines = index.reshape(height, width).astype(np.uint8) if few else pixels.reshape(height, -1)
    body = np.full((height, lines.shape[1] + 1), 2, np.uint8)
    body[0, 1:], body[1:, 1:] = lines[0], lines[1:] - lines[:-1]
    parts = [chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 3 if few else 6, 0, 0, 0))]
    if dpi:
        parts.append(chunk(b"pHYs", struct.pack(">IIB", *[round(dpi / 0.0254)] * 2, 1)))
    if few:
        table = colours.astype(">u4").view(np.uint8).reshape(-1, 4)
        parts += [chunk(b"PLTE", table[:, :3].tobytes()), chunk(b"tRNS", table[:, 3].tobytes())]
    return PNG + b"".join(parts) + chunk(b"IDAT", zlib.compress(body.tobytes(), 6)) + chunk(b"IEND", b"")


def encode_bmp(pixels: np.ndarray) -> bytes:
    height, width = pixels.shape[:2]
    body = pixels[::-1, :, [2, 1, 0, 3]].tobytes()
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 32, 0, len(body), 2835, 2835, 0, 0) + body


def encode_tga(pixels: np.ndarray) -> bytes:
    height, width = pixels.shape[:2]
    return struct.pack("<BBBHHBHHHHBB", 0, 0, 2, 0, 0, 0, 0, 0, width, height, 32, 0x28) + pixels[:, :, [2, 1, 0, 3]].tobytes()


WRITERS: dict[str, Callable[[np.ndarray], bytes]] = {"png": encode_png, "bmp": encode_bmp, "tga": encode_tga}


def decoded(files: DataFrame, content: str = "content") -> DataFrame:
    """files with width, height, rgba (bytes by rows) and error in place of the content; what can't be decoded has an error and no pixels. Null contents are null throughout."""
    rest = [c for c in files.columns if c != content]
    rows = files.select(*rest, content)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for raw in part.column(len(rest)).to_pylist():
                try:
                    pixels = None if raw is None else decode(raw)
                    out.append((None,) * 4 if pixels is None else (pixels.shape[1], pixels.shape[0], pixels.tobytes(), None))
                except (ValueError, KeyError, IndexError, UnboundLocalError, TypeError, struct.error, zlib.error) as error:
                    out.append((None, None, None, str(error) or type(error).__name__))
            made = [pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.string()), strict=True)] if out else [pa.array([], k) for k in (pa.int32(), pa.int32(), pa.binary(), pa.string())]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(rest))), *made], [*rest, "width", "height", "rgba", "error"])

    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {k}" for c, k in rows.dtypes[:-1]), DECODED]))


def encoded(images: DataFrame, kind: str, width: str = "width", height: str = "height", rgba: str = "rgba") -> DataFrame:
    """images with one more column, content: the file's bytes as png, bmp or tga; null where there are no pixels."""
    write = WRITERS[kind]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sizes = zip(*(part.column(c).to_pylist() for c in (width, height, rgba)), strict=True)
            files = [None if p is None else write(np.frombuffer(p, np.uint8).reshape(h, w, 4)) for w, h, p in sizes]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(files, pa.binary())], [*part.schema.names, "content"])

    return images.mapInArrow(run, ", ".join([*(f"`{c}` {k}" for c, k in images.dtypes), "content binary"]))


def pixels_of(images: DataFrame, keys: list[str]) -> DataFrame:
    """keys, x, y, r, g, b, a: a row for each pixel of decoded images."""
    at = images.where(F.col("rgba").isNotNull()).select(*keys, "width", "rgba", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("_k"))
    level = lambda k: F.conv(F.hex(F.substring(F.col("rgba"), F.col("_k") * 4 + k + 1, F.lit(1))), 16, 10).cast("long")
    return at.select(*keys, F.pmod("_k", "width").cast("long").alias("x"), F.floor(F.col("_k") / F.col("width")).cast("long").alias("y"), *[level(k).alias(c) for k, c in enumerate("rgba")])


def images_of(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, width, height, rgba of pixel rows (x, y, r, g, b, a); places without a row are clear. An image bounds a row.

    An image's rows meet in one task, its raster's places among them, and are put in order once.
    """
    code = F.concat(*[F.lpad(F.hex(F.col(c).cast("long")), 2, "0") for c in "rgba"])
    whole = Window.partitionBy(*keys)
    sides = {"width": (F.max("x").over(whole) + 1).cast("int"), "height": (F.max("y").over(whole) + 1).cast("int")}
    own = pixels.withColumns(sides).select(*keys, "width", "height", (F.col("y") * F.col("width") + F.col("x")).cast("long").alias("_k"), code.alias("_c"))
    places = own.groupBy(*keys, "width", "height").agg(F.lit(0)).select(*keys, "width", "height", F.explode(F.sequence(F.lit(0).cast("long"), F.col("width").cast("long") * F.col("height") - 1)).alias("_k"), F.lit("00000000").alias("_c"))
    spots = own.unionByName(places).groupBy(*keys, "width", "height", "_k").agg(F.max("_c").alias("_c"))
    rows = spots.groupBy(*keys, "width", "height").agg(F.sort_array(F.collect_list(F.struct("_k", "_c"))).alias("_p"))
    return rows.select(*keys, "width", "height", F.unhex(F.array_join("_p._c", "")).alias("rgba"))
