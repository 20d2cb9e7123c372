"""Textures in blocks of 4 by 4 pixels (DXT1, DXT3, DXT5), many blocks at once, and the DDS files that hold them."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Bytes of a block by kind.
SIZES = {"dxt1": 8, "dxt3": 16, "dxt5": 16}


def packed565(colours: np.ndarray) -> np.ndarray:
    """16-bit numbers of colours (0 to 255)."""
    r, g, b = (np.floor(colours[..., k] * top / 255 + 0.5).astype(np.int64) for k, top in ((0, 31), (1, 63), (2, 31)))
    return r << 11 | g << 5 | b


def unpacked565(code: np.ndarray) -> np.ndarray:
    r, g, b = code >> 11 & 31, code >> 5 & 63, code & 31
    return np.stack([r << 3 | r >> 2, g << 2 | g >> 4, b << 3 | b >> 2], axis=-1)


def palettes(one: np.ndarray, two: np.ndarray, always_four: bool) -> np.ndarray:
    """The four colours of each block, with alpha: both ends and two between, or one between and clear black where the first end isn't the greater."""
    a, b = unpacked565(one), unpacked565(two)
    four = (one > two)[:, None] | always_four
    third, last = np.where(four, (2 * a + b) // 3, (a + b) // 2), np.where(four, (a + 2 * b) // 3, 0)
    out = np.full((len(one), 4, 4), 255, np.int64)
    out[:, :, :3] = np.stack([a, b, third, last], axis=1)
    out[:, 3, 3] = np.where(four[:, 0], 255, 0)
    return out


def alpha_levels(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The eight levels of each DXT5 block: six between the ends, or four and both extremes where the first isn't the greater."""
    a, b, k = one[:, None].astype(np.int64), two[:, None].astype(np.int64), np.arange(1, 7)
    six = (a * (7 - k) + b * k) // 7
    four = np.concatenate([(a * (5 - k[:4]) + b * k[:4]) // 5, np.zeros_like(a), np.full_like(a, 255)], axis=1)
    return np.concatenate([a, b, np.where(a > b, six, four)], axis=1)


def decode_blocks(raw: np.ndarray, kind: str) -> np.ndarray:
    """Blocks (bytes, a row each) as 16 pixels each, by rows, of red, green, blue and alpha."""
    colour = raw[:, SIZES[kind] - 8 :].astype(np.int64)
    one, two = colour[:, 0] | colour[:, 1] << 8, colour[:, 2] | colour[:, 3] << 8
    picks = np.unpackbits(raw[:, SIZES[kind] - 4 :], axis=1, bitorder="little").reshape(-1, 16, 2) @ np.array([1, 2])
    out = np.take_along_axis(palettes(one, two, kind != "dxt1"), picks[:, :, None].astype(np.int64), axis=1)
    if kind == "dxt3":
        out[:, :, 3] = np.stack([raw[:, :8] & 15, raw[:, :8] >> 4], axis=2).reshape(-1, 16).astype(np.int64) * 17
    if kind == "dxt5":
        own = np.unpackbits(raw[:, 2:8], axis=1, bitorder="little").reshape(-1, 16, 3) @ np.array([1, 2, 4])
        out[:, :, 3] = np.take_along_axis(alpha_levels(raw[:, 0], raw[:, 1]), own.astype(np.int64), axis=1)
    return out.astype(np.uint8)


def encode_blocks(pixels: np.ndarray, kind: str) -> np.ndarray:
    """16 pixels a block as bytes. Ends lie where the colours reach along their main axis; each pixel takes the nearest of the four."""
    rgb, alpha = pixels[:, :, :3].astype(float), pixels[:, :, 3].astype(np.int64)
    clear = (alpha < 128) if kind == "dxt1" else np.zeros_like(alpha, bool)
    weight = np.where(clear, 0.0, 1.0)[:, :, None]
    middle = (rgb * weight).sum(axis=1, keepdims=True) / np.maximum(weight.sum(axis=1, keepdims=True), 1)
    apart = (rgb - middle) * weight
    axis = np.linalg.eigh(np.einsum("nki,nkj->nij", apart, apart))[1][:, :, -1]
    along = np.einsum("nki,ni->nk", apart, axis)
    ends = [np.clip(middle[:, 0] + reach[:, None] * axis, 0, 255) for reach in (along.min(axis=1), along.max(axis=1))]
    one, two = (packed565(e) for e in ends)
    # Blocks with clear pixels need the lesser end first, others the greater.
    low, high, has_clear = np.minimum(one, two), np.maximum(one, two), clear.any(axis=1)
    one, two = np.where(has_clear, low, high), np.where(has_clear, high, low)
    colours = palettes(one, two, kind != "dxt1")
    far = ((rgb[:, :, None, :] - colours[:, None, :, :3]) ** 2).sum(axis=3)
    far[:, :, 3] = np.where((colours[:, 3, 3] == 0)[:, None], np.inf, far[:, :, 3])
    picks = np.where(clear, 3, far.argmin(axis=2))
    bits = np.stack([picks & 1, picks >> 1], axis=2).reshape(-1, 32).astype(np.uint8)
    body = np.hstack([np.stack([one & 255, one >> 8, two & 255, two >> 8], axis=1).astype(np.uint8), np.packbits(bits, axis=1, bitorder="little")])
    if kind == "dxt3":
        level = (alpha * 15 + 127) // 255
        return np.hstack([(level[:, ::2] | level[:, 1::2] << 4).astype(np.uint8), body])
    if kind == "dxt5":
        top, least = alpha.max(axis=1), alpha.min(axis=1)
        own = np.abs(alpha[:, :, None] - alpha_levels(top, least)[:, None, :]).argmin(axis=2)
        bits = np.stack([own & 1, own >> 1 & 1, own >> 2], axis=2).reshape(-1, 48).astype(np.uint8)
        return np.hstack([np.stack([top, least], axis=1).astype(np.uint8), np.packbits(bits, axis=1, bitorder="little"), body])
    return body


def to_blocks(image: np.ndarray) -> np.ndarray:
    """An image (rows, columns, 4) as blocks of 16 pixels, from left to right and down; edges repeat outwards."""
    h, w = image.shape[:2]
    whole = np.pad(image, ((0, -h % 4), (0, -w % 4), (0, 0)), mode="edge")
    return whole.reshape(whole.shape[0] // 4, 4, whole.shape[1] // 4, 4, 4).swapaxes(1, 2).reshape(-1, 16, 4)


def from_blocks(blocks: np.ndarray, width: int, height: int) -> np.ndarray:
    across, down = -(-width // 4), -(-height // 4)
    return blocks.reshape(down, across, 4, 4, 4).swapaxes(1, 2).reshape(4 * down, 4 * across, 4)[:height, :width]


def dds(image: np.ndarray, kind: str) -> bytes:
    """A DDS file of an image."""
    height, width = image.shape[:2]
    body = encode_blocks(to_blocks(image), kind).tobytes()
    form = struct.pack("<II4s5I", 32, 4, kind.upper().encode(), 0, 0, 0, 0, 0)
    return b"DDS " + struct.pack("<7I44x", 124, 0x81007, height, width, len(body), 0, 0) + form + struct.pack("<5I", 0x1000, 0, 0, 0, 0) + body


def decode_dds(content: bytes) -> np.ndarray:
    height, width = struct.unpack_from("<II", content, 12)
    kind = content[84:88].decode().lower()
    if kind not in SIZES:
        raise ValueError(f"DDS of kind {kind!r}")
    many = -(-width // 4) * -(-height // 4)
    return from_blocks(decode_blocks(np.frombuffer(content, np.uint8, many * SIZES[kind], 128).reshape(many, -1), kind), width, height)


def textured(images: DataFrame, kind: str, width: str = "width", height: str = "height", rgba: str = "rgba") -> DataFrame:
    """images with one more column, content: a DDS file of their pixels as dxt1, dxt3 or dxt5; null where there are none. All blocks of a batch's images are encoded at once for each image."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sizes = zip(*(part.column(c).to_pylist() for c in (width, height, rgba)), strict=True)
            files = [None if p is None else dds(np.frombuffer(p, np.uint8).reshape(h, w, 4), kind) for w, h, p in sizes]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(files, pa.binary())], [*part.schema.names, "content"])

    return images.mapInArrow(run, ", ".join([*(f"`{c}` {k}" for c, k in images.dtypes), "content binary"]))


def pixels_of_blocks(blocks: DataFrame, kind: str, block: str = "block") -> DataFrame:
    """blocks with pixels in place of each block's bytes: 64 bytes, 16 pixels by rows. Null blocks and blocks of another length are null."""
    rest = [c for c in blocks.columns if c != block]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = part.column(len(rest)).to_pylist()
            good = [k for k, b in enumerate(out) if b is not None and len(b) == SIZES[kind]]
            found = decode_blocks(np.frombuffer(b"".join([out[k] for k in good]), np.uint8).reshape(-1, SIZES[kind]), kind) if good else []
            made = dict(zip(good, found, strict=True))
            pixels = pa.array([made[k].tobytes() if k in made else None for k in range(len(out))], pa.binary())
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(rest))), pixels], [*rest, "pixels"])

    return blocks.select(*rest, block).mapInArrow(run, ", ".join([*(f"`{c}` {k}" for c, k in blocks.select(*rest).dtypes), "pixels binary"]))
