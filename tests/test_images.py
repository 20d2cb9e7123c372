"""Image files: round trips, and files put together by hand."""

import random
import struct
import zlib

import numpy as np
import pytest

from quiltwork.operators import blocks
from quiltwork.sources import images


def picture(h, w, colours=1000, seed=0):
    r = np.random.default_rng(seed)
    table = r.integers(0, 256, (colours, 4), dtype=np.uint8)
    return table[r.integers(0, colours, (h, w))]


@pytest.mark.parametrize("kind", ["png", "bmp", "tga"])
@pytest.mark.parametrize("size", [(1, 1), (3, 5), (16, 33), (40, 40)])
@pytest.mark.parametrize("colours", [3, 1000])
def test_round_trips(kind, size, colours):
    art = picture(*size, colours)
    assert (images.decode(images.WRITERS[kind](art)) == art).all()


def filtered(lines, step, kind):
    """The other direction of a PNG filter, byte by byte."""
    rows, stride = lines.shape
    out, v = [], lines.astype(int)
    for y in range(rows):
        k = kind(y)
        out.append(k)
        for x in range(stride):
            a, b = v[y, x - step] if x >= step else 0, v[y - 1, x] if y else 0
            c = v[y - 1, x - step] if y and x >= step else 0
            p = a + b - c
            near = [0, a, b, (a + b) // 2, min((a, b, c), key=lambda q: abs(p - q))][k]
            out.append((v[y, x] - near) % 256)
    return bytes(out)


def png(width, height, depth, colour, body, more=b"", interlaced=0):
    return images.PNG + images.chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlaced)) + more + images.chunk(b"IDAT", zlib.compress(body)) + images.chunk(b"IEND", b"")


def test_png_filters_depths_and_passes():
    art = picture(9, 13, seed=3)
    for colour, step, take in ((6, 4, slice(0, 4)), (2, 3, slice(0, 3)), (4, 2, [0, 3])):
        part = np.ascontiguousarray(art[:, :, take])
        got = images.decode(png(13, 9, 8, colour, filtered(part.reshape(9, -1), step, lambda y: y % 5)))
        assert (got[:, :, :3] == (part[:, :, :3] if colour != 4 else part[:, :, :1])).all() and (got[:, :, 3] == (part[:, :, -1] if colour != 2 else 255)).all()
    grey = np.array([[0, 1, 1, 0, 1, 0, 0, 1, 1], [1] * 9], np.uint8)
    got = images.decode(png(9, 2, 1, 0, b"".join(b"\0" + row.tobytes() for row in np.packbits(grey, axis=1)), images.chunk(b"tRNS", struct.pack(">H", 1))))
    assert (got[:, :, 0] == grey * 255).all() and (got[:, :, 3] == (1 - grey) * 255).all()
    deep = np.stack([art[:, :, 0], art[:, :, 1]], axis=2)  # 16 bits: high byte, low byte
    assert (images.decode(png(13, 9, 16, 0, filtered(deep.reshape(9, -1), 2, lambda y: 4 - y % 5)))[:, :, 2] == art[:, :, 0]).all()
    body = b""
    for y0, x0, dy, dx in images.PASSES:
        part = art[y0::dy, x0::dx]
        body += filtered(part.reshape(part.shape[0], -1), 4, lambda y: y % 5) if part.size else b""
    assert (images.decode(png(13, 9, 8, 6, body, interlaced=1)) == art).all()


def test_tga_runs_and_pnm():
    runs = bytes([0x82, 1, 2, 3, 0x01, 9, 8, 7, 6, 5, 4])
    head = struct.pack("<BBBHHBHHHHBB", 2, 0, 10, 0, 0, 0, 0, 0, 5, 1, 24, 0x20)
    assert images.decode(head + b"xy" + runs)[0, :, :3].tolist() == [[3, 2, 1]] * 3 + [[7, 8, 9], [4, 5, 6]]
    assert images.decode(b"P5\n# said\n2 1\n15\n" + bytes([0, 15]))[0, :, 0].tolist() == [0, 255]
    assert images.decode(b"P6 1 1 255\n" + bytes([1, 2, 3])).tolist() == [[[1, 2, 3, 255]]]


def test_tables(spark):
    arts = [picture(random.Random(k).randrange(1, 9), 4, seed=k) for k in range(6)]
    rows = [(k, bytearray(images.encode_png(a))) for k, a in enumerate(arts)] + [(90, None), (91, bytearray(b"\x89PNG\r\n\x1a\nbroken")), (92, bytearray(b"")), (93, bytearray(images.PNG + images.chunk(b"IHDR", struct.pack(">IIBBBBB", 1 << 30, 1 << 30, 8, 6, 0, 0, 0))))]
    read = images.decoded(spark.createDataFrame(rows, "id long, content binary").repartition(3))
    by = {r.id: r for r in read.collect()}
    assert all(bytes(by[k].rgba) == a.tobytes() and (by[k].width, by[k].height) == (4, len(a)) for k, a in enumerate(arts))
    assert by[90].rgba is None and by[90].error is None and all(by[k].rgba is None and by[k].error for k in (91, 92, 93))
    again = images.images_of(images.pixels_of(read, ["id"]), ["id"])
    assert {r.id: bytes(r.rgba) for r in again.collect()} == {k: a.tobytes() for k, a in enumerate(arts)}
    for kind in images.WRITERS:
        back = images.decoded(images.encoded(again, kind).select("id", "content"))
        assert {r.id: bytes(r.rgba) for r in back.collect()} == {k: a.tobytes() for k, a in enumerate(arts)}
    assert images.decoded(spark.createDataFrame([], "id long, content binary")).collect() == []


def plain_block(b, kind):
    """One block, decoded number by number."""
    colour = b[-8:]
    ends = [colour[0] | colour[1] << 8, colour[2] | colour[3] << 8]
    wide = [((e >> 11) * 8 + (e >> 11) // 4, (e >> 5 & 63) * 4 + (e >> 5 & 63) // 16, (e & 31) * 8 + (e & 31) // 4) for e in ends]
    if ends[0] > ends[1] or kind != "dxt1":
        table = [*wide, tuple((2 * p + q) // 3 for p, q in zip(*wide)), tuple((p + 2 * q) // 3 for p, q in zip(*wide))]
        alphas = [255] * 4
    else:
        table, alphas = [*wide, tuple((p + q) // 2 for p, q in zip(*wide)), (0, 0, 0)], [255, 255, 255, 0]
    picks, out = int.from_bytes(colour[4:], "little"), []
    levels = [b[0], b[1]]
    levels += [(b[0] * (7 - k) + b[1] * k) // 7 for k in range(1, 7)] if b[0] > b[1] else [(b[0] * (5 - k) + b[1] * k) // 5 for k in range(1, 5)] + [0, 255]
    for k in range(16):
        n = picks >> 2 * k & 3
        a = {"dxt1": alphas[n], "dxt3": (int.from_bytes(b[:8], "little") >> 4 * k & 15) * 17, "dxt5": levels[int.from_bytes(b[2:8], "little") >> 3 * k & 7]}[kind]
        out.append((*table[n], a))
    return out


@pytest.mark.parametrize("kind", ["dxt1", "dxt3", "dxt5"])
def test_blocks(kind):
    r = np.random.default_rng(7)
    raw = r.integers(0, 256, (300, blocks.SIZES[kind]), dtype=np.uint8)
    assert blocks.decode_blocks(raw, kind).tolist() == [[list(p) for p in plain_block(b.tolist(), kind)] for b in raw]
    # Colours between two ends come back nearly, and flat blocks within the steps of the ends.
    ends, share = r.integers(0, 256, (200, 2, 1, 4)), r.random((200, 16, 1))
    art = (ends[:, 0] * share + ends[:, 1] * (1 - share)).astype(np.uint8)
    art[:, :, 3] = 255 if kind == "dxt1" else art[:, :, 3]
    far = np.abs(blocks.decode_blocks(blocks.encode_blocks(art, kind), kind).astype(int) - art)
    assert far[:, :, :3].mean() < 14 and far[:, :, 3].max() <= {"dxt1": 0, "dxt3": 9, "dxt5": 19}[kind]
    flat = np.repeat(r.integers(0, 256, (50, 1, 4), dtype=np.uint8), 16, axis=1)
    flat[:, :, 3] = 255
    assert np.abs(blocks.decode_blocks(blocks.encode_blocks(flat, kind), kind).astype(int) - flat).max() <= 4
    image = picture(7, 10, seed=2)
    image[:, :, 3] = 255
    assert images.decode(blocks.dds(image, kind)).shape == image.shape
    clear = image.copy()
    clear[::2, :, 3] = 0
    assert ((images.decode(blocks.dds(clear, kind))[:, :, 3] > 127) == (clear[:, :, 3] > 127)).all()
