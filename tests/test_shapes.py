"""Meshes of masks with holes, and images written as C source."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiltwork.operators import geometry, indexed, meshes, raster, tracing
from quiltwork.sources import images, text_images


def cut_area(mask):
    """What marching squares keep of a mask, square by square."""
    s = np.pad(mask, 1).astype(int)
    a, b, c, d = s[:-1, :-1], s[:-1, 1:], s[1:, 1:], s[1:, :-1]
    n = a + b + c + d
    return float((np.array([0, 0.125, 0.5, 0.875, 1])[n] + np.where((n == 2) & (a == c), 0.25, 0)).sum())


def area_of(vertices, indices):
    return sum(abs(meshes.ring_area([vertices[i] for i in indices[k : k + 3]])) for k in range(0, len(indices), 3)) / 2


def signed(contours):
    return sum(abs(meshes.ring_area(p)) * (-1 if hole else 1) for p, hole, _ in contours) / 2


@pytest.mark.parametrize("seed", range(6))
def test_triangles_cover_masks(seed):
    r = np.random.default_rng(seed)
    for _ in range(25):
        mask = r.random(r.integers(1, 16, 2)) < r.choice([0.3, 0.6, 0.9])
        if mask.any():
            contours, vertices, indices = meshes.meshed(mask, 0.0)
            assert abs(area_of(vertices, indices) - cut_area(mask)) < 1e-9 and abs(signed(contours) - cut_area(mask)) < 1e-9
            assert all((parent is None and not hole) or contours[parent][1] != hole for _, hole, parent in contours)


def test_simplified_shapes():
    """A ring with an island: simplified contours, still joined and covered, and fewer points."""
    y, x = np.mgrid[:60, :60]
    far = np.hypot(y - 30, x - 30)
    mask = (far < 28) & (far > 14) | (far < 6)
    full, simple = meshes.meshed(mask, 0.0), meshes.meshed(mask, 1.0)
    assert [(h, p) for _, h, p in simple[0]] == [(h, p) for _, h, p in full[0]] and sorted(h for _, h, _ in simple[0]) == [False, False, True]
    assert len(simple[1]) < len(full[1]) / 3 and abs(area_of(*simple[1:]) - signed(simple[0])) < 1e-9 and abs(signed(simple[0]) - cut_area(mask)) < 60


def test_mesh_column(spark):
    ring = bytearray(b"\1\1\1\1\0\1\1\1\1")
    rows = [(1, ring, 3), (2, bytearray(9), 3), (3, None, 3), (4, ring, 4), (5, bytearray(b"\7"), 1), (6, ring, None)]
    found = meshes.with_meshes(spark.createDataFrame(rows, "id int, mask binary, width int"), "mask", "width", 0.0)
    by = {r.id: r for r in found.select("*", meshes.mesh_area(F.col("shape.mesh")).alias("area")).collect()}
    assert [by[k].shape is None for k in range(1, 7)] == [False, True, True, True, False, True]
    assert by[1].area == cut_area(np.frombuffer(bytes(ring), np.uint8).reshape(3, 3) > 0) and by[5].area == 0.5
    assert [(c.is_hole, c.parent) for c in by[1].shape.contours] == [(False, None), (True, 0)]
    uv = meshes.with_texture_points(F.col("shape.mesh"), F.lit(2), F.lit(4), F.lit(1), F.lit(10), F.lit(20), F.lit(False))
    (row,) = found.where("id = 5").select(uv.alias("m")).collect()
    assert {(p.x, p.y) for p in row.m.uvs} == {(0.25, 0.2), (0.3, 0.225), (0.25, 0.25), (0.2, 0.225)}


def xpm(head, entries, rows):
    return "/* XPM */\nstatic char * a[] = {\n" + ",\n".join(f'"{t}"' for t in [head, *entries, *rows]) + "};\n"


def test_xpm(spark):
    good = xpm("3 2 4 2", ["aa c #f00", "bb s x c None", "cc\tm white c #0001FFFF8000", "dd c DarkGray"], ["aabbcc", "ddddaaEXTRA"])
    cases = {
        "good": good, "none": "", "null": None, "size": xpm("3 x 1 1", [], []), "huge": xpm("900000 900000 1 1", ["a c red"], ["a"]), "rows": xpm("1 2 1 1", ["a c red"], ["a"]), "colour": xpm("1 1 1 1", ["a c nosuch"], ["a"]),
        "no c": xpm("1 1 1 1", ["a s red"], ["a"]), "short": xpm("2 1 1 1", ["a c red"], ["a"]), "unknown": xpm("1 1 1 1", ["a c red"], ["b"]), "twice": xpm("1 1 2 1", ["a c red", "a c blue"], ["a"]), "space": xpm("2 1 2 1", ["  c red", "c c #00F"], [" c"]),
    }
    files = spark.createDataFrame(list(cases.items()), "name string, content string")
    found = {r.name: r for r in text_images.xpm(files).collect()}
    pixel = lambda p: tuple(p)
    assert [[pixel(p) for p in line] for line in found["good"].rows] == [[(255, 0, 0, 255), (0, 0, 0, 0), (0, 255, 127, 255)], [(105, 105, 105, 255), (105, 105, 105, 255), (255, 0, 0, 255)]]
    assert found["twice"].rows[0][0].r == 255 and [p.b for p in found["space"].rows[0]] == [0, 255]
    assert {k: r.error for k, r in found.items() if r.error} == {
        "none": "no header", "null": "no header", "size": "no size that the file can hold: 3 x 1 1", "huge": "no size that the file can hold: 900000 900000 1 1", "rows": "colours or rows are missing", "colour": "no colour in: a c nosuch",
        "no c": "no colour in: a s red", "short": "a row is too short", "unknown": "a pixel without a colour",
    }
    assert all(found[k].rows is None and found[k].width is None for k in found if found[k].error) and text_images.pixel_rows(text_images.xpm(files), ["name"]).where("name = 'good'").count() == 6


def test_xbm(spark):
    head = "#define t_width 9\n#define t_height 2\n"
    cases = {"good": head + "static char t_bits[] = { 0x01, 0X1,\n 80, 0x00, 0xff };", "short": head + "{ 0x01 }", "byte": head + "{ 0x01, zz, 3, 4 }", "no bits": head, "no size": "{ 1 }", "null": None}
    found = {r.name: r for r in text_images.xbm(spark.createDataFrame(list(cases.items()), "name string, content string")).collect()}
    assert [[p.a for p in line] for line in found["good"].rows] == [[255, 0, 0, 0, 0, 0, 0, 0, 255], [0, 0, 0, 0, 0, 0, 0, 255, 0]]
    assert {k: r.error for k, r in found.items() if r.error} == {"short": "bytes are missing", "byte": "no byte: zz", "no bits": "no bits", "no size": "no width and height", "null": "no width and height"}


def turned(loop):
    """A loop from its least point on, in the direction that comes first."""
    k = loop.index(min(loop))
    ring = loop[k:] + loop[:k]
    return min(tuple(ring), tuple(ring[:1] + ring[:0:-1]))


def test_contours_over_pixels(spark):
    """Points, loops and their order are those of the array version, for many images at once."""
    r = np.random.default_rng(8)
    masks = {k: r.random(r.integers(1, 12, 2)) < r.choice([0.4, 0.6, 0.9]) for k in range(20)} | {20: np.ones((1, 1), bool), 21: np.zeros((3, 3), bool), 22: np.indices((40, 40)).sum(axis=0) % 2 == 0}
    rows = [(k, int(x), int(y)) for k, m in masks.items() for y, x in zip(*np.nonzero(m))]
    found = tracing.contours(spark.createDataFrame(rows + rows[:5], "image int, x int, y int").repartition(4), ["image"]).collect()
    by = {}
    for row in sorted(found, key=lambda row: row.position):
        by.setdefault((row.image, row.loop), []).append((row.px, row.py))
    for k, mask in masks.items():
        assert sorted(turned(loop) for (image, _), loop in by.items() if image == k) == sorted(turned(loop) for loop in geometry.stitched(geometry.segments(mask))), k


def one_by_one(image, palette):
    """Serpentine Floyd-Steinberg, pixel by pixel."""
    work, out = image.astype(np.float32), np.empty(image.shape[:2], int)
    h, w = image.shape[:2]
    for y in range(h):
        ahead = -1 if y % 2 else 1
        for x in range(w)[::ahead]:
            old = np.clip(work[y, x], 0, 255)
            out[y, x] = ((old - palette) ** 2).sum(axis=1).argmin()
            error = old - palette[out[y, x]]
            for dx, dy, share in ((ahead, 0, 7), (-ahead, 1, 3), (0, 1, 5), (ahead, 1, 1)):
                if 0 <= x + dx < w and y + dy < h:
                    work[y + dy, x + dx] += error * np.float32(share / 16)
    return out


def test_palettes(spark):
    r = np.random.default_rng(3)
    pictures = [r.integers(0, 256, (*r.integers(1, 9, 2), 4)).astype(np.uint8) for _ in range(12)]
    palettes = [r.integers(0, 256, (n, 4)) for n in (1, 2, 16, 256) * 3]
    rows = [(k, bytearray(p.tobytes()), p.shape[1], [[int(c) for c in e] for e in t]) for k, (p, t) in enumerate(zip(pictures, palettes))]
    rows += [(20, None, 3, [[0, 0, 0, 0]]), (21, bytearray(8), 3, [[0, 0, 0, 0]]), (22, bytearray(8), 2, None), (23, bytearray(8), 2, [])]
    df = spark.createDataFrame(rows, "id int, rgba binary, width int, palette array<array<int>>").coalesce(2)
    for errors in (False, True):
        found = {x.id: x for x in indexed.indexed(df, "rgba", "width", "palette", errors).collect()}
        for k, (p, t) in enumerate(zip(pictures, palettes)):
            want = one_by_one(p, t.astype(np.float32)) if errors else ((p.reshape(-1, 1, 4).astype(int) - t) ** 2).sum(axis=2).argmin(axis=1).reshape(p.shape[:2])
            assert bytes(found[k].indices) == want.astype(np.uint8).tobytes() and bytes(found[k].rgba) == t[want].astype(np.uint8).tobytes(), (k, errors)
        assert all(found[k].indices is None for k in range(20, 24)) and bytes(found[21].rgba) == bytes(8)
    small = indexed.indexed(df, "rgba", "width", "palette", True).where("id < 12").withColumn("height", (F.octet_length("rgba") / F.col("width") / 4).cast("int"))
    files = {x.id: bytes(x.content) for x in images.encoded(small, "png").collect()}
    assert all(b"PLTE" in f for f in files.values())


def test_outlines_of_contours(spark):
    """A turned frame's triangle, drawn on a page with its frame; single points draw nothing."""
    frames = spark.createDataFrame([(1, 2, 3, 5, 4, True, [[(0.0, 0.0), (3.0, 0.0), (0.0, 4.0)], [(1.0, 1.0)]]), (1, 0, 0, 0, 9, False, [[(0.0, 0.0), (9.0, 9.0)]]), (2, 0, 0, 1, 1, False, None)], "page int, x int, y int, w int, h int, rotated boolean, c array<array<struct<x:double,y:double>>>")
    lines = raster.shape_lines(frames, ["page"], "c")
    assert sorted(tuple(r) for r in lines.where("page = 1").collect()) == sorted([(1, 2, 3, 6, 3), (1, 2, 6, 6, 6), (1, 2, 3, 2, 6), (1, 6, 3, 6, 6), (1, 6, 3, 6, 6), (1, 6, 6, 2, 3), (1, 2, 3, 6, 3)])
    pixels = spark.createDataFrame([(1, x, y, 1, 2, 3, 4) for x in range(5) for y in range(5)], "page int, x int, y int, r int, g int, b int, a int")
    found = {(r.x, r.y) for r in raster.outlined(pixels, lines, ["page"]).where("r = 255 and g = 0 and a = 255").collect()}
    assert found == {(2, 3), (3, 3), (4, 3), (2, 4), (3, 4), (4, 4)} and raster.line_pixels(lines.where("page = 2"), ["page"]).distinct().count() == 1


def test_contours_alone_cut_no_ears(monkeypatch):
    mask = np.array([[1, 1, 1], [1, 0, 1], [1, 1, 1]], bool)
    whole = meshes.meshed(mask, 0.0)
    monkeypatch.setattr(meshes, "clipped", None)
    assert meshes.meshed(mask, 0.0, False) == (whole[0], [], [])


def test_ears_are_cut_in_numbers_that_fit_small_rings(monkeypatch):
    """Turns of corners that nothing touched aren't taken again: three for each corner and two for each that goes, at most."""
    ring = [(float(x), float(y)) for x, y in [(0, 0), *((k, 5 + k % 2) for k in range(1, 40)), (40, 0)]][::-1]
    ring = ring if meshes.ring_area(ring) > 0 else ring[::-1]
    asked, side = [], meshes.side
    monkeypatch.setattr(meshes, "side", lambda *p: asked.append(1) or side(*p))
    ears = meshes.clipped(ring)
    assert abs(meshes.covered(ring, ears) - meshes.ring_area(ring)) < 1e-9 and len(asked) <= 3 * len(ring) + 1


def test_images_close_in_tasks_or_by_rounds(spark, monkeypatch):
    """Small images need no rounds of joins; a bound that some exceed gives the same."""
    r = random.Random(8)
    rows = [(k, x, y) for k in range(12) for y in range(9) for x in range(9) if r.random() < (0.55 if k % 3 else 0.05)]
    df = spark.createDataFrame(rows, "image int, x int, y int").repartition(3)
    by_rounds = sorted(map(tuple, tracing.loops(tracing.edges(df, ["image"]), ["image"]).collect()))
    for most in (1, 30, 100):
        assert sorted(map(tuple, tracing.looped(tracing.edges(df, ["image"]), ["image"], most).collect())) == by_rounds
    monkeypatch.setattr(tracing, "loops", None)
    assert sorted(map(tuple, tracing.looped(tracing.edges(df, ["image"]), ["image"]).collect())) == by_rounds


def test_pixels_travel_as_tiles(spark, monkeypatch):
    """Contours by tiles are those by edges and rounds, whether an image closes in its task or not; points aren't kept anywhere."""
    r = random.Random(9)
    rows = [(f"i{k}", x, y) for k in range(8) for y in range(21) for x in range(27) if r.random() < (0.55 if k % 3 else 0.05)]
    df = spark.createDataFrame(rows + rows[:9], "image string, x int, y long").repartition(3)
    half = lambda c: (c - 2) / 2 + 0.5
    want = sorted((e.image, e.loop, e.position, half(e.here % (1 << 32)), half(e.here >> 32)) for e in tracing.loops(tracing.edges(df, ["image"]), ["image"]).collect())
    for most in (1, 64 * 6, 200_000):
        assert sorted(map(tuple, tracing.contours(df, ["image"], most=most).collect())) == want, most
        by = {(q.image, q.loop): [(p.x, p.y) for p in q.points] for q in tracing.rings(df, ["image"], most=most).collect()}
        assert sum(map(len, by.values())) == len(want) and all(by[w[:2]][w[2]] == w[3:] for w in want)
    kept, settled = [], tracing.settled
    monkeypatch.setattr(tracing, "settled", lambda df: kept.append(df.count()) or settled(df))
    tracing.contours(df, ["image"]).collect()
    assert kept == [df.selectExpr("image", "x >> 3", "y >> 3").distinct().count()]


def test_masks_are_swept(monkeypatch):
    """Loops that don't cross need no bridges and ears: triangles by height cover a mask once, holes, islands and level sides included."""
    monkeypatch.setattr(meshes, "bridged", None)
    monkeypatch.setattr(meshes, "clipped", None)
    r = np.random.default_rng(12)
    masks = [r.random(r.integers(1, 18, 2)) < r.choice([0.3, 0.5, 0.6, 0.9]) for _ in range(80)] + [np.pad(np.pad(np.pad(np.ones((1, 1), bool), 1), 1, constant_values=True), 1), np.ones((7, 3), bool)]
    for mask in filter(np.any, masks):
        contours, vertices, indices = meshes.meshed(mask, 0.0)
        corners = np.array(vertices)[np.array(indices).reshape(-1, 3)]
        at = r.random((60, 2)) * (mask.shape[1] + 2, mask.shape[0] + 2) - 1
        turn = lambda a, b: (b[:, :1] - a[:, :1]) * (at[:, 1] - a[:, 1:]) - (b[:, 1:] - a[:, 1:]) * (at[:, 0] - a[:, :1])
        held = np.all([turn(corners[:, k], corners[:, (k + 1) % 3]) > 0 for k in range(3)], axis=0).sum(axis=0)
        want = [sum(geometry.inside(tuple(p), loop) for loop, _, _ in contours) % 2 for p in at.tolist()]
        assert held.tolist() == want and abs(area_of(vertices, indices) - cut_area(mask)) < 1e-9
        assert len(vertices) == sum(len(loop) for loop, _, _ in contours)


def test_loops_in_numbers_are_those_of_segments():
    r = np.random.default_rng(13)
    for _ in range(60):
        mask = r.random(r.integers(1, 20, 2)) < r.choice([0.3, 0.5, 0.9])
        assert geometry.mask_loops(mask) == geometry.stitched(geometry.segments(mask))
