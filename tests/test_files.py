"""Scans, headers, sidecars, writers and sealed contents on small files."""

import json
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from quiltwork.operators import flow, raster
from quiltwork.sources import files


def png(w, h):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * (4 * w + 1) * h)) + chunk(b"IEND", b"")


CASES = {
    "a.png": (png(300, 7), ("png", 300, 7)),
    "sub/b.bmp": (b"BM" + bytes(16) + struct.pack("<ii", 12, 34), ("bmp", 12, 34)),
    "sub/c.dds": (b"DDS " + bytes(8) + struct.pack("<II", 5, 6), ("dds", 6, 5)),
    "d.GIF": (b"GIF89a" + struct.pack("<HH", 9, 8), ("gif", 9, 8)),
    "e.txt": (b"nothing", None),
    "f.pvr.gz": (b"\x1f\x8b", None),
    "empty.png": (b"", None),
}


def test_scan_and_headers(spark, tmp_path):
    for name, (content, _) in CASES.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(content)
    found = files.scan(spark, [str(tmp_path), str(tmp_path / "sub")], ignore=["*.txt"])
    rows = {r.path.split(str(tmp_path) + "/")[1]: r for r in found.select("path", files.image_size(F.col("content")).alias("s"), files.is_image(F.col("path")).alias("i")).collect()}
    assert rows.keys() == CASES.keys() - {"e.txt", "empty.png"}
    assert all((None if r.s is None else tuple(r.s)) == CASES[n][1] for n, r in rows.items())
    assert all(r.i for r in rows.values())
    assert {r.path.rsplit("/", 1)[1] for r in files.scan(spark, [str(tmp_path)], recursive=False, content=False).collect()} == {n for n in CASES if "/" not in n and CASES[n][0]}


def test_sidecars(spark):
    df = spark.createDataFrame([('{"a": {"x": 0.5, "y": 1}, "b": {"x": 0, "y": 0.25}}', '{"panel": [4, 6, 5, 3], "short": [1]}'), (None, "not json")], "p string, b string")
    first, second = df.select(files.pivots(F.col("p")).alias("p"), files.borders(F.col("b")).alias("b")).collect()
    assert {tuple(x) for x in first.p} == {("a", 0.5, 1.0), ("b", 0.0, 0.25)} and {tuple(x) for x in first.b} == {("panel", 4, 6, 5, 3), ("short", 1, None, None, None)}
    assert second.p is None
    rows = spark.createDataFrame([("b", 0.0, 0.25), ("a", 0.5, 1.0)], "id string, x double, y double")
    assert json.loads(files.sidecar(rows, "id", ["x", "y"]).first().document) == {"a": {"x": 0.5, "y": 1.0}, "b": {"x": 0.0, "y": 0.25}}


def test_only_changes_are_written(spark):
    old = spark.createDataFrame([("a", b"1"), ("b", b"2")], "k string, c binary")
    new = spark.createDataFrame([("a", b"1"), ("b", b"3"), ("c", b"")], "k string, c binary")
    assert {r.k for r in files.changed(new, old, "k", "c").collect()} == {"b", "c"}


def test_sealed_contents(spark):
    df = spark.createDataFrame([(b"secret",), (b"",)], "c binary").select("c", files.sealed(F.col("c"), F.lit("k" * 32)).alias("s"))
    rows = df.select("c", "s", files.opened(F.col("s"), F.lit("k" * 32)).alias("o"), files.opened(F.col("s"), F.lit("x" * 32)).alias("w"), files.opened(F.col("c"), F.lit("k" * 32)).alias("n")).collect()
    assert all(bytes(r.o) == bytes(r.c) and r.w is None and r.n is None and bytes(r.s).startswith(b"QWSEAL1") for r in rows)


def test_bleeding_is_in_place(spark):
    image = np.zeros((1, 4, 4), np.uint8)
    image[0, 0] = (9, 8, 7, 255)
    assert raster.bled(image)[0, :, :3].tolist() == [[9, 8, 7]] * 4 and raster.bled(image)[0, :, 3].tolist() == [255, 0, 0, 0]
    df = spark.createDataFrame([(image.tobytes(), 4), (None, 4), (b"abc", 4)], "image binary, width int")
    assert [r.image and len(r.image) for r in raster.with_bleeding(df, "image", "width").collect()] == [16, None, 3]


def test_manual_wishes():
    o = flow.FlowOptions(width=64, height=64, padding=0, align=8)
    placed = {p[0]: p[1:6] for p in flow.manual_rows([("a", 10, 10, 60, -5), ("b", 10, 10, 3, 3), ("c", 30, 10, None, None), ("d", 40, 10, None, None)], o)}
    assert placed["a"] == (0, 48, 0, 10, 10) and placed["b"] == (0, 8, 8, 10, 10)
    assert placed["d"][2] >= 18 and placed["c"][2] >= placed["d"][2]


def test_smallest_page(spark):
    df = spark.createDataFrame([("g", k, f"s{k}", 14, 14) for k in range(4)] + [("h", 0, "t", 100, 3)], "g string, ord long, id string, w long, h long")
    found = {r.g: (r.width, r.height) for r in flow.smallest_page(df, "g", [16, 32, 64, 128]).collect()}
    assert found == {"g": (32, 32), "h": (16, 128)}  # turned
