"""Project files in and out, and files written as one transaction."""

import os
import time

import pytest
from pyspark.sql import functions as F

from quiltwork.sources import projects as pj
from quiltwork.sources import sink


def settings(k):
    row = {
        "input_directory": f"in{k}", "output_directory": "/out", "max_texture_size": 512 + k, "padding": k % 4, "extrude": 1, "allow_rotation": k % 2 == 0, "enable_trim": k % 3 > 0, "trim_threshold": 1, "enable_polygon": False, "polygon_tolerance": 1.5, "enable_aliasing": True,
        "color_depth": "RGBA8888", "dithering_algorithm": "None", "gpu_format": "PNG", "template_format": "JSON", "packing_strategy": "BSSF", "scale_variants": [1.0, 0.5], "enable_normal_maps": False, "default_pivot_x": 0.25, "default_pivot_y": 0.5, "base_file_name": f'a"\\{k} ü',
        "recursive": True, "extra_inputs": [f"x/{k}.png", "y & <z>.png"] if k % 5 else None, "fixed_width": 64 if k % 7 == 0 else None, "sprites": [("b/c.png", None, None), ("hero one.png", 0.5, 1.0)] if k % 2 else [],
    }
    return {"path": f"p/{k:04}"} | {c: row.get(c) for c in pj.COLUMNS if c not in ("path", "format", "errors", "unsupported")}


@pytest.fixture(scope="module")
def made(spark):
    kinds = dict(part.split(" ", 1) for part in pj.ROWS.replace("array<struct<file:string,pivot_x:double,pivot_y:double>>", "SPRITES").split(", "))
    schema = ", ".join(f"{c} {kinds[c].replace('SPRITES', 'array<struct<file:string,pivot_x:double,pivot_y:double>>')}" for c in settings(0))
    return spark.createDataFrame([tuple(settings(k).values()) for k in range(1000)], schema).repartition(8)


def plain(rows):
    return sorted((r.path.rsplit("/", 1)[-1].split(".")[0], {c: [tuple(s) for s in v] if c == "sprites" else list(v) if isinstance(v, list) else v for c, v in r.asDict().items() if c not in ("path", "format")}) for r in rows)


def test_thousand_toml_files(spark, made, tmp_path):
    """Written, read and written again: all settings come back, and the second write touches nothing."""
    spark.dataSource.register(pj.Projects)
    files = pj.project_files(made.withColumn("path", F.concat("path", F.lit(".tpproj"))))
    sink.write_files(files, str(tmp_path))
    back = spark.read.format("projects").option("files_per_task", 100).load(str(tmp_path))
    assert back.rdd.getNumPartitions() == 10 and back.where("errors is not null or size(unsupported) > 0").count() == 0
    assert [(p, {c: v for c, v in r.items() if c not in ("errors", "unsupported")}) for p, r in plain(back.collect())] == [(r["path"][2:], {c: sorted(v) if c == "sprites" else v for c, v in r.items() if c != "path"}) for r in map(settings, range(1000))]
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*") if p.is_file()}
    time.sleep(0.02)
    sink.write_files(pj.project_files(back.withColumn("path", F.substring_index("path", f"{tmp_path}/", -1))), str(tmp_path))
    assert {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*") if p.is_file()} == before and len(before) == 1000


def test_tps_files(spark, made, tmp_path):
    files = pj.project_files(made.withColumn("path", F.concat("path", F.lit(".tps"))), "tps")
    sink.write_files(files, str(tmp_path))
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))
    back = dict(plain(pj.parsed(read).collect()))
    assert len(back) == 1000
    for k in range(1000):
        own, found = settings(k), back[f"{k:04}"]
        for s in pj.SETTINGS:
            if s.key:
                assert found[s.name] == own[s.name], (k, s.name)
        assert found["sprites"] == sorted(own["sprites"]) and found["default_pivot_x"] == 0.25 and found["enable_trim"] == own["enable_trim"] and found["unsupported"] == [] and found["errors"] is None


def test_what_is_wrong_with_projects(spark):
    rows = [
        ("a.tpproj", 'padding = "x"\nextrude = 1\nnew_thing = 3\nmax_texture_size = 99999999999\n'), ("b.tpproj", "padding = = 1"), ("c.tps", "<data><struct><key>one</key><key>allowRotation</key><true/><key>algorithmSettings</key><struct><key>deep</key><int>1</int></struct></struct></data>"),
        ("d.tps", "<plist/>"), ("e.tps", '<!DOCTYPE x [<!ENTITY a "b">]><data><struct/></data>'), ("f.tps", None), ("g.toml", b"\xff\xfe"), ("h.tpproj", ""),
    ]
    df = spark.createDataFrame([(p, bytearray(c.encode() if isinstance(c, str) else c) if c is not None else None) for p, c in rows], "path string, content binary")
    found = {r.path: r for r in pj.parsed(df).collect()}
    needed = [s.name for s in pj.SETTINGS if s.needed]
    assert found["a.tpproj"].errors == f"missing: {', '.join(n for n in needed if n not in ('padding', 'extrude', 'max_texture_size'))}; of another type: max_texture_size, padding"
    assert found["a.tpproj"].extrude == 1 and found["a.tpproj"].padding is None and found["a.tpproj"].unsupported == ["new_thing"] and found["h.tpproj"].errors == f"missing: {', '.join(needed)}"
    assert found["c.tps"].allow_rotation and found["c.tps"].unsupported == ["deep", "one"] and all(found[f"{k}"].errors.startswith("not read") for k in ("b.tpproj", "d.tps", "e.tps", "f.tps", "g.toml"))
    assert [tuple(r) for r in pj.audit(pj.parsed(df)).collect()] == [("deep", 1), ("new_thing", 1), ("one", 1)]


def test_relative_paths(spark, made):
    once = pj.with_resolved_paths(made.withColumn("path", F.concat(F.lit("/w/"), "path")).withColumn("excluded_inputs", F.array(F.lit(""), F.lit("/a"), F.lit("s3://b/c"), F.lit("d"))))
    twice = pj.with_resolved_paths(once)
    (r,) = once.where("path = '/w/p/0001'").collect()
    assert r.input_directory == "/w/p/in1" and r.output_directory == "/out" and r.extra_inputs[0] == "/w/p/x/1.png" and r.excluded_inputs == ["", "/a", "s3://b/c", "/w/p/d"]
    assert once.exceptAll(twice).count() == 0


def stray(folder):
    return [str(p.relative_to(folder)) for p in folder.rglob("*") if any(x.startswith(".") for x in p.relative_to(folder).parts)]


def files_of(spark, rows):
    return spark.createDataFrame([(p, bytearray(c) if c is not None else None) for p, c in rows], "path string, content binary").repartition(4)


def test_only_changes_are_written(spark, tmp_path):
    sink.write_files(files_of(spark, [("a/b.txt", b"one"), ("c.txt", b"two"), ("empty", None)]), str(tmp_path))
    old = (tmp_path / "c.txt").stat().st_mtime_ns
    time.sleep(0.02)
    sink.write_files(files_of(spark, [("a/b.txt", b"other"), ("c.txt", b"two"), ("./a/../d", b"three"), ("c.txt", b"two")]), f"file://{tmp_path}")
    assert (tmp_path / "a/b.txt").read_bytes() == b"other" and (tmp_path / "c.txt").stat().st_mtime_ns == old and (tmp_path / "d").read_bytes() == b"three" and (tmp_path / "empty").read_bytes() == b"" and not stray(tmp_path)


@pytest.mark.parametrize("rows", [[("a", b"1"), ("a", b"2")], [("good", b"1"), ("../out", b"2")], [("good", b"1"), ("/abs", b"2")], [("good", b"1"), (None, b"2")]])
def test_a_failed_job_leaves_nothing(spark, tmp_path, rows):
    target = tmp_path / "t"
    target.mkdir()
    with pytest.raises(Exception):
        sink.write_files(files_of(spark, rows), str(target))
    assert os.listdir(target) == [] and os.listdir(tmp_path) == ["t"]


def test_a_task_that_fails_once(spark, tmp_path):
    """What a lost attempt has staged goes with the job; its retry's files are the ones that stay."""
    writer = sink.FileWriter(str(tmp_path), spark.createDataFrame([], "path string, content binary").schema)

    def broken():
        yield from ({"path": f"{k}.txt", "content": b"x"} for k in range(3))
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(broken())
    assert len(stray(tmp_path)) > 0
    writer.commit([writer.write(iter([{"path": f"{k}.txt", "content": b"x"} for k in range(5)])), None])
    assert sorted(os.listdir(tmp_path)) == [f"{k}.txt" for k in range(5)]


def test_slices(spark, tmp_path):
    rows = spark.createDataFrame([("art/sheet.v2.png", r, c, bytearray(b"%d%d" % (r, c))) for r in range(2) for c in range(3)], "image string, row int, column int, content binary")
    sink.write_files(sink.slice_files(rows, F.col("image"), folder="cells/"), str(tmp_path))
    assert sorted(os.listdir(tmp_path / "cells")) == [f"sheet.v2_{r}_{c}.png" for r in range(2) for c in range(3)] and (tmp_path / "cells/sheet.v2_1_2.png").read_bytes() == b"12"
