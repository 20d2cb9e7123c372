"""Operators on small cases worked out by hand or by brute force."""

import binascii
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quiltwork.functions import text
from quiltwork.operators import assembly, colour, dedup, flow, geometry, grouping, packing, pairing, render, select


def met(a, b):
    return a[2] < b[2] + b[4] and b[2] < a[2] + a[4] and a[3] < b[3] + b[5] and b[3] < a[3] + a[5]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.integers(1, 30)), max_size=40), st.sampled_from(["short", "long", "area", "bottom", "contact"]), st.booleans(), st.booleans(), st.sampled_from([0, 4]))
def test_free_rectangles_never_overlap(sizes, score, guillotine, rotate, align):
    o = flow.FlowOptions(width=64, height=48, border=1, score=score, rotate=rotate, align=align)
    items = [(f"s{k}", w, h) for k, (w, h) in enumerate(sizes)]
    placed = flow.free_rectangles(items, o, guillotine)
    assert sorted(p[0] for p in placed) == sorted(i[0] for i in items)
    for k, a in enumerate(placed):
        assert a[2] >= 1 and a[3] >= 1 and a[2] + a[4] <= 63 and a[3] + a[5] <= 47
        assert not align or a[2] % align == 0 and a[3] % align == 0
        assert not any(a[1] == b[1] and met(a, b) for b in placed[:k])


def test_rotation_saves_a_page():
    bars = [(f"w{k}", 8, 4) for k in range(1)] + [("h", 4, 8)]
    pages = lambda rotate: 1 + max(p[1] for p in flow.free_rectangles(bars, flow.FlowOptions(width=8, height=8, rotate=rotate), False))
    assert pages(True) == 1 and pages(False) == 2


def test_items_that_fit_nowhere_are_named():
    for guillotine in (False, True):
        with pytest.raises(ValueError, match="huge"):
            flow.free_rectangles([("huge", 64, 64)], flow.FlowOptions(width=32, height=32), guillotine)
    with pytest.raises(ValueError, match="huge"):
        flow.rows_of([("a", 4, 4), ("huge", 64, 4)], flow.FlowOptions(width=32, height=32))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 20), st.integers(1, 20)), max_size=25))
def test_the_lowest_place_is_the_one_that_a_search_of_all_places_finds(sizes):
    """Without turns, the bottom score takes the first place, by lower edge and then by right edge, that is free on the newest page that has one."""
    o = flow.FlowOptions(width=40, height=32, score="bottom", rotate=False)
    pages, want = [], []
    for k, (w, h) in sorted(enumerate(sizes), key=lambda s: -s[1][0] * s[1][1]):
        for n in [*range(len(pages) - 1, -1, -1), len(pages)]:
            if n == len(pages):
                pages.append(np.zeros((32, 40), bool))
            spots = [(y, x) for y in range(33 - h) for x in range(41 - w) if not pages[n][y : y + h, x : x + w].any()]
            if spots:
                y, x = min(spots)
                pages[n][y : y + h, x : x + w] = True
                want.append((f"s{k}", n, x, y))
                break
    assert [p[:4] for p in flow.free_rectangles([(f"s{k}", w, h) for k, (w, h) in enumerate(sizes)], o, False)] == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 20), st.integers(1, 20)), min_size=1, max_size=20), st.booleans(), st.sampled_from([0, 3]))
def test_free_rectangles_are_what_is_left(sizes, guillotine, align):
    """Cuts tile what is free; carved rectangles cover it, are maximal and none lies within another."""
    page, taken = flow.Page(flow.FlowOptions(width=50, height=40, align=align), guillotine), np.zeros((40, 50), int)
    for w, h in sizes:
        if found := page.spot(w, h):
            page.take(found[0], found[1])
            x, y, tw, th = found[1]
            assert not taken[y : y + th, x : x + tw].any()
            taken[y : y + th, x : x + tw] = 1
    free = np.zeros((40, 50), int)
    for x, y, w, h in page.free:
        assert not taken[y : y + h, x : x + w].any()
        free[y : y + h, x : x + w] += 1
        if not guillotine:
            assert all(taken[a:b, c:d].any() or not (0 <= c and d <= 50 and 0 <= a and b <= 40) for a, b, c, d in ((y, y + h, x - 1, x), (y, y + h, x + w, x + w + 1), (y - 1, y, x, x + w), (y + h, y + h + 1, x, x + w)))
    assert ((free > 0) == (taken == 0)).all() and (not guillotine or free.max() <= 1)


def test_the_larger_tile_decides_a_cut():
    free, item = np.array([0, 0, 10, 20]), np.array([0, 0, 4, 5])
    page = flow.Page(flow.FlowOptions(width=10, height=20), True)
    page.take(0, item)
    assert page.free.tolist() == [[0, 5, 10, 15], [4, 0, 6, 5]]  # 150 by rows beats 120 by columns
    assert flow.strips(free, item, True).tolist() == [[0, 5, 4, 15], [4, 0, 6, 20]]


def test_the_best_of_all_scores_and_the_size_search():
    r = random.Random(5)
    rows = [(k, f"s{k}", r.randrange(3, 30), r.randrange(3, 30)) for k in range(60)]
    o = flow.FlowOptions(width=100, height=90, padding=0)
    tries = [flow.placed_as(rows, "maxrects", flow.FlowOptions(width=100, height=90, padding=0, score=s)) for s in flow.SCORES]
    size = lambda p: (len(flow.extents(p)), sum(a * b for a, b in flow.extents(p).values()))
    best = flow.placed_as(rows, "maxrects", flow.replace(o, score="best"))
    assert size(best) == min(map(size, tries))
    for constraint, fits in (("any", lambda v: True), ("x4", lambda v: v % 4 == 0), ("pot", lambda v: v & (v - 1) == 0)):
        own = flow.smallest(rows, "maxrects", flow.FlowOptions(width=1024, height=1024, padding=0, constraint=constraint), 4)
        assert fits(own.width) and fits(own.height) and own.width * own.height < 1024 * 1024
        placed = flow.placed_as(rows, "maxrects", own, 1)
        assert placed and flow.placed_as(rows, "maxrects", flow.replace(own, height=own.height - max(1, own.step(1)) if constraint != "pot" else own.height // 2), 1) is None


def test_whole_placement(spark):
    r = random.Random(6)
    rows = [(f"f{k % 3}", k, f"s{k}", r.randrange(3, 30), r.randrange(3, 30)) for k in range(60)]
    df = spark.createDataFrame(rows, "folder string, ord long, id string, w long, h long")
    for mode in ("fast", "good"):
        for found in (flow.pack_pages(df, "folder", how, flow.FlowOptions(width=200, height=200, score="best", constraint="x4"), mode).collect() for how in ("maxrects", "guillotine", "rows")):
            assert sorted(x.id for x in found) == sorted(x[2] for x in rows)
            assert all(x.x + x.frame_w <= x.page_w <= 200 and x.y + x.frame_h <= x.page_h <= 200 and x.page_w % 4 == 0 for x in found)
            for k, a in enumerate(found):
                assert not any(a.folder == b.folder and a.page == b.page and met(a[1:], b[1:]) for b in found[:k])
    assert flow.pack_pages(df.limit(0), "folder").collect() == []
    with pytest.raises(Exception, match="s3"):
        flow.pack_pages(df.where("id = 's3'"), "folder", options=flow.FlowOptions(width=4, height=4)).collect()
    with pytest.raises(Exception, match="no room"):
        flow.pack_pages(df, "folder", options=flow.FlowOptions(width=16, height=16, border=8)).collect()


def test_rows_wrap_and_turn_pages():
    placed = flow.rows_of([(str(k), 10, 6) for k in range(7)], flow.FlowOptions(width=20, height=12))
    assert [(p[1], p[2], p[3]) for p in placed] == [(0, 0, 0), (0, 10, 0), (0, 0, 6), (0, 10, 6), (1, 0, 0), (1, 10, 0), (1, 0, 6)]


def test_orders_keep_ties():
    rows = [(1, "b", 2, 9), (2, "a", 2, 1), (3, "c", 5, 1)]
    names = lambda **o: [i[0] for i in flow.ordered(rows, flow.FlowOptions(**o))]
    assert names() == ["a", "b", "c"] and names(order="width") == ["b", "a", "c"] and names(order="width", descending=True) == ["c", "b", "a"]


def test_grid_of_null_and_huge_cells(spark):
    df = spark.createDataFrame([("a", 4, 4), ("b", 2, 9), ("c", 2, 9)], "id string, w long, h long")
    rows = {r.id: (r.page, r.x, r.y) for r in packing.grid(df, packing.PageOptions(width=12, height=24)).collect()}
    assert rows == {"c": (0, 0, 0), "b": (0, 6, 0), "a": (0, 0, 11)}
    assert all(r.page is None for r in packing.grid(df, packing.PageOptions(width=4, height=4)).collect())
    assert packing.grid(df.limit(0)).collect() == []


def test_overlaps_against_brute_force(spark):
    r = random.Random(4)
    rows = [(r.randrange(3), k, r.randrange(200), r.randrange(200), r.randrange(1, 90), r.randrange(1, 90)) for k in range(120)]
    df = spark.createDataFrame(rows, "page long, id long, x long, y long, frame_w long, frame_h long")
    got = {tuple(x) for x in packing.overlaps(df, ["page"], cell=32).collect()}
    want = {(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[2] < b[2] + b[4] and b[2] < a[2] + a[4] and a[3] < b[3] + b[5] and b[3] < a[3] + a[5]}
    assert got == want
    assert len(packing.overlaps(df, ["page"], cell=32).collect()) == len(want)


def test_slices_of_sheets(spark):
    sheet = spark.createDataFrame([(68, 36), (10, 10)], "w long, h long")
    fixed = packing.slices(sheet, "w", "h", 4, 4, cell=(16, 16)).where("w = 68").orderBy("row", "col").collect()
    assert [(r.x, r.y) for r in fixed if r.row == 0] == [(4, 4), (24, 4), (44, 4)] and all(r.x + 16 <= 68 for r in fixed)
    cut = packing.slices(spark.createDataFrame([(64, 32)], "w long, h long"), "w", "h", 0, 0, cell=(30, 30)).collect()
    assert len(cut) == 2


def test_aliases(spark):
    rows = [(1, "x"), (2, None), (3, "x"), (4, None), (5, ""), (6, "x")]
    found = dedup.aliases(spark.createDataFrame(rows, "id long, c string").withColumn("ord", F.col("id")), "c", "id", "ord")
    assert {r.id: r.alias_of for r in found.collect()} == {1: None, 2: None, 3: 1, 4: 2, 5: None, 6: 1}
    summary = dedup.alias_summary(found, "id").first()
    assert (summary["items"], summary.owners, summary.aliases, summary.shared) == (6, 3, 3, 2)


def test_pairs(spark):
    items = spark.createDataFrame([("hero/idle", "idle"), ("idle", "idle"), ("coin", "coin")], "key string, name string")
    normals = spark.createDataFrame([("hero/idle", "idle", "n1"), ("x/coin", "coin", "n2"), ("y/bar", "bar", "n3"), ("hero/idle", "idle", "n0")], "key string, name string, path string")
    paired = pairing.pair(items, normals, "key", "name", "path")
    assert {r.key: r.companion for r in paired.collect()} == {"hero/idle": "n0", "idle": None, "coin": "n2"}
    assert {r.path for r in pairing.orphans(normals, paired, "path").collect()} == {"n1", "n3"}


def test_names(spark):
    df = spark.createDataFrame([(0,), (2,)], "n long")
    pick = lambda base, suffix="": [r[0] for r in df.select(text.expand_name(base, F.col("n"), F.lit(suffix))).collect()]
    assert pick("sheet") == ["sheet", "sheet_2"] and pick("sheet{n1}") == ["sheet1", "sheet3"] and pick("{n}{v}x", "@2x") == ["0@2xx", "2@2xx"] and pick("a{v}b", "-hd") == ["a-hdb", "a_2-hdb"]
    one = lambda c, *v: spark.createDataFrame([v], ", ".join(f"c{k} string" for k in range(len(v)))).select(c).first()[0]
    assert one(text.relative_id(F.col("c0"), ["/in", "/in/sub"]), "/in/sub/hero.v2.png") == "sub/hero.v2"
    assert one(text.relative_id(F.col("c0"), ["/x"]), "/in/.hidden") == ".hidden"
    assert one(text.with_extension(F.col("c0"), "png"), "A.PNG") == "A.PNG"
    assert one(text.identifier(F.col("c0")), "9 lives!") == "_9_lives_" and one(text.identifier(F.col("c0")), "") == "_"
    assert one(text.short_number(F.col("c0")), "2.50") == "2.5" and one(text.short_number(F.col("c0")), "3") == "3"
    assert [text.variant_suffix(s) for s in (1.0, 2.0, 0.5, 0.25, 1 / 3, 1.5)] == ["", "@2x", "-hd", "-lhd", "-sd", "@1.5x"]


def test_globs(spark):
    df = spark.createDataFrame([("a/b.png",), ("b.PNG",), (None,), ("x\ny",)], "p string")
    keep = lambda *p: {r.p for r in select.without_ignored(df, "p", list(p)).collect()}
    assert keep("*.png") == {"b.PNG", None, "x\ny"} and keep("?.png") == {"b.PNG", None, "x\ny"} and keep("x*y") == {"a/b.png", "b.PNG", None} and keep("[a]") == {"a/b.png", "b.PNG", None, "x\ny"}
    assert select.included(df, "p", " ").count() == 4


def test_animations(spark):
    df = spark.createDataFrame([("walk_10", 1), ("walk_2", 2), ("walk-1", 3), ("hero", 4), ("_1", 5), ("_2", 6), ("run1", 7), ("run2", 8)], "id string, ord long")
    base, number = text.frame_suffix(F.col("id"))
    assert {r.base: r.frames for r in grouping.animations(df, base, number, "id", "ord").collect()} == {"walk_": ["walk_2", "walk_10"], "_": ["_1", "_2"]}


def test_contours():
    square = np.zeros((6, 7), bool)
    square[1:5, 2:6] = True
    square[2:4, 3:5] = False
    loops = geometry.outline(square, 0.0)
    assert sorted(hole for _, hole in loops) == [False, True]
    corners = geometry.simplified([(0, 0), (1, 0.01), (2, 0), (2, 2)], 0.1)
    assert corners == [(0, 0), (2, 0), (2, 2)]
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]
    cut = geometry.triangles(ring)
    area = lambda a, b, c: abs((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])) / 2
    assert len(cut) == 3 and abs(sum(area(*(ring[k] for k in t)) for t in cut) - 10.0) < 1e-9


def test_dither_keeps_levels_and_mean(spark):
    image = np.tile(np.arange(0, 256, 4, dtype=np.uint8), (32, 1))
    out = colour.diffused(image[None, :, :, None], 4)[0, :, :, 0]
    assert set(np.unique(out)) <= {v * 17 for v in range(16)} and abs(out.mean() - image.mean()) < 2
    df = spark.createDataFrame([(bytearray(64), 4), (None, 4), (bytearray(5), 4)], "image binary, width int")
    assert [None if r.image is None else len(r.image) for r in colour.dithered(df, "image", "width").collect()] == [64, None, 5]


def test_documents_escape(spark):
    df = spark.createDataFrame([('a"<&', 0, 1, 2, 3, 4)], "id string, page long, x long, y long, frame_w long, frame_h long")
    assert render.documents_of(df, "json", ["page"]).first().document == '{"frames":[{"filename":"a\\"<&","frame":{"x":1,"y":2,"w":3,"h":4}}]}'
    assert 'name="a&quot;&lt;&amp;"' in render.documents_of(df, "xml", ["page"]).first().document


def test_difference_counts(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "v long")
    b = spark.createDataFrame([(1,), (3,), (None,), (None,)], "v long")
    assert {(r.v, r.change, r.times) for r in select.difference(a, b).collect()} == {(1, "removed", 1), (2, "removed", 1), (3, "added", 1), (None, "added", 1)}


def test_median_cut():
    counts = [((0, 0), 10), ((1, 0), 10), ((200, 5), 1), ((210, 5), 1)]
    assert colour.median_cut(counts, 2) == [(0, 0), (70, 2)] or len(colour.median_cut(counts, 2)) == 2
    assert colour.median_cut(counts, 10) == [c for c, _ in counts]
    assert colour.median_cut([], 4) == [] and colour.median_cut([((7, 7), 3)], 4) == [(7, 7)]


def test_unique_names_cascade(spark):
    df = spark.createDataFrame([("g", 1, "a"), ("g", 2, "a_"), ("g", 3, "a"), ("g", 4, "a"), ("h", 1, "a")], "g string, o long, n string")
    assert [r.n for r in grouping.unique_names(df, "g", "n", "o").where("g = 'g'").orderBy("o").collect()] == ["a", "a_", "a__", "a___"]


def test_own_family(spark):
    render.register("count", lambda i: F.concat(F.lit("#"), i), before="begin\n", after="\nend")
    df = spark.createDataFrame([("b", 0, 1, 2, 3, 4), ("a", 0, 1, 2, 3, 4)], "id string, page long, x long, y long, frame_w long, frame_h long")
    assert render.documents_of(df, "count", ["page"]).first().document == "begin\n#a\n#b\nend"


def test_configurations(spark):
    from quiltwork.plans.config import PackConfig, advice, configurations

    assert PackConfig().problems() == [] and "the fixed width exceeds the largest" in PackConfig(fixed_width=9999).problems() and len(PackConfig(scale=0, padding=-1, trim_threshold=0).problems()) == 3
    rows = configurations(spark, [PackConfig(), PackConfig(extrude=3, scale=0.5, padding=0, max_width=8192, data_format="css")]).select(advice(["css"]).alias("a")).collect()
    assert rows[0].a == [] and len(rows[1].a) == 5


def test_parsing(spark):
    df = spark.createDataFrame([("#FFF",), ("10203040",), ("12345",), (None,), (" Yes ",), ("nope",)], "t string")
    rows = df.select(text.colour_channels(F.col("t")).alias("c"), text.truth(F.col("t")).alias("b")).collect()
    assert [r.c and tuple(r.c) for r in rows] == [(255, 255, 255, 255), (16, 32, 48, 64), None, None, None, None] and [r.b for r in rows] == [None, None, None, None, True, None]


def test_sums_before_without_one_window(spark):
    names = ["", "a", "ab", "abcd", "abcde", "abcdf", "b", "é", None]
    rows = [(n, k + 1) for k, n in enumerate(names)]
    got = {r.k: r.s for r in grouping.summed_before(spark.createDataFrame(rows, "k string, v long"), "k", F.col("v"), "s").collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or ""))
    assert got == {n: sum(v for _, v in order[:i]) for i, (n, _) in enumerate(order)}


def test_crc16(spark):
    rows = [bytes(range(k)) for k in (0, 1, 9, 200)] + [b"123456789"]
    found = spark.createDataFrame([(bytearray(b),) for b in rows], "b binary").select("b", assembly.crc16(F.col("b")).alias("c")).collect()
    assert all(r.c == binascii.crc_hqx(bytes(r.b), 0) for r in found)


def test_paths(spark):
    cases = {"/a/./b//c/": "/a/b/c", "../x/../../y": "../../y", "/../a": "/a", "": ".", "a/..": ".", "/": "/", "./a b": "a b"}
    df = spark.createDataFrame([(c,) for c in cases], "p string")
    assert {r.p: r.c for r in df.select("p", assembly.canonical_path(F.col("p")).alias("c")).collect()} == cases
    order = assembly.in_path_order(spark.createDataFrame([(k, p) for k, p in enumerate(["b", "a/b", "a b/c", "a", "a/b", "a/a/z"])], "k long, p string"), "p", "k")
    assert [r.k for r in order.orderBy("rank").collect()] == [3, 5, 1, 4, 2, 0]


def test_four_times_is_twice_twice(spark):
    r = random.Random(9)
    rows = [(1, x, y, r.randrange(3)) for x in range(5) for y in range(4)]
    df = spark.createDataFrame(rows, "i long, x long, y long, v long")
    found = {(p.x, p.y): p.v for p in assembly.art(df, ["i"], (5, 4), "v", "scale4").collect()}
    assert len(found) == 16 * 20 and {v for v in found.values()} <= {0, 1, 2}
    flat = assembly.art(df.withColumn("v", F.lit(7)), ["i"], (5, 4), "v", "scale3").collect()
    assert len(flat) == 9 * 20 and {p.v for p in flat} == {7}


def test_dithering_against_one_pixel_after_another():
    r = np.random.default_rng(8)
    art = r.integers(0, 256, (3, 6, 7, 4), dtype=np.uint8)
    for kernel in ("none", "nearest", "linear", "floyd-steinberg", "floyd-steinberg-alpha", "atkinson", "atkinson-alpha"):
        shares, whole = colour.KERNELS[kernel.removesuffix("-alpha")]
        for bits in (1, 2, 4, 5):
            step = np.float32(255) / np.float32(2**bits - 1)
            for image, got in zip(art, colour.diffused(art, bits, kernel), strict=True):
                work = image.astype(np.float32)
                for y in range(6):
                    for x in range(7):
                        for c in range(4):
                            old = work[y, x, c]
                            work[y, x, c] = np.clip(np.floor(old / step + np.float32(0.5)), 0, 2**bits - 1) * step
                            for dx, dy, share in shares if c < 3 or kernel.endswith("-alpha") else []:
                                if 0 <= x + dx < 7 and y + dy < 6:
                                    work[y + dy, x + dx, c] += (old - work[y, x, c]) * np.float32(share / whole)
                assert (np.clip(np.floor(work + np.float32(0.5)), 0, 255).astype(np.uint8) == got).all()


@pytest.mark.parametrize("guillotine", [False, True])
def test_pages_that_have_no_room_for_a_size_are_not_asked_again(monkeypatch, guillotine):
    asked, spot = [], flow.Page.spot
    monkeypatch.setattr(flow.Page, "spot", lambda page, w, h: asked.append(1) or spot(page, w, h))
    items = [(str(k), *((9, 9), (8, 10))[k % 2]) for k in range(400)]
    placed = flow.free_rectangles(items, flow.FlowOptions(width=20, height=20), guillotine)
    pages = 1 + max(p[1] for p in placed)
    assert pages >= 100 and len(asked) <= len(items) + 3 * pages


def test_contact_is_the_length_of_shared_sides():
    page = flow.Page(flow.FlowOptions(width=20, height=20, score="contact"), False)
    page.take(0, (0, 0, 5, 4))
    page.take(0, (9, 2, 3, 6))
    assert [page.contact(*at) for at in ((5, 0, 4, 4), (0, 4, 5, 3), (12, 7, 8, 13))] == [4 + 2 + 4, 5 + 3, 1 + 13 + 8]


def test_a_size_is_tried_once_and_only_until_a_score_holds_all(monkeypatch):
    asked, place = [], flow.free_rectangles
    monkeypatch.setattr(flow, "free_rectangles", lambda items, o, *more: asked.append((o.width, o.height, o.score)) or place(items, o, *more))
    rows = [(k, f"s{k}", 8, 8) for k in range(16)]
    own = flow.smallest(rows, "maxrects", flow.FlowOptions(width=64, height=64, padding=0, score="best"), 4)
    assert own.width * own.height == 1024 and len(asked) == len(set(asked))
    assert [a[2] for a in asked if a[:2] == (64, 64)] == ["short"]


def test_the_best_order_holds_one_placement():
    import tracemalloc

    rows = [(k, f"s{k}", k % 37 + 1, k % 50 + 1) for k in range(4000)]
    peaks = []
    for order in ("area", "best"):
        tracemalloc.start()
        found = flow.placed_as(rows, "rows", flow.FlowOptions(order=order))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert len(found) == 4000 and peaks[1] < 2 * peaks[0]


@pytest.mark.parametrize("score", flow.SCORES)
@pytest.mark.parametrize("rotate,align,border", [(True, 0, 0), (False, 0, 1), (True, 3, 2)])
def test_pages_of_very_many_free_rectangles_place_the_same(monkeypatch, score, rotate, align, border):
    r = random.Random(f"{score} {rotate} {align}")
    o = flow.FlowOptions(width=150, height=131, score=score, rotate=rotate, align=align, border=border)
    for _ in range(3):
        items = [(str(k), r.randrange(1, 30), r.randrange(1, 100 if k % 9 == 0 else 30)) for k in range(250)]
        found = []
        for many in (10**9, 5):
            monkeypatch.setattr(flow, "MANY", many)
            found.append((flow.free_rectangles(items, o, False), flow.free_rectangles(items, o, False, 1)))
        assert found[0] == found[1]
        page = flow.Page(o, False)
        for _, w, h in items[:40]:
            if at := page.spot(w, h):
                page.take(*at[:2])
        listed = flow.Page(o, False)
        monkeypatch.setattr(flow, "MANY", 10**9)
        for _, w, h in items[:40]:
            if at := listed.spot(w, h):
                listed.take(*at[:2])
        assert page.wide and page.rects == listed.rects


def test_groups_of_a_size_search_are_dealt_out(spark):
    df = spark.range(80).select((F.col("id") % 20).cast("string").alias("folder"), F.col("id").alias("ord"), F.concat(F.lit("s"), "id").alias("id"), F.lit(3).cast("long").alias("w"), (F.col("id") % 7 + 1).alias("h"))
    assert flow.pack_pages(df, "folder").select(F.spark_partition_id()).distinct().count() > 4


def test_the_size_search_takes_all_scores(spark, monkeypatch):
    from quiltwork.plans import catalogue

    seen = []
    monkeypatch.setattr(flow, "pack_pages", lambda df, group, how, options: seen.append(options.score))
    catalogue.pack_search(spark, "/root/testdata/sf0.001")
    assert seen == ["best"]
