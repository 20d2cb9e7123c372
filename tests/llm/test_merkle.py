"""The manifest against plain trees of lists."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from quiltwork.llm.merkle import ManifestOptions, manifest

SHAPE = "doc_id long, source string, lang string, n_chars long, text string, node string, tree int, pos string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """The root, and of each node the siblings' (left, right) up to it."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = k // 16 * 16
            paths[i].append(("".join(nodes[run:k]), "".join(nodes[k + 1 : run + 16])))
            at[i] = k // 16
        nodes = [h("".join(nodes[k : k + 16])) for k in range(0, len(nodes), 16)]
    return nodes[0], paths


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(*r[:5]), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources}
    root, tops = climb([trees[s][0] for s in sources]) if sources else ("", [])
    out = []
    for s, top in zip(sources, tops):
        for x, own in zip(sorted(by[s], key=lambda x: x[:3]), trees[s][1]):
            r, path = x[3], own + top
            node = x[2]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = None if r[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
                node = leaf(*r[:4], text)
            for a, b in path:
                node = h(a + node + b)
            out.append((r[0], x[2], trees[s][0], root, h("".join(a + b for a, b in path)), node, node == root))
    return sorted(out, key=str)


def rows_of():
    rows = [(k * 7 % 5000, f"s{k % 3}" if k % 2 else "hot", "en" if k % 5 else None, k if k % 4 else None, None if k % 11 == 0 else f"Text {k} ÄÖ ß 中" * (k % 3)) for k in range(700)]
    rows += [(None, "hot", None, None, None), (None, "hot", "de", 1, "a"), (None, None, "de", 1, "a"), (3, "hot", "x", 1, "Twice"), (3, "hot", "x", 1, "Twice"), (3, "hot", "x", 2, "Other"), (-9, "", "x", 1, ""), (8, "é", "x", 1, "A" * 100_000), (5, "alone", None, 2, "One")]
    rows += [(10_000 + k, f"many{k:03}", "en", 1, "Small") for k in range(40)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows_of()], SHAPE).repartition(6)


@pytest.mark.parametrize("options", [ManifestOptions(), ManifestOptions(16, 1, 8), ManifestOptions(16, 2, 30)])
def test_against_trees_of_lists(docs, options):
    """Also with blocks and top trees so small that blocks of blocks, and sources, are reduced in several rounds."""
    got = manifest(docs, options)
    assert got.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows == brute(rows_of()) and 0 < sum(not r[-1] for r in rows) < len(rows) / 5


def test_nothing_and_one(spark, docs):
    assert manifest(docs.where("false")).count() == 0
    (one,) = manifest(docs.where("doc_id = 5 and source = 'alone'")).collect()
    assert one.leaf == one.subroot == one.root == leaf(5, "alone", None, 2, "One") and one.proof_sha256 == h("")


def test_large_ids_beside_nulls(spark):
    rows = [(2**53 + 1, "s", None, None, "a"), (None, "s", None, None, "b"), (2**53 + 2, "s", None, None, "c")]
    got = manifest(spark.createDataFrame([(*r, "", 0, "") for r in rows], SHAPE))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_every_change_shows(docs):
    """A changed value, a row less or more, all change the root."""
    roots = {manifest(df).select("root").first()[0] for df in (docs, docs.where("doc_id != 14"), docs.withColumn("lang", F.when(F.col("doc_id") == 21, "fr").otherwise(F.col("lang"))), docs.unionByName(docs.where("doc_id = 28")))}
    assert len(roots) == 4
