"""Fingerprints against a plain Python version, and the next document against sorting."""

import hashlib
import re
import struct

import xxhash
from pyspark.sql import functions as F

from quiltwork.llm.fingerprints import FingerprintOptions, compare_with_edits, with_fingerprint


def chain(*values):
    """xxhash64 as Spark chains it: each value is hashed with the hash so far as seed; nulls don't count."""
    seed = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v)
            seed = xxhash.xxh64_intdigest(data, seed=seed)
            seed = seed - (1 << 64) if seed >> 63 else seed
    return seed


def fingerprint(text, options=FingerprintOptions()):
    tokens = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    hashes, seen, found = [chain(w) for w in tokens], {}, []
    for i in range(len(hashes)):
        own = chain(*hashes[i : i + options.k]) >> 31
        found.append((chain(own, (seen.get(own, 0),)) >> 31, i))
        seen[own] = seen.get(own, 0) + 1
    out = []
    for seed in range(options.parts):
        order = sorted((chain(h, (seed,)) >> 31, i) for h, i in found or [(-1, (1 << 31) - 1)])
        out.append(chain(*[h for h, _ in sorted((order[0], order[-1]), key=lambda x: x[1])]) & 0xFFFFFFFF)
    return "".join(f"{x:08x}" for x in out)


def near(a, b):
    return sum(a[i : i + 8] == b[i : i + 8] for i in range(0, len(a), 8)) / (len(a) // 8)


def expected(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, chain(r[1]) if r[0] is None else r[0], r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = fingerprint(t), fingerprint(edited), fingerprint(after)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, near(a, b), near(a, c)))
    return out


def test_brute_force(spark):
    words = "eins two trois cuatro  fünf 六 seven\teight nine\nten".split(" ")
    rows = [(7 * k * k + 3, " ".join(words[(k * j + j * j) % len(words)] for j in range(k))) for k in range(0, 120, 3)]
    rows += [(4, None), (5, ""), (6, "one"), (8, "x " * 300), (9, "x " * 300), (-5, "😀" * 9), (None, "no id here"), (None, "none here"), (None, None), (None, "none here"), (11, "b a"), (11, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnsRenamed({}).selectExpr("*", "1 as fingerprint", "2 as next")
    for options in (FingerprintOptions(), FingerprintOptions(bucket_bytes=900, coarse_buckets=3), FingerprintOptions(bucket_bytes=40)):
        got = [tuple(r) for r in compare_with_edits(docs, options).collect()]
        assert sorted(got, key=str) == sorted(expected(rows), key=str)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert compare_with_edits(empty).collect() == []
    (one,) = compare_with_edits(spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")).collect()
    assert one.near_next == 1.0
    twins = compare_with_edits(spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")).collect()
    assert len(twins) == 3 and {r.near_next for r in twins} == {1.0}


def test_order_matters(spark):
    text = " ".join(f"w{k}" for k in range(400))
    moved = " ".join(f"w{(k + 200) % 400}" for k in range(400))
    other = " ".join(f"v{k}" for k in range(400))
    near_self = near(fingerprint(text), fingerprint(text + " tail"))
    assert near_self > 0.8 > near(fingerprint(text), fingerprint(moved)) > near(fingerprint(text), fingerprint(other)) == 0


def test_all_k_mers_can_be_chosen(spark):
    """Texts that differ in one of many words: the share of equal parts is that of both ends being common and in order."""
    words = [f"w{k}" for k in range(3000)]
    rows = [(0, " ".join(words))]
    for k in range(1, 40):
        own = list(words)
        for j in range(60):
            own[(k * 71 + j * 50) % 3000] = f"x{k}.{j}"
        rows.append((k, " ".join(own)))
    df = with_fingerprint(spark.createDataFrame(rows, "doc_id long, text string"), F.col("text"), "f")
    found = {r.doc_id: r.f for r in df.collect()}
    share = [sum(a == b for a, b in zip(found[0], found[k], strict=True)) / 32 for k in range(1, 40)]
    both, union = 2998 - 180, 2998 + 180  # of k-mers
    assert abs(sum(share) / len(share) - (both / union) ** 2) < 0.05


def test_long_text(spark):
    text = " ".join(f"w{k % 5000}" for k in range(200_000))
    (one,) = compare_with_edits(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert one.n_chars == len(text) and one.fingerprint == fingerprint(text)
