import random
import re

import numpy as np
import pytest

from quiltwork.llm.hyperminhash import EMPTY, NearOptions, alike, estimate, near_duplicates, packed_texts, prefix, shingle_sets, sketch, without_near_duplicates


def brute(rows, k, percent):
    sets = []
    for _, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    part = list(range(len(rows)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                part[b] = a
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)], least[root(i)] == d) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("k", [2, 5])
def test_brute_force(spark, k):
    r = random.Random(k)
    words = [f"w{i}" for i in range(300)]
    rows = [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "ONE"), (1005, "one two"), (1006, "È two"), (1007, "è two")]
    for g in range(12):
        base = [r.choice(words) for _ in range(r.choice([6, 12, 40, 150, 400]))]
        for c in range(r.choice([1, 3, 14])):
            w = list(base)
            for _ in range(r.randrange(0, max(2, len(w) // 9))):
                w[r.randrange(len(w))] = r.choice(words)
            rows.append((r.randrange(900) * 1000 + g * 20 + c, r.choice([" ", "\n", "\t "]).join(w).upper() if r.random() < 0.3 else " ".join(w)))
    rows = list({d: (d, t) for d, t in rows}.values())
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "2 as key", "3 as id")
    got = sorted(tuple(x) for x in near_duplicates(df, NearOptions(shingle=k)).collect())
    assert got == brute(rows, k, 80)
    # Without rounds, and in small blocks, all is compared at the end.
    again = near_duplicates(df, NearOptions(shingle=k, rounds=0, block=3))
    assert sorted(tuple(x) for x in again.collect()) == got


def test_edges(spark):
    schema = "doc_id long, text string"
    assert near_duplicates(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, "a b"), (3, "a b"), (3, "a b"), (2, "a b"), (3, "c d e f g")]
    got = sorted((tuple(x) for x in near_duplicates(spark.createDataFrame(rows, schema), NearOptions(shingle=2)).collect()), key=str)
    assert got == sorted([(None, 1, None, True), (3, 1, 2, False), (3, 1, 2, False), (2, 1, 2, True), (3, 4, 3, True)], key=str)


@pytest.mark.parametrize("unlike", range(4))
def test_ids_with_several_texts_keep_their_links(spark, unlike):
    r = random.Random(unlike)
    one, two = ([f"{c}{r.randrange(1000)}" for _ in range(200)] for c in "ab")
    edited = [*one[:-1], "other"]
    rows = [(3, " ".join(one)), (5, " ".join(edited)), (5, " ".join(two)), (7, " ".join([*two[:-1], "other"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x.doc_id, x.component_id, x.kept) for x in near_duplicates(df).collect())
    assert got == [(3, 3, True), (5, 3, False), (5, 5, True), (7, 5, False)]
    assert sorted(tuple(x) for x in without_near_duplicates(df).collect()) == sorted([rows[0], rows[2]])


def test_one_of_each_group_stays(spark):
    rows = [(1, "a b c d e f", 7), (2, "a b c d e f", 8), (3, None, 9), (4, "", 1), (None, "a b c d e f", 2), (5, "one two", 3), (5, "three four", 4), (5, "three four", 4), (2, "x y z", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tkey int")
    got = sorted((tuple(r) for r in without_near_duplicates(df).collect()), key=str)
    assert got == sorted(set(rows) - {rows[1]}, key=str)


def test_sketch_keeps_zeros_and_mantissa():
    o = NearOptions()
    for s in shingle_sets(["a b c d e f g h i j k l m n o p"], 2):
        got = sketch(s, o)
        for value in s.tolist():
            assert got[value >> 57] != 0xFFFF
        least = {}
        for value in s.tolist():
            least.setdefault(value >> 57, value)
        for bucket, value in least.items():
            rest = format(((value << 7) & ((1 << 64) - 1)) | 127, "064b")
            zeros = len(rest) - len(rest.lstrip("0"))
            assert got[bucket] == (zeros << 10) | int((rest[zeros + 1 :] + "0" * 64)[:10], 2)


def test_pairs_at_the_threshold_are_found():
    """Measured recall: pairs whose similarity is 0.8 or just above, of every size, meet in a band or a prefix and pass the estimate."""
    o, r, missed, tried = NearOptions(), np.random.default_rng(3), 0, 0
    for union in [5, 6, 10, 15, 16, 17, 20, 21, 25, 40, 100, 400]:
        both = -(-4 * union // 5)
        for _ in range(1500):
            every = r.integers(0, 1 << 64, union, dtype=np.uint64)
            cut = r.integers(both, union + 1)
            one, two = np.sort(np.append(every[:both], every[both:cut])), np.sort(np.append(every[:both], every[cut:]))
            a, b = sketch(one, o), sketch(two, o)
            same = ((a == b).reshape(-1, o.band).all(axis=1) & (a != EMPTY).reshape(-1, o.band).any(axis=1)).any()
            met = same and (estimate(a[None], b[None], o)[0] >= o.least_estimate or max(len(one), len(two)) <= o.small)
            met = met or len(np.intersect1d(prefix(one, o), prefix(two, o))) > 0
            missed, tried = missed + (not met), tried + 1
            if max(len(one), len(two)) <= o.small:
                assert len(np.intersect1d(prefix(one, o), prefix(two, o)))
    assert missed == 0, (missed, tried)


def test_a_piece_sends_no_more_links_than_join_it(spark):
    r, words = random.Random(2), [f"w{i}" for i in range(60)]
    texts = []
    for k in range(80):
        w = list(words)
        w[r.randrange(60)] = f"x{k}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame([(k, k, t) for k, t in enumerate(texts)], "doc_id long, tkey long, text string")
    o = NearOptions(shingle=2, block=40, least_estimate=0.0)
    rows = [(k, 7 * (o.many + 1) + o.many, k, len(texts), len(s), bytearray(np.full(o.registers, EMPTY - 1 - k, np.uint16).tobytes())) for k, s in enumerate(shingle_sets(texts, 2))]
    members = spark.createDataFrame(rows, "id long, band long, c long, m long, n long, registers binary")
    links = alike(members.select("id", "band", "c", "m"), members, o, packed_texts(docs).selectExpr("doc_id as id", "packed")).collect()
    pieces = 3  # two blocks
    assert 79 <= len(links) <= pieces * 79
