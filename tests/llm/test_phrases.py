import hashlib
import random
import re
from collections import Counter

import numpy as np

from quiltwork.llm import phrase_automata
from quiltwork.llm.phrase_automata import PhraseOptions, locate, remove_phrases


def brute(rows, n=35):
    docs = [[x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x] for _, t in rows]
    seen = Counter(tuple(w[i : i + n]) for w in docs for i in range(len(w) - n + 1))
    out = []
    for (d, _), w in zip(rows, docs, strict=True):
        gone = set()
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone.update(range(i, i + n))
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["é", "日本", "\x1c", "a b", " "]
    text = lambda n: [r.choice(words) for _ in range(n)]
    shared = [text(n) for n in (34, 35, 36, 60, 120)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (5, "x " * 34), (6, "y " * 35), (7, "z " * 36), (8, "a b " * 300), (9, " ".join(text(6000)))]
    for d in range(10, 90):
        w = text(r.randrange(0, 90))
        for _ in range(r.randrange(3)):
            s = r.choice(shared)
            at, cut = r.randrange(len(w) + 1), r.randrange(0, max(1, len(s) - 30))
            w[at:at] = s[cut:] if r.random() < 0.5 else s
        rows.append((d, r.choice([" ", "\n", " \t"]).join(w)))
    return rows + [(200, rows[20][1]), (201, rows[20][1]), (9, rows[8][1]), (300, "x " * 34), (None, rows[30][1])]


def test_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as tkey", "2 as hashes", "3 as first").repartition(5)
        assert sorted((tuple(x) for x in remove_phrases(df).collect()), key=str) == brute(rows)
    small = [(i, t) for i, t in corpus(3)]
    got = remove_phrases(spark.createDataFrame(small, "doc_id long, text string"), PhraseOptions(window=7, anchor=3)).collect()
    assert sorted((tuple(x) for x in got), key=str) == brute(small, 7)


def test_empty(spark):
    assert remove_phrases(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_shard_against_brute_force():
    o, r = PhraseOptions(window=5, anchor=2), random.Random(4)
    for _ in range(40):
        words = ["a", "b", "ab", "é", "x"]
        contents = list({" ".join(r.choice(words) for _ in range(r.randrange(1, 25))).encode() for _ in range(12)})
        weight = np.array([r.choice([1, 1, 1, 2]) for _ in contents])
        twice = np.array([r.random() < 0.1 for _ in contents])
        split = [c.split() for c in contents]
        seen = Counter()
        for w, n, t in zip(split, weight.tolist(), twice, strict=True):
            for i in range(len(w) - 4):
                seen[tuple(w[i : i + 5])] += 2 if t else n
        for w, found in zip(split, locate(contents, weight, twice, o), strict=True):
            gone = {k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
            assert {k for a, b in found.tolist() for k in range(a, b)} == gone


def test_the_automaton_decides(monkeypatch):
    contents = [b"a b c d e f g h", b"x a b c d e f y"]
    o = PhraseOptions(window=5, anchor=2)
    assert [f.tolist() for f in locate(contents, np.array([1, 1]), np.zeros(2, bool), o)] == [[[0, 6]], [[1, 7]]]
    monkeypatch.setattr(phrase_automata.Passages, "found_in", lambda *_: [])
    assert [f.tolist() for f in locate(contents, np.array([1, 1]), np.zeros(2, bool), o)] == [[], []]
