import numpy as np
from pyspark.sql import functions as F

from quiltwork.llm.hash_index import IndexOptions, nearest


def brute(rows, k):
    out = {}
    for q, v in rows:
        if q % 20 == 0:
            scored = sorted((-float(np.dot(np.array(v, float), np.array(w, float))), i) for i, w in rows if i != q)
            out[q] = [i for _, i in scored[:k]]
    return out


def test_recall_and_order(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(np.float32(x)) for x in rng.standard_normal(24) * (1 + i % 3)]) for i in range(1500)]
    rows[41] = (41, rows[43][1])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1)).withColumn("score", F.lit(2))
    want = brute(rows, 20)
    found = {}
    for r in nearest(df, F.col("vec_id") % 20 == 0, IndexOptions(shard_rows=400, query_rows=30)).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert found.keys() == want.keys()
    vectors = dict(rows)
    for q, hits in found.items():
        assert [k for k, _, _ in hits] == list(range(1, 21)) and q not in {i for _, i, _ in hits}
        assert [(-s, i) for _, i, s in hits] == sorted((-s, i) for _, i, s in hits)
        assert all(abs(s - np.dot(np.array(vectors[q]), np.array(vectors[i]))) < 1e-9 for _, i, s in hits)
    assert np.mean([len({i for _, i, _ in found[q]} & set(want[q])) / 20 for q in want]) >= 0.9


def test_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert nearest(spark.createDataFrame([], schema), F.col("vec_id") % 20 == 0).collect() == []
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [1.0, 1.0]), (6, [1.0, -1.0]), (7, [1.0]), (None, [1.0, 2.0]), (20, [0.0, 1.0]), (40, [float("inf"), 1.0])]
    got = [tuple(r) for r in nearest(spark.createDataFrame(rows, schema), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 5, 1.0), (0, 2, 6, 1.0), (0, 3, 20, 0.0), (20, 1, 5, 1.0), (20, 2, 0, 0.0), (20, 3, 6, -1.0)]
