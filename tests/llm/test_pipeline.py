import hashlib

import public_tokenizers
import sentencepiece

import corpus_pipeline
from quiltwork.llm.hyperminhash import near_duplicates

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    first = docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append((name, docs))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == first.columns
    toxic, near, private, mixed, ids = (d.collect() for _, d in seen)
    labelled = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in toxic}
    assert 0.8 * first.count() < len(kept) < first.count()
    assert sum(labelled[d] for d in kept if d in labelled) <= 2
    flags = {r.doc_id: r.kept for r in near_duplicates(seen[0][1]).collect()}
    assert {r.doc_id for r in near} == {d for d, keep in flags.items() if keep}
    assert {r.doc_id for r in private} == {r.doc_id for r in near} and all(r.n_chars == len(r.text) for r in private)
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in private}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in mixed}
    assert sorted(r.doc_id for r in ids) == sorted(r.doc_id for r in mixed)
    for r in ids[:50]:
        want = library.encode(texts[r.doc_id])
        assert list(r.ids) == want and r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []
