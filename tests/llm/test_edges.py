"""Nulls, empty and very long texts, ties, repeated rows, and columns of clashing names, through the operators that other tests try on plain rows alone."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quiltwork.llm.hyperminhash import NearOptions, near_duplicates, without_near_duplicates
from quiltwork.llm.mixing import mix, plan_mix
from quiltwork.llm.noisy_channel import score_held_out
from quiltwork.llm.piece_codec import encode_documents
from quiltwork.llm.string_kernel import identify_held_out
from quiltwork.llm.surrogates import replace_entities

CLASHING = ["key", "n", "band", "size", "rank", "kind", "norm", "toxic", "h", "k", "tkey", "id", "copies", "_key"]


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(11)
    words = "the of and house water green mother through which there der und nicht wasser".split()
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    long = text(60_000)
    rows = [(k, text(30), r.choice(["en", "de"]), "ab"[k % 2]) for k in range(60)]
    rows += [(100, long, "en", "a"), (101, long, "en", None), (102, None, "en", "a"), (103, "", None, "b"), (None, "the water", "en", "a"), (None, None, None, None), (104, "x" * 200_000, "en", "b")]
    rows += [(105, "same text here", "en", "a")] * 3 + [(106, "same text here", "en", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.select("*", *[F.lit(1).alias(c) for c in CLASHING]).repartition(3)


def test_languages(docs):
    found = identify_held_out(docs).collect()
    assert len(found) == docs.count()
    by = {r.doc_id: r for r in found}
    assert by[100].lang_pred == by[101].lang_pred and abs(by[100].score - by[101].score) < 1e-4 and by[102].lang_pred == by[103].lang_pred == "und"
    assert len({(r.lang_pred, round(r.score, 4)) for r in found if r.doc_id in (105, 106)}) == 1


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(k, k % 5 == 0) for k in range(60)] + [(7, None), (None, True), (5, True)], "doc_id long, toxic boolean").select("doc_id", F.col("toxic").cast("int").alias("toxic"), F.lit(1).alias("text"))
    found = score_held_out(docs, labels).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)
    by = {r.doc_id: r.score for r in found}
    assert by[100] == by[101] and by[105] == by[106]


def test_surrogates(spark, docs):
    own = docs.withColumns({"_row": F.lit(1), "_text": F.lit("t"), "_mentions": F.lit(2), "_map": F.lit(3)}).withColumn("text", F.when(F.col("doc_id") == 100, F.concat("text", F.lit(" mail bob@example.org"))).otherwise(F.col("text")))
    found = replace_entities(own)
    assert found.columns == [*own.columns, "_entities"]
    rows = found.collect()
    assert len(rows) == own.count()
    (long,) = (r for r in rows if r.doc_id == 100)
    assert "bob@" not in long.text and len(long._entities) == 1


def test_near_duplicates(docs):
    found = near_duplicates(docs, NearOptions(shingle=2)).collect()
    assert len(found) == docs.count()
    by = {r.doc_id: r for r in found if r.doc_id is not None}
    assert by[101].component_id == 100 and by[106].component_id == 105 and by[104].n_shingles == 1 and by[102].n_shingles == 0
    assert all(r.component_id is None and r.kept for r in found if r.doc_id is None)


def test_one_of_each_component(docs):
    """All columns stay as they are, whatever their names."""
    rows = without_near_duplicates(docs).collect()
    ids = [r.doc_id for r in rows]
    assert 100 in ids and 101 not in ids and ids.count(105) == 1 and 106 not in ids and ids.count(None) == 2 and all(r._key == 1 and r.band == 1 for r in rows)


def test_mixture(docs):
    found = plan_mix(docs).collect()
    assert len(found) == docs.count() and all(r.taken <= 3 * r.size for r in found)
    mixed = mix(docs.drop("copies"))
    assert mixed.where("doc_id = 100").count() == next(len(r.copies) for r in found if r.doc_id == 100)


def test_pieces(docs):
    found = encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), spans=True).collect()
    assert len(found) == docs.count()
    by = {r.doc_id: r for r in found}
    assert by[100].ids_sha256 == by[101].ids_sha256 and by[102].n_tokens == by[103].n_tokens == 0 and by[104].ends[-1] == 200_000
    assert all(len(r.ids) == r.n_tokens == len(r.begins) for r in found)
