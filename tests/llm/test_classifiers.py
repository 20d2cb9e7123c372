import random
import time

from pyspark.sql import functions as F

from quiltwork.llm.noisy_channel import Restorer, count_trigrams, learn, score_documents, score_held_out, without_toxic
from quiltwork.llm.string_kernel import identify, identify_held_out

WORDS = {"en": "the of and house water green mother through which there".split(), "de": "der und nicht straße wasser grün mutter durch welche über".split(), "fr": "les des pas maison eau vert mère dans où être".split()}


def corpus(n, seed=1):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        lang = r.choice(sorted(WORDS))
        rows.append((k, " ".join(r.choice(WORDS[lang]) for _ in range(r.randrange(8, 60))), lang))
    return rows


def test_languages(spark):
    rows = corpus(400) + [(900, None, "en"), (901, "", "en"), (902, "12 !! 34", "de"), (None, "the water of the house", None), (903, "THE HOUSE OF WATER AND MOTHER", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "2 as held_out")
    found = identify_held_out(df).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    truth = {d: lang for d, _, lang in rows if d is not None and d < 900}
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.98
    by = {r.doc_id: r.lang_pred for r in found}
    assert by[900] == by[901] == by[902] == "und" and by[903] == "en" and by[None] == "en"


def test_more_than_64_languages(spark):
    r = random.Random(7)
    names = [f"l{k:03}" for k in range(70)]
    lexicon = {name: ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(3, 9))) for _ in range(12)] for name in names}
    rows = [(k, " ".join(r.choice(lexicon[names[k % 70]]) for _ in range(30)), names[k % 70]) for k in range(70 * 12)]
    found = identify_held_out(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    right = {x.doc_id for x in found if x.held_out and x.lang_pred == names[x.doc_id % 70]}
    late = [x.doc_id for x in found if x.held_out and x.doc_id % 70 >= 64]
    assert len(right) > 0.9 * sum(x.held_out for x in found) and late and sum(d in right for d in late) > 0.8 * len(late)


def test_languages_without_training(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in identify(df, F.lit(True)).collect()] == [("und", 0.0)]
    assert identify(df.limit(0), F.lit(True)).collect() == []


def test_restored_words():
    restorer = Restorer(count_trigrams(["idiot moron stupid trash loser disgusting the other of and nothing"] * 50))
    for given, want in (("1d10t", "idiot"), ("m0r0n", "moron"), ("$tup1d", "stupid"), ("tr@sh", "trash"), ("stuuuupid", "stupid"), ("i.d.i.o.t", "idiot"), ("Other,", "other"), ("(nothing)!!", "nothing"), ("2024", "2024")):
        assert restorer.restore_token(given) == want
    assert restorer.restore("you s t u p i d ones") == "you stupid ones"


def test_long_disguises():
    restorer = Restorer(count_trigrams(["idiot moron stupid trash loser disgusting the other of and nothing"] * 50))
    for given in ("s" + "t" * 20 + "u" * 20 + "p" * 10 + "1" * 10 + "d", "i.-.-.-.-.-.-.d.-.-.-.-.-.-.i.-.-.-.-.-.-.o.-.-.-.-.-.-.-.-.-.t"):
        assert len(given) >= 60 and restorer.restore_token(given) in ("stupid", "idiot")
    assert len(restorer.restore_token("1d10t-" * 20_000)) >= 100_000
    assert not restorer.disguised("日本" * 200_000) and restorer.disguised("日" * 2 + "本" * 3)


def toxic_corpus(n=600):
    r = random.Random(2)
    rows, labels = [], []
    for k, t, _ in corpus(n):
        bad = r.random() < 0.2
        words = t.split() + r.choices("idiot moron stupid".split(), k=3) * bad
        r.shuffle(words)
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_corpus()
    extra = [(2000, None), (2001, ""), (2002, "the house of an 1d10t and a m0ron"), (None, "the house")]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string").selectExpr("*", "1 as score", "2 as predicted")
    table = spark.createDataFrame(labels + [(5000, 1), (None, 1), (2001, None), (labels[0][0], labels[0][1])], "doc_id long, toxic int")
    found = score_held_out(docs, table).collect()
    assert len(found) == len(rows) + len(extra) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    truth = dict(labels)
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    by = {r.doc_id: r.predicted for r in found}
    assert by[2000] == by[2001] == by[None] == 0 and by[2002] == 1
    kept = without_toxic(docs, learn(docs, table, F.lit(True)))
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {2000, 2001, None} and 2002 not in {r.doc_id for r in kept.collect()}


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    scorer = learn(docs, none, F.lit(True))
    (row,) = score_documents(docs, scorer, restored=True).collect()
    assert row.predicted == 0 and row.restored == "a b"
    assert score_documents(docs.limit(0), scorer).collect() == []


def test_signs_around_a_token_take_linear_time():
    restorer = Restorer(count_trigrams(["an idiot is here"]))
    assert [restorer.bared(t) for t in ("(word).", "word**", "word*", "\"«x»\"", "a!!##", "....", "x.y..")] == ["word", "word", "word*", "x", "a", "", "x.y"]
    began = time.time()
    restorer.restore_token("x" + "." * 400_000 + "y")
    restorer.restore_token("x" + ".*" * 500 + "..")
    assert time.time() - began < 20
