import hashlib
import io
import random

import public_tokenizers
import pytest
import sentencepiece

from quiltwork.llm.piece_codec import CharacterMap, PieceCodec, encode_documents

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["a", "the", " ", "  ", "\n", "\n\n", "▁", "é", "日", "😀", "\t", "\x00", "1", "12", "<s>", "<0x0A>", "x", "Ing", " ⁇ ", "�", "\r", " ", "　"]


def texts(n, seed=3):
    r = random.Random(seed)
    return ["".join(r.choice(ODD) for _ in range(r.randrange(0, 14))) for _ in range(n)] + ["", " ", "\n", "▁", "word " * 3000]


def test_same_as_the_library():
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    with open(MODEL, "rb") as file:
        codec = PieceCodec(file.read())
    assert codec.splits
    for text in texts(3000):
        ids = library.encode(text)
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
        assert codec.digest(text) == want and codec.ids(text).tolist() == ids, repr(text)
        own, first, last = codec.encode(text)
        raw = text.encode()
        assert own == ids and b"".join(raw[a:b] for a, b in zip(first, last)) == raw, repr(text)


def test_new_segments_of_a_group_take_one_call(monkeypatch):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    with open(MODEL, "rb") as file:
        codec = PieceCodec(file.read())
    calls = []

    class Counted:
        def __getattr__(self, name):
            return lambda given, **kw: calls.append(name) or getattr(library, name)(given, **kw)

    monkeypatch.setattr(codec, "mapped", Counted())  # this model has no map, so both are the same
    text = " ".join(f"w{k}" for k in range(500)) + "\n\nend"
    assert codec.encode(text)[0] == library.encode(text) and sorted(calls) == ["decode", "encode"]
    # Nothing new, nothing asked.
    assert codec.encode(text)[0] == library.encode(text) and len(calls) == 2


def test_groups_beyond_the_memo(monkeypatch):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    monkeypatch.setattr("quiltwork.llm.piece_codec.MEMO_SEGMENTS", 7)
    with open(MODEL, "rb") as file:
        codec = PieceCodec(file.read())
    given = texts(300, 9)
    for k in range(0, len(given), 11):
        for text, (ids, first, last, joined, decoded) in zip(given[k : k + 11], codec.encoded(given[k : k + 11]), strict=True):
            want, raw = library.encode(text), text.encode()
            assert ids.tolist() == want and joined == ",".join(map(str, want)).encode() and decoded == library.decode(want).encode(), repr(text)
            assert b"".join(raw[a:b] for a, b in zip(first.tolist(), last.tolist())) == raw
        assert len(codec.memo) < 7


def test_longest_prefix():
    normalizer = getattr(sentencepiece, "SentencePieceNormalizer", None)
    if normalizer is None:
        pytest.skip("this version has no normaliser of its own")
    own = normalizer(rule_name="nmt_nfkc")
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(own.serialized_model_proto())
    table = CharacterMap(proto.normalizer_spec.precompiled_charsmap)
    for text in ["ｆｕｌｌ width", "ﬁne", "①②", "áb", "Å Å", "ｶﾞ", "日本", "x​y"]:
        mapped, starts = table.replace(text)
        assert mapped.strip() == own.normalize(text).replace("▁", " ").strip()
        assert len(starts) == len(mapped) + 1 and starts == sorted(starts) and starts[-1] == len(text.encode())


def test_documents(spark):
    rows = [(k, t) for k, t in enumerate(texts(40))] + [(None, "a b"), (3, None), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as n_tokens")
    found = encode_documents(df, MODEL, spans=True).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.n_tokens == len(r.ids) == len(r.begins) == len(r.ends)
        assert hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() == r.ids_sha256
    assert encode_documents(df.limit(0), MODEL).collect() == []


def test_model_with_a_map(monkeypatch):
    r = random.Random(5)
    model = io.BytesIO()
    lines = [" ".join("".join(r.choice("abcdeéfiwxyz日本") for _ in range(r.randrange(1, 7))) for _ in range(9)) for _ in range(400)]
    sentencepiece.SentencePieceTrainer.train(sentence_iterator=iter(lines), model_writer=model, vocab_size=330, model_type="bpe", byte_fallback=True, normalization_rule_name="nmt_nfkc", user_defined_symbols=["ｗｘ"], minloglevel=2)
    library, codec = sentencepiece.SentencePieceProcessor(model_proto=model.getvalue()), PieceCodec(model.getvalue())
    assert not codec.splits
    given = ["ﬁne  ｆｕｌｌ", " ①② áb ", "日本　ｶﾞ", "aｗｘb x​y", "", "  ", "eé ﬁ\nx\ty"]
    # The library must not apply the map again.
    calls = []
    real = CharacterMap.replace
    monkeypatch.setattr(CharacterMap, "replace", lambda self, *a: calls.append(a[0]) or real(self, *a))
    for text in given + ["".join(r.choice(["ﬁ", "ｆ", "a", " ", "①", "é", "e\u0301", "　", "日", "😀", "ｗｘ", "ｗ"]) for _ in range(12)) for _ in range(300)]:
        ids, first, last = codec.encode(text)
        pieces = library.encode(text, return_type="proto").pieces
        assert ids == library.encode(text), repr(text)
        assert list(zip(first, last)) == [(p.begin, p.end) for p in pieces], repr(text)
    assert calls


def test_query_projects_to_source_bytes(spark):
    rows = list(enumerate(["a  bé\n日 😀x", "▁ ▁a", ""]))
    for r in encode_documents(spark.createDataFrame(rows, "doc_id long, text string"), MODEL, ids=False).join(encode_documents(spark.createDataFrame(rows, "doc_id long, text string"), MODEL, spans=True).select("doc_id", "begins", "ends"), "doc_id").collect():
        raw = rows[r.doc_id][1].encode()
        assert b"".join(raw[a:b] for a, b in zip(r.begins, r.ends)) == raw
        flat = b"".join(x.to_bytes(4, "little") for pair in zip(r.begins, r.ends) for x in pair)
        assert r.spans_sha256 == hashlib.sha256(flat).hexdigest()
