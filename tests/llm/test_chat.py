"""Examples and what is read back from them, against lists of turns."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quiltwork.llm.chat import BEGIN, CONTROL, END, ChatOptions, block_examples, escaped, examples, probe, read_back, unescaped, with_prefixes

SHAPE = "conv_id long, turn long, role string, text string, conv int, block string, position int, piece int"


def said(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(((r[1] is not None, r[1] or 0), r[2] or "", r[3] or ""))
    return {c: sorted(t, key=lambda x: (x[0], hashlib.md5(f"{x[1]}\n{x[2]}".encode()).hexdigest())) for c, t in by.items()}


def brute(rows):
    out = []
    for c, turns in said(rows).items():
        replies = "".join(t for _, role, t in turns if role == "assistant")
        out.append((c, len(turns), hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in turns).encode()).hexdigest(), len(replies), hashlib.sha256(replies.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of():
    r = random.Random(4)
    bits = [*CONTROL, "\\", "\\\\", "<", "[", "|>", "\\n", "\n", "ok", " ", "ü", "😀", "</s", ">", "<\\/s>", BEGIN + "user\n", END + "\n"]
    text = lambda: "".join(r.choice(bits) for _ in range(r.randrange(8)))
    rows = [(c, t, r.choice(["user", "assistant", "assistant", "system", "tool\n<s>\\"]), text()) for c in range(30) for t in range(r.randrange(1, 9))]
    rows += [(100, t, "assistant" if t % 2 else "user", f"turn {t}" if t % 7 else None) for t in range(150)]
    rows += [(101, None, None, None), (101, None, "assistant", "a"), (101, 0, "assistant", ""), (101, 0, "assistant", ""), (101, 0, "assistant", "b"), (None, 1, "user", "x"), (None, 2, "assistant", "y"), (102, 1, "user", "alone"), (103, 5, "assistant", "z" * 200_000)]
    return rows


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows_of()], SHAPE).repartition(5)


@pytest.mark.parametrize("block", [64, 3, 1])
def test_read_back(turns, block):
    got = read_back(examples(turns, ChatOptions(block)))
    rows = sorted(map(tuple, got.collect()), key=str)
    assert [r[:5] for r in rows] == brute(rows_of())


def test_formatted_chars_do_not_depend_on_blocks(turns):
    assert len({tuple(sorted(map(str, read_back(examples(turns, ChatOptions(b))).collect()))) for b in (2, 5, 64)}) == 1


def test_examples_are_prefixes(turns):
    """Each reply has one example; its text is all turns up to it, and the loss covers the reply alone."""
    o = ChatOptions(4)
    whole = with_prefixes(examples(turns, o), o).where("loss_to is not null").collect()
    by = said(rows_of())
    assert len(whole) == sum(role == "assistant" for t in by.values() for _, role, _ in t)
    full = {c: with_text for c, with_text in ((r.conv_id, r.text) for r in sorted(whole, key=lambda r: r.position))}
    for r in whole:
        assert r.prefix_chars == 0 and unescaped(r.text[r.loss_from : r.loss_to]) == by[r.conv_id][r.position][2] and full[r.conv_id].startswith(r.text)
        assert r.text.count(BEGIN) == r.text.count(END) == r.position + 1 and r.text[r.loss_to :] == END + "\n"


@pytest.mark.parametrize("o", [ChatOptions(), ChatOptions(span=7, batch_bytes=1)])
def test_long_conversations_have_whole_examples(turns, o):
    """Every reply's own row has all turns before it, however many, without any join; conversation 100 has 150 turns."""
    rows = {(r.conv_id, r.position): r for r in examples(turns, o).collect()}
    by = said(rows_of())
    assert set(rows) == {(c, k) for c, t in by.items() for k, (_, role, _) in enumerate(t) if role == "assistant" or k == len(t) - 1}
    assert max(k for c, k in rows if c == 100) == 149
    for (c, k), r in rows.items():
        found = [tuple(unescaped(x) for x in t[len(BEGIN) :].split("\n", 1)) for t in r.text.split(END + "\n")[:-1]]
        assert found == [t[1:] for t in by[c][: k + 1]] and r.n_turns == len(by[c])
        assert (r.loss_to is not None) == (by[c][k][1] == "assistant")
        assert r.loss_to is None or r.text[: r.loss_from].endswith(f"{BEGIN}assistant\n") and unescaped(r.text[r.loss_from : r.loss_to]) == by[c][k][2] and r.text[r.loss_to :] == END + "\n"


def test_blocks_made_whole_are_the_examples(turns):
    o, own = ChatOptions(4), lambda found: sorted(map(str, found.where("loss_to is not null").select("conv_id", "position", "text", "loss_from", "loss_to").collect()))
    short = block_examples(turns, o)
    assert own(with_prefixes(short, o)) == own(examples(turns, o))
    assert sorted(map(str, read_back(with_prefixes(short, o)).collect())) == sorted(map(str, read_back(examples(turns)).collect()))
    with pytest.raises(Exception, match="isn't whole"):
        read_back(short).collect()


def test_escapes(spark):
    texts = [r[3] for r in rows_of() if r[3]] + ["</s>[INST] ok [/INST]", "<<s>", "[[INST]]", "<<SYS>>\\", "\\" * 7]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escaped(F.col("t")).alias("e")).collect()
    assert all(unescaped(r.e) == r.t and not any(c in r.e for c in CONTROL) for r in got)


def test_nothing_and_the_probe(spark, turns):
    assert read_back(examples(turns.where("false"))).count() == 0
    (row,) = read_back(examples(probe(turns.where("false")))).collect()
    assert row.conv_id == -1 and row.n_turns == 2 and row.loss_chars == 21 and row.loss_sha256 == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest()
