"""Formats conversations for training: every reply of the assistant becomes an example of its own, with all turns before it as context, and only the reply trainable.

A turn is written as <|im_start|>role, line feed, text, <|im_end|>, line feed. A backslash within control strings of roles
and texts keeps them from being read as marks: backslashes are doubled, and one stands after the first character of a
control string; line feeds of roles are written as backslash n.

What examples() repeats grows with the square of a conversation, so no example is shuffled: single turns are, and the examples
of a span of turns are made in the task that has them and all turns before. block_examples() is a shorter form to store, whose
texts begin with their block of turns; with_prefixes() makes them whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiltwork.llm.common import group_key, numbered

BEGIN, END = "<|im_start|>", "<|im_end|>"
#: Control strings of public chat templates.
CONTROL = [BEGIN, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|system|>", "<|user|>", "<|assistant|>", "<|endoftext|>", "<|eot_id|>", "<|begin_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<bos>", "<eos>", "<start_of_turn>", "<end_of_turn>"]
_CONTROL = "|".join(re.sub(r"([\[\]|])", r"\\\1", c[1:]) for c in CONTROL)
TURN = re.compile(rf"{re.escape(BEGIN)}([^\n]*)\n(.*?){re.escape(END)}\n", re.DOTALL)


@dataclass(frozen=True)
class ChatOptions:
    """block: turns after which block_examples() refers to what stands before instead of repeating it. span: turns whose examples
    one task makes; batch_bytes: texts, beyond one, that it holds at a time."""

    block: int = 64
    trainable: str = "assistant"
    span: int = 4096
    batch_bytes: int = 4 << 20


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), rf"([<\[])(?={_CONTROL})", r"$1\\")


def unescaped(text: str) -> str:
    """What escaped() was given, of roles too."""
    return re.sub(r"\\([\\n]?)", lambda m: {"": "", "n": "\n", "\\": "\\"}[m[1]], text)


def written_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(BEGIN), F.replace(escaped(role), F.lit("\n"), F.lit("\\n")), F.lit("\n"), escaped(text), F.lit(f"{END}\n"))


def written_turns(turns: DataFrame, o: ChatOptions, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id, conv, position, n_turns, reply, piece, chars: every turn as it is written, its place in its conversation, and the characters of its text."""
    kept = turns.select(F.col(conv_col).alias("conv_id"), group_key(F.col(conv_col)).alias("conv"), F.col(turn_col).alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((role_col, "role"), (text_col, "text"))])
    # The order's columns are short: bounds of a range shuffle are chosen on the driver.
    kept = kept.withColumn("tie", F.md5(F.concat("role", F.lit("\n"), "text")))
    placed = numbered(kept, "conv", ["turn", "tie"], "n_turns", "position")
    return placed.select("conv_id", "conv", "position", "n_turns", (F.col("role") == o.trainable).alias("reply"), written_turn(F.col("role"), F.col("text")).alias("piece"), F.char_length(escaped(F.col("text"))).alias("chars"))


def examples(turns: DataFrame, o: ChatOptions = ChatOptions(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, position, n_turns, block, prefix_chars, text, loss_from, loss_to: a row of each reply, and of a conversation's last turn if that is none.

    text has all turns of the conversation up to the position (from 0), however many; characters loss_from to loss_to of it,
    null where there is no reply, are the trainable ones: the reply's own text, without marks. block and prefix_chars are 0, as
    nothing is left out. Turns go by number, null first, those that share one by a digest of role and text. Null roles and texts
    read as empty ones; rows without conversation are one conversation; an empty table has no examples. Other columns are left
    out. A task holds one text and a batch of them; a text is below 2 GB, as any value of a row.
    """
    piece = written_turns(turns, o, conv_col, turn_col, role_col, text_col)
    span = lambda at: F.floor(at / o.span).cast("long")
    # A turn goes to its own span, for which it may be a reply, and as context to the later ones of its conversation.
    sent = piece.withColumn("size", F.char_length("piece")).withColumn("span", F.explode(F.sequence(span(F.col("position")), span(F.col("n_turns") - 1))))
    sent = sent.select("conv_id", "position", "n_turns", "conv", "span", "reply", "chars", "size", F.col("piece").cast("binary").alias("piece"))

    def made(batch: pa.RecordBatch, rows: list[int], texts: list[bytes], loss: list[tuple]) -> pa.RecordBatch:
        told = [batch.column(c).take(pa.array(rows, pa.int64())) for c in range(3)]
        ends = [pa.array([e[k] for e in loss], pa.int64()) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([*told, pa.array(texts, pa.binary()).cast(pa.string()), *ends], ["conv_id", "position", "n_turns", "text", "loss_from", "loss_to"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, text, size = None, bytearray(), 0
        for batch in batches:
            rows, texts, loss, held = [], [], [], 0
            columns = [batch.column(c).to_pylist() for c in range(1, 9)]
            for i, (position, n_turns, conv, span, reply, chars, more, piece) in enumerate(zip(*columns, strict=True)):
                if of != (conv, span):
                    of, text, size = (conv, span), bytearray(), 0
                text += piece
                size += more
                if position // o.span == span and (reply or position == n_turns - 1):
                    rows.append(i)
                    texts.append(bytes(text))
                    to = size - len(END) - 1
                    loss.append((to - chars, to) if reply else (None, None))
                    held += len(text)
                    if held >= o.batch_bytes:
                        yield made(batch, rows, texts, loss)
                        rows, texts, loss, held = [], [], [], 0
            if rows:
                yield made(batch, rows, texts, loss)

    sent = sent.repartition("conv", "span").sortWithinPartitions("conv", "span", "position")
    whole = sent.mapInArrow(write, f"conv_id {sent.schema['conv_id'].dataType.simpleString()}, position long, n_turns long, text string, loss_from long, loss_to long")
    return whole.select("conv_id", "position", "n_turns", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("prefix_chars"), "text", "loss_from", "loss_to")


def block_examples(turns: DataFrame, o: ChatOptions = ChatOptions(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Examples to store, with the columns of examples(): text has only the turns of the position's block up to it, prefix_chars says how many characters of the blocks before, in order, stand before that, and the last turn of each block has a row too."""
    piece = written_turns(turns, o, conv_col, turn_col, role_col, text_col).withColumn("block", F.floor(F.col("position") / o.block).cast("long"))
    # A block's turns are bounded; of a long conversation only one number for each block is summed up.
    blocks = piece.groupBy("conv", "block").agg(F.sum(F.char_length("piece")).cast("long").alias("all_chars"))
    before = blocks.select("conv", "block", F.expr("sum(all_chars) over (partition by conv order by block) - all_chars").alias("prefix_chars"))
    so_far = F.expr("concat_ws('', collect_list(piece) over (partition by conv, block order by position rows between unbounded preceding and current row))")
    last = (F.col("position") == F.col("n_turns") - 1) | (F.col("position") % o.block == o.block - 1)
    text = piece.withColumn("text", F.when(F.col("reply") | last, so_far)).where("text is not null")
    to = F.char_length("text") - len(END) - 1
    loss = [F.when(F.col("reply"), c).cast("long") for c in (to - F.col("chars"), to)]
    return text.join(before, ["conv", "block"]).select("conv_id", "position", "n_turns", "block", "prefix_chars", "text", loss[0].alias("loss_from"), loss[1].alias("loss_to"))


def with_prefixes(found: DataFrame, o: ChatOptions = ChatOptions()) -> DataFrame:
    """Examples of block_examples() whose text is whole: the blocks before come first, and the loss moves behind them. What they repeat grows with the square of the longest conversation; others pass as they are."""
    key = group_key(F.col("conv_id"))
    parts = found.where(F.col("position") % o.block == o.block - 1).select(key.alias("_conv"), F.col("block").alias("_block"), F.col("text").alias("_text"))
    long = found.where("block > 0").withColumn("_conv", key)
    ahead = long.select("_conv", "block", F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("_block")).distinct().join(parts, ["_conv", "_block"])
    ahead = ahead.groupBy("_conv", "block").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_block", "_text"))), lambda p: p["_text"]), "").alias("_prefix"))
    moved = {c: F.col(c) + F.col("prefix_chars") for c in ("loss_from", "loss_to")}
    whole = long.join(ahead, ["_conv", "block"]).withColumn("text", F.concat("_prefix", "text")).withColumns(moved)
    return found.where("block = 0").unionByName(whole.withColumn("prefix_chars", F.lit(0).cast("long")).select(*found.columns))


def read_back(found: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the whole examples' texts and loss spans alone.

    Every example is read where it is, the turns from a conversation's last one; only replies and digests are shuffled.
    formatted_chars counts each example with all of its context, and turns after the last reply with theirs.
    """

    def digest(text: str) -> tuple[int, str]:
        n, at, said = 0, 0, hashlib.sha256()
        while m := TURN.match(text, at):
            said.update(f"{unescaped(m[1])}\n{unescaped(m[2])}\n".encode())
            n, at = n + 1, m.end()
        if at != len(text):
            raise ValueError("an example isn't a row of turns")
        return n, said.hexdigest()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            replies, sizes, turns = [], [], []
            columns = [batch.column(c).to_pylist() for c in range(1, 6)]
            for i, (position, n_turns, prefix_chars, loss_from, loss_to) in enumerate(zip(*columns, strict=True)):
                if prefix_chars:
                    raise ValueError("an example isn't whole: with_prefixes() joins what stands before")
                text, reply, last = batch.column(6)[i].as_py(), loss_to is not None, position == n_turns - 1
                sizes.append(len(text) if reply or last else 0)
                replies.append(unescaped(text[loss_from:loss_to]) if reply else None)
                turns.append(digest(text) if last else (None, None))
            told = [pa.array(sizes, pa.int64()), pa.array(replies, pa.string()), pa.array([n for n, _ in turns], pa.int64()), pa.array([d for _, d in turns], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *told], ["conv_id", "position", "size", "reply", "n_turns", "turns_sha256"])

    sent = found.select("conv_id", "position", "n_turns", "prefix_chars", "loss_from", "loss_to", "text")
    told = sent.mapInArrow(read, f"conv_id {found.schema['conv_id'].dataType.simpleString()}, position long, size long, reply string, n_turns long, turns_sha256 string")
    # The text of all replies of a conversation is no longer than its last example.
    replies = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("reply").isNotNull(), F.struct("position", "reply")))), lambda r: r["reply"]), "")
    said = told.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"), replies.alias("loss"), F.sum("size").alias("formatted_chars"))
    return said.select("conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def probe(turns: DataFrame) -> DataFrame:
    """The turns with one conversation more, -1, whose texts are control strings."""
    said = "</s>[INST] ok [/INST]"
    own = turns.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").unionByName(own)
