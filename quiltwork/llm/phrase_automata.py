"""Removes repeated phrases: windows of words that occur again anywhere.

Every window has an anchor, the short string in it with the least hash, so windows that could be equal have equal anchors.
Anchors that occur once are ruled out by counting. Around each of the others, documents are streamed to the shard that the
anchor belongs to, so that every phrase meets all documents that could hold it and no others. A shard confirms the windows
that recur in its stream, compiles the passages that they form into an Aho-Corasick automaton and runs the stream through
it. A passage is entered in pieces of half a window, laid end to end: every window of it holds a whole piece. Where a piece
is found, the words around it are compared with the passage's, byte by byte, as far as they agree; a window that this finds
in two places is an occurrence to remove.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltwork.llm.passages import buckets_for, contains, distinct_texts, recurring, runs, text_key
from quiltwork.llm.rolling import anchor_of, anchors, batches, windows, word_hashes

#: Bytes kept of an anchor's hash (finding more anchors does no harm).
ANCHOR_BYTES = 5
#: Bytes of stretches that a task gathers before it sends them on.
GATHER = 16_000_000
#: Shards of a bucket: their automata are built one after the other, each of some hundred thousand bytes of passages.
SHARDS = 32
STREAM = "bucket int, shard int, contents binary, counts binary, twice binary, keys binary, places binary"
DEALT = "bucket int, keys binary, begins binary, ends binary"
FOUND = "tkey bigint, begins binary, ends binary"
RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


@dataclass(frozen=True)
class PhraseOptions:
    window: int = 35
    anchor: int = 12

    @property
    def row(self) -> int:
        """Anchor candidates in a window."""
        return self.window - self.anchor + 1

    @property
    def piece(self) -> int:
        return (self.window + 1) // 2


def _each(texts: list[bytes], o: PhraseOptions) -> Iterator[tuple[int, np.ndarray]]:
    """Each text that has a window, with its word hashes."""
    for a, b in batches(texts):
        hashes, _, _, first = word_hashes(texts[a:b])
        for k, (i, j) in enumerate(zip(first[:-1], first[1:], strict=True)):
            if j - i >= o.window:
                yield a + k, hashes[i:j]


def packed_texts(keyed: DataFrame) -> DataFrame:
    """keyed with packed, the text compressed, in place of text: texts go through two shuffles."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=3, write_checksum=False)
        for part in parts:
            at = part.schema.get_field_index("text")
            yield part.set_column(at, "packed", pa.array([small.compress(t.encode()) for t in part.column(at).to_pylist()], pa.binary()))

    return keyed.mapInArrow(run, ", ".join(f"{'packed binary' if n == 'text' else f'{n} {k}'}" for n, k in keyed.dtypes))


def unpacked(column: pa.Array) -> list[bytes]:
    large = zstandard.ZstdDecompressor()
    return [large.decompress(p) for p in column.to_pylist()]


class Passages:
    """Passages that recur, compiled into an automaton of their pieces."""

    def __init__(self, o: PhraseOptions) -> None:
        self.o, self.automaton, self.holders = o, ahocorasick.Automaton(), {}
        self.texts: list[bytes] = []
        self.starts: list[np.ndarray] = []

    def add(self, text: bytes, starts: np.ndarray, ends: np.ndarray) -> None:
        """A passage with a blank before and after it, and where its words begin and end."""
        f, size = len(self.texts), self.o.piece
        self.texts.append(text)
        self.starts.append(starts)
        for q in range(0, len(starts) - size + 1, size):
            piece = text[starts[q] - 1 : ends[q + size - 1] + 1].decode("latin-1")
            holders = self.holders.setdefault(piece, [])
            holders.append((f, int(starts[q]) - 1))
            self.automaton.add_word(piece, (len(piece), holders))

    def compile(self) -> None:
        self.automaton.make_automaton()

    def found_in(self, text: bytes, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(passage, its first word, first word here, number of words) of stretches of a window or more that a text, with blanks around, has in common with a passage."""
        out, seen = [], set()
        for last, (size, holders) in self.automaton.iter(text.decode("latin-1")):
            at = last - size + 1
            for f, place in holders:
                shift = at - place
                if (f, shift) in seen:
                    continue
                seen.add((f, shift))
                other = self.texts[f]
                low, high = max(0, shift), min(len(text), shift + len(other))
                one, two = text[low:high], other[low - shift : high - shift]
                if one != two:
                    differ = np.flatnonzero(np.frombuffer(one, np.uint8) != np.frombuffer(two, np.uint8)) + low
                    k = int(np.searchsorted(differ, at))
                    low, high = int(differ[k - 1]) + 1 if k else low, int(differ[k]) if k < len(differ) else high
                # Whole words: the blanks before and after them agree as well.
                i, j = int(np.searchsorted(starts, low + 1)), int(np.searchsorted(ends, high - 1, "right"))
                if j - i >= self.o.window:
                    out.append((f, int(np.searchsorted(self.starts[f], starts[i] - shift)), i, j - i))
        return out


def hashed(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """word_hashes() of many contents, some at a time."""
    parts, size, many = [], 0, 0
    for a, b in batches(contents):
        hashes, starts, ends, first = word_hashes(contents[a:b])
        parts.append((hashes, starts + size, ends + size, first[:-1] + many))
        size, many = size + sum(len(c) + 1 for c in contents[a:b]), many + len(hashes)
    hashes, starts, ends, first = (np.concatenate(x) for x in zip(*parts, strict=True))
    return hashes, starts, ends, np.append(first, many)


def locate(contents: list[bytes], weight: np.ndarray, twice: np.ndarray, o: PhraseOptions) -> list[np.ndarray]:
    """For each content (words joined by blanks, `weight` times in the stream, or in a text that stands in several rows) begins and ends of the stretches of words that windows which recur cover."""
    out = [np.zeros((0, 2), np.int64)] * len(contents)
    hashes, starts, ends, first = hashed(contents)
    every = windows(hashes, o.window)
    many = np.maximum(np.diff(first) - o.window + 1, 0)
    own = np.repeat(np.arange(len(contents)), many)
    at = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many) + first[:-1][own]
    _, sample, kind = np.unique(every[at], return_index=True, return_inverse=True)
    again = (np.bincount(kind, weight[own]) >= 2) | (np.bincount(kind, twice[own]) > 0)
    if not again.any():
        return out
    base = np.concatenate([[0], np.cumsum([len(c) + 1 for c in contents])]) - 1  # each content gets a blank before it
    # Of equal windows one is a witness; neighbouring witnesses form a passage.
    witness = np.sort(sample[again])
    passages = Passages(o)
    edge = np.flatnonzero((np.diff(at[witness]) != 1) | (np.diff(own[witness]) != 0))
    for a, b in zip(witness[np.append(0, edge + 1)], witness[np.append(edge, len(witness) - 1)], strict=True):
        k, i, j = own[a], at[a], at[b] + o.window
        begin = starts[i]
        passages.add(b" " + contents[k][begin - base[k] - 1 : ends[j - 1] - base[k] - 1] + b" ", starts[i:j] - begin + 1, ends[i:j] - begin + 1)
    passages.compile()
    matches = []
    for k in np.unique(own[again[kind]]).tolist():
        i, j = first[k], first[k + 1]
        matches += [(k, *m) for m in passages.found_in(b" " + contents[k] + b" ", starts[i:j] - base[k], ends[i:j] - base[k])]
    # How often each window of a passage was found.
    counts = [np.zeros(len(s) - o.window + 1) for s in passages.starts]
    for k, f, of, _, n in matches:
        counts[f][of : of + n - o.window + 1] += 2 if twice[k] else weight[k]
    change: dict[int, np.ndarray] = {}
    for k, f, of, here, n in matches:
        start = here + np.flatnonzero(counts[f][of : of + n - o.window + 1] >= 2)
        own_change = change.setdefault(k, np.zeros(first[k + 1] - first[k] + 1, np.int64))
        own_change[start] += 1
        np.subtract.at(own_change, start + o.window, 1)
    for k, own_change in change.items():
        gone = np.diff(np.concatenate([[0], (np.cumsum(own_change)[:-1] > 0).astype(np.int8), [0]]))
        out[k] = np.stack([np.flatnonzero(gone == 1), np.flatnonzero(gone == -1)], axis=1)
    return out


def streamed(texts: list[bytes], known: list[bytes], o: PhraseOptions) -> Iterator[tuple[int, int, int, bytes]]:
    """(text, hash of the anchor, first word, words) of the stretches around a text's anchors that are known to recur."""
    for k, hashes in _each(texts, o):
        short = windows(hashes, o.anchor)
        chosen = anchor_of(short, o.row)
        able = np.flatnonzero(contains(short, known[k], ANCHOR_BYTES)[chosen])
        if not len(able):
            continue
        words = texts[k].split()
        edge = np.flatnonzero((np.diff(able) != 1) | (np.diff(chosen[able]) != 0))
        for a, b in zip(able[np.append(0, edge + 1)].tolist(), able[np.append(edge, len(able) - 1)].tolist(), strict=True):
            yield k, int(short[chosen[a]]), a, b" ".join(words[a : b + o.window])


def recurring_stretches(docs: DataFrame, packed: DataFrame, keyed: DataFrame, o: PhraseOptions) -> DataFrame:
    """tkey, twin, times (rows with this text; if several, all windows recur) and, packed, begins and ends of stretches of words to remove."""
    buckets = buckets_for(docs)

    def anchor_entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, hashes, owners = batch.column(1).to_pylist(), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for k, own in _each([t.encode() for t in batch.column(0).to_pylist()], o):
            short = windows(own, o.anchor)
            hashes.append(short[anchors(short, o.row)])
            owners.append(np.full(len(hashes[-1]), keys[k], np.int64))
        return np.concatenate(hashes), np.concatenate(owners), np.zeros(sum(map(len, hashes)), np.uint8)

    known = recurring(keyed.select("text", "tkey"), anchor_entries, buckets, ANCHOR_BYTES)
    texts = distinct_texts(keyed)
    once = packed.join(known.join(texts, "tkey"), ["tkey", "twin"]).where(F.coalesce("doc_id", F.lit((1 << 63) - 1)) == F.col("first"))

    def send(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes], list] = {}
        size, done = 0, set()
        for part in parts:
            keys, twins, hashes, times = (part.column(c).to_pylist() for c in (1, 2, 3, 4))
            # Rows alike in text and id are one text.
            take = [k for k, key in enumerate(zip(keys, twins, strict=True)) if key not in done and not (times[k] > 1 and done.add(key))]
            raw = unpacked(part.column(0).take(pa.array(take, pa.int64())))
            for k, anchor, at, content in streamed(raw, [hashes[x] for x in take], o):
                key, again = keys[take[k]], times[take[k]] > 1
                found = held.setdefault((anchor % (buckets * SHARDS), content), [[], [], False])
                found[0].append(key)
                found[1].append(at)
                found[2] |= again
                size += len(content) * (len(found[0]) == 1) + 16
                if size >= GATHER:
                    yield out(held)
                    held, size = {}, 0
        if held:
            yield out(held)

    def out(held: dict[tuple[int, bytes], list]) -> pa.RecordBatch:
        small, rows, by = zstandard.ZstdCompressor(level=3), [], {}
        for (shard, content), found in held.items():
            by.setdefault(shard, []).append((content, *found))
        for shard, found in by.items():
            contents, keys, places, twice = zip(*found, strict=True)
            flat = [np.array([x for own in column for x in own], np.int64).tobytes() for column in (keys, places)]
            rows.append((shard % buckets, shard, small.compress(b"\n".join(contents)), np.array([len(x) for x in keys], np.uint32).tobytes(), np.array(twice, np.uint8).tobytes(), flat[0], small.compress(flat[1])))
        kinds = [pa.int32()] * 2 + [pa.binary()] * 5
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "shard", "contents", "counts", "twice", "keys", "places"])

    def shard_spans(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Text keys, and begins and ends of stretches to remove, of one shard's stream."""
        number: dict[bytes, int] = {}
        which, large = [], zstandard.ZstdDecompressor()
        for blob in part.column("contents").to_pylist():
            which.append(np.array([number.setdefault(c, len(number)) for c in large.decompress(blob).split(b"\n")], np.int64))
        counts, twice = (np.concatenate([np.frombuffer(x, kind) for x in part.column(c).to_pylist()]) for c, kind in (("counts", np.uint32), ("twice", np.uint8)))
        keys = np.concatenate([np.frombuffer(x, np.int64) for x in part.column("keys").to_pylist()])
        places = np.concatenate([np.frombuffer(large.decompress(x), np.int64) for x in part.column("places").to_pylist()])
        whose = np.concatenate(which)
        found = locate(list(number), np.bincount(whose, counts, len(number)), np.bincount(whose, twice, len(number)) > 0, o)
        occurrence = np.repeat(whose, counts)
        sizes = np.array([len(f) for f in found], np.int64)
        flat, base, times = np.concatenate(found), np.cumsum(sizes) - sizes, sizes[occurrence]
        pick = np.repeat(base[occurrence], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return np.repeat(keys, times), flat[pick] + np.repeat(places, times)[:, None]

    def search(part: pa.Table) -> pa.Table:
        shards = part.column("shard").to_numpy()
        order = np.argsort(shards, kind="stable")
        begin, end = runs(shards[order])
        keys, spans = (np.concatenate(x) for x in zip(*(shard_spans(part.take(pa.array(order[a:b]))) for a, b in zip(begin, end, strict=True)), strict=True))
        bucket = (keys.view(np.uint64) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        bucket, keys, spans = bucket[order], keys[order], spans[order]
        begin, end = runs(bucket)
        small = zstandard.ZstdCompressor(level=3)
        pack = lambda x: pa.array([small.compress(x[a:b].tobytes()) for a, b in zip(begin, end, strict=True)], pa.binary())
        return pa.table({"bucket": pa.array(bucket[begin], pa.int32()), "keys": pack(keys), "begins": pack(np.ascontiguousarray(spans[:, 0])), "ends": pack(np.ascontiguousarray(spans[:, 1]))})

    def gather(part: pa.Table) -> pa.Table:
        large = zstandard.ZstdDecompressor()
        keys, begins, ends = (np.concatenate([np.frombuffer(large.decompress(x), np.int64) for x in part.column(c).to_pylist()]) for c in ("keys", "begins", "ends"))
        order = np.lexsort((begins, keys))
        keys, begins, ends = keys[order], begins[order], ends[order]
        a, b = runs(keys)
        pack = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(a, b, strict=True)], pa.binary())
        return pa.table({"tkey": pa.array(keys[a], pa.int64()), "begins": pack(begins), "ends": pack(ends)})

    met = once.select("packed", "tkey", "twin", "hashes", "times").mapInArrow(send, STREAM).groupBy("bucket").applyInArrow(search, DEALT)
    found = met.groupBy("bucket").applyInArrow(gather, FOUND)
    return texts.join(found, "tkey", "left").where("times > 1 or begins is not null").select("tkey", "twin", "begins", "ends", "times")


def removed(n: int, again: bool, begins: bytes | None, ends: bytes | None, o: PhraseOptions) -> np.ndarray:
    """Which words of a text go."""
    out = np.full(n, again and n >= o.window)
    if not again and begins:
        change = np.zeros(n + 1, np.int64)
        for step, places in ((1, begins), (-1, ends)):
            where = np.frombuffer(places, np.int64)
            np.add.at(change, where[where <= n], step)
        out = np.cumsum(change)[:-1] > 0
    return out


def remove_phrases(docs: DataFrame, options: PhraseOptions = PhraseOptions(), id_col: str = "doc_id", text_col: str = "text", kept_text: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept text.

    Null texts have no words. Repeated rows repeat each other's windows, so all of their words go if there are enough for
    a window; shorter texts keep all words. Other columns are left out.
    """
    o = options
    keyed = text_key(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    packed = packed_texts(keyed)
    rows = packed.join(recurring_stretches(docs, packed, keyed, o), ["tkey", "twin"], "left").select("doc_id", "packed", "begins", "ends", "times")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            begins, ends, times = (part.column(c).to_pylist() for c in (2, 3, 4))
            sizes, gone, kept = [], [], []
            for k, raw in enumerate(unpacked(part.column(1))):
                words = raw.split()
                out = removed(len(words), (times[k] or 1) > 1, begins[k], ends[k], o)
                sizes.append(len(words))
                gone.append(int(out.sum()))
                kept.append(b" ".join([w for w, go in zip(words, out.tolist(), strict=True) if not go]) if gone[-1] else b" ".join(words))
            columns = [part.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x.decode() for x in kept])], [*names, "kept"]) if kept_text else pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, RESULT + ", kept string" * kept_text)
