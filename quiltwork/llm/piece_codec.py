"""SentencePiece encoding and decoding with source offsets.

The text is normalised by longest-prefix look-ups in the model's compiled character map, keeping for every normalised
character the source bytes that it came from; it is then encoded without the map, and every piece is projected back to the
bytes of the original text. Under a model without a map the text falls into segments that no merge can join (a piece has
the blank sign at its start only, and the line feed in no piece), so a task keeps what it learned about segments. Those that
are new to it in a group of texts are encoded and decoded by one call each: a call for every segment costs several times the
work done in it.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from quiltwork.llm.rolling import batches as some

BLANK = "▁"
#: Distinct segments kept per task, and their bytes; the memo is emptied between groups when full, which changes speed only.
MEMO_SEGMENTS, MEMO_BYTES = 100_000, 32_000_000
#: Characters of the texts whose segments are held at once; a longer text is a group of its own.
GROUP = 500_000


class CharacterMap:
    """The compiled character map of a model: a double-array trie over UTF-8 bytes with replacement strings behind it."""

    def __init__(self, blob: bytes) -> None:
        self.units: tuple[int, ...] = ()
        self.strings = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, int] | None:
        """Length and string offset of the longest key that starts at a byte."""
        units, found = self.units, None
        node = 0
        unit = units[0]
        node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
        for k in range(at, len(data)):
            byte = data[k]
            node ^= byte
            unit = units[node]
            if (unit & ((1 << 31) | 0xFF)) != byte:
                break
            node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
            if (unit >> 8) & 1:
                found = (k + 1 - at, units[node] & ((1 << 31) - 1))
        return found

    def replace(self, text: str, kept: re.Pattern[str] | None = None) -> tuple[str, list[int]]:
        """The mapped text, and for each of its characters the source byte where it begins (one more at the end).

        What `kept` matches passes as it is.
        """
        out, starts, at = [], [], 0
        whole = {m.start(): m.end() for m in kept.finditer(text)} if kept else {}
        if not self.units or whole:
            # Stretches between kept ones are mapped on their own.
            k, edges = 0, [*sorted(whole.items()), (len(text), len(text))]
            for begin, end in edges:
                between = text[k:begin]
                if self.units and between:
                    mapped, own = self.replace(between)
                    out.append(mapped)
                    starts.extend([at + x for x in own[:-1]])
                    at += own[-1]
                    between = ""
                for ch in between + text[begin:end]:
                    starts.append(at)
                    at += len(ch.encode("utf-8", "surrogatepass"))
                out.append(between + text[begin:end])
                k = end
            return "".join(out), [*starts, at]
        data = text.encode("utf-8", "surrogatepass")
        while at < len(data):
            if hit := self.longest(data, at):
                length, offset = hit
                piece = self.strings[offset : self.strings.index(b"\0", offset)].decode()
            else:
                lead = data[at]
                length = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                piece = data[at : at + length].decode("utf-8", "surrogatepass")
            out.append(piece)
            starts.extend([at] * len(piece))
            at += length
        return "".join(out), [*starts, at]


class PieceCodec:
    """Encodes and decodes as the sentencepiece library does with the same model, and knows where pieces came from."""

    def __init__(self, model: bytes) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        rules = proto.normalizer_spec
        plain = [p.piece for p in proto.pieces]
        self.map = CharacterMap(rules.precompiled_charsmap)
        own = sorted((p.piece for p in proto.pieces if p.type == p.USER_DEFINED), key=lambda x: (-len(x), x))
        self.kept = re.compile("|".join(map(re.escape, own))) if own else None
        self.splits = (
            rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces and not rules.precompiled_charsmap
            and not proto.trainer_spec.treat_whitespace_as_suffix and not any(BLANK in p.lstrip(BLANK) or "\n" in p for p in plain)
            and proto.trainer_spec.byte_fallback and BLANK in plain and not own
        )
        # The map has been applied when the text is encoded.
        rules.precompiled_charsmap, rules.name = b"", "identity"
        self.mapped = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.blank_id = self.library.piece_to_id(BLANK)
        self.names = [f"{i}" for i in range(len(plain))]
        self.memo: dict[str, tuple[int, str, bytes, bytes]] = {}
        self.held = 0
        # How many source bytes a piece covers if its blank sign stands for a blank; bytes cover one each.
        self.widths = np.array([1 if p.type == p.BYTE else len(p.piece.replace(BLANK, " ").encode()) for p in proto.pieces], np.int32)
        self.first, self.segment = re.compile(r" *[^ \n]*"), re.compile(r" +[^ \n]*|\n+[^ \n]*")
        self.first_signs, self.segment_signs = re.compile(f"[ {BLANK}]*[^ {BLANK}\n]*"), re.compile(f"[ {BLANK}]+[^ {BLANK}\n]*|\n+[^ {BLANK}\n]*")

    def segments(self, text: str) -> list[str]:
        """Stretches of the source; the first, marked by a null character, has the blank that is put first."""
        if not text:
            return []
        first, rest = (self.first_signs, self.segment_signs) if BLANK in text else (self.first, self.segment)
        head = first.match(text)[0]
        found = rest.findall(text, len(head))
        found.insert(0, "\0" + head)
        return found

    def learn(self, segments: list[str]) -> None:
        """Number of ids, the ids joined by commas, the decoded bytes, with a blank for each blank sign, and the ids of new segments."""
        names, given = self.names, []
        lines = [s[0] == "\n" for s in segments]
        for s, line in zip(segments, lines):
            # The library puts a blank first; before a line feed it isn't wanted.
            given.append((s if line else s[1:]).replace(" ", BLANK))
        # Tasks share the cores already.
        encoded = self.mapped.encode(given, num_threads=1)
        decoded = self.mapped.decode(encoded, num_threads=1)
        for s, line, ids, text in zip(segments, lines, encoded, decoded, strict=True):
            if line:
                ids = ids[1:]
            else:
                ids, text = ids or [self.blank_id], " " + text
            self.memo[s] = (len(ids), ",".join([names[i] for i in ids]), text.encode(), array("i", ids).tobytes())
            self.held += len(s)

    def encode(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """Ids with the first and the next byte of each in the UTF-8 source; the blank put first has an empty span."""
        ((ids, first, last, _, _),) = self.encoded([text])
        return ids.tolist(), first.tolist(), last.tolist()

    def encoded(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, bytes, bytes]]:
        """encode() of a group of texts in arrays, with the ids joined by commas and the decoded text."""
        if not self.splits:
            return [self._project(t) for t in texts]
        parts, memo = [self.segments(t) for t in texts], self.memo
        new = list({s: None for part in parts for s in part if s not in memo})
        for k in range(0, len(new), MEMO_SEGMENTS):
            self.learn(new[k : k + MEMO_SEGMENTS])
        found = [self._joined(text, [memo[s] for s in part]) for text, part in zip(texts, parts)]
        if len(memo) >= MEMO_SEGMENTS or self.held >= MEMO_BYTES:
            memo.clear()
            self.held = 0
        return found

    def _joined(self, text: str, found: list[tuple[int, str, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes, bytes]:
        ids = np.frombuffer(b"".join([x[3] for x in found]), np.int32)
        joined, decoded = ",".join([x[1] for x in found]).encode(), b"".join([x[2] for x in found])[1:]
        widths = self.widths[ids]
        widths[:1] -= 1
        if BLANK not in text and widths.sum() == len(text.encode("utf-8", "surrogatepass")):
            last = widths.cumsum(dtype=np.int32)
            return ids, last - widths, last, joined, decoded
        mapped, starts = self.map.replace(text)
        begins: list[int] = []
        ends: list[int] = []
        self._spans([self.library.id_to_piece(i) for i in ids.tolist()], ids.tolist(), -1, mapped, starts, begins, ends)
        return ids, np.array(begins, np.int32), np.array(ends, np.int32), joined, decoded

    def _spans(self, pieces: list[str], ids: list[int], at: int, mapped: str, starts: list[int], first: list[int], last: list[int]) -> int:
        left = 0  # bytes still to come of a character that fell back to bytes
        for piece, i in zip(pieces, ids, strict=True):
            if self.library.is_byte(i):
                if not left:
                    left = len(mapped[at].encode("utf-8", "surrogatepass"))
                    done = 0
                width = starts[at + 1] - starts[at]
                first.append(starts[at] + min(done, width))
                done += 1
                left -= 1
                last.append(starts[at] + min(done, width) if left else starts[at + 1])
                at += not left
            else:
                end = at + (1 if self.library.is_unknown(i) else len(piece))
                first.append(starts[max(at, 0)])
                last.append(starts[max(end, 0)])
                at = end
        return at

    def _project(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes, bytes]:
        """For other models: the mapped text's pieces, by the alignment of the map in bytes of the source."""
        mapped, starts = self.map.replace(text, self.kept)
        # The library's offsets are bytes of the mapped text.
        widths = [len(ch.encode("utf-8", "surrogatepass")) for ch in mapped]
        starts = [x for x, width in zip(starts, widths) for _ in range(width)] + starts[-1:]
        pieces = self.mapped.encode(mapped, return_type="proto").pieces
        ids = [p.id for p in pieces]
        first, last = ([starts[x] for x in where] for where in ([p.begin for p in pieces], [p.end for p in pieces]))
        joined = ",".join([self.names[i] for i in ids]).encode()
        return np.array(ids, np.int32), np.array(first, np.int32), np.array(last, np.int32), joined, self.library.decode(ids).encode()

    def ids(self, text: str) -> np.ndarray:
        return self.encoded([text])[0][0]

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids joined by commas, and SHA-256 of the decoded text."""
        ((ids, _, _, joined, decoded),) = self.encoded([text])
        return len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(decoded).hexdigest()

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def encode_documents(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, spans: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256, the ids and, if asked for, the bytes of each.

    spans_sha256 is over the first and the next source byte of each id in turn, as 32-bit integers, little end first. Null texts count as empty and have no ids. Repeated rows stay; other columns are left out, so their names can't
    clash. The model file's bytes (half a megabyte, of fixed size) go to the tasks with the function.
    """
    with open(model_path, "rb") as file:
        model = file.read()
    extra = ", ids array<int>" * ids + ", begins array<int>, ends array<int>" * spans

    def lists(arrays: list) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *arrays]).astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(model)
        sha = lambda values: pa.array([hashlib.sha256(v).hexdigest() for v in values], pa.string())
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            # A few texts at a time, so that what is held doesn't grow with the rows of a batch.
            for a, b in some(texts, GROUP):
                found = codec.encoded(texts[a:b])
                spans_of = [np.stack([x[1], x[2]], axis=1).astype("<i4").tobytes() for x in found]
                columns = [batch.column(0).slice(a, b - a), pa.array([len(x[0]) for x in found], pa.int64()), sha([x[3] for x in found]), sha([x[4] for x in found]), sha(spans_of)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"]
                if ids:
                    columns.append(lists([x[0] for x in found]))
                    names.append("ids")
                if spans:
                    columns += [lists([x[k] for x in found]) for k in (1, 2)]
                    names += ["begins", "ends"]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string{extra}")
