"""Near-duplicate documents by HyperMinHash.

A document's set of word shingles is sketched in buckets; a bucket keeps of its least hash the number of leading zeros and
a few bits of mantissa. Bands of registers that agree make candidates, the share of agreeing registers, corrected for
chance agreement, estimates their Jaccard similarity, and the full sets confirm every link. Small sets, whose few registers
can all be missed by banding, meet by their prefix as well: of two sets so alike, the least hashes share one.

Documents with equal sets are one class. Classes that share a band are first compared with its least class and with the
least of a small part of it; links merge classes into components. What then still shares a band across components is
compared pair by pair within pieces of bounded size. A piece confirms its pairs itself, joins what is linked, and sends one
link for each component that it merged, so neither pairs nor links grow with the square of a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from quiltwork.llm.common import materialise, release
from quiltwork.llm.components import components
from quiltwork.llm.rolling import batches, mix, windows, word_hashes

EMPTY = 0xFFFF
#: Rows of a partition of classes, band members and pairs.
ROWS = 20_000


@dataclass(frozen=True)
class NearOptions:
    """Links: percent * union <= 100 * intersection. A pair at the threshold shares no band with probability 5e-8 at most, and is never missed if a set has no more than `small` shingles."""

    shingle: int = 5
    percent: int = 80
    registers: int = 128
    band: int = 4
    mantissa: int = 10
    #: Pairs whose estimate is lower aren't confirmed: nearly six standard deviations below the threshold. Small sets have no estimate to pass.
    least_estimate: float = 0.6
    #: Sets of so few shingles are also found by their prefix.
    small: int = 16
    #: Rounds of comparing each class with one other before all that is left is compared.
    rounds: int = 2
    #: Classes of a band in the parts whose least is a candidate in a round.
    part: int = 8
    #: Classes of one band in a block; a piece compares two blocks.
    block: int = 4000

    @property
    def many(self) -> int:
        return self.registers // self.band


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted hashes of the distinct k-word shingles of each text, A-Z lower-cased; of fewer words, of the whole sequence."""
    raw, out = [(t or "").encode("utf-8", "surrogatepass") for t in texts], []
    for a, b in batches(raw, 500_000):
        hashes, _, _, first = word_hashes(raw[a:b], lower=True)
        every = windows(hashes, k)
        for i, j in zip(first[:-1], first[1:], strict=True):
            if j - i >= k:
                out.append(np.unique(every[i : j - k + 1]))
            else:
                out.append(windows(hashes[i:j], j - i) if j > i else np.zeros(0, np.uint64))
    return out


def sketch(shingles: np.ndarray, options: NearOptions) -> np.ndarray:
    """Registers of a set: leading zeros and mantissa of the least hash of each bucket, EMPTY without any."""
    out = np.full(options.registers, EMPTY, np.uint16)
    if not len(shingles):
        return out
    bits = options.registers.bit_length() - 1
    bucket, first = np.unique(shingles >> np.uint64(64 - bits), return_index=True)  # sorted, so the first is the least
    rest = (shingles[first] << np.uint64(bits)) | np.uint64((1 << bits) - 1)
    zeros = 63 - np.minimum(np.log2(rest.astype(np.float64)).astype(np.int64), 63)
    zeros -= (rest >> np.minimum(64 - zeros, 63).astype(np.uint64)) * (zeros > 0) > 0  # the logarithm may round up
    left = rest << (zeros + 1).astype(np.uint64)
    out[bucket.astype(np.int64)] = (zeros.astype(np.uint16) << np.uint16(options.mantissa)) | (left >> np.uint64(64 - options.mantissa)).astype(np.uint16)
    return out


def bands(registers: np.ndarray, options: NearOptions) -> tuple[np.ndarray, np.ndarray]:
    """Row and number of each band that isn't empty throughout, of registers a row for each set; the number's remainder by many + 1 says which band."""
    parts = registers.reshape(len(registers), options.many, options.band)
    row, k = np.nonzero((parts != EMPTY).any(axis=2))
    value = np.zeros(len(row), np.uint64)
    for d in range(options.band):
        value = mix(value + parts[row, k, d].astype(np.uint64) + np.uint64(1))
    return row, numbered(value, k.astype(np.uint64), options)


def numbered(value: np.ndarray, k: np.ndarray | np.uint64, options: NearOptions) -> np.ndarray:
    """Hashes as numbers of 62 bits whose remainder by many + 1 is k."""
    step = np.uint64(options.many + 1)
    return (((value >> np.uint64(2)) // step) * step + k).astype(np.int64)


def prefix(shingles: np.ndarray, options: NearOptions) -> np.ndarray:
    """Of a small set the least hashes, so many that every set as near as a link asks for has one of them among its own."""
    n = len(shingles)
    return shingles[: n + 1 - -(-options.percent * n // 100)] if 0 < n <= options.small else shingles[:0]


def estimate(one: np.ndarray, two: np.ndarray, options: NearOptions) -> np.ndarray:
    """Jaccard similarity by row: agreeing registers, without those that agree by chance, of those not empty in both."""
    used = (one != EMPTY) | (two != EMPTY)
    same = (used & (one == two)).sum(axis=1) / np.maximum(used.sum(axis=1), 1)
    chance = 0.1699 / (1 << options.mantissa)
    return np.maximum(0, (same - chance) / (1 - chance))


def profile(docs: DataFrame, options: NearOptions, id_col: str, text_col: str) -> DataFrame:
    """doc_id, a hash of the text, size and digest of the set, registers, and the prefix of small sets."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tkey"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = shingle_sets(part.column(1).to_pylist(), options.shingle)
            digests = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in found], pa.binary())
            registers = pa.array([sketch(s, options).tobytes() for s in found], pa.binary())
            firsts = pa.array([numbered(prefix(s, options), np.uint64(options.many), options).tobytes() for s in found], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([len(s) for s in found], pa.int64()), digests, registers, firsts], ["doc_id", "tkey", "n", "key", "registers", "firsts"])

    return rows.mapInArrow(run, "doc_id bigint, tkey bigint, n bigint, key binary, registers binary, firsts binary")


def with_bands(classes: DataFrame, options: NearOptions) -> DataFrame:
    """id and band, a row for each band of a class and each hash of a small set's prefix."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids = part.column(0).to_numpy()
            row, band = bands(np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, options.registers), options)
            firsts = part.column(2).to_pylist()
            own = np.repeat(ids, [len(f) // 8 for f in firsts])
            yield pa.RecordBatch.from_arrays([pa.array(np.append(ids[row], own), pa.int64()), pa.array(np.append(band, np.frombuffer(b"".join(firsts), np.int64)), pa.int64())], ["id", "band"])

    return classes.select("id", "registers", "firsts").mapInArrow(run, "id bigint, band bigint")


def packed_texts(docs: DataFrame) -> DataFrame:
    """docs (doc_id, tkey, text) with the text compressed."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=3)
        for part in parts:
            texts = pa.array([small.compress((t or "").encode("utf-8", "surrogatepass")) for t in part.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts], ["doc_id", "tkey", "packed"])

    return docs.mapInArrow(run, "doc_id bigint, tkey bigint, packed binary")


def sets_of(packed: list[bytes], options: NearOptions) -> list[np.ndarray]:
    large = zstandard.ZstdDecompressor()
    return shingle_sets([large.decompress(p).decode("utf-8", "surrogatepass") for p in packed], options.shingle)


def linked(one: np.ndarray, two: np.ndarray, options: NearOptions) -> bool:
    """Whether two full sets, sorted, make a link."""
    both = len(np.intersect1d(one, two, assume_unique=True))
    return 100 * both >= options.percent * (len(one) + len(two) - both)


def confirmed(pairs: DataFrame, options: NearOptions) -> DataFrame:
    """Of pairs (a, b, ta, tb: packed texts) those whose full sets make a link. Sets are built once for each text of some pairs."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            # A few pairs at a time, so that few sets are held.
            for at in range(0, whole.num_rows, 400):
                part = whole.slice(at, 400)
                a, b = (part.column(k).to_pylist() for k in (0, 1))
                texts = dict(zip(a + b, part.column(2).to_pylist() + part.column(3).to_pylist(), strict=True))
                known = dict(zip(texts, sets_of(list(texts.values()), options), strict=True))
                good = pa.array([linked(known[x], known[y], options) for x, y in zip(a, b, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(good), part.column(1).filter(good)], ["a", "b"])

    return pairs.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def alike(members: DataFrame, sketches: DataFrame, options: NearOptions, texts: DataFrame | None = None) -> DataFrame:
    """Compares a band's members (band, id, c, m: how many they are) whose components differ and whose sizes and estimates allow a link; sketches: id, n, registers.

    Without texts the ids that are in some such pair are returned (a = b = id). With them (id, packed) the full sets
    decide, and the links returned join the components of a piece: at most one fewer than it has.
    A pair is looked at in the first band that both share. Members of a band are cut into blocks, and every two blocks are
    compared in a piece of their own, so no piece holds more than two blocks.
    """
    o, many = options, options.many
    confirm = texts is not None
    blocks = F.ceil(F.col("m") / o.block).cast("int")
    own = members.withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    own = own.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "c")
    # What is wide joins last, so it moves once.
    own = own.join(sketches.select("id", "n", "registers"), "id")
    own = own.join(texts.select("id", "packed"), "id") if confirm else own
    dealt = own.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "id")

    def compare(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        band, i, j = (part.column(x)[0].as_py() for x in ("band", "i", "j"))
        own, ids, c, n = (part.column(x).to_numpy() for x in ("own", "id", "c", "n"))
        registers = np.frombuffer(b"".join(part.column("registers").to_pylist()), np.uint16).reshape(len(ids), o.registers)
        packed = part.column("packed") if confirm else None
        sets: dict[int, np.ndarray] = {}
        able = np.zeros(len(ids), bool)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        a, b = [ids[:0]], [ids[:0]]
        step = max(1, 40_000 // max(1, len(right)))
        for at in range(0, len(left), step):
            x, y = (v.ravel() for v in np.meshgrid(left[at : at + step], right, indexing="ij"))
            take = (c[x] != c[y]) & (100 * np.minimum(n[x], n[y]) >= o.percent * np.maximum(n[x], n[y])) & ((x < y) | (i != j))
            x, y = x[take], y[take]
            one, two = registers[x], registers[y]
            good = (estimate(one, two, o) >= o.least_estimate) | (np.maximum(n[x], n[y]) <= o.small)
            x, y, one, two = x[good], y[good], one[good], two[good]
            agree = ((one == two).reshape(len(x), many, o.band).all(axis=2)) & (one != EMPTY).reshape(len(x), many, o.band).any(axis=2)
            slot = band % (many + 1)
            first = ~agree.any(axis=1) if slot == many else agree[:, : slot + 1].argmax(axis=1) == slot
            x, y = x[first], y[first]
            if not confirm:
                able[x] = able[y] = True
                continue
            wanted = [k for k in np.union1d(x, y).astype(np.int64).tolist() if k not in sets]
            sets.update(zip(wanted, sets_of([packed[k].as_py() for k in wanted], o), strict=True))
            for p, q in zip(x.tolist(), y.tolist(), strict=True):
                if c[p] != c[q] and linked(sets[p], sets[q], o):
                    a.append(ids[p : p + 1])
                    b.append(ids[q : q + 1])
                    c = np.where(c == c[q], c[p], c)  # one component from now on
        return (np.concatenate(a), np.concatenate(b)) if confirm else (ids[able], ids[able])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for part in parts:
            table = pa.Table.from_batches([part]) if held is None else pa.concat_tables([held, pa.Table.from_batches([part])])
            marks = np.stack([table.column(x).to_numpy() for x in ("band", "i", "j")])
            edge = np.append(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1, len(table))
            start, found = 0, []
            for end in edge[:-1]:
                if end - start > 1:
                    found.append(compare(table.slice(start, end - start)))
                start = end
            held = table.slice(start)
            if found:
                yield out(found)
        if held is not None and len(held) > 1:
            yield out([compare(held)])

    def out(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], ["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint")


def likely(options: NearOptions):
    """Whether registers allow a link."""

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        one, two = (np.frombuffer(b"".join(x.to_pylist()), np.uint16).reshape(len(x), options.registers) for x in (a, b))
        return pa.array(estimate(one, two, options) >= options.least_estimate)

    return F.arrow_udf(run, BooleanType())


class Comparison:
    """The classes of a table and the components found among them so far."""

    def __init__(self, docs: DataFrame, options: NearOptions, id_col: str, text_col: str) -> None:
        self.options = options
        self.rows = materialise(profile(docs, options, id_col, text_col), ROWS)
        # No step has more rows than there are documents, but for the members of bands.
        self.most = max(1, self.rows.count())
        # Ids may repeat with other texts, so a class has a number of its own (fixed by the checkpoint) beside its least row.
        classes = self.rows.where(F.col("doc_id").isNotNull() & (F.col("n") > 0)).groupBy("key")
        classes = classes.agg(F.min(F.struct("doc_id", "tkey")).alias("least"), *[F.first(x).alias(x) for x in ("n", "registers", "firsts")])
        self.classes = materialise(classes.select("key", "least.doc_id", "least.tkey", "n", "registers", "firsts").withColumn("id", F.monotonically_increasing_id()), ROWS, self.most)
        self.rows = self.rows.drop("registers", "firsts")
        every = with_bands(self.classes, options)
        sizes = every.groupBy("band").agg(F.count("*").alias("m")).where("m > 1")
        self.members = materialise(every.join(sizes, "band").select("id", "band", "m"), ROWS, 4 * self.most)  # classes that share a band with others
        sketches = self.classes.join(self.members.select("id").distinct(), "id", "left_semi")
        self.sketches = materialise(sketches.select("id", "doc_id", "tkey", "n", "registers"), ROWS, self.most)
        packed = packed_texts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tkey"), F.col(text_col).alias("text")))
        own = packed.join(self.sketches.select("doc_id", "tkey", "id"), ["doc_id", "tkey"])
        self.texts = materialise(own.groupBy("doc_id", "tkey", "id").agg(F.first("packed").alias("packed")).select("id", "packed"), ROWS // 4, self.most)
        release(docs.sparkSession)
        self.compared: DataFrame | None = None
        self.parts: DataFrame | None = None

    def component(self, of: DataFrame, column: str, to: str) -> DataFrame:
        if self.parts is None:
            return of.withColumn(to, F.col(column))
        return of.join(self.parts.select(F.col("node").alias(column), F.col("component").alias("_c")), column, "left").withColumn(to, F.coalesce("_c", column)).drop("_c")

    def merge(self, found: DataFrame) -> None:
        """Joins the components of linked classes (a, b)."""
        if not found.isEmpty():
            self.parts = components(found if self.parts is None else found.union(self.parts.select(F.col("node").alias("a"), F.col("component").alias("b"))), 2 * self.most)
        release(found.sparkSession)

    def compare(self, pairs: DataFrame) -> None:
        """Confirms pairs (a, b), one for each class at most, and merges the components of those that are linked."""
        o, s = self.options, self.sketches
        pairs = materialise(pairs, ROWS, self.most)
        self.compared = pairs if self.compared is None else self.compared.union(pairs)
        left, right = (s.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("registers").alias(f"r{x}")) for x in "ab")
        able = (100 * F.least("na", "nb") >= o.percent * F.greatest("na", "nb")) & (likely(o)("ra", "rb") | (F.greatest("na", "nb") <= o.small))
        pairs = pairs.join(left, "a").join(right, "b").where(able).select("a", "b")
        left, right = (self.texts.select(F.col("id").alias(x), F.col("packed").alias(f"t{x}")) for x in "ab")
        self.merge(materialise(confirmed(pairs.join(left, "a").join(right, "b"), o), ROWS // 4, self.most))

    def mixed(self) -> DataFrame:
        """Members of bands whose members are in several components: band, id, m, c."""
        members = self.component(self.members, "id", "c")
        open_ = members.groupBy("band").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x != y").select("band")
        return materialise(members.join(open_, "band").select("id", "band", "m", "c"), ROWS, 4 * self.most)

    def run(self) -> DataFrame:
        """node and component of the classes that are linked to another, except the least of a component."""
        o, members = self.options, self.members.withColumn("c", F.col("id"))
        for k in range(o.rounds):
            # The least of the band and that of a part of it, dealt anew in each round; of these the one met most often.
            dealt = members.withColumn("part", F.pmod(F.xxhash64("id", F.lit(k)), F.ceil(F.col("m") / o.part)))
            leasts = [members.groupBy("band").agg(F.min("id").alias("p")), dealt.groupBy("band", "part").agg(F.min("id").alias("p"))]
            met = dealt.join(leasts[0], "band").select("id", "c", "p").union(dealt.join(leasts[1], ["band", "part"]).select("id", "c", "p")).where("id != p")
            met = self.component(met, "p", "d").where("c != d").groupBy("id", "p").agg(F.count("*").alias("times"))
            if self.compared is not None:
                known = self.compared.select(F.col("a").alias("id"), F.col("b").alias("p")).union(self.compared.select(F.col("b").alias("id"), F.col("a").alias("p")))
                met = met.join(known, ["id", "p"], "left_anti")
            best = met.groupBy("id").agg(F.max(F.struct("times", "p")).alias("best"))
            self.compare(best.select(F.least("id", "best.p").alias("a"), F.greatest("id", "best.p").alias("b")).distinct())
            members = self.mixed()
            if members.isEmpty():
                break
        else:
            able = materialise(alike(members, self.sketches, o).select(F.col("a").alias("id")).distinct(), ROWS, self.most)
            release(able.sparkSession)
            members = members.join(able, "id", "left_semi")
            sizes = members.groupBy("band").agg(F.count("*").alias("m")).where("m > 1")
            self.merge(materialise(alike(members.drop("m").join(sizes, "band"), self.sketches, o, self.texts), ROWS))
        if self.parts is None:
            return self.sketches.select(F.col("id").alias("node"), F.col("id").alias("component")).limit(0)
        return self.parts


def near_duplicates(docs: DataFrame, options: NearOptions = NearOptions(), id_col: str = "doc_id", text_col: str = "text", text_key: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept and, if asked for, text_key, the text's xxhash64.

    component_id is the least id that links reach, kept says whether it is the document's own. Null, empty and blank texts
    have no shingles and no links. Rows without an id count for nothing and are kept with a null component. Repeated rows
    are duplicates like others; of an id's several texts each has its own component. Other columns are left out.
    """
    found = Comparison(docs, options, id_col, text_col)
    parts = found.run()
    of = found.classes.select("key", "id", F.col("doc_id").alias("least")).join(parts, F.col("id") == F.col("node"), "left").withColumn("part", F.coalesce("component", "id"))
    # A component goes by its least doc_id; classes that are linked to none by their own.
    ends = parts.select(F.col("component").alias("part")).distinct()
    first = of.join(ends, "part", "left_semi").groupBy("part").agg(F.min("least").alias("first"))
    of = of.join(first, "part", "left").select("key", F.coalesce("first", "least").alias("component"))
    rows = found.rows.join(of, "key", "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), *[F.col("tkey").alias("text_key")] * text_key)


def without_near_duplicates(docs: DataFrame, options: NearOptions = NearOptions()) -> DataFrame:
    """The rows of docs, with all columns, that near_duplicates() keeps: one of each component, one of rows alike in id and text. Rows without an id stay."""
    kept = near_duplicates(docs, options, text_key=True).where("kept and doc_id is not null").select("doc_id", F.col("text_key").alias("_key")).distinct()
    # The row is one column, so that its names can't clash.
    keyed = docs.select("doc_id", F.xxhash64("text").alias("_key"), F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    return keyed.join(kept, ["doc_id", "_key"], "left_semi").dropDuplicates(["doc_id", "_key"]).select("_row.*").union(docs.where(F.col("doc_id").isNull()))
