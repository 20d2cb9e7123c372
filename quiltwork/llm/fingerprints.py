"""Order MinHash fingerprints, in DataFrame functions only.

A text's k-mers are k words in a row, each numbered by how many equal ones stand before it. Under each of `parts` hashes,
of all numbered k-mers the least and the least under the hash's complement (the greatest) are selected, put back into text
order and hashed as a tuple. Both are selected without replacement by one random order, so two texts agree in a part as
often as if the two least were taken: when both of the union's are common to them and stand in the same order. The share
of equal parts falls with the edit distance and with moved passages alike.

Numbered k-mers become rows and a hash aggregate keeps the minimum and maximum of every part, so a text's selection needs
a fixed number of words of memory. Texts, their edited texts and their fingerprints stay in the task that their ids belong to: one shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiltwork.llm.common import words

#: Low bits of a numbered k-mer: its position. No array is longer.
POSITION_BITS = 31
POSITION = (1 << POSITION_BITS) - 1


@dataclass(frozen=True)
class FingerprintOptions:
    k: int = 3
    parts: int = 32
    #: Bytes of text of neighbouring ids that are compared together.
    bucket_bytes: int = 1 << 20
    coarse_buckets: int = 1024


def bind(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def numbered_kmers(text: Column, k: int) -> Column:
    """For each k-mer a hash of its words and its occurrence number (33 bits), then its position; shorter k-mers end the text. Texts without words have one that no other has.

    Equal k-mers are neighbours in a sorted array; how many stand before one is found by adding powers of two as long as
    the element that far back is still equal.
    """
    steps = F.array(*[F.lit(1 << b) for b in range(30, -1, -1)])

    def packed(hashes: Column) -> Column:
        def at(x: Column, i: Column) -> Column:
            return F.xxhash64(x, *[F.get(hashes, i + d) for d in range(1, k)]).bitwiseAND(~POSITION).bitwiseOR(i.cast("long"))

        return F.transform(hashes, at)

    def whole(sorted_: Column) -> Column:
        def back(x: Column, i: Column, n: Column) -> Column:
            return F.shiftright(F.get(sorted_, i - n), POSITION_BITS) == F.shiftright(x, POSITION_BITS)

        def occurrence(x: Column, i: Column) -> Column:
            many = F.aggregate(steps, F.lit(0), lambda n, step: F.when((step <= i - n) & back(x, i, n + step), n + step).otherwise(n))
            return F.when((i > 0) & back(x, i, F.lit(1)), many).otherwise(F.lit(0))

        return F.transform(sorted_, lambda x, i: F.xxhash64(F.shiftright(x, POSITION_BITS), occurrence(x, i)).bitwiseAND(~POSITION).bitwiseOR(x.bitwiseAND(POSITION)))

    found = bind(F.sort_array(bind(F.transform(words(text), lambda w: F.xxhash64(w)), packed)), whole)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(-1)))


def fingerprints(df: DataFrame, keys: list[str], text: Column, parts: int, k: int) -> DataFrame:
    """keys and fingerprint, an array of parts numbers below 2 ** 32, of the rows that have those keys (which tell texts apart).

    Null, empty and blank texts have one and the same fingerprint, which no other text has (but for hash collisions).
    """
    rows = df.select(*keys, F.explode(numbered_kmers(text, k)).alias("x"))
    ranks = [F.xxhash64(F.shiftright("x", POSITION_BITS), F.lit(p)).bitwiseAND(~POSITION).bitwiseOR(F.col("x").bitwiseAND(POSITION)).alias(f"r{p}") for p in range(parts)]
    ends = rows.select(*keys, *ranks).groupBy(*keys).agg(*[F.min(f"r{p}").alias(f"a{p}") for p in range(parts)], *[F.max(f"r{p}").alias(f"b{p}") for p in range(parts)])

    def part(p: int) -> Column:
        least, most = F.col(f"a{p}"), F.col(f"b{p}")
        in_order = least.bitwiseAND(POSITION) <= most.bitwiseAND(POSITION)
        one, two = F.shiftright(F.when(in_order, least).otherwise(most), POSITION_BITS), F.shiftright(F.when(in_order, most).otherwise(least), POSITION_BITS)
        return F.xxhash64(one, two).bitwiseAND(0xFFFFFFFF)

    return ends.select(*keys, F.array(*[part(p) for p in range(parts)]).alias("fingerprint"))


def with_fingerprint(df: DataFrame, text: Column, to: str, options: FingerprintOptions = FingerprintOptions()) -> DataFrame:
    """df with the fingerprint of a text in a column of its own. Equal texts are fingerprinted once; they are told apart by SHA-256."""
    keyed = df.withColumn("_key", F.sha2(F.coalesce(text, F.lit("")), 256))
    found = fingerprints(keyed.select("_key", text.alias("_text")).dropDuplicates(["_key"]), ["_key"], F.col("_text"), options.parts, options.k)
    return keyed.join(found.withColumnRenamed("fingerprint", to), "_key").drop("_key")


def likeness(one: Column, two: Column) -> Column:
    """Share of equal parts, 0 to 1."""
    return F.size(F.filter(F.zip_with(one, two, lambda a, b: a == b), lambda same: same)) / F.size(one)


def as_text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def in_buckets(rows: DataFrame, options: FingerprintOptions) -> DataFrame:
    """rows (doc_id, text) with _bucket and _copy: neighbours by doc_id share a bucket, and at its end stands a copy of the row that follows.

    Buckets hold about equally many bytes: quantiles of the id, weighted by size, each cut into equal widths. Null ids come
    last, in buckets by the text's hash; equal ids share a bucket.
    """
    size = F.octet_length("text")
    rows = rows.withColumn("_null", F.col("doc_id").isNull()).withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")))
    known = {r["_null"]: r["bytes"] or 0 for r in rows.groupBy("_null").agg(F.sum(size).alias("bytes")).collect()}
    coarse = max(1, min(options.coarse_buckets, known.get(False, 0) // options.bucket_bytes))
    weighted = rows.where(~F.col("_null")).select("_id", F.explode(F.sequence(F.lit(0), F.least(F.shiftright(size, 12), F.lit(1 << 20)))))
    bounds = weighted.approxQuantile("_id", [k / coarse for k in range(coarse + 1)], 0.1 / coarse) if False in known else []
    bounds = sorted({min(int(x), (1 << 63) - 1) for x in bounds}) or [0]
    fine = max(1, known.get(False, 0) // (coarse * options.bucket_bytes))
    nulls = max(1, known.get(True, 0) // options.bucket_bytes)
    lows = F.array(*[F.lit(b) for b in bounds])
    zone = F.greatest(F.size(F.filter(lows, lambda b: b <= F.col("_id"))) - 1, F.lit(0))
    low = F.get(lows, F.col("_zone")).cast("double")
    high = F.coalesce(F.get(lows, F.col("_zone") + 1).cast("double"), F.lit(bounds[-1]).cast("double") + 1)
    share = F.when(F.col("_null"), F.col("_id").cast("double") / float(1 << 64) + 0.5).otherwise((F.col("_id").cast("double") - low) / F.greatest(high - low, F.lit(1.0)))
    many = F.when(F.col("_null"), F.lit(nulls)).otherwise(F.lit(fine))
    within = F.least(F.greatest(F.floor(share * many), F.lit(0)), many - 1)
    rows = rows.withColumn("_zone", F.when(F.col("_null"), F.lit(len(bounds))).otherwise(zone)).withColumn("_bucket", (F.col("_zone").cast("long") * fine + within).cast("long"))
    first = rows.groupBy("_zone", "_bucket").agg(F.min(F.struct("_null", "_id", "text", "doc_id")).alias("_first"))
    zones = first.groupBy("_zone").agg(F.max("_bucket").alias("_end"))
    # At most coarse_buckets + 1 zones; the zone before the first is the last.
    zones = zones.select("_zone", F.expr("coalesce(lag(_end) over (order by _zone), max(_end) over ())").alias("_before"))
    copies = first.withColumn("_own", F.expr("lag(_bucket) over (partition by _zone order by _bucket)")).join(F.broadcast(zones), "_zone")
    names = ["doc_id", "text", "_null", "_id"]
    copies = copies.select(F.coalesce("_own", "_before").alias("_bucket"), F.lit(1).alias("_copy"), *[F.col(f"_first.{c}").alias(c) for c in names])
    return rows.select("_bucket", F.lit(0).alias("_copy"), *names).unionByName(copies)


def compare_with_edits(docs: DataFrame, options: FingerprintOptions = FingerprintOptions()) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose second half is the start of the next document.

    Null texts count as empty; repeated rows stay and follow one another; other columns are left out. A single document
    follows itself. An empty table gives no rows. Equal ids are ordered by text, null ids come last, by the text's hash.
    """
    o = options
    placed = in_buckets(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), o)
    # What follows reads each bucket where it lies.
    placed = placed.repartition("_bucket")
    order = "partition by _bucket order by _copy, _id, text"
    placed = placed.selectExpr("_bucket", "_copy", "doc_id", "text", f"row_number() over ({order}) as _nth", f"lead(text) over ({order}) as next")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next"), F.lit(1), half))
    placed = placed.select("_bucket", "_copy", "_nth", "doc_id", "text", n.cast("long").alias("n_chars"), F.when(F.col("_copy") == 0, edited).alias("edited"))
    both = placed.select("_bucket", "_copy", "_nth", "doc_id", "n_chars", F.explode(F.array(
        F.struct(F.lit(0).alias("_which"), F.col("text"), F.lit("").alias("sha")), F.struct(F.lit(1).alias("_which"), F.col("edited").alias("text"), F.sha2("edited", 256).alias("sha"))
    )).alias("_t")).where("_t.text is not null").select("_bucket", "_copy", "_nth", "doc_id", "n_chars", "_t._which", "_t.text", "_t.sha")
    found = fingerprints(both, ["_bucket", "_copy", "_nth", "doc_id", "n_chars", "_which", "sha"], F.col("text"), o.parts, o.k)
    # A row's edited text comes next, and after it the row that follows.
    order = "partition by _bucket order by _nth, _which"
    found = found.selectExpr("*", *[f"lead({c}, {k}) over ({order}) as {to}" for c, k, to in (("fingerprint", 1, "edited"), ("fingerprint", 2, "next"), ("sha", 1, "edited_sha256"))]).where("_which = 0 and _copy = 0")
    return found.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("fingerprint")).alias("fingerprint"), as_text(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next")).alias("near_next"),
    )
