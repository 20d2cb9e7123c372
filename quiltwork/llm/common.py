"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
WORD_GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """Words of a text in order; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words. Runs of other characters shrink to one letter first, so no array is built."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_bucket(doc_id: Column, buckets: int) -> Column:
    """crc32 of the decimal doc_id, modulo buckets (null id: as the empty string)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % buckets


def near_least(hashed: Column, wanted: int, total: Column) -> Column:
    """Whether a hash is among the least of `total` rows, of which about three times `wanted` are let through.

    Taking the least `wanted` of those is then the same as taking them of all, but for bad luck that can leave fewer; and
    what tasks send no longer grows with their number.
    """
    share = F.least(F.lit(1.0), F.lit(3.0 * wanted + 50) / F.greatest(total, F.lit(1)))
    return F.pmod(F.shiftrightunsigned(hashed, 34), F.lit(1 << 30)) < F.ceil(share * (1 << 30))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a session of one process, as in tests, may leave it out."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get()
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file:///tmp/checkpoints/{uuid.uuid4().hex}"
    return folder


def materialise(df: DataFrame, rows: int = 0, most: int = 0) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder; with rows, partitions of about so many rows at most follow.

    Steps that go back and forth between small tables would else run as many tasks, and leave as many shuffle and
    checkpoint files, as the session has shuffle partitions, however few rows there are. most: a known bound on the rows,
    by which they are gathered before they are written.
    """
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    kept = (df.coalesce(max(1, -(-most // rows))) if rows and most else df).checkpoint(eager=True)
    if rows:
        many = max(1, -(-kept.count() // rows))
        kept = kept.coalesce(many) if many < kept.rdd.getNumPartitions() else kept
    return kept


def group_key(value: Column) -> Column:
    """Values as texts that are never null and sort bytewise, null first."""
    return F.when(value.isNull(), "a").otherwise(F.concat(F.lit("b"), value.cast("string")))


def numbered(rows: DataFrame, group: str, order: list[str], many: str = "n", place: str = "pos") -> DataFrame:
    """rows with each one's place in its group, from 0, and the group's size. A range shuffle cuts large groups; only counts by partition and group are summed up.

    Rows alike in all columns of the order are interchangeable.
    """
    laid = materialise(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = laid.groupBy(group, part.alias("_part")).agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    sums = counts.withColumns({"_before": F.expr(f"sum(_rows) over (partition by {group} order by _part) - _rows"), many: F.expr(f"sum(_rows) over (partition by {group})")})
    known = laid.withColumn("_part", part).join(sums.select(group, "_part", "_first", "_before", many), [group, "_part"])
    return known.withColumn(place, F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_before", "_rows")


def release(spark: SparkSession) -> None:
    """Lets go of steps that are done: Spark deletes shuffle files of plans that no one refers to once the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
