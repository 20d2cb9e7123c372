"""The tables seen as what a packer works on: sprites, pixel blocks, contents, change events, paths and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sprites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, w, h, folder, ord of each part."""
    return table(spark, sf_dir, "part").select(
        F.concat_ws("_", F.replace("p_name", F.lit(" "), F.lit("_")), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("id"),
        F.col("p_size").cast("long").alias("w"), (F.col("p_partkey") % 37 + 1).cast("long").alias("h"), F.col("p_type").alias("folder"), F.col("p_partkey").alias("ord"),
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, k, r, g, b, a: each embedding's 64 numbers as the 16 pixels of a block."""
    level = F.transform("embedding", lambda e: F.least(F.greatest(F.floor((e.cast("double") + 1) * 127.5), F.lit(0)), F.lit(255)).cast("long"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", level.alias("c")).select("vec_id", "c", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k"))
    return rows.select("vec_id", F.col("k").cast("long").alias("k"), *[F.get("c", F.col("k") * 4 + i).alias(x) for i, x in enumerate("rgba")])


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id and path: the url without scheme, query and fragment."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^[A-Za-z]+://", ""), "[?#].*$", "").alias("path"))


SPRITES = "sprites AS (SELECT replace(p_name, ' ', '_') || '_' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS id, CAST(p_size AS BIGINT) AS w, CAST(p_partkey % 37 + 1 AS BIGINT) AS h, p_type AS folder, p_partkey AS ord FROM part)"
PIXELS = """levels AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(least(greatest(floor((CAST(e AS DOUBLE) + 1) * 127.5), 0), 255) AS BIGINT)) AS c FROM embeddings),
    pixels AS (SELECT vec_id, CAST(k AS BIGINT) AS k, c[4 * k + 1] AS r, c[4 * k + 2] AS g, c[4 * k + 3] AS b, c[4 * k + 4] AS a FROM levels, (SELECT unnest(range(16)) AS k))"""
PATHS = "paths AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[A-Za-z]+://', ''), '[?#].*$', '') AS path FROM pages)"
