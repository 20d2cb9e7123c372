"""Exact duplicates: the first item with a content owns it, later ones are its aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def aliases(df: DataFrame, content: str, id_: str, order: str, within: list[str] | None = None) -> DataFrame:
    """df's id columns with alias_of: the id of the first item with the same content (null for owners).

    Contents meet by a 256-bit digest, so whole buffers aren't shuffled; owners are found by aggregation, so a content
    that very many items have needs no window over them. Null contents are alike. `within` are columns that must agree too.
    """
    keys = ["_digest", *(within or [])]
    digested = df.select(id_, order, *(within or []), F.coalesce(F.sha2(F.col(content).cast("binary"), 256), F.lit("none")).alias("_digest"))
    owner = digested.groupBy(*keys).agg(F.min(F.struct(order, id_)).alias("_own"))
    found = digested.join(owner, keys)
    return found.select(id_, order, *(within or []), F.when(F.col(f"_own.{order}") != F.col(order), F.col(f"_own.{id_}")).alias("alias_of"))


def alias_summary(aliased: DataFrame, id_: str) -> DataFrame:
    """One row: items, owners, aliases, and owners that have aliases."""
    return aliased.agg(
        F.count("*").alias("items"), F.sum(F.col("alias_of").isNull().cast("long")).alias("owners"),
        F.sum(F.col("alias_of").isNotNull().cast("long")).alias("aliases"), F.countDistinct("alias_of").alias("shared"),
    )


def duplicate_ids(df: DataFrame, id_: str) -> DataFrame:
    """Ids that several rows have, with how many."""
    return df.groupBy(id_).agg(F.count("*").alias("times")).where("times > 1")


def alias_targets(aliased: DataFrame, id_: str) -> DataFrame:
    """Items that some alias points to."""
    return aliased.join(aliased.where("alias_of is not null").select(F.col("alias_of").alias(id_)).distinct(), id_, "left_semi")
