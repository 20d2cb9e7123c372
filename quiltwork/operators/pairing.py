"""Joins of items with companions, overrides and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair(items: DataFrame, companions: DataFrame, key: str, name: str, path: str) -> DataFrame:
    """items with companion: the path of the first companion (by path) with their key.

    Where there is none, the only companion with their name, if theirs is also the only item with it.
    """
    by_key = companions.groupBy(key).agg(F.min(path).alias("_by_key"))
    lone = companions.groupBy(name).agg(F.min(path).alias("_by_name"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    single = items.groupBy(name).agg(F.count("*").alias("_n")).where("_n = 1").select(name)
    by_name = lone.join(single, name, "left_semi")
    found = items.join(by_key, key, "left").join(by_name, name, "left")
    return found.withColumn("companion", F.coalesce("_by_key", "_by_name")).drop("_by_key", "_by_name")


def orphans(companions: DataFrame, paired: DataFrame, path: str) -> DataFrame:
    """Companions that no item got."""
    return companions.join(paired.where("companion is not null").select(F.col("companion").alias(path)).distinct(), path, "left_anti")


def with_overrides(items: DataFrame, layers: list[tuple[DataFrame, str]], id_: str, to: str, default: object) -> DataFrame:
    """items with a value: of the first layer (id, value) that has one, else the default. A layer has an id once."""
    found, values = items, []
    for k, (layer, value) in enumerate(layers):
        found = found.join(layer.select(F.col(id_), F.col(value).alias(f"_v{k}")), id_, "left")
        values.append(F.col(f"_v{k}"))
    return found.withColumn(to, F.coalesce(*values, F.lit(default))).drop(*[f"_v{k}" for k in range(len(layers))])


def owned(items: DataFrame, listed: DataFrame, item: str, index: str, default: int) -> DataFrame:
    """items with group_index: of the groups that list them the first, else the default."""
    first = listed.groupBy(item).agg(F.min(index).alias("_first"))
    return items.join(first, item, "left").withColumn("group_index", F.coalesce("_first", F.lit(default))).drop("_first")
