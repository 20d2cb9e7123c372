"""Discovery, filters and set operations over tables of named items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiltwork.functions.text import any_glob, file_name, pattern_list


def discover(roots: list[DataFrame], key: str, excluded: DataFrame | None = None, ignore: list[str] | None = None) -> DataFrame:
    """Rows of all roots, one for each key (of the first root that has it), without excluded keys and ignored patterns."""
    found = None
    for k, root in enumerate(roots):
        part = root.withColumn("_root", F.lit(k))
        found = part if found is None else found.unionByName(part)
    if ignore:
        found = found.where(~any_glob(F.col(key), ignore))
    if excluded is not None:
        found = found.join(excluded.select(key).distinct(), key, "left_anti")
    rest = [c for c in found.columns if c not in (key, "_root")]
    best = found.groupBy(key).agg(F.min(F.struct("_root", *rest)).alias("_best"))
    return best.select(key, *[F.col(f"_best.{c}").alias(c) for c in rest])


def without_ignored(df: DataFrame, path: str, patterns: list[str]) -> DataFrame:
    """Rows whose path and file name match none of the patterns."""
    return df.where(~any_glob(F.col(path), patterns) & ~any_glob(file_name(F.col(path)), patterns))


def included(df: DataFrame, name: str, names: str) -> DataFrame:
    """Rows whose name, or its last component, matches one of a comma list of patterns; an empty list keeps all."""
    patterns = pattern_list(names)
    return df.where(any_glob(F.col(name), patterns) | any_glob(file_name(F.col(name)), patterns)) if patterns else df


def inside(x: Column, y: Column, w: Column, h: Column, region: tuple[int, int, int, int]) -> Column:
    """Whether a rectangle has area in common with a region given by two opposite corners, in any order."""
    x0, x1, y0, y1 = min(region[0], region[2]), max(region[0], region[2]), min(region[1], region[3]), max(region[1], region[3])
    return (x < x1) & (x + w > x0) & (y < y1) & (y + h > y0)


def moved(members: DataFrame, taken: DataFrame, item: str, group: str) -> DataFrame:
    """Membership after items were moved: what taken lists leaves its groups and joins the one given there."""
    return members.join(taken.select(item), item, "left_anti").select(item, group).union(taken.select(item, group)).distinct()


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that went and rows that came, with how often; rows in both as often as the fewer don't count."""
    columns = before.columns
    signed = before.withColumn("_n", F.lit(-1)).unionByName(after.withColumn("_n", F.lit(1))).groupBy(*columns).agg(F.sum("_n").alias("_n"))
    return signed.where("_n != 0").select(*columns, F.when(F.col("_n") > 0, "added").otherwise("removed").alias("change"), F.abs("_n").cast("long").alias("times"))


def last_wins(df: DataFrame, key: str, position: str, value: str) -> DataFrame:
    """For each key the value at its last position."""
    return df.groupBy(key).agg(F.max_by(value, position).alias(value))


def newest(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last n rows of each key with their place, newest first: a bounded stack."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))
    return df.withColumn("place", place.cast("long")).where(F.col("place") <= n)


def restored(excluded: DataFrame, back: DataFrame, key: str) -> DataFrame:
    """What stays excluded once some are restored."""
    return excluded.join(back.select(key).distinct(), key, "left_anti")
