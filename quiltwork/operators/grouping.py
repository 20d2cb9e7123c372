"""Animations, folders and pages as ordered groups."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def animations(df: DataFrame, base: Column, number: Column, id_: str, order: str, least: int = 2, key: list[str] | None = None) -> DataFrame:
    """base, name, frames: items with a base and a number, by base, in the order of number and then of `order`.

    Bases with fewer items than `least` are left out. The name is the base without separators at its end.
    """
    keys = key or []
    rows = df.withColumn("_base", base).withColumn("_number", number).where(F.col("_base").isNotNull() & F.col("_number").isNotNull())
    found = rows.groupBy(*keys, "_base").agg(F.sort_array(F.collect_list(F.struct("_number", order, F.col(id_).alias("_id")))).alias("_frames"))
    return found.where(F.size("_frames") >= least).select(
        *keys, F.col("_base").alias("base"), F.regexp_replace("_base", r"[_\-. ]+$", "").alias("name"), F.col("_frames._id").alias("frames")
    )


def summed_before(df: DataFrame, key: str, value: Column, to: str) -> DataFrame:
    """df with the sum of value over the rows before, by key (nulls first; keys are distinct).

    Keys that begin alike are summed up in a window of their own, and what their beginnings have before them is added: no window holds the table.
    """
    rows = df.withColumn("_head", F.coalesce(F.substring(F.col(key).cast("string"), 1, 4), F.lit(""))).withColumn("_value", value)
    frame = "rows between unbounded preceding and 1 preceding"
    heads = rows.groupBy("_head").agg(F.sum("_value").alias("_all")).withColumn("_before", F.expr(f"coalesce(sum(_all) over (order by _head {frame}), 0)")).drop("_all")
    own = rows.withColumn("_own", F.expr(f"coalesce(sum(_value) over (partition by _head order by {key} {frame}), 0)"))
    return own.join(heads, "_head").withColumn(to, (F.col("_before") + F.col("_own")).cast("long")).drop("_head", "_value", "_own", "_before")


def folders(df: DataFrame, folder: Column) -> DataFrame:
    """folder, items, rank: the root (empty) first, the others in order of name."""
    found = df.groupBy(folder.alias("folder")).agg(F.count("*").alias("items"))
    return summed_before(found, "folder", F.lit(1), "rank").select("folder", "items", "rank")


def page_offsets(pages: DataFrame, group: str, count: str) -> DataFrame:
    """pages (a row for each group, named by text) with first_page: how many pages the groups before have."""
    return summed_before(pages, group, F.col(count), "first_page").select(*pages.columns, "first_page")


def tree_counts(df: DataFrame, path: str) -> DataFrame:
    """folder, files: how many files each folder of the paths holds, subfolders included; the root is empty."""
    parts = F.split(F.col(path), "/")
    each = df.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("folder"))
    return each.groupBy("folder").agg(F.count("*").alias("files"))


def unique_names(df: DataFrame, group: str, name: str, order: str) -> DataFrame:
    """group, order and name, each name with as many _ at its end as it takes to differ from those before it in its group.

    A name depends on all before it, so a group (one exported file) is one task.
    """
    kinds = dict(df.dtypes)

    def number(part: pa.Table) -> pa.Table:
        rows = sorted(zip(part.column(order).to_pylist(), part.column(name).to_pylist(), strict=True))
        seen: set[str] = set()
        out = []
        for _, own in rows:
            while own in seen:
                own += "_"
            seen.add(own)
            out.append(own)
        first = part.column(group)[0]
        return pa.table({group: pa.array([first.as_py()] * len(rows), first.type), order: pa.array([o for o, _ in rows], part.schema.field(order).type), name: pa.array(out, pa.string())})

    return df.select(group, order, name).groupBy(group).applyInArrow(number, f"{group} {kinds[group]}, {order} {kinds[order]}, {name} string")
