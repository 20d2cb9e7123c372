"""A Merkle manifest of a table: a tree for each source, a tree of the sources' roots, and a proof for each row.

A row's leaf is made where the row is read, and texts move no further. Leaves are ordered by a range shuffle, so no source
has to fit one task. Blocks of 16^3 neighbours are reduced to one node each in parallel; what is left is small, or is
reduced again until it is. The driver builds the trees above these nodes and broadcasts to each block the siblings on its
way to the root; executors then rebuild their blocks, finish the proofs and fold every row up to the root.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiltwork.llm.common import group_key, materialise, numbered

#: What of a row goes into its leaf, in this order.
LEAF = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


@dataclass(frozen=True)
class ManifestOptions:
    """Runs of `arity` nodes have one parent. A block has arity ** block_levels nodes. The driver builds what is above `top_nodes` nodes: about 4 KB of siblings each, 16 MB in all."""

    arity: int = 16
    block_levels: int = 3
    top_nodes: int = 4096

    @property
    def block(self) -> int:
        return self.arity**self.block_levels


def digest(joined: str) -> str:
    return hashlib.sha256(joined.encode()).hexdigest()


def leaf(*values: Column) -> Column:
    """sha256 of values, each as its length in bytes, a colon and itself; null as a dash."""
    told = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*told), 256)


def tampered(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """Whether a row is tampered with (5 divides the crc32 of its id; never without an id), and the text then: A to Z in lower case."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False)), F.translate(text, letters, letters.lower())


def levels(nodes: list[str], many: int, o: ManifestOptions) -> list[list[str]]:
    """The levels above the nodes of a block, the nodes first: as many as a tree of `many` nodes has, block_levels at most."""
    out = [nodes]
    while many > 1 and len(out) <= o.block_levels:
        last = out[-1]
        out.append([digest("".join(last[k : k + o.arity])) for k in range(0, len(last), o.arity)])
        many = -(-many // o.arity)
    return out


def climb(tree: list[list[str]], k: int, o: ManifestOptions) -> list[tuple[str, str]]:
    """What stands left and right of a node and of its ancestors, level by level below the top."""
    out = []
    for level in tree[:-1]:
        run = k // o.arity * o.arity
        out.append(("".join(level[run:k]), "".join(level[k + 1 : run + o.arity])))
        k //= o.arity
    return out


def fold(node: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        node = digest(left + node + right)
    return node


def reduced(nodes: DataFrame, o: ManifestOptions) -> DataFrame:
    """tree, pos, n, node of the blocks of tree, pos, n, node. A group has o.block rows at most."""

    def top(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        many = int(rows["n"].iloc[0])
        return pd.DataFrame({"tree": [key[0]], "pos": [key[1]], "n": [-(-many // o.block)], "node": [levels(rows["node"].tolist(), many, o)[-1][0]]})

    block = F.floor(F.col("pos") / o.block).cast("long").alias("block")
    return nodes.select("tree", "pos", "n", "node").groupBy("tree", block).applyInPandas(top, "tree string, pos long, n long, node string")


def top_paths(found: list, o: ManifestOptions) -> dict[tuple[str, int], tuple]:
    """Of each of the few nodes left: the siblings up to the root, its tree's root, and the root."""
    wide = ManifestOptions(o.arity, 64)
    by: dict[str, list] = {}
    for r in sorted(found, key=lambda r: (r["tree"].encode(), r["pos"])):
        by.setdefault(r["tree"], []).append(r["node"])
    trees = {t: levels(nodes, len(nodes), wide) for t, nodes in by.items()}
    roots = [tree[-1][0] for tree in trees.values()]
    above = levels(roots, len(roots), wide)
    return {(t, k): (climb(tree, k, wide) + climb(above, i, wide), tree[-1][0], above[-1][0]) for i, (t, tree) in enumerate(trees.items()) for k in range(len(tree[0]))}


def finished(nodes: DataFrame, above: dict | DataFrame, keep: list[str], schema: str, end, o: ManifestOptions) -> DataFrame:
    """Rebuilds each block of nodes and gives end(row, siblings up to the root, subroot, root) for each row. above: what lies above the blocks, broadcast if it is small, else joined block by block."""

    def rows_of(rows: pd.DataFrame, path: list, subroot: str, root: str) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        first = int(rows["pos"].iloc[0])
        tree = levels(rows["node"].tolist(), int(rows["n"].iloc[0]), o)
        return pd.DataFrame([end(r, climb(tree, r.pos - first, o) + path, subroot, root) for r in rows.itertuples(index=False)], columns=[c.split()[0] for c in schema.split(", ")])

    own = nodes.select("tree", "pos", "n", "node", *keep).withColumn("block", F.floor(F.col("pos") / o.block).cast("long"))
    if isinstance(above, dict):
        told = nodes.sparkSession.sparkContext.broadcast(above)
        return own.groupBy("tree", "block").applyInPandas(lambda key, rows: rows_of(rows, *told.value[(key[0], int(key[1]))]), schema)

    def both(rows: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
        return rows_of(rows, [(p["left"], p["right"]) for p in up["path"].iloc[0]], up["subroot"].iloc[0], up["root"].iloc[0])

    return own.groupBy("tree", "block").cogroup(above.withColumnRenamed("pos", "block").groupBy("tree", "block")).applyInPandas(both, schema)


def paths_above(nodes: DataFrame, o: ManifestOptions) -> dict | DataFrame:
    """What lies above the nodes tree, pos, n, node: a dictionary if they are few, else a table of them."""
    few = nodes.limit(o.top_nodes + 1).collect()
    if len(few) <= o.top_nodes:
        return top_paths(few, o)
    shape = "tree string, pos long, path " + PATH + ", subroot string, root string"
    end = lambda r, path, subroot, root: (r.tree, r.pos, [{"left": a, "right": b} for a, b in path], subroot, root)
    if nodes.where("n > 1").isEmpty():  # Many sources, of which each is one node by now: they are the nodes of one tree.
        one = numbered(nodes.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "node"), "tree", ["source"])
        up = paths_above(materialise(reduced(one, o)), o)
        done = finished(one, up, ["source"], shape.replace("tree string", "source string") + ", node string", lambda r, path, subroot, root: (r.source, 0, end(r, path, "", root)[2], r.node, root, r.node), o)
        return materialise(done.select(F.col("source").alias("tree"), "pos", "path", "subroot", "root"))
    return materialise(finished(nodes, paths_above(materialise(reduced(nodes, o)), o), [], shape, end, o))


def manifest(docs: DataFrame, o: ManifestOptions = ManifestOptions(), id_col: str = "doc_id", source_col: str = "source", leaf_cols: tuple[str, ...] = LEAF, text_col: str = "text") -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row of docs.

    Null values have a mark of their own in a leaf, so an empty text and none differ. Within a source, rows without id come
    first, and rows that share an id stand in the order of their leaves; repeated rows are separate leaves, and each of them
    gets one of their places. An empty table gives no rows. Other columns are left out.
    """
    hit, text = tampered(F.col(id_col), F.col(text_col))
    own = leaf(*[F.col(c) for c in leaf_cols])
    other = leaf(*[text if c == text_col else F.col(c) for c in leaf_cols])
    rows = docs.select(F.col(id_col).alias("doc_id"), group_key(F.col(source_col)).alias("tree"), own.alias("node"), F.when(hit, other).alias("tampered"))
    # Ids travel as texts: pandas would turn numbers beside nulls into floats.
    rows = numbered(rows, "tree", ["doc_id", "node"]).withColumn("doc_id", F.col("doc_id").cast("string"))

    def end(r, path: list[tuple[str, str]], subroot: str, root: str) -> tuple:
        folded = fold(r.tampered or r.node, path)
        return r.doc_id, r.node, subroot, root, digest("".join(a + b for a, b in path)), folded, folded == root

    schema = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    done = finished(rows, paths_above(materialise(reduced(rows, o)), o), ["doc_id", "tampered"], schema, end, o)
    return done.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))
