"""Trees over parent links and lineage over source lists, walked by levels."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.session import bare, cut_lineage


def tree(df: DataFrame, root, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """(id, depth) of the subtree below a root, its own included; a cycle ends where an id would come again."""
    links = df.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent"))
    front = bare(links.where(F.col("id") == root).select("id", F.lit(0).cast("long").alias("depth")))
    out = front
    for depth in itertools.count(1):
        nxt = links.join(front.select(F.col("id").alias("parent")), "parent", "left_semi").select("id").join(out, "id", "left_anti")
        front = cut_lineage(bare(nxt.select("id", F.lit(depth).cast("long").alias("depth"))))
        if front.isEmpty():
            return out
        out = cut_lineage(out.unionByName(front))


def subtree_total(df: DataFrame, root, value_col: str, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """One row: root, n (nodes) and total of a column over the subtree."""
    inside = tree(df, root, id_col, parent_col)
    return df.join(inside.select(F.col("id").alias(id_col)), id_col, "left_semi").agg(F.lit(root).alias("root"), F.count("*").alias("n"), F.sum(value_col).alias("total"))


def upstream(lineage: DataFrame, data_id, most: int, id_col: str = "data_id", sources_col: str = "source_ids") -> DataFrame:
    """(data_id, depth, copies) upstream of a record to a number of levels, itself at depth 1: missing sources are skipped, and one reached by several ways counts each."""
    links = lineage.select(F.col(id_col).alias("id"), F.explode_outer(sources_col).alias("source"))
    known = lineage.select(F.col(id_col).alias("id"))
    front = known.where(F.col("id") == data_id).select("id", F.lit(1).cast("long").alias("depth"), F.lit(1).cast("long").alias("copies"))
    out = front
    for depth in range(2, most + 1):
        nxt = links.join(front, "id").where("source IS NOT NULL").groupBy(F.col("source").alias("id")).agg(F.sum("copies").alias("copies")).join(known, "id", "left_semi")
        front = cut_lineage(bare(nxt.select("id", F.lit(depth).cast("long").alias("depth"), "copies")))
        if front.isEmpty():
            break
        out = cut_lineage(out.unionByName(front))
    return out.select(F.col("id").alias("data_id"), "depth", "copies")


def by_decision(lineage: DataFrame, decision, decisions_col: str = "decision_ids") -> DataFrame:
    return lineage.where(F.array_contains(decisions_col, decision))
