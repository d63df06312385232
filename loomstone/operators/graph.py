"""Property graph: nodes (id, type, name, ...) and directed edges (id, type, src, dst, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.session import bare, cut_lineage


def _steps(edges: DataFrame, direction: str) -> DataFrame:
    """(a, b) for each step that a direction (out, in, both) allows."""
    out = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    back = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    if direction not in ("out", "in", "both"):
        raise ValueError(f"unknown direction {direction}")
    return {"out": out, "in": back}.get(direction) if direction != "both" else out.unionByName(back)


def edges_of(edges: DataFrame, node) -> DataFrame:
    """Edges from the node, then edges to it (a loop stands in both): direction and the edge."""
    return edges.where(F.col("src") == node).withColumn("direction", F.lit("out")).unionByName(edges.where(F.col("dst") == node).withColumn("direction", F.lit("in")))


def neighbors(nodes: DataFrame, edges: DataFrame, node, direction: str = "out") -> DataFrame:
    """Distinct existing nodes one step away; the node itself only by a loop."""
    near = _steps(edges, direction).where(F.col("a") == node).select(F.col("b").alias("id")).distinct()
    return nodes.join(near, "id", "left_semi")


def k_hop(nodes: DataFrame, edges: DataFrame, node, k: int, direction: str = "both") -> DataFrame:
    """Existing nodes whose shortest distance is exactly k; none for k < 1."""
    if k < 1:
        return nodes.limit(0)
    steps = _steps(edges, direction)
    front = nodes.sparkSession.createDataFrame([(node,)], nodes.select("id").schema)
    seen = front
    for _ in range(k):
        front = cut_lineage(bare(steps.join(front.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti")))
        seen = cut_lineage(seen.unionByName(front))
    return nodes.join(front, "id", "left_semi")


def within(nodes: DataFrame, edges: DataFrame, node, depth: int, direction: str = "out") -> DataFrame:
    """Existing nodes whose shortest distance is 1 to depth, with it, in one walk."""
    steps = _steps(edges, direction)
    front = nodes.sparkSession.createDataFrame([(node,)], nodes.select("id").schema)
    seen = front.withColumn("depth", F.lit(0))
    for k in range(1, depth + 1):
        front = cut_lineage(bare(steps.join(front.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti")))
        if front.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(front.withColumn("depth", F.lit(k))))
    return nodes.drop("depth").join(seen.where("depth > 0"), "id")


def shortest_path(nodes: DataFrame, edges: DataFrame, start, end, direction: str = "both") -> DataFrame:
    """One row (length, path): the smallest of the shortest paths in the order of its ids; nodes between need not exist. No row if there is no path."""
    spark = nodes.sparkSession
    schema = f"length long, path array<{dict(nodes.dtypes)['id']}>"
    if start == end:
        return spark.createDataFrame([(1, [start])], schema)
    steps = _steps(edges, direction).distinct()
    front = spark.createDataFrame([(start, [start])], f"id {dict(nodes.dtypes)['id']}, path array<{dict(nodes.dtypes)['id']}>")
    seen = front.select("id")
    while True:
        front = cut_lineage(
            bare(steps.join(front, steps["a"] == front["id"]).select(F.col("b").alias("id"), F.concat("path", F.array("b")).alias("path")).join(seen, "id", "left_anti").groupBy("id").agg(F.min("path").alias("path")))
        )
        hit = front.where(F.col("id") == end)
        if not hit.isEmpty():
            return hit.select(F.size("path").cast("long").alias("length"), "path")
        if front.isEmpty():
            return spark.createDataFrame([], schema)
        seen = cut_lineage(seen.unionByName(front.select("id")))


def delete_node(nodes: DataFrame, edges: DataFrame, node) -> tuple[DataFrame, DataFrame]:
    """Without the node and all edges at it."""
    return nodes.where(F.col("id") != node), edges.where((F.col("src") != node) & (F.col("dst") != node))


def find(df: DataFrame, limit: int | None = None, **equal) -> DataFrame:
    """Nodes or edges by type, name or others, in the order of ids."""
    for k, v in equal.items():
        df = df.where(F.col(k) == v)
    df = df.orderBy("id")
    return df.limit(limit) if limit else df
