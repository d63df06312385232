"""Connected components of link tables, in shuffles that follow the number of links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

LINKS = "a long, b long"
#: Links that one task joins at most; more are joined in rounds of shuffles.
TASK_LINKS = 400_000


def forest(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Links (node, smallest node of its component) that join what the given links join."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a, b, strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    nodes = [x for x in parent if root(x) != x]
    return nodes, [root(x) for x in nodes]


def _thinned(links: DataFrame) -> DataFrame:
    """Each partition's links replaced by a forest of them, in blocks of bounded size."""

    def run(batches):
        for batch in batches:
            a, b = forest(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return links.select("a", "b").mapInArrow(run, LINKS)


def spanning(links: DataFrame) -> DataFrame:
    """Of the links (a, b) those that join what the ones before them have not joined: in one task if they are few, else in blocks of bounded size."""

    def run(batches):
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := parent.get(x, x)) != x:
                parent[x] = x = parent.get(y, y)
            return x

        for batch in batches:
            if len(parent) > TASK_LINKS:
                parent.clear()
            keep = []
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = root(x), root(y)
                keep.append(x != y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            yield batch.filter(pa.array(keep, pa.bool_()))

    few = links.count() <= TASK_LINKS
    return (links.repartition(1) if few else links).mapInArrow(run, LINKS)


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that links lead to, for every node with a link to another.

    links: long columns a and b, in any direction, repeated as may be; links of a node to itself and nulls are left out. Up to TASK_LINKS
    forest links are joined in one task. Beyond, each round makes all larger neighbours of a node point to its smallest, then all smaller ones (large and small star), until nothing changes."""
    now = _thinned(links.select(F.col(links.columns[0]).cast("long").alias("a"), F.col(links.columns[1]).cast("long").alias("b")).where("a <> b"))
    now = checkpointed(now.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if now.count() <= TASK_LINKS:

        def run(batches):
            a, b = [], []
            for batch in batches:
                a += batch.column(0).to_pylist()
                b += batch.column(1).to_pylist()
            a, b = forest(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["node", "component"])

        return now.repartition(1).mapInArrow(run, "node long, component long")
    state = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Every link now points from larger to smaller.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b").distinct()
        now = checkpointed(small)
        # A star forest is reached when no node that others point to points on.
        told = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if tuple(told) == state:
            break
        state = tuple(told)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


def brute_components(nodes: list[int], links: list[tuple[int, int]]) -> dict[int, int]:
    """For tests and small tables."""
    a, b = forest([x for x, _ in links], [y for _, y in links]) if links else ([], [])
    return {n: n for n in nodes} | dict(zip(a, b, strict=True))
