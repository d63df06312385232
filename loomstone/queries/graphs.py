"""Graph, lineage and decision trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.operators import graph, lineage
from loomstone.sources.tables import DECISIONS_SQL, EDGES_SQL, decisions, graph_edges, graph_nodes, load

from .registry import register

_BOTH = "steps AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges)"
_DEPTHS = f"""WITH RECURSIVE {EDGES_SQL}, {_BOTH}, walk(id, depth) AS (
  SELECT 'c:1', 0 UNION SELECT steps.b, depth + 1 FROM walk JOIN steps ON steps.a = walk.id WHERE depth < {{k}}),
near AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id)"""


def _graph(spark, d):
    return graph_nodes(spark, d), graph_edges(spark, d)


@register("graph_edges_of", f"WITH {EDGES_SQL} SELECT 'out' AS direction, id, type FROM edges WHERE src = 'n:3' UNION ALL SELECT 'in', id, type FROM edges WHERE dst = 'n:3'")
def graph_edges_of(spark, d):
    return graph.edges_of(graph_edges(spark, d), "n:3").select("direction", "id", "type")


def _neighbors(direction: str, where: str):
    @register(f"graph_neighbors_{direction}", f"WITH {EDGES_SQL} SELECT * FROM nodes WHERE id IN ({where})")
    def run(spark, d):
        return graph.neighbors(*_graph(spark, d), "n:3", direction)


_neighbors("out", "SELECT dst FROM edges WHERE src = 'n:3'")
_neighbors("in", "SELECT src FROM edges WHERE dst = 'n:3'")
_neighbors("both", "SELECT dst FROM edges WHERE src = 'n:3' UNION SELECT src FROM edges WHERE dst = 'n:3'")


def _hop(k: int):
    @register(f"graph_khop_{k}", _DEPTHS.format(k=k) + f" SELECT nodes.* FROM nodes JOIN near USING (id) WHERE depth = {k}")
    def run(spark, d):
        return graph.k_hop(*_graph(spark, d), "c:1", k, "both")


for _k in (1, 2, 3):
    _hop(_k)


def _path_len(name: str, end: str):
    @register(name, _DEPTHS.format(k=6) + f" SELECT depth + 1 AS length FROM near WHERE id = '{end}'")
    def run(spark, d):
        return graph.shortest_path(*_graph(spark, d), "c:1", end, "both").select(F.col("length").cast("int").alias("length"))


_path_len("graph_shortest_path_len", "n:14")
_path_len("graph_shortest_path_none", "s:7")


@register("graph_find_by_type", f"WITH {EDGES_SQL} SELECT * FROM nodes WHERE type = 'nation' ORDER BY id LIMIT 10")
def graph_find_by_type(spark, d):
    return graph.find(graph_nodes(spark, d), 10, type="nation")


@register("graph_delete_cascade", f"WITH {EDGES_SQL} SELECT type, count(*) AS n FROM edges WHERE src <> 'n:3' AND dst <> 'n:3' GROUP BY type")
def graph_delete_cascade(spark, d):
    return graph.delete_node(*_graph(spark, d), "n:3")[1].groupBy("type").agg(F.count("*").alias("n"))


_TREE = f"""WITH RECURSIVE t(id, depth) AS (SELECT id, 0::BIGINT FROM {DECISIONS_SQL} WHERE id = 3
  UNION ALL SELECT d.id, depth + 1 FROM t JOIN {DECISIONS_SQL} d ON d.parent_id = t.id)"""


@register("decision_list", f"SELECT type, count(*) AS n, min(id) AS first_id, sum(duration_ms)::BIGINT AS total FROM {DECISIONS_SQL} GROUP BY type")
def decision_list(spark, d):
    return decisions(spark, d).groupBy("type").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.sum("duration_ms").alias("total"))


@register("decision_tree", _TREE + " SELECT id, depth FROM t")
def decision_tree(spark, d):
    return lineage.tree(decisions(spark, d), 3)


@register("decision_subtree_duration", _TREE + f" SELECT 3 AS root, count(*) AS n, sum(duration_ms)::BIGINT AS total FROM t JOIN {DECISIONS_SQL} USING (id)")
def decision_subtree_duration(spark, d):
    return lineage.subtree_total(decisions(spark, d), 3, "duration_ms")


def _records(spark, d):
    """A lineage record for each order: made from the orders of half and of a third of its number."""
    key = F.col("o_orderkey")
    sources = F.filter(F.array_distinct(F.array(F.floor(key / 2), F.floor(key / 3))), lambda x: x > 0)
    return load(spark, d, "orders").select(key.alias("data_id"), sources.alias("source_ids"), F.array((key % 5).cast("long")).alias("decision_ids"))


_UP = """WITH RECURSIVE rec AS (SELECT o_orderkey AS id, list_filter(list_distinct([o_orderkey // 2, o_orderkey // 3]), lambda x: x > 0) AS src FROM orders),
links AS (SELECT id, unnest(src) AS source FROM rec),
up(id, depth) AS (SELECT id, 1::BIGINT FROM rec WHERE id = 997 UNION ALL SELECT source, depth + 1 FROM up JOIN links USING (id) WHERE depth < 6 AND source IN (SELECT id FROM rec))"""


@register("lineage_upstream", _UP + " SELECT id AS data_id, depth, count(*) AS copies FROM up GROUP BY id, depth")
def lineage_upstream(spark, d):
    return lineage.upstream(_records(spark, d), 997, 6)


@register("lineage_depth", _UP + " SELECT max(depth) AS depth, count(DISTINCT id) AS ids FROM up")
def lineage_depth(spark, d):
    return lineage.upstream(_records(spark, d), 997, 6).agg(F.max("depth").alias("depth"), F.count_distinct("data_id").alias("ids"))


@register("lineage_by_decision", "SELECT o_orderkey AS data_id FROM orders WHERE o_orderkey % 5 = 2")
def lineage_by_decision(spark, d):
    return lineage.by_decision(_records(spark, d), 2).select("data_id")
