"""Functions and operators on the fixtures of the blueprint."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstone.functions import expr, text
from loomstone.operators import agents, graph, lineage, rag, vector


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("Snow fell; SNOW melted -- snow_2 rose", ["snow", "fell", "melted", "snow_2", "rose"]),
        ("a1 b-2", ["a1", "b", "2"]),
        (" ,.;-- ", []),
        ("", []),
        ("山道 x", ["山道", "山", "道", "x"]),
    ],
)
def test_tokens(spark, given, want):
    assert one(spark, text.tokens(F.lit(given))) == want


def test_normalize(spark):
    for given, want in (("SELECT * FROM t WHERE id = 1", "SELECT * FROM t WHERE id = ?"), ("t12 = 'a'", "t1? = ?"), ("x = 1.5", "x = ?.?")):
        assert one(spark, text.normalize_sql(F.lit(given))) == want


def test_expressions(spark):
    n = F.lit(None).cast("double")
    assert one(spark, expr.divide(F.lit(1), F.lit(0))) is None
    assert one(spark, expr.modulo(F.lit(7.9), F.lit(4))) == 3.0
    assert one(spark, expr.compat_eq(n, n)) is True
    assert one(spark, expr.compat_lt(n, F.lit(1.0))) is True
    assert one(spark, expr.compat_lt(F.lit(1.0), n)) is False
    assert one(spark, expr.length_bytes(F.lit("né"))) == 3


def rivers(spark):
    """spring -> lake -> delta -> sea, and moor -> lake."""
    names = ["spring", "moor", "lake", "delta", "sea"]
    nodes = spark.createDataFrame([(x, "water", x.title()) for x in names], "id string, type string, name string")
    flows = [("f7", "spring", "lake"), ("f3", "moor", "lake"), ("f9", "lake", "delta"), ("f1", "delta", "sea")]
    return nodes, spark.createDataFrame([(e, "flow", a, b) for e, a, b in flows], "id string, type string, src string, dst string")


def test_graph(spark):
    nodes, edges = rivers(spark)
    for k, want in ((1, {"lake"}), (2, {"delta"}), (3, {"sea"}), (4, set())):
        assert {r["id"] for r in graph.k_hop(nodes, edges, "moor", k, "out").collect()} == want
    assert {r["id"] for r in graph.k_hop(nodes, edges, "moor", 2, "both").collect()} == {"spring", "delta"}
    canal = edges.unionByName(spark.createDataFrame([("f5", "canal", "spring", "delta")], edges.schema))
    assert graph.shortest_path(nodes, edges, "spring", "sea", "out").first()["path"] == ["spring", "lake", "delta", "sea"]
    assert graph.shortest_path(nodes, canal, "spring", "sea", "out").first()["path"] == ["spring", "delta", "sea"]
    assert graph.shortest_path(nodes, canal, "sea", "spring", "out").count() == 0
    assert graph.shortest_path(nodes, edges, "sea", "sea").first()["length"] == 1
    assert {r["id"] for r in graph.delete_node(nodes, edges, "lake")[1].collect()} == {"f1"}
    assert {r["id"] for r in graph.neighbors(nodes, edges, "lake", "both").collect()} == {"spring", "moor", "delta"}


def test_tree_and_lineage(spark):
    rows = spark.createDataFrame([(1, None, 100), (2, 1, 50), (3, 1, 50), (4, 2, 50), (9, 8, 7)], "id int, parent_id int, duration_ms int")
    assert lineage.subtree_total(rows, 1, "duration_ms").first()["total"] == 250
    cycle = spark.createDataFrame([(1, 2), (2, 1)], "id int, parent_id int")
    assert lineage.tree(cycle, 1).count() == 2


def test_long_chains(spark, monkeypatch):
    """Paths of more than 64 steps and trees of more than 100 levels are whole."""
    for module in (graph, lineage):  # fewer tasks
        monkeypatch.setattr(module, "cut_lineage", lambda df: df.coalesce(1).checkpoint())
    n = 70
    nodes = spark.range(n).selectExpr("id", "'t' AS type", "'x' AS name").coalesce(1)
    edges = spark.range(n - 1).selectExpr("id", "'e' AS type", "id AS src", "id + 1 AS dst").coalesce(1)
    found = graph.shortest_path(nodes, edges, 0, n - 1, "out").first()
    assert found["length"] == n and found["path"] == list(range(n))
    n = 105
    rows = spark.range(n).selectExpr("id", "nullif(id - 1, -1) AS parent_id", "2 AS duration_ms").coalesce(1)
    assert tuple(lineage.subtree_total(rows, 0, "duration_ms").first()) == (0, n, 2 * n)


def test_walks_of_derived_links(spark, monkeypatch):
    """What the optimizer derives of a column from another does not pile up over the levels of a walk."""
    sizes = []

    def cut(df):
        out = df.coalesce(1).checkpoint()
        sizes.append(len(out._jdf.queryExecution().optimizedPlan().constraints().toString()))
        return out

    monkeypatch.setattr(lineage, "cut_lineage", cut)
    rows = spark.range(1, 128).selectExpr("id", "CASE WHEN id > 1 THEN floor(id / 2) END AS parent_id").coalesce(1)
    assert sorted(map(tuple, lineage.tree(rows, 3).collect())) == sorted((i, i.bit_length() - 2) for i in range(1, 128) if bin(i)[2:4] == "11")
    assert len(sizes) > 8 and max(sizes) < 1000
    assert tuple(lineage.subtree_total(rows.withColumn("ms", F.lit(2)), 3, "ms").first()) == (3, 63, 126)


def test_walks_of_derived_edges(spark, monkeypatch):
    sizes = []

    def cut(df):
        out = df.coalesce(1).checkpoint()
        sizes.append(len(out._jdf.queryExecution().optimizedPlan().constraints().toString()))
        return out

    monkeypatch.setattr(graph, "cut_lineage", cut)
    nodes = spark.range(1, 128).selectExpr("id", "'t' AS type", "'x' AS name").coalesce(1)
    edges = spark.range(1, 128).selectExpr("id", "'e' AS type", "CASE WHEN id > 1 THEN floor(id / 2) END AS src", "id AS dst").coalesce(1)
    assert sorted(r["id"] for r in graph.k_hop(nodes, edges, 3, 5, "out").collect()) == list(range(96, 128))
    assert graph.shortest_path(nodes, edges, 1, 100, "out").first()["path"] == [1, 3, 6, 12, 25, 50, 100]
    assert len(sizes) > 8 and max(sizes) < 1000


def test_chunks(spark):
    docs = spark.createDataFrame([(1, "Tides rise.\n\nBoats leave the quay.\n\n\n\nGulls follow."), (2, ""), (3, None)], "id int, text string")
    assert [(r["chunk_index"], r["chunk"][:5]) for r in rag.chunk_paragraphs(docs, "id", "text").orderBy("chunk_index").collect()] == [(0, "Tides"), (1, "Boats"), (3, "Gulls")]
    x = spark.createDataFrame([(1, "x" * 100)], "id int, text string")
    assert [len(r["chunk"]) for r in rag.chunk_fixed(x, "id", "text", 25).collect()] == [25] * 4
    s = spark.createDataFrame([(1, "Aa bb. Cc! Dd? 好。Ee")], "id int, text string")
    assert [r["chunk"] for r in rag.chunk_sentences(s, "id", "text", 9).orderBy("chunk_index").collect()] == ["Aa bb. Cc!", "Dd? 好。 Ee"]
    hits = spark.createDataFrame([(1, "aaaa"), (2, "bbbb"), (3, "c")], "rank int, content string")
    assert rag.build_context(hits, 8).first()["context"] == "aaaa\n\nbbbb"
    assert rag.build_context(hits, 7).first()["n"] == 1


def test_rbac(spark):
    asked = [(1, "ann", "file", "read", "src/main"), (2, "ann", "file", "read", "doc/main"), (3, "ann", "file", "write", "src/main"), (4, "ben", "queue", "purge", "q9"), (5, "ben", "file", "read", "src/x"), (6, "cy", "file", "read", "src/x")]
    requests = spark.createDataFrame(asked, "id int, agent_id string, resource string, action string, scope string")
    grants = spark.createDataFrame([("reader", "file", "read", "src/*"), ("boss", "queue", "admin", None), ("boss", "file", "read", "doc/main")], "role string, resource string, action string, scope string")
    has = spark.createDataFrame([("ann", "reader"), ("ben", "boss")], "agent_id string, role string")
    got = {r["id"] for r in agents.rbac_check(requests, has, grants).collect() if r["allowed"]}
    assert got == {1, 4}


def test_decay_and_states(spark):
    d = lambda h, n: one(spark, agents.decayed(F.lit(0.5), F.lit(h), F.lit(n), 0.1))
    assert d(0.5, 5) == 0.5 and d(10.0, 0) == 0.5
    assert abs(d(2.0, 3) - 0.5 * np.exp(-0.2 * np.log(4))) < 1e-12
    assert d(1e6, 9) == 0.01
    log = spark.createDataFrame([(1, 1, "active"), (1, 2, "completed"), (1, 3, "active"), (2, 1, "failed"), (2, 2, "active")], "id int, seq int, state string")
    assert [(r["id"], r["seq"]) for r in agents.invalid_transitions(log, "id", "seq", "state").collect()] == [(1, 3)]


def test_tasks(spark):
    t = spark.createDataFrame([(1, 2, "pending", [9]), (2, 1, "pending", [3]), (3, 1, "running", []), (4, 1, "pending", [5]), (5, 0, "completed", [])], "id int, priority int, status string, depends_on array<int>").withColumn("created_at", F.lit(0))
    assert [r["id"] for r in agents.next_tasks(t, 2).collect()] == [2, 4]
    assert sorted(r["id"] for r in agents.ready_tasks(t).collect()) == [1, 4]


def test_ann_recall(spark, tmp_path):
    """The registered setting finds nine of ten at least; searches read the probed cells only."""
    from loomstone.queries.vectors import PROBES, ann_index

    queries = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").where("vec_id % 20 = 0")
    index = ann_index(spark, "/root/testdata/sf0.01")
    assert index.recall(queries, 10, PROBES) >= 0.9
    assert index.recall(queries, 10, 16) == 1.0
    centers = np.random.default_rng(3).normal(size=(20, 16)) * 4
    v = np.concatenate([c + np.random.default_rng(i).normal(size=(50, 16)) for i, c in enumerate(centers)])
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(-1, None)], "id int, vector array<double>")
    index = vector.IvfIndex(rows, 10, "l2", path=f"{tmp_path}/cells")
    assert index.recall(rows.where("id % 20 = 0"), 10, 3) >= 0.95
    found = index.search(v[7], 10, probes=3)
    exact = [r["id"] for r in vector.search(rows, v[7], 10, "l2").collect()]
    assert [r["id"] for r in found.collect()] == exact and set(found.columns) == {"id", "vector", "distance", "score"}
    read = {f.split("cell=")[1].split("/")[0] for f in found.inputFiles()}
    assert len(read) <= 10 and "PartitionFilters: [cell" in found._jdf.queryExecution().toString()


def test_joins_with_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.1]), (4, None)], "id int, vector array<double>")
    got = vector.knn_join(rows.where("id = 1"), rows, 2).orderBy("rank").collect()
    assert [r["id"] for r in got] == [1, 3]
    assert {(r["query_id"], r["id"]) for r in vector.range_join(rows.where("id = 1"), rows, 0.5).collect()} == {(1, 1), (1, 3)}
    assert vector.search(rows, [1.0, 0.0, 0.0], 1, "l2").first()["distance"] > 1e38


@pytest.mark.parametrize("kind", ["knn", "range"])
def test_joins_in_tiles(spark, monkeypatch, kind):
    """What a task holds does not depend on the sizes of blocks of queries and batches of vectors."""
    import tracemalloc

    import pandas as pd

    v = np.random.default_rng(5).normal(size=(10_000, 4))
    v[5000:6000] = v[:1000]  # copies: ties go by id
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v[:2000])], "id long, vector array<double>")
    taken = []
    monkeypatch.setattr(type(queries), "mapInPandas", lambda self, f, schema: taken.append(f) or self.sparkSession.createDataFrame([], schema))
    vector.knn_join(queries, queries, 3) if kind == "knn" else vector.range_join(queries, queries, 1e-4)
    tracemalloc.start()
    found = list(taken[0](iter([pd.DataFrame({"id": np.arange(len(v)), "v": list(v)})])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6
    got = {(q, i) for q, i in pd.concat(found)[["query_id", "id"]].astype(int).itertuples(index=False)}
    unit = v / np.sqrt((v * v).sum(1))[:, None]
    for q in range(0, 2000, 97):
        d = 1 - (unit * unit[q]).sum(1)
        want = np.lexsort((np.arange(len(v)), d.round(13)))[:3] if kind == "knn" else np.flatnonzero(d <= 1e-4)
        assert {i for p, i in got if p == q} == set(want.tolist())
