"""Vector distances, searches and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.functions.vectors import cosine_distance, parse_vector, vector_literal
from loomstone.operators import vector
from loomstone.sources.tables import load

from .registry import register

QUERY = [((i * 37) % 19 - 9) / 10.0 for i in range(64)]
_Q = "[" + ", ".join(f"{x}::DOUBLE" for x in QUERY) + "]"
_E = "embedding::DOUBLE[]"
DISTANCES = {"cosine": f"list_cosine_distance({_E}, {_Q})", "l2": f"list_distance({_E}, {_Q})", "dot": f"-list_inner_product({_E}, {_Q})"}


def _topk(name: str):
    @register(f"vector_{name}_topk", f"SELECT vec_id, round({DISTANCES[name]}, 6) AS distance, round(1 - {DISTANCES[name]}, 6) AS score FROM embeddings ORDER BY {DISTANCES[name]}, vec_id LIMIT 10")
    def run(spark, d):
        return vector.search(load(spark, d, "embeddings"), QUERY, 10, name, "vec_id", "embedding").select("vec_id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


for _name in DISTANCES:
    _topk(_name)


@register("vector_distance_op", f"SELECT vec_id, round({DISTANCES['cosine']}, 6) AS distance FROM embeddings WHERE {DISTANCES['cosine']} < 0.9")
def vector_distance_op(spark, d):
    dist = cosine_distance(F.col("embedding"), vector_literal(QUERY))
    return load(spark, d, "embeddings").select("vec_id", dist.alias("x")).where("x < 0.9").select("vec_id", F.round("x", 6).alias("distance"))


@register("vector_search_payload", f"SELECT vec_id, '{{\"label\":' || label || '}}' AS payload, round({DISTANCES['cosine']}, 6) AS distance FROM embeddings ORDER BY {DISTANCES['cosine']}, vec_id LIMIT 5")
def vector_search_payload(spark, d):
    rows = load(spark, d, "embeddings").withColumn("payload", F.to_json(F.struct("label")))
    return vector.search(rows, QUERY, 5, "cosine", "vec_id", "embedding").select("vec_id", "payload", F.round("distance", 6).alias("distance"))


@register("vector_index_stats", "SELECT label, count(*) AS n, min(len(embedding))::BIGINT AS dim_min, max(len(embedding))::BIGINT AS dim_max FROM embeddings GROUP BY label")
def vector_index_stats(spark, d):
    size = F.size("embedding").cast("long")
    return load(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.min(size).alias("dim_min"), F.max(size).alias("dim_max"))


@register("vector_parse_literal", "SELECT vec_id, 3::BIGINT AS dim, round((vec_id % 7) / 2.0 + 1.5, 6) AS total FROM embeddings")
def vector_parse_literal(spark, d):
    text = F.concat(F.lit("["), (F.col("vec_id") % 7) / 2, F.lit(", 1.0, 0.5]"))
    v = parse_vector(text)
    return load(spark, d, "embeddings").select("vec_id", F.size(v).cast("long").alias("dim"), F.round(F.aggregate(v.cast("array<double>"), F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


_PAIR = "list_cosine_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"


@register(
    "vector_knn_join",
    f"""SELECT query_id, id, distance, rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, round({_PAIR}, 6) AS distance,
row_number() OVER (PARTITION BY q.vec_id ORDER BY {_PAIR}, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0) WHERE rank <= 5""",
)
def vector_knn_join(spark, d):
    """Queries are the rows whose id is divisible by 20, against all rows."""
    rows = load(spark, d, "embeddings")
    return vector.knn_join(rows.where("vec_id % 20 = 0"), rows, 5, "cosine", "vec_id", "embedding").withColumn("distance", F.abs(F.round("distance", 6)))


@register("vector_range_join", f"SELECT q.vec_id AS query_id, v.vec_id AS id, abs(round({_PAIR}, 6)) AS distance FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND {_PAIR} <= 0.7")
def vector_range_join(spark, d):
    """Queries are the rows whose id is divisible by 20, against all rows."""
    rows = load(spark, d, "embeddings")
    return vector.range_join(rows.where("vec_id % 20 = 0"), rows, 0.7, "cosine", "vec_id", "embedding").withColumn("distance", F.abs(F.round("distance", 6)))


def ann_index(spark, d):
    return vector.IvfIndex(load(spark, d, "embeddings"), 16, "cosine", "vec_id", "embedding")


#: Cells that a search probes.
PROBES = 12


@register("vector_ann_search")
def vector_ann_search(spark, d):
    """Approximate; queries are the rows whose id is divisible by 20, against all rows. The tests hold its recall against the exact join."""
    return ann_index(spark, d).join(load(spark, d, "embeddings").where("vec_id % 20 = 0"), 10, PROBES).withColumn("distance", F.abs(F.round("distance", 6)))


@register("vector_upsert_delete", "SELECT vec_id, label FROM (SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN 99 ELSE label END AS label FROM embeddings) WHERE vec_id NOT IN (1, 2, 3)")
def vector_upsert_delete(spark, d):
    rows = load(spark, d, "embeddings").select("vec_id", "label")
    new = rows.where("vec_id % 10 = 0").withColumn("label", F.lit(99))
    return vector.delete(vector.upsert(rows, new, "vec_id"), [1, 2, 3], "vec_id")
