"""Parquet tables by name, other formats, and the agent concepts as views of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema=None, **options) -> DataFrame:
    """Read files of a format; text formats need a schema, as guessing one reads the data twice."""
    if kind in ("csv", "json") and schema is None:
        raise ValueError(f"{kind} needs a schema")
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "error", partition_by: list[str] | None = None, **options) -> None:
    writer = df.write.format(kind).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session for each conversation: id, agent_id, turns, state (by conv_id)."""
    state = F.element_at(F.array(*map(F.lit, ("active", "paused", "completed", "failed"))), (F.col("conv_id") % 4 + 1).cast("int"))
    return load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns")).select(
        F.col("conv_id").alias("id"), F.concat(F.lit("agent-"), F.col("conv_id") % 10).alias("agent_id"), "turns", state.alias("state")
    )


SESSIONS_SQL = "(SELECT conv_id AS id, 'agent-' || (conv_id % 10) AS agent_id, count(*) AS turns, ['active','paused','completed','failed'][conv_id % 4 + 1] AS state FROM conversations GROUP BY conv_id)"


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A memory for each turn: id, session_id, type (by role), content, importance, access_count, created_at (second of the turn)."""
    kind = F.when(F.col("role") == "user", "short_term").when(F.col("role") == "assistant", "long_term").otherwise("working")
    return load(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", F.lpad(F.col("turn").cast("string"), 4, "0")).alias("id"), F.col("conv_id").alias("session_id"), kind.alias("type"), F.col("text").alias("content"),
        ((F.col("turn") % 10) / 10.0).alias("importance"), F.col("turn").alias("access_count"), (F.col("conv_id") * 100 + F.col("turn") * 7).alias("created_at"),
    )


MEMORIES_SQL = """(SELECT conv_id || '-' || lpad(turn::VARCHAR, 4, '0') AS id, conv_id AS session_id,
  CASE role WHEN 'user' THEN 'short_term' WHEN 'assistant' THEN 'long_term' ELSE 'working' END AS type, text AS content,
  (turn % 10) / 10.0::DOUBLE AS importance, turn AS access_count, conv_id * 100 + turn * 7 AS created_at FROM conversations)"""


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges (id, type, src, dst): nation to region, supplier and customer to nation."""
    def edge(table: str, kind: str, a: str, ac: str, b: str, bc: str) -> DataFrame:
        src, dst = F.concat(F.lit(a), F.col(ac)), F.concat(F.lit(b), F.col(bc))
        return load(spark, sf_dir, table).select(F.concat(src, F.lit(">"), dst).alias("id"), F.lit(kind).alias("type"), src.alias("src"), dst.alias("dst"))

    out = edge("nation", "in_region", "n:", "n_nationkey", "r:", "n_regionkey")
    out = out.unionByName(edge("supplier", "supplies", "s:", "s_suppkey", "n:", "s_nationkey"))
    return out.unionByName(edge("customer", "buys", "c:", "c_custkey", "n:", "c_nationkey"))


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes (id, type, name)."""
    out = None
    for table, kind, prefix, key, name in (("region", "region", "r:", "r_regionkey", "r_name"), ("nation", "nation", "n:", "n_nationkey", "n_name"), ("supplier", "supplier", "s:", "s_suppkey", "s_name"), ("customer", "customer", "c:", "c_custkey", "c_name")):
        part = load(spark, sf_dir, table).select(F.concat(F.lit(prefix), F.col(key)).alias("id"), F.lit(kind).alias("type"), F.col(name).alias("name"))
        out = part if out is None else out.unionByName(part)
    return out


EDGES_SQL = """edges AS (SELECT src || '>' || dst AS id, type, src, dst FROM (
  SELECT 'n:' || n_nationkey AS src, 'r:' || n_regionkey AS dst, 'in_region' AS type FROM nation
  UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'supplies' FROM supplier
  UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'buys' FROM customer)),
nodes AS (SELECT 'r:' || r_regionkey AS id, 'region' AS type, r_name AS name FROM region
  UNION ALL SELECT 'n:' || n_nationkey, 'nation', n_name FROM nation
  UNION ALL SELECT 's:' || s_suppkey, 'supplier', s_name FROM supplier
  UNION ALL SELECT 'c:' || c_custkey, 'customer', c_name FROM customer)"""


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A binary tree over orders: id, parent_id (id div 2; none for the root 1 and below), duration_ms."""
    key = F.col("o_orderkey")
    return load(spark, sf_dir, "orders").select(key.alias("id"), F.when(key > 1, F.floor(key / 2)).alias("parent_id"), F.col("o_orderpriority").alias("type"), F.round("o_totalprice").cast("long").alias("duration_ms"))


DECISIONS_SQL = "(SELECT o_orderkey AS id, CASE WHEN o_orderkey > 1 THEN o_orderkey // 2 END AS parent_id, o_orderpriority AS type, round(o_totalprice)::BIGINT AS duration_ms FROM orders)"


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task for each order: id, agent_id, priority, status, created_at, depends_on (the task of half the id)."""
    key = F.col("o_orderkey")
    return load(spark, sf_dir, "orders").select(
        key.alias("id"), F.concat(F.lit("agent-"), F.col("o_custkey") % 10).alias("agent_id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("running").alias("status"), F.col("o_orderdate").alias("created_at"), F.array(F.floor(key / 2)).alias("depends_on"),
    )


TASKS_SQL = """(SELECT o_orderkey AS id, 'agent-' || (o_custkey % 10) AS agent_id, substr(o_orderpriority, 1, 1)::INT AS priority,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'running' END AS status, o_orderdate AS created_at, o_orderkey // 2 AS depends_on FROM orders)"""


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit record for each event: id, at, agent_id, operation, success, duration_ms."""
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("ts").alias("at"), F.concat(F.lit("agent-"), F.col("user_id")).alias("agent_id"), F.col("event_type").alias("operation"), (F.col("event_type") != "error").alias("success"), F.col("value").alias("duration_ms")
    )


AUDIT_SQL = "(SELECT event_id AS id, ts AS \"at\", 'agent-' || user_id AS agent_id, event_type AS operation, event_type <> 'error' AS success, value AS duration_ms FROM events)"
