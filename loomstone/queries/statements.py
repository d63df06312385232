"""Statements of the dialect on copies of the tables, run by the engine."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomstone.engine import Engine
from loomstone.plans.catalog import ConstraintError
from loomstone.session import shared_folder
from loomstone.sources.tables import load

from .indexes import TOKENS_SQL
from .registry import register


def _engine(spark, d, name: str, ddl: str) -> Engine:
    """A new engine that holds one table with the rows of the given one."""
    engine = Engine(spark, f"{shared_folder(spark)}/engine-{uuid.uuid4().hex}")
    engine.sql(f"CREATE TABLE {name} ({ddl})")
    engine.catalog.insert(name, load(engine.spark, d, name).select(*[c.name for c in engine.catalog.table(name).columns]))
    return engine


REGION = "r_regionkey INT PRIMARY KEY, r_name STRING"
NATION = "n_nationkey INT PRIMARY KEY, n_name STRING NOT NULL, n_regionkey INT"
ORDERS = "o_orderkey BIGINT PRIMARY KEY, o_orderstatus STRING, o_totalprice DOUBLE"


@register("engine_insert", r"SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region UNION ALL VALUES (100, 'ATL''ANTIS'), (101, NULL), (102, 'C:\new')")
def engine_insert(spark, d):
    engine = _engine(spark, d, "region", REGION)
    engine.sql(r"""INSERT INTO region VALUES (100, 'ATL''ANTIS'), (101, NULL), (102, "C:\new")""")
    return engine.sql("SELECT r_regionkey, r_name FROM region")


@register("engine_update", "SELECT o_orderkey::BIGINT AS o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END::DOUBLE AS o_totalprice FROM orders")
def engine_update(spark, d):
    engine = _engine(spark, d, "orders", ORDERS)
    engine.sql("UPDATE orders SET o_orderstatus = 'X', o_totalprice = o_totalprice * 2 WHERE o_orderstatus = 'F'")
    return engine.sql("SELECT * FROM orders")


@register("engine_delete", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation WHERE n_nationkey % 3 <> 1")
def engine_delete(spark, d):
    engine = _engine(spark, d, "nation", NATION)
    engine.sql("DELETE FROM nation WHERE n_nationkey % 3 = 1")
    return engine.sql("SELECT n_nationkey, n_name FROM nation")


@register(
    "engine_arithmetic",
    """SELECT n_nationkey::BIGINT AS n_nationkey, (n_nationkey * 3 % 4)::DOUBLE AS a, (trunc(n_nationkey + 7.9)::BIGINT % 4)::DOUBLE AS b, n_nationkey::DOUBLE / nullif(n_regionkey, 0) AS c,
(n_nationkey + 1)::DOUBLE AS d, (n_nationkey - 2 * n_regionkey)::DOUBLE AS e, strlen(n_name)::BIGINT AS f FROM nation""",
)
def engine_arithmetic(spark, d):
    engine = _engine(spark, d, "nation", NATION)
    return engine.sql("SELECT n_nationkey, n_nationkey * 3 % 4 AS a, (n_nationkey + 7.9) % 4 AS b, n_nationkey / n_regionkey AS c, n_nationkey + 1 AS d, n_nationkey - 2 * n_regionkey AS e, cast(LENGTH(n_name) AS BIGINT) AS f FROM nation")


@register("engine_first_last", "SELECT n_regionkey::BIGINT AS n_regionkey, arg_min(n_name, n_nationkey::VARCHAR) AS a, arg_max(n_name, n_nationkey::VARCHAR) AS b, count(*) AS n FROM nation GROUP BY n_regionkey HAVING count(*) > 1")
def engine_first_last(spark, d):
    engine = _engine(spark, d, "nation", NATION)
    return engine.sql("SELECT n_regionkey, FIRST(n_name) AS a, LAST(n_name) AS b, COUNT(*) AS n FROM nation GROUP BY n_regionkey HAVING n > 1")


@register("engine_index_range", "SELECT o_orderkey::BIGINT AS o_orderkey, o_orderstatus, o_totalprice::DOUBLE AS o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000")
def engine_index_range(spark, d):
    engine = _engine(spark, d, "orders", ORDERS)
    engine.sql("CREATE INDEX by_price ON orders (o_totalprice) USING BTREE")
    return engine.sql("SELECT * FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000")


@register("engine_match", f"WITH {TOKENS_SQL} SELECT doc_id::BIGINT AS doc_id FROM terms WHERE term IN ('the', 'with', 'only') GROUP BY doc_id HAVING count(*) = 3")
def engine_match(spark, d):
    engine = _engine(spark, d, "documents", "doc_id BIGINT PRIMARY KEY, text TEXT")
    engine.sql("CREATE FULLTEXT INDEX by_word ON documents (text)")
    return engine.sql("SELECT doc_id FROM documents WHERE MATCH(text) AGAINST('the only, WITH')")


@register("engine_index_equal", "SELECT event_id::BIGINT AS event_id, event_type FROM events WHERE user_id = 7 AND event_type <> 'error'")
def engine_index_equal(spark, d):
    engine = _engine(spark, d, "events", "event_id BIGINT PRIMARY KEY, user_id BIGINT, event_type STRING")
    engine.sql("CREATE INDEX by_user ON events (user_id) USING HASH")
    return engine.sql("SELECT event_id, event_type FROM events WHERE user_id = 7 AND event_type <> 'error'")


_REFUSED = {
    "null": "INSERT INTO nation VALUES (100, NULL, 1)",
    "key": "INSERT INTO nation VALUES (3, 'AGAIN', 1)",
    "type": "INSERT INTO nation VALUES ('x', 'TEXT', 1)",
    "unique": "INSERT INTO nation VALUES (101, 'nation_4', 1)",
    "update": "UPDATE nation SET n_name = NULL WHERE n_nationkey = 2",
}


@register("engine_constraints", "SELECT * FROM (VALUES ('null', true, 25::BIGINT), ('key', true, 25), ('type', true, 25), ('unique', true, 25), ('update', true, 25)) v(rule, refused, n)")
def engine_constraints(spark, d):
    engine = _engine(spark, d, "nation", NATION)
    engine.sql("CREATE UNIQUE INDEX by_name ON nation (n_name)")
    rows = []
    for rule, text in _REFUSED.items():
        try:
            engine.sql(text)
            refused = False
        except ConstraintError:
            refused = True
        rows.append((rule, refused, engine.sql("SELECT COUNT(*) AS n FROM nation").first()["n"]))
    return spark.createDataFrame(rows, "rule string, refused boolean, n long")


_BUILT_IN_SQL = """(SELECT 'reader' AS role, unnest(['session', 'memory', 'decision', 'room', 'task', 'query']) AS resource, 'read' AS action UNION ALL
  SELECT 'writer', unnest(['session', 'memory', 'decision', 'room', 'task', 'query']), 'read' UNION ALL SELECT 'writer', unnest(['session', 'memory', 'decision', 'room', 'task']), 'write' UNION ALL
  SELECT 'observer', 'audit', 'read' UNION ALL SELECT 'admin', '*', '*')"""


@register(
    "engine_roles",
    f"""WITH req AS (SELECT event_id AS id, user_id AS agent, ['query', 'audit', 'task'][event_id % 3 + 1] AS resource, CASE WHEN event_id % 2 = 0 THEN 'read' ELSE 'write' END AS action FROM events),
given AS (SELECT 1 AS agent, 'reader' AS role UNION ALL SELECT 2, 'writer' UNION ALL SELECT 3, 'observer' UNION ALL SELECT 4, 'admin' UNION ALL SELECT 5, 'reader' UNION ALL SELECT 5, 'observer')
SELECT id::BIGINT AS id, EXISTS (SELECT 1 FROM given JOIN {_BUILT_IN_SQL} p USING (role) WHERE given.agent = req.agent AND p.resource IN ('*', req.resource) AND p.action IN ('*', req.action)) AS allowed FROM req""",
)
def engine_roles(spark, d):
    engine = Engine(spark, f"{shared_folder(spark)}/engine-{uuid.uuid4().hex}")
    for agent, role in (("1", "reader"), ("2", "writer"), ("3", "observer"), ("4", "admin"), ("5", "reader"), ("5", "observer")):
        engine.roles.assign(agent, role)
    resource = F.element_at(F.array(*map(F.lit, ("query", "audit", "task"))), (F.col("event_id") % 3 + 1).cast("int"))
    asked = load(engine.spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("agent_id"), resource.alias("resource"), F.when(F.col("event_id") % 2 == 0, "read").otherwise("write").alias("action"), F.lit("").alias("scope"))
    return engine.roles.check_all(asked).select("id", "allowed")
