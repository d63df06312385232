"""Scans, expressions, joins, aggregates, order."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.functions import expr
from loomstone.sources.tables import load

from . import sql
from .registry import register

sql(
    "flagship_segment_totals",
    """SELECT c.c_mktsegment, count(*) AS cnt, round(sum(o.o_totalprice), 2) AS total
FROM {customer} c JOIN {orders} o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 1000
GROUP BY c.c_mktsegment HAVING cnt > 1 ORDER BY total DESC, c.c_mktsegment LIMIT 10""",
)
sql("scan_all", "SELECT * FROM {nation}")
sql("project_alias", "SELECT o_orderkey AS id, o_totalprice AS price, o_orderpriority AS prio FROM {orders}")
sql("select_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM {orders}")
sql("filter_and_or_not", "SELECT o_orderkey, o_orderstatus FROM {orders} WHERE (o_orderstatus = 'F' AND o_totalprice > 50000) OR NOT (o_totalprice >= 1000)")
sql(
    "compare_ops",
    "SELECT count_if(l_quantity = 10) AS eq, count_if(l_quantity <> 10) AS ne, count_if(l_quantity < 10) AS lt, count_if(l_quantity <= 10) AS le, count_if(l_quantity > 10) AS gt, count_if(l_quantity >= 10) AS ge FROM {lineitem}",
    "SELECT count_if(l_quantity = 10)::BIGINT AS eq, count_if(l_quantity <> 10)::BIGINT AS ne, count_if(l_quantity < 10)::BIGINT AS lt, count_if(l_quantity <= 10)::BIGINT AS le, count_if(l_quantity > 10)::BIGINT AS gt, count_if(l_quantity >= 10)::BIGINT AS ge FROM lineitem",
)
sql("in_list", "SELECT o_orderkey FROM {orders} WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
sql("not_in_list", "SELECT o_orderkey FROM {orders} WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
sql("in_subquery", "SELECT c_custkey, c_name FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 100000)")
sql("scalar_subquery", "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM {orders})")
sql("between", "SELECT o_orderkey FROM {orders} WHERE o_totalprice BETWEEN 1000 AND 20000")
sql("not_between", "SELECT o_orderkey FROM {orders} WHERE o_totalprice NOT BETWEEN 1000 AND 200000")
sql("like_pattern", "SELECT p_partkey, p_name FROM {part} WHERE p_name LIKE '%a_e%' AND p_type NOT LIKE 'STANDARD%'")
sql("is_null", "SELECT d.doc_id FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id WHERE l.toxic IS NULL AND d.lang IS NOT NULL")
sql("join_inner", "SELECT o.o_orderkey, c.c_name FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey")
sql("join_multi", "SELECT n.n_name, r.r_name, count(*) AS customers FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey GROUP BY n.n_name, r.r_name")
sql("join_theta", "SELECT a.n_nationkey AS a, b.r_regionkey AS b FROM {nation} a JOIN {region} b ON a.n_regionkey < b.r_regionkey")
sql("join_left", "SELECT d.doc_id, l.quality, l.toxic FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id")
sql("join_left_anti_pattern", "SELECT c.c_custkey FROM {customer} c LEFT JOIN {orders} o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NULL")
sql("join_cross", "SELECT r.r_name, n.n_name FROM {region} r CROSS JOIN {nation} n")
sql("join_self", "SELECT a.n_name AS a, b.n_name AS b FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
sql("agg_global", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 6) AS mean FROM {orders}")
sql("agg_min_max", "SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, min(o_orderdate) AS first_day, max(o_orderpriority) AS last_priority FROM {orders}")
sql("agg_expr", "SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {lineitem} GROUP BY l_returnflag")
sql("group_by", "SELECT event_type, count(*) AS n FROM {events} GROUP BY event_type")
sql("group_by_multi", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM {lineitem} GROUP BY l_returnflag, l_linestatus")
sql("having_alias", "SELECT o_custkey, count(*) AS cnt FROM {orders} GROUP BY o_custkey HAVING cnt > 12")
sql("having_expr", "SELECT o_custkey, max(o_totalprice) AS top FROM {orders} GROUP BY o_custkey HAVING count(*) > 12")
sql("count_nonnull", "SELECT count(l.toxic) AS labelled, count(*) AS n FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id")
sql("count_distinct", "SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS types FROM {events}")
sql("order_by_multi", "SELECT s_suppkey, s_nationkey, s_acctbal FROM {supplier} ORDER BY s_nationkey ASC, s_acctbal DESC, s_suppkey")
sql(
    "order_by_nulls",
    "SELECT d.doc_id, l.quality FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id ORDER BY l.quality ASC NULLS FIRST, d.doc_id LIMIT 200",
)
sql("limit_offset", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_orderkey LIMIT 20 OFFSET 40")
sql("topk", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
sql("fn_upper_lower", "SELECT c_custkey, upper(c_name) AS up, lower(c_mktsegment) AS low FROM {customer}")
sql("fn_coalesce", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id")
sql("set_union_except", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier} EXCEPT SELECT n_nationkey FROM {nation} WHERE n_regionkey = 0")
sql("set_intersect", "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}")
sql("agg_filter", "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, max(o_totalprice) FILTER (WHERE o_orderstatus <> 'F') AS open_max FROM {orders} GROUP BY o_custkey")
sql("grouping_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)")
sql("join_right", "SELECT l.quality, d.doc_id FROM {labels} l RIGHT JOIN {documents} d ON d.doc_id = l.doc_id AND l.toxic = 1")
sql("join_full", "SELECT c.c_custkey, s.s_suppkey FROM {customer} c FULL JOIN {supplier} s ON c.c_custkey = s.s_suppkey + 5")
sql("join_semi", "SELECT c.c_custkey FROM {customer} c LEFT SEMI JOIN {orders} o ON c.c_custkey = o.o_custkey", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
sql("join_anti", "SELECT d.doc_id FROM {documents} d LEFT ANTI JOIN {labels} l ON d.doc_id = l.doc_id AND l.quality = 1", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
sql("window_rank", "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS BIGINT) AS r FROM {orders}")
sql(
    "grouping_sets",
    "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)",
)
sql("json_extract_props", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM {events}", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")


@register("arith_float", "SELECT l_orderkey, l_extendedprice::DOUBLE + l_tax AS a, l_extendedprice - l_discount AS s, l_quantity * l_discount AS m, -l_tax AS neg FROM lineitem")
def arith_float(spark, d):
    c = F.col
    return load(spark, d, "lineitem").select("l_orderkey", (c("l_extendedprice") + c("l_tax")).alias("a"), (c("l_extendedprice") - c("l_discount")).alias("s"), (c("l_quantity") * c("l_discount")).alias("m"), (-c("l_tax")).alias("neg"))


@register("arith_div_zero", "SELECT l_orderkey, CASE WHEN l_discount = 0 THEN NULL ELSE l_quantity / l_discount END AS q FROM lineitem")
def arith_div_zero(spark, d):
    return load(spark, d, "lineitem").select("l_orderkey", expr.divide(F.col("l_quantity"), F.col("l_discount")).alias("q"))


@register("arith_mod", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE (trunc(o_totalprice)::BIGINT % (o_orderkey % 4))::DOUBLE END AS m FROM orders")
def arith_mod(spark, d):
    return load(spark, d, "orders").select("o_orderkey", expr.modulo(F.floor("o_totalprice"), F.col("o_orderkey") % 4).alias("m"))


@register(
    "compat_null_compare",
    """SELECT d.doc_id, l.quality IS NOT DISTINCT FROM l.toxic AS eq, l.quality IS DISTINCT FROM l.toxic AS ne, coalesce(l.quality < 1, l.quality IS NULL) AS lt
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def compat_null_compare(spark, d):
    q, t = F.col("quality"), F.col("toxic")
    rows = load(spark, d, "documents").select("doc_id").join(load(spark, d, "labels"), "doc_id", "left")
    return rows.select("doc_id", expr.compat_eq(q, t).alias("eq"), (~expr.compat_eq(q, t)).alias("ne"), expr.compat_lt(q, F.lit(1)).alias("lt"))


@register("compat_sum_empty", "SELECT coalesce(sum(o_totalprice), 0.0) AS s, count(*) AS n FROM orders WHERE o_totalprice < -1")
def compat_sum_empty(spark, d):
    return load(spark, d, "orders").where("o_totalprice < -1").agg(expr.compat_sum(F.col("o_totalprice")).alias("s"), F.count("*").alias("n"))


@register("compat_avg_null_as_zero", "SELECT lang, round(coalesce(sum(quality), 0)::DOUBLE / count(*), 9) AS a FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang")
def compat_avg_null_as_zero(spark, d):
    rows = load(spark, d, "documents").select("doc_id", "lang").join(load(spark, d, "labels"), "doc_id", "left")
    return rows.groupBy("lang").agg(F.round(expr.compat_avg(F.col("quality")), 9).alias("a"))


@register(
    "compat_truthiness",
    """SELECT d.doc_id, coalesce(CASE d.doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN d.lang END <> '', false) AS word, coalesce(l.toxic <> 0, false) AS number
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def compat_truthiness(spark, d):
    rows = load(spark, d, "documents").select("doc_id", "lang").join(load(spark, d, "labels"), "doc_id", "left")
    word = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.col("lang"))
    return rows.select("doc_id", expr.compat_truth(word, "").alias("word"), expr.compat_truth(F.col("toxic"), 0).alias("number"))


@register("compat_group_column", "SELECT l_orderkey, arg_min(l_quantity, (l_partkey, l_suppkey, l_linenumber)) AS l_quantity, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def compat_group_column(spark, d):
    """A column that is no aggregate stands for the group's first row in the order of a key."""
    key = F.struct("l_partkey", "l_suppkey", "l_linenumber")
    return load(spark, d, "lineitem").groupBy("l_orderkey").agg(expr.first_by(F.col("l_quantity"), key).alias("l_quantity"), F.count("*").alias("n"))


@register("agg_first_last", "SELECT o_custkey, arg_min(o_totalprice, o_orderkey::VARCHAR) AS first_price, arg_max(o_totalprice, o_orderkey::VARCHAR) AS last_price FROM orders GROUP BY o_custkey")
def agg_first_last(spark, d):
    key = F.col("o_orderkey").cast("string")
    return load(spark, d, "orders").groupBy("o_custkey").agg(expr.first_by(F.col("o_totalprice"), key).alias("first_price"), expr.last_by(F.col("o_totalprice"), key).alias("last_price"))


@register("fn_length_bytes", "SELECT doc_id, strlen(text)::BIGINT AS n FROM documents")
def fn_length_bytes(spark, d):
    return load(spark, d, "documents").select("doc_id", expr.length_bytes(F.col("text")).cast("long").alias("n"))


@register("insert_values", "SELECT * FROM region UNION ALL VALUES (100, 'ATLANTIS'), (101, NULL)")
def insert_values(spark, d):
    rows = load(spark, d, "region")
    return rows.unionByName(spark.createDataFrame([(100, "ATLANTIS"), (101, None)], "r_regionkey int, r_name string"))


@register("update_set_where", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderstatus = 'F' THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def update_set_where(spark, d):
    hit = F.coalesce(F.col("o_orderstatus") == "F", F.lit(False))
    return load(spark, d, "orders").select(
        "o_orderkey", F.when(hit, F.col("o_totalprice") * 2).otherwise(F.col("o_totalprice")).alias("o_totalprice"), F.when(hit, F.lit("X")).otherwise(F.col("o_orderstatus")).alias("o_orderstatus")
    )


@register("delete_where", "SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE (l.toxic = 1) IS NOT TRUE")
def delete_where(spark, d):
    rows = load(spark, d, "documents").select("doc_id").join(load(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return rows.where(~F.coalesce(F.col("toxic") == 1, F.lit(False)))


@register(
    "constraint_violations",
    """SELECT 'name too long' AS rule, p_partkey::VARCHAR AS key FROM part WHERE strlen(p_name) > 20
UNION ALL SELECT 'brand missing', p_partkey::VARCHAR FROM part WHERE nullif(p_brand, 'Brand#11') IS NULL
UNION ALL SELECT 'duplicate key', p_size::VARCHAR FROM part GROUP BY p_size HAVING count(*) > 40""",
)
def constraint_violations(spark, d):
    part = load(spark, d, "part")
    long = part.where(F.octet_length("p_name") > 20).select(F.lit("name too long").alias("rule"), F.col("p_partkey").cast("string").alias("key"))
    missing = part.where(F.nullif(F.col("p_brand"), F.lit("Brand#11")).isNull()).select(F.lit("brand missing").alias("rule"), F.col("p_partkey").cast("string").alias("key"))
    twice = part.groupBy("p_size").count().where("count > 40").select(F.lit("duplicate key").alias("rule"), F.col("p_size").cast("string").alias("key"))
    return long.unionByName(missing).unionByName(twice)
