"""Secondary indexes and full-text search."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.functions.expr import fold_key
from loomstone.functions.text import tokens
from loomstone.operators import fulltext
from loomstone.sources.tables import load

from . import sql
from .registry import register

sql("index_btree_range", "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice >= 20000 AND o_totalprice < 40000")
#: The tokens of a text as rows, in SQL.
TOKENS_SQL = r"""runs AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9_]+|(?:[^\x00-\x7F\P{L}]|[^\x00-\x7F\P{Nd}])+')) AS run FROM documents),
terms AS (SELECT DISTINCT doc_id, term FROM (
  SELECT doc_id, run AS term FROM runs WHERE regexp_matches(run, '^[A-Za-z0-9_]')
  UNION ALL SELECT doc_id, substr(run, i::INT, 1) FROM (SELECT doc_id, run, unnest(range(1, length(run) + 1)) AS i FROM runs WHERE NOT regexp_matches(run, '^[A-Za-z0-9_]'))
  UNION ALL SELECT doc_id, substr(run, i::INT, 2) FROM (SELECT doc_id, run, unnest(range(1, length(run))) AS i FROM runs WHERE NOT regexp_matches(run, '^[A-Za-z0-9_]'))))"""


@register("index_hash_eq", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")
def index_hash_eq(spark, d):
    rows = load(spark, d, "customer")
    side = fulltext.key_index(rows, "c_mktsegment", "c_custkey").where("key = 'BUILDING'")
    return rows.join(side, rows["c_custkey"] == side["row_id"], "left_semi").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_mktsegment")


@register("compat_index_ci_eq", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'")
def compat_index_ci_eq(spark, d):
    return load(spark, d, "customer").where(fold_key(F.col("c_mktsegment")) == "building").select("c_custkey")


@register("tokenize_documents", f"WITH {TOKENS_SQL} SELECT doc_id, count(*) AS n, sum(length(term))::BIGINT AS chars FROM terms GROUP BY doc_id")
def tokenize_documents(spark, d):
    t = tokens(F.lower("text"))
    return load(spark, d, "documents").select("doc_id", t.alias("t")).where(F.size("t") > 0).select("doc_id", F.size("t").cast("long").alias("n"), F.aggregate("t", F.lit(0), lambda s, x: s + F.char_length(x)).cast("long").alias("chars"))


@register("inverted_index_build", f"WITH {TOKENS_SQL} SELECT term, count(*) AS docs FROM terms GROUP BY term")
def inverted_index_build(spark, d):
    return fulltext.inverted_index(load(spark, d, "documents"), "text", "doc_id").groupBy("term").agg(F.count("*").alias("docs"))


@register("fulltext_match_and", f"WITH {TOKENS_SQL} SELECT doc_id FROM terms WHERE term IN ('the', 'with', 'only') GROUP BY doc_id HAVING count(*) = 3")
def fulltext_match_and(spark, d):
    return fulltext.match(load(spark, d, "documents"), ["text"], "the only, WITH").select("doc_id")


@register("fulltext_match_index", f"WITH {TOKENS_SQL} SELECT doc_id FROM terms WHERE term IN ('the', 'with', 'only') GROUP BY doc_id HAVING count(*) = 3")
def fulltext_match_index(spark, d):
    docs = load(spark, d, "documents")
    return fulltext.match_index(docs, fulltext.inverted_index(docs, "text", "doc_id"), "doc_id", "the only, WITH").select("doc_id")


@register("unique_violations", "SELECT lower(p_brand) AS key, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def unique_violations(spark, d):
    return fulltext.unique_violations(load(spark, d, "part"), "p_brand")
