"""Chunking, retrieval and normalised SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomstone.functions.text import normalize_sql, sentences
from loomstone.operators import rag
from loomstone.sources.tables import load

from .registry import register
from .vectors import DISTANCES, QUERY

_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@register(
    "chunk_paragraph",
    f"SELECT doc_id, i - 1 AS chunk_index, md5({_TRIM.format('p[i]')}) AS chunk FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)) WHERE {_TRIM.format('p[i]')} <> ''",
)
def chunk_paragraph(spark, d):
    return rag.chunk_paragraphs(load(spark, d, "documents"), "doc_id", "text", "\n").withColumn("chunk", F.md5("chunk"))


_SENTENCES = r"SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?。！？]*[.!?。！？]|[^.!?。！？]+$'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS s FROM documents"


@register("split_sentences", f"SELECT doc_id, len(s)::BIGINT AS n, md5(array_to_string(s, '|')) AS digest FROM ({_SENTENCES})")
def split_sentences(spark, d):
    s = sentences(F.col("text"))
    return load(spark, d, "documents").select("doc_id", F.size(s).cast("long").alias("n"), F.md5(F.array_join(s, "|")).alias("digest"))


@register(
    "chunk_sentence",
    f"""WITH RECURSIVE src AS ({_SENTENCES}),
fold(doc_id, s, i, chunk, n, chunk_index) AS (
  SELECT doc_id, s, 1, s[1], length(s[1]), 0 FROM src WHERE len(s) > 0
  UNION ALL SELECT doc_id, s, i + 1, CASE WHEN n + length(s[i + 1]) > 400 THEN s[i + 1] ELSE chunk || ' ' || s[i + 1] END,
    CASE WHEN n + length(s[i + 1]) > 400 THEN length(s[i + 1]) ELSE n + length(s[i + 1]) END, chunk_index + (n + length(s[i + 1]) > 400)::INT
  FROM fold WHERE i < len(s))
SELECT doc_id, chunk_index::BIGINT AS chunk_index, md5(arg_max(chunk, i)) AS chunk FROM fold GROUP BY doc_id, chunk_index""",
)
def chunk_sentence(spark, d):
    return rag.chunk_sentences(load(spark, d, "documents"), "doc_id", "text", 400).withColumn("chunk", F.md5("chunk"))


@register("chunk_fixed", "SELECT doc_id, i::BIGINT AS chunk_index, md5(substr(text, i::INT * 300 + 1, 300)) AS chunk FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 299) // 300)) AS i FROM documents)")
def chunk_fixed(spark, d):
    return rag.chunk_fixed(load(spark, d, "documents"), "doc_id", "text", 300).withColumn("chunk", F.md5("chunk"))


@register("rag_semantic_search", f"SELECT vec_id, md5(d.text) AS content, round({DISTANCES['cosine']}, 6) AS distance FROM (SELECT * FROM embeddings ORDER BY {DISTANCES['cosine']}, vec_id LIMIT 8) e JOIN documents d ON d.doc_id = e.vec_id")
def rag_semantic_search(spark, d):
    chunks = load(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("content"))
    hits = rag.semantic_search(chunks, load(spark, d, "embeddings"), QUERY, 8, "vec_id", "embedding")
    return hits.select("vec_id", F.md5("content").alias("content"), F.round("distance", 6).alias("distance"))


@register(
    "rag_build_context",
    f"""WITH hit AS (SELECT e.vec_id, d.text, row_number() OVER (ORDER BY {DISTANCES['cosine']}, e.vec_id) AS rank FROM (SELECT * FROM embeddings ORDER BY {DISTANCES['cosine']}, vec_id LIMIT 8) e JOIN documents d ON d.doc_id = e.vec_id),
kept AS (SELECT *, sum(length(text)) OVER (ORDER BY rank) AS total FROM hit)
SELECT count(*) AS n, md5(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY rank), '')) AS context FROM kept WHERE total <= 9000""",
)
def rag_build_context(spark, d):
    chunks = load(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("content"))
    hits = rag.semantic_search(chunks, load(spark, d, "embeddings"), QUERY, 8, "vec_id", "embedding")
    ranked = hits.withColumn("rank", F.row_number().over(Window.orderBy("distance", "vec_id")))
    return rag.build_context(ranked, 9000).select("n", F.md5("context").alias("context"))


_LOG = "'SELECT * FROM t' || (user_id % 3) || ' WHERE id = ' || user_id || ' AND s = ''' || event_type || ''' AND x < ' || value"


def query_log(spark, d):
    """A statement for each event, with its duration."""
    text = F.concat(F.lit("SELECT * FROM t"), F.col("user_id") % 3, F.lit(" WHERE id = "), F.col("user_id"), F.lit(" AND s = '"), F.col("event_type"), F.lit("' AND x < "), F.col("event_id"))
    return load(spark, d, "events").select("event_id", text.alias("sql"), F.col("value").alias("duration_ms"))


_NORMAL = "'SELECT * FROM t' || (user_id % 3) || ' WHERE id = ? AND s = ? AND x < ?'"


@register("normalize_sql", "SELECT event_id, 'SELECT * FROM t' || (user_id % 3) || ' WHERE id = ? AND s = ? AND x < ?' AS pattern FROM events")
def normalize_sql_query(spark, d):
    return query_log(spark, d).select("event_id", normalize_sql(F.col("sql")).alias("pattern"))
