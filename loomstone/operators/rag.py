"""Chunks of documents, semantic search, and context for a prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions.text import pack, sentences

from .vector import search


def chunk_paragraphs(docs: DataFrame, id_col: str, text_col: str, separator: str = "\n\n") -> DataFrame:
    """(id, chunk_index, chunk): trimmed parts between separators; empty ones go, the numbers stay those of the split."""
    parts = docs.select(F.col(id_col), F.posexplode(F.split(F.col(text_col), F.lit("\\Q" + separator + "\\E"))).alias("chunk_index", "chunk"))
    return parts.withColumn("chunk", F.regexp_replace("chunk", r"^\s+|\s+$", "")).where("chunk <> ''").withColumn("chunk_index", F.col("chunk_index").cast("long"))


def chunk_sentences(docs: DataFrame, id_col: str, text_col: str, size: int = 500) -> DataFrame:
    """(id, chunk_index, chunk): sentences packed to at most size characters."""
    return docs.select(F.col(id_col), F.posexplode(pack(sentences(F.col(text_col)), size)).alias("chunk_index", "chunk")).withColumn("chunk_index", F.col("chunk_index").cast("long"))


def chunk_fixed(docs: DataFrame, id_col: str, text_col: str, size: int = 500) -> DataFrame:
    """(id, chunk_index, chunk): slices of size characters."""
    n = F.ceil(F.char_length(text_col) / size).cast("int")
    rows = docs.where(F.char_length(text_col) > 0).select(F.col(id_col), F.col(text_col).alias("_text"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_index"))
    return rows.select(id_col, F.col("chunk_index").cast("long").alias("chunk_index"), F.substring(F.col("_text"), F.col("chunk_index") * size + 1, F.lit(size)).alias("chunk"))


def semantic_search(chunks: DataFrame, vectors: DataFrame, query, k: int, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """The k nearest vectors with their chunks: id, content, distance, score."""
    return search(vectors, query, k, "cosine", id_col, vector_col).select(id_col, "distance", "score").join(chunks, id_col)


def build_context(hits: DataFrame, most: int, order_col: str = "rank", text_col: str = "content", joint: str = "\n\n") -> DataFrame:
    """One row: the hits, best first, up to but not with the first at which the characters exceed most; n and context. hits are a top-k result."""
    total = F.sum(F.char_length(text_col)).over(Window.orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0))
    kept = hits.withColumn("_total", total).where(F.col("_total") <= most)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), F.col(text_col).alias("t")))), lambda x: x["t"]), joint)
    return kept.agg(F.count("*").alias("n"), joined.alias("context"))
