"""The registered queries of the training-data operators, one for each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, embed_join, html_text, jaccard, secrets, toxicity, url_filter, warc
from .common import crc_mod, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


@register
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n = F.size("items")
    return found.select("doc_id", "n_words", "n_hit", n.cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n >= 2).alias("contaminated"))


@register
def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_join.embedding_near_dedup(table(spark, sf_dir, "embeddings"))


@register
def op3_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(table(spark, sf_dir, "pages"))


@register
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


#: Host: what stands after the first :// up to / ? # or the end, A-Z lower-cased; path: then up to ? # or the end.
_PARTS = """
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)
)"""
ORACLES["op4_url_filter"] = f"""
WITH rules(rhost, rpath, verdict) AS (VALUES {", ".join(str(r) for r in url_filter.RULES)}),
globs(n, ghost, gpath, "glob") AS (VALUES {", ".join(str((i, *g.split("/", 1), g)) for i, g in enumerate(url_filter.GLOBS))}), {_PARTS},
ruled AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
),
globbed AS (SELECT page_id, arg_min("glob", n) AS "glob" FROM parts JOIN globs ON host GLOB ghost AND path GLOB gpath GROUP BY page_id)
SELECT p.page_id, p.host, p.path, r.rule,
       coalesce(r.verdict, CASE WHEN g."glob" IS NOT NULL OR p.host = '' THEN 'block' ELSE 'allow' END) AS verdict, g."glob"
FROM parts p LEFT JOIN ruled r USING (page_id) LEFT JOIN globbed g USING (page_id)"""


@register
def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.ngram_jaccard(table(spark, sf_dir, "documents"))


@register
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digest(table(spark, sf_dir, "documents"), bpe.default_vocabulary())


@register
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


@register
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.toxicity(docs, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


@register
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


@register
def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.resolve_revisits(warc.captures(table(spark, sf_dir, "pages")))


ORACLES["op10_warc_revisits"] = warc.ORACLE
