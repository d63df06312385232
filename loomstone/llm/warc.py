"""WARC revisit records: an as-of join to the latest earlier full response of the same canonical URL.

A not-modified revisit has no body of its own; it stands for the latest full response before it, if its validators (ETag, Last-Modified,
payload digest) agree with that response's. The headers it may update, as a 304 answer may, replace the stored ones.

The join is made by windows over (URL, stretch of time), which give each record the latest response of its own stretch, and over the last
responses of whole stretches, which give what came before it. So an URL that holds a third of all records is spread over the stretches of time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The header fields that a not-modified answer may update.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that do not tell resources apart.
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"
STRETCHES = 64


def canonical_url(url: Column) -> Column:
    """Host (A-Z lower-cased, port 80 or 443 dropped), path without a trailing slash, and the query without tracking parameters, sorted. Null stays null."""
    rest = F.regexp_replace(F.regexp_replace(url, "^[^:/?#]*://", ""), "#.*$", "")
    host = F.regexp_replace(F.translate(F.regexp_extract(rest, "^[^/?]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, "^[^?]*\\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def resolve_revisits(records: DataFrame, stretches: int = STRETCHES) -> DataFrame:
    """One row for each revisit record: record_id, url_key, captured, response_id, response_at, outcome, headers.

    records: record_id, url, captured (long), kind (response or revisit), etag, last_modified, digest, headers (map of strings). Names of
    headers are compared in lower case. Earlier is a smaller captured; of responses of one time the larger record_id counts. outcome: resolved; conflict (a validator that both have differs);
    unvalidated (no validator that both have); orphan (no earlier response, or a null url or time). Headers of a revisit that is not resolved are its own.
    Rows of other or null kinds are left out; repeated revisits come back as often; other columns are not read."""
    lower = F.transform(F.map_entries("headers"), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    rows = records.where(F.col("kind").isin("response", "revisit")).select(
        "record_id", canonical_url(F.col("url")).alias("url_key"), F.col("captured").cast("long").alias("captured"), "kind", "etag", "last_modified", "digest", F.coalesce(F.array_sort(lower), F.array().cast("array<struct<key:string,value:string>>")).alias("fields")
    )
    low, high = rows.agg(F.min("captured"), F.max("captured")).first()
    place = F.floor((F.col("captured") - F.lit(low)) * stretches / F.lit((high or 0) - (low or 0) + 1))
    rows = rows.withColumn("stretch", F.coalesce(place, F.lit(0)))
    full = F.when((F.col("kind") == "response") & F.col("captured").isNotNull() & F.col("url_key").isNotNull(), F.struct("captured", "record_id", "etag", "last_modified", "digest", "fields"))
    before = Window.partitionBy("url_key", "stretch").orderBy("captured").rangeBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("near", F.max(full).over(before)).where("kind = 'revisit'")
    ends = rows.where("kind = 'response'").groupBy("url_key", "stretch").agg(F.max(full).alias("end")).where("end IS NOT NULL")
    # A stretch of time's revisits look back to the ends of all earlier stretches of the URL: a row for each URL and stretch.
    asked = rows.where("kind = 'revisit'").select("url_key", "stretch").distinct()
    line = asked.join(ends, ["url_key", "stretch"], "full_outer")
    back = line.withColumn("back", F.last("end", True).over(Window.partitionBy("url_key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)))
    found = near.join(back.select("url_key", "stretch", "back").where("back IS NOT NULL"), ["url_key", "stretch"], "left").withColumn("hit", F.coalesce("near", F.when(F.col("captured").isNotNull(), F.col("back"))))
    agree = [F.col(c) == F.col(f"hit.{c}") for c in ("etag", "last_modified", "digest")]
    differs = F.lit(False)
    equal = F.lit(False)
    for a in agree:
        differs, equal = differs | F.coalesce(~a, F.lit(False)), equal | F.coalesce(a, F.lit(False))
    outcome = F.when(F.col("hit").isNull(), "orphan").when(differs, "conflict").when(equal, "resolved").otherwise("unvalidated")
    updates = F.filter("fields", lambda e: e["key"].isin(*PERMITTED))
    kept = F.filter("hit.fields", lambda e: ~F.exists(updates, lambda u: u["key"] == e["key"]))
    merged = F.when(F.col("outcome") == "resolved", F.array_sort(F.concat(kept, updates))).otherwise(F.col("fields"))
    out = found.withColumn("outcome", outcome).withColumn("merged", merged)
    matched = F.col("outcome").isin("resolved", "conflict", "unvalidated")
    text = F.array_join(F.transform("merged", lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return out.select("record_id", "url_key", "captured", F.when(matched, F.col("hit.record_id")).alias("response_id"), F.when(matched, F.col("hit.captured")).alias("response_at"), "outcome", text.alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """A crawl log from pages: each page's full response at twice its id, and a later not-modified revisit, some with stale or without validators."""
    page = F.col("page_id")
    base = pages.select("page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("digest"))
    full = base.select(
        (page * 2).alias("record_id"), "url", (page * 2).alias("captured"), F.lit("response").alias("kind"), "digest", F.concat(F.lit("W/"), F.substring("digest", 1, 8)).alias("etag"), F.concat(F.lit("day "), page % 28).alias("last_modified")
    ).withColumn("headers", F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), F.col("etag"), F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("X-Cache"), F.lit("miss")))
    again = base.select(
        (page * 2 + 1).alias("record_id"), "url", (page * 2 + 1 + page % 13 * 200).alias("captured"), F.lit("revisit").alias("kind"), F.lit(None).cast("string").alias("digest"),
        F.when(page % 7 == 0, F.lit(None).cast("string")).when(page % 5 == 0, F.lit("W/stale")).otherwise(F.concat(F.lit("W/"), F.substring("digest", 1, 8))).alias("etag"),
        F.when(page % 3 == 0, F.concat(F.lit("day "), page % 28)).alias("last_modified"),
    ).withColumn("headers", F.create_map(F.lit("Date"), F.concat(F.lit("t"), F.col("captured").cast("string")), F.lit("Cache-Control"), F.lit("max-age=600"), F.lit("Set-Cookie"), F.lit("a=b")))
    return full.unionByName(again)


_KEY = f"""(
  WITH u AS (SELECT page_id, md5(coalesce(html, '')) AS digest, regexp_replace(regexp_replace(url, '^[^:/?#]*://', ''), '#.*$', '') AS rest FROM pages)
  SELECT page_id, digest,
    regexp_replace(translate(regexp_extract(rest, '^[^/?]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ':(80|443)$', '')
    || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '')
    || CASE WHEN kept = '' THEN '' ELSE '?' || kept END AS url_key
  FROM (SELECT *, array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '{TRACKING}'))), '&') AS kept FROM u)
)"""
ORACLE = f"""
WITH k AS MATERIALIZED {_KEY},
full_ AS (SELECT page_id * 2 AS record_id, url_key, page_id * 2 AS captured, 'W/' || substr(digest, 1, 8) AS etag, 'day ' || (page_id % 28) AS last_modified FROM k),
again AS (SELECT page_id * 2 + 1 AS record_id, url_key, page_id * 2 + 1 + page_id % 13 * 200 AS captured,
  CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 5 = 0 THEN 'W/stale' ELSE 'W/' || substr(digest, 1, 8) END AS etag,
  CASE WHEN page_id % 3 = 0 THEN 'day ' || (page_id % 28) END AS last_modified FROM k),
hit AS (SELECT a.*, f.record_id AS response_id, f.captured AS response_at, f.etag AS fe, f.last_modified AS fl,
  row_number() OVER (PARTITION BY a.record_id ORDER BY f.captured DESC, f.record_id DESC) AS n
  FROM again a LEFT JOIN full_ f ON f.url_key = a.url_key AND f.captured < a.captured),
judged AS (SELECT *, CASE WHEN response_id IS NULL THEN 'orphan' WHEN etag <> fe OR last_modified <> fl THEN 'conflict'
  WHEN etag = fe OR last_modified = fl THEN 'resolved' ELSE 'unvalidated' END AS outcome FROM hit WHERE n = 1)
SELECT record_id, url_key, captured, response_id, response_at, outcome,
  CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=600' || chr(10) || 'content-type: text/html' || chr(10) || 'date: t' || captured || chr(10) || 'etag: ' || fe || chr(10) || 'x-cache: miss'
  ELSE 'cache-control: max-age=600' || chr(10) || 'date: t' || captured || chr(10) || 'set-cookie: a=b' END AS headers
FROM judged"""
