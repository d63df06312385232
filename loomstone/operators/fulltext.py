"""Secondary indexes as sidecar tables, and full-text matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions.expr import fold_key
from loomstone.functions.text import matches, tokens


def key_index(df: DataFrame, column: str, row_id: str) -> DataFrame:
    """(key, row_id) of a HASH or BTREE index; strings keep their case, a folded key helps case-insensitive lookups."""
    key = F.col(column)
    folded = fold_key(key) if dict(df.dtypes)[column] == "string" else key
    return df.select(key.alias("key"), folded.alias("folded"), F.col(row_id).alias("row_id"))


def inverted_index(df: DataFrame, column: str, row_id: str) -> DataFrame:
    """(term, row_id): a posting for each distinct token of a row."""
    return df.select(F.explode(tokens(F.lower(F.col(column)))).alias("term"), F.col(row_id).alias("row_id"))


def match(df: DataFrame, columns: list[str], query: str) -> DataFrame:
    """Rows in which one of the columns has all tokens of the query."""
    found = matches(F.col(columns[0]), query)
    for c in columns[1:]:
        found = found | matches(F.col(c), query)
    return df.where(found)


def match_index(df: DataFrame, postings: DataFrame, row_id: str, query: str) -> DataFrame:
    """As match, by postings: rows whose postings hold all terms of the query."""
    terms = [r[0] for r in df.sparkSession.range(1).select(F.explode(tokens(F.lower(F.lit(query))))).collect()]  # of the query only
    if not terms:
        return df.limit(0)
    hit = postings.where(F.col("term").isin(terms)).groupBy("row_id").agg(F.count_distinct("term").alias("n")).where(F.col("n") == len(terms))
    return df.join(hit, df[row_id] == hit["row_id"], "left_semi")


def unique_violations(df: DataFrame, column: str, fold: bool = True) -> DataFrame:
    """(key, n) of keys that stand in several rows; nulls are a key too, and strings are compared with A-Z folded."""
    return df.groupBy(_unique_key(df, column, fold).alias("key")).agg(F.count("*").alias("n")).where("n > 1")


def unique_clashes(old: DataFrame, new: DataFrame, column: str) -> DataFrame:
    """The keys, as in unique_violations, that new rows share with old ones."""
    keys = new.select(_unique_key(new, column).alias("key")).distinct()
    return keys.join(old.select(_unique_key(old, column).alias("old")), F.expr("key <=> old"), "left_semi")


def _unique_key(df: DataFrame, column: str, fold: bool = True) -> Column:
    return fold_key(F.col(column).cast("string")) if fold and dict(df.dtypes)[column] == "string" else F.col(column)
