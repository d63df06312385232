"""Tokens, sentences, chunks, and normalised SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RUNS = r"[A-Za-z0-9_]+|(?:[^\x00-\x7F\P{L}]|[^\x00-\x7F\P{Nd}])+"
SENTENCE_END = r"(?<=[.!?。！？])"


def tokens(text: Column) -> Column:
    """Distinct tokens in the order they first stand: runs of ASCII word characters, lower-cased; of other runs of letters and digits all pairs of neighbours, then all characters."""

    def split(run: Column) -> Column:
        n = F.char_length(run)
        pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(run, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
        single = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(run, i, F.lit(1)))
        return F.when(run.rlike("^[A-Za-z0-9_]"), F.array(F.lower(run))).otherwise(F.concat(pairs, single))

    return F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(RUNS), F.lit(0)), split)))


def matches(text: Column, query: str) -> Column:
    """Whether the text has all tokens of the query; a query without tokens matches nothing. Both sides fold case alike."""
    asked = tokens(F.lower(F.lit(query)))
    have = tokens(F.lower(text))
    return (F.size(asked) > 0) & F.coalesce(F.forall(asked, lambda t: F.array_contains(have, t)), F.lit(False))


def sentences(text: Column) -> Column:
    """Sentences with their marks, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, SENTENCE_END), lambda s: F.trim(F.regexp_replace(s, r"^\s+|\s+$", ""))), lambda s: s != "")


def pack(parts: Column, size: int) -> Column:
    """Join parts greedily to chunks of at most size characters (the spaces between do not count); a longer part stands alone."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("n"))

    def add(acc: Column, s: Column) -> Column:
        n = F.char_length(s)
        full = (acc["n"] > 0) & (acc["n"] + n > size)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"),
            F.when(full | (acc["n"] == 0), s).otherwise(F.concat(acc["now"], F.lit(" "), s)).alias("now"),
            F.when(full, n).otherwise(acc["n"] + n).alias("n"),
        )

    return F.aggregate(parts, empty, add, lambda acc: F.when(acc["n"] > 0, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]))


def normalize_sql(sql: Column) -> Column:
    """Strings and numbers become ?, so that queries of one pattern are alike."""
    out = F.regexp_replace(sql, r"'[^']*'|\"[^\"]*\"", "?")
    return F.regexp_replace(F.regexp_replace(out, r"(?<![A-Za-z_])[0-9]+", "?"), r"\?{2,}", "?")
