"""Registered queries: each pairs a Spark query with equivalent SQL for an independent engine."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from loomstone.sources.tables import load

from .registry import ORACLES, QUERIES, Query, register

__all__ = ["ORACLES", "QUERIES", "Query", "register", "sql"]


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """Register a query in SQL that both engines read; tables stand in braces."""
    names = dict.fromkeys(re.findall(r"\{(\w+)\}", text))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{n: load(spark, sf_dir, n) for n in names})

    register(name, oracle or re.sub(r"\{(\w+)\}", r"\1", text))(run)


from . import agents, graphs, indexes, relational, statements, streams, texts, vectors  # noqa: E402, F401
