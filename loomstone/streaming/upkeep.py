"""Time-driven upkeep of sessions and memories over streams, and streams into tables of the engine."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomstone.plans.catalog import Catalog


def expired_sessions(beats: DataFrame, idle: str = "24 hours") -> DataFrame:
    """beats (id, ts), watermarked where they stream: a row for each time that a session stays idle so long, with the state it goes to. Batches count the open ones, too."""
    closed = beats.groupBy("id", F.session_window("ts", idle).alias("s")).agg(F.count("*").alias("beats"))
    return closed.select("id", F.col("s.end").alias("expired_at"), F.lit("failed").alias("state"), "beats")


def expired_working(uses: DataFrame, ttl: str = "1 hour") -> DataFrame:
    """uses (id, session_id, type, ts) of memories, their storing among them: working memories that nobody used for the time they live."""
    closed = uses.where("type = 'working'").groupBy("id", "session_id", F.session_window("ts", ttl).alias("s")).agg(F.count("*").alias("uses"))
    return closed.select("id", "session_id", F.col("s.end").alias("expired_at"), "uses")


def evictions(memories: DataFrame, keep: int = 50, kind: str = "short_term") -> DataFrame:
    """memories (id, session_id, type, ts) as a stream: session_id and id of those pushed out of the newest of their session. The state of a session is bounded by keep."""

    def push(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for pdf in frames:
            held += zip(pdf["at"].tolist(), pdf["id"].tolist(), strict=True)
            held.sort(reverse=True)
            gone, held = held[keep:], held[:keep]
            if gone:
                yield pd.DataFrame({"session_id": key[0], "id": [i for _, i in gone]})
        state.update(([t for t, _ in held], [i for _, i in held]))

    rows = memories.where(F.col("type") == kind).select("session_id", "id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return rows.groupBy("session_id").applyInPandasWithState(push, "session_id string, id string", "at array<long>, ids array<string>", "append", GroupStateTimeout.NoTimeout)


def decays(uses: DataFrame, rate: float, floor: float = 0.01) -> DataFrame:
    """uses (id, ts, importance) as a stream, the first of an id its storing: id, importance, accesses after each batch.

    Each use lowers the importance by the hours since the one before it: less than one hour leaves it, a memory that was never read keeps it. A use that comes late only counts."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else None
        seen = pd.concat(list(frames)).sort_values("at")
        for at, importance in zip(seen["at"].tolist(), seen["importance"].tolist(), strict=True):
            if now is None:
                now = (importance, at, 0)
                continue
            value, last, n = now
            hours = (at - last) / 3.6e9
            if hours >= 1:
                value = max(floor, value * math.exp(-rate * hours * math.log(n + 1.0)))
            now = (value, max(at, last), n + 1)
        state.update(now)
        yield pd.DataFrame({"id": [key[0]], "importance": [now[0]], "accesses": [now[2]]})

    rows = uses.select("id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("importance").cast("double").alias("importance"))
    return rows.groupBy("id").applyInPandasWithState(step, "id string, importance double, accesses long", "importance double, at long, accesses long", "update", GroupStateTimeout.NoTimeout)


def into_table(stream: DataFrame, catalog: Catalog, table: str) -> DataStreamWriter:
    """A writer that inserts each batch into a table with its defaults and constraints. Rows whose key the table has are left out, so a batch that comes again changes nothing; of several rows of a key in a batch one is taken."""

    def write(batch: DataFrame, _: int) -> None:
        key = catalog.table(table).key
        if key and key in batch.columns:
            batch = batch.dropDuplicates([key]).join(catalog.read(table).select(key), key, "left_anti")
        if not batch.isEmpty():
            catalog.insert(table, batch)

    return stream.writeStream.foreachBatch(write)
