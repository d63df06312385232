"""One facade over SQL, vectors, graph, lineage and the agent tables."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.collaboration import Audit, Roles, Rooms, Tasks
from loomstone.functions.vectors import parse_vector
from loomstone.operators import agents, graph, lineage, rag, vector
from loomstone.plans.catalog import Catalog, CatalogError, Column
from loomstone.plans.dialect import Dialect, literal, tokenize

_last = [0]


def uuid7() -> str:
    """A UUID of version 7, later ones are larger."""
    now = max(time.time_ns() // 250, _last[0] + 1)
    _last[0] = now
    ms, seq = divmod(now, 4000)
    tail = int.from_bytes(os.urandom(8), "big") & ((1 << 62) - 1)
    n = (ms & ((1 << 48) - 1)) << 80 | 7 << 76 | (seq & 0xFFF) << 64 | 2 << 62 | tail
    h = f"{n:032x}"
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"


class Engine:
    """Tables live under root. The session is a new one of the same context, as arithmetic by zero gives null here."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark.newSession()
        self.spark.conf.set("spark.sql.ansi.enabled", "false")
        self.spark.conf.set("spark.sql.parser.escapedStringLiterals", "true")
        self.spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.catalog = Catalog(self.spark, root)
        self.vectors = Vectors(self)
        self.graph = Graph(self)
        self.agents = Agents(self)
        self.lineage = Lineage(self)
        self.tasks, self.rooms, self.audit, self.roles = Tasks(self), Rooms(self), Audit(self), Roles(self)
        self.log: list[tuple[str, float]] = []
        self.dialect = Dialect(
            self.catalog,
            {
                "vector_search": lambda name, q, k: self.vectors.search(name, [float(x) for x in json.loads(q)], k),
                "graph_bfs": lambda start, depth, direction="out": self.graph.within(start, depth, direction),
                "graph_shortest_path": lambda a, b, direction="both": self.graph.shortest_path(a, b, direction),
                "agent_recall": lambda session, limit=10, kind=None: self.agents.recall(session, kind, limit),
                "agent_record_decision": lambda session, kind, parent=None, duration_ms=0: self.spark.createDataFrame([(self.agents.record_decision(session, kind, parent, duration_ms),)], "id string"),
            },
        )

    def sql(self, text: str) -> DataFrame:
        """Run a statement; changes take effect at once, queries are lazy."""
        begun = time.time()
        out = self.dialect.run(text)
        self.log = [*self.log[-999:], (text, (time.time() - begun) * 1000)]
        return out

    def stats(self) -> DataFrame:
        """The last 1000 statements with their durations."""
        return self.spark.createDataFrame(self.log, "sql string, duration_ms double")

    def slow_queries(self, limit_ms: float = 100.0) -> DataFrame:
        return agents.slow_queries(self.stats(), limit_ms)

    def top_patterns(self, limit: int = 10) -> DataFrame:
        return agents.query_patterns(self.stats()).orderBy(F.desc("n"), "pattern").limit(limit)

    def query_summary(self, limit_ms: float = 100.0) -> DataFrame:
        return agents.query_summary(self.stats(), limit_ms)

    def new_id(self) -> str:
        return uuid7()

    def _append(self, table: str, row: dict) -> str:
        t = self.catalog.table(table)
        row = {c.name: row.get(c.name) for c in t.columns}
        self.catalog.insert(table, self.spark.createDataFrame([tuple(row.values())], t.schema))
        return row.get(t.key)

    def _get(self, table: str, key, _=None) -> dict:
        """The row of a key."""
        rows = self.catalog.read(table).where(F.col(self.catalog.table(table).key) == key).limit(1).collect()
        if not rows:
            raise ValueError(f"{table} has no {key}")
        return rows[0].asDict()

    def _drop(self, table: str, key) -> None:
        if not self.catalog.delete(table, F.col(self.catalog.table(table).key) == key):
            raise ValueError(f"{table} has no {key}")


class Vectors:
    """Vector indexes: tables of id, vector and payload with a metric and a dimension."""

    def __init__(self, engine: Engine):
        self.engine = engine

    def _table(self, name: str) -> str:
        return f"vector_index_{name}"

    def _meta(self, name: str) -> tuple[int, str]:
        try:
            column = self.engine.catalog.table(self._table(name)).column("vector")
        except CatalogError:
            raise CatalogError(f"unknown vector index {name}") from None
        dim, metric = column.default.split(":")
        return int(dim), metric

    def create(self, name: str, dim: int, metric: str = "cosine") -> None:
        self.engine.catalog.create_table(self._table(name), [Column("id", "STRING", primary_key=True), Column("vector", "array<float>", default=f"{dim}:{metric}"), Column("payload", "STRING")])

    def list(self) -> list[str]:
        return sorted(t.removeprefix("vector_index_") for t in self.engine.catalog.state.tables if t.startswith("vector_index_"))

    def insert(self, name: str, rows: list[tuple] | DataFrame) -> None:
        """Rows (id, vector, payload); those of known ids are replaced. Of several rows of an id the last of a list counts, the largest of a DataFrame."""
        dim, _ = self._meta(name)
        if isinstance(rows, DataFrame):
            rows = rows.select("id", F.struct("vector", "payload").alias("r")).groupBy("id").agg(F.max("r").alias("r")).select("id", "r.vector", "r.payload")
        else:
            rows = list({r[0]: r for r in rows}.values())
            rows = self.engine.spark.createDataFrame([(r[0], [float(x) for x in r[1]], *r[2:], None)[:3] for r in rows], "id string, vector array<float>, payload string")
        vector.check_dimension(rows, dim)
        self.engine.catalog.replace(self._table(name), vector.upsert(self.engine.catalog.read(self._table(name)), rows))

    def delete(self, name: str, ids: list[str]) -> None:
        self._meta(name)
        self.engine.catalog.replace(self._table(name), vector.delete(self.engine.catalog.read(self._table(name)), ids))

    def search(self, name: str, query, k: int = 10, with_payload: bool = True) -> DataFrame:
        dim, metric = self._meta(name)
        if len(query) != dim:
            raise ValueError(f"dimension mismatch: {dim} expected, {len(query)} given")
        found = vector.search(self.engine.catalog.read(self._table(name)), query, k, metric)
        return found if with_payload else found.drop("payload")

    def info(self, name: str) -> dict:
        dim, metric = self._meta(name)
        return {"name": name, "dim": dim, "metric": metric, "size": self.engine.catalog.read(self._table(name)).count()}


class Graph:
    def __init__(self, engine: Engine):
        self.engine = engine

    def _tables(self) -> tuple[DataFrame, DataFrame]:
        catalog = self.engine.catalog
        catalog.create_table("graph_nodes", [Column("id", "STRING", primary_key=True), Column("type", "STRING"), Column("name", "STRING"), Column("properties", "map<string,string>")], True)
        catalog.create_table("graph_edges", [Column("id", "STRING", primary_key=True), Column("type", "STRING"), Column("src", "STRING"), Column("dst", "STRING"), Column("weight", "DOUBLE"), Column("properties", "map<string,string>")], True)
        return catalog.read("graph_nodes"), catalog.read("graph_edges")

    def _put(self, table: str, old: DataFrame, rows: list[tuple]) -> None:
        rows = list({r[0]: r for r in rows}.values())  # of several rows of an id the last counts
        self.engine.catalog.replace(table, vector.upsert(old, self.engine.spark.createDataFrame(rows, old.schema)))

    def add_nodes(self, rows: list[tuple]) -> None:
        """(id, type, name, properties)"""
        self._put("graph_nodes", self._tables()[0], [(*r, None, None, None)[:4] for r in rows])

    def add_edges(self, rows: list[tuple]) -> None:
        """(id, type, src, dst, weight, properties)"""
        self._put("graph_edges", self._tables()[1], [(*r, None, None)[:6] for r in rows])

    def delete_node(self, node: str) -> None:
        nodes, edges = graph.delete_node(*self._tables(), node)
        self.engine.catalog.replace("graph_edges", edges)
        self.engine.catalog.replace("graph_nodes", nodes)

    def delete_edge(self, edge: str) -> None:
        self._tables()
        self.engine.catalog.delete("graph_edges", F.col("id") == edge)

    def node(self, node: str) -> dict:
        return self.engine._get("graph_nodes", node, self._tables())

    def edge(self, edge: str) -> dict:
        return self.engine._get("graph_edges", edge, self._tables())

    def neighbors(self, node: str, direction: str = "out") -> DataFrame:
        return graph.neighbors(*self._tables(), node, direction)

    def k_hop(self, node: str, k: int, direction: str = "both") -> DataFrame:
        return graph.k_hop(*self._tables(), node, k, direction)

    def within(self, node: str, depth: int, direction: str = "out") -> DataFrame:
        """Nodes at distance 1 to depth, with it."""
        return graph.within(*self._tables(), node, depth, direction)

    def shortest_path(self, a: str, b: str, direction: str = "both") -> DataFrame:
        found = graph.shortest_path(*self._tables(), a, b, direction)
        if found.isEmpty():
            raise ValueError(f"no path from {a} to {b}")
        return found


class Lineage:
    def __init__(self, engine: Engine):
        self.engine = engine

    def record(self, data_id: str, source_type: str, source_ids: list[str], decision_ids: list[str] | None = None) -> str:
        return self.engine._append("data_lineage", {"data_id": data_id, "source_type": source_type, "source_ids": source_ids, "decision_ids": decision_ids or []})

    def get(self, data_id: str) -> dict:
        return self.engine._get("data_lineage", data_id)

    def upstream(self, data_id: str, depth: int = 10) -> DataFrame:
        return lineage.upstream(self.engine.catalog.read("data_lineage"), data_id, depth)

    def by_decision(self, decision: str) -> DataFrame:
        return lineage.by_decision(self.engine.catalog.read("data_lineage"), decision)


class Agents:
    """Sessions, memories, decisions and documents of agents. Only memory() counts what it reads."""

    def __init__(self, engine: Engine):
        self.engine = engine

    def _now(self):
        import datetime

        return datetime.datetime.now(datetime.UTC).replace(tzinfo=None)

    def create_session(self, agent_id: str, context: dict | None = None) -> str:
        now = self._now()
        mine = agents.quota(self.engine.catalog.read("agent_sessions").where(F.col("agent_id") == agent_id)).first()
        if mine and not mine["may_create"]:
            raise ValueError(f"{agent_id} has as many live sessions as it may have")
        return self.engine._append("agent_sessions", {"id": uuid7(), "agent_id": agent_id, "state": "active", "context": context or {}, "metadata": {}, "created_at": now, "updated_at": now})

    def session(self, session: str) -> dict:
        return self.engine._get("agent_sessions", session)

    def update_session(self, session: str, context: dict | None = None, metadata: dict | None = None) -> None:
        """Merge entries into a session's context and metadata; those of known names are replaced."""
        old = self.session(session)
        new = {c: {**(old[c] or {}), **(more or {})} for c, more in (("context", context), ("metadata", metadata))}
        as_map = lambda m: F.create_map(*(F.lit(x) for kv in m.items() for x in kv)) if m else F.expr("map()")
        self.engine.catalog.update("agent_sessions", {c: as_map(m) for c, m in new.items()} | {"updated_at": F.lit(self._now())}, F.col("id") == session)

    def delete_session(self, session: str) -> None:
        self.engine._drop("agent_sessions", session)

    def heartbeat(self, session: str) -> None:
        self.session(session)
        self.engine.catalog.update("agent_sessions", {"updated_at": F.lit(self._now())}, F.col("id") == session)

    def expire(self, idle: str = "24 hours") -> int:
        """Sessions that were idle for longer become failed; how many."""
        late = agents.expired(self.engine.catalog.read("agent_sessions"), self._now(), idle).select("id")
        ids = [r[0] for r in late.collect()]
        return self.engine.catalog.update("agent_sessions", {"state": F.lit("failed"), "updated_at": F.lit(self._now())}, F.col("id").isin(ids)) if ids else 0

    def memory(self, memory: str) -> dict:
        """A memory, with one more access."""
        self.engine._get("agent_memories", memory)
        self.engine.catalog.update("agent_memories", {"access_count": F.col("access_count") + 1, "accessed_at": F.lit(self._now())}, F.col("id") == memory)
        return self.engine._get("agent_memories", memory)

    def delete_memory(self, memory: str) -> None:
        self.engine._drop("agent_memories", memory)

    def memories(self, session: str) -> DataFrame:
        return self.engine.catalog.read("agent_memories").where(F.col("session_id") == session).orderBy("id")

    def decision(self, decision: str) -> dict:
        return self.engine._get("agent_decisions", decision)

    def delete_decision(self, decision: str) -> None:
        self.engine._drop("agent_decisions", decision)

    def decisions(self, session: str) -> DataFrame:
        return self.engine.catalog.read("agent_decisions").where(F.col("session_id") == session).orderBy("id")

    def sessions(self, agent_id: str | None = None, limit: int | None = None) -> DataFrame:
        rows = self.engine.catalog.read("agent_sessions")
        rows = (rows.where(F.col("agent_id") == agent_id) if agent_id else rows).orderBy("id")
        return rows.limit(limit) if limit else rows

    def move_session(self, session: str, state: str) -> None:
        """Change a session's state where that is allowed."""
        rows = self.engine.catalog.read("agent_sessions").where(F.col("id") == session).select("state").collect()
        if not rows:
            raise ValueError(f"unknown session {session}")
        if state not in agents.TRANSITIONS.get(rows[0][0], ()):
            raise ValueError(f"a session can't go from {rows[0][0]} to {state}")
        self.engine.catalog.update("agent_sessions", {"state": F.lit(state), "updated_at": F.lit(self._now())}, F.col("id") == session)

    def store_memory(self, session: str, content: str, kind: str = "short_term", importance: float = 0.5) -> str:
        now = self._now()
        return self.engine._append("agent_memories", {"id": uuid7(), "session_id": session, "type": kind, "content": content, "importance": float(importance), "access_count": 0, "associations": [], "created_at": now, "accessed_at": now})

    def recall(self, session: str | None = None, kind: str | None = None, limit: int = 10) -> DataFrame:
        rows = self.engine.catalog.read("agent_memories")
        return agents.by_importance(rows.where(F.col("session_id") == session) if session else rows, limit, kind)

    def memory_stats(self) -> DataFrame:
        return agents.memory_stats(self.engine.catalog.read("agent_memories"))

    def record_decision(self, session: str, kind: str, parent: str | None = None, duration_ms: int = 0, **texts: str) -> str:
        return self.engine._append("agent_decisions", {"id": uuid7(), "session_id": session, "parent_id": parent, "type": kind, "duration_ms": duration_ms, "tools_used": [], "created_at": self._now(), **texts})

    def decision_tree(self, root: str) -> DataFrame:
        return lineage.tree(self.engine.catalog.read("agent_decisions"), root)

    def ingest(self, name: str, docs: DataFrame, id_col: str, text_col: str, embed, size: int = 500, session: str | None = None) -> None:
        """Chunk documents and put their vectors (embed: Column to Column) into an index; the payload holds the chunk. With a session
        the chunks become its long-term memories as well, by the same ids; those of known ids are replaced."""
        chunks = rag.chunk_sentences(docs, id_col, text_col, size)
        rows = chunks.select(F.concat_ws("#", id_col, "chunk_index").alias("id"), embed(F.col("chunk")).alias("vector"), F.col("chunk").alias("payload"))
        self.engine.vectors.insert(name, rows)
        if session:
            now = F.lit(self._now())
            new = rows.select("id", F.lit(session).alias("session_id"), F.lit("long_term").alias("type"), F.col("payload").alias("content"), F.lit(0.5).alias("importance"), F.lit(0).cast("long").alias("access_count"),
                              F.lit([]).cast("array<string>").alias("associations"), F.col("vector").cast("array<float>").alias("embedding"), now.alias("created_at"), now.alias("accessed_at"))
            old = self.engine.catalog.read("agent_memories")
            if old.join(new.select("id"), "id", "left_semi").isEmpty():
                self.engine.catalog.insert("agent_memories", new)
            else:
                self.engine.catalog.replace("agent_memories", vector.upsert(old, new))

    def search_memories(self, name: str, query, k: int = 10) -> DataFrame:
        """The memories nearest to a vector by an index over their ids, best first."""
        self.engine.vectors._meta(name)
        index = self.engine.catalog.read(self.engine.vectors._table(name))
        return rag.semantic_search(self.engine.catalog.read("agent_memories").select("id", "session_id", "type", "content"), index, query, k).orderBy("distance", "id")


__all__ = ["Engine", "literal", "parse_vector", "tokenize", "uuid7"]
