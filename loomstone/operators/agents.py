"""Sessions, memories, rooms, tasks, audit, permissions and query statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions.text import normalize_sql

#: The session states that may follow each state.
TRANSITIONS = {"active": ("paused", "completed", "failed"), "paused": ("active", "failed"), "completed": (), "failed": ("active",)}
LIVE = ("active", "paused")


def can_move(old: Column, new: Column) -> Column:
    out = F.lit(False)
    for state, then in TRANSITIONS.items():
        out = out | ((old == state) & new.isin(*then)) if then else out
    return F.coalesce(out, F.lit(False))


def invalid_transitions(log: DataFrame, id_col: str, order_col: str, state_col: str) -> DataFrame:
    """Changes of state that are not allowed: id, order, from_state, to_state."""
    before = F.lag(state_col).over(Window.partitionBy(id_col).orderBy(order_col))
    moved = log.select(id_col, order_col, before.alias("from_state"), F.col(state_col).alias("to_state"))
    return moved.where(F.col("from_state").isNotNull() & (F.col("from_state") != F.col("to_state")) & ~can_move(F.col("from_state"), F.col("to_state")))


def quota(sessions: DataFrame, most: int = 100) -> DataFrame:
    """agent_id, live sessions, and whether another may begin."""
    return sessions.groupBy("agent_id").agg(F.count_if(F.col("state").isin(*LIVE)).alias("live")).withColumn("may_create", F.col("live") < most)


def expired(sessions: DataFrame, as_of, idle: str = "24 hours", seen_col: str = "updated_at") -> DataFrame:
    """Live sessions that were idle for longer before as_of."""
    limit = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {idle}")
    return sessions.where(F.col("state").isin(*LIVE) & (F.col(seen_col) < limit))


def _newest() -> Window:
    return Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("id"))


def recent_window(memories: DataFrame, keep: int = 50, kind: str = "short_term") -> DataFrame:
    """The newest short-term memories of each session, numbered from the newest."""
    return memories.where(F.col("type") == kind).withColumn("rank", F.row_number().over(_newest()).cast("long")).where(F.col("rank") <= keep)


def evicted(memories: DataFrame, keep: int = 50, kind: str = "short_term") -> DataFrame:
    """The short-term memories beyond the newest of each session."""
    return memories.where(F.col("type") == kind).withColumn("rank", F.row_number().over(_newest()).cast("long")).where(F.col("rank") > keep)


def by_importance(memories: DataFrame, limit: int, kind: str | None = None) -> DataFrame:
    rows = memories.where(F.col("type") == kind) if kind else memories
    return rows.orderBy(F.desc("importance"), "id").limit(limit)


def recall_recent(memories: DataFrame, since, limit: int) -> DataFrame:
    return memories.where(F.col("created_at") >= since).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def memory_stats(memories: DataFrame) -> DataFrame:
    """For each session: totals by type, mean importance, total accesses."""
    n = lambda kind: F.count_if(F.col("type") == kind).alias(kind)
    return memories.groupBy("session_id").agg(F.count("*").alias("total"), n("short_term"), n("long_term"), n("working"), F.round(F.avg("importance"), 6).alias("avg_importance"), F.sum("access_count").alias("accesses"))


def decayed(importance: Column, hours: Column, accesses: Column, rate: float, floor: float = 0.01) -> Column:
    """Importance after some idle hours: less than one hour leaves it, a memory that was never read keeps it."""
    return F.when(hours < 1, importance).otherwise(F.greatest(F.lit(floor), importance * F.exp(-F.lit(rate) * hours * F.log(accesses + 1.0))))


def touch(memories: DataFrame, ids: list, now) -> DataFrame:
    """The memories with one more access of some ids."""
    hit = F.col("id").isin(ids)
    return memories.withColumn("access_count", F.when(hit, F.col("access_count") + 1).otherwise(F.col("access_count"))).withColumn("accessed_at", F.when(hit, F.lit(now)).otherwise(F.col("accessed_at")))


def room_messages(messages: DataFrame, members: DataFrame, limit: int | None = None) -> DataFrame:
    """Messages of members of their room, in order of their ids."""
    rows = messages.join(members, ["room_id", "agent_id"], "left_semi").orderBy("id")
    return rows.limit(limit) if limit else rows


def share_memory(memory: DataFrame, members: DataFrame) -> DataFrame:
    """A working memory for each member of the room: session_id is the member's agent id."""
    return memory.join(members, "room_id").select(F.col("agent_id").alias("session_id"), F.lit("working").alias("type"), "content", "importance", F.col("id").alias("source_id"))


def next_tasks(tasks: DataFrame, limit: int) -> DataFrame:
    """Pending tasks in the order in which they are handed out."""
    return tasks.where("status = 'pending'").orderBy("priority", "created_at", "id").limit(limit)


def ready_tasks(tasks: DataFrame) -> DataFrame:
    """Pending tasks with no dependency that exists and is not completed."""
    needs = tasks.where("status = 'pending'").select("id", F.explode("depends_on").alias("need"))
    open_ = tasks.where("status IS NULL OR status <> 'completed'").select(F.col("id").alias("need"))
    blocked = needs.join(open_, "need", "left_semi").select("id")
    return tasks.where("status = 'pending'").join(blocked, "id", "left_anti")


def tasks_by_agent(tasks: DataFrame, agent: str, status: str, limit: int) -> DataFrame:
    return tasks.where((F.col("agent_id") == agent) & (F.col("status") == status)).orderBy("id").limit(limit)


def audit_of(audit: DataFrame, agent_id=None, operation: str | None = None) -> DataFrame:
    """The events of an agent, of an operation, or of both."""
    for column, value in (("agent_id", agent_id), ("operation", operation)):
        audit = audit if value is None else audit.where(F.col(column) == value)
    return audit


def audit_summary(audit: DataFrame) -> DataFrame:
    """For each operation: n, how many went well, and the mean duration."""
    return audit.groupBy("operation").agg(F.count("*").alias("n"), F.count_if("success").alias("ok"), F.round(F.avg("duration_ms"), 6).alias("mean_ms"))


def audit_recent(audit: DataFrame, since, limit: int) -> DataFrame:
    return audit.where(F.col("at") >= F.lit(since).cast("timestamp_ntz")).orderBy(F.desc("at"), F.desc("id")).limit(limit)


def rbac_check(requests: DataFrame, assignments: DataFrame, permissions: DataFrame) -> DataFrame:
    """requests (id, agent_id, resource, action, scope) with allowed.

    assignments: agent_id, role; permissions: role, resource, action, scope. A resource or action of * fits all, admin all actions; a scope that is null, empty or * fits
    all, one that ends in * its prefix. Agents meet permissions by role, so requests are joined on keys, and each is grouped by its own columns."""
    p = permissions.select("role", F.col("resource").alias("p_resource"), F.col("action").alias("p_action"), F.coalesce("scope", F.lit("")).alias("p_scope"))
    granted = assignments.join(p, "role").select("agent_id", "p_resource", "p_action", "p_scope").distinct()
    fits = (
        F.col("p_resource").isin("*") | (F.col("p_resource") == F.col("resource"))
    ) & (F.col("p_action").isin("*", "admin") | (F.col("p_action") == F.col("action"))) & (
        F.col("p_scope").isin("", "*") | (F.col("p_scope") == F.col("scope")) | (F.col("p_scope").endswith("*") & F.col("scope").startswith(F.expr("left(p_scope, length(p_scope) - 1)")))
    )
    allowed = requests.join(granted, "agent_id").where(fits).select("id").distinct()
    return requests.join(allowed.withColumn("allowed", F.lit(True)), "id", "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def slow_queries(log: DataFrame, limit_ms: float = 100.0) -> DataFrame:
    return log.where(F.col("duration_ms") > limit_ms)


def query_patterns(log: DataFrame) -> DataFrame:
    """pattern, n, total and longest duration."""
    return log.groupBy(normalize_sql(F.col("sql")).alias("pattern")).agg(F.count("*").alias("n"), F.round(F.sum("duration_ms"), 2).alias("total_ms"), F.round(F.max("duration_ms"), 2).alias("max_ms"))


def query_summary(log: DataFrame, limit_ms: float = 100.0) -> DataFrame:
    return log.agg(F.count("*").alias("n"), F.count_if(F.col("duration_ms") > limit_ms).alias("slow"), F.round(F.avg("duration_ms"), 4).alias("avg_ms"), F.round(F.max("duration_ms"), 2).alias("max_ms"))
