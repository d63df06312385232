"""Sessions, memories, rooms, tasks, audit, permissions, query statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.operators import agents
from loomstone.sources.tables import AUDIT_SQL, MEMORIES_SQL, SESSIONS_SQL, TASKS_SQL, audit, load, memories, sessions, tasks

from .registry import register
from .texts import query_log


@register("session_list_by_agent", f"SELECT id, turns, state FROM {SESSIONS_SQL} WHERE agent_id = 'agent-3' ORDER BY id LIMIT 50")
def session_list_by_agent(spark, d):
    return sessions(spark, d).where("agent_id = 'agent-3'").orderBy("id").limit(50).select("id", "turns", "state")


_LOG = "(SELECT user_id AS id, event_id AS seq, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'paused' ELSE 'active' END AS state FROM events)"


def state_log(spark, d):
    """Requested states of a session for each user, by event."""
    kind = F.col("event_type")
    state = F.when(kind == "error", "failed").when(kind == "purchase", "completed").when(kind == "signup", "paused").otherwise("active")
    return load(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), state.alias("state"))


@register(
    "session_invalid_transitions",
    f"""SELECT id, seq, from_state, to_state FROM (SELECT id, seq, state AS to_state, lag(state) OVER (PARTITION BY id ORDER BY seq) AS from_state FROM {_LOG})
WHERE from_state <> to_state AND from_state || '>' || to_state NOT IN ('active>paused', 'active>completed', 'active>failed', 'paused>active', 'paused>failed', 'failed>active')""",
)
def session_invalid_transitions(spark, d):
    return agents.invalid_transitions(state_log(spark, d), "id", "seq", "state")


@register("session_quota", f"SELECT agent_id, count_if(state IN ('active', 'paused'))::BIGINT AS live, count_if(state IN ('active', 'paused')) < 10 AS may_create FROM {SESSIONS_SQL} GROUP BY agent_id")
def session_quota(spark, d):
    return agents.quota(sessions(spark, d), 10)


@register("session_expired", "SELECT user_id AS id, max(ts) AS updated_at FROM events GROUP BY user_id HAVING max(ts) < TIMESTAMP '2024-01-31 12:00:00' - INTERVAL 24 HOURS")
def session_expired(spark, d):
    last = load(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("updated_at")).withColumn("state", F.lit("active"))
    return agents.expired(last, "2024-01-31 12:00:00").select("id", "updated_at")


@register("memory_list", f"SELECT id, type, importance FROM {MEMORIES_SQL} WHERE session_id = 7 AND type = 'short_term' ORDER BY id LIMIT 20")
def memory_list(spark, d):
    return memories(spark, d).where("session_id = 7 AND type = 'short_term'").orderBy("id").limit(20).select("id", "type", "importance")


_RANKED = f"SELECT id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC) AS rank FROM {MEMORIES_SQL} WHERE type = 'short_term'"


@register("memory_recent_window", f"SELECT * FROM ({_RANKED}) WHERE rank <= 2")
def memory_recent_window(spark, d):
    return agents.recent_window(memories(spark, d), 2).select("id", "session_id", "rank")


@register("memory_evicted", f"SELECT * FROM ({_RANKED}) WHERE rank > 2")
def memory_evicted(spark, d):
    return agents.evicted(memories(spark, d), 2).select("id", "session_id", "rank")


@register("memory_by_importance", f"SELECT id, importance FROM {MEMORIES_SQL} WHERE type = 'long_term' ORDER BY importance DESC, id LIMIT 20")
def memory_by_importance(spark, d):
    return agents.by_importance(memories(spark, d), 20, "long_term").select("id", "importance")


@register("memory_recall_recent", f"SELECT id, created_at FROM {MEMORIES_SQL} WHERE created_at >= 5000 ORDER BY created_at DESC, id DESC LIMIT 20")
def memory_recall_recent(spark, d):
    return agents.recall_recent(memories(spark, d), 5000, 20).select("id", "created_at")


@register(
    "memory_stats",
    f"""SELECT session_id, count(*) AS total, count_if(type = 'short_term')::BIGINT AS short_term, count_if(type = 'long_term')::BIGINT AS long_term, count_if(type = 'working')::BIGINT AS working,
round(avg(importance), 6) AS avg_importance, sum(access_count)::BIGINT AS accesses FROM {MEMORIES_SQL} GROUP BY session_id""",
)
def memory_stats(spark, d):
    return agents.memory_stats(memories(spark, d))


@register(
    "memory_decay",
    f"SELECT id, round(CASE WHEN created_at % 50 < 1 THEN importance ELSE greatest(0.01, importance * exp(-0.05 * (created_at % 50) * ln(access_count + 1.0))) END, 9) AS importance FROM {MEMORIES_SQL} WHERE type <> 'working'",
)
def memory_decay(spark, d):
    rows = memories(spark, d).where("type <> 'working'")
    return rows.select("id", F.round(agents.decayed(F.col("importance"), F.col("created_at") % 50, F.col("access_count"), 0.05), 9).alias("importance"))


@register("memory_working_ttl", f"SELECT id FROM {MEMORIES_SQL} WHERE type <> 'working' OR created_at >= 3000")
def memory_working_ttl(spark, d):
    return memories(spark, d).where("type <> 'working' OR created_at >= 3000").select("id")


@register("room_messages", "SELECT conv_id || '/' || turn AS id, conv_id % 5 AS room_id FROM conversations WHERE role IN ('user', 'assistant') AND NOT (conv_id % 5 = 2 AND role = 'user')")
def room_messages(spark, d):
    messages = load(spark, d, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("id"), (F.col("conv_id") % 5).alias("room_id"), F.col("role").alias("agent_id"))
    members = spark.createDataFrame([(r, a) for r in range(5) for a in ("user", "assistant") if (r, a) != (2, "user")], "room_id long, agent_id string")
    return agents.room_messages(messages, members).select("id", "room_id")


@register("share_memory_fanout", f"SELECT 'agent-' || a AS session_id, 'working' AS type, id AS source_id FROM {MEMORIES_SQL}, (VALUES (1), (2), (3)) v(a) WHERE session_id = 4")
def share_memory_fanout(spark, d):
    memory = memories(spark, d).where("session_id = 4").withColumn("room_id", F.lit(1))
    members = spark.createDataFrame([(1, f"agent-{i}") for i in (1, 2, 3)], "room_id int, agent_id string")
    return agents.share_memory(memory, members).select("session_id", "type", "source_id")


@register("task_next", f"SELECT id, priority FROM {TASKS_SQL} WHERE status = 'pending' ORDER BY priority, created_at, id LIMIT 15")
def task_next(spark, d):
    return agents.next_tasks(tasks(spark, d), 15).select("id", "priority")


@register("task_ready", f"WITH t AS {TASKS_SQL} SELECT id FROM t WHERE status = 'pending' AND depends_on NOT IN (SELECT id FROM t WHERE status <> 'completed')")
def task_ready(spark, d):
    return agents.ready_tasks(tasks(spark, d)).select("id")


@register("task_by_agent", f"SELECT id, status FROM {TASKS_SQL} WHERE agent_id = 'agent-4' AND status = 'pending' ORDER BY id LIMIT 20")
def task_by_agent(spark, d):
    return agents.tasks_by_agent(tasks(spark, d), "agent-4", "pending", 20).select("id", "status")


@register("audit_by_agent", f"SELECT id, operation, success FROM {AUDIT_SQL} WHERE agent_id = 'agent-5'")
def audit_by_agent(spark, d):
    return agents.audit_of(audit(spark, d), agent_id="agent-5").select("id", "operation", "success")


@register("audit_by_operation", f"SELECT operation, count(*) AS n, count_if(success)::BIGINT AS ok, round(avg(duration_ms), 6) AS mean_ms FROM {AUDIT_SQL} GROUP BY operation")
def audit_by_operation(spark, d):
    return agents.audit_summary(audit(spark, d))


@register("audit_recent", f"SELECT id, \"at\" FROM {AUDIT_SQL} WHERE \"at\" >= TIMESTAMP '2024-01-20 00:00:00' ORDER BY \"at\" DESC, id DESC LIMIT 25")
def audit_recent(spark, d):
    return agents.audit_recent(audit(spark, d), "2024-01-20 00:00:00", 25).select("id", "at")


#: agent-<n> has the role of n % 3.
_ROLES = ["admin", "reader", "owner"]
_GRANTS = [("admin", "*", "admin", "*"), ("reader", "memory", "read", "view*"), ("owner", "session", "write", "click"), ("owner", "memory", "*", "")]
_GRANTS_SQL = "(VALUES " + ", ".join(str(g) for g in _GRANTS) + ") g(role, resource, action, scope)"


@register(
    "rbac_check",
    f"""WITH req AS (SELECT event_id AS id, ['admin', 'reader', 'owner'][user_id % 3 + 1] AS role, CASE WHEN event_id % 2 = 0 THEN 'memory' ELSE 'session' END AS resource,
  CASE WHEN event_id % 3 = 0 THEN 'write' ELSE 'read' END AS action, event_type AS scope FROM events)
SELECT id, EXISTS (SELECT 1 FROM {_GRANTS_SQL} WHERE g.role = req.role AND g.resource IN ('*', req.resource) AND g.action IN ('*', 'admin', req.action)
  AND (g.scope IN ('', '*', req.scope) OR (ends_with(g.scope, '*') AND starts_with(req.scope, rtrim(g.scope, '*'))))) AS allowed FROM req""",
)
def rbac_check(spark, d):
    e = load(spark, d, "events")
    requests = e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("agent_id"), F.when(F.col("event_id") % 2 == 0, "memory").otherwise("session").alias("resource"), F.when(F.col("event_id") % 3 == 0, "write").otherwise("read").alias("action"), F.col("event_type").alias("scope")
    )
    role = F.element_at(F.array(*map(F.lit, _ROLES)), (F.col("user_id") % 3 + 1).cast("int"))
    assignments = e.select(F.col("user_id").alias("agent_id"), role.alias("role")).distinct()
    permissions = spark.createDataFrame(_GRANTS, "role string, resource string, action string, scope string")
    return agents.rbac_check(requests, assignments, permissions).select("id", "allowed")


@register("stats_slow", "SELECT event_id, value AS duration_ms FROM events WHERE value > 100")
def stats_slow(spark, d):
    return agents.slow_queries(query_log(spark, d)).select("event_id", "duration_ms")


@register("stats_top_patterns", "SELECT 'SELECT * FROM t' || (user_id % 3) || ' WHERE id = ? AND s = ? AND x < ?' AS pattern, count(*) AS n, round(sum(value), 2) AS total_ms, round(max(value), 2) AS max_ms FROM events GROUP BY 1 ORDER BY n DESC, pattern LIMIT 10")
def stats_top_patterns(spark, d):
    return agents.query_patterns(query_log(spark, d)).orderBy(F.desc("n"), "pattern").limit(10)


@register("stats_summary", "SELECT count(*) AS n, count_if(value > 100)::BIGINT AS slow, round(avg(value), 4) AS avg_ms, round(max(value), 2) AS max_ms FROM events")
def stats_summary(spark, d):
    return agents.query_summary(query_log(spark, d))
