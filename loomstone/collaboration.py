"""Tasks, rooms, audit and roles of agents: tables of the catalog, made when they are first used."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.operators import agents
from loomstone.plans.catalog import Column

TABLES = {
    "agent_tasks": "id string, agent_id string, type string, priority bigint, status string, payload string, depends_on array<string>, result string, error string, duration_ms bigint, created_at timestamp, started_at timestamp, ended_at timestamp",
    "agent_rooms": "id string, name string, creator_id string, state string, created_at timestamp, updated_at timestamp",
    "agent_room_members": "room_id string, agent_id string, role string, joined_at timestamp",
    "agent_room_messages": "id string, room_id string, agent_id string, type string, content string, created_at timestamp",
    "agent_audit": "id string, at timestamp, agent_id string, operation string, resource string, success boolean, duration_ms bigint, detail string",
    "agent_roles": "name string, description string",
    "agent_role_permissions": "role string, resource string, action string, scope string",
    "agent_role_assignments": "agent_id string, role string",
}
#: Tables whose rows are told apart by all their columns, not by the first.
LISTS = ("agent_room_members", "agent_role_permissions", "agent_role_assignments")
#: The built-in roles, what they are for, and the resources on which each may do an action.
ROLES = {"admin": "everything", "writer": "reads and writes the work of agents", "reader": "reads the work of agents", "observer": "reads the audit"}
WORK = ("session", "memory", "decision", "room", "task")


def built_in_permissions() -> list[tuple[str, str, str, str]]:
    read = [(x, "read") for x in (*WORK, "query")]
    each = {"admin": [("*", "*")], "writer": [*read, *((x, "write") for x in WORK)], "reader": read, "observer": [("audit", "read")]}
    return [(role, resource, action, "") for role, grants in each.items() for resource, action in grants]


class _Tables:
    def __init__(self, engine):
        self.engine = engine

    def _read(self, name: str) -> DataFrame:
        fields = T._parse_datatype_string(TABLES[name]).fields
        self.engine.catalog.create_table(name, [Column(f.name, f.dataType.simpleString(), primary_key=not i and name not in LISTS) for i, f in enumerate(fields)], True)
        return self.engine.catalog.read(name)

    def _add(self, table: str, /, **row):
        self._read(table)
        return self.engine._append(table, row)

    def _row(self, name: str, key: str) -> dict:
        self._read(name)
        return self.engine._get(name, key)

    def _change(self, table: str, where, /, **values) -> int:
        self._read(table)
        return self.engine.catalog.update(table, {c: F.lit(v) for c, v in values.items()}, where)

    def _now(self) -> datetime.datetime:
        return datetime.datetime.now(datetime.UTC).replace(tzinfo=None)


class Tasks(_Tables):
    """A queue: the least priority first, then the oldest. Statuses: pending, running, completed, failed, cancelled."""

    def enqueue(self, agent_id: str, kind: str, priority: int = 0, payload=None, depends_on: list[str] | None = None) -> str:
        return self._add("agent_tasks", id=self.engine.new_id(), agent_id=agent_id, type=kind, priority=priority, status="pending", payload=json.dumps(payload), depends_on=depends_on or [], created_at=self._now())

    def dequeue(self, ready_only: bool = False) -> dict | None:
        """The next pending task, now running, or None. ready_only: tasks that wait for others are passed over. Cancelled tasks are never handed out."""
        rows = self._read("agent_tasks")
        got = agents.next_tasks(agents.ready_tasks(rows) if ready_only else rows, 1).select("id").collect()
        if not got:
            return None
        self._change("agent_tasks", F.col("id") == got[0][0], status="running", started_at=self._now())
        return self.task(got[0][0])

    def task(self, task: str) -> dict:
        return self._row("agent_tasks", task)

    def _end(self, task: str, status: str, **more) -> None:
        old, now = self.task(task), self._now()
        if status == "completed" and old["started_at"]:
            more["duration_ms"] = (now - old["started_at"]) // datetime.timedelta(milliseconds=1)
        self._change("agent_tasks", F.col("id") == task, status=status, ended_at=now, **more)

    def complete(self, task: str, result=None) -> None:
        self._end(task, "completed", **({} if result is None else {"result": json.dumps(result)}))

    def fail(self, task: str, reason: str = "") -> None:
        self._end(task, "failed", **({"error": reason} if reason else {}))

    def cancel(self, task: str) -> None:
        self._end(task, "cancelled")

    def by_agent(self, agent_id: str, status: str = "pending", limit: int = 100) -> DataFrame:
        return agents.tasks_by_agent(self._read("agent_tasks"), agent_id, status, limit)

    def pending(self) -> int:
        return self._read("agent_tasks").where("status = 'pending'").count()


class Rooms(_Tables):
    """Rooms with members; only members send and share."""

    def create(self, name: str, creator: str) -> str:
        now = self._now()
        room = self._add("agent_rooms", id=self.engine.new_id(), name=name, creator_id=creator, state="active", created_at=now, updated_at=now)
        self._add("agent_room_members", room_id=room, agent_id=creator, role="owner", joined_at=now)
        return room

    def room(self, room: str) -> dict:
        return self._row("agent_rooms", room)

    def list(self) -> DataFrame:
        return self._read("agent_rooms").orderBy("id")

    def members(self, room: str) -> DataFrame:
        return self._read("agent_room_members").where(F.col("room_id") == room)

    def _is_member(self, room: str, agent_id: str) -> bool:
        self.room(room)
        return not self.members(room).where(F.col("agent_id") == agent_id).isEmpty()

    def _must(self, room: str, agent_id: str) -> None:
        if not self._is_member(room, agent_id):
            raise ValueError(f"{agent_id} is not in the room {room}")

    def _touch(self, room: str) -> None:
        self._change("agent_rooms", F.col("id") == room, updated_at=self._now())

    def join(self, room: str, agent_id: str, role: str = "member") -> None:
        if self._is_member(room, agent_id):
            raise ValueError(f"{agent_id} is in the room {room} already")
        self._add("agent_room_members", room_id=room, agent_id=agent_id, role=role, joined_at=self._now())
        self._touch(room)

    def leave(self, room: str, agent_id: str) -> None:
        self._must(room, agent_id)
        self.engine.catalog.delete("agent_room_members", (F.col("room_id") == room) & (F.col("agent_id") == agent_id))
        self._touch(room)

    def send(self, room: str, agent_id: str, content, kind: str = "text") -> str:
        self._must(room, agent_id)
        sent = self._add("agent_room_messages", id=self.engine.new_id(), room_id=room, agent_id=agent_id, type=kind, content=json.dumps(content, ensure_ascii=False), created_at=self._now())
        self._touch(room)
        return sent

    def messages(self, room: str, limit: int | None = None) -> DataFrame:
        """The room's messages in order; those of members who have left stay."""
        rows = self._read("agent_room_messages").where(F.col("room_id") == room).orderBy("id")
        return rows.limit(limit) if limit else rows

    def share_memory(self, room: str, agent_id: str, content: str, importance: float = 0.5) -> int:
        """A working memory for each member, and a message that tells of it. How many members."""
        self._must(room, agent_id)
        now, source = F.lit(self._now()), self.engine.new_id()
        memory = self.engine.spark.createDataFrame([(source, room, content, float(importance))], "id string, room_id string, content string, importance double")
        rows = agents.share_memory(memory, self.members(room)).drop("source_id")
        n = self.engine.catalog.insert("agent_memories", rows.withColumns({"access_count": F.lit(0), "associations": F.lit([]).cast("array<string>"), "created_at": now, "accessed_at": now}))
        self.send(room, agent_id, {"content": content, "members": n}, "shared_memory")
        return n


class Audit(_Tables):
    def record(self, agent_id: str, operation: str, resource: str = "", success: bool = True, duration_ms: int = 0, detail=None, at=None) -> str:
        return self._add("agent_audit", id=self.engine.new_id(), at=at or self._now(), agent_id=agent_id, operation=operation, resource=resource, success=success, duration_ms=duration_ms, detail=json.dumps(detail))

    def event(self, event: str) -> dict:
        return self._row("agent_audit", event)

    def by_agent(self, agent_id: str) -> DataFrame:
        return agents.audit_of(self._read("agent_audit"), agent_id=agent_id).orderBy("id")

    def by_operation(self, operation: str) -> DataFrame:
        return agents.audit_of(self._read("agent_audit"), operation=operation).orderBy("id")

    def summary(self) -> DataFrame:
        return agents.audit_summary(self._read("agent_audit"))

    def recent(self, since, limit: int = 100) -> DataFrame:
        return agents.audit_recent(self._read("agent_audit"), since, limit)


class Roles(_Tables):
    """Roles with their permissions, and who has them. The built-in roles are there at first; changes to them stay."""

    def _read(self, name: str) -> DataFrame:
        new = name not in self.engine.catalog.state.tables
        rows = super()._read(name)
        built_in = {"agent_roles": lambda: list(ROLES.items()), "agent_role_permissions": built_in_permissions}.get(name)
        if new and built_in:
            self.engine.catalog.insert(name, self.engine.spark.createDataFrame(built_in(), rows.schema))
            rows = super()._read(name)
        return rows

    def create(self, role: str, permissions: list[tuple], description: str = "") -> None:
        """A role with permissions (resource, action, scope); one of that name is replaced."""
        self._remove(role)
        self._add("agent_roles", name=role, description=description)
        grants = [(role, *p, "")[:4] for p in permissions]
        if grants:
            self.engine.catalog.insert("agent_role_permissions", self.engine.spark.createDataFrame(grants, self._read("agent_role_permissions").schema))

    def _remove(self, role: str) -> int:
        self._read("agent_role_permissions")
        self.engine.catalog.delete("agent_role_permissions", F.col("role") == role)
        self._read("agent_roles")
        return self.engine.catalog.delete("agent_roles", F.col("name") == role)

    def delete(self, role: str) -> None:
        if not self._remove(role):
            raise ValueError(f"unknown role {role}")

    def list(self) -> DataFrame:
        return self._read("agent_roles").orderBy("name")

    def permissions(self, role: str) -> DataFrame:
        return self._read("agent_role_permissions").where(F.col("role") == role)

    def of(self, agent_id: str) -> list[str]:
        return sorted(r[0] for r in self._read("agent_role_assignments").where(F.col("agent_id") == agent_id).select("role").distinct().collect())

    def assign(self, agent_id: str, role: str) -> None:
        """Give a role; one that the agent has already stays as it is."""
        if not agent_id or not role:
            raise ValueError("an agent and a role are needed")
        self._row("agent_roles", role)
        if role not in self.of(agent_id):
            self._add("agent_role_assignments", agent_id=agent_id, role=role)

    def revoke(self, agent_id: str, role: str) -> None:
        self._read("agent_role_assignments")
        self.engine.catalog.delete("agent_role_assignments", (F.col("agent_id") == agent_id) & (F.col("role") == role))

    def check_all(self, requests: DataFrame) -> DataFrame:
        """Requests (id, agent_id, resource, action, scope) with allowed."""
        return agents.rbac_check(requests, self._read("agent_role_assignments"), self._read("agent_role_permissions"))

    def check(self, agent_id: str, resource: str, action: str, scope: str = "") -> bool:
        asked = self.engine.spark.createDataFrame([(0, agent_id, resource, action, scope)], "id long, agent_id string, resource string, action string, scope string")
        return self.check_all(asked).first()["allowed"]

    def require(self, agent_id: str, resource: str, action: str, scope: str = "") -> None:
        if not self.check(agent_id, resource, action, scope):
            raise PermissionError(f"{agent_id} may not {action} {resource} {scope}".strip())
