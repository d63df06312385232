"""Statements, constraints, indexes and the facade on small tables."""

import pytest

from loomstone.engine import Engine, uuid7
from loomstone.plans.catalog import CatalogError, ConstraintError


@pytest.fixture()
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/db")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_select_and_aggregates(engine):
    engine.sql("CREATE TABLE harvest (plot VARCHAR(12) PRIMARY KEY, farm STRING, crop TEXT, tonnes FLOAT)")
    engine.sql("INSERT INTO harvest VALUES ('p10','north','barley',12.5),('p2','north','oats',4.0),('p30','south','rye',7.25),('p4','north','barley',0.25),('p51','east','oats',9.0)")
    assert rows(engine.sql("SELECT COUNT(*) AS n, SUM(tonnes) AS s, MIN(tonnes) AS lo, MAX(tonnes) AS hi FROM harvest")) == [(5, 33.0, 0.25, 12.5)]
    assert {r[0] for r in rows(engine.sql("SELECT plot FROM harvest WHERE tonnes > 7"))} == {"p10", "p30", "p51"}
    assert rows(engine.sql("SELECT farm, COUNT(*) AS plots FROM harvest GROUP BY farm HAVING plots > 1")) == [("north", 3)]
    # Keys are ordered by their bytes: p10, p2, p30, p4, p51.
    assert rows(engine.sql("SELECT farm, FIRST(crop) AS a, LAST(crop) AS b FROM harvest GROUP BY farm ORDER BY farm")) == [("east", "oats", "oats"), ("north", "barley", "barley"), ("south", "rye", "rye")]
    assert rows(engine.sql("SELECT FIRST(tonnes) AS a, LAST(tonnes) AS b FROM harvest")) == [(12.5, 9.0)]
    assert rows(engine.sql('SELECT plot FROM harvest WHERE crop LIKE "%a%" AND farm IN ("north", "east") ORDER BY plot DESC LIMIT 2 OFFSET 1;')) == [("p4",), ("p2",)]


def test_arithmetic(engine):
    """Results are floats, remainders those of whole parts, and a zero divisor gives null."""
    got = engine.sql("SELECT 1 + 2 AS a, 7.9 % 4 AS b, 7 % 0 AS c, 5 / 2 AS d, 9 * 7 % 5 AS e, 2 * (3 - 5) AS f, -7 % -4 AS g, 6 - -1 AS h, LENGTH('schön') AS n, 3 / 0 AS z").first()
    assert tuple(got) == (3.0, 3.0, None, 2.5, 3.0, -4.0, -3.0, 7.0, 6, None)
    assert all(isinstance(got[c], float) for c in "abdefgh")


def test_texts_as_they_are(engine):
    engine.sql("CREATE TABLE paths (id INT PRIMARY KEY, p STRING)")
    engine.sql(r"""INSERT INTO paths VALUES (1, 'C:\new\table'), (2, 'it''s'), (3, "say ""hi"" to o'neil")""")
    assert rows(engine.sql("SELECT p FROM paths ORDER BY id")) == [("C:\\new\\table",), ("it's",), ("say \"hi\" to o'neil",)]
    assert rows(engine.sql(r"SELECT id FROM paths WHERE p = 'C:\new\table'")) == [(1,)]


def test_first_of_joined_tables(engine):
    """The first table's key orders them, by its alias where it has one."""
    engine.sql("CREATE TABLE port (id STRING PRIMARY KEY, sea STRING)")
    engine.sql("CREATE TABLE ship (id STRING PRIMARY KEY, port STRING, flag STRING)")
    engine.sql("INSERT INTO port VALUES ('k', 'baltic'), ('c', 'baltic'), ('r', 'north')")
    engine.sql("INSERT INTO ship VALUES ('1', 'k', 'se'), ('2', 'c', 'dk'), ('3', 'r', 'nl')")
    want = [("baltic", "dk", "se"), ("north", "nl", "nl")]
    for source, p, s_ in (("port JOIN ship ON ship.port = port.id", "port", "ship"), ("port AS a JOIN ship b ON b.port = a.id", "a", "b")):
        assert rows(engine.sql(f"SELECT {p}.sea, FIRST({s_}.flag) AS x, LAST({s_}.flag) AS y FROM {source} GROUP BY {p}.sea ORDER BY {p}.sea")) == want


def test_trailing_tokens(engine):
    engine.sql("CREATE TABLE keepme (id INT PRIMARY KEY)")
    engine.sql("CREATE INDEX byid ON keepme (id)")
    for bad in ("DROP TABLE keepme now", "SHOW TABLES please", "SHOW INDEXES FROM keepme twice", "DROP INDEX byid too", "ALTER TABLE keepme DROP COLUMN id id", "CREATE INDEX more ON keepme (id) USING HASH fast", "DELETE FROM keepme everything"):
        with pytest.raises(ValueError):
            engine.sql(bad)
    assert engine.catalog.table("keepme") and len(rows(engine.sql("SHOW INDEXES FROM keepme"))) == 1


def test_constraints(engine):
    engine.sql("CREATE TABLE users (id VARCHAR(4) PRIMARY KEY, name VARCHAR(8) NOT NULL, active BOOL DEFAULT TRUE, age INT)")
    engine.sql("INSERT INTO users (id, name) VALUES ('u1', 'alice')")
    assert rows(engine.sql("SELECT active FROM users")) == [(True,)]
    for bad in (
        "INSERT INTO users (id) VALUES ('u2')",
        "INSERT INTO users (id, name) VALUES ('u1', 'bob')",
        "INSERT INTO users (id, name) VALUES ('u2', 'a name too long')",
        "INSERT INTO users (id, name, age) VALUES ('u2', 'bob', 'x')",
        "UPDATE users SET name = NULL WHERE id = 'u1'",
    ):
        with pytest.raises(ConstraintError):
            engine.sql(bad)
    for bad in ("INSERT INTO users (id, nick) VALUES ('u2', 'x')", "INSERT INTO users (id, name) VALUES ('u2')", "SELECT_ FROM", "CREATE TABLE users (id INT)", "DROP TABLE agent_sessions", "INSERT INTO nowhere VALUES (1)"):
        with pytest.raises(Exception):  # noqa: B017
            engine.sql(bad).collect()
    assert engine.sql("UPDATE users SET age = 30, id = 'u9' WHERE name = 'alice'").first()[0] == 1
    assert rows(engine.sql("SELECT id, age FROM users")) == [("u9", 30)]
    assert engine.sql("DELETE FROM users WHERE age > 40").first()[0] == 0
    assert engine.sql("DELETE FROM users WHERE age = 30").first()[0] == 1


def test_alter_show_and_reopen(engine, spark):
    engine.sql("CREATE TABLE t (id INT PRIMARY KEY, a INT)")
    engine.sql("INSERT INTO t VALUES (1, 2)")
    engine.sql("ALTER TABLE t ADD COLUMN b STRING DEFAULT 'x'")
    assert rows(engine.sql("SELECT * FROM t")) == [(1, 2, None)]
    engine.sql("ALTER TABLE t MODIFY a FLOAT")
    engine.sql("ALTER TABLE t DROP COLUMN b")
    again = Engine(spark, engine.catalog.root)
    assert rows(again.sql("SELECT * FROM t")) == [(1, 2.0)]
    assert ("t",) in rows(again.sql("SHOW TABLES"))
    assert rows(again.sql("DESCRIBE t"))[0] == ("id", "INT", "NO", "PRI", None)
    with pytest.raises(CatalogError):
        again.sql("ALTER TABLE t DROP COLUMN id")
    again.sql("DROP TABLE t")
    again.sql("DROP TABLE IF EXISTS t")


def test_indexes(engine):
    engine.sql("CREATE TABLE recipes (id STRING PRIMARY KEY, minutes FLOAT, steps TEXT)")
    engine.sql("INSERT INTO recipes VALUES ('soup', 45, 'Chop leeks, simmer slowly'), ('tart', 70, 'Roll pastry; bake with leeks'), ('tea', 4, 'Boil WATER'), ('rice', 18, '洗米煮饭然后静置')")
    engine.sql("CREATE INDEX by_minutes ON recipes (minutes) USING BTREE")
    engine.sql("CREATE FULLTEXT INDEX by_step ON recipes (steps)")
    key = lambda df: sorted(r["id"] for r in df.collect())
    assert key(engine.catalog.lookup("by_minutes", low=18.0, high=45.0)) == ["rice", "soup"]
    assert key(engine.catalog.lookup("by_minutes", equal=4.0)) == ["tea"]
    for asked, want in (("leeks", ["soup", "tart"]), ("LEEKS bake", ["tart"]), ("煮饭", ["rice"]), ("??", []), ("water leeks", [])):
        assert key(engine.catalog.lookup("by_step", match=asked)) == want
        assert key(engine.sql(f"SELECT id FROM recipes WHERE MATCH(steps) AGAINST('{asked}')")) == want
    engine.sql("INSERT INTO recipes VALUES ('stew', 45, 'bake, then simmer leeks')")
    assert key(engine.catalog.lookup("by_step", match="bake leeks")) == ["stew", "tart"]
    with pytest.raises(ConstraintError):
        engine.sql("CREATE UNIQUE INDEX once ON recipes (minutes)")
    assert [r[0] for r in engine.sql("SHOW INDEXES FROM recipes").collect()] == ["by_minutes", "by_step"]
    engine.sql("DROP INDEX by_step")


def test_queries_read_indexes(engine):
    """Equality, ranges and MATCH scan the index's folder; conditions that not all rows must fulfil do not; rows are the same either way."""
    engine.sql("CREATE TABLE lamps (id STRING PRIMARY KEY, watts INT, note TEXT)")
    engine.sql("INSERT INTO lamps VALUES ('a', 5, 'warm white'), ('b', 9, 'cold white'), ('c', NULL, 'red')")
    engine.sql("INSERT INTO lamps VALUES ('d', 9, 'warm red'), ('e', 12, NULL)")
    asked = {
        "SELECT id FROM lamps WHERE watts = 9": "w_tree",
        "SELECT id FROM lamps l WHERE l.watts > 5 AND id <> 'e'": "w_tree",
        "SELECT id FROM lamps AS l WHERE l.watts BETWEEN 5 AND 9 AND note LIKE '%white' ORDER BY id": "w_tree",
        "SELECT id FROM lamps WHERE MATCH(note) AGAINST('WARM') LIMIT 9": "n_words",
        "SELECT id FROM lamps WHERE MATCH(note) AGAINST('red') AND watts >= 9": "n_words",
        "SELECT id FROM lamps WHERE watts = 9 OR id = 'a'": None,
        "SELECT id FROM lamps WHERE NOT watts = 9": None,
        "SELECT id FROM lamps WHERE watts NOT BETWEEN 6 AND 9": None,
        "SELECT id FROM lamps WHERE watts = '9'": None,
        "SELECT COUNT(*) FILTER (WHERE watts = 9) AS id FROM lamps": None,
        "SELECT a.id FROM lamps a JOIN lamps b ON a.watts = b.watts WHERE a.watts = 5": None,
    }
    before = {q: sorted(rows(engine.sql(q))) for q in asked}
    engine.sql("CREATE INDEX w_tree ON lamps (watts)")
    engine.sql("CREATE FULLTEXT INDEX n_words ON lamps (note)")
    for q, index in asked.items():
        got = engine.sql(q)
        assert sorted(rows(got)) == before[q], q
        assert {x for x in ("w_tree", "n_words") if any(f"/index/{x}/" in f for f in got.inputFiles())} == ({index} if index else set()), q
    engine.sql("INSERT INTO lamps VALUES ('f', 9, 'warm')")
    assert sorted(rows(engine.sql("SELECT id FROM lamps WHERE watts = 9"))) == [("b",), ("d",), ("f",)]
    engine.sql("UPDATE lamps SET watts = 10 WHERE id = 'f'")
    engine.sql("DELETE FROM lamps WHERE id = 'b'")
    assert rows(engine.sql("SELECT id FROM lamps WHERE watts = 9")) == [("d",)]


def test_inserts_write_new_rows_only(engine, spark, monkeypatch):
    """Folders of older rows stay; beyond PARTS all but the first are merged; unique indexes hold over folders."""
    from loomstone.plans import catalog

    monkeypatch.setattr(catalog, "PARTS", 3)
    engine.sql("CREATE TABLE log (id INT PRIMARY KEY, word STRING)")
    engine.sql("CREATE UNIQUE INDEX once ON log (word)")
    files = [set()]
    for k in range(6):
        assert engine.sql(f"INSERT INTO log VALUES ({k}, 'w{k}')").first()[0] == 1
        files.append(set(engine.catalog.read("log").inputFiles()))
        if k in (1, 2):
            assert files[-2] < files[-1]
    assert len(engine.catalog.table("log").parts) <= 3 and len(engine.catalog.state.indexes["once"].parts) <= 3
    for bad in ("INSERT INTO log VALUES (9, 'W0')", "INSERT INTO log VALUES (3, 'new')"):
        with pytest.raises(ConstraintError):
            engine.sql(bad)
    again = Engine(spark, engine.catalog.root)
    assert sorted(rows(again.sql("SELECT * FROM log"))) == [(k, f"w{k}") for k in range(6)]
    assert [r["id"] for r in again.catalog.lookup("once", equal="w4").collect()] == [4]


def test_tasks(engine):
    t = engine.tasks
    assert t.dequeue() is None
    late, first, other = t.enqueue("baker", "knead", 5), t.enqueue("baker", "sift", 1, {"kg": 2}), t.enqueue("cook", "boil", 1)
    waits = t.enqueue("baker", "bake", 0, depends_on=[late])
    t.cancel(other)
    assert t.dequeue(ready_only=True)["id"] == first and t.dequeue()["id"] == waits
    got = t.dequeue()
    assert (got["id"], got["status"]) == (late, "running") and t.dequeue() is None and t.pending() == 0
    t.complete(first, {"ok": True})
    t.fail(late, "no flour")
    done, failed = t.task(first), t.task(late)
    assert (done["status"], done["result"]) == ("completed", '{"ok": true}') and done["duration_ms"] >= 0 and done["ended_at"] >= done["started_at"]
    assert (failed["status"], failed["error"]) == ("failed", "no flour")
    assert [r["id"] for r in t.by_agent("cook", "cancelled").collect()] == [other]
    with pytest.raises(ValueError):
        t.complete("nothing")


def test_rooms(engine):
    r = engine.rooms
    room = r.create("harbour", "ada")
    r.join(room, "bo")
    for bad in (lambda: r.join(room, "bo"), lambda: r.send(room, "cy", "hi"), lambda: r.leave(room, "cy"), lambda: r.join("nowhere", "bo"), lambda: r.share_memory(room, "cy", "x")):
        with pytest.raises(ValueError):
            bad()
    r.send(room, "bo", "tide at six")
    assert r.share_memory(room, "ada", "the quay is shut", 0.75) == 2
    r.leave(room, "bo")
    assert [(m["agent_id"], m["type"]) for m in r.messages(room).collect()] == [("bo", "text"), ("ada", "shared_memory")]
    assert [(m["agent_id"], m["role"]) for m in r.members(room).collect()] == [("ada", "owner")]
    for agent in ("ada", "bo"):
        assert [(m["type"], m["content"], m["importance"]) for m in engine.agents.memories(agent).collect()] == [("working", "the quay is shut", 0.75)]
    assert r.list().count() == 1 and r.room(room)["updated_at"] >= r.room(room)["created_at"]


def test_roles(engine):
    p = engine.roles
    assert [r["name"] for r in p.list().collect()] == ["admin", "observer", "reader", "writer"]
    p.assign("kim", "writer")
    p.assign("kim", "writer")
    p.assign("lou", "observer")
    p.assign("max", "admin")
    assert p.of("kim") == ["writer"]
    asked = [("kim", "task", "write", True), ("kim", "query", "read", True), ("kim", "query", "write", False), ("kim", "audit", "read", False), ("lou", "audit", "read", True), ("max", "permission", "admin", True), ("noone", "task", "read", False)]
    for agent, resource, action, want in asked:
        assert p.check(agent, resource, action) is want, (agent, resource, action)
    p.create("gate", [("room", "admin", "east-*")])
    p.assign("lou", "gate")
    assert p.check("lou", "room", "write", "east-4") and not p.check("lou", "room", "write", "west-4")
    p.revoke("lou", "gate")
    p.delete("gate")
    for bad, kind in ((lambda: p.require("lou", "room", "write", "east-4"), PermissionError), (lambda: p.assign("lou", "gate"), ValueError), (lambda: p.delete("gate"), ValueError)):
        with pytest.raises(kind):
            bad()


def test_audit_and_statistics(engine):
    a = engine.audit
    first = a.record("kim", "write", "memory", duration_ms=4, detail={"n": 1})
    a.record("kim", "read", success=False, duration_ms=8)
    last = a.record("lou", "read", duration_ms=2)
    assert a.event(first)["detail"] == '{"n": 1}' and [r["operation"] for r in a.by_agent("kim").collect()] == ["write", "read"]
    assert [r["id"] for r in a.recent("2020-01-01 00:00:00", 1).collect()] == [last] and a.by_operation("read").count() == 2
    assert sorted(rows(a.summary())) == [("read", 2, 1, 5.0), ("write", 1, 1, 4.0)]
    for n in (1, 2, 3):
        engine.sql(f"SELECT {n} AS x")
    assert engine.top_patterns(1).first()["n"] == 3 and engine.query_summary(0.0).first()["n"] == 3 and engine.slow_queries(1e9).isEmpty()


def test_ingested_documents_become_memories(engine, spark):
    from pyspark.sql import functions as F

    engine.vectors.create("notes", 2)
    docs = spark.createDataFrame([("d1", "Rain fell on the hills. It rained on."), ("d2", "Dust.")], "doc string, body string")
    embed = lambda c: F.array(F.char_length(c).cast("float"), F.lit(1.0).cast("float"))
    for _ in range(2):  # those of known ids are replaced
        engine.agents.ingest("notes", docs, "doc", "body", embed, 25, session="s1")
    kept = engine.agents.memories("s1").collect()
    assert [(m["id"], m["type"], m["importance"]) for m in kept] == [("d1#0", "long_term", 0.5), ("d1#1", "long_term", 0.5), ("d2#0", "long_term", 0.5)]
    assert engine.agents.search_memories("notes", [5.0, 1.0], 1).first()["content"] == "Dust."
    assert engine.sql("SELECT id FROM agent_record_decision('s1', 'choose')").count() == 1 and engine.agents.decisions("s1").count() == 1


def test_vectors(engine, spark):
    v = engine.vectors
    v.create("winds", 3)
    v.insert("winds", [("gale", [3.0, 4.0, 0.0], '{"kind":"storm"}'), ("calm", [0.0, 0.0, 2.0]), ("breeze", [1.0, 1.0, 1.0]), ("calm", [0.0, 0.0, 5.0])])
    assert v.info("winds")["size"] == 3
    assert [r["id"] for r in v.search("winds", [0.6, 0.8, 0.0], 2).collect()] == ["gale", "breeze"]
    v.insert("winds", spark.createDataFrame([("breeze", [6.0, 8.0, 0.5], None), ("breeze", [6.0, 8.0, 0.5], None)], "id string, vector array<float>, payload string"))
    assert [r["id"] for r in engine.sql("SELECT id FROM vector_search('winds', '[3, 4, 0]', 2) ORDER BY distance").collect()] == ["gale", "breeze"]
    with pytest.raises(ValueError):
        v.insert("winds", [("flat", [1.0, 2.0])])
    with pytest.raises(ValueError):
        v.search("tides", [1.0], 1)
    v.delete("winds", ["gale"])
    assert v.info("winds")["size"] == 2 and v.list() == ["winds"]
    got = engine.sql("SELECT from_json('[3,4]', 'array<double>') <-> '[-4, 3]' AS far, from_json('[3,4]', 'array<double>') <-> '[6, 8]' AS near").first()
    assert abs(got["far"] - 1) < 1e-12 and abs(got["near"]) < 1e-12


def test_graph_facade(engine):
    g = engine.graph
    g.add_nodes([("oslo", "city", "Oslo"), ("rome", "city", "Rom"), ("rome", "city", "Rome"), ("kyiv", "city", "Kyiv")])
    g.add_edges([("e1", "rail", "oslo", "rome"), ("e2", "rail", "rome", "kyiv"), ("e2", "road", "rome", "kyiv")])
    assert g.node("rome")["name"] == "Rome" and g.edge("e2")["type"] == "road"
    assert sorted((r["id"], r["depth"]) for r in g.within("oslo", 2).collect()) == [("kyiv", 2), ("rome", 1)]
    g.delete_edge("e2")
    with pytest.raises(ValueError):
        g.shortest_path("oslo", "kyiv")
    with pytest.raises(ValueError):
        g.edge("e2")


def test_agents_and_lineage(engine):
    a = engine.agents
    s = a.create_session("pilot", {"lang": "nb", "zone": "CET"})
    a.update_session(s, {"lang": "sv"}, {"tier": "gold"})
    assert (a.session(s)["context"], a.session(s)["metadata"]) == ({"lang": "sv", "zone": "CET"}, {"tier": "gold"})
    a.move_session(s, "completed")
    with pytest.raises(ValueError):
        a.move_session(s, "paused")
    kept = [a.store_memory(s, f"note {i}", kind, weight) for i, (kind, weight) in enumerate((("working", 0.2), ("long_term", 0.6), ("working", 0.9)))]
    stats = a.memory_stats().first()
    assert (stats["total"], stats["short_term"], stats["long_term"], stats["working"]) == (3, 0, 1, 2)
    assert [r["importance"] for r in engine.sql(f"SELECT importance FROM agent_recall('{s}', 2)").collect()] == [0.9, 0.6]
    assert [a.memory(kept[1])["access_count"] for _ in range(2)] == [1, 2]
    a.delete_memory(kept[0])
    assert [r["id"] for r in a.memories(s).collect()] == kept[1:]
    top = a.record_decision(s, "choose", duration_ms=7)
    step = a.record_decision(s, "try", top, 11)
    a.record_decision(s, "retry", step, 13)
    assert a.decision_tree(top).count() == 3 and a.decision(step)["duration_ms"] == 11 and a.decisions(s).count() == 3
    a.delete_decision(step)
    assert a.decision_tree(top).count() == 1
    a.delete_session(s)
    for gone in (lambda: a.session(s), lambda: a.delete_session(s), lambda: a.decision(step), lambda: a.memory(kept[0])):
        with pytest.raises(ValueError):
            gone()
    for d, src in (("scan", []), ("sensor", []), ("map", ["scan", "sensor"]), ("atlas", ["map", "missing"])):
        engine.lineage.record(d, "file", src, ["pick-7"] if d == "sensor" else [])
    assert sorted(r["data_id"] for r in engine.lineage.upstream("atlas").collect()) == ["atlas", "map", "scan", "sensor"]
    assert [r["data_id"] for r in engine.lineage.by_decision("pick-7").collect()] == ["sensor"]


def test_idle_sessions(engine, monkeypatch):
    import datetime

    a = engine.agents
    old = a.create_session("night")
    now = a._now()
    monkeypatch.setattr(a, "_now", lambda: now + datetime.timedelta(hours=30))
    new = a.create_session("night")
    assert a.expire("24 hours") == 1 and a.expire("24 hours") == 0
    assert (a.session(old)["state"], a.session(new)["state"]) == ("failed", "active")


def test_uuid7_rises():
    ids = [uuid7() for _ in range(1000)]
    assert ids == sorted(ids) and len(set(ids)) == 1000 and all(x[14] == "7" for x in ids)
