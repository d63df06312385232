"""Streams give what batches give, for what has closed."""

import pandas as pd
from pyspark.sql import functions as F

from loomstone.engine import Engine
from loomstone.functions import expr
from loomstone.operators import agents
from loomstone.streaming import states, upkeep, windows

DATA = "/root/testdata/sf0.001/events.parquet"


def drain(stream, mode, name):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.sql(f"SELECT * FROM {name}")


def test_sessions_match_batch(spark, tmp_path):
    batch = spark.read.parquet(DATA)
    batch.write.parquet(f"{tmp_path}/in")
    stream = windows.event_stream(spark, f"{tmp_path}/in", batch.schema)
    got = {tuple(r) for r in drain(windows.sessionize(stream), "append", "closed_sessions").collect()}
    late = batch.agg(F.max("ts").cast("timestamp") - F.expr("INTERVAL 1 HOUR")).first()[0]
    # Filtered here: a filter on the end of a session would be pushed below the merging of its events.
    whole = windows.sessionize(batch.withColumn("ts", F.col("ts").cast("timestamp"))).collect()
    assert got == {tuple(r) for r in whole if r["session_end"] <= late}


def test_tumbling_and_duplicates(spark, tmp_path):
    batch = spark.read.parquet(DATA)
    batch.write.parquet(f"{tmp_path}/in")
    stream = windows.distinct_events(windows.event_stream(spark, f"{tmp_path}/in", batch.schema))
    assert drain(stream, "append", "once").count() == batch.count()


def test_state_machine(spark, tmp_path):
    pd.DataFrame({"id": ["a", "a", "a", "b"], "seq": [1, 2, 3, 1], "state": ["paused", "completed", "active", "failed"]}).to_parquet(f"{tmp_path}/x.parquet")
    stream = spark.readStream.schema("id string, seq long, state string").parquet(str(tmp_path))
    got = {r["id"]: (r["n"], r["state"], r["rejected"]) for r in drain(states.session_states(stream), "update", "machine").collect()}
    assert got == {"a": (3, "active", 1), "b": (1, "failed", 0)}


def test_upkeep_matches_batch(spark, tmp_path):
    batch = spark.read.parquet(DATA).select(F.col("event_id").cast("string").alias("id"), (F.col("user_id") % 7).cast("string").alias("session_id"), F.when(F.col("event_id") % 2 == 0, "short_term").otherwise("working").alias("type"), "ts")
    batch.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = windows.event_stream(spark, f"{tmp_path}/in", batch.schema)
    whole = batch.withColumn("ts", F.col("ts").cast("timestamp"))
    late = whole.agg(F.max("ts") - F.expr("INTERVAL 1 HOUR")).first()[0]
    beats = lambda df: df.select(F.col("session_id").alias("id"), "ts")
    for name, make in (("idle", lambda df: upkeep.expired_sessions(beats(df), "2 hours")), ("ttl", upkeep.expired_working)):
        got = {tuple(r) for r in drain(make(stream), "append", name).collect()}
        assert got and got == {tuple(r) for r in make(whole).collect() if r["expired_at"] <= late}
    got = sorted(tuple(r) for r in drain(upkeep.evictions(stream, 5), "append", "pushed").collect())
    assert got and got == sorted((r["session_id"], r["id"]) for r in agents.evicted(batch.withColumn("created_at", F.col("ts")), 5).collect())


def test_decay_of_uses(spark, tmp_path):
    hours = [0, 3, 3.5, 10]
    pd.DataFrame({"id": ["m"] * 4 + ["k"], "ts": pd.to_datetime(pd.Series([*hours, 5]) * 3600, unit="s").astype("datetime64[us]"), "importance": [0.8, None, None, None, 0.4]}).to_parquet(f"{tmp_path}/x.parquet")
    stream = spark.readStream.schema("id string, ts timestamp_ntz, importance double").parquet(str(tmp_path))
    got = {r["id"]: (r["importance"], r["accesses"]) for r in drain(upkeep.decays(stream, 0.1), "update", "decays").collect()}
    # Each use by the expression of the batch: hours since the use before, and how often the memory was read till then.
    value = 0.8
    for n, (a, b) in enumerate(zip(hours, hours[1:], strict=False)):
        value = spark.range(1).select(agents.decayed(F.lit(value), F.lit(b - a), F.lit(n), 0.1)).first()[0]
    assert got["k"] == (0.4, 0) and got["m"][1] == 3 and abs(got["m"][0] - value) < 1e-12 and value < 0.8


def test_stream_into_table(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/db")
    engine.sql("CREATE TABLE visits (id STRING PRIMARY KEY, place TEXT NOT NULL, n INT DEFAULT 1)")
    engine.sql("INSERT INTO visits VALUES ('a', 'pier', 7)")
    pd.DataFrame({"id": ["a", "b", "c", "c"], "place": ["dock", "quay", "mole", "mole"]}).to_parquet(f"{tmp_path}/x.parquet")
    stream = engine.spark.readStream.schema("id string, place string").parquet(f"{tmp_path}/x.*")
    for k in range(2):  # the second reads all rows again
        upkeep.into_table(stream, engine.catalog, "visits").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c{k}").start().awaitTermination(120)
        assert [tuple(r) for r in engine.sql("SELECT id, place, n FROM visits ORDER BY id").collect()] == [("a", "pier", 7), ("b", "quay", 1), ("c", "mole", 1)]


def test_truth(spark):
    rows = spark.createDataFrame([("", 0, False), ("0", 2, True), (None, None, None)], "s string, n int, b boolean")
    got = [tuple(r) for r in rows.select(expr.compat_truth(F.col("s"), ""), expr.compat_truth(F.col("n"), 0), expr.compat_truth(F.col("b"), False)).collect()]
    assert got == [(False,) * 3, (True,) * 3, (False,) * 3]
