"""Streams with state: order, timers, batch sizes, restarts, and how much they hold."""

import datetime as dt
import random
import time

import numpy as np
import pytest
from logsluice.operators import windows
from logsluice.streaming import jobs, retained, ruled, stateful
from pyspark.sql import functions as F

START = dt.datetime(2024, 1, 1)


def put(spark, rows, schema, path):
    """One file more for a stream to read."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def run(spark, stream, path):
    with stateful.state_store(spark):
        query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def test_charts_follow_event_time(spark, tmp_path):
    """Rows of many files come late by up to two hours; the chart is that of the ordered series, and little waits."""
    rng, schema = random.Random(1), "metric_name string, ts timestamp, value double"
    rows = [(m, START + dt.timedelta(minutes=10 * k), float(rng.randrange(100))) for k in range(240) for m in ("a", "b")]
    late = sorted(rows, key=lambda r: r[1] + dt.timedelta(minutes=rng.randrange(120)))
    for k in range(0, len(late), 80):
        put(spark, late[k : k + 80], schema, f"{tmp_path}/in")
    put(spark, [("a", dt.datetime(2100, 1, 1), None), (None, START, 1.0)], schema, f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = run(spark, stateful.spc(stream, size=20, late="2 hours"), str(tmp_path))
    found = sorted((r.metric_name, r.ts, r.n, round(r["mean"] or 0, 6), round(r.z, 6), r.is_anomaly) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    expected = windows.spc(spark.createDataFrame(rows, schema), 20, 3.0, 30).withColumn("late", F.lit(0)).collect()
    assert found == sorted((r.metric_name, r.ts, r.n, round(r["mean"] or 0, 6), round(r.z, 6), r.is_anomaly) for r in expected)
    assert len(query.recentProgress) > 5 and query.lastProgress.stateOperators[0].customMetrics is not None
    # before the closing row, only what lies within the watermark's delay had not been told
    assert len(found) == len(rows)


def test_decisions_leave_by_outcome_or_timer(spark, tmp_path):
    at = lambda hours: START + dt.timedelta(hours=hours)
    decisions, outcomes = "log_id long, event_ts timestamp", "log_id long, outcome_ts timestamp"
    for rows in ([(1, at(0)), (2, at(0)), (3, at(1))], [(4, at(30)), (None, at(30)), (5, at(31))], [(6, at(60)), (7, at(61))]):
        put(spark, rows, decisions, f"{tmp_path}/d")
    # 1 in time, 2 too late, 4 has its outcome in an earlier batch than its decision, 5 one before the decision and one after
    for rows in ([(1, at(24)), (4, at(32)), (5, at(30))], [(2, at(25)), (5, at(32))], [(9, at(61)), (None, at(61))]):
        put(spark, rows, outcomes, f"{tmp_path}/o")
    read = lambda schema, name: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")
    out = lambda: stateful.pending(read(decisions, "d"), read(outcomes, "o"), late="12 hours", shares=3)
    run(spark, out(), str(tmp_path))
    told = lambda: {r.log_id: (r.state, (r.ended_at - START).total_seconds() / 3600) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    before = {1: ("outcome", 24), 2: ("timeout", 24), 3: ("timeout", 25), 4: ("outcome", 32), 5: ("outcome", 32)}
    assert told() == before  # 6 and 7 wait
    put(spark, [(100, at(200))], decisions, f"{tmp_path}/d")
    put(spark, [(6, at(62)), (200, at(200))], outcomes, f"{tmp_path}/o")
    run(spark, out(), str(tmp_path))
    assert told() == before | {6: ("outcome", 62), 7: ("timeout", 85)}
    assert spark.read.parquet(f"{tmp_path}/out").count() == 7


def test_many_decisions_wait_in_few_packets(spark, tmp_path):
    """What waits is packed: state and timers are as many as slots and shares, not as logs; every outcome before its decision counts."""
    at = lambda hours: START + dt.timedelta(hours=hours)
    decisions, outcomes = "log_id long, event_ts timestamp", "log_id long, outcome_ts timestamp"
    put(spark, [(-1, at(0))], decisions, f"{tmp_path}/d")
    put(spark, [(k, at(30)) for k in range(0, 4000, 4)] + [(k, at(5)) for k in range(0, 4000, 2)], outcomes, f"{tmp_path}/o")
    read = lambda schema, name: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")
    out = lambda: stateful.pending(read(decisions, "d"), read(outcomes, "o"), late="60 days", shares=2)
    run(spark, out(), str(tmp_path))
    put(spark, [(k, at(4) + dt.timedelta(seconds=k % 3600)) for k in range(4000)], decisions, f"{tmp_path}/d")
    query = run(spark, out(), str(tmp_path))
    assert query.lastProgress.stateOperators[0].numRowsTotal <= 2 * (stateful.SLOTS + 8)
    put(spark, [(-2, at(9000))], decisions, f"{tmp_path}/d")
    put(spark, [(-3, at(9000))], outcomes, f"{tmp_path}/o")
    run(spark, out(), str(tmp_path))
    told = sorted((r.log_id, r.state, (r.ended_at - START).total_seconds()) for r in spark.read.parquet(f"{tmp_path}/out").collect() if r.log_id >= 0)
    assert told == [(k, "timeout", 28 * 3600 + k % 3600) if k % 2 else (k, "outcome", 5 * 3600) for k in range(4000)]


def test_matching_against_one_log_after_another():
    rng, window = random.Random(4), 10
    for _ in range(60):
        rows = [(rng.randrange(12), rng.randrange(40), rng.random() < 0.6) for _ in range(rng.randrange(60))]
        ended, waits = stateful._matched(np.array(rows, stateful._WAITS), window)
        told, wait = [], []
        for log_id in range(12):
            decided = min((us for k, us, outcome in rows if k == log_id and not outcome), default=None)
            came = [us for k, us, outcome in rows if k == log_id and outcome]
            fits = [us for us in came if decided is not None and decided <= us <= decided + window]
            if fits:
                told.append((log_id, decided, min(fits), False))
            else:
                wait += [(log_id, decided, False)] * (decided is not None) + [(log_id, us, True) for us in came if decided is None or us < decided]
        assert ended.tolist() == told and sorted(waits.tolist()) == sorted(wait)


ROUTED = "log_id long, category string, method string, destination string, at timestamp"


def routed(rng, n, first=0):
    kinds = [("critical", "immediate", "qradar"), ("suspicious", "queue", "qradar"), ("noise", "queue", "summary"), ("noise", "queue", "cold_storage")]
    return [(first + k, *rng.choice(kinds), START + dt.timedelta(microseconds=k)) for k in range(n)]


def test_batches_have_their_size_and_survive_a_restart(spark, tmp_path):
    rng, table = random.Random(3), {"critical": ("immediate", ["qradar"], 1), "suspicious": ("queue", ["qradar"], 7), "noise": ("queue", ["summary", "cold_storage"], 20)}
    sent = lambda: stateful.batched(spark.readStream.schema(ROUTED).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), F.pmod("log_id", F.lit(2)), 2, spark.readStream.schema("x int").parquet(f"{tmp_path}/flush"), None, table)
    (tmp_path / "flush").mkdir()
    parts = [routed(rng, 90, 1000 * k) for k in range(4)]
    for p in parts[:2]:
        put(spark, p, ROUTED, f"{tmp_path}/in")
    folder = str(tmp_path / "sinks")

    def go():
        stream = sent()
        jobs.in_batches(stream, "x", lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/batch={n}"), f"{tmp_path}/state")
        return spark.read.schema(stream.schema).parquet(folder).collect()

    def check(rows, last):
        queues = {}
        for r in rows:
            if r.method == "immediate":
                assert r.batch_rows == 1 and r.batch_number is None
            else:
                queues.setdefault((r.destination, r.category, r.lane), {}).setdefault(r.batch_number, []).append(r)
        for (_, category, _), batches in queues.items():
            assert sorted(batches) == list(range(len(batches)))
            sizes = [len(batches[k]) for k in sorted(batches)]
            assert all(len(b) == b[0].batch_rows for b in batches.values())
            assert sizes[: -1 if last else None] == [table[category][2]] * (len(sizes) - last)
        return sorted(r.log_id for r in rows)

    first = check(go(), 0)
    assert len(first) == len(set(first)) < 180
    for p in parts[2:]:
        put(spark, p, ROUTED, f"{tmp_path}/in")
    check(go(), 0)
    put(spark, [(1,)], "x int", f"{tmp_path}/flush")
    rows = go()
    assert check(rows, 1) == sorted(r[0] for p in parts for r in p)
    assert {r.log_id: r["at"] for r in rows} == {r[0]: r[4] for p in parts for r in p}


def test_a_batch_that_waits_long_enough_is_sent(spark, tmp_path):
    put(spark, [(k, "noise", "queue", "summary", START) for k in range(5)], ROUTED, f"{tmp_path}/in")
    stream = stateful.batched(spark.readStream.schema(ROUTED).parquet(f"{tmp_path}/in"), F.lit(0), 1, None, 0.5)
    with stateful.state_store(spark):
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            time.sleep(1)
            if query.lastProgress and query.lastProgress.batchId > 1 and spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").count():
                break
    finally:
        query.stop()
    found = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r.log_id for r in found) == [0, 1, 2, 3, 4] and {r.batch_rows for r in found} == {5}


@pytest.mark.parametrize("before", [None, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"])
def test_the_sessions_state_store_is_left_as_it_was(spark, before):
    key = stateful._STORE
    default = spark.conf.get(key, None)
    if before:
        spark.conf.set(key, before)
    with stateful.state_store(spark):
        assert spark.conf.get(key).endswith("RocksDBStateStoreProvider")
    assert spark.conf.get(key, None) == (before or default)
    spark.conf.unset(key)


def test_rules_added_between_batches_count_from_then_on(spark, tmp_path):
    schema, path = "log_id long, source string, message string", str(tmp_path)
    each = ruled.checked(f"{path}/rules", f"{path}/out", f"{path}/pins")
    batch = spark.createDataFrame([(1, "a-1", "x"), (2, None, None)], schema)
    each(batch, 0)  # no rules at all yet
    assert ruled.add_rules(spark, f"{path}/rules", [("one", "f", 5, ["^a-"], [])]) == 1
    each(batch, 1)
    assert ruled.add_rules(spark, f"{path}/rules", [("two", "g", 9, ["("], ["x"]), ("one", "f", 7, ["^b-"], None)]) == 2
    each(batch, 2)
    each(batch, 1)  # again, as after a failure
    each(batch, 0)
    told = {(r.batch, r.log_id): (r.rules_version, r.decision.matched_rules, r.decision.retention_days) for r in spark.read.parquet(f"{path}/out").collect()}
    assert told == {(0, 1): (0, [], 0), (0, 2): (0, [], 0), (1, 1): (1, ["one"], 5), (1, 2): (1, [], 0), (2, 1): (2, ["two"], 9), (2, 2): (2, [], 0)}
    assert ruled.rules_at(spark, f"{path}/rules", 1) == (1, [("one", "f", 5, ["^a-"], [])])
    assert [r[0] for r in ruled.rules_at(spark, f"{path}/rules")[1]] == ["one", "two"]


def test_a_replay_of_many_files_loses_no_late_row(spark):
    """Rows of all times in each of 30 files: a replay brings them in order, whatever the files and cores."""
    rows = spark.range(3000).select(F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 600).alias("event_ts"), F.lit("a").alias("source"), F.lit("noise").alias("expected_category"), F.lit("x").alias("message"))
    rows = rows.unionByName(rows.limit(1).withColumn("event_ts", F.lit(None).cast("timestamp"))).repartition(30, "event_ts")
    assert jobs.finished(jobs.eps(jobs.replayed(rows, files_a_batch=8)), "eps").agg(F.sum("n")).first()[0] == 6 * 3000
    assert jobs.finished(jobs.noise_summary(jobs.replayed(rows, files_a_batch=8)), "noise").agg(F.sum("n")).first()[0] == 3000
    same = rows.withColumn("event_ts", F.lit("2024-01-01").cast("timestamp")).withColumn("k", F.monotonically_increasing_id())
    assert jobs.finished(jobs.eps(jobs.replayed(same, files_a_batch=8)), "eps").agg(F.max("n")).first()[0] == 3001
    assert jobs.finished(jobs.eps(jobs.replayed(rows.limit(0))), "eps").count() == 0


def test_kept_decisions_are_read_by_hour(spark, tmp_path):
    at = lambda hours: START + dt.timedelta(hours=hours)
    schema, folder = "log_id long, event_ts timestamp, source string, category string", f"{tmp_path}/kept"
    batch = lambda ks: spark.createDataFrame([(k, at(k / 2), "Web-1" if k % 2 else "db", "noise") for k in ks] + [(999, None, "web-1", "noise")], schema)
    each = retained.keep(folder)
    each(batch(range(40)), 0)
    each(batch(range(40, 100)), 1)
    each(batch(range(40)), 0)  # again, as after a failure
    offenses = spark.createDataFrame([(1, at(10.2), 8, "OPEN", ["WEB 1", "web"]), (2, at(30), 8, "CLOSED", ["db"]), (3, None, 8, "OPEN", ["db"]), (4, at(47.4), 8, "OPEN", ["db-x", None])], "offense_id long, start_time timestamp, severity int, status string, log_sources array<string>")
    found = retained.near(spark, folder, batch([]).schema, offenses)
    assert "hour#" in plan(found).split("PartitionFilters: [")[1].split("]")[0]
    assert sorted({r.log_id for r in found.collect()}) == [18, 19, 20, 21, 58, 59, 60, 61, 92, 93, 94, 95]
    retained.by_source(folder, batch([]).schema, f"{tmp_path}/out")(offenses, 0)
    pairs = lambda path: sorted((r.offense_id, r.log_id) for r in spark.read.parquet(path).collect())
    assert pairs(f"{tmp_path}/out") == [(1, 19), (2, 58), (2, 60), (4, 94)]
    retained.by_source(folder, batch([]).schema, f"{tmp_path}/recent", lambda: at(48), 24)(offenses, 0)
    assert pairs(f"{tmp_path}/recent") == [(4, 94)]
    assert retained.drop_old(spark, folder, at(48)) == 24
    assert spark.read.parquet(folder).agg(F.min("event_ts")).first()[0] == at(24)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_queues_take_packets_and_not_rows(spark):
    rows = [(k, None if k % 7 == 0 else 2**60 + k, "noise" if k % 2 else None, ["summary", "cold_storage"][k % 3 == 0], k % 2, START + dt.timedelta(microseconds=k)) for k in range(25_000)]
    df = spark.createDataFrame(rows, "log_id long, n long, category string, destination string, lane int, at timestamp").coalesce(1)
    packets = stateful._packets(df, df.columns).collect()
    assert len(packets) <= 4 * 3 and sum(p.n for p in packets) == 25_000
    held = spark.createDataFrame([(5, 100, p.n, p.rows) for p in packets], "first long, size long, n long, rows binary")
    out = stateful._unpacked(held, df.withColumns({c: F.lit(0).cast("long") for c in ("batch_number", "batch_rows")}).schema).collect()
    assert {r.log_id: (r.n, r.category, r.destination, r.lane, r["at"]) for r in out} == {r[0]: r[1:] for r in rows}
    assert len(out) == 25_000 and min(r.batch_number for r in out) == 5
