"""Leases on streams and tables, and the polling source across restarts."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tarmac.sources import job_queue
from tarmac.streaming import leases, windows

START = datetime(2024, 1, 1)


def at(minutes):
    return (START + timedelta(minutes=minutes)).isoformat()


#: (job, state, minutes); leases last 10 minutes
EVENTS = [
    [("a", "pending", 0), ("b", "pending", 1), ("c", "processing", 1), ("a", "processing", 5)],
    [("b", "processing", 9), ("a", "completed", 12), ("b", "pending", 13), ("d", "pending", 14)],
    [("b", "completed", 30), ("e", "pending", 31), ("a", "pending", 33), ("a", "processing", 34), ("a", "failed", 35)],
    [("e", "processing", 47), ("f", "pending", 100)],
]
WANT = [
    ("a", "claimed", 0, 1), ("b", "claimed", 1, 1), ("a", "completed", 12, 1), ("d", "claimed", 14, 1),
    # b was silent from 9 on, and d from 14 on
    ("b", "returned", 19, 1), ("b", "claimed", 19, 2), ("b", "returned", 29, 2), ("b", "claimed", 29, 3),
    ("d", "returned", 24, 1), ("d", "claimed", 24, 2), ("d", "returned", 34, 2), ("d", "claimed", 34, 3), ("d", "failed", 44, 3),
    # completed may not follow claimed, so b goes on until its last lease is over
    ("b", "failed", 39, 3), ("e", "claimed", 31, 1), ("a", "claimed", 33, 1), ("a", "failed", 35, 1),
    ("e", "returned", 41, 1), ("e", "claimed", 41, 2), ("e", "returned", 57, 2), ("e", "claimed", 57, 3), ("e", "failed", 67, 3), ("f", "claimed", 100, 1),
]


def rows_of(df):
    return sorted((r["job_id"], r["change"], round((r["at"] - START).total_seconds() / 60), r["attempt"]) for r in df.collect())


def events_of(spark, groups):
    rows = [(j, f"v{j}", s, START + timedelta(minutes=m)) for g in groups for j, s, m in g]
    return spark.createDataFrame(rows, "job_id string, video_id string, status string, at timestamp")


def test_lease_history(spark):
    assert rows_of(leases.lease_history(events_of(spark, EVENTS), 600)) == sorted(WANT)
    odd = spark.createDataFrame([(None, "v", "pending", START), ("x", "v", None, START), ("y", "v", "pending", None)], "job_id string, video_id string, status string, at timestamp")
    assert leases.lease_history(odd, 600).count() == 0


@pytest.mark.parametrize("cuts", [[1, 1, 1, 1], [2, 2], [4]])
def test_lease_stream_equals_table(spark, tmp_path, cuts):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    leases.use_rocksdb(spark)
    try:
        groups, rest = [], list(EVENTS)
        for n in cuts:
            groups.append([e for g in rest[:n] for e in g])
            rest = rest[n:]
        source = tmp_path / "in"
        source.mkdir()
        out, events = f"{tmp_path}/out", spark.readStream.schema("job_id string, video_id string, status string, at timestamp").json(str(source))
        # each group is a run of its own: the state lives on in the checkpoint
        for i, group in enumerate(groups):
            (source / f"{i}.json").write_text("\n".join(json.dumps({"job_id": j, "video_id": f"v{j}", "status": s, "at": at(m)}) for j, s, m in group))
            q = leases.lease_changes(events, 600).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", out).trigger(availableNow=True).start()
            assert q.awaitTermination(120) and q.exception() is None
        assert rows_of(spark.read.parquet(out)) == sorted(WANT)
    finally:
        spark.conf.set(provider, before)


def test_claims_by_age(spark, tmp_path):
    changes = leases.lease_history(events_of(spark, EVENTS[:1]), 600)
    changes.coalesce(1).write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema(changes.schema).json(f"{tmp_path}/in")
    assert leases.work_on_claims(stream, lambda df: df, f"{tmp_path}/c", f"{tmp_path}/out").awaitTermination(60)
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("turn").collect()
    assert [(r["job_id"], r["turn"]) for r in got] == [("a", 1), ("b", 2)]


@pytest.mark.parametrize("keep", ["true", "false"])
def test_queue_survives_restarts(spark, tmp_path, keep):
    job_queue.register(spark)
    path = f"{tmp_path}/queue.db"
    job_queue.create(path)

    def run(until):
        stream = spark.readStream.format("job_queue").option("path", path).option("rowsPerPartition", 3).option("keep", keep).load()
        q = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").start()
        for _ in range(300):
            if q.exception() is not None or sum(p["numInputRows"] for p in q.recentProgress) >= until:
                break
            q.awaitTermination(0.2)
        q.processAllAvailable()
        q.stop()
        assert q.exception() is None

    job_queue.push(path, [(f"j{i}", "v", "pending", None, at(i)) for i in range(12)])
    run(12)
    job_queue.push(path, [(f"k{i}", None, "pending", 5, None) for i in range(4)])
    run(4)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r["seq"] for r in got) == list(range(1, 17))
    assert {r["job_id"]: r["at"] for r in got}["j3"] == START + timedelta(minutes=3)
    left = spark.read.format("job_queue").option("path", path).load().count()
    assert left == 16 if keep == "true" else left <= 16


def test_streams_join_like_tables(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type")
    # three runs, in order of time
    cut = events.select(F.ntile(3).over(Window.orderBy("ts")).alias("part"), "*")
    want = {(r["event_id"], r["r_event_id"]) for r in windows.near_pairs(*[events.filter(F.col("event_type") == t) for t in ("click", "view")], "user_id", "ts", 36_000).collect()}
    for i in (1, 2, 3):
        cut.filter(f"part = {i}").drop("part").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
        pairs = windows.near_pairs(*[stream.filter(F.col("event_type") == t) for t in ("click", "view")], "user_id", "ts", 36_000)
        q = pairs.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        assert q.awaitTermination(120) and windows.late_rows(q) == 0
    rows = spark.read.parquet(f"{tmp_path}/out").select("event_id", "r_event_id").collect()
    assert len(rows) == len(want) > 50 and {tuple(r) for r in rows} == want


def test_once_within_drops_repeats_and_late_rows(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    stream = windows.once_within(spark.readStream.schema("k string, ts timestamp").json(str(source)), ["k"], "ts", "10 minutes")
    late = 0
    for i, rows in enumerate([[("a", 0), ("a", 1), ("b", 2)], [("a", 5), ("c", 200)], [("d", 20), ("a", 201)]]):
        (source / f"{i}.json").write_text("\n".join(json.dumps({"k": k, "ts": at(m)}) for k, m in rows))
        q = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        late += windows.late_rows(q)
    # d comes after the watermark; a is forgotten by then and counts anew
    assert sorted(r["k"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "a", "b", "c"]
    assert late == 1
