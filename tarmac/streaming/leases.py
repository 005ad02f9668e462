"""The job queue with leases: a claimed job that shows no progress returns to the queue, finished jobs leave the state.

A pending job is claimed when it is seen and leased for a while; each event of progress renews the lease.  When a lease
ends the job is ``returned`` and claimed again, up to ``attempts`` times, then it ``failed``.  Completed and failed jobs
are forgotten; a later pending event of theirs begins a new job.  Events that may not follow a job's state, and events
older than its last one, change nothing; neither do events without job, state or time.

The same rules run on streams, by state variables and event-time timers, and on tables, by one pass over sorted events.
Leases end by event time, so a stream gives the rows of the table up to its watermark, however it's cut into batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .jobs import FOLLOWS

CHANGES = "job_id string, video_id string, change string, at long, created long, attempt int"
STATE = "status string, video string, created long, last long, until long, attempt int"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DONE = ("completed", "failed")


class Job(NamedTuple):
    """A leased job; times in microseconds."""

    status: str
    video: str | None
    created: int
    last: int
    until: int
    attempt: int


def ended(key: str, job: Job, now: int, lease: int, attempts: int) -> tuple[Job | None, list[tuple]]:
    """The job after all leases that end until ``now``, and the changes they make."""
    out = []
    while job and job.until <= now:
        at, n = job.until, job.attempt + 1
        if n > attempts:
            return None, [*out, (key, job.video, "failed", at, job.created, job.attempt)]
        out += [(key, job.video, "returned", at, job.created, job.attempt), (key, job.video, "claimed", at, job.created, n)]
        job = job._replace(status="claimed", until=at + lease, attempt=n)
    return job, out


def after(key: str, job: Job | None, at: int, status: str, video: str | None, lease: int, attempts: int) -> tuple[Job | None, list[tuple]]:
    """The job after one event, and the changes up to it."""
    out: list[tuple] = []
    if job and at >= job.last:
        job, out = ended(key, job, at, lease, attempts)
    if job is None:
        if status != "pending":
            return None, out
        return Job("claimed", video, at, at, at + lease, 1), [*out, (key, video, "claimed", at, at, 1)]
    if at < job.last or status not in FOLLOWS.get(job.status, ()):
        return job, out
    if status in DONE:
        return None, [*out, (key, job.video, status, at, job.created, job.attempt)]
    return job._replace(status=status, last=at, until=at + lease), out


def prepared(events: DataFrame) -> DataFrame:
    """Events with what a lease needs; the status breaks ties of time."""
    micros = F.unix_micros(F.col("at").cast("timestamp")).alias("micros")
    rows = events.select(F.col("job_id").cast("string").alias("job_id"), F.col("video_id").cast("string").alias("video_id"), "status", "at", micros)
    return rows.filter("job_id is not null and status is not null and at is not null")


def frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["job_id", "video_id", "change", "at", "created", "attempt"]).astype({"at": "int64", "created": "int64", "attempt": "int32"})


class Leases(StatefulProcessor):
    """One state variable a job, gone when the job is done, and one timer at the end of its lease."""

    def __init__(self, lease: int, attempts: int):
        self.lease, self.attempts = lease, attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", STATE)

    def load(self) -> Job | None:
        return Job(*self.state.get()) if self.state.exists() else None

    def store(self, old: Job | None, new: Job | None) -> None:
        # timers count milliseconds: the first one at which the lease is over
        due = lambda job: -(-job.until // 1000)
        if old and (new is None or due(new) != due(old)):
            self.handle.deleteTimer(due(old))
        if new is None:
            self.state.clear()
            return
        self.state.update(tuple(new))
        if old is None or due(new) != due(old):
            self.handle.registerTimer(due(new))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = job = self.load()
        out = []
        events = pd.concat(list(rows))[["micros", "status", "video_id"]].sort_values(["micros", "status"], kind="stable")
        for at, status, video in events.itertuples(index=False, name=None):
            job, changes = after(key[0], job, at, status, video, self.lease, self.attempts)
            out += changes
        self.store(old, job)
        yield frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        old = self.load()
        if old is None:
            return
        job, out = ended(key[0], old, timerValues.getCurrentWatermarkInMs() * 1000, self.lease, self.attempts)
        self.store(old, job)
        yield frame(out)

    def close(self) -> None:
        pass


def finished(changes: DataFrame) -> DataFrame:
    return changes.withColumns({c: F.timestamp_micros(c) for c in ("at", "created")})


def lease_changes(events: DataFrame, lease_seconds: float, attempts: int = 3, late: str = "0 seconds") -> DataFrame:
    """(job_id, video_id, change, at, created, attempt) of a stream: claimed, returned, completed and failed jobs.

    The session needs the RocksDB state store (``use_rocksdb``).
    """
    rows = prepared(events).withWatermark("at", late)
    out = rows.groupBy("job_id").transformWithStateInPandas(Leases(round(lease_seconds * 1e6), attempts), CHANGES, "append", "EventTime")
    return finished(out)


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def lease_history(events: DataFrame, lease_seconds: float, attempts: int = 3) -> DataFrame:
    """The same changes of a table of events, with leases that end until its last event.

    Jobs are streamed through their tasks event by event, so a job with very many events needs no more memory.
    """
    lease = round(lease_seconds * 1e6)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, job, now = None, None, 0
        for b in batches:
            out = []
            for name, at, status, video, now in b.itertuples(index=False, name=None):  # noqa: B020
                if name != key:
                    out += ended(key, job, now, lease, attempts)[1] if job else []
                    key, job = name, None
                job, changes = after(key, job, at, status, video, lease, attempts)
                out += changes
            yield frame(out)
        if job:
            yield frame(ended(key, job, now, lease, attempts)[1])

    rows = prepared(events)
    last = rows.agg(F.max("micros").alias("now"))
    lined = rows.join(F.broadcast(last)).repartition(F.xxhash64("job_id")).sortWithinPartitions("job_id", "micros", "status")
    return finished(lined.select("job_id", "micros", "status", "video_id", "now").mapInPandas(run, CHANGES))


def work_on_claims(changes: DataFrame, work, checkpoint: str, out: str):
    """Claimed jobs of each micro-batch through ``work``, the oldest first; a batch that runs again overwrites its folder."""

    def batch(df: DataFrame, number: int) -> None:
        # a batch's claims in one order, by age
        age = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("created", "job_id"))
        claims = df.filter("change = 'claimed'").withColumn("turn", age)
        work(claims).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
