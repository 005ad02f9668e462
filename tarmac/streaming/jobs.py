"""The job queue as a stream: files of job events arrive, the current state of each job is kept."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import first_per_key

#: States that may follow a state.
FOLLOWS = {"pending": ["claimed"], "claimed": ["processing", "failed"], "processing": ["processing", "completed", "failed"], "failed": ["pending"]}
EVENTS = "job_id string, video_id string, status string, progress int, at timestamp"


def job_events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def job_states(events: DataFrame) -> DataFrame:
    """Latest state and highest progress of each job; works on streams (complete or update mode) and tables."""
    return events.groupBy("job_id").agg(
        F.max_by("status", "at").alias("status"), F.max("progress").alias("progress"), F.min("at").alias("created"), F.max("at").alias("updated")
    )


def transitions(events: DataFrame) -> DataFrame:
    """Changes of state, by comparing each event with the one before (tables)."""
    from pyspark.sql import Window

    before = F.lag("status").over(Window.partitionBy("job_id").orderBy("at"))
    return events.withColumn("previous", before).filter(F.col("previous").isNotNull() & (F.col("previous") != F.col("status")))


def process_pending(events: DataFrame, work, checkpoint: str, out: str):
    """Pending jobs of each micro-batch, one row each, through ``work`` (DataFrame to DataFrame), appended to ``out``."""
    # a job's first event tells when it was created
    first = lambda df: first_per_key(df.filter("status = 'pending'"), "job_id", "at", "video_id")
    return by_batch(events, lambda df: work(first(df)), checkpoint, out)


def process_claims(events: DataFrame, work, checkpoint: str, out: str):
    """The same for jobs that ``claims`` gives: none that is done or was claimed before, in whatever micro-batch."""
    return by_batch(claims(events), work, checkpoint, out)


def by_batch(rows: DataFrame, work, checkpoint: str, out: str):
    """Each micro-batch through ``work``.

    A batch that is run again overwrites its own folder, so each job's result is written once.
    """

    def batch(df: DataFrame, number: int) -> None:
        work(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def claims(events: DataFrame) -> DataFrame:
    """(job_id, video_id, created) of each job of a stream when it is found pending; from then on it counts as claimed.

    A job is claimed again only where a pending event follows a state that may be left for pending.  Events older than
    a job's last one change nothing, neither do events without job or state.
    """

    def step(key, batches, state):
        last, last_at, created, video = state.get if state.exists else (None, None, None, None)
        for at, status, own in pd.concat(list(batches))[["at", "status", "video_id"]].sort_values("at", kind="stable").itertuples(index=False):
            created = at if created is None else min(created, at)
            if last is not None and (at < last_at or (status == "pending" and status not in FOLLOWS.get(last, ()))):
                continue
            last, last_at, video = status, at, own
        found = [(key[0], video, created)] if last == "pending" else []
        state.update(("claimed" if found else last, last_at, created, video))
        yield pd.DataFrame(found, columns=["job_id", "video_id", "created"]).astype({"created": "int64"})

    rows = events.select("job_id", "video_id", "status", F.unix_micros("at").alias("at")).filter("job_id is not null and status is not null and at is not null")
    found = rows.groupBy("job_id").applyInPandasWithState(step, "job_id string, video_id string, created long", "status string, at long, created long, video_id string", "append", "NoTimeout")
    return found.withColumn("created", F.timestamp_micros("created"))


def claimed(events: DataFrame, n: int = 1) -> DataFrame:
    """The ``n`` oldest jobs whose last event is ``pending``, as the rows that claim them (tables)."""
    states = events.groupBy("job_id").agg(F.max_by("status", "at").alias("status"), F.max_by("video_id", "at").alias("video_id"), F.min("at").alias("created"))
    return states.filter("status = 'pending'").orderBy("created", "job_id").limit(n).withColumn("status", F.lit("claimed"))


def tracked(events: DataFrame) -> DataFrame:
    """Changes of state of a stream of events, as they come, each with whether it may be; a job's last state is kept.

    Events of a job within a micro-batch are taken by time; one that arrives in a later batch follows those before it.
    """

    def step(key, batches, state):
        last = state.get[0] if state.exists else None
        out = []
        for at, status in pd.concat(list(batches))[["at", "status"]].sort_values("at", kind="stable").itertuples(index=False):
            if last is not None and status != last:
                out.append((key[0], last, status, at, status in FOLLOWS.get(last, ())))
            last = status
        state.update((last,))
        yield pd.DataFrame(out, columns=["job_id", "previous", "status", "at", "legal"]).astype({"legal": bool, "at": "datetime64[ns]"})

    rows = events.select("job_id", "status", "at").filter("job_id is not null and status is not null")
    return rows.groupBy("job_id").applyInPandasWithState(step, "job_id string, previous string, status string, at timestamp, legal boolean", "status string", "append", "NoTimeout")


def illegal_transitions(events: DataFrame) -> DataFrame:
    """Changes of state that may not be."""
    of = F.create_map(*[x for k, v in FOLLOWS.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in v]))])
    after = F.coalesce(F.element_at(of, F.col("previous")), F.array().cast("array<string>"))
    return transitions(events).filter(~F.array_contains(after, F.col("status")))
