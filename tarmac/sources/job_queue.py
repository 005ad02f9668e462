"""A job queue in a SQLite table as a streaming Python data source: ``spark.readStream.format("job_queue")``.

The table ``jobs`` has a growing integer ``seq`` and (job_id, video_id, status, progress, at).  An offset is the last
``seq`` that a batch took, so a restarted query goes on behind its checkpoint, without loss or repeat.  A batch is read
in ranges of ``rowsPerPartition`` rows by as many tasks.  With ``keep`` false rows are deleted once the batch that read
them is committed.  The reader holds no state of its own.  The file must be on a path that all executors see.
"""

from __future__ import annotations

import sqlite3
from contextlib import closing

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

COLUMNS = "seq, job_id, video_id, status, progress, at"
SCHEMA = "seq long, job_id string, video_id string, status string, progress int, at timestamp"


def create(path: str) -> None:
    with closing(sqlite3.connect(path)) as db, db:
        db.execute("CREATE TABLE IF NOT EXISTS jobs (seq INTEGER PRIMARY KEY AUTOINCREMENT, job_id TEXT, video_id TEXT, status TEXT, progress INTEGER, at TEXT)")


def push(path: str, rows: list[tuple]) -> None:
    """Add events (job_id, video_id, status, progress, at as ISO text)."""
    with closing(sqlite3.connect(path)) as db, db:
        db.executemany("INSERT INTO jobs (job_id, video_id, status, progress, at) VALUES (?, ?, ?, ?, ?)", rows)


class Range(InputPartition):
    def __init__(self, after: int, upto: int):
        self.after, self.upto = after, upto


def ranges(after: int, upto: int, rows: int) -> list[Range]:
    return [Range(a, min(a + rows, upto)) for a in range(after, upto, rows)]


class Rows:
    def __init__(self, options):
        self.path = options["path"]
        self.rows = int(options.get("rowsPerPartition", 10_000))
        self.keep = options.get("keep", "true").lower() == "true"

    def one(self, sql: str, *values) -> int:
        with closing(sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)) as db:
            return db.execute(sql, values).fetchone()[0]

    def last(self) -> int:
        """The largest number ever given, also where rows were deleted."""
        return self.one("SELECT coalesce(max(seq), 0) FROM sqlite_sequence WHERE name = 'jobs'")

    def read(self, part: Range):
        from datetime import UTC, datetime

        with closing(sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)) as db:
            for *values, at in db.execute(f"SELECT {COLUMNS} FROM jobs WHERE seq > ? AND seq <= ? ORDER BY seq", (part.after, part.upto)):
                yield (*values, None if at is None else datetime.fromisoformat(at).replace(tzinfo=UTC))


class QueueStream(Rows, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"seq": 0}

    def latestOffset(self) -> dict:
        return {"seq": self.last()}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return ranges(start["seq"], end["seq"], self.rows)

    def commit(self, end: dict) -> None:
        if not self.keep:
            with closing(sqlite3.connect(self.path)) as db, db:
                db.execute("DELETE FROM jobs WHERE seq <= ?", (end["seq"],))


class QueueTable(Rows, DataSourceReader):
    def partitions(self) -> list[Range]:
        return ranges(self.one("SELECT coalesce(min(seq), 1) FROM jobs") - 1, self.last(), self.rows)


class QueueSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "job_queue"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> QueueTable:
        return QueueTable(self.options)

    def streamReader(self, schema) -> QueueStream:
        return QueueStream(self.options)


def register(spark) -> None:
    spark.dataSource.register(QueueSource)
