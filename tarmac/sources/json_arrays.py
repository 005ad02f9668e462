"""One JSON array per key as a file of its own: ``df.write.format("json_arrays")``.

Tasks stream their rows to files in a hidden folder of their attempt and tell the driver which keys they wrote.  Only
when all tasks are done these are renamed into place, one rename a key; a failed job, or a repeated task, leaves
nothing behind.  Files of keys that aren't written stay as they are.  The folder must be on a path that all executors
and the driver see.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal
from urllib.parse import quote

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


def plain(value):
    """A value as JSON has it."""
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    return float(value) if isinstance(value, Decimal) else value


def file_name(key) -> str:
    return ("__null__" if key is None else quote(str(key), safe="")) + ".json"


class ArrayWriter(DataSourceWriter):
    def __init__(self, path: str, key: str):
        self.path, self.key = path, key
        self.hidden = f"{path}/.{uuid.uuid4().hex}"

    def write(self, rows) -> Written:
        folder = f"{self.hidden}/{uuid.uuid4().hex}"
        os.makedirs(folder)
        names, out = [], None
        for row in rows:
            values = row.asDict()
            name = file_name(values.pop(self.key))
            if out is None or name != names[-1]:
                if out:
                    out.write("\n]\n")
                    out.close()
                if name in names:
                    raise ValueError(f"rows of {name} aren't behind each other: use write_arrays")
                names.append(name)
                out = open(f"{folder}/{name}", "w", encoding="utf-8")
                out.write("[\n")
            else:
                out.write(",\n")
            out.write(json.dumps({k: plain(v) for k, v in values.items() if v is not None}, ensure_ascii=False))
        if out:
            out.write("\n]\n")
            out.close()
        return Written(folder, names)

    def commit(self, messages) -> None:
        done = [m for m in messages if m is not None]
        names = [n for m in done for n in m.names]
        if len(names) != len(set(names)):
            self.abort(messages)
            raise ValueError("a key's rows were written by several tasks: use write_arrays")
        for m in done:
            for name in m.names:
                os.replace(f"{m.folder}/{name}", f"{self.path}/{name}")
        shutil.rmtree(self.hidden, ignore_errors=True)

    def abort(self, messages) -> None:
        shutil.rmtree(self.hidden, ignore_errors=True)


class ArraySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_arrays"

    def writer(self, schema, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(self.options["path"], self.options["key"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArraySource)


def write_arrays(df: DataFrame, path: str, key: str, *order: str) -> None:
    """A file ``<key>.json`` for each key of ``df`` with its rows in order, without the key and without nulls."""
    os.makedirs(path, exist_ok=True)
    lined = df.repartition(F.xxhash64(key)).sortWithinPartitions(key, *order)
    lined.write.format("json_arrays").mode("append").option("path", path).option("key", key).save()
