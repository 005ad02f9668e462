"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used where a local session names no shared folder, that is in tests on one machine.
LOCAL_SHARED = "/tmp/tarmac-shared"
#: What is cut off both ends of a word.
EDGES = ".,;:!?()[]{}<>\"'`*_-/\\|«»“”‘’„…–—¡¿#"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors see; on a cluster it must be set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return folder or LOCAL_SHARED


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/tarmac/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back.

    This cuts the lineage, and a lost executor doesn't lose the rows.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the folders of stored frames that nothing reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for df in frames:
        folders = {os.path.dirname(f) for f in df.inputFiles()}
        for folder in folders:
            if "/tarmac/" in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def streamed_by(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows of a key in one partition, sorted by key and ``order``, for tasks that read them as a stream.

    Dealt out by a hash of the key: a plain repartition by the key counts as met where a join or union below claims that
    partitioning, and adaptive execution may then still split or mix its partitions.
    """
    return df.repartition(F.xxhash64(key)).sortWithinPartitions(key, *order)


def set_aside(df: DataFrame, *own: str) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with those columns renamed that begin as the operators' own do, but for ``own``, and their former names."""
    names: dict[str, str] = {}
    for c in df.columns:
        if c.startswith("__") and c not in own:
            new = f"x{c}"
            while new in df.columns or new in names:
                new = f"x{new}"
            names[new] = c
    back = {c: new for new, c in names.items()}
    return (df.select(*[F.col(f"`{c}`").alias(back.get(c, c)) for c in df.columns]) if names else df), names


def brought_back(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """``df`` with the names that ``set_aside`` changed."""
    return df.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns]) if names else df
