"""Annotation tasks and other multi-line JSON with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME = "struct<frame:int,enabled:boolean,rotation:double,x:double,y:double,width:double,height:double,time:double>"
VALUE = f"struct<framesCount:int,duration:double,labels:array<string>,choices:array<string>,sequence:array<{FRAME}>>"
RESULT = f"struct<id:string,type:string,from_name:string,to_name:string,origin:string,value:{VALUE}>"
TASKS = f"id long, data struct<video:string>, annotations array<struct<id:long,completed_by:int,result:array<{RESULT}>>>"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or a pattern has files, in whatever file system it names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


DAMAGED = "_damaged"


def read_tasks(spark: SparkSession, categories: dict[str, str], quarantine: str | None = None) -> DataFrame:
    """Tasks of several files; ``categories`` maps paths to categories.  Files that aren't there are skipped.

    A file that isn't JSON gives no rows; with ``quarantine`` its path, category and text are added to that folder.
    """
    there = {p: c for p, c in categories.items() if exists(spark, p)}
    if not there:
        return spark.createDataFrame([], f"{TASKS}, category string")
    read = spark.read.schema(f"{TASKS}, {DAMAGED} string").option("multiLine", True).option("columnNameOfCorruptRecord", DAMAGED)
    rows = read.json(list(there)).withColumn("path", F.url_decode(F.regexp_replace("_metadata.file_path", "[+]", "%2B")))
    # whole paths as the file system spells them, without its scheme: base names may repeat
    plain = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/+", "/")
    named = spark.createDataFrame([(full_path(spark, p), c) for p, c in there.items()], "full string, category string")
    rows = rows.join(F.broadcast(named.withColumn("full", plain("full"))), plain("path") == F.col("full"), "left").drop("full")
    # a value of another type than declared damages only itself: its task keeps its id
    lost = F.col(DAMAGED).isNotNull() & F.col("id").isNull()
    if quarantine:
        rows.filter(lost).select("path", "category", F.col(DAMAGED).alias("text")).write.mode("append").parquet(quarantine)
    return rows.filter(~lost).drop(DAMAGED, "path")


def full_path(spark: SparkSession, path: str) -> str:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


def read_json_array(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(paths)
