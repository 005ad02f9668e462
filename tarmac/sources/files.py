"""Listings of folders and plain sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import decimals, file_extension, file_stem

VIDEO, IMAGE = ("mp4", "avi", "mov", "mkv"), ("jpg", "jpeg", "png")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(folder or tempfile.gettempdir()).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def listing(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, folder, name, stem, extension, length, modified) of all files below; contents aren't read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    parts = F.split("path", "/")
    rows = rows.select("path", F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("name"), file_stem(F.col("path")).alias("stem"), file_extension(F.col("path")).alias("extension"), "length", F.col("modificationTime").alias("modified"))
    return rows.filter(~F.col("name").startswith("."))


def library(files: DataFrame) -> DataFrame:
    """A row for each folder and stem with its newest video and image; groups without video come last."""
    video, image = F.col("extension").isin(*VIDEO), F.col("extension").isin(*IMAGE)
    out = files.groupBy("folder", "stem").agg(
        F.max_by("path", F.when(video, F.col("modified"))).alias("video"), F.max_by("path", F.when(image, F.col("modified"))).alias("thumbnail"),
        F.max(F.when(video, F.col("modified"))).alias("last_modified"), F.sum("length").alias("bytes"),
    )
    return out.orderBy("folder", F.desc_nulls_last("last_modified"), "stem")


def folder_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("folder").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def write_csv(df: DataFrame, path: str, coordinates: tuple[str, ...] = ("lat", "lng")) -> None:
    """CSV with a header, coordinates with six digits; values with commas are quoted."""
    fixed = {c: decimals(F.col(c), 6) for c in coordinates if c in df.columns}
    df.withColumns(fixed).write.mode("overwrite").option("header", True).csv(path)


def write_json_by(df: DataFrame, path: str, key: str) -> None:
    df.write.mode("overwrite").partitionBy(key).json(path)


def as_documents(df: DataFrame) -> DataFrame:
    """One JSON text for each row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("item"))
