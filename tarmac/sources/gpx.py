"""GPX tracks as DataFrames, through Spark's XML reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINT = "struct<_lat:string,_lon:string,_timestamp:string,_speed:string,ele:string>"
SCHEMA = f"name string, trkseg array<struct<trkpt:array<{POINT}>>>"


def read_gpx(spark: SparkSession, paths: str | list[str], drop_invalid: bool = False) -> DataFrame:
    """(path, idx, lat, lon, ts, speed, ele): points in file order.  Bad numbers are 0, or drop the row on request."""
    rows = spark.read.format("xml").option("rowTag", "trk").option("ignoreNamespace", True).schema(SCHEMA).load(paths)
    one = rows.select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.flatten(F.col("trkseg.trkpt"))).alias("idx", "p"))
    lat, lon = F.col("p._lat").try_cast("double"), F.col("p._lon").try_cast("double")
    if drop_invalid:
        one = one.filter(lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon))
    return one.select(
        "path", "idx", F.coalesce(lat, F.lit(0.0)).alias("lat"), F.coalesce(lon, F.lit(0.0)).alias("lon"),
        F.try_to_timestamp(F.col("p._timestamp"), F.lit("yyyy:MM:dd HH:mm:ssX")).alias("ts"),
        F.coalesce(F.col("p._speed").try_cast("double"), F.lit(0.0)).alias("speed"), F.col("p.ele").try_cast("double").alias("ele"),
    )


def damaged(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, reason, text) of files that give no points: no XML of a track, or a track without any."""
    whole = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    good = read_gpx(spark, paths).select(F.col("path").alias("good")).distinct()
    reason = F.when(F.trim("text") == "", "empty").when(~F.col("text").contains("<trkpt"), "no points").otherwise("broken")
    return whole.join(good, F.col("path") == F.col("good"), "left_anti").select("path", reason.alias("reason"), "text")


def read_first(spark: SparkSession, choices: list[str], drop_invalid: bool = False) -> DataFrame:
    """Points of the first path that has any file; no rows where none has."""
    from .annotations import exists

    found = next((p for p in choices if exists(spark, p)), None)
    if found is None:
        return spark.createDataFrame([], "path string, idx int, lat double, lon double, ts timestamp, speed double, ele double")
    return read_gpx(spark, found, drop_invalid)


def paths_of(points: DataFrame, least: int = 2) -> DataFrame:
    """A track's points in order as an array; tracks of fewer than ``least`` points are left out."""
    track = F.sort_array(F.collect_list(F.struct("idx", "lat", "lon"))).alias("track")
    return points.groupBy("path").agg(track).filter(F.size("track") >= least)


def with_positional_time(points: DataFrame, key: str, index: str, duration: float) -> DataFrame:
    """Seconds of a point by its place: index / number of points * duration."""
    n = points.groupBy(key).agg(F.count("*").alias("__n"))
    return points.join(n, key).withColumn("seconds", F.col(index) / F.col("__n") * duration).drop("__n")


def is_gpx(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, valid) by the text alone."""
    text = spark.read.text(paths, wholetext=True)
    valid = (F.col("value").contains("<gpx") | F.col("value").contains("<trkpt")) & F.col("value").contains("lat=")
    return text.select(F.col("_metadata.file_path").alias("path"), valid.alias("valid"))
