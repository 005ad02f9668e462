"""The survey roles on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START = 1_704_067_200  # 2024-01-01, in seconds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items: route, part, condition (R poor, A fair, else good), confidence, date."""
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("survey_id"), F.col("l_linenumber").alias("item"), F.col("l_suppkey").alias("route_id"), F.col("l_partkey").alias("part"),
        F.when(flag == "R", "Poor").when(flag == "A", "Fair").otherwise("Good").alias("condition"),
        F.col("l_discount").alias("confidence"), F.col("l_shipdate").alias("detected_at"),
    )


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("route_id"), F.col("s_name").alias("road_name"), F.col("s_nationkey").alias("road_type"), F.col("s_acctbal").alias("km"))


def surveys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("route_id"), F.to_date("o_orderdate").alias("survey_date"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("surveyor"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames: video, number, seconds from the start, detections."""
    # microseconds of the timestamp without zone, as whole number
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("frame_number"), F.col("user_id").alias("video_id"), "event_type", ((micros - F.lit(START * 1_000_000)) / 1_000_000).alias("seconds"),
        F.get_json_object("props", "$.k").cast("int").alias("detections_count"), "value",
    )
