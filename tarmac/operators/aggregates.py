"""Aggregations: dashboards, histograms, conditional pivots, nested summaries.  Partial aggregation precedes each shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kpis(assets: DataFrame, roads: DataFrame, condition: str, km: str, good: str = "Good", fair: str = "Fair", poor: str = "Poor") -> DataFrame:
    """One row: all assets, anomalies (poor), good, fair, kilometres of all roads."""
    n = lambda v: F.count_if(F.col(condition) == v)
    one = assets.agg(F.count("*").alias("total_assets"), n(poor).alias("anomalies"), n(good).alias("good"), n(fair).alias("fair"))
    length = roads.agg(F.round(F.coalesce(F.sum(F.coalesce(F.col(km), F.lit(0.0))), F.lit(0.0)), 1).alias("km_surveyed"))
    return one.join(F.broadcast(length))  # one row each


def top_groups(df: DataFrame, key: str, k: int, count: str = "count") -> DataFrame:
    """The k largest groups; ties by key."""
    return df.groupBy(key).agg(F.count("*").alias(count)).orderBy(F.desc(count), F.asc_nulls_last(key)).limit(k)


def named(c: str, default: str = "Unknown") -> Column:
    """The group's name; null and empty ones are named after grouping, so they stay apart."""
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default))


def frame_stats(frames: DataFrame, count: str = "detections_count") -> DataFrame:
    """One row: frames, frames with detections, detections, mean; zeros for no frames."""
    zero = F.lit(0)
    return frames.agg(
        F.count("*").alias("total_frames"), F.count_if(F.col(count) > 0).alias("frames_with_detections"),
        F.coalesce(F.sum(count), zero).cast("long").alias("total_detections"), F.round(F.coalesce(F.avg(count), zero.cast("double")), 6).alias("avg_detections"),
    )


def over_domain(df: DataFrame, key: str, domain: list[str], count: str = "count") -> DataFrame:
    """Counts of every value of a fixed domain, zeros included."""
    all_ = df.sparkSession.createDataFrame([(v,) for v in domain], f"{key} string")
    return all_.join(df.groupBy(key).agg(F.count("*").alias(count)), key, "left").withColumn(count, F.coalesce(count, F.lit(0)))


def class_histogram(frames: DataFrame, detections: str = "detections", default: str = "unknown") -> DataFrame:
    one = frames.select(F.explode(detections).alias("d"))
    return one.groupBy(F.coalesce("d.class_name", F.lit(default)).alias("class_name")).agg(F.count("*").alias("count"))


def class_report(histogram: DataFrame, frames: int | Column) -> DataFrame:
    """Share of all detections and mean per frame; a last row named TOTAL."""
    frames = frames if isinstance(frames, Column) else F.lit(frames)
    total = histogram.agg(F.sum("count").alias("__all"))
    rows = histogram.rollup("class_name").agg(F.sum("count").alias("count")).join(F.broadcast(total))
    return rows.select(F.coalesce("class_name", F.lit("TOTAL")).alias("class_name"), "count", (F.col("count") / frames).alias("per_frame"), F.round(100 * F.col("count") / F.col("__all"), 4).alias("percent"))


def conditions_by(df: DataFrame, key: Column, condition: str, good="good", fair="fair", poor="poor") -> DataFrame:
    n = lambda v: F.count_if(F.col(condition) == v)
    return df.groupBy(key).agg(F.count("*").alias("total"), n(good).alias("good"), n(fair).alias("fair"), n(poor).alias("poor"))


def latency_stats(times: DataFrame, seconds: str, order: str, cost_per_second: float = 0.0004) -> DataFrame:
    """Mean, extremes, rate, first against the mean of the rest (cold start if over twice that), cost."""
    one = times.agg(
        F.count("*").alias("frames"), F.avg(seconds).alias("avg_s"), F.min(seconds).alias("min_s"), F.max(seconds).alias("max_s"),
        F.sum(seconds).alias("total_s"), F.min_by(seconds, order).alias("first_s"),
    )
    rest = F.try_divide(F.col("total_s") - F.col("first_s"), F.col("frames") - 1)
    return one.withColumns({"frames_per_s": F.try_divide("frames", "total_s"), "warm_s": rest, "cold_start": F.col("first_s") > 2 * rest, "cost": F.col("total_s") * cost_per_second})


def status_counts(df: DataFrame, status: str, sets: dict[str, list[str]]) -> DataFrame:
    """One row with a count for each, possibly overlapping, set of states."""
    return df.agg(*[F.count_if(F.col(status).isin(*values)).alias(name) for name, values in sets.items()])


def road_kpis(roads: DataFrame, km: str) -> DataFrame:
    total = F.sum(F.coalesce(F.col(km), F.lit(0.0)))
    return roads.agg(F.count("*").alias("roads"), F.round(total, 2).alias("km"), F.round(F.coalesce(F.try_divide(total, F.count("*")), F.lit(0.0)), 4).alias("mean_km"))


def tile_pyramid(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy("z").agg(F.count("*").alias("tiles"), *[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))])


def bounding_box(points: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    return points.agg(F.min(lat).alias("min_lat"), F.max(lat).alias("max_lat"), F.min(lon).alias("min_lon"), F.max(lon).alias("max_lon"))


def per_second(detections: DataFrame, key: str, seconds: str, order: str, lat: str, lon: str) -> DataFrame:
    """Detections by rounded second with the first one's place."""
    return detections.groupBy(key, F.floor(F.col(seconds) + 0.5).alias("second")).agg(
        F.count("*").alias("detections"), F.min_by(lat, order).alias(lat), F.min_by(lon, order).alias(lon)
    )


def route_summary(rows: DataFrame, route: str, date: str, surveyor: str, condition: str, good="good", fair="fair", poor="poor") -> DataFrame:
    """By route: totals by condition, latest date and its surveyor, and the surveys (newest first) as an array."""
    n = lambda v: F.count_if(F.col(condition) == v)
    days = rows.groupBy(route, date).agg(F.count("*").alias("assets"), F.min(surveyor).alias("surveyor"), n(good).alias("good"), n(fair).alias("fair"), n(poor).alias("poor"))
    surveys = F.sort_array(F.collect_list(F.struct(F.col(date).alias("date"), "assets", "surveyor")), False)
    return days.groupBy(route).agg(
        F.sum("assets").alias("total"), F.sum("good").alias("good"), F.sum("fair").alias("fair"), F.sum("poor").alias("poor"),
        F.max(date).alias("latest"), F.max_by("surveyor", date).alias("latest_surveyor"), surveys.alias("surveys"),
    )


def ranked_text(histogram: DataFrame, name: str, count: str, k: int = 15) -> DataFrame:
    """The k largest classes as one line ``a: n, b: m``."""
    top = histogram.orderBy(F.desc(count), name).limit(k)
    line = F.sort_array(F.collect_list(F.struct((-F.col(count)).alias("n"), F.col(name).alias("name"))))
    return top.agg(F.concat_ws(", ", F.transform(line, lambda x: F.concat(x["name"], F.lit(": "), (-x["n"]).cast("string")))).alias("classes"))


def sorted_distinct(df: DataFrame, c: str) -> DataFrame:
    return df.filter(F.col(c).isNotNull() & (F.col(c).cast("string") != "")).select(c).distinct().orderBy(c)
