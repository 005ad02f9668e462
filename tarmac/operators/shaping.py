"""Rows in other shapes: listings, reshaped detections, groups within frames, name chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def projected(df: DataFrame, columns: list[str], types: dict[str, str] | None = None) -> DataFrame:
    """These columns in this order; what the table lacks is null, of its type in ``types`` or else a string."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast((types or {}).get(c, "string")).alias(c) for c in columns])


def demo_rows(detections: DataFrame, route: str, *order, prefix: str = "demo") -> DataFrame:
    """Detections as asset rows with ids by their place within the route, from 0."""
    place = F.row_number().over(Window.partitionBy(route).orderBy(*order)) - 1
    return detections.withColumn("id", F.concat_ws("_", F.lit(prefix), F.col(route).cast("string"), place.cast("string")))


def frame_documents(detections: DataFrame, frame: str, fields: list[str], *order: str) -> DataFrame:
    """A row for each frame with its detections as an array of structs, in order, and their number."""
    one = F.struct(*[F.col(c) for c in [*order, *fields]])
    kept = F.transform(F.array_sort(F.collect_list(one)), lambda d: F.struct(*[d[c].alias(c) for c in fields]))
    return detections.groupBy(frame).agg(kept.alias("detections"), F.count("*").alias("detections_count"))


def classes_in_frames(detections: DataFrame, frame: str, category: str, default: str = "Other") -> DataFrame:
    """Detections of each frame counted by category."""
    return detections.groupBy(frame, F.coalesce(F.col(category), F.lit(default)).alias("category")).agg(F.count("*").alias("count"))


def repeated(df: DataFrame, times: Column, number: str = "n") -> DataFrame:
    """Each row as often as ``times`` says, numbered from 1; not at all for 0 or null."""
    return df.withColumn(number, F.explode(F.when(times > 0, F.sequence(F.lit(1), times.cast("int"))).otherwise(F.array().cast("array<int>"))))


def chained_name(df: DataFrame, chain: list[tuple[DataFrame, str, str, str]], out: str, default: str = "Unknown") -> DataFrame:
    """A name by the first lookup that finds one: (table, key of ``df``, key of the table, name)."""
    found = []
    for i, (other, key, other_key, name) in enumerate(chain):
        side = other.select(F.col(other_key).alias(f"__k{i}"), F.col(name).alias(f"__v{i}"))
        df = df.join(side, F.col(key) == F.col(f"__k{i}"), "left").drop(f"__k{i}")
        found.append(F.col(f"__v{i}"))
    return df.withColumn(out, F.coalesce(*found, F.lit(default))).drop(*[f"__v{i}" for i in range(len(chain))])


def latest_by_category(files: DataFrame, category: Column, url: str, order: str) -> DataFrame:
    """The last file of each category."""
    return files.groupBy(category.alias("category")).agg(F.max_by(url, order).alias("url"))


def metadata_totals(frames: DataFrame, count: str) -> DataFrame:
    return frames.agg(F.count("*").alias("frames"), F.coalesce(F.sum(F.coalesce(count, F.lit(0))), F.lit(0)).cast("long").alias("detections"))


def points(tracks: DataFrame, key: str, array: str) -> DataFrame:
    """All points of all tracks under each other, with their place in the track."""
    return tracks.select(key, F.posexplode(array).alias("place", "point"))
