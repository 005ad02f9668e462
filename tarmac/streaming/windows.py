"""Event-time windows, alike on streams and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_time(df: DataFrame, c: str = "ts", late: str | None = None) -> DataFrame:
    """``c`` as timestamp (watermarks need one), with a watermark on request."""
    out = df.withColumn(c, F.col(c).cast("timestamp"))
    return out.withWatermark(c, late) if late else out


def per_window(df: DataFrame, c: str, length: str, keys: list[str], value: str, slide: str | None = None) -> DataFrame:
    """Tumbling windows, or sliding ones with ``slide``."""
    w = F.window(c, length, slide) if slide else F.window(c, length)
    out = df.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("events"), F.round(F.sum(value), 2).alias("total"))
    return out.select(F.col("w.start").alias("start"), *keys, "events", "total")


def sessions(df: DataFrame, c: str, gap: str, key: str) -> DataFrame:
    out = df.groupBy(F.session_window(c, gap).alias("w"), key).agg(F.count("*").alias("events"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def once_within(df: DataFrame, keys: list[str], c: str, late: str) -> DataFrame:
    """Each key once within the watermark (streams)."""
    return df.withWatermark(c, late).dropDuplicatesWithinWatermark(keys)


def near_pairs(left: DataFrame, right: DataFrame, key: str, time: str, seconds: float, late: str = "10 minutes") -> DataFrame:
    """Pairs of a key less than ``seconds`` apart in time, of two streams or tables; right columns get the prefix ``r_``.

    Watermarks on both sides let a stream forget rows that no coming row can meet: state is bounded by the width and the
    lateness, whatever the length of the streams.  Rows later than that are dropped (``late_rows`` counts them).
    """
    a = left.withWatermark(time, late)
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).withWatermark(f"r_{time}", late)
    width = F.expr(f"interval {seconds} seconds")
    near = (F.col(f"r_{time}") > F.col(time) - width) & (F.col(f"r_{time}") < F.col(time) + width)
    return a.join(b, (F.col(key) == F.col(f"r_{key}")) & near)


def late_rows(query) -> int:
    """Rows that a stream's operators have dropped as too late, over the progress that it still knows."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
