"""Annotation tasks to detections: rectangles with their keyframes, joined to the choices of the same id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import condition_of, steady_confidence, video_key
from .filters import shown_keyframes


def detections(tasks: DataFrame, video: str | None = None) -> DataFrame:
    """A row for each shown keyframe: task, video, class, condition, frame, seconds, box, confidence.

    Choices are aggregated by (task, annotation, id) before the join, so nothing multiplies.
    """
    rows = tasks.withColumn("video", video_key(F.col("data.video")))
    if video:
        rows = rows.filter(F.col("video") == video)
    keep = ["video", "category"] if "category" in tasks.columns else ["video"]
    each = rows.select("id", *keep, F.posexplode("annotations").alias("a_pos", "a")).select("id", *keep, "a_pos", F.posexplode("a.result").alias("r_pos", "r"))
    key = ["id", "a_pos", F.col("r.id").alias("result_id")]
    boxes = each.filter("r.type = 'videorectangle'").select(*key, *keep, "r_pos", F.get("r.value.labels", F.lit(0)).alias("class_name"), "r.value.sequence")
    picked = each.filter("r.type = 'choices'").select(*key, "r_pos", F.col("r.value.choices").alias("choices"))
    chosen = picked.groupBy("id", "a_pos", "result_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("r_pos", "choices"))), lambda x: x["choices"])).alias("choices"))
    both = boxes.join(chosen, ["id", "a_pos", "result_id"], "left").withColumn("condition", F.coalesce(condition_of(F.col("choices")), F.lit("good")))
    s = both.withColumn("s", F.explode(shown_keyframes(F.col("sequence"))))
    box = F.struct(*[F.col(f"s.{c}").alias(c) for c in ("x", "y", "width", "height")])
    return s.select("id", *keep, "result_id", "class_name", "condition", F.col("s.frame").alias("frame"), F.col("s.time").alias("timestamp"), box.alias("bbox"), steady_confidence(F.concat_ws("/", "id", "result_id", "s.frame")).alias("confidence"))
