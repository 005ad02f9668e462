"""Updates and deletes as copy-on-write: each gives a new snapshot of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import absent, first_per_key, present
from .ranking import with_latest, with_versions


def merge_update(table: DataFrame, changes: DataFrame, key: str, touch: str | None = None, now: Column | None = None, set_null: tuple[str, ...] = ()) -> DataFrame:
    """Changed columns of matching rows; null in ``changes`` leaves a value, but is set in the columns ``set_null``.

    Keys in ``changes`` are unique.
    """
    cols = [c for c in changes.columns if c != key and c in table.columns]
    right = changes.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in cols])
    out = table.join(right, F.col(key) == F.col("__k"), "left")
    new = {c: F.when(F.col("__k").isNotNull(), F.col(f"__{c}")).otherwise(F.col(c)) if c in set_null else F.coalesce(F.col(f"__{c}"), F.col(c)) for c in cols}
    out = out.withColumns(new)
    if touch:
        out = out.withColumn(touch, F.when(F.col("__k").isNotNull(), now if now is not None else F.current_timestamp()).otherwise(F.col(touch)))
    return out.select(*table.columns)


def update_where(table: DataFrame, where: Column, **values) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    return table.withColumns({c: F.when(hit, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def append_new(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't there yet are added."""
    return table.unionByName(absent(rows.dropDuplicates([key]), table, key))


def delete_keys(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return absent(table, gone, key)


def delete_surveys(surveys: DataFrame, videos: DataFrame, frames: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """Cascade: surveys, their videos and frames; each route's newest survey by date becomes the latest."""
    lost = present(videos, gone, "survey_id", "id")
    left = delete_keys(surveys, gone.select("id"), "id")
    return {
        "surveys": with_latest(left.drop("is_latest"), "route_id", F.desc("survey_date"), F.desc("id")),
        "videos": absent(videos, lost, "id"),
        "frames": absent(absent(frames, lost, "video_id", "id"), gone, "survey_id", "id"),
    }


def deleted_files(videos: DataFrame, gone: DataFrame, library: str = "video_library", top: str = "uploads/") -> DataFrame:
    """(survey_id, id, path, kept) for the files of deleted surveys' videos: those of the library are kept.

    A video's own file comes with its thumbnail and track; a path is given below the upload folder.
    """
    lost = present(videos, gone, "survey_id", "id")
    url = F.coalesce(F.col("storage_url"), F.lit(""))
    stays = url.contains(library) | (url == "")
    files = F.when(stays, F.array(url)).otherwise(F.array("storage_url", "thumbnail_url", "gpx_file_url"))
    each = lost.select("survey_id", "id", stays.alias("kept"), F.explode(files).alias("path")).filter("path <> ''")
    below = F.regexp_replace(F.regexp_replace("path", "^/+", ""), f"^{top}", "")
    return each.select("survey_id", "id", F.when(F.col("kept"), F.col("path")).otherwise(below).alias("path"), "kept")


def delete_report(surveys: DataFrame, videos: DataFrame, gone: DataFrame, library: str = "video_library") -> DataFrame:
    """One row a deleted survey: its videos, files to delete and files of the library that stay."""
    lost = present(videos, gone, "survey_id", "id")
    own = F.coalesce(F.col("storage_url"), F.lit(""))
    counts = lost.groupBy("survey_id").agg(
        F.count("*").alias("deleted_videos"), F.count_if((own != "") & ~own.contains(library)).alias("deleted_files"), F.count_if(own.contains(library)).alias("preserved_files")
    )
    rows = present(surveys.select("id"), gone, "id").join(counts, F.col("id") == F.col("survey_id"), "left").drop("survey_id")
    return rows.na.fill(0, ["deleted_videos", "deleted_files", "preserved_files"])


def rewrite_changed(path: str, part: str, table: DataFrame, changed: DataFrame) -> None:
    """Write the rows of ``table`` (a new snapshot of what lies at ``path``) whose partition holds a changed row.

    ``changed`` has the partitions (column ``part``) that an update touched, before or after it.  Others' files stay;
    a partition that lost all its rows goes.  Partition values are plain words or numbers.  The new rows are written aside first, as they may come from ``path``.
    """
    import uuid

    spark = table.sparkSession
    # as many values as partitions at most, held here because the files they are read from go
    hit = [r[0] for r in changed.select(part).distinct().collect()]
    rows = table.filter(F.col(part).isin(hit))
    aside = f"{path.rstrip('/')}/.new-{uuid.uuid4().hex}"
    rows.write.partitionBy(part).parquet(aside)
    fresh = spark.read.schema(table.schema).parquet(aside)
    fresh.select(*table.columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    left = {r[0] for r in fresh.select(part).distinct().collect()}
    for value in set(hit) - left:
        where = jvm.org.apache.hadoop.fs.Path(f"{path}/{part}={value}")
        where.getFileSystem(conf).delete(where, True)
    where = jvm.org.apache.hadoop.fs.Path(aside)
    where.getFileSystem(conf).delete(where, True)


def backfill(table: DataFrame, c: str, value: Column) -> DataFrame:
    return table.withColumn(c, F.coalesce(F.col(c), value))


def repaired_paths(table: DataFrame, cols: list[str]) -> DataFrame:
    """A prefix that stands twice is cut to one; ``changed`` tells which rows it touched."""
    fixed = {c: F.regexp_replace(F.col(c), "^(/?)(?:uploads/){2,}", "$1uploads/") for c in cols}
    changed = F.lit(False)
    for c, new in fixed.items():
        changed = changed | F.coalesce(new != F.col(c), F.lit(False))
    return table.withColumn("changed", changed).withColumns(fixed)


def bulk_insert(table: DataFrame, rows: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """Rows with defaults for what they lack are added; keys that are there already, or stand twice, are tolerated."""
    given = {c: F.coalesce(F.col(c), v) if c in rows.columns else v for c, v in defaults.items()}
    return append_new(table, rows.withColumns(given), key)


def set_by_title(table: DataFrame, title: str, key: str, changes: DataFrame) -> DataFrame:
    """``changes`` (title and new values) go to the first row of each title, by key."""
    first = first_per_key(table.join(changes.select(title), title, "left_semi"), title, key).select(key, title)
    return merge_update(table, first.join(changes, title).drop(title), key)


def with_location(frames: DataFrame, lat: str = "lat", lon: str = "lon", altitude: str = "altitude", time: str = "gpx_timestamp") -> DataFrame:
    """Frames that an as-of join linked: a point as ``location`` (null without one), altitude and time."""
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates"))
    linked = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    kept = [c for c in frames.columns if c not in (lat, lon, altitude, time)]
    return frames.select(*kept, F.when(linked, point).alias("location"), F.col(altitude).alias("altitude"), F.col(time).alias("gpx_timestamp"))


def create_surveys(surveys: DataFrame, new: DataFrame) -> DataFrame:
    """New surveys join the old ones; versions by date and the latest flag of each route are set anew."""
    rows = surveys.unionByName(new, allowMissingColumns=True).drop("survey_version", "is_latest")
    return with_latest(with_versions(rows, "route_id", "survey_date", "id"), "route_id", F.desc("survey_date"), F.desc("id"))


def add_messages(chats: DataFrame, messages: DataFrame, new: DataFrame, preview: int = 200) -> tuple[DataFrame, DataFrame]:
    """(chats, messages) after new messages (id, chat_id, content, created_at): each chat shows its newest one."""
    newest = new.groupBy(F.col("chat_id").alias("id")).agg(
        F.max("created_at").alias("updated_at"), F.max_by(F.substring("content", 1, preview), F.struct("created_at", "id")).alias("last_message_preview")
    )
    return merge_update(chats, newest, "id"), messages.unionByName(new)
