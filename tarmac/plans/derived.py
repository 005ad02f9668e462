"""Queries on keys, paths, boxes, latencies and small updates, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import aggregates as A
from ..operators import dml as M
from ..operators import filters as S
from . import roles as R
from .queries import FRAMES, SURVEYS, query


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS key FROM supplier")
def video_keys(spark, d):
    end = F.when(F.col("s_suppkey") % 2 == 0, ".MP4").otherwise(".mov")
    rows = R.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("/videos/2024/"), "s_name", end).alias("path"))
    return rows.select("id", X.video_key(F.col("path")).alias("key"))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN 'http://host/uploads/' || s_name ELSE '/uploads/' || s_name END AS url FROM supplier")
def upload_urls(spark, d):
    """Paths with one, two or no upload folders, and whole addresses."""
    kind = F.col("s_suppkey") % 4
    start = F.when(kind == 0, "http://host/uploads/").when(kind == 1, "//uploads/uploads/").when(kind == 2, "uploads/").otherwise("")
    return R.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), X.stored_url(F.concat(start, "s_name")).alias("url"))


@query("SELECT l_orderkey AS survey_id, l_linenumber AS item, l_quantity::DOUBLE AS x, l_suppkey::DOUBLE AS y, l_linenumber::DOUBLE AS width, 2.0::DOUBLE AS height FROM lineitem")
def boxes_of_corners(spark, d):
    """Boxes given by two corners, as corner and size."""
    x, y = F.col("l_quantity").cast("double"), F.col("l_suppkey").cast("double")
    corners = F.struct(x.alias("x1"), y.alias("y1"), (x + F.col("l_linenumber")).alias("x2"), (y + 2).alias("y2"))
    box = X.box_xywh(corners)
    rows = R.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("survey_id"), F.col("l_linenumber").alias("item"), box.alias("box"))
    return rows.select("survey_id", "item", "box.*")


@query("""SELECT event_id, key, CASE WHEN key = 'seen' THEN 1.0 WHEN event_type = 'view' THEN 0.0 ELSE value END::DOUBLE AS n FROM
 (SELECT event_id, event_type, value, unnest(['seen', event_type]) AS key FROM events)""")
def maps_merged(spark, d):
    """Entries of two maps; where both have a key the second one's value stays."""
    e = R.table(spark, d, "events")
    own = F.create_map("event_type", F.col("value").cast("double"), F.lit("seen"), F.lit(0.0))
    over = F.when(F.col("event_type") == "view", F.create_map(F.lit("view"), F.lit(0.0), F.lit("seen"), F.lit(1.0))).otherwise(F.create_map(F.lit("seen"), F.lit(1.0)))
    return e.select("event_id", F.explode(X.merged_maps(own, over)).alias("key", "n"))


@query("""SELECT frames, round(total_s / frames, 4) AS avg_s, min_s, max_s, round(total_s, 3) AS total_s, first_s, round(frames / total_s, 6) AS frames_per_s,
 round((total_s - first_s) / (frames - 1), 4) AS warm_s, first_s > 2 * (total_s - first_s) / (frames - 1) AS cold_start, round(total_s * 0.0004, 4) AS cost FROM
 (SELECT count(*) AS frames, sum(value) AS total_s, min(value) AS min_s, max(value) AS max_s, arg_min(value, event_id) AS first_s FROM events)""")
def latencies(spark, d):
    """Mean, extremes, rate, cold start and cost of the frames' seconds."""
    out = A.latency_stats(R.table(spark, d, "events"), "value", "event_id")
    digits = {"avg_s": 4, "total_s": 3, "frames_per_s": 6, "warm_s": 4, "cost": 4}
    return out.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query("""SELECT event_id % 5 AS z, count(*) AS tiles, min(user_id) AS min_x, max(user_id) AS max_x, min(event_id % 97) AS min_y, max(event_id % 97) AS max_y
 FROM events GROUP BY 1""")
def tiles_by_zoom(spark, d):
    tiles = R.table(spark, d, "events").select((F.col("event_id") % 5).alias("z"), F.col("user_id").alias("x"), (F.col("event_id") % 97).alias("y"))
    return A.tile_pyramid(tiles)


@query(f"SELECT min(value) AS min_lat, max(value) AS max_lat, min(seconds) AS min_lon, max(seconds) AS max_lon FROM {FRAMES}")
def bounds_of_points(spark, d):
    return A.bounding_box(R.frames(spark, d), "value", "seconds")


LINES = "(SELECT l_orderkey AS id, count(*) AS n, count(*) FILTER (l_returnflag IN ('R', 'A')) AS wanted, count(*) FILTER (l_returnflag = 'R') AS enabled FROM lineitem GROUP BY 1)"


def lines(spark, d):
    """Orders with an array of their lines."""
    one = F.struct(F.col("l_returnflag").alias("class_name"), (F.col("l_returnflag") == "R").alias("enabled"))
    return R.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(one).alias("lines"))


@query(f"SELECT id, wanted AS chosen, n AS unfiltered FROM {LINES}")
def classes_chosen(spark, d):
    """Detections of chosen classes; without a choice all stay."""
    size = lambda classes: F.size(S.of_classes(F.col("lines"), classes)).cast("long")
    return lines(spark, d).select("id", size(["R", "A"]).alias("chosen"), size([]).alias("unfiltered"))


@query(f"SELECT id, CASE WHEN n = 1 THEN 1 ELSE enabled END AS shown FROM {LINES}")
def keyframes_shown(spark, d):
    return lines(spark, d).select("id", F.size(S.shown_keyframes(F.col("lines"))).cast("long").alias("shown"))


@query("""SELECT event_id, concat_ws(',', CASE WHEN event_id % 3 = 0 THEN 'name' END, CASE WHEN event_id % 2 = 0 THEN 'kind' END) AS missing FROM events
 WHERE event_id % 3 = 0 OR event_id % 2 = 0""")
def incomplete_rows(spark, d):
    """Rows that lack required columns, with these columns' names."""
    name, kind = F.when(F.col("event_id") % 3 != 0, F.col("event_type")), F.when(F.col("event_id") % 2 == 0, "").otherwise(F.col("event_type"))
    rows = R.table(spark, d, "events").select("event_id", name.alias("name"), kind.alias("kind"))
    return rows.withColumn("missing", S.missing_keys("event_id", "name", "kind")).filter(F.size("missing") > 0).select("event_id", F.array_join("missing", ",").alias("missing"))


@query(f"SELECT id, CASE WHEN nullif(route_id % 5, 1) = 0 THEN 'closed' ELSE status END AS status, CASE WHEN nullif(route_id % 5, 1) = 0 THEN upper(surveyor) ELSE surveyor END AS surveyor FROM {SURVEYS}")
def surveys_closed(spark, d):
    """Values and expressions set where a condition holds; an unknown condition leaves the row."""
    where = F.nullif(F.col("route_id") % 5, F.lit(1)) == 0
    return M.update_where(R.surveys(spark, d), where, status="closed", surveyor=F.upper("surveyor")).select("id", "status", "surveyor")


@query("""SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey % 2 = 0
 UNION ALL SELECT s_suppkey, 'new ' || s_name FROM supplier WHERE s_suppkey % 2 <> 0 AND s_suppkey % 3 = 0""")
def roads_appended(spark, d):
    """Repeated new rows are added once, and only under keys that aren't there yet."""
    s = R.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    new = s.filter("id % 3 = 0").withColumn("name", F.concat(F.lit("new "), "name"))
    return M.append_new(s.filter("id % 2 = 0"), new.unionByName(new), "id")


@query(f"SELECT id, route_id FROM {SURVEYS} WHERE id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def surveys_left(spark, d):
    gone = R.table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("id"))
    return M.delete_keys(R.surveys(spark, d), gone, "id").select("id", "route_id")


@query("SELECT c_custkey AS k, c_name AS id, CAST(floor(c_acctbal + 0.5) AS BIGINT) AS whole FROM customer")
def plain_ids(spark, d):
    """Ids given plainly or as extended JSON, and balances rounded half up."""
    c = R.table(spark, d, "customer")
    key = F.when(F.col("c_custkey") % 2 == 0, F.to_json(F.struct(F.col("c_name").alias("$oid")))).otherwise(F.col("c_name"))
    return c.select(F.col("c_custkey").alias("k"), X.object_id(key).alias("id"), X.half_up(F.col("c_acctbal")).cast("long").alias("whole"))


MEDIA_CASE = """CASE s_suppkey % 5 WHEN 0 THEN 'video/mp4' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'application/gpx+xml' ELSE 'application/octet-stream' END"""


@query(f"SELECT s_suppkey AS id, {MEDIA_CASE} AS media_type, 'data:' || {MEDIA_CASE} || ';base64,' || base64(s_name::BLOB) AS url FROM supplier")
def media_of_files(spark, d):
    """Media types by extension, whatever its case; others and names without one are plain bytes."""
    kind = F.col("s_suppkey") % 5
    path = F.concat(F.lit("a.b/"), "s_name", F.when(kind == 0, ".MP4").when(kind == 1, ".jpeg").when(kind == 2, ".gpx").when(kind == 3, ".xyz").otherwise(""))
    rows = R.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), path.alias("path"), "s_name")
    return rows.select("id", X.media_type(F.col("path")).alias("media_type"), X.data_url(F.col("path"), F.col("s_name").cast("binary")).alias("url"))


@query("""SELECT l_orderkey AS survey_id, l_linenumber AS item, CASE l_returnflag WHEN 'R' THEN 'poor' WHEN 'A' THEN 'fair' ELSE 'good' END AS condition FROM lineitem""")
def conditions_of_choices(spark, d):
    """The condition named by the first choice that ends in a known word."""
    flag = F.col("l_returnflag")
    word = F.when(flag == "R", F.when(F.col("l_linenumber") % 2 == 0, "Damaged").otherwise("Missing")).when(flag == "A", "Fair").otherwise("Blue")
    choices = F.array(F.lit("Sign-Large"), F.concat(F.lit("Sign-Wide-"), word), F.lit("Sign-Good"))
    return R.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("survey_id"), F.col("l_linenumber").alias("item"), X.condition_of(choices).alias("condition"))


@query("""SELECT c_custkey AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 'Admin' WHEN 'MACHINERY' THEN 'Asset Manager' WHEN 'HOUSEHOLD' THEN 'Viewer' ELSE 'Road Surveyor' END AS role FROM customer""")
def role_names(spark, d):
    """Display names of canonical roles; unknown and missing ones are road surveyors."""
    kind = F.col("c_mktsegment")
    role = F.when(kind == "BUILDING", "ADMIN").when(kind == "MACHINERY", "asset_manager").when(kind == "HOUSEHOLD", "viewer").when(kind == "FURNITURE", "guest")
    return R.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), X.role_name(role).alias("role"))


@query(f"SELECT id, route_id, status FROM {SURVEYS}")
def columns_allowed(spark, d):
    """Only the columns that may be written, in the table's order, whatever else was sent."""
    sent = R.surveys(spark, d).withColumns({"is_admin": F.lit(True), "password": F.lit("x")})
    return S.allowed_columns(sent, ["status", "id", "route_id", "unknown"])
