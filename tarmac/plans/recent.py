"""Queries on recent rows, linked tracks, dates, leases and other listings, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import aggregates as A
from ..operators import dml as M
from ..operators import filters as S
from ..operators import inference as V
from ..operators import joins as J
from ..operators import ranking as W
from ..operators import shaping as P
from ..streaming import leases as L
from ..streaming import windows as T
from . import roles as R
from .queries import ASSETS, FRAMES, SURVEYS, query


@query(f"""SELECT coalesce(c_name, 'Route ' || route_id) AS road, survey_date AS date, coalesce(n, 0) AS assets, surveyor FROM
 (SELECT * FROM {SURVEYS} ORDER BY survey_date DESC, id LIMIT 5) s LEFT JOIN (SELECT survey_id, count(*) AS n FROM {ASSETS} GROUP BY 1) a ON a.survey_id = s.id
 LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON c_custkey = route_id""")
def recent_surveys(spark, d):
    newest = W.newest(R.surveys(spark, d), 5, "survey_date", "id")
    counts = R.assets(spark, d).groupBy("survey_id").agg(F.count("*").alias("assets"))
    rows = newest.join(counts, F.col("id") == F.col("survey_id"), "left").na.fill(0, ["assets"])
    roads = R.table(spark, d, "customer").filter("c_custkey % 2 = 0")
    named = J.lookup(rows, roads, "route_id", "c_custkey", "c_name", "road", F.concat(F.lit("Route "), F.col("route_id").cast("string")))
    return named.select("road", F.col("survey_date").alias("date"), "assets", "surveyor")


VIDEOS = "(SELECT event_id AS id, user_id AS route_id, ts AS updated_at, event_type AS status, value AS progress FROM events)"


def videos(spark, d):
    return R.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("route_id"), F.col("ts").alias("updated_at"), F.col("event_type").alias("status"), F.col("value").alias("progress"))


@query(f"SELECT id, updated_at FROM {VIDEOS} WHERE status = 'error' ORDER BY updated_at DESC, id LIMIT 5")
def recent_failures(spark, d):
    return W.newest(S.matching(videos(spark, d), status="error"), 5, "updated_at", "id").select("id", "updated_at")


@query(f"SELECT id, status, updated_at FROM {VIDEOS} WHERE status IN ('click', 'view') ORDER BY updated_at DESC, id LIMIT 100")
def newest_jobs(spark, d):
    return W.newest(S.matching(videos(spark, d), status=["click", "view"]), 100, "updated_at", "id").select("id", "status", "updated_at")


@query(f"SELECT survey_id, item, condition FROM {ASSETS} ORDER BY detected_at DESC, survey_id, item LIMIT 10")
def recent_detections(spark, d):
    return R.assets(spark, d).orderBy(F.desc_nulls_last("detected_at"), "survey_id", "item").limit(10).select("survey_id", "item", "condition")


@query(f"""WITH t AS (SELECT o_orderkey AS track, o_custkey AS route_id, 0 AS source FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_custkey, 1 FROM orders WHERE o_orderstatus <> 'F')
 SELECT c_custkey AS route_id, c_name AS road_name, track, source FROM customer JOIN (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY route_id ORDER BY source, track) = 1) t ON t.route_id = c_custkey""")
def tracks_of_roads(spark, d):
    """One track a road, its own before those of its videos."""
    o = R.table(spark, d, "orders").select(F.col("o_orderkey").alias("track"), F.col("o_custkey").alias("route_id"), "o_orderstatus")
    one = W.union_first([o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus <> 'F'")], "route_id", "track").drop("o_orderstatus")
    return R.table(spark, d, "customer").join(one, F.col("c_custkey") == F.col("route_id")).select("route_id", F.col("c_name").alias("road_name"), "track", F.col("source"))


@query(f"""WITH p AS (SELECT video_id, frame_number AS point, 2592000.0 * (row_number() OVER w - 1) / greatest(count(*) OVER (PARTITION BY video_id) - 1, 1) AS seconds FROM {FRAMES}
  WHERE event_type = 'view' WINDOW w AS (PARTITION BY video_id ORDER BY frame_number))
 SELECT p.point, arg_min(c.frame_number, struct_pack(a := abs(c.seconds - p.seconds), b := c.seconds, k := c.frame_number)) AS frame FROM p
 LEFT JOIN (SELECT * FROM {FRAMES} WHERE event_type = 'click') c USING (video_id) GROUP BY 1""")
def frames_of_markers(spark, d):
    """Each marker's frame: the nearest one to the marker's share of the video."""
    f = R.frames(spark, d)
    own = Window.partitionBy("video_id")
    share = (F.row_number().over(own.orderBy("frame_number")) - 1) / F.greatest(F.count("*").over(own) - 1, F.lit(1))
    markers = S.matching(f, event_type="view").select(F.col("frame_number").alias("point"), "video_id", (share * 2592000.0).alias("seconds"))
    frames = S.matching(f, event_type="click").select("video_id", "seconds", F.col("frame_number").alias("frame"))
    return J.nearest_asof(markers, frames, "video_id", "seconds", "frame", ["frame"], span=86_400.0).select("point", "frame")


@query(f"""SELECT c.frame_number, v.frame_number IS NOT NULL AS linked, v.value AS lat, v.seconds AS gpx_timestamp FROM (SELECT * FROM {FRAMES} WHERE event_type = 'click') c
 LEFT JOIN {FRAMES} v ON v.video_id = c.video_id AND v.frame_number = (SELECT arg_min(n.frame_number, struct_pack(a := abs(n.seconds - c.seconds), b := n.seconds, k := n.frame_number)) FROM {FRAMES} n WHERE n.event_type = 'view' AND n.video_id = c.video_id)""")
def frames_linked_by_time(spark, d):
    """Frames with the place of the track point that is nearest in time."""
    f = R.frames(spark, d)
    points = S.matching(f, event_type="view").select("video_id", "seconds", F.col("frame_number").alias("point"), F.col("value").alias("lat"), F.col("value").alias("lon"), F.lit(0.0).alias("altitude"))
    clicks = S.matching(f, event_type="click").select("frame_number", "video_id", "seconds")
    near = J.nearest_asof(clicks, points, "video_id", "seconds", "point", ["lat", "lon", "altitude"], span=86_400.0).withColumnRenamed("matched_seconds", "gpx_timestamp")
    out = M.with_location(near)
    return out.select("frame_number", F.col("location").isNotNull().alias("linked"), F.get(F.col("location.coordinates"), F.lit(1)).alias("lat"), "gpx_timestamp")


@query("SELECT user_id AS video_id, event_id // 50 AS frame, arg_max(event_id, struct_pack(a := ts, b := event_id)) AS id FROM events WHERE event_id // 50 < 40 GROUP BY 1, 2")
def frame_by_number(spark, d):
    """The newest row of each video's frame of a number."""
    rows = R.table(spark, d, "events").select(F.col("user_id").alias("video_id"), F.floor(F.col("event_id") / 50).alias("frame"), "ts", F.col("event_id").alias("id")).filter("frame < 40")
    newest = Window.partitionBy("video_id", "frame").orderBy(F.desc("ts"), F.desc("id"))
    return rows.withColumn("n", F.row_number().over(newest)).filter("n = 1").select("video_id", "frame", "id")


@query(f"SELECT s_name AS road_name, count(a.route_id) AS assets FROM supplier LEFT JOIN (SELECT route_id FROM {ASSETS} WHERE route_id < 1000) a ON a.route_id = s_suppkey GROUP BY s_suppkey, s_name")
def assets_by_code(spark, d):
    """Assets that name their road by a code (R007) counted by road."""
    coded = R.assets(spark, d).filter("route_id < 1000").select(X.route_code(F.col("route_id")).alias("code"))
    counts = coded.groupBy(X.route_number(F.col("code")).alias("number")).agg(F.count("*").alias("assets"))
    return R.roads(spark, d).join(counts, F.col("route_id") == F.col("number"), "left").select("road_name", F.coalesce("assets", F.lit(0)).alias("assets"))


@query(f"SELECT id, route_id FROM {SURVEYS} s WHERE survey_date = CASE WHEN route_id % 3 = 0 THEN DATE '1995-06-01' ELSE (SELECT max(survey_date) FROM {SURVEYS} t WHERE t.route_id = s.route_id) END")
def surveys_of_date(spark, d):
    """A given date's surveys for every third road, the latest ones for the others."""
    wanted = F.when(F.col("route_id") % 3 == 0, F.lit("1995-06-01").cast("date"))
    return W.rows_of_date(R.surveys(spark, d), "route_id", "survey_date", wanted).select("id", "route_id")


@query(f"SELECT c.condition, coalesce(n, 0) AS \"count\" FROM (VALUES ('Good'), ('Fair'), ('Poor'), ('Unknown')) c(condition) LEFT JOIN (SELECT condition, count(*) AS n FROM {ASSETS} GROUP BY 1) USING (condition)")
def conditions_of_domain(spark, d):
    return A.over_domain(R.assets(spark, d), "condition", ["Good", "Fair", "Poor", "Unknown"])


@query("SELECT coalesce(nullif(o_orderstatus, 'P'), 'unknown') AS class_name, count(*) AS \"count\" FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def classes_of_arrays(spark, d):
    o = R.table(spark, d, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("class_name"))
    rows = R.table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    arrays = rows.groupBy("l_orderkey").agg(F.collect_list(F.struct("class_name")).alias("detections"))
    return A.class_histogram(arrays)


@query("SELECT DISTINCT p_type FROM part WHERE p_type <> ''")
def types_listing(spark, d):
    return A.sorted_distinct(R.table(spark, d, "part"), "p_type")


@query("SELECT string_agg(p_brand || ': ' || n, ', ' ORDER BY n DESC, p_brand) AS classes FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15)")
def classes_text(spark, d):
    return A.ranked_text(R.table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n")), "p_brand", "n")


@query(f"""SELECT frame_number, video_id, floor(100 * row_number() OVER w / count(*) OVER (PARTITION BY video_id))::INT AS progress,
 round(CASE WHEN count(*) OVER (PARTITION BY video_id) > 1 THEN (row_number() OVER w - 1) / (count(*) OVER (PARTITION BY video_id) - 1) ELSE 0 END, 6) AS fraction FROM {FRAMES} WINDOW w AS (PARTITION BY video_id ORDER BY frame_number)""")
def track_progress(spark, d):
    rows = W.progress(R.frames(spark, d).select("frame_number", "video_id"), "video_id", "frame_number")
    return rows.withColumn("fraction", F.round("fraction", 6))


@query("SELECT p_brand AS class_name, ((row_number() OVER (ORDER BY first_seen, p_brand) - 1) % 6)::INT AS colour FROM (SELECT p_brand, min(p_partkey) AS first_seen FROM part GROUP BY 1)")
def class_colours(spark, d):
    return W.colours_by_first(R.table(spark, d, "part"), "p_brand", "p_partkey").select(F.col("p_brand").alias("class_name"), "colour")


@query(f"SELECT route_id, max(v) + 1 AS next_version FROM (SELECT route_id, row_number() OVER (PARTITION BY route_id ORDER BY survey_date, id) AS v FROM {SURVEYS}) GROUP BY 1")
def next_versions(spark, d):
    return W.next_version(W.with_versions(R.surveys(spark, d), "route_id", "survey_date", "id"), "route_id").select("route_id", F.col("next_version").cast("long").alias("next_version"))


@query("""SELECT s.id, count(v.id) AS deleted_videos, count(*) FILTER (v.url LIKE '/uploads/%') AS deleted_files, count(*) FILTER (v.url LIKE '%video_library%') AS preserved_files
 FROM (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'P') s LEFT JOIN (SELECT l_orderkey AS survey_id, l_linenumber AS id,
 CASE l_linenumber % 3 WHEN 0 THEN '/video_library/' || l_partkey WHEN 1 THEN '/uploads/' || l_partkey END AS url FROM lineitem) v ON v.survey_id = s.id GROUP BY 1""")
def deleted_counts(spark, d):
    n = F.col("l_linenumber")
    url = F.when(n % 3 == 0, F.concat(F.lit("/video_library/"), "l_partkey")).when(n % 3 == 1, F.concat(F.lit("/uploads/"), "l_partkey"))
    owned = R.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("survey_id"), n.alias("id"), url.alias("storage_url"))
    s = R.surveys(spark, d)
    return M.delete_report(s, owned, s.filter("status = 'P'").select("id"))


KIND = "CASE WHEN event_type = 'click' THEN 'pending' ELSE 'processing' END"


@query(f"""WITH e AS (SELECT user_id AS job, epoch_us(ts) AS us, {KIND} AS status FROM events),
 b AS (SELECT job, min(us) AS t0 FROM e WHERE status = 'pending' GROUP BY 1),
 r AS (SELECT job, t0 AS us FROM b UNION ALL SELECT e.job, e.us FROM e JOIN b USING (job) WHERE e.status = 'processing' AND e.us > b.t0),
 g AS (SELECT job, us, coalesce(lead(us) OVER (PARTITION BY job ORDER BY us), (SELECT max(us) FROM e)) - us AS gap FROM r)
 SELECT job::VARCHAR AS job_id, sum(gap // 86400000000)::BIGINT AS returned, 1 + sum(gap // 86400000000)::BIGINT AS claimed FROM g GROUP BY 1""")
def job_leases(spark, d):
    """How often each job was claimed and came back, with leases of a day: clicks ask for a job, other events are progress."""
    kind = F.when(F.col("event_type") == "click", "pending").otherwise("processing")
    events = R.table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.lit(None).cast("string").alias("video_id"), kind.alias("status"), F.col("ts").alias("at"))
    changes = L.lease_history(events, 86_400, attempts=1 << 30)
    n = lambda c: F.count_if(F.col("change") == c).alias(c)
    return changes.groupBy("job_id").agg(n("returned"), n("claimed"))


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, ts FROM events) GROUP BY 1, 2")
def once_each(spark, d):
    """Events counted once for each user, kind and time."""
    rows = T.event_time(R.table(spark, d, "events")).dropDuplicates(["user_id", "event_type", "ts"])
    return rows.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN lang IS NULL OR lang = '' THEN 'none' ELSE lang END AS lang, lower(trim('  ' || source || ' ')) AS source FROM documents")
def defaults_and_keys(spark, d):
    docs = R.table(spark, d, "documents")
    return docs.select("doc_id", X.or_default(F.col("lang"), "none").alias("lang"), X.email_key(F.concat(F.lit("  "), "source", F.lit(" "))).alias("source"))


@query("""SELECT o_orderkey AS id, 60 * (o_orderkey % 50) + o_orderkey % 60 AS second, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS frame FROM orders""")
def times_in_questions(spark, d):
    """Seconds from ``at 2:05``, frames from ``frame number 45`` where no time is named."""
    k = F.col("o_orderkey")
    clock = F.concat(F.lit("what is at "), (k % 50).cast("string"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit("?"))
    number = F.when(k % 2 == 0, F.concat(F.lit("show frame number "), F.col("o_custkey").cast("string"))).otherwise("show it")
    return R.table(spark, d, "orders").select(k.alias("id"), X.time_asked(clock).cast("long").alias("second"), X.frame_asked(number).cast("long").alias("frame"))


@query("""SELECT l_orderkey AS id, l_linenumber AS item, printf('frame_%06d_%.2fs.jpg', l_partkey, l_linenumber / 4.0) AS path, CASE WHEN l_partkey >= 1500 THEN 1498 ELSE l_partkey END AS shown,
 l_suppkey * 30 AS frame, l_partkey / 25.0 AS seconds, l_quantity * 1920 / 100 AS x, l_returnflag || ': ' || printf('%.2f', l_discount) AS label FROM lineitem""")
def frame_values(spark, d):
    li = R.table(spark, d, "lineitem")
    part, n = F.col("l_partkey"), F.col("l_linenumber")
    box = F.struct(F.col("l_quantity").alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("width"), F.lit(1.0).alias("height"))
    return li.select(
        F.col("l_orderkey").alias("id"), n.alias("item"), X.frame_path(part, n / 4.0).alias("path"), X.frame_in_range(part, F.lit(1500).cast("long")).alias("shown"), X.frame_of(F.col("l_suppkey"), F.lit(30)).alias("frame"),
        X.seconds_of(part, F.lit(25)).alias("seconds"), X.box_pixels(box, F.lit(1920), F.lit(1080))["x"].alias("x"), X.percent_label(F.col("l_returnflag"), F.col("l_discount")).alias("label"),
    )


@query("SELECT o_orderkey AS id, string_agg(k || '=' || v, ',' ORDER BY k) AS models FROM (SELECT l_orderkey AS o_orderkey, l_returnflag AS k, max(l_partkey) AS v FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def models_of_frames(spark, d):
    """A map of each frame's models, as sorted entries."""
    best = R.table(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.max("l_partkey").alias("v"))
    m = J.merged_models(best, "l_orderkey", "l_returnflag", "v")
    text = F.transform(X.sorted_keys(F.col("by_model")), lambda k: F.concat_ws("=", k, F.element_at("by_model", k).cast("string")))
    return m.select(F.col("l_orderkey").alias("id"), F.array_join(text, ",").alias("models"))


@query("SELECT event_id, m AS model FROM events, (VALUES ('roads'), ('signs'), ('lights')) t(m) WHERE event_id % 3 = 0")
def frames_for_models(spark, d):
    every = S.every_nth(R.table(spark, d, "events"), "event_id", 3)
    return V.fan_out(every, ["roads", "signs", "lights"]).select("event_id", "model")


@query("SELECT r.s_suppkey AS route_id, f.n_name AS track FROM (SELECT *, (row_number() OVER (ORDER BY s_suppkey) - 1) % 25 AS i FROM supplier) r JOIN (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation) f USING (i)")
def tracks_in_turn(spark, d):
    """Track files given to roads in turn."""
    files = R.table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("track"))
    return J.round_robin(files, R.roads(spark, d).select("route_id"), "n_nationkey", "route_id").select("route_id", "track")


@query("SELECT c_custkey AS id, coalesce(o.o_orderstatus, 'none') AS status FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1) o ON o_custkey = c_custkey AND c_custkey % 2 = 0")
def backfilled(spark, d):
    last = R.table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderstatus", "o_orderkey").alias("status"))
    rows = R.table(spark, d, "customer").join(last, (F.col("c_custkey") == F.col("o_custkey")) & (F.col("c_custkey") % 2 == 0), "left").select(F.col("c_custkey").alias("id"), "status")
    return M.backfill(rows, "status", F.lit("none"))


@query("SELECT s_suppkey AS route_id, s_acctbal AS km FROM supplier UNION ALL SELECT c_custkey + 50, c_acctbal FROM customer WHERE c_custkey + 50 NOT IN (SELECT s_suppkey FROM supplier)")
def bulk_roads(spark, d):
    """Roads added where their key is new; a missing length is taken from the default."""
    roads = R.roads(spark, d).select("route_id", "km")
    new = R.table(spark, d, "customer").select((F.col("c_custkey") + 50).alias("route_id"), F.col("c_acctbal").alias("km"))
    return M.bulk_insert(roads, new, "route_id", {"km": F.lit(0.0)})


@query("SELECT s_suppkey AS id, regexp_replace(u, '^(/?)(uploads/){2,}', '\\1uploads/') AS path, starts_with(ltrim(u, '/'), 'uploads/uploads/') AS changed FROM (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '/uploads/uploads/' WHEN 1 THEN 'uploads/' ELSE 'uploads/uploads/uploads/' END || s_name AS u FROM supplier)")
def repaired_urls(spark, d):
    k = F.col("s_suppkey")
    start = F.when(k % 3 == 0, "/uploads/uploads/").when(k % 3 == 1, "uploads/").otherwise("uploads/uploads/uploads/")
    rows = R.table(spark, d, "supplier").select(k.alias("id"), F.concat(start, "s_name").alias("path"))
    return M.repaired_paths(rows, ["path"])


@query("SELECT s_suppkey AS route_id, s_name AS road_name, NULL::DOUBLE AS start_lat FROM supplier WHERE s_suppkey = 7")
def road_by_key(spark, d):
    """One road by its key, with typed nulls for what the table lacks."""
    return P.projected(S.matching(R.roads(spark, d), route_id=7), ["route_id", "road_name", "start_lat"], {"start_lat": "double"})


MODEL = ([[0.4, -1.5, 0.02], [-0.3, 0.8, -0.01], [0.1, 0.1, 0.005]], [0.2, -0.5, -0.3])
CLASSES = ["Pothole", "Crack", "Sign"]


def probability(k: int) -> str:
    (a, b, c), d = MODEL[0][k], MODEL[1][k]
    return f"1 / (1 + exp(-({a} * seconds / 1000000 + {b} * detections_count + {c} * value + {d})))"


@query(f"""SELECT frame_number, class_name, round(p, 6) AS confidence FROM (SELECT frame_number, unnest(['Pothole', 'Crack', 'Sign']) AS class_name,
 unnest([{", ".join(probability(k) for k in range(3))}]) AS p FROM {FRAMES}) WHERE p >= 0.25""")
def scored_frames(spark, d):
    """Detections of all frames by a fixed linear model."""
    f = R.frames(spark, d).withColumn("day", F.col("seconds") / 1_000_000)
    scored = V.with_probabilities(f, ["day", "detections_count", "value"], *MODEL)
    found = V.detected(scored, CLASSES).select("frame_number", F.explode("detections").alias("x"))
    return found.select("frame_number", "x.class_name", F.round("x.confidence", 6).alias("confidence"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 0 ELSE 1 END::INT AS n, CASE WHEN event_id % 4 <> 2 THEN json_extract_string(props, '$.k')::INT END AS k,
 CASE WHEN event_id % 4 = 1 THEN 'x' END AS label FROM events""")
def loose_payloads(spark, d):
    """Bare lists, ``predictions`` objects, broken text and single objects, read without a schema."""
    e, props, kind = R.table(spark, d, "events"), F.col("props"), F.col("event_id") % 4
    listed = F.concat(F.lit("["), props, F.lit("]"))
    under = F.concat(F.lit('{"predictions": ['), props, F.lit(', {"label": "x", "k": "no number"}]}'))
    payload = F.when(kind == 0, listed).when(kind == 1, under).when(kind == 2, F.concat(F.lit('{"predictions": ['), props)).otherwise(props)
    rows = e.select("event_id", X.loose_predictions(payload).alias("p"))
    first, second = F.get("p", F.lit(0)), F.get("p", F.lit(1))
    return rows.select("event_id", F.size("p").alias("n"), X.variant_field(first, "k", "int").alias("k"), X.variant_field(second, "label", "string").alias("label"))
