"""Queries on listings, reshaped rows, name chains, pages and updates, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import dml as M
from ..operators import filters as S
from ..operators import joins as J
from ..operators import ranking as W
from ..operators import shaping as P
from ..streaming import jobs as Q
from . import roles as R
from .queries import ASSETS, FRAMES, SURVEYS, query

VERSIONED = f"""(SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY survey_date, id) AS survey_version,
 row_number() OVER (PARTITION BY route_id ORDER BY survey_date DESC, id DESC) = 1 AS is_latest FROM {SURVEYS})"""


def versioned(spark, d):
    rows = W.with_versions(R.surveys(spark, d), "route_id", "survey_date", "id")
    return W.with_latest(rows, "route_id", F.desc("survey_date"), F.desc("id"))


@query("SELECT s_suppkey AS route_id, s_name AS road_name, NULL::VARCHAR AS start_point_name, s_acctbal AS km FROM supplier")
def road_listing(spark, d):
    return P.projected(R.roads(spark, d), ["route_id", "road_name", "start_point_name", "km"])


@query(f"SELECT frame_number, (SELECT count(*) FROM {FRAMES}) AS total, (SELECT ceil(count(*) / 100.0)::BIGINT FROM {FRAMES}) AS pages FROM {FRAMES} ORDER BY frame_number LIMIT 100 OFFSET 100")
def frames_page_total(spark, d):
    return W.page_with_total(R.frames(spark, d).select("frame_number"), 2, 100, "frame_number")


@query("""SELECT o_orderkey AS id, coalesce(a.n_name, b.n_name, 'Unknown') AS road_name, printf('%.2f MB', o_totalprice / 1048576.0) AS size, (o_orderkey // 60) || ':' || lpad((o_orderkey % 60)::VARCHAR, 2, '0') AS duration
 FROM orders LEFT JOIN nation a ON a.n_nationkey = CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey % 40 END LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 5 <> 0 LEFT JOIN nation b ON b.n_nationkey = c_nationkey""")
def video_list(spark, d):
    o, nation = R.table(spark, d, "orders"), R.table(spark, d, "nation")
    videos = o.withColumn("route_id", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey") % 40))
    surveys = R.table(spark, d, "customer").filter("c_custkey % 5 <> 0").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    named = P.chained_name(videos, [(nation, "route_id", "n_nationkey", "n_name"), (surveys, "o_custkey", "c_custkey", "n_name")], "road_name")
    return named.select(F.col("o_orderkey").alias("id"), "road_name", X.megabytes(F.col("o_totalprice")).alias("size"), X.minutes_seconds(F.col("o_orderkey")).alias("duration"))


@query(f"SELECT survey_id, item, 'demo_' || route_id || '_' || (row_number() OVER (PARTITION BY route_id ORDER BY survey_id, item, part, condition, confidence, detected_at) - 1) AS id FROM {ASSETS}")
def demo_assets(spark, d):
    return P.demo_rows(R.assets(spark, d), "route_id", "survey_id", "item", "part", "condition", "confidence", "detected_at").select("survey_id", "item", "id")


@query(f"SELECT survey_id, count(*) AS detections_count, string_agg(condition, ',' ORDER BY item, part, condition) AS conditions FROM {ASSETS} GROUP BY 1")
def frame_documents(spark, d):
    rows = P.frame_documents(R.assets(spark, d), "survey_id", ["condition"], "item", "part")
    return rows.select("survey_id", "detections_count", F.array_join(F.transform("detections", lambda x: x["condition"]), ",").alias("conditions"))


@query(f"""SELECT c.frame_number, coalesce(string_agg(v.frame_number::VARCHAR, ',' ORDER BY v.frame_number), '') AS near FROM (SELECT * FROM {FRAMES} WHERE event_type = 'click') c
 LEFT JOIN (SELECT * FROM {FRAMES} WHERE event_type = 'view') v ON v.video_id = c.video_id AND abs(v.seconds - c.seconds) < 3600 GROUP BY 1""")
def frames_near_points(spark, d):
    f = R.frames(spark, d)
    rows = J.band_lists(S.matching(f, event_type="click"), S.matching(f, event_type="view"), "video_id", "seconds", 3600.0, "frame_number", "frame_number")
    return rows.select("frame_number", F.array_join(F.col("values").cast("array<string>"), ",").alias("near"))


@query("SELECT s_suppkey AS route_id, n FROM supplier, range(1, 4) r(n) WHERE n <= s_nationkey % 4")
def seeded_assets(spark, d):
    return P.repeated(R.roads(spark, d), F.col("road_type") % 4).select("route_id", F.col("n").cast("long").alias("n"))


@query("""SELECT CASE WHEN starts_with(p_brand, 'Brand#1') THEN 'Brand#1' WHEN starts_with(p_brand, 'Brand#12') THEN 'Brand#12' WHEN starts_with(p_brand, 'Brand#3') THEN 'Brand#3' ELSE 'default' END AS category,
 arg_max(p_name, p_partkey) AS url FROM part GROUP BY 1""")
def category_videos(spark, d):
    category = X.prefix_category(F.col("p_brand"), ["Brand#1", "Brand#12", "Brand#3"])
    return P.latest_by_category(R.table(spark, d, "part"), category, "p_name", "p_partkey")


@query(f"SELECT count(*) AS frames, coalesce(sum(coalesce(detections_count, 0)), 0)::BIGINT AS detections FROM {FRAMES}")
def metadata_totals(spark, d):
    return P.metadata_totals(R.frames(spark, d), "detections_count")


@query(f"SELECT id, route_id FROM {SURVEYS} s WHERE survey_date = (SELECT max(survey_date) FROM {SURVEYS} t WHERE t.route_id = s.route_id)")
def latest_survey_rows(spark, d):
    return W.latest_rows(R.surveys(spark, d), "route_id", "survey_date").select("id", "route_id")


@query(f"SELECT survey_id, coalesce(nullif(condition, 'Good'), 'Other') AS category, count(*) AS \"count\" FROM {ASSETS} GROUP BY 1, 2")
def classes_in_frames(spark, d):
    rows = R.assets(spark, d).withColumn("condition", F.nullif("condition", F.lit("Good")))
    return P.classes_in_frames(rows, "survey_id", "condition")


@query(f"SELECT sum(n)::BIGINT AS total FROM (SELECT count(*) n FROM {ASSETS} WHERE condition <> 'Good' GROUP BY condition)")
def donut_total(spark, d):
    return R.assets(spark, d).filter("condition <> 'Good'").groupBy("condition").count().agg(F.sum("count").alias("total"))


@query(f"SELECT id, survey_version FROM {VERSIONED} WHERE route_id = 7 ORDER BY survey_version DESC")
def route_history(spark, d):
    return W.history(versioned(spark, d), "route_id", 7).select("id", "survey_version")


@query(f"SELECT route_id, count(*) AS anomalies FROM {ASSETS} WHERE condition = 'Poor' AND confidence > 0.08 GROUP BY 1 HAVING count(*) > 0 ORDER BY 2 DESC, 1 LIMIT 10")
def top_positive(spark, d):
    from ..operators import aggregates as A

    return A.top_groups(R.assets(spark, d).filter("condition = 'Poor' and confidence > 0.08"), "route_id", 10, "anomalies")


@query("SELECT s_name FROM supplier ORDER BY regexp_extract(s_name, '(\\d+)$', 1)::BIGINT DESC LIMIT 10")
def roads_by_number(spark, d):
    return R.table(spark, d, "supplier").orderBy(X.number_in(F.col("s_name")).desc()).limit(10).select("s_name")


@query(f"SELECT id, route_id FROM {VERSIONED} WHERE is_latest AND status = 'O'")
def surveys_listing(spark, d):
    return S.surveys_listing(versioned(spark, d), status="O").select("id", "route_id")


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 7")
def own_rows(spark, d):
    return S.visible_to(R.table(spark, d, "orders"), "o_custkey", 7, "viewer").select("o_orderkey")


@query("SELECT page_id FROM pages WHERE contains(url, 'example')")
def path_contains(spark, d):
    return R.table(spark, d, "pages").filter(F.col("url").contains("example")).select("page_id")


@query("SELECT doc_id FROM documents WHERE nullif(lang, 'en') IS NULL")
def lacking_text(spark, d):
    rows = R.table(spark, d, "documents").withColumn("lang", F.nullif("lang", F.lit("en")))
    return S.lacking(rows, "lang").select("doc_id")


@query(f"""WITH gone AS (SELECT id FROM {SURVEYS} WHERE status = 'P'), v AS (SELECT l_orderkey AS survey_id, l_orderkey * 10 + l_linenumber AS id FROM lineitem),
 lost AS (SELECT id FROM v WHERE survey_id IN (SELECT id FROM gone)), f AS (SELECT event_id AS id, event_id * 10 + 1 AS video_id, event_id AS survey_id FROM events)
 SELECT 'surveys' AS part, count(*) AS n FROM {SURVEYS} WHERE status <> 'P' UNION ALL SELECT 'videos', count(*) FROM v WHERE id NOT IN (SELECT id FROM lost)
 UNION ALL SELECT 'frames', count(*) FROM f WHERE video_id NOT IN (SELECT id FROM lost) AND survey_id NOT IN (SELECT id FROM gone)""")
def deleted_cascade(spark, d):
    s = R.surveys(spark, d).withColumn("is_latest", F.lit(False))
    videos = R.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("survey_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    frames = R.table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("event_id") * 10 + 1).alias("video_id"), F.col("event_id").alias("survey_id"))
    out = M.delete_surveys(s, videos, frames, s.filter("status = 'P'").select("id"))
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n") for part, df in out.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("""WITH r AS (SELECT s_suppkey, s_name, abs(s_acctbal) / 100 AS km, 2 * pi() * s_suppkey / 1000 AS a FROM supplier)
 SELECT s_suppkey AS route_id, CASE WHEN km >= 50 THEN 'National/Expressway' WHEN km >= 15 THEN 'Municipal/Urban Road' ELSE 'Local Access Road' END AS class,
 s_name || CASE WHEN contains(s_name, 'Rd') OR contains(s_name, 'Road') THEN ' Start' WHEN contains(s_name, 'St') THEN ' North' ELSE ' Point A' END AS start_name,
 round(25.25 + least(km / 100, 0.5) * cos(a), 6) AS start_lat, round(51.5 + least(km / 100, 0.5) * sin(a), 6) AS start_lng,
 round(25.25 + (least(km / 100, 0.5) + km / 150) * cos(a + 0.2), 6) AS end_lat, round(51.5 + (least(km / 100, 0.5) + km / 150) * sin(a + 0.2), 6) AS end_lng FROM r""")
def road_attributes(spark, d):
    r = R.roads(spark, d).withColumn("km", F.abs("km") / 100)
    ends = X.road_ends(25.25, 51.5, 2 * F.pi() * F.col("route_id") / 1000, F.col("km"))
    return r.withColumn("ends", ends).select("route_id", X.road_class(F.col("km")).alias("class"), X.endpoint_names(F.col("road_name"))["start_name"].alias("start_name"), "ends.*")


NAMED = "(SELECT p_partkey, p_brand || CASE WHEN p_partkey % 7 = 0 THEN '_' || (p_partkey % 9) ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN '.mp4' ELSE '' END AS name FROM part)"


@query(f"""WITH n AS (SELECT p_partkey, name, rtrim(replace(name, '.mp4', '')) AS stem, CASE WHEN contains(name, '.mp4') THEN '.mp4' ELSE '' END AS ending FROM {NAMED}),
 k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY p_partkey) - 1 AS j, count(*) OVER (PARTITION BY name) AS m FROM n),
 u AS (SELECT name, stem, ending, list(p_partkey ORDER BY p_partkey) AS ids FROM n GROUP BY 1, 2, 3),
 t AS (SELECT u.name, len(u.ids) AS m, coalesce(list(DISTINCT substring(v.stem, length(u.stem) + 2)::BIGINT) FILTER (v.stem IS NOT NULL), []) AS used
  FROM u LEFT JOIN n v ON v.ending = u.ending AND starts_with(v.stem, u.stem || '_') AND regexp_full_match(substring(v.stem, length(u.stem) + 2), '[1-9][0-9]*') GROUP BY 1, 2)
 SELECT p_partkey, CASE WHEN j = 0 THEN k.name ELSE stem || '_' || list_filter(range(1, t.m + len(used) + 1), lambda x: NOT list_contains(used, x))[j] || ending END AS unique_name FROM k JOIN t USING (name)""")
def unique_names(spark, d):
    key = F.col("p_partkey")
    numbered = F.when(key % 7 == 0, F.concat(F.lit("_"), (key % 9).cast("string"))).otherwise("")
    name = F.concat("p_brand", numbered, F.when(key % 5 == 0, ".mp4").otherwise(""))
    return W.unique_names(R.table(spark, d, "part").select("p_partkey", name.alias("name")), "name", "p_partkey").select("p_partkey", "unique_name")


@query("""SELECT o_orderkey AS id, left(o_orderpriority, 3) AS preview, CASE WHEN o_totalprice / 400000 > 0.8 THEN 'good' WHEN o_totalprice / 400000 BETWEEN 0.5 AND 0.8 THEN 'fair' WHEN o_totalprice / 400000 < 0.5 THEN 'poor' END AS band,
 (o_orderkey * least(1.0, 640.0 / greatest(o_orderkey, o_custkey)))::DOUBLE AS w, CASE o_orderstatus WHEN 'O' THEN 'blue' WHEN 'F' THEN 'green' ELSE 'grey' END AS colour, o_orderdate::DATE - 7 AS week_before,
 CASE o_orderstatus WHEN 'O' THEN 'admin' ELSE 'road_surveyor' END AS role FROM orders""")
def shaped_orders(spark, d):
    o = R.table(spark, d, "orders")
    status = F.col("o_orderstatus")
    side = F.col("o_orderkey") * F.least(F.lit(1.0), F.lit(640.0) / F.greatest("o_orderkey", "o_custkey"))
    return o.select(
        F.col("o_orderkey").alias("id"), X.preview(F.col("o_orderpriority"), 3).alias("preview"), X.band_of(F.col("o_totalprice") / 400000, F.lit("good:>0.8,fair:0.5-0.8,poor:<0.5")).alias("band"),
        side.alias("w"), X.style(status, {"O": "blue", "F": "green"}, "grey").alias("colour"), F.date_sub(F.to_date("o_orderdate"), 7).alias("week_before"),
        X.canonical_role(F.when(status == "O", "Admin").otherwise("someone")).alias("role"),
    )


@query("""SELECT l_orderkey AS id, string_agg(f || ':' || n, ',' ORDER BY f) AS counts FROM (SELECT l_orderkey, l_returnflag f, count(*) n FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def summed_maps(spark, d):
    li = R.table(spark, d, "lineitem").withColumn("odd", F.col("l_linenumber") % 2)
    counts = li.groupBy("l_orderkey", "odd", "l_returnflag").agg(F.count("*").alias("n"))
    maps = counts.groupBy("l_orderkey").agg(*[F.map_from_entries(F.collect_list(F.when(F.col("odd") == k, F.struct("l_returnflag", "n")))).alias(f"m{k}") for k in (0, 1)])
    both = maps.withColumn("m", X.summed_maps(F.col("m0"), F.col("m1")))
    text = F.transform(X.sorted_keys(F.col("m")), lambda k: F.concat_ws(":", k, F.element_at("m", k).cast("string")))
    return both.select(F.col("l_orderkey").alias("id"), F.array_join(text, ",").alias("counts"))


@query("SELECT user_id AS video_id, event_id, coalesce(CASE WHEN props LIKE '[%' THEN 0 END, json_extract_string(props, '$.k')::INT) AS k FROM events")
def json_payloads(spark, d):
    e = R.table(spark, d, "events")
    wrapped = F.concat(F.lit('{"predictions":['), F.col("props"), F.lit("]}"))
    return e.select(F.col("user_id").alias("video_id"), "event_id", F.get(X.predictions(wrapped, "struct<k:int>"), F.lit(0))["k"].alias("k"))


@query(f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY road_type ORDER BY route_id) k FROM (SELECT s_suppkey route_id, s_nationkey road_type, s_acctbal km FROM supplier))
 SELECT route_id, road_type, CASE WHEN k = 1 AND road_type IN (3, 4) THEN -1.0::DOUBLE ELSE km END AS km FROM n""")
def set_by_title(spark, d):
    roads = R.roads(spark, d).select("route_id", "road_type", "km")
    changes = roads.filter("road_type in (3, 4)").select("road_type").distinct().withColumn("km", F.lit(-1.0))
    return M.set_by_title(roads, "road_type", "route_id", changes)


@query(f"""SELECT id, route_id, row_number() OVER (PARTITION BY route_id ORDER BY survey_date, id) AS survey_version, row_number() OVER (PARTITION BY route_id ORDER BY survey_date DESC, id DESC) = 1 AS is_latest
 FROM (SELECT id, route_id, survey_date FROM {SURVEYS} UNION ALL SELECT id + 10000000, route_id, survey_date + 3000 FROM {SURVEYS} WHERE route_id < 20)""")
def created_surveys(spark, d):
    s = versioned(spark, d).select("id", "route_id", "survey_date", "survey_version", "is_latest")
    new = s.filter("route_id < 20").select((F.col("id") + 10000000).alias("id"), "route_id", F.date_add("survey_date", 3000).alias("survey_date"))
    return M.create_surveys(s, new).select("id", "route_id", "survey_version", "is_latest")


@query("SELECT conv_id AS id, CASE WHEN max(turn) > 2 THEN left(arg_max(text, turn), 20) END AS last_message_preview FROM conversations GROUP BY 1")
def touched_chats(spark, d):
    c = R.table(spark, d, "conversations")
    chats = c.groupBy(F.col("conv_id").alias("id")).agg(F.lit(None).cast("string").alias("last_message_preview"), F.lit(None).cast("long").alias("updated_at"))
    rows = c.select(F.col("turn").alias("id"), F.col("conv_id").alias("chat_id"), F.col("text").alias("content"), F.col("turn").alias("created_at"))
    out, _ = M.add_messages(chats, rows.limit(0), rows.filter("created_at > 2"), 20)
    return out.select("id", "last_message_preview")


@query(f"""SELECT c.frame_number, v.frame_number IS NOT NULL AS linked, v.value AS lat FROM (SELECT * FROM {FRAMES} WHERE event_type = 'click') c
 LEFT JOIN {FRAMES} v ON v.frame_number = (c.frame_number // 10) * 10 AND v.event_type = 'view'""")
def linked_frames(spark, d):
    f = R.frames(spark, d)
    views = S.matching(f, event_type="view").select(F.col("frame_number").alias("at"), F.col("value").alias("lat"), F.col("value").alias("lon"), F.lit(0.0).alias("altitude"), F.col("seconds").alias("gpx_timestamp"))
    rows = S.matching(f, event_type="click").join(views, F.floor(F.col("frame_number") / 10) * 10 == F.col("at"), "left")
    out = M.with_location(rows)
    return out.select("frame_number", F.col("location").isNotNull().alias("linked"), F.get(F.col("location.coordinates"), F.lit(1)).alias("lat"))


@query("""WITH e AS (SELECT user_id job_id, event_type, ts, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) p FROM events)
 SELECT job_id, count(*) AS changes FROM e WHERE p IS NOT NULL AND p <> event_type GROUP BY 1""")
def state_changes(spark, d):
    e = R.table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("status"), F.struct("ts", "event_id").alias("at"))
    return Q.transitions(e).groupBy("job_id").agg(F.count("*").alias("changes"))


@query("""SELECT l_orderkey AS id, l_linenumber AS item, CASE WHEN l_linenumber % 3 = 1 THEN trunc((l_partkey + 1) * (480e0 / (l_suppkey + 1)))::INT ELSE 640 END AS width,
 CASE l_linenumber % 3 WHEN 0 THEN trunc((l_suppkey + 1) * (640e0 / (l_partkey + 1)))::INT ELSE 480 END AS height,
 CASE l_returnflag WHEN 'R' THEN 'red' WHEN 'A' THEN 'amber' ELSE 'grey' END AS colour,
 CASE l_returnflag WHEN 'R' THEN 'Poor' WHEN 'A' THEN 'Fair' ELSE 'Good' END || ' condition ' || lower(l_linestatus) || ' detected' AS description,
 CASE l_returnflag WHEN 'A' THEN 'R' WHEN 'R' THEN 'A' ELSE 'A,R,' || l_returnflag END AS shown FROM lineitem""")
def styled_items(spark, d):
    li = R.table(spark, d, "lineitem")
    flag = F.col("l_returnflag")
    third = F.col("l_linenumber") % 3
    size = X.resized(F.col("l_partkey") + 1, F.col("l_suppkey") + 1, F.when(third != 1, 640), F.when(third != 0, 480))
    condition = F.when(flag == "R", "poor").when(flag == "A", "FAIR").otherwise("Good")
    return li.select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("item"), size["width"].alias("width"), size["height"].alias("height"),
        X.first_style(F.array(flag, "l_linestatus"), {"R": "red", "A": "amber"}, "grey").alias("colour"), X.description(F.col("l_linestatus"), condition).alias("description"),
        F.array_join(X.toggled(F.array(F.lit("A"), F.lit("R")), flag), ",").alias("shown"),
    )


@query("""SELECT p_partkey AS id, CASE WHEN contains(p_brand, '#12') THEN '#12' WHEN contains(p_brand, '#1') THEN '#1' ELSE 'none' END AS key,
 'data:image/png;base64,' || base64(encode(p_name)) AS data FROM part""")
def demo_files(spark, d):
    p = R.table(spark, d, "part")
    name = F.concat(F.lit("/demo/"), "p_brand", F.lit(".v2.gpx"))
    return p.select(F.col("p_partkey").alias("id"), X.demo_key(name, ["#12", "#1"], "none").alias("key"), X.data_url(F.concat("p_brand", F.lit(".png")), F.col("p_name").cast("binary")).alias("data"))


@query(f"""WITH p AS (SELECT video_id, frame_number, seconds FROM {FRAMES} WHERE event_type = 'view') SELECT video_id, frame_number, (row_number() OVER (PARTITION BY video_id ORDER BY seconds, frame_number) - 1)::INT AS at FROM p""")
def track_points(spark, d):
    views = S.matching(R.frames(spark, d), event_type="view")
    tracks = views.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("seconds", "frame_number"))).alias("points"))
    return P.points(tracks, "video_id", "points").select("video_id", "point.frame_number", F.col("place").alias("at"))


@query("SELECT p_partkey AS id, row_number() OVER (ORDER BY p_brand, p_partkey) + (SELECT max(p_partkey) FROM part) AS new_id FROM part")
def numbered_on(spark, d):
    p = R.table(spark, d, "part")
    return W.surrogate_keys(p, p.withColumnRenamed("p_partkey", "new_id"), "new_id", "p_brand", "p_partkey").select(F.col("p_partkey").alias("id"), "new_id")


def job_events(spark, d):
    """Events as states of jobs, one job a user."""
    kind = F.col("event_type")
    status = F.when(kind == "click", "pending").when(kind == "view", "claimed").otherwise("processing")
    return R.table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("user_id").alias("video_id"), status.alias("status"), F.struct("ts", "event_id").alias("at"))


JOBS = "(SELECT user_id AS job_id, CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'claimed' ELSE 'processing' END AS status, ts, event_id FROM events)"


@query(f"""SELECT job_id, 'claimed' AS status FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS k, first(ts) OVER w AS born, first(event_id) OVER w AS first_id FROM {JOBS} WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id))
 WHERE k = 1 AND status = 'pending' ORDER BY born, first_id LIMIT 20""")
def claimed_jobs(spark, d):
    return Q.claimed(job_events(spark, d), 20).select("job_id", "status")


@query(f"""SELECT job_id, previous, status, count(*) AS n FROM (SELECT job_id, status, lag(status) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS previous FROM {JOBS})
 WHERE previous <> status AND NOT (previous = 'pending' AND status = 'claimed') AND NOT (previous = 'claimed' AND status = 'processing') GROUP BY 1, 2, 3""")
def illegal_changes(spark, d):
    return Q.illegal_transitions(job_events(spark, d)).groupBy("job_id", "previous", "status").agg(F.count("*").alias("n"))
