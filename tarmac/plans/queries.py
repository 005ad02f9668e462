"""The library's queries on the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import aggregates as A
from ..operators import dml as M
from ..operators import filters as S
from ..operators import joins as J
from ..operators import ranking as W
from ..streaming import windows as T
from . import roles as R

ASSETS = """(SELECT l_orderkey survey_id, l_linenumber item, l_suppkey route_id, l_partkey part,
 CASE l_returnflag WHEN 'R' THEN 'Poor' WHEN 'A' THEN 'Fair' ELSE 'Good' END AS condition, l_discount confidence, l_shipdate detected_at FROM lineitem)"""
SURVEYS = "(SELECT o_orderkey id, o_custkey route_id, o_orderdate::DATE survey_date, o_orderstatus status, o_orderpriority surveyor FROM orders)"
FRAMES = """(SELECT event_id frame_number, user_id video_id, event_type, (epoch_us(ts) - 1704067200000000) / 1000000 AS seconds,
 json_extract_string(props, '$.k')::INT AS detections_count, value FROM events)"""

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"""SELECT a.route_id, a.anomalies, coalesce(s_name, 'Route ' || a.route_id) AS road_name FROM
 (SELECT route_id, count(*) anomalies FROM {ASSETS} WHERE condition = 'Poor' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5) a LEFT JOIN supplier ON s_suppkey = a.route_id""")
def top_anomaly_roads(spark, d):
    top = A.top_groups(S.matching(R.assets(spark, d), condition="Poor"), "route_id", 5, "anomalies")
    return J.lookup(top, R.roads(spark, d), "route_id", "route_id", "road_name", "road_name", F.concat(F.lit("Route "), F.col("route_id").cast("string")))


@query(f"""SELECT count(*) total_assets, count_if(condition = 'Poor') anomalies, count_if(condition = 'Good') good, count_if(condition = 'Fair') fair,
 (SELECT round(coalesce(sum(s_acctbal), 0), 1) FROM supplier) km_surveyed FROM {ASSETS}""")
def dashboard_kpis(spark, d):
    return A.kpis(R.assets(spark, d), R.roads(spark, d), "condition", "km")


@query(f"""SELECT p_type AS category, count(*) AS "count" FROM {ASSETS} JOIN part ON p_partkey = part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def assets_by_category(spark, d):
    rows = R.assets(spark, d).join(R.table(spark, d, "part"), F.col("part") == F.col("p_partkey"))
    return A.top_groups(rows, "p_type", 10).select(A.named("p_type").alias("category"), "count")


@query(f"""SELECT p_brand AS category, count(*) total, count_if(condition = 'Good') good, count_if(condition = 'Fair') fair, count_if(condition = 'Poor') poor
 FROM {ASSETS} JOIN part ON p_partkey = part GROUP BY 1""")
def asset_stats(spark, d):
    rows = R.assets(spark, d).join(R.table(spark, d, "part"), F.col("part") == F.col("p_partkey"))
    return A.conditions_by(rows, F.col("p_brand").alias("category"), "condition", "Good", "Fair", "Poor")


@query(f"""SELECT video_id, count(*) total_frames, count_if(detections_count > 0) frames_with_detections, sum(detections_count)::BIGINT total_detections,
 round(avg(detections_count), 6) avg_detections FROM {FRAMES} GROUP BY 1""")
def frame_stats_by_video(spark, d):
    f = R.frames(spark, d)
    return f.groupBy("video_id").agg(
        F.count("*").alias("total_frames"), F.count_if(F.col("detections_count") > 0).alias("frames_with_detections"),
        F.sum("detections_count").alias("total_detections"), F.round(F.avg("detections_count"), 6).alias("avg_detections"),
    )


@query("SELECT 0::BIGINT total_frames, 0::BIGINT frames_with_detections, 0::BIGINT total_detections, 0.0::DOUBLE avg_detections")
def frame_stats_empty(spark, d):
    return A.frame_stats(S.matching(R.frames(spark, d), video_id=-1))


@query(f"SELECT * FROM {ASSETS} WHERE route_id = 3 AND condition IN ('Poor', 'Fair') ORDER BY detected_at DESC, survey_id, item LIMIT 1000")
def assets_listing(spark, d):
    rows = S.matching(R.assets(spark, d), route_id=3, condition=["Poor", "Fair"], survey_id=None)
    return rows.orderBy(F.desc("detected_at"), "survey_id", "item").limit(1000)


@query(f"SELECT * FROM {FRAMES} WHERE detections_count > 0 ORDER BY detections_count DESC, frame_number LIMIT 50")
def frames_with_most_detections(spark, d):
    return S.with_detections(R.frames(spark, d)).orderBy(F.desc("detections_count"), "frame_number").limit(50)


@query(f"SELECT * FROM {FRAMES} ORDER BY frame_number LIMIT 100 OFFSET 200")
def frames_page(spark, d):
    return W.page(R.frames(spark, d), 3, 100, "frame_number")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring')")
def substring_search(spark, d):
    return S.containing(R.table(spark, d, "part"), "RING", "p_name", "p_type").select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE list_has_any(string_split(lower(p_name), ' '), ['widget', 'red'])")
def text_search(spark, d):
    return S.any_term(R.table(spark, d, "part"), "red widget", "p_name").select("p_partkey", "p_name")


@query(f"""SELECT c.frame_number, c.video_id, c.seconds, arg_min(v.frame_number, struct_pack(a := abs(v.seconds - c.seconds), b := v.seconds, c := v.frame_number)) AS point
 FROM (SELECT * FROM {FRAMES} WHERE event_type = 'click') c LEFT JOIN (SELECT * FROM {FRAMES} WHERE event_type = 'view') v USING (video_id) GROUP BY ALL""")
def nearest_point(spark, d):
    f = R.frames(spark, d)
    clicks = S.matching(f, event_type="click").select("frame_number", "video_id", "seconds")
    points = S.matching(f, event_type="view").select("video_id", "seconds", F.col("frame_number").alias("point"))
    return J.nearest_asof(clicks, points, "video_id", "seconds", "point", ["point"], span=86_400.0).select("frame_number", "video_id", "seconds", "point")


@query(f"""WITH p AS (SELECT video_id, frame_number AS point, row_number() OVER (PARTITION BY video_id ORDER BY frame_number) - 1 AS idx FROM {FRAMES} WHERE event_type = 'view'),
 n AS (SELECT video_id, count(*) n FROM p GROUP BY 1)
 SELECT c.frame_number, c.video_id, p.point FROM {FRAMES} c LEFT JOIN n USING (video_id)
 LEFT JOIN p ON p.video_id = c.video_id AND p.idx = least(floor(c.seconds / 2592000.0 * n.n), n.n - 1) WHERE c.event_type = 'click'""")
def positional_point(spark, d):
    from pyspark.sql import Window

    f = R.frames(spark, d)
    index = F.row_number().over(Window.partitionBy("video_id").orderBy("frame_number")) - 1
    points = S.matching(f, event_type="view").select("video_id", F.col("frame_number").alias("point"), index.alias("idx"))
    clicks = S.matching(f, event_type="click").withColumn("duration", F.lit(2592000.0))
    return J.positional_link(clicks, points, "video_id", "seconds", "duration", "idx", ["point"]).select("frame_number", "video_id", "point")


@query(f"""SELECT a.frame_number, b.frame_number AS r_frame_number FROM {FRAMES} a JOIN {FRAMES} b ON a.video_id = b.video_id AND abs(a.seconds - b.seconds) < 3600
 WHERE a.event_type = 'click' AND b.event_type = 'view'""")
def band_pairs(spark, d):
    f = R.frames(spark, d)
    return J.band_join(S.matching(f, event_type="click"), S.matching(f, event_type="view"), "video_id", "seconds", 3600.0).select("frame_number", "r_frame_number")


@query(f"""SELECT video_id, frame_number, rank FROM (SELECT video_id, frame_number,
 row_number() OVER (PARTITION BY video_id ORDER BY abs(seconds - 1000000), frame_number) AS rank FROM {FRAMES}) WHERE rank <= 3""")
def nearest_frames(spark, d):
    return J.nearest_k(R.frames(spark, d), "video_id", F.abs(F.col("seconds") - 1000000), "frame_number", 3).select("video_id", "frame_number", "rank")


@query(f"""SELECT id, route_id, row_number() OVER (PARTITION BY route_id ORDER BY survey_date, id) AS survey_version,
 row_number() OVER (PARTITION BY route_id ORDER BY survey_date DESC, id DESC) = 1 AS is_latest FROM {SURVEYS}""")
def survey_versions(spark, d):
    rows = W.with_versions(R.surveys(spark, d), "route_id", "survey_date", "id")
    return W.with_latest(rows, "route_id", F.desc("survey_date"), F.desc("id")).select("id", "route_id", "survey_version", "is_latest")


@query(f"""SELECT id, route_id, row_number() OVER (PARTITION BY route_id ORDER BY survey_date DESC, id DESC) = 1 AS is_latest FROM {SURVEYS} WHERE status <> 'P'""")
def delete_surveys(spark, d):
    s = R.surveys(spark, d)
    none = s.select(F.col("id").alias("survey_id"), "id", F.col("id").alias("video_id")).limit(0)
    out = M.delete_surveys(s.withColumn("is_latest", F.lit(False)), none, none, s.filter("status = 'P'").select("id"))
    return out["surveys"].select("id", "route_id", "is_latest")


@query(f"""SELECT s.route_id, s.road_name, CASE WHEN n.poor > 10 THEN round(s.km + 1, 2) ELSE s.km END AS km FROM
 (SELECT s_suppkey route_id, s_name road_name, s_acctbal km FROM supplier) s LEFT JOIN (SELECT route_id, count_if(condition = 'Poor') poor FROM {ASSETS} GROUP BY 1) n USING (route_id)""")
def update_roads(spark, d):
    roads = R.roads(spark, d).select("route_id", "road_name", "km")
    poor = S.matching(R.assets(spark, d), condition="Poor").groupBy("route_id").agg(F.count("*").alias("poor")).filter("poor > 10")
    changes = roads.join(poor, "route_id").select("route_id", F.round(F.col("km") + 1, 2).alias("km"))
    return M.merge_update(roads, changes, "route_id")


@query("""SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM
 (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS all_ FROM lineitem) QUALIFY n = all_""")
def last_items(spark, d):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    rows = R.table(spark, d, "lineitem").withColumn("n", n).withColumn("all_", F.count("*").over(Window.partitionBy("l_orderkey")))
    return rows.filter("n = all_").select("l_orderkey", "l_linenumber", "n")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) n FROM conversations) WHERE n <= 6")
def conversation_tails(spark, d):
    return W.tail_per_key(R.table(spark, d, "conversations"), "conv_id", "turn", 6).select("conv_id", "turn", "role")


@query(f"""WITH p AS (SELECT video_id, frame_number, row_number() OVER (PARTITION BY video_id ORDER BY frame_number) - 1 AS idx, count(*) OVER (PARTITION BY video_id) n FROM {FRAMES})
 SELECT video_id, frame_number, idx FROM p WHERE idx % greatest(1, n // 20) = 0 OR idx = n - 1""")
def downsampled_tracks(spark, d):
    from pyspark.sql import Window

    idx = F.row_number().over(Window.partitionBy("video_id").orderBy("frame_number")) - 1
    return W.downsampled(R.frames(spark, d).select("video_id", "frame_number", idx.alias("idx")), "video_id", "idx", 20)


@query(f"""SELECT condition, count(*) AS "count", round(100 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM {ASSETS} GROUP BY 1""")
def condition_shares(spark, d):
    return W.share_of_total(R.assets(spark, d), "condition")


@query(f"""WITH days AS (SELECT route_id, survey_date, count(*) assets, min(surveyor) surveyor, count_if(condition = 'Good') good, count_if(condition = 'Fair') fair, count_if(condition = 'Poor') poor
 FROM (SELECT s.route_id, s.survey_date, s.surveyor, a.condition FROM {ASSETS} a JOIN {SURVEYS} s ON s.id = a.survey_id) GROUP BY 1, 2)
 SELECT route_id, sum(assets)::BIGINT total, sum(good)::BIGINT good, sum(fair)::BIGINT fair, sum(poor)::BIGINT poor, max(survey_date) latest, arg_max(surveyor, survey_date) latest_surveyor, count(*) surveys FROM days GROUP BY 1""")
def route_summaries(spark, d):
    s = R.surveys(spark, d)
    rows = R.assets(spark, d).select("survey_id", "condition").join(s, F.col("survey_id") == F.col("id"))
    return A.route_summary(rows, "route_id", "survey_date", "surveyor", "condition", "Good", "Fair", "Poor").withColumn("surveys", F.size("surveys").cast("long"))


@query("SELECT count_if(o_orderstatus IN ('P', 'O', 'F')) uploaded, count_if(o_orderstatus = 'F') completed, count_if(o_orderstatus = 'P') queued, count_if(o_orderstatus IN ('P', 'O')) active FROM orders")
def upload_counts(spark, d):
    return A.status_counts(R.surveys(spark, d), "status", {"uploaded": ["P", "O", "F"], "completed": ["F"], "queued": ["P"], "active": ["P", "O"]})


@query("SELECT count(*) roads, round(sum(s_acctbal), 2) km, round(sum(s_acctbal) / count(*), 4) mean_km FROM supplier")
def road_kpis(spark, d):
    return A.road_kpis(R.roads(spark, d), "km")


@query("SELECT s_suppkey AS route_id FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R' AND l_quantity > 49)")
def roads_with_anomalies(spark, d):
    hits = R.table(spark, d, "lineitem").filter("l_returnflag = 'R' and l_quantity > 49")
    return J.present(R.roads(spark, d), hits, "route_id", "l_suppkey").select("route_id")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 150000)")
def customers_without_surveys(spark, d):
    asked = R.table(spark, d, "orders").filter("o_orderstatus = 'P' and o_totalprice > 150000")
    return J.absent(R.table(spark, d, "customer"), asked, "c_custkey", "o_custkey").select("c_custkey")


@query("""WITH g AS (SELECT s_suppkey a, s_nationkey::DOUBLE lat, (s_suppkey % 90)::DOUBLE lon FROM supplier)
 SELECT a, round(6371 * 2 * atan2(sqrt(h), sqrt(1 - h)), 2) km, floor((lon + 180) / 360 * 256)::INT x,
 floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 256)::INT y FROM
 (SELECT *, sin(radians(10 - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(10.0)) * sin(radians(20 - lon) / 2) ** 2 AS h FROM g)""")
def distances_and_tiles(spark, d):
    g = R.table(spark, d, "supplier").select(F.col("s_suppkey").alias("a"), F.col("s_nationkey").cast("double").alias("lat"), (F.col("s_suppkey") % 90).cast("double").alias("lon"))
    z = F.lit(8)
    return g.select("a", X.haversine_km(F.col("lat"), F.col("lon"), F.lit(10.0), F.lit(20.0)).alias("km"), X.tile_x(F.col("lon"), z).alias("x"), X.tile_y(F.col("lat"), z).alias("y"))


@query("""SELECT o_orderkey AS id, (o_orderkey // 60) || ':' || lpad((o_orderkey % 60)::VARCHAR, 2, '0') AS duration, 'R' || CASE WHEN o_custkey < 1000 THEN lpad(o_custkey::VARCHAR, 3, '0') ELSE o_custkey::VARCHAR END AS code,
 'AST-' || CASE WHEN o_orderkey < 100000 THEN lpad(o_orderkey::VARCHAR, 5, '0') ELSE o_orderkey::VARCHAR END AS asset_id, printf('%.2f MB', o_totalprice / 1048576.0) AS size, CASE WHEN o_totalprice >= 200000 THEN 7 ELSE 4 END AS radius FROM orders""")
def formatted(spark, d):
    o = R.table(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("id"), X.minutes_seconds(k).alias("duration"), X.route_code(F.col("o_custkey")).alias("code"), X.numbered_id("AST", k).alias("asset_id"),
        X.megabytes(F.col("o_totalprice")).alias("size"), X.marker_radius(F.when(F.col("o_totalprice") >= 200000, 6).otherwise(0)).alias("radius"),
    )


@query("SELECT page_id, regexp_replace(list_last(string_split(url, '/')), '\\.[^/.]+$', '') AS stem, starts_with(url, 'http') AS absolute FROM pages")
def url_parts(spark, d):
    return R.table(spark, d, "pages").select("page_id", X.file_stem(F.col("url")).alias("stem"), F.col("url").startswith("http").alias("absolute"))


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS events, round(sum(value), 2) AS total FROM events GROUP BY ALL""")
def hourly_events(spark, d):
    return T.per_window(T.event_time(R.table(spark, d, "events")), "ts", "1 hour", ["event_type"], "value")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g)
 SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS events FROM s GROUP BY user_id, n""")
def user_sessions(spark, d):
    return T.sessions(T.event_time(R.table(spark, d, "events")), "ts", "30 minutes", "user_id")


@query("""SELECT o_orderkey AS survey_id, len(list_filter(dets, lambda x: x.confidence >= 0.05)) AS confident, len(list_filter(dets, lambda x: x.class_name <> 'R')) AS kept,
 list_has_any(list_transform(dets, lambda x: x.class_name), ['A']) AS has_fair FROM
 (SELECT l_orderkey AS o_orderkey, list({'class_name': l_returnflag, 'confidence': l_discount}) dets FROM lineitem GROUP BY 1)""")
def detection_arrays(spark, d):
    det = F.struct(F.col("l_returnflag").alias("class_name"), F.col("l_discount").alias("confidence"))
    rows = R.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("survey_id")).agg(F.collect_list(det).alias("dets"))
    dets = F.col("dets")
    return rows.select(
        "survey_id", F.size(S.confident(dets, 0.05)).cast("long").alias("confident"), F.size(S.without_class_like(dets, "r")).cast("long").alias("kept"), S.has_class(dets, ["A"]).alias("has_fair")
    )


@query("""SELECT coalesce(l_returnflag, 'TOTAL') AS class_name, count(*) AS "count", count(*) / 1000 AS per_frame, round(100 * count(*) / (SELECT count(*) FROM lineitem), 4) AS percent
 FROM lineitem GROUP BY ROLLUP (l_returnflag)""")
def class_report(spark, d):
    counts = R.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("class_name")).agg(F.count("*").alias("count"))
    return A.class_report(counts, 1000)


@query(f"SELECT video_id, floor(seconds / 3600 + 0.5)::BIGINT AS second, count(*) AS detections, arg_min(value, frame_number) AS lat, arg_min(detections_count, frame_number) AS lon FROM {FRAMES} GROUP BY 1, 2")
def grouped_by_second(spark, d):
    return A.per_second(R.frames(spark, d).withColumn("seconds", F.col("seconds") / 3600).withColumnRenamed("value", "lat").withColumnRenamed("detections_count", "lon"), "video_id", "seconds", "frame_number", "lat", "lon")


# the other queries add themselves to the same tables
from . import derived, recent, shaped, texts  # noqa: E402, F401
