"""Sources and sinks: pushed filters, committed files, damaged files, partitions that stay."""

import json
import os
import sqlite3

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringStartsWith

from tarmac.operators import dml
from tarmac.sources import annotations, gpx, json_arrays, tiles


@pytest.fixture
def tile_file(tmp_path):
    path = str(tmp_path / "t.db")
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE tiles (z INT, x INT, y INT, s INT, image BLOB)")
    db.executemany("INSERT INTO tiles VALUES (?, ?, ?, 0, ?)", [(z, x, y, b"%d/%d/%d" % (z, x, y)) for z in range(5) for x in range(1 << z) for y in range(1 << z)])
    db.commit()
    db.close()
    return path


def test_tile_filters_reach_the_file(spark, tile_file):
    reader = tiles.TileReader(tile_file, 64, True)
    rest = list(reader.pushFilters([EqualTo(("z",), 4), EqualTo(("x",), 3), In(("y",), [5]), GreaterThan(("s",), -1), StringStartsWith(("image",), "4")]))
    assert [type(f) for f in rest] == [StringStartsWith]
    parts = reader.partitions()
    assert [(p.zoom, p.first, p.last) for p in parts] == [(4, 3, 3)]
    assert [r[4] for p in parts for r in reader.read(p)] == [b"4/3/5"]
    whole = tiles.TileReader(tile_file, 64)
    assert len(whole.partitions()) == 3 + 1 + 4 and sum(len(list(whole.read(p))) for p in whole.partitions()) == 341
    tiles.register(spark)
    df = tiles.tile(spark, tile_file, 3, 6, 7)
    assert [bytes(r["image"]) for r in df.collect()] == [b"3/6/7"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan tiles" in plan and "= 6" not in plan
    assert tiles.tile(spark, tile_file, 9, 0, 0).count() == 0
    assert spark.read.format("tiles").option("path", tile_file).option("pushdown", True).load().filter("z >= 3 and x < 2 and y in (0, 1)").count() == 8
    again = spark.read.format("tiles").option("path", tile_file).load()
    assert again.filter("z = 1").count() == 4 and again.count() == 341


def test_json_arrays_round_trip(spark, tmp_path):
    json_arrays.register(spark)
    rows = [(v, f, 0.5, [{"class_name": "Sign", "n": f}], None if f else "é") for v in ("a/b", "c", None) for f in range(40)]
    df = spark.createDataFrame(rows, "video_id string, frame int, confidence double, detections array<struct<class_name:string,n:int>>, note string")
    path = f"{tmp_path}/out"
    json_arrays.write_arrays(df, path, "video_id", "frame")
    assert sorted(os.listdir(path)) == ["__null__.json", "a%2Fb.json", "c.json"]
    assert [r["frame"] for r in json.load(open(f"{path}/c.json", encoding="utf-8"))] == list(range(40))
    back = annotations.read_json_array(spark, f"{path}/c.json", "frame int, confidence double, detections array<struct<class_name:string,n:int>>, note string")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.filter("video_id = 'c'").drop("video_id").collect()))
    json_arrays.write_arrays(df.filter("video_id = 'c' and frame < 2"), path, "video_id", "frame")
    assert len(json.load(open(f"{path}/c.json"))) == 2 and len(json.load(open(f"{path}/a%2Fb.json"))) == 40


def test_json_arrays_leave_nothing_half_written(spark, tmp_path):
    json_arrays.register(spark)
    path = f"{tmp_path}/out"
    fail = F.udf(lambda i: 1 // (i - 50), "int")
    with pytest.raises(Exception, match="division|Division"):
        json_arrays.write_arrays(spark.range(100).select((F.col("id") % 3).alias("k"), "id", fail("id").alias("v")), path, "k", "id")
    assert os.listdir(path) == []
    with pytest.raises(Exception, match="write_arrays"):
        spark.range(0, 10, 1, 5).select(F.lit("k").alias("k"), "id").write.format("json_arrays").mode("append").option("path", path).option("key", "k").save()
    assert os.listdir(path) == []
    # a task that ran twice: only the attempt that was reported counts
    writer = json_arrays.ArrayWriter(path, "k")
    rows = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int").collect()
    writer.write(iter(rows))
    writer.commit([writer.write(iter(rows)), None])
    assert os.listdir(path) == ["a.json"] and json.load(open(f"{path}/a.json")) == [{"v": 1}, {"v": 2}]


def test_damaged_tasks_go_to_quarantine(spark, tmp_path):
    good = [{"id": 1, "data": {"video": "s3://x/a.mp4"}, "annotations": []}]
    for folder in ("one", "two words"):
        os.makedirs(f"{tmp_path}/{folder}")
        (tmp_path / folder / "a.json").write_text(json.dumps(good))
    (tmp_path / "bad.json").write_text('[{"id": 1, "data": ')
    of = {f"{tmp_path}/one/a.json": "signs", f"{tmp_path}/two words/a.json": "lights", f"{tmp_path}/bad.json": "broken", f"{tmp_path}/none.json": "none"}
    rows = annotations.read_tasks(spark, of, f"{tmp_path}/quarantine").collect()
    assert sorted((r["id"], r["category"]) for r in rows) == [(1, "lights"), (1, "signs")]
    held = spark.read.parquet(f"{tmp_path}/quarantine").collect()
    assert [(r["category"], r["path"].endswith("bad.json"), r["text"].startswith("[{")) for r in held] == [("broken", True, True)]
    assert annotations.read_tasks(spark, {f"{tmp_path}/none.json": "none"}).count() == 0


def test_damaged_tracks(spark, tmp_path):
    (tmp_path / "good.gpx").write_text('<gpx><trk><name>a</name><trkseg><trkpt lat="1" lon="2"/></trkseg></trk></gpx>')
    (tmp_path / "cut.gpx").write_text('<gpx><trk><name>a</name><trkseg><trkpt lat="1" lon=')
    (tmp_path / "plain.gpx").write_text("no track at all")
    assert gpx.read_gpx(spark, f"{tmp_path}/*.gpx").count() == 1
    got = {os.path.basename(r["path"]): r["reason"] for r in gpx.damaged(spark, f"{tmp_path}/*.gpx").collect()}
    assert got == {"cut.gpx": "broken", "plain.gpx": "no points"}
    assert gpx.read_first(spark, [f"{tmp_path}/none.gpx", f"{tmp_path}/good.gpx"]).count() == 1
    assert gpx.read_first(spark, [f"{tmp_path}/none.gpx"]).count() == 0


def test_untouched_partitions_keep_their_files(spark, tmp_path):
    path = f"{tmp_path}/roads"
    spark.range(40).select("id", (F.col("id") * 2).alias("km"), (F.col("id") % 4).alias("kind")).write.partitionBy("kind").parquet(path)
    files = lambda k: {f: os.stat(f"{path}/kind={k}/{f}").st_mtime_ns for f in os.listdir(f"{path}/kind={k}") if f.endswith(".parquet")}
    before = {k: files(k) for k in range(4)}
    table = spark.read.schema("id long, km long, kind int").parquet(path)
    changes = spark.createDataFrame([(5, 500), (9, 900)], "id long, km long")
    dml.rewrite_changed(path, "kind", dml.merge_update(table, changes, "id"), table.join(changes.select("id"), "id", "left_semi"))
    after = {r["id"]: r["km"] for r in spark.read.parquet(path).collect()}
    assert after == {i: {5: 500, 9: 900}.get(i, i * 2) for i in range(40)}
    assert [files(k) == before[k] for k in range(4)] == [True, False, True, True]
    table = spark.read.schema("id long, km long, kind int").parquet(path)
    gone = table.filter("kind = 2").select("id")
    dml.rewrite_changed(path, "kind", dml.delete_keys(table, gone, "id"), table.filter("kind = 2"))
    assert sorted(d for d in os.listdir(path) if d.startswith("kind")) == ["kind=0", "kind=1", "kind=3"]
    assert files(3) == before[3]


def test_deleted_files(spark):
    videos = spark.createDataFrame(
        [(1, 7, "/uploads/a.mp4", "/uploads/t.jpg", None), (2, 7, "/video_library/b.mp4", "/uploads/u.jpg", "g.gpx"), (3, 7, None, None, None), (4, 8, "c.mp4", None, None)],
        "id long, survey_id long, storage_url string, thumbnail_url string, gpx_file_url string",
    )
    surveys = spark.createDataFrame([(7,), (8,), (9,)], "id long")
    gone = surveys.filter("id in (7, 9)")
    assert sorted((r["id"], r["path"], r["kept"]) for r in dml.deleted_files(videos, gone).collect()) == [(1, "a.mp4", False), (1, "t.jpg", False), (2, "/video_library/b.mp4", True)]
    got = {r["id"]: (r["deleted_videos"], r["deleted_files"], r["preserved_files"]) for r in dml.delete_report(surveys, videos, gone).collect()}
    assert got == {7: (3, 1, 1), 9: (0, 0, 0)}
