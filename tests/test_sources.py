import random

from pyspark.sql import functions as F

from wellspring import metrics
from wellspring.sources import annotations, cloud_vehicles, frames, linear_road, repeated, smart_grid, smart_grid_readings, split_by, synthetic_lineage, synthetic_overlap


def test_text_sources(spark, tmp_path):
    (tmp_path / "lr.csv").write_text("0,30,1,0,9,1,0,10,500\n0,60,2,5,9,1,0,10,500\n")
    rows = sorted(map(tuple, linear_road(spark, str(tmp_path / "lr.csv"), instances=2, id_shift=100).select("vid", "xway", F.unix_seconds("ts"), "key").collect()))
    assert rows == [(1, 0, 30, "1"), (2, 0, 60, "2"), (101, 1, 30, "101"), (102, 1, 60, "102")]
    (tmp_path / "sg.csv").write_text("1,0,0\n25,7,12\n")
    assert sorted(map(tuple, smart_grid(spark, str(tmp_path / "sg.csv")).select(F.unix_seconds("ts"), "key", "value").collect())) == [(3600, "0", 0), (90000, "7", 12)]
    (tmp_path / "cc.csv").write_text("5,3,39.9,116.3\n")
    assert tuple(cloud_vehicles(spark, str(tmp_path / "cc.csv")).select(F.unix_millis("ts"), "car_id", "lat", "lon").first()) == (5000, 3, 39.9, 116.3)


def test_a_line_that_does_not_parse_fails(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("1,0,0\nx,y,z\n")
    try:
        smart_grid(spark, str(tmp_path / "bad.csv")).collect()
    except Exception as e:
        assert "MALFORMED" in str(e).upper()
    else:
        raise AssertionError("parsed")


def test_annotation_files_become_frames(spark, tmp_path):
    for payload in ("lidar", "ring_front_left", "ring_front_right"):
        (tmp_path / f"objects_{payload}-log-7000000000.txt").write_text("a,PEDESTRIAN,1,2,3\nb,BICYCLE,4,5,6\na,PEDESTRIAN,7,8,9\n")
    (tmp_path / "objects_lidar-log-8000000000.txt").write_text("a,PEDESTRIAN,1,2,3\n")
    held = annotations(spark, str(tmp_path))
    assert held.count() == 4
    (row,) = frames(held).collect()
    assert row.lidar.payload_type == "lidar" and {e.key: e.value.x for e in row.left.annotations} == {"a": 7.0, "b": 4.0}


def test_frames_of_clocks_that_differ_are_numbered_and_repeated(spark):
    rows = [(p, 7_000_000_000 + k * 100_000_000 + late, {"k": (str(k), 0.0, 0.0, 0.0)}) for k in range(6) for p, late in (("ring_front_right", 5_000_000), ("lidar", 0), ("ring_front_left", 3_000_000))]
    held = spark.createDataFrame(rows[:-1] + [("lidar", 8_000_000_000, {})] + rows[-1:], "payload_type string, ns bigint, annotations map<string, struct<label:string,x:double,y:double,z:double>>")
    found = lambda **how: sorted((r.ms, r.l, r.r) for r in frames(held, **how).select(F.unix_millis("ts").alias("ms"), F.col("left.annotations")[0]["value"]["label"].alias("l"), F.col("right.annotations")[0]["value"]["label"].alias("r")).collect())
    once = found()
    assert once == [(7000 + 100 * k, str(k), str(k)) for k in range(6)]
    assert found(every=4) == [once[0], once[4]]
    assert found(every=4, times=2) == [once[0], once[4], (7000 + 200 + 500, "2", "2")]


def test_result_files_and_ratio(spark, tmp_path):
    folder = tmp_path / "lr_ANK"
    folder.mkdir()
    (folder / "latency.csv").write_text("".join(f"1,1,n,0,{100 + t},{1000 * t - 1000}\n" for t in range(11)))
    (folder / "provreads.csv").write_text("1,1,n,0,0,1\n1,1,n,0,10,1\n1,1,n,0,5,30\n1,1,n,1,5,30\n")
    (folder / "provwrites.csv").write_text("1,1,n,0,0,1\n1,1,n,0,10,1\n1,1,n,0,5,20\n")
    held = metrics.results(spark, str(tmp_path)).cache()
    late = {r.t: r.value for r in held.where("parameter = 'latency'").collect()}
    assert late == {t: (t - 1.0 if 1 <= t <= 9 else None) for t in range(11)}
    assert {r.t: r.ratio for r in metrics.read_write_ratio(held).collect()} == {0: None, 5: 3.0, 10: None}


def test_latency_of_delivery_and_by_the_clock(spark):
    second = lambda df, *cols: df.withColumns({c: F.timestamp_seconds(c) for c in cols})
    acks = second(spark.createDataFrame([("a", 5_000_000, 100), ("b", 7_200_000_000, 101), ("c", 9_000_000, 103)], "uid1 string, ts bigint, delivered bigint"), "delivered")
    safe = second(spark.createDataFrame([(5_000_000, 90), (9_000_000, 95), (9_000_001, 97), (7_300_000_000, 99)], "ts bigint, stimulus bigint"), "stimulus")
    assert {r.uid1: r.delivery_ms for r in metrics.ack_delivery(acks, safe).collect()} == {"a": 5000, "b": 2000, "c": 6000}
    rows = spark.range(3).select((F.current_timestamp() - F.expr("INTERVAL 2 SECONDS")).alias("at"))
    (row,) = metrics.wall_latency(rows, "at").collect()
    assert row["count"] == 3 and 1900 < row.average < 60_000


def test_repeated_input_is_later_each_time(spark):
    rows = spark.createDataFrame([(1, 10.0), (2, 20.0)], "id bigint, s double").withColumn("ts", F.timestamp_seconds("s"))
    found = repeated(rows, 3, "ts", "id").select("id", F.unix_seconds("ts").alias("t")).collect()
    assert sorted(r.t for r in found) == [10, 20, 21, 31, 32, 42] and len({r.id for r in found}) == 6


def test_synthetic_lineage_has_its_size_overlap_and_delay(spark):
    rows = synthetic_lineage(spark, 300, 25, 20, 5, 48)
    assert synthetic_overlap(rows).first().mean_overlap == 5
    bad = rows.select("sink_ts", F.explode("prov").alias("p")).where((F.col("p.ts") > F.col("sink_ts")) | (F.col("p.ts") <= F.col("sink_ts") - 26) | (F.length("p.data") != 48))
    assert rows.where(F.size("prov") != 20).count() == 0 and bad.count() == 0
    per_uid = rows.select(F.explode("prov").alias("p")).groupBy("p.uid").agg(F.countDistinct("p.ts").alias("n")).where("n > 1")
    assert per_uid.count() == 0


def test_meter_readings_are_about_normal_and_floored(spark):
    rows = smart_grid_readings(spark, 200, 20).cache()
    assert rows.count() == 4000 and rows.where("value > 0 and value < 8").count() == 0
    assert 9 < rows.where("value > 0").agg(F.avg("value")).first()[0] < 13


def test_split_keeps_keys_together(spark):
    parts = split_by(spark.range(100).withColumn("k", F.col("id") % 7), "k", 3)
    assert parts.groupBy("k").agg(F.countDistinct("part").alias("n")).where("n > 1").count() == 0


def test_series_and_trimming(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([(float(s), rng.random()) for s in (0, 0, 1, 4)], "s double, v double").withColumn("ts", F.timestamp_seconds("s"))
    found = {r.second: (r["count"], r.most) for r in metrics.per_second(rows, "ts", "v").collect()}
    assert [found[s][0] for s in range(5)] == [2, 1, 0, 0, 1] and found[2][1] == -1
    series = spark.createDataFrame([(s, float(s - 5)) for s in range(11)], "second bigint, v double")
    kept = {r.second: r.v for r in metrics.trimmed(series).collect()}
    assert sorted(kept) == list(range(1, 10)) and kept[1] is None and kept[9] == 4


def test_frames_are_dealt_to_more_tasks_where_there_are_more_payloads(spark, monkeypatch):
    from wellspring.sources import files

    monkeypatch.setattr(files, "TASK_ROWS", 100, raising=False)
    held = spark.range(1200).select(F.element_at(F.array(*map(F.lit, ("lidar", "ring_front_left", "ring_front_right"))), (F.col("id") % 3 + 1).cast("int")).alias("payload_type"), (F.col("id") * 600_000_000_000).alias("ns"), F.create_map(F.lit("t"), F.col("id")).alias("annotations"))
    found = frames(held)
    dealt = [x for x in found._jdf.queryExecution().analyzed().toString().splitlines() if "RepartitionByExpression" in x]
    assert dealt and all(x.rstrip().endswith(", 12") for x in dealt) and found.count() == 400
