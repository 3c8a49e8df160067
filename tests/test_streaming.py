import os

import pytest
from pyspark.sql import functions as F

from wellspring import metrics
from wellspring.plans import events as plans
from wellspring.operators.graph import delivery_order
from wellspring.operators import forward_graph
from wellspring.sources import frames
from wellspring.streaming import frame_stream, standard_graph_stream
from wellspring.streaming import arriving, latency_series, observed, run_logged
from wellspring.streaming import delivered, drain, graph_stream, prepare, staged, started, write_batches

ENDS = [{"user_id": -1, "event_type": t, "value": v} for t in ("click", "view") for v in (1.0, 25.0)]



@pytest.fixture(scope="module")
def events(spark):
    prepare(spark)
    rows = spark.range(300).select(F.col("id").alias("event_id"), F.timestamp_seconds(1704067200 + F.col("id") * 5000).alias("ts"), (F.col("id") % 5).alias("user_id"), F.when(F.col("id") % 2 == 0, "click").otherwise("view").alias("event_type"), ((F.col("id") * 37) % 90).cast("double").alias("value"))
    return rows.cache()


def stream(events, stamped=False):
    return plans.source(staged(events, "event_id", "ts", ends=ENDS), watermark="0 seconds", stamped=stamped)


@pytest.mark.parametrize("name", ["anomaly", "accident", "inarea", "followup"])
def test_streams_equal_batches(events, name):
    plan, hidden = plans.PLANS[name], ["ts", "l_ts", "r_ts"]
    batch = plan(plans.source(events)).df.drop("event", *hidden)
    found = drain(plan(stream(events)).df.drop("event", *hidden))
    assert sorted(map(str, found.select(*batch.columns).collect())) == sorted(map(str, batch.collect()))


def test_every_vertex_is_acknowledged_once_and_last(events):
    batch = plans.in_area(plans.source(events))
    rows = delivered(graph_stream({"inarea": plans.in_area(stream(events, stamped=True))}))
    assert delivery_order(rows).first()[1:] == (0, 0)
    found = rows.collect()
    used = {str(r.source) for r in batch.edges().collect()}
    ids = {kind: [r.uid1 for r in found if r.kind == kind] for kind in ("SOURCE", "SINK", "ACK")}
    assert set(ids["SOURCE"]) == used and len(ids["SOURCE"]) == len(used)
    assert sorted(ids["ACK"]) == sorted(ids["SOURCE"] + ids["SINK"])
    ts = {(r.kind, r.uid1): r.ts for r in found}
    assert all(ts["ACK", u] - ts["SOURCE", u] == batch.reach * 1_000_000 for u in used)


def test_sources_of_a_slice_and_bucket_share_a_key_and_a_timer(events, tmp_path):
    """Slices of a day: no source has a timer of its own, and each is still acknowledged after its last edge."""
    nodes = graph_stream({"inarea": plans.in_area(stream(events, stamped=True))}, buckets=2)
    out = str(tmp_path / "nodes")
    progress = write_batches(nodes, lambda rows, n: rows.write.mode("overwrite").parquet(f"{out}/batch={n}"), str(tmp_path / "progress"))
    timers = sum(o["customMetrics"].get("numRegisteredTimers", 0) for p in progress for o in p["stateOperators"])
    found = events.sparkSession.read.schema("kind string, uid1 string, uid2 string, ts bigint, data string, batch bigint").parquet(out)
    batch = forward_graph({"inarea": plans.in_area(plans.source(events))}, events, "event_id", "ts")
    shown = lambda df: sorted(map(str, df.select("kind", "uid1", "uid2", "ts", "data").collect()))
    assert shown(found) == shown(batch.nodes()) != []
    assert delivery_order(found).first()[1:] == (0, 0)
    assert 0 < timers <= 2 * 19 < found.where("kind = 'SOURCE'").count()


def test_a_stream_goes_on_where_it_stopped(events, tmp_path):
    """The second run, with new state stores and the first one's checkpoint, has the rest of the rows: windows that were open and sources that waited are not lost."""
    spark, rows, out = events.sparkSession, str(tmp_path / "rows"), str(tmp_path / "out")
    schema = events.schema

    def run():
        source = spark.readStream.schema(schema).parquet(rows)
        nodes = graph_stream({"inarea": plans.in_area(plans.source(source, watermark="0 seconds", stamped=True))})
        write_batches(nodes, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), str(tmp_path / "progress"))
        return spark.read.schema("kind string, uid1 string, uid2 string, ts bigint, data string").parquet(out)

    events.where("event_id < 150").write.mode("append").parquet(rows)
    assert 0 < run().where("kind = 'SINK'").count() < plans.in_area(plans.source(events)).df.count()
    events.where("event_id >= 150").write.mode("append").parquet(rows)
    ends = [(-1 - k, "2999-01-01 23:30:00", -1, "click", v) for k, v in enumerate((1.0, 25.0))]
    spark.createDataFrame(ends, "event_id bigint, ts string, user_id bigint, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(rows)
    found = run()
    assert sorted((r.uid2, int(r.uid1)) for r in found.where("kind = 'EDGE'").collect()) == sorted((r.sink, r.source) for r in plans.in_area(plans.source(events)).edges("inarea").collect())
    assert found.where("kind = 'ACK'").count() == found.where("kind in ('SOURCE', 'SINK')").count()


def test_late_rows_are_left_out(events, tmp_path):
    spark, rows = events.sparkSession, str(tmp_path / "rows")
    progress, out = str(tmp_path / "progress"), str(tmp_path / "out")

    def run():
        source = spark.readStream.schema(events.schema).parquet(rows)
        plan = plans.source(source, watermark="0 seconds").window_agg(["user_id"], "1 hours", n=F.count("*"))
        plan.plain().select("user_id", "n", "window_end").writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
        return {(r.user_id, r.window_end): r.n for r in spark.read.parquet(out).collect()}

    for ids in ("event_id between 0 and 100", "event_id between 200 and 250"):
        events.where(ids).write.mode("append").parquet(rows)
        before = run()
    events.where("event_id between 101 and 199 or event_id > 290").withColumn("event_id", F.col("event_id") + 1000).write.mode("append").parquet(rows)
    after = run()
    last = 1704067200 + 250 * 5000
    assert before.items() <= after.items()
    new = {k[1].timestamp() for k in after.keys() - before.keys()}
    assert new and all(t > last for t in new)


def test_graph_stream_equals_batch_and_batches_can_come_again(events, tmp_path):
    batch = plans.in_area(plans.source(events))
    nodes = graph_stream({"inarea": plans.in_area(stream(events, stamped=True))})
    out = str(tmp_path / "nodes")

    def write(rows, number):
        for _ in range(2):
            rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    progress = write_batches(nodes, write, str(tmp_path / "progress"))
    found = events.sparkSession.read.parquet(out)
    edges = {(r.uid2, int(r.uid1)) for r in found.where("kind = 'EDGE'").collect()}
    assert edges == {(r.sink, r.source) for r in batch.edges("inarea").collect()}
    assert found.where("kind = 'SINK'").count() == batch.df.count() == found.where("kind = 'ACK' and uid1 like 'inarea|%'").count()
    assert metrics.progress_summary(progress)["rows_per_s"] > 0


def test_delays_are_logged_by_batch_and_second(events, tmp_path):
    spark, log = events.sparkSession, str(tmp_path / "log")
    rows = plans.source(arriving(staged(events, "event_id", "ts", ends=ENDS)), watermark="0 seconds")
    results = rows.window_agg(["user_id"], "24 hours", n=F.count("*"), stimulus=F.max("stimulus"))
    run_logged(observed(results.plain()), lambda held, n: held.write.mode("overwrite").parquet(f"{tmp_path}/rows/batch={n}"), str(tmp_path / "progress"), log)
    series = latency_series(spark, log).collect()
    written = spark.read.parquet(str(tmp_path / "rows"))
    assert sum(r["count"] for r in series) == written.count() == plans.source(events).window_agg(["user_id"], "24 hours", n=F.count("*")).df.count()
    seconds = sorted(r.second for r in series)
    assert seconds == list(range(seconds[0], seconds[-1] + 1))
    assert all(0 < r.average <= r.most for r in series if r["count"])
    # A batch's record that comes again replaces the first.
    before = sorted(tmp_path.joinpath("log").glob("*.json"))
    assert before and len({p.name for p in before}) == len(before)


def test_the_mean_delay_of_many_rows_is_exact(spark, tmp_path):
    """All rows arrive at once, so their mean delay is the largest, however many they are."""
    log, at = str(tmp_path / "log"), F.timestamp_millis(F.lit(1704067200123))
    rows = staged(spark.range(50_000).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts")), "event_id", "ts")
    run_logged(observed(rows.select("event_id", at.alias("stimulus"))), lambda held, n: held.write.mode("overwrite").parquet(f"{tmp_path}/rows/batch={n}"), str(tmp_path / "progress"), log)
    found = [r for r in latency_series(spark, log).collect() if r["count"]]
    assert [(r["count"], r.average) for r in found] == [(50_001, found[0].most)]


def test_the_state_of_an_interval_join_is_let_go(spark, tmp_path):
    prepare(spark)
    rows = spark.range(600).select(F.col("id").alias("event_id"), F.timestamp_seconds(1704067200 + F.col("id") * 600).alias("ts"), (F.col("id") % 5).alias("user_id"), F.when(F.col("id") % 2 == 0, "click").otherwise("purchase").alias("event_type"), F.lit(1.0).alias("value"))
    for k in range(6):
        rows.where(F.col("event_id").between(100 * k, 100 * k + 99)).coalesce(1).write.mode("append").parquet(str(tmp_path / "rows"))
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "rows"))
    joined = plans.follow_up(plans.source(source, watermark="0 seconds")).plain()
    progress = write_batches(joined, lambda held, n: held.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}"), str(tmp_path / "progress"))
    state = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    assert len(state) >= 6 and max(state) < 300 and state[-1] <= 200
    found = spark.read.parquet(str(tmp_path / "out")).select("l_event_id", "r_event_id")
    batch = plans.follow_up(plans.source(rows)).plain().select("l_event_id", "r_event_id")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, batch.collect()))


def dark(events):
    """Windows over windows, the later ones over all keys."""
    daily = events.window_agg(["user_id"], "24 hours", total=F.sum("value")).where("total < 400")
    return daily.window_agg([], "48 hours", users=F.count("*")).where("users > 1")


@pytest.mark.parametrize("plan", [plans.in_area, dark])
def test_the_graph_without_lists_equals_the_batch(events, plan):
    batch = plan(plans.source(events))
    rows = delivered(graph_stream({"q": plan(plans.source(staged(events, "event_id", "ts", ends=ENDS), carry=False, watermark="0 seconds"))}))
    found = rows.collect()
    assert {(r.uid2, int(r.uid1)) for r in found if r.kind == "EDGE"} == {(r.sink, r.source) for r in batch.edges("q").collect()} != set()
    assert sum(r.kind == "EDGE" for r in found) == batch.edges("q").count()
    assert {(r.uid1, r.data) for r in found if r.kind == "SINK"} == {(r.sink, r.data) for r in batch.sinks("q").collect()}
    assert sorted(r.uid1 for r in found if r.kind == "ACK") == sorted(r.uid1 for r in found if r.kind in ("SOURCE", "SINK"))
    assert all(r.data.startswith("{") for r in found if r.kind == "SOURCE") and delivery_order(rows).first()[1:] == (0, 0)


@pytest.mark.parametrize("plan,carry", [(plans.in_area, True), (plans.in_area, False), (dark, True)])
def test_the_graph_from_standard_operators_equals_the_batch(events, plan, carry):
    batch = plan(plans.source(events))
    held = plan(plans.source(staged(events, "event_id", "ts", ends=ENDS), carry=carry, watermark="0 seconds"))
    rows = delivered(standard_graph_stream({"q": held}))
    graph = forward_graph({"q": batch}, events, "event_id", "ts")
    shown = lambda df: sorted(map(str, df.select("kind", "uid1", "uid2", "ts", "data").collect()))
    assert shown(rows) == shown(graph.nodes())
    assert delivery_order(rows).first()[1:] == (0, 0)


def test_streams_without_lists_say_what_they_cannot_do(events):
    held = plans.source(staged(events, "event_id", "ts", ends=ENDS), carry=False, watermark="0 seconds")
    with pytest.raises(NotImplementedError, match="carry"):
        held.window_join(held, {"user_id": "user_id"}, "1 hours").flow()


def test_frames_of_a_stream_equal_those_of_a_table(spark, tmp_path):
    prepare(spark)
    kinds = ["lidar", "ring_front_left", "ring_front_right", "lidar", "ring_front_left", "ring_front_right", "lidar", "lidar", "ring_front_left", "ring_front_left", "ring_front_right", "lidar"]
    rows = [(k, 10**15 + 400_000_000 * n + 1, [(f"t{n}", ("A", n / 7, 0.0, 1.0))]) for n, k in enumerate(kinds * 5)]
    table = spark.createDataFrame(rows, "payload_type string, ns bigint, annotations array<struct<key:string,value:struct<label:string,x:double,y:double,z:double>>>")
    for k in range(5):
        table.where(f"ns between {rows[12 * k][1]} and {rows[12 * k + 11][1]}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    table.limit(1).withColumn("payload_type", F.lit("end")).withColumn("ns", F.lit(1 << 62)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for every in (1, 2):
        batch = frames(table.withColumn("annotations", F.map_from_entries("annotations")), every)
        found = drain(frame_stream(stream, every))
        assert sorted(map(str, found.collect())) == sorted(map(str, batch.collect())) != []


def test_frames_reach_over_windows_and_equal_payloads_count(spark, tmp_path):
    """Threes begin in one window and end in a later one, windows have one, two or many payloads, and a payload that comes twice counts twice, as in the batch."""
    prepare(spark)
    kinds = ["lidar", "ring_front_left", "ring_front_right", "ring_front_left", "lidar", "ring_front_right", "lidar", "lidar"]
    seconds = [0, 1, 61, 62, 130, 130, 190, 250, 251, 252, *range(310, 330), 400, 470, 471, 2000, 2001, 2100]
    rows = [(kinds[n % len(kinds)], 10**15 + 10**9 * s + 3 * n, [(f"t{n}", ("A", n / 7, 0.0, 1.0))]) for n, s in enumerate(seconds)]
    rows = rows + rows[5:6]
    table = spark.createDataFrame(rows, "payload_type string, ns bigint, annotations array<struct<key:string,value:struct<label:string,x:double,y:double,z:double>>>")
    for low, high in ((0, 100), (100, 300), (300, 3000)):
        table.where(f"ns >= {10**15 + 10**9 * low} and ns < {10**15 + 10**9 * high}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    table.limit(1).withColumn("payload_type", F.lit("end")).withColumn("ns", F.lit(1 << 62)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    batch = frames(table.withColumn("annotations", F.map_from_entries("annotations")), 2)
    assert sorted(map(str, drain(frame_stream(stream, 2)).collect())) == sorted(map(str, batch.collect())) != []


def test_streams_without_lists_call_no_processor_for_each_source(events):
    held = plans.source(staged(events, "event_id", "ts", ends=ENDS), carry=False, watermark="0 seconds")
    assert "TransformWithState" not in graph_stream({"blackout": plans.PLANS["blackout"](held)})._jdf.queryExecution().analyzed().toString()


def _taken(path):
    return sum(os.lstat(os.path.join(d, f)).st_blocks * 512 for d, _, names in os.walk(path) for f in names if os.path.lexists(os.path.join(d, f)))


def test_small_state_takes_little_disk(events, tmp_path):
    """Windows over windows: operators that keep state are few, and a store with few rows takes little of the executors' disk."""
    spark = events.sparkSession
    local = spark._jvm.org.apache.spark.util.Utils.getLocalDir(spark.sparkContext._jsc.sc().conf())
    nodes = graph_stream({"q": dark(plans.source(staged(events, "event_id", "ts", ends=ENDS), carry=False, watermark="0 seconds"))})
    before, seen = _taken(local), []

    def write(rows, n):
        rows.write.mode("overwrite").parquet(f"{tmp_path}/nodes/batch={n}")
        seen.append(_taken(local))

    progress = write_batches(nodes, write, str(tmp_path / "progress"))
    assert len(progress[-1]["stateOperators"]) <= 14
    assert max(seen) - before < 40e6


def test_the_graph_without_lists_opens_few_stores(events, tmp_path):
    """What a stream with little state costs is opening and committing its stores: one for each of seven operators in each partition, a join's too."""
    nodes = graph_stream({"q": plans.in_area(plans.source(staged(events, "event_id", "ts", ends=ENDS), carry=False, watermark="0 seconds"))})
    progress = write_batches(nodes, lambda rows, n: rows.write.mode("overwrite").parquet(f"{tmp_path}/nodes/batch={n}"), str(tmp_path / "progress"))
    held = progress[-1]["stateOperators"]
    assert len(held) <= 7 and sum(s["numStateStoreInstances"] for s in held) <= 7 * int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def test_results_and_edges_with_lists_come_from_one_aggregation(events, tmp_path):
    """Windows are computed for results and edges together, for sources and for acknowledgements: six operators with state, not seven. Results with null payloads and keys are there too."""
    rows = events.withColumn("user_id", F.expr("if(user_id = 3, null, user_id)")).withColumn("event_type", F.expr("if(event_id % 4 = 0, null, event_type)"))
    held = plans.in_area(plans.source(staged(rows, "event_id", "ts", ends=ENDS), watermark="0 seconds"))
    nodes = standard_graph_stream({"q": held})
    progress = write_batches(nodes, lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/nodes/batch={n}"), str(tmp_path / "progress"))
    assert len(progress[-1]["stateOperators"]) <= 6
    found = events.sparkSession.read.schema("kind string, uid1 string, uid2 string, ts bigint, data string").parquet(f"{tmp_path}/nodes")
    batch = forward_graph({"q": plans.in_area(plans.source(rows))}, rows, "event_id", "ts").nodes()
    shown = lambda df: sorted(map(str, df.select("kind", "uid1", "uid2", "ts", "data").collect()))
    assert shown(found) == shown(batch) != []


def test_payloads_are_dealt_before_they_are_gathered(spark, tmp_path):
    """No task gathers windows of what it has read, which it would hold as a whole; payloads without annotations count, and frames are those of the table."""
    prepare(spark)
    kinds = ["lidar", "ring_front_left", "ring_front_right"]
    rows = [(kinds[n % 3], 10**15 + 7 * 10**9 * n, None if n % 4 == 0 else [(f"t{n}", ("A", n / 7, 0.0, 1.0))]) for n in range(90)]
    table = spark.createDataFrame(rows + rows[30:33], "payload_type string, ns bigint, annotations array<struct<key:string,value:struct<label:string,x:double,y:double,z:double>>>")
    end = table.limit(1).withColumn("payload_type", F.lit("end")).withColumn("ns", F.lit(1 << 62))
    table.unionByName(end).write.parquet(str(tmp_path / "in"))
    query = started(frame_stream(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")), 2).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True), spark)
    query.awaitTermination()
    plan = query._jsq.explainInternal(False).splitlines()
    below = [plan[n + 1] for n, line in enumerate(plan) if "partial_collect_list" in line]
    assert len(below) == 2 and all("Exchange hashpartitioning(vehicle" in line for line in below)
    batch = frames(table.withColumn("annotations", F.map_from_entries("annotations")), 2)
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(str, batch.collect())) != []
