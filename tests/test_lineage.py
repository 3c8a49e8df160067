from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from wellspring.functions import speed_kmh, uid
from wellspring.operators import Lineage, forward_graph
from wellspring.operators.graph import delivery_order, latencies, violations
from wellspring.plans import events as plans
from wellspring.plans import workloads
from wellspring.scratch import written
from wellspring.sinks import DeliveryStore, backward_lines, command_lines, graph_tables, lines, timestamped_lines

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def events(spark):
    rows = []
    for k in range(400):
        rows.append((k, at(k * 5400 + (k * k * 37) % 5000), k * k % 7, ("click", "view", "purchase")[k % 3], float((k * 7919) % 9000) / 100))
    return spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double").cache()


@pytest.mark.parametrize("carry", [True, False])
def test_stopped_vehicles_and_accident_of_two_vehicles(spark, carry):
    rows = [(k, at(30 * (k // 2)), 0, k % 2 + 1, 0, 0, 1, 0, 10, 500) for k in range(8)]
    reports = spark.createDataFrame(rows, "uid bigint, ts timestamp, type int, vid bigint, speed int, xway int, lane int, dir int, seg int, pos int")
    stopped = workloads.stopped_vehicles(Lineage.source(reports, "uid", "ts", carry))
    accident = workloads.accidents(stopped)
    assert stopped.df.count() == 2 and accident.df.count() == 1
    assert accident.reach == 150
    graph = forward_graph({"stopped": stopped, "accident": accident}, reports, "uid", "ts")
    assert [x.count() for x in (graph.source, graph.sink, graph.edge, graph.ack)] == [8, 3, 16, 11]
    assert violations(graph.nodes()).collect() == []


@pytest.mark.parametrize("meters,days", [(8, 1), (7, 0)])
def test_blackout_and_anomaly_of_meters(spark, meters, days):
    rows = [(m * 24 + h, at(3600 * h), str(m), 0) for m in range(meters) for h in range(24)] + [(9000 + h, at(3600 * h), "x", 10) for h in range(24)]
    readings = Lineage.source(spark.createDataFrame(rows, "uid bigint, ts timestamp, key string, value bigint"), "uid", "ts", carry=False)
    dark = workloads.blackouts(readings)
    assert dark.df.count() == days and dark.edges().count() == 192 * days
    odd = workloads.anomalies(readings)
    (row,) = odd.df.collect()
    assert (row.difference, row.ts) == (230, at(23 * 3600).replace(tzinfo=None)) and odd.edges().count() == 24


@pytest.mark.parametrize("n,found", [(10, 1), (9, 0)])
def test_readings_in_area(spark, n, found):
    inside = [(k, at(k * 14), 7, 39.915, 116.31) for k in range(n)]
    outside = [(100, at(3), 7, 39.912915, 116.31), (101, at(4), 7, 39.915, 116.3188575)]
    cars = Lineage.source(spark.createDataFrame(inside + outside, "uid bigint, ts timestamp, car_id int, lat double, lon double"), "uid", "ts")
    result = workloads.in_area(cars).df.collect()
    assert len({r.rid for r in result}) >= found and all(r["count"] == n and 100 not in r.prov for r in result) and bool(result) == bool(found)


def test_high_speed_and_no_time_between_readings(spark):
    rows = [(k, at(k * 5), 1, 39.9 + k * 0.002, 116.3) for k in range(12)] + [(50, at(0), 2, 39.9, 116.3), (51, at(0), 2, 39.95, 116.3)]
    cars = Lineage.source(spark.createDataFrame(rows, "uid bigint, ts timestamp, car_id int, lat double, lon double"), "uid", "ts")
    fast = workloads.high_speed(cars).df.collect()
    assert fast and {r.car_id for r in fast} == {1}
    assert all(abs(r.average - 0.002 * 110574.307 / 5 * 3.6) < 1 for r in fast)
    nothing = spark.range(1).select(speed_kmh(*(F.lit(x) for x in (1.0, 1.0, 5, 2.0, 2.0, 5))).alias("v")).first()
    assert nothing.v is None


def test_pedestrians_and_bicycles_of_frames(spark):
    side = "struct<payload_type:string,annotations:map<string,struct<label:string,x:double,y:double,z:double>>>"
    walk, ride = ("PEDESTRIAN", 1.0, 1.0, 0.0), ("BICYCLE", 5.0, 19.0, 0.0)
    far = ("BICYCLE", 5.0, 20.0, 0.0)
    rows = [(1, at(0), ("lidar", {f"b{k}": ride for k in range(6)} | {"f": far}), ("ring_front_left", {"p": walk}), ("ring_front_right", {}))]
    rows += [(2, at(1), ("lidar", {f"b{k}": ride for k in range(6)}), ("ring_front_left", {}), ("ring_front_right", {"p": walk, "q": walk}))]
    frames = Lineage.source(spark.createDataFrame(rows, f"uid bigint, ts timestamp, lidar {side}, left {side}, right {side}"), "uid", "ts")
    crossed = workloads.crossed_pedestrians(frames).df.collect()
    assert {r.l_object_id for r in crossed} == {"p"} and all(r.prov == [1, 2] for r in crossed)
    cycles = workloads.cycles_in_front(frames).df.collect()
    assert {(r["count"], tuple(r.prov)) for r in cycles} == {(12, (1, 2))}


@pytest.mark.parametrize("name", sorted(plans.PLANS))
def test_both_ways_to_know_lineage_agree(events, name):
    plan = plans.PLANS[name]
    carried, traced = plan(plans.source(events)), plan(plans.source(events, carry=False))
    assert sorted(map(tuple, carried.edges("q").collect())) == sorted(map(tuple, traced.edges("q").collect()))
    assert sorted(map(str, carried.plain().collect())) == sorted(map(str, traced.plain().collect()))
    assert "prov" not in traced.df.columns


@pytest.mark.parametrize("name", ["anomaly", "inarea", "speed", "crossed", "blackout"])
def test_lineage_is_enough_to_make_the_results_again(events, name):
    plan = plans.PLANS[name]
    first = plan(plans.source(events))
    used = events.join(first.edges().select(F.col("source").alias("event_id")).distinct(), "event_id", "left_semi")
    again = plan(plans.source(used))
    before, after = (sorted(map(str, q.plain().collect())) for q in (first, again))
    assert set(before) <= set(after)
    if name == "anomaly":
        assert before == after
        assert sorted(map(tuple, first.edges().collect())) == sorted(map(tuple, again.edges().collect()))


def test_window_aggregate_equals_brute_force(events):
    found = {(r.user_id, r.window_end): (r.n, r.prov) for r in events.transform(lambda d: plans.source(d).window_agg(["user_id"], "6 hours", "2 hours", n=F.count("*")).df).collect()}
    expected = defaultdict(list)
    for r in events.collect():
        start = datetime(2023, 12, 31)
        while start <= r.ts:
            if start <= r.ts < start + timedelta(hours=6):
                expected[r.user_id, start + timedelta(hours=6)].append(r.event_id)
            start += timedelta(hours=2)
    assert found == {k: (len(v), sorted(v)) for k, v in expected.items()}


def test_interval_join_bounds_are_included(spark):
    rows = spark.createDataFrame([(1, at(0), "a"), (2, at(3600), "a"), (3, at(3601), "a"), (4, at(0), "b")], "uid bigint, ts timestamp, k string")
    left, right = Lineage.source(rows, "uid", "ts"), Lineage.source(rows.where("uid = 1"), "uid", "ts")
    joined = left.interval_join(right, {"k": "k"}, "0 hours", "1 hours")
    assert {(r.l_uid, tuple(r.prov)) for r in joined.df.collect()} == {(1, (1,)), (2, (1, 2))} and joined.reach == 3600


def test_union_and_explode_keep_lineage(spark):
    rows = spark.createDataFrame([(1, at(0), [1, 2]), (2, at(60), [3])], "uid bigint, ts timestamp, v array<int>")
    for carry in (True, False):
        one = Lineage.source(rows, "uid", "ts", carry)
        both = one.union(one.where("uid = 2")).explode(F.col("v"), "x").window_agg(["x"], "1 hours", n=F.count("*"))
        assert {(r.x, r.n) for r in both.df.collect()} == {(1, 1), (2, 1), (3, 2)}
        assert {(r.sink.split("|")[1], r.source) for r in both.edges().collect()} == {("1", 1), ("2", 1), ("3", 2)}


def test_empty_input_gives_empty_results(events):
    none = plans.source(events.where("event_id < 0"))
    assert all(plan(none).df.count() == 0 for plan in plans.PLANS.values())


def test_graph_rules_find_faults(spark):
    sound = [("SOURCE", "1", None, 10), ("SINK", "q|a", None, 20), ("EDGE", "1", "q|a", 20), ("ACK", "1", None, 40), ("ACK", "q|a", None, 20)]
    frame = lambda rows: spark.createDataFrame([(*r, None) for r in rows], "kind string, uid1 string, uid2 string, ts bigint, data string")
    rules = lambda rows: {r.rule for r in violations(frame(rows)).collect()}
    assert rules(sound) == set()
    assert rules(sound + [sound[0]]) == {"vertex once"}
    assert rules(sound + [sound[3]]) == {"ack once"}
    assert rules(sound + [("ACK", "9", None, 1)]) == {"ack of a vertex"}
    assert rules(sound[:3] + sound[4:]) == {"vertex acked"}
    assert rules(sound[:3] + [("ACK", "1", None, 5), sound[4]]) == {"ack after vertex", "edge before ack"}
    assert rules(sound[:2] + [("EDGE", "1", "q|a", 15)] + sound[3:]) == {"edge after vertices"}
    assert rules(sound + [sound[2]]) == {"edge once"}
    placed = lambda batches: delivery_order(frame(sound).join(spark.createDataFrame(batches, "kind string, uid1 string, batch bigint"), ["kind", "uid1"])).first()
    good = [("SOURCE", "1", 0), ("SINK", "q|a", 0), ("EDGE", "1", 0), ("ACK", "1", 1), ("ACK", "q|a", 0)]
    assert tuple(placed(good)) == (1, 0, 0)
    assert tuple(placed([("SOURCE", "1", 1), *good[1:3], ("ACK", "1", 2), good[4]])) == (1, 1, 0)
    assert tuple(placed([*good[:2], ("EDGE", "1", 2), *good[3:]])) == (1, 0, 1)


def test_encoders(events, spark):
    graph = forward_graph({"inarea": plans.in_area(plans.source(events))}, events, "event_id", "ts")
    nodes = graph.nodes().cache()
    text = [r.value for r in lines(nodes).collect()]
    assert {t.split(" ::: ")[0] for t in text} == {"SOURCE", "SINK", "EDGE", "ACK"} and len(text) == nodes.count()
    stamped = [r.value.split(" ", 3) for r in timestamped_lines(nodes, ordered=True).collect()]
    assert stamped == sorted(stamped, key=lambda x: (int(x[0]), int(x[1])))
    assert {r.value[2:4] for r in command_lines(nodes).collect()} == {"an", "ae", "cn"}
    vertices, relations = graph_tables(nodes)
    assert vertices.count() == graph.source.count() + graph.sink.count() and relations.count() == graph.edge.count()
    block = backward_lines(plans.in_area(plans.source(events)), events, "event_id").first().value
    count = int(block.split("<- [")[1].split("]")[0])
    assert block.startswith("> {") and block.endswith("\n}") and block.count("\n") == count + 1
    late = latencies(nodes, graph.max_delay).groupBy("kind").agg(F.max("latency_u").alias("u")).collect()
    assert {r.kind: r.u for r in late} == {"SOURCE": 1.0, "SINK": 0.0}


def test_delivery_store_delivers_each_element_once(events, spark, tmp_path):
    graph = forward_graph({"inarea": plans.in_area(plans.source(events))}, events, "event_id", "ts")
    nodes = graph.nodes().where("kind <> 'ACK'").cache()
    store = DeliveryStore(spark, str(tmp_path / "store")).create(["inarea"])
    half = nodes.agg(F.percentile("ts", 0.5)).first()[0]
    store.append(nodes.where(F.col("ts") < half), 0)
    store.mark_safe("inarea", int(half), 0)
    first = store.deliver(graph.max_delay, 0).collect()
    store.append(nodes, 1)
    store.append(nodes, 1)  # the batch comes again
    store.mark_safe("inarea", 2**53, 1)
    second = store.deliver(graph.max_delay, 1).collect()
    keys = [(r.kind, r.uid1, r.uid2) for r in first + second]
    assert len(keys) == len(set(keys)) == graph.nodes().count()
    assert store.pending(graph.max_delay).count() == 0


def test_no_source_is_acknowledged_before_every_sink_has_reported(spark, tmp_path):
    node = lambda *rows: spark.createDataFrame([(*r, None) for r in rows], "kind string, uid1 string, uid2 string, ts bigint, data string")
    store = DeliveryStore(spark, str(tmp_path / "store")).create(["a", "b"])
    store.append(node(("SOURCE", "1", None, 10), ("SINK", "a|x", None, 20), ("EDGE", "1", "a|x", 20)), 0)
    store.mark_safe("a", 10**12, 0)
    first = store.deliver(1, 0).collect()
    store.append(node(("SOURCE", "1", None, 10), ("SINK", "b|y", None, 30), ("EDGE", "1", "b|y", 30)), 1)
    store.mark_safe("b", 10**12, 1)
    second = store.deliver(1, 1).collect()
    assert {(r.kind, r.uid1) for r in first} == {("SOURCE", "1"), ("SINK", "a|x"), ("EDGE", "1"), ("ACK", "a|x")}
    assert {(r.kind, r.uid1) for r in second} == {("SINK", "b|y"), ("EDGE", "1"), ("ACK", "b|y"), ("ACK", "1")}


@pytest.mark.parametrize("carry", [True, False])
def test_ids_of_null_and_marked_keys_differ(spark, carry):
    keys = [("a|b", "c"), ("a", "b|c"), (None, "z"), ("", "z"), ("\\0", "z"), ("a#b", "z"), ("a\\hb", "z"), ("a", "b"), (None, None)]
    rows = spark.createDataFrame([(k, at(0), *key) for k, key in enumerate(keys)], "uid bigint, ts timestamp, a string, b string")
    found = Lineage.source(rows, "uid", "ts", carry).window_agg(["a", "b"], "1 hours", n=F.count("*"))
    assert len({r.rid for r in found.df.collect()}) == len(keys)
    edges = found.edges().collect()
    assert len(edges) == len({r.sink for r in edges}) == len(keys)
    twice = found.window_join(found, {"b": "b"}, "1 hours")
    assert len({r.rid for r in twice.df.collect()}) == twice.df.count() and twice.edges().count() == sum(1 if x.l_a == x.r_a else 2 for x in twice.df.collect())


def test_ids_keep_generator_and_counter(spark):
    r = spark.range(1).select(uid(F.lit(3), F.lit(12345)).alias("u")).first()
    assert r.u == (3 << 58) | 12345


@pytest.mark.parametrize("few", [True, False])
def test_pairs_are_not_compared_where_a_plan_gives_each_once(spark, monkeypatch, few):
    """A join's pairs come out of it as they are, also those of a reading that is in its own day, and of rows that are there twice."""
    if not few:
        monkeypatch.setattr("wellspring.operators.lineage.BROADCAST_ROWS", 0)
    rows = [(m * 24 + h, at(3600 * h), str(m), 9 + h * m) for m in range(5) for h in range(24)]
    readings = spark.createDataFrame(rows + rows[:30] + rows[-1:], "uid bigint, ts timestamp, key string, value bigint")
    plan = lambda carry: workloads.anomalies(Lineage.source(readings, "uid", "ts", carry))
    found = plan(False).edges("odd")
    assert found._jdf.queryExecution().optimizedPlan().nodeName() in ("Union", "Project")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plan(True).edges("odd").collect()))
    assert found.count() == found.distinct().count() == 5 * 24


def test_chains_of_joins_give_each_pair_once(spark, events):
    held = {carry: plans.source(events, carry=carry) for carry in (True, False)}
    chain = lambda e: e.window_join(e.where("value > 40"), {"user_id": "user_id"}, "4 hours").window_join(e.where("value > 10"), {"l_user_id": "user_id"}, "8 hours", prefix=("a_", "b_"))
    carried, traced = (sorted(map(tuple, chain(held[c]).edges("q").collect())) for c in (True, False))
    assert carried == traced and len(traced) == len(set(traced)) > 100


def test_a_join_of_sources_reads_its_results_once(spark):
    """Both sources of a pair are in its key: pairs are not written down, and no side is read for itself. Rows that are there twice, rows without an id and rows that meet themselves are as with lists."""
    rows = [(k, at(600 * k), k % 3, "view" if k % 2 else "click") for k in range(40)]
    rows = spark.createDataFrame([*rows, *rows[5:15], (None, at(600), 1, "view"), (None, at(700), 1, "click"), (90, at(700), None, "click")], "uid bigint, ts timestamp, user bigint, kind string")
    for plan in (lambda e: e.where("kind = 'click'").window_join(e.where("kind = 'view'"), {"user": "user"}, "2 hours", "1 hours"), lambda e: e.interval_join(e, {"user": "user"}, "0 hours", "1 hours")):
        carried, traced = (plan(Lineage.source(rows, "uid", "ts", carry)) for carry in (True, False))
        before = written(spark)
        found = traced.edges("q")
        assert written(spark) == before and "Union" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(str, found.distinct().collect())) == sorted(map(str, carried.edges("q").collect())) != []
