import itertools
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from wellspring.operators import Lineage, forward_graph
from wellspring.operators.graph import violations
from wellspring.plans import workloads

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
SIDE = "struct<payload_type:string,annotations:map<string,struct<label:string,x:double,y:double,z:double>>>"


def frames_of(spark):
    walk = ("PEDESTRIAN", 1.0, 1.0, 0.0)
    rows = [(1, T0, ("lidar", {}), ("ring_front_left", {"p": walk, "q|": walk}), ("ring_front_right", {"q|": walk, "p": walk}))]
    rows += [(2, T0 + timedelta(seconds=1), ("lidar", {}), ("ring_front_left", {}), ("ring_front_right", {"p": walk}))]
    return spark.createDataFrame(rows, f"uid bigint, ts timestamp, lidar {SIDE}, left {SIDE}, right {SIDE}")


def crossings():
    """By brute force: (left id, right id, window end in seconds) of each pair of sightings by different cameras, and their sources."""
    seen = [(1, 0, 0, "p"), (1, 0, 0, "q|"), (1, 0, 1, "q|"), (1, 0, 1, "p"), (2, 1, 1, "p")]
    name = lambda s: f"{s[0]}@{s[2]}@{s[3].replace('|', chr(92) + 'p')}"
    for a, b in itertools.product(seen, seen):
        for end in (1, 2, 3):
            if a[3] == b[3] and a[2] != b[2] and all(end - 2 <= s[1] < end for s in (a, b)):
                yield f"crossed|{name(a)}#{name(b)}#{int(T0.timestamp() + end) * 1_000_000}", {a[0], b[0]}


@pytest.mark.parametrize("carry", [True, False])
def test_each_exploded_result_is_a_sink_of_its_own(spark, carry):
    rows = frames_of(spark)
    crossed = workloads.crossed_pedestrians(Lineage.source(rows, "uid", "ts", carry))
    expected = dict(crossings())
    graph = forward_graph({"crossed": crossed}, rows, "uid", "ts")
    assert sorted(r.id for r in graph.sink.collect()) == sorted(expected) and crossed.df.count() == len(expected) == 10
    assert {(r.sink, int(r.source)) for r in graph.edge.collect()} == {(k, u) for k, us in expected.items() for u in us}
    assert graph.ack.count() == len(expected) + 2 and violations(graph.nodes()).count() == 0


@pytest.mark.parametrize("carry", [True, False])
def test_elements_and_entries_have_ids_through_later_steps(spark, carry):
    rows = spark.createDataFrame([(7, T0, ["x", "x", None], {"k@": 1, "k": 1}), (8, T0, [], {}), (9, T0, None, None)], "uid bigint, ts timestamp, a array<string>, m map<string,int>")
    held = Lineage.source(rows, "uid", "ts", carry).explode(F.col("a"), "e").explode(F.col("m"), "k", "v")
    assert sorted(r.rid for r in held.df.collect()) == sorted(f"7@{i}@{k}" for i in range(3) for k in ("k\\a", "k"))
    assert {(r.sink, r.source) for r in held.edges().collect()} == {(f"|7@{i}@{k}", 7) for i in range(3) for k in ("k\\a", "k")}
    both = held.union(held.where("k = 'k'")).window_agg(["e"], "1 hours", n=F.count("*"))
    assert {(r.e, r.n) for r in both.plain().collect()} == {("x", 6), (None, 3)}
    assert {r.source for r in both.edges().collect()} == {7}


@pytest.mark.parametrize("carry", [True, False])
def test_keys_of_any_type_have_texts_of_their_own(spark, carry):
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        summer = [datetime(2024, 10, 27, h, 30, tzinfo=timezone.utc) for h in (0, 1)]
        arrays = [["a, b"], ["a", "b"], ["a", None], ["a"], [], None]
        rows = [(k, T0, a, t, (t, s), b) for k, (a, t, s, b) in enumerate(itertools.product(arrays, summer, [None, "x|y"], [b"|", b"\\p"]))]
        table = spark.createDataFrame(rows, "uid bigint, ts timestamp, a array<string>, t timestamp, s struct<t:timestamp,x:string>, b binary")
        found = Lineage.source(table, "uid", "ts", carry).window_agg(["a", "t", "s", "b"], "1 hours", n=F.count("*"))
        assert len({r.rid for r in found.df.collect()}) == len(rows) == found.edges().select("sink").distinct().count()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_names_that_operators_need_are_refused(spark):
    rows = spark.createDataFrame([(1, T0, 2)], "uid bigint, ts timestamp, x int")
    for name in ("event", "RID", "prov", "rkey", "window"):
        with pytest.raises(ValueError, match=name):
            Lineage.source(rows.withColumnRenamed("x", name), "uid", "ts")
    with pytest.raises(ValueError, match="ts"):
        Lineage.source(rows.withColumnRenamed("ts", "at").withColumnRenamed("x", "ts"), "uid", "at")
    held = Lineage.source(rows, "uid", "ts")
    for broken in (lambda: held.with_column("rid", F.lit(1)), lambda: held.select(F.lit(1).alias("event")), lambda: held.window_agg(["x"], "1 hours", prov=F.count("*")), lambda: held.explode(F.array("x"), "rkey")):
        with pytest.raises(ValueError, match="taken"):
            broken()
    with pytest.raises(ValueError, match="window_end"):
        held.window_agg(["x"], "1 hours", n=F.count("*")).window_agg(["window_end"], "1 hours", n=F.count("*"))
