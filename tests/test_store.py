import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wellspring import metrics
from wellspring.operators.asof import next_in_log
from wellspring.sinks import DeliveryStore

NODE = "kind string, uid1 string, uid2 string, ts bigint, data string"


def nodes(spark, *rows):
    return spark.createDataFrame([(*r, None) for r in rows], NODE)


@pytest.mark.parametrize("cell", [10, 1000, 10**9])
def test_next_in_log_equals_brute_force(spark, cell):
    rng = random.Random(cell)
    rows = [(k, rng.choice("ab"), rng.choice([rng.randrange(-300, 300), rng.randrange(-(10**6), 10**6)])) for k in range(300)]
    log = [(rng.choice("abc"), rng.choice([rng.randrange(-300, 300), rng.randrange(-(10**6), 10**6)]), rng.randrange(50)) for _ in range(80)]
    log += log[:5] + [(n, t, v + 1) for n, t, v in log[:3]]
    found = next_in_log(spark.createDataFrame(rows, "id int, name string, ts bigint"), spark.createDataFrame(log, "name string, ts bigint, value int"), "ts", "value", ["name"], cell)
    expected = [(i, n, t, *min(((u, v) for m, u, v in log if m == n and u > t), default=(None, None))) for i, n, t in rows]
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    alone = next_in_log(spark.createDataFrame(rows, "id int, name string, ts bigint"), spark.createDataFrame([], "ts bigint, value int"), "ts", "value", cell=cell)
    assert {(r.next_ts, r.next_value) for r in alone.collect()} == {(None, None)} and alone.count() == 300


def test_ack_delivery_has_no_bound_on_how_early_an_ack_is(spark):
    hour, t0 = 3_600_000_000, datetime(2024, 1, 1)
    acks = spark.createDataFrame([("a", -10 * hour, t0), ("b", -30 * hour, t0), ("c", -9000 * hour, t0), ("d", 5 * hour, t0)], "uid1 string, ts bigint, delivered timestamp")
    safe = spark.createDataFrame([("x", 0, t0 - timedelta(seconds=9)), ("y", 1, t0 - timedelta(seconds=4)), ("y", 6 * hour, t0 - timedelta(seconds=1))], "name string, ts bigint, stimulus timestamp")
    assert {r.uid1: r.delivery_ms for r in metrics.ack_delivery(acks, safe).collect()} == {"a": 4000, "b": 4000, "c": 4000, "d": None}


def filled(spark, path, polls=12):
    """A store that gets ten sources with an edge each in every step of time, and is polled after each; copies of a source come up to one step later."""
    ticks = iter(range(10**6))
    store = DeliveryStore(spark, path, lambda: float(next(ticks))).create(["q"])
    out = []
    for k in range(polls):
        rows = []
        for i in range(10):
            at = (10 * k + i) * 100_000
            rows += [("SOURCE", f"{k}-{i}", None, at), ("SINK", f"q|{k}-{i}", None, at), ("EDGE", f"{k}-{i}", f"q|{k}-{i}", at)]
            if k:
                rows += [("SOURCE", f"{k - 1}-{i}", None, at - 1_000_000), ("EDGE", f"{k - 1}-{i}", f"q|{k}-{i}", at)]
        store.append(nodes(spark, *rows), k)
        store.mark_safe("q", (k + 1) * 1_000_000, k)
        out.append(store.deliver(2, k).collect())
    return store, out


def test_polls_read_what_is_new_and_open_only(spark, tmp_path):
    store, out = filled(spark, str(tmp_path / "store"))
    keys = [(r.kind, r.uid1, r.uid2) for rows in out for r in rows]
    assert len(keys) == len(set(keys))
    everything = {(r.kind, r.uid1, r.uid2) for r in store.nodes().collect()}
    acks = {k for k in keys if k[0] == "ACK"}
    assert set(keys) - acks == everything
    # A source is acknowledged two units after it, when the sink has got there.
    assert {k[1] for k in acks} == {k[1] for k in everything if k[0] == "SINK"} | {f"{k}-{i}" for k in range(12) for i in range(10) if (10 * k + i) * 100_000 + 2_000_000 < 12_000_000}
    read = [r.read for r in store.reads().orderBy("poll").collect()]
    assert len(read) == 12 and max(read[4:]) == min(read[4:]) <= 2 * read[3]
    assert len(store._names("commits")) == 0


def test_a_late_element_is_delivered_and_a_late_copy_is_not(spark, tmp_path):
    store, out = filled(spark, str(tmp_path / "store"), polls=6)
    late = nodes(spark, ("SOURCE", "0-0", None, 0), ("SOURCE", "new", None, 5), ("EDGE", "new", "q|0-0", 5), ("SINK", "q|0-0", None, 0))
    store.append(late, 100)
    assert {(r.kind, r.uid1) for r in store.pending(2).collect()} == {("SOURCE", "new"), ("EDGE", "new"), ("ACK", "new")}
    assert {(r.kind, r.uid1) for r in store.deliver(2, 100).collect()} == {("SOURCE", "new"), ("EDGE", "new"), ("ACK", "new")}
    store.append(late, 101)
    assert store.deliver(2, 101).count() == 0


class Stopped(Exception):
    pass


def test_a_transaction_that_is_broken_off_leaves_nothing_and_comes_again(spark, tmp_path, monkeypatch):
    store = DeliveryStore(spark, str(tmp_path / "store")).create(["a"])
    rows = nodes(spark, ("SOURCE", "1", None, 10), ("SINK", "a|x", None, 20), ("EDGE", "1", "a|x", 20))

    def stop(*_):
        raise Stopped

    with monkeypatch.context() as patch:
        patch.setattr(DeliveryStore, "_record", stop)
        with pytest.raises(Stopped):
            store.commit(0, nodes=rows, safe={"a": 10**9}, name="a")
    assert store.nodes().count() == 0 and store.pending(1).count() == 0 and store.statistics().count() == 0
    assert store.commit(0, nodes=rows, safe={"a": 10**9}, name="a") and not store.commit(0, nodes=rows, safe={"a": 10**9}, name="a")
    assert [tuple(r) for r in store.statistics().collect()] == [("a", 0, 3, 20)]
    with monkeypatch.context() as patch:
        patch.setattr(DeliveryStore, "_record", stop)
        with pytest.raises(Stopped):
            store.deliver(1, 0)
    with monkeypatch.context() as patch:  # the poll is on record, but what it took in is not moved yet
        patch.setattr(DeliveryStore, "_move", stop)
        with pytest.raises(Stopped):
            store.deliver(1, 0)
    again = DeliveryStore(spark, store.path)
    first = sorted(map(tuple, again.deliver(1, 0).collect()), key=str)
    assert {(r[0], r[1]) for r in first} == {("SOURCE", "1"), ("SINK", "a|x"), ("EDGE", "1"), ("ACK", "a|x"), ("ACK", "1")} and len(first) == 5
    assert sorted(map(tuple, again.deliver(1, 0).collect()), key=str) == first
    assert again.deliver(1, 1).count() == 0 and again.nodes().count() == 3 and again.statistics().count() == 1


def test_latency_of_acks_follows_the_last_sink(spark, tmp_path):
    ticks = iter([0, 1, 10, 20, 25, 30, 90, 95])
    store = DeliveryStore(spark, str(tmp_path / "store"), lambda: float(next(ticks))).create(["a", "b"])
    store.append(nodes(spark, ("SOURCE", "1", None, 10), ("SOURCE", "2", None, 5_000_000), ("SINK", "a|x", None, 20)), 0)
    store.mark_safe("a", 3_000_000, 0)
    store.mark_safe("b", 2_000_000, 0)
    assert store.deliver(1, 0).where("kind = 'ACK' and uid1 = '1'").count() == 1
    store.mark_safe("a", 9_000_000, 1)
    store.mark_safe("b", 9_000_000, 1)
    store.deliver(1, 1)
    assert {(r.poll, r.uid1): r.delivery_ms for r in store.ack_latency().collect()} == {(0, "1"): 5000, (1, "2"): 5000}
