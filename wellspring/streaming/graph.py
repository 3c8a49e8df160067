"""The forward graph as one stream of sources, results, edges and acknowledgements, with keyed state and event-time timers."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wellspring.operators.lineage import HIDDEN, Lineage
from wellspring.streaming.standard import standard_graph_stream

_NODES = "kind string, uid1 string, uid2 string, ts long, data string"


def prepare(spark: SparkSession) -> None:
    """State that is kept by key needs the RocksDB store.

    Each stateful operator has a store in each partition, and a store sets some 4 MB of disk aside for its logs before it has a row, so this is turned off. A join of two streams keeps its four tables in one store.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    spark.conf.set("spark.sql.streaming.join.stateFormatVersion", "3")


#: Keys that the sources of one slice of time are dealt to, and slices of a delay.
BUCKETS, SLICES = 256, 4


class _Graph(StatefulProcessor):
    """Of each result, itself and its ACK. Of each source, itself when first seen, its edges, and its ACK when event time has passed its slice of time by more than the delay.

    A key has all sources of one slice and bucket, so state is read and a timer set once for them and not for each source.
    The timer of a batch comes after its rows, and windows that hold a source end before the delay is over, so no edge follows an ACK.
    """

    def __init__(self, delay_ms: int, slice_us: int):
        self.delay_ms, self.slice_us = delay_ms, slice_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", "id string, ts long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        known, new = None, []
        for r in rows:
            if r.sink is None:
                yield Row(kind="SINK", uid1=r.id, uid2=None, ts=r.ts, data=r.data)
                yield Row(kind="ACK", uid1=r.id, uid2=None, ts=r.ts, data=None)
                continue
            if known is None:
                known = {s[0] for s in self.seen.get()}
                if not known:
                    self.handle.registerTimer((key[0] + 1) * self.slice_us // 1000 + self.delay_ms + 1)
            if r.id not in known:
                known.add(r.id)
                new.append((r.id, r.source_ts))
                yield Row(kind="SOURCE", uid1=r.id, uid2=None, ts=r.source_ts, data=r.data)
            yield Row(kind="EDGE", uid1=r.id, uid2=r.sink, ts=max(r.ts, r.source_ts), data=None)
        if new:
            self.seen.appendList(new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        for uid, ts in self.seen.get():
            yield Row(kind="ACK", uid1=uid, uid2=None, ts=ts + self.delay_ms * 1000, data=None)
        self.seen.clear()

    def close(self) -> None:
        pass


def graph_stream(queries: dict[str, Lineage], max_delay: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The graph of streaming queries over ``stamped`` sources, or over sources with ``carry=False``, as nodes (kind, uid1, uid2, ts, data), the same as the batch graph's.

    Within a micro-batch nodes come in the order of their kinds once they are sorted by it; over micro-batches a vertex comes before its edges and these before its ACK.
    With ``stamped`` sources they come with the results' lineage, and are kept by slices of their time (a quarter of the delay) and ``buckets`` by id: a source's ACK comes up to a slice after its delay. With ``carry=False`` no row holds a list: a window's sources wait in the state of a join, row by row, and the graph is that of ``standard_graph_stream``, since a processor that is called for each source costs more. Source ids are numbers and results have a name before ``|``, so they differ.
    """
    delay = max(q.reach for q in queries.values()) if max_delay is None else max_delay
    if not any(q.carry for q in queries.values()):
        return standard_graph_stream(queries, delay)
    out, none = [], F.lit(None).cast("string")
    for name, q in queries.items():
        sink = F.concat(F.lit(f"{name}|"), "rid")
        payload = F.to_json(F.struct(*(c for c in q.df.columns if c not in (*HIDDEN, "ts"))))
        node = lambda key, to, data, at: F.struct(key.alias("id"), to.alias("sink"), data.alias("data"), at.alias("source_ts"))
        each = F.concat(F.array(node(sink, none, payload, F.lit(None).cast("bigint"))), F.transform("prov", lambda p: node(p["id"].cast("string"), sink, p["data"], p["ts"])))  # noqa: B023
        out.append(q.df.select("event", "ts", F.explode(each).alias("node")).select("event", "ts", "node.*"))
    # Sources of a slice are all before the next slice's begin, whichever side of zero they are on.
    slice_us = max(1, delay * 1_000_000 // SLICES)
    at = F.coalesce("source_ts", F.unix_micros("event"))
    nodes = reduce(DataFrame.unionByName, out).withColumn("at", at).withColumn("slice", F.expr(f"at div {slice_us}")).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)))
    return nodes.drop("at").groupBy("slice", "bucket").transformWithState(_Graph(delay * 1000, slice_us), _NODES, "append", "eventTime")
