"""The forward graph of one or more queries: every source and result once, edges between them, and an acknowledgement for each vertex.

An acknowledgement says that its vertex gets no further edge. A result is acknowledged at once; a source when event time has passed its own by more
than ``max_delay``, the longest sum of window lengths of any query. All tables are plain joins and aggregations, each partitioned by id.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.operators.lineage import Lineage
from wellspring.scratch import kept

#: Sources whose edges are compared in one task.
SOURCES_A_TASK = 50_000
#: Order of kinds at one time. Fixed values.
ORDER = {"SINK": 0, "SOURCE": 1, "EDGE": 2, "ACK": 3}


@dataclass(frozen=True)
class ForwardGraph:
    """``source`` (id, ts, data), ``sink`` (id, ts, data), ``edge`` (source, sink), ``ack`` (id, ts); source ids as text. ``timed``: edges with ``ts``, their later vertex's; null where there is no such source."""

    source: DataFrame
    sink: DataFrame
    timed: DataFrame
    ack: DataFrame
    max_delay: int

    @property
    def edge(self) -> DataFrame:
        return self.timed.select("source", "sink")

    def nodes(self) -> DataFrame:
        """The graph as one table: ``kind``, ``uid1``, ``uid2`` (edges only), ``ts`` (microseconds; an edge's is its later vertex's) and ``data``."""
        none = F.lit(None).cast("string")
        return reduce(
            DataFrame.unionByName,
            [
                self.source.select(F.lit("SOURCE").alias("kind"), F.col("id").alias("uid1"), none.alias("uid2"), "ts", "data"),
                self.sink.select(F.lit("SINK").alias("kind"), F.col("id").alias("uid1"), none.alias("uid2"), "ts", "data"),
                self.timed.where("ts is not null").select(F.lit("EDGE").alias("kind"), F.col("source").alias("uid1"), F.col("sink").alias("uid2"), "ts", none.alias("data")),
                self.ack.select(F.lit("ACK").alias("kind"), F.col("id").alias("uid1"), none.alias("uid2"), "ts", none.alias("data")),
            ],
        )


def _us(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.unix_micros("ts")) if dict(df.dtypes)["ts"] == "timestamp" else df


def forward_graph(queries: dict[str, Lineage], sources: DataFrame, uid: str, ts: str, max_delay: int | None = None) -> ForwardGraph:
    """The graph of named queries over ``sources``. ``max_delay`` in seconds; by default what the queries' windows need."""
    delay = max(q.reach for q in queries.values()) if max_delay is None else max_delay
    queries = {n: q.settled() for n, q in queries.items()}
    sink = _us(reduce(DataFrame.unionByName, [q.sinks(n) for n, q in queries.items()])).groupBy(F.col("sink").alias("id")).agg(F.max("ts").alias("ts"), F.max("data").alias("data"))
    payload = [c for c in sources.columns if c not in (uid, ts)]
    held = _us(sources.withColumnRenamed(ts, "ts") if ts != "ts" else sources)
    # Pairs are dealt by source once: for their copies, and for the source's time. A result's time comes along.
    found = reduce(DataFrame.unionByName, [_pairs(q, n) for n, q in queries.items()])
    tasks = max(int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held.count() // SOURCES_A_TASK))
    once = found.repartition(tasks, "uid").groupBy("uid", "sink").agg(F.max("b").alias("b"))
    seen = held.select(F.col(uid).alias("uid"), "ts").repartition(tasks, "uid").groupBy("uid").agg(F.max("ts").alias("a"))
    late = F.when(F.col("a").isNotNull(), F.greatest("a", "b")).alias("ts")
    edge = kept(once.join(seen, "uid", "left").select("uid", "sink", late))
    source = held.join(edge.select(F.col("uid").alias(uid)).distinct(), uid, "left_semi").select(F.col(uid).cast("string").alias("id"), "ts", F.to_json(F.struct(*payload)).alias("data"))
    ack = source.select("id", (F.col("ts") + delay * 1_000_000).alias("ts")).unionByName(sink.select("id", "ts"))
    return ForwardGraph(source, sink, edge.select(F.col("uid").cast("string").alias("source"), "sink", "ts"), ack, delay)


def _pairs(q: Lineage, name: str) -> DataFrame:
    """``sink``, its time ``b``, and ``uid`` of a source, each pair at least once."""
    at = F.col("ts") if dict(q.df.dtypes)["ts"] == "bigint" else F.unix_micros("ts")
    found = q.pairs(F.struct(F.concat(F.lit(f"{name}|"), "rid").alias("sink"), at.alias("ts")), once=False)
    return found.select(F.col("out.sink").alias("sink"), F.col("out.ts").alias("b"), "uid")


def violations(nodes: DataFrame) -> DataFrame:
    """``rule`` and the offending ``uid1``, ``uid2`` in a graph of :meth:`ForwardGraph.nodes`; none for a sound graph."""
    own = F.when(F.col("kind") == "ACK", F.col("ts")), F.when(F.col("kind") != "ACK", F.col("ts"))
    count = lambda kinds: F.sum(F.col("kind").isin(*kinds).cast("int"))
    each = nodes.where("kind <> 'EDGE'").groupBy("uid1").agg(count(["SOURCE", "SINK"]).alias("n"), count(["ACK"]).alias("m"), F.min(own[1]).alias("seen"), F.min(own[0]).alias("acked"))
    edges = nodes.where("kind = 'EDGE'").select("uid1", "uid2", "ts")
    times = each.select("uid1", F.when(F.col("n") > 0, F.col("seen")).alias("seen"), F.col("acked"))
    after, before = ("edge after vertices", "seen is null or ts < seen"), ("edge before ack", "ts > acked")
    return reduce(
        DataFrame.unionByName,
        [
            _broken(each.withColumn("uid2", F.lit(None).cast("string")), ("vertex once", "n > 1"), ("ack once", "m > 1"), ("ack of a vertex", "n = 0"), ("vertex acked", "m = 0"), ("ack after vertex", "acked < seen")),
            _broken(edges.join(times, "uid1", "left"), after, before),
            _broken(edges.join(times.withColumnRenamed("uid1", "uid2"), "uid2", "left"), after, before),
            _broken(edges.groupBy("uid1", "uid2").agg(F.count("*").alias("k")), ("edge once", "k > 1")),
        ],
    )


def _broken(rows: DataFrame, *rules: tuple[str, str]) -> DataFrame:
    """A row for each rule that a row breaks, from one look at it."""
    found = F.array_compact(F.array(*(F.when(F.expr(broken), F.lit(name)) for name, broken in rules)))
    return rows.select(F.explode(found).alias("rule"), "uid1", "uid2")


def delivery_order(nodes: DataFrame) -> DataFrame:
    """``edges`` of a graph delivered in batches (``batch``; within one by kind), and how many came before a vertex of theirs (``early``) or after its ACK (``late``)."""
    kinds = F.create_map(*(F.lit(x) for pair in ORDER.items() for x in pair))
    placed = nodes.withColumn("at", F.struct("batch", F.when(F.col("kind").isin("SINK", "SOURCE"), 0).otherwise(kinds[F.col("kind")]).alias("order")))
    vertex = placed.where("kind <> 'EDGE'").groupBy(F.col("uid1").alias("id")).agg(F.max(F.when(F.col("kind") != "ACK", F.col("at"))).alias("seen"), F.min(F.when(F.col("kind") == "ACK", F.col("at"))).alias("acked"))
    edges = placed.where("kind = 'EDGE'")
    ends = reduce(DataFrame.unionByName, [edges.select(F.concat_ws(" ", "uid1", "uid2").alias("edge"), F.col(c).alias("id"), "at") for c in ("uid1", "uid2")]).join(vertex, "id", "left")
    each = ends.groupBy("edge").agg(F.max(F.coalesce(F.col("at") <= F.col("seen"), F.lit(True)).cast("int")).alias("early"), F.max(F.coalesce(F.col("at") >= F.col("acked"), F.lit(False)).cast("int")).alias("late"))
    return each.agg(F.count("*").alias("edges"), F.coalesce(F.sum("early"), F.lit(0)).alias("early"), F.coalesce(F.sum("late"), F.lit(0)).alias("late"))


def latencies(nodes: DataFrame, max_delay: int) -> DataFrame:
    """Logical latency of acknowledgements, in seconds and in units of ``max_delay``: ``uid1``, ``kind``, ``latency_s``, ``latency_u``."""
    vertex = nodes.where("kind in ('SOURCE', 'SINK')").select("uid1", "kind", F.col("ts").alias("seen"))
    ack = nodes.where("kind = 'ACK'").select("uid1", F.col("ts").alias("acked"))
    late = (F.col("acked") - F.col("seen")) / 1e6
    return vertex.join(ack, "uid1").select("uid1", "kind", late.alias("latency_s"), (late / max_delay).alias("latency_u"))
