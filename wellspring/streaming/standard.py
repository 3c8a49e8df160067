"""The forward graph of streams from Spark's own operators, without a stateful processor: sources come once by a deduplication or a semi-join, their acknowledgements out of a window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspring.operators.lineage import HIDDEN, Lineage


def _node(kind: str, uid1: str, uid2: str | None, ts: str | Column, data: str | Column | None) -> Column:
    of = lambda c: F.lit(None).cast("string") if c is None else F.col(c) if isinstance(c, str) else c
    return F.struct(F.lit(kind).alias("kind"), of(uid1).alias("uid1"), of(uid2).alias("uid2"), of(ts).alias("ts"), of(data).alias("data"))


def _nodes(rows: DataFrame, keep: list[str], *nodes: tuple[str, str, str | None, str | Column, str | Column | None]) -> DataFrame:
    """Of each row the ``nodes`` (kind, uid1, uid2, ts, data), with its columns ``keep``: several of one row, so that what made it is not computed for each."""
    return rows.select(*keep, F.explode(F.array(*(_node(*n) for n in nodes))).alias("node")).select(*keep, "node.*")


def _due(rows: DataFrame, at: str, delay: int) -> DataFrame:
    """``rows`` with ``window``, which ends one to two delays after ``at``."""
    return rows.withColumn("window", F.window(at, f"{2 * delay} seconds", f"{delay} seconds")).where(F.expr(f"{at} >= window.start AND {at} < window.start + INTERVAL {delay} SECONDS"))


def _acks(rows: DataFrame, uid: str, ts: str, at: str, delay: int) -> DataFrame:
    """An ACK of each source in ``rows``, however often it is there."""
    acked = _due(rows, at, delay).groupBy("window", uid, ts).agg(F.count("*").alias("n"))
    return _nodes(acked, [], ("ACK", uid, None, F.col(ts) + delay * 1_000_000, None))


def standard_graph_stream(queries: dict[str, Lineage], max_delay: int | None = None) -> DataFrame:
    """The same nodes (kind, uid1, uid2, ts, data) as those of ``graph_stream``.

    A source comes once, with the first result that it is in. Its ACK comes out of a window over the source's time that ends one to two delays after it, so after the last edge; its time is the
    source's plus the delay, as in the batch.

    With ``carry=False`` edges bring their source along: one deduplication, whose state goes by such windows too, gives sources and edges. With ``carry=True`` results and edges come out of the same rows, and
    a stream-stream semi-join by id gives sources; its state goes when time has passed the source by the delay. Spark computes what two branches of a stream share for each of them, with a state of its own,
    so there are as few branches as can be.
    """
    delay = max(q.reach for q in queries.values()) if max_delay is None else max_delay
    return reduce(DataFrame.unionByName, (_looked_up if any(q.carry for q in queries.values()) else _brought)(queries, delay))


def _sink(name: str) -> Column:
    return F.concat(F.lit(f"{name}|"), "rid").alias("sink")


#: A result and its ACK.
_OWN = ("SINK", "sink", None, "ts", "data"), ("ACK", "sink", None, "ts", None)


def _results(name: str, q: Lineage, *columns: str | Column) -> DataFrame:
    """``sink``, ``ts`` and ``data``, the payload as JSON, of a query's results, with ``columns``."""
    payload = [c for c in q.df.columns if c not in (*HIDDEN, "ts")]
    return q.df.select(_sink(name), "ts", F.to_json(F.struct(*payload)).alias("data"), *columns)


def _source_id(prov: DataFrame) -> Column:
    """The id in an element ``uid`` of a lineage, stamped or not."""
    return (F.col("uid") if dict(prov.dtypes)["uid"] == "bigint" else F.col("uid.id")).cast("string")


def _with_edges(name: str, q: Lineage) -> DataFrame:
    """Nodes of results with ``prov`` and of their edges, from one look at them: a result and its ACK come at the place of its first source."""
    each = _results(name, q, F.posexplode_outer("prov").alias("place", "uid"))
    each = each.withColumn("uid", _source_id(each))
    own, edge = [_node(*n) for n in _OWN], _node("EDGE", "uid", "sink", "ts", None)
    nodes = F.when(F.col("place") > 0, F.array(edge)).when(F.col("place") == 0, F.array(*own, edge)).otherwise(F.array(*own))
    return each.select(F.explode(nodes).alias("node")).select("node.*")


def _brought(queries: dict[str, Lineage], delay: int) -> list[DataFrame]:
    """Nodes of results, sources and edges, from edges that have their source with them."""
    edges = reduce(DataFrame.unionByName, [q.flow("rid", "ts").select("__uid", "__ts", "__at", "__data", "ts", _sink(name)) for name, q in queries.items()])
    kept = _due(edges, "__at", max(delay, *(q.reach for q in queries.values())))
    found = _nodes(kept, ["window"], ("SOURCE", "__uid", None, "__ts", "__data"), ("EDGE", "__uid", "sink", "ts", None))
    return [*(_nodes(_results(name, q), [], *_OWN) for name, q in queries.items()), found.dropDuplicates(["window", "kind", "uid1", "uid2"]).drop("window"), _acks(edges, "__uid", "__ts", "__at", delay)]


def _looked_up(queries: dict[str, Lineage], delay: int) -> list[DataFrame]:
    """Nodes of results, sources and edges, from edges that have their source's id only."""
    out, edges, roots = [], [], []
    for name, q in queries.items():
        if q.carry:
            out.append(_with_edges(name, q))
            held = q.df.select("event", F.explode("prov").alias("uid"))
            edges.append(held.select(_source_id(held).alias("uid"), F.col("event").alias("seen")))
        else:
            held = q.flow("rid", "ts").select("event", "ts", _sink(name), F.col("__uid").alias("uid"))
            out += [_nodes(_results(name, q), [], *_OWN), _nodes(held, [], ("EDGE", "uid", "sink", "ts", None))]
            edges.append(held.select("uid", F.col("event").alias("seen")))
        roots += [r for r in q.roots if not any(r is x for x in roots)]
    seen = reduce(DataFrame.unionByName, edges)
    for root in roots:
        near = F.expr(f"rid = uid AND seen >= event AND seen <= event + INTERVAL {delay} SECONDS")
        sources = root.join(seen, near, "left_semi")
        out += [_nodes(sources, [], ("SOURCE", "rid", None, "ts", "data")), _acks(sources, "rid", "ts", "event", delay)]
    return out
