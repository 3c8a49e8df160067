"""Encoders: from a graph's nodes (kind, uid1, uid2, ts, data) to lines or tables. Each is a function of a DataFrame, so it serves batches and ``foreachBatch``."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspring.operators.graph import ORDER
from wellspring.operators.lineage import Lineage


class Encoder(Protocol):
    """From nodes to what is written of them."""

    def __call__(self, nodes: DataFrame) -> DataFrame: ...


def _line() -> Column:
    vertex = F.concat_ws(" ::: ", "kind", "uid1", F.coalesce("data", F.lit("")))
    edge = F.concat(F.lit("EDGE ::: "), "uid1", F.lit(" -> "), "uid2")
    return F.when(F.col("kind") == "EDGE", edge).when(F.col("kind") == "ACK", F.concat(F.lit("ACK ::: "), "uid1")).otherwise(vertex)


def lines(nodes: DataFrame) -> DataFrame:
    """``value``: ``SOURCE ::: uid ::: tuple``, ``SINK ::: uid ::: tuple``, ``EDGE ::: a -> b``, ``ACK ::: uid``."""
    return nodes.select(_line().alias("value"))


def _order() -> Column:
    return F.create_map(*(F.lit(x) for pair in ORDER.items() for x in pair))[F.col("kind")]


def timestamped_lines(nodes: DataFrame, ordered: bool = False) -> DataFrame:
    """:func:`lines` after stream time (milliseconds), order of kind and data time; a batch can be sorted by them."""
    millis = F.floor(F.col("ts") / 1000)
    out = nodes.select(millis.alias("at"), _order().alias("order"), F.format_string("%d %d %d %s", millis, _order(), millis, _line()).alias("value"))
    return (out.orderBy("at", "order", "value") if ordered else out).select("value")


def plain_lines(rows: DataFrame, stimulus: str = "stimulus") -> DataFrame:
    """``value``, the row as JSON without its ``stimulus``, and ``delay_ms``, from when its last input arrived until now."""
    late = F.unix_millis(F.current_timestamp()) - F.unix_millis(stimulus)
    return rows.select(F.to_json(F.struct(*(c for c in rows.columns if c != stimulus))).alias("value"), late.alias("delay_ms"))


def backward_lines(query: Lineage, sources: DataFrame, uid: str, name: str = "") -> DataFrame:
    """``value``: ``> {tuple} <- [n] {``, the n source tuples on lines of their own in order of id, ``}``."""
    payload = sources.select(F.col(uid).alias("source"), F.to_json(F.struct(*sources.columns)).alias("row"))
    held = query.edges(name).join(payload, "source").groupBy("sink").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("source", "row"))).alias("rows"))
    return query.sinks(name).join(held, "sink").select(F.concat(F.lit("> {"), "data", F.lit("} <- ["), F.col("n").cast("string"), F.lit("] {\n"), F.array_join(F.col("rows.row"), "\n"), F.lit("\n}")).alias("value"))


def command_lines(nodes: DataFrame) -> DataFrame:
    """``value``: JSON commands of a graph viewer: ``an`` adds a node, ``ae`` an edge, ``cn`` changes a node to done."""
    node = F.create_map("uid1", F.struct(F.col("uid1").alias("label"), F.lower("kind").alias("type"), F.col("data"), F.col("ts").alias("timestamp"), F.lit(False).alias("done")))
    edge = F.create_map(F.concat("uid1", F.lit("->"), "uid2"), F.struct(F.col("uid1").alias("source"), F.col("uid2").alias("target"), F.lit(True).alias("directed")))
    done = F.create_map("uid1", F.struct(F.lit(True).alias("done")))
    command = F.when(F.col("kind") == "EDGE", F.to_json(F.struct(edge.alias("ae")))).when(F.col("kind") == "ACK", F.to_json(F.struct(done.alias("cn")))).otherwise(F.to_json(F.struct(node.alias("an"))))
    return nodes.select(command.alias("value"))


def graph_tables(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (id, label, ts, data) and relations (src, dst, relationship) for a graph database's import."""
    vertices = nodes.where("kind in ('SOURCE', 'SINK')").select(F.col("uid1").alias("id"), F.col("kind").alias("label"), "ts", "data")
    return vertices, nodes.where("kind = 'EDGE'").select(F.col("uid1").alias("src"), F.col("uid2").alias("dst"), F.lit("PROVENANCE").alias("relationship"))


def noop(nodes: DataFrame) -> None:
    """Computes the nodes and writes nothing."""
    nodes.write.format("noop").mode("overwrite").save()


def jdbc(nodes: DataFrame, url: str, table: str, **properties: str) -> None:
    """Appends nodes to a database's table; the driver's class comes with the session."""
    nodes.write.jdbc(url, table, mode="append", properties=properties)
