"""Generated inputs. All values come from hashes of row numbers, so a run, a retry and an SQL query make the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _draw(below: int, *parts: Column) -> Column:
    """A number from 0 to ``below`` - 1 that depends on the parts alone."""
    return F.pmod(F.crc32(F.concat_ws(":", *parts)), F.lit(below))


def synthetic_lineage(spark: SparkSession, length: int = 1000, delay: int = 10, size: int = 100, overlap: int = 0, tuple_bytes: int = 32) -> DataFrame:
    """:func:`synthetic_sources` of sinks numbered from 0 to ``length`` - 1."""
    return synthetic_sources(spark.range(length).withColumnRenamed("id", "sink_id"), delay, size, overlap, tuple_bytes)


def synthetic_sources(sinks: DataFrame, delay: int = 10, size: int = 100, overlap: int = 0, tuple_bytes: int = 32) -> DataFrame:
    """Sink rows (``sink_id`` i) with lineage: ``sink_ts`` = ``delay`` + i, and ``prov``, ``size`` sources (uid, ts, data), ``overlap`` of them shared with the sink before.

    A sink's own sources are numbered from i * (size - overlap); the shared ones are the last of the sink before, while the delay allows. A source's time is
    its first sink's less a draw below the delay.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap is from 0 to size - 1")
    fresh = size - overlap
    rows = sinks.select("sink_id").withColumn("sink_ts", F.col("sink_id") + delay)
    ids = F.sequence(F.col("sink_id") * fresh, F.col("sink_id") * fresh + size - 1)

    def source(uid: Column) -> Column:
        first = F.greatest(F.floor((uid - overlap) / fresh), F.lit(0)).cast("bigint")
        return F.struct(uid.alias("uid"), (first + delay - _draw(max(1, delay - 1), uid.cast("string"))).alias("ts"), F.unhex(F.substring(F.repeat(F.sha2(uid.cast("string").cast("binary"), 256), tuple_bytes // 32 + 1), 1, 2 * tuple_bytes)).alias("data"))

    return rows.withColumn("prov", F.transform(ids, source))


def synthetic_overlap(rows: DataFrame) -> DataFrame:
    """``mean_overlap``: how many sources a sink shares with the one before, on average over sinks that have one before."""
    held = rows.select("sink_id", F.col("prov.uid").alias("ids"))
    before = held.select((F.col("sink_id") + 1).alias("sink_id"), F.col("ids").alias("before"))
    return held.join(before, "sink_id").agg(F.avg(F.size(F.array_intersect("ids", "before"))).alias("mean_overlap"))


def smart_grid_readings(spark: SparkSession, meters: int = 20_000, hours: int = 1000, mean: float = 10.0, spread: float = 4.0, least: int = 8) -> DataFrame:
    """Meter readings ``hours``, ``meter``, ``value``: about normal (a sum of twelve draws), and 0 where below ``least``."""
    rows = spark.range(meters * hours).select(F.floor(F.col("id") / meters).alias("hours"), (F.col("id") % meters).cast("string").alias("meter"))
    draws = sum((_draw(1000, "hours", "meter", F.lit(str(k))) for k in range(12)), F.lit(0)) / 1000.0 - 6.0
    value = F.round(draws * spread + mean).cast("bigint")
    return rows.withColumn("value", F.when(value < least, 0).otherwise(value))
