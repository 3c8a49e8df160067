"""Metrics: series per second of events, and rates and latencies from a stream's progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspring.operators.asof import next_in_log

#: Share of a run's start and end that is left out of its figures. Fixed value.
TRIM = 0.1


def per_second(rows: DataFrame, ts: str, value: str, step: int = 1) -> DataFrame:
    """``second`` (or first of ``step`` seconds), ``count``, ``average`` and ``most``; steps between the first and the last without rows have 0, -1 and -1."""
    at = (F.floor(F.unix_micros(ts) / (1_000_000 * step)) * step).alias("second")
    return each_step(rows.groupBy(at).agg(F.count("*").alias("count"), F.avg(value).alias("average"), F.max(value).alias("most")), step)


def each_step(held: DataFrame, step: int) -> DataFrame:
    """``held`` (second, count, average, most) with the steps of so many seconds that it leaves out between its first and last."""
    # Days first, so that no row holds all steps of a long span.
    day = step * max(1, 86_400 // step)
    span = held.agg(F.min("second").alias("a"), F.max("second").alias("b")).where("a is not null").select("b", F.explode(F.expr(f"sequence(a, b, {day}L)")).alias("from"))
    span = span.select(F.explode(F.expr(f"sequence(from, least(b, from + {day - step}L), {step}L)")).alias("second"))
    return span.join(held, "second", "left").select("second", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("average", F.lit(-1.0)).alias("average"), F.coalesce("most", F.lit(-1.0)).alias("most"))


def trimmed(series: DataFrame, at: str = "second") -> DataFrame:
    """The series less the first and last tenth of its time; negative figures become null."""
    span = series.agg(F.min(at).alias("a"), F.max(at).alias("b"))
    kept = series.join(F.broadcast(span)).where((F.col(at) >= F.col("a") + TRIM * (F.col("b") - F.col("a"))) & (F.col(at) <= F.col("b") - TRIM * (F.col("b") - F.col("a")))).drop("a", "b")
    numbers = [c for c, t in kept.dtypes if c != at and t in ("double", "bigint", "int")]
    return kept.withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in numbers})


def wall_latency(rows: DataFrame, stimulus: str, step: int = 1) -> DataFrame:
    """The average milliseconds from ``stimulus`` (when a row's last input arrived) until this plan runs, by second of now: what a sink logs per micro-batch."""
    late = rows.select(F.current_timestamp().alias("now"), (F.unix_millis(F.current_timestamp()) - F.unix_millis(stimulus)).alias("late"))
    return per_second(late, "now", "late", step)


def ack_delivery(acks: DataFrame, safe: DataFrame) -> DataFrame:
    """Each ACK with ``delivery_ms``: from when event time was first safe past it at every sink until it was delivered; null while a sink has not reported a later time.

    ``acks``: uid1, ts (event time, microseconds), ``delivered`` (an instant) and whatever else. ``safe``: ts (event time that was safe), ``stimulus`` (when it was) and, where there are several sinks, ``name``.
    It does not matter how long before a report an ACK's time is.
    """
    log = safe.select(*(["name"] if "name" in safe.columns else [F.lit("").alias("name")]), "ts", F.unix_millis("stimulus").alias("stimulus"))
    # There is a row for each sink, of which there are few, and an ACK waits for the last of them.
    each = acks.withColumn("ack", F.struct(*acks.columns)).join(F.broadcast(log.select("name").distinct()))
    found = next_in_log(each.select("ack", "name", "ts"), log, "ts", "stimulus", ["name"])
    last = found.groupBy("ack").agg(F.max("next_value").alias("safe"), F.min(F.col("next_value").isNotNull()).alias("all"))
    return last.select("ack.*", F.when(F.col("all"), F.unix_millis("ack.delivered") - F.col("safe")).alias("delivery_ms")).drop("ts", "delivered")


def results(spark: SparkSession, folder: str) -> DataFrame:
    """Result files ``<experiment>_<variant>/<parameter>.csv`` (rep, parallelism, node, idx, t, value): times from a run's start, warm-up and cool-down null, negative values null, latencies in seconds."""
    rows = spark.read.schema("rep INT, parallelism INT, node STRING, idx STRING, t BIGINT, value DOUBLE").csv(f"{folder}/*_*/*.csv")
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)/([^/]+)\.csv$", 1)
    rows = rows.withColumn("experiment", F.split_part(name, F.lit("_"), F.lit(1))).withColumn("variant", F.split_part(name, F.lit("_"), F.lit(2))).withColumn("parameter", F.regexp_extract(F.input_file_name(), r"([^/]+)/([^/]+)\.csv$", 2))
    run = ["experiment", "variant", "parameter", "rep", "parallelism"]
    span = rows.groupBy(*run).agg(F.min("t").alias("a"), F.max("t").alias("b"))
    held = rows.join(span, run).withColumn("t", F.col("t") - F.col("a")).withColumn("end", F.col("b") - F.col("a")).drop("a", "b")
    inside = (F.col("t") >= F.floor(F.col("end") * TRIM)) & (F.col("t") <= F.ceil(F.col("end") - F.col("end") * TRIM)) & (F.col("value") >= 0)
    seconds = F.when(F.col("parameter").isin("latency", "deliverylatency", "provreadtime", "provwritetime"), F.col("value") / 1000).otherwise(F.col("value"))
    return held.withColumn("value", F.when(inside, seconds)).drop("end")


def read_write_ratio(held: DataFrame) -> DataFrame:
    """``ratio`` of provenance reads to writes of each run and second in :func:`results`; null where nothing was written."""
    by = ["experiment", "variant", "rep", "parallelism", "t"]
    of = lambda name: F.sum(F.when(F.col("parameter") == name, F.col("value")))
    sums = held.where(F.col("parameter").isin("provreads", "provwrites")).groupBy(*by).agg(of("provreads").alias("reads"), of("provwrites").alias("writes"))
    return sums.withColumn("ratio", F.try_divide("reads", "writes"))


def progress_summary(progress: list[dict]) -> dict[str, float]:
    """Rows per second, longest batch in seconds, and rows of state at the end, of a stream's progress reports."""
    total = sum(p["numInputRows"] for p in progress)
    spent = sum(p["batchDuration"] for p in progress) / 1000
    state = sum(s["numRowsTotal"] for s in progress[-1]["stateOperators"]) if progress else 0
    return {"rows_per_s": total / spent if spent else 0.0, "longest_batch_s": max((p["batchDuration"] for p in progress), default=0) / 1000, "state_rows": state}
