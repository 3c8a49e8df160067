"""Latency by the clock of a running stream: from when a result's last input arrived until the batch that gave it was done."""

from __future__ import annotations

import json
import threading
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from wellspring.metrics import each_step
from wellspring.streaming.run import started

#: The name under which a stream's rows are observed.
OBSERVED = "latency"


def arriving(stream: DataFrame) -> DataFrame:
    """A source's rows with ``stimulus``, when they were read. Results keep the largest of their inputs', as an aggregate like any other."""
    return stream.withColumn("stimulus", F.current_timestamp())


def observed(stream: DataFrame, stimulus: str = "stimulus") -> DataFrame:
    """The same rows, which are counted on their way to the sink, with the mean and least ``stimulus`` of each micro-batch.

    The mean is of decimals: from some thousand rows on, a sum of milliseconds since 1970 is beyond what a double holds exactly, and the mean could be less than the least.
    """
    at = F.unix_millis(stimulus)
    return stream.observe(OBSERVED, F.count(F.lit(1)).alias("rows"), F.avg(at.cast("decimal(20,0)")).alias("mean"), F.min(at).alias("least"))


class LatencyLog(StreamingQueryListener):
    """Writes a record for each micro-batch of the query ``name`` below ``path``, by the batch's number: one that comes again replaces its own and is not counted twice.

    A record has ``batch``, ``at`` (the batch's end in milliseconds), ``rows``, and the ``average`` and ``most`` milliseconds that its rows took. Records appear by rename.
    """

    def __init__(self, spark: SparkSession, path: str, name: str):
        self.spark, self.path, self.name, self.over, self.runs = spark, path, name, threading.Event(), set()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        if event.name == self.name:
            self.runs.add(str(event.runId))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        seen = p.observedMetrics.get(OBSERVED)
        if p.name != self.name or seen is None:
            return
        end = int(datetime.fromisoformat(p.timestamp.replace("Z", "+00:00")).timestamp() * 1000) + p.batchDuration
        held = {"batch": p.batchId, "at": end, "rows": seen["rows"], "average": None if seen["mean"] is None else float(end - seen["mean"]), "most": None if seen["least"] is None else end - seen["least"]}
        jvm = self.spark._jvm.org.apache.hadoop.fs
        draft, place = jvm.Path(f"{self.path}/.draft-{uuid.uuid4().hex}"), jvm.Path(f"{self.path}/{p.batchId}.json")
        fs = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = fs.create(draft, True)
        out.write(bytearray((json.dumps(held) + "\n").encode()))
        out.close()
        fs.delete(place, False)
        fs.rename(draft, place)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if str(event.runId) in self.runs:
            self.over.set()


def run_logged(stream: DataFrame, write, checkpoint: str, path: str) -> None:
    """Runs an :func:`observed` stream through ``write(rows, batch)`` over all rows that there are, with a :class:`LatencyLog` below ``path``."""
    spark, name = stream.sparkSession, f"logged-{uuid.uuid4().hex}"
    log = LatencyLog(spark, path, name)
    spark.streams.addListener(log)
    try:
        started(stream.writeStream.queryName(name).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True), spark).awaitTermination()
        # Events come after the fact; the last of a query says that it has ended.
        log.over.wait(60)
    finally:
        spark.streams.removeListener(log)


def records(spark: SparkSession, path: str) -> DataFrame:
    """``batch``, ``at``, ``rows``, ``average`` and ``most`` of each micro-batch."""
    return spark.read.schema("batch BIGINT, at BIGINT, rows BIGINT, average DOUBLE, most DOUBLE").json(path)


def latency_series(spark: SparkSession, path: str) -> DataFrame:
    """``second``, ``count``, ``average`` and ``most`` (milliseconds) of the results that batches gave in it; seconds without have 0, -1 and -1."""
    held = records(spark, path).where("rows > 0").groupBy(F.expr("at div 1000").alias("second"))
    total = F.sum(F.col("average").cast("decimal(18,4)") * F.col("rows").cast("decimal(16,0)"))
    return each_step(held.agg(F.sum("rows").alias("count"), (total / F.sum("rows")).cast("double").alias("average"), F.max("most").alias("most")), 1)
