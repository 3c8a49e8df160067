"""Bounded runs of streams: staged input with an end mark, and draining a query into a table."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from wellspring.scratch import shared_folder

#: The time of the rows that end a staged stream, later than any window; their id is -1.
END_TS, END_UID = "2999-01-01 23:30:00", -1


def started(writer: DataStreamWriter, spark: SparkSession) -> StreamingQuery:
    """Starts a query with each exchange computed for itself. Where two branches of a stream share one, Spark does not see the watermark below it for the second, whose windows then never close.

    A query takes the session's settings when it starts, so batch queries keep theirs.
    """
    name = "spark.sql.exchange.reuse"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        return writer.start()
    finally:
        spark.conf.set(name, before)


def folder(spark: SparkSession, name: str) -> str:
    """A new folder for staged rows, results or a stream's progress, in the folder that driver and executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, uid: str, ts: str, parts: int | None = None, ends: Sequence[dict] = ({},)) -> DataFrame:
    """``df`` as a stream of files, and last rows far in the future: a stream has no end of its own, and only later rows close its last windows.

    Filters move below the watermark, so each branch of a plan needs an end row that passes its filters: ``ends`` has the values of each. End rows come
    out of no closed window; where they come out of a stateful step, they are to be left out after it. ``parts``: files of the rows, one for each core if not given.
    """
    spark, path = df.sparkSession, folder(df.sparkSession, "staged")
    df.repartition(parts or max(4, spark.sparkContext.defaultParallelism)).write.parquet(path)
    for values in ends:
        row = {**values, uid: END_UID, ts: END_TS}
        spark.range(1).select(*(F.lit(row.get(c)).cast(t).alias(c) for c, t in df.dtypes)).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def drain(stream: DataFrame, name: str = "out") -> DataFrame:
    """Runs a stream over all rows that there are; its results as a table. The checkpoint lets an interrupted run go on."""
    spark, path = stream.sparkSession, folder(stream.sparkSession, name)
    started(stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True), spark).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def write_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> list[dict]:
    """Runs a stream through ``write(rows, batch)``, which must give the same for a batch that comes again; returns each batch's progress.

    A batch's rows are kept while they are written, so that several writes do not run its stateful steps again.
    """

    def once(rows: DataFrame, batch: int) -> None:
        held = rows.persist()
        try:
            write(held, batch)
        finally:
            held.unpersist()

    query = started(stream.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint).trigger(availableNow=True), stream.sparkSession)
    query.awaitTermination()
    return [dict(p) if isinstance(p, dict) else p for p in query.recentProgress]


def delivered(stream: DataFrame, name: str = "delivered") -> DataFrame:
    """Runs a stream over all rows that there are; its results with ``batch``, the number of the micro-batch that delivered them."""
    path = folder(stream.sparkSession, name)
    write_batches(stream, lambda rows, batch: rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}"), f"{path}/progress")
    return stream.sparkSession.read.schema(f"{stream.schema.toDDL()}, batch BIGINT").parquet(f"{path}/rows")
