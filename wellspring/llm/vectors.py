"""What the searches over vectors share: integer vectors, blocks of them that are indexed one by one, and blocks of queries that a task can hold."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspring.llm._common import kept


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int, **more: Column) -> DataFrame:
    """``id``, ``vector`` (``floor(scale * x)`` of each component x) and ``more``, written down.

    Rows with a null id, a null vector, or a null or non-finite component are left out, and rows that are equal in all of this are one.
    """
    x = F.transform(F.col(vector_col).cast("array<double>"), lambda c: F.when(F.abs(c) < F.lit(float("inf")), c))
    named = df.select(F.col(id_col).cast("bigint").alias("id"), x.alias("x"), *(c.alias(n) for n, c in more.items()))
    whole = named.where(F.col("id").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull()))
    return kept(whole.select("id", F.transform("x", lambda c: F.floor(c * scale).cast("bigint")).alias("vector"), *more).distinct())


def matrix(vectors: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A list column as rows of ``width`` integers; shorter vectors go on with zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    ends = vectors.offsets.to_numpy().astype(np.int64)
    sizes, values = np.diff(ends), vectors.values.to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(ends[0], ends[-1]) - np.repeat(ends[:-1], sizes)] = values[ends[0] : ends[-1]]
    return out


def narrow(values: np.ndarray) -> np.ndarray:
    """The same integers in the least of 16, 32 and 64 bits that holds all of them."""
    top = max(abs(int(values.min())), abs(int(values.max()))) if values.size else 0
    return values.astype(np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64)


def fits(queries: np.ndarray, rows: np.ndarray) -> None:
    """Refuses vectors whose inner products could leave 64 bits, rather than give wrong scores."""
    most = lambda m: max(abs(int(m.min())), abs(int(m.max()))) if m.size else 0
    if most(queries) * most(rows) * max(1, rows.shape[1]) >= 1 << 61:
        raise OverflowError("components are so large that an inner product could leave 64 bits")


def index(rows: DataFrame, block_rows: int, build: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """Rows dealt by hash to blocks of ``block_rows`` on average, each turned into what ``build`` makes of it; written down, and spread so that each task has whole blocks."""
    n = max(1, -(-rows.count() // block_rows))
    held = rows.withColumn("block", F.pmod(F.xxhash64(*rows.columns), F.lit(n)))
    made = kept(held.groupBy("block").applyInArrow(build, schema))
    return made.repartition(max(1, min(n, max(3 * rows.sparkSession.sparkContext.defaultParallelism, n // 64))))


def query_blocks(queries: DataFrame, most: int) -> Iterator[pa.Table]:
    """The rows in tables of at most ``most``: dealt by hash, and a share that is too large is dealt again."""
    h = F.xxhash64(*queries.columns)
    n = max(1, -(-queries.count() * 5 // (4 * most)))
    todo = [(n, rest) for rest in range(n)]
    while todo:
        parts, rest = todo.pop(0)
        held = queries.where(F.pmod(h, F.lit(parts)) == rest).limit(most + 1).toArrow()
        if held.num_rows > most:
            todo += [(2 * parts, rest), (2 * parts, rest + parts)]
        elif held.num_rows:
            yield held


def width_of(rows: DataFrame) -> int:
    return rows.agg(F.coalesce(F.max(F.size("vector")), F.lit(0))).head()[0]


def in_tasks(spark: SparkSession, blocks: DataFrame, held: object, work: Callable[[object, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``work(held, blocks of a task)`` gives, written down. ``held``, a block of queries and so of bounded size, is sent to each executor once and let go afterwards."""
    sent = spark.sparkContext.broadcast(held)
    try:
        return kept(blocks.mapInArrow(lambda batches: work(sent.value, batches), schema))
    finally:
        sent.unpersist()
