"""What the operators of this subpackage share: reading, cutting lineage, text as bytes, batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspring.scratch import kept, shared_folder

__all__ = ["byte_list", "cut", "free", "kept", "pieces", "table", "utf8"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder (see ``wellspring.scratch``), so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def free(columns: Iterable[str], name: str) -> str:
    """``name``, or the first of ``name_``, ``name__`` and so on that is none of the columns, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8(column: str = "text"):
    """The column's UTF-8 bytes; Arrow then hands them to Python without decoding."""
    return F.col(column).cast("binary")


def byte_list(array: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """A string or binary Arrow column as a list of bytes."""
    kind = array.type
    if pa.types.is_string(kind):
        array = array.cast(pa.binary())
    elif pa.types.is_large_string(kind):
        array = array.cast(pa.large_binary())
    return array.to_pylist()


def pieces(batches: Iterator[pa.RecordBatch], column: int | str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes of ``column`` (one row at least), which bounds a task's memory."""
    for batch in batches:
        held = batch.column(column).nbytes
        n = batch.num_rows
        if held <= limit or n <= 1:
            if n:
                yield batch
            continue
        import pyarrow.compute as pc

        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if total and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        yield batch.slice(start)
