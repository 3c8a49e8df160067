"""Where rows are kept between jobs: the folder that driver and executors share, and tables in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows that may be broadcast; a row of links is some hundred bytes.
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where none is named, a local session gets a new one; on a cluster that is an error, as machines share no local folder."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if sc.getCheckpointDir() is None:
        named = named or tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


_written: dict[str, list[str]] = {}


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once and written as a Parquet table in the shared folder, so that a lost executor costs no recomputation. It stays until :func:`forget`."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def written(spark: SparkSession) -> int:
    """How many tables :func:`kept` has written for this application: a mark for :func:`forget`."""
    return len(_written.get(spark.sparkContext.applicationId, []))


def forget(spark: SparkSession, mark: int = 0) -> int:
    """Deletes the tables that :func:`kept` has written since the mark, and says how many. What reads them must be written by then."""
    held = _written.get(spark.sparkContext.applicationId, [])
    paths, held[mark:] = held[mark:], []
    for path in paths:
        remove(spark, path)
    return len(paths)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever Spark's file systems have it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
