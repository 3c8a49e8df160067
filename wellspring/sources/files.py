"""The workloads' text inputs. Each has a fixed schema; a line that does not parse fails the job. All read as batches or, with ``stream=True``, as streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wellspring.functions import from_units, uid

# Column positions of the inputs. Fixed values.
LINEAR_ROAD = "type INT, time BIGINT, vid BIGINT, speed INT, xway INT, lane INT, dir INT, seg INT, pos INT"
SMART_GRID = "hours BIGINT, meter STRING, value BIGINT"
CLOUD = "seconds BIGINT, car_id INT, lat DOUBLE, lon DOUBLE"
ANNOTATION = "track_id STRING, label STRING, x DOUBLE, y DOUBLE, z DOUBLE"


def _csv(spark: SparkSession, path: str, schema: str, stream: bool, per_trigger: int | None) -> DataFrame:
    reader = (spark.readStream if stream else spark.read).schema(schema).option("mode", "FAILFAST")
    if stream and per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.csv(path)


def linear_road(spark: SparkSession, path: str, instances: int = 1, id_shift: int = 0, stream: bool = False, per_trigger: int | None = None) -> DataFrame:
    """Position reports with ``ts`` (seconds in the file) and ``key``. Each of ``instances`` readers has the file once more, its vehicles' ids shifted and its number for ``xway``."""
    rows = _csv(spark, path, LINEAR_ROAD, stream, per_trigger)
    rows = rows.withColumn("xway", F.explode(F.sequence(F.lit(0), F.lit(instances - 1))))
    rows = rows.withColumn("vid", F.col("vid") + F.col("xway") * F.lit(id_shift))
    return rows.withColumn("key", F.col("vid").cast("string")).withColumn("ts", from_units("time", 1000)).drop("time")


def smart_grid(spark: SparkSession, path: str, instances: int = 1, id_shift: int = 0, stream: bool = False, per_trigger: int | None = None) -> DataFrame:
    """Meter readings: ``ts`` (hours in the file), ``key`` and ``value``."""
    rows = _csv(spark, path, SMART_GRID, stream, per_trigger).withColumn("instance", F.explode(F.sequence(F.lit(0), F.lit(instances - 1))))
    return rows.select(from_units("hours", 3_600_000).alias("ts"), (F.col("meter").cast("bigint") + F.col("instance") * F.lit(id_shift)).cast("string").alias("key"), "value")


def cloud_vehicles(spark: SparkSession, path: str, stream: bool = False, per_trigger: int | None = None) -> DataFrame:
    """Vehicle positions: ``ts`` (seconds in the file), ``car_id``, ``lat``, ``lon``. Files take the place of a socket, so a stream can be replayed and recovered."""
    return _csv(spark, path, CLOUD, stream, per_trigger).select(from_units("seconds", 1000).alias("ts"), "car_id", "lat", "lon")


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotation files ``[objects_]<payload>-...-<ns>.txt`` as ``payload_type``, ``ns``, ``ts`` (milliseconds of it) and ``annotations``, a map from track to (label, x, y, z).

    Of lines with the same track in a file the last counts. The file's name gives payload and time.
    """
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1)
    rows = spark.read.schema(ANNOTATION).option("mode", "FAILFAST").csv(path).select("*", name.alias("name"), F.monotonically_increasing_id().alias("line"))
    payload = F.regexp_extract("name", r"^(?:objects_)?([^-]+)-", 1)
    last = F.max_by(F.struct("label", "x", "y", "z"), "line").alias("object")
    tracks = rows.groupBy(payload.alias("payload_type"), F.regexp_extract("name", r"-(\d+)$", 1).cast("bigint").alias("ns"), "track_id").agg(last)
    held = tracks.groupBy("payload_type", "ns").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("track_id", "object")))).alias("annotations"))
    return held.select("payload_type", "ns", _millis("ns").alias("ts"), "annotations")


def _millis(ns: str) -> Column:
    return F.timestamp_millis(F.expr(f"{ns} div 1000000"))


_HOUR = 3_600_000_000_000
#: Payloads of a task on average, so that what a task sorts does not grow with the table; an hour's stay together.
TASK_ROWS = 250_000


def frames(held: DataFrame, every: int = 1, times: int = 1) -> DataFrame:
    """Frames ``ts``, ``lidar``, ``left``, ``right`` of payloads (payload_type, ns, annotations), whose clocks differ: in order of time, each three payloads make one.

    The frame has its lidar's time. The whole is played ``times`` over, each time later by its length, and every ``every``-th frame of it stays. Threes without all
    of the payloads make no frame. Places in the order come from counts by hour, so that only an hour's payloads are sorted together. The payloads are counted first, and dealt to as many tasks as they need.
    """
    parts = max(int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held.count() // TASK_ROWS))
    plain = held.select("payload_type", "ns", F.map_entries("annotations").alias("annotations"), F.expr(f"ns div {_HOUR}").alias("hour"))
    before = Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    first = plain.groupBy("hour").agg(F.count("*").alias("n")).select("hour", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    order = Window.partitionBy("hour").orderBy("ns", "payload_type")
    placed = plain.repartition(parts, "hour").withColumn("place", F.row_number().over(order)).join(first, "hour").withColumn("three", F.expr("(first + place - 1) div 3")).repartition(parts, "three")
    part = lambda which, name: F.max(F.when(which, F.struct("payload_type", "ns", "annotations"))).alias(name)
    lidar, left = F.col("payload_type") == "lidar", F.col("payload_type").contains("left")
    threes = placed.groupBy("three").agg(part(lidar, "lidar"), part(left, "left"), part(~lidar & ~left, "right")).where("lidar is not null and left is not null and right is not null")
    span = F.broadcast(threes.agg(F.count("*").alias("length"), (F.max("lidar.ns") - F.min("lidar.ns") + 1).alias("shift")))
    ranked = threes.withColumn("hour", F.expr(f"lidar.ns div {_HOUR}"))
    start = ranked.groupBy("hour").agg(F.count("*").alias("n")).select("hour", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = ranked.repartition(parts, "hour").withColumn("place", F.row_number().over(Window.partitionBy("hour").orderBy("three"))).join(start, "hour").withColumn("index", F.col("first") + F.col("place") - 1)
    played = numbered.join(span).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).where((F.col("turn") * F.col("length") + F.col("index")) % every == 0)
    played = played.withColumn("at", F.col("lidar.ns") + F.col("turn") * F.col("shift"))
    payload = lambda name: F.struct(F.col(f"{name}.payload_type").alias("payload_type"), _millis("at").alias("ts"), F.col(f"{name}.annotations").alias("annotations")).alias(name)
    return played.select(_millis("at").alias("ts"), payload("lidar"), payload("left"), payload("right"))


def repeated(df: DataFrame, times: int, ts: str = "ts", uid_col: str | None = None) -> DataFrame:
    """The input ``times`` over, each time later by its length (largest time and one second) and, with ``uid_col``, under the ids of another generator."""
    length = F.broadcast(df.agg((F.max(F.unix_micros(ts)) - F.min(F.unix_micros(ts)) + 1_000_000).alias("__length")))
    rows = df.join(length).withColumn("__turn", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    rows = rows.withColumn(ts, F.timestamp_micros(F.unix_micros(ts) + F.col("__turn") * F.col("__length")))
    if uid_col:
        rows = rows.withColumn(uid_col, uid(F.col("__turn"), F.col(uid_col)))
    return rows.drop("__turn", "__length")


def split_by(df: DataFrame, key: str, parts: int) -> DataFrame:
    """Each row's ``part`` by a hash of its key, the rows dealt by it."""
    part = F.pmod(F.conv(F.substring(F.sha1(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(parts))
    return df.withColumn("part", part).repartition(parts, "part")
