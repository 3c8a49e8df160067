"""The four workloads. Thresholds and window lengths are parameters with the workloads' own values.

Where a query's rules are not published in full they are inferred, and say so.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wellspring.functions import earliest, latest, opposite_camera, speed_kmh
from wellspring.operators.lineage import Lineage

# The region of the vehicle workload: open bounds of latitude and longitude. Fixed values.
REGION = ((39.912915, 39.9206835), (116.299221, 116.3188575))
EMPTY = -1.0

POSITION = ("xway", "lane", "dir", "seg", "pos")


def distinct_count(rows: Lineage, column: str | Column) -> Column:
    """The exact number of distinct values. Streams, which have no such aggregate, keep a group's values, which must be few there."""
    return F.size(F.collect_set(column)).cast("bigint") if rows.df.isStreaming else F.count_distinct(column)


# Linear road: rows (type, vid, speed, xway, lane, dir, seg, pos).


def stopped_vehicles(reports: Lineage, size: str = "120 seconds", slide: str = "30 seconds", reports_needed: int = 4) -> Lineage:
    """Vehicles with exactly so many reports of speed 0 in a window, all at one position."""
    place = F.struct(*POSITION)
    out = reports.where("type = 0 AND speed = 0").window_agg(
        ["vid"], size, slide, reports=F.count("*"), places=distinct_count(reports, place), latest=latest(place, F.col("ts"), F.xxhash64("rid"))
    )
    return out.where((F.col("reports") == reports_needed) & (F.col("places") == 1)).select("vid", "reports", *(F.col(f"latest.{c}").alias(c) for c in POSITION), "window_end")


def accidents(stopped: Lineage, size: str = "30 seconds", vehicles: int = 1) -> Lineage:
    """Positions at which more than ``vehicles`` different vehicles have stopped."""
    return stopped.window_agg(["pos"], size, count=distinct_count(stopped, "vid")).where(F.col("count") > vehicles)


# Smart grid: rows (key, value).


def daily_usage(readings: Lineage, key: str = "key", value: str = "value") -> Lineage:
    """Sums of a day, rounded so that the order of addition does not show."""
    return readings.window_agg([key], "24 hours", total=F.round(F.sum(value), 6))


def anomalies(readings: Lineage, key: str = "key", value: str = "value", usage: float = 200, difference: float = 200) -> Lineage:
    """Meters whose use in a day is above ``usage`` and differs from a reading of the day's last hour by more than ``difference``."""
    last_hour = readings.where(F.floor(F.unix_micros("event") / 3_600_000_000) % 24 == 23)
    joined = daily_usage(readings, key, value).where(F.col("total") > usage).window_join(last_hour, {key: key}, "1 hours")
    return joined.with_column("difference", F.round(F.abs(F.col("l_total") - F.col(f"r_{value}")), 6)).where(F.col("difference") > difference)


def blackouts(readings: Lineage, key: str = "key", value: str = "value", usage: float = 0, meters: int = 7) -> Lineage:
    """Days on which more than ``meters`` meters used no more than ``usage``."""
    return daily_usage(readings, key, value).where(F.col("total") <= usage).window_agg([], "24 hours", count=F.count("*")).where(F.col("count") > meters)


# Cloud vehicles: rows (car_id, lat, lon).


def first_and_last(rows: Lineage, key: str, columns: list[str], size: str, slide: str) -> Lineage:
    """The first and last row of each window with two rows at least. (Inferred: windows of one row have no last one and are dropped.)"""
    row = F.struct(*columns, F.col("ts").alias("at"))
    out = rows.window_agg([key], size, slide, n=F.count("*"), first=earliest(row, F.col("ts"), F.xxhash64("rid")), last=latest(row, F.col("ts"), F.xxhash64("rid")))
    return out.where("n > 1")


def high_speed(positions: Lineage, minimum: float = 70) -> Lineage:
    """Average speed above ``minimum`` km/h over 120 seconds of speeds over 15 seconds. (The comparison is inferred; windows in which no time passed have no speed.)"""
    held = first_and_last(positions, "car_id", ["lat", "lon"], "15 seconds", "5 seconds")
    ms = lambda side: F.unix_millis(F.col(f"{side}.at")) if dict(held.df.select(f"{side}.at").dtypes)["at"] == "timestamp" else F.floor(F.col(f"{side}.at") / 1000)
    speed = speed_kmh(F.col("first.lat"), F.col("first.lon"), ms("first"), F.col("last.lat"), F.col("last.lon"), ms("last"))
    speeds = held.where(F.col("last.lon") != EMPTY).with_column("speed", speed).where("speed is not null")
    return speeds.window_agg(["car_id"], "120 seconds", "60 seconds", average=F.avg("speed")).where(F.col("average") > minimum)


def in_area(positions: Lineage, minimum: int = 9, size: str = "300 seconds", slide: str = "150 seconds") -> Lineage:
    """Cars with more than ``minimum`` readings inside the region in a window."""
    (south, north), (west, east) = REGION
    inside = (F.col("lat") > south) & (F.col("lat") < north) & (F.col("lon") > west) & (F.col("lon") < east)
    return positions.where(inside).window_agg(["car_id"], size, slide, count=F.count("*")).where(F.col("count") > minimum)


# Local vehicle: rows (lidar, left, right), each a struct (payload_type, ts, annotations).


def objects(frames: Lineage, payloads: tuple[str, ...]) -> Lineage:
    """A row for each annotation: ``payload_type``, ``object_id``, ``label``, ``x``, ``y``, ``z``."""
    held = frames.explode(F.array(*payloads), "payload")
    held = held.select(F.col("payload.payload_type").alias("payload_type"), F.col("payload.annotations").alias("annotations"))
    if dict(held.df.dtypes)["annotations"].startswith("array"):
        each = held.explode(F.col("annotations"), "entry").with_column("key", F.col("entry.key")).with_column("value", F.col("entry.value"))
    else:
        each = held.explode(F.col("annotations"), "key", "value")
    return each.select("payload_type", F.col("key").alias("object_id"), *(F.col(f"value.{c}").alias(c) for c in ("label", "x", "y", "z")))


def crossed_pedestrians(frames: Lineage, size: str = "2 seconds", slide: str = "1 seconds") -> Lineage:
    """Pedestrians seen by one front camera and, in the same window, by the other. (Inferred: both cameras' annotations take part.)"""
    walking = objects(frames, ("left", "right")).where(F.col("label") == "PEDESTRIAN").select("payload_type", "object_id")
    seen = walking.with_column("own", F.concat_ws("|", "payload_type", "object_id"))
    crossing = walking.with_column("own", F.concat_ws("|", opposite_camera(F.col("payload_type")), "object_id"))
    return crossing.window_join(seen, {"own": "own"}, size, slide)


def cycles_in_front(frames: Lineage, minimum: int = 11, size: str = "6 seconds", slide: str = "3 seconds") -> Lineage:
    """Payloads with at least ``minimum`` bicycles ahead in a window. (The lidar payload and the comparison are inferred.)"""
    ahead = (F.col("label") == "BICYCLE") & (F.abs("x") < 20) & (F.abs("y") < 20)
    return objects(frames, ("lidar",)).where(ahead).window_agg(["payload_type"], size, slide, count=F.count("*")).where(F.col("count") >= minimum)
