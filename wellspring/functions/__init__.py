"""Column expressions shared by sources and plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres in a degree, as the vehicle workload takes them. Fixed values.
METRES_PER_LATITUDE, METRES_PER_LONGITUDE = 110_574.307, 111_132.954

#: High bits of an id that name its generator; the rest count. Fixed values.
GENERATOR_BITS, COUNTER_BITS = 6, 58


def event_time(ts: str) -> Column:
    """A zoneless timestamp as an instant, read as UTC whatever the session's zone."""
    return F.timestamp_micros(micros(ts))


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a zoneless timestamp column."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def from_units(t: str | Column, milliseconds: int) -> Column:
    """An instant from a count of units of so many milliseconds (1000: seconds, 3600000: hours)."""
    return F.timestamp_millis((F.col(t) if isinstance(t, str) else t) * F.lit(milliseconds))


def uid(generator: Column, counter: Column) -> Column:
    """An id from its generator's number (below 32, so that ids are not negative) and a counter."""
    return F.shiftleft(generator.cast("bigint"), COUNTER_BITS).bitwiseOR(counter.cast("bigint").bitwiseAND(F.lit((1 << COUNTER_BITS) - 1)))


def speed_kmh(lat1: Column, lon1: Column, ms1: Column, lat2: Column, lon2: Column, ms2: Column) -> Column:
    """Speed between two readings; null if no time passed."""
    metres = F.sqrt(F.pow((lat2 - lat1) * METRES_PER_LATITUDE, F.lit(2)) + F.pow((lon2 - lon1) * METRES_PER_LONGITUDE, F.lit(2)))
    return F.try_divide(metres, (ms2 - ms1).cast("double")) * 1000 * 3.6


def opposite_camera(camera: Column) -> Column:
    return F.when(camera == "ring_front_left", "ring_front_right").when(camera == "ring_front_right", "ring_front_left")


def latest(value: Column, ts: Column, tie: Column) -> Column:
    """The value of the row of largest ts, of equal ones that of smallest tie."""
    return F.max_by(value, F.struct(ts, -tie))


def earliest(value: Column, ts: Column, tie: Column) -> Column:
    return F.min_by(value, F.struct(ts, tie))
