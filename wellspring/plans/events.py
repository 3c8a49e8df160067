"""The workloads' shapes on the ``events`` table: same operators, thresholds and windows that suit its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspring.functions import earliest, event_time, latest
from wellspring.operators.lineage import Lineage
from wellspring.plans.workloads import anomalies, distinct_count


def read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id``, ``ts`` (an instant), ``user_id``, ``event_type``, ``value``."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", event_time("ts").alias("ts"), "user_id", "event_type", "value")


def source(events: DataFrame, carry: bool = True, watermark: str | None = None, stamped: bool = False) -> Lineage:
    return Lineage.source(events, "event_id", "ts", carry, watermark, stamped)


def stopped(events: Lineage, n: int = 3) -> Lineage:
    """Users with exactly n small values of one type in four days."""
    kind = latest(F.col("event_type"), F.col("ts"), F.col("event_id"))
    out = events.where("value < 20").window_agg(["user_id"], "96 hours", "24 hours", n=F.count("*"), kinds=distinct_count(events, "event_type"), latest_type=kind)
    return out.where((F.col("n") == n) & (F.col("kinds") == 1)).select("user_id", "n", "latest_type", "window_end")


def accident(events: Lineage) -> Lineage:
    """Types at which more than one user has stopped within a day."""
    still = stopped(events)
    return still.window_agg(["latest_type"], "24 hours", users=distinct_count(still, "user_id")).where("users > 1")


def blackout(events: Lineage) -> Lineage:
    """Days on which more than three users have a sum below 5."""
    return events.window_agg(["user_id"], "24 hours", total=F.round(F.sum("value"), 6)).where("total < 5").window_agg([], "24 hours", users=F.count("*")).where("users > 3")


def anomaly(events: Lineage) -> Lineage:
    """Users with a daily sum above 60 that differs by more than 60 from a value of the day's last hour."""
    return anomalies(events, "user_id", "value", 60, 60)


def in_area(events: Lineage) -> Lineage:
    """Users with more than five values between 10 and 40 in four days."""
    return events.where("value > 10 AND value < 40").window_agg(["user_id"], "96 hours", "48 hours", n=F.count("*")).where("n > 5")


def speed(events: Lineage) -> Lineage:
    """Change of value per hour from the first to the last event of three days."""
    row = F.struct("value", F.col("ts").alias("at"), "event_id")
    out = events.window_agg(["user_id"], "72 hours", "24 hours", n=F.count("*"), first=earliest(row, F.col("ts"), F.col("event_id")), last=latest(row, F.col("ts"), F.col("event_id"))).where("n > 1")
    at = lambda side: F.unix_micros(F.col(f"{side}.at")) if dict(out.df.select(f"{side}.at").dtypes)["at"] == "timestamp" else F.col(f"{side}.at")
    hours = (at("last") - at("first")) / 3.6e9
    return out.with_column("rate", F.try_divide(F.abs(F.col("last.value") - F.col("first.value")), hours)).where("rate is not null").select("user_id", "rate", "n", F.col("first.event_id").alias("first_id"), F.col("last.event_id").alias("last_id"), "window_end")


def high_speed(events: Lineage) -> Lineage:
    """Average of :func:`speed` above 1 over six days."""
    return speed(events).window_agg(["user_id"], "144 hours", "72 hours", average=F.avg("rate"), windows=F.count("*")).where("average > 1")


def crossed(events: Lineage) -> Lineage:
    """Clicks and views of one user in the same two hours."""
    click, view = events.where("event_type = 'click'"), events.where("event_type = 'view'")
    return click.window_join(view, {"user_id": "user_id"}, "2 hours", "1 hours")


def cycles(events: Lineage) -> Lineage:
    """Types with at least five values below 100 in six hours."""
    return events.where("value < 100").window_agg(["event_type"], "6 hours", "3 hours", n=F.count("*")).where("n >= 5")


def follow_up(events: Lineage) -> Lineage:
    """Purchases up to three hours after a click of the same user."""
    return events.where("event_type = 'purchase'").interval_join(events.where("event_type = 'click'"), {"user_id": "user_id"}, "0 hours", "3 hours")


PLANS = {"stopped": stopped, "stopped4": lambda e: stopped(e, 4), "accident": accident, "blackout": blackout, "anomaly": anomaly, "inarea": in_area, "speed": speed, "highspeed": high_speed, "crossed": crossed, "cycles": cycles, "followup": follow_up}
