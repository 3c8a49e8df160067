"""Frames of vehicle payloads as a stream: windows hold the payloads in order of time, and a small state of each vehicle says where a window's first frame begins."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_ITEM = "ns bigint, payload_type string, annotations string, code int"


class _Places(StatefulProcessor):
    """Of one vehicle: how many frames its windows have made, and the last payloads (two at most) that wait for a third. Takes a row for each window and gives one: what waits before it.

    Windows come once they are closed, those of earlier batches before those of later ones, so within a batch their order is that of their times.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "made long, waiting string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        made, waiting = self.state.get() if self.state.exists() else (0, "[]")
        wait = json.loads(waiting)
        for event, n, ends, whole in sorted((r.event, r.n, r.ends, (r.whole0, r.whole1, r.whole2)) for r in rows):
            yield Row(vehicle=key[0], event=event, made=made, waiting=json.dumps(wait))
            head, tail = json.loads(ends)
            if len(wait) + n < 3:
                wait += head[:n]
                continue
            # The first payloads end the three that waits; the others are in threes from there, and what is left waits.
            lead = -len(wait) % 3
            if wait:
                made += len({x["code"] for x in wait + head[:lead]}) == 3
            made += whole[lead]
            left = (n - lead) % 3
            wait = tail[len(tail) - left :]
        self.state.update((made, json.dumps(wait)))

    def close(self) -> None:
        pass


def _whole(of: str, first: str) -> str:
    """SQL for the places k of an array's threes from ``first`` on, (first + 3k, + 1, + 2), that have all kinds."""
    kinds = " | ".join(f"{of}[int({first} + 3 * k + {i})].code" for i in range(3))
    return f"if(size({of}) < {first} + 3, array(), filter(sequence(0, int((size({of}) - {first}) div 3) - 1), k -> ({kinds}) = 7))"


def frame_stream(payloads: DataFrame, every: int = 1, watermark: str = "0 seconds", vehicle: str | None = None, window: str = "1 minute") -> DataFrame:
    """Frames (``ts``, ``lidar``, ``left``, ``right``, and ``vehicle`` if it is named) of a stream of payloads (payload_type, ns, annotations), as ``sources.frames`` makes them of a table: every ``every``-th.

    Payloads wait in windows of event time, dealt by vehicle and window; what meets in one place is a window's payloads, and of a vehicle a row for each window with its number of payloads and
    frames, its first two and its last two. Of equal payloads each counts. The payloads of a window leave when a row comes that is ``watermark`` later than its end.
    """
    kind = f"a {payloads.schema['annotations'].dataType.simpleString()}"
    code = F.when(F.col("payload_type") == "lidar", 1).when(F.col("payload_type").contains("left"), 2).otherwise(4)
    text = F.to_json(F.struct(F.col("annotations").alias("a"))).alias("annotations")
    held = payloads.select(F.coalesce(F.col(vehicle).cast("string"), F.lit("")).alias("vehicle") if vehicle else F.lit("").alias("vehicle"), "ns", "payload_type", text, F.timestamp_micros(F.expr("ns div 1000")).alias("event"))
    # Payloads are dealt before they are gathered: else each task of the input would first gather all that it reads, by window, and spill it.
    dealt = held.withWatermark("event", watermark).select("vehicle", F.window("event", window).alias("window"), "ns", "payload_type", "annotations").repartition("vehicle", "window")
    item = F.struct("ns", "payload_type", "annotations", code.alias("code"))
    grouped = dealt.groupBy("vehicle", "window").agg(F.sort_array(F.collect_list(item)).alias("items"))
    grouped = grouped.select("vehicle", F.window_time("window").alias("event"), "items")
    whole = [F.size(F.expr(_whole("items", str(k)))).cast("bigint").alias(f"whole{k}") for k in range(3)]
    ends = F.to_json(F.array(F.expr("slice(items, 1, 2)"), F.expr("slice(items, greatest(size(items) - 1, 1), 2)"))).alias("ends")
    placed = grouped.select("vehicle", "event", F.size("items").cast("bigint").alias("n"), ends, *whole).groupBy("vehicle").transformWithState(_Places(), "vehicle string, event timestamp, made long, waiting string", "append", "eventTime", eventTimeColumnName="event")
    met = grouped.join(placed, ["vehicle", "event"]).select("vehicle", "made", F.concat(F.from_json("waiting", f"array<struct<{_ITEM}>>"), "items").alias("items"))
    threes = met.select("vehicle", "made", "items", F.posexplode(F.expr(_whole("items", "0"))).alias("place", "k")).where((F.col("made") + F.col("place")) % every == 0)
    of = threes.select("vehicle", *(F.expr(f"filter(slice(items, 3 * k + 1, 3), x -> x.code = {c})[0]").alias(name) for name, c in (("lidar", 1), ("left", 2), ("right", 4))))
    at = F.timestamp_millis(F.expr("lidar.ns div 1000000"))
    payload = lambda name: F.struct(F.col(f"{name}.payload_type").alias("payload_type"), at.alias("ts"), F.from_json(f"{name}.annotations", kind)["a"].alias("annotations")).alias(name)
    return of.select(*(["vehicle"] if vehicle else []), at.alias("ts"), payload("lidar"), payload("left"), payload("right"))
