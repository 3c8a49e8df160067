"""A delivery store: graph elements in transactions, and polls that deliver each of them once.

A transaction's rows are written first, under a name of their own, and then its commit record, in one rename: readers go by the records, so they see all of a
transaction or nothing, and one that was broken off leaves nothing to be seen. A transaction that comes again under its number finds its record and is left out.
The record has the number of rows and their largest time, so that counts follow commits.

A poll reads what was committed since the last one and what the last one left open: elements whose time is not yet past ``max_delay`` at every sink, of which copies
may still come, and sources that wait for their acknowledgement. What is past is closed and is never read again, so a poll costs what is new and what is open,
not what was ever delivered. Elements that come after their time was closed are rare; they are looked up in all that was sent, so that none is lost or sent twice.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from wellspring.metrics import ack_delivery

_NODES = "kind STRING, uid1 STRING, uid2 STRING, ts BIGINT, data STRING"
_POLLED = f"{_NODES}, sent BOOLEAN, open BOOLEAN"
_COMMIT = "name STRING, batch BIGINT, folder STRING, rows BIGINT, most BIGINT, safe MAP<STRING, BIGINT>, at BIGINT"
_LOWEST = -(1 << 62)
_KEY = ["kind", "uid1", "uid2"]


def _same(a: DataFrame, b: DataFrame) -> Column:
    return (a["kind"] == b["kind"]) & (a["uid1"] == b["uid1"]) & a["uid2"].eqNullSafe(b["uid2"])


@dataclass(frozen=True)
class DeliveryStore:
    """Tables below ``path``. A sink reports its rows before it reports their time as safe; all sinks are registered by :meth:`create` before the first poll."""

    spark: SparkSession
    path: str
    clock: Callable[[], float] = time.time

    # Records: small JSON files that appear by rename. Those of transactions that a poll has taken in are moved from ``commits`` to ``taken``, so that polls list what is new.

    def _place(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{path}")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _names(self, kind: str) -> list[str]:
        fs, place = self._place(kind)
        return sorted(f.getPath().getName() for f in fs.listStatus(place)) if fs.exists(place) else []

    def _is_there(self, path: str) -> bool:
        fs, place = self._place(path)
        return fs.exists(place)

    def _load(self, path: str) -> dict:
        fs, place = self._place(path)
        stream = fs.open(place)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _record(self, path: str, held: dict) -> None:
        """Makes a record visible at once and as a whole."""
        fs, place = self._place(path)
        _, draft = self._place(f"drafts/{uuid.uuid4().hex}")
        fs.mkdirs(place.getParent())
        out = fs.create(draft, True)
        out.write(bytearray((json.dumps(held) + "\n").encode()))
        out.close()
        if not fs.rename(draft, place):
            raise OSError(f"{place} could not be written")

    def _move(self, name: str) -> None:
        fs, place = self._place(f"commits/{name}")
        _, to = self._place(f"taken/{name}")
        fs.mkdirs(to.getParent())
        fs.rename(place, to)

    def _commits(self) -> DataFrame:
        """The records of all transactions; one that is being moved counts once."""
        there = [f"{self.path}/{k}" for k in ("commits", "taken") if self._names(k)]
        return self.spark.read.schema(_COMMIT).json(there).dropDuplicates(["name", "batch"]) if there else self.spark.createDataFrame([], _COMMIT)

    def _table(self, folders: Sequence[str], schema: str = _NODES) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, kind: str) -> tuple[str, dict]:
        """Writes rows under a new name; the name, and their number and largest time as they were counted on the way."""
        folder, seen = f"{kind}/{uuid.uuid4().hex}", Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows"), F.max("ts").alias("most")).write.parquet(f"{self.path}/{folder}")
        return folder, seen.get

    # Sinks.

    def create(self, sinks: Sequence[str]) -> DeliveryStore:
        """Registers all ``sinks`` with the lowest time, so that no source is acknowledged before each of them has reported."""
        self.commit(-1, safe=dict.fromkeys(sinks, _LOWEST))
        return self

    def commit(self, batch: int, nodes: DataFrame | None = None, safe: dict[str, int] | None = None, name: str = "") -> bool:
        """One transaction of the writer ``name``: elements, and the event times (microseconds) up to which sinks are complete. False if this writer's ``batch`` is there already."""
        record = f"{name}-{batch}.json"
        if self._is_there(f"commits/{record}") or self._is_there(f"taken/{record}"):
            return False
        folder, seen = self._write(nodes.select(*_KEY, "ts", "data").dropDuplicates(_KEY), "nodes") if nodes is not None else (None, {})
        self._record(f"commits/{record}", {"name": name, "batch": batch, "folder": folder, "rows": seen.get("rows") or 0, "most": seen.get("most"), "safe": safe or {}, "at": int(self.clock() * 1000)})
        return True

    def append(self, nodes: DataFrame, batch: int) -> None:
        self.commit(batch, nodes=nodes, name="nodes")

    def mark_safe(self, name: str, ts: int, batch: int) -> None:
        """Event time (microseconds) up to which the sink ``name`` is complete."""
        self.commit(batch, safe={name: ts}, name=f"safe-{name}")

    # Polls.

    def nodes(self) -> DataFrame:
        """Every committed element once, the earliest copy of each."""
        folders = [r.folder for r in self._commits().where("folder is not null").select("folder").collect()]
        return self._table(folders).groupBy(*_KEY).agg(F.min(F.struct("ts", "data")).alias("v")).select(*_KEY, "v.ts", "v.data")

    def _last(self) -> dict:
        polls = [int(n.removesuffix(".json")) for n in self._names("polls")]
        return self._load(f"polls/{max(polls)}.json") if polls else {"folder": None, "rows": 0, "seen": [], "safe": _LOWEST, "times": {}}

    def _due(self, max_delay: int) -> tuple[DataFrame, dict]:
        """The rows of the next poll, ``sent`` if it delivers them and ``open`` if the poll after it has to know them, and what its record says."""
        last, delay = self._last(), max_delay * 1_000_000
        listed = self._names("commits")
        news = [self._load(f"commits/{n}") for n in listed if n not in set(last["seen"])]
        times = dict(last["times"])
        for held in news:
            for sink, ts in held["safe"].items():
                times[sink] = max(ts, times.get(sink, _LOWEST))
        safe, before = min(times.values(), default=_LOWEST), last["safe"]
        arrived = self._table([h["folder"] for h in news if h["folder"]]).groupBy(*_KEY).agg(F.min(F.struct("ts", "data")).alias("v")).select(*_KEY, "v.ts", "v.data")
        waiting = self._table([last["folder"]] if last["folder"] else [], _POLLED).where("open").drop("sent", "open")
        fresh = arrived.join(waiting, _same(arrived, waiting), "left_anti")
        late = fresh.where(F.col("ts") + delay < before)
        if before > _LOWEST and not late.isEmpty():
            ever = self._table([self._load(f"polls/{n}")["folder"] for n in self._names("polls")], _POLLED).where("sent")
            fresh = fresh.where(F.col("ts") + delay >= before).unionByName(late.join(ever, _same(late, ever), "left_anti"))
        held = fresh.withColumn("new", F.lit(True)).unionByName(waiting.withColumn("new", F.lit(False)))
        past, none = F.col("ts") + delay < safe, F.lit(None).cast("string")
        own = F.struct(*_KEY, "ts", "data", F.col("new").alias("sent"), (~past).alias("open"))
        ack = F.struct(F.lit("ACK").alias("kind"), "uid1", none.alias("uid2"), (F.col("ts") + F.when(F.col("kind") == "SOURCE", delay).otherwise(0)).alias("ts"), none.alias("data"), F.lit(True).alias("sent"), F.lit(False).alias("open"))
        acked = (F.col("kind") == "SOURCE") & past | (F.col("kind") == "SINK") & F.col("new")
        rows = held.select(F.explode(F.array_compact(F.array(own, F.when(acked, ack)))).alias("r")).select("r.*").where("sent or open")
        return rows, {"seen": listed, "safe": safe, "times": times, "read": sum(h["rows"] for h in news) + last["rows"]}

    def pending(self, max_delay: int) -> DataFrame:
        """What a poll would deliver now."""
        return self._due(max_delay)[0].where("sent").drop("sent", "open")

    def deliver(self, max_delay: int, poll: int) -> DataFrame:
        """The elements to be delivered by this poll, from now on sent: new ones, and an ACK for each sink and for each source that is past ``max_delay`` at every sink.

        Polls are numbered upwards. One that comes again under its number gives the rows that it gave before; one that was broken off has left nothing to be seen, and the next delivers the same.
        """
        if not self._is_there(f"polls/{poll}.json"):
            rows, held = self._due(max_delay)
            folder, seen = self._write(rows, "polled")
            self._record(f"polls/{poll}.json", held | {"poll": poll, "folder": folder, "rows": seen["rows"], "at": int(self.clock() * 1000)})
        held = self._load(f"polls/{poll}.json")
        for name in held["seen"]:
            if self._is_there(f"commits/{name}"):
                self._move(name)
        return self._table([held["folder"]], _POLLED).where("sent").drop("sent", "open")

    # Figures that follow commits.

    def statistics(self) -> DataFrame:
        """``name``, ``batch``, ``rows`` and ``most`` (the largest time) of each committed transaction with elements; one that came again counts once."""
        return self._commits().where("folder is not null").select("name", "batch", "rows", "most")

    def reads(self) -> DataFrame:
        """``poll``, and how many rows it has ``read``: those of new transactions and what the poll before it left."""
        return self.spark.read.schema("poll BIGINT, read BIGINT").json(f"{self.path}/polls")

    def safe_log(self) -> DataFrame:
        """``name``, ``ts`` and ``stimulus``: the event times that sinks reported as safe, and when (milliseconds)."""
        return self._commits().select("at", F.explode("safe").alias("name", "ts")).where(F.col("ts") > _LOWEST).select("name", "ts", F.col("at").alias("stimulus"))

    def ack_latency(self) -> DataFrame:
        """``poll``, ``uid1`` and ``delivery_ms`` of each delivered ACK of a source: from when event time was past its own at every sink until the poll that delivered it."""
        polls = self.spark.read.schema("poll BIGINT, folder STRING, at BIGINT").json(f"{self.path}/polls")
        name = F.concat(F.lit("polled/"), F.element_at(F.split(F.input_file_name(), "/"), -2))
        sent = self.spark.read.schema(_POLLED).parquet(f"{self.path}/polled/*").withColumn("folder", name).where("sent and kind in ('ACK', 'SINK')")
        sinks = sent.where("kind = 'SINK'").select("uid1")
        acks = sent.where("kind = 'ACK'").join(sinks, "uid1", "left_anti").join(F.broadcast(polls), "folder").select("poll", "uid1", "ts", F.timestamp_millis("at").alias("delivered"))
        return ack_delivery(acks, self.safe_log().withColumn("stimulus", F.timestamp_millis("stimulus"))).select("poll", "uid1", "delivery_ms")
