r"""Windowed operators whose results know the source rows they came from.

Two ways to know, with equal results:

* ``carry=True``: every row has ``prov``, the sorted array of its source ids. Works in Structured Streaming too. An array is as long as its row's lineage.
* ``carry=False``: rows carry only their own id, as text (``rid``) and in its parts with their types (``rkey``). :meth:`Lineage.edges` writes the results' keys down and
  joins them to what their windows held, step by step: a key of a join has those of both sides in it and needs no join. Keys of few results are broadcast, after
  a count, so that the sources are scanned and not shuffled. No row ever holds a group, so a window over all keys or a hot key stays spread. Batch only.
  Where a plan cannot give a pair twice (windows over sources, joins of those with rows of one source each), pairs are not compared with each other: what is made
  distinct before is results and sources, of which there are fewer.

Texts of different ids differ: in a key, ``\``, ``|``, ``#`` and ``@`` are escaped, null is ``\0``, times are their microseconds and nested values are JSON. Each result has an id
of its own that is a function of the data: rows that :meth:`Lineage.explode` makes of one row have its id, ``@`` and their place in the array or their key in the map.

Beside its own columns each row has ``ts`` (the largest of its inputs' times, as a fact about the data) and ``event`` (what later windows go by: a result's
window end less a microsecond). ``reach`` is the longest sum of window lengths from the sources: nothing contributes to a result later than that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, DateType, MapType, NumericType, StructType, TimestampNTZType, TimestampType

from wellspring.scratch import BROADCAST_ROWS, kept

HIDDEN = ("rid", "rkey", "prov", "event")
#: Names that rows may not bring along, as the operators give them.
RESERVED = (*HIDDEN, "window", "r_window")


@dataclass(frozen=True)
class Links:
    """Results (``out``) and the keys of rows they came from (``key``); ``rows`` is known once they are written down.

    More columns hold a source each that ``out`` gets elsewhere and that is left out here.
    """

    df: DataFrame
    rows: int | None = None

    @property
    def but(self) -> list[str]:
        return [c for c in self.df.columns if c not in ("out", "key")]

    def settled(self) -> Links:
        if self.rows is not None:
            return self
        held = kept(self.df)
        return replace(self, df=held, rows=held.count())

    def of(self, key: Column, but: Column | None = None) -> Links:
        more = [] if but is None else [but.alias(f"but{len(self.but)}")]
        return replace(self, df=self.df.select("out", key.alias("key"), *self.but, *more))

    def sources(self, a: Column, b: Column) -> DataFrame:
        """``out`` and ``uid`` for each of a row's two sources, once if they are equal, from one look at the row."""
        each = self.df.select("out", *self.but, F.explode(F.when(a.eqNullSafe(b), F.array(b)).otherwise(F.array(a, b))).alias("uid"))
        return each.where(self.new("uid")).select("out", "uid")

    def new(self, uid: str) -> Column:
        """Whether ``out`` gets the source in column ``uid`` here only."""
        return reduce(lambda a, b: a & b, [~F.col(uid).eqNullSafe(F.col(c)) for c in self.but], F.lit(True))


Trace = Callable[[Links], DataFrame]


def seconds(length: str) -> int:
    """Seconds of a window length such as ``"96 hours"``."""
    count, unit = length.split()
    return int(count) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


#: How times look in nested keys: with all their digits, and instants with their offset, so that different ones differ.
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


def _text(kind: DataType, key: Column) -> Column:
    """A key as text, without the marks that stand between keys. Different keys of one type have different texts."""
    if isinstance(kind, TimestampType):
        text = F.unix_micros(key).cast("string")
    elif isinstance(kind, ArrayType | StructType):
        text = F.to_json(F.struct(key.alias("k")), _TIMES)
    elif isinstance(kind, BinaryType):
        text = F.hex(key)
    else:
        text = key.cast("string")
    if not isinstance(kind, NumericType | BooleanType | DateType | TimestampType | TimestampNTZType | BinaryType):
        for mark, instead in (("\\", "\\\\"), ("|", "\\p"), ("#", "\\h"), ("@", "\\a")):
            text = F.replace(text, F.lit(mark), F.lit(instead))
    return F.when(key.isNull(), F.lit("\\0")).otherwise(text)


def _free(names: Iterable[str], taken: Iterable[str] = RESERVED) -> None:
    """Refuses columns whose names the operators need, whatever their case, rather than lose them."""
    lost = sorted({n for n in names if n.lower() in taken})
    if lost:
        raise ValueError(f"columns named {', '.join(lost)}: these names are taken, so rename them first")


def _end(window: str) -> Column:
    return F.unix_micros(F.col(f"{window}.end")).cast("string")


def _all(parts: Iterable[Lineage]) -> tuple[DataFrame, ...]:
    """The sources of all parts, each once."""
    out: list[DataFrame] = []
    for root in (r for p in parts for r in p.roots):
        if not any(root is x for x in out):
            out.append(root)
    return tuple(out)


@dataclass(frozen=True)
class Lineage:
    """Rows with their lineage. Make one with :meth:`source`; every method returns a new one."""

    df: DataFrame
    trace: Trace
    reach: int = 0
    carry: bool = True
    #: For streams: with ``carry=False`` the sources by row, see :meth:`flow`; and the sources themselves (rid, ts, event, data).
    sources_of: Callable[[DataFrame, list[str]], DataFrame] | None = None
    roots: tuple[DataFrame, ...] = ()
    #: Of rows with one source each, that source's id from the row's key; whether no two rows share it; and whether ``trace`` gives each pair once.
    one: Callable[[Column], Column] | None = None
    own: bool = False
    once: bool = False

    @classmethod
    def source(cls, df: DataFrame, uid: str, ts: str, carry: bool = True, watermark: str | None = None, stamped: bool = False) -> Lineage:
        """Source rows; ``uid`` is a unique long. ``watermark``: how late a stream's rows may be.

        Columns named as in ``RESERVED``, or ``ts`` beside the time, are refused.

        ``stamped``: ``prov`` has more than ids: (``id``, ``ts`` in microseconds, ``data``, the other columns as JSON), all that a graph needs of a source.
        """
        _free(df.columns)
        _free([c for c in df.columns if c != ts], ("ts",))
        payload = [c for c in df.columns if c not in (uid, ts)]
        df = df.withColumnRenamed(ts, "ts") if ts != "ts" else df
        df = df.withColumn("event", F.col("ts"))
        if watermark is not None:
            df = df.withColumn("ts", F.unix_micros("ts")).withWatermark("event", watermark)
        df = df.withColumn("rid", F.col(uid).cast("string"))
        own = F.col(uid).cast("bigint")
        if not carry:
            df = df.withColumn("rkey", own)
        elif stamped:
            at = F.col("ts") if dict(df.dtypes)["ts"] == "bigint" else F.unix_micros("ts")
            df = df.withColumn("prov", F.array(F.struct(own.alias("id"), at.alias("ts"), F.to_json(F.struct(*payload)).alias("data"))))
        else:
            df = df.withColumn("prov", F.array(own))

        def trace(links: Links) -> DataFrame:
            return links.df.where(links.new("key")).select("out", F.col("key").alias("uid"))

        if not df.isStreaming:
            return cls(df, trace, 0, carry, one=lambda key: key, own=True, once=True)
        data = F.to_json(F.struct(*payload))
        flow = lambda rows, keep: rows.select(F.col("rid").alias("__uid"), F.col("ts").alias("__ts"), F.col("event").alias("__at"), data.alias("__data"), "event", *keep)
        return cls(df, trace, 0, carry, None if carry else flow, (df.select("rid", "ts", "event", data.alias("data")),))

    def flow(self, *keep: str) -> DataFrame:
        """In a stream, for each row and source of it: the source's ``__uid`` as text, ``__ts``, ``__at`` (its event time) and ``__data`` (its other columns as JSON), and the row's ``event`` and columns ``keep``. Of sources, windows over them and windows over those."""
        if self.sources_of is None:
            raise NotImplementedError("streams without lists know the lineage of windows only; use carry=True")
        return self.sources_of(self.df, list(keep))

    def _hidden(self) -> list[str]:
        return [c for c in HIDDEN if c in self.df.columns]

    def where(self, condition: Column | str) -> Lineage:
        return replace(self, df=self.df.where(condition))

    def select(self, *columns: str | Column) -> Lineage:
        """Columns by name or expression; the time and the lineage stay."""
        named = [c for c in columns if isinstance(c, str)]
        kept = [c for c in ("ts", *self._hidden()) if c not in named]
        df = self.df.select(*columns, *kept)
        _free([c for c in set(df.columns) if df.columns.count(c) > 1])
        return replace(self, df=df)

    def with_column(self, name: str, value: Column) -> Lineage:
        _free([name])
        return replace(self, df=self.df.withColumn(name, value))

    def explode(self, column: Column, *names: str) -> Lineage:
        """A row for each element of an array (one name) or entry of a map (two names), each with an id of its own: an element's has its place, an entry's its key."""
        _free(names)
        kind = self.df.select(column.alias("c")).schema["c"].dataType
        if isinstance(kind, MapType):
            df = self.df.select("*", F.explode(column).alias(*names))
            own, text = F.col(names[0]), _text(kind.keyType, F.col(names[0]))
        else:
            df = self.df.select("*", F.posexplode(column).alias("r_window", *names))
            own = text = F.col("r_window")
        df = df.withColumn("rid", F.concat("rid", F.lit("@"), text.cast("string")))
        if self.carry:
            return replace(self, df=df.drop("r_window"))
        df = df.withColumn("rkey", F.struct(F.col("rkey").alias("of"), own.alias("at"))).drop("r_window")
        one = None if self.one is None else lambda key: self.one(key["of"])
        return replace(self, df=df, trace=lambda links: self.trace(links.of(F.col("key.of"))), sources_of=None, one=one, own=False)

    def union(self, *others: Lineage) -> Lineage:
        """Rows of all, by column name."""
        parts = (self, *others)
        frames = [p.df.withColumn("rid", F.concat(F.lit(f"{k}:"), "rid")) for k, p in enumerate(parts)]
        if not self.carry:
            kinds = [p.df.schema["rkey"].dataType for p in parts]
            own = lambda k, j: F.col("rkey") if j == k else F.lit(None).cast(kinds[j])
            frames = [f.withColumn("rkey", F.struct(F.lit(k).alias("part"), *(own(k, j).alias(f"k{j}") for j in range(len(parts))))) for k, f in enumerate(frames)]

        def trace(links: Links) -> DataFrame:
            links = links.settled()
            return reduce(DataFrame.unionByName, [p.trace(replace(links, df=links.df.where(F.col("key.part") == k)).of(F.col(f"key.k{k}"))) for k, p in enumerate(parts)])

        return Lineage(reduce(DataFrame.unionByName, frames), trace, max(p.reach for p in parts), self.carry, roots=_all(parts))

    def window_agg(self, keys: list[str], size: str, slide: str | None = None, **aggregates: Column) -> Lineage:
        """Aggregates over sliding (or, without ``slide``, tumbling) windows of event time, by keys; no keys: over all rows of a window.

        Results have the keys, ``window_end`` and the aggregates.
        """
        _free(aggregates)
        _free([*keys, *aggregates], ("window_end",))
        windowed = self.df.withColumn("window", F.window("event", size, slide or size))
        rid = F.concat_ws("|", *(_text(self.df.schema[k].dataType, F.col(k)) for k in keys), _end("window"))
        more = [F.array_sort(F.array_distinct(F.flatten(F.collect_list("prov")))).alias("prov")] if self.carry else []
        grouped = windowed.groupBy("window", *keys).agg(*(c.alias(n) for n, c in aggregates.items()), *([] if "ts" in aggregates else [F.max("ts").alias("ts")]), *more)
        out = grouped.withColumn("rid", rid)
        if not self.carry:
            out = out.withColumn("rkey", F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col("window.end").alias("end")))
        out = out.withColumn("event", F.window_time("window")).withColumn("window_end", F.col("window.end")).drop("window")

        def trace(links: Links) -> DataFrame:
            links = links.settled()
            wanted = links.df.select("out", F.col("key").alias("of"), *links.but)
            small = links.rows <= BROADCAST_ROWS
            members = windowed.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col("window.end").alias("end"), F.col("rkey").alias("key"))
            match = [F.col("of.end") == F.col("end"), *(F.col(f"of.k{i}").eqNullSafe(F.col(f"k{i}")) for i in range(len(keys)))]
            if self.own:
                members = (members.join(F.broadcast(wanted.select("of").distinct()), match, "left_semi") if small else members).distinct()
            return self.trace(Links(members.join(F.broadcast(wanted) if small else wanted, match).select("out", "key", *links.but)))

        def flow(rows: DataFrame, keep: list[str]) -> DataFrame:
            # Sources wait in the join's state until time has passed what their window can reach; its result comes in the batch that closes it. Rows go by their source's time from then on, as a stream's
            # rows have one time only.
            held = self.flow(*keys).withColumn("window", F.window("event", size, slide or size))
            held = held.select(rid.alias("__id"), "__uid", "__ts", "__at", "__data")
            fired = rows.select(F.col("rid").alias("__of"), "event", *(F.col(c).alias(f"__{i}") for i, c in enumerate(keep)))
            near = F.expr(f"__id = __of AND event >= __at AND event <= __at + INTERVAL {self.reach + seconds(size)} SECONDS")
            return held.join(fired, near).select("__uid", "__ts", "__at", "__data", "event", *(F.col(f"__{i}").alias(c) for i, c in enumerate(keep)))

        return Lineage(out, trace, self.reach + seconds(size), self.carry, flow if self.sources_of is not None else None, self.roots, once=self.own)

    def _sides(self, other: Lineage, on: dict[str, str], prefix: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
        left = self.df.select(*(F.col(c).alias(f"{prefix[0]}{c}") for c in self.df.columns))
        right = other.df.select(*(F.col(c).alias(f"{prefix[1]}{c}") for c in other.df.columns))
        return left, right

    def _joined(self, other: Lineage, rows: DataFrame, a: str, b: str, rid: Column, event: Column, reach: int) -> Lineage:
        out = rows.withColumn("ts", F.greatest(f"{a}ts", f"{b}ts")).withColumn("rid", rid).withColumn("event", event)
        if self.carry:
            out = out.withColumn("prov", F.array_sort(F.array_union(f"{a}prov", f"{b}prov")))

        else:
            sides = [F.col(f"{a}rkey").alias("l"), F.col(f"{b}rkey").alias("r")]
            out = out.withColumn("rkey", F.struct(*sides, *([F.col("window.end").alias("end")] if "window" in rows.columns else [])))

        def trace(links: Links) -> DataFrame:
            l, r = F.col("key.l"), F.col("key.r")
            if self.one is not None and other.one is not None:  # the key has both sources in it, so it is read once and need not be written down
                return links.sources(self.one(l), other.one(r))
            links = links.settled()
            if other.one is not None:
                return self.trace(links.of(l, other.one(r))).unionByName(other.trace(links.of(r)))
            return self.trace(links.of(l)).unionByName(other.trace(links.of(r, None if self.one is None else self.one(l))))

        hidden = [f"{p}{c}" for p in (a, b) for c in HIDDEN]
        return Lineage(out.drop(*(h for h in hidden if h in out.columns)), trace, reach, self.carry, roots=_all((self, other)), once=self.once and other.once and (self.one is not None or other.one is not None))

    def window_join(self, other: Lineage, on: dict[str, str], size: str, slide: str | None = None, prefix: tuple[str, str] = ("l_", "r_")) -> Lineage:
        """All pairs with equal keys in the same window; a pair that shares several windows is there several times. Columns get the sides' prefixes."""
        a, b = prefix
        left, right = self._sides(other, on, prefix)
        left = left.withColumn("window", F.window(f"{a}event", size, slide or size)).drop(f"{a}event")
        right = right.withColumn("r_window", F.window(f"{b}event", size, slide or size)).drop(f"{b}event")
        match = [F.col("window") == F.col("r_window"), *(F.col(f"{a}{x}") == F.col(f"{b}{y}") for x, y in on.items())]
        rows = left.join(right, match).withColumn("window_end", F.col("window.end")).drop("r_window")
        rid = F.concat_ws("#", f"{a}rid", f"{b}rid", _end("window"))
        out = self._joined(other, rows, a, b, rid, F.window_time("window"), max(self.reach, other.reach) + seconds(size))
        return replace(out, df=out.df.drop("window"))

    def interval_join(self, other: Lineage, on: dict[str, str], lower: str, upper: str, prefix: tuple[str, str] = ("l_", "r_")) -> Lineage:
        """Pairs with equal keys where the left's time is between the right's plus ``lower`` and plus ``upper`` (``"-1 hours"``), both included."""
        a, b = prefix
        left, right = self._sides(other, on, prefix)
        between = F.expr(f"{a}event >= {b}event + INTERVAL {lower} AND {a}event <= {b}event + INTERVAL {upper}")
        rows = left.join(right, [between, *(F.col(f"{a}{x}") == F.col(f"{b}{y}") for x, y in on.items())])
        return self._joined(other, rows, a, b, F.concat_ws("#", f"{a}rid", f"{b}rid"), F.greatest(f"{a}event", f"{b}event"), max(self.reach, other.reach) + seconds(upper) - seconds(lower))

    def plain(self) -> DataFrame:
        """The rows without lineage."""
        return self.df.drop(*HIDDEN)

    def edges(self, name: str = "") -> DataFrame:
        """``sink`` (the name, ``|`` and the row's id) and ``source`` ids, each pair once."""
        return self.pairs(F.concat(F.lit(f"{name}|"), "rid")).withColumnsRenamed({"out": "sink", "uid": "source"})

    def pairs(self, out: Column, once: bool = True) -> DataFrame:
        """``out``, an expression over the row that tells it from others, and ``uid``, a source of it, each pair once (or, where that is not asked for, at least once)."""
        if self.carry:
            found = self.df.select(out.alias("out"), F.explode("prov").alias("uid"))
            stamped = dict(found.dtypes)["uid"] != "bigint"
            found = found.select("out", F.col("uid.id").alias("uid")) if stamped else found
            return found.distinct() if once else found
        links = self.df.select(out.alias("out"), F.col("rkey").alias("key"))
        if once and self.once:
            return self.trace(Links(links.distinct()))
        return self.trace(Links(links)).distinct() if once else self.trace(Links(links))

    def settled(self) -> Lineage:
        """The same with its rows written down, for uses that would compute them more than once."""
        return replace(self, df=kept(self.df))

    def sinks(self, name: str = "") -> DataFrame:
        """``sink``, ``ts``, and ``data``, the payload as JSON."""
        payload = [c for c in self.df.columns if c not in (*HIDDEN, "ts")]
        return self.df.select(F.concat(F.lit(f"{name}|"), "rid").alias("sink"), "ts", F.to_json(F.struct(*payload)).alias("data"))
