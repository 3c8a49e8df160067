"""The registered queries over ``events`` and the other tables, each with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspring import metrics, workload_queries
from wellspring.functions import event_time
from wellspring.operators import ForwardGraph, Lineage, forward_graph
from wellspring.operators.graph import delivery_order, latencies, violations
from wellspring.plans import events as plans
from wellspring.scratch import kept
from wellspring.sinks import DeliveryStore, backward_lines, command_lines, graph_tables, lines, plain_lines, timestamped_lines
from wellspring.sources import repeated, synthetic_overlap, synthetic_sources
from wellspring.streaming import arriving, delivered, drain, graph_stream, latency_series, observed, prepare, run_logged, staged, standard_graph_stream
from wellspring.streaming.run import folder

#: What each plan's rows show.
SHOWN = {
    "stopped": ["user_id", "n", "latest_type", "window_end"],
    "stopped4": ["user_id", "n", "latest_type", "window_end"],
    "accident": ["latest_type", "users", "window_end"],
    "blackout": ["users", "window_end"],
    "anomaly": ["l_user_id", "r_event_id", "l_total", "r_value", "difference", "window_end"],
    "inarea": ["user_id", "n", "window_end"],
    "speed": ["user_id", "n", "first_id", "last_id", "rate", "window_end"],
    "highspeed": ["user_id", "windows", "average", "window_end"],
    "crossed": ["l_event_id", "r_event_id", "window_end"],
    "cycles": ["event_type", "n", "window_end"],
    "followup": ["l_event_id", "r_event_id"],
}
GRAPHED = ("anomaly", "inarea")


def _shown(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns, times as microseconds and sums rounded, so that engines agree."""
    kinds = dict(df.dtypes)
    return df.select(*(F.unix_micros(c).alias(f"{c}_us") if kinds[c] == "timestamp" else F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c) for c in columns))


def _plan(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _shown(plans.PLANS[name](plans.source(plans.read(spark, sf_dir), carry=False)).plain(), SHOWN[name])


def _lineage(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: plans.PLANS[name](plans.source(plans.read(spark, sf_dir), carry=False)).edges(name)


def _graph(spark: SparkSession, sf_dir: str) -> ForwardGraph:
    events = plans.read(spark, sf_dir)
    held = plans.source(events, carry=False)
    return forward_graph({n: plans.PLANS[n](held) for n in GRAPHED}, events, "event_id", "ts")


def _stream(spark: SparkSession, sf_dir: str, stamped: bool = False) -> Lineage:
    prepare(spark)
    ends = [{"user_id": -1, "event_type": "click", "value": v} for v in (1.0, 25.0)]
    return plans.source(staged(plans.read(spark, sf_dir), "event_id", "ts", ends=ends), watermark="0 seconds", stamped=stamped)


def anomaly_prov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: anomalies with their lineage as a sorted list of source ids."""
    found = plans.anomaly(plans.source(plans.read(spark, sf_dir)))
    return found.df.select(F.concat(F.lit("anomaly|"), "rid").alias("sink"), F.size("prov").cast("bigint").alias("n"), F.array_join(F.col("prov").cast("array<string>"), ",").alias("sources"))


def graph_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).source


def graph_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).sink


def graph_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).edge


def graph_ack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).ack


def graph_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules find in a graph without some ACKs (of ids that end with 7), with some results twice (with 3), and with edges that are too early (of sources that end with 5)."""
    nodes = _graph(spark, sf_dir).nodes().where("not (kind = 'ACK' and uid1 like '%7')").withColumn("ts", F.expr("if(kind = 'EDGE' and uid1 like '%5', 0, ts)"))
    return violations(nodes.unionByName(nodes.where("kind = 'SINK' and uid1 like '%3'"))).groupBy("rule").agg(F.count("*").alias("n"))


def graph_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of each kind, and how many break a rule."""
    nodes = _graph(spark, sf_dir).nodes()
    return nodes.groupBy("kind").agg(F.count("*").alias("n")).join(violations(nodes).agg(F.count("*").alias("broken")))


def graph_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = _graph(spark, sf_dir)
    return latencies(graph.nodes(), graph.max_delay).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg("latency_s"), 6).alias("latency_s"), F.round(F.avg("latency_u"), 6).alias("latency_u"))


def graph_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(_graph(spark, sf_dir).nodes())


def graph_timestamped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamped_lines(_graph(spark, sf_dir).nodes())


def graph_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return command_lines(_graph(spark, sf_dir).nodes())


def graph_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_tables(_graph(spark, sf_dir).nodes())[1]


def backward_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = plans.read(spark, sf_dir)
    held = plans.anomaly(plans.source(events, carry=False)).select(F.col("l_user_id").alias("user_id"), F.col("r_event_id").alias("event_id"))
    return backward_lines(held, events.select("event_id", "user_id"), "event_id", "anomaly")


def delivery_poll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two polls of a delivery store; in the first, one sink has not reported, so no source is acknowledged. Both sinks are complete up to 2024-01-20 in the second."""
    graph = _graph(spark, sf_dir)
    store = DeliveryStore(spark, folder(spark, "store")).create(GRAPHED)
    nodes = graph.nodes().where("kind <> 'ACK'")
    store.append(nodes.where("ts < 1705190400000000"), 0)
    store.mark_safe("anomaly", 1705708800000000, 0)
    first = store.deliver(graph.max_delay, 0).withColumn("poll", F.lit(1))
    store.append(nodes, 1)
    store.mark_safe("inarea", 1705708800000000, 1)
    second = store.deliver(graph.max_delay, 1).withColumn("poll", F.lit(2))
    return first.unionByName(second).select("poll", "kind", "uid1", "uid2", "ts", "data")


def _polled(spark: SparkSession, sf_dir: str) -> DeliveryStore:
    """A store with the graph's nodes in eight transactions by time, a poll after each, and a clock that goes on by a second whenever it is read. Each sink reports its time a transaction late."""
    graph = _graph(spark, sf_dir)
    nodes = kept(graph.nodes().where("kind <> 'ACK'"))
    seconds = count(1_700_000_000)
    store = DeliveryStore(spark, folder(spark, "store"), lambda: float(next(seconds))).create(GRAPHED)
    for k in range(8):
        low, high = _DAYS[0] + k * _DAYS[1], _DAYS[0] + (k + 1) * _DAYS[1]
        due = F.lit(True) if k == 7 else F.col("ts") < high
        store.append(nodes.where(due if k == 0 else due & (F.col("ts") >= low)), k)
        store.append(nodes.where("false"), k)  # comes again, and finds its record
        for sink in GRAPHED:
            store.mark_safe(sink, low, k)
        store.deliver(graph.max_delay, k)
    return store


#: The start of the transactions' times, and how long each is: four days.
_DAYS = (1704067200_000_000, 4 * 86_400_000_000)


def delivery_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each delivered ACK of a source, the poll, and how long its time had been past at every sink."""
    return _polled(spark, sf_dir).ack_latency()


def delivery_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements and largest time of each committed transaction."""
    return _polled(spark, sf_dir).statistics().select("batch", "rows", "most")


def repeated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = repeated(plans.read(spark, sf_dir), 3, "ts", "event_id")
    return held.select("event_id", F.unix_micros("ts").alias("ts_us"), "value")


def union_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small and large values of a user, as two branches brought together, by day."""
    events = plans.source(plans.read(spark, sf_dir), carry=False)
    small, large = (events.where(c).with_column("side", F.lit(s)) for c, s in (("value < 10", "small"), ("value > 100", "large")))
    return _shown(small.union(large).window_agg(["user_id", "side"], "24 hours", n=F.count("*")).plain(), ["user_id", "side", "n", "window_end"])


def exploded_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of events, one row each, counted by name and day."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", event_time("ts").alias("ts"), F.from_json("props", "map<string,string>").alias("props"))
    held = Lineage.source(events, "event_id", "ts", carry=False).explode(F.col("props"), "name", "text").where("text is not null")
    return _shown(held.window_agg(["name"], "24 hours", n=F.count("*"), longest=F.max(F.length("text")).cast("bigint")).plain(), ["name", "n", "longest", "window_end"])


def day_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = metrics.per_second(plans.read(spark, sf_dir), "ts", "value", 60)
    return held.select("second", "count", F.round("average", 6).alias("average"), F.round("most", 6).alias("most"))


def orders_by_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by priority over four weeks sliding by one."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.timestamp_micros(F.unix_date(F.col("o_orderdate").cast("date")).cast("bigint") * 86_400_000_000).alias("ts"), "o_orderpriority", "o_totalprice")
    held = Lineage.source(orders, "o_orderkey", "ts", carry=False).window_agg(["o_orderpriority"], "28 days", "7 days", n=F.count("*"), most=F.max("o_totalprice"))
    return _shown(held.plain(), ["o_orderpriority", "n", "most", "window_end"])


def shipped_soon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines shipped within a month of their order's date, counted by order: an interval join of two sources."""
    day = lambda c: F.timestamp_micros(F.unix_date(F.col(c).cast("date")).cast("bigint") * 86_400_000_000).alias("ts")
    orders = Lineage.source(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", day("o_orderdate")), "o_orderkey", "ts", carry=False)
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), "l_orderkey", day("l_shipdate"), "l_quantity")
    held = Lineage.source(items, "line", "ts", carry=False).interval_join(orders, {"l_orderkey": "o_orderkey"}, "0 days", "30 days", ("i_", "o_"))
    return held.plain().groupBy(F.col("o_o_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.round(F.sum("i_l_quantity"), 6).alias("quantity"))


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("sink_id"))


def synthetic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated sources of each event, taken as a result, two of them shared with the event before."""
    held = synthetic_sources(_numbers(spark, sf_dir), 25, 10, 2).select("sink_id", "sink_ts", F.explode("prov.uid").alias("uid"))
    return held.groupBy("sink_id", "sink_ts").agg(F.count("*").alias("n"), F.min("uid").alias("first"), F.max("uid").alias("last"), F.sum("uid").alias("total"))


def synthetic_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic_overlap(synthetic_sources(_numbers(spark, sf_dir), 25, 50, 12))


def stream_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(drain(plans.anomaly(_stream(spark, sf_dir)).plain(), "anomaly"), SHOWN["anomaly"])


def stream_followup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval join as a stream: both sides have watermarks, so its state is let go once the interval has passed."""
    return _shown(drain(plans.follow_up(_stream(spark, sf_dir)).plain(), "followup"), SHOWN["followup"])


def stream_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream's series of delays by second: how many results it has, whether there is one row a second, and whether delays are sound."""
    prepare(spark)
    ends = [{"user_id": -1, "event_type": "click", "value": v} for v in (1.0, 25.0)]
    rows = plans.source(arriving(staged(plans.read(spark, sf_dir), "event_id", "ts", ends=ends)), watermark="0 seconds")
    results = rows.where("value > 10 AND value < 40").window_agg(["user_id"], "96 hours", "48 hours", n=F.count("*"), stimulus=F.max("stimulus")).where("n > 5")
    log = folder(spark, "latency")
    run_logged(observed(results.plain()), lambda held, batch: plain_lines(held).write.mode("overwrite").parquet(f"{log}-lines/batch={batch}"), f"{log}-progress", log)
    held = latency_series(spark, log)
    lines_held = spark.read.schema("value STRING, delay_ms BIGINT").parquet(f"{log}-lines").agg(F.count("*").alias("lines"), F.min("delay_ms").alias("least"))
    sound = F.when(F.col("count") > 0, (F.col("average") >= 0) & (F.col("average") <= F.col("most"))).otherwise((F.col("average") == -1) & (F.col("most") == -1))
    figures = held.agg(F.sum("count").alias("results"), (F.count("*") == F.max("second") - F.min("second") + 1).alias("each_second"), F.every(sound).alias("sound"))
    return figures.join(lines_held).select("results", "lines", "each_second", (F.col("sound") & (F.col("least") >= 0)).alias("sound"))


def stream_accident(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(drain(plans.accident(_stream(spark, sf_dir)).plain(), "accident"), SHOWN["accident"])


def _stream_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_stream({"inarea": plans.in_area(_stream(spark, sf_dir, stamped=True))})


def stream_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming graph of one plan, all kinds of nodes."""
    return drain(_stream_nodes(spark, sf_dir), "graph")


def _flow(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The streaming graph of a plan whose rows hold no lineage."""
    prepare(spark)
    ends = [{"user_id": -1, "event_type": "click", "value": v} for v in (1.0, 25.0)]
    return graph_stream({name: plans.PLANS[name](plans.source(staged(plans.read(spark, sf_dir), "event_id", "ts", ends=ends), carry=False, watermark="0 seconds"))})


def stream_flow_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as stream_graph, without an array in any row: windows' sources are in keyed state, entry by entry."""
    return drain(_flow(spark, sf_dir, "inarea"), "flow")


def stream_standard_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as stream_graph, from Spark's own operators alone."""
    return drain(standard_graph_stream({"inarea": plans.in_area(_stream(spark, sf_dir))}), "standard")


def stream_flow_blackout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of windows over windows, the later ones over all keys."""
    return drain(_flow(spark, sf_dir, "blackout"), "flow").where("kind = 'EDGE'").select(F.col("uid2").alias("sink"), F.col("uid1").cast("bigint").alias("source"))


def stream_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the streaming graph, and how many were delivered before their vertices or after an ACK of one."""
    return delivery_order(delivered(_stream_nodes(spark, sf_dir)))


def stream_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the streaming graph of one plan."""
    return stream_graph(spark, sf_dir).where("kind = 'EDGE'").select(F.col("uid2").alias("sink"), F.col("uid1").cast("bigint").alias("source"))


def stream_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of the streaming graph and their acknowledgements."""
    found = stream_graph(spark, sf_dir).where("kind = 'SOURCE' or kind = 'ACK' and uid1 not like 'inarea|%'")
    return found.select("kind", F.col("uid1").cast("bigint").alias("uid"), "ts")


DIRECT = (
    anomaly_prov, graph_source, graph_sink, graph_edge, graph_ack, graph_violations, graph_sound, graph_latency, graph_lines, graph_timestamped_lines, graph_commands, graph_relations, backward_text, delivery_poll, delivery_latency, delivery_statistics, repeated_events, union_counts,
    exploded_props, day_series, orders_by_week, shipped_soon, synthetic_edges, synthetic_shared, stream_anomaly, stream_followup, stream_latency, stream_accident, stream_graph, stream_flow_graph, stream_standard_graph, stream_flow_blackout, stream_delivery, stream_edges, stream_sources,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: _plan(name) for name in SHOWN} | {f"{name}_lineage": _lineage(name) for name in SHOWN}
    return out | {f.__name__: f for f in DIRECT} | workload_queries.queries()


def _windowed(rows: str, size: int, slide: int) -> str:
    """SQL for ``rows`` with ``w``, the end of each window (hours) that they are in."""
    return f"(SELECT e.*, time_bucket(INTERVAL {slide} HOUR, e.ts, TIMESTAMP '1970-01-01') - k * INTERVAL {slide} HOUR + INTERVAL {size} HOUR AS w FROM {rows} e, range({size // slide}) t(k))"


_EV = "(SELECT event_id, ts, user_id, event_type, value FROM events)"
_AGG = "max(ts) AS ts, list(event_id) AS prov, w AS window_end"
_MICRO = "INTERVAL 1 MICROSECOND"


def _stopped_sql(n: int) -> str:
    return f"""SELECT user_id, count(*) AS n, arg_max(event_type, ts) AS latest_type, user_id || '|' || epoch_us(w) AS rid, {_AGG}
        FROM {_windowed(f"(SELECT * FROM {_EV} WHERE value < 20)", 96, 24)} GROUP BY user_id, w HAVING count(*) = {n} AND count(DISTINCT event_type) = 1"""


_DAY = f"SELECT user_id, round(sum(value), 6) AS total, user_id || '|' || epoch_us(w) AS rid, {_AGG} FROM {_windowed(_EV, 24, 24)} GROUP BY user_id, w"
_SPEED = f"""SELECT *, abs(arg_max - arg_min) / ((epoch_us(b) - epoch_us(a)) / 3.6e9) AS rate FROM (
    SELECT user_id, count(*) AS n, arg_min(event_id, ts) AS first_id, arg_max(event_id, ts) AS last_id, arg_min(value, ts) AS arg_min, arg_max(value, ts) AS arg_max, min(ts) AS a, max(ts) AS b, user_id || '|' || epoch_us(w) AS rid, {_AGG}
    FROM {_windowed(_EV, 72, 24)} GROUP BY user_id, w HAVING count(*) > 1)"""
#: Rows of each plan, with ``rid``, ``prov``, ``ts`` and ``window_end``.
PLAN_SQL = {
    "stopped": _stopped_sql(3),
    "stopped4": _stopped_sql(4),
    "accident": f"""SELECT latest_type, count(DISTINCT user_id) AS users, latest_type || '|' || epoch_us(w) AS rid, max(data_ts) AS ts, flatten(list(prov)) AS prov, w AS window_end
        FROM {_windowed(f"(SELECT * EXCLUDE (ts), ts AS data_ts, window_end - {_MICRO} AS ts FROM ({_stopped_sql(3)}))", 24, 24)} GROUP BY latest_type, w HAVING count(DISTINCT user_id) > 1""",
    "blackout": f"""SELECT count(*) AS users, CAST(epoch_us(w) AS VARCHAR) AS rid, max(data_ts) AS ts, flatten(list(prov)) AS prov, w AS window_end
        FROM {_windowed(f"(SELECT * EXCLUDE (ts), ts AS data_ts, window_end - {_MICRO} AS ts FROM ({_DAY}) WHERE total < 5)", 24, 24)} GROUP BY w HAVING count(*) > 3""",
    "anomaly": f"""SELECT d.user_id AS l_user_id, r.event_id AS r_event_id, r.event_type AS r_event_type, d.ts AS l_ts, r.ts AS r_ts, d.total AS l_total, r.value AS r_value, round(abs(d.total - r.value), 6) AS difference, d.rid || '#' || r.event_id || '#' || epoch_us(d.window_end) AS rid,
        greatest(d.ts, r.ts) AS ts, list_append(d.prov, r.event_id) AS prov, d.window_end FROM ({_DAY}) d JOIN {_EV} r ON d.user_id = r.user_id AND r.ts >= d.window_end - INTERVAL 1 HOUR AND r.ts < d.window_end
        WHERE d.total > 60 AND round(abs(d.total - r.value), 6) > 60""",
    "inarea": f"""SELECT user_id, count(*) AS n, user_id || '|' || epoch_us(w) AS rid, {_AGG} FROM {_windowed(f"(SELECT * FROM {_EV} WHERE value > 10 AND value < 40)", 96, 48)} GROUP BY user_id, w HAVING count(*) > 5""",
    "speed": _SPEED,
    "highspeed": f"""SELECT user_id, count(*) AS windows, avg(rate) AS average, user_id || '|' || epoch_us(w) AS rid, max(data_ts) AS ts, flatten(list(prov)) AS prov, w AS window_end
        FROM {_windowed(f"(SELECT * EXCLUDE (ts), ts AS data_ts, window_end - {_MICRO} AS ts FROM ({_SPEED}))", 144, 72)} GROUP BY user_id, w HAVING avg(rate) > 1""",
    "crossed": f"""SELECT l.event_id AS l_event_id, r.event_id AS r_event_id, l.event_id || '#' || r.event_id || '#' || epoch_us(l.w) AS rid, greatest(l.ts, r.ts) AS ts, [l.event_id, r.event_id] AS prov, l.w AS window_end
        FROM {_windowed(f"(SELECT * FROM {_EV} WHERE event_type = 'click')", 2, 1)} l JOIN {_windowed(f"(SELECT * FROM {_EV} WHERE event_type = 'view')", 2, 1)} r ON l.user_id = r.user_id AND l.w = r.w""",
    "cycles": f"""SELECT event_type, count(*) AS n, event_type || '|' || epoch_us(w) AS rid, {_AGG} FROM {_windowed(f"(SELECT * FROM {_EV} WHERE value < 100)", 6, 3)} GROUP BY event_type, w HAVING count(*) >= 5""",
    "followup": f"""SELECT l.event_id AS l_event_id, r.event_id AS r_event_id, l.event_id || '#' || r.event_id AS rid, greatest(l.ts, r.ts) AS ts, [l.event_id, r.event_id] AS prov
        FROM (SELECT * FROM {_EV} WHERE event_type = 'purchase') l JOIN (SELECT * FROM {_EV} WHERE event_type = 'click') r ON l.user_id = r.user_id AND l.ts BETWEEN r.ts AND r.ts + INTERVAL 3 HOUR""",
}
_ROUNDED = {"l_total", "r_value", "difference", "rate", "average"}


def _plan_sql(name: str) -> str:
    columns = ", ".join(f"epoch_us({c}) AS {c}_us" if c == "window_end" else f"round({c}, 6) AS {c}" if c in _ROUNDED else c for c in SHOWN[name])
    return f"SELECT {columns} FROM ({PLAN_SQL[name]})"


def _edge_sql(name: str) -> str:
    return f"SELECT DISTINCT '{name}|' || rid AS sink, unnest(prov) AS source FROM ({PLAN_SQL[name]})"


_EDGES = " UNION ".join(_edge_sql(n) for n in GRAPHED)
_JSON_TS = "strftime({}, '%Y-%m-%dT%H:%M:%S.%gZ')".format
_JSON_END = _JSON_TS("window_end")
_SINK_DATA = {
    "anomaly": f"""'{{"l_user_id":' || l_user_id || ',"l_total":' || l_total || ',"l_ts":"' || {_JSON_TS('l_ts')} || '","l_window_end":"' || {_JSON_END} || '","r_event_id":' || r_event_id || ',"r_ts":"' || {_JSON_TS('r_ts')} || '","r_user_id":' || l_user_id || ',"r_event_type":"' || r_event_type || '","r_value":' || r_value || ',"window_end":"' || {_JSON_END} || '","difference":' || difference || '}}'""",
    "inarea": f"""'{{"user_id":' || user_id || ',"n":' || n || ',"window_end":"' || {_JSON_END} || '"}}'""",
}


def _sink_sql(name: str) -> str:
    return f"SELECT '{name}|' || rid AS id, epoch_us(ts) AS ts, {_SINK_DATA[name]} AS data FROM ({PLAN_SQL[name]})"


def _source_sql(edges: str) -> str:
    data = """'{"user_id":' || user_id || ',"event_type":"' || event_type || '","value":' || value || '}'"""
    return f"SELECT CAST(event_id AS VARCHAR) AS id, epoch_us(ts) AS ts, {data} AS data FROM events WHERE event_id IN (SELECT source FROM ({edges}))"


_SINKS = " UNION ".join(_sink_sql(n) for n in GRAPHED)
_SOURCES = _source_sql(_EDGES)
_DELAY = 96 * 3600 * 1_000_000
_ACKS = f"SELECT id, ts + {_DELAY} AS ts FROM ({_SOURCES}) UNION ALL SELECT id, ts FROM ({_SINKS})"
def _timed_edges(edges: str, sources: str, sinks: str) -> str:
    return f"SELECT CAST(e.source AS VARCHAR) AS source, e.sink, greatest(s.ts, k.ts) AS ts FROM ({edges}) e JOIN ({sources}) s ON CAST(e.source AS VARCHAR) = s.id JOIN ({sinks}) k ON e.sink = k.id"


def _node_sql(edges: str, sources: str, sinks: str) -> str:
    """All nodes of a graph."""
    acks = f"SELECT id, ts + {_DELAY} AS ts FROM ({sources}) UNION ALL SELECT id, ts FROM ({sinks})"
    return f"""SELECT 'SOURCE' AS kind, id AS uid1, NULL AS uid2, ts, data FROM ({sources}) UNION ALL SELECT 'SINK', id, NULL, ts, data FROM ({sinks})
        UNION ALL SELECT 'EDGE', source, sink, ts, NULL FROM ({_timed_edges(edges, sources, sinks)}) UNION ALL SELECT 'ACK', id, NULL, ts, NULL FROM ({acks})"""


_TIMED_EDGES = f"SELECT CAST(e.source AS VARCHAR) AS source, e.sink, greatest(s.ts, k.ts) AS ts FROM ({_EDGES}) e JOIN ({_SOURCES}) s ON CAST(e.source AS VARCHAR) = s.id JOIN ({_SINKS}) k ON e.sink = k.id"


_NODES = _node_sql(_EDGES, _SOURCES, _SINKS)
_IN_AREA = (_edge_sql("inarea"), _source_sql(_edge_sql("inarea")), _sink_sql("inarea"))
_LINE = "CASE kind WHEN 'EDGE' THEN 'EDGE ::: ' || uid1 || ' -> ' || uid2 WHEN 'ACK' THEN 'ACK ::: ' || uid1 ELSE kind || ' ::: ' || uid1 || ' ::: ' || data END"


def oracle_sql() -> dict[str, str]:
    out = {name: _plan_sql(name) for name in SHOWN} | {f"{name}_lineage": _edge_sql(name) for name in SHOWN} | workload_queries.oracle_sql()
    return out | {
        "anomaly_prov": f"SELECT 'anomaly|' || rid AS sink, CAST(len(p) AS BIGINT) AS n, array_to_string(p, ',') AS sources FROM (SELECT rid, list_sort(list_distinct(prov)) AS p FROM ({PLAN_SQL['anomaly']}))",
        "graph_source": _SOURCES,
        "graph_sink": _SINKS,
        "graph_edge": f"SELECT CAST(source AS VARCHAR) AS source, sink FROM ({_EDGES})",
        "graph_ack": _ACKS,
        "graph_violations": f"""WITH node AS (SELECT * EXCLUDE (ts), CASE WHEN kind = 'EDGE' AND uid1 LIKE '%5' THEN 0 ELSE ts END AS ts FROM ({_NODES}) WHERE NOT (kind = 'ACK' AND uid1 LIKE '%7'))
            SELECT 'vertex acked' AS rule, count(*) AS n FROM node WHERE kind IN ('SOURCE', 'SINK') AND uid1 LIKE '%7' HAVING count(*) > 0
            UNION ALL SELECT 'vertex once', count(*) FROM node WHERE kind = 'SINK' AND uid1 LIKE '%3' HAVING count(*) > 0
            UNION ALL SELECT 'edge after vertices', 2 * count(*) FROM node WHERE kind = 'EDGE' AND uid1 LIKE '%5' HAVING count(*) > 0""",
        "graph_sound": f"SELECT kind, count(*) AS n, CAST(0 AS BIGINT) AS broken FROM ({_NODES}) GROUP BY kind",
        "graph_latency": f"""SELECT kind, count(*) AS n, round(avg(l), 6) AS latency_s, round(avg(l) / {_DELAY / 1e6}, 6) AS latency_u
            FROM (SELECT 'SOURCE' AS kind, {_DELAY / 1e6} AS l FROM ({_SOURCES}) UNION ALL SELECT 'SINK', 0 FROM ({_SINKS})) GROUP BY kind""",
        "graph_lines": f"SELECT {_LINE} AS value FROM ({_NODES})",
        "graph_timestamped_lines": f"""SELECT ts // 1000 || CASE kind WHEN 'SINK' THEN ' 0 ' WHEN 'SOURCE' THEN ' 1 ' WHEN 'EDGE' THEN ' 2 ' ELSE ' 3 ' END || ts // 1000 || ' ' || {_LINE} AS value FROM ({_NODES})""",
        "graph_commands": f"""SELECT CASE kind WHEN 'EDGE' THEN '{{"ae":{{"' || uid1 || '->' || uid2 || '":{{"source":"' || uid1 || '","target":"' || uid2 || '","directed":true}}}}}}'
            WHEN 'ACK' THEN '{{"cn":{{"' || uid1 || '":{{"done":true}}}}}}'
            ELSE '{{"an":{{"' || uid1 || '":{{"label":"' || uid1 || '","type":"' || lower(kind) || '","data":' || to_json(data) || ',"timestamp":' || ts || ',"done":false}}}}}}' END AS value FROM ({_NODES})""",
        "graph_relations": f"SELECT CAST(source AS VARCHAR) AS src, sink AS dst, 'PROVENANCE' AS relationship FROM ({_EDGES})",
        "backward_text": f"""SELECT '> {{' || '{{"user_id":' || user_id || ',"event_id":' || event_id || '}}' || '}} <- [' || n || '] {{' || chr(10) || rows || chr(10) || '}}' AS value FROM (
            SELECT rid, any_value(l_user_id) AS user_id, any_value(r_event_id) AS event_id, count(*) AS n, string_agg('{{"event_id":' || e.event_id || ',"user_id":' || e.user_id || '}}', chr(10) ORDER BY e.event_id) AS rows
            FROM (SELECT rid, l_user_id, r_event_id, unnest(list_distinct(prov)) AS source FROM ({PLAN_SQL['anomaly']})) JOIN events e ON e.event_id = source GROUP BY rid)""",
        "delivery_poll": f"""WITH node AS (SELECT * FROM ({_NODES}) WHERE kind <> 'ACK'), part AS (SELECT CAST(CASE WHEN ts < 1705190400000000 THEN 1 ELSE 2 END AS INTEGER) AS poll, * FROM node)
            SELECT * FROM part UNION ALL SELECT poll, 'ACK', uid1, NULL, ts, NULL FROM part WHERE kind = 'SINK'
            UNION ALL SELECT 2, 'ACK', uid1, NULL, ts + {_DELAY}, NULL FROM node WHERE kind = 'SOURCE' AND ts + {_DELAY} < 1705708800000000""",
        # The clock: 1 for the sinks' registration, then for poll k its transaction (the copy reads no clock), the two reports and the poll.
        "delivery_latency": f"""WITH ack AS (SELECT id AS uid1, ts + {_DELAY} AS ts FROM ({_SOURCES})),
            report AS (SELECT k, 1704067200000000 + k * 345600000000 AS safe FROM range(8) t(k)),
            met AS (SELECT uid1, ts, min(k) AS poll FROM ack JOIN report ON ts < safe GROUP BY ALL)
            SELECT poll, uid1, CAST(1000 AS BIGINT) AS delivery_ms FROM met""",
        "delivery_statistics": f"""SELECT greatest(0, least(7, (ts - 1704067200000000) // 345600000000)) AS batch, count(*) AS rows, max(ts) AS most FROM ({_NODES}) WHERE kind <> 'ACK' GROUP BY ALL""",
        "repeated_events": """SELECT (k << 58) | event_id AS event_id, epoch_us(ts) + k * len AS ts_us, value
            FROM events, (SELECT epoch_us(max(ts)) - epoch_us(min(ts)) + 1000000 AS len FROM events), (SELECT CAST(range AS BIGINT) AS k FROM range(3))""",
        "union_counts": f"""SELECT user_id, CASE WHEN value < 10 THEN 'small' ELSE 'large' END AS side, count(*) AS n, epoch_us(w) AS window_end_us
            FROM {_windowed(f"(SELECT * FROM {_EV} WHERE value < 10 OR value > 100)", 24, 24)} GROUP BY ALL""",
        "exploded_props": f"""SELECT name, count(*) AS n, CAST(max(length(t)) AS BIGINT) AS longest, epoch_us(w) AS window_end_us FROM (
            SELECT w, name, json_extract_string(props, '$."' || name || '"') AS t FROM (SELECT w, props, unnest(json_keys(props)) AS name FROM {_windowed('(SELECT ts, props FROM events)', 24, 24)})) WHERE t IS NOT NULL GROUP BY name, w""",
        "day_series": """WITH held AS (SELECT epoch_us(ts) // 60000000 * 60 AS second, count(*) AS n, avg(value) AS a, max(value) AS m FROM events GROUP BY 1),
            span AS (SELECT unnest(range(min(second), max(second) + 1, 60)) AS second FROM held)
            SELECT second, coalesce(n, 0) AS count, round(coalesce(a, -1.0), 6) AS average, round(coalesce(m, -1.0), 6) AS most FROM span LEFT JOIN held USING (second)""",
        "orders_by_week": f"""SELECT o_orderpriority, count(*) AS n, round(max(o_totalprice), 6) AS most, epoch_us(w) AS window_end_us
            FROM {_windowed('(SELECT CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS ts, o_orderpriority, o_totalprice FROM orders)', 672, 168)} GROUP BY o_orderpriority, w""",
        "shipped_soon": """SELECT o_orderkey, count(*) AS n, round(sum(l_quantity), 6) AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey
            AND CAST(l_shipdate AS DATE) >= CAST(o_orderdate AS DATE) AND CAST(l_shipdate AS DATE) <= CAST(o_orderdate AS DATE) + INTERVAL 30 DAY GROUP BY o_orderkey""",
        "synthetic_edges": "SELECT i AS sink_id, i + 25 AS sink_ts, count(*) AS n, min(i * 8 + j) AS first, max(i * 8 + j) AS last, CAST(sum(i * 8 + j) AS BIGINT) AS total FROM (SELECT event_id AS i FROM events), range(10) b(j) GROUP BY i",
        "synthetic_shared": """WITH held AS (SELECT i, list(i * 38 + j) AS ids FROM (SELECT event_id AS i FROM events), range(50) b(j) GROUP BY i)
            SELECT avg(len(list_intersect(x.ids, y.ids))) AS mean_overlap FROM held x JOIN held y ON x.i = y.i + 1""",
        "stream_anomaly": _plan_sql("anomaly"),
        "stream_accident": _plan_sql("accident"),
        "stream_followup": _plan_sql("followup"),
        "stream_latency": f"SELECT count(*) AS results, count(*) AS lines, true AS each_second, true AS sound FROM ({PLAN_SQL['inarea']})",
        "stream_edges": _edge_sql("inarea"),
        "stream_graph": _node_sql(*_IN_AREA),
        "stream_flow_graph": _node_sql(*_IN_AREA),
        "stream_standard_graph": _node_sql(*_IN_AREA),
        "stream_flow_blackout": _edge_sql("blackout"),
        "stream_delivery": f"SELECT count(*) AS edges, CAST(0 AS BIGINT) AS early, CAST(0 AS BIGINT) AS late FROM ({_edge_sql('inarea')})",
        "stream_sources": f"SELECT kind, CAST(uid1 AS BIGINT) AS uid, ts FROM ({_node_sql(*_IN_AREA)}) WHERE kind = 'SOURCE' OR kind = 'ACK' AND uid1 NOT LIKE 'inarea|%'",
    }
