"""The workloads' plans on rows of their own kind, made from ``events`` by rules that SQL has too, with SQL for the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wellspring.functions import event_time, from_units, speed_kmh
from wellspring.operators import Lineage, forward_graph
from wellspring.plans import workloads
from wellspring.sources import cloud_vehicles, frames, linear_road, smart_grid, synthetic_sources
from wellspring.streaming import drain, frame_stream, prepare
from wellspring.streaming.run import folder


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value")


def _at(count: Column, milliseconds: int = 1000) -> Column:
    return from_units(count, milliseconds).alias("ts")


def reports(events: DataFrame) -> DataFrame:
    """Of each event a vehicle that reports four times, every 30 seconds; it stands where its user's number is a multiple of 3."""
    each = events.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(3))))
    zero = F.lit(0)
    return each.select((F.col("event_id") * 4 + F.col("j")).alias("uid"), _at(F.col("event_id") * 20 + F.col("j") * 30), zero.alias("type"), F.col("event_id").alias("vid"), F.when(F.col("user_id") % 3 == 0, 0).otherwise(50).alias("speed"), zero.alias("xway"), zero.alias("lane"), zero.alias("dir"), zero.alias("seg"), (F.col("user_id") % 5).alias("pos"))


def readings(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_id").alias("uid"), _at(F.col("event_id") % 2400 * 3600), (F.col("user_id") % 300).cast("string").alias("key"), F.when(F.col("value") < 30, 0).otherwise(F.floor(F.col("value") * 8)).alias("value"))


def positions(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_id").alias("uid"), _at(F.col("event_id") * 2), (F.col("user_id") % 8).alias("car_id"), (F.lit(39.91) + (F.col("event_id") * 7 % 1000) / F.lit(1e5)).alias("lat"), (F.lit(116.3) + (F.col("event_id") * 13 % 1000) / F.lit(5e4)).alias("lon"))


def _one(key: Column, label: str, x: Column, y: Column) -> Column:
    return F.create_map(key, F.struct(F.lit(label).alias("label"), x.alias("x"), y.alias("y"), F.lit(0.0).alias("z")))


def vehicle_frames(events: DataFrame) -> DataFrame:
    number = lambda c: F.concat(F.lit("p"), c.cast("string"))
    seen = lambda name, held: F.struct(F.lit(name).alias("payload_type"), held.alias("annotations"))
    far, one = F.col("value"), F.lit(1.0)
    return events.select(
        F.col("event_id").alias("uid"), _at(F.col("event_id") * F.lit(200), 1), seen("lidar", _one(F.lit("b"), "BICYCLE", far, one)).alias("lidar"),
        seen("ring_front_left", _one(number(F.col("user_id") % 7), "PEDESTRIAN", one, one)).alias("left"), seen("ring_front_right", _one(number(F.col("event_id") % 11), "PEDESTRIAN", one, one)).alias("right"),
    )


def payloads(events: DataFrame) -> DataFrame:
    """Three payloads of each event, a few milliseconds apart."""
    each = events.withColumn("p", F.explode(F.array(*(F.struct(F.lit(k).alias("payload"), F.lit(late).cast("bigint").alias("late")) for k, late in (("ring_front_left", 3_000_000), ("lidar", 0), ("ring_front_right", 5_000_001))))))
    return each.select(F.col("p.payload").alias("payload_type"), (F.col("event_id") * 100_000_000 + F.col("p.late")).alias("ns"), _one(F.col("event_id").cast("string"), "BICYCLE", F.lit(1.0), F.lit(1.0)).alias("annotations"))


PLANS: dict[str, tuple[Callable, Callable, list[str]]] = {
    "lr_stopped": (reports, workloads.stopped_vehicles, ["vid", "reports", "pos", "window_end"]),
    "lr_accident": (reports, lambda x: workloads.accidents(workloads.stopped_vehicles(x)), ["pos", "count", "window_end"]),
    "sg_anomaly": (readings, workloads.anomalies, ["l_key", "r_uid", "l_total", "difference", "window_end"]),
    "sg_blackout": (readings, workloads.blackouts, ["count", "window_end"]),
    "cv_highspeed": (positions, workloads.high_speed, ["car_id", "average", "window_end"]),
    "cv_inarea": (positions, workloads.in_area, ["car_id", "count", "window_end"]),
    "lv_crossed": (vehicle_frames, workloads.crossed_pedestrians, ["l_payload_type", "l_object_id", "r_payload_type", "n", "window_end"]),
    "lv_cycles": (vehicle_frames, workloads.cycles_in_front, ["payload_type", "count", "window_end"]),
}


def _shown(df: DataFrame, columns: list[str]) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*(F.unix_micros(c).alias(f"{c}_us") if kinds[c] == "timestamp" else F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c).cast("bigint").alias(c) if kinds[c] == "int" else F.col(c) for c in columns))


def _plan(name: str) -> Callable[[SparkSession, str], DataFrame]:
    rows, plan, columns = PLANS[name]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = plan(Lineage.source(rows(_events(spark, sf_dir)), "uid", "ts", carry=False)).plain()
        if name == "lv_crossed":  # how often two cameras saw one; lv_crossed_graph has each pair
            out = out.groupBy("l_payload_type", "l_object_id", "r_payload_type", "window_end").agg(F.count("*").alias("n"))
        return _shown(out, columns)

    return query


def _lineage(name: str) -> Callable[[SparkSession, str], DataFrame]:
    rows, plan, _ = PLANS[name]
    return lambda spark, sf_dir: plan(Lineage.source(rows(_events(spark, sf_dir)), "uid", "ts", carry=False)).edges(name)


def lv_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third frame of payloads with clocks of their own, played twice."""
    held = frames(payloads(_events(spark, sf_dir)), every=3, times=2)
    key = lambda side: F.col(f"{side}.annotations")[0]["key"].cast("bigint").alias(side)
    return held.select(F.unix_millis("ts").alias("ms"), key("lidar"), key("left"), key("right"))


def stream_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third frame of the same payloads an hour later, as a stream."""
    prepare(spark)
    rows, path = payloads(_events(spark, sf_dir)).withColumn("ns", F.col("ns") + 3_600_000_000_000).withColumn("annotations", F.map_entries("annotations")), folder(spark, "payloads")
    rows.repartition(4).write.parquet(path)
    # The row that ends the stream is of no kind that a frame has.
    spark.range(1).select(F.lit("end").alias("payload_type"), F.lit(1 << 62).alias("ns"), F.lit(None).cast(rows.schema["annotations"].dataType).alias("annotations")).write.mode("append").parquet(path)
    held = drain(frame_stream(spark.readStream.schema(rows.schema).parquet(path), every=3), "frames")
    key = lambda side: F.col(f"{side}.annotations")[0]["key"].cast("bigint").alias(side)
    return held.select(F.unix_millis("ts").alias("ms"), key("lidar"), key("left"), key("right"))


def _file(rows: DataFrame, name: str) -> str:
    """The rows as a text input without a header."""
    path = folder(rows.sparkSession, name)
    rows.write.csv(path)
    return path


def lr_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position reports written as text and read by two instances, the second with vehicles of its own."""
    rows = reports(_events(spark, sf_dir)).select("type", F.unix_seconds("ts").alias("time"), "vid", "speed", "xway", "lane", "dir", "seg", "pos")
    return linear_road(spark, _file(rows, "linear-road"), 2, 1_000_000).select("key", F.unix_micros("ts").alias("ts_us"), "xway", "vid", "speed", "pos")


def sg_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meter readings written as text and read by three instances."""
    rows = readings(_events(spark, sf_dir)).select(F.expr("unix_seconds(ts) div 3600").alias("hours"), F.col("key").alias("meter"), "value")
    return smart_grid(spark, _file(rows, "smart-grid"), 3, 1000).select("key", F.unix_micros("ts").alias("ts_us"), "value")


def cv_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicle positions written as text and read back."""
    rows = positions(_events(spark, sf_dir)).select(F.unix_seconds("ts").alias("seconds"), "car_id", "lat", "lon")
    return cloud_vehicles(spark, _file(rows, "cloud")).select(F.unix_micros("ts").alias("ts_us"), F.col("car_id").cast("bigint").alias("car_id"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def cv_current_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The speed between each position of a car and its next."""
    order = Window.partitionBy("car_id").orderBy("ts")
    lead = lambda c: F.lead(c).over(order)
    speed = speed_kmh(F.col("lat"), F.col("lon"), F.unix_millis("ts"), lead("lat"), lead("lon"), F.unix_millis(lead("ts")))
    return positions(_events(spark, sf_dir)).select("uid", F.round(speed, 4).alias("speed"))


def _odd_keys(spark: SparkSession, sf_dir: str, carry: bool) -> Lineage:
    """Events by day and keys that are null, empty or hold the marks that stand between keys."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    a = F.element_at(F.array(*(F.lit(x).cast("string") for x in (None, "", "a|b", "a", "a#\\"))), (F.col("user_id") % 5 + 1).cast("int"))
    b = F.element_at(F.array(*(F.lit(x).cast("string") for x in ("c", "b|c", None, "z"))), (F.col("event_id") % 4 + 1).cast("int"))
    rows = events.select("event_id", event_time("ts").alias("ts"), a.alias("a"), b.alias("b"))
    return Lineage.source(rows, "event_id", "ts", carry).window_agg(["a", "b"], "24 hours", n=F.count("*"))


def odd_key_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _odd_keys(spark, sf_dir, False).edges("odd")


def odd_key_prov(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _odd_keys(spark, sf_dir, True)
    return found.df.select(F.concat(F.lit("odd|"), "rid").alias("sink"), "n", F.array_join(F.col("prov").cast("array<string>"), ",").alias("sources"))


def array_key_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by keys that are arrays, some of which look alike when they are joined by commas, and instants."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = lambda *words: F.array(*(F.lit(w) for w in words))
    a = F.element_at(F.array(text("a, b"), text("a", "b"), text("a, b", "c"), text("a", "b, c"), F.lit(None).cast("array<string>")), (F.col("user_id") % 5 + 1).cast("int"))
    rows = events.select("event_id", event_time("ts").alias("ts"), a.alias("a"), event_time("ts").alias("hour")).withColumn("hour", F.date_trunc("hour", "hour"))
    return Lineage.source(rows, "event_id", "ts", carry=False).window_agg(["a", "hour"], "24 hours", n=F.count("*")).edges("array")


def lv_crossed_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forward graph of pedestrians crossing: each pair of annotations is a result of its own."""
    rows = vehicle_frames(_events(spark, sf_dir))
    nodes = forward_graph({"lv_crossed": workloads.crossed_pedestrians(Lineage.source(rows, "uid", "ts", carry=False))}, rows, "uid", "ts").nodes()
    return nodes.select("kind", "uid1", "uid2", "ts")


def synthetic_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of ten generated sources of each event."""
    return synthetic_sources(_events(spark, sf_dir).select(F.col("event_id").alias("sink_id")), 25, 10, 0, 48).select(F.explode("prov").alias("p")).select("p.uid", F.lower(F.hex("p.data")).alias("data"))


DIRECT = (lr_file, sg_file, cv_file, lv_frames, stream_frames, lv_crossed_graph, cv_current_speed, odd_key_edges, odd_key_prov, array_key_edges, synthetic_data)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _plan(name) for name in PLANS} | {f"{name}_lineage": _lineage(name) for name in PLANS} | {f.__name__: f for f in DIRECT}


def _windowed(rows: str, size: int, slide: int) -> str:
    """SQL for ``rows`` with ``w``, the end of each window (seconds) that they are in."""
    return f"(SELECT e.*, time_bucket(INTERVAL {slide} SECOND, e.ts, TIMESTAMP '1970-01-01') - k * INTERVAL {slide} SECOND + INTERVAL {size} SECOND AS w FROM {rows} e, range({size // slide}) t(k))"


def _later(rows: str) -> str:
    """Results as the input of later windows."""
    return f"(SELECT * EXCLUDE (ts), ts AS data_ts, window_end - INTERVAL 1 MICROSECOND AS ts FROM ({rows}))"


_US = "make_timestamp(CAST({} AS BIGINT))".format
_REPORTS = f"(SELECT event_id * 4 + j AS uid, {_US('(event_id * 20 + j * 30) * 1000000')} AS ts, event_id AS vid, user_id % 5 AS pos FROM events, range(4) r(j) WHERE user_id % 3 = 0)"
_READINGS = f"(SELECT event_id AS uid, {_US('event_id % 2400 * 3600000000')} AS ts, CAST(user_id % 300 AS VARCHAR) AS key, CASE WHEN value < 30 THEN 0 ELSE CAST(floor(value * 8) AS BIGINT) END AS value FROM events)"
_POSITIONS = f"(SELECT event_id AS uid, {_US('event_id * 2000000')} AS ts, user_id % 8 AS car_id, CAST(39.91 AS DOUBLE) + (event_id * 7 % 1000) / CAST(1e5 AS DOUBLE) AS lat, CAST(116.3 AS DOUBLE) + (event_id * 13 % 1000) / CAST(5e4 AS DOUBLE) AS lon FROM events)"
_FRAMES = f"(SELECT event_id AS uid, {_US('event_id * 200000')} AS ts, value, 'p' || user_id % 7 AS l, 'p' || event_id % 11 AS r FROM events)"
_AGG = "max(ts) AS ts, list(uid) AS prov, w AS window_end"
_STOPPED = f"SELECT vid, count(*) AS reports, any_value(pos) AS pos, vid || '|' || epoch_us(w) AS rid, {_AGG} FROM {_windowed(_REPORTS, 120, 30)} GROUP BY vid, w HAVING count(*) = 4 AND count(DISTINCT pos) = 1"
_DAY = f"SELECT key, sum(value) AS total, key || '|' || epoch_us(w) AS rid, {_AGG} FROM {_windowed(_READINGS, 86400, 86400)} GROUP BY key, w"


def _kmh(a: str, b: str, t: str) -> str:
    return f"sqrt(pow(({b}.lat - {a}.lat) * 110574.307, 2) + pow(({b}.lon - {a}.lon) * 111132.954, 2)) / {t} * 1000 * 3.6"


_SPEED = f"""SELECT *, {_kmh('a', 'b', '((epoch_us(t1) - epoch_us(t0)) // 1000)')} AS speed FROM (
    SELECT car_id, arg_min({{'lat': lat, 'lon': lon}}, ts) AS a, arg_max({{'lat': lat, 'lon': lon}}, ts) AS b, min(ts) AS t0, max(ts) AS t1, car_id || '|' || epoch_us(w) AS rid, {_AGG}
    FROM {_windowed(_POSITIONS, 15, 5)} GROUP BY car_id, w HAVING count(*) > 1)"""
_WALKERS = f"""(SELECT uid, uid || '@0@' || l AS id, ts, 'ring_front_left' AS cam, l AS obj FROM {_FRAMES} UNION ALL SELECT uid, uid || '@1@' || r, ts, 'ring_front_right', r FROM {_FRAMES})"""
_OTHER = "CASE a.cam WHEN 'ring_front_left' THEN 'ring_front_right' ELSE 'ring_front_left' END"
PLAN_SQL = {
    "lr_stopped": _STOPPED,
    "lr_accident": f"SELECT pos, count(DISTINCT vid) AS count, pos || '|' || epoch_us(w) AS rid, max(data_ts) AS ts, flatten(list(prov)) AS prov, w AS window_end FROM {_windowed(_later(_STOPPED), 30, 30)} GROUP BY pos, w HAVING count(DISTINCT vid) > 1",
    "sg_anomaly": f"""SELECT d.key AS l_key, r.uid AS r_uid, CAST(d.total AS BIGINT) AS l_total, CAST(abs(d.total - r.value) AS BIGINT) AS difference, d.rid || '#' || r.uid || '#' || epoch_us(d.window_end) AS rid, list_append(d.prov, r.uid) AS prov, d.window_end
        FROM ({_DAY}) d JOIN {_READINGS} r ON d.key = r.key AND r.ts >= d.window_end - INTERVAL 1 HOUR AND r.ts < d.window_end WHERE d.total > 200 AND abs(d.total - r.value) > 200""",
    "sg_blackout": f"SELECT count(*) AS count, CAST(epoch_us(w) AS VARCHAR) AS rid, flatten(list(prov)) AS prov, w AS window_end FROM {_windowed(_later(f'SELECT * FROM ({_DAY}) WHERE total <= 0'), 86400, 86400)} GROUP BY w HAVING count(*) > 7",
    "cv_highspeed": f"SELECT car_id, avg(speed) AS average, car_id || '|' || epoch_us(w) AS rid, flatten(list(prov)) AS prov, w AS window_end FROM {_windowed(_later(_SPEED), 120, 60)} GROUP BY car_id, w HAVING avg(speed) > 70",
    "cv_inarea": f"SELECT car_id, count(*) AS count, car_id || '|' || epoch_us(w) AS rid, {_AGG} FROM {_windowed(f'(SELECT * FROM {_POSITIONS} WHERE lat > 39.912915 AND lat < 39.9206835 AND lon > 116.299221 AND lon < 116.3188575)', 300, 150)} GROUP BY car_id, w HAVING count(*) > 9",
    "lv_crossed": f"""SELECT a.cam AS l_payload_type, a.obj AS l_object_id, b.cam AS r_payload_type, a.id || '#' || b.id || '#' || epoch_us(a.w) AS rid, greatest(a.ts, b.ts) AS ts, [a.uid, b.uid] AS prov, a.w AS window_end
        FROM {_windowed(_WALKERS, 2, 1)} a JOIN {_windowed(_WALKERS, 2, 1)} b ON a.w = b.w AND a.obj = b.obj AND b.cam = {_OTHER}""",
    "lv_cycles": f"SELECT 'lidar' AS payload_type, count(*) AS count, 'lidar|' || epoch_us(w) AS rid, {_AGG} FROM {_windowed(f'(SELECT * FROM {_FRAMES} WHERE abs(value) < 20)', 6, 3)} GROUP BY w HAVING count(*) >= 11",
}


_FRAME_SQL = """WITH p AS (SELECT event_id, late, name, row_number() OVER (ORDER BY event_id * 100000000 + late, name) - 1 AS k
        FROM events, (VALUES ('ring_front_left', 3000000), ('lidar', 0), ('ring_front_right', 5000001)) v(name, late)),
    f AS (SELECT row_number() OVER (ORDER BY k // 3) - 1 AS i, count(*) OVER () AS len, max(event_id * 100000000 + late) FILTER (WHERE name = 'lidar') AS ns,
        max(event_id) FILTER (WHERE name = 'lidar') AS lidar, max(event_id) FILTER (WHERE name LIKE '%left') AS l, max(event_id) FILTER (WHERE name LIKE '%right') AS r FROM p GROUP BY k // 3)"""


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, (_, _, columns) in PLANS.items():
        rows = PLAN_SQL[name]
        if name == "lv_crossed":
            rows = f"SELECT l_payload_type, l_object_id, r_payload_type, window_end, count(*) AS n FROM ({rows}) GROUP BY ALL"
        shown = ", ".join(f"epoch_us({c}) AS {c}_us" if c == "window_end" else f"round({c}, 6) AS {c}" if c == "average" else f"{c}" for c in columns)
        out[name] = f"SELECT {shown} FROM ({rows})"
        out[f"{name}_lineage"] = f"SELECT DISTINCT '{name}|' || rid AS sink, unnest(prov) AS source FROM ({PLAN_SQL[name]})"
    escaped = "coalesce(replace(replace(replace({0}, '\\', '\\\\'), '|', '\\p'), '#', '\\h'), '\\0')".format
    odd = f"""SELECT 'odd|' || {escaped('a')} || '|' || {escaped('b')} || '|' || epoch_us(date_trunc('day', ts) + INTERVAL 1 DAY) AS sink, count(*) AS n, list(event_id) AS prov
        FROM (SELECT event_id, ts, [NULL, '', 'a|b', 'a', 'a#\\'][user_id % 5 + 1] AS a, ['c', 'b|c', NULL, 'z'][event_id % 4 + 1] AS b FROM events) GROUP BY a, b, date_trunc('day', ts)"""
    crossed, seen = f"SELECT 'lv_crossed|' || rid AS id, epoch_us(ts) AS ts, prov FROM ({PLAN_SQL['lv_crossed']})", f"SELECT uid, epoch_us(ts) AS ts FROM {_FRAMES}"
    return out | {
        "lv_crossed_graph": f"""WITH sink AS ({crossed}), edge AS (SELECT DISTINCT id, ts, unnest(prov) AS uid FROM sink), source AS (SELECT * FROM ({seen}) WHERE uid IN (SELECT uid FROM edge))
            SELECT 'SOURCE' AS kind, CAST(uid AS VARCHAR) AS uid1, NULL AS uid2, ts FROM source UNION ALL SELECT 'ACK', CAST(uid AS VARCHAR), NULL, ts + 2000000 FROM source
            UNION ALL SELECT 'SINK', id, NULL, ts FROM sink UNION ALL SELECT 'ACK', id, NULL, ts FROM sink
            UNION ALL SELECT 'EDGE', CAST(uid AS VARCHAR), id, greatest(edge.ts, source.ts) FROM edge JOIN source USING (uid)""",
        "array_key_edges": """SELECT 'array|' || CASE WHEN a IS NULL THEN '\\0' ELSE '{"k":' || to_json(a) || '}' END || '|' || epoch_us(date_trunc('hour', ts)) || '|' || epoch_us(date_trunc('day', ts) + INTERVAL 1 DAY) AS sink, event_id AS source
            FROM (SELECT event_id, ts, [['a, b'], ['a', 'b'], ['a, b', 'c'], ['a', 'b, c'], NULL][user_id % 5 + 1] AS a FROM events)""",
        "lv_frames": f"""{_FRAME_SQL}, s AS (SELECT max(ns) - min(ns) + 1 AS shift FROM f)
            SELECT CAST((ns + turn * shift) // 1000000 AS BIGINT) AS ms, lidar, l AS "left", r AS "right" FROM f, s, range(2) t(turn) WHERE (turn * len + i) % 3 = 0""",
        "stream_frames": f"""{_FRAME_SQL} SELECT CAST(ns // 1000000 AS BIGINT) + 3600000 AS ms, lidar, l AS "left", r AS "right" FROM f WHERE i % 3 = 0""",
        "lr_file": """SELECT CAST(vid AS VARCHAR) AS key, ts_us, xway, vid, CAST(speed AS INT) AS speed, CAST(pos AS INT) AS pos FROM (
            SELECT event_id + x * 1000000 AS vid, (event_id * 20 + j * 30) * 1000000 AS ts_us, CAST(x AS INT) AS xway, CASE WHEN user_id % 3 = 0 THEN 0 ELSE 50 END AS speed, user_id % 5 AS pos FROM events, range(4) r(j), range(2) i(x))""",
        "sg_file": f"SELECT CAST(CAST(key AS BIGINT) + k * 1000 AS VARCHAR) AS key, epoch_us(ts) AS ts_us, value FROM {_READINGS}, range(3) i(k)",
        "cv_file": f"SELECT epoch_us(ts) AS ts_us, car_id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM {_POSITIONS}",
        "cv_current_speed": f"""SELECT a.uid, round({_kmh('a', 'a.b', "((epoch_us(a.b.ts) - epoch_us(a.ts)) // 1000)")}, 4) AS speed
            FROM (SELECT *, lead({{'lat': lat, 'lon': lon, 'ts': ts}}) OVER (PARTITION BY car_id ORDER BY ts) AS b FROM {_POSITIONS}) a""",
        "odd_key_edges": f"SELECT sink, unnest(prov) AS source FROM ({odd})",
        "odd_key_prov": f"SELECT sink, n, array_to_string(list_sort(prov), ',') AS sources FROM ({odd})",
        "synthetic_data": "SELECT i * 10 + j AS uid, repeat(sha256(CAST(i * 10 + j AS VARCHAR)), 2)[:96] AS data FROM (SELECT event_id AS i FROM events), range(10) b(j)",
    }
