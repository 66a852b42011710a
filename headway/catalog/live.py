"""Streaming jobs drained over the events table, compared with their batch form."""

from pyspark.sql import functions as F

from headway.catalog.base import query, r6, rounded
from headway.catalog.feeds import seen_vehicles, write_binary
from headway.session import scratch_path
from headway.sinks.tables import _glob, current
from headway.sources.snapshots import stream_snapshots
from headway.streaming import jobs as st


def stream(t, source=None):
    e = t.raw("events")
    s = source if source is not None else st.event_stream(t.spark, f"{t.folder}/events*.parquet", e.schema)
    return s.select(F.col("event_id").alias("obs_id"), "ts", F.col("event_type").alias("route_id"), F.col("user_id").alias("stop_id"), ((F.col("value") - 50) * 20).alias("delay"))


def paths(t, name):
    root = scratch_path(t.spark, name)
    return f"{root}/data", f"{root}/checkpoint"


def drained(q):
    q.awaitTermination()
    if q.exception():
        raise q.exception()


@query("r01_append_snapshots", "obs", "SELECT obs_id, ts, route_id, stop_id, delay FROM obs")
def _(t):
    data, check = paths(t, "append-stream")
    for _i in range(2):
        drained(st.append_snapshots(stream(t), data, check))
    return t.spark.read.parquet(data)


@query("r01_binary_snapshots", "upd", "SELECT CAST(trip_id AS VARCHAR) AS trip, CAST(stop_id AS VARCHAR) AS stop, stop_sequence, '2.0' AS version FROM upd")
def _(t):
    data, check = paths(t, "binary-stream")
    source = scratch_path(t.spark, "binary-source")
    write_binary(t, source)
    files = _glob(t.spark, f"{source}/part-*")
    # A batch takes the files of three writing tasks: there are more files where tasks write more, not more batches.
    each = 3 * -(-len(files) // max(1, len({f.getName().split("-")[1] for f in files})))
    for _i in range(2):
        drained(st.append_snapshots(seen_vehicles(stream_snapshots(t.spark, f"{source}/part-*", "vehicle", each)).drop("price"), data, check))
    return t.spark.read.parquet(data)


@query("r02_latest_updates", "obs", """, r AS (SELECT *, row_number() OVER (PARTITION BY stop_id, route_id ORDER BY ts DESC, obs_id DESC) AS rn FROM obs) SELECT obs_id, stop_id, route_id, delay FROM r WHERE rn = 1 AND ts >= (SELECT max(ts) FROM obs) - INTERVAL 72 HOUR""")
def _(t):
    root, check = paths(t, "latest-stream")
    drained(st.latest_updates(stream(t), ["stop_id", "route_id"], ["ts", "obs_id"], root, check, "ts", "72 hours"))
    return st.live(t.spark, root, "ts", "72 hours").select("obs_id", "stop_id", "route_id", "delay")


@query("r03_new_dimension_rows", "obs", "SELECT DISTINCT stop_id, route_id FROM obs")
def _(t):
    data, check = paths(t, "dimension-stream")
    # Two batches over two folders: later events first, so that keys return and others come late.
    e, halves = t.raw("events"), scratch_path(t.spark, "dimension-source")
    for late in (False, True):
        e.where((F.col("event_id") % 3 == 0) if late else (F.col("event_id") % 3 > 0)).write.mode("append").parquet(halves)
        source = st.event_stream(t.spark, halves, e.schema)
        drained(st.new_dimension_rows(stream(t, source), ["stop_id", "route_id"], "ts", data, check))
    return t.spark.read.parquet(data).select("stop_id", "route_id")


@query("r04_hourly_buckets", "obs", """SELECT date_trunc('hour', ts) AS time_bucket, route_id, round(avg(delay) + 1e-9, 6) AS mean, count(*) AS n FROM obs GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM obs) - INTERVAL 10 MINUTE""")
def _(t):
    data, check = paths(t, "hourly-stream")
    drained(st.to_parquet(st.hourly_buckets(stream(t), ["route_id"], "ts", "delay"), data, check))
    return rounded(t.spark.read.parquet(data), "mean")


@query("r05_sliding_trend", "obs", """, w AS (SELECT *, unnest(range(6)) AS i FROM obs), s AS (SELECT *, time_bucket(INTERVAL 10 MINUTE, ts) - to_minutes(i * 10) AS start FROM w)
SELECT start, start + INTERVAL 60 MINUTE AS "end", route_id, round(avg(delay) + 1e-9, 6) AS trend, count(*) AS n FROM s GROUP BY 1, 2, 3 HAVING start + INTERVAL 60 MINUTE <= (SELECT max(ts) FROM obs) - INTERVAL 10 MINUTE""")
def _(t):
    data, check = paths(t, "trend-stream")
    drained(st.to_parquet(st.sliding_trend(stream(t), ["route_id"], "ts", "delay"), data, check))
    return rounded(t.spark.read.parquet(data), "trend")


@query("r06_live_regions", "obs", """, w AS (SELECT *, unnest(range(4)) AS i FROM obs), s AS (SELECT *, time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(i * 30) AS start FROM w) SELECT start, route_id, round(avg(delay) + 1e-9, 6) AS avg_delay_seconds, count(*) AS n FROM s GROUP BY 1, 2""")
def _(t):
    root, check = paths(t, "region-stream")
    drained(st.live_regions(stream(t), "route_id", "ts", "delay", root, check))
    return rounded(current(t.spark, root), "avg_delay_seconds")


@query("r07_closed_hours", "obs", "SELECT date_trunc('hour', ts) AS hour, round(avg(delay) + 1e-9, 6) AS delay, count(*) AS n FROM obs GROUP BY 1 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM obs)")
def _(t):
    data, check = paths(t, "hours-stream")
    drained(st.to_parquet(st.closed_hours(stream(t), "ts", ["delay"]), data, check))
    return rounded(t.spark.read.parquet(data), "delay")
