"""Ordered features and fills on the given tables."""

from pyspark.sql import functions as F

from headway.catalog.base import query, r6, rounded
from headway.operators import fills as fi, windows as wi
from headway.operators.spans import daily, hourly, rowwise


def order():
    return [F.col("ts"), F.col("obs_id")]


@query("w01_latest_per", "upd", """, r AS (SELECT *, row_number() OVER (PARTITION BY trip_id, stop_sequence ORDER BY feed_time DESC, price DESC, stop_id DESC) AS rn FROM upd)
SELECT trip_id, stop_sequence, feed_time, price, delay FROM r WHERE rn = 1""")
def _(t):
    d = wi.latest_per(t.upd, ["trip_id", "stop_sequence"], [F.desc("feed_time"), F.desc("price"), F.desc("stop_id")])
    return d.select("trip_id", "stop_sequence", "feed_time", "price", "delay")


@query("w02_distinct_on", "obs", ", r AS (SELECT *, row_number() OVER (PARTITION BY stop_id, route_id ORDER BY ts DESC, obs_id DESC) AS rn FROM obs) SELECT stop_id, route_id, obs_id, delay FROM r WHERE rn = 1")
def _(t):
    return wi.latest_per(t.obs, ["stop_id", "route_id"], [F.desc("ts"), F.desc("obs_id")]).select("stop_id", "route_id", "obs_id", "delay")


@query("w03_travel_seconds", "obs", "SELECT obs_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY route_id, stop_id ORDER BY ts, obs_id))) / 1000000e0 AS travel_time_raw_seconds FROM obs")
def _(t):
    return wi.travel_seconds(t.obs, ["route_id", "stop_id"], order(), daily("ts"), "ts").select("obs_id", "travel_time_raw_seconds")


@query("w04_lag_n", "upd", """, c AS (SELECT trip_id, stop_sequence, feed_time, price, delay FROM upd) SELECT *, lag(delay, 1) OVER w AS prev_stop_delay, lag(delay, 2) OVER w AS prev_2_stop_delay
FROM c WINDOW w AS (PARTITION BY trip_id ORDER BY stop_sequence, feed_time, price)""")
def _(t):
    d = t.upd.select("trip_id", "stop_sequence", "feed_time", "price", "delay")
    keys = [F.col("stop_sequence"), F.col("feed_time"), F.col("price")]
    return wi.lag_n(d, ["trip_id"], keys, None, "delay", [1, 2], ["prev_stop_delay", "prev_2_stop_delay"])


TREND = "SELECT obs_id, round(avg(delay) OVER (PARTITION BY route_id, direction_id ORDER BY ts RANGE BETWEEN INTERVAL 60 MINUTE PRECEDING AND INTERVAL 1 MINUTE PRECEDING) + 1e-9, 6) AS trend FROM obs"


@query("w05_range_trend", "obs", TREND)
def _(t):
    return rounded(wi.range_trend(t.obs, ["route_id", "direction_id"], "ts", "delay").select("obs_id", "trend"), "trend")


@query("w06_rows_mean", "obs", "SELECT obs_id, round(avg(delay) OVER (PARTITION BY route_id, direction_id, hour_of_day ORDER BY ts, obs_id ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING) + 1e-9, 6) AS rows_mean FROM obs")
def _(t):
    d = wi.rows_mean(t.obs, ["route_id", "direction_id", "hour_of_day"], order(), daily("ts"), "delay")
    return rounded(d.select("obs_id", "rows_mean"), "rows_mean")


@query("w07_rows_std", "obs", "SELECT obs_id, round(stddev_samp(delay) OVER (PARTITION BY route_id, direction_id ORDER BY ts, obs_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) + 1e-9, 4) AS rows_std FROM obs")
def _(t):
    d = wi.rows_std(t.obs, ["route_id", "direction_id"], order(), hourly("ts"), "delay")
    return d.select("obs_id", F.round(F.col("rows_std") + 1e-9, 4).alias("rows_std"))


@query("w08_rows_mean_trip_hour", "obs", "SELECT obs_id, round(avg(delay) OVER (PARTITION BY stop_id, hour_of_day ORDER BY ts, obs_id ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING) + 1e-9, 6) AS rows_mean FROM obs")
def _(t):
    d = wi.rows_mean(t.obs, ["stop_id", "hour_of_day"], order(), daily("ts"), "delay", rows=500)
    return rounded(d.select("obs_id", "rows_mean"), "rows_mean")


@query("w09_deviation", "wx", "SELECT hour, round(temperature - avg(temperature) OVER (ORDER BY hour ROWS BETWEEN 168 PRECEDING AND CURRENT ROW) + 1e-9, 6) AS temperature_deviation FROM wx")
def _(t):
    return rounded(wi.deviation(t.wx, [F.col("hour")], daily("hour"), "temperature").select("hour", "temperature_deviation"), "temperature_deviation")


@query("w10_change", "wx", "SELECT hour, round(temperature - coalesce(lag(temperature) OVER (ORDER BY hour), temperature) + 1e-9, 6) AS temperature_change FROM wx")
def _(t):
    return rounded(wi.change(t.wx, [F.col("hour")], daily("hour"), "temperature").select("hour", "temperature_change"), "temperature_change")


TRIP_MEANS = ", m AS (SELECT trip_id, stop_sequence % 3 AS grp, avg(delay) AS x, min(feed_time) AS t FROM upd GROUP BY 1, 2)"


def trip_means(t):
    return t.upd.groupBy("trip_id", (F.col("stop_sequence") % 3).alias("grp")).agg(F.avg("delay").alias("x"), F.min("feed_time").alias("t"))


@query("w11_lags", "upd", TRIP_MEANS + " SELECT trip_id, grp, " + ", ".join(f"round(lag(x, {n}) OVER w + 1e-9, 6) AS lag_{n}" for n in (1, 2, 3, 5)) + " FROM m WINDOW w AS (PARTITION BY grp ORDER BY t, trip_id)")
def _(t):
    names = [f"lag_{n}" for n in (1, 2, 3, 5)]
    d = wi.lag_n(trip_means(t), ["grp"], [F.col("t"), F.col("trip_id")], daily("t"), "x", [1, 2, 3, 5], names)
    return rounded(d.select("trip_id", "grp", *names), *names)


_ROLL = ", ".join(
    f"round(coalesce(avg(x) OVER w{n}, 0) + 1e-9, 6) AS r_mean_{n}, round(coalesce(stddev_samp(x) OVER w{n}, 0) + 1e-9, 4) AS r_std_{n}" for n in (3, 5, 10)
)
_WINS = ", ".join(f"w{n} AS (PARTITION BY grp ORDER BY t, trip_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in (3, 5, 10))


@query("w12_rolling", "upd", TRIP_MEANS + f" SELECT trip_id, grp, {_ROLL} FROM m WINDOW {_WINS}")
def _(t):
    d = wi.rolling(trip_means(t), ["grp"], [F.col("t"), F.col("trip_id")], daily("t"), "x", (3, 5, 10), "r")
    means, stds = [f"r_mean_{n}" for n in (3, 5, 10)], [f"r_std_{n}" for n in (3, 5, 10)]
    d = rounded(d.select("trip_id", "grp", *means, *stds), *means)
    return d.withColumns({s: F.round(F.col(s) + 1e-9, 4) for s in stds})


def _interp(key: str, x: str, ids: str, src: str, order_by: str) -> str:
    part = f"PARTITION BY {key} " if key else ""
    return f""", n AS (SELECT *, row_number() OVER ({part}ORDER BY {order_by}) AS p FROM {src}),
b AS (SELECT *, last_value(CASE WHEN {x} IS NOT NULL THEN p END IGNORE NULLS) OVER up AS pp, last_value({x} IGNORE NULLS) OVER up AS pv,
first_value(CASE WHEN {x} IS NOT NULL THEN p END IGNORE NULLS) OVER dn AS np, first_value({x} IGNORE NULLS) OVER dn AS nv FROM n
WINDOW up AS ({part}ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), dn AS ({part}ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT {ids}, round(CASE WHEN {x} IS NOT NULL THEN {x} WHEN pp IS NOT NULL AND np IS NOT NULL THEN pv + (nv - pv) * (p - pp) / (np - pp) ELSE coalesce(pv, nv) END + 1e-9, 6) AS filled FROM b"""


@query("w13_interpolate", "obs", _interp("stop_id", "gappy", "obs_id", "obs", "ts, obs_id"))
def _(t):
    d = fi.interpolate(t.obs, ["stop_id"], order(), daily("ts"), "gappy")
    return d.select("obs_id", r6("gappy").alias("filled"))


@query("w14_interpolate_series", "wx", _interp("", "visibility", "hour", "wx", "hour"))
def _(t):
    d = fi.interpolate(t.wx, [], [F.col("hour")], daily("hour"), "visibility")
    return d.select("hour", r6("visibility").alias("filled"))


@query("w15_ffill_limit", "obs", "SELECT obs_id, coalesce(gappy, last_value(gappy IGNORE NULLS) OVER (PARTITION BY route_id ORDER BY ts, obs_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)) AS gappy FROM obs")
def _(t):
    return fi.ffill(t.obs, ["route_id"], order(), hourly("ts"), "gappy", 7).select("obs_id", "gappy")


GRID = """, c AS (SELECT route_id, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, avg(delay) AS d FROM obs GROUP BY 1, 2), lim AS (SELECT min(ts) AS lo, max(ts) AS hi FROM c),
st AS (SELECT unnest(generate_series(lo, hi, INTERVAL 15 MINUTE)) AS ts FROM lim), g AS (SELECT r.route_id, st.ts, c.d FROM (SELECT DISTINCT route_id FROM obs) r CROSS JOIN st LEFT JOIN c ON c.route_id = r.route_id AND c.ts = st.ts),
f AS (SELECT route_id, ts, d IS NOT NULL AS observed, coalesce(last_value(d IGNORE NULLS) OVER (PARTITION BY route_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0) AS delay FROM g)"""


def grid(t):
    g = fi.regular_grid(t.obs.select("route_id", "ts", "delay"), ["route_id"], "ts", 900, "delay")
    return fi.ffill(g, ["route_id"], [F.col("ts")], daily("ts"), "delay", 4, 0.0)


@query("w16_grid_fill", "obs", GRID + " SELECT route_id, ts, observed, round(delay + 1e-9, 6) AS delay FROM f")
def _(t):
    return rounded(grid(t).select("route_id", "ts", "observed", "delay"), "delay")


@query("w18_group_bounds", "upd", "SELECT trip_id, stop_sequence, price, min(stop_sequence) OVER (PARTITION BY trip_id) AS stop_sequence_min, max(stop_sequence) OVER (PARTITION BY trip_id) AS stop_sequence_max FROM upd")
def _(t):
    return wi.group_bounds(t.upd, ["trip_id"], "stop_sequence").select("trip_id", "stop_sequence", "price", "stop_sequence_min", "stop_sequence_max")


@query("w19_reversal_flag", "upd", "SELECT trip_id, stop_sequence, price, coalesce(feed_time < lag(feed_time) OVER (PARTITION BY trip_id ORDER BY stop_sequence, price, stop_id), false) AS time_reversal FROM upd")
def _(t):
    d = wi.reversal_flag(t.upd, ["trip_id"], [F.col("stop_sequence"), F.col("price"), F.col("stop_id")], None, "feed_time")
    return d.select("trip_id", "stop_sequence", "price", "time_reversal")


@query("w20_next_value", "obs", "SELECT obs_id, coalesce(lead(stop_id) OVER (PARTITION BY route_id ORDER BY ts, obs_id), -1) AS next_stop FROM obs")
def _(t):
    return wi.next_value(t.obs, ["route_id"], order(), hourly("ts"), "stop_id", "next_stop").select("obs_id", F.coalesce("next_stop", F.lit(-1)).alias("next_stop"))


@query("w21_dedup_keep_last", "upd", ", r AS (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY feed_time DESC, price DESC) AS rn FROM upd) SELECT trip_id, stop_sequence, feed_time, price FROM r WHERE rn = 1")
def _(t):
    return wi.dedup_keep_last(t.upd, ["trip_id"], ["feed_time", "price"]).select("trip_id", "stop_sequence", "feed_time", "price")


@query("w22_last_row", "obs", "SELECT stop_id, arg_max(obs_id, (ts, obs_id)) AS obs_id, arg_max(delay, (ts, obs_id)) AS delay FROM obs GROUP BY 1")
def _(t):
    return wi.last_row(t.obs, ["stop_id"], ["ts", "obs_id"], ["obs_id", "delay"])


@query("w23_order_index", "upd", ", m AS (SELECT trip_id, min(feed_time) AS t FROM upd GROUP BY 1) SELECT trip_id, row_number() OVER (ORDER BY t, trip_id) AS trip_order FROM m")
def _(t):
    m = t.upd.groupBy("trip_id").agg(F.min("feed_time").alias("t"))
    return wi.order_of(m, [], "t", ["trip_id"], daily("t")).select("trip_id", "trip_order")


@query("d03_locf", "obs", "SELECT obs_id, coalesce(gappy, last_value(gappy IGNORE NULLS) OVER (PARTITION BY route_id, direction_id, hour_of_day ORDER BY ts, obs_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS gappy FROM obs")
def _(t):
    return fi.locf(t.obs, ["route_id", "direction_id", "hour_of_day"], order(), daily("ts"), "gappy").select("obs_id", "gappy")


@query("d06_moving_average", "obs", "SELECT obs_id, round(avg(delay) OVER (PARTITION BY stop_id ORDER BY ts, obs_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) + 1e-9, 6) AS moving_average FROM obs")
def _(t):
    return rounded(wi.moving_average(t.obs, ["stop_id"], order(), daily("ts"), "delay", 5).select("obs_id", "moving_average"), "moving_average")


@query("w_window_bundle", "obs", """SELECT obs_id, round(avg(delay) OVER (PARTITION BY route_id ORDER BY ts, obs_id ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) + 1e-9, 6) AS m24,
lag(delay, 3) OVER (PARTITION BY route_id ORDER BY ts, obs_id) AS lag3, lead(delay, 2) OVER (PARTITION BY route_id ORDER BY ts, obs_id) AS lead2, row_number() OVER (PARTITION BY route_id ORDER BY ts, obs_id) AS pos FROM obs""")
def _(t):
    fns = {
        "m24": lambda w: F.avg("delay").over(w.rowsBetween(-24, -1)), "lag3": lambda w: F.lag("delay", 3).over(w),
        "lead2": lambda w: F.lead("delay", 2).over(w),
    }
    d = rowwise(t.obs, ["route_id"], order(), hourly("ts"), fns, back=24, ahead=2, rows=100, keep_pos=True)
    return rounded(d.select("obs_id", "m24", "lag3", "lead2", F.col("_pos").alias("pos")), "m24")
