"""Filters, projections, flags and encodings on the given tables."""

from pyspark.sql import functions as F

from headway.catalog.base import query, r6, rounded
from headway.functions import encode as en, geo
from headway.functions import clock as ck
from headway.operators import distribution as di, filters as fl, windows as wi
from headway.operators.spans import hourly


@query("p01_delay_plausible", "obs", "SELECT obs_id, delay FROM obs WHERE delay BETWEEN -3600 AND 3600 AND ts IS NOT NULL")
def _(t):
    return fl.delay_plausible(t.obs, "delay", "ts").select("obs_id", "delay")


@query("p02_lookback", "obs", "SELECT obs_id, ts FROM obs WHERE ts >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 24 HOUR")
def _(t):
    return fl.lookback(t.obs, "ts", "2024-01-20 12:00:00", "24 hours").select("obs_id", "ts")


@query("p03_route_since", "trips", "SELECT trip_id, route_id, start_date FROM trips WHERE route_id IN (1, 5, 9) AND start_date >= DATE '1997-01-01' AND start_date <= DATE '2000-12-31'")
def _(t):
    d = fl.route_since(t.trips, [1, 5, 9], "1997-01-01", "2000-12-31")
    return d.select("trip_id", "route_id", "start_date")


@query("p04_date_range", "trips", "SELECT trip_id, start_date FROM trips WHERE start_date BETWEEN DATE '1996-02-01' AND DATE '1996-02-29'")
def _(t):
    return fl.date_range(t.trips, "start_date", "1996-02-01", "1996-02-29").select("trip_id", "start_date")


@query("p05_delay_bounds", "obs", "SELECT obs_id, delay FROM obs WHERE delay >= -600 AND delay <= 1800")
def _(t):
    return fl.delay_bounds(t.obs, "delay").select("obs_id", "delay")


CELLS = "cells AS (SELECT trip_id, stop_sequence, min(delay) AS delay FROM upd GROUP BY 1, 2)"


def cells(t):
    return t.upd.groupBy("trip_id", "stop_sequence").agg(F.min("delay").alias("delay"))


@query("p06_upstream_ready", "upd", f""", {CELLS}, w AS (SELECT *, lag(delay) OVER (PARTITION BY trip_id ORDER BY stop_sequence) AS prev FROM cells)
SELECT * FROM w WHERE stop_sequence >= 6 AND prev IS NOT NULL""")
def _(t):
    d = wi.lag_n(cells(t), ["trip_id"], [F.col("stop_sequence")], [F.floor(F.col("stop_sequence") / 1000)], "delay", [1], ["prev"])
    return fl.upstream_ready(d, "stop_sequence", "prev")


TRAVEL = """, w AS (SELECT obs_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY stop_id ORDER BY ts, obs_id))) / 1000000e0 AS raw FROM obs),
v AS (SELECT *, CASE WHEN raw BETWEEN 10 AND 36000 THEN raw END AS travel_time_duration FROM w)"""


@query("p07_valid_travel_time", "obs", TRAVEL + " SELECT obs_id, raw, travel_time_duration FROM v WHERE travel_time_duration IS NOT NULL OR raw IS NULL")
def _(t):
    d = wi.travel_seconds(t.obs, ["stop_id"], [F.col("ts"), F.col("obs_id")], hourly("ts"), "ts", "raw")
    return fl.valid_travel_time(d, "raw", 10, 36000).select("obs_id", "raw", "travel_time_duration")


@query("p08_drop_null", "obs", "SELECT obs_id, gappy FROM obs WHERE gappy IS NOT NULL AND delay IS NOT NULL")
def _(t):
    return fl.drop_null(t.obs, ["gappy", "delay"]).select("obs_id", "gappy")


@query("p09_drop_existing", "", "SELECT user_id, event_type, value FROM events")
def _(t):
    return fl.drop_existing(t.raw("events"), ["props", "wind_gust", "ts", "event_id"])


@query("p10_sky_onehot", "wx", """SELECT hour, CASE WHEN cloud <= 2 THEN 1 ELSE 0 END AS weather_sunny,
CASE WHEN cloud > 2 AND cloud <= 6 THEN 1 ELSE 0 END AS weather_cloudy, CASE WHEN cloud > 6 THEN 1 ELSE 0 END AS weather_rainy FROM wx""")
def _(t):
    return t.wx.select("hour", *[v.alias(n) for n, v in en.sky_onehot("cloud").items()])


@query("p11_precip_estimate", "wx", """SELECT hour, CAST(CASE WHEN humidity > 90 AND cloud > 6 THEN 2.0 WHEN humidity > 80 AND cloud > 4 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS precipitation FROM wx""")
def _(t):
    return t.wx.select("hour", en.precip_estimate("humidity", "cloud").alias("precipitation"))


_PARTS = ",\n".join(
    f"CASE WHEN hour_of_day BETWEEN {a} AND {b} THEN 1 ELSE 0 END AS {n}" for n, (a, b) in en.DAY_PARTS.items()
)


@query("p12_daypart_onehot", "obs", f"""SELECT obs_id, {_PARTS},
CASE WHEN isodow <= 5 AND hour_of_day IN (8, 15, 16) THEN 1 ELSE 0 END AS school_commute_hour,
CASE WHEN isodow IN (6, 7) THEN 1 ELSE 0 END AS is_weekend, CAST(day(ts) AS INTEGER) AS day_of_month FROM obs""")
def _(t):
    return t.obs.select("obs_id", *[v.alias(n) for n, v in en.daypart_onehot("hour_of_day", "isodow", "ts").items()])


@query("p13_rush_type", "obs", "SELECT obs_id, CASE WHEN hour_of_day BETWEEN 7 AND 9 THEN 1 WHEN hour_of_day BETWEEN 17 AND 19 THEN 2 ELSE 0 END AS rush FROM obs")
def _(t):
    return t.obs.select("obs_id", en.rush_type("hour_of_day").alias("rush"))


@query("p14_peak_weekend_flags", "obs", "SELECT obs_id, CASE WHEN hour_of_day IN (7, 8, 17, 18) THEN 1 ELSE 0 END AS peak, CASE WHEN isodow >= 6 THEN 1 ELSE 0 END AS weekend FROM obs")
def _(t):
    return t.obs.select("obs_id", en.peak_flag("hour_of_day").alias("peak"), en.weekend_flag("isodow").alias("weekend"))


KM = """6371 * acos(least(1e0, greatest(-1e0, sin(radians(49.2827e0)) * sin(radians(stop_lat))
 + cos(radians(49.2827e0)) * cos(radians(stop_lat)) * cos(radians(stop_lon + 123.1207e0)))))"""


@query("p15_density_score", "stops", f""", s AS (SELECT *, {KM} AS km, s_nationkey AS n FROM stops JOIN supplier ON s_suppkey = stop_id)
SELECT stop_id, CASE WHEN n IN (0, 1, 2) AND km <= 20 THEN 5 WHEN n IN (0, 1, 2, 3, 4, 5, 6) THEN 4 WHEN n IN (7, 8, 9, 10) THEN 3
WHEN n IN (11, 12, 13) THEN 2 WHEN n IN (14, 15) THEN 1 ELSE 0 END AS score FROM s""")
def _(t):
    s = t.stops.join(t.raw("supplier"), F.col("s_suppkey") == F.col("stop_id"))
    classes = {4: (0, 1, 2, 3, 4, 5, 6), 3: (7, 8, 9, 10), 2: (11, 12, 13), 1: (14, 15)}
    score = geo.density_score("s_nationkey", geo.distance_km("stop_lat", "stop_lon"), 20, (0, 1, 2), classes)
    return s.select("stop_id", score.alias("score"))


@query("p16_anomaly_flags", "obs", """, w AS (SELECT *, coalesce(ts < lag(ts) OVER (PARTITION BY stop_id ORDER BY obs_id), false) AS time_reversal FROM obs)
SELECT obs_id, (delay < -900 OR delay > 1800) AS is_anomaly, time_reversal, (delay < -900 OR delay > 1800 OR time_reversal) AS should_exclude FROM w""")
def _(t):
    d = wi.reversal_flag(t.obs, ["stop_id"], [F.col("obs_id")], [F.floor(F.col("obs_id") / 50_000)], "ts", "back")
    return fl.anomaly_flags(d, "delay", F.col("back")).select("obs_id", "is_anomaly", "time_reversal", "should_exclude")


@query("p17_graduated_filter", "obs", """, a AS (SELECT * FROM obs WHERE NOT (delay < -900 OR delay > 1800)), s AS (SELECT avg(delay) AS m, stddev_samp(delay) AS sd FROM a)
SELECT obs_id, delay FROM a, s WHERE abs((delay - m) / sd) <= 2""")
def _(t):
    flagged = fl.anomaly_flags(t.obs, "delay", F.lit(False))
    return fl.graduated_filter(flagged, "delay", 2)[1].select("obs_id", "delay")


@query("p18_asymmetric_anomaly", "obs", """, h AS (SELECT obs_id, delay, hour_of_day IN (7,8,9,17,18,19) AS rush, hour_of_day IN (22,23,0,1,2,3,4,5) AS night FROM obs),
b AS (SELECT *, CASE WHEN rush THEN 1350e0 WHEN night THEN 720e0 ELSE 900e0 END AS late, CASE WHEN night THEN 240e0 ELSE 300e0 END AS early FROM h),
l AS (SELECT obs_id, delay < -120 AS is_minor_early, delay < -early AS is_major_early, delay < -600 AS is_severe_early,
delay > 300 AS is_minor_delay, delay > late AS is_major_delay, delay > 1800 AS is_severe_delay FROM b)
SELECT *, CASE WHEN is_severe_early OR is_severe_delay THEN 3 WHEN is_major_early OR is_major_delay THEN 2 WHEN is_minor_early OR is_minor_delay THEN 1 ELSE 0 END AS anomaly_level,
(is_severe_early OR is_severe_delay OR is_major_early OR is_major_delay) AS should_exclude FROM l""")
def _(t):
    d = fl.asymmetric_anomaly(t.obs, "delay", "hour_of_day")
    return d.select("obs_id", "is_minor_early", "is_major_early", "is_severe_early", "is_minor_delay", "is_major_delay",
                    "is_severe_delay", "anomaly_level", "should_exclude")


@query("p19_mad_filter", "obs", """, m AS (SELECT median(delay) AS mid FROM obs), d AS (SELECT median(abs(delay - mid)) AS mad FROM obs, m)
SELECT obs_id, delay FROM obs, m, d WHERE abs(delay - mid) <= 2 * mad""")
def _(t):
    return di.mad_filter(t.obs, "delay", 2).select("obs_id", "delay")


@query("p20_cast_all", "upd", "SELECT CAST(trip_id AS VARCHAR) AS trip_id, CAST(stop_sequence AS BIGINT) AS stop_sequence, CAST(delay AS INTEGER) AS delay FROM upd")
def _(t):
    return fl.cast_all(t.upd.select("trip_id", "stop_sequence", "delay"), {"trip_id": "string", "stop_sequence": "bigint", "delay": "int"})


@query("p21_select_available", "obs", "SELECT obs_id, delay FROM obs")
def _(t):
    return fl.select_available(t.obs, ["obs_id", "humidex", "delay", "region_id"])[0]


@query("p22_feature_layout", "obs", "SELECT obs_id, round(delay + hour_of_day * 2 + isodow * 3 + 1e-9, 6) AS checksum, 3 AS width FROM obs")
def _(t):
    groups = {"target": ["delay"], "time": ["hour_of_day", "isodow", "absent"], "again": ["delay", "hour_of_day"]}
    cols, info = fl.layout(groups, t.obs.columns)
    v = F.array(*[F.col(x).cast("double") for x in cols])
    total = F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return t.obs.select("obs_id", v.alias("v")).select("obs_id", r6(total).alias("checksum"), F.size("v").alias("width"))


@query("p23_default_features", "obs", "SELECT obs_id, delay AS arrival_delay, isodow AS day_of_week, sin(hour_of_day * 2 * pi() / 24) IS NOT NULL AS known FROM obs")
def _(t):
    d = t.obs.select("obs_id", F.col("delay").alias("arrival_delay"), F.col("isodow").alias("day_of_week"), en.cyclic("hour_of_day", 24)[0].alias("hour_sin"))
    got, _missing = fl.select_available(d, ["obs_id", *fl.default_features(d.columns)])
    return got.withColumn("known", F.col("hour_sin").isNotNull()).drop("hour_sin")


@query("p24_finite_only", "upd", "SELECT trip_id, stop_sequence, stop_id, price, CASE WHEN delay = 0 THEN NULL ELSE pred / delay END AS ratio FROM upd WHERE delay <> 0")
def _(t):
    ratio = F.when(F.col("delay") == 0, F.lit(float("nan"))).otherwise(F.col("pred") / F.nullif(F.col("delay"), F.lit(0.0)))
    return fl.finite_only(t.upd.withColumn("ratio", ratio), ["ratio"]).select("trip_id", "stop_sequence", "stop_id", "price", "ratio")


@query("p25_exclude", "obs", "SELECT obs_id, route_id FROM obs WHERE route_id NOT IN ('error', 'view') AND stop_id NOT IN (SELECT user_id FROM events WHERE value > 200)")
def _(t):
    some = t.raw("events").where("value > 200").select(F.col("user_id").alias("stop_id"))
    return fl.exclude(fl.exclude(t.obs, "route_id", ["error", "view"]), "stop_id", some).select("obs_id", "route_id")


@query("d01_drop_sparse_columns", "obs", "SELECT obs_id, delay FROM obs")
def _(t):
    d = t.obs.select("obs_id", "delay", F.when(F.col("delay") > 2000, F.col("delay")).alias("rare"))
    return fl.drop_sparse_columns(d, 0.5)


@query("d02_outlier_iqr", "obs", """, q AS (SELECT quantile_cont(delay, 0.25) AS q1, quantile_cont(delay, 0.75) AS q3 FROM obs)
SELECT obs_id, delay FROM obs, q WHERE delay BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""")
def _(t):
    return di.outlier_filter(t.obs, "delay", "iqr").select("obs_id", "delay")


@query("d02_outlier_zscore", "obs", """, s AS (SELECT avg(delay) AS m, stddev_samp(delay) AS sd FROM obs)
SELECT obs_id, delay FROM obs, s WHERE abs((delay - m) / sd) <= 3""")
def _(t):
    return di.outlier_filter(t.obs, "delay", "zscore").select("obs_id", "delay")


@query("c02_humidex", "wx", "SELECT hour, round(temperature + 0.5555 * (6.11 * exp(5417.753 * (1/273.15e0 - 1/(dew_point + 273.15e0))) - 10), 2) AS humidex FROM wx")
def _(t):
    return t.wx.select("hour", en.humidex("temperature", "dew_point").alias("humidex"))


@query("c03_cyclic", "obs", """SELECT obs_id, round(sin(2 * pi() * hour_of_day / 24) + 1e-9, 6) AS hour_sin, round(cos(2 * pi() * hour_of_day / 24) + 1e-9, 6) AS hour_cos,
round(sin(2 * pi() * isodow / 7) + 1e-9, 6) AS day_sin, round(cos(2 * pi() * isodow / 7) + 1e-9, 6) AS day_cos FROM obs""")
def _(t):
    (hs, hc), (ds, dc) = en.cyclic("hour_of_day", 24), en.cyclic("isodow", 7)
    return t.obs.select("obs_id", r6(hs).alias("hour_sin"), r6(hc).alias("hour_cos"), r6(ds).alias("day_sin"), r6(dc).alias("day_cos"))


@query("c04_angle_from", "stops", "SELECT stop_id, round(stop_lat + 1e-9, 6) AS lat, round(stop_lon + 1e-9, 6) AS lon FROM stops")
def _(t):
    def back(x):
        a = F.radians(x)
        return r6(en.angle_from(F.sin(a), F.cos(a)))

    return t.stops.select("stop_id", back("stop_lat").alias("lat"), back("stop_lon").alias("lon"))


@query("c05_distance_km", "cstops", f"SELECT stop_id, round({KM} + 1e-9, 2) AS km, round(stop_lat - 49.2827e0 + 1e-9, 6) AS lat_relative FROM cstops")
def _(t):
    return t.cstops.select("stop_id", F.round(geo.distance_km("stop_lat", "stop_lon") + 1e-9, 2).alias("km"), r6(F.col("stop_lat") - 49.2827).alias("lat_relative"))


def _case(edges, labels):
    return "CASE " + " ".join(f"WHEN hour_of_day >= {a} AND hour_of_day < {b} THEN '{n}'" for a, b, n in zip(edges, edges[1:], labels)) + " END"


@query("c07_bin_label", "obs", f"SELECT obs_id, {_case(*en.PERIODS_DETAILED)} AS detailed, {_case(*en.PERIODS_STORE)} AS store FROM obs")
def _(t):
    return t.obs.select("obs_id", en.bin_label("hour_of_day", *en.PERIODS_DETAILED).alias("detailed"), en.bin_label("hour_of_day", *en.PERIODS_STORE).alias("store"))


@query("c12_composite_key", "trips", "SELECT trip_id, strftime(start_date, '%Y%m%d') || '_' || route_id || '_' || direction_id || '_' || trip_id AS trip_key, CAST(route_id AS VARCHAR) AS route_part FROM trips")
def _(t):
    k = t.trips.withColumn("trip_key", en.key(F.date_format("start_date", "yyyyMMdd"), "route_id", "direction_id", "trip_id"))
    return k.select("trip_id", "trip_key", en.key_part("trip_key", 1).alias("route_part"))


@query("c16_week_key", "obs", "SELECT obs_id, CAST(date_trunc('week', (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Vancouver') AS DATE) AS week FROM obs")
def _(t):
    return t.obs.select("obs_id", ck.week_key("ts").alias("week"))


@query("c17_time_features", "obs", f"""SELECT obs_id, hour_of_day, {_case(*en.PERIODS_DETAILED)} AS time_period_detailed, CASE WHEN hour_of_day IN (7,8,17,18) THEN 1 ELSE 0 END AS is_peak_hour,
CASE WHEN isodow >= 6 THEN 1 ELSE 0 END AS is_weekend, round(cos(2 * pi() * isodow / 7) + 1e-9, 6) AS day_cos FROM obs""")
def _(t):
    from headway.plans.training import time_features

    d = time_features(t.obs, "ts", "isodow")
    return rounded(d.select("obs_id", "hour_of_day", "time_period_detailed", "is_peak_hour", "is_weekend", "day_cos"), "day_cos")


@query("f01_stop_actual_time", "upd", """SELECT DISTINCT trip_id, stop_sequence, feed_time,
CAST((feed_time + to_seconds(stop_sequence * 3600 + 1800) + INTERVAL 1 DAY) AT TIME ZONE 'America/Vancouver' AT TIME ZONE 'UTC' AS TIMESTAMP) AS actual FROM upd""")
def _(t):
    d = t.upd.select("trip_id", "stop_sequence", "feed_time").distinct()
    return d.withColumn("actual", ck.stop_actual_time(F.to_date("feed_time"), F.col("stop_sequence") * 3600 + 1800, F.lit(1)))


@query("f02_actual_arrival_time", "upd", """SELECT DISTINCT trip_id, stop_sequence, feed_time,
CAST((feed_time + to_seconds(stop_sequence * 600)) AT TIME ZONE 'UTC' AT TIME ZONE 'UTC' AS TIMESTAMP) AS actual FROM upd""")
def _(t):
    d = t.upd.select("trip_id", "stop_sequence", "feed_time").distinct()
    row = F.struct((F.col("stop_sequence") * 600).alias("arrival_secs"), F.lit(0).alias("arrival_day_offset"))
    return d.withColumn("st", row).select("trip_id", "stop_sequence", "feed_time", ck.actual_arrival_time(F.to_date("feed_time"), "st", "UTC").alias("actual"))


@query("f06_date_parts", "trips", """SELECT trip_id, CAST(dayofweek(start_date) AS INTEGER) AS dow, CAST(isodow(start_date) AS INTEGER) AS isodow, rpad(dayname(start_date), 9, ' ') AS day_name FROM trips""")
def _(t):
    return t.trips.select("trip_id", ck.dow("start_date").alias("dow"), ck.isodow("start_date").alias("isodow"), ck.padded_day_name("start_date").alias("day_name"))
