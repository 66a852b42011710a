"""Aggregations and reports on the given tables."""

from pyspark.sql import functions as F

from headway.catalog.base import query, r6, rounded
from headway.catalog.joining import ALERTS, alert_tables
from headway.operators import aggregates as ag, distribution as di, joins as jo, metrics as me, windows as wi


@query("a01_group_mean_having", "obs", "SELECT route_id, direction_id, hour_of_day, round(avg(delay) + 1e-9, 6) AS mean, count(*) AS n FROM obs GROUP BY 1, 2, 3 HAVING count(*) >= 40")
def _(t):
    return rounded(ag.group_mean_having(t.obs, ["route_id", "direction_id", "hour_of_day"], "delay", 40), "mean")


@query("a02_route_hour_stats", "obs", "SELECT route_id, direction_id, hour_of_day, round(avg(delay) + 1e-9, 6) AS delay_mean_by_route_hour, round(avg(gappy) + 1e-9, 6) AS travel_mean_by_route_hour FROM obs GROUP BY 1, 2, 3")
def _(t):
    return rounded(ag.route_hour_stats(t.obs, "delay", "gappy", 9), "delay_mean_by_route_hour", "travel_mean_by_route_hour")


@query("a03_hourly_delay", "obs", """SELECT route_id, date_trunc('hour', ts) AS bucket, round(avg(delay) + 1e-9, 6) AS delay, arg_min(stop_id, obs_id) AS stop_id, count(*) AS observation_count
FROM obs GROUP BY 1, 2 HAVING count(*) >= 2""")
def _(t):
    d = t.obs.withColumn("bucket", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return rounded(ag.hourly_delay(d, ["route_id", "bucket"], ["delay"], ["stop_id"], ["obs_id"]), "delay")


@query("a04_weather_bucket", "wx", "SELECT date_trunc('day', hour) AS day, round(avg(temperature) + 1e-9, 6) AS temperature, round(avg(cloud) + 1e-9, 6) AS cloud FROM wx GROUP BY 1")
def _(t):
    d = t.wx.withColumn("day", F.date_trunc("day", "hour").cast("timestamp_ntz"))
    return rounded(ag.weather_bucket(d, "day", ["temperature", "cloud"]), "temperature", "cloud")


@query("a05_bucket_mean", "obs", "SELECT route_id, time_bucket(INTERVAL 10 MINUTE, ts) AS bucket, round(avg(delay) + 1e-9, 6) AS delay, round(avg(gappy) + 1e-9, 6) AS gappy FROM obs GROUP BY 1, 2")
def _(t):
    return rounded(ag.bucket_mean(t.obs, "route_id", "ts", 600, ["delay", "gappy"], 9), "delay", "gappy")


@query("a06_alert_features", "", f"""WITH {ALERTS}, n AS (SELECT *, TRY_CAST(cause AS INTEGER) AS c, TRY_CAST(effect AS INTEGER) AS e FROM al)
SELECT route_id, date_trunc('hour', ts) AS alert_hour, 1 AS has_active_alert, count(DISTINCT alert_id) FILTER (WHERE e IN (1, 4)) AS high_impact_alert_count,
count(DISTINCT alert_id) FILTER (WHERE c = 10) AS alert_police_activity, count(DISTINCT alert_id) FILTER (WHERE c = 9) AS alert_construction,
count(DISTINCT alert_id) FILTER (WHERE c = 2) AS alert_technical_problem, count(DISTINCT alert_id) FILTER (WHERE e = 1) AS alert_effect_no_service,
count(DISTINCT alert_id) FILTER (WHERE e = 4) AS alert_effect_detour,
CAST(sum(CASE e WHEN 1 THEN 10 WHEN 3 THEN 8 WHEN 4 THEN 7 WHEN 6 THEN 5 WHEN 9 THEN 4 WHEN 2 THEN 3 ELSE 1 END) AS BIGINT) AS alert_severity_score FROM n GROUP BY 1, 2""")
def _(t):
    a = alert_tables(t)
    return ag.alert_features(jo.alert_detail(a["alerts"], a["alert_informed_entities"], a["alert_active_periods"], a["alert_text"]))


@query("a07_min_max_per", "upd", "SELECT trip_id, min(feed_time) AS min_feed_time, max(feed_time) AS max_feed_time FROM upd GROUP BY 1")
def _(t):
    return ag.min_max_per(t.upd, "trip_id", "feed_time")


LOCATED = ", l AS (SELECT u.*, s.stop_lat, n.n_name AS region_id FROM upd u JOIN stops s USING (stop_id) JOIN supplier ON s_suppkey = stop_id JOIN nation n ON n_nationkey = s_nationkey)"


def located(t):
    return (
        t.upd.join(t.stops, "stop_id").join(t.raw("supplier").withColumnRenamed("s_suppkey", "stop_id").select("stop_id", "s_nationkey"), "stop_id")
        .join(t.raw("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("region_id")), "s_nationkey")
    )


@query("a08_region_status", "upd stops", LOCATED + " SELECT region_id, round(min(stop_lat) + 1e-9, 6) AS min_lat, round(max(stop_lat) + 1e-9, 6) AS max_lat, round(avg(delay) + 1e-9, 6) AS avg_delay_seconds FROM l GROUP BY 1")
def _(t):
    return rounded(ag.region_status(located(t), delay="delay"), "min_lat", "max_lat", "avg_delay_seconds")


@query("a09_mean_per", "upd", "SELECT stop_id, status, round(avg(delay) + 1e-9, 6) AS avg_delay FROM upd GROUP BY 1, 2")
def _(t):
    return rounded(ag.mean_per(t.upd, ["stop_id", "status"], "delay"), "avg_delay")


@query("a10_min_per", "upd", "SELECT stop_id, flag, min(feed_time) AS feed_time, min(price) AS price FROM upd WHERE feed_time >= TIMESTAMP '1998-01-01' GROUP BY 1, 2")
def _(t):
    return ag.min_per(t.upd.where("feed_time >= '1998-01-01'"), ["stop_id", "flag"], ["feed_time", "price"])


TU = ", r AS (SELECT u.*, t.route_id, t.start_date, t.headsign, u.delay AS arrival_delay FROM upd u JOIN trips t USING (trip_id))"


def trip_rows(t):
    return t.upd.join(t.trips, "trip_id").withColumn("arrival_delay", F.col("delay"))


@query("a11_route_summary", "upd trips", TU + """ SELECT route_id, count(*) AS total_records, count(DISTINCT start_date) AS unique_dates, count(DISTINCT trip_id) AS unique_trips, count(DISTINCT stop_id) AS unique_stops,
min(start_date) AS earliest_date, max(start_date) AS latest_date, round(avg(delay) + 1e-9, 6) AS avg_delay, round(stddev_samp(delay) + 1e-9, 6) AS stddev_delay,
count(*) FILTER (WHERE delay > 300) AS late_records, count(*) FILTER (WHERE delay < -300) AS early_records FROM r GROUP BY 1""")
def _(t):
    return rounded(ag.route_summary(trip_rows(t)), "avg_delay", "stddev_delay")


@query("a12_available_routes", "upd trips", TU + """ SELECT route_id, headsign AS route_short_name, count(*) AS record_count, count(DISTINCT start_date) AS date_count, min(start_date) AS earliest_date, max(start_date) AS latest_date
FROM r WHERE start_date >= DATE '1996-01-01' GROUP BY 1, 2 HAVING count(*) >= 20""")
def _(t):
    return ag.available_routes(trip_rows(t).withColumnRenamed("headsign", "route_short_name"), "1996-01-01", 20)


@query("a13_date_coverage", "upd trips", TU + " SELECT start_date, count(*) AS record_count, count(DISTINCT trip_id) AS trip_count, round(avg(delay) + 1e-9, 6) AS avg_delay FROM r GROUP BY 1 ORDER BY 1 DESC LIMIT 30")
def _(t):
    return rounded(ag.date_coverage(trip_rows(t)), "avg_delay")


@query("a14_distinct_array", "trips", "SELECT route_id, array_to_string(list_sort(list(DISTINCT headsign)), '|') AS headsigns, CAST(count(DISTINCT direction_id) AS INTEGER) AS n_dir FROM trips GROUP BY 1")
def _(t):
    d = ag.distinct_array(t.trips, "route_id", ["headsign", "direction_id"])
    return d.select("route_id", F.array_join("headsign", "|").alias("headsigns"), F.size("direction_id").alias("n_dir"))


@query("a15_missing_summary", "obs wx", """SELECT 'gappy' AS "column", count(*) FILTER (WHERE gappy IS NULL) AS missing_count, round(avg(CASE WHEN gappy IS NULL THEN 1e0 ELSE 0e0 END) * 100, 1) AS missing_percentage FROM obs
UNION ALL SELECT 'delay', count(*) FILTER (WHERE delay IS NULL), round(avg(CASE WHEN delay IS NULL THEN 1e0 ELSE 0e0 END) * 100, 1) FROM obs""")
def _(t):
    return ag.missing_summary(t.obs, ["gappy", "delay"])


@query("a16_null_counts_per", "obs", "SELECT stop_id, count(*) AS n_rows, count(*) FILTER (WHERE gappy IS NULL) AS null_gappy, count(*) FILTER (WHERE k IS NULL) AS null_k FROM obs GROUP BY 1")
def _(t):
    return ag.null_counts_per(t.obs, "stop_id", ["gappy", "k"])


@query("a16_all_null_keys", "obs", "SELECT hour_of_day * 1000 + stop_id AS cell FROM obs GROUP BY 1 HAVING count(gappy) = 0")
def _(t):
    return ag.all_null_keys(t.obs.withColumn("cell", F.col("hour_of_day") * 1000 + F.col("stop_id")), "cell", "gappy")


@query("a16_jointly_missing", "wx", "SELECT count(*) FILTER (WHERE visibility IS NULL AND CASE WHEN cloud > 3 THEN cloud END IS NULL) AS n FROM wx")
def _(t):
    return ag.jointly_missing(t.wx.withColumn("c", F.when(F.col("cloud") > 3, F.col("cloud"))), ["visibility", "c"])


def _desc(x):
    return f"""SELECT '{x}' AS "column", count({x}) AS count, round(avg({x}) + 1e-9, 6) AS mean, round(stddev_samp({x}) + 1e-9, 6) AS std, min({x}) AS min, max({x}) AS max,
round(quantile_cont({x}, 0.25) + 1e-9, 6) AS p25, round(quantile_cont({x}, 0.5) + 1e-9, 6) AS p50, round(quantile_cont({x}, 0.75) + 1e-9, 6) AS p75 FROM upd"""


@query("a17_describe", "upd", _desc("delay") + " UNION ALL " + _desc("pred"))
def _(t):
    return rounded(di.describe_exact(t.upd, ["delay", "pred"]), "mean", "std", "p25", "p50", "p75")


@query("a18_extremes_per", "upd", 'SELECT trip_id, stop_sequence, min(delay) AS "min", max(delay) AS "max", min(abs(delay)) AS abs_min FROM upd GROUP BY 1, 2')
def _(t):
    return ag.extremes_per(t.upd, ["trip_id", "stop_sequence"], "delay")


@query("a19_mean_by", "obs", "SELECT hour_of_day, round(avg(delay) + 1e-9, 6) AS mean, count(*) AS n FROM obs GROUP BY 1")
def _(t):
    return rounded(ag.mean_by(t.obs, "hour_of_day", "delay"), "mean")


@query("a20_pivot_mean", "obs", "SELECT hour_of_day, " + ", ".join(f"round(avg(delay) FILTER (WHERE isodow = {i}) + 1e-9, 6) AS d{i}" for i in range(1, 8)) + " FROM obs GROUP BY 1")
def _(t):
    d = ag.pivot_mean(t.obs, "hour_of_day", "isodow", range(1, 8), "delay")
    return d.select("hour_of_day", *[r6(str(i)).alias(f"d{i}") for i in range(1, 8)])


@query("a21_with_without", "upd", """, g AS (SELECT trip_id, avg(delay) FILTER (WHERE flag = 'R') AS a, avg(delay) FILTER (WHERE flag <> 'R') AS b FROM upd GROUP BY 1)
SELECT trip_id, round(a + 1e-9, 6) AS with_flag, round(b + 1e-9, 6) AS without_flag, round(a - b + 1e-9, 6) AS difference FROM g WHERE a IS NOT NULL AND b IS NOT NULL""")
def _(t):
    d = t.upd.withColumn("on", (F.col("flag") == "R").cast("int"))
    return rounded(ag.with_without(d, ["trip_id"], "on", "delay"), "with_flag", "without_flag", "difference")


@query("a22_completeness", "upd", """, e AS (SELECT trip_id, count(DISTINCT stop_sequence) AS expected FROM upd GROUP BY 1), o AS (SELECT trip_id, count(DISTINCT stop_sequence) AS observed FROM upd WHERE delay > 0 GROUP BY 1)
SELECT trip_id, expected, coalesce(observed, 0) AS observed, round(coalesce(observed, 0) / expected + 1e-9, 6) AS ratio FROM e LEFT JOIN o USING (trip_id)""")
def _(t):
    return rounded(ag.completeness(t.upd.where("delay > 0"), t.upd, ["trip_id"], "stop_sequence"), "ratio")


@query("a23_count_matrix", "upd", "SELECT stop_id, stop_sequence, count(*) AS n, least(count(*), 80) AS shown FROM upd GROUP BY 1, 2")
def _(t):
    return ag.count_matrix(t.upd, "stop_id", "stop_sequence", 80)


STOP_TYPE = """, c AS (SELECT trip_id, stop_sequence, max(delay) AS mx, min(delay) AS mn, arg_min(delay, (feed_time, price)) AS f FROM upd GROUP BY 1, 2),
b AS (SELECT *, min(stop_sequence) OVER (PARTITION BY trip_id) AS lo, max(stop_sequence) OVER (PARTITION BY trip_id) AS hi FROM c),
s AS (SELECT trip_id, stop_sequence, CASE WHEN stop_sequence = hi THEN 'last' WHEN stop_sequence = lo THEN 'first' ELSE 'middle' END AS stop_type,
CASE WHEN stop_sequence = hi THEN mn WHEN stop_sequence = lo THEN mx ELSE f END AS arrival_delay_agg FROM b)"""


@query("a24_stop_type_agg", "upd", STOP_TYPE + " SELECT * FROM s")
def _(t):
    d = ag.stop_type_agg(t.upd, ["trip_id"], "stop_sequence", "delay", "feed_time", ["price"])
    return d.select("trip_id", "stop_sequence", "stop_type", "arrival_delay_agg")


@query("a25_sequence_gaps", "upd", """, n AS (SELECT trip_id, min(stop_sequence) AS lo, max(stop_sequence) AS hi FROM upd GROUP BY 1), e AS (SELECT trip_id, CAST(unnest(range(lo, hi + 1)) AS INTEGER) AS missing_seq FROM n)
SELECT * FROM e WHERE (trip_id, missing_seq) NOT IN (SELECT trip_id, stop_sequence FROM upd)""")
def _(t):
    return ag.sequence_gaps(t.upd, ["trip_id"], "stop_sequence")


@query("a25_gap_report", "upd", "SELECT trip_id, min(stop_sequence) AS min_seq, max(stop_sequence) AS max_seq, max(stop_sequence) - min(stop_sequence) + 1 - count(DISTINCT stop_sequence) AS gap_count FROM upd GROUP BY 1 HAVING max(stop_sequence) - min(stop_sequence) + 1 > count(DISTINCT stop_sequence)")
def _(t):
    return ag.gap_report(t.upd, ["trip_id"], "stop_sequence")


@query("a26_trip_agg", "upd", "SELECT trip_id, round(avg(delay) + 1e-9, 6) AS trip_mean_delay, min(feed_time) AS first_scheduled FROM upd GROUP BY 1")
def _(t):
    return rounded(ag.trip_agg(t.upd, ["trip_id"], "delay", "feed_time"), "trip_mean_delay")


METRICS = """count(*) AS n, round(avg(abs(delay - pred)) + 1e-9, 6) AS mae, round(avg((delay - pred) * (delay - pred)) + 1e-9, 4) AS mse, round(sqrt(avg((delay - pred) * (delay - pred))) + 1e-9, 6) AS rmse,
round(1 - avg((delay - pred) * (delay - pred)) / var_pop(delay) + 1e-9, 6) AS r2, round(avg(CASE WHEN sign(delay) = sign(pred) THEN 1e0 ELSE 0e0 END) + 1e-9, 6) AS direction_accuracy,
round(avg(CASE WHEN (abs(delay) <= 60) = (abs(pred) <= 60) THEN 1e0 ELSE 0e0 END) + 1e-9, 6) AS ontime_accuracy,
round(avg(CASE WHEN abs(delay - pred) <= 30 THEN 1e0 ELSE 0e0 END) + 1e-9, 6) AS within_30s, round(avg(CASE WHEN abs(delay - pred) <= 60 THEN 1e0 ELSE 0e0 END) + 1e-9, 6) AS within_1min,
round(avg(CASE WHEN abs(delay - pred) <= 120 THEN 1e0 ELSE 0e0 END) + 1e-9, 6) AS within_2min, round(avg(CASE WHEN abs(delay - pred) <= 300 THEN 1e0 ELSE 0e0 END) + 1e-9, 6) AS within_5min,
round(avg(CASE WHEN delay <> 0 THEN abs((delay - pred) / delay) END) * 100 + 1e-9, 6) AS mape"""


def shown(d):
    d = rounded(d, "mae", "rmse", "r2", "direction_accuracy", "ontime_accuracy", "within_30s", "within_1min", "within_2min", "within_5min", "mape")
    return d.withColumn("mse", F.round(F.col("mse") + 1e-9, 4))


@query("a27_regression_metrics", "upd", f"SELECT {METRICS} FROM upd")
def _(t):
    return shown(me.regression_metrics(t.upd, "delay", "pred"))


@query("a28_delay_levels", "upd", """, v AS (SELECT CASE WHEN delay < -120 THEN 'Very Early' WHEN delay < -30 THEN 'Early' WHEN delay < 30 THEN 'On Time' WHEN delay < 300 THEN 'Minor Delay' ELSE 'Major Delay' END AS level, delay, pred FROM upd)
SELECT level, count(*) AS count, round(avg(abs(delay - pred)) + 1e-9, 6) AS mae, round(sqrt(avg((delay - pred) * (delay - pred))) + 1e-9, 6) AS rmse, round(avg(CASE WHEN sign(delay) = sign(pred) THEN 1e0 ELSE 0e0 END) + 1e-9, 6) AS direction_accuracy,
round(avg(delay) + 1e-9, 6) AS true_mean, round(avg(pred) + 1e-9, 6) AS pred_mean, round(count(*) * 100e0 / (SELECT count(*) FROM upd) + 1e-9, 6) AS percentage FROM v GROUP BY 1""")
def _(t):
    return rounded(me.delay_levels(t.upd, "delay", "pred"), "mae", "rmse", "direction_accuracy", "true_mean", "pred_mean", "percentage")


@query("a29_error_by", "upd", "SELECT stop_sequence, flag, round(avg(delay - pred) + 1e-9, 6) AS mean, round(stddev_samp(delay - pred) + 1e-9, 6) AS std, count(*) AS count FROM upd GROUP BY 1, 2")
def _(t):
    return rounded(me.error_by(t.upd.withColumn("err", F.col("delay") - F.col("pred")), ["stop_sequence", "flag"], "err"), "mean", "std")


ROUTE_ERR = "SELECT part_id, avg(abs(delay - pred)) AS mae, stddev_samp(abs(delay - pred)) AS mae_std, avg(delay) AS avg_delay, count(*) AS n FROM upd GROUP BY 1 HAVING count(*) >= 30"


@query("a30_route_error", "upd", f", e AS ({ROUTE_ERR}) SELECT part_id, round(mae + 1e-9, 6) AS mae, round(mae_std + 1e-9, 6) AS mae_std, round(avg_delay + 1e-9, 6) AS avg_delay, n FROM e")
def _(t):
    return rounded(me.route_error(t.upd, "part_id", "delay", "pred", 30), "mae", "mae_std", "avg_delay")


@query("a30_error_trend", "upd", f", e AS ({ROUTE_ERR}) SELECT round(corr(avg_delay, mae) + 1e-9, 6) AS corr, round(regr_slope(mae, avg_delay) + 1e-9, 6) AS slope, round(regr_intercept(mae, avg_delay) + 1e-9, 6) AS intercept FROM e")
def _(t):
    return rounded(me.trend(me.route_error(t.upd, "part_id", "delay", "pred", 30), "avg_delay", "mae"), "corr", "slope", "intercept")


TRIP_ERR = "SELECT trip_id, avg(abs(delay - pred)) AS mae, sqrt(avg((delay - pred) * (delay - pred))) AS rmse, max(abs(delay - pred)) AS max_error, avg(delay) AS mean_actual, avg(pred) AS mean_pred FROM upd GROUP BY 1"


@query("a31_trip_errors", "upd", f", e AS ({TRIP_ERR}) SELECT trip_id, round(mae + 1e-9, 6) AS mae, round(rmse + 1e-9, 6) AS rmse, round(max_error + 1e-9, 6) AS max_error, round(mean_actual + 1e-9, 6) AS mean_actual, round(mean_pred + 1e-9, 6) AS mean_pred FROM e")
def _(t):
    return rounded(me.trip_errors(t.upd, ["trip_id"], "delay", "pred"), "mae", "rmse", "max_error", "mean_actual", "mean_pred")


@query("a32_percentiles", "obs", "SELECT route_id, " + ", ".join(f"round(quantile_cont(delay, 0.{q}) + 1e-9, 6) AS p{q}" for q in (50, 75, 90, 95, 99)) + " FROM obs GROUP BY 1")
def _(t):
    d = di.percentiles(t.obs, "delay", [0.5, 0.75, 0.9, 0.95, 0.99], ["route_id"])
    return rounded(d, "p50", "p75", "p90", "p95", "p99")


@query("a33_outlier_profile", "upd", """, q AS (SELECT quantile_cont(price, 0.95) AS b FROM upd) SELECT price > b AS is_outlier, count(*) AS n, round(avg(delay) + 1e-9, 6) AS delay, round(avg(stop_sequence) + 1e-9, 6) AS stop_sequence FROM upd, q GROUP BY 1""")
def _(t):
    return rounded(me.outlier_profile(t.upd, "price", ["delay", "stop_sequence"]), "delay", "stop_sequence")


@query("a33_outlier_routes", "upd", """, q AS (SELECT quantile_cont(price, 0.95) AS b FROM upd) SELECT stop_id, count(*) FILTER (WHERE price > b) AS n_outliers, count(*) AS n, round(count(*) FILTER (WHERE price > b) * 100e0 / count(*) + 1e-9, 6) AS rate
FROM upd, q GROUP BY 1 HAVING count(*) FILTER (WHERE price > b) > 0""")
def _(t):
    return rounded(me.outlier_routes(t.upd, "price", "stop_id"), "rate")


@query("a34_accuracy_by_region", "upd stops", LOCATED + f" SELECT region_id, flag, {METRICS} FROM l GROUP BY 1, 2")
def _(t):
    return shown(me.accuracy_by(located(t), "delay", "pred", ["region_id", "flag"]))


@query("a35_metrics_by_step", "upd", f"SELECT stop_sequence, {METRICS} FROM upd GROUP BY 1")
def _(t):
    return shown(me.metrics_by_step(t.upd, "stop_sequence", "delay", "pred"))


@query("a36_mann_whitney", "upd", """, r AS (SELECT price, flag = 'R' AS g, count(*) OVER (PARTITION BY price) AS ties, rank() OVER (ORDER BY price) AS rk FROM upd),
s AS (SELECT count(*) AS n, count(*) FILTER (WHERE g) AS n1, sum(CASE WHEN g THEN rk + (ties - 1) / 2e0 END) AS r1, sum(CAST(ties AS DOUBLE) * ties - 1) AS t3 FROM r),
u AS (SELECT n1, n - n1 AS n2, r1 - n1 * (n1 + 1) / 2e0 AS u1, n, t3 FROM s)
SELECT n1, n2, u1, round((abs(u1 - n1 * n2 / 2e0) - 0.5) / sqrt(CAST(n1 AS DOUBLE) * n2 / 12 * (n + 1 - t3 / (CAST(n AS DOUBLE) * (n - 1)))) + 1e-9, 6) AS z FROM u""")
def _(t):
    d = di.mann_whitney(t.upd.withColumn("g", (F.col("flag") == "R").cast("int")), "g", "price")
    return rounded(d.drop("p_value"), "z")


@query("a37_corr_pairs", "upd", """, p AS (SELECT 'delay' AS a, 'pred' AS b, corr(delay, pred) AS r FROM upd UNION ALL SELECT 'delay', 'price', corr(delay, price) FROM upd UNION ALL SELECT 'pred', 'price', corr(pred, price) FROM upd)
SELECT a, b, round(r + 1e-9, 6) AS r FROM p WHERE abs(r) >= 0.5""")
def _(t):
    return rounded(ag.corr_pairs(t.upd, ["delay", "pred", "price"], 0.5), "r")


@query("a38_circular_mean", "obs", """, m AS (SELECT route_id, degrees(atan2(avg(sin(radians(k * 3.6e0))), avg(cos(radians(k * 3.6e0))))) AS d FROM obs GROUP BY 1)
SELECT route_id, round(CASE WHEN d < 0 THEN d + 360 ELSE d END + 1e-9, 4) AS direction FROM m""")
def _(t):
    d = ag.circular_mean(t.obs.withColumn("deg", F.col("k") * 3.6), "deg", ["route_id"])
    return d.withColumn("direction", F.round(F.col("direction") + 1e-9, 4))


@query("a39_mode_of", "obs", """, c AS (SELECT stop_id, k, count(*) AS n FROM obs GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY stop_id ORDER BY n DESC, k) AS rn FROM c) SELECT stop_id, k AS mode FROM r WHERE rn = 1""")
def _(t):
    return ag.mode_of(t.obs, "k", ["stop_id"])


@query("a40_value_counts", "upd", "SELECT stop_id, count(*) AS n FROM upd GROUP BY 1")
def _(t):
    return ag.value_counts(t.upd, "stop_id")


@query("a40_duplicate_keys", "upd", "SELECT trip_id, stop_sequence, count(*) AS n FROM upd GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return ag.duplicate_keys(t.upd, ["trip_id", "stop_sequence"])


@query("a41_histogram", "obs", """SELECT least(CAST(floor((delay + 600) / 120) AS BIGINT), 19) AS bin, count(*) AS n, CAST(-600 + least(CAST(floor((delay + 600) / 120) AS BIGINT), 19) * 120 AS DOUBLE) AS bin_start FROM obs WHERE delay BETWEEN -600 AND 1800 GROUP BY 1""")
def _(t):
    return ag.histogram(t.obs, "delay", -600, 1800, 20)


@query("a42_trip_rows", "upd", "SELECT trip_id, arg_min(stop_id, (feed_time, stop_sequence, price)) AS stop_id, round(avg(delay) + 1e-9, 6) AS delay FROM upd GROUP BY 1")
def _(t):
    return rounded(ag.trip_rows(t.upd, ["trip_id"], ["feed_time", "stop_sequence", "price"], ["stop_id"], ["delay"]), "delay")


@query("a43_importance_by_group", "", """WITH f AS (SELECT event_type AS feature, avg(value) AS importance FROM events GROUP BY 1)
SELECT CASE WHEN feature IN ('click', 'view') THEN 'browse' WHEN feature = 'purchase' THEN 'buy' ELSE 'other' END AS "group", round(sum(importance) + 1e-9, 6) AS sum, round(avg(importance) + 1e-9, 6) AS mean, count(*) AS count FROM f GROUP BY 1""")
def _(t):
    f = t.raw("events").groupBy(F.col("event_type").alias("feature")).agg(F.avg("value").alias("importance"))
    return rounded(me.importance_by_group(f, {"browse": ["click", "view"], "buy": ["purchase"]}), "sum", "mean")


@query("a45_region_delay_hourly", "obs", "SELECT route_id, date_trunc('hour', ts) AS period, round(avg(delay) + 1e-9, 6) AS avg_delay, count(*) AS n, round(avg(CASE WHEN abs(delay) <= 60 THEN 1e0 ELSE 0e0 END) + 1e-9, 6) AS on_time_rate FROM obs GROUP BY 1, 2")
def _(t):
    return rounded(ag.region_delay(t.obs, "hourly", "ts", "route_id", "delay"), "avg_delay", "on_time_rate")


@query("a45_region_delay_daily", "obs", "SELECT stop_id, date_trunc('day', ts) AS period, round(avg(delay) + 1e-9, 6) AS avg_delay, count(*) AS n, round(avg(CASE WHEN abs(delay) <= 60 THEN 1e0 ELSE 0e0 END) + 1e-9, 6) AS on_time_rate FROM obs GROUP BY 1, 2")
def _(t):
    return rounded(ag.region_delay(t.obs, "daily", "ts", "stop_id", "delay"), "avg_delay", "on_time_rate")


@query("a45_region_delay_recent", "obs", "SELECT route_id, round(avg(delay) + 1e-9, 6) AS avg_delay, count(*) AS n, round(avg(CASE WHEN abs(delay) <= 60 THEN 1e0 ELSE 0e0 END) + 1e-9, 6) AS on_time_rate FROM obs WHERE ts > TIMESTAMP '2024-01-20 10:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1")
def _(t):
    return rounded(ag.region_delay(t.obs, "recent", "ts", "route_id", "delay", "2024-01-20 12:00:00"), "avg_delay", "on_time_rate")


@query("a45_region_ranking", "obs", """, s AS (SELECT route_id, avg(abs(delay)) AS a, avg(CASE WHEN abs(delay) <= 500 THEN 1e0 ELSE 0e0 END) AS r FROM obs WHERE ts > TIMESTAMP '2024-01-13 12:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1)
SELECT route_id, round(a + 1e-9, 6) AS avg_abs_delay, round(r + 1e-9, 6) AS on_time_rate, CAST(rank() OVER (ORDER BY a) AS INTEGER) AS rank, CASE WHEN r >= 0.8 THEN 'A' WHEN r >= 0.6 THEN 'B' WHEN r >= 0.4 THEN 'C' ELSE 'D' END AS grade FROM s""")
def _(t):
    return rounded(ag.region_ranking(t.obs, "2024-01-20 12:00:00", "ts", 7, "route_id", "delay", 500), "avg_abs_delay", "on_time_rate")


@query("d04_standardize_within", "obs", """, s AS (SELECT route_id, hour_of_day, isodow, avg(delay) AS m, nullif(stddev_samp(delay), 0) AS sd FROM obs GROUP BY 1, 2, 3)
SELECT obs_id, round((delay - m) / sd + 1e-9, 6) AS delay_z FROM obs JOIN s USING (route_id, hour_of_day, isodow)""")
def _(t):
    return rounded(wi.standardize_within(t.obs, ["route_id", "hour_of_day", "isodow"], "delay").select("obs_id", "delay_z"), "delay_z")


@query("d06_historical_average", "obs", ", s AS (SELECT stop_id, avg(delay) AS m FROM obs GROUP BY 1) SELECT obs_id, round(m + 1e-9, 6) AS historical_average FROM obs JOIN s USING (stop_id)")
def _(t):
    return rounded(wi.historical_average(t.obs, ["stop_id"], "delay").select("obs_id", "historical_average"), "historical_average")


@query("d07_scenario_metrics", "upd", f""", x AS (SELECT 'all' AS scenario, * FROM upd UNION ALL SELECT 'early_stops', * FROM upd WHERE stop_sequence <= 2 UNION ALL SELECT 'returned', * FROM upd WHERE flag = 'R')
SELECT scenario, {METRICS} FROM x GROUP BY 1""")
def _(t):
    return shown(me.scenario_metrics(t.upd, {"all": F.lit(True), "early_stops": F.col("stop_sequence") <= 2, "returned": F.col("flag") == "R"}, "delay", "pred"))


@query("d08_daily_normals", "upd", """SELECT CAST(month(feed_time) AS INTEGER) AS month, CAST(day(feed_time) AS INTEGER) AS day, round(avg(delay) + 1e-9, 6) AS delay_mean, round(stddev_samp(delay) + 1e-9, 6) AS delay_std, count(delay) AS delay_count,
CAST(min(feed_time) AS DATE) AS first_date, CAST(max(feed_time) AS DATE) AS last_date FROM upd GROUP BY 1, 2""")
def _(t):
    return rounded(ag.daily_normals(t.upd, "feed_time", ["delay"]), "delay_mean", "delay_std")


@query("d08_against_normals", "upd", """, n AS (SELECT month(feed_time) AS m, day(feed_time) AS d, avg(delay) AS x FROM upd GROUP BY 1, 2)
SELECT trip_id, stop_sequence, price, round(delay - x + 1e-9, 6) AS delay_anomaly FROM upd JOIN n ON m = month(feed_time) AND d = day(feed_time)""")
def _(t):
    n = ag.daily_normals(t.upd, "feed_time", ["delay"])
    return rounded(ag.against_normals(t.upd, n, "feed_time", ["delay"]).select("trip_id", "stop_sequence", "price", "delay_anomaly"), "delay_anomaly")


@query("m11_masked_metrics", "upd", f"SELECT flag, {METRICS} FROM upd WHERE status = 'O' GROUP BY 1")
def _(t):
    return shown(me.masked_metrics(t.upd.withColumn("seen", (F.col("status") == "O").cast("int")), "seen", "delay", "pred", ["flag"]))
