"""Composite datasets on the given tables."""

from pyspark.sql import functions as F

from headway.catalog.aggs import STOP_TYPE
from headway.catalog.base import query, r6, rounded
from headway.catalog.feeds import region_names
from headway.catalog.filters import KM
from headway.catalog.joining import ALERTS, CALENDAR, POSITIONS, STOP_TIMES, alert_tables, descriptors, feed_tables, positions, stop_times
from headway.functions.clock import epoch, hour_start
from headway.operators.learning import score_regions
from headway.operators.spans import daily
from headway.sinks.tables import stage
from headway.plans import grid as gr, network as nw, realtime as rt, serving as sv, training as tr, trips as tp, weather as we

AS_OF = "1999-06-15 08:00:00"

ENRICHED = f"""es AS (SELECT s.*, t.region_id, round({KM} + 1e-9, 2) AS km FROM stops s LEFT JOIN tiles t ON stop_lon >= xmin AND stop_lon < xmax AND stop_lat >= ymin AND stop_lat < ymax)"""


def enriched(t):
    d = nw.enriched_stops(t.stops, t.tiles, classes={4: ("NATION_0", "NATION_1"), 2: ("NATION_7", "NATION_8")}, core=("NATION_3",))
    return d.withColumn("distance_from_downtown_km", F.round(F.col("distance_from_downtown_km") + 1e-9, 2))


@query("v01_enriched_stops", "cstops tiles", f""", s AS (SELECT c.*, t.region_id, {KM} AS k FROM cstops c LEFT JOIN tiles t ON stop_lon >= xmin AND stop_lon < xmax AND stop_lat >= ymin AND stop_lat < ymax)
SELECT stop_id, stop_name, region_id, round(k, 2) AS km, round(sin(radians(stop_lat)), 6) AS lat_sin, round(cos(radians(stop_lon)), 6) AS lon_cos, round(stop_lat - 49.2827e0, 6) AS lat_relative,
CASE WHEN region_id IN ('NATION_17', 'NATION_18') AND k <= 5 THEN 5 WHEN region_id IN ('NATION_17', 'NATION_18', 'NATION_0') THEN 4 WHEN region_id = 'NATION_7' THEN 2 ELSE 0 END AS area_density_score FROM s""")
def _(t):
    d = nw.enriched_stops(t.cstops, t.tiles, classes={4: ("NATION_17", "NATION_18", "NATION_0"), 2: ("NATION_7",)}, core=("NATION_17", "NATION_18"))
    return d.select("stop_id", "stop_name", "region_id", F.col("distance_from_downtown_km").alias("km"), "lat_sin", "lon_cos", "lat_relative", "area_density_score")


@query("v02_active_service_dates", "services exceptions", f""", {CALENDAR}, a AS (SELECT * FROM cal UNION SELECT date, service_id FROM exceptions WHERE exception_type = 1)
SELECT service_date, service_id, CAST(dayofweek(service_date) AS INTEGER) AS day_of_week, rpad(dayname(service_date), 9, ' ') AS day_name, dayofweek(service_date) IN (0, 6) AS is_weekend FROM a
WHERE NOT EXISTS (SELECT 1 FROM exceptions e WHERE e.exception_type = 2 AND e.date = a.service_date AND e.service_id = a.service_id)""")
def _(t):
    return nw.active_service_dates(t.services, t.exceptions)


BASE = """bu AS (SELECT u.trip_id, u.stop_sequence, strftime(t.start_date, '%Y%m%d') AS start_date, t.route_id, t.direction_id, u.stop_id, CAST(u.delay * 15 AS INTEGER) AS arrival_delay, u.feed_time AS update_time,
 u.feed_time + to_seconds(CAST(u.stop_sequence * 600 + u.delay * 15 AS BIGINT)) AS actual_arrival_time FROM upd u JOIN trips t USING (trip_id) WHERE u.delay * 15 BETWEEN -3600 AND 3600),
rb AS (SELECT *, row_number() OVER (PARTITION BY trip_id, stop_sequence, start_date ORDER BY update_time DESC, actual_arrival_time DESC, arrival_delay DESC, stop_id DESC) AS rn FROM bu), base AS (SELECT * EXCLUDE rn FROM rb WHERE rn = 1)"""


RECENT = BASE.replace("BETWEEN -3600 AND 3600", f"BETWEEN -3600 AND 3600 AND u.feed_time >= TIMESTAMP '{AS_OF}' - INTERVAL 720 HOUR")


def base(t, as_of=None, interval="24 hours"):
    return rt.base_updates(feed_tables(t), as_of, interval)


@query("v03_base_updates", "upd trips", f", {BASE} SELECT * FROM base")
def _(t):
    return base(t).drop("trip_update_id")


@query("v03_base_recent", "upd trips", f", {RECENT} SELECT * FROM base")
def _(t):
    return base(t, AS_OF, "720 hours").drop("trip_update_id")


OBSERVED = POSITIONS + """, op AS (SELECT vp.*, strftime(start_date, '%Y%m%d') AS day, CAST(start_date AS TIMESTAMP) + to_seconds(arrival_secs) + to_days(arrival_day_offset) AS scheduled_arrival_time,
 make_timestamp(timestamp_seconds * 1000000) AS actual_arrival_time FROM vp), ob AS (SELECT *, CAST(epoch(actual_arrival_time) - epoch(scheduled_arrival_time) AS INTEGER) AS arrival_delay FROM op)"""


def located_stops(t):
    return nw.stops_with_regions(t.stops, t.tiles)


def observed(t, as_of=None, interval="2 hours"):
    tables = {"vehicle_positions": positions(t), "trip_descriptors": descriptors(t), "stop_times": stop_times(t)}
    return rt.base_positions(tables, stage(located_stops(t), "stops"), as_of, interval, "UTC")


@query("v04_base_positions", "upd trips stops tiles", f", {OBSERVED}, {ENRICHED} SELECT trip_id, stop_sequence, stop_id, day AS start_date, region_id, scheduled_arrival_time, actual_arrival_time, arrival_delay, date_trunc('hour', scheduled_arrival_time) AS time_bucket, CAST(hour(scheduled_arrival_time) AS INTEGER) AS hour_of_day, CAST(isodow(start_date) AS INTEGER) AS day_of_week FROM ob JOIN es USING (stop_id)")
def _(t):
    return observed(t).select("trip_id", "stop_sequence", "stop_id", "start_date", "region_id", "scheduled_arrival_time", "actual_arrival_time", "arrival_delay", "time_bucket", "hour_of_day", "day_of_week")


def analytics(t):
    routes = t.raw("customer").select(F.col("c_custkey").alias("route_id"), F.col("c_mktsegment").alias("route_short_name"))
    trips = t.trips.select("trip_id", F.col("headsign").alias("trip_headsign"), "service_id")
    rows = base(t).drop("trip_update_id", "update_time")
    return rt.analytics(rows, routes, trips, stage(enriched(t), "stops"), stop_times(t), "UTC", 2, lambda d: stage(d, "analytics"))


ANALYTICS = f"""{STOP_TIMES}, {ENRICHED}, {BASE}, an AS (SELECT b.*, c_mktsegment AS route_short_name, t.headsign AS trip_headsign, es.stop_name, es.region_id, st.arrival_secs, km, CAST(hour(actual_arrival_time) AS INTEGER) AS hour_of_day, date_trunc('hour', actual_arrival_time) AS datetime_60,
 CAST(isodow(t.start_date) AS INTEGER) AS day_of_week FROM base b JOIN customer ON c_custkey = b.route_id JOIN trips t ON t.trip_id = b.trip_id JOIN es ON es.stop_id = b.stop_id JOIN st ON st.trip_id = b.trip_id AND st.stop_sequence = b.stop_sequence),
rh AS (SELECT route_id, direction_id, hour_of_day, avg(arrival_delay) AS m FROM an GROUP BY 1, 2, 3 HAVING count(*) >= 2)"""


@query("v05_analytics", "upd trips stops tiles", f""", {ANALYTICS} SELECT trip_id, stop_sequence, route_short_name, trip_headsign, stop_name, region_id, arrival_secs AS scheduled_arrival_time, hour_of_day, day_of_week, datetime_60, arrival_delay,
CASE WHEN hour_of_day IN (7, 8, 17, 18) THEN 1 ELSE 0 END AS is_peak_hour, CASE WHEN day_of_week >= 6 THEN 1 ELSE 0 END AS is_weekend, round(sin(2 * pi() * hour_of_day / 24) + 1e-9, 6) AS hour_sin, round(m + 1e-9, 6) AS delay_mean_by_route_hour
FROM an LEFT JOIN rh USING (route_id, direction_id, hour_of_day)""")
def _(t):
    d = analytics(t).select("trip_id", "stop_sequence", "route_short_name", "trip_headsign", "stop_name", "region_id", "scheduled_arrival_time", "hour_of_day", "day_of_week", "datetime_60", "arrival_delay",
                            "is_peak_hour", "is_weekend", "hour_sin", "delay_mean_by_route_hour")
    return rounded(d, "hour_sin", "delay_mean_by_route_hour")


@query("v06_alert_views", "", f"WITH {ALERTS} SELECT count(*) AS n_detail, count(DISTINCT (route_id, date_trunc('hour', ts))) AS n_features FROM al")
def _(t):
    detail, features = rt.alerts_of(alert_tables(t))
    return detail.agg(F.count(F.lit(1)).alias("n_detail")).withColumn("n_features", features.agg(F.count(F.lit(1))).scalar())


PRED = """pr AS (SELECT l_suppkey % 25 AS region_no, l_partkey % 50 AS route_id, CAST(l_orderkey % 2 AS INTEGER) AS direction_id, l_suppkey AS stop_id, CASE WHEN l_linenumber < 7 THEN l_linenumber END AS stop_sequence, l_shipdate AS prediction_created_at,
 l_shipdate + to_hours(CAST(l_partkey % 3 AS BIGINT)) AS prediction_target_time, CAST(l_partkey % 3 + 1 AS INTEGER) AS prediction_hour_offset, (l_quantity - 25) * 20 AS predicted_delay_seconds, l_extendedprice AS price FROM lineitem),
pm AS (SELECT route_id, stop_id, stop_sequence, direction_id, max(prediction_created_at) AS m FROM pr GROUP BY 1, 2, 3, 4),
pl AS (SELECT pr.* FROM pr JOIN pm ON pm.route_id = pr.route_id AND pm.stop_id = pr.stop_id AND pm.stop_sequence = pr.stop_sequence AND pm.direction_id = pr.direction_id AND m = prediction_created_at)"""


def predictions(t):
    li = t.raw("lineitem")
    k = (F.col("l_partkey") % 3).cast("int")
    return li.select(
        (F.col("l_suppkey") % 25).alias("region_id"), (F.col("l_partkey") % 50).alias("route_id"), (F.col("l_orderkey") % 2).cast("int").alias("direction_id"), F.col("l_suppkey").alias("stop_id"),
        F.when(F.col("l_linenumber") < 7, F.col("l_linenumber")).alias("stop_sequence"), F.col("l_shipdate").alias("prediction_created_at"),
        (F.col("l_shipdate") + F.make_dt_interval(F.lit(0), k, F.lit(0), F.lit(0))).alias("prediction_target_time"), (k + 1).alias("prediction_hour_offset"),
        ((F.col("l_quantity") - 25) * 20).alias("predicted_delay_seconds"), ((F.col("l_quantity") - 25) / 3).alias("predicted_delay_minutes"), F.col("l_extendedprice").alias("price"),
    )


@query("v07_latest_predictions", "", f"WITH {PRED} SELECT route_id, direction_id, stop_id, stop_sequence, prediction_target_time, predicted_delay_seconds, price FROM pl")
def _(t):
    return rt.latest_predictions(predictions(t)).select("route_id", "direction_id", "stop_id", "stop_sequence", "prediction_target_time", "predicted_delay_seconds", "price")


@query("f06_register_views", "services exceptions", f""", {CALENDAR}, a AS (SELECT * FROM cal UNION SELECT date, service_id FROM exceptions WHERE exception_type = 1), k AS (SELECT * FROM a
WHERE NOT EXISTS (SELECT 1 FROM exceptions e WHERE e.exception_type = 2 AND e.date = a.service_date AND e.service_id = a.service_id)), p AS (WITH {PRED} SELECT * FROM pl)
SELECT CAST(dayofweek(service_date) AS INTEGER) AS day_of_week, count(*) AS n, (SELECT count(*) FROM p) AS predictions FROM k GROUP BY 1""")
def _(t):
    from headway.plans.views import register_views

    register_views(t.spark, {"calendar": t.services, "calendar_dates": t.exceptions, "predictions": predictions(t)})
    return t.spark.sql("SELECT day_of_week, count(*) AS n, (SELECT count(*) FROM predictions_latest) AS predictions FROM active_service_dates GROUP BY day_of_week")


def history(t):
    """Observations as past arrivals: the stop is also the route and the trip."""
    o = t.obs
    return o.select(
        "obs_id", F.col("stop_id").alias("route_id"), F.col("stop_id").alias("trip_id"), (F.col("k") % 2).alias("direction_id"), "stop_id", F.col("k").alias("stop_sequence"),
        F.date_format("ts", "yyyyMMdd").alias("start_date"), F.col("ts").alias("scheduled_arrival_time"), F.col("ts").alias("actual_arrival_time"), "hour_of_day",
        F.col("isodow").alias("day_of_week"), F.col("delay").alias("arrival_delay"),
    )


def training_tables(t):
    wx = t.wx.select("unixtime", F.col("temperature").alias("humidex_v"), F.col("humidity").alias("wind_speed"), F.col("cloud").alias("cloud_cover_8"))
    days = t.raw("events").where("event_type = 'error' AND value > 250").select(F.to_date("ts").alias("date"), F.lit(1).alias("exception_type"))
    a = alert_tables(t)
    return {
        "trips": t.raw("customer").select(F.col("c_custkey").alias("trip_id"), F.col("c_mktsegment").alias("trip_headsign")),
        "stops": t.cstops.withColumn("distance_from_downtown_km", F.col("stop_lat") - 49).withColumn("area_density_score", (F.col("stop_id") % 6).cast("int")),
        "weather_hourly": wx, "calendar_dates": days, "alert_features": rt.alerts_of(a)[1],
    }


HIST = f"""{ALERTS}, h AS (SELECT obs_id, stop_id AS route_id, k % 2 AS direction_id, stop_id AS trip_id, k AS stop_sequence, strftime(ts, '%Y%m%d') AS start_date, ts, hour_of_day, isodow, delay FROM obs),
af AS (SELECT route_id, date_trunc('hour', ts) AS hr, count(DISTINCT alert_id) FILTER (WHERE TRY_CAST(effect AS INTEGER) IN (1, 4)) AS high_impact_alert_count, CAST(sum(CASE TRY_CAST(effect AS INTEGER) WHEN 1 THEN 10 WHEN 3 THEN 8 WHEN 4 THEN 7 WHEN 6 THEN 5 WHEN 9 THEN 4 WHEN 2 THEN 3 ELSE 1 END) AS BIGINT) AS alert_severity_score FROM al GROUP BY 1, 2),
wh AS (SELECT hour AS hr, temperature AS humidex, temperature - avg(temperature) OVER (ORDER BY hour ROWS BETWEEN 168 PRECEDING AND CURRENT ROW) AS humidex_deviation_7d, humidity - coalesce(lag(humidity) OVER (ORDER BY hour), humidity) AS wind_speed_change_1h, cloud FROM wx),
hol AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events WHERE event_type = 'error' AND value > 250)"""
WINS = """avg(delay) OVER (PARTITION BY route_id, direction_id ORDER BY ts RANGE BETWEEN INTERVAL 60 MINUTE PRECEDING AND INTERVAL 1 MINUTE PRECEDING) AS w5,
avg(delay) OVER (PARTITION BY route_id, direction_id, hour_of_day ORDER BY ts, trip_id, stop_sequence, start_date ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING) AS w6,
stddev_samp(delay) OVER (PARTITION BY route_id, direction_id ORDER BY ts, trip_id, stop_sequence, start_date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS w7,
avg(delay) OVER (PARTITION BY trip_id, hour_of_day ORDER BY ts, trip_id, stop_sequence, start_date ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING) AS w8"""
ENRICH = """round(humidex_deviation_7d + 1e-9, 6) AS humidex_deviation_7d, round(wind_speed_change_1h + 1e-9, 6) AS wind_speed_change_1h, CASE WHEN cloud > 6 THEN 1 ELSE 0 END AS weather_rainy, coalesce(high_impact_alert_count, 0) AS high_impact_alert_count,
coalesce(alert_severity_score, 0) AS alert_severity_score, CASE WHEN hol.d IS NULL THEN 0 ELSE 1 END AS is_holiday, c_mktsegment AS trip_headsign, CAST(day(ts) AS INTEGER) AS day_of_month"""
ENRICH_FROM = "JOIN customer ON c_custkey = trip_id JOIN wh ON wh.hr = date_trunc('hour', ts) LEFT JOIN af ON af.route_id = x.route_id AND af.hr = date_trunc('hour', ts) LEFT JOIN hol ON hol.d = CAST(ts AS DATE)"
_SHARED = ["humidex_deviation_7d", "wind_speed_change_1h", "weather_rainy", "high_impact_alert_count", "alert_severity_score", "is_holiday", "trip_headsign", "day_of_month"]


@query("v08_route_training", "obs wx", f""", {HIST}, x AS (SELECT *, {WINS} FROM h)
SELECT obs_id, round(coalesce(w5, 0) + 1e-9, 6) AS route_delay_trend_60min, round(coalesce(w6, 0) + 1e-9, 6) AS route_hourly_delay_7d_avg, round(coalesce(w7, 0) + 1e-9, 4) AS route_delay_volatility_3h,
round(coalesce(w6, 0) + 1e-9, 6) AS delay_mean_by_route_hour, round(coalesce(w8, 0) + 1e-9, 6) AS delay_mean_by_trip_headsign_hour, CASE WHEN hour_of_day BETWEEN 7 AND 9 THEN 1 ELSE 0 END AS rush_hour_morning, {ENRICH} FROM x {ENRICH_FROM}""")
def _(t):
    d = tr.route_training(history(t), training_tables(t))
    d = d.select("obs_id", "route_delay_trend_60min", "route_hourly_delay_7d_avg", "route_delay_volatility_3h", "delay_mean_by_route_hour", "delay_mean_by_trip_headsign_hour", "rush_hour_morning", *_SHARED)
    d = rounded(d, "route_delay_trend_60min", "route_hourly_delay_7d_avg", "delay_mean_by_route_hour", "delay_mean_by_trip_headsign_hour", "humidex_deviation_7d", "wind_speed_change_1h")
    return d.withColumn("route_delay_volatility_3h", F.round(F.col("route_delay_volatility_3h") + 1e-9, 4))


@query("v09_trip_training", "obs wx", f""", {HIST}, x AS (SELECT *, {WINS}, lag(delay, 1) OVER q AS p1, lag(delay, 2) OVER q AS p2 FROM h WINDOW q AS (PARTITION BY trip_id, start_date ORDER BY stop_sequence, ts))
SELECT obs_id, p1 AS prev_stop_delay, coalesce(p2, 0) AS prev_2_stop_delay, round(coalesce(w5, 0) + 1e-9, 6) AS route_delay_trend_60min, round(coalesce(w6, 0) + 1e-9, 6) AS route_hourly_delay_7d_avg,
CASE WHEN hour_of_day BETWEEN 7 AND 9 THEN 1 WHEN hour_of_day BETWEEN 17 AND 19 THEN 2 ELSE 0 END AS rush_hour_type, {ENRICH} FROM x {ENRICH_FROM} WHERE stop_sequence >= 6 AND p1 IS NOT NULL""")
def _(t):
    d = tr.trip_training(history(t), training_tables(t))
    d = d.select("obs_id", "prev_stop_delay", "prev_2_stop_delay", "route_delay_trend_60min", "route_hourly_delay_7d_avg", "rush_hour_type", *_SHARED)
    return rounded(d, "route_delay_trend_60min", "route_hourly_delay_7d_avg", "humidex_deviation_7d", "wind_speed_change_1h")


TT = f"""{OBSERVED}, w AS (SELECT * EXCLUDE start_date, day AS start_date, CAST(epoch(actual_arrival_time) - epoch(lag(actual_arrival_time) OVER (PARTITION BY start_date, route_id, trip_id ORDER BY stop_sequence, actual_arrival_time, stop_id)) AS DOUBLE) AS raw FROM ob),
tt AS (SELECT *, CASE WHEN raw BETWEEN 10 AND 3600 THEN raw END AS travel_time_duration FROM w), tk AS (SELECT * FROM tt WHERE travel_time_duration IS NOT NULL OR raw IS NULL)"""


@query("v10_travel_time", "upd trips", f", {TT} SELECT trip_id, stop_id, stop_sequence AS line_direction_link_order, start_date, arrival_delay, travel_time_duration FROM tk")
def _(t):
    return tr.travel_time_dataset(observed(t)).select("trip_id", "stop_id", "line_direction_link_order", "start_date", "arrival_delay", "travel_time_duration")


def weather_rows(t):
    w = t.wx
    return w.select("unixtime", "temperature", F.col("humidity").alias("relative_humidity"), F.lit(1.0).alias("pressure_sea"), (F.col("cloud") * 2).alias("wind_speed"), "visibility",
                    F.col("dew_point").alias("humidex_v"), F.col("cloud").alias("cloud_cover_8"))


WF = """wf AS (SELECT hour AS time_bucket, temperature AS temp, dew_point AS humidex, cloud * 2 AS wind_speed, CASE WHEN cloud <= 2 THEN 1 ELSE 0 END AS weather_sunny, CASE WHEN cloud > 2 AND cloud <= 6 THEN 1 ELSE 0 END AS weather_cloudy,
 CASE WHEN cloud > 6 THEN 1 ELSE 0 END AS weather_rainy, CAST(CASE WHEN humidity > 90 AND cloud > 6 THEN 2.0 WHEN humidity > 80 AND cloud > 4 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS precipitation FROM wx)"""


@query("v11_weather_features", "wx", f", {WF} SELECT * FROM wf WHERE time_bucket >= TIMESTAMP '2024-01-10 00:00:00'")
def _(t):
    d = tr.weather_features(weather_rows(t), 1704844800).withColumnRenamed("datetime", "time_bucket")
    return d.select("time_bucket", "temp", "humidex", "wind_speed", "weather_sunny", "weather_cloudy", "weather_rainy", "precipitation")


def daily_weather(t):
    """Weather of each clock hour of the update days, from mean prices."""
    b = t.upd.groupBy(F.col("feed_time").alias("day")).agg(F.avg("price").alias("p"), (F.count(F.lit(1)) % 9).cast("double").alias("c"))
    hours = b.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(6))))
    return hours.select((epoch("day") + F.col("h") * 3600).alias("unixtime"), F.round(F.col("p") + 1e-9, 4).alias("humidex_v"), F.col("h").cast("double").alias("wind_speed"), F.col("c").alias("cloud_cover_8"))


STATUS = f"""{ANALYTICS}, dw AS (SELECT feed_time + to_hours(h) AS hr, round(p + 1e-9, 4) AS humidex, CAST(h AS DOUBLE) AS wind_speed, c FROM (SELECT feed_time, avg(price) AS p, CAST(count(*) % 9 AS DOUBLE) AS c FROM upd GROUP BY 1), range(7) r(h)),
ps AS (SELECT an.*, m, humidex, wind_speed, c FROM an LEFT JOIN rh USING (route_id, direction_id, hour_of_day) JOIN dw ON hr = datetime_60 WHERE datetime_60 >= TIMESTAMP '1999-06-15 08:00:00' - INTERVAL 9000 HOUR)"""


def status(t):
    return rt.predict_status(analytics(t), daily_weather(t), AS_OF, None, "9000 hours")


@query("v12_predict_status", "upd trips stops tiles", f", {STATUS} SELECT trip_headsign IS NOT NULL AS known, region_id, route_id, stop_id, datetime_60 AS time_bucket, arrival_delay, stop_sequence AS line_direction_link_order, round(humidex + 1e-9, 4) AS humidex, wind_speed, CASE WHEN c > 6 THEN 1 ELSE 0 END AS weather_rainy FROM ps")
def _(t):
    d = status(t).select(F.lit(True).alias("known"), "region_id", "route_id", "stop_id", "time_bucket", "arrival_delay", "line_direction_link_order", "humidex", "wind_speed", "weather_rainy")
    return d.withColumn("humidex", F.round(F.col("humidex") + 1e-9, 4))


DAY = "2001-02-05 08:00:00"
BOARD = f"""{CALENDAR}, {OBSERVED}, {PRED}, sd AS (SELECT service_date, service_id FROM cal WHERE service_date IN (DATE '2001-02-05', DATE '2001-02-04')),
tm AS (SELECT st.*, t.route_id, t.direction_id, t.headsign, t.service_id, sd.service_date, CAST(sd.service_date AS TIMESTAMP) + to_seconds(st.arrival_secs) + to_days(st.arrival_day_offset) AS actual_time FROM st JOIN trips t USING (trip_id) JOIN sd ON sd.service_id = t.service_id),
rec AS (SELECT * FROM ob), av AS (SELECT route_id, stop_id, avg(arrival_delay) AS m FROM rec GROUP BY 1, 2),
pv AS (SELECT trip_id, stop_sequence, arg_max(arrival_delay, (actual_arrival_time, arrival_delay)) AS arrival_delay FROM rec GROUP BY 1, 2)"""


def board_inputs(t):
    trips = t.trips.select("trip_id", "route_id", "direction_id", F.col("headsign").alias("trip_headsign"), "service_id")
    p = rt.latest_predictions(predictions(t)).groupBy("stop_id", "stop_sequence", "route_id", "direction_id", "prediction_target_time").agg(F.min("predicted_delay_seconds").alias("predicted_delay_seconds"))
    seen = observed(t).select("route_id", "stop_id", "trip_id", "stop_sequence", "arrival_delay", "actual_arrival_time")
    return stop_times(t), trips, nw.expand_calendar(t.services), seen, p


@query("v13_stop_board", "upd trips services stops", f""", {BOARD}, na AS (SELECT stop_id, route_id, headsign, service_id, service_date, min(actual_time) AS next_arrival_time FROM tm WHERE actual_time >= TIMESTAMP '{DAY}' GROUP BY 1, 2, 3, 4, 5),
pp AS (SELECT stop_id, stop_sequence, route_id, direction_id, prediction_target_time, min(predicted_delay_seconds) AS s FROM pl GROUP BY ALL)
SELECT tm.stop_id, tm.route_id, tm.service_date, na.next_arrival_time, tm.trip_id, tm.stop_sequence, round(coalesce(pp.s, av.m) + 1e-9, 6) AS predicted_delay_seconds, coalesce(pv.arrival_delay, -99999) AS previous_stop_arrival_delay
FROM tm JOIN na ON na.stop_id = tm.stop_id AND na.route_id = tm.route_id AND na.headsign = tm.headsign AND na.service_id = tm.service_id AND na.service_date = tm.service_date AND na.next_arrival_time = tm.actual_time LEFT JOIN pv ON pv.trip_id = tm.trip_id AND pv.stop_sequence = tm.stop_sequence - 1 LEFT JOIN av ON av.route_id = tm.route_id AND av.stop_id = tm.stop_id
LEFT JOIN pp ON pp.stop_id = tm.stop_id AND pp.stop_sequence = tm.stop_sequence AND pp.route_id = tm.route_id AND pp.direction_id = tm.direction_id AND pp.prediction_target_time = date_trunc('hour', na.next_arrival_time)""")
def _(t):
    st, trips, dates, seen, p = board_inputs(t)
    d = sv.stop_board(st, trips, dates, stage(seen, "seen"), p, DAY, zone="UTC")
    d = d.select("stop_id", "route_id", "service_date", "next_arrival_time", "trip_id", "stop_sequence", "predicted_delay_seconds", F.coalesce("previous_stop_arrival_delay", F.lit(-99999)).alias("previous_stop_arrival_delay"))
    return rounded(d, "predicted_delay_seconds")


@query("v14_route_timetable", "upd trips services stops", f""", {BOARD}, pp AS (SELECT stop_id, stop_sequence, route_id, prediction_target_time, min(predicted_delay_seconds) AS s FROM pl GROUP BY ALL)
SELECT tm.route_id, tm.trip_id, tm.stop_id, tm.stop_sequence, tm.service_date, tm.actual_time AS actual_arrival_timestamp, pp.prediction_target_time, round(coalesce(pp.s, av.m) + 1e-9, 6) AS predicted_delay_seconds
FROM tm LEFT JOIN av ON av.route_id = tm.route_id AND av.stop_id = tm.stop_id LEFT JOIN pp ON pp.stop_id = tm.stop_id AND pp.route_id = tm.route_id AND pp.prediction_target_time <= tm.actual_time AND pp.prediction_target_time + INTERVAL 1 HOUR > tm.actual_time
WHERE tm.actual_time >= TIMESTAMP '{DAY}' - INTERVAL 5 MINUTE""")
def _(t):
    st, trips, dates, seen, p = board_inputs(t)
    p = p.groupBy("stop_id", "stop_sequence", "route_id", "prediction_target_time").agg(F.min("predicted_delay_seconds").alias("predicted_delay_seconds"))
    d = sv.route_timetable(st, trips, dates, seen, p, DAY, zone="UTC")
    d = d.select("route_id", "trip_id", "stop_id", "stop_sequence", "service_date", "actual_arrival_timestamp", "prediction_target_time", "predicted_delay_seconds")
    return rounded(d, "predicted_delay_seconds")


@query("v15_region_board", "upd trips stops tiles", f", {OBSERVED}, {ENRICHED} SELECT region_id, round(min(stop_lat) + 1e-9, 6) AS min_lat, round(max(stop_lat) + 1e-9, 6) AS max_lat, round(avg(arrival_delay) + 1e-9, 6) AS avg_delay_seconds FROM ob JOIN es USING (stop_id) WHERE region_id IS NOT NULL GROUP BY 1")
def _(t):
    return rounded(sv.region_board(observed(t)), "min_lat", "max_lat", "avg_delay_seconds")


@query("v16_region_predictions", "", f"""WITH {PRED} SELECT region_no AS region_id, route_id, direction_id, stop_id, count(DISTINCT prediction_hour_offset) AS n_hours, min(prediction_hour_offset) AS first_offset FROM pl WHERE prediction_hour_offset <= 2 GROUP BY 1, 2, 3, 4""")
def _(t):
    d = sv.nest_predictions(sv.region_predictions(rt.latest_predictions(predictions(t)), hours=2))
    return d.select("region_id", "route_id", "direction_id", "stop_id", F.size("hour_predictions").cast("bigint").alias("n_hours"), F.get("hour_predictions", F.lit(0))["offset"].alias("first_offset"))


@query("a44_nest_predictions", "", f"""WITH {PRED}, h AS (SELECT region_no AS region_id, route_id, direction_id, stop_id, prediction_hour_offset AS o, min((strftime(prediction_target_time, '%Y-%m-%d %H:%M:%S'), predicted_delay_seconds)) AS v FROM pr GROUP BY 1, 2, 3, 4, 5)
SELECT region_id, route_id, direction_id, stop_id, string_agg(o || '@' || v[1], '|' ORDER BY o) AS hours, round(sum(v[2]) + 1e-9, 6) AS total FROM h GROUP BY 1, 2, 3, 4""")
def _(t):
    d = sv.nest_predictions(predictions(t))
    text = F.array_join(F.transform("hour_predictions", lambda h: F.concat_ws("@", h["offset"].cast("string"), h["time"])), "|")
    total = F.aggregate(F.transform("hour_predictions", lambda h: h["delay_seconds"]), F.lit(0.0), lambda a, v: a + v)
    return d.select("region_id", "route_id", "direction_id", "stop_id", text.alias("hours"), r6(total).alias("total"))


@query("v17_mapping_summary", "cstops tiles", "SELECT count(*) AS total_stops, count(region_id) AS mapped_stops, round(count(region_id) * 100e0 / count(*), 1) AS mapped_percent FROM cstops LEFT JOIN tiles ON stop_lon >= xmin AND stop_lon < xmax AND stop_lat >= ymin AND stop_lat < ymax")
def _(t):
    return nw.mapping_summary(nw.stops_with_regions(t.cstops, t.tiles)).withColumn("mapped_percent", F.col("mapped_percent").cast("double"))


@query("v17_stops_per_region", "cstops tiles", "SELECT region_id, region_name, count(stop_id) AS stop_count FROM tiles LEFT JOIN cstops ON stop_lon >= xmin AND stop_lon < xmax AND stop_lat >= ymin AND stop_lat < ymax GROUP BY 1, 2")
def _(t):
    return nw.stops_per_region(t.tiles, nw.stops_with_regions(t.cstops, t.tiles))


@query("v19_ml_base", "upd trips stops tiles", f""", {OBSERVED}, ax AS (SELECT route_id, date_trunc('hour', scheduled_arrival_time) AS hr, max(arrival_delay) AS worst FROM ob WHERE arrival_delay > 1200 GROUP BY 1, 2)
SELECT trip_id, ob.stop_sequence, ob.arrival_delay, CASE WHEN ax.hr IS NULL THEN 0 ELSE 1 END AS has_active_alert, coalesce(worst, 0) AS alert_severity_score FROM ob LEFT JOIN ax ON ax.route_id = ob.route_id AND ax.hr = date_trunc('hour', scheduled_arrival_time) WHERE day BETWEEN '19980101' AND '19991231'""")
def _(t):
    o = observed(t)
    late = o.where("arrival_delay > 1200").groupBy("route_id", F.col("time_bucket").alias("alert_hour")).agg(F.max("arrival_delay").alias("alert_severity_score"))
    alerts = late.withColumns({x: F.lit(1) for x in tr.ALERT_COLUMNS if x != "alert_severity_score"})
    return tr.ml_base(o, alerts, "19980101", "19991231").select("trip_id", "stop_sequence", "arrival_delay", "has_active_alert", "alert_severity_score")


@query("v20_offline_features", "upd trips wx", f""", {TT}, c AS (SELECT *, CAST(hour(actual_arrival_time) AS INTEGER) AS hod, date_trunc('hour', actual_arrival_time) AS hr, CAST(isodow(strptime(start_date, '%Y%m%d')) AS INTEGER) AS dow FROM tk WHERE travel_time_duration IS NOT NULL),
k AS (SELECT * FROM c WHERE NOT (arrival_delay < -CASE WHEN hod IN (22,23,0,1,2,3,4,5) THEN 240 ELSE 300 END OR arrival_delay > CASE WHEN hod IN (7,8,9,17,18,19) THEN 1350 WHEN hod IN (22,23,0,1,2,3,4,5) THEN 720 ELSE 900 END)),
g AS (SELECT route_id, stop_id, hr, dow, avg(arrival_delay) AS d, avg(travel_time_duration) AS tv, count(*) AS n FROM k GROUP BY route_id, direction_id, stop_id, stop_sequence, hr, dow)
SELECT route_id, stop_id, hr AS time_bucket, dow AS day_of_week, round(d + 1e-9, 6) AS arrival_delay, round(tv + 1e-9, 6) AS travel_time_duration, n AS observation_count, CAST(hour(hr) AS INTEGER) AS hour_of_day FROM g""")
def _(t):
    tt = stage(tr.travel_time_dataset(observed(t)))
    hours = tt.select(F.col("datetime_60").alias("datetime")).distinct()
    cols = ["temp", "precipitation", "humidex", "wind_speed", "weather_sunny", "weather_cloudy", "weather_rainy"]
    d = tr.offline_features(tt, hours.withColumns({x: F.lit(1.0) for x in cols}), min_obs=1)
    d = d.select("route_id", "stop_id", "time_bucket", "day_of_week", "arrival_delay", "travel_time_duration", "observation_count", "hour_of_day")
    return rounded(d, "arrival_delay", "travel_time_duration")


def raw_weather(t):
    w = t.wx
    return w.select(
        F.col("hour").alias("date_time_local"), "unixtime", "temperature", F.when(F.col("cloud") != 5, F.col("dew_point")).alias("dew_point"), "visibility",
        F.when(F.col("cloud") < 7, F.col("cloud")).alias("cloud_cover_8"), F.when(F.col("cloud") > 1, F.col("humidity")).alias("relative_humidity"),
        F.when(F.col("cloud") != 2, F.col("cloud") * 45).alias("wind_dir_10s"), F.lit(1).alias("wind_gust"),
    )


CLEAN = """, a AS (SELECT hour, unixtime, temperature, CASE WHEN cloud <> 5 THEN dew_point END AS dp, visibility AS vis, CASE WHEN cloud < 7 THEN cloud END AS cl, CASE WHEN cloud > 1 THEN humidity END AS rh, CASE WHEN cloud <> 2 THEN cloud * 45 END AS wd, row_number() OVER (ORDER BY hour) AS p FROM wx),
cm AS (SELECT degrees(atan2(avg(sin(radians(wd))), avg(cos(radians(wd))))) AS d FROM a), md AS (SELECT cl FROM a WHERE cl IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, cl LIMIT 1),
b AS (SELECT *, last_value(CASE WHEN vis IS NOT NULL THEN p END IGNORE NULLS) OVER up AS pp, last_value(vis IGNORE NULLS) OVER up AS pv, first_value(CASE WHEN vis IS NOT NULL THEN p END IGNORE NULLS) OVER dn AS np, first_value(vis IGNORE NULLS) OVER dn AS nv,
last_value(dp IGNORE NULLS) OVER l7 AS dpf, last_value(rh IGNORE NULLS) OVER l7 AS rhf FROM a WINDOW up AS (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), dn AS (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), l7 AS (ORDER BY p ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
cw AS (SELECT hour, round(coalesce(wd, CASE WHEN cm.d < 0 THEN cm.d + 360 ELSE cm.d END) + 1e-9, 4) AS wind_dir_10s, round(CASE WHEN vis IS NOT NULL THEN vis WHEN pp IS NOT NULL AND np IS NOT NULL THEN pv + (nv - pv) * (p - pp) / (np - pp) ELSE coalesce(pv, nv) END + 1e-9, 6) AS visibility,
coalesce(b.cl, md.cl) AS cloud_cover_8, rhf AS relative_humidity, dpf AS dew_point, round(temperature + 0.5555 * (6.11 * exp(5417.753 * (1/273.15e0 - 1/(dpf + 273.15e0))) - 10), 2) AS humidex_v FROM b, cm, md)"""


def cleaned(d):
    d = d.withColumn("wind_dir_10s", F.round(F.col("wind_dir_10s") + 1e-9, 4)).withColumnRenamed("date_time_local", "hour")
    return rounded(d.select("hour", "wind_dir_10s", "visibility", "cloud_cover_8", "relative_humidity", "dew_point", "humidex_v"), "visibility")


@query("c01_clean_weather", "wx", CLEAN + " SELECT * FROM cw")
def _(t):
    return cleaned(we.clean_weather(raw_weather(t)))


@query("v21_ingest_weather", "wx", CLEAN + " SELECT * FROM cw WHERE hour >= TIMESTAMP '2024-01-15' AND hour <= TIMESTAMP '2024-01-20 11:00:00'")
def _(t):
    have = raw_weather(t).where("date_time_local < '2024-01-15'")
    return cleaned(we.ingest_weather(raw_weather(t), have, "2024-01-20 12:30:00"))


@query("v22_stop_grid", "obs", """, c AS (SELECT stop_id, time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') AS ts, avg(delay) AS d FROM obs GROUP BY 1, 2), lim AS (SELECT min(ts) AS lo, max(ts) AS hi FROM c),
st AS (SELECT unnest(generate_series(lo, hi, INTERVAL 15 MINUTE)) AS ts FROM lim), i AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM st),
g AS (SELECT r.stop_id, i.ts, i.i, i.n, c.d FROM (SELECT DISTINCT stop_id FROM obs) r CROSS JOIN i LEFT JOIN c ON c.stop_id = r.stop_id AND c.ts = i.ts),
f AS (SELECT stop_id, ts, i < floor(n * 0.7e0) AS is_train, d IS NOT NULL AS observed, coalesce(last_value(d IGNORE NULLS) OVER (PARTITION BY stop_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0) AS delay FROM g),
s AS (SELECT avg(delay) AS m, stddev_pop(delay) AS sd FROM f WHERE is_train) SELECT stop_id, ts, is_train, observed, round((delay - m) / sd + 1e-9, 6) AS scaled FROM f, s""")
def _(t):
    o = t.obs.select("stop_id", F.col("route_id").alias("trip_id"), F.col("ts").alias("actual_arrival_time"), F.col("obs_id").alias("stop_sequence"), F.col("delay").alias("arrival_delay"))
    d = gr.stop_grid(o)["grid"]
    return rounded(d.select("stop_id", F.col("actual_arrival_time").alias("ts"), "is_train", "observed", F.col("arrival_delay_scaled").alias("scaled")), "scaled")


@query("v23_import_regions", "cstops tiles", "SELECT region_id, region_name, count(stop_id) AS stop_count FROM tiles LEFT JOIN cstops ON stop_lon >= xmin AND stop_lon < xmax AND stop_lat >= ymin AND stop_lat < ymax GROUP BY 1, 2")
def _(t):
    old = t.tiles.withColumn("region_name", F.lit("old")).where("region_id < 'NATION_2'")
    return nw.import_regions(old, t.tiles, t.cstops)["per_region"]


PREP = STOP_TYPE.replace("SELECT trip_id, stop_sequence, max(delay) AS mx, min(delay) AS mn, arg_min(delay, (feed_time, price)) AS f", "SELECT trip_id, stop_sequence, min(feed_time) AS t, max(g) AS mx, min(g) AS mn, arg_min(g, (feed_time, price)) FILTER (WHERE g IS NOT NULL) AS f").replace(
    "FROM upd GROUP", "FROM (SELECT *, CASE WHEN flag <> 'A' THEN delay END AS g FROM upd) GROUP").replace("SELECT trip_id, stop_sequence, CASE WHEN stop_sequence = hi THEN 'last'", "SELECT trip_id, t, stop_sequence, CASE WHEN stop_sequence = hi THEN 'last'")
INTERP = """, n AS (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY stop_sequence) AS p, arrival_delay_agg AS v FROM s),
b2 AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER up AS pp, last_value(v IGNORE NULLS) OVER up AS pv, first_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER dn AS np, first_value(v IGNORE NULLS) OVER dn AS nv FROM n
WINDOW up AS (PARTITION BY trip_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), dn AS (PARTITION BY trip_id ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
pt AS (SELECT trip_id, stop_sequence, t, stop_type, CASE WHEN v IS NOT NULL THEN v WHEN pp IS NOT NULL AND np IS NOT NULL THEN pv + (nv - pv) * (p - pp) / (np - pp) ELSE coalesce(pv, nv) END AS a FROM b2)"""


def prepared(t):
    u = t.upd.join(t.trips, "trip_id").select(
        "trip_id", "stop_sequence", "stop_id", "route_id", "direction_id", F.date_format("start_date", "yyyyMMdd").alias("start_date"), "price",
        F.when(F.col("flag") != "A", F.col("delay")).alias("arrival_delay"), F.col("feed_time").alias("actual_arrival_time"), F.col("feed_time").alias("scheduled_arrival_time"),
    )
    return tp.prepare_trip_data(u, others=("scheduled_arrival_time", "stop_id"), tie=["price"])


@query("c13_prepare_trip_data", "upd trips", PREP + INTERP + " SELECT trip_id, stop_sequence, stop_type, round(a + 1e-9, 6) AS arrival_delay_agg FROM pt")
def _(t):
    return rounded(prepared(t).select("trip_id", "stop_sequence", "stop_type", "arrival_delay_agg"), "arrival_delay_agg")


@query("c14_process_features", "upd trips", """, c AS (SELECT trip_id, stop_sequence FROM upd GROUP BY 1, 2), r AS (SELECT trip_id, stop_sequence, route_id || '_' || direction_id AS k, start_date FROM c JOIN trips USING (trip_id)), e AS (SELECT k, CAST(row_number() OVER (ORDER BY k) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT k FROM r))
SELECT trip_id, stop_sequence, code AS route_direction_encoded, CAST(isodow(start_date) - 1 AS INTEGER) AS day_of_week, CASE WHEN isodow(start_date) >= 6 THEN 1 ELSE 0 END AS is_weekend, 0 AS has_detour FROM r JOIN e USING (k)""")
def _(t):
    return tp.process_features(stage(prepared(t))).select("trip_id", "stop_sequence", "route_direction_encoded", "day_of_week", "is_weekend", "has_detour")


@query("c15_trip_history", "upd trips", PREP + INTERP + """, m AS (SELECT pt.trip_id, route_id, direction_id, strftime(start_date, '%Y%m%d') || '_' || route_id || '_' || direction_id || '_' || pt.trip_id AS tk, avg(a) AS x, min(t) AS t FROM pt JOIN trips USING (trip_id) GROUP BY 1, 2, 3, 4),
f AS (SELECT trip_id, coalesce(lag(x, 1) OVER w, 0) AS l1, coalesce(lag(x, 5) OVER w, 0) AS l5, coalesce(avg(x) OVER w3, 0) AS m3, coalesce(stddev_samp(x) OVER w10, 0) AS s10 FROM m WINDOW w AS (PARTITION BY route_id, direction_id ORDER BY t, tk), w3 AS (PARTITION BY route_id, direction_id ORDER BY t, tk ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), w10 AS (PARTITION BY route_id, direction_id ORDER BY t, tk ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
SELECT trip_id, stop_sequence, round(l1 + 1e-9, 6) AS delay_lag_1, round(l5 + 1e-9, 6) AS delay_lag_5, round(m3 + 1e-9, 6) AS delay_rolling_mean_3, round(s10 + 1e-9, 4) AS delay_rolling_std_10 FROM pt JOIN f USING (trip_id)""")
def _(t):
    d = tp.trip_history_features(stage(prepared(t))).select("trip_id", "stop_sequence", "delay_lag_1", "delay_lag_5", "delay_rolling_mean_3", "delay_rolling_std_10")
    return rounded(d, "delay_lag_1", "delay_lag_5", "delay_rolling_mean_3").withColumn("delay_rolling_std_10", F.round(F.col("delay_rolling_std_10") + 1e-9, 4))


@query("m08_score_regions", "upd trips stops tiles", f""", {STATUS}, q AS (SELECT *, row_number() OVER (PARTITION BY region_id, route_id, direction_id, stop_id ORDER BY datetime_60 DESC, stop_sequence DESC) AS rn FROM ps WHERE region_id IS NOT NULL),
z AS (SELECT region_id, route_id, direction_id, stop_id, avg(arrival_delay) AS m FROM q WHERE rn <= 2 GROUP BY 1, 2, 3, 4 HAVING count(*) = 2)
SELECT region_id, route_id, direction_id, stop_id, CAST(h AS INTEGER) AS prediction_hour_offset, TIMESTAMP '1999-06-15 08:00:00' + to_hours(h - 1) AS prediction_target_time, round(m, 1) AS predicted_delay_seconds FROM z, range(1, 4) r(h)""")
def _(t):
    d = score_regions(stage(status(t).where("region_id IS NOT NULL")), "1999-06-15 08:25:00", ["arrival_delay", "humidex"], n_in=2)
    return d.select("region_id", "route_id", "direction_id", "stop_id", "prediction_hour_offset", "prediction_target_time", F.round("predicted_delay_seconds", 1).alias("predicted_delay_seconds"))
