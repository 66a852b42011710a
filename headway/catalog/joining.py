"""Joins on the given tables."""

from pyspark.sql import functions as F

from headway.catalog.base import query, r6, rounded
from headway.functions.clock import hour_start
from headway.operators import joins as jo
from headway.operators.aggregates import mean_per
from headway.operators.fills import fill_across
from headway.operators.spatial import point_in_polygon


def feed_tables(t):
    """Normalized realtime tables in the shape of the feed, read from lineitem and orders."""
    li = t.raw("lineitem")
    msg = F.unix_timestamp(F.col("l_shipdate").cast("timestamp"))
    tu = F.concat_ws("-", "l_orderkey", msg)
    delay = ((F.col("l_quantity") - 25) * 300).cast("int")
    # The id of an update is made of the two others: they alone are shuffled to make the rows distinct.
    pairs = li.select("l_orderkey", msg.alias("feed_message_id")).distinct()
    per_trip = pairs.select(F.concat_ws("-", "l_orderkey", "feed_message_id").alias("trip_update_id"), "feed_message_id", F.col("l_orderkey").alias("trip_descriptor_id"))
    messages = li.select(msg.alias("feed_message_id")).distinct()
    return {
        "stop_time_updates": li.select(
            tu.alias("trip_update_id"), F.col("l_linenumber").alias("stop_sequence"), F.col("l_suppkey").alias("stop_id"),
            delay.alias("arrival_delay"), (msg + F.col("l_linenumber") * 600 + delay).alias("arrival_time"),
        ),
        "trip_updates": per_trip.select("trip_update_id", F.col("trip_update_id").alias("feed_entity_id"), "trip_descriptor_id"),
        "feed_entities": per_trip.select(F.col("trip_update_id").alias("feed_entity_id"), "feed_message_id"),
        "feed_messages": messages,
        "feed_headers": messages.select("feed_message_id", F.col("feed_message_id").alias("timestamp_seconds")),
        "trip_descriptors": t.trips.select(
            F.col("trip_id").alias("trip_descriptor_id"), "trip_id", "route_id", F.date_format("start_date", "yyyyMMdd").alias("start_date"), "direction_id"
        ),
    }


@query("j01_stop_updates_flat", "upd trips", """SELECT u.trip_id, u.stop_sequence, u.stop_id, t.route_id, CAST(epoch(feed_time) AS BIGINT) AS timestamp_seconds,
CAST((delay / 20) * 300 AS INTEGER) AS arrival_delay FROM upd u JOIN trips t USING (trip_id)""")
def _(t):
    return jo.stop_updates_flat(feed_tables(t)).select("trip_id", "stop_sequence", "stop_id", "route_id", "timestamp_seconds", "arrival_delay")


@query("j02_star_enrich", "upd trips", """SELECT u.trip_id, u.stop_sequence, u.delay, u.price, t.headsign, s.s_name, p.p_brand FROM upd u
JOIN trips t USING (trip_id) JOIN supplier s ON s_suppkey = stop_id JOIN part p ON p_partkey = part_id""")
def _(t):
    dims = [t.trips, t.raw("supplier").withColumnRenamed("s_suppkey", "stop_id"), t.raw("part").withColumnRenamed("p_partkey", "part_id")]
    d = jo.star_enrich(t.upd, dims, ["trip_id", "stop_id", "part_id"])
    return d.select("trip_id", "stop_sequence", "delay", "price", "headsign", "s_name", "p_brand")


STOP_TIMES = "st AS (SELECT trip_id, stop_sequence, min(stop_id) AS stop_id, CAST(stop_sequence * 600 + (trip_id % 48) * 1800 AS INTEGER) AS arrival_secs, CAST(trip_id % 2 AS INTEGER) AS arrival_day_offset FROM upd GROUP BY 1, 2)"


def _planned():
    """Scheduled seconds and day offset, which the trip and the sequence number fix."""
    secs = (F.col("stop_sequence") * 600 + (F.col("trip_id") % 48) * 1800).cast("int")
    return secs.alias("arrival_secs"), (F.col("trip_id") % 2).cast("int").alias("arrival_day_offset")


def stop_times(t):
    stops = t.upd.groupBy("trip_id", "stop_sequence").agg(F.min("stop_id").alias("stop_id"))
    return stops.select("trip_id", "stop_sequence", "stop_id", *_planned())


def positions(t):
    # Every update has its row in stop_times, but for those without a key.
    u = t.upd.na.drop(subset=["trip_id", "stop_sequence"]).select("*", *_planned())
    u = u.join(t.trips.select("trip_id", "start_date"), "trip_id")
    planned = F.unix_timestamp(F.col("start_date").cast("timestamp")) + F.col("arrival_secs") + F.col("arrival_day_offset") * 86400
    return u.select(
        F.col("trip_id").alias("trip_descriptor_id"), F.col("stop_sequence").alias("current_stop_sequence"), F.col("stop_id"),
        (planned + (F.col("delay") * 3).cast("int")).alias("timestamp_seconds"),
    )


def descriptors(t):
    return feed_tables(t)["trip_descriptors"]


POSITIONS = f"""{STOP_TIMES}, vp AS (SELECT u.trip_id, u.stop_sequence, CAST(epoch(CAST(t.start_date AS TIMESTAMP)) AS BIGINT) + st.arrival_secs + st.arrival_day_offset * 86400 + CAST(u.delay * 3 AS INTEGER) AS timestamp_seconds,
 t.route_id, t.direction_id, t.start_date, st.stop_id, st.arrival_secs, st.arrival_day_offset FROM upd u JOIN st USING (trip_id, stop_sequence) JOIN trips t USING (trip_id))"""


@query("j03_positions_on_schedule", "upd trips stops", f", {POSITIONS} SELECT trip_id, stop_sequence, stop_id, timestamp_seconds, stop_name FROM vp JOIN stops USING (stop_id)")
def _(t):
    d = jo.positions_on_schedule(positions(t), descriptors(t), stop_times(t), t.stops)
    return d.select("trip_id", "stop_sequence", "stop_id", "timestamp_seconds", "stop_name")


@query("j04_group_stat_back", "obs", """, g AS (SELECT route_id, hour_of_day, avg(delay) AS m FROM obs GROUP BY 1, 2 HAVING count(*) >= 80)
SELECT obs_id, delay, round(m + 1e-9, 6) AS mean_delay FROM obs LEFT JOIN g USING (route_id, hour_of_day)""")
def _(t):
    d = jo.group_stat_back(t.obs, ["route_id", "hour_of_day"], {"mean_delay": F.avg("delay")}, 80)
    return rounded(d.select("obs_id", "delay", "mean_delay"), "mean_delay")


@query("j05_with_weather", "obs wx", "SELECT obs_id, delay, hour AS datetime_60, temperature, cloud FROM obs JOIN wx ON date_trunc('hour', ts) = hour")
def _(t):
    w = t.wx.withColumnRenamed("hour", "datetime_60")
    return jo.with_weather(t.obs, w, "ts").select("obs_id", "delay", "datetime_60", "temperature", "cloud")


ALERTS = """al AS (SELECT event_id AS alert_id, ts, user_id AS route_id, CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 12 AS VARCHAR) AS cause,
 CASE WHEN value > 100 THEN 'UNKNOWN_EFFECT' ELSE CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS VARCHAR) END AS effect FROM events WHERE event_type = 'error')"""


def alert_tables(t):
    """Alert tables from error events: both spellings of text types, two periods, one entity."""
    e = t.raw("events").where("event_type = 'error'")
    k = F.get_json_object("props", "$.k").cast("int")
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    base = e.select(
        F.col("event_id").alias("alert_id"), (k % 12).cast("string").alias("cause"),
        F.when(F.col("value") > 100, "UNKNOWN_EFFECT").otherwise((k % 10).cast("string")).alias("effect"),
        F.lit("2").alias("severity_level"), F.col("ts").alias("created_at"),
    )
    entities = e.select(F.col("event_id").alias("alert_id"), F.col("user_id").alias("route_id"), F.lit(None).cast("string").alias("stop_id"),
                        F.lit("A").alias("agency_id"), F.lit(3).alias("route_type"))
    spans = F.array(F.struct(at.alias("s"), (at + 3600).alias("e")), F.struct((at + 7200).alias("s"), (at + 9000).alias("e")))
    periods = e.select(F.col("event_id").alias("alert_id"), F.inline(spans)).select("alert_id", F.col("s").alias("period_start"), F.col("e").alias("period_end"))
    texts = F.array(
        F.struct(F.lit("header_text").alias("text_type"), F.concat(F.lit("h"), "event_id").alias("text"), F.lit("en").alias("language")),
        F.struct(F.lit("description").alias("text_type"), F.concat(F.lit("d"), "event_id").alias("text"), F.lit(None).cast("string").alias("language")),
        F.struct(F.lit("url").alias("text_type"), F.lit("http").alias("text"), F.lit("fr").alias("language")),
    )
    text = e.select(F.col("event_id").alias("alert_id"), F.inline(texts))
    return {"alerts": base, "alert_informed_entities": entities, "alert_active_periods": periods, "alert_text": text}


@query("j06_alert_detail", "", f"""WITH {ALERTS} SELECT alert_id, cause, effect, route_id, 'h' || alert_id AS header_text, 'd' || alert_id AS description_text, CAST(NULL AS VARCHAR) AS url,
date_trunc('second', ts) AS active_period_start, date_trunc('second', ts) + INTERVAL 9000 SECOND AS active_period_end FROM al""")
def _(t):
    a = alert_tables(t)
    d = jo.alert_detail(a["alerts"], a["alert_informed_entities"], a["alert_active_periods"], a["alert_text"])
    return d.select("alert_id", "cause", "effect", "route_id", "header_text", "description_text", "url", "active_period_start", "active_period_end")


@query("j07_point_in_polygon", "cstops tiles", """SELECT stop_id, region_id FROM cstops LEFT JOIN tiles ON stop_lon >= xmin AND stop_lon < xmax AND stop_lat >= ymin AND stop_lat < ymax""")
def _(t):
    return point_in_polygon(t.cstops, t.tiles, "stop_lon", "stop_lat", ["region_id"]).select("stop_id", "region_id")


@query("j08_interval_join", "obs", """, p AS (SELECT DISTINCT stop_id, date_trunc('hour', ts) + INTERVAL 30 MINUTE AS target FROM obs)
SELECT o.obs_id, p.target FROM obs o LEFT JOIN p ON p.stop_id = o.stop_id AND p.target <= o.ts AND p.target + INTERVAL 1 HOUR > o.ts""")
def _(t):
    p = t.obs.select("stop_id", (hour_start("ts") + F.expr("INTERVAL 30 MINUTE")).alias("target")).distinct()
    return jo.interval_join(t.obs, p, ["stop_id"], "ts", "target").select("obs_id", "target")


CALENDAR = """days AS (SELECT service_id, CAST(unnest(generate_series(CAST(start_date AS TIMESTAMP), CAST(end_date AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS service_date,
 monday, tuesday, wednesday, thursday, friday, saturday, sunday FROM services), cal AS (SELECT service_date, service_id FROM days WHERE
 CASE isodow(service_date) WHEN 1 THEN monday WHEN 2 THEN tuesday WHEN 3 THEN wednesday WHEN 4 THEN thursday WHEN 5 THEN friday WHEN 6 THEN saturday ELSE sunday END = 1)"""


@query("j09_expand_calendar", "services", f", {CALENDAR} SELECT * FROM cal")
def _(t):
    return jo.expand_calendar(t.services)


@query("j10_anti_removed", "trips exceptions", "SELECT trip_id, start_date FROM trips t WHERE NOT EXISTS (SELECT 1 FROM exceptions e WHERE e.service_id = t.service_id AND e.date = t.start_date AND e.exception_type = 2)")
def _(t):
    gone = t.exceptions.where("exception_type = 2").select("service_id", F.col("date").alias("start_date"))
    return jo.anti(t.trips, gone, ["service_id", "start_date"]).select("trip_id", "start_date")


@query("j11_new_rows", "upd", """SELECT trip_id, stop_sequence, min(delay) AS delay FROM upd WHERE (trip_id, stop_sequence) NOT IN (SELECT trip_id, stop_sequence FROM upd WHERE flag = 'A') GROUP BY 1, 2""")
def _(t):
    u = t.upd.select("trip_id", "stop_sequence", "delay")
    return jo.new_rows(u, t.upd.where("flag = 'A'"), ["trip_id", "stop_sequence"])


@query("j12_exists_flag", "trips exceptions", "SELECT trip_id, CASE WHEN EXISTS (SELECT 1 FROM exceptions e WHERE e.date = t.start_date AND e.exception_type = 1) THEN 1 ELSE 0 END AS is_holiday FROM trips t")
def _(t):
    added = t.exceptions.where("exception_type = 1").select(F.col("date").alias("start_date"))
    return jo.exists_flag(t.trips, added, ["start_date"], "is_holiday").select("trip_id", "is_holiday")


@query("j13_semi", "trips exceptions", "SELECT trip_id FROM trips WHERE start_date IN (SELECT date FROM exceptions WHERE exception_type = 2)")
def _(t):
    days = t.exceptions.where("exception_type = 2").select(F.col("date").alias("start_date"))
    return jo.semi(t.trips, days, ["start_date"]).select("trip_id")


@query("j14_latest_batch", "upd", """, m AS (SELECT part_id, max(feed_time) AS feed_time FROM upd GROUP BY 1)
SELECT u.part_id, u.feed_time, u.trip_id, u.stop_sequence, u.price FROM upd u JOIN m USING (part_id, feed_time)""")
def _(t):
    return jo.latest_batch(t.upd, ["part_id"], "feed_time").select("part_id", "feed_time", "trip_id", "stop_sequence", "price")


CELL = ", c AS (SELECT trip_id, stop_sequence, max(delay) AS delay FROM upd GROUP BY 1, 2)"


@query("j15_previous_step", "upd", CELL + " SELECT c.trip_id, c.stop_sequence, c.delay, p.delay AS prev_delay FROM c LEFT JOIN c p ON p.trip_id = c.trip_id AND p.stop_sequence = c.stop_sequence - 1")
def _(t):
    c = t.upd.groupBy("trip_id", "stop_sequence").agg(F.max("delay").alias("delay"))
    return jo.previous_step(c, c, ["trip_id"], "stop_sequence", "delay", "prev_delay")


@query("j16_next_per_group", "upd", """, a AS (SELECT * FROM upd WHERE feed_time >= TIMESTAMP '1999-01-01'), m AS (SELECT stop_id, flag, min(feed_time) AS feed_time FROM a GROUP BY 1, 2)
SELECT a.stop_id, a.flag, a.feed_time, a.trip_id, a.price FROM a JOIN m USING (stop_id, flag, feed_time)""")
def _(t):
    return jo.next_per_group(t.upd, ["stop_id", "flag"], "feed_time", "1999-01-01 00:00:00").select("stop_id", "flag", "feed_time", "trip_id", "price")


@query("j17_fallback", "obs", """, a AS (SELECT stop_id, avg(delay) AS m FROM obs GROUP BY 1)
SELECT obs_id, round(coalesce(gappy, m) + 1e-9, 6) AS best FROM obs LEFT JOIN a USING (stop_id)""")
def _(t):
    d = t.obs.join(mean_per(t.obs, ["stop_id"], "delay", "m"), "stop_id", "left")
    return rounded(jo.fallback(d, "gappy", "m", "best").select("obs_id", "best"), "best")


@query("j18_nearest", "cstops stops", """, d AS (SELECT c.stop_id, s.stop_id AS near, sqrt((s.stop_lon - c.stop_lon) * (s.stop_lon - c.stop_lon) + (s.stop_lat - c.stop_lat) * (s.stop_lat - c.stop_lat)) AS dist FROM cstops c, stops s)
SELECT stop_id, round(min(dist) + 1e-9, 6) AS dist FROM d GROUP BY 1""")
def _(t):
    s = t.stops.select(F.col("stop_id").alias("sid"), F.col("stop_lon").alias("sx"), F.col("stop_lat").alias("sy"))
    d = jo.nearest(t.cstops, s, "stop_lon", "stop_lat", "sid", "sx", "sy", "near")
    return d.select("stop_id", r6("near_dist").alias("dist"))


@query("j18_nearest_grid", "cstops stops", """, d AS (SELECT c.stop_id, s.stop_id AS near, sqrt((s.stop_lon - c.stop_lon) * (s.stop_lon - c.stop_lon) + (s.stop_lat - c.stop_lat) * (s.stop_lat - c.stop_lat)) AS dist FROM cstops c, stops s)
SELECT stop_id, round(min(dist) + 1e-9, 6) AS dist FROM d GROUP BY 1""")
def _(t):
    s = t.stops.select(F.col("stop_id").alias("sid"), F.col("stop_lon").alias("sx"), F.col("stop_lat").alias("sy"))
    d = jo.nearest(t.cstops, s, "stop_lon", "stop_lat", "sid", "sx", "sy", "near", group=8)
    return d.select("stop_id", r6("near_dist").alias("dist"))


@query("j19_chain", "", """SELECT c_custkey, o_orderkey, l_linenumber, l_extendedprice, n_name FROM nation JOIN customer ON c_nationkey = n_nationkey
JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey""")
def _(t):
    n = t.raw("nation").withColumnRenamed("n_nationkey", "c_nationkey")
    o = t.raw("orders").withColumnRenamed("o_custkey", "c_custkey")
    li = t.raw("lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    d = jo.chain([n, t.raw("customer"), o, li], ["c_nationkey", "c_custkey", "o_orderkey"])
    return d.select("c_custkey", "o_orderkey", "l_linenumber", "l_extendedprice", "n_name")


@query("j20_expected_vs_actual", "upd", """, e AS (SELECT DISTINCT stop_id, flag FROM upd), a AS (SELECT stop_id, flag, count(*) AS n FROM upd WHERE delay > 450 GROUP BY 1, 2)
SELECT stop_id, flag, coalesce(n, 0) AS n, least(coalesce(n, 0), 5) AS shown FROM e LEFT JOIN a USING (stop_id, flag)""")
def _(t):
    return jo.expected_vs_actual(t.upd, t.upd.where("delay > 450"), ["stop_id", "flag"])


@query("j21_multi_mean", "upd", "SELECT stop_id, flag, round(avg(delay) + 1e-9, 6) AS delay, round(avg(pred) + 1e-9, 6) AS pred, round(avg(price) + 1e-9, 6) AS price FROM upd GROUP BY 1, 2")
def _(t):
    return rounded(jo.multi_mean(t.upd, ["stop_id", "flag"], ["delay", "pred", "price"], 9), "delay", "pred", "price")


@query("j22_lookup", "trips", ", f AS (SELECT route_id, min(headsign) AS first_sign FROM trips GROUP BY 1) SELECT trip_id, route_id, first_sign FROM trips LEFT JOIN f USING (route_id)")
def _(t):
    first = t.trips.groupBy("route_id").agg(F.min("headsign").alias("first_sign"))
    return jo.lookup(t.trips, first, ["route_id"], ["first_sign"]).select("trip_id", "route_id", "first_sign")


@query("j23_count_per_parent", "", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(t):
    o = t.raw("orders").withColumnRenamed("o_custkey", "c_custkey")
    return jo.count_per_parent(t.raw("customer").select("c_custkey"), o, ["c_custkey"])


@query("j24_back_merge", "upd", ", f AS (SELECT trip_id, avg(delay) AS trip_mean FROM upd GROUP BY 1) SELECT trip_id, stop_sequence, price, round(trip_mean + 1e-9, 6) AS trip_mean FROM upd LEFT JOIN f USING (trip_id)")
def _(t):
    feats = mean_per(t.upd, ["trip_id"], "delay", "trip_mean")
    return rounded(jo.back_merge(t.upd, feats, ["trip_id"]).select("trip_id", "stop_sequence", "price", "trip_mean"), "trip_mean")


@query("w17_fill_across", "upd", """, c AS (SELECT trip_id, stop_sequence, min(CASE WHEN delay > 0 THEN delay END) AS d FROM upd GROUP BY 1, 2)
SELECT trip_id, stop_sequence, coalesce(last_value(d IGNORE NULLS) OVER (PARTITION BY trip_id ORDER BY stop_sequence ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS d FROM c""")
def _(t):
    c = t.upd.groupBy("trip_id", "stop_sequence").agg(F.min(F.when(F.col("delay") > 0, F.col("delay"))).alias("d"))
    return fill_across(c, ["trip_id"], "stop_sequence", "d")
