"""Set operations, orders and limits on the given tables."""

from pyspark.sql import functions as F

from headway.catalog.base import query, r6
from headway.operators import sets as se


@query("u01_union_distinct", "services exceptions", "SELECT service_id, start_date AS date FROM services UNION SELECT service_id, date FROM exceptions WHERE exception_type = 1")
def _(t):
    a = t.services.select("service_id", F.col("start_date").alias("date"))
    b = t.exceptions.where("exception_type = 1").select("service_id", "date")
    return se.union_distinct(a, b)


@query("u02_union_all", "", "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS bal FROM supplier UNION ALL SELECT c_custkey, c_name, NULL FROM customer")
def _(t):
    a = t.raw("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    b = t.raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return se.union_all([a, b])


@query("u03_except_keys", "trips exceptions", "SELECT DISTINCT service_id, start_date FROM trips WHERE (service_id, start_date) NOT IN (SELECT service_id, date FROM exceptions WHERE exception_type = 2)")
def _(t):
    gone = t.exceptions.where("exception_type = 2").select("service_id", F.col("date").alias("start_date"))
    return se.except_keys(t.trips.select("service_id", "start_date").distinct(), gone, ["service_id", "start_date"])


@query("u04_overlap", "upd", "SELECT stop_id, part_id FROM upd WHERE flag = 'A' INTERSECT SELECT stop_id, part_id FROM upd WHERE flag = 'R'")
def _(t):
    return se.overlap(t.upd.where("flag = 'A'"), t.upd.where("flag = 'R'"), ["stop_id", "part_id"])


@query("u05_distinct", "upd", "SELECT DISTINCT stop_id, stop_sequence, flag FROM upd")
def _(t):
    return se.distinct(t.upd, ["stop_id", "stop_sequence", "flag"])


@query("l01_order", "trips", "SELECT route_id, start_date, trip_id FROM trips ORDER BY route_id, start_date DESC, trip_id")
def _(t):
    return se.order(t.trips.select("route_id", "start_date", "trip_id"), ["route_id", F.desc("start_date"), "trip_id"])


@query("l02_latest_dates", "trips", "SELECT start_date, count(*) AS n, max(trip_id) AS latest FROM trips GROUP BY 1 ORDER BY latest DESC, start_date LIMIT 30")
def _(t):
    return se.latest(t.trips, ["start_date"], "trip_id", 30)


@query("l03_top_k", "upd", "SELECT trip_id, stop_sequence, price FROM upd ORDER BY price DESC, trip_id, stop_sequence LIMIT 15")
def _(t):
    return se.top_k(t.upd.select("trip_id", "stop_sequence", "price"), F.desc("price"), 15, ["trip_id", "stop_sequence"])


@query("l04_by_abs", "upd", "SELECT trip_id, stop_sequence, round(delay - pred + 1e-9, 6) AS err, price FROM upd")
def _(t):
    d = t.upd.select("trip_id", "stop_sequence", r6(F.col("delay") - F.col("pred")).alias("err"), "price")
    return se.by_abs(d, "err", ["trip_id", "stop_sequence", "price"])


@query("l05_sample_n", "", "SELECT event_id FROM events ORDER BY md5(event_id || '|7'), event_id LIMIT 100")
def _(t):
    return se.sample_n(t.raw("events").select("event_id"), ["event_id"], 100, 7)


@query("l06_latest_batches", "upd", "SELECT stop_id, count(*) AS n, max(feed_time) AS latest FROM upd GROUP BY 1 ORDER BY latest DESC, stop_id LIMIT 10")
def _(t):
    return se.latest(t.upd, ["stop_id"], "feed_time", 10)
