"""Sources, sinks and table maintenance on records derived from the given tables."""

from pyspark.sql import functions as F

from headway.catalog.base import query, r6, rounded
from headway.functions import clock as ck, geo
from headway.functions.encode import map_codes
from headway.functions.numbers import hash_text
from headway.operators import metrics as me, splits as sp
from headway.session import scratch_path
from headway.sinks import tables as tb
from headway.sources import readers as rd, snapshots as sn
from headway.sources.schemas import FEED


@query("s01_type_schedule", "upd", """SELECT DISTINCT CAST(trip_id AS VARCHAR) AS trip_id, stop_sequence, CAST((stop_sequence * 5 % 24) * 3600 + 61 AS INTEGER) AS arrival_secs, CAST(stop_sequence * 5 // 24 AS INTEGER) AS arrival_day_offset, 0 AS departure_day_offset FROM upd""")
def _(t):
    raw = t.upd.select(
        F.col("trip_id").cast("string"), F.format_string("%d:01:01", F.col("stop_sequence") * 5).alias("arrival_time"), F.lit("").alias("departure_time"),
        F.col("stop_sequence").cast("string").alias("stop_sequence"), F.lit("x").alias("unknown_column"),
    ).distinct()
    return rd.type_schedule("stop_times", raw).select("trip_id", "stop_sequence", "arrival_secs", "arrival_day_offset", "departure_day_offset")


@query("s02_parse_service_date", "trips", "SELECT trip_id, CASE WHEN direction_id = 0 THEN start_date END AS day FROM trips")
def _(t):
    text = F.when(F.col("direction_id") == 0, F.date_format("start_date", "yyyyMMdd")).otherwise("2025-1x")
    return t.trips.select("trip_id", ck.parse_service_date(text).alias("day"))


@query("s03_split_extended_time", "upd", """SELECT trip_id, stop_sequence, price, coalesce(CASE WHEN flag <> 'N' THEN (stop_sequence * 5 % 24) * 3600 + 1800 END, -1) AS tod, CASE WHEN flag <> 'N' THEN CAST(stop_sequence * 5 // 24 AS INTEGER) ELSE 0 END AS day_offset FROM upd""")
def _(t):
    text = F.when(F.col("flag") != "N", F.format_string("%d:30:00", F.col("stop_sequence") * 5)).otherwise("7h30")
    d = t.upd.withColumn("s", ck.split_extended_time(text))
    return d.select("trip_id", "stop_sequence", "price", F.coalesce("s.tod", F.lit(-1)).alias("tod"), "s.day_offset")


def _chunk(tag: str, body):
    """A length-delimited field of fewer than 128 bytes."""
    return F.concat(F.unhex(F.lit(tag)), F.unhex(F.lpad(F.hex(F.octet_length(body)), 2, "0")), body)


def _text(x):
    return F.encode(x.cast("string"), "utf-8")


def binary_entities(t, name=None):
    """A vehicle entity for each update, as the bytes of a feed message; ``name`` is the entity's id, if it is not null."""
    trip = _chunk("0A", _chunk("0A", _text(F.col("trip_id"))))
    seen = F.concat(trip, F.unhex(F.lit("18")), F.unhex(F.lpad(F.hex("stop_sequence"), 2, "0")), _chunk("3A", _text(F.col("stop_id"))))
    own = _chunk("0A", _text(F.lit("e1") if name is None else name))
    entity = _chunk("12", F.concat(F.coalesce(own, F.unhex(F.lit(""))), _chunk("22", seen)))
    header = _chunk("0A", _chunk("0A", F.encode(F.lit("2.0"), "utf-8")))
    return t.upd.select("trip_id", "price", "flag", F.concat(header, entity).alias("content"))


#: Messages of a file. A file is one record with all its entities, so their number bounds a task's memory, whatever the input.
MESSAGES = 20_000


def write_binary(t, path):
    """Files of feed messages: messages one behind the other are one message, parted here by a field that readers skip.

    An entity's id is the price of its update.
    """
    d = binary_entities(t, F.col("price").cast("string")).select(F.col("content").cast("string"))
    d.write.option("lineSep", "x\0").option("maxRecordsPerFile", MESSAGES).text(path)


def seen_vehicles(d):
    e = d.select("header", F.explode("entity").alias("e"))
    return e.select(
        F.col("e.vehicle.trip.trip_id").alias("trip"), F.col("e.vehicle.stop_id").alias("stop"), F.col("e.vehicle.current_stop_sequence").alias("stop_sequence"),
        F.col("header.gtfs_realtime_version").alias("version"), F.col("e.id").cast("double").alias("price"),
    )


@query("s05_decode_snapshots", "upd", "SELECT CAST(trip_id AS VARCHAR) AS trip, CAST(stop_id AS VARCHAR) AS stop, stop_sequence, '2.0' AS version, price FROM upd")
def _(t):
    path = scratch_path(t.spark, "binary")
    write_binary(t, path)
    return seen_vehicles(sn.read_snapshots(t.spark, f"{path}/part-*", "vehicle"))


@query("s05_damaged_snapshots", "upd", """SELECT flag, count(*) AS files, count(*) FILTER (WHERE flag <> 'N') AS entities, count(*) FILTER (WHERE flag <> 'A') AS errors FROM upd GROUP BY 1""")
def _(t):
    """Whole messages, messages with half an entity behind a whole one, and messages cut in their entity."""
    c = F.col("content")
    some = F.when(F.col("flag") == "A", c).when(F.col("flag") == "R", F.concat(c, F.unhex(F.lit("12300A0265")))).otherwise(F.substring(c, F.lit(1), F.length(c) - 2))
    files = binary_entities(t).select(F.col("flag").alias("path"), F.length("content").cast("long").alias("length"), some.alias("content"))
    d = sn.decode_files(files, "vehicle")
    return d.groupBy(F.col("file").alias("flag")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.size("entity")).alias("entities"), F.count("error").alias("errors"))


def snapshots(t):
    """One snapshot per lineitem row as JSON text read with the feed schema.

    Each has a trip update with one stop, a vehicle and a repeated entity id; some have no header.
    """
    u = t.upd.withColumn("uid", F.concat_ws("-", "trip_id", "stop_sequence", "price", "stop_id"))
    trip = F.struct(F.col("trip_id").cast("string").alias("trip_id"), F.col("part_id").cast("string").alias("route_id"), (F.col("stop_sequence") % 4).alias("schedule_relationship"))
    stop = F.struct(
        F.col("stop_sequence"), F.col("stop_id").cast("string").alias("stop_id"),
        F.when(F.col("flag") != "N", F.struct(F.col("delay").cast("int").alias("delay"), F.unix_timestamp(F.col("feed_time").cast("timestamp")).alias("time"))).alias("arrival"),
        F.when(F.col("flag") == "R", F.lit(1)).alias("schedule_relationship"),
    )
    update = F.struct(F.lit("a").alias("id"), F.struct(trip.alias("trip"), F.array(stop).alias("stop_time_update")).alias("trip_update"))
    seen = F.struct(
        F.lit("b").alias("id"),
        F.struct(trip.alias("trip"), F.struct(F.col("stop_id").cast("string").alias("id")).alias("vehicle"), F.col("stop_sequence").alias("current_stop_sequence"),
                 (F.col("stop_sequence") % 5).alias("current_status"), F.col("stop_id").cast("string").alias("stop_id")).alias("vehicle"),
    )
    en = F.array(F.struct(F.col("uid").alias("text")))
    alert = F.struct(
        F.lit("c").alias("id"),
        F.struct(F.struct(en.alias("translation")).alias("header_text"), F.struct(F.array(F.struct(F.lit("u").alias("text"), F.lit("fr").alias("language"))).alias("translation")).alias("url"),
                 F.array(F.struct(F.lit(5).alias("start"), F.lit(9).alias("end"))).alias("active_period"), F.lit("4").alias("effect")).alias("alert"),
    )
    header = F.when(F.col("status") == "O", F.struct(F.lit("2.0").alias("gtfs_realtime_version"), F.unix_timestamp(F.col("feed_time").cast("timestamp")).alias("timestamp")))
    again = F.struct(F.lit("a").alias("id"), F.lit(True).alias("is_deleted"))

    def text(e):
        return F.to_json(e)

    parts = F.concat(F.lit('{"entity":['), F.concat_ws(",", text(update), text(seen), text(alert), text(again)), F.lit("]"),
                     F.coalesce(F.concat(F.lit(',"header":'), F.to_json(header)), F.lit("")), F.lit("}"))
    # As a generator's output the records are made once: a filter on their header stays behind it.
    return u.select(F.lit("trip_updates").alias("feed_type"), F.col("uid").alias("file"), F.lit(1).cast("bigint").alias("file_size"), F.inline(F.array(F.from_json(parts, FEED))))


@query("s06_validate_snapshots", "upd", "SELECT status = 'O' AS valid, 4 AS n_entities, count(*) AS n FROM upd GROUP BY 1")
def _(t):
    d = sn.validate_snapshots(snapshots(t))
    return d.groupBy("valid", "n_entities").agg(F.count(F.lit(1)).alias("n"))


@query("s07_feed_entities", "upd", ", o AS (SELECT * FROM upd WHERE status = 'O') SELECT x.entity_id, x.entity_type, false AS is_deleted, count(*) AS n FROM o, (VALUES ('a', 'trip_update'), ('b', 'vehicle_position'), ('c', 'alert')) x(entity_id, entity_type) GROUP BY 1, 2")
def _(t):
    d = sn.normalize_snapshots(snapshots(t))["feed_entities"]
    return d.groupBy("entity_id", "entity_type", "is_deleted").agg(F.count(F.lit(1)).alias("n"))


@query("s07_stop_time_updates", "upd", """SELECT stop_sequence, CAST(stop_id AS VARCHAR) AS stop_id, CASE WHEN flag <> 'N' THEN delay END AS arrival_delay, CASE WHEN flag = 'R' THEN 'SKIPPED' ELSE 'SCHEDULED' END AS schedule_relationship, count(*) AS n FROM upd WHERE status = 'O' GROUP BY 1, 2, 3, 4""")
def _(t):
    d = sn.normalize_snapshots(snapshots(t))["stop_time_updates"]
    return d.groupBy("stop_sequence", "stop_id", F.col("arrival_delay").cast("double").alias("arrival_delay"), "schedule_relationship").agg(F.count(F.lit(1)).alias("n"))


@query("s07_trip_descriptors", "upd", "SELECT DISTINCT CAST(trip_id AS VARCHAR) AS trip_id, CAST(part_id AS VARCHAR) AS route_id, '20250101' AS start_date, 0 AS direction_id FROM upd WHERE status = 'O'")
def _(t):
    return sn.normalize_snapshots(snapshots(t))["trip_descriptors"].select("trip_id", "route_id", "start_date", "direction_id")


@query("s07_vehicle_positions", "upd", """SELECT current_stop_sequence, stop_id, current_status, count(*) AS n FROM (SELECT stop_sequence AS current_stop_sequence, CAST(stop_id AS VARCHAR) AS stop_id,
CASE stop_sequence % 5 WHEN 0 THEN 'INCOMING_AT' WHEN 1 THEN 'STOPPED_AT' ELSE 'IN_TRANSIT_TO' END AS current_status FROM upd WHERE status = 'O') GROUP BY 1, 2, 3""")
def _(t):
    d = sn.normalize_snapshots(snapshots(t))["vehicle_positions"]
    return d.groupBy("current_stop_sequence", "stop_id", "current_status").agg(F.count(F.lit(1)).alias("n"))


@query("s08_map_codes", "upd", "SELECT stop_sequence, CASE stop_sequence WHEN 1 THEN 'ADDED' WHEN 2 THEN 'UNSCHEDULED' WHEN 3 THEN 'CANCELED' WHEN 5 THEN 'REPLACEMENT' WHEN 6 THEN 'DUPLICATED' WHEN 7 THEN 'DELETED' ELSE 'SCHEDULED' END AS label, count(*) AS n FROM upd GROUP BY 1, 2")
def _(t):
    d = t.upd.withColumn("label", map_codes("stop_sequence", sn.TRIP_RELATIONSHIP, "SCHEDULED"))
    return d.groupBy("stop_sequence", "label").agg(F.count(F.lit(1)).alias("n"))


@query("s09_type_weather", "wx", "SELECT hour AS date_time_local, unixtime, round(temperature, 1) AS temperature, CASE WHEN cloud > 4 THEN NULL ELSE cloud END AS cloud_cover_8 FROM wx")
def _(t):
    text = t.wx.select(
        F.concat(F.date_format("hour", "yyyy-MM-dd HH:mm:ss"), F.when(F.col("cloud") > 4, " PDT").otherwise(" PST")).alias("date_time_local"),
        F.col("unixtime").cast("string").alias("unixtime"), F.col("temperature").cast("string").alias("temperature"),
        F.when(F.col("cloud") > 4, "n/a").otherwise(F.col("cloud").cast("string")).alias("cloud_cover_8"),
    )
    d = rd.type_weather(text)
    return d.select("date_time_local", "unixtime", F.col("temperature").cast("double"), F.col("cloud_cover_8").cast("double"))


@query("s10_station_obs", "stops", "SELECT stop_name AS stn_nam_value, round(stop_lon + 1e-9, 6) AS lon, round(stop_lat + 1e-9, 6) AS lat, CAST(stop_id AS DOUBLE) AS air_temp FROM stops")
def _(t):
    feature = F.struct(
        F.lit("Feature").alias("type"), F.col("stop_name").alias("id"),
        F.struct(F.lit("Point").alias("type"), F.array("stop_lon", "stop_lat").alias("coordinates")).alias("geometry"),
        F.create_map(F.lit("stn_nam-value"), F.col("stop_name"), F.lit("air_temp"), F.col("stop_id").cast("string")).alias("properties"),
    )
    doc = t.stops.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features"))).alias("j"))
    docs = doc.select(F.from_json("j", rd.STATION_OBS).alias("d")).select("d.*")
    obs = rd.station_columns(rd.flatten_features(docs), {"stn_nam-value": "string", "air_temp": "double"})
    return obs.select("stn_nam_value", r6(F.get("coordinates", F.lit(0))).alias("lon"), r6(F.get("coordinates", F.lit(1))).alias("lat"), "air_temp")


@query("s11_read_all", "", "SELECT n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def _(t):
    return rd.read_all(t.spark, f"{t.folder}/nation.parquet", text=("n_regionkey",))


REGION_NAMES = "CASE n_nationkey % 4 WHEN 0 THEN 'City of ' WHEN 1 THEN 'District of ' WHEN 2 THEN 'Village of ' ELSE '' END"


def region_names(t):
    n = F.col("n_nationkey")
    kind = F.when(n % 4 == 0, "City of ").when(n % 4 == 1, "District of ").when(n % 4 == 2, "Village of ").otherwise("")
    return t.raw("nation").withColumn("region_name", F.concat(kind, F.lit("Nation "), (n % 10).cast("string")))


@query("s12_match_regions", "", f"""WITH r AS (SELECT n_nationkey, {REGION_NAMES} || 'Nation ' || (n_nationkey % 10) AS region_name, 'nation_' || (n_nationkey % 10) AS slug,
CASE n_nationkey % 4 WHEN 0 THEN 'city' WHEN 1 THEN 'district' WHEN 2 THEN 'village' ELSE 'other' END AS region_type FROM nation), c AS (SELECT slug, count(*) AS n FROM r GROUP BY 1)
SELECT n_nationkey, region_name, region_type, CASE WHEN n > 1 THEN slug || '_' || region_type ELSE slug END AS region_id FROM r JOIN c USING (slug)""")
def _(t):
    names = region_names(t).select(F.col("n_nationkey").alias("idx"), "region_name")
    shapes = t.raw("nation").select(F.col("n_nationkey").alias("idx"), F.col("n_nationkey"))
    return rd.match_regions(names, shapes)


@query("s13_region_slug", "", "SELECT n_nationkey, 'nation_' || (n_nationkey % 10) AS slug FROM nation")
def _(t):
    return region_names(t).select("n_nationkey", geo.region_slug("region_name").alias("slug"))


@query("s14_region_type", "", "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'city' WHEN 1 THEN 'district' WHEN 2 THEN 'village' ELSE 'other' END AS kind FROM nation")
def _(t):
    return region_names(t).select("n_nationkey", geo.region_type("region_name").alias("kind"))


@query("s15_parse_wkt", "tiles", "SELECT region_id, round(xmin + 1e-9, 6) AS xmin, round(ymin + 1e-9, 6) AS ymin, round(xmax + 1e-9, 6) AS xmax, round(ymax + 1e-9, 6) AS ymax, 1 AS n_rings FROM tiles")
def _(t):
    pts = F.transform(F.get("rings", F.lit(0)), lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")))
    wkt = t.tiles.select("region_id", F.concat(F.lit("SRID=4326;POLYGON(("), F.array_join(pts, ", "), F.lit("))")).alias("w"))
    d = wkt.withColumn("r", geo.parse_wkt("w")).withColumn("b", geo.bbox("r"))
    return d.select("region_id", *[r6(f"b.{x}").alias(x) for x in ("xmin", "ymin", "xmax", "ymax")], F.size("r").alias("n_rings"))


@query("s16_scan", "", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (3, 7, 11) AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1999-01-01'")
def _(t):
    return rd.scan(t.spark, f"{t.folder}/orders.parquet", [3, 7, 11], "1996-01-01", "1999-01-01", ["o_orderkey", "o_custkey", "o_totalprice"], "o_custkey", "o_orderdate")


@query("s17_parse_lonlat", "stops", "SELECT stop_id, round(stop_lon + 1e-9, 6) AS lon, round(stop_lat + 1e-9, 6) AS lat FROM stops")
def _(t):
    d = t.stops.withColumn("p", geo.parse_lonlat(F.format_string("[%s, %s]", F.col("stop_lon").cast("string"), F.col("stop_lat").cast("string"))))
    return d.select("stop_id", r6("p.lon").alias("lon"), r6("p.lat").alias("lat"))


@query("s18_alert_text", "upd", "SELECT 'header_text' AS text_type, 'en' AS language, count(*) AS n FROM upd WHERE status = 'O' UNION ALL SELECT 'url', 'fr', count(*) FROM upd WHERE status = 'O'")
def _(t):
    d = sn.normalize_snapshots(snapshots(t))["alert_text"]
    return d.groupBy("text_type", "language").agg(F.count(F.lit(1)).alias("n"))


@query("s19_snapshots_to_json", "upd", "SELECT status = 'O' AS valid, 4 AS n_entities, count(*) AS n FROM upd GROUP BY 1")
def _(t):
    path = scratch_path(t.spark, "snapshots")
    sn.snapshots_to_json(snapshots(t), path)
    d = sn.validate_snapshots(sn.read_snapshots(t.spark, path, "trip_updates", "json"))
    return d.groupBy("valid", "n_entities").agg(F.count(F.lit(1)).alias("n"))


PAIR = ["trip_id", "stop_sequence"]


@query("k01_append", "upd", "SELECT trip_id, stop_sequence, price FROM upd")
def _(t):
    path, u = scratch_path(t.spark, "append"), t.upd.select(*PAIR, "price", "flag")
    for f in ("A", "R", "N"):
        tb.append(u.where(F.col("flag") == f).drop("flag"), path)
    return t.spark.read.parquet(path)


@query("k02_insert_new", "upd", """SELECT trip_id, stop_sequence, min(delay) FILTER (WHERE flag = 'A') AS delay FROM upd WHERE flag = 'A' GROUP BY 1, 2
UNION ALL SELECT trip_id, stop_sequence, min(delay) FROM upd WHERE (trip_id, stop_sequence) NOT IN (SELECT trip_id, stop_sequence FROM upd WHERE flag = 'A') GROUP BY 1, 2""")
def _(t):
    path, u = scratch_path(t.spark, "insert"), t.upd.select(*PAIR, "delay", "flag")
    tb.insert_new(u.where("flag = 'A'").drop("flag"), path, PAIR)
    for _i in range(2):
        tb.insert_new(u.drop("flag"), path, PAIR)
    return t.spark.read.parquet(path)


@query("k03_upsert_dimension", "", "SELECT c_nationkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_mktsegment END, 'UNKNOWN') AS label, 1 AS known FROM customer GROUP BY 1, 2")
def _(t):
    path = scratch_path(t.spark, "dimension")
    c = t.raw("customer").select("c_nationkey", F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("label"))
    for _i in range(2):
        tb.upsert_dimension(c, path, ["c_nationkey", "label"], "descriptor_id", {"label": "UNKNOWN"})
    return t.spark.read.parquet(path).select("c_nationkey", "label", F.col("descriptor_id").isNotNull().cast("int").alias("known"))


@query("k04_entities_once", "upd", "SELECT feed_time, trip_id, min(stop_id) AS stop_id FROM upd GROUP BY 1, 2")
def _(t):
    path = scratch_path(t.spark, "entities")
    e = t.upd.select("feed_time", "trip_id", "stop_id")
    for _i in range(2):
        tb.insert_new(e, path, ["feed_time", "trip_id"])
    return t.spark.read.parquet(path)


@query("k05_upsert", "", "SELECT o_custkey, CASE WHEN o_custkey % 2 = 0 THEN max(o_totalprice) ELSE min(o_totalprice) END AS price FROM orders GROUP BY 1")
def _(t):
    root, o = scratch_path(t.spark, "upsert"), t.raw("orders")
    tb.upsert(o.groupBy("o_custkey").agg(F.min("o_totalprice").alias("price")), root, ["o_custkey"])
    even = o.where(F.col("o_custkey") % 2 == 0)
    tb.upsert(even.groupBy("o_custkey").agg(F.max("o_totalprice").alias("price")), root, ["o_custkey"])
    return tb.current(t.spark, root)


@query("k06_append_new_timestamps", "wx", "SELECT hour, temperature FROM wx")
def _(t):
    path, w = scratch_path(t.spark, "hours"), t.wx.select("hour", "temperature")
    tb.append_new_timestamps(w.where("hour < '2024-01-15'"), path, "hour")
    tb.append_new_timestamps(w, path, "hour")
    return t.spark.read.parquet(path)


@query("k07_missing_hours", "wx", "SELECT CAST(least(greatest(CASE WHEN epoch(TIMESTAMP '2024-02-05 10:00:00') - 7200 - max(unixtime) <= 0 THEN 1 ELSE floor((epoch(TIMESTAMP '2024-02-05 10:00:00') - 7200 - max(unixtime)) / 3600) + 5 END, 1), 1000) AS INTEGER) AS rows FROM wx")
def _(t):
    return tb.missing_hours(t.wx, "2024-02-05 10:24:00")


@query("k08_complete_hours_only", "wx", "SELECT hour FROM wx WHERE hour <= TIMESTAMP '2024-01-20 11:00:00'")
def _(t):
    return tb.complete_hours_only(t.wx, "2024-01-20 12:40:00").select("hour")


@query("k09_write_with_metadata", "upd", "SELECT count(*) AS n_rows, 10 AS n_columns, 'baseline' AS model FROM upd")
def _(t):
    path = scratch_path(t.spark, "dataset")
    tb.write_with_metadata(t.upd, path, {"model": "baseline"})
    return t.spark.read.json(f"{path}_metadata").select("n_rows", F.col("n_columns").cast("int"), "model")


@query("k10_feature_store", "trips", "SELECT CAST(year(start_date) AS INTEGER) AS year, count(*) AS n FROM trips GROUP BY 1")
def _(t):
    path = scratch_path(t.spark, "features")
    tb.write_feature_store(t.trips.withColumn("year", F.year("start_date")), path, "year")
    return t.spark.read.parquet(path).groupBy("year").agg(F.count(F.lit(1)).alias("n"))


@query("k11_write_splits", "trips", """, d AS (SELECT DISTINCT start_date FROM trips), i AS (SELECT start_date, row_number() OVER (ORDER BY start_date) - 1 AS i, count(*) OVER () AS n FROM d),
s AS (SELECT trips.start_date, CASE WHEN i < floor(n * 0.7e0) THEN 'train' WHEN i < floor(n * 0.85e0) THEN 'valid' ELSE 'test' END AS split FROM trips JOIN i USING (start_date))
SELECT split, count(*) AS samples, CAST(min(start_date) AS VARCHAR) AS first_date, CAST(max(start_date) AS VARCHAR) AS last_date FROM s GROUP BY 1""")
def _(t):
    path = scratch_path(t.spark, "splits")
    tb.write_splits(sp.split_dates(t.trips, "start_date"), path)
    return t.spark.read.json(f"{path}_info")


@query("k12_stops_geojson", "stops", """, h AS (SELECT l_suppkey AS stop_id, array_to_string(list_sort(list(DISTINCT o_orderpriority)), '|') AS signs, count(DISTINCT c_mktsegment) AS n_routes FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1)
SELECT stop_id, stop_name, signs, CAST(n_routes AS INTEGER) AS n_routes, round(stop_lon + 1e-9, 6) AS lon FROM stops JOIN h USING (stop_id)""")
def _(t):
    from headway.plans.network import stop_labels

    routes = t.raw("customer").select(F.col("c_custkey").alias("route_id"), F.col("c_mktsegment").alias("route_long_name"))
    labels = stop_labels(t.stops, t.upd, t.trips.withColumnRenamed("headsign", "trip_headsign"), routes)
    j = tb.stops_geojson(labels)
    p = F.from_json("feature", "geometry struct<coordinates:array<double>>, properties struct<stop_name:string,trip_headsigns:array<string>,route_names:array<string>>")
    d = j.select("stop_id", p.alias("p"))
    return d.select("stop_id", "p.properties.stop_name", F.array_join("p.properties.trip_headsigns", "|").alias("signs"), F.size("p.properties.route_names").alias("n_routes"),
                    r6(F.get("p.geometry.coordinates", F.lit(0))).alias("lon"))


@query("k13_compare_models", "upd", "SELECT 'model' AS model_name, count(*) AS n, round(avg(abs(delay - pred)) + 1e-9, 6) AS mae FROM upd UNION ALL SELECT 'zero', count(*), round(avg(abs(delay)) + 1e-9, 6) FROM upd")
def _(t):
    path = scratch_path(t.spark, "evaluations")
    tb.save_eval(me.regression_metrics(t.upd, "delay", "pred"), path, "model", "{}")
    tb.save_eval(me.regression_metrics(t.upd.withColumn("zero", F.lit(0.0)), "delay", "zero"), path, "zero")
    return rounded(tb.compare_models(t.spark, path).select("model_name", "n", "mae"), "mae")


@query("k14_incremental", "obs", "SELECT route_id, stop_id, count(*) AS n, round(avg(delay) + 1e-9, 6) AS mean_delay, min(k) AS min_k, max(delay) AS max_delay FROM obs GROUP BY 1, 2")
def _(t):
    root = scratch_path(t.spark, "grouped")
    for upto in ("2024-01-10", "2024-01-11", "2024-01-20", "2100-01-01", "2100-01-01"):
        tb.refresh_groups(t.obs.where(F.col("ts") < upto), root, ["route_id", "stop_id"], "ts", ["delay"], ["k"], ["delay"])
    return rounded(tb.grouped(t.spark, root), "mean_delay")


@query("k14_refresh", "", "SELECT 'broken' AS view_name, 'failed' AS status, -1 AS rows_affected UNION ALL SELECT 'route_counts', 'success', count(DISTINCT o_custkey) FROM orders")
def _(t):
    root, log = scratch_path(t.spark, "views"), scratch_path(t.spark, "log")
    tb.refresh(t.spark, "route_counts", lambda: t.trips.groupBy("route_id").count(), root, log)
    tb.refresh(t.spark, "broken", lambda: t.trips.withColumn("x", F.raise_error(F.lit("no"))), root, log)
    return t.spark.read.parquet(log).select("view_name", "status", F.coalesce("rows_affected", F.lit(-1)).alias("rows_affected"))


@query("k15_refresh_status", "obs", """SELECT route_id AS view_name, max(ts) AS last_refresh_time, 'success' AS status, arg_max(obs_id, ts) AS rows_affected, round((epoch(TIMESTAMP '2024-02-01 00:00:00') - floor(epoch(max(ts)))) / 60, 1) AS minutes_since_refresh FROM obs GROUP BY 1""")
def _(t):
    log = t.obs.select(F.col("route_id").alias("view_name"), F.col("ts").alias("last_refresh_time"), F.lit("success").alias("status"), F.col("obs_id").alias("rows_affected"))
    return tb.refresh_status(log, "2024-02-01 00:00:00")


@query("k16_table_stats", "trips", "SELECT count(*) AS row_count, count(DISTINCT route_id) AS unique_routes, count(DISTINCT start_date) AS unique_dates, min(start_date) AS earliest_date, max(start_date) AS latest_date FROM trips")
def _(t):
    return tb.table_stats(t.trips)


@query("k16_row_counts", "", "SELECT 'orders' AS table_name, count(*) AS row_count FROM orders UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'customer', count(*) FROM customer")
def _(t):
    return tb.row_counts({n: t.raw(n) for n in ("orders", "events", "customer")})


@query("k17_monitor_counts", "obs", """SELECT route_id, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-20 11:00:00') AS last_hour, count(*) AS last_day, max(ts) AS latest FROM obs WHERE ts > TIMESTAMP '2024-01-19 12:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1""")
def _(t):
    return tb.monitor_counts(t.obs, "ts", "2024-01-20 12:00:00", ["route_id"])
