import struct

import pytest
from pyspark.sql import functions as F

from headway.sources import readers as rd, snapshots as sn
from headway.sources.wire import decode, decode_feed


def varint(n):
    n &= (1 << 64) - 1
    out = b""
    while n > 0x7F:
        out += bytes([n & 0x7F | 0x80])
        n >>= 7
    return out + bytes([n])


def part(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    body = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(body)) + body


def feed():
    header = part(1, "2.0") + part(3, 1_700_000_000)
    stop = part(1, 7) + part(2, part(1, -90) + part(2, 1_700_000_100)) + part(4, "S7") + part(99, "ignored")
    update = part(1, part(1, "T1") + part(3, "20250102") + part(5, "R1")) + part(2, stop) + part(2, part(1, 8))
    seen = part(1, part(1, "T1")) + part(2, part(1, 49.25) + part(2, -123.0)) + part(3, 7) + part(4, 1) + part(5, 1_700_000_050)
    alert = part(1, part(1, 5) + part(2, 9)) + part(5, part(2, "R1")) + part(6, 10) + part(10, part(1, part(1, "Détour") + part(2, "en")))
    ents = [part(1, "a") + part(3, update), part(1, "b") + part(4, seen), part(1, "c") + part(5, alert), part(1, "a") + part(3, update)]
    return part(1, header) + b"".join(part(2, e) for e in ents)


def test_decode():
    d = decode(feed())
    assert d["header"]["timestamp"] == 1_700_000_000
    stop = d["entity"][0]["trip_update"]["stop_time_update"][0]
    assert stop["arrival"]["delay"] == -90 and stop["stop_id"] == "S7" and stop["departure"] is None
    assert d["entity"][2]["alert"]["cause"] == "10"
    with pytest.raises((ValueError, IndexError)):
        decode(feed()[:-3])


def test_damaged_feeds_keep_what_comes_before():
    whole = decode_feed(feed())
    assert whole["error"] is None and len(whole["entity"]) == 4
    for cut in range(1, len(feed())):
        got = decode_feed(feed()[:cut])
        assert got["entity"] == whole["entity"][: len(got["entity"])] and (got["error"] or got["header"]) is not None
    cut = decode_feed(feed()[:-3])
    assert cut["entity"] == whole["entity"][:3] and "after 3 entities" in cut["error"] and cut["header"] == whole["header"]
    inner = decode_feed(feed() + part(2, part(1, "x") + b"\x1a\x7f") + part(2, part(1, "z")))
    assert [e["id"] for e in inner["entity"]] == ["a", "b", "c", "a", "z"] and "entity in field 6" in inner["error"]
    assert decode_feed(b"") == {"header": None, "entity": [], "error": None}


def test_snapshot_stream(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for i, data in enumerate((feed(), feed()[:-3])):
        (source / f"{i}.pb").write_bytes(data)
        q = sn.stream_snapshots(spark, str(source), "vehicle").select("file", F.size("entity").alias("n"), "error").writeStream.format("parquet")
        q = q.option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {r.file[-4:]: (r.n, r.error is None) for r in spark.read.parquet(out).collect()}
    assert got == {"0.pb": (4, True), "1.pb": (3, False)} and spark.read.parquet(out).count() == 2


def test_snapshot_files(spark, tmp_path):
    (tmp_path / "one.pb").write_bytes(feed())
    (tmp_path / "bad.pb").write_bytes(b"\x0a\xff\xff")
    snaps = sn.read_snapshots(spark, str(tmp_path), "trip_updates")
    flags = {r.file.split("/")[-1]: (r.valid, r.n_entities) for r in sn.validate_snapshots(snaps).collect()}
    assert flags == {"one.pb": (True, 4), "bad.pb": (False, 0)}
    t = sn.normalize_snapshots(snaps)
    assert t["feed_entities"].count() == 3
    rows = {r.stop_sequence: r for r in t["stop_time_updates"].collect()}
    assert rows[7].arrival_delay == -90 and rows[8].arrival_delay is None and rows[8].schedule_relationship == "SCHEDULED"
    v = t["vehicle_positions"].first()
    assert v.current_status == "STOPPED_AT" and v.latitude == 49.25
    assert t["trip_descriptors"].count() == 2
    a = t["alert_active_periods"].first()
    assert (a.period_start, a.period_end) == (5, 9)
    assert t["alert_text"].first().text == "Détour"
    again = str(tmp_path / "json")
    sn.snapshots_to_json(snaps.where("header IS NOT NULL"), again)
    assert sn.normalize_snapshots(sn.read_snapshots(spark, again, "trip_updates", "json"))["feed_entities"].count() == 3


def test_schedule_folder(spark, tmp_path):
    files = {
        "agency": "agency_id,agency_name\n1,A\n", "stops": "stop_id,stop_lat,stop_lon,extra\nS1,49.2,-123.1,x\n",
        "routes": "route_id\nR1\n", "trips": "trip_id,route_id,service_id\nT1,R1,W\n",
        "stop_times": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\nT1,25:35:00,,S1,1\nT1,bad,08:00:00,S1,2\n",
        "calendar_dates": "service_id,date,exception_type\nW,20250101,1\n",
    }
    for n, text in files.items():
        (tmp_path / f"{n}.txt").write_text(text)
    t = rd.read_schedule(spark, str(tmp_path))
    assert "calendar" not in t and "calendar_dates" in t
    rows = {r.stop_sequence: r for r in t["stop_times"].collect()}
    assert (rows[1].arrival_secs, rows[1].arrival_day_offset, rows[1].departure_secs) == (5700, 1, None)
    assert rows[2].arrival_secs is None and rows[2].departure_secs == 28800
    assert float(t["stops"].first().stop_lat) == 49.2
    (tmp_path / "trips.txt").rename(tmp_path / "was.txt")
    with pytest.raises(FileNotFoundError):
        rd.read_schedule(spark, str(tmp_path))


def test_weather_csv(spark, tmp_path):
    (tmp_path / "w.csv").write_text("date_time_local,unixtime,temperature,wind_speed\n2025-01-02 03:00:00 PST,10,4.56,n/a\nbroken,x,,7\n")
    rows = rd.read_weather(spark, str(tmp_path / "w.csv")).collect()
    assert float(rows[0].temperature) == 4.6 and rows[0].wind_speed is None and str(rows[0].date_time_local) == "2025-01-02 03:00:00"
    assert rows[1].date_time_local is None and rows[1].unixtime is None and rows[1].wind_speed == 7


def test_regions(spark, tmp_path):
    (tmp_path / "r.csv").write_text("name,lat,lon\nCity of North Vancouver,49.3,-123.0\nDistrict of North Vancouver,49.4,-123.1\n")
    ring = "[[[0,0],[1,0],[1,1],[0,0]]]"
    feat = ",".join(f'{{"type":"Feature","geometry":{{"type":"Polygon","coordinates":{ring}}}}}' for _ in range(2))
    (tmp_path / "r.geojson").write_text(f'{{"type":"FeatureCollection","features":[{feat}]}}')
    got = rd.read_regions(spark, str(tmp_path / "r.csv"), str(tmp_path / "r.geojson"))
    assert {r.region_id for r in got.collect()} == {"north_vancouver_city", "north_vancouver_district"}
    (tmp_path / "r2.csv").write_text("name,lat,lon\nOne,1,2\n")
    with pytest.raises(ValueError):
        rd.read_regions(spark, str(tmp_path / "r2.csv"), str(tmp_path / "r.geojson"))


def test_read_all_merges(spark, tmp_path):
    spark.range(2).select(F.col("id"), F.lit(20250101).alias("start_date")).write.parquet(str(tmp_path / "d" / "a"))
    spark.range(3).select(F.col("id"), F.lit("x").alias("more"), F.lit(20250102).alias("start_date")).write.parquet(str(tmp_path / "d" / "b"))
    d = rd.read_all(spark, str(tmp_path / "d" / "*"))
    assert d.count() == 5 and dict(d.dtypes)["start_date"] == "string" and "more" in d.columns


def test_scan_parses_dates_and_converts_zones(spark, tmp_path):
    rows = [("a", "2024-07-01 12:30:00", 1), ("b", "no date", 2), ("c", None, 3)]
    spark.createDataFrame(rows, "route_id string, seen string, n int").write.parquet(f"{tmp_path}/t")
    got = rd.scan(spark, f"{tmp_path}/t", columns=["route_id", "seen"], parse_dates=["seen"], zone="America/Vancouver")
    assert [str(r.seen) for r in got.orderBy("route_id").collect()] == ["2024-07-01 05:30:00", "None", "None"]


def test_grid_span_bounds_every_key(spark):
    from headway.operators.fills import regular_grid

    rows = spark.sql("SELECT * FROM VALUES (1, timestamp_ntz'2024-01-01 10:05:00', 2.0), (1, timestamp_ntz'1970-01-01 00:00:00', 9.0), (2, timestamp_ntz'2024-01-01 10:50:00', 4.0) AS t(k, ts, x)")
    got = regular_grid(rows, ["k"], "ts", 900, "x", ("2024-01-01 10:00:00", "2024-01-01 11:00:00"))
    assert got.count() == 10 and got.where("observed").count() == 2
