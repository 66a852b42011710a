"""Steps whose cost must not follow the rows in the wrong place."""

from pyspark.sql import Window, functions as F

from headway.catalog import QUERIES, joining as jn, views
from headway.catalog.base import Tables
from headway.operators import fills as fi, joins as jo, learning as le, sequences as sq, spans, splits as sp, windows as wi
from headway.plans import realtime as rt
from headway.sources import snapshots as sn
from headway.sources.schemas import FEED


def test_hash_slices_are_bounded(spark):
    d = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") * 1.5).alias("x"))
    plan = sp.split_random(d, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "1, 3)" in plan and "1, 5)" not in plan and spans.HASH_DIGITS == 3
    assert sp.split_random(d, ["k"], 0.75).where("split = 'train'").count() == 1500


def test_permuted_copies_do_not_broadcast_rows(spark):
    d = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 1.5).alias("x"))
    out = le.permuted_copies(d, ["x"], ["k"], 2)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan and out.count() == 100
    assert sorted(r.x for r in out.where("_repeat = 1").collect()) == sorted(r.x for r in d.collect())


def test_trees_are_grown_on_all_cores(spark, monkeypatch):
    monkeypatch.setattr(le, "SPREAD", 10)
    parts = []

    class Fit:
        def fit(self, rows):
            parts.append(rows.select(F.spark_partition_id()).distinct().count())

    rows = spark.range(0, 800, 1, 1).select(F.col("id").cast("double").alias(le.LABEL))
    le._on_cached(lambda f: Fit(), rows, True)
    le._on_cached(lambda f: Fit(), rows)
    assert parts == [spark.sparkContext.defaultParallelism, 1]


def records(spark):
    texts = [
        '{"header":{"timestamp":5},"entity":[{"id":"a","trip_update":{"trip":{"trip_id":"t1","route_id":"r"},"vehicle":{"id":"v1"}},"vehicle":{"trip":{"trip_id":"no"}}},'
        '{"id":"b","vehicle":{"trip":{"trip_id":"t2"},"vehicle":{"id":"v2"}}},{"id":"c","alert":{"effect":"4"}},{"id":"d","trip_update":{}}]}',
        '{"entity":[{"id":"x","vehicle":{"trip":{"trip_id":"without header"}}}]}',
    ]
    d = spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "file string, t string")
    return d.select(F.lit("vehicle").alias("feed_type"), "file", F.lit(1).cast("bigint").alias("file_size"), F.from_json("t", FEED).alias("j")).select("feed_type", "file", "file_size", "j.*")


def test_descriptors_come_from_one_pass(spark):
    out = sn.normalize_snapshots(records(spark))
    assert {r.trip_id for r in out["trip_descriptors"].collect()} == {"t1", "t2", "UNKNOWN"}
    assert {r.vehicle_id for r in out["vehicle_descriptors"].collect()} == {"v1", "v2", "UNKNOWN"}
    assert "Union" not in out["trip_descriptors"]._jdf.queryExecution().optimizedPlan().toString()


def test_json_snapshots_are_compressed_and_read_back(spark, tmp_path):
    path = str(tmp_path / "j")
    sn.snapshots_to_json(records(spark), path)
    assert list((tmp_path / "j").glob("part-*.snappy"))
    got = sn.validate_snapshots(sn.read_snapshots(spark, path, "vehicle", "json")).groupBy("valid", "n_entities").count().collect()
    assert {(r.valid, r.n_entities, r["count"]) for r in got} == {(True, 4, 1), (False, 1, 1)}


def test_grid_comes_dealt_by_key(spark):
    """Known values are gathered by key before the steps are spread out: the grid is neither joined nor shuffled."""
    rows = [("a", "2024-01-01 00:01:00", 1.0), ("a", "2024-01-01 00:02:00", 3.0), ("a", "2024-01-02 00:00:00", None), ("b", "2024-01-02 20:01:00", 5.0),
            ("c", None, 7.0), (None, "2024-01-01 00:01:00", 9.0)]
    d = spark.createDataFrame(rows, "k string, t string, x double").select("k", F.col("t").cast("timestamp_ntz").alias("t"), "x")
    grid = fi.regular_grid(d, ["k"], "t", 900, "x")
    filled = fi.ffill(grid, ["k"], [F.col("t")], None, "x", 2, 0.0)
    plan = filled._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and grid.columns == ["k", "t", "x", "observed"]
    steps = 44 * 4 + 1
    assert {r.k: r["count"] for r in grid.groupBy("k").count().collect()} == {"a": steps, "b": steps, "c": steps, None: steps}
    known = {(r.k, str(r.t), r.x) for r in grid.where("observed").collect()}
    assert known == {("a", "2024-01-01 00:00:00", 2.0), ("b", "2024-01-02 20:00:00", 5.0)}
    assert [r.x for r in filled.where("k = 'a'").orderBy("t").limit(4).collect()] == [2.0, 2.0, 2.0, 0.0]
    assert fi.grid_steps(d, "t", 900).count() == steps and fi.grid_steps(d.limit(0), "t", 900).count() == 0


def test_range_means_run_over_no_sliding_frame(spark):
    """A frame of very many rows is two running sums: the same means, and no frame that starts at an offset."""
    rows = [(i, "ab"[i % 2] if i % 7 else None, None if i % 11 == 0 else i * 977 % 9000, None if i % 5 == 0 else i * 1.25) for i in range(300)]
    rows += [(1000, "a", 3600, 1.0), (1001, "a", 60, 2.0), (1002, "a", 7140, 4.0), (1003, "a", 0, float("nan"))]
    d = spark.createDataFrame(rows, "id long, k string, s long, x double").withColumn("t", F.timestamp_seconds("s").cast("timestamp_ntz"))
    w = Window.partitionBy("k").orderBy(F.unix_micros(F.col("t").cast("timestamp"))).rangeBetween(-3600_000_000, -60_000_000)
    got = wi.range_trend(d, ["k"], "t", "x")
    assert "RangeFrame, -" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.columns == [*d.columns, "trend"]

    def means(f, name):
        return sorted((r.id, str(r[name])) for r in f.select("id", F.round(name, 9).alias(name)).collect())

    assert means(got, "trend") == means(d.withColumn("trend", F.avg("x").over(w)), "trend")


def test_history_lengths_share_the_vectors_of_trips(spark, monkeypatch):
    calls, real = [], sq.trip_vectors
    for m in (sq, le):
        monkeypatch.setattr(m, "trip_vectors", lambda *a, **k: calls.append(1) or real(*a, **k), raising=False)
    rows = [(1, trip, trip * 100 + s, s, float(trip * s)) for trip in range(6) for s in (1, 2)]
    d = spark.createDataFrame(rows, "route long, trip long, t long, seq int, delay double").withColumn("t", F.timestamp_seconds("t").cast("timestamp_ntz"))
    got = {r.n_past: r for r in le.length_experiment(d, (2, 3), "route", "trip", "t", "seq", "delay").collect()}
    assert len(calls) == 1 and {k: r.n for k, r in got.items()} == {2: 8, 3: 6}
    assert abs(got[2].mae - 2.25) < 1e-9 and abs(got[3].mae - 3.0) < 1e-9


def test_snapshots_are_parsed_once(spark, tmp_path):
    row = (1, 2, 3, 1, 30.0, 9.5, 0.05, 0.0, "R", "O")
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    d = spark.createDataFrame([row, (*row[:9], "F")], names).withColumn("l_shipdate", F.lit("1998-01-01").cast("timestamp_ntz"))
    d.write.parquet(str(tmp_path / "lineitem.parquet"))
    out = QUERIES["s07_stop_time_updates"](spark, str(tmp_path))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert [tuple(r) for r in out.collect()] == [(1, "3", 100.0, "SKIPPED", 1)]


def test_the_newest_batch_needs_no_join(spark):
    d = spark.createDataFrame([("a", 1, 1, "x"), ("a", 1, 2, "y"), ("a", 1, 2, "z"), ("b", 2, 1, "u"), (None, 2, 9, "null key"), ("b", 2, None, "no time")], "k string, l int, at int, v string")
    out = jo.latest_batch(d, ["k", "l"], "at")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "WindowGroupLimit" in plan and out.columns == d.columns
    assert sorted(r.v for r in out.collect()) == ["u", "y", "z"]


def updates(spark, tmp_path):
    """Three trips with repeated, unkeyed and unmatched updates."""
    day = "timestamp_ntz'1998-01-02 00:00:00'"
    spark.sql(f"SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS BIGINT) AS l_partkey, CAST(7 AS BIGINT) AS l_suppkey, {day} + make_dt_interval(late) AS l_shipdate, CAST(26 AS DOUBLE) AS l_quantity, 0.05D AS l_discount, "
              "1.0D AS l_extendedprice, 'A' AS l_returnflag, 'O' AS l_linestatus FROM VALUES (1L, 1, 0), (1L, 1, 0), (1L, 1, 1), (1L, 2, 0), (2L, 1, 0), (2L, NULL, 0), (NULL, 3, 0), (9L, 1, NULL) AS t(l_orderkey, l_linenumber, late)"
              ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql(f"SELECT o_orderkey, 4L AS o_custkey, {day} AS o_orderdate, 'LOW' AS o_orderpriority FROM VALUES (1L), (2L), (2L), (3L) AS t(o_orderkey)").write.parquet(f"{tmp_path}/orders.parquet")
    return Tables(spark, str(tmp_path))


def test_updates_are_told_apart_by_two_numbers(spark, tmp_path):
    d = jn.feed_tables(updates(spark, tmp_path))
    for name in ("trip_updates", "feed_entities"):
        plan = d[name]._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate [l_orderkey" in plan and d[name].count() == d[name].distinct().count() == 5
    assert {r.trip_update_id for r in d["trip_updates"].where("trip_descriptor_id = 1").collect()} == {"1-883699200", "1-883785600"}
    flat = jo.stop_updates_flat(d)._jdf.queryExecution().optimizedPlan().toString()
    assert flat.count("Join Inner") == 5 and flat.index("o_orderkey") > flat.index("trip_update_id")


def test_positions_are_not_joined_to_their_own_updates(spark, tmp_path):
    t = updates(spark, tmp_path)
    out = jn.positions(t)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    u = t.upd.join(jn.stop_times(t).drop("stop_id"), ["trip_id", "stop_sequence"]).join(t.trips.select("trip_id", "start_date"), "trip_id")
    planned = F.unix_timestamp(F.col("start_date").cast("timestamp")) + F.col("arrival_secs") + F.col("arrival_day_offset") * 86400
    want = u.select("trip_id", "stop_sequence", "stop_id", planned + (F.col("delay") * 3).cast("int"))
    assert out.exceptAll(want).count() == want.exceptAll(out).count() == 0 and out.count() == 6


def test_analytics_rows_are_written_once_without_their_stops(spark):
    at = "timestamp_ntz'2024-01-01 08:10:00'"
    base = spark.sql(f"SELECT * FROM VALUES (1, 1, 'r', 0, 's', '20240101', {at}, 10), (1, 2, 'r', 0, 's', '20240101', {at}, 30), (2, 1, 'r', 0, 'gone', '20240101', {at}, 500), (3, 1, 'q', 0, 's', '20240101', {at}, 7) AS t(trip_id, stop_sequence, route_id, direction_id, stop_id, start_date, actual_arrival_time, arrival_delay)")
    routes = spark.sql("SELECT * FROM VALUES ('r', 'R'), ('q', 'Q') AS t(route_id, route_short_name)")
    trips = spark.sql("SELECT id AS trip_id, 'h' AS trip_headsign FROM range(1, 4)")
    geo = ", ".join(f"0.0D AS {x}" for x in ("stop_lat", "stop_lon", *rt.GEO))
    # A stop that stands twice doubles its rows, also in the count of the group.
    stops = spark.sql(f"SELECT 's' AS stop_id, n AS stop_name, 'z' AS region_id, {geo} FROM VALUES ('one'), ('two') AS t(n)")
    times = spark.sql("SELECT trip_id, stop_sequence, 60 AS arrival_secs FROM range(1, 4) t(trip_id), range(1, 3) s(stop_sequence)")
    kept = []

    def store(d):
        kept.append(d.columns)
        return d

    got = {}
    for how in (None, store):
        out = rt.analytics(base, routes, trips, stops, times, "UTC", 3, how)
        got[how] = sorted((r.trip_id, r.stop_sequence, r.stop_name, r.hour_of_day, r.delay_mean_by_route_hour) for r in out.collect())
    want = [(1, s, n, 8, 20.0) for s in (1, 2) for n in ("one", "two")] + [(3, 1, n, 8, None) for n in ("one", "two")]
    assert got[None] == got[store] == want
    assert len(kept) == 1 and "stop_name" not in kept[0]


def test_boards_store_only_what_they_read(spark, monkeypatch):
    stored = {}
    monkeypatch.setattr(views, "stage", lambda d, label="stage": stored.setdefault(label, d))
    QUERIES["v14_route_timetable"](spark, "/root/testdata/sf0.001")
    assert "seen" not in stored and "stops" in stored
    QUERIES["v13_stop_board"](spark, "/root/testdata/sf0.001")
    assert len(stored["seen"].columns) == 6
