"""Keyed tables: replacement by key, cost by batch, growing parts, replay; and the live table on top."""

import pathlib
import random

import pytest
from pyspark.sql import functions as F

from headway.sinks import keyed, tables as tb
from headway.streaming import jobs as st


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(keyed, "LIMIT", 100)
    monkeypatch.setattr(keyed, "LEAST", 20)


def files(root):
    return {p: p.stat().st_size for p in pathlib.Path(root).rglob("*.parquet")}


def table(spark, root):
    return dict(map(tuple, tb.current(spark, root).select("k", "v").collect()))


def test_replaces_and_keeps(spark, tmp_path):
    root = str(tmp_path / "u")
    assert tb.current(spark, root) is None
    tb.upsert(spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string"), root, ["k"])
    tb.upsert(spark.createDataFrame([(2, "z"), (3, "c"), (None, "m")], "k int, v string"), root, ["k"])
    assert table(spark, root) == {1: "a", 2: "z", 3: "c", None: "m"}
    n = tb.upsert(spark.createDataFrame([], "k int, v string"), root, ["k"])
    assert n == 2 == tb.upsert(spark.range(0).selectExpr("cast(id as int) k", "'x' v"), root, ["k"])
    with pytest.raises(ValueError):
        tb.upsert(spark.createDataFrame([(2, "z")], "k int, v string"), root, ["v"])
    tb.write_version(spark.createDataFrame([(9, "w")], "k int, v string"), root)
    assert table(spark, root) == {9: "w"}
    tb.upsert(spark.createDataFrame([(9, "y"), (8, "x")], "k int, v string"), root, ["k"])
    assert table(spark, root) == {9: "y", 8: "x"}


def test_many_batches_equal_a_dictionary(spark, tmp_path, small):
    root, rng, want = str(tmp_path / "u"), random.Random(3), {}
    for i in range(10):
        rows = {rng.randrange(700): f"{i}" for _ in range(rng.choice([1, 5, 60, 150]))}
        want |= rows
        tb.upsert(spark.createDataFrame(list(rows.items()), "k long, v string").coalesce(1), root, ["k"])
        if i % 4 == 3:
            assert table(spark, root) == want
    m = keyed.newest(spark, root)
    assert table(spark, root) == want and len(m["parts"]) > 2
    assert sorted(b for p in m["parts"] for b in keyed._buckets(p, keyed._depth(m))) == keyed._buckets("", keyed._depth(m))
    assert max(x["rows"] for x in m["parts"].values()) <= 2 * keyed.LIMIT
    assert len(m["changes"]) <= 6 and len(keyed.states(spark, root)) == keyed.KEEP


def test_cost_follows_the_batch(spark, tmp_path, small):
    """Rows written by 8 batches of 10 keys are about the same on tables of 1,000 and of 4,000 rows."""
    cost = {}
    for size in (1000, 4000):
        root = str(tmp_path / f"t{size}")
        tb.upsert(spark.range(size).selectExpr("id AS k", "'old' AS v").coalesce(1), root, ["k"])
        seen, written = set(files(root)), 0
        for i in range(8):
            rows = [(j * 97 % size, f"{i}") for j in range(i * 10, i * 10 + 10)]
            tb.upsert(spark.createDataFrame(rows, "k long, v string").coalesce(1), root, ["k"])
            new = set(files(root)) - seen
            seen |= new
            written += sum(spark.read.parquet(str(p)).count() for p in new)
        cost[size] = written
    assert cost[4000] <= 1.5 * cost[1000] and cost[4000] < 8 * 10 * 8


def test_replay_adds_nothing(spark, tmp_path):
    root = str(tmp_path / "r")
    d = spark.createDataFrame([(1, "a")], "k int, v string")
    n = tb.upsert(d, root, ["k"], ("job", 4))
    before = files(root)
    assert tb.upsert(d.withColumn("v", F.lit("again")), root, ["k"], ("job", 4)) == n and files(root) == before
    assert tb.upsert(d.withColumn("v", F.lit("b")), root, ["k"], ("other", 0)) == n + 1
    assert table(spark, root) == {1: "b"}


def test_a_failed_upsert_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "f")
    tb.upsert(spark.createDataFrame([(1, "a")], "k int, v string"), root, ["k"])
    with pytest.raises(Exception):
        tb.upsert(spark.range(3).select(F.col("id").cast("int").alias("k"), F.raise_error(F.lit("no")).cast("string").alias("v")), root, ["k"])
    assert table(spark, root) == {1: "a"}
    tb.upsert(spark.createDataFrame([(1, "b")], "k int, v string"), root, ["k"])
    assert table(spark, root) == {1: "b"}


def test_live_table_over_batches(spark, tmp_path):
    """Three batches: a late row loses, an old key expires and may return, a row older than the horizon is dropped."""
    source, root, check = (str(tmp_path / x) for x in ("in", "live", "check"))
    schema = "stop string, ts timestamp_ntz, id int, delay int"

    def batch(*rows):
        d = spark.createDataFrame([(s, i, v, h) for s, h, i, v in rows], "stop string, id int, delay int, h double")
        made = d.select("stop", (F.lit("2024-05-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(0), secs=F.col("h") * 3600)).alias("ts"), "id", "delay")
        made.coalesce(1).write.mode("append").parquet(source)
        q = st.latest_updates(st.event_stream(spark, source, schema), ["stop"], ["ts", "id"], root, check, "ts", "24 hours")
        q.awaitTermination()
        assert q.exception() is None
        progress = [s["stateOperators"][0]["numRowsTotal"] for s in q.recentProgress if s["stateOperators"]]
        return {r.stop: (r.id, r.delay) for r in st.live(spark, root, "ts", "24 hours").collect()}, progress[-1]

    got, _ = batch(("a", 1.0, 1, 5), ("a", 2.0, 2, 6), ("b", 2.0, 3, None), ("c", 20.0, 4, 1), ("c", 20.0, 5, 2))
    assert got == {"a": (2, 6), "b": (3, None), "c": (5, 2)}
    got, _ = batch(("a", 1.5, 6, 9), ("b", 25.5, 7, 8))
    assert got == {"a": (2, 6), "b": (7, 8), "c": (5, 2)}
    got, live = batch(("d", 30.0, 8, 1), ("c", 19.0, 9, 9))
    assert got == {"b": (7, 8), "c": (5, 2), "d": (8, 1)}
    kept = tb.current(spark, root).where("not _gone").count()
    assert kept == 3 and live < 12  # the state holds three keys with their timers
    got, _ = batch(("a", 5.0, 10, 7), ("e", 50.0, 11, 4), ("a", 49.0, 12, 3))
    assert got == {"a": (12, 3), "d": (8, 1), "e": (11, 4)}
    assert "RocksDB" not in (spark.conf.get("spark.sql.streaming.stateStore.providerClass") or "")  # put back


def test_refresh_reads_new_rows_and_touched_groups(spark, tmp_path, small):
    """After 1 % new rows a refresh takes in those rows, reads few parts, and the table equals a full rebuild."""
    root, source = str(tmp_path / "g"), str(tmp_path / "source")
    made = spark.range(4000).selectExpr("id % 900 AS k", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id) AS ts", "if(id % 7 = 0, null, id * 0.5D) AS x")
    made.write.parquet(source)
    args = (root, ["k"], "ts", ["x"], ["x"], ["x"])
    assert tb.refresh_groups(spark.read.parquet(source), *args) == 4000
    assert tb.refresh_groups(spark.read.parquet(source), *args) == 0
    more = spark.range(40).selectExpr("cast(900 + id % 2 as long) AS k", "timestamp_ntz'2024-02-01' AS ts", "cast(id as double) AS x").unionByName(
        spark.sql("SELECT 5L AS k, timestamp_ntz'2024-02-01' AS ts, -3.0D AS x UNION ALL SELECT 6L, null, 1.0D UNION ALL SELECT null, timestamp_ntz'2024-02-01', 1.0D")
    )
    more.write.mode("append").parquet(source)
    m = keyed.newest(spark, root)
    assert len(m["parts"]) > 4
    seen = keyed.lookup(spark, root, m, spark.sql("SELECT 5L AS k UNION ALL SELECT 900L UNION ALL SELECT CAST(NULL AS LONG)"))
    read = {f for f in seen.inputFiles()}
    assert seen.count() == 1 and len(read) < len(tb.current(spark, root).inputFiles()) / 2
    assert tb.refresh_groups(spark.read.parquet(source), *args) == 42
    want = spark.read.parquet(source).where("ts is not null").groupBy("k").agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b"), F.round(F.avg("x"), 6).alias("c"))
    got = tb.grouped(spark, root).select("k", "n", F.col("min_x").alias("a"), F.col("max_x").alias("b"), F.round("mean_x", 6).alias("c"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
