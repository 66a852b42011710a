import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from headway.operators import joins as jo, sequences as sq, splits as sp
from headway.operators.nearest import nearest_sites
from headway.operators.spans import hourly
from headway.sinks import tables as tb


@pytest.mark.parametrize("n", [0, 1, 60, 201])
def test_nearest_against_brute_force(spark, n):
    rng = random.Random(3)
    sites = [(i, rng.gauss(0, 1) if i < 40 else rng.uniform(50, 60), rng.gauss(0, 1)) for i in range(n)]
    sites += [(1000, *sites[0][1:])] if n else []
    sites += [(2000, None, 0.0), (2001, float("nan"), 0.0)]
    points = [(i, rng.uniform(-80, 80), rng.uniform(-80, 80)) for i in range(150)] + [(999, None, 1.0), (998, float("nan"), 1.0)]
    got = jo.nearest(
        spark.createDataFrame(points, "pid int, px double, py double"), spark.createDataFrame(sites, "sid int, sx double, sy double"),
        "px", "py", "sid", "sx", "sy",
    ).collect()
    best = {p[0]: min((((s[1] - p[1]) ** 2 + (s[2] - p[2]) ** 2) ** 0.5, s[0]) for s in sites[:-2])[1] if n and p[0] < 998 else None for p in points}
    assert {r.pid: r.nearest for r in got} == best
    empty = spark.createDataFrame([], "pid int, px double, py double")
    assert jo.nearest(empty, spark.createDataFrame(sites, "sid int, sx double, sy double"), "px", "py", "sid", "sx", "sy").count() == 0


@pytest.mark.parametrize("shape", ["crowd", "line", "copies"])
def test_nearest_in_crowds(spark, shape):
    """However dense the sites: equal to brute force, and a point looks at a bounded number of them."""
    rng = np.random.default_rng(7)
    n = 100_000 if shape == "crowd" else 5_000
    sites = {"crowd": rng.uniform(0, 0.25, (n, 2)), "line": np.stack([np.full(n, 0.1), rng.uniform(0, 1, n)], 1), "copies": rng.integers(0, 4, (n, 2)) / 8}[shape]
    points = np.concatenate([rng.uniform(0, 0.25, (300, 2)), rng.uniform(-3, 3, (20, 2)), sites[:20]])
    s = spark.createDataFrame(pd.DataFrame({"sid": [f"s{i:06d}" for i in range(n)], "sx": sites[:, 0], "sy": sites[:, 1]}))
    p = spark.createDataFrame(pd.DataFrame({"px": points[:, 0], "py": points[:, 1]}))
    got = {(r["_x"], r["_y"]): r for r in nearest_sites(p, s, "sid", "sx", "sy", "px", "py", 1000).collect()}
    for x, y in points.tolist():
        d2 = (sites[:, 0] - x) ** 2 + (sites[:, 1] - y) ** 2
        r = got[x, y]
        assert r["_id"] == f"s{d2.argmin():06d}" and r["_d"] == pytest.approx(d2.min() ** 0.5, abs=1e-12)
    if shape == "crowd":
        looked = [got[x, y]["_looked"] for x, y in points[:300].tolist()]
        assert max(looked) <= 20 * 64 and sum(looked) / 300 <= 4 * 64


def test_interval_join_bounds(spark):
    left = spark.sql("SELECT 1 k, timestamp_ntz'2024-01-01 10:00:00' t UNION ALL SELECT 1, timestamp_ntz'2024-01-01 10:59:59.999999' UNION ALL SELECT 1, timestamp_ntz'2024-01-01 11:00:00' UNION ALL SELECT 2, timestamp_ntz'2024-01-01 10:00:00'")
    right = spark.sql("SELECT 1 k, timestamp_ntz'2024-01-01 10:00:00' target")
    got = jo.interval_join(left, right, ["k"], "t", "target").groupBy(F.col("target").isNotNull().alias("hit")).count().collect()
    assert {r.hit: r["count"] for r in got} == {True: 2, False: 2}


def test_no_cross_join_in_plans(spark):
    a = spark.range(10).select(F.col("id").alias("k"), F.current_timestamp().cast("timestamp_ntz").alias("t"))
    plan = jo.interval_join(a, a.withColumnRenamed("t", "t2"), ["k"], "t", "t2")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_new_rows_twice_adds_nothing(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    path = str(tmp_path / "t")
    for _ in range(3):
        tb.insert_new(d, path, ["k"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "c")]


def test_versions_survive_a_failed_refresh(spark, tmp_path):
    root, log = str(tmp_path / "views"), str(tmp_path / "log")
    assert tb.refresh(spark, "v", lambda: spark.range(3), root, log) == "success"
    assert tb.refresh(spark, "v", lambda: spark.range(9).select(F.raise_error(F.lit("no"))), root, log) == "failed"
    assert tb.current(spark, f"{root}/v").count() == 3
    assert spark.read.parquet(log).count() == 2


@pytest.fixture(scope="module")
def obs(spark):
    rng = random.Random(2)
    return spark.createDataFrame([(i, f"g{rng.randrange(9)}", i % 5) for i in range(500)], "id int, g string, day int")


def test_group_split_is_disjoint(obs):
    d = sp.split_groups(obs, ["g"], 0.7)
    assert d.count() == 500
    assert d.groupBy("g").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0


def test_stratified_share(obs):
    d = sp.split_stratified(obs, ["g"], ["id"], 0.8)
    for r in d.groupBy("g").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "train").alias("t")).collect():
        assert r.t == int(r.n * 0.8)


def test_dates_and_folds(obs):
    d = sp.split_dates(obs, "day", 0.6, 0.2, 0.2)
    assert d.count() == 500
    f = sp.cv_folds(obs, "day", 2, 2, 1, 0)
    train = {(r.fold, r.day) for r in f.where("role = 'train'").collect()}
    test = {(r.fold, r.day) for r in f.where("role = 'test'").collect()}
    assert not train & test
    with pytest.raises(ValueError):
        sp.cv_folds(obs, "day", 2, 9, 9)


def test_window_samples(spark):
    rows = [("a", i) for i in range(13)] + [("b", i) for i in range(10)]
    d = spark.createDataFrame(rows, "k string, i int").withColumn("ts", F.timestamp_seconds(F.col("i") * 600).cast("timestamp_ntz"))
    got = sq.windows(d, ["k"], ["ts"], hourly("ts"), ["i"], "i").collect()
    assert sorted((r.k, r.start, r.x[0][0], r.x[7][0], r.y) for r in got) == [("a", s + 1, float(s), float(s + 7), [s + 8.0, s + 9.0, s + 10.0]) for s in range(3)]
    last = sq.windows(d, ["k"], ["ts"], [], ["i"], "i", mode="latest").collect()
    assert sorted((r.k, r.x[0][0], r.x[7][0]) for r in last) == [("a", 5.0, 12.0), ("b", 2.0, 9.0)]
