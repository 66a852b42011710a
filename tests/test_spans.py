"""Split windows against plain windows and pandas, with a hot key and tiny pieces."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from headway.operators import distribution as di, fills as fi, windows as wi
from headway.operators.spans import daily, hourly, place, rowwise, timewise

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    out = []
    for i in range(3000):
        key = None if i % 97 == 0 else ("hot" if rng.random() < 0.6 else f"k{rng.randrange(6)}")
        ts = START + dt.timedelta(seconds=rng.randrange(0, 400_000) if rng.random() < 0.8 else 3600)
        out.append((i, key, None if i % 211 == 0 else ts, None if rng.random() < 0.4 else round(rng.uniform(-50, 50), 1)))
    return spark.createDataFrame(out, "id int, key string, ts timestamp_ntz, x double").repartition(7).cache()


ORDER = ["ts", "id"]


def same(a, b):
    assert {tuple(r) for r in a.collect()} == {tuple(r) for r in b.collect()}


@pytest.mark.parametrize("slices", [hourly, daily])
def test_place_is_row_number(rows, slices):
    w = Window.partitionBy("key").orderBy(*ORDER)
    want = rows.select("id", F.row_number().over(w).cast("long"), F.count("*").over(Window.partitionBy("key")))
    same(place(rows, ["key"], ORDER, slices("ts"), total="n").select("id", "_pos", "n"), want)


@pytest.mark.parametrize("block", [1, 3, 50, 10_000])
def test_rowwise_equals_plain_window(rows, block):
    fns = {
        "m": lambda w: F.round(F.avg("x").over(w.rowsBetween(-5, -1)), 6), "l": lambda w: F.lag("id", 4).over(w),
        "n": lambda w: F.lead("id", 2).over(w), "c": lambda w: F.count("x").over(w.rowsBetween(-2, 2)),
    }
    w = Window.partitionBy("key").orderBy(*ORDER)
    got = rowwise(rows, ["key"], ORDER, hourly("ts"), fns, back=5, ahead=2, rows=block)
    same(got.select("id", *fns), rows.select("id", *[f(w).alias(n) for n, f in fns.items()]))


@pytest.mark.parametrize("width", [600, 3600, 86400])
def test_timewise_equals_range_window(rows, width):
    w = Window.partitionBy("key").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3600_000_000, -60_000_000)
    got = timewise(rows, ["key"], "ts", {"m": lambda w: F.sum("id").over(w)}, 3600, 60, width)
    same(got.select("id", "m"), rows.select("id", F.sum("id").over(w)))


def test_interpolate_matches_pandas(rows):
    got = fi.interpolate(rows, ["key"], ORDER, hourly("ts"), "x").toPandas().set_index("id")["x"]
    pdf = rows.toPandas().sort_values(["ts", "id"], na_position="first")
    pdf["key"] = pdf["key"].fillna("-")
    want = pdf.groupby("key")["x"].transform(lambda s: s.interpolate(limit_direction="both"))
    want.index = pdf["id"]
    assert (got.sort_index() - want.sort_index()).abs().max() < 1e-9


def test_fills_match_pandas(rows):
    pdf = rows.toPandas().sort_values(["ts", "id"], na_position="first")
    pdf["key"] = pdf["key"].fillna("-")
    for limit in (None, 2):
        got = fi.ffill(rows, ["key"], ORDER, hourly("ts"), "x", limit).toPandas().set_index("id")["x"].sort_index()
        want = pdf.groupby("key")["x"].ffill(limit=limit)
        want.index = pdf["id"]
        pd.testing.assert_series_equal(got, want.sort_index(), check_names=False)


def test_quantiles_match_pandas(rows):
    qs = [0.0, 0.1, 0.5, 0.95, 1.0]
    for scale in (1e-6, 1.0, 1e6):
        scaled = rows.na.drop(subset=["key", "x"]).withColumn("x", F.col("x") * scale)
        assert scaled.groupBy(di.value_slices(scaled, "x")).count().agg(F.max("count")).first()[0] <= scaled.count() / 4
        got = di.percentiles(scaled, "x", qs, ["key"], ["a", "b", "c", "d", "e"]).toPandas().set_index("key").sort_index()
        want = rows.toPandas().dropna(subset=["key", "x"]).groupby("key")["x"].quantile(qs).unstack()
        assert abs(got.to_numpy() / scale - want.to_numpy()).max() < 1e-9


def test_mad_zero_keeps_all(spark):
    d = spark.createDataFrame([(1.0,), (1.0,), (1.0,), (9.0,)], "x double")
    assert di.mad_filter(d, "x").count() == 4
    assert di.mad_filter(spark.createDataFrame([(None,), (None,)], "x double"), "x").count() == 2


def test_mann_whitney_against_pairs(spark):
    rng = random.Random(1)
    data = [(rng.randrange(2), rng.randrange(20) / 2) for _ in range(200)]
    r = di.mann_whitney(spark.createDataFrame(data, "g int, x double"), "g", "x").first()
    a, b = [x for g, x in data if g], [x for g, x in data if not g]
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert r.u1 == pytest.approx(u) and 0 <= r.p_value <= 1


def test_latest_per_is_limited_before_the_shuffle(rows):
    plan = wi.latest_per(rows, ["key"], [F.desc("ts"), F.desc("id")])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
