import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from headway.functions import clock as ck, encode as en, geo
from headway.operators.spatial import point_in_polygon, polygon_cells


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize(
    "text, tod, offset",
    [("25:35:00", 5700, 1), ("01:35:00", 5700, 0), ("49:00:01", 3601, 2), ("", None, 0), ("7h30", None, 0), (None, None, 0), ("12:61:00", None, 0)],
)
def test_extended_time(spark, text, tod, offset):
    got = one(spark, ck.split_extended_time(F.lit(text).cast("string")).alias("s")).s
    assert (got.tod, got.day_offset) == (tod, offset)


def actual(spark, day, tod, offset):
    return one(spark, ck.stop_actual_time(F.lit(day).cast("date"), F.lit(tod), F.lit(offset)).alias("t")).t


def test_actual_time_of_next_day(spark):
    assert actual(spark, "2025-10-24", 5700, 1) == dt.datetime(2025, 10, 25, 8, 35)


def test_repeated_hour_reads_as_standard_time(spark):
    assert actual(spark, "2025-11-02", 5400, 0) == dt.datetime(2025, 11, 2, 9, 30)
    assert actual(spark, "2025-11-02", 1800, 0) == dt.datetime(2025, 11, 2, 7, 30)
    assert actual(spark, "2025-11-02", 7200, 0) == dt.datetime(2025, 11, 2, 10, 0)


def test_skipped_hour(spark):
    assert actual(spark, "2025-03-09", 9000, 0) == dt.datetime(2025, 3, 9, 10, 30)
    assert actual(spark, "2025-03-09", None, 0) is None


def test_service_date(spark):
    got = one(spark, ck.parse_service_date(F.lit("20250131")).alias("a"), ck.parse_service_date(F.lit(20240229)).alias("b"), ck.parse_service_date(F.lit("2025013")).alias("c"))
    assert (got.a, got.b, got.c) == (dt.date(2025, 1, 31), dt.date(2024, 2, 29), None)


def test_humidex(spark):
    want = round(30 + 0.5555 * (6.11 * math.exp(5417.753 * (1 / 273.15 - 1 / (15 + 273.15))) - 10), 2)
    got = one(spark, en.humidex(F.lit(30.0), F.lit(15.0)).alias("h"), en.humidex(F.lit(None), F.lit(1.0)).alias("n"))
    assert got.h == pytest.approx(want) and got.n is None


def test_region_names(spark):
    names = ["City of North Vancouver", "District of North Vancouver", "Bowen Island Municipality", "Electoral Area A", "Tsawwassen First Nation"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", geo.region_slug("n").alias("s"), geo.region_type("n").alias("t")).collect()
    got = {r.n: (r.s, r.t) for r in rows}
    assert got["City of North Vancouver"] == ("north_vancouver", "city")
    assert got["Bowen Island Municipality"] == ("bowen_island_municipality", "municipality")
    assert got["Electoral Area A"] == ("electoral_area_a", "electoral_area")
    assert got["Tsawwassen First Nation"][1] == "first_nation"


def test_polygon_with_hole_and_parts(spark):
    wkt = "SRID=4326;MULTIPOLYGON(((0 0, 10 0, 10 10, 0 10, 0 0),(4 4, 6 4, 6 6, 4 6, 4 4)),((20 0, 22 0, 22 2, 20 2, 20 0)))"
    poly = spark.createDataFrame([("a", wkt)], "id string, w string").select("id", geo.parse_wkt("w").alias("rings"))
    pts = [(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 21.0, 1.0), (4, 15.0, 1.0), (5, 0.0, 5.0), (6, 10.0, 5.0), (7, 5.0, 3.999), (8, None, 1.0)]
    p = spark.createDataFrame(pts, "pid int, x double, y double")
    for edges in (1, 4, 100):
        rows = point_in_polygon(p, poly, "x", "y", ["id"], edges=edges).collect()
        inside = {r.pid for r in rows if r.id}
        assert len(rows) == len(pts)
        assert inside == {1, 3, 5, 7}


def test_geojson_rings(spark):
    text = '{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]}'
    got = one(spark, geo.rings_from_geojson(F.lit(text)).alias("r")).r
    assert len(got) == 2 and got[1][0].x == 5.0


def _ray(x, y, edges):
    return sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for x1, y1, x2, y2 in edges) % 2 == 1


def _star(cx, cy, size, n, rng, rough=0.7):
    turn = np.sort(rng.uniform(0, 2 * np.pi, n))
    far = size * (1 - rough * rng.uniform(0, 1, n)) * (1 - 0.3 * np.sin(3 * turn) ** 2)
    return [(cx + f * np.cos(a), cy + f * np.sin(a)) for a, f in zip(turn, far)]


def test_country_beside_city_blocks(spark):
    """A large outline and small blocks: few cells, most of them whole, and the result of the plain ray over all edges."""
    rng = np.random.default_rng(5)
    country = _star(0.0, 0.0, 400.0, 4000, rng, 0.002)
    blocks = {f"b{i}": [(x, y), (x + 0.01, y), (x + 0.01, y + 0.01), (x, y + 0.01)] for i, (x, y) in enumerate(rng.integers(0, 40, (200, 2)) / 100)}
    shapes = {"country": country, "star": _star(3.3, -7.1, 0.7, 60, rng)} | blocks
    rows = [(k, [[{"x": float(x), "y": float(y)} for x, y in ring]]) for k, ring in shapes.items()] + [("none", []), ("null", None), ("dot", [[{"x": 1.0, "y": 1.0}]])]
    polygons = spark.createDataFrame(rows, "id string, rings array<array<struct<x: double, y: double>>>")
    spots = np.concatenate([rng.uniform(-400, 400, (150, 2)), rng.uniform(0, 0.5, (150, 2)), rng.uniform(2, 5, (40, 2)) * [1, -2], rng.integers(0, 50, (100, 2)) / 100, country[:40]])
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(spots)] + [(9999, None, 1.0)], "pid int, x double, y double")
    got = {}
    for r in point_in_polygon(points, polygons, "x", "y", ["id"]).collect():
        got.setdefault(r.pid, set()).add(r.id)
    edges = {k: [(*a, *b) for a, b in zip(ring, ring[1:] + ring[:1])] for k, ring in shapes.items()}
    for i, (x, y) in enumerate(spots.tolist()):
        assert got[i] == ({k for k, e in edges.items() if _ray(x, y, e)} or {None}), (i, x, y)
    assert got[9999] == {None}
    cells = polygon_cells(polygons, ["id"]).select("id", F.size("_edges").alias("n"), F.size("_ends").alias("ends"), "_lv").collect()
    big = [c for c in cells if c.id == "country"]
    assert len(big) < 3 * 4000 and max(c.n for c in big) <= 32 and len({c["_lv"] for c in big}) > 3
    assert sum(c.n == c.ends == 0 for c in big) > 100 and len(cells) - len(big) < 200 * 16
    assert point_in_polygon(points, polygons, "x", "y", ["id"], how="inner").where("id is null").count() == 0
    assert point_in_polygon(points, polygons.limit(0), "x", "y", ["id"]).where("id is null").count() == len(spots) + 1


@pytest.mark.parametrize("left", [0, 50, 50_000])
def test_percentiles_by_buckets(spark, monkeypatch, left):
    """Against numpy: skewed, far apart, repeated, negative and NaN values, and one value only."""
    from headway.operators import distribution as di

    monkeypatch.setattr(di, "LEFT", left)
    monkeypatch.setattr(di, "BUCKETS", 16 if left < 100 else 4096)
    rng = np.random.default_rng(3)
    shapes = {
        "skewed": np.exp(rng.normal(0, 8, 3000)), "far": np.array([-1.7e308, 1.7e308, 0.0, 5e-324, 1.0] * 3), "copies": rng.integers(0, 3, 2000) * 1.0,
        "one": np.array([4.0]), "even": rng.uniform(-1, 1, 1001), "two": np.array([1.0, 2.0]),
    }
    qs = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]
    for name, v in shapes.items():
        d = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "x double").repartition(3)
        got = list(di.percentiles(d, "x", qs).first())
        h = [(len(v) - 1) * q for q in qs]
        o = np.sort(v)
        want = [o[int(np.floor(k))] + (o[int(np.ceil(k))] - o[int(np.floor(k))]) * (k - np.floor(k)) for k in h]
        assert got == pytest.approx(want, rel=1e-12, nan_ok=True), name
    assert list(di.percentiles(spark.createDataFrame([], "x double"), "x", [0.5]).first()) == [None]
    tail = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),)], "x double")
    assert di.percentiles(tail, "x", [0.5]).first()[0] == 2.0 and np.isnan(di.percentiles(tail, "x", [1.0]).first()[0])
    ends = spark.createDataFrame([(1.0,), (2.0,), (float("inf"),)], "x double")
    assert di.percentiles(ends, "x", [0.5]).first()[0] == 2.0
