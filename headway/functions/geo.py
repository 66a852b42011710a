"""Distance, density score, region names and polygon tests as column expressions.

A polygon is ``array<array<struct<x:double,y:double>>>``: a list of closed or open rings. Holes
and separate parts are further rings; a point is inside when it is inside an odd number of them.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from headway.functions.clock import c

EARTH_KM = 6371
DOWNTOWN = (49.2827, -123.1207)

RINGS = "array<array<struct<x:double,y:double>>>"

# Regions by density class, densest first. The id list is data; callers may pass
# their own mapping of region id to score.
CORE_REGIONS = ("vancouver", "burnaby", "new_westminster")
DENSITY = {
    4: ("vancouver", "burnaby", "richmond", "new_westminster", "north_vancouver_city",
        "north_vancouver_district"),
    3: ("surrey", "coquitlam", "port_coquitlam", "port_moody", "west_vancouver", "delta"),
    2: ("langley_city", "langley_township", "maple_ridge", "pitt_meadows", "white_rock"),
    1: ("lions_bay", "belcarra", "anmore", "bowen_island"),
}

# Name prefixes that the region id drops, and the type each name shows.
NAME_PREFIXES = ("city of ", "district of ", "township of ", "village of ", "municipality")
TYPE_BY_PREFIX = {"City of": "city", "District of": "district", "Township of": "township",
                  "Village of": "village"}
TYPE_BY_PART = {"Municipality": "municipality", "First Nation": "first_nation",
                "Electoral Area": "electoral_area"}


def distance_km(lat, lon, lat0: float = DOWNTOWN[0], lon0: float = DOWNTOWN[1]) -> Column:
    """Great-circle distance to a fixed point in km, unrounded; the arccosine is clamped."""
    la, lo = F.radians(c(lat).cast("double")), c(lon).cast("double")
    here = F.radians(F.lit(lat0))
    cosine = F.sin(here) * F.sin(la) + F.cos(here) * F.cos(la) * F.cos(F.radians(lo - lon0))
    return F.lit(EARTH_KM) * F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine)))


def density_score(region, dist_km, near_km: float = 5, core=CORE_REGIONS, classes=None) -> Column:
    """0..5: core regions near the centre score 5, the rest by the class of their region."""
    r = c(region)
    out = F.when(r.isin(*core) & (c(dist_km) <= near_km), 5)
    for score, ids in (classes or DENSITY).items():
        out = out.when(r.isin(*ids), score)
    return out.otherwise(0)


def region_slug(name) -> Column:
    """Region name to id: lower case, one leading type word dropped, blanks to underscores."""
    pattern = "^(" + "|".join(NAME_PREFIXES) + ")"
    return F.replace(F.trim(F.regexp_replace(F.lower(c(name)), pattern, "")), F.lit(" "), F.lit("_"))


def region_type(name) -> Column:
    n = c(name)
    out = F.when(F.lit(False), F.lit(""))
    for prefix, kind in TYPE_BY_PREFIX.items():
        out = out.when(F.startswith(n, F.lit(prefix)), kind)
    for part, kind in TYPE_BY_PART.items():
        out = out.when(F.contains(n, F.lit(part)), kind)
    return out.otherwise("other")


def parse_wkt(col) -> Column:
    """``SRID=4326;POLYGON((x y, ...), (...))`` or MULTIPOLYGON text to rings."""
    body = F.element_at(F.split(c(col), ";"), -1)
    rings = F.regexp_extract_all(body, F.lit(r"\(([^()]+)\)"), F.lit(1))

    def point(text):
        xy = F.split(F.trim(text), r"\s+")
        return F.struct(xy[0].cast("double").alias("x"), xy[1].cast("double").alias("y"))

    return F.transform(rings, lambda r: F.transform(F.split(r, ","), point))


def parse_lonlat(col) -> Column:
    """``[lon, lat]`` given as text or array to struct(lon, lat)."""
    arr = F.from_json(c(col).cast("string"), "array<double>")
    return F.struct(F.get(arr, F.lit(0)).alias("lon"), F.get(arr, F.lit(1)).alias("lat"))


def rings_from_geojson(geom) -> Column:
    """GeoJSON geometry text (Polygon or MultiPolygon) to rings."""
    g = c(geom)
    kind = F.get_json_object(g, "$.type")
    coords = F.get_json_object(g, "$.coordinates")
    one = F.from_json(coords, "array<array<array<double>>>")
    many = F.flatten(F.from_json(coords, "array<array<array<array<double>>>>"))

    def ring(r):
        return F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))

    return F.transform(F.when(kind == "MultiPolygon", many).otherwise(one), ring)


def bbox(rings) -> Column:
    """struct(xmin, ymin, xmax, ymax) of a polygon."""
    pts = F.flatten(c(rings))
    xs, ys = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"),
        F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"),
    )


def edges_of(rings) -> Column:
    """Edges of a polygon as array<struct<x1,y1,x2,y2>>; every ring is closed.

    Computed once per polygon so that the test per point only folds over numbers.
    """

    def ring_edges(r):
        n = F.size(r)
        return F.transform(
            r,
            lambda p, i: F.struct(
                p["x"].alias("x1"), p["y"].alias("y1"),
                F.get(r, (i + 1) % n)["x"].alias("x2"),
                F.get(r, (i + 1) % n)["y"].alias("y2"),
            ),
        )

    return F.flatten(F.transform(c(rings), ring_edges))


def inside(x, y, edges) -> Column:
    """Even-odd ray casting over the edges of a polygon.

    A point on a left or lower edge counts as inside, on a right or upper edge as outside, so
    tiles that share an edge never claim the same point twice.
    """
    px, py = c(x), c(y)

    def crosses(e):
        spans = (e["y1"] > py) != (e["y2"] > py)
        rise = F.when(spans, e["y2"] - e["y1"])
        return spans & (px < (e["x2"] - e["x1"]) * (py - e["y1"]) / rise + e["x1"])

    return F.size(F.filter(c(edges), crosses)) % 2 == 1
