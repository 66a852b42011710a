"""Stops, regions and service dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from headway.functions import geo
from headway.functions.clock import dow, padded_day_name
from headway.functions.geo import density_score, distance_km
from headway.operators.aggregates import distinct_array
from headway.operators.joins import anti, count_per_parent, expand_calendar
from headway.operators.sets import union_distinct
from headway.operators.spatial import point_in_polygon
from headway.sinks.tables import merge_rows


def enriched_stops(stops: DataFrame, regions: DataFrame, classes=None, core=geo.CORE_REGIONS) -> DataFrame:
    """Stops with region, distance from downtown, encoded and relative position, density score."""
    s = point_in_polygon(stops, regions, "stop_lon", "stop_lat", ["region_id", "region_name", "region_type"])
    lat, lon = F.col("stop_lat").cast("double"), F.col("stop_lon").cast("double")
    s = s.withColumn("_km", distance_km(lat, lon))
    return s.withColumns(
        {
            "distance_from_downtown_km": F.round("_km", 2),
            "lat_sin": F.round(F.sin(F.radians(lat)), 6),
            "lat_cos": F.round(F.cos(F.radians(lat)), 6),
            "lon_sin": F.round(F.sin(F.radians(lon)), 6),
            "lon_cos": F.round(F.cos(F.radians(lon)), 6),
            "lat_relative": F.round(lat - geo.DOWNTOWN[0], 6),
            "lon_relative": F.round(lon - geo.DOWNTOWN[1], 6),
            "area_density_score": density_score("region_id", "_km", core=core, classes=classes),
        }
    ).drop("_km")


def active_service_dates(calendar: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Services active on each date: weekly pattern, plus added, minus removed."""
    marks = exceptions.select(F.col("date").alias("service_date"), "service_id", "exception_type")
    keys = ["service_date", "service_id"]
    running = union_distinct(expand_calendar(calendar), marks.where("exception_type = 1").select(*keys))
    kept = anti(running, marks.where("exception_type = 2"), keys)
    return kept.select(
        *keys, dow("service_date").alias("day_of_week"), padded_day_name("service_date").alias("day_name"),
        dow("service_date").isin(0, 6).alias("is_weekend"),
    )


def stops_with_regions(stops: DataFrame, regions: DataFrame) -> DataFrame:
    return point_in_polygon(stops, regions, "stop_lon", "stop_lat", ["region_id", "region_name"])


def mapping_summary(mapped: DataFrame) -> DataFrame:
    """How many stops have a region, in total and percent."""
    return mapped.agg(
        F.count(F.lit(1)).alias("total_stops"), F.count("region_id").alias("mapped_stops"),
        F.round(F.count("region_id") * 100.0 / F.count(F.lit(1)), 1).alias("mapped_percent"),
    )


def stops_per_region(regions: DataFrame, mapped: DataFrame) -> DataFrame:
    return count_per_parent(
        regions.select("region_id", "region_name"), mapped.where(F.col("region_id").isNotNull()), ["region_id"], "stop_count"
    )


def import_regions(known: DataFrame | None, fresh: DataFrame, stops: DataFrame) -> dict[str, DataFrame]:
    """Regions upserted by id, stops mapped to them, and the two summaries."""
    regions = fresh if known is None else merge_rows(known, fresh, ["region_id"])
    mapped = stops_with_regions(stops, regions)
    return {
        "regions": regions, "stops": mapped, "summary": mapping_summary(mapped),
        "per_region": stops_per_region(regions, mapped),
    }


def stop_labels(stops, stop_times, trips, routes) -> DataFrame:
    """Stops with the distinct headsigns and route names that serve them."""
    served = (
        stop_times.select("stop_id", "trip_id").join(trips.select("trip_id", "route_id", "trip_headsign"), "trip_id")
        .select("stop_id", "route_id", "trip_headsign").distinct()
        .join(routes.select("route_id", "route_long_name"), "route_id")
    )
    labels = distinct_array(served, "stop_id", ["trip_headsign", "route_long_name"]).select(
        "stop_id", F.col("trip_headsign").alias("trip_headsigns"), F.col("route_long_name").alias("route_names")
    )
    return stops.join(labels, "stop_id")
