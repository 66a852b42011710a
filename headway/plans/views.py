"""Composite datasets as temporary views, so that they can be asked in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from headway.functions.clock import LOCAL_ZONE
from headway.plans import network, realtime


def view_builders(t: dict[str, DataFrame], as_of=None, zone: str = LOCAL_ZONE) -> dict[str, Callable[[], DataFrame]]:
    """View name to builder, for the views whose tables are there."""

    def stops():
        return network.enriched_stops(t["stops"], t["regions"])

    def updates():
        return realtime.base_updates(t, as_of)

    needs = {
        "stops_enriched": (stops, ("stops", "regions")),
        "active_service_dates": (lambda: network.active_service_dates(t["calendar"], t["calendar_dates"]), ("calendar", "calendar_dates")),
        "rt_base_updates": (updates, ("stop_time_updates", "trip_updates", "trip_descriptors", "feed_entities", "feed_messages", "feed_headers")),
        "rt_base_positions": (lambda: realtime.base_positions(t, stops(), as_of, zone=zone), ("vehicle_positions", "trip_descriptors", "stop_times", "stops", "regions")),
        "rt_analytics": (
            lambda: realtime.analytics(updates(), t["routes"], t["trips"], stops(), t["stop_times"], zone),
            ("routes", "trips", "stops", "regions", "stop_times", "stop_time_updates"),
        ),
        "alerts_detail": (lambda: realtime.alerts_of(t)[0], ("alerts", "alert_informed_entities", "alert_active_periods", "alert_text")),
        "alert_features_route_hour": (lambda: realtime.alerts_of(t)[1], ("alerts", "alert_informed_entities", "alert_active_periods", "alert_text")),
        "predictions_latest": (lambda: realtime.latest_predictions(t["predictions"]), ("predictions",)),
    }
    return {n: fn for n, (fn, tables) in needs.items() if all(x in t for x in tables)}


def register_views(spark: SparkSession, t: dict[str, DataFrame], as_of=None, zone: str = LOCAL_ZONE) -> list[str]:
    """Create the temporary views that the given tables allow; returns their names."""
    built = view_builders(t, as_of, zone)
    for name, fn in built.items():
        fn().createOrReplaceTempView(name)
    return sorted(built)
