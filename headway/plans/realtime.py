"""Live tables: latest updates, observed positions, analytics rows, alerts, predictions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from headway.functions.clock import (
    LOCAL_ZONE, from_epoch, hour_start, isodow, parse_service_date, seconds_between, stop_actual_time, to_local,
)
from headway.functions.encode import cyclic, peak_flag, rainy, weekend_flag
from headway.operators.aggregates import alert_features
from headway.operators.filters import delay_plausible, lookback
from headway.operators.joins import (
    alert_detail, group_stat_back, latest_batch, positions_on_schedule, stop_updates_flat, with_weather,
)
from headway.operators.windows import latest_per


def base_updates(t: dict[str, DataFrame], as_of=None, interval: str = "24 hours") -> DataFrame:
    """The latest plausible update of every (trip, stop sequence, start date)."""
    stu = delay_plausible(t["stop_time_updates"], "arrival_delay", "arrival_time")
    stu = stu.select("trip_update_id", "stop_id", "stop_sequence", "arrival_time", "arrival_delay")
    trips = t["trip_descriptors"].select("trip_descriptor_id", "trip_id", "route_id", "start_date", "direction_id")
    headers = t["feed_headers"].withColumn("update_time", from_epoch("timestamp_seconds"))
    if as_of is not None:
        headers = lookback(headers, "update_time", as_of, interval)
    flat = stop_updates_flat(
        {**t, "stop_time_updates": stu, "trip_descriptors": trips, "feed_headers": headers.select("feed_message_id", "update_time")}
    )
    rows = flat.select(
        "trip_update_id", "route_id", "trip_id", "start_date", "direction_id", "stop_id", "stop_sequence",
        from_epoch("arrival_time").alias("actual_arrival_time"), "arrival_delay", "update_time",
    )
    order = [F.desc("update_time"), F.desc("trip_update_id"), F.desc("actual_arrival_time"), F.desc("arrival_delay"), F.desc("stop_id")]
    return latest_per(rows, ["trip_id", "stop_sequence", "start_date"], order)


def base_positions(t: dict[str, DataFrame], stops: DataFrame, as_of=None, interval="2 hours", zone=LOCAL_ZONE) -> DataFrame:
    """Observed positions against the schedule; without ``as_of`` the whole history.

    The age bound is put on the raw epoch column, so it reaches the scan.
    """
    vp = t["vehicle_positions"]
    if as_of is not None:
        n, unit = interval.split()
        at = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL '{int(n)}' {unit.rstrip('s').upper()}")
        vp = vp.where(F.col("timestamp_seconds") >= F.unix_timestamp(at))
    place = stops.select("stop_id", "region_id", "stop_lat", "stop_lon")
    rows = positions_on_schedule(vp, t["trip_descriptors"], t["stop_times"], place)
    date = parse_service_date("start_date")
    rows = rows.select(
        "route_id", "trip_id", "start_date", "arrival_day_offset", "direction_id", "stop_id", "stop_sequence",
        "region_id", "stop_lat", "stop_lon",
        stop_actual_time(date, "arrival_secs", "arrival_day_offset", zone).alias("scheduled_arrival_time"),
        from_epoch("timestamp_seconds").alias("actual_arrival_time"),
    )
    return rows.withColumns(
        {
            "arrival_delay": F.round(seconds_between("scheduled_arrival_time", "actual_arrival_time")).cast("int"),
            "time_bucket": hour_start("scheduled_arrival_time"),
            "hour_of_day": F.hour(to_local("scheduled_arrival_time", zone)),
            "day_of_week": isodow(date),
        }
    )


GEO = ("distance_from_downtown_km", "lat_sin", "lat_cos", "lon_sin", "lon_cos", "lat_relative", "lon_relative", "area_density_score")


def analytics(base, routes, trips, stops, stop_times, zone: str = LOCAL_ZONE, min_n: int = 5, store: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Updates with schedule, stop and route columns, time features and the route-hour mean.

    The schedule is matched on (trip, stop sequence), so a trip that passes a stop twice does
    not multiply rows. Weekday features come from the service date. The mean reads the rows a second time: ``store``, if given,
    writes them once, before the columns of the stop are added.
    """
    st = stop_times.select("trip_id", "stop_sequence", F.col("arrival_secs").alias("scheduled_arrival_time"))
    rows = (
        base.join(st, ["trip_id", "stop_sequence"])
        .join(routes.select("route_id", "route_short_name"), "route_id")
        .join(trips.select("trip_id", "trip_headsign"), "trip_id")
    )
    rows = (rows if store is None else store(rows)).withColumn("hour_of_day", F.hour(to_local("actual_arrival_time", zone)))
    # Rows are counted with their stops, but the mean is joined back before they carry the columns of the stop.
    rows = group_stat_back(
        rows, ["route_id", "direction_id", "hour_of_day"], {"delay_mean_by_route_hour": F.avg("arrival_delay")}, min_n,
        rows.join(stops.select("stop_id"), "stop_id"),
    )
    rows = rows.join(stops.select("stop_id", "stop_name", "stop_lat", "stop_lon", "region_id", *GEO), "stop_id")
    rows = rows.withColumns({"day_of_week": isodow(parse_service_date("start_date")), "datetime_60": hour_start("actual_arrival_time")})
    hs, hc = cyclic("hour_of_day", 24)
    ds, dc = cyclic("day_of_week", 7)
    return rows.withColumns(
        {
            "hour_sin": hs, "hour_cos": hc, "day_sin": ds, "day_cos": dc,
            "is_peak_hour": peak_flag("hour_of_day"), "is_weekend": weekend_flag("day_of_week"),
        }
    )


def alerts_of(t: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Alert detail rows and the features per route and hour."""
    detail = alert_detail(t["alerts"], t["alert_informed_entities"], t["alert_active_periods"], t["alert_text"])
    return detail, alert_features(detail)


LATEST_KEYS = ("route_id", "stop_id", "stop_sequence", "direction_id")


def latest_predictions(predictions: DataFrame) -> DataFrame:
    """The newest prediction batch of each (route, stop, sequence, direction)."""
    return latest_batch(predictions, LATEST_KEYS, "prediction_created_at")


def predict_status(rows: DataFrame, weather: DataFrame, as_of=None, region=None, interval: str = "9 hours", rain=6) -> DataFrame:
    """Model input: recent analytics rows with the weather of their hour.

    Without ``region`` all regions come in one frame.
    """
    d = rows if as_of is None else lookback(rows, "datetime_60", as_of, interval)
    if region is not None:
        d = d.where(F.col("region_id") == region)
    w = weather.select(from_epoch("unixtime").alias("datetime_60"), "humidex_v", "wind_speed", "cloud_cover_8")
    joined = d.join(w, "datetime_60")
    return joined.select(
        "region_id", "route_id", "stop_id", "stop_name", "stop_lat", "stop_lon", F.col("datetime_60").alias("time_bucket"),
        "direction_id", "hour_sin", "hour_cos", "day_cos", "day_sin", "is_peak_hour", "is_weekend", "arrival_delay",
        F.col("stop_sequence").alias("line_direction_link_order"), "delay_mean_by_route_hour", "distance_from_downtown_km",
        F.col("humidex_v").alias("humidex"), "wind_speed", rainy("cloud_cover_8", rain).alias("weather_rainy"),
    )
