"""Training sets: leakage-free window features joined to weather, geography and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from headway.functions.clock import from_epoch, hour_start, isodow, parse_service_date
from headway.functions.encode import (
    PERIODS_DETAILED, bin_label, cyclic, daypart_onehot, peak_flag, precip_estimate, rainy, rush_type, sky_onehot, weekend_flag,
)
from headway.operators.aggregates import hourly_delay, route_hour_stats, weather_bucket
from headway.operators.filters import asymmetric_anomaly, drop_null, upstream_ready, valid_travel_time
from headway.operators.joins import exists_flag, with_weather
from headway.operators.spans import daily, hourly, rowwise
from headway.operators.windows import range_trend, travel_seconds

ALERT_COLUMNS = (
    "has_active_alert", "high_impact_alert_count", "alert_police_activity", "alert_construction",
    "alert_technical_problem", "alert_effect_no_service", "alert_effect_detour", "alert_severity_score",
)
TIE = ("trip_id", "stop_sequence", "start_date", "actual_arrival_time")


def weather_changes(weather: DataFrame, back: int = 168) -> DataFrame:
    """Humidex deviation from its past week and wind change, on the hourly table itself."""
    fns = {
        "_mean": lambda w: F.avg("humidex_v").over(w.rowsBetween(-back, 0)),
        "_wind": lambda w: F.lag("wind_speed").over(w),
    }
    w = weather.withColumn("datetime_60", from_epoch("unixtime"))
    w = rowwise(w, [], [F.col("unixtime")], [F.floor(F.col("unixtime") / (86400 * 30))], fns, back=back)
    return w.withColumns(
        {
            "humidex_deviation_7d": F.col("humidex_v") - F.col("_mean"),
            "wind_speed_change_1h": F.col("wind_speed") - F.coalesce("_wind", "wind_speed"),
        }
    ).drop("_mean", "_wind")


def route_windows(base: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """Past-hour mean, past-rows mean at the same hour and volatility per route and direction.

    ``source``: a frame with the same rows that is cheaper to read again for slice sizes.
    """
    source = base if source is None else source
    order = [F.col("scheduled_arrival_time"), *[F.col(x) for x in TIE]]
    cut = hourly("scheduled_arrival_time")
    rd = ["route_id", "direction_id"]
    d = range_trend(base, rd, "scheduled_arrival_time", "arrival_delay", 3600, 60, "route_delay_trend_60min")
    d = rowwise(d, rd, order, cut, {"route_delay_volatility_3h": lambda w: F.stddev_samp("arrival_delay").over(w.rowsBetween(-3, -1))}, back=3, source=source)
    return rowwise(
        d, [*rd, "hour_of_day"], order, daily("scheduled_arrival_time"),
        {"route_hourly_delay_7d_avg": lambda w: F.avg("arrival_delay").over(w.rowsBetween(-168, -1))}, back=168, source=source,
    )


def _enrich(d: DataFrame, t: dict[str, DataFrame], rain: float) -> DataFrame:
    """Trip, stop, weather, holiday and alert columns shared by both training sets."""
    added = t["calendar_dates"].where("exception_type = 1").select(F.col("date").alias("_date"))
    d = d.withColumn("_date", parse_service_date("start_date")).withColumn("datetime_60", hour_start("scheduled_arrival_time"))
    d = exists_flag(d, added, ["_date"], "is_holiday")
    wh = weather_changes(t["weather_hourly"]).select(
        "datetime_60", F.col("humidex_v").alias("humidex"), "wind_speed", "humidex_deviation_7d", "wind_speed_change_1h",
        rainy("cloud_cover_8", rain).alias("weather_rainy"),
    )
    stops = t["stops"].select("stop_id", "stop_name", "distance_from_downtown_km", "area_density_score")
    d = (
        d.join(t["trips"].select("trip_id", "trip_headsign"), "trip_id").join(stops, "stop_id").join(wh, "datetime_60")
        .join(t["alert_features"].withColumnRenamed("alert_hour", "datetime_60"), ["route_id", "datetime_60"], "left")
    )
    hs, hc = cyclic("hour_of_day", 24)
    ds, dc = cyclic("day_of_week", 7)
    return d.withColumns(
        {
            **{x: F.coalesce(x, F.lit(0)) for x in ALERT_COLUMNS},
            "hour_sin": hs, "hour_cos": hc, "day_sin": ds, "day_cos": dc, "day_of_month": F.dayofmonth("_date"),
        }
    ).drop("_date").withColumnRenamed("datetime_60", "time_bucket")


def route_training(base: DataFrame, t: dict[str, DataFrame], rain: float = 6) -> DataFrame:
    """Route-based training rows; ``t``: trips, stops, weather_hourly, calendar_dates, alert_features."""
    order = [F.col("scheduled_arrival_time"), *[F.col(x) for x in TIE]]
    d = route_windows(base)
    d = rowwise(
        d, ["trip_id", "hour_of_day"], order, daily("scheduled_arrival_time"),
        {"delay_mean_by_trip_headsign_hour": lambda w: F.avg("arrival_delay").over(w.rowsBetween(-168, -1))}, back=168, source=base,
    )
    zero = ("route_delay_trend_60min", "route_hourly_delay_7d_avg", "route_delay_volatility_3h", "delay_mean_by_trip_headsign_hour")
    d = d.withColumns({x: F.coalesce(x, F.lit(0.0)) for x in zero})
    d = d.withColumn("delay_mean_by_route_hour", F.col("route_hourly_delay_7d_avg"))
    d = d.withColumns(daypart_onehot("hour_of_day", "day_of_week"))
    return _enrich(d, t, rain)


def trip_training(base: DataFrame, t: dict[str, DataFrame], rain: float = 6, min_seq: int = 6) -> DataFrame:
    """Trip-based training rows: delays one and two stops upstream, from the sixth stop on."""
    order = [F.col("stop_sequence"), F.col("scheduled_arrival_time"), F.col("actual_arrival_time"), F.col("stop_id")]
    fns = {
        "prev_stop_delay": lambda w: F.lag("arrival_delay", 1).over(w),
        "prev_2_stop_delay": lambda w: F.lag("arrival_delay", 2).over(w),
    }
    d = rowwise(base, ["trip_id", "start_date"], order, None, fns, back=2)
    d = upstream_ready(route_windows(d, base), "stop_sequence", "prev_stop_delay", min_seq)
    zero = ("prev_stop_delay", "prev_2_stop_delay", "route_delay_trend_60min", "route_hourly_delay_7d_avg", "route_delay_volatility_3h")
    d = d.withColumns({x: F.coalesce(F.col(x).cast("double"), F.lit(0.0)) for x in zero})
    parts = daypart_onehot("hour_of_day", "day_of_week")
    d = d.withColumns(
        {"rush_hour_type": rush_type("hour_of_day"), "school_commute_hour": parts["school_commute_hour"], "is_weekend": parts["is_weekend"]}
    )
    return _enrich(d, t, rain)


def travel_time_dataset(updates: DataFrame, route_ids=None, start=None) -> DataFrame:
    """Seconds from the previous stop of the trip, kept where plausible or at the first stop."""
    from headway.operators.filters import delay_plausible, route_since

    d = delay_plausible(route_since(updates, route_ids, start), "arrival_delay", "actual_arrival_time")
    d = travel_seconds(
        d, ["start_date", "route_id", "trip_id"], [F.col("stop_sequence"), F.col("actual_arrival_time"), F.col("stop_id")],
        None, "actual_arrival_time",
    )
    return valid_travel_time(d, "travel_time_raw_seconds").select(
        F.col("actual_arrival_time").alias("datetime"), hour_start("actual_arrival_time").alias("datetime_60"),
        isodow(parse_service_date("start_date")).alias("day_of_week"), F.col("stop_sequence").alias("line_direction_link_order"),
        "trip_id", "stop_id", "start_date", "route_id", "direction_id", "travel_time_raw_seconds", "arrival_delay", "travel_time_duration",
    )


def weather_features(weather: DataFrame, start_unix: int | None = None) -> DataFrame:
    d = weather if start_unix is None else weather.where(F.col("unixtime") >= start_unix)
    sky = sky_onehot("cloud_cover_8")
    return d.select(
        from_epoch("unixtime").alias("datetime"), F.col("temperature").alias("temp"), "relative_humidity", "pressure_sea",
        "wind_speed", "visibility", F.col("humidex_v").alias("humidex"), "cloud_cover_8",
        *[v.alias(n) for n, v in sky.items()], precip_estimate("relative_humidity", "cloud_cover_8").alias("precipitation"),
    )


def time_features(df: DataFrame, bucket: str = "time_bucket", day: str = "day_of_week") -> DataFrame:
    """Hour, cyclic hour and weekday, named day part, peak and weekend flags."""
    d = df.withColumn("hour_of_day", F.hour(bucket))
    hs, hc = cyclic("hour_of_day", 24)
    ds, dc = cyclic(day, 7)
    return d.withColumns(
        {
            "hour_sin": hs, "hour_cos": hc, "day_sin": ds, "day_cos": dc,
            "time_period_detailed": bin_label("hour_of_day", *PERIODS_DETAILED),
            "is_peak_hour": peak_flag("hour_of_day"), "is_weekend": weekend_flag(day),
        }
    )


def ml_base(positions: DataFrame, alerts: DataFrame, start=None, end=None) -> DataFrame:
    """Position rows of a date range with the alert features of their route and hour."""
    from headway.operators.filters import date_range

    d = positions if start is None else date_range(positions, "start_date", start, end)
    a = alerts.withColumnRenamed("alert_hour", "time_bucket").select("route_id", "time_bucket", *ALERT_COLUMNS)
    d = d.join(a, ["route_id", "time_bucket"], "left")
    return d.withColumns({x: F.coalesce(x, F.lit(0)) for x in ALERT_COLUMNS})


def offline_features(travel: DataFrame, weather: DataFrame, required=("arrival_delay", "travel_time_duration"), min_obs=2) -> DataFrame:
    """Cleaned hourly delay features with weather: nulls out, anomalies out, means, time features."""
    d = drop_null(travel, required).withColumn("hour_of_day", F.hour("datetime"))
    d = asymmetric_anomaly(d, "arrival_delay", "hour_of_day").where(~F.col("should_exclude"))
    d = d.join(route_hour_stats(d), ["route_id", "direction_id", "hour_of_day"], "left")
    hourly_rows = hourly_delay(
        d.withColumn("time_bucket", F.col("datetime_60")),
        ["route_id", "direction_id", "stop_id", "line_direction_link_order", "time_bucket", "day_of_week"],
        ["arrival_delay", "travel_time_duration"], ["delay_mean_by_route_hour", "travel_mean_by_route_hour"],
        ["datetime", "trip_id"], min_obs,
    )
    cols = ["temp", "precipitation", "humidex", "wind_speed", "weather_sunny", "weather_cloudy", "weather_rainy"]
    w = weather_bucket(weather.withColumnRenamed("datetime", "time_bucket"), "time_bucket", cols)
    return time_features(hourly_rows).join(w, "time_bucket")
