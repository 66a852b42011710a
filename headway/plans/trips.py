"""Trip preparation, trip features and the history of a route's trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from headway.functions.clock import isodow, parse_service_date
from headway.functions.encode import PERIODS_STORE, as_flag, bin_label, cyclic, key
from headway.operators.aggregates import stop_type_agg, trip_agg
from headway.operators.fills import interpolate
from headway.operators.scaling import label_apply, label_fit
from headway.operators.spans import daily, rowwise
from headway.operators.windows import rolling_exprs

TRIP = ("start_date", "route_id", "direction_id", "trip_id")


def prepare_trip_data(df: DataFrame, direction_id=None, others=("scheduled_arrival_time", "stop_id", "hour_of_day"), tie=()) -> DataFrame:
    """One row per trip and stop with a single, gap-filled delay ``arrival_delay_agg``.

    ``others`` keep the value of the earliest observation.
    """
    d = df if direction_id is None else df.where(F.col("direction_id") == direction_id)
    cells = stop_type_agg(d, TRIP, "stop_sequence", "arrival_delay", "actual_arrival_time", tie, [*others, "actual_arrival_time"])
    cells = cells.withColumn("arrival_delay_agg", F.col("arrival_delay_agg").cast("double"))
    filled = interpolate(cells, TRIP, [F.col("stop_sequence")], [F.floor(F.col("stop_sequence") / 1000)], "arrival_delay_agg")
    return filled.withColumn("trip_key", key(*TRIP)).withColumn("route_direction_key", key("route_id", "direction_id"))


def process_features(df: DataFrame, legacy_weekend: bool = False) -> DataFrame:
    """Time of day, cyclic time, weekday, flags and the encoded route-direction.

    ``legacy_weekend`` counts Sunday only, as a zero-based weekday of six or more does.
    """
    minutes = F.hour("scheduled_arrival_time") + F.minute("scheduled_arrival_time") / 60
    day = isodow(parse_service_date("start_date"))
    d = df.withColumns({"time_of_day": minutes, "hour": F.hour("scheduled_arrival_time"), "day_of_week": day - 1})
    s, c = cyclic("time_of_day", 24)

    def positive(x):
        return as_flag(F.col(x) > 0) if x in df.columns else F.lit(0)

    d = d.withColumns(
        {
            "time_sin": s, "time_cos": c,
            "is_weekend": as_flag(F.col("day_of_week") >= (6 if legacy_weekend else 5)),
            "is_rush_hour": as_flag(F.col("hour").between(14, 18)),
            "has_detour": positive("alert_effect_detour"), "has_police_alert": positive("alert_police_activity"),
        }
    )
    codes = label_fit(d, "route_direction_key")
    return label_apply(d, "route_direction_key", codes).withColumnRenamed("route_direction_key_encoded", "route_direction_encoded")


def trip_history_features(df: DataFrame, lags=(1, 2, 3, 5), windows=(3, 5, 10)) -> DataFrame:
    """Mean delays of earlier trips of the same route and direction, joined back to the stops.

    Trips are aggregated first, so the ordered features run over one row per trip; all of them
    share one pass. Missing history is 0. ``df`` is read three times, so hand over a stored table.
    """
    trips = trip_agg(df, ["trip_key", "route_direction_key"], "arrival_delay_agg", "scheduled_arrival_time")
    fns = {f"delay_lag_{n}": (lambda w, n=n: F.coalesce(F.lag("trip_mean_delay", n).over(w), F.lit(0.0))) for n in lags}
    fns |= rolling_exprs("trip_mean_delay", windows, "delay_rolling")
    hist = rowwise(
        trips, ["route_direction_key"], [F.col("first_scheduled"), F.col("trip_key")], daily("first_scheduled"), fns,
        back=max(*lags, *windows),
    )
    out = df.join(hist.drop("route_direction_key", "trip_mean_delay", "first_scheduled"), "trip_key", "left")
    hour = F.hour("scheduled_arrival_time")
    return out.withColumns(
        {
            "time_period": bin_label(hour, *PERIODS_STORE), "is_morning_rush": as_flag(hour.between(7, 9)),
            "is_evening_rush": as_flag(hour.between(16, 19)),
        }
    )


def route_headsigns(trips: DataFrame) -> DataFrame:
    """First headsign of each route (smallest text)."""
    return trips.groupBy("route_id").agg(F.min("trip_headsign").alias("trip_headsign"))
