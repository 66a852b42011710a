"""What the stop and region pages ask for."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from headway.functions.clock import LOCAL_ZONE, hour_start, stop_actual_time
from headway.operators.aggregates import mean_per, region_status
from headway.operators.filters import lookback
from headway.operators.joins import fallback, interval_join, next_per_group, previous_step
from headway.operators.windows import latest_per


def _service_days(dates: DataFrame, as_of: str) -> DataFrame:
    """Services of the day of ``as_of`` and the day before."""
    today = F.lit(as_of).cast("timestamp_ntz").cast("date")
    return dates.where(F.col("service_date").between(F.date_sub(today, 1), today)).select("service_date", "service_id")


def timetable(st: DataFrame, trips: DataFrame, dates: DataFrame, as_of: str, zone: str = LOCAL_ZONE) -> DataFrame:
    """Scheduled stops of yesterday's and today's services with their actual time."""
    t = trips.select("trip_id", "route_id", "direction_id", "trip_headsign", "service_id").join(_service_days(dates, as_of), "service_id")
    rows = st.select("trip_id", "stop_id", "stop_sequence", "arrival_secs", "arrival_day_offset").join(t, "trip_id")
    return rows.withColumn("actual_time", stop_actual_time("service_date", "arrival_secs", "arrival_day_offset", zone))


def stop_board(st, trips, dates, observed, predictions, as_of: str, stop_id=None, zone: str = LOCAL_ZONE) -> DataFrame:
    """Next arrivals with predicted delay and the delay at the stop before.

    Trip and time come from the same row: the earliest instant of the group, ties kept.

    ``observed`` are recent position rows, ``predictions`` the latest batch. Without ``stop_id``
    the boards of all stops come in one job.
    """
    if stop_id is not None:
        st = st.where(F.col("stop_id") == stop_id)
        predictions = predictions.where(F.col("stop_id") == stop_id)
    rows = timetable(st, trips, dates, as_of, zone)
    group = ["stop_id", "route_id", "trip_headsign", "service_id", "service_date"]
    nxt = next_per_group(rows, group, "actual_time", as_of).withColumnRenamed("actual_time", "next_arrival_time")
    seen = latest_per(
        observed.select("trip_id", "stop_sequence", "arrival_delay", "actual_arrival_time"), ["trip_id", "stop_sequence"],
        [F.desc("actual_arrival_time"), F.desc("arrival_delay")],
    )
    nxt = previous_step(nxt, seen, ["trip_id"], "stop_sequence", "arrival_delay", "previous_stop_arrival_delay")
    nxt = nxt.join(mean_per(observed, ["route_id", "stop_id"], "arrival_delay", "_mean"), ["route_id", "stop_id"], "left")
    at = ["stop_id", "stop_sequence", "route_id", "direction_id"]
    p = predictions.select(*at, F.col("prediction_target_time").alias("_hour"), F.col("predicted_delay_seconds").alias("_model"))
    nxt = nxt.withColumn("_hour", hour_start("next_arrival_time")).join(p, [*at, "_hour"], "left")
    return fallback(nxt, "_model", "_mean", "predicted_delay_seconds").select(
        "stop_id", "route_id", "service_id", "service_date", "next_arrival_time", "trip_id", "direction_id", "trip_headsign",
        "stop_sequence", "predicted_delay_seconds", "previous_stop_arrival_delay",
    )


def route_timetable(st, trips, dates, observed, predictions, as_of: str, stop_id=None, route_id=None, grace="5 minutes", zone: str = LOCAL_ZONE) -> DataFrame:
    """Timetable of a route at a stop with the prediction valid at each arrival."""
    if stop_id is not None:
        st, predictions = st.where(F.col("stop_id") == stop_id), predictions.where(F.col("stop_id") == stop_id)
    if route_id is not None:
        trips, predictions = trips.where(F.col("route_id") == route_id), predictions.where(F.col("route_id") == route_id)
    rows = lookback(timetable(st, trips, dates, as_of, zone), "actual_time", as_of, grace)
    p = predictions.select("stop_id", "route_id", "prediction_target_time", F.col("predicted_delay_seconds").alias("_model"))
    rows = interval_join(rows, p, ["stop_id", "route_id"], "actual_time", "prediction_target_time", 3600)
    rows = rows.join(mean_per(observed, ["route_id", "stop_id"], "arrival_delay", "_mean"), ["route_id", "stop_id"], "left")
    return fallback(rows, "_model", "_mean", "predicted_delay_seconds").select(
        "route_id", "trip_id", "stop_id", "direction_id", "stop_sequence", "trip_headsign", "arrival_secs", "arrival_day_offset",
        "service_date", F.col("actual_time").alias("actual_arrival_timestamp"), "prediction_target_time", "predicted_delay_seconds",
    )


def region_board(observed: DataFrame) -> DataFrame:
    """Current delay per region; rows without a region or delay drop out."""
    return region_status(observed.na.drop(subset=["region_id", "arrival_delay"]))


def region_predictions(latest: DataFrame, region_id=None, hours: int = 3) -> DataFrame:
    """Latest predictions of a region (or all) up to an hour offset."""
    d = latest.where(F.col("prediction_hour_offset") <= hours)
    return d if region_id is None else d.where(F.col("region_id") == region_id)


def nest_predictions(df: DataFrame, keys=("region_id", "route_id", "direction_id", "stop_id")) -> DataFrame:
    """One row per stop with its predictions as an array in hour order (at most one per offset)."""
    hour = F.struct(
        F.col("prediction_hour_offset").alias("offset"),
        F.date_format("prediction_target_time", "yyyy-MM-dd HH:mm:ss").alias("time"),
        F.coalesce(F.col("predicted_delay_seconds").cast("double"), F.lit(0.0)).alias("delay_seconds"),
        F.coalesce(F.col("predicted_delay_minutes").cast("double"), F.lit(0.0)).alias("delay_minutes"),
    )
    per_hour = df.groupBy(*keys, "prediction_hour_offset").agg(F.min(hour).alias("_h"))
    return per_hour.groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias("hour_predictions"))
