"""Weather cleaning and ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from headway.functions.encode import humidex
from headway.operators.aggregates import circular_mean_col, mode_of
from headway.operators.fills import ffill, interpolate
from headway.operators.filters import drop_existing
from headway.operators.joins import new_rows


def clean_weather(df: DataFrame, ts: str = "unixtime", limit: int = 7) -> DataFrame:
    """Fills gaps: mean direction for wind, interpolation for visibility, mode for cloud cover,
    at most ``limit`` hours forward for humidity and dew point; then humidex."""
    d = drop_existing(df)
    cut, order = [F.floor(F.col(ts) / (86400 * 30))], [F.col(ts)]
    if "wind_dir_10s" in d.columns:
        mean = d.agg(circular_mean_col("wind_dir_10s")).scalar()
        d = d.withColumn("wind_dir_10s", F.coalesce("wind_dir_10s", mean))
    if "visibility" in d.columns:
        d = interpolate(d.withColumn("visibility", F.col("visibility").cast("double")), [], order, cut, "visibility")
    if "cloud_cover_8" in d.columns:
        common = mode_of(d, "cloud_cover_8").select(F.first("mode")).scalar()
        d = d.withColumn("cloud_cover_8", F.coalesce("cloud_cover_8", common))
    short = [x for x in ("relative_humidity", "dew_point") if x in d.columns]
    if short:
        d = ffill(d, [], order, cut, short, limit)
    return d.withColumn("humidex_v", humidex("temperature", "dew_point"))


def ingest_weather(df: DataFrame, stored: DataFrame, as_of: str, key: str = "date_time_local") -> DataFrame:
    """Cleaned rows of complete hours that the table does not hold yet."""
    from headway.sinks.tables import complete_hours_only

    return new_rows(complete_hours_only(clean_weather(df), as_of), stored, [key])
