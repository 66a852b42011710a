"""Row filters, projections and anomaly flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from headway.functions.clock import c
from headway.functions.encode import NIGHT_HOURS, RUSH_HOURS, finite

# Delay thresholds in seconds and the factors for rush and night hours.
THRESHOLDS = {
    "early_minor": 120,
    "early_major": 300,
    "early_severe": 600,
    "late_minor": 300,
    "late_major": 900,
    "late_severe": 1800,
    "rush_factor": 1.5,
    "night_factor": 0.8,
}

# The columns a weather frame loses before cleaning.
WEATHER_UNUSED = (
    "wind_dir", "wind_gust", "windchill", "cloud_cover_4", "cloud_cover_10", "solar_radiation",
    "health_index", "humidex",
)

# Default model features; the second list is used as far as present.
FEATURES_BASE = ("weather", "temp", "precipitation", "arrival_delay", "travel_time_duration",
                 "day_of_week", "time_period_basic")
FEATURES_OPTIONAL = (
    "hour_sin", "hour_cos", "day_sin", "day_cos",
    "distance_from_downtown_km", "lat_sin", "lat_cos", "lon_sin", "lon_cos", "lat_relative",
    "lon_relative", "area_density_score", "region_id_encoded", "area_type_encoded",
)


def delay_plausible(df: DataFrame, delay: str, time: str, lo=-3600, hi=3600) -> DataFrame:
    return df.where(F.col(delay).between(lo, hi) & F.col(time).isNotNull())


def delay_bounds(df: DataFrame, delay: str, lo=-600, hi=1800) -> DataFrame:
    return df.where(F.col(delay).between(lo, hi))


def lookback(df: DataFrame, ts: str, as_of, interval: str) -> DataFrame:
    """Rows not older than ``interval`` (``'24 hours'``) before ``as_of``.

    ``as_of`` is text or a timestamp; the bound is a constant next to the bare column, so it
    reaches the scan.
    """
    at = F.lit(as_of).cast("timestamp_ntz") if not isinstance(as_of, Column) else as_of
    n, unit = interval.split()
    bound = at - F.expr(f"INTERVAL '{int(n)}' {unit.rstrip('s').upper()}")
    return df.where(F.col(ts) >= bound)


def route_since(df, route_ids=None, start=None, end=None, route="route_id", date="start_date"):
    """Rows of the given routes from ``start`` to ``end`` (text dates compare as text)."""
    if route_ids is not None:
        ids = [route_ids] if isinstance(route_ids, (str, int)) else list(route_ids)
        df = df.where(F.col(route).isin(*ids))
    if start is not None:
        df = df.where(F.col(date) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(date) <= F.lit(end))
    return df


def date_range(df, date: str, start, end) -> DataFrame:
    return df.where(F.col(date).between(F.lit(start), F.lit(end)))


def upstream_ready(df, seq: str, prev: str, min_seq: int = 6) -> DataFrame:
    """Rows far enough along the trip with a known delay upstream; apply after the lag."""
    return df.where((F.col(seq) >= min_seq) & F.col(prev).isNotNull())


def valid_travel_time(df, raw: str, lo=10, hi=3600, name="travel_time_duration") -> DataFrame:
    """Add the travel time where plausible; keep those rows and the first stops."""
    ok = F.when(F.col(raw).between(lo, hi), F.col(raw))
    return df.withColumn(name, ok).where(F.col(name).isNotNull() | F.col(raw).isNull())


def drop_null(df, cols: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(cols))


def drop_existing(df, cols: Sequence[str] = WEATHER_UNUSED) -> DataFrame:
    return df.drop(*cols)


def anomaly_flags(df, delay: str, reversal: Column, minutes: int = 15) -> DataFrame:
    """Early by more than ``minutes``, late by more than twice that, or time running backwards."""
    bound = minutes * 60
    off = (F.col(delay) < -bound) | (F.col(delay) > 2 * bound)
    back = F.coalesce(reversal, F.lit(False))
    return (
        df.withColumn("is_anomaly", F.coalesce(off, F.lit(False)))
        .withColumn("time_reversal", back)
        .withColumn("should_exclude", F.col("is_anomaly") | F.col("time_reversal"))
    )


def graduated_filter(df, delay: str, sigma: float = 3, exclude="should_exclude"):
    """Two frames: without excluded rows, and of those without sigma outliers."""
    from headway.operators.distribution import sigma_filter

    first = df.where(~F.col(exclude))
    return first, sigma_filter(first, delay, sigma)


def asymmetric_anomaly(df, delay: str, hour, limits: dict | None = None) -> DataFrame:
    """Six early/late flags with hour-dependent major bounds, a level 0..3 and an exclude flag."""
    t = {**THRESHOLDS, **(limits or {})}
    h, d = c(hour), F.col(delay)
    rush, night = h.isin(*RUSH_HOURS), h.isin(*NIGHT_HOURS)
    late = F.when(rush, t["late_major"] * t["rush_factor"]).when(
        night, t["late_major"] * t["night_factor"]
    )
    early = F.when(night, t["early_major"] * t["night_factor"])
    df = (
        df.withColumn("is_rush_hour", rush)
        .withColumn("is_night_hour", night)
        .withColumn("delay_threshold_adjusted", late.otherwise(float(t["late_major"])))
        .withColumn("early_threshold_adjusted", early.otherwise(float(t["early_major"])))
    )
    flags = {
        "is_minor_early": d < -t["early_minor"],
        "is_major_early": d < -F.col("early_threshold_adjusted"),
        "is_severe_early": d < -t["early_severe"],
        "is_minor_delay": d > t["late_minor"],
        "is_major_delay": d > F.col("delay_threshold_adjusted"),
        "is_severe_delay": d > t["late_severe"],
    }
    for name, cond in flags.items():
        df = df.withColumn(name, F.coalesce(cond, F.lit(False)))
    level = (
        F.when(F.col("is_severe_early") | F.col("is_severe_delay"), 3)
        .when(F.col("is_major_early") | F.col("is_major_delay"), 2)
        .when(F.col("is_minor_early") | F.col("is_minor_delay"), 1)
        .otherwise(0)
    )
    return df.withColumn("anomaly_level", level).withColumn(
        "should_exclude", F.col("anomaly_level") >= 2
    )


def cast_all(df, types: dict[str, str]) -> DataFrame:
    """Cast the named columns in one projection."""
    return df.select(*[F.col(x).cast(types[x]).alias(x) if x in types else F.col(x) for x in df.columns])


def select_available(df, cols: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The requested columns that exist, and the list of those that do not."""
    have = [x for x in cols if x in df.columns]
    return df.select(*have), [x for x in cols if x not in df.columns]


def layout(groups: dict[str, Sequence[str]], columns: Sequence[str], skip_target: bool = False):
    """Ordered feature columns by group and where each group starts and ends.

    A column listed twice keeps its first place.
    """
    out: list[str] = []
    info: dict[str, dict] = {}
    for name, members in groups.items():
        if skip_target and name == "target":
            continue
        found = [x for x in members if x in columns and x not in out]
        if found:
            info[name] = {
                "features": found, "start_idx": len(out), "end_idx": len(out) + len(found),
                "size": len(found),
            }
            out += found
    return out, info


def default_features(columns: Sequence[str]) -> list[str]:
    return [*FEATURES_BASE, *[x for x in FEATURES_OPTIONAL if x in columns]]


def finite_only(df, cols: Sequence[str]) -> DataFrame:
    keep = F.lit(True)
    for x in cols:
        keep = keep & finite(x)
    return df.where(keep)


def exclude(df, key: str, values) -> DataFrame:
    """Rows whose key is not in a list or frame of keys; null keys stay."""
    if isinstance(values, DataFrame):
        return df.join(values.select(key).distinct(), key, "left_anti")
    return df.where(~F.coalesce(F.col(key).isin(*values), F.lit(False)))


def drop_sparse_columns(df, max_missing: float = 0.5) -> DataFrame:
    """Drop columns whose share of nulls is above the bound; one pass, one row to the driver."""
    shares = df.agg(
        *[F.avg(F.col(x).isNull().cast("double")).alias(x) for x in df.columns]
    ).first()
    return df.drop(*[x for x in df.columns if (shares[x] or 0.0) > max_missing])
