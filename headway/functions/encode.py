"""Cyclic encodings, day parts, weather flags, bins and composite keys."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from headway.functions.clock import c

# Hours that count as peak, rush, night and school travel.
PEAK_HOURS = (7, 8, 17, 18)
RUSH_HOURS = (7, 8, 9, 17, 18, 19)
NIGHT_HOURS = (22, 23, 0, 1, 2, 3, 4, 5)
SCHOOL_HOURS = (8, 15, 16)

# Named day parts, both ends included.
DAY_PARTS = {
    "rush_hour_morning": (7, 9),
    "rush_hour_evening": (17, 19),
    "time_late_night": (0, 4),
    "time_early_morning": (5, 6),
    "time_morning": (7, 11),
    "time_daytime": (12, 16),
    "time_evening": (17, 20),
    "time_night": (21, 23),
}

# Lower bin edges and labels of the two hour binnings.
PERIODS_DETAILED = (
    (0, 5, 7, 9, 12, 15, 18, 22, 24),
    ("Late_Night", "Early_Morning", "Morning_Peak", "Midday", "Afternoon", "Evening_Peak",
     "Night", "Late_Evening"),
)
PERIODS_STORE = (
    (0, 6, 9, 12, 15, 18, 21, 24),
    ("night", "morning_rush", "morning", "noon", "afternoon", "evening_rush", "evening"),
)


def as_flag(cond: Column) -> Column:
    """1 where the condition holds, else 0 (null counts as 0)."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def cyclic(x, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a value on a circle of the given period."""
    angle = c(x) * F.lit(2 * math.pi) / F.lit(period)
    return F.sin(angle), F.cos(angle)


def angle_from(sin, cos) -> Column:
    """Degrees of the angle with the given sine and cosine."""
    return F.degrees(F.atan2(c(sin), c(cos)))


def sky_onehot(cloud) -> dict[str, Column]:
    """Sunny (<= 2), cloudy (<= 6), rainy flags of cloud cover in eighths."""
    x = c(cloud)
    return {
        "weather_sunny": as_flag(x <= 2),
        "weather_cloudy": as_flag((x > 2) & (x <= 6)),
        "weather_rainy": rainy(x),
    }


def rainy(cloud, above: float = 6) -> Column:
    return as_flag(c(cloud) > above)


def precip_estimate(humidity, cloud) -> Column:
    """Precipitation guessed from humidity and cloud cover."""
    h, k = c(humidity), c(cloud)
    return (
        F.when((h > 90) & (k > 6), F.lit(2.0))
        .when((h > 80) & (k > 4), F.lit(0.5))
        .otherwise(F.lit(0.0))
    )


def daypart_onehot(hour, isodow, date=None) -> dict[str, Column]:
    """Day-part flags, school travel, weekend and (with a date) day of month."""
    h, d = c(hour), c(isodow)
    out = {name: as_flag(h.between(lo, hi)) for name, (lo, hi) in DAY_PARTS.items()}
    out["school_commute_hour"] = as_flag((d <= 5) & h.isin(*SCHOOL_HOURS))
    out["is_weekend"] = weekend_flag(d)
    if date is not None:
        out["day_of_month"] = F.dayofmonth(c(date))
    return out


def rush_type(hour) -> Column:
    """1 in the morning rush, 2 in the evening rush, else 0."""
    h = c(hour)
    am, pm = DAY_PARTS["rush_hour_morning"], DAY_PARTS["rush_hour_evening"]
    return F.when(h.between(*am), 1).when(h.between(*pm), 2).otherwise(0)


def peak_flag(hour) -> Column:
    return as_flag(c(hour).isin(*PEAK_HOURS))


def weekend_flag(isodow) -> Column:
    return as_flag(c(isodow) >= 6)


def bin_label(x, edges, labels) -> Column:
    """Label of the half-open bin [edge, next edge) a value falls in; null outside."""
    v = c(x)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for lo, hi, label in zip(edges, edges[1:], labels):
        out = out.when((v >= lo) & (v < hi), F.lit(label))
    return out


def humidex(temperature, dew_point) -> Column:
    """Felt temperature from air temperature and dew point in Celsius, two digits."""
    t, d = c(temperature).cast("double"), c(dew_point).cast("double")
    vapour = F.lit(6.11) * F.exp(F.lit(5417.753) * (F.lit(1 / 273.15) - 1 / (d + 273.15)))
    return F.round(t + F.lit(0.5555) * (vapour - 10), 2)


def key(*cols, sep: str = "_") -> Column:
    """Composite text key; use real columns inside a job and this only at its edge."""
    return F.concat_ws(sep, *[c(x).cast("string") for x in cols])


def key_part(col, i: int, sep: str = "_") -> Column:
    """The i-th (0-based) part of a composite key, null when absent."""
    return F.get(F.split(c(col), sep), F.lit(i))


def map_codes(col, mapping: dict, default: str) -> Column:
    """Code to label; unknown and null codes give the default."""
    v = c(col)
    out = F.when(F.lit(False), F.lit(default))
    for code, label in mapping.items():
        out = out.when(v == code, F.lit(label))
    return out.otherwise(F.lit(default))


def finite(col) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    v = c(col).cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
