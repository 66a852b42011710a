"""Service dates, clock times past midnight, local time and time buckets.

Wall-clock values are ``timestamp_ntz``; instants are ``timestamp_ntz`` in UTC. The session time
zone has to be UTC, so that a cast between the two timestamp types keeps the digits. The zone is a
constant, which keeps the conversion inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

LOCAL_ZONE = "America/Vancouver"


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_service_date(col) -> Column:
    """``YYYYMMDD`` as text or number to date; malformed text gives null."""
    return F.try_to_timestamp(c(col).cast("string"), F.lit("yyyyMMdd")).cast("date")


def split_extended_time(col) -> Column:
    """``H:MM:SS`` that may pass 24:00:00 to struct(tod seconds, day offset).

    Malformed or null text gives (null, 0).
    """
    text = F.trim(c(col).cast("string"))
    ok = text.rlike(r"^\d{1,3}:[0-5]\d:[0-5]\d$")
    part = F.split(text, ":")
    hour = part[0].try_cast("int")
    tod = (hour % 24) * 3600 + part[1].try_cast("int") * 60 + part[2].try_cast("int")
    return F.struct(
        F.when(ok, tod).alias("tod"),
        F.when(ok, F.floor(hour / 24).cast("int")).otherwise(F.lit(0)).alias("day_offset"),
    )


def clock_text(tod) -> Column:
    """Seconds of day to ``HH:MM:SS``."""
    t = c(tod)
    return F.format_string(
        "%02d:%02d:%02d",
        F.floor(t / 3600).cast("int"),
        (F.floor(t / 60) % 60).cast("int"),
        (t % 60).cast("int"),
    )


def wall_time(date, tod, day_offset) -> Column:
    """Date, seconds of day and day offset to a wall-clock timestamp."""
    start = F.date_add(c(date), c(day_offset).cast("int")).cast("timestamp_ntz")
    return start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), c(tod).cast("decimal(18,6)"))


def to_instant(wall, zone: str = LOCAL_ZONE) -> Column:
    """Wall clock in ``zone`` to a UTC timestamp.

    An hour that occurs twice is read as standard time, so the later of the two instants is
    taken: if the instant one hour later shows the same wall clock, that one is meant.
    """
    if zone == "UTC":
        return c(wall)
    w = c(wall).cast("timestamp")
    first = F.to_utc_timestamp(w, zone)
    later = first + F.expr("INTERVAL '1' HOUR")
    repeated = F.from_utc_timestamp(later, zone) == w
    return F.when(repeated, later).otherwise(first).cast("timestamp_ntz")


def to_local(instant, zone: str = LOCAL_ZONE) -> Column:
    """UTC timestamp to the wall clock of ``zone``."""
    if zone == "UTC":
        return c(instant)
    return F.from_utc_timestamp(c(instant).cast("timestamp"), zone).cast("timestamp_ntz")


def stop_actual_time(date, tod, day_offset, zone: str = LOCAL_ZONE) -> Column:
    """Scheduled local stop time as a UTC instant; null when a part is null."""
    return to_instant(wall_time(date, tod, F.coalesce(c(day_offset), F.lit(0))), zone)


def actual_arrival_time(date, stop_time: str, zone: str = LOCAL_ZONE) -> Column:
    """As :func:`stop_actual_time`, taking a struct(arrival_secs, arrival_day_offset)."""
    return stop_actual_time(
        date, F.col(f"{stop_time}.arrival_secs"), F.col(f"{stop_time}.arrival_day_offset"), zone
    )


def from_epoch(seconds) -> Column:
    """Epoch seconds to a UTC ``timestamp_ntz``."""
    return F.timestamp_seconds(c(seconds)).cast("timestamp_ntz")


def micros(ts) -> Column:
    """Microseconds since the epoch of a timestamp, read as UTC."""
    return F.unix_micros(c(ts).cast("timestamp"))


def epoch(ts) -> Column:
    """Whole seconds since the epoch, rounded down."""
    return F.floor(micros(ts) / 1_000_000).cast("long")


def seconds_between(start, end) -> Column:
    """Difference in seconds as double."""
    return (micros(end) - micros(start)) / F.lit(1e6)


def floor_to(ts, seconds: int) -> Column:
    """Start of the fixed-width bucket that holds ``ts``."""
    return F.timestamp_seconds(F.floor(epoch(ts) / seconds) * seconds).cast("timestamp_ntz")


def hour_start(ts) -> Column:
    return F.date_trunc("hour", c(ts)).cast("timestamp_ntz")


def isodow(date) -> Column:
    """Monday 1 .. Sunday 7."""
    return F.weekday(c(date)) + 1


def dow(date) -> Column:
    """Sunday 0 .. Saturday 6."""
    return F.dayofweek(c(date)) - 1


def padded_day_name(date) -> Column:
    """Day name padded with blanks to nine characters."""
    return F.rpad(F.date_format(c(date), "EEEE"), 9, " ")


def week_key(instant, zone: str = LOCAL_ZONE) -> Column:
    """Monday of the local week an instant falls in."""
    return F.date_trunc("week", to_local(instant, zone)).cast("date")
