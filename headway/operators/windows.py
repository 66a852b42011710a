"""Ordered features. Latest-row rules use a grouped limit or an aggregate; frames are split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from headway.functions.clock import seconds_between
from headway.operators.spans import place, rowwise, timewise, timewise_mean


def latest_per(df, keys: Sequence[str], order: Sequence, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in the given (total) order.

    A row number compared with a constant is cut on the map side, so a hot key sends at most
    ``n`` rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def dedup_keep_last(df, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ascending ``order``."""
    return latest_per(df, keys, [F.col(x).desc_nulls_last() for x in order])


def last_row(df, keys: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Chosen columns of the latest row of each key, as one aggregate."""
    return (
        df.groupBy(*keys).agg(F.max(F.struct(*order, F.struct(*cols).alias("_v")))["_v"].alias("_v"))
        .select(*keys, "_v.*")
    )


def lag_n(df, keys, order, slices, x: str, ns: Sequence[int], names=None) -> DataFrame:
    """Values ``n`` rows earlier."""
    names = names or [f"{x}_lag_{n}" for n in ns]
    exprs = {m: (lambda w, n=n: F.lag(x, n).over(w)) for m, n in zip(names, ns)}
    return rowwise(df, keys, order, slices, exprs, back=max(ns))


def next_value(df, keys, order, slices, x: str, name: str | None = None) -> DataFrame:
    return rowwise(df, keys, order, slices, {name or f"next_{x}": lambda w: F.lead(x).over(w)}, ahead=1)


def travel_seconds(df, keys, order, slices, ts: str, name="travel_time_raw_seconds") -> DataFrame:
    """Seconds since the previous row of the key; null on its first row."""
    out = rowwise(df, keys, order, slices, {"_prev": lambda w: F.lag(ts).over(w)}, back=1)
    return out.withColumn(name, seconds_between("_prev", ts)).drop("_prev")


def reversal_flag(df, keys, order, slices, ts: str, name="time_reversal") -> DataFrame:
    """True where time is earlier than on the row before."""
    out = rowwise(df, keys, order, slices, {"_prev": lambda w: F.lag(ts).over(w)}, back=1)
    return out.withColumn(name, F.coalesce(F.col(ts) < F.col("_prev"), F.lit(False))).drop("_prev")


def range_trend(df, keys, ts: str, x: str, back_seconds=3600, until_seconds=60, name="trend", slice_seconds=None) -> DataFrame:
    """Mean over the time range [ts - back, ts - until].

    Decimals keep their own means, frame by frame; everything else is summed as double, once per row.
    """
    if not isinstance(df.schema[x].dataType, T.DecimalType):
        return timewise_mean(df, keys, ts, x, name, back_seconds, until_seconds)
    return timewise(df, keys, ts, {name: lambda w: F.avg(x).over(w)}, back_seconds, until_seconds, slice_seconds)


def rows_mean(df, keys, order, slices, x: str, back=168, until=1, name="rows_mean", rows=None) -> DataFrame:
    fn = {name: lambda w: F.avg(x).over(w.rowsBetween(-back, -until))}
    return rowwise(df, keys, order, slices, fn, back=back, **({"rows": rows} if rows else {}))


def rows_std(df, keys, order, slices, x: str, back=3, until=1, name="rows_std") -> DataFrame:
    fn = {name: lambda w: F.stddev_samp(x).over(w.rowsBetween(-back, -until))}
    return rowwise(df, keys, order, slices, fn, back=back)


def deviation(df, order, slices, x: str, back=168, keys=(), name=None) -> DataFrame:
    """Value minus the mean of itself and the ``back`` rows before; meant for hourly weather."""
    fn = {"_m": lambda w: F.avg(x).over(w.rowsBetween(-back, 0))}
    out = rowwise(df, keys, order, slices, fn, back=back)
    return out.withColumn(name or f"{x}_deviation", F.col(x) - F.col("_m")).drop("_m")


def change(df, order, slices, x: str, keys=(), name=None) -> DataFrame:
    """Value minus the previous one; 0 on the first row."""
    out = rowwise(df, keys, order, slices, {"_prev": lambda w: F.lag(x).over(w)}, back=1)
    return out.withColumn(name or f"{x}_change", F.col(x) - F.coalesce("_prev", x)).drop("_prev")


def rolling_exprs(x: str, windows: Sequence[int], prefix: str) -> dict:
    exprs = {}
    for n in windows:
        exprs[f"{prefix}_mean_{n}"] = lambda w, n=n: F.coalesce(F.avg(x).over(w.rowsBetween(-n, -1)), F.lit(0.0))
        exprs[f"{prefix}_std_{n}"] = lambda w, n=n: F.coalesce(F.stddev_samp(x).over(w.rowsBetween(-n, -1)), F.lit(0.0))
    return exprs


def rolling(df, keys, order, slices, x: str, windows=(3, 5, 10), prefix="rolling") -> DataFrame:
    """Mean and sample deviation of the previous rows; 0 where there are too few."""
    return rowwise(df, keys, order, slices, rolling_exprs(x, windows, prefix), back=max(windows))


def moving_average(df, keys, order, slices, x: str, n: int, name="moving_average") -> DataFrame:
    return rowwise(df, keys, order, slices, {name: lambda w: F.avg(x).over(w.rowsBetween(-n, -1))}, back=n)


def group_bounds(df, keys: Sequence[str], x: str) -> DataFrame:
    """Group minimum and maximum on every row: aggregated first, then joined back."""
    b = df.groupBy(*keys).agg(F.min(x).alias(f"{x}_min"), F.max(x).alias(f"{x}_max"))
    return df.join(b, list(keys), "left")


def standardize_within(df, keys: Sequence[str], x: str, name: str | None = None) -> DataFrame:
    """Value minus group mean over group sample deviation; null where that is 0 or unknown."""
    s = df.groupBy(*keys).agg(F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"))
    z = (F.col(x) - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))
    return df.join(s, list(keys), "left").withColumn(name or f"{x}_z", z).drop("_m", "_s")


def historical_average(df, keys: Sequence[str], x: str, name="historical_average", min_n: int = 1) -> DataFrame:
    from headway.operators.joins import group_stat_back

    return group_stat_back(df, keys, {name: F.avg(x)}, min_n)


def order_index(df, keys, order, slices, name="order_index") -> DataFrame:
    """1-based place of each row in its key."""
    return place(df, keys, order, slices, name)


def order_of(trips: DataFrame, keys, ts: str, tie: Sequence[str], slices: Sequence[Column], name="trip_order"):
    return place(trips, keys, [F.col(ts), *tie], slices, name)
