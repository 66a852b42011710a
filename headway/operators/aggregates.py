"""Grouped summaries. All are built-in aggregates with map-side combination."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from headway.functions.clock import floor_to, hour_start

# Alert codes of the summary and the weight of each effect code (1 for the rest).
HIGH_IMPACT = (1, 4)
CAUSE_FLAGS = {"alert_police_activity": 10, "alert_construction": 9, "alert_technical_problem": 2}
EFFECT_FLAGS = {"alert_effect_no_service": 1, "alert_effect_detour": 4}
EFFECT_WEIGHT = {1: 10, 3: 8, 4: 7, 6: 5, 9: 4, 2: 3}


def _n() -> Column:
    return F.count(F.lit(1))


def group_mean_having(df, keys: Sequence[str], x: str, min_n: int = 5) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(x).alias("mean"), _n().alias("n")).where(F.col("n") >= min_n)


def route_hour_stats(df, delay="arrival_delay", travel="travel_time_duration", digits=3) -> DataFrame:
    return df.groupBy("route_id", "direction_id", "hour_of_day").agg(
        F.round(F.avg(delay), digits).alias("delay_mean_by_route_hour"),
        F.round(F.avg(travel), digits).alias("travel_mean_by_route_hour"),
    )


def hourly_delay(
    df, keys: Sequence[str], means: Sequence[str], firsts: Sequence[str], order: Sequence[str],
    min_obs: int = 2,
) -> DataFrame:
    """Means, row count and the first known value of static columns per bucket.

    "First" follows ``order``, so it is the same on every run.
    """

    def first_of(x):
        return F.min(F.when(F.col(x).isNotNull(), F.struct(*order, F.col(x).alias("_v"))))["_v"]

    return (
        df.groupBy(*keys)
        .agg(
            *[F.avg(x).alias(x) for x in means],
            *[first_of(x).alias(x) for x in firsts],
            _n().alias("observation_count"),
        )
        .where(F.col("observation_count") >= min_obs)
    )


def weather_bucket(df, bucket: str, cols: Sequence[str]) -> DataFrame:
    return df.groupBy(bucket).agg(*[F.avg(x).alias(x) for x in cols])


def bucket_mean(df, key: str, ts: str, seconds: int, cols: Sequence[str], digits: int = 2) -> DataFrame:
    """Means per key and time bucket of fixed width."""
    return df.groupBy(key, floor_to(ts, seconds).alias("bucket")).agg(
        *[F.round(F.avg(x), digits).alias(x) for x in cols]
    )


def alert_features(detail, start: str = "active_period_start") -> DataFrame:
    """Alert counts and severity per route and hour of the alert's start.

    Codes that are not numbers count as other.
    """
    d = detail.where(F.col("route_id").isNotNull() & F.col(start).isNotNull())
    d = d.withColumn("_cause", F.col("cause").cast("string").try_cast("int")).withColumn(
        "_effect", F.col("effect").cast("string").try_cast("int")
    )

    flags = {
        "high_impact_alert_count": F.col("_effect").isin(*HIGH_IMPACT),
        **{n: F.col("_cause") == code for n, code in CAUSE_FLAGS.items()},
        **{n: F.col("_effect") == code for n, code in EFFECT_FLAGS.items()},
    }
    weight = F.when(F.lit(False), 0)
    for code, points in EFFECT_WEIGHT.items():
        weight = weight.when(F.col("_effect") == code, points)
    # An alert's rows are folded first, so that counting alerts needs no distinct and no copies of rows.
    once = d.groupBy("route_id", hour_start(start).alias("alert_hour"), "alert_id").agg(
        *[F.max(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()], F.sum(weight.otherwise(1)).alias("_points")
    )
    return once.groupBy("route_id", "alert_hour").agg(
        F.max(F.lit(1)).alias("has_active_alert"),
        *[F.count_if(F.col(n) & F.col("alert_id").isNotNull()).alias(n) for n in flags],
        F.coalesce(F.sum("_points"), F.lit(0)).alias("alert_severity_score"),
    )


def min_max_per(df, key: str, x: str) -> DataFrame:
    return df.groupBy(key).agg(F.min(x).alias(f"min_{x}"), F.max(x).alias(f"max_{x}"))


def region_status(df, region="region_id", delay="arrival_delay", lat="stop_lat") -> DataFrame:
    """Mean delay and latitude extremes per region."""
    return df.groupBy(region).agg(
        F.min(lat).alias("min_lat"), F.max(lat).alias("max_lat"), F.avg(delay).alias("avg_delay_seconds")
    )


def mean_per(df, keys: Sequence[str], x: str, name: str | None = None) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(x).alias(name or f"avg_{x}"))


def min_per(df, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.min(x).alias(x) for x in cols])


def route_summary(df, late: int = 300, early: int = -300, route="route_id", travel=None) -> DataFrame:
    """Rows, distinct dates, trips and stops, date range, delay statistics and late/early rows.

    The distinct counts are exact. Each is a narrow aggregate of its own, stitched by route: together they
    would make a copy of every row for each of them.
    """
    d = F.col("arrival_delay")
    counts = {"unique_dates": "start_date", "unique_trips": "trip_id", "unique_stops": "stop_id"}
    stitched = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [df.groupBy(route).agg(F.count_distinct(x).alias(n)) for n, x in counts.items()],
    )
    extra = [F.avg(travel).alias("avg_travel_time")] if travel else []
    main = df.groupBy(route).agg(
        _n().alias("total_records"),
        F.min("start_date").alias("earliest_date"),
        F.max("start_date").alias("latest_date"),
        F.avg(d).alias("avg_delay"),
        F.stddev_samp(d).alias("stddev_delay"),
        *extra,
        F.count_if(d > late).alias("late_records"),
        F.count_if(d < early).alias("early_records"),
    )
    names = [x for x in main.columns if x != route]
    both = main.unionByName(stitched, allowMissingColumns=True).groupBy(route).agg(*[F.max(x).alias(x) for x in [*names, *counts]])
    return both.select(route, names[0], *counts, *names[1:])


def available_routes(df, start=None, min_records: int = 1000) -> DataFrame:
    d = df if start is None else df.where(F.col("start_date") >= F.lit(start))
    return (
        d.groupBy("route_id", "route_short_name")
        .agg(
            _n().alias("record_count"), F.count_distinct("start_date").alias("date_count"),
            F.min("start_date").alias("earliest_date"), F.max("start_date").alias("latest_date"),
        )
        .where(F.col("record_count") >= min_records)
        .orderBy(F.desc("record_count"), "route_id")
    )


def date_coverage(df, limit: int = 30) -> DataFrame:
    """Rows, trips and mean delay of the latest dates."""
    return (
        df.groupBy("start_date")
        .agg(_n().alias("record_count"), F.count_distinct("trip_id").alias("trip_count"),
             F.avg("arrival_delay").alias("avg_delay"))
        .orderBy(F.desc("start_date")).limit(limit)
    )


def distinct_array(df, key: str, cols: Sequence[str]) -> DataFrame:
    """Sorted distinct values of each column per key.

    The arrays are as long as the number of distinct values (headsigns of a stop), since equal
    values are dropped before they are gathered.
    """
    return df.groupBy(key).agg(*[F.sort_array(F.collect_set(x)).alias(x) for x in cols])


def _unpivot(one_row: DataFrame, cols: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """One row with columns <part>_<i> to one row per column."""
    rows = F.array(
        *[
            F.struct(F.lit(x).alias("column"), *[F.col(f"{p}_{i}").alias(p) for p in parts])
            for i, x in enumerate(cols)
        ]
    )
    return one_row.select(F.explode(rows).alias("r")).select("r.*")


def missing_summary(df, cols: Sequence[str] | None = None) -> DataFrame:
    """Null count and percent (one digit) of each column, in one pass."""
    cols = list(cols or df.columns)
    row = df.agg(
        *[F.count_if(F.col(x).isNull()).alias(f"missing_count_{i}") for i, x in enumerate(cols)],
        *[
            F.round(F.avg(F.col(x).isNull().cast("double")) * 100, 1).alias(f"missing_percentage_{i}")
            for i, x in enumerate(cols)
        ],
    )
    return _unpivot(row, cols, ["missing_count", "missing_percentage"])


def null_counts_per(df, key: str, cols: Sequence[str]) -> DataFrame:
    return df.groupBy(key).agg(
        _n().alias("n_rows"), *[F.count_if(F.col(x).isNull()).alias(f"null_{x}") for x in cols]
    )


def all_null_keys(df, key: str, col: str) -> DataFrame:
    """Keys that never have a value."""
    return df.groupBy(key).agg(F.count(col).alias("n")).where("n = 0").select(key)


def jointly_missing(df, cols: Sequence[str]) -> DataFrame:
    """Number of rows where all the columns are null."""
    cond = F.lit(True)
    for x in cols:
        cond = cond & F.col(x).isNull()
    return df.agg(F.count_if(cond).alias("n"))


def extremes_per(df, keys: Sequence[str], x: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.min(x).alias("min"), F.max(x).alias("max"), F.min(F.abs(F.col(x))).alias("abs_min")
    )


def mean_by(df, key, x: str) -> DataFrame:
    keys = [key] if isinstance(key, (str, Column)) else list(key)
    return df.groupBy(*keys).agg(F.avg(x).alias("mean"), _n().alias("n"))


def pivot_mean(df, row: str, col: str, values: Sequence, x: str) -> DataFrame:
    """Means as a matrix; the columns are given, so no extra pass looks for them."""
    return df.groupBy(row).pivot(col, list(values)).agg(F.avg(x))


def with_without(df, keys: Sequence[str], flag: str, x: str) -> DataFrame:
    """Mean with and without a flag per key where both occur, and the difference."""
    on = F.col(flag) == 1
    return (
        df.groupBy(*keys)
        .agg(F.avg(F.when(on, F.col(x))).alias("with_flag"), F.avg(F.when(~on, F.col(x))).alias("without_flag"))
        .na.drop(subset=["with_flag", "without_flag"])
        .withColumn("difference", F.col("with_flag") - F.col("without_flag"))
    )


def completeness(observed, scheduled, key: Sequence[str], item: str) -> DataFrame:
    """Distinct observed and scheduled items per key and their ratio."""
    have = observed.select(*key, item).distinct().groupBy(*key).agg(_n().alias("observed"))
    want = scheduled.select(*key, item).distinct().groupBy(*key).agg(_n().alias("expected"))
    return (
        want.join(have, list(key), "left")
        .withColumn("observed", F.coalesce("observed", F.lit(0)))
        .withColumn("ratio", F.col("observed") / F.col("expected"))
    )


def count_matrix(df, row: str, col: str, cap: int = 5) -> DataFrame:
    """Rows per cell: the count, and as ``shown`` the count up to ``cap``."""
    return df.groupBy(row, col).agg(_n().alias("n"), F.least(_n(), F.lit(cap)).alias("shown"))


def stop_type_agg(
    df, trip: Sequence[str], seq: str, delay: str, ts: str, tie: Sequence[str] = (),
    others: Sequence[str] = (), name: str = "arrival_delay_agg",
) -> DataFrame:
    """One delay per (trip, sequence): the largest at the first stop, the smallest at the last,
    the earliest observation in between.

    All three are taken in one aggregation; the trip's ends come from a window over the reduced
    rows (at most one per stop), not over the raw rows.
    """
    known = F.when(F.col(delay).isNotNull(), F.struct(ts, *tie, F.col(delay).alias("_v")))
    cells = df.groupBy(*trip, seq).agg(
        F.max(delay).alias("_max"), F.min(delay).alias("_min"), F.min(known)["_v"].alias("_first"),
        *[F.min(F.when(F.col(x).isNotNull(), F.struct(ts, *tie, F.col(x).alias("_v"))))["_v"].alias(x) for x in others],
    )
    w = Window.partitionBy(*trip)
    cells = cells.withColumn("seq_min", F.min(seq).over(w)).withColumn("seq_max", F.max(seq).over(w))
    kind = F.when(F.col(seq) == F.col("seq_max"), "last").when(F.col(seq) == F.col("seq_min"), "first").otherwise("middle")
    value = F.when(F.col("stop_type") == "last", F.col("_min")).when(F.col("stop_type") == "first", F.col("_max")).otherwise(F.col("_first"))
    return cells.withColumn("stop_type", kind).withColumn(name, value).drop("_max", "_min", "_first")


def sequence_gaps(df, keys: Sequence[str], seq: str) -> DataFrame:
    """Missing sequence numbers per key between its first and last, one row per number.

    Gaps come from neighbouring distinct numbers; only missing numbers are generated.
    """
    nums = df.select(*keys, seq).distinct()
    w = Window.partitionBy(*keys).orderBy(seq)
    gap = nums.withColumn("_next", F.lead(seq).over(w)).where(F.col("_next") > F.col(seq) + 1)
    return gap.select(*keys, F.explode(F.sequence(F.col(seq) + 1, F.col("_next") - 1)).alias("missing_seq"))


def gap_report(df, keys: Sequence[str], seq: str) -> DataFrame:
    """Keys with gaps: first and last number and how many are missing."""
    nums = df.groupBy(*keys).agg(
        F.min(seq).alias("min_seq"), F.max(seq).alias("max_seq"), F.count_distinct(seq).alias("_n")
    )
    return nums.withColumn(
        "gap_count", F.col("max_seq") - F.col("min_seq") + 1 - F.col("_n")
    ).where("gap_count > 0").drop("_n")


def trip_agg(df, keys: Sequence[str], delay: str, ts: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(delay).alias("trip_mean_delay"), F.min(ts).alias("first_scheduled"))


def trip_rows(df, keys: Sequence[str], order: Sequence[str], firsts: Sequence[str], means: Sequence[str]) -> DataFrame:
    """One row per trip: first known value of some columns, mean of others."""
    return df.groupBy(*keys).agg(
        *[F.min(F.when(F.col(x).isNotNull(), F.struct(*order, F.col(x).alias("_v"))))["_v"].alias(x) for x in firsts],
        *[F.avg(x).alias(x) for x in means],
    )


def corr_pairs(df, cols: Sequence[str], min_abs: float = 0.0) -> DataFrame:
    """Correlation of every pair of columns in one pass; pairs at or above the bound."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    row = df.agg(*[F.corr(a, b).alias(f"r_{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(
        *[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r_{i}").alias("r")) for i, (a, b) in enumerate(pairs)]
    )
    return row.select(F.explode(rows).alias("p")).select("p.*").where(F.abs("r") >= min_abs)


def circular_mean_col(deg) -> Column:
    """Mean direction in degrees, 0 <= mean < 360, as an aggregate column."""
    rad = F.radians(F.col(deg) if isinstance(deg, str) else deg)
    mean = F.degrees(F.atan2(F.avg(F.sin(rad)), F.avg(F.cos(rad))))
    return F.when(mean < 0, mean + 360).otherwise(mean)


def circular_mean(df, deg: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(circular_mean_col(deg).alias("direction"))


def mode_of(df, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Most frequent value, smallest on ties; counts are combined before they are compared."""
    n = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(_n().alias("n"))
    return n.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(x).alias("v")))["v"].alias("mode"))


def value_counts(df, x: str) -> DataFrame:
    return df.groupBy(x).agg(_n().alias("n"))


def duplicate_keys(df, keys: Sequence[str]) -> DataFrame:
    return value_counts_by(df, keys).where("n > 1")


def value_counts_by(df, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(_n().alias("n"))


def histogram(df, x: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Rows per bin of equal width; the last bin includes ``hi``, values outside are left out."""
    width = (hi - lo) / bins
    at = F.least(F.floor((F.col(x) - lo) / width), F.lit(bins - 1))
    return (
        df.where(F.col(x).between(lo, hi)).groupBy(at.alias("bin")).agg(_n().alias("n"))
        .withColumn("bin_start", F.lit(lo) + F.col("bin") * width)
    )


def region_delay(df, grain: str, ts: str, region="region_id", delay="arrival_delay", as_of=None, on_time=60) -> DataFrame:
    """Delay per region in hourly, daily or recent (two hours before ``as_of``) form."""
    if grain == "recent":
        at = F.lit(as_of).cast("timestamp_ntz")
        df = df.where((F.col(ts) > at - F.expr("INTERVAL '2' HOUR")) & (F.col(ts) <= at))
        keys = [F.col(region)]
    else:
        unit = {"hourly": "hour", "daily": "day"}[grain]
        keys = [F.col(region), F.date_trunc(unit, ts).cast("timestamp_ntz").alias("period")]
    return df.groupBy(*keys).agg(
        F.avg(delay).alias("avg_delay"), _n().alias("n"),
        F.avg((F.abs(F.col(delay)) <= on_time).cast("double")).alias("on_time_rate"),
    )


def region_ranking(df, as_of, ts: str, days: int = 7, region="region_id", delay="arrival_delay", on_time=60) -> DataFrame:
    """Regions by mean absolute delay over the last days, with a grade by on-time share.

    Grades: A from 0.8, B from 0.6, C from 0.4, D below.
    """
    at = F.lit(as_of).cast("timestamp_ntz")
    recent = df.where((F.col(ts) > at - F.expr(f"INTERVAL '{int(days)}' DAY")) & (F.col(ts) <= at))
    s = recent.groupBy(region).agg(
        F.avg(F.abs(F.col(delay))).alias("avg_abs_delay"),
        F.avg((F.abs(F.col(delay)) <= on_time).cast("double")).alias("on_time_rate"),
    )
    rate = F.col("on_time_rate")
    grade = F.when(rate >= 0.8, "A").when(rate >= 0.6, "B").when(rate >= 0.4, "C").otherwise("D")
    return s.withColumn("rank", F.rank().over(Window.orderBy("avg_abs_delay"))).withColumn("grade", grade)


def daily_normals(df, ts: str, cols: Sequence[str]) -> DataFrame:
    """Mean, deviation and count per calendar day over the years, with the dates covered."""
    aggs = []
    for x in cols:
        aggs += [F.avg(x).alias(f"{x}_mean"), F.stddev_samp(x).alias(f"{x}_std"), F.count(x).alias(f"{x}_count")]
    return df.groupBy(F.month(ts).alias("month"), F.dayofmonth(ts).alias("day")).agg(
        *aggs, F.min(F.to_date(ts)).alias("first_date"), F.max(F.to_date(ts)).alias("last_date")
    )


def against_normals(df, normals, ts: str, cols: Sequence[str]) -> DataFrame:
    """Rows with the difference of each column to the normal of its calendar day."""
    d = df.withColumn("month", F.month(ts)).withColumn("day", F.dayofmonth(ts)).join(normals, ["month", "day"], "left")
    for x in cols:
        d = d.withColumn(f"{x}_anomaly", F.col(x) - F.col(f"{x}_mean"))
    return d
