"""Joins between feeds, schedules, weather, alerts and predictions.

No side is forced to be broadcast: the planner does that for sides below its size threshold and
otherwise shuffles, where adaptive execution splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from headway.functions.clock import c, hour_start, micros
from headway.operators.nearest import GROUP, nearest_sites


def stop_updates_flat(t: dict[str, DataFrame]) -> DataFrame:
    """Stop-time updates with trip, entity, message and header columns.

    The descriptors come last, so that the shuffles before carry none of their columns.
    """
    return (
        t["stop_time_updates"]
        .join(t["trip_updates"], "trip_update_id")
        .join(t["feed_entities"], "feed_entity_id")
        .join(t["feed_messages"], "feed_message_id")
        .join(t["feed_headers"], "feed_message_id")
        .join(t["trip_descriptors"], "trip_descriptor_id")
    )


def chain(dfs: Sequence[DataFrame], keys: Sequence, how: str = "inner") -> DataFrame:
    """Join frames left to right, the i-th step on the i-th key list."""
    return reduce(lambda a, kb: a.join(kb[1], kb[0], how), zip(keys, dfs[1:]), dfs[0])


def star_enrich(base: DataFrame, dims: Sequence[DataFrame], keys: Sequence) -> DataFrame:
    """A fact joined to its dimensions, each on its own key list."""
    return chain([base, *dims], keys)


def positions_on_schedule(vp, td, st, stops) -> DataFrame:
    """Vehicle positions matched to the scheduled stop with the same sequence, plus the stop."""
    seen = vp.drop("stop_id").join(td, "trip_descriptor_id")
    planned = st.select(
        F.col("trip_id"), F.col("stop_sequence"), F.col("stop_id"), F.col("arrival_secs"),
        F.col("arrival_day_offset"),
    )
    return (
        seen.withColumnRenamed("current_stop_sequence", "stop_sequence")
        .join(planned, ["trip_id", "stop_sequence"])
        .join(stops, "stop_id")
    )


def group_stat_back(
    df, keys: Sequence[str], stats: dict[str, Column], min_n: int = 5, of: DataFrame | None = None
) -> DataFrame:
    """Group statistics of groups with at least ``min_n`` rows, joined back to every row.

    ``of`` are the rows that are counted, if they are not those of ``df``.
    """
    counted = (df if of is None else of).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), *[s.alias(n) for n, s in stats.items()]
    )
    return df.join(counted.where(F.col("_n") >= min_n).drop("_n"), list(keys), "left")


def with_weather(df, weather, ts: str, bucket: str = "datetime_60") -> DataFrame:
    """Rows with the weather of their clock hour; hours without weather drop out."""
    return df.withColumn(bucket, hour_start(ts)).join(weather, bucket)


def alert_detail(alerts, entities, periods, texts) -> DataFrame:
    """Alerts with affected entities, active period and English texts, distinct rows.

    Texts are found under their short and their long type names. The entities come last: an
    alert that names very many of them is only spread out in that one join.
    """
    span = periods.groupBy("alert_id").agg(
        F.min("period_start").alias("period_start"), F.max("period_end").alias("period_end")
    )
    english = texts.where((F.col("language") == "en") | F.col("language").isNull())

    def text_of(kind: str, name: str) -> DataFrame:
        both = (kind, f"{kind}_text")
        return english.where(F.col("text_type").isin(*both)).select(
            "alert_id", F.col("text").alias(name)
        )

    described = (
        alerts.join(span, "alert_id", "left")
        .join(text_of("header", "header_text"), "alert_id", "left")
        .join(text_of("description", "description_text"), "alert_id", "left")
        .join(text_of("url", "url"), "alert_id", "left")
    )
    return (
        described.join(entities, "alert_id", "left")
        .select(
            "alert_id", "cause", "effect", "severity_level", "route_id", "stop_id", "agency_id",
            "route_type", "header_text", "description_text", "url",
            F.timestamp_seconds("period_start").cast("timestamp_ntz").alias("active_period_start"),
            F.timestamp_seconds("period_end").cast("timestamp_ntz").alias("active_period_end"),
            "created_at",
        )
        .distinct()
    )


def interval_join(
    left, right, keys: Sequence[str], lt: str, rt: str, seconds: int = 3600, how: str = "left"
) -> DataFrame:
    """Join where ``right.rt <= left.lt < right.rt + seconds`` and the keys agree.

    Both sides get the time bucket of the interval width as a further equality key (a right row
    touches at most two buckets), so this is a hash join, not a range scan.
    """
    us = seconds * 1_000_000
    a = left.withColumn("_bucket", F.floor(micros(lt) / us))
    first = F.floor(micros(rt) / us)
    last = F.floor((micros(rt) + us - 1) / us)
    b = right.withColumn("_bucket", F.explode(F.sequence(first, last)))
    b = b.select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.col("_bucket").alias("_r_bucket"),
                 *[x for x in right.columns if x not in keys])
    cond = F.col("_bucket") == F.col("_r_bucket")
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_r_{k}"))
    lu, ru = micros(lt), micros(rt)
    cond = cond & (ru <= lu) & (ru + us > lu)
    return a.join(b, cond, how).drop("_bucket", "_r_bucket", *[f"_r_{k}" for k in keys])


WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def expand_calendar(calendar: DataFrame) -> DataFrame:
    """One row per service and date of its weekly pattern: each row expands to its own dates."""
    days = calendar.where(F.col("start_date") <= F.col("end_date")).withColumn(
        "service_date", F.explode(F.sequence("start_date", "end_date", F.expr("INTERVAL 1 DAY")))
    )
    runs = F.get(F.array(*WEEKDAYS), F.weekday("service_date")) == 1
    return days.where(runs).select("service_date", "service_id")


def anti(df, removed, keys: Sequence[str]) -> DataFrame:
    """Rows without a partner in ``removed``."""
    return df.join(removed.select(*keys), list(keys), "left_anti")


def semi(df, other, keys: Sequence[str]) -> DataFrame:
    """Rows with a partner in ``other``, never duplicated."""
    return df.join(other.select(*keys), list(keys), "left_semi")


def new_rows(df, target, keys: Sequence[str]) -> DataFrame:
    """One row per key that the target does not hold yet.

    Which of several new rows of a key stays is decided by the smallest row, not by arrival.
    """
    rest = [x for x in df.columns if x not in keys]
    fresh = anti(df, target, keys)
    if not rest:
        return fresh.distinct()
    return fresh.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def exists_flag(df, other, keys: Sequence[str], name: str) -> DataFrame:
    """1 where ``other`` has a row with the same keys, else 0."""
    marks = other.select(*keys).distinct().withColumn(name, F.lit(1))
    return df.join(marks, list(keys), "left").withColumn(name, F.coalesce(name, F.lit(0)))


def latest_batch(df, keys: Sequence[str], created_at: str) -> DataFrame:
    """All rows of the newest batch of each key, ties kept; rows with a null key drop out.

    A rank compared with a constant is cut on the map side: the rows are shuffled once, and of a hot key only
    the newest batch of each task. The newest batch of one key has to fit a task.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(created_at).desc())
    known = df.na.drop(subset=[*keys, created_at])
    return known.withColumn("_rank", F.rank().over(w)).where("_rank = 1").drop("_rank")


def previous_step(df, other, key: Sequence[str], seq: str, value: str, name: str) -> DataFrame:
    """Value of ``other`` one sequence number earlier on the same key."""
    shifted = other.select(*key, (F.col(seq) + 1).alias(seq), F.col(value).alias(name))
    return df.join(shifted, [*key, seq], "left")


def next_per_group(df, group: Sequence[str], ts: str, as_of) -> DataFrame:
    """The rows of each group with the earliest time not before ``as_of``, ties kept."""
    w = Window.partitionBy(*group).orderBy(F.col(ts).asc())
    later = df.where(F.col(ts) >= F.lit(as_of).cast("timestamp_ntz"))
    return later.withColumn("_rank", F.rank().over(w)).where("_rank = 1").drop("_rank")


def fallback(df, primary: str, secondary: str, name: str) -> DataFrame:
    return df.withColumn(name, F.coalesce(F.col(primary).cast("double"), F.col(secondary).cast("double")))


def lookup(df, dim, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Left join of chosen columns of a dimension that has one row per key."""
    return df.join(dim.select(*keys, *cols), list(keys), "left")


def back_merge(df, feats, key: Sequence[str]) -> DataFrame:
    return df.join(feats, list(key), "left")


def expected_vs_actual(expected, actual, keys: Sequence[str], cap: int = 5) -> DataFrame:
    """Observed row counts per expected key, 0 when none; ``shown`` stops at ``cap``."""
    n = actual.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    out = expected.select(*keys).distinct().join(n, list(keys), "left")
    out = out.withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("shown", F.least(F.col("n"), F.lit(cap)))


def count_per_parent(parent, child, key: Sequence[str], name: str = "n") -> DataFrame:
    """Every parent row with its number of children.

    Children are counted before the join, so a parent with most of them costs one row.
    """
    n = child.groupBy(*key).agg(F.count(F.lit(1)).alias(name))
    return parent.join(n, list(key), "left").withColumn(name, F.coalesce(name, F.lit(0)))


def multi_mean(df, keys: Sequence[str], cols: Sequence[str], digits: int = 2) -> DataFrame:
    """Means of several columns in one aggregation (a full outer stitch of separate means)."""
    return df.groupBy(*keys).agg(*[F.round(F.avg(x), digits).alias(x) for x in cols])


def nearest(
    points: DataFrame,
    sites: DataFrame,
    px: str,
    py: str,
    sid: str,
    sx: str,
    sy: str,
    name: str = "nearest",
    group: int = GROUP,
) -> DataFrame:
    """The closest site (Euclidean in the given units) of every point, smallest id on ties.

    Works over a k-d partition of the sites in groups of ``group`` (:mod:`headway.operators.nearest`). Adds ``name``
    and ``<name>_dist``. Both are null for a point with a null, NaN or infinite coordinate and where there is no site;
    sites with such a coordinate do not count.
    """
    best = nearest_sites(points, sites, sid, sx, sy, px, py, group)
    best = best.select("_x", "_y", F.col("_id").alias(name), F.col("_d").alias(f"{name}_dist"))
    at = points.withColumns({"_x": F.col(px).cast("double"), "_y": F.col(py).cast("double")})
    return at.join(best, ["_x", "_y"], "left").drop("_x", "_y")
