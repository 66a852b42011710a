"""Fixed-length samples from ordered rows: one row per sample, steps as arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from headway.operators.spans import daily, rowwise
from headway.operators.windows import latest_per


def _vector(features: Sequence[str]) -> Column:
    return F.array(*[F.col(x).cast("double") for x in features])


def windows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slices: Sequence[Column],
    features: Sequence[str],
    target: str,
    n_in: int = 8,
    n_out: int = 3,
    mode: str = "train",
    min_len: int | None = None,
    marks: Sequence[str] = (),
) -> DataFrame:
    """Sliding windows with stride one.

    ``train``: ``x`` = n_in steps of feature vectors, ``y`` = the next n_out targets; keys with
    fewer than ``min_len`` rows give none. ``latest``: only the last n_in steps of each key.
    ``marks`` are columns reported for the first and last row (``first_*``, ``last_*``).
    Only the features are carried through the window.
    """
    row = F.struct(
        _vector(features).alias("f"), F.col(target).cast("double").alias("t"), *marks
    )
    order_cols = [F.col(x) for x in order]
    if mode == "latest":
        kept = latest_per(
            df.select(*keys, *order, row.alias("_r")), keys, [c.desc_nulls_last() for c in order_cols], n_in
        )
        steps = kept.groupBy(*keys).agg(
            F.sort_array(F.collect_list(F.struct(*order, "_r"))).alias("_s")
        ).where(F.size("_s") == n_in)
        first = [F.get("_s", F.lit(0))[f"_r"][m].alias(f"first_{m}") for m in marks]
        last = [F.get("_s", F.lit(n_in - 1))["_r"][m].alias(f"last_{m}") for m in marks]
        return steps.select(*keys, F.transform("_s", lambda s: s["_r"]["f"]).alias("x"), *first, *last)
    n = n_in + n_out
    fn = {"_s": lambda w: F.collect_list("_r").over(w.rowsBetween(0, n - 1))}
    slim = df.select(*keys, *order, row.alias("_r"), *[s.alias(f"_cut{i}") for i, s in enumerate(slices or [])])
    cuts = None if slices is None else [F.col(f"_cut{i}") for i in range(len(slices))]
    out = rowwise(slim, keys, order_cols, cuts, fn, ahead=n - 1, keep_pos=True, total="_len")
    out = out.where((F.size("_s") == n) & (F.col("_len") >= (min_len or n)))
    return out.select(
        *keys, F.col("_pos").alias("start"),
        *[F.get("_s", F.lit(0))[m].alias(f"first_{m}") for m in marks],
        *[F.get("_s", F.lit(n - 1))[m].alias(f"last_{m}") for m in marks],
        F.transform(F.slice("_s", 1, n_in), lambda s: s["f"]).alias("x"),
        F.transform(F.slice("_s", n_in + 1, n_out), lambda s: s["t"]).alias("y"),
    )


def stop_lists(df, route_key: str, seq: str) -> DataFrame:
    """Sorted stop sequence numbers of each route: as long as the route has stops."""
    return df.groupBy(route_key).agg(F.sort_array(F.collect_set(seq)).alias("stops"))


def trip_vectors(df, route_key: str, trip_key: str, ts: str, seq: str, delay: str, stops=None) -> DataFrame:
    """One row per trip: delays along the route's stop list, filled forward, zero padded.

    Every vector has the length of the longest stop list.
    """
    stops = stops if stops is not None else stop_lists(df, route_key, seq)
    longest = stops.agg(F.max(F.size("stops"))).scalar()
    cells = df.groupBy(route_key, trip_key, seq).agg(
        F.min(F.when(F.col(delay).isNotNull(), F.struct(ts, delay)))[delay].cast("double").alias("_v"),
        F.min(ts).alias("_t"),
    )
    trips = cells.groupBy(route_key, trip_key).agg(
        F.min("_t").alias("first_time"),
        F.map_from_entries(F.collect_list(F.struct(F.col(seq).alias("k"), F.col("_v").alias("v")))).alias("_m"),
    )
    start = F.struct(F.lit(0.0).alias("last"), F.array().cast("array<double>").alias("out"))

    def step(acc, s):
        v = F.coalesce(F.try_element_at(F.col("_m"), s), acc["last"])
        return F.struct(v.alias("last"), F.concat(acc["out"], F.array(v)).alias("out"))

    filled = F.aggregate("stops", start, step)["out"]
    return (
        trips.join(stops, route_key)
        .withColumn("delays", F.concat(filled, F.array_repeat(F.lit(0.0), longest - F.size("stops"))))
        .select(route_key, trip_key, "first_time", "delays")
    )


def mean_of(arr) -> Column:
    a = F.col(arr) if isinstance(arr, str) else arr
    return F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, v: s + v), F.size(a))


def std_of(arr) -> Column:
    """Population deviation of an array."""
    a = F.col(arr) if isinstance(arr, str) else arr
    m = mean_of(a)
    return F.sqrt(F.aggregate(F.transform(a, lambda v: v * v), F.lit(0.0), lambda s, v: s + v) / F.size(a) - m * m)


def past_trips(df, route_key, trip_key, ts, seq, delay, n: int = 5, stops=None, slices=None, features: Sequence[str] = (), vectors=None) -> DataFrame:
    """Delays of the past ``n`` trips of the same route as a matrix, with the target trip's.

    Adds mean, population deviation, trend (mean of the latest minus mean of the earliest trip)
    and maximum of the matrix. Trips with fewer than ``n`` predecessors give no row. ``features`` are
    columns of the target trip: the array ``features`` has of each the first value that is not null,
    or 0. ``vectors`` are the rows' :func:`trip_vectors`, for callers that use them several times.
    """
    vec = trip_vectors(df, route_key, trip_key, ts, seq, delay, stops) if vectors is None else vectors
    cuts = slices or daily("first_time")
    fn = {"past": lambda w: F.collect_list("delays").over(w.rowsBetween(-n, -1))}
    out = rowwise(vec, [route_key], [F.col("first_time"), F.col(trip_key)], cuts, fn, back=n)
    out = out.where(F.size("past") == n).withColumn("_flat", F.flatten("past"))
    mean = F.try_divide(F.aggregate("_flat", F.lit(0.0), lambda s, v: s + v), F.size("_flat"))
    out = out.withColumn("past_mean", mean)
    squares = F.transform("_flat", lambda v: F.pow(v - F.col("past_mean"), 2))
    spread = F.try_divide(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v), F.size("_flat"))
    if features:
        firsts = [F.min(F.when(F.col(x).isNotNull(), F.struct(ts, seq, F.col(x).cast("double").alias("v"))))["v"] for x in features]
        own = df.groupBy(route_key, trip_key).agg(F.array(*[F.coalesce(v, F.lit(0.0)) for v in firsts]).alias("features"))
        out = out.join(own, [route_key, trip_key], "left")
    return (
        out.withColumn("past_std", F.sqrt(spread))
        .withColumn("past_trend", mean_of(F.get("past", F.lit(n - 1))) - mean_of(F.get("past", F.lit(0))))
        .withColumn("past_max", F.array_max("_flat"))
        .withColumnRenamed("delays", "target")
        .drop("_flat")
    )


def grid_windows(grid, keys: Sequence[str], ts: str, x: str, slices, mask: str = "observed", size: int = 6) -> DataFrame:
    """Per key: ``size`` consecutive grid values, the next one and whether it was observed."""
    fn = {
        "past": lambda w: F.collect_list(F.coalesce(F.col(x), F.lit(0.0))).over(w.rowsBetween(-size, -1)),
    }
    out = rowwise(grid, keys, [F.col(ts)], slices, fn, back=size)
    return out.where(F.size("past") == size).select(
        *keys, ts, "past", F.col(x).alias("next"), F.col(mask).alias("observed")
    )


def stop_edges(df, trip: Sequence[str], order: Sequence, slices, stop: str) -> DataFrame:
    """Distinct directed edges between consecutive stops of a trip, no self loops."""
    out = rowwise(
        df.select(*dict.fromkeys([*trip, *[o for o in order if isinstance(o, str)], stop])),
        trip, [F.col(o) if isinstance(o, str) else o for o in order], slices,
        {"dst": lambda w: F.lead(stop).over(w)}, ahead=1,
    )
    return (
        out.select(F.col(stop).alias("src"), "dst").where(F.col("dst").isNotNull() & (F.col("src") != F.col("dst"))).distinct()
    )


def source_mask(stops, edges, stop: str) -> DataFrame:
    """1 for stops that start an edge, else 0."""
    src = edges.select(F.col("src").alias(stop)).distinct().withColumn("node_mask", F.lit(1))
    return stops.select(stop).distinct().join(src, stop, "left").withColumn("node_mask", F.coalesce("node_mask", F.lit(0)))
