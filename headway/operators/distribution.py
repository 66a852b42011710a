"""Exact quantiles, ranks and outlier rules without gathering a group in one task.

Percentiles of a whole column are selected by counts in buckets that get finer around the ranks asked for. Percentiles by
key, and ranks, count distinct values first (map-side combined) and rank them by cumulative counts over value slices of about equal
row counts, so that one key with a third of all rows is spread.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from headway.operators.spans import running


SLICES = 64


def value_slices(df: DataFrame, x: str) -> Column:
    """Number of the slice a value falls in; slices lie between approximate quantiles of the column.

    So they hold about as many rows each whatever the values' range, and there are at most
    :data:`SLICES` of them. The cut points are one small job before the query.
    """
    at = df.select(F.col(x).cast("double").alias("_x")).approxQuantile("_x", [i / SLICES for i in range(1, SLICES)], 0.005)
    cuts = [F.lit(p) for p in sorted(set(at or []))]
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*cuts), lambda p: p <= F.col(x)))


def value_ranks(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """One row per (key, distinct value): ``n`` rows, ``upto`` = rows <= value, ``total`` rows."""
    known = df.where(F.col(x).isNotNull())
    counts = known.groupBy(*keys, x).agg(F.count(F.lit(1)).alias("n"))
    return running(counts, keys, [F.col(x)], [value_slices(known, x)], F.col("n"), "upto", "total")


#: Buckets that an interval is counted in, and values that are left to the driver at most.
BUCKETS, LEFT = 4096, 50_000


def order_statistics(df: DataFrame, x: str, ranks: Callable[[int], Sequence[int]]) -> list[float] | None:
    """The values with the given ranks (from 1 on; a function of the number of values) of a numeric column, NaN last.

    Values are counted in buckets between their extremes; a bucket that holds a rank is counted in finer buckets between its own, all
    such buckets in one pass, until it has one value or few values are left. No task sorts or ranks anything: it sends at most
    ``BUCKETS`` counts an interval. A pass narrows each interval 4096 times; three are usual. None where a value is infinite.
    """
    v = F.col(x).cast("double")
    real = F.when(~F.isnan(v), v)
    all_, n, low, high = df.where(v.isNotNull()).agg(F.count(v), F.count(real), F.min(real), F.max(real)).first()
    if n and max(abs(low), abs(high)) == float("inf"):
        return None
    wanted = ranks(all_)
    found = {r: float("nan") for r in wanted if r > n}
    # Each open rank: the interval it lies in and the values below that.
    open_ = {r: (low, high, 0, n) for r in wanted if r <= n}
    while True:
        found |= {r: lo for r, (lo, hi, _b, _n) in open_.items() if lo == hi}
        open_ = {r: at for r, at in open_.items() if r not in found}
        if not open_:
            break
        spans = sorted(set(open_.values()))
        inside = [(v >= lo) & (v <= hi) for lo, hi, _b, _n in spans]
        which = F.coalesce(*[F.when(c, F.lit(i)) for i, c in enumerate(inside)])
        rows = df.select(v.alias("v"), which.alias("i")).where(F.col("i").isNotNull())
        if sum(k for _lo, _hi, _b, k in spans) <= LEFT:
            counts = rows.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
            cells = [(r["i"], r["v"], r["v"], r["n"]) for r in counts.collect()]
        else:
            at = F.coalesce(*[F.when(F.col("i") == i, _share(lo, hi)) for i, (lo, hi, _b, _n) in enumerate(spans)])
            b = F.least(F.floor(at * BUCKETS), F.lit(BUCKETS - 1))
            counts = rows.groupBy("i", b.alias("b")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))
            cells = [(r["i"], r["lo"], r["hi"], r["n"]) for r in counts.collect()]
        below = {i: base for i, (_lo, _hi, base, _n) in enumerate(spans)}
        for i, lo, hi, k in sorted(cells):
            for r, at in open_.items():
                if at == spans[i] and below[i] < r <= below[i] + k:
                    open_[r] = (lo, hi, below[i], k)
            below[i] += k
    return [found[r] for r in wanted]


def _share(lo: float, hi: float) -> Column:
    """Where ``v`` lies between two different bounds, from 0 to 1."""
    half = 1.0 if math.isfinite(hi - lo) else 0.5
    return (F.col("v") * half - lo * half) / (hi * half - lo * half)


def _percentiles_of_all(df: DataFrame, x: str, qs: Sequence[float], names: Sequence[str]) -> DataFrame | None:
    """Percentiles of a whole column of whole or floating numbers; None where they have to be ranked."""
    if dict(df.dtypes)[x] not in ("double", "float", "int", "bigint", "smallint", "tinyint"):
        return None
    at: list[float] = []

    def ranks(n):
        at[:] = [(n - 1) * float(q) for q in qs]
        return [int(f(h)) + 1 for h in at for f in (math.floor, math.ceil)] if n else []

    got = order_statistics(df, x, ranks)
    if got is None:
        return None
    row = [lo + (hi - lo) * (h - math.floor(h)) for lo, hi, h in zip(got[::2], got[1::2], at)] or [None] * len(qs)
    return df.sparkSession.createDataFrame([tuple(row)], T.StructType([T.StructField(k, T.DoubleType()) for k in names]))


def percentiles(
    df: DataFrame,
    x: str,
    qs: Sequence[float],
    keys: Sequence[str] = (),
    names: Sequence[str] | None = None,
) -> DataFrame:
    """Exact percentiles with linear interpolation, one column per q."""
    names = names or [f"p{int(round(q * 100))}" for q in qs]
    if not keys and (whole := _percentiles_of_all(df, x, qs, names)) is not None:
        return whole
    ranked = value_ranks(df, keys, x)

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("upto") >= rank, F.col(x)))

    aggs = []
    for q, name in zip(qs, names):
        h = (F.col("total") - 1) * F.lit(float(q))
        lo = F.floor(h)
        aggs += [
            at(lo + 1).alias(f"_lo_{name}"),
            at(F.ceil(h) + 1).alias(f"_hi_{name}"),
            F.max(h - lo).alias(f"_t_{name}"),
        ]
    out = ranked.groupBy(*keys).agg(*aggs)
    return out.select(
        *keys,
        *[
            (
                F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_t_{n}")
            ).alias(n)
            for n in names
        ],
    )


def median(df, x, keys=(), name="median") -> DataFrame:
    return percentiles(df, x, [0.5], keys, [name])


def mad_filter(df: DataFrame, x: str, k: float = 3) -> DataFrame:
    """Keep rows within ``k`` median absolute deviations of the median; all rows when it is 0.

    Null values go, unless the whole column is null.
    """
    mid = median(df, x).select(F.first("median")).scalar()
    off = df.select(F.abs(F.col(x) - mid).alias("_off"))
    mad = median(off, "_off").select(F.first("median")).scalar()
    return df.where(
        F.coalesce(mad == 0, F.lit(True)) | (F.abs(F.col(x) - mid) <= F.lit(float(k)) * mad)
    )


def sigma_filter(df: DataFrame, x: str, k: float = 3) -> DataFrame:
    """Keep rows within ``k`` sample standard deviations of the mean."""
    mean, std = df.agg(F.avg(x)).scalar(), df.agg(F.stddev_samp(x)).scalar()
    return df.where(~F.coalesce(F.abs((F.col(x) - mean) / F.nullif(std, F.lit(0.0))) > k, F.lit(False)))


def iqr_filter(df: DataFrame, x: str, k: float = 1.5) -> DataFrame:
    """Keep rows within ``k`` interquartile ranges of the quartiles."""
    q = percentiles(df, x, [0.25, 0.75], names=["q1", "q3"])
    box = q.select(F.struct(F.first("q1").alias("q1"), F.first("q3").alias("q3"))).scalar()
    reach = (box["q3"] - box["q1"]) * F.lit(float(k))
    return df.where((F.col(x) >= box["q1"] - reach) & (F.col(x) <= box["q3"] + reach))


def outlier_filter(df: DataFrame, x: str, method: str, hour: str | None = None) -> DataFrame:
    """Outlier rows removed by the named rule: asymmetric, iqr, zscore or mad."""
    if method == "asymmetric":
        from headway.operators.filters import asymmetric_anomaly

        extra = [*FLAGS_ADDED]
        return asymmetric_anomaly(df, x, hour).where(~F.col("should_exclude")).drop(*extra)
    rules = {"iqr": iqr_filter, "zscore": sigma_filter, "mad": mad_filter}
    return rules[method](df, x)


FLAGS_ADDED = (
    "is_rush_hour", "is_night_hour", "delay_threshold_adjusted", "early_threshold_adjusted",
    "is_minor_early", "is_major_early", "is_severe_early", "is_minor_delay", "is_major_delay",
    "is_severe_delay", "anomaly_level", "should_exclude",
)


def describe_exact(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max, one row per column."""
    long = df.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(x).alias("column"), F.col(x).cast("double").alias("v"))
                    for x in cols
                ]
            )
        ).alias("e")
    ).select("e.*")
    base = long.groupBy("column").agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"),
    )
    return base.join(percentiles(long, "v", [0.25, 0.5, 0.75], ["column"]), "column", "left")


def mann_whitney(df: DataFrame, group: str, x: str) -> DataFrame:
    """Two-sided Mann-Whitney U for two groups (flag 1 against 0).

    Average ranks for ties, tie-corrected normal approximation with continuity correction.
    One row: n1, n2, u1, z, p_value.
    """
    from headway.functions.numbers import normal_tail

    flag = F.col(group).cast("int")
    counts = (
        df.where(F.col(x).isNotNull() & F.col(group).isNotNull())
        .groupBy(x)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(flag).alias("n_first"))
    )
    ranked = running(counts, [], [F.col(x)], [value_slices(counts, x)], F.col("n"), "upto")
    rank = F.col("upto") - (F.col("n") - 1) / 2
    s = ranked.agg(
        F.sum("n").cast("double").alias("n"),
        F.sum("n_first").cast("double").alias("n1"),
        F.sum(rank * F.col("n_first")).alias("r1"),
        F.sum(F.pow(F.col("n").cast("double"), 3) - F.col("n")).alias("ties"),
    )
    s = s.withColumn("n2", F.col("n") - F.col("n1"))
    s = s.withColumn("u1", F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2)
    mean = F.col("n1") * F.col("n2") / 2
    var = F.col("n1") * F.col("n2") / 12 * (F.col("n") + 1 - F.try_divide("ties", F.col("n") * (F.col("n") - 1)))
    s = s.withColumn("z", F.try_divide(F.greatest(F.abs(F.col("u1") - mean) - 0.5, F.lit(0.0)), F.sqrt(var)))
    return s.select(
        F.col("n1").cast("long").alias("n1"), F.col("n2").cast("long").alias("n2"), "u1", "z",
        (2 * normal_tail(F.col("z"))).alias("p_value"),
    )
