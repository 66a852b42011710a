"""Train/test splits and folds as a column or a fold table.

"Random" means ordered by a hash of the row key and a seed, so a split is the same on every run
and engine. No split gathers ids on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from headway.functions.numbers import hash_text
from headway.operators.spans import HASH_DIGITS, place


def _label(df, ratio: float, pos="_pos", total="_total", name="split") -> DataFrame:
    cut = F.floor(F.col(total) * F.lit(float(ratio)))
    return df.withColumn(name, F.when(F.col(pos) <= cut, "train").otherwise("test")).drop(pos, total)


def split_temporal(df, order: Sequence, slices: Sequence[Column], ratio: float = 0.9) -> DataFrame:
    """The first share of rows by time is train."""
    return _label(place(df, [], order, slices, "_pos", "_total"), ratio)


def split_random(df, key: Sequence[str], ratio: float = 0.9, seed: int = 42) -> DataFrame:
    h = df.withColumn("_h", hash_text(*key, seed=seed))
    placed = place(h, [], [F.col("_h"), *[F.col(k) for k in key]], [F.substring("_h", 1, HASH_DIGITS)], "_pos", "_total")
    return _label(placed, ratio).drop("_h")


def split_groups(df, key: Sequence[str], ratio: float = 0.8, seed: int = 42) -> DataFrame:
    """Whole groups go to train or test; the share is of groups, not rows."""
    groups = split_random(df.select(*key).distinct(), key, ratio, seed)
    return df.join(groups, list(key))


def split_stratified(df, group: Sequence[str], key: Sequence[str], ratio: float = 0.8, seed: int = 42) -> DataFrame:
    """The share is taken inside every group."""
    h = df.withColumn("_h", hash_text(*key, seed=seed))
    placed = place(h, group, [F.col("_h"), *[F.col(k) for k in key]], [F.substring("_h", 1, 4)], "_pos", "_total")
    return _label(placed, ratio).drop("_h")


def split(df, method: str, **kw) -> DataFrame:
    """temporal, random, route_aware (whole groups) or stratified."""
    return {
        "temporal": split_temporal, "random": split_random, "route_aware": split_groups,
        "stratified": split_stratified,
    }[method](df, **kw)


def numbered_dates(df, date: str) -> DataFrame:
    """Distinct dates with their 0-based index and count; as long as the calendar."""
    d = df.select(date).where(F.col(date).isNotNull()).distinct()
    return d.withColumn("idx", F.row_number().over(Window.orderBy(date)) - 1).withColumn(
        "n_dates", F.count(F.lit(1)).over(Window.partitionBy())
    )


def split_dates(df, date: str, train=0.7, valid=0.15, test=0.15) -> DataFrame:
    """Whole dates to train, valid and test in time order; bounds are cut down to whole dates."""
    if abs(train + valid + test - 1.0) > 1e-6:
        raise ValueError("the shares must sum to 1")
    d = numbered_dates(df, date)
    first = F.floor(F.col("n_dates") * F.lit(float(train)))
    second = F.floor(F.col("n_dates") * F.lit(float(train + valid)))
    d = d.withColumn("split", F.when(F.col("idx") < first, "train").when(F.col("idx") < second, "valid").otherwise("test"))
    return df.join(d.select(date, "split"), date)


def fold_bounds(n: int, n_splits: int, train_size: int | None, test_size: int, gap: int, method: str):
    """(fold, train start, train end, test start, test end) as half-open index ranges."""
    out = []
    if method == "sliding":
        if train_size is None:
            raise ValueError("a sliding window needs train_size")
        spare = n - train_size - gap - test_size
        if spare < 0:
            raise ValueError(f"need at least {n - spare} dates, got {n}")
        step = max(1, spare // (n_splits - 1)) if n_splits > 1 else 1
        spans = [(i * step, i * step + train_size) for i in range(n_splits)]
    else:
        base = train_size or n // (n_splits + 1)
        if n < base + gap + test_size:
            raise ValueError(f"need at least {base + gap + test_size} dates, got {n}")
        step = (n - base - gap) // n_splits
        spans = [(0, base + i * step) for i in range(n_splits)]
    for i, (lo, hi) in enumerate(spans):
        start, end = hi + gap, hi + gap + test_size
        if method == "expanding":
            end = min(end, n)
        if end > n:
            break
        out.append((i, lo, hi, start, end))
    return out


def cv_folds(df, date: str, n_splits=5, train_size=None, test_size=7, gap=0, method="expanding") -> DataFrame:
    """Fold table (fold, role, date). Only the number of dates reaches the driver."""
    d = numbered_dates(df, date)
    n = d.count()
    bounds = fold_bounds(n, n_splits, train_size, test_size, gap, method)
    roles = F.array(
        *[
            F.struct(F.lit(i).alias("fold"), F.lit(role).alias("role"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
            for i, a, b, s, e in bounds
            for role, lo, hi in (("train", a, b), ("test", s, e))
        ]
    )
    return (
        d.withColumn("_r", F.explode(roles))
        .where((F.col("idx") >= F.col("_r.lo")) & (F.col("idx") < F.col("_r.hi")))
        .select(F.col("_r.fold").alias("fold"), F.col("_r.role").alias("role"), date)
    )


def fold_report(df, folds, date: str) -> DataFrame:
    """Dates and rows of each fold and role; rows are counted per date before the join."""
    per_date = df.groupBy(date).agg(F.count(F.lit(1)).alias("_n"))
    return folds.join(per_date, date).groupBy("fold", "role").agg(
        F.min(date).alias("first_date"), F.max(date).alias("last_date"),
        F.count(F.lit(1)).alias("n_dates"), F.sum("_n").alias("n_rows"),
    )


def split_report(df, group: Sequence[str], x: str, split: str = "split") -> DataFrame:
    """Rows, share, groups, nulls and basic statistics per split, and groups in more than one."""
    whole = df.agg(F.count(F.lit(1))).scalar()
    shared = (
        df.select(split, *group).distinct().groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        .agg(F.count(F.lit(1))).scalar()
    )
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(*group).alias("n_groups"),
        F.count_if(F.col(x).isNull()).alias("n_null"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"), F.max(x).alias("max"),
    ).withColumn("share", F.col("n_rows") / whole).withColumn("shared_groups", shared)
