"""Encoders and scalers. A fitted scaler is a small frame that can be stored and applied later."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from headway.operators.distribution import percentiles
from headway.operators.spans import place


def label_fit(df, x: str, unknown: str = "unknown") -> DataFrame:
    """Codes 0.. of the distinct values in alphabetical order (null reads as ``unknown``).

    Values are numbered in slices between sampled values (:func:`_cuts`), so that codes of any shape
    stay spread.
    """
    d = df.select(F.coalesce(F.col(x), F.lit(unknown)).alias(x)).distinct()
    return place(d, [], [F.col(x)], [_cuts(d, x)], "_pos").select(
        x, (F.col("_pos") - 1).cast("int").alias(f"{x}_encoded")
    )


def _cuts(d: DataFrame, x: str, slices: int = 256) -> Column:
    """Slice number of a value: how many of at most ``slices`` cut points it is not below.

    The cut points are the values with the smallest hashes, an even sample whose size is fixed.
    """
    points = sorted(r[0] for r in d.orderBy(F.xxhash64(x), x).limit(slices).collect())
    kind = d.schema[x].dataType
    if not points:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(p).cast(kind) for p in points]), lambda p: p <= F.col(x)))


def label_apply(df, x: str, codes: DataFrame, unknown: str = "unknown") -> DataFrame:
    """Codes joined to rows; values not seen in the fit get -1."""
    name = f"{x}_encoded"
    c = codes.select(F.col(x).alias("_v"), name)
    out = df.withColumn("_v", F.coalesce(F.col(x), F.lit(unknown))).join(c, "_v", "left")
    return out.withColumn(name, F.coalesce(name, F.lit(-1))).drop("_v")


def standard_fit(df, cols: Sequence[str]) -> DataFrame:
    """One row with mean and population deviation of each column."""
    aggs = []
    for x in cols:
        aggs += [F.avg(x).alias(f"{x}_mean"), F.stddev_pop(x).alias(f"{x}_std")]
    return df.agg(*aggs)


def _scalar(fit: DataFrame) -> Column:
    return fit.select(F.struct(*fit.columns)).scalar()


def standard_apply(df, fit: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """(x - mean) / deviation with the fitted values; a deviation of 0 counts as 1."""
    s = _scalar(fit)
    return df.withColumns(
        {
            f"{x}{suffix}": (F.col(x) - s[f"{x}_mean"])
            / F.when(s[f"{x}_std"] == 0, F.lit(1.0)).otherwise(s[f"{x}_std"])
            for x in cols
        }
    )


def standard_inverse(df, fit: DataFrame, x: str, of: str) -> DataFrame:
    """Back to the original scale of column ``of``."""
    s = _scalar(fit)
    return df.withColumn(x, F.col(x) * s[f"{of}_std"] + s[f"{of}_mean"])


def standard_fit_steps(df, x: str = "x") -> DataFrame:
    """Mean and population deviation per feature over all samples and steps of ``x``."""
    flat = df.select(F.explode(x).alias("v")).select(F.posexplode("v").alias("feature", "v"))
    return flat.groupBy("feature").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def standard_apply_steps(df, fit: DataFrame, x: str = "x") -> DataFrame:
    """Scale arrays of feature vectors; the fit has one row per feature."""
    s = fit.agg(F.sort_array(F.collect_list(F.struct("feature", "mean", "std")))).scalar()
    scaled = F.transform(
        x,
        lambda step: F.zip_with(
            step, F.col("_fit"),
            lambda v, p: (v - p["mean"]) / F.when(p["std"] == 0, F.lit(1.0)).otherwise(p["std"]),
        ),
    )
    return df.withColumn("_fit", s).withColumn(x, scaled).drop("_fit")


def robust_fit(df, cols: Sequence[str]) -> DataFrame:
    """Median and interquartile range of each column, one row per column."""
    long = df.select(
        F.explode(F.array(*[F.struct(F.lit(x).alias("column"), F.col(x).cast("double").alias("v")) for x in cols])).alias("e")
    ).select("e.*")
    q = percentiles(long, "v", [0.25, 0.5, 0.75], ["column"], ["q1", "median", "q3"])
    return q.select("column", "median", (F.col("q3") - F.col("q1")).alias("iqr"))


def robust_apply(df, fit: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    s = fit.agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("median", "iqr"))))).scalar()

    def scaled(x):
        p = F.try_element_at(s, F.lit(x))
        return (F.col(x) - p["median"]) / F.when(p["iqr"] == 0, F.lit(1.0)).otherwise(p["iqr"])

    return df.withColumns({f"{x}{suffix}": scaled(x) for x in cols})


def poly2(df, vec: str, out: str = "poly") -> DataFrame:
    """All terms of degree one and two of a vector column."""
    from pyspark.ml.feature import PolynomialExpansion

    return PolynomialExpansion(degree=2, inputCol=vec, outputCol=out).transform(df)


def flatten_vector(df, cols: Sequence, out: str = "features") -> DataFrame:
    """Numbers, arrays and arrays of arrays laid out in one ML vector."""
    from pyspark.ml.functions import array_to_vector

    parts = []
    for x in cols:
        kind = df.schema[x].dataType.simpleString()
        if kind.startswith("array<array"):
            parts.append(F.flatten(F.col(x)))
        elif kind.startswith("array"):
            parts.append(F.transform(F.col(x), lambda v: v.cast("double")))
        else:
            parts.append(F.array(F.col(x).cast("double")))
    return df.withColumn(out, array_to_vector(F.concat(*parts)))
