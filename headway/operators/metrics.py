"""Evaluation of predicted against observed delays; every metric is a single aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from headway.functions.encode import finite
from headway.operators.distribution import percentiles

# Error bands and delay levels in seconds; lower bound included, upper excluded.
WITHIN = {"within_30s": 30, "within_1min": 60, "within_2min": 120, "within_5min": 300}
ON_TIME = 60
LEVELS = (
    ("Very Early", None, -120), ("Early", -120, -30), ("On Time", -30, 30),
    ("Minor Delay", 30, 300), ("Major Delay", 300, None),
)


def metric_columns(y: str, yhat: str) -> dict[str, Column]:
    a, p = F.col(y), F.col(yhat)
    err = a - p
    out = {
        "n": F.count(F.lit(1)),
        "mae": F.avg(F.abs(err)),
        "mse": F.avg(err * err),
        "rmse": F.sqrt(F.avg(err * err)),
        "r2": 1 - F.avg(err * err) / F.nullif(F.var_pop(a), F.lit(0.0)),
        "direction_accuracy": F.avg((F.signum(a) == F.signum(p)).cast("double")),
        "ontime_accuracy": F.avg(((F.abs(a) <= ON_TIME) == (F.abs(p) <= ON_TIME)).cast("double")),
    }
    for name, bound in WITHIN.items():
        out[name] = F.avg((F.abs(err) <= bound).cast("double"))
    out["mape"] = F.avg(F.when(a != 0, F.abs(err / F.nullif(a, F.lit(0.0))))) * 100
    return out


def regression_metrics(df, y: str, yhat: str, by: Sequence[str] = ()) -> DataFrame:
    """Error measures over rows where both values are finite."""
    d = df.where(finite(y) & finite(yhat))
    return d.groupBy(*by).agg(*[c.alias(n) for n, c in metric_columns(y, yhat).items()])


def accuracy_by(df, y: str, yhat: str, by: Sequence[str]) -> DataFrame:
    return regression_metrics(df, y, yhat, by)


def metrics_by_step(df, step: str, y: str, yhat: str) -> DataFrame:
    return regression_metrics(df, y, yhat, [step])


def masked_metrics(df, mask: str, y: str, yhat: str, by: Sequence[str] = ()) -> DataFrame:
    """Metrics over observed cells only."""
    return regression_metrics(df.where(F.col(mask).cast("int") == 1), y, yhat, by)


def scenario_metrics(df, scenarios: dict[str, Column], y: str, yhat: str, by: Sequence[str] = ()) -> DataFrame:
    """Metrics per named condition; a row counts in every scenario it meets."""
    tags = F.array_compact(F.array(*[F.when(cond, F.lit(n)) for n, cond in scenarios.items()]))
    return regression_metrics(df.withColumn("scenario", F.explode(tags)), y, yhat, ["scenario", *by])


def level_of(y) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    v = F.col(y)
    for name, lo, hi in LEVELS:
        cond = (v < hi) if lo is None else (v >= lo) if hi is None else (v >= lo) & (v < hi)
        out = out.when(cond, name)
    return out


def delay_levels(df, y: str, yhat: str) -> DataFrame:
    """Errors per delay level; levels without rows show 0."""
    d = df.where(finite(y) & finite(yhat))
    err = F.col(y) - F.col(yhat)
    cols = {
        "count": F.count(F.lit(1)), "mae": F.avg(F.abs(err)), "rmse": F.sqrt(F.avg(err * err)),
        "direction_accuracy": F.avg((F.signum(y) == F.signum(yhat)).cast("double")),
        "true_mean": F.avg(y), "pred_mean": F.avg(yhat),
    }
    got = d.withColumn("level", level_of(y)).groupBy("level").agg(*[c.alias(n) for n, c in cols.items()])
    names = F.array(*[F.lit(n) for n, _, _ in LEVELS])
    total = d.agg(F.count(F.lit(1)).alias("_all")).withColumn("level", F.explode(names))
    out = total.join(got, "level", "left")
    out = out.withColumns({n: F.coalesce(n, F.lit(0 if n == "count" else 0.0)) for n in cols})
    share = F.when(F.col("_all") > 0, F.col("count") * 100.0 / F.col("_all")).otherwise(0.0)
    return out.withColumn("percentage", share).drop("_all")


def error_by(df, key, err: str) -> DataFrame:
    """Mean, sample deviation and count of errors per key."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(F.avg(err).alias("mean"), F.stddev_samp(err).alias("std"), F.count(err).alias("count"))


def route_error(df, route: str, y: str, yhat: str, min_n: int = 50) -> DataFrame:
    err = F.abs(F.col(y) - F.col(yhat))
    return df.groupBy(route).agg(
        F.avg(err).alias("mae"), F.stddev_samp(err).alias("mae_std"), F.avg(y).alias("avg_delay"),
        F.count(F.lit(1)).alias("n"),
    ).where(F.col("n") >= min_n)


def trend(df, x: str, y: str) -> DataFrame:
    """Correlation and straight line of y over x, one row."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    return df.agg(F.corr(a, b).alias("corr"), F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"))


def trip_errors(df, key: Sequence[str], y: str, yhat: str) -> DataFrame:
    err = F.col(y) - F.col(yhat)
    return df.groupBy(*key).agg(
        F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"), F.max(F.abs(err)).alias("max_error"),
        F.avg(y).alias("mean_actual"), F.avg(yhat).alias("mean_pred"),
    )


def outlier_profile(df, x: str, cols: Sequence[str], q: float = 0.95) -> DataFrame:
    """Means of some columns for rows above the q-quantile of x and for the rest."""
    bound = percentiles(df, x, [q], names=["b"]).select(F.first("b")).scalar()
    return df.withColumn("is_outlier", F.col(x) > bound).groupBy("is_outlier").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in cols]
    )


def outlier_routes(df, x: str, route: str, q: float = 0.95) -> DataFrame:
    """Outliers and their share per route, routes with outliers only."""
    bound = percentiles(df, x, [q], names=["b"]).select(F.first("b")).scalar()
    out = df.groupBy(route).agg(F.count_if(F.col(x) > bound).alias("n_outliers"), F.count(F.lit(1)).alias("n"))
    return out.where("n_outliers > 0").withColumn("rate", F.col("n_outliers") * 100.0 / F.col("n"))


def importance_by_group(df, groups: dict[str, Sequence[str]], feature="feature", value="importance") -> DataFrame:
    name = F.when(F.lit(False), F.lit(""))
    for g, members in groups.items():
        name = name.when(F.col(feature).isin(*members), g)
    return df.groupBy(name.otherwise("other").alias("group")).agg(
        F.sum(value).alias("sum"), F.avg(value).alias("mean"), F.count(value).alias("count")
    )
