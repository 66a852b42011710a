"""Baselines, Spark ML regressors, tuning, importances and batch scoring."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import ElementwiseProduct, PolynomialExpansion, StandardScaler, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.storagelevel import StorageLevel

from headway.functions.clock import c
from headway.functions.encode import finite
from headway.functions.numbers import hash_text
from headway.operators import gram, trees
from headway.operators.metrics import masked_metrics, regression_metrics
from headway.operators.scaling import standard_inverse
from headway.operators.sequences import past_trips, trip_vectors, windows
from headway.operators.spans import HASH_DIGITS, place
from headway.operators.windows import last_row
from headway.sinks.tables import stage

LABEL, FEATURES, PREDICTION = "label", "features", "prediction"

# Default settings of the regressors and the grids that tuning tries. ``alpha`` and
# ``l1_ratio`` are penalties as :func:`penalty` reads them; depth 30 is the deepest Spark allows; a node
# needs twice ``minInstancesPerNode`` rows to be split.
DEFAULTS = {
    "linear": {},
    "ridge": {"alpha": 1.0},
    "lasso": {"alpha": 1.0, "maxIter": 1000},
    "elastic": {"alpha": 1.0, "l1_ratio": 0.5, "maxIter": 1000},
    "random_forest": {"numTrees": 100, "maxDepth": 30, "seed": 42},
    "gradient_boosting": {"maxIter": 100, "stepSize": 0.1, "maxDepth": 3, "seed": 42},
}
GRIDS = {
    "ridge": {"alpha": [0.1, 1.0, 10.0, 100.0]},
    "lasso": {"alpha": [0.1, 1.0, 10.0, 100.0]},
    "elastic": {"alpha": [0.1, 1.0, 10.0], "l1_ratio": [0.1, 0.5, 0.9]},
    "random_forest": {"numTrees": [50, 100, 200], "maxDepth": [30, 10, 20], "minInstancesPerNode": [1, 3, 5]},
    "gradient_boosting": {"maxIter": [50, 100, 200], "stepSize": [0.01, 0.1, 0.2], "maxDepth": [3, 5, 7]},
}


def baseline(df: DataFrame, kind: str = "mean", past: str = "past", name: str = PREDICTION) -> DataFrame:
    """Predicted vector per sample: the last trip, or the mean of the past trips per stop."""
    n = F.size(past)
    if kind == "last":
        return df.withColumn(name, F.get(past, n - 1))
    sums = F.aggregate(
        F.slice(past, F.lit(2), F.greatest(n - 1, F.lit(0))), F.get(past, F.lit(0)),
        lambda acc, row: F.zip_with(acc, row, lambda a, b: a + b),
    )
    return df.withColumn(name, F.transform(sums, lambda v: v / n))


def long_errors(df: DataFrame, ids: Sequence[str], target: str = "target", pred: str = PREDICTION) -> DataFrame:
    """One row per sample and position from target and prediction vectors."""
    pairs = F.arrays_zip(F.col(target).alias("y"), F.col(pred).alias("yhat"))
    return df.select(*ids, F.posexplode(pairs).alias("position", "p")).select(*ids, "position", "p.*")


class Facts(NamedTuple):
    """Rows of a training set and the population deviation of its label."""

    n: int
    deviation: float


def facts(rows: DataFrame) -> Facts:
    r = rows.agg(F.count(F.lit(1)), F.stddev_pop(LABEL)).first()
    return Facts(r[0], r[1] or 0.0)


def penalty(kind: str, alpha: float, l1_ratio: float, f: Facts) -> dict:
    """Spark's strength and mixture for a penalty on the label's own scale.

    Ridge adds ``alpha * |w|^2`` to the sum of squared errors. Lasso and elastic-net add ``alpha * l1_ratio * |w|_1 +
    alpha * (1 - l1_ratio) / 2 * |w|^2`` to half their mean. Spark divides the label by its deviation
    first, which leaves the first-order part as stated and divides the quadratic one by the deviation.
    """
    first, second = (0.0, alpha / max(1, f.n)) if kind == "ridge" else (alpha * l1_ratio, alpha * (1 - l1_ratio))
    strength = first + second * f.deviation
    return {"regParam": strength, "elasticNetParam": first / strength if strength else 0.0}


def settings_of(kind: str, f: Facts, **params) -> dict:
    """Default and given settings in Spark's names."""
    p = {**DEFAULTS[kind], **params}
    if "alpha" in p:
        ratio = p.pop("l1_ratio", 1.0 if kind == "lasso" else 0.5)
        p |= penalty(kind, p.pop("alpha"), ratio, f)
    return p


def regressor(kind: str, f: Facts, **params):
    cls = {"random_forest": RandomForestRegressor, "gradient_boosting": GBTRegressor}.get(kind, LinearRegression)
    p = settings_of(kind, f, **params)
    if cls is LinearRegression:
        p = {"standardization": False, **p}  # the features come standardized
    return cls(featuresCol=FEATURES, labelCol=LABEL, predictionCol=PREDICTION, **p)


def model_input(cols: Sequence[str], n: int, poly: bool = False, scale: bool = True, out: str = FEATURES) -> list:
    """Stages that assemble, expand and standardize features; fitted once with the model.

    Deviations are population ones: Spark's scaler takes the sample deviation of the ``n`` rows, which
    the last stage corrects. A row with a null keeps its place with a vector of NaN.
    """
    steps, last = [VectorAssembler(inputCols=list(cols), outputCol="_raw", handleInvalid="keep")], "_raw"
    width = len(cols)
    if poly:
        steps.append(PolynomialExpansion(degree=2, inputCol=last, outputCol="_poly"))
        last, width = "_poly", width + width * (width + 1) // 2
    if scale:
        steps.append(StandardScaler(inputCol=last, outputCol="_scaled", withMean=True, withStd=True))
        ratio = Vectors.dense([(n / max(1, n - 1)) ** 0.5] * width)
        steps.append(ElementwiseProduct(scalingVec=ratio, inputCol="_scaled", outputCol=out))
    else:
        steps[-1].setOutputCol(out)
    return steps


def estimator(kind: str, cols: Sequence[str], f: Facts, poly: bool = False, **params) -> Pipeline:
    return Pipeline(stages=[*model_input(cols, f.n, poly), regressor(kind, f, **params)])


def complete(cols: Sequence[str]) -> Column:
    """True where every feature is a number."""
    each = [F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double")) for x in cols]
    return functools.reduce(lambda a, b: a & b, each, F.lit(True))


def _labelled(df: DataFrame, y: str) -> DataFrame:
    return df.withColumn(LABEL, F.col(y).cast("double")).where(finite(LABEL))


def training_rows(df: DataFrame, cols: Sequence[str], y: str) -> DataFrame:
    """Features and label of the rows a model can learn from: finite label, complete features."""
    return _labelled(df, y).where(complete(cols)).select(*dict.fromkeys([*cols, LABEL]))


#: Rows from which trees are grown on cells, or on rows dealt evenly to all cores.
SPREAD = 100_000
#: Long rows of stops up to which they are kept for a fit.
LONG_ROWS = 2_000_000


def _uneven(rows: DataFrame, n: int) -> bool:
    """True where one part holds over twice a core's share of the ``n`` rows."""
    share = n / rows.sparkSession.sparkContext.defaultParallelism
    return rows.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] > 2 * share


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)


def _on_cached(make, rows: DataFrame, spread: bool = False, stored: bool = False):
    """``make(facts).fit`` on rows kept in executor memory and disk, since training reads them many times.

    Lost blocks are computed again from their source. Rows that are ``stored``, a few steps from a stored table, are not kept. With
    ``spread`` many rows are dealt evenly to all cores first: a file has as many parts as row groups, and every pass of a fit would run
    on those few.
    """
    rows = rows if stored else rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        f = facts(rows)
        return make(f).fit(_dealt(rows) if spread and f.n > SPREAD else rows)
    finally:
        if not stored:
            rows.unpersist()


class _Cells:
    """Grows trees on cells, which need no standardized features, or else by ``spark``'s estimator. Rows are dealt for a few passes only
    where they are uneven, and for Spark's many in any case, but for ``stored`` ones.
    """

    def __init__(self, kind: str, cols: Sequence[str], params: dict, spark: Pipeline, n: int, stored: bool):
        self.kind, self.cols, self.params, self.spark, self.n, self.stored = kind, list(cols), {**DEFAULTS[kind], **params}, spark, n, stored

    def fit(self, rows: DataFrame) -> PipelineModel:
        uneven = _uneven(rows, self.n)
        even = _dealt(rows).persist(StorageLevel.MEMORY_AND_DISK) if uneven else rows
        try:
            grown = trees.fit(self.kind, even, self.cols, LABEL, PREDICTION, **self.params)
        finally:
            if uneven:
                even.unpersist()
        if grown:
            return PipelineModel([VectorAssembler(inputCols=self.cols, outputCol="_raw", handleInvalid="keep"), grown])
        return self.spark.fit(rows if self.stored and not uneven else _dealt(rows))


def fit(kind: str, df: DataFrame, cols: Sequence[str], y: str, poly: bool = False, stored: bool = False, **params) -> PipelineModel:
    """Pipeline fitted to the rows with a label and all features. Trees of many rows and few features are grown on cells.

    ``stored`` says that the rows are cheap to make again and need not be kept for the passes of the fit.
    """
    tree = kind in trees.SETTINGS

    def make(f: Facts):
        p = estimator(kind, cols, f, poly, **params)
        return _Cells(kind, cols, params, p, f.n, stored) if tree and not poly and f.n > SPREAD else p

    return _on_cached(make, training_rows(df, cols, y), tree and poly, stored)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Every row with its prediction, null where a feature is missing."""
    cols = model.stages[0].getInputCols()
    out = model.transform(df).drop("_raw", "_poly", "_scaled", FEATURES)
    return out.withColumn(PREDICTION, F.when(complete(cols), F.col(PREDICTION)))


def combinations(grid: dict) -> list[dict]:
    return [dict(zip(grid, values)) for values in itertools.product(*grid.values())]


def _validator(kind, cols, grid, folds, seed, parallelism, f: Facts, **params):
    p = estimator(kind, cols, f, **params)
    last = p.getStages()[-1]
    inside = Facts(f.n * (folds - 1) // folds, f.deviation)
    maps = [{getattr(last, k): v for k, v in settings_of(kind, inside, **params, **s).items()} for s in combinations(grid or {})]
    return CrossValidator(
        estimator=p, estimatorParamMaps=maps,
        evaluator=RegressionEvaluator(labelCol=LABEL, predictionCol=PREDICTION, metricName="rmse"),
        numFolds=folds, seed=seed, parallelism=parallelism,
    )


LINEAR = ("ridge", "lasso", "elastic")


def tune(
    kind: str, df: DataFrame, cols, y: str, grid: dict | None = None, folds: int = 5, seed: int = 42, parallelism: int = 2, fold: Column | None = None, **params
):
    """Best model of a grid by k-fold RMSE, and the average score of every setting.

    Linear models score all settings and folds from one pass over the rows (:mod:`headway.operators.gram`); the folds are
    those of ``fold``, a whole number a row, or of a hash of the row. Trees are fitted setting by setting.
    """
    grid = GRIDS.get(kind, {}) if grid is None else grid
    settings = combinations(grid)
    if kind in LINEAR:
        part = F.pmod(F.xxhash64(F.lit(seed), *cols, y), F.lit(folds)) if fold is None else fold
        rows = _labelled(df, y).where(complete(cols))
        base = {k: v for k, v in {**DEFAULTS[kind], **params}.items() if k in ("alpha", "l1_ratio")}
        scores = gram.grid_scores(gram.moments(rows, cols, LABEL, part), kind, [{**base, **s} for s in settings])
        best = fit(kind, df, cols, y, **params, **settings[min(range(len(scores)), key=scores.__getitem__)])
    else:
        cv = _on_cached(lambda f: _validator(kind, cols, grid, folds, seed, parallelism, f, **params), training_rows(df, cols, y))
        scores, best = [float(m) for m in cv.avgMetrics], cv.bestModel
    return best, df.sparkSession.createDataFrame([(str(s), m) for s, m in zip(settings, scores)], "params string, rmse double")


def importances(model: PipelineModel, spark, cols: Sequence[str]) -> DataFrame:
    """Tree importances or absolute coefficients per feature, largest first."""
    last = model.stages[-1]
    values = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    names = list(cols) if len(cols) == len(values) else [f"feature_{i}" for i in range(len(values))]
    rows = [(n, abs(float(v))) for n, v in zip(names, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def fit_report(kind: str, train: DataFrame, valid: DataFrame, cols, y: str, folds: int = 0, **params):
    """Fitted model with its train, validation and (optionally) k-fold metrics as one frame."""
    model = fit(kind, train, cols, y, **params)

    def scored(df, name):
        return regression_metrics(predict(model, _labelled(df, y)), LABEL, PREDICTION).withColumn("part", F.lit(name))

    report = scored(train, "train").unionByName(scored(valid, "valid"))
    left_out = train.count() - training_rows(train, cols, y).count()
    report = report.withColumn("rows_left_out", F.lit(left_out))
    if folds:
        cv = _on_cached(lambda f: _validator(kind, cols, {}, folds, 42, 2, f, **params), training_rows(train, cols, y))
        report = report.withColumn("cv_rmse", F.lit(float(cv.avgMetrics[0])))
    return model, report


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def per_stop(samples: DataFrame, kind: str = "gradient_boosting", past: str = "past", target: str = "target", **params):
    """One model for all stop positions in long form: the position is a feature.

    Features per row: the position, all past delays, those at the position once more, the target trip's
    features where the samples have them, and the four summaries of the sample. The samples' arrays have one shape, which
    is read from the first of them.

    The long rows have a sample's numbers once for each of its positions. Over ``LONG_ROWS`` of them are not kept: the samples are stored,
    dealt to all cores, the long rows made from them in every pass, and nothing of them stays but the bins that Spark's trees hold.
    """
    kept = stage(samples, "stop-samples")
    has = "features" in samples.columns
    shape = kept.select(F.size(past), F.size(F.get(past, F.lit(0))), F.size("features") if has else F.lit(0)).first() or (0, 0, 0)
    n, have = shape[0], kept.count()
    many = have * shape[1] > LONG_ROWS
    if many:
        samples = stage(_dealt(kept), "stop-samples") if _uneven(kept, have) else kept
    long = samples.select("*", F.posexplode(target).alias("position", "y"))
    at = {f"past_{i}": F.get(F.get(past, F.lit(i)), F.col("position")) for i in range(n)}
    at |= {f"past_{i}_{j}": F.get(F.get(past, F.lit(i)), F.lit(j)) for i in range(n) for j in range(shape[1])}
    at |= {f"target_{k}": F.get("features", F.lit(k)) for k in range(shape[2])}
    long = long.withColumns(at).drop("features").withColumn("position", F.col("position").cast("double"))
    cols = ["position", *at, "past_mean", "past_std", "past_trend", "past_max"]
    model = fit(kind, long, cols, "y", stored=many, **params)
    return model, predict(model, long.withColumn(LABEL, F.col("y")))


def permute(df: DataFrame, cols: Sequence[str], key: Sequence[str], seed: int) -> DataFrame:
    """Columns exchanged between rows by a permutation that depends only on keys and seed.

    Rows are numbered in two hash orders and the values of one are handed to the other; both
    numberings are spread over hash slices.
    """
    def ranked(name, s):
        h = df.withColumn("_h", hash_text(*key, seed=s))
        return place(h, [], [F.col("_h"), *[F.col(k) for k in key]], [F.substring("_h", 1, HASH_DIGITS)], name).drop("_h")

    mine = ranked("_p", 2 * seed).drop(*cols)
    given = ranked("_p", 2 * seed + 1).select("_p", *cols)
    return mine.join(given, "_p").drop("_p").select(*df.columns)


def shift_of(copy, n):
    """By how many places copy number ``copy`` turns the hash order of ``n`` rows; never by none, where there are two rows."""
    return 1 + (copy * 7919 + 104729) % F.greatest(n - 1, F.lit(1))


def permuted_copies(df: DataFrame, features: Sequence[str], key: Sequence[str], repeats: int = 10, seed: int = 1) -> DataFrame:
    """Every row once for each feature and repeat, with that feature's value from another row.

    Rows are numbered once, in the order of a hash of their key; a copy turns that order by its own number of places, a bijection.
    So a row sends each copy one value, and the copies of all features and repeats are one exchange: the plan is the same for any
    number of repeats. Adds ``_feature`` (its number) and ``_repeat``. ``features`` are numbers.
    """
    h = df.withColumn("_h", hash_text(*key, seed=seed))
    order = [F.col("_h"), *[F.col(k) for k in key]]
    rows = stage(place(h, [], order, [F.substring("_h", 1, HASH_DIGITS)], "_p").drop("_h"), "permuted")
    n = rows.count()
    copies = F.explode(F.sequence(F.lit(0), F.lit(len(features) * repeats - 1))).alias("_copy")
    values = F.array(*[F.col(f).cast("double") for f in features])
    sent = rows.select("_p", values.alias("_all"), copies).select(
        (F.pmod(F.col("_p") - 1 - shift_of(F.col("_copy"), F.lit(n)), F.lit(max(n, 1))) + 1).alias("_p"),
        F.floor(F.col("_copy") / repeats).cast("int").alias("_feature"), (F.col("_copy") % repeats).alias("_repeat"), "_all",
    ).select("_p", "_feature", "_repeat", F.get("_all", F.col("_feature")).alias("_value"))
    put = {f: F.when(F.col("_feature") == i, F.col("_value").cast(df.schema[f].dataType)).otherwise(F.col(f)) for i, f in enumerate(features)}
    # The rows grow with the input: they are not to be broadcast by way of the driver, however few of them a run has.
    return rows.hint("merge").join(sent, "_p").withColumns(put).drop("_p", "_value")


def permute_steps(df: DataFrame, x: str, key: Sequence[str], strategy: str, seed, feature, block: int = 2) -> DataFrame:
    """Steps of one feature reordered inside each sample: single steps or blocks of steps.

    ``seed`` and ``feature`` (its number in a step) are numbers or columns.
    """
    size = 1 if strategy == "within_sample" else block
    steps = F.size(x)
    n = F.floor(steps / size).cast("int")
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    order = F.sort_array(
        F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.struct(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], seed.cast("string"), i.cast("string")).cast("binary")).alias("h"), i.alias("i")),
        )
    )

    def source(t):
        b = F.floor(t / size).cast("int")
        return F.when(b < n, F.get("_order", b)["i"] * size + t % size).otherwise(t)

    def rebuilt(step, t):
        return F.transform(step, lambda v, j: F.when(j == feature, F.get(F.get(F.col(x), source(t)), j)).otherwise(v))

    # Fewer steps than a block stay as they are: a sequence from 0 to -1 would run backwards.
    d = df.withColumn("_order", F.when(n > 0, order))
    return d.withColumn(x, F.when(F.col("_order").isNull(), F.col(x)).otherwise(F.transform(x, rebuilt))).drop("_order")


def step_copies(df: DataFrame, x: str, key: Sequence[str], n_features: int, repeats: int, strategy: str, block: int = 2) -> DataFrame:
    """Every sample once for each feature and repeat, the steps of that feature reordered; no exchange."""
    copies = df.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(n_features * repeats - 1))))
    tagged = copies.withColumns({"_feature": F.floor(F.col("_copy") / repeats).cast("int"), "_repeat": F.col("_copy") % repeats}).drop("_copy")
    return permute_steps(tagged, x, key, strategy, F.col("_repeat") + 1, F.col("_feature"), block)


def permutation_importance(model, df: DataFrame, cols, y: str, key: Sequence[str], repeats: int = 10, features=None, strategy: str = "cross_sample", x: str | None = None, block: int = 2) -> DataFrame:
    """Rise of the mean absolute error when a feature is permuted.

    ``cross_sample`` exchanges a column between samples; ``within_sample`` and ``block`` reorder the steps of
    feature number f inside each sample's step array ``x``. ``model`` is a fitted pipeline, or a function
    that adds a prediction. All features and repeats are one job over tagged copies of the rows, whose plan does not depend on
    the number of repeats.
    """
    score = model if callable(model) else lambda d: predict(model, d)
    named = _labelled(df, y).select(*dict.fromkeys([*key, *cols, *([x] if x else []), LABEL]))
    err = F.avg(F.abs(F.col(LABEL) - F.col(PREDICTION)))
    base = score(named).agg(err).first()[0]
    names = list(features or cols)
    if strategy == "cross_sample":
        tagged = permuted_copies(named, names, key, repeats)
    else:
        tagged = step_copies(named, x, key, len(names), repeats, strategy, block)
    rises = score(tagged).groupBy("_feature", "_repeat").agg((err - base).alias("rise"))
    label = F.get(F.array(*[F.lit(f) for f in names]), F.col("_feature"))
    return rises.groupBy(label.alias("feature")).agg(
        F.avg("rise").alias("importance"), F.stddev_pop("rise").alias("std"), F.lit(base).alias("baseline_mae")
    )


def decode(df: DataFrame, as_of: str, pred: str = PREDICTION, horizon: int = 3) -> DataFrame:
    """One row per sample and hour offset from a prediction vector.

    Offset 1 is the hour ``as_of`` falls in. Values that are not finite are left out.
    """
    at = F.lit(as_of).cast("timestamp_ntz")
    start = F.date_trunc("hour", at).cast("timestamp_ntz")
    rows = df.select("*", F.posexplode(F.slice(pred, 1, horizon)).alias("_i", "_v")).where(finite("_v"))
    rows = rows.withColumn("prediction_hour_offset", F.col("_i") + 1)
    return rows.withColumns(
        {
            "prediction_created_at": at,
            "prediction_target_time": start + F.make_dt_interval(F.lit(0), F.col("_i"), F.lit(0), F.lit(0)),
            "predicted_delay_seconds": F.round("_v", 2), "predicted_delay_minutes": F.round(F.col("_v") / 60, 2),
        }
    ).drop("_i", "_v", pred)


def with_run_meta(df: DataFrame, **meta) -> DataFrame:
    return df.withColumns({k: v if isinstance(v, Column) else F.lit(v) for k, v in meta.items()})


STOP_KEY = ("route_id", "direction_id", "stop_id")


def score_regions(status: DataFrame, as_of: str, features: Sequence[str], model=None, version: str = "baseline", n_in: int = 8, horizon: int = 3) -> DataFrame:
    """Predictions for every stop of every region from its last ``n_in`` rows, in one job.

    ``model`` maps a frame with the step array ``x`` to one with a prediction vector; without it
    the mean delay of the steps is carried forward. Scaling belongs to the model, so training
    statistics apply and the scored batch never changes them. ``status`` is read four times, so
    hand over a stored table.
    """
    cols = [*[f for f in features if f != "arrival_delay"], "arrival_delay"]
    order = ["time_bucket", "line_direction_link_order"]
    keys = ["region_id", *STOP_KEY]
    x = windows(status, keys, order, [], cols, "arrival_delay", n_in, horizon, mode="latest")
    if model is None:
        delays = F.transform("x", lambda s: F.get(s, F.lit(len(cols) - 1)))
        mean = F.aggregate(delays, F.lit(0.0), lambda a, v: a + v) / n_in
        scored = x.withColumn(PREDICTION, F.array_repeat(mean, horizon))
    else:
        scored = model(x)
    info = last_row(status, keys, order, ["stop_name", "stop_lat", "stop_lon", "line_direction_link_order"])
    out = decode(scored.drop("x"), as_of, horizon=horizon).join(info.withColumnRenamed("line_direction_link_order", "stop_sequence"), keys)
    span = status.groupBy("region_id").agg(F.min("time_bucket").alias("input_data_start"), F.max("time_bucket").alias("input_data_end"))
    count = x.groupBy("region_id").agg(F.count(F.lit(1)).cast("int").alias("sequence_count"))
    return with_run_meta(out.join(span, "region_id").join(count, "region_id"), model_version=version)


def grid_errors(df: DataFrame, fitted: DataFrame, of: str, mask: str, y: str, yhat: str) -> DataFrame:
    """Error of observed cells in original units."""
    back = standard_inverse(standard_inverse(df, fitted, y, of), fitted, yhat, of)
    return masked_metrics(back, mask, y, yhat)


def length_experiment(df: DataFrame, ns: Sequence[int], route_key, trip_key, ts, seq, delay, kind: str = "mean") -> DataFrame:
    """Metrics of a baseline for several history lengths. The trips' vectors are stored once for all of them."""
    out, vectors = None, stage(trip_vectors(df, route_key, trip_key, ts, seq, delay), "trip-vectors")
    for n in ns:
        s = baseline(past_trips(df, route_key, trip_key, ts, seq, delay, n, vectors=vectors), kind)
        m = regression_metrics(long_errors(s, [trip_key]), "y", "yhat").withColumn("n_past", F.lit(n))
        out = m if out is None else out.unionByName(m)
    return out
