"""Models and baselines on samples made from the given tables."""

from pyspark.sql import functions as F

from headway.catalog.base import query, r6, rounded
from headway.catalog.samples import PAST, past
from headway.operators import gram as gr, learning as le, metrics as me, splits as sp
from headway.operators.scaling import standard_apply, standard_fit
from headway.operators.sequences import windows
from headway.session import scratch_path
from headway.sinks.tables import stage

COLS = ["pred", "stop_sequence", "price"]


def rows(t):
    return t.upd.select("trip_id", *COLS, "delay", "part_id")


def parts(t):
    d = sp.split_groups(rows(t), ["trip_id"], 0.8)
    return d.where("split = 'train'").drop("split"), d.where("split = 'test'").drop("split")


@query("m01_baseline_mean", "upd", PAST + """, q AS (SELECT route, trip_id, stop_sequence, v, avg(v) OVER w AS yhat, count(*) OVER w AS have FROM m WINDOW w AS (PARTITION BY route, stop_sequence ORDER BY first_time, trip_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
SELECT count(*) AS n, round(avg(abs(v - yhat)) + 1e-9, 6) AS mae FROM q WHERE have = 3""")
def _(t):
    d = le.long_errors(le.baseline(past(t), "mean"), ["trip_id"])
    return d.agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.abs(F.col("y") - F.col("yhat")))).alias("mae"))


@query("m01_baseline_last", "upd", PAST + """, q AS (SELECT v, lag(v, 1) OVER w AS yhat, lag(v, 3) OVER w AS far FROM m WINDOW w AS (PARTITION BY route, stop_sequence ORDER BY first_time, trip_id))
SELECT count(*) AS n, round(avg(abs(v - yhat)) + 1e-9, 6) AS mae FROM q WHERE far IS NOT NULL""")
def _(t):
    d = le.long_errors(le.baseline(past(t), "last"), ["trip_id"])
    return d.agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.abs(F.col("y") - F.col("yhat")))).alias("mae"))


@query("m02_linear_fit", "upd", """, s AS (SELECT regr_slope(delay, pred) AS b, regr_intercept(delay, pred) AS a FROM upd) SELECT trip_id, stop_sequence, price, round(a + b * pred, 3) AS prediction FROM upd, s""")
def _(t):
    m = le.fit("linear", t.upd, ["pred"], "delay")
    return le.predict(m, t.upd).select("trip_id", "stop_sequence", "price", F.round("prediction", 3).alias("prediction"))


@query("m02_ridge_closed_form", "upd", """, c AS (SELECT avg(pred) AS mp, stddev_pop(pred) AS sp, avg(delay) AS md, count(*) AS n FROM upd),
w AS (SELECT sum((pred - mp) / sp * (delay - md)) / (any_value(n) + 100.0) AS b, any_value(mp) AS mp, any_value(sp) AS sp, any_value(md) AS md FROM upd, c)
SELECT trip_id, stop_sequence, price, round(md + b * (pred - mp) / sp, 3) AS prediction FROM upd, w""")
def _(t):
    m = le.fit("ridge", t.upd, ["pred"], "delay", alpha=100.0)
    return le.predict(m, t.upd).select("trip_id", "stop_sequence", "price", F.round("prediction", 3).alias("prediction"))


# Moments of the training rows by fold, standardized, and the weights by coordinate descent; settings and folds are those of the query.
# A fold's training rows are those outside it.
MOMENTS = """RECURSIVE, st AS (SELECT setting, kind, alpha, ratio FROM ({settings}) x(setting, kind, alpha, ratio)),
mo AS (SELECT f, count(*) AS n, avg(pred) AS m1, avg(stop_sequence) AS m2, avg(price) AS m3, avg(delay) AS my, stddev_pop(pred) AS s1, stddev_pop(stop_sequence) AS s2, stddev_pop(price) AS s3,
 corr(pred, stop_sequence) AS g12, corr(pred, price) AS g13, corr(stop_sequence, price) AS g23,
 covar_pop(pred, delay) / stddev_pop(pred) AS c1, covar_pop(stop_sequence, delay) / stddev_pop(stop_sequence) AS c2, covar_pop(price, delay) / stddev_pop(price) AS c3
 FROM upd, ({folds}) fs(f) WHERE trip_id % 5 <> f GROUP BY f),
sy AS (SELECT mo.*, st.*, CASE WHEN kind = 'ridge' THEN 0 ELSE alpha * ratio END AS l1, CASE WHEN kind = 'ridge' THEN alpha / n ELSE alpha * (1 - ratio) END AS l2 FROM mo, st),
cd AS (SELECT f, setting, 0 AS i, CAST(0 AS DOUBLE) AS w1, CAST(0 AS DOUBLE) AS w2, CAST(0 AS DOUBLE) AS w3 FROM sy
 UNION ALL SELECT f, setting, i + 1, w1, w2, sign(r3) * greatest(abs(r3) - l1, 0) / (1 + l2) FROM (
  SELECT *, c3 - g13 * w1 - g23 * w2 AS r3 FROM (SELECT * REPLACE (sign(r2) * greatest(abs(r2) - l1, 0) / (1 + l2) AS w2) FROM (
   SELECT *, c2 - g12 * w1 - g23 * w3 AS r2 FROM (SELECT * REPLACE (sign(r1) * greatest(abs(r1) - l1, 0) / (1 + l2) AS w1) FROM (
    SELECT sy.*, cd.i, cd.w1, cd.w2, cd.w3, c1 - g12 * cd.w2 - g13 * cd.w3 AS r1 FROM cd JOIN sy USING (f, setting) WHERE cd.i < 60))))) z),
co AS (SELECT sy.f, sy.setting, w1 / s1 AS b1, w2 / s2 AS b2, w3 / s3 AS b3, my - w1 / s1 * m1 - w2 / s2 * m2 - w3 / s3 * m3 AS b0 FROM cd JOIN sy USING (f, setting) WHERE i = 60)
"""


@query("m02_regularized", "upd", MOMENTS.format(settings="VALUES (1, 'ridge', 1.0, 0.0), (2, 'lasso', 1.0, 1.0), (3, 'elastic', 1.0, 0.5)", folds="VALUES (0)") + """
SELECT kind, trip_id, stop_sequence, price, round(b0 + b1 * pred + b2 * stop_sequence + b3 * price, 3) AS prediction FROM upd, co JOIN st USING (setting) WHERE trip_id % 5 = 0""")
def _(t):
    train, test = t.upd.where("trip_id % 5 <> 0"), t.upd.where("trip_id % 5 = 0")
    m = gr.moments(le.training_rows(train, COLS, "delay"), COLS, le.LABEL)
    parts = []
    for kind in le.LINEAR:
        alpha = {k: v for k, v in le.DEFAULTS[kind].items() if k in ("alpha", "l1_ratio")}
        parts.append(gr.solve(m.total(), m.shift, COLS, kind, **alpha).predict(test).withColumn("kind", F.lit(kind)))
    d = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return d.select("kind", "trip_id", "stop_sequence", "price", F.round("prediction", 3).alias("prediction"))


@query("m03_tree_models")
def _(t):
    train, test = parts(t)
    a = le.predict(le.fit("random_forest", train, COLS, "delay", maxDepth=10), test)
    b = le.predict(le.fit("gradient_boosting", train, COLS, "delay"), test)
    f = me.regression_metrics(a, "delay", "prediction").withColumn("kind", F.lit("random_forest"))
    return f.unionByName(me.regression_metrics(b, "delay", "prediction").withColumn("kind", F.lit("gradient_boosting")))


def _grids():
    """The settings of all three grids as SQL values."""
    rows = [(kind, s) for kind in le.LINEAR for s in le.combinations(le.GRIDS[kind])]
    ratio = {"ridge": 0.0, "lasso": 1.0}
    return "VALUES " + ", ".join(f"({i}, '{k}', {s['alpha']}, {s.get('l1_ratio', ratio.get(k))})" for i, (k, s) in enumerate(rows))


@query("m04_tune", "upd", MOMENTS.format(settings=_grids(), folds="VALUES (0), (1), (2), (3), (4)") + """,
er AS (SELECT f, setting, sqrt(avg(pow(delay - b0 - b1 * pred - b2 * stop_sequence - b3 * price, 2))) AS rmse FROM upd JOIN co ON trip_id % 5 = f GROUP BY 1, 2)
SELECT kind, alpha, CASE WHEN kind = 'elastic' THEN ratio END AS l1_ratio, round(avg(rmse), 4) AS rmse FROM er JOIN st USING (setting) GROUP BY 1, 2, 3""")
def _(t):
    m = gr.moments(le.training_rows(t.upd, [*COLS, "trip_id"], "delay"), COLS, le.LABEL, F.col("trip_id") % 5)
    rows = []
    for kind in le.LINEAR:
        settings = le.combinations(le.GRIDS[kind])
        rows += [(kind, s["alpha"], s.get("l1_ratio"), v) for s, v in zip(settings, gr.grid_scores(m, kind, settings))]
    return t.spark.createDataFrame(rows, "kind string, alpha double, l1_ratio double, rmse double").withColumn("rmse", F.round("rmse", 4))


@query("m04_tune_model")
def _(t):
    model, scores = le.tune("elastic", t.upd, COLS, "delay", fold=F.col("trip_id") % 5)
    return me.regression_metrics(le.predict(model, t.upd), "delay", "prediction").withColumn("best_rmse", F.lit(scores.agg(F.min("rmse")).first()[0]))


@query("m05_importances")
def _(t):
    m = le.fit("random_forest", rows(t), COLS, "delay", maxDepth=10)
    return le.importances(m, t.spark, COLS)


@query("m06_per_stop")
def _(t):
    _m, scored = le.per_stop(past(t, features=("price", "pred")), "gradient_boosting", maxIter=10, maxDepth=5)
    return me.metrics_by_step(scored, "position", "y", "prediction")


@query("m07_permutation_importance")
def _(t):
    d = t.obs.select("obs_id", "hour_of_day", "k", "delay")
    m = le.fit("linear", d, ["hour_of_day", "k"], "delay")
    return le.permutation_importance(m, d, ["hour_of_day", "k"], "delay", ["obs_id"])


# Rows in the order of their hash; copy c of n rows takes a value from the row 1 + (7919 c + 104729) % (n - 1) places on.
COPIES = """, o AS (SELECT obs_id, hour_of_day, k, delay, row_number() OVER (ORDER BY md5(obs_id || '|1'), obs_id) AS p, count(*) OVER () AS n FROM obs WHERE delay IS NOT NULL),
c AS (SELECT o.obs_id, o.delay, c // 3 AS feature, c % 3 AS repeat, CASE WHEN c < 3 THEN v.hour_of_day ELSE o.hour_of_day END AS hour_of_day, CASE WHEN c >= 3 THEN v.k ELSE o.k END AS k
 FROM o CROSS JOIN range(6) r(c) JOIN o v ON v.p = (o.p - 1 + 1 + (c * 7919 + 104729) % (o.n - 1)) % o.n + 1)"""


@query("m07_permuted_values", "obs", COPIES + " SELECT obs_id, feature, repeat, hour_of_day, k FROM c")
def _(t):
    d = le.permuted_copies(t.obs.select("obs_id", "hour_of_day", "k", "delay").where("delay is not null"), ["hour_of_day", "k"], ["obs_id"], 3)
    return d.select("obs_id", F.col("_feature").alias("feature"), F.col("_repeat").alias("repeat"), "hour_of_day", "k")


@query("m07_cross_sample", "obs", COPIES + """, e AS (SELECT feature, repeat, avg(abs(delay - 10 * hour_of_day - 3 * k)) AS e FROM c GROUP BY 1, 2), b AS (SELECT avg(abs(delay - 10 * hour_of_day - 3 * k)) AS b FROM o)
SELECT CASE feature WHEN 0 THEN 'hour_of_day' ELSE 'k' END AS feature, round(avg(e - b) + 1e-9, 6) AS importance, round(stddev_pop(e - b) + 1e-9, 6) AS std FROM e, b GROUP BY 1""")
def _(t):
    rule = lambda d: d.withColumn("prediction", F.col("hour_of_day") * 10.0 + F.col("k") * 3.0)
    d = le.permutation_importance(rule, t.obs.select("obs_id", "hour_of_day", "k", "delay"), ["hour_of_day", "k"], "delay", ["obs_id"], 3)
    return rounded(d.select("feature", "importance", "std"), "importance", "std")


def _steps(t):
    """Eight steps of two features for each stop's first eight rows."""
    d = t.obs.where("delay is not null").select("stop_id", F.struct("obs_id", F.array(F.col("delay").cast("double"), F.col("hour_of_day").cast("double")).alias("s")).alias("s"))
    d = d.groupBy("stop_id").agg(F.array_sort(F.collect_list("s")).alias("s")).where(F.size("s") >= 8)
    return d.select("stop_id", F.transform(F.slice("s", 1, 8), lambda v: v["s"]).alias("x"))


def _step_sql(size):
    return f"""RECURSIVE, q AS (SELECT stop_id, delay, hour_of_day, row_number() OVER (PARTITION BY stop_id ORDER BY obs_id) - 1 AS t, count(*) OVER (PARTITION BY stop_id) AS have FROM obs WHERE delay IS NOT NULL),
s AS (SELECT * FROM q WHERE have >= 8 AND t < 8), b AS (SELECT stop_id, repeat, b, row_number() OVER (PARTITION BY stop_id, repeat ORDER BY md5(stop_id || '|' || (repeat + 1) || '|' || b)) - 1 AS place
 FROM (SELECT DISTINCT stop_id FROM s), range(2) r(repeat), range({8 // size}) l(b))
SELECT s.stop_id, f AS feature, b.repeat, s.t, CASE WHEN f = 0 THEN m.delay ELSE s.delay END AS delay, CAST(CASE WHEN f = 1 THEN m.hour_of_day ELSE s.hour_of_day END AS DOUBLE) AS hour_of_day
FROM s CROSS JOIN range(2) ff(f) JOIN b ON b.stop_id = s.stop_id AND b.place = s.t // {size} JOIN s m ON m.stop_id = s.stop_id AND m.t = b.b * {size} + s.t % {size}"""


def _step_copies(t, strategy):
    d = le.step_copies(_steps(t), "x", ["stop_id"], 2, 2, strategy)
    d = d.select("stop_id", F.col("_feature").alias("feature"), F.col("_repeat").alias("repeat"), F.posexplode("x").alias("t", "v"))
    return d.select("stop_id", "feature", "repeat", "t", F.get("v", F.lit(0)).alias("delay"), F.get("v", F.lit(1)).alias("hour_of_day"))


@query("m07_within_sample", "obs", _step_sql(1))
def _(t):
    return _step_copies(t, "within_sample")


@query("m07_block", "obs", _step_sql(2))
def _(t):
    return _step_copies(t, "block")


@query("m07_permuted_column", "obs", """, a AS (SELECT *, row_number() OVER (ORDER BY md5(obs_id || '|2'), obs_id) AS p FROM obs), b AS (SELECT delay, row_number() OVER (ORDER BY md5(obs_id || '|3'), obs_id) AS p FROM obs)
SELECT a.obs_id, a.k, b.delay FROM a JOIN b USING (p)""")
def _(t):
    return le.permute(t.obs.select("obs_id", "k", "delay"), ["delay"], ["obs_id"], 1)


def _status(t):
    """Delays of a few dense stops in region status form."""
    k = F.col("stop_id") % 20
    return t.obs.where("delay is not null").select(
        (k % 4).alias("region_id"), "route_id", "direction_id", k.alias("stop_id"), F.col("ts").alias("time_bucket"), F.col("obs_id").alias("line_direction_link_order"),
        F.col("delay").cast("double").alias("arrival_delay"), F.lit("stop").alias("stop_name"), F.lit(49.0).alias("stop_lat"), F.lit(-123.0).alias("stop_lon"),
    )


def _fitted(status):
    """A model of the next three delays by the mean of the last eight, one regression an hour ahead."""
    keys, order = ["region_id", *le.STOP_KEY], ["time_bucket", "line_direction_link_order"]

    def mean(d):
        return d.withColumn("m", F.aggregate("x", F.lit(0.0), lambda a, v: a + F.get(v, F.lit(0))) / 8)

    train = mean(windows(status, keys, order, [], ["arrival_delay"], "arrival_delay")).select("m", *[F.get("y", F.lit(h)).alias(f"y{h}") for h in range(3)])
    train = stage(train, "region-train")
    models = [gr.fit("linear", train, ["m"], f"y{h}") for h in range(3)]

    def score(x):
        d = mean(x)
        for h, m in enumerate(models):
            d = m.predict(d, f"_h{h}")
        return d.withColumn("prediction", F.array("_h0", "_h1", "_h2")).drop("m", "_h0", "_h1", "_h2")

    return score


@query("m08_fitted_model", "obs", """, s AS (SELECT stop_id % 20 % 4 AS region_id, route_id, direction_id, stop_id % 20 AS stop_id, ts, obs_id, CAST(delay AS DOUBLE) AS d FROM obs WHERE delay IS NOT NULL),
w AS (SELECT *, avg(d) OVER (k ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS m, count(*) OVER (k ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS have, lead(d, 1) OVER k AS y1, lead(d, 2) OVER k AS y2, lead(d, 3) OVER k AS y3
 FROM s WINDOW k AS (PARTITION BY region_id, route_id, direction_id, stop_id ORDER BY ts, obs_id)),
f AS (SELECT regr_slope(y1, m) AS b1, regr_intercept(y1, m) AS a1, regr_slope(y2, m) AS b2, regr_intercept(y2, m) AS a2, regr_slope(y3, m) AS b3, regr_intercept(y3, m) AS a3 FROM w WHERE have = 8 AND y3 IS NOT NULL),
g AS (SELECT * FROM w WHERE have = 8 AND y1 IS NULL), c AS (SELECT region_id, count(*) AS n FROM g GROUP BY 1), t AS (SELECT region_id, min(ts) AS lo, max(ts) AS hi FROM s GROUP BY 1)
SELECT region_id, route_id, direction_id, stop_id, CAST(h AS INTEGER) AS prediction_hour_offset, round(CASE h WHEN 1 THEN a1 + b1 * m WHEN 2 THEN a2 + b2 * m ELSE a3 + b3 * m END, 2) AS predicted_delay_seconds,
 obs_id AS stop_sequence, CAST(n AS INTEGER) AS sequence_count, lo AS input_data_start, hi AS input_data_end, 'mean of eight' AS model_version FROM g JOIN c USING (region_id) JOIN t USING (region_id), f, range(1, 4) r(h)""")
def _(t):
    s = stage(_status(t), "region-status")
    d = le.score_regions(s, "2024-02-01 08:25:00", ["arrival_delay"], _fitted(s), "mean of eight")
    return d.select(
        "region_id", *le.STOP_KEY, "prediction_hour_offset", "predicted_delay_seconds", "stop_sequence",
        "sequence_count", "input_data_start", "input_data_end", "model_version",
    )


@query("m09_decode", "obs", """, s AS (SELECT stop_id, avg(delay) AS m FROM obs GROUP BY 1) SELECT stop_id, CAST(h AS INTEGER) AS prediction_hour_offset, TIMESTAMP '2024-01-20 14:00:00' + to_hours(h - 1) AS prediction_target_time, round(m * h + 1e-9, 2) AS predicted_delay_seconds
FROM s, range(1, 4) r(h)""")
def _(t):
    m = t.obs.groupBy("stop_id").agg((F.avg("delay") + 1e-9).alias("m"))
    v = m.withColumn("prediction", F.array("m", F.col("m") * 2, F.col("m") * 3, F.lit(float("nan"))))
    d = le.decode(v, "2024-01-20 14:23:00")
    return d.select("stop_id", "prediction_hour_offset", "prediction_target_time", "predicted_delay_seconds")


@query("m10_run_meta", "obs", "SELECT stop_id, 'v1' AS model_version, min(ts) AS input_data_start, max(ts) AS input_data_end, count(*) AS sequence_count FROM obs GROUP BY 1")
def _(t):
    d = t.obs.groupBy("stop_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count(F.lit(1)).alias("n"))
    d = le.with_run_meta(d, model_version="v1", input_data_start=F.col("lo"), input_data_end=F.col("hi"), sequence_count=F.col("n"))
    return d.drop("lo", "hi", "n")


@query("m11_grid_errors", "upd", "SELECT count(*) AS n, round(avg(abs(delay - pred)) + 1e-9, 5) AS mae, round(sqrt(avg((delay - pred) * (delay - pred))) + 1e-9, 5) AS rmse FROM upd WHERE flag <> 'N'")
def _(t):
    fit = standard_fit(t.upd, ["delay"])
    d = t.upd.withColumn("seen", (F.col("flag") != "N").cast("int"))
    scaled = standard_apply(standard_apply(d, fit, ["delay"]), fit.select(F.col("delay_mean").alias("pred_mean"), F.col("delay_std").alias("pred_std")), ["pred"])
    e = le.grid_errors(scaled, fit, "delay", "seen", "delay", "pred")
    return e.select("n", F.round(F.col("mae") + 1e-9, 5).alias("mae"), F.round(F.col("rmse") + 1e-9, 5).alias("rmse"))


_LEN = ", ".join(f"avg(v) OVER w{n} AS y{n}, count(*) OVER w{n} AS c{n}" for n in (3, 5, 7, 10))
_LENW = ", ".join(f"w{n} AS (PARTITION BY route, stop_sequence ORDER BY first_time, trip_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in (3, 5, 7, 10))


@query("m12_length_experiment", "upd", PAST + f", q AS (SELECT v, {_LEN} FROM m WINDOW {_LENW}) " + " UNION ALL ".join(f"SELECT {n} AS n_past, count(*) AS n, round(avg(abs(v - y{n})) + 1e-9, 6) AS mae FROM q WHERE c{n} = {n}" for n in (3, 5, 7, 10)))
def _(t):
    d = t.upd.withColumn("route", F.col("trip_id") % 40)
    out = le.length_experiment(d, (3, 5, 7, 10), "route", "trip_id", "feed_time", "stop_sequence", "delay")
    return rounded(out.select("n_past", "n", "mae"), "mae")


@query("m13_fit_report")
def _(t):
    train, test = parts(t)
    model, report = le.fit_report("ridge", train, test, COLS, "delay", folds=5)
    path = scratch_path(t.spark, "model")
    le.save(model, path)
    again = me.regression_metrics(le.predict(le.load(path), test), "delay", "prediction")
    return report.unionByName(again.withColumn("part", F.lit("reloaded")), allowMissingColumns=True)


@query("c18_model_input", "upd", """, f AS (SELECT avg(delay) AS m1, stddev_pop(delay) AS s1, avg(delay * pred) AS m2, stddev_pop(delay * pred) AS s2 FROM upd) SELECT trip_id, stop_sequence, price, round((delay - m1) / s1, 4) AS first, round((delay * pred - m2) / s2, 4) AS cross_term FROM upd, f""")
def _(t):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    m = Pipeline(stages=le.model_input(["delay", "pred"], t.upd.count(), poly=True)).fit(t.upd)
    d = m.transform(t.upd).withColumn("v", vector_to_array("features"))
    return d.select("trip_id", "stop_sequence", "price", F.round(F.get("v", F.lit(0)), 4).alias("first"), F.round(F.get("v", F.lit(3)), 4).alias("cross_term"))
