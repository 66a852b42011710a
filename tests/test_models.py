"""Linear models from moments against plain numpy; permutations as one exchange."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from headway.operators import gram as gr, learning as le


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 4)) * [1, 5, 0.1, 0] + [1e6, -3, 0, 7]  # a large mean, a constant
    y = 2 * (x[:, 0] - 1e6) - 0.3 * x[:, 1] + 4 * x[:, 2] + rng.normal(size=400)
    return pd.DataFrame(x, columns=list("abcd")).assign(y=y, f=np.arange(400) % 5)


def by_numpy(d, kind, alpha, ratio=0.5):
    x, y = d[list("abcd")].to_numpy(), d["y"].to_numpy()
    dev = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(dev > 1e-9, dev, 1)
    z[:, dev <= 1e-9] = 0
    c, n = y - y.mean(), len(y)
    if kind in ("linear", "ridge"):
        w = np.linalg.lstsq(z.T @ z + (alpha if kind == "ridge" else 0) * np.eye(4), z.T @ c, rcond=None)[0]
    else:  # proximal gradient
        first, second = (alpha, 0) if kind == "lasso" else (alpha * ratio, alpha * (1 - ratio))
        w, step = np.zeros(4), 1 / (np.linalg.eigvalsh(z.T @ z / n).max() + second)
        for _ in range(5000):
            g = w - step * (z.T @ (z @ w - c) / n + second * w)
            w = np.sign(g) * np.maximum(np.abs(g) - step * first, 0)
    return lambda e: y.mean() + ((e[list("abcd")].to_numpy() - x.mean(axis=0)) / np.where(dev > 1e-9, dev, 1)) @ w


@pytest.mark.parametrize("kind", ["linear", "ridge", "lasso", "elastic"])
def test_fits_and_folds(spark, data, kind):
    df = spark.createDataFrame(data).repartition(3)
    alpha = {"linear": 0.0, "ridge": 50.0, "lasso": 0.2, "elastic": 0.4}[kind]
    model = gr.fit(kind, df, list("abcd"), "y", alpha=alpha)
    got = model.predict(df.select("*")).select("prediction", *"abcd").toPandas()
    assert got["prediction"].to_numpy() == pytest.approx(by_numpy(data, kind, alpha)(got), abs=1e-5)
    m = gr.moments(df, list("abcd"), "y", F.col("f"))
    want = []
    for f in range(5):
        held = data[data.f == f]
        want.append(np.sqrt(np.mean((held.y - by_numpy(data[data.f != f], kind, alpha)(held)) ** 2)))
    assert gr.grid_scores(m, kind, [{"alpha": alpha}])[0] == pytest.approx(np.mean(want), rel=1e-5)


def test_tune_takes_the_best_setting(spark, data):
    df = spark.createDataFrame(data)
    model, scores = le.tune("lasso", df, list("abc"), "y", fold=F.col("f"))
    s = {r.params: r.rmse for r in scores.collect()}
    assert len(s) == 4 and min(s, key=s.get) == "{'alpha': 0.1}" and max(s.values()) == s["{'alpha': 100.0}"]
    rmse = le.predict(model, df).agg(F.sqrt(F.avg(F.pow(F.col("y") - F.col("prediction"), 2)))).first()[0]
    assert rmse == pytest.approx(s["{'alpha': 0.1}"], rel=0.05)
    assert gr.moments(df.limit(0), ["a"], "y").folds == {}
    with pytest.raises(ValueError):
        gr.fit("ridge", df.limit(0), ["a"], "y")
    gone = gr.fit("linear", df, ["b"], "y").predict(spark.sql("SELECT CAST(NULL AS DOUBLE) b UNION ALL SELECT DOUBLE('NaN')"))
    assert gone.where("prediction IS NOT NULL").count() == 0


def test_copies_are_permutations_in_one_exchange(spark):
    d = spark.range(101).select(F.col("id").alias("k"), (F.col("id") * 3).cast("int").alias("a"), (F.col("id") * 0.5).alias("b"))
    got = le.permuted_copies(d, ["a", "b"], ["k"], 4)
    rows = got.toPandas()
    assert len(rows) == 101 * 8 and dict(got.dtypes)["a"] == "int"
    for (f, r), g in rows.groupby(["_feature", "_repeat"]):
        assert sorted(g.a) == sorted(g.k * 3) and sorted(g.b) == sorted(g.k * 0.5)
        kept, moved = ("b", "a") if f == 0 else ("a", "b")
        assert (g[kept] == g.k * (3 if kept == "a" else 0.5)).all() and (g[moved] != g.k * (3 if moved == "a" else 0.5)).all()

    def size(n):
        return le.permuted_copies(d, ["a", "b"], ["k"], n)._jdf.queryExecution().optimizedPlan().toString().count("\n")

    assert size(2) == size(50)
    assert le.permuted_copies(d.limit(1), ["a"], ["k"], 2).count() == 2 and le.permuted_copies(d.limit(0), ["a"], ["k"], 2).count() == 0


def test_steps_shorter_than_a_block(spark):
    d = spark.createDataFrame([(1, [[1.0, 2.0]]), (2, []), (3, [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]])], "k int, x array<array<double>>")
    got = {(r.k, r._feature, r._repeat): r.x for r in le.step_copies(d, "x", ["k"], 2, 2, "block").collect()}
    assert len(got) == 12 and got[1, 0, 1] == [[1.0, 2.0]] and got[2, 1, 0] == []
    assert all(sorted(v[i] for v in got[3, f, r]) == [[1.0, 3.0, 5.0], [2.0, 4.0, 6.0]][i] for f in (0, 1) for r in (0, 1) for i in (0, 1))
