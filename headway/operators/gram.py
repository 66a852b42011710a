"""Linear models from moments: one pass over the rows, then small linear algebra for every fold and setting.

For each fold the pass sums v v' of v = (1, features, label). A training set is the sum of all folds but one; means, deviations,
the Gram matrix of the standardized features and the squared error on the fold left out all follow from those sums. Ridge is
solved in closed form, lasso and elastic-net by coordinate descent on the p x p matrix. Values are shifted by the first row, so that large
means do not eat the digits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F


class Moments(NamedTuple):
    """Sums of v v' by fold, the shift of (features, label), and the features' names."""

    folds: dict[int, np.ndarray]
    shift: np.ndarray
    cols: tuple[str, ...]

    def total(self, without: int | None = None) -> np.ndarray:
        return np.sum([m for f, m in self.folds.items() if f != without], axis=0)


def moments(rows: DataFrame, cols: Sequence[str], y: str, fold: Column | None = None) -> Moments:
    """The sums of each fold; rows are complete. A task sends p + 2 vectors a fold, which Spark adds up before and after its shuffle."""
    names = [*cols, y]
    d = rows.select((F.lit(0) if fold is None else fold).cast("int").alias("_fold"), *[F.col(x).cast("double").alias(f"_{i}") for i, x in enumerate(names)])
    first = d.first()
    if first is None:
        return Moments({}, np.zeros(len(names)), tuple(cols))
    shift = np.array(first[1:], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            at = b.column(0).to_numpy()
            v = np.stack([np.ones(len(at)), *[b.column(i + 1).to_numpy() - s for i, s in enumerate(shift)]], 1)
            for f in np.unique(at).tolist():
                part = v[at == f]
                sums[f] = sums.get(f, 0) + part.T @ part
        for f, m in sums.items():
            n = len(m)
            yield pa.RecordBatch.from_arrays([pa.array([f] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(list(m), pa.list_(pa.float64()))], names=["fold", "i", "sums"])

    lines = d.mapInArrow(run, "fold int, i int, sums array<double>").select("fold", "i", array_to_vector("sums").alias("v"))
    total = lines.groupBy("fold", "i").agg(Summarizer.sum(F.col("v")).alias("v")).select("fold", "i", vector_to_array("v").alias("v")).collect()
    folds: dict[int, np.ndarray] = {}
    for r in sorted(total, key=lambda r: (r["fold"], r["i"])):
        folds.setdefault(r["fold"], np.zeros((len(names) + 1,) * 2))[r["i"]] = r["v"]
    return Moments(folds, shift, tuple(cols))


class Linear(NamedTuple):
    """Coefficients on the features' own scale."""

    cols: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """Every row with its prediction, null where a feature is missing or NaN."""
        value, known = F.lit(self.intercept), F.lit(True)
        for x, b in zip(self.cols, self.coefficients):
            value, known = value + F.col(x).cast("double") * b, known & F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))
        return df.withColumn(name, F.when(known, value))


def standardized(m: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, means and population deviations of (features, label), Gram matrix of the standardized features and their products
    with the centred label, both divided by the rows."""
    n = m[0, 0]
    mean = m[0, 1:] / n
    cov = m[1:, 1:] / n - np.outer(mean, mean)
    dev = np.sqrt(np.maximum(np.diag(cov), 0))
    scale = np.where(dev[:-1] > 0, dev[:-1], 1.0)
    return n, mean, dev, cov[:-1, :-1] / np.outer(scale, scale), cov[:-1, -1] / scale


def descend(g: np.ndarray, c: np.ndarray, first: float, second: float, steps: int = 1000, exact: float = 1e-12) -> np.ndarray:
    """The w that minimizes w'Gw / 2 - c'w + first * |w|_1 + second / 2 * |w|^2, a coordinate at a time."""
    w = np.zeros(len(c))
    for _ in range(steps):
        before = w.copy()
        for j in range(len(c)):
            rest = c[j] - g[j] @ w + g[j, j] * w[j]
            full = g[j, j] + second
            w[j] = np.sign(rest) * max(abs(rest) - first, 0.0) / full if full > 0 else 0.0
        if np.abs(w - before).max(initial=0.0) <= exact * max(1.0, np.abs(w).max(initial=0.0)):
            break
    return w


def solve(m: np.ndarray, shift: np.ndarray, cols: Sequence[str], kind: str, alpha: float = 0.0, l1_ratio: float = 0.5) -> Linear:
    """Ridge adds ``alpha * |w|^2`` to the sum of squared errors; lasso and elastic-net add ``alpha * l1_ratio * |w|_1 + alpha *
    (1 - l1_ratio) / 2 * |w|^2`` to half their mean; linear adds nothing. Features are standardized, a constant one gets 0."""
    n, mean, dev, g, c = standardized(m)
    live = dev[:-1] > 0
    w = np.zeros(len(c))
    if kind in ("linear", "ridge"):
        part = g[np.ix_(live, live)]
        w[live] = np.linalg.lstsq(part + (alpha / n if kind == "ridge" else 0.0) * np.eye(len(part)), c[live], rcond=None)[0]
    else:
        ratio = 1.0 if kind == "lasso" else l1_ratio
        w[live] = descend(g[np.ix_(live, live)], c[live], alpha * ratio, alpha * (1 - ratio))
    b = np.where(live, w / np.where(live, dev[:-1], 1.0), 0.0)
    mean = mean + shift
    return Linear(tuple(cols), tuple(b.tolist()), float(mean[-1] - b @ mean[:-1]))


def squared_error(m: np.ndarray, shift: np.ndarray, model: Linear) -> float:
    """Mean squared error of a model on the rows that the moments sum up."""
    b = np.array(model.coefficients)
    u = np.concatenate([[shift[-1] - model.intercept - b @ shift[:-1]], -b, [1.0]])
    return max(float(u @ m @ u), 0.0) / m[0, 0]


def fit(kind: str, rows: DataFrame, cols: Sequence[str], y: str, **params) -> Linear:
    m = moments(rows, cols, y)
    if not m.folds:
        raise ValueError("no rows to learn from")
    return solve(m.total(), m.shift, cols, kind, **params)


def grid_scores(m: Moments, kind: str, settings: Sequence[dict]) -> list[float]:
    """Mean over the folds of the root mean squared error on the fold left out, for each setting."""
    folds = [f for f in m.folds if len(m.folds) > 1]
    trains = {f: m.total(f) for f in folds}
    scores = []
    for s in settings:
        each = [squared_error(m.folds[f], m.shift, solve(trains[f], m.shift, m.cols, kind, **s)) ** 0.5 for f in folds]
        scores.append(float(np.mean(each)) if each else float("nan"))
    return scores
