"""Quality scores by histogram gradient-boosted trees over document statistics.

The statistics describe whole texts: sizes, shares of character kinds, word and line lengths, and how
much repeats. Trees are grown level by level on binned statistics of a bounded sample of labelled
rows. A fitted model is a handful of arrays (feature, threshold and leaf value of complete binary trees);
scoring walks all trees of a batch at once, one level a step.

Edge cases: null and empty texts have all statistics zero and are scored like any other. Labels
that are null, or of keys without a document, are not learned from; a key with several labels counts
with the largest. Without any label the score is 0.5 everywhere, with one class only near that class.
Repeated rows are scored alike. An input column named like an output column is replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from headway.llm.common import annotate, col, thinned

NAMES = (
    "log_bytes", "log_words", "log_lines", "upper", "digit", "space", "newline", "non_ascii", "stop_marks", "bang", "bar",
    "symbols", "quotes", "commas", "word_length", "word_spread", "longest_word", "short_words", "distinct_words",
    "distinct_pairs", "top_word", "distinct_lines", "line_length", "word_ends_symbol", "repeat_next",
)
_SYMBOLS = np.frombuffer(b"#$%&*@^~<>{}[]=+_\\/|", np.uint8)


def statistics(text: str | None) -> list[float]:
    """The statistics of one text, in the order of :data:`NAMES`."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(NAMES)
    n, size = len(words), len(raw)
    at = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / size
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    distinct = set(words)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:])))
    ends = sum(c for w, c in counts.items() if w[-1] in b"#$%&*!|@")
    same = sum(a == b for a, b in zip(words, words[1:]))
    return [
        np.log1p(size), np.log1p(n), np.log1p(len(lines)), at[65:91].sum(), at[48:58].sum(), at[32], at[10], at[128:].sum(),
        at[46] + at[63], at[33], at[124], at[_SYMBOLS].sum(), at[34] + at[39], at[44], lengths.mean(), lengths.std(),
        np.log1p(lengths.max()), (lengths <= 3).mean(), len(distinct) / n, pairs / max(1, n - 1), max(counts.values()) / n,
        len(set(lines)) / max(1, len(lines)), np.log1p(size / max(1, len(lines))), ends / n, same / max(1, n - 1),
    ]


def with_statistics(df: DataFrame, text: str, keep: list[str] | None = None) -> DataFrame:
    """Add ``stats``, an array of the statistics of the whole text."""
    return annotate(df, text, "stats array<double>", lambda: lambda texts: {"stats": [list(map(float, statistics(t))) for t in texts]}, keep)


# ---------------------------------------------------------------- boosted trees


def _bins(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Cut points of each statistic: quantiles of its distinct values."""
    cuts = []
    for j in range(x.shape[1]):
        v = np.unique(x[:, j])
        middle = (v[1:] + v[:-1]) / 2
        cuts.append(middle if len(middle) < most else np.unique(np.quantile(middle, np.linspace(0, 1, most - 1))))
    return cuts


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 1.0) -> dict:
    """Boosted trees for the log-odds of ``y``; a node that no split improves sends every row left."""
    n, width = x.shape
    inner = 2**depth - 1
    model = {
        "base": float(np.log((y.sum() + 1) / (n - y.sum() + 1))), "depth": depth, "feature": np.zeros((trees, inner), np.int32),
        "threshold": np.full((trees, inner), np.inf), "leaf": np.zeros((trees, 2**depth)),
    }
    if n == 0 or width == 0:
        model["base"], model["leaf"] = 0.0, model["leaf"][:0]
        model["feature"], model["threshold"] = model["feature"][:0], model["threshold"][:0]
        return model
    cuts = _bins(x, bins)
    b = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    score = np.full(n, model["base"])
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            count, base = 2**level, 2**level - 1
            gain = np.full(count, 1e-9)
            split = np.zeros((count, 2), np.int64)
            use = np.zeros(count, bool)
            for j in range(width):
                size = len(cuts[j]) + 1
                if size < 2:
                    continue
                key = node * size + b[:, j]
                gs = np.bincount(key, g, count * size).reshape(count, size).cumsum(axis=1)
                hs = np.bincount(key, h, count * size).reshape(count, size).cumsum(axis=1)
                gl, hl, ga, ha = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                won = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
                won[(hl < least) | (ha - hl < least)] = 0
                at = won.argmax(axis=1)
                better = won[np.arange(count), at] > gain
                gain[better], use[better] = won[np.arange(count), at][better], True
                split[better] = np.column_stack([np.full(count, j), at])[better]
            for k in np.flatnonzero(use):
                j, at = split[k]
                model["feature"][t, base + k], model["threshold"][t, base + k] = j, cuts[j][at]
            right = use[node] & (b[np.arange(n), split[node, 0]] > split[node, 1])
            node = 2 * node + right
        leaf = rate * np.bincount(node, g, 2**depth) / (np.bincount(node, h, 2**depth) + ridge)
        model["leaf"][t] = leaf
        score += leaf[node]
    return model


def log_odds(model: dict, x: np.ndarray) -> np.ndarray:
    """All trees walked together, one level a step."""
    trees = np.arange(len(model["leaf"]))
    at = np.zeros((len(x), len(trees)), np.int64)
    rows = np.arange(len(x))[:, None]
    for _ in range(model["depth"]):
        at = 2 * at + 1 + (x[rows, model["feature"][trees, at]] > model["threshold"][trees, at])
    return model["base"] + model["leaf"][trees, at - (2 ** model["depth"] - 1)].sum(axis=1)


# ---------------------------------------------------------------- training and scoring


def train(described: DataFrame, labels: DataFrame, key: str, label: str, usable: Column, rows: int = 20_000, **options) -> dict:
    """Fit on at most ``rows`` labelled rows, the first by a hash of their key.

    ``described`` has the key and ``stats``; its stored form is read once more for the sample.
    """
    named = (
        labels.where(usable & col(key).isNotNull() & col(label).isNotNull())
        .groupBy(col(key).alias("key")).agg(F.max(col(label).cast("int")).alias("y"))
    )
    picked = thinned(named, "key", rows, max(1, named.count()), 4)
    joined = described.select(col(key).alias("key"), "stats").join(picked, "key")
    sample = joined.orderBy(F.xxhash64("key", F.lit(5)), "key").limit(rows).select("stats", "y").toPandas()
    x = np.array(sample["stats"].tolist(), float).reshape(len(sample), len(NAMES))
    return fit(x, sample["y"].to_numpy(float), **options)


def predict(described: DataFrame, model: dict, keep: list[str] | None = None) -> DataFrame:
    """Add ``score``, the probability of label 1, from ``stats``."""
    shared = described.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        return lambda stats: {"score": 1 / (1 + np.exp(-log_odds(m, np.array(stats, float).reshape(len(stats), len(NAMES)))))}

    return annotate(described, "stats", "score double", make, keep)
