"""Set operations, orders and limits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from headway.functions.numbers import hash_text


def union_distinct(a, b) -> DataFrame:
    return a.unionByName(b).distinct()


def union_all(dfs: Sequence[DataFrame]) -> DataFrame:
    """All rows; columns a frame lacks become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def except_keys(a, b, keys: Sequence[str]) -> DataFrame:
    return a.join(b.select(*keys), list(keys), "left_anti")


def overlap(a, b, key: Sequence[str]) -> DataFrame:
    return a.select(*key).intersect(b.select(*key))


def distinct(df, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct()


def order(df, keys: Sequence) -> DataFrame:
    """Global order; used where a result leaves the engine, not between steps."""
    return df.orderBy(*keys)


def top_k(df, by, k: int, tiebreak: Sequence = ()) -> DataFrame:
    return df.orderBy(by, *tiebreak).limit(k)


def by_abs(df, x: str, tiebreak: Sequence = ()) -> DataFrame:
    return df.orderBy(F.abs(F.col(x)).desc(), *tiebreak)


def sample_n(df, key: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """``n`` rows chosen by a hash of their key: the same rows on every run."""
    return (
        df.withColumn("_h", hash_text(*key, seed=seed)).orderBy("_h", *key).limit(n).drop("_h")
    )


def latest(df, group: Sequence[str], ts: str, n: int) -> DataFrame:
    """The newest groups (batches, feeds) with their row counts."""
    return (
        df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("latest"))
        .orderBy(F.desc("latest"), *group).limit(n)
    )
