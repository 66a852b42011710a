"""Numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def normal_tail(z: Column) -> Column:
    """Upper tail of the standard normal for z >= 0 (Abramowitz and Stegun 26.2.17).

    Absolute error below 7.5e-8.
    """
    # The published coefficients of the approximation.
    p, coef = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = 1 / (1 + F.lit(p) * z)
    poly = F.lit(0.0)
    for a in reversed(coef):
        poly = (poly + F.lit(a)) * t
    return F.exp(-z * z / 2) / F.sqrt(2 * F.pi()) * poly


def hash_text(*cols, seed=0) -> Column:
    """Hex digest of the values and a seed: the same on every engine, stable over runs."""
    parts = [F.col(x).cast("string") if isinstance(x, str) else x.cast("string") for x in cols]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))).cast("binary"))


def row_id(*cols) -> Column:
    """Surrogate id of a natural key, stable over runs."""
    return F.xxhash64(*cols)
