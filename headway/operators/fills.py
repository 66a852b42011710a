"""Interpolation and filling along an order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from headway.functions.clock import floor_to
from headway.operators.spans import POS, known_neighbours, rowwise


def interpolate(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence,
    slices: Sequence,
    cols: str | Sequence[str],
    edges: str = "nearest",
) -> DataFrame:
    """Linear interpolation by row position inside each key.

    ``edges='nearest'`` fills leading and trailing gaps with the closest known value; ``'null'``
    leaves them. A key without known values stays null.
    """
    cols = [cols] if isinstance(cols, str) else list(cols)
    out = known_neighbours(df, keys, order, slices, cols)

    def filled(x):
        p, n = F.col(f"_p_{x}"), F.col(f"_n_{x}")
        share = (F.col(POS) - p["pos"]) / F.nullif(n["pos"] - p["pos"], F.lit(0))
        line = F.when(p["pos"] < n["pos"], p["val"] + (n["val"] - p["val"]) * share)
        tail = [p["val"], n["val"]] if edges == "nearest" else []
        return F.coalesce(F.col(x), line, *tail)

    return out.withColumns({x: filled(x) for x in cols}).drop(POS, *_near(cols))


def _near(cols) -> list[str]:
    return [f"_{p}_{x}" for p in "pn" for x in cols]


def ffill(df, keys, order, slices, cols, limit: int | None = None, default=None) -> DataFrame:
    """Carry the last known value forward over at most ``limit`` rows, then ``default``."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    if limit is None:
        out = known_neighbours(df, keys, order, slices, cols)
        out = out.withColumns({x: F.coalesce(F.col(x), F.col(f"_p_{x}")["val"]) for x in cols}).drop(POS, *_near(cols))
    else:
        filled = {
            f"_f_{x}": (lambda w, x=x: F.last(x, True).over(w.rowsBetween(-limit, 0))) for x in cols
        }
        out = rowwise(df, keys, order, slices, filled, back=limit)
        out = out.withColumns({x: F.col(f"_f_{x}") for x in cols}).drop(*filled)
    if default is not None:
        out = out.withColumns({x: F.coalesce(F.col(x), F.lit(default)) for x in cols})
    return out


def locf(df, keys, order, slices, cols) -> DataFrame:
    """Last observation carried forward without a limit."""
    return ffill(df, keys, order, slices, cols, None)


def fill_across(df, row: Sequence[str], col_order: str, x: str, default=0.0) -> DataFrame:
    """Fill along the columns of a long-form matrix: one row per (row key, column).

    A matrix row has as many entries as the stop list, so the plain window is bounded.
    """
    w = Window.partitionBy(*row).orderBy(col_order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(x, F.coalesce(F.last(x, True).over(w), F.lit(default)))


#: Steps of a grid whose known values travel as one map.
CHUNK = 64


def grid_bounds(df, ts: str, step_seconds: int, span: tuple[str, str] | None = None) -> Column:
    """First and last step of :func:`regular_grid` as struct(lo, hi), null for a frame without times."""
    if span:
        lo, hi = (F.lit(s).cast("timestamp_ntz") for s in span)
        return F.struct(floor_to(lo, step_seconds).alias("lo"), floor_to(hi, step_seconds).alias("hi"))
    at = floor_to(ts, step_seconds)
    return df.agg(F.struct(F.min(at).alias("lo"), F.max(at).alias("hi"))).scalar()


def grid_steps(df, ts: str, step_seconds: int, span: tuple[str, str] | None = None) -> DataFrame:
    """The steps of :func:`regular_grid`, one row each; as long as the calendar."""
    bounds = grid_bounds(df, ts, step_seconds, span)
    one = df.sparkSession.range(1).select(bounds["lo"].alias("lo"), bounds["hi"].alias("hi"))
    return one.select(F.explode(F.sequence("lo", "hi", _seconds(step_seconds))).alias(ts))


def _seconds(n: int) -> Column:
    return F.expr(f"INTERVAL {int(n)} SECOND")


def regular_grid(df, keys: Sequence[str], ts: str, step_seconds: int, x: str, span: tuple[str, str] | None = None) -> DataFrame:
    """Mean of ``x`` per (key, time step) on every step between the first and last of all keys.

    With ``span``, two times, only rows inside it count and the steps are those between them, so that no
    wrong clock stretches the grid.

    Adds ``observed``; missing steps have null ``x``. The number of steps is bounded by the
    calendar, the expansion grows with keys x steps. Only known values are shuffled: they are gathered
    by key, in maps of ``CHUNK`` steps, and every key is spread out where it is. So the grid comes dealt by key.
    """
    if span:
        lo, hi = (F.lit(s).cast("timestamp_ntz") for s in span)
        df = df.where(F.col(ts).between(lo, hi))
    bounds, width = grid_bounds(df, ts, step_seconds, span), step_seconds * CHUNK
    cells = df.groupBy(*keys, floor_to(ts, step_seconds).alias("_at")).agg(F.avg(x).alias("_x"))
    known = F.when(F.col("_at").isNotNull() & F.col("_x").isNotNull(), F.struct("_at", "_x"))
    chunks = cells.groupBy(*keys, floor_to("_at", width).alias("_chunk")).agg(F.map_from_entries(F.collect_list(known)).alias("_cells"))
    some = F.col("_chunk").isNotNull()
    for k in keys:  # a null key is no key: it has steps, but no values
        some = some & F.col(k).isNotNull()
    by_key = chunks.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.when(some, F.struct("_chunk", "_cells")))).alias("_chunks"))
    spread = by_key.select(*keys, "_chunks", F.explode(F.sequence(floor_to(bounds["lo"], width), bounds["hi"], _seconds(width))).alias("_chunk"))
    last = F.least(bounds["hi"], F.col("_chunk") + _seconds(width - step_seconds))
    steps = F.sequence(F.greatest(bounds["lo"], F.col("_chunk")), last, _seconds(step_seconds))
    grid = spread.select(*keys, F.try_element_at("_chunks", F.col("_chunk")).alias("_cells"), steps.alias("_steps"))
    grid = grid.select(*keys, "_cells", F.explode("_steps").alias(ts))
    return grid.select(*keys, ts, F.try_element_at("_cells", F.col(ts)).alias(x)).withColumn("observed", F.col(x).isNotNull())
