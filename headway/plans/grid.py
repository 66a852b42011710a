"""The stop grid: edges, a regular time grid with mask, scaled on its train part."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from headway.operators.fills import ffill, grid_steps, regular_grid
from headway.operators.scaling import standard_apply, standard_fit
from headway.operators.sequences import source_mask, stop_edges
from headway.operators.spans import daily
from headway.operators.splits import numbered_dates


def stop_grid(df: DataFrame, route_ids=None, ts="actual_arrival_time", step=900, train=0.7) -> dict[str, DataFrame]:
    """Edges between stops, node mask, and delays per stop and step: filled over at most four
    steps, then 0, standardized with the statistics of the first share of steps."""
    d = df if route_ids is None else df.where(F.col("route_id").isin(*route_ids))
    edges = stop_edges(d, ["trip_id"], [ts, "stop_sequence", "stop_id"], daily(ts), "stop_id")
    grid = regular_grid(d, ["stop_id"], ts, step, "arrival_delay")
    # A stop has as many rows as there are steps, and they come dealt by stop: a plain window shuffles nothing.
    grid = ffill(grid, ["stop_id"], [F.col(ts)], None, "arrival_delay", 4, 0.0)
    steps = numbered_dates(grid_steps(d, ts, step), ts)
    last = steps.where(F.col("idx") < F.floor(F.col("n_dates") * F.lit(float(train)))).agg(F.max(ts)).scalar()
    grid = grid.withColumn("is_train", F.coalesce(F.col(ts) <= last, F.lit(False)))
    fit = standard_fit(grid.where("is_train"), ["arrival_delay"])
    return {
        "edges": edges, "nodes": source_mask(d.select("stop_id"), edges, "stop_id"),
        "grid": standard_apply(grid, fit, ["arrival_delay"], "_scaled"), "fit": fit,
    }
