"""Points in polygons, over a covering of each polygon by cells of several sizes.

A polygon starts with the few cells as large as itself. A cell with more than ``EDGES`` edges is cut into 4 x 4, until it has
no more; so a country has large cells inside and small ones along its border, and the number of cells follows the
edges, not the area. A cell keeps the edges that touch it, and what the rest of the outline adds to ray casting inside it:

* edges to its left, above or below never meet a ray to the right of its points;
* edges to its right meet the ray whenever they span the point's height. Along a chain of them that depends on the heights of the
  chain's two ends only, since each height between counts twice. The ends are kept if they lie at the cell's height,
  and otherwise are a constant, odd or even.

A cell without edges and ends is wholly inside (or is dropped); its points need no ray casting. The result is that of casting the ray
over all edges, bit by bit.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from headway.functions.geo import edges_of, inside

#: Edges and ends of a cell before it is cut (times ``DENSE`` for long edges), cuts at most, cells sent on at once.
EDGES, DENSE, CUTS, SENT = 8, 16, 12, 4096
SIDE = 4


class Cell:
    """A cell of width ``SIDE ** level`` with its edges (rows x1, y1, x2, y2), ends and the constant part."""

    def __init__(self, level: int, cx: int, cy: int, edges: np.ndarray, ends: np.ndarray, odd: bool):
        self.at, self.edges, self.ends, self.odd = (level, cx, cy), edges, ends, odd

    def part(self, level: int, cx: int, cy: int) -> Cell:
        """The same outline seen from a cell inside this one."""
        w = float(SIDE) ** level
        slack = w * 1e-6 + 1e-12 * max(abs(cx), abs(cy), 1) * w
        x0, x1, y0, y1 = cx * w - slack, (cx + 1) * w + slack, cy * w - slack, (cy + 1) * w + slack
        e = self.edges
        low, high = np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
        spans = (high > y0) & (low <= y1)
        right = np.minimum(e[:, 0], e[:, 2]) > x1
        left = np.maximum(e[:, 0], e[:, 2]) < x0
        ends = np.concatenate([self.ends, e[right & spans][:, [1, 3]].ravel()])
        odd = self.odd ^ bool(np.count_nonzero(ends > y1) % 2)
        value, n = np.unique(ends[(ends > y0) & (ends <= y1)], return_counts=True)
        return Cell(level, cx, cy, e[spans & ~right & ~left], value[n % 2 == 1], odd)

    def children(self) -> list[Cell]:
        level, cx, cy = self.at
        return [self.part(level - 1, cx * SIDE + i, cy * SIDE + j) for i in range(SIDE) for j in range(SIDE)]


def covering(edges: np.ndarray, most: int = EDGES) -> Iterator[Cell]:
    """The cells of one polygon. Level edges meet no ray and are left out."""
    edges = edges[edges[:, 1] != edges[:, 3]]
    if not len(edges):
        return
    xs, ys = edges[:, [0, 2]], edges[:, [1, 3]]
    size = max(np.ptp(xs), np.ptp(ys))
    if not np.isfinite(size) or size == 0:
        return
    level = int(np.ceil(np.log(size) / np.log(SIDE)))
    w = float(SIDE) ** level
    whole = Cell(level, 0, 0, edges, np.zeros(0), False)
    (xa, xb), (ya, yb) = ((int(np.floor(v.min() / w)), int(np.floor(v.max() / w))) for v in (xs, ys))
    todo = [whole.part(level, cx, cy) for cx in range(xa, xb + 1) for cy in range(ya, yb + 1)]
    while todo:
        c = todo.pop()
        n = len(c.edges) + len(c.ends)
        if n > most and level - c.at[0] < CUTS:
            parts = c.children()
            # Long edges side by side cross most of the parts: cutting on would multiply them.
            if n > DENSE * most or sum(len(p.edges) + len(p.ends) for p in parts) <= 3 * n:
                todo += parts
                continue
        if n or c.odd:
            yield c


def polygon_cells(polygons: DataFrame, ids: list[str], rings: str = "rings", most: int = EDGES) -> DataFrame:
    """The cells of all polygons: ids, _lv, _cx, _cy, _edges, _ends and _odd. A polygon's edges are in memory once."""
    flat = polygons.where(F.size(rings) > 0).select(*ids, edges_of(rings).alias("_e"))
    flat = flat.select(*ids, *[F.col(f"_e.{k}").cast("array<double>").alias(k) for k in ("x1", "y1", "x2", "y2")])
    edge = T.ArrayType(T.StructType([T.StructField(k, T.DoubleType()) for k in ("x1", "y1", "x2", "y2")]))
    new = [("_lv", T.IntegerType()), ("_cx", T.LongType()), ("_cy", T.LongType()), ("_edges", edge), ("_ends", T.ArrayType(T.DoubleType())), ("_odd", T.BooleanType())]
    schema = T.StructType([*[flat.schema[x] for x in ids], *[T.StructField(k, t) for k, t in new]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                sides = [b.column(len(ids) + k)[i].values.to_numpy(zero_copy_only=False) for k in range(4)]
                cells = covering(np.stack(sides, 1)[np.isfinite(sides).all(axis=0)], most)
                while some := list(itertools.islice(cells, SENT)):
                    names = [b.column(k).take(pa.array([i] * len(some))) for k in range(len(ids))]
                    held = np.cumsum([0] + [len(c.edges) for c in some])
                    columns = [pa.array(v, pa.float64()) for v in np.concatenate([c.edges for c in some]).T]
                    edges = pa.ListArray.from_arrays(pa.array(held, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(arrow.field("_edges").type.value_type)))
                    rest = [pa.array([c.at[k] for c in some], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64()))]
                    ends, odd = pa.array([c.ends for c in some], pa.list_(pa.float64())), pa.array([c.odd for c in some])
                    yield pa.RecordBatch.from_arrays([*names, *rest, edges.cast(arrow.field("_edges").type), ends.cast(arrow.field("_ends").type), odd], schema=arrow)

    return flat.mapInArrow(run, schema)


def point_in_polygon(
    points: DataFrame,
    polygons: DataFrame,
    x: str,
    y: str,
    ids: list[str],
    rings: str = "rings",
    how: str = "left",
    edges: int = EDGES,
) -> DataFrame:
    """Points with the ids of the polygons that hold them; ``how`` is left or inner.

    Each distinct position looks up the cell of each size that the covering has: an equality join. Only cells at a border cast
    rays, over ``edges`` edges (a few times more where long ones lie side by side). A point in several overlapping polygons gives
    several rows; boundary rule as in ``inside``. Points without coordinates are in no polygon.
    """
    from headway.sinks.tables import stage

    cells = stage(polygon_cells(polygons, ids, rings, edges), "cells")
    sizes = [r[0] for r in cells.select("_lv").distinct().collect()]  # a few: one for each fourfold size
    at = points.withColumns({"_px": F.col(x).cast("double"), "_py": F.col(y).cast("double")})

    def spot(level):
        w = F.lit(float(SIDE) ** level)
        return F.struct(F.lit(level).alias("_lv"), F.floor(F.col("_px") / w).alias("_cx"), F.floor(F.col("_py") / w).alias("_cy"))

    spots = at.select("_px", "_py").na.drop().distinct()
    if sizes:
        spots = spots.withColumn("_s", F.explode(F.array(*[spot(v) for v in sizes]))).select("_px", "_py", "_s.*")
    else:
        spots = spots.select("_px", "_py", F.lit(0).alias("_lv"), F.lit(0).cast("long").alias("_cx"), F.lit(0).cast("long").alias("_cy"))
    past = F.size(F.filter("_ends", lambda v: v > F.col("_py"))) % 2 == 1
    cast = F.when(F.size("_edges") > 0, inside("_px", "_py", "_edges")).otherwise(False)
    odd = (cast.cast("int") + past.cast("int") + F.col("_odd").cast("int")) % 2 == 1
    hits = spots.join(cells, ["_lv", "_cx", "_cy"]).where(odd).select("_px", "_py", *ids)
    return at.join(hits, ["_px", "_py"], how).drop("_px", "_py")
