"""The closest site of each point, over a k-d partition of the sites by equal counts.

Sites are cut into groups of about ``GROUP`` by a k-d tree: the medians of a bounded sample of sites, the wider axis first. A
point is routed down the tree to its group; then the groups whose bounding box is no farther than the best site so far are
searched too, and no others. However dense the sites are, a group holds the same number of them, and inside a group a point
looks at leaves of ``LEAF`` sites in the order of their distance while they can hold a closer one.

On Spark, points and sites meet as blocks: rows with up to ``GROUP`` sites of a group and up to ``BLOCK`` points of it, so that a site
is copied once a block and not once a point. Points are dealt by ranges of (group, position), so that a crowded group is spread.
The tree and the boxes have a row for each group, at most ``GROUPS``; beyond that groups grow instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Sites of a group, of a leaf inside it; points of a block; groups at most; sites sampled for the tree.
GROUP, LEAF, BLOCK, GROUPS, SAMPLE = 8192, 64, 4096, 200_000, 400_000


class Tree:
    """A k-d tree with its cuts at medians; ``route`` gives the leaf of each position."""

    def __init__(self, xy: np.ndarray, size: int):
        self.axis, self.cut, self.left, self.right = [], [], [], []
        self.leaves = 0
        todo = [(xy, None)]
        while todo:
            part, slot = todo.pop()
            at = len(self.axis)
            if slot:
                slot[0][slot[1]] = at
            spread = np.ptp(part, axis=0) if len(part) else np.zeros(2)
            axis = int(spread[1] > spread[0])
            if len(part) <= size or spread[axis] == 0:
                self.axis.append(-1)
                self.cut.append(float(self.leaves))
                self.left.append(at)
                self.right.append(at)
                self.leaves += 1
                continue
            v = part[:, axis]
            cut = np.median(v)
            if not (v < cut).any():  # more than half share the least value
                cut = v[v > cut].min()
            self.axis.append(axis)
            self.cut.append(cut)
            self.left.append(0)
            self.right.append(0)
            todo += [(part[v < cut], (self.left, at)), (part[v >= cut], (self.right, at))]
        self.axis, self.left, self.right = (np.array(a, np.int64) for a in (self.axis, self.left, self.right))
        self.cut = np.array(self.cut)

    def route(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while (inner := self.axis[at] >= 0).any():
            v = np.where(self.axis[at] == 0, x, y)
            at = np.where(inner, np.where(v < self.cut[at], self.left[at], self.right[at]), at)
        return self.cut[at].astype(np.int64)


def box_distance2(boxes: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distance of each position to each box (columns xmin, ymin, xmax, ymax), as a matrix."""
    dx = np.maximum(np.maximum(boxes[:, 0] - x[:, None], x[:, None] - boxes[:, 2]), 0)
    dy = np.maximum(np.maximum(boxes[:, 1] - y[:, None], y[:, None] - boxes[:, 3]), 0)
    return dx * dx + dy * dy


def search(x, y, bound2, sx, sy, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the closest site no farther than the bound (-1: none), the smallest on ties; its squared distance; sites looked at."""
    n, m = len(sx), len(x)
    s = max(1, int(np.ceil(np.sqrt(n / leaf))))
    by_x = np.lexsort((sy, sx))
    order = by_x[np.lexsort((sy[by_x], np.arange(n) * s // n))]
    start = np.searchsorted(np.arange(n) * (s * s) // n, np.arange(s * s))
    start = start[np.append(np.diff(start) > 0, start[-1] < n)]  # leaves that hold a site
    xs, ys = sx[order], sy[order]
    boxes = np.stack([np.minimum.reduceat(xs, start), np.minimum.reduceat(ys, start), np.maximum.reduceat(xs, start), np.maximum.reduceat(ys, start)], 1)
    size = np.diff(np.append(start, n))
    member = order[np.minimum(start[:, None] + np.arange(size.max()), (start + size - 1)[:, None])]
    best, which, looked = np.array(bound2, np.float64), np.full(m, n), np.zeros(m, np.int64)
    step = max(1, 2_000_000 // (len(boxes) + member.shape[1]))
    for a in range(0, m, step):
        far = box_distance2(boxes, x[a : a + step], y[a : a + step])
        near = np.argsort(far, axis=1)
        rows = np.arange(len(far))
        for r in range(len(boxes)):
            at = near[rows, r]
            go = far[rows, at] <= best[a + rows]
            rows, at = rows[go], at[go]
            if not len(rows):
                break
            c, k = member[at], a + rows
            d = (sx[c] - x[k][:, None]) ** 2 + (sy[c] - y[k][:, None]) ** 2
            low = d.min(axis=1)
            i = np.where(d == low[:, None], c, n).min(axis=1)
            better = (low < best[k]) | ((low == best[k]) & (i < which[k]))
            best[k] = np.where(better, low, best[k])
            which[k] = np.where(better, i, which[k])
            looked[k] += size[at]
    return np.where(which < n, which, -1), best, looked


def _doubles(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _grouped(df: DataFrame, tree: Tree) -> DataFrame:
    """Add ``_g``, the group of (_x, _y)."""
    schema = T.StructType([*df.schema.fields, T.StructField("_g", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.route(_doubles(b, "_x"), _doubles(b, "_y")))], names=schema.names)

    return df.mapInArrow(run, schema)


def _blocks(points: DataFrame) -> DataFrame:
    """Points (_g, _x, _y, _bound) of a group as rows of up to ``BLOCK`` of them."""
    dealt = points.select("_g", "_x", "_y", "_bound").repartitionByRange("_g", "_x", "_y").sortWithinPartitions("_g", "_x", "_y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, *rest = (_doubles(b, c) for c in ("_g", "_x", "_y", "_bound"))
            cuts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(g)) + 1, np.arange(0, len(g), BLOCK)]))
            ends = np.append(cuts[1:], len(g))
            lists = [[v[i:j] for i, j in zip(cuts, ends)] for v in rest]
            yield pa.RecordBatch.from_arrays([pa.array(g[cuts]), *[pa.array(x, pa.list_(pa.float64())) for x in lists]], names=["_g", "_xs", "_ys", "_bounds"])

    return dealt.mapInArrow(run, "_g long, _xs array<double>, _ys array<double>, _bounds array<double>")


def _searched(blocks: DataFrame, sites: DataFrame) -> DataFrame:
    """(_x, _y, _d2, _id): for each point of a block the best site of its group within the bound, if there is one."""
    kind = sites.schema["_ids"].dataType.elementType
    real = T.DoubleType()
    out = T.StructType().add("_x", real).add("_y", real).add("_d2", real).add("_id", kind).add("_looked", T.LongType())
    both = blocks.join(sites, "_g").select("_xs", "_ys", "_bounds", "_sx", "_sy", "_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x, y, bound, sx, sy = (b.column(k)[i].values.to_numpy(zero_copy_only=False) for k in range(5))
                which, d2, looked = search(x, y, bound, sx, sy)
                hit = which >= 0
                ids = b.column(5)[i].values.take(pa.array(which[hit]))
                yield pa.RecordBatch.from_arrays([pa.array(x[hit]), pa.array(y[hit]), pa.array(d2[hit]), ids, pa.array(looked[hit])], names=out.names)

    return both.mapInArrow(run, out)


def _beyond(best: DataFrame, tree: Tree, boxes: np.ndarray) -> DataFrame:
    """(_g, _x, _y, _bound): the other groups that may hold a site as close as the best one so far."""
    by = np.argsort(boxes[:, 0])
    left, right = boxes[by, 0], np.maximum.accumulate(boxes[by, 2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, d2 = (_doubles(b, c) for c in ("_x", "_y", "_d2"))
            home, reach = tree.route(x, y), np.sqrt(d2) * (1 + 1e-12)
            order = np.argsort(x)
            step = max(1, min(1024, 4_000_000 // len(boxes)))
            for a in range(0, len(x), step):
                k = order[a : a + step]
                lo, hi = np.searchsorted(right, (x[k] - reach[k]).min()), np.searchsorted(left, (x[k] + reach[k]).max(), "right")
                some = by[lo:hi]
                p, g = np.nonzero(box_distance2(boxes[some], x[k], y[k]) <= d2[k][:, None])
                p, g = k[p], some[g]
                other = g != home[p]
                p, g = p[other], g[other]
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(x[p]), pa.array(y[p]), pa.array(d2[p])], names=["_g", "_x", "_y", "_bound"])

    return best.select("_x", "_y", "_d2").mapInArrow(run, "_g long, _x double, _y double, _bound double")


def _placed(df: DataFrame, x: str, y: str, *more: Column) -> DataFrame:
    """Rows with two finite coordinates, as _x and _y."""
    xy = df.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), *more)
    return xy.where(~(F.isnull("_x") | F.isnull("_y") | F.isnan("_x") | F.isnan("_y") | (F.abs("_x") == float("inf")) | (F.abs("_y") == float("inf"))))


def nearest_sites(points: DataFrame, sites: DataFrame, sid: str, sx: str, sy: str, px: str, py: str, group: int = GROUP) -> DataFrame:
    """(_x, _y, _d, _id, _looked) of each distinct position of the points: distance and id of the closest site, sites looked at.

    Empty where there is no site.
    """
    from headway.sinks.tables import stage

    places = _placed(sites, sx, sy, F.col(sid).alias("_id")).groupBy("_x", "_y").agg(F.min("_id").alias("_id"))
    places = stage(places, "sites")
    n = places.count()
    group = max(group, -(-n // GROUPS))
    share = min(1.0, SAMPLE / max(n, 1))
    sample = places.where(F.pmod(F.xxhash64("_x", "_y"), F.lit(1 << 30)) < share * (1 << 30)).select("_x", "_y")
    tree = Tree(np.array([tuple(r) for r in sample.toLocalIterator()], np.float64).reshape(-1, 2), max(1, int(group * share)))
    dealt = stage(_grouped(places, tree), "sites-dealt")
    edges = [f(c).alias(f.__name__ + c) for f in (F.min, F.max) for c in ("_x", "_y")]
    found = dealt.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), *edges)
    boxes = np.full((tree.leaves, 4), np.inf)
    for r in found.drop("n").collect():
        boxes[r[0]] = r[1:]
    # A group that the sample took for smaller comes in several rows; each keeps the order of ids.
    many = F.ceil(F.col("n") / group)
    packed = dealt.join(found.select("_g", "n"), "_g").groupBy("_g", F.pmod(F.xxhash64("_x", "_y"), many).alias("_c")).agg(
        F.sort_array(F.collect_list(F.struct("_id", "_x", "_y"))).alias("s")
    )
    packed = stage(packed.select("_g", F.col("s._x").alias("_sx"), F.col("s._y").alias("_sy"), F.col("s._id").alias("_ids")), "sites-packed")
    seen = _grouped(_placed(points, px, py).distinct(), tree).withColumn("_bound", F.lit(float("inf")))
    # A leaf of the tree without sites of its own hands its points to the nearest box.
    full = np.isfinite(boxes[:, 0])
    if n and not full.all():
        seen = _rehomed(seen, boxes, full)

    def best(d):
        return d.groupBy("_x", "_y").agg(F.min(F.struct("_d2", "_id")).alias("b"), F.sum("_looked").alias("_looked")).select("_x", "_y", "b.*", "_looked")

    home = stage(best(_searched(_blocks(seen), packed)), "nearest-home")
    if not n:
        return home.select("_x", "_y", F.sqrt("_d2").alias("_d"), "_id", "_looked")
    other = _searched(_blocks(_beyond(home, tree, boxes)), packed)
    return best(home.unionByName(other)).select("_x", "_y", F.sqrt("_d2").alias("_d"), "_id", "_looked")


def _rehomed(seen: DataFrame, boxes: np.ndarray, full: np.ndarray) -> DataFrame:
    names, some = np.flatnonzero(full), boxes[full]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, x, y = (_doubles(b, c).copy() for c in ("_g", "_x", "_y"))
            for k in np.array_split(np.flatnonzero(~full[g]), max(1, len(g) // 64)):
                if len(k):
                    g[k] = names[box_distance2(some, x[k], y[k]).argmin(axis=1)]
            yield b.set_column(b.schema.get_field_index("_g"), "_g", pa.array(g))

    return seen.mapInArrow(run, seen.schema)
