"""SimHash near-duplicate groups through a Gray-order hierarchical index.

A fingerprint bit is set when it is set in over half of the hashes of a text's word shingles.
Fingerprints within ``radius`` bits are linked; a group is a connected component of the links.

Distinct fingerprints are joined by a tree of shared masked bit patterns. The bits are cut into
``radius + 1`` blocks: two linked fingerprints agree on one block at least, so each fingerprint goes
below one upper node (mask, pattern) for each block. A node with more than ``leaf`` fingerprints is
cut again over the bits its mask leaves free, until nodes are small; a node with no more than 12 free
bits cannot hold more than 4096 distinct fingerprints, so every leaf is bounded and no pair is lost.
Inside a leaf, fingerprints are sorted by Gray rank and folded into runs whose common bits form the
inner nodes; a search adds up the differences on the way down and drops a whole run as soon as they
exceed the radius. A leaf reports a spanning forest of its links, at most a row for each
fingerprint, never all pairs. Components are found by repeated min-label stars over these rows.

Edge cases: null or word-less text has fingerprint zero and is linked like any other. Repeated
rows are members of one group. A null key never names a component unless the whole component has
none. An empty table gives no rows. An input column named like an output column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from headway.llm.common import annotate, chunks, col
from headway.sinks.tables import stage

BITS = 64
LEAF = 1024
FANOUT = 8


# ---------------------------------------------------------------- fingerprints


def fingerprint_of(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    width = min(width, len(words))
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[width - 1 :])], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprints(df: DataFrame, text: str, width: int = 3, seed: int = 42, keep: list[str] | None = None) -> DataFrame:
    """Add ``fp``, the fingerprint as a signed 64-bit integer."""

    def make():
        def run(texts):
            return {"fp": np.array([fingerprint_of(t, width, seed) for t in texts], np.uint64).view(np.int64)}

        return run

    return annotate(df, text, "fp long", make, keep)


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# ---------------------------------------------------------------- upper nodes: shared masked patterns


def blocks_of(mask: int, parts: int) -> list[int]:
    """The free bits of ``mask`` cut into ``parts`` runs, each added to the mask."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    cuts = [round(len(free) * k / parts) for k in range(parts + 1)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def leaves(fps: DataFrame, radius: int, leaf: int) -> DataFrame:
    """(mask, pattern, fp) for every leaf node with two fingerprints or more.

    ``fps`` holds distinct fingerprints. Each round writes its nodes' members once, counts them, and
    hands the members of crowded nodes to the next round.
    """
    done, masks, rows = [], [0], fps.select(F.lit(0).cast("long").alias("mask"), "fp")
    while masks:
        below = {m: blocks_of(m, radius + 1) for m in masks}
        pairs = [F.when(F.col("mask") == _signed(m), F.array(*[F.lit(_signed(b)).cast("long") for b in bs])) for m, bs in below.items()]
        members = stage(
            rows.select(F.explode(F.coalesce(*pairs)).alias("mask"), "fp")
            .withColumn("pattern", F.expr("fp & mask")),
            "simhash-nodes",
        )
        size = members.groupBy("mask", "pattern").agg(F.count(F.lit(1)).alias("n"))
        kinds = {r["mask"]: r["most"] for r in size.groupBy("mask").agg(F.max("n").alias("most")).collect()}
        full = [m for m in sorted({b for bs in below.values() for b in bs}) if kinds.get(_signed(m), 0) > leaf]
        final = [m for m in full if BITS - m.bit_count() <= 12]  # bounded by their free bits
        masks = [m for m in full if m not in final]
        crowded = F.col("n") > leaf
        if final:
            crowded &= ~F.col("mask").isin([_signed(m) for m in final])
        sized = members.join(size.where(F.col("n") > 1), ["mask", "pattern"])
        done.append(sized.where(~crowded).select("mask", "pattern", "fp"))
        rows = sized.where(crowded).select("mask", "fp")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


# ---------------------------------------------------------------- leaves: Gray order


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    r = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class GrayIndex:
    """Runs of Gray-sorted codes, folded upwards inside each group; ``group`` never decreases.

    A node keeps the bits its members share. ``mask[k]`` and ``pattern[k]`` hold, for level k, only
    the shared bits that its parent does not share already, so differences add up on the way down.
    """

    def __init__(self, codes: np.ndarray, group: np.ndarray):
        self.levels = []
        common, shared, owner = np.full(len(codes), ~np.uint64(0)), codes, group
        while True:
            self.levels.append([common, shared, owner, None])
            if len(owner) == len(np.unique(owner)):
                break
            first = np.concatenate([[True], owner[1:] != owner[:-1]])
            begin = np.flatnonzero(first)
            inside = np.arange(len(owner)) - begin[np.cumsum(first) - 1]
            start = np.flatnonzero(inside % FANOUT == 0)
            all_set, any_set = np.bitwise_and.reduceat(shared, start), np.bitwise_or.reduceat(shared, start)
            both = np.bitwise_and.reduceat(common, start)
            self.levels[-1][3] = np.append(start, len(owner))  # children of parent j: start[j] .. start[j + 1]
            common, shared, owner = both & ~(all_set ^ any_set), all_set, owner[start]
        self.top = len(self.levels) - 1
        self.rest = [None] * (self.top + 1)
        for k in range(self.top, -1, -1):
            common, shared, _, _ = self.levels[k]
            if k == self.top:
                new = common
            else:
                bounds = self.levels[k][3]
                new = common & ~np.repeat(self.levels[k + 1][0], np.diff(bounds))
            self.rest[k] = (new, shared & new)

    def search(self, queries: np.ndarray, root: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query position, code position) of all codes within the radius, below each query's root."""
        q, node = np.arange(len(queries)), root
        acc = np.zeros(len(q), np.int64)
        for k in range(self.top, -1, -1):
            mask, pattern = self.rest[k]
            acc = acc + np.bitwise_count((queries[q] & mask[node]) ^ pattern[node])
            near = acc <= radius
            q, node, acc = q[near], node[near], acc[near]
            if k:
                bounds = self.levels[k - 1][3]
                width = bounds[node + 1] - bounds[node]
                ends = np.cumsum(width)
                at = np.repeat(np.arange(len(node)), width)
                node = bounds[node][at] + np.arange(len(at)) - (ends - width)[at]
                q, acc = q[at], acc[at]
        return q, node


def forest(codes: np.ndarray, group: np.ndarray, radius: int) -> np.ndarray:
    """For each code the position of the first code of its component inside its group."""
    order = np.lexsort((gray_rank(codes), group))
    c, g = codes[order], group[order]
    index = GrayIndex(c, g)
    roots = index.levels[index.top][2]
    root = np.searchsorted(roots, g)
    left, right = [], []
    members = np.bincount(g)[g]
    for a, b in chunks(members, 1 << 21):
        q, hit = index.search(c[a:b], root[a:b], radius)
        q = q + a
        up = hit > q
        left.append(q[up])
        right.append(hit[up])
    a, b = np.concatenate(left), np.concatenate(right)
    label = np.arange(len(c))
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        label = new[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    out = np.empty(len(c), np.int64)
    out[order] = order[label]
    return out


def leaf_links(nodes: DataFrame, radius: int) -> DataFrame:
    """(a, b) rows that connect the linked fingerprints of each leaf node."""
    rows = nodes.repartition("mask", "pattern").sortWithinPartitions("mask", "pattern")

    def solve(held: list[tuple]) -> pa.RecordBatch | None:
        mask, pattern, fp = (np.concatenate(x) for x in zip(*held))
        group = np.cumsum(np.concatenate([[0], (mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1])]))
        to = forest(fp.view(np.uint64), group, radius)
        moved = to != np.arange(len(fp))
        return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[to[moved]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            m, p, f = (batch.column(i).to_numpy() for i in range(3))
            if not len(m):
                continue
            held.append((m, p, f))
            size += len(m)
            if size < 16 * LEAF:
                continue
            m, p, f = (np.concatenate(x) for x in zip(*held))
            last = np.flatnonzero((m != m[-1]) | (p != p[-1]))
            cut = last[-1] + 1 if len(last) else 0  # the last node may go on in the next batch
            if cut:
                yield solve([(m[:cut], p[:cut], f[:cut])])
            held, size = [(m[cut:], p[cut:], f[cut:])], len(m) - cut
        if held and size:
            yield solve(held)

    return rows.select("mask", "pattern", "fp").mapInArrow(run, "a long, b long")


# ---------------------------------------------------------------- components


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b), root being the smallest node it reaches.

    Large and small stars in turn: every round hangs each node's larger neighbours, then its smaller
    ones, on its smallest neighbour, until nothing moves. Rounds grow with the logarithm of a
    component's size. Each round is written to the shared folder.
    """
    edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "stars")
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(small, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = stage(hung.where("u <> v").distinct(), "stars")
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if before == (state["n"], state["h"]):
            break
        before = (state["n"], state["h"])
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def near_duplicates(df: DataFrame, text: str, key: str, radius: int = 2, width: int = 3, seed: int = 42, leaf: int = LEAF) -> DataFrame:
    """(key, fingerprint, component_id) of every row.

    The fingerprints are written once; everything after works on 16 bytes a row, and the index on
    distinct fingerprints only, so a huge group of equal texts is one entry of it.
    """
    prints = stage(with_fingerprints(df, text, width, seed, [key]).select(col(key).alias("key"), "fp"), "simhash")
    distinct = stage(prints.groupBy("fp").agg(F.min("key").alias("least_key")), "simhash-distinct")
    linked = components(leaf_links(leaves(distinct.select("fp"), radius, leaf), radius))
    roots = distinct.join(linked, distinct["fp"] == linked["node"], "left").select("fp", "least_key", F.coalesce("root", "fp").alias("root"))
    roots = stage(roots, "simhash-roots")
    least = roots.groupBy("root").agg(F.min("least_key").alias("component_id"))
    named = roots.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(F.col("key").alias(key), hex16(F.col("fp")).alias("fingerprint"), "component_id")
