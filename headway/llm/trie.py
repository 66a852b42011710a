"""Prefix trie of conversations: what a node for each distinct beginning shares and saves.

A turn is named by 128 bits of a hash of its role and text, a conversation by the names of its turns in a row. The
names, put together, are a binary sort key: a beginning sorts before what continues it. Spark deals the
conversations out by ranges of that key and sorts each shard; a task takes blocks of a bounded number of cells from it and works on
a matrix of turn ids padded with 0:

* ``numpy.lexsort`` orders the rows by columns, equal ones by conversation id;
* a cell that differs from the row above marks a change; OR-accumulated along the row, the marks show where nodes of each depth start;
* from the deepest column to the root ``reduceat`` sums up the rows of each node: members, smallest id, children, leaves, savings.

A node that holds neither a block's first row nor its last lies whole in the block and is done. The others lie on the paths of
those two rows. Each path goes on as one row with what the block knows of its nodes (members, and the children, leaves and savings of
nodes that are done), and the same step runs on these rows, level by level, until they fit one block. So 2 rows of each block travel on, and no
node is gathered, however many conversations share it. A node's parent on such a path gets its id by a join with the block's paths.

The members that end at a node are hashed in the block, where the node is done. Those of nodes across blocks leave each block as one
text of ids, and the texts of a node are hashed one after another in the order of blocks.

Edge cases: null role and text count as empty. Turns are ordered by turn, null first, turns with one number by the hash of role and text.
Repeated rows are repeated turns. A turn without conversation id belongs to none and is left out. A conversation without turns ends at the root.
An empty table has no nodes, not even a root. A conversation travels as one row of 24 bytes a turn, whatever its texts; one that fills more than a
block's cells is a block of its own. Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from headway.llm.common import col
from headway.operators.sets import union_all
from headway.sinks.tables import stage

#: Cells (rows by columns) of a block, bytes of a turn's name, rows sent to the JVM at once.
CELLS = 1 << 19
NAME = 16
SENT = 20_000
NONE = np.iinfo(np.int64).max
EMPTY = hashlib.sha256(b"").hexdigest()
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
#: What a block gives: done nodes, path rows for the next level, the nodes of these paths, ids of members that end at them.
PARTIALS = ("members", "lowest", "children", "leaves", "saved")
BLOCK = (
    "kind string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
    "block long, side int, hash binary, ids string, key binary, pos long, sizes binary, " + ", ".join(f"{x} binary" for x in PARTIALS)
)
KINDS = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "binary": T.BinaryType()}
SCHEMA = T.StructType([T.StructField(x.split()[0], KINDS[x.split()[1]]) for x in BLOCK.split(", ")])
ARROW = to_arrow_schema(SCHEMA)


def sequences(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """A row for each conversation: ``conv_id`` and its ``turns`` in order, each with its name ``id`` and the bytes of its text."""
    who, what = (F.coalesce(col(x).cast("string"), F.lit("")) for x in (role, text))
    name = F.sha2(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, what), 256)
    one = F.struct(col(turn).alias("turn"), name.alias("name"), F.octet_length(what).cast("long").alias("bytes"))
    rows = df.where(col(conv).isNotNull()).groupBy(col(conv).cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("t"))
    return rows.select("conv_id", F.transform("t", lambda x: F.struct(F.left(x["name"], F.lit(2 * NAME)).alias("id"), x["bytes"].alias("bytes"))).alias("turns"))


def ranks(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The padded matrix of turn ids, numbered in the order of their names from 1 on, and the turns of each row."""
    size = np.array([len(k) // NAME for k in keys])
    flat = np.frombuffer(b"".join(keys), ">u8").astype(np.uint64).reshape(-1, 2)
    by = np.lexsort((flat[:, 1], flat[:, 0]))
    new = np.ones(len(by), bool)
    new[1:] = (flat[by[1:]] != flat[by[:-1]]).any(axis=1)
    rank = np.empty(len(by), np.int32)
    rank[by] = np.cumsum(new)
    return padded(rank, size, int(size.max())), size


def padded(flat: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(size), width), flat.dtype)
    out[np.arange(width) < size[:, None]] = flat
    return out


def prefix_hashes(key: bytes) -> list[bytes]:
    """A name for each beginning of a row, the empty one first."""
    h = hashlib.sha256()
    out = [h.digest()[:NAME]]
    for i in range(0, len(key), NAME):
        h.update(key[i : i + NAME])
        out.append(h.copy().digest()[:NAME])
    return out


def batch(kind: str, n: int, **columns) -> Iterator[pa.RecordBatch]:
    if n:
        arrays = [pa.array(np.full(n, kind), pa.string())]
        for f in list(ARROW)[1:]:
            x = columns.get(f.name)
            arrays.append(pa.nulls(n, f.type) if x is None else x if isinstance(x, pa.Array) else pa.array(x, f.type))
        whole = pa.RecordBatch.from_arrays(arrays, schema=ARROW)
        for i in range(0, n, SENT):
            yield whole.slice(i, SENT)


def nodes_of_block(keys, pos, sizes, partials, block: int, final: bool) -> Iterator[pa.RecordBatch]:
    """Nodes, path rows, paths and ends of one block.

    ``pos`` orders equal rows: the conversation's id where ``partials`` is None, so that each row is one conversation. Otherwise
    ``partials`` holds, for each row, arrays of what is known of the node at each depth of its path.
    """
    x, size = ranks(keys)
    n_rows, width = x.shape
    order = np.lexsort([pos, *(x[:, j] for j in range(width - 1, -1, -1))])
    weight = padded(np.concatenate(sizes), size, width)[order]
    known = None if partials is None else [padded(np.concatenate(p), size + 1, width + 1)[order] for p in partials]
    if known is not None:
        known[1][np.arange(width + 1) > size[order][:, None]] = NONE
    x, size, pos, keys = x[order], size[order], pos[order], [keys[i] for i in order]
    mark = np.ones((n_rows, width), bool)
    mark[1:] = x[1:] != x[:-1]
    mark = np.logical_or.accumulate(mark, axis=1)
    done_below, leaves_below, saved_below = (np.zeros(n_rows, np.int64) for _ in range(3))
    depths: list[dict] = []
    for d in range(width, -1, -1):
        start = np.flatnonzero(mark[:, d - 1]) if d else np.zeros(1, np.int64)
        end = np.append(start[1:], n_rows)
        real = x[start, d - 1] > 0 if d else np.ones(1, bool)

        def total(below, i):
            return (np.add.reduceat(below, start) + (np.add.reduceat(known[i][:, d], start) if known else 0))[real]

        members = (np.add.reduceat(known[0][:, d], start) if known else end - start)[real]
        lowest = np.minimum.reduceat(known[1][:, d] if known else pos, start)[real]
        children, leaves, saved = total(done_below, 2), total(leaves_below, 3), total(saved_below, 4)
        start, end = start[real], end[real]
        done = np.full(len(start), True) if final else (start > 0) & (end < n_rows)
        leaf = done & (children == 0)
        own = np.where(done, (members - 1) * (weight[start, d - 1] if d else 0), 0)
        leaves_below[start] += leaf
        saved_below[start] += own
        done_below[:] = 0
        done_below[start[done]] = 1
        depths.append(dict(start=start, end=end, done=done, partials=(members, lowest, children, leaves + leaf, saved + own)))
    depths.reverse()

    ends = [np.full(len(g["start"]), EMPTY, dtype=object) for g in depths]
    if partials is None:
        first = np.flatnonzero(mark[:, -1]) if width else np.zeros(1, np.int64)
        after = np.append(first[1:], n_rows)
        texts = []
        for a, b in zip(first.tolist(), after.tolist()):
            d = int(size[a])
            i = int(np.searchsorted(depths[d]["start"], a))
            ids = ",".join(map(str, pos[a:b].tolist()))
            if depths[d]["done"][i]:
                ends[d][i] = hashlib.sha256(ids.encode()).hexdigest()
            else:
                texts.append((prefix_hashes(keys[a])[-1], ids))
        yield from batch("ends", len(texts), hash=[h for h, _ in texts], ids=[t for _, t in texts], block=np.full(len(texts), block))

    hashes: dict[int, list[bytes]] = {}
    for d, g in enumerate(depths):
        done = g["done"]
        start, n = g["start"][done], int(done.sum())
        parent = above = side = None
        if d:
            above = depths[d - 1]
            at = np.searchsorted(above["start"], start, "right") - 1
            open_above = ~above["done"][at]
            parent = pa.array(above["partials"][1][at], mask=open_above)
            side = pa.array(np.where(above["start"][at] == 0, 0, 1).astype(np.int32), mask=~open_above)
        members, lowest, children, leaves, saved = (p[done] for p in g["partials"])
        names = None
        if partials is not None:
            names = [hashes.setdefault(i, prefix_hashes(keys[i]))[d] for i in start.tolist()]
        yield from batch(
            "node", n, conv_id=lowest, depth=np.full(n, d), parent_conv_id=parent, n_convs=members, n_children=children, n_leaves=leaves,
            saved_tokens=saved, ends_sha256=ends[d][done], block=np.full(n, block), side=side, hash=names,
        )
    if final:
        return
    for side, row in ((0, 0), (1, n_rows - 1)):
        at = [int(np.searchsorted(depths[d]["start"], row, "right")) - 1 for d in range(size[row] + 1)]
        mine = [side == 0 or depths[d]["start"][i] > 0 for d, i in enumerate(at)]
        if not mine[-1]:
            continue
        known_now = np.array([[p[i] for p in depths[d]["partials"]] if m else [0, NONE, 0, 0, 0] for d, (i, m) in enumerate(zip(at, mine))], np.int64)
        yield from batch(
            "path", 1, key=[keys[row]], pos=[2 * block + side], sizes=[weight[row, : size[row]].tobytes()],
            **{k: [known_now[:, i].tobytes()] for i, k in enumerate(PARTIALS)},
        )
        names = [(d, h) for (d, h), m in zip(enumerate(prefix_hashes(keys[row])), mine) if m]
        yield from batch("on_path", len(names), depth=[d for d, _ in names], hash=[h for _, h in names], block=[block] * len(names), side=[side] * len(names))


def level(rows: DataFrame, number: int, cells: int, parts: int | None) -> DataFrame:
    """One step on rows (key, pos, sizes and partials): blocks of sorted range shards, or a single last block for ``parts`` 1."""
    first = number == 0
    columns = ["key", "pos", "sizes"] + ([] if first else list(PARTIALS))
    rows, final = rows.select(*columns), parts == 1
    if final:
        dealt = rows.repartition(1)
    else:
        by = [F.col("key"), F.col("pos")]
        dealt = (rows.repartitionByRange(parts, *by) if parts else rows.repartitionByRange(*by)).sortWithinPartitions(*by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n_block = TaskContext.get().partitionId(), 0

        def longs(raw):
            return np.frombuffer(raw, np.int64)

        def close(held):
            keys, pos, sizes, *known = zip(*held)
            if first:
                sizes = [np.array(s, np.int64) for s in sizes]
            else:
                sizes = list(map(longs, sizes))
            partials = None if first else [list(map(longs, k)) for k in known]
            return nodes_of_block(list(keys), np.array(pos, np.int64), sizes, partials, (number << 56) + (part << 28) + n_block, final)

        held, wide = [], 0
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns]):
                wider = max(wide, len(row[0]) // NAME + 1)
                if held and not final and wider * (len(held) + 1) > cells:
                    yield from close(held)
                    n_block += 1
                    held, wider = [], len(row[0]) // NAME + 1
                held.append(row)
                wide = wider
        if held:
            yield from close(held)

    return dealt.mapInArrow(run, SCHEMA)


def end_hashes(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at each node across blocks, their texts taken in order and one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, h = None, None
        out = []
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if name != node:
                    out += [(node, h.hexdigest())] if h else []
                    node, h = name, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(text.encode())
        out += [(node, h.hexdigest())] if h else []
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], ["hash", "ended"])

    return ends.repartition("hash").sortWithinPartitions("hash", "block").select("hash", "ids").mapInArrow(run, "hash binary, ended string")


def prefix_nodes(turns: DataFrame, cells: int = CELLS) -> DataFrame:
    """The nodes of the trie of ``turns`` (as :func:`sequences` gives them; ``conv_id`` unique).

    Depth 0 is the root. ``conv_id`` is the smallest member, ``parent_conv_id`` the parent's; ``saved_tokens`` sums, over the node and all below it,
    the bytes of a node's last text for each member but one; ``ends_sha256`` hashes the ids of the members without a further turn.
    """
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), ""))
    rows = turns.select(key.alias("key"), F.col("conv_id").alias("pos"), F.transform("turns", lambda t: t["bytes"]).alias("sizes"))
    out = [stage(level(rows, 0, cells, None), "trie")]
    before = None
    while True:
        paths = out[-1].where("kind = 'path'")
        n = paths.agg(F.sum(F.octet_length("key") / NAME + 1)).first()[0]
        if not n:
            break
        # Rows too long for a block leave nothing to gain from another level.
        parts = 1 if n <= cells or (before and n > before / 2) else int(n // cells) + 1
        out.append(stage(level(paths, len(out), cells, parts), "trie"))
        before = n
        if parts == 1:
            break
    nodes = [d.where("kind = 'node'") for d in out]
    upper = union_all([d.select(*RESULT, "hash", "block", "side") for d in nodes[1:]]) if nodes[1:] else nodes[0].select(*RESULT, "hash", "block", "side")
    ended = end_hashes(out[0].where("kind = 'ends'").select("hash", "block", "ids"))
    upper = upper.join(ended, "hash", "left").withColumn("ends_sha256", F.coalesce("ended", "ends_sha256")).drop("ended")
    upper = stage(upper, "trie-upper")
    ids = upper.select("hash", F.col("conv_id").alias("_parent"))
    on_path = union_all([d.where("kind = 'on_path'").select("hash", "block", "side", (F.col("depth") + 1).alias("depth")) for d in out])
    parents = stage(on_path.join(ids, "hash").select("block", "side", "depth", "_parent"), "trie-parents")
    each = union_all([nodes[0].select(*RESULT, "block", "side"), upper.select(*RESULT, "block", "side")]) if nodes[1:] else nodes[0].select(*RESULT, "block", "side")
    below = each.where("side is not null").join(parents, ["block", "side", "depth"], "left").withColumn("parent_conv_id", F.col("_parent"))
    return each.where("side is null").select(*RESULT).unionByName(below.select(*RESULT))
