"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Targets. Sources share ``ratio`` of all words by weight. A target stops at ``most`` times its
   source's words, and the excess is shared again by weight among the others.
2. Blocks. The documents of a source are put in a keyed random order and their words cut into blocks of
   equal length. A source's quota is its target in whole blocks.
3. Splitting tree. The quotas are split among the output shards: a node halves its shards and draws, from
   its quotas, how many blocks of each source go left, without replacement (multivariate
   hypergeometric). Sources are split the same way: first groups of sources, each group then in a
   task of its own. The shards together get exactly the quotas.
4. Draws. The blocks of a source are permuted by a keyed Feistel network; draw p takes block p of the
   permutation, and beyond the last block begins again with another permutation. A shard takes
   the draws of its range, so shards are disjoint and no block is taken more than ``most`` times.
5. Local shuffle. Inside a shard, pieces are ordered by a keyed hash.

A document's place in its source is a running sum over hash slices, so a source with a third of all
rows is spread over tasks. Only one row for each source group and shard passes through the driver.

Edge cases: a null or word-less text has size 0 and takes nothing. A null source is a source of its
own, last in order. All sizes zero: all targets are zero. An empty table gives no rows. Repeated rows
are documents of their own. An input column named like an output column is replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from headway.llm.common import SPACE_WORD, col, others
from headway.operators.spans import running
from headway.sinks.tables import stage

#: Words of a block, and the most blocks of all sources together (longer blocks are used beyond).
BLOCK_WORDS = 64
MOST_BLOCKS = 1 << 28
#: A small source has at least this many blocks, so that its quota is near its target.
LEAST_BLOCKS = 100
SHARDS = 64
#: Sources of a group of the tree; documents of a hash slice, on average.
GROUP_SOURCES = 1024
SLICE_DOCS = 50_000
FEISTEL_ROUNDS = 4


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), ratio: float = 1.5, most: float = 2.0) -> DataFrame:
    """(src, source, source_size, target) from (src, source, source_size): one row for each source.

    Weights repeat over the sources in code point order, null last. The common level of words a
    weight is raised until the sources below their limit take up what the limited ones leave.
    """
    n = len(weights)
    named = sizes.withColumn("none", F.col("source").isNull())
    # Numbered in slices by leading characters, so that no task orders all sources.
    slices = [F.col("none"), F.substring("src", 1, 3)]
    placed = running(named, [], ["none", "src"], slices, None, "at")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("at") - 1, F.lit(n)) + 1).cast("int"))
    limits = stage(
        placed.select("src", "source", "source_size", weight.alias("w"), (F.col("source_size") * most).alias("cap")), "mixing-sources"
    )
    whole = limits.agg(F.sum("source_size").alias("t"), F.sum("w").alias("w")).first()
    budget, weights_sum = (whole["t"] or 0) * ratio, whole["w"] or 1.0
    level, fixed = budget / weights_sum, 0
    while True:
        full = F.col("w") * level >= F.col("cap")
        got = limits.agg(F.sum(F.when(full, F.col("cap"))).alias("cap"), F.sum(F.when(~full, F.col("w"))).alias("w"), F.count_if(full).alias("n")).first()
        if got["n"] == fixed or not got["w"]:
            break
        fixed, level = got["n"], (budget - (got["cap"] or 0.0)) / got["w"]
    return limits.select("src", "source", "source_size", F.least(F.col("w") * level, F.col("cap")).alias("target"))


# ---------------------------------------------------------------- splitting tree


def split_tree(quotas: np.ndarray, shares: np.ndarray, path: list[int]) -> np.ndarray:
    """Quotas (by row) dealt to shards of the given sizes; column sums are the shares."""
    if len(shares) == 1:
        return quotas.reshape(-1, 1)
    half = len(shares) // 2
    take = int(shares[:half].sum())
    rng = np.random.default_rng(path)
    left = rng.multivariate_hypergeometric(quotas, take, method="marginals") if len(quotas) else quotas
    return np.concatenate([split_tree(left, shares[:half], [*path, 0]), split_tree(quotas - left, shares[half:], [*path, 1])], axis=1)


def even_shares(total: int, shards: int) -> np.ndarray:
    return np.full(shards, total // shards, np.int64) + (np.arange(shards) < total % shards)


def deal(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(src, firsts): where the range of a source's draws begins that each shard takes.

    ``quotas`` has (src, quota). Groups of sources are split on the driver, a row each; the sources of a
    group in a task.
    """
    groups = max(1, -(-quotas.count() // GROUP_SOURCES))
    marked = quotas.withColumn("grp", F.pmod(F.xxhash64("src"), F.lit(groups)).cast("int"))
    sums = sorted((r["grp"], r["q"]) for r in marked.groupBy("grp").agg(F.sum("quota").alias("q")).collect())
    totals = np.array([q for _, q in sums], np.int64)
    split = split_tree(totals, even_shares(int(totals.sum()), shards), [seed])
    rows = [(g, row.tolist()) for (g, _), row in zip(sums, split)]
    shares = quotas.sparkSession.createDataFrame(rows, "grp int, shares array<long>")

    def inside(pdf):
        pdf = pdf.sort_values("src", kind="stable").reset_index(drop=True)
        got = split_tree(pdf["quota"].to_numpy(np.int64), np.array(pdf["shares"].iloc[0], np.int64), [seed, 2 + int(pdf["grp"].iloc[0])])
        return pdf[["src"]].assign(firsts=(np.cumsum(got, axis=1) - got).tolist())

    return marked.join(shares, "grp").groupBy("grp").applyInPandas(inside, "src string, firsts array<long>")


# ---------------------------------------------------------------- draws


def place_in(b: Column, n: Column, epoch: Column, source_hash: Column, seed: int) -> Column:
    """Position of block b (0 .. n-1) in the permutation of an epoch: an alternating Feistel network on pairs.

    b is written as (x, y) below (a, c) with a * c >= n; results outside n walk on along their cycle.
    """
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    c = F.ceil(n / a).cast("long")

    def once(v):
        def turn(acc, i):
            x, y = acc["x"], acc["y"]
            hx = F.pmod(F.xxhash64(F.lit(seed), source_hash, epoch, i, y), a)
            hy = F.pmod(F.xxhash64(F.lit(seed), source_hash, epoch, i, x), c)
            return F.when(i % 2 == 0, F.struct(((x + hx) % a).alias("x"), y.alias("y"))).otherwise(
                F.struct(x.alias("x"), ((y + hy) % c).alias("y"))
            )

        begin = F.struct(F.floor(v / c).cast("long").alias("x"), (v % c).cast("long").alias("y"))
        done = F.aggregate(F.sequence(F.lit(0), F.lit(FEISTEL_ROUNDS - 1)), begin, turn)
        return done["x"] * c + done["y"]

    # a * c exceeds n by less than a, so a walk outside is rare and short; 64 steps bound it.
    def walk(v, _):
        return F.when(v < n, v).otherwise(once(v))

    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), once(b), walk)


ADDED = ("size", "source_size", "target", "pieces")
PIECES = "array<struct<shard:int,draw:long,copy:int,first:long,n:long>>"


def mix(
    df: DataFrame, text: str, source: str, key: str, weights: tuple[float, ...] = (3, 1, 2), ratio: float = 1.5,
    most: int = 2, shards: int = SHARDS, seed: int = 7, keep: list[str] | None = None, stored: bool = False,
) -> DataFrame:
    """Add ``size``, ``source_size``, ``target`` (its source's) and ``pieces`` to every document.

    A piece is a run of ``n`` words from word ``first`` (0-based) that ``shard`` takes, ``draw`` being its
    place among the source's draws and ``copy`` the times its block was taken before. ``keep`` names
    the columns that stay. The input is written once with its sizes, unless it is ``stored`` already: then it is read three times.
    """
    kept = [x for x in others(df, ADDED) if keep is None or x in keep]
    src = F.coalesce(F.concat(F.lit("="), col(source).cast("string")), F.lit(""))
    # Ties of the key are told apart by text and, for equal rows, do not matter.
    order = F.xxhash64(F.lit(seed), col(key).cast("string"), col(text))
    rows = df.select(*[col(x).alias(f"k{i}") for i, x in enumerate(kept)], src.alias("src"), col(source).cast("string").alias("source"),
                     words_in(col(text)).alias("size"), order.alias("h"))
    rows = rows if stored else stage(rows, "mixing-rows")
    sizes = rows.groupBy("src").agg(F.first("source", True).alias("source"), F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    aims = targets(sizes.select("src", "source", "source_size"), weights, ratio, float(most))
    facts = sizes.agg(F.sum("source_size").alias("words"), F.sum("docs").alias("docs")).first()
    words, docs = facts["words"] or 0, facts["docs"] or 0
    longest = max(BLOCK_WORDS, -(-int(words * ratio) // MOST_BLOCKS))
    block = F.greatest(F.lit(1), F.least(F.lit(longest), F.floor(F.col("source_size") / LEAST_BLOCKS))).cast("long")
    n_blocks = F.ceil(F.col("source_size") / F.col("block")).cast("long")
    quota = F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(0).cast("long")
    plan = stage(
        aims.withColumn("block", block).withColumn("blocks", n_blocks)
        .withColumn("quota", F.least(quota, F.col("blocks") * most)),
        "mixing-plan",
    )
    dealt = deal(plan.select("src", "quota"), shards, seed)
    plan = stage(plan.join(dealt, "src").select("src", "source_size", "target", "block", "blocks", "quota", "firsts"), "mixing-dealt")
    bits = max(0, (-(-docs // SLICE_DOCS) - 1).bit_length())
    cut = F.shiftright("h", 64 - bits) if bits else F.lit(0)
    placed = running(rows.drop("source"), ["src"], ["h"], [cut.cast("long")], F.col("size"), "end", source=rows)
    joined = placed.join(plan, "src").withColumn("start", F.col("end") - F.col("size"))
    return joined.withColumn("pieces", _pieces(most, seed)).select(
        *[F.col(f"k{i}").alias(x) for i, x in enumerate(kept)], "size", "source_size", "target", "pieces"
    )


def _pieces(most: int, seed: int) -> Column:
    """What the draws take of each block that the document covers."""
    start, end, block = F.col("start"), F.col("end"), F.col("block")

    def taken(b):
        first, last = F.greatest(b * block, start), F.least((b + 1) * block, end)

        def copy(e):
            draw = place_in(b, F.col("blocks"), e, F.xxhash64("src"), seed) + e * F.col("blocks")
            return F.struct(draw.alias("draw"), e.alias("copy"), (first - start).alias("first"), (last - first).alias("n"))

        return F.transform(F.sequence(F.lit(0), F.lit(most - 1)), copy)

    covered = F.sequence(F.floor(start / block), F.floor((end - 1) / block))
    draws = F.filter(F.flatten(F.transform(covered, taken)), lambda x: x["draw"] < F.col("quota"))
    dealt = F.transform(
        draws,
        lambda x: F.struct(
            F.size(F.filter("firsts", lambda f: f <= x["draw"])).alias("shard"), x["draw"].alias("draw"),
            x["copy"].alias("copy"), x["first"].alias("first"), x["n"].alias("n"),
        ),
    )
    return F.when(F.col("size") > 0, dealt).otherwise(F.lit(None)).cast(PIECES)


def taken_words() -> Column:
    return F.coalesce(F.aggregate("pieces", F.lit(0).cast("long"), lambda t, p: t + p["n"]), F.lit(0).cast("long"))


def mixture(df: DataFrame, text: str, source: str, key: str, seed: int = 7, **options) -> DataFrame:
    """The mixed corpus: a row for each piece, with its text, dealt to shards and shuffled inside them.

    Columns: shard, place (a keyed hash to read a shard by), the key, the source, copy, first, n and text. Rows
    of a shard stand in files of random parts of it, in the order of ``place``.
    """
    mixed = mix(df, text, source, key, seed=seed, keep=[key, source, text], **options)
    words = F.regexp_extract_all(col(text), F.lit(SPACE_WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    pieces = mixed.withColumn("words", words).select(
        col(key).alias("key"), col(source).alias("source"),
        F.inline(F.transform("pieces", lambda p: F.struct(p["shard"].alias("shard"), p["draw"].alias("draw"), p["copy"].alias("copy"),
            p["first"].alias("first"), p["n"].alias("n"), F.array_join(F.slice("words", (p["first"] + 1).cast("int"), p["n"].cast("int")), "").alias("text")))),
    )
    place = F.xxhash64(F.lit(seed), "shard", "source", "draw", "key", "first")
    out = pieces.withColumn("place", place).repartition("shard", F.pmod("place", F.lit(16)))
    return out.sortWithinPartitions("shard", "place").select(
        "shard", "place", F.col("key").alias(key), F.col("source").alias(source), "copy", "first", "n", F.col("text").alias(text)
    )
