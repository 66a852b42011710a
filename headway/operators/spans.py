"""Ordered windows that split hot keys.

A window partitioned by key puts all rows of a key into one task. Here a key is cut into bounded
pieces and the rows a frame needs from the neighbouring piece are copied along, so the result is
the one the plain window gives while no task sees more than a slice or a block of a key.

* :func:`place` numbers the rows of each key exactly. The caller names *slices*: expressions that
  never decrease along the order (an hour for a time order, say). Rows are numbered inside
  (key, slice) and shifted by the row counts of earlier slices, which are pre-aggregated.
* :func:`rowwise` evaluates bounded ROWS frames over blocks of consecutive positions.
* :func:`timewise` evaluates bounded RANGE frames over time slices, :func:`timewise_mean` means over frames of very many rows.
* :func:`running` gives cumulative sums over an order of any length.
* :func:`known_neighbours` finds the nearest known value over a gap of any length.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

from headway.functions.clock import c, floor_to, micros

BLOCK_ROWS = 100_000
#: Leading hex digits of a hash that cut an order by it into slices: 4,096 of them. One task shifts their counts, and a join sends them
#: to the others, so their number does not follow that of the rows.
HASH_DIGITS = 3
POS = "_pos"


def hourly(ts) -> list[Column]:
    """Slices for a time order: one per clock hour."""
    return [floor_to(ts, 3600)]


def daily(ts) -> list[Column]:
    return [floor_to(ts, 86400)]


def _span(keys: Sequence[str], slices: Sequence[Column]) -> Column:
    named = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    cut = [c(s).alias(f"s{i}") for i, s in enumerate(slices)]
    return F.struct(*named, *cut)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence,
    slices: Sequence,
    weight: Column | None = None,
    name: str = POS,
    total: str | None = None,
    source: DataFrame | None = None,
) -> DataFrame:
    """Cumulative sum of ``weight`` (rows when None) per key, current row included.

    ``total`` also adds the sum over the whole key. ``order`` must be total and the slices must
    follow it. The slice sums are a second, narrow pass over the rows; where ``df`` already
    carries costly columns, name an earlier frame with the same rows as ``source`` for it.
    """
    w = F.lit(1).cast("long") if weight is None else weight
    marked = df.withColumns({"_span": _span(keys, slices), "_weight": w})
    narrow = (df if source is None else source).select(_span(keys, slices).alias("_span"), w.alias("_weight"))
    sums = narrow.groupBy("_span").agg(F.sum("_weight").alias("_sum"))
    key_cols = [F.col(f"_span.k{i}") for i in range(len(keys))]
    over_key = Window.partitionBy(*key_cols)
    earlier = over_key.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.select(
        F.col("_span"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"),
        *([F.sum("_sum").over(over_key).alias(total)] if total else []),
    )
    local = Window.partitionBy("_span").orderBy(*order)
    inner = (
        F.row_number().over(local).cast("long")
        if weight is None
        else F.sum("_weight").over(local.rowsBetween(Window.unboundedPreceding, 0))
    )
    return (
        marked.withColumn("_inner", inner)
        .join(shift, "_span")
        .withColumn(name, F.col("_inner") + F.col("_before"))
        .drop("_span", "_weight", "_inner", "_before")
    )


def place(df, keys, order, slices, name: str = POS, total: str | None = None, source=None) -> DataFrame:
    """Exact 1-based row number per key, as bigint."""
    return running(df, keys, order, slices, None, name, total, source)


def blocked(df: DataFrame, back: int = 0, ahead: int = 0, rows: int = BLOCK_ROWS) -> DataFrame:
    """Cut placed rows into blocks of ``rows`` positions and copy the rows near a cut.

    Adds ``_block``; a row outside its own block is a copy that only feeds frames.
    """
    rows = max(rows, back, ahead)
    at, inside = _block_of(rows), (F.col(POS) - 1) % rows
    homes = [at]
    if back:
        homes.append(F.when(inside >= rows - back, at + 1))
    if ahead:
        homes.append(F.when((inside < ahead) & (at > 0), at - 1))
    return df.select("*", F.explode(F.array_compact(F.array(*homes))).alias("_block"))


def _block_of(rows: int) -> Column:
    return F.floor((F.col(POS) - 1) / rows)


def rowwise(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence,
    slices: Sequence | None,
    exprs: dict[str, Callable[[WindowSpec], Column]],
    back: int = 0,
    ahead: int = 0,
    rows: int = BLOCK_ROWS,
    keep_pos: bool = False,
    total: str | None = None,
    source: DataFrame | None = None,
) -> DataFrame:
    """Add window columns whose ROWS frames reach ``back`` rows back and ``ahead`` rows ahead.

    Each function gets the ordered window and returns a column over it. One pass serves all of
    them. ``rows`` bounds a task's share of a key. In a chain of calls pass the frame the chain
    began with as ``source``, so that each call adds one narrow pass and not a second copy of
    everything before it. A slice must hold many rows. For keys that are small by nature, a trip with
    its stops say, pass None as ``slices``: a plain window then needs one shuffle and no second pass.
    """
    if slices is None:
        w = Window.partitionBy(*keys)
        ordered = w.orderBy(*order)
        extra = {POS: F.row_number().over(ordered).cast("long")} if keep_pos else {}
        extra |= {total: F.count(F.lit(1)).over(w)} if total else {}
        return df.withColumns({**{name: fn(ordered) for name, fn in exprs.items()}, **extra})
    rows = max(rows, back, ahead)
    cut = blocked(place(df, keys, order, slices, POS, total, source), back, ahead, rows)
    w = Window.partitionBy(*keys, "_block").orderBy(POS)
    out = cut.withColumns({name: fn(w) for name, fn in exprs.items()})
    out = out.where(F.col("_block") == _block_of(rows))
    return out.drop("_block") if keep_pos else out.drop("_block", POS)


def timewise(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    exprs: dict[str, Callable[[WindowSpec], Column]],
    back_seconds: int,
    until_seconds: int = 0,
    slice_seconds: int | None = None,
) -> DataFrame:
    """Add window columns over RANGE frames of time ``[ts - back, ts - until]``.

    Rows whose time is within ``back_seconds`` of the end of a slice are copied to the next one.
    Rows without a time stay and see only each other. One shuffle on (key, slice).
    """
    width = max(slice_seconds or 3600, back_seconds)
    home = F.floor(micros(ts) / (width * 1_000_000))
    reach = F.floor((micros(ts) + back_seconds * 1_000_000) / (width * 1_000_000))
    cut = df.select("*", micros(ts).alias("_us"), home.alias("_home"), F.explode(F.coalesce(F.sequence(home, reach), F.array(home))).alias("_slice"))
    w = (
        Window.partitionBy(*keys, "_slice")
        .orderBy("_us")
        .rangeBetween(-back_seconds * 1_000_000, -until_seconds * 1_000_000)
    )
    out = cut.withColumns({name: fn(w) for name, fn in exprs.items()})
    return out.where(F.col("_slice").eqNullSafe(F.col("_home"))).drop("_home", "_slice", "_us")


def timewise_mean(df: DataFrame, keys: Sequence[str], ts: str, x: str, name: str, back_seconds: int, until_seconds: int = 0) -> DataFrame:
    """Add the mean of ``x`` over times ``[ts - back, ts - until]``, as :func:`timewise` gives it, in time that does not follow the rows
    of a frame.

    Slices are as long as a frame, so a frame is the end of one slice and the start of the next. Each row asks for the sum from the
    frame's first time to the end of that slice, and for the one from the start of the next slice to the frame's last time: both
    are running sums, and nothing is subtracted. Two shuffles on (key, slice). Rows without a time see only each other.
    """
    width = (back_seconds - until_seconds) * 1_000_000 + 1
    us = micros(ts)
    lo, hi = us - back_seconds * 1_000_000, us - until_seconds * 1_000_000

    def start(at):
        return at - F.pmod(at, F.lit(width))

    def half(d, sign, at, part):
        """Sum and count of values between ``at`` and the end of its slice that ``sign`` runs from."""
        value, asked = (
            F.struct(F.lit(ask).alias("ask"), start(t).alias("slice"), (t * sign).alias("order")) for ask, t in ((False, us), (True, at))
        )
        d = d.select("*", F.explode(F.array(value, asked)).alias("_c"))
        # The copy that is only a value leaves the other columns behind.
        d = d.select(*[F.when(F.col("_c.ask"), F.col(k)).alias(k) if k not in (*keys, x) else F.col(k) for k in d.columns if k != "_c"], "_c")
        w = Window.partitionBy(*keys, "_c.slice").orderBy("_c.order").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        v = F.when(~F.col("_c.ask"), F.col(x).cast("double"))
        return d.withColumns({f"_s{part}": F.sum(v).over(w), f"_n{part}": F.count(v).over(w)}).where("_c.ask").drop("_c")

    out = half(half(df, -1, lo, 0), 1, hi, 1)
    two = F.coalesce(start(lo) < start(hi), F.lit(False))  # else the frame is one whole slice
    total = F.coalesce("_s0", F.lit(0.0)) + F.when(two, F.coalesce("_s1", F.lit(0.0))).otherwise(0.0)
    n = F.col("_n0") + F.when(two, F.col("_n1")).otherwise(0)
    return out.withColumn(name, F.when(n > 0, total / n)).drop("_s0", "_n0", "_s1", "_n1")


def known_neighbours(
    df: DataFrame, keys: Sequence[str], order: Sequence, slices: Sequence, cols: Sequence[str]
) -> DataFrame:
    """Position, and per column the nearest non-null before (or at) and after each row.

    Adds ``_pos``, ``_p_<col>`` and ``_n_<col>`` as struct(pos, val), null where there is none.
    The gap may be of any length: of each slice only its row count and its first and last known
    values travel to the other slices. Rows are shuffled once, on (key, slice).
    """
    marked = df.withColumn("_span", _span(keys, slices))
    w = Window.partitionBy("_span").orderBy(*order)

    def known(x, at):
        return F.when(F.col(x).isNotNull(), F.struct(F.col(at).alias("pos"), F.col(x).alias("val")))

    local = marked.withColumn("_at", F.row_number().over(w).cast("long"))
    edge = local.groupBy("_span").agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.max(known(x, "_at")).alias(f"_last_{x}") for x in cols],
        *[F.min(known(x, "_at")).alias(f"_first_{x}") for x in cols],
    )
    over_key = Window.partitionBy(*[F.col(f"_span.k{i}") for i in range(len(keys))]).orderBy("_span")
    before = over_key.rowsBetween(Window.unboundedPreceding, -1)
    after = over_key.rowsBetween(1, Window.unboundedFollowing)
    edge = edge.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))

    def shifted(c):
        v = F.col(c)
        return F.when(v.isNotNull(), F.struct((v["pos"] + F.col("_before")).alias("pos"), v["val"].alias("val")))

    edge = edge.withColumns({f"_{e}_{x}": shifted(f"_{e}_{x}") for e in ("last", "first") for x in cols})
    edge = edge.select(
        "_span", "_before",
        *[F.last(f"_last_{x}", True).over(before).alias(f"_pin_{x}") for x in cols],
        *[F.first(f"_first_{x}", True).over(after).alias(f"_nin_{x}") for x in cols],
    )
    up, down = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    here = {f"_pk_{x}": F.last(known(x, "_at"), True).over(up) for x in cols}
    here |= {f"_nk_{x}": F.first(known(x, "_at"), True).over(down) for x in cols}
    near = {POS: F.col("_at") + F.col("_before")}
    for x in cols:
        near[f"_p_{x}"] = F.coalesce(shifted(f"_pk_{x}"), f"_pin_{x}")
        near[f"_n_{x}"] = F.coalesce(shifted(f"_nk_{x}"), f"_nin_{x}")
    out = local.withColumns(here).join(edge, "_span").withColumns(near)
    drop = [f"_{p}_{x}" for p in ("pk", "nk", "pin", "nin") for x in cols]
    return out.drop("_span", "_at", "_before", *drop)
