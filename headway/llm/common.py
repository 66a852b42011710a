"""What the text operators share: column names, batched evaluation of whole texts, hash lookup."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of text that one call of a batch function gets (one longer text comes alone).
CHUNK_BYTES = 4 << 20
#: Rows of a batch sent to Python, so that a batch of long texts stays small.
BATCH_ROWS = 1000
#: JVM and byte-level forms of the two word definitions used by the operators.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def others(df: DataFrame, added: Iterable[str]) -> list[str]:
    """The input columns that stay; an added column replaces an input column of its name (in any case)."""
    new = {x.lower() for x in added}
    return [x for x in df.columns if x.lower() not in new]


def held_out(key: str, folds: int = 5) -> Column:
    """True for rows kept from learning: crc32 of the key as text is divisible by ``folds``; null keys are not."""
    return F.coalesce(F.crc32(col(key).cast("string")) % folds == 0, F.lit(False))


def thinned(df: DataFrame, key: str, want: int, have: Column | int, seed: int) -> DataFrame:
    """Rows whose key hashes below twice the share ``want`` of ``have``: a little more than ``want`` rows.

    Goes before an exact limit, so that tasks send few rows to it however many they read.
    """
    share = F.lit(2.0 * want + 100) / have
    return df.where(F.pmod(F.xxhash64(col(key), F.lit(seed)), F.lit(1 << 30)) < share * (1 << 30))


def annotate(
    df: DataFrame,
    inputs: str | list[str],
    added: str,
    make: Callable[[], Callable[[list], dict]],
    keep: list[str] | None = None,
) -> DataFrame:
    """Add columns that a batch function computes from whole texts.

    ``inputs`` names the input column, or several; the first one is the text, where there is one. ``added`` is the DDL of
    the new columns. ``make`` runs once in each task and returns a function from a list for each
    input (null is None) to {column: values}. ``keep`` names the columns that stay, all by default.
    Narrow: no shuffle. A task holds one batch of rows; texts reach the function in lists of about
    :data:`CHUNK_BYTES`.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    extra = T.StructType.fromDDL(added)
    new = [f.name for f in extra.fields]
    kept = [x for x in others(df, new) if keep is None or x in keep]
    fields = [df.schema[x] for x in kept]
    inputs = [inputs] if isinstance(inputs, str) else inputs
    sent = df.select(*[col(x) for x in kept], *[col(x).alias(f"_sent_{i}") for i, x in enumerate(inputs)])
    schema = T.StructType(fields + list(extra.fields))
    kinds = [to_arrow_schema(T.StructType([f])).field(0).type for f in extra.fields]
    n_kept = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from computed(batches)
        finally:
            give_back()

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            first = batch.column(n_kept)
            size = np.zeros(len(first))
            if pa.types.is_string(first.type) or pa.types.is_binary(first.type):
                size = pc.fill_null(pc.binary_length(first), 0).to_numpy(zero_copy_only=False)
            for a, b in chunks(size, CHUNK_BYTES):
                out = fn(*[batch.column(n_kept + i).slice(a, b - a).to_pylist() for i in range(len(inputs))])
                arrays = [batch.column(i).slice(a, b - a) for i in range(n_kept)]
                arrays += [x if isinstance(x := out[n], pa.Array) else pa.array(x, type=k) for n, k in zip(new, kinds)]
                yield pa.RecordBatch.from_arrays(arrays, names=kept + new)

    return sent.mapInArrow(run, schema)


def give_back() -> None:
    """Return a finished task's memory to the system: Spark keeps its Python process for later tasks and other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library keeps what it has
        ctypes.CDLL(None).malloc_trim(0)


def chunks(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose sizes sum to at most ``limit``, one row at least."""
    start, total = 0, 0
    for i, s in enumerate(sizes.tolist()):
        if i > start and total + s > limit:
            yield start, i
            start, total = i, 0
        total += s
    if len(sizes):
        yield start, len(sizes)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit keys evenly (multiply and fold twice)."""
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


class SortedHashes:
    """Sorted unique 64-bit hashes with a jump table over their leading bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(np.asarray(keys, np.uint64), np.uint64(2**64 - 1))
        n = len(keys)
        self.bits = max(1, int(4 * n).bit_length())
        self.jump = np.searchsorted(self.keys[:n], np.arange(2**self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).astype(np.int32)
        self.n = n

    def find(self, h: np.ndarray) -> np.ndarray:
        """Position of each hash, -1 where it is not stored."""
        at = self.jump[(h >> np.uint64(64 - self.bits)).view(np.int64)]
        seen = self.keys[at]
        out = np.where(seen == h, at, -1).astype(np.int32)
        left = np.flatnonzero(seen < h)
        while len(left):
            at_left = at[left] + 1
            at[left] = at_left
            seen = self.keys[at_left]
            out[left[seen == h[left]]] = at_left[seen == h[left]]
            left = left[seen < h[left]]
        out[out >= self.n] = -1
        return out
