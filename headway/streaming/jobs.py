"""Continuous forms of the batch rules as Structured Streaming queries.

Every function builds a query that starts on demand: it returns a started ``StreamingQuery`` when
called with a sink and a checkpoint below the shared folder. Triggers default to ``availableNow``,
which drains what is there and stops; pass ``trigger={"processingTime": "2 minutes"}`` to keep on.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor

from headway.operators.windows import latest_per
from headway.sinks.tables import current, insert_new, upsert

ONCE = {"availableNow": True}


def event_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files: int | None = None) -> DataFrame:
    """Files of a folder as a stream with an explicit schema."""
    r = spark.readStream.schema(schema).format(fmt)
    if files:
        r = r.option("maxFilesPerTrigger", files)
    return r.load(path)


def instant(df: DataFrame, ts: str) -> DataFrame:
    """Event time as an instant, as watermarks need it."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def to_parquet(df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    return (
        df.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or ONCE)).start()
    )


def each_batch(df: DataFrame, fn: Callable, checkpoint: str, mode: str = "update", trigger: dict | None = None):
    return (
        df.writeStream.foreachBatch(fn).outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or ONCE)).start()
    )


def append_snapshots(stream: DataFrame, path: str, checkpoint: str, trigger=None):
    """New snapshot files to the table, each exactly once."""
    return to_parquet(stream, path, checkpoint, trigger)


#: State that keeps one row a key on disk and checkpoints its changes; needed by stateful processors and their timers.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Settings of the session while a query is started (it takes its own copy)."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class _Latest(StatefulProcessor):
    """Passes a row on when it is the latest of its key, and a mark when the key's row has grown too old.

    A key's state is the order of its latest row, three numbers or texts for a row of any width.
    """

    def __init__(self, n_keys: int, columns: Sequence[str], state: T.StructType):
        self.n_keys, self.columns, self.schema = n_keys, columns, state
        self.order = range(len(columns), len(columns) + len(state))

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", self.schema)

    @staticmethod
    def rank(values) -> tuple:
        return tuple((x is not None, x) for x in values)

    def handleInputRows(self, key, rows, timerValues):
        best = max(rows, key=lambda r: self.rank(r[i] for i in self.order))
        new = tuple(best[i] for i in self.order)
        old = self.last.get() if self.last.exists() else None
        if old is not None and self.rank(old) >= self.rank(new):
            return
        if old is not None:
            self.handle.deleteTimer(old[0] // 1000 + 1)
        self.last.update(new)
        self.handle.registerTimer(new[0] // 1000 + 1)
        yield Row(**dict(zip(self.columns, best)), _gone=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.last.clear()
        yield Row(**dict.fromkeys(self.columns) | dict(zip(self.columns, key)), _gone=True)


def latest_updates(
    stream: DataFrame, keys: Sequence[str], order: Sequence[str], root: str, checkpoint: str, ts: str, horizon: str, trigger=None
):
    """Latest row per key among the rows of the last ``horizon`` before the newest; read it with :func:`live`.

    The state is keyed and holds live keys only: a timer in event time clears a key once its row is older than the
    horizon, and rows that come later than that are dropped. Only rows that change reach the sink, keyed parts of a table
    (see :func:`headway.sinks.tables.upsert`), so that a batch costs what it changes, not what is stored. Rows
    without a time are left out. Of a key's rows the last by (``ts``, ``order``) counts, nulls first; ``order`` makes that unique.
    """
    columns = [*keys, *[x for x in stream.columns if x not in keys]]
    ranked = [ts, *[x for x in order if x != ts]]
    kinds = dict(stream.dtypes)

    def plain(x):
        return F.unix_micros(F.col(x).cast("timestamp")) if kinds[x].startswith("timestamp") else F.col(x)

    d = stream.where(F.col(ts).isNotNull()).select(*columns, *[plain(x).alias(f"_o{i}") for i, x in enumerate(ranked)], F.col(ts).cast("timestamp").alias("_time"))
    d = d.withWatermark("_time", horizon)
    state = T.StructType([d.schema[f"_o{i}"] for i in range(len(ranked))])
    out = T.StructType([T.StructField(x, d.schema[x].dataType) for x in columns] + [T.StructField("_gone", T.BooleanType())])
    step = _Latest(len(keys), columns, state)
    changed = d.groupBy(*keys).transformWithState(step, out, "Update", "EventTime")

    def run(batch: DataFrame, batch_id: int) -> None:
        upsert(batch, root, keys, (checkpoint, batch_id))

    with settings(stream.sparkSession, STATE):
        return each_batch(changed, run, checkpoint, "update", trigger)


def live(spark: SparkSession, root: str, ts: str, horizon: str) -> DataFrame | None:
    """The table of :func:`latest_updates`: rows of the last ``horizon`` before its newest."""
    have = current(spark, root)
    if have is None:
        return None
    n, unit = horizon.split()
    rows = have.where(~F.col("_gone")).drop("_gone")
    newest = rows.agg(F.max(ts)).scalar()
    return rows.where(F.col(ts) >= newest - F.expr(f"INTERVAL '{int(n)}' {unit.rstrip('s').upper()}"))


def new_dimension_rows(stream: DataFrame, keys: Sequence[str], ts: str, path: str, checkpoint: str, trigger=None):
    """Rows whose key the table does not hold yet, one for each key, however late or often it comes.

    Of the rows of a key in one micro-batch the earliest is stored. A replayed batch finds its keys
    stored and adds nothing.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        insert_new(latest_per(batch, keys, [F.col(ts).asc_nulls_last(), *[F.col(x) for x in batch.columns if x != ts]]), path, keys)

    return each_batch(stream, run, checkpoint, "append", trigger)


def hourly_buckets(stream: DataFrame, keys: Sequence[str], ts: str, x: str, watermark="10 minutes") -> DataFrame:
    """Mean and count per key and closed clock hour."""
    return (
        instant(stream, ts).withWatermark(ts, watermark).groupBy(F.window(ts, "1 hour").alias("w"), *keys)
        .agg(F.avg(x).alias("mean"), F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").cast("timestamp_ntz").alias("time_bucket"), *keys, "mean", "n")
    )


def sliding_trend(stream: DataFrame, keys: Sequence[str], ts: str, x: str, length="60 minutes", step="10 minutes", watermark="10 minutes") -> DataFrame:
    """Mean over the past hour every ten minutes: the window form of the per-row trend."""
    return (
        instant(stream, ts).withWatermark(ts, watermark).groupBy(F.window(ts, length, step).alias("w"), *keys)
        .agg(F.avg(x).alias("trend"), F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), *keys, "trend", "n")
    )


def live_regions(stream: DataFrame, region: str, ts: str, x: str, root: str, checkpoint: str, length="2 hours", step="30 minutes", watermark="10 minutes", trigger=None):
    """Sliding region status, each window kept up to date in a table by (window, region)."""
    d = (
        instant(stream, ts).withWatermark(ts, watermark).groupBy(F.window(ts, length, step).alias("w"), region)
        .agg(F.avg(x).alias("avg_delay_seconds"), F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").cast("timestamp_ntz").alias("start"), region, "avg_delay_seconds", "n")
    )

    def run(batch: DataFrame, batch_id: int) -> None:
        upsert(batch, root, ["start", region], (checkpoint, batch_id))

    return each_batch(d, run, checkpoint, "update", trigger)


def closed_hours(stream: DataFrame, ts: str, cols: Sequence[str], watermark="0 seconds") -> DataFrame:
    """Hourly means of hours the watermark has closed; a partial last hour never appears."""
    return (
        instant(stream, ts).withWatermark(ts, watermark).groupBy(F.window(ts, "1 hour").alias("w"))
        .agg(*[F.avg(x).alias(x) for x in cols], F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").cast("timestamp_ntz").alias("hour"), *cols, "n")
    )
