"""Writing and maintaining stored tables.

A table is a folder of Parquet files, or of numbered versions of it when rows are replaced. The last
versions stay, so a lost executor or a failed job never leaves a half-written table behind.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from headway.functions.clock import epoch
from headway.functions.numbers import row_id
from headway.operators.joins import new_rows
from headway.sinks import keyed
from headway.sources.readers import exists


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if exists(spark, path) else None


def insert_new(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Append the rows whose key the table does not hold; running it twice adds nothing."""
    have = stored(df.sparkSession, path)
    fresh = new_rows(df, have if have is not None else df.limit(0), keys)
    append(fresh, path)


def upsert_dimension(df: DataFrame, path: str, natural_keys: Sequence[str], id_col: str, defaults: dict | None = None) -> None:
    """Get-or-create of dimension rows; the first writer of a natural key wins."""
    rows = df.na.fill(defaults) if defaults else df
    insert_new(rows.withColumn(id_col, row_id(*natural_keys)), path, natural_keys)


def merge_rows(target: DataFrame, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target with the rows of ``df`` put in place of rows with the same key."""
    return target.join(df.select(*keys), list(keys), "left_anti").unionByName(df)


#: Whole versions kept for readers of older ones.
KEEP = 3


def _glob(spark: SparkSession, pattern: str) -> list:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return [s.getPath() for s in hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop) or []]


def _versions(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(p.getParent().getName().split("=")[1]) for p in _glob(spark, f"{root}/v=*/_SUCCESS"))


def _retire(spark: SparkSession, root: str) -> None:
    """Remove all whole versions but the last few."""
    for v in _versions(spark, root)[:-KEEP]:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/v={v}")
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """The frame written once to the shared folder and read back.

    For frames that several later steps read: their lineage ends here, lost tasks read the files
    again, and columns are pruned at the scan.
    """
    from headway.session import scratch_path

    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def current(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest complete state of a versioned table."""
    whole, parts = (_versions(spark, root) or [0])[-1], keyed.newest(spark, root)
    if parts and parts["n"] > whole:
        return keyed.read(spark, root, parts)
    return spark.read.parquet(f"{root}/v={whole}") if whole else None


def write_version(df: DataFrame, root: str) -> int:
    """The whole table as a new version; older versions go, but for the last few."""
    spark = df.sparkSession
    n = max((_versions(spark, root) or [0])[-1], (keyed.newest(spark, root) or {"n": 0})["n"]) + 1
    df.write.mode("overwrite").parquet(f"{root}/v={n}")
    _retire(spark, root)
    return n


def upsert(df: DataFrame, root: str, keys: Sequence[str], batch: tuple[str, int] | None = None) -> int:
    """Insert or replace by key; returns the version's number.

    The rows are written as a change; parts of the table take their changes in once those make up a
    quarter of them (:mod:`headway.sinks.keyed`). ``batch`` names the writer and numbers its batches: a number that the
    table has seen adds nothing. Keys are unique in ``df`` and keep their types.
    """
    spark = df.sparkSession
    whole = (_versions(spark, root) or [0])[-1]
    return keyed.upsert(df, root, keys, whole, batch)


def append_new_timestamps(df: DataFrame, path: str, ts: str) -> None:
    insert_new(df, path, [ts])


def missing_hours(target: DataFrame, as_of: str, unixtime: str = "unixtime", default: int = 48) -> DataFrame:
    """Rows to fetch: hours between the stored maximum and the last complete hour plus five.

    At least 1, at most 1000; ``default`` for an empty table.
    """
    at = F.date_trunc("hour", F.lit(as_of).cast("timestamp")).cast("timestamp_ntz")
    gap = F.floor((epoch(at) - 3600 - (F.max(unixtime) + 3600)) / 3600)
    want = F.when(F.max(unixtime).isNull(), default).when(epoch(at) - 7200 - F.max(unixtime) <= 0, 1).otherwise(gap + 5)
    return target.agg(F.least(F.greatest(want, F.lit(1)), F.lit(1000)).cast("int").alias("rows"))


def complete_hours_only(df: DataFrame, as_of: str, unixtime: str = "unixtime") -> DataFrame:
    at = F.date_trunc("hour", F.lit(as_of).cast("timestamp")).cast("timestamp_ntz")
    return df.where(F.col(unixtime) <= epoch(at) - 3600)


def write_with_metadata(df: DataFrame, path: str, meta: dict | None = None, fmt: str = "csv") -> None:
    """Data, and beside it one JSON row with row count, columns, types and extra facts.

    The count is taken from the written files, so the frame is computed once.
    """
    writer = df.write.mode("overwrite")
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path))
    spark = df.sparkSession
    back = spark.read.option("header", True).csv(path) if fmt == "csv" else spark.read.parquet(path)
    facts = back.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).alias("n_columns"),
        F.array(*[F.lit(x) for x in df.columns]).alias("columns"),
        F.array(*[F.lit(t) for _, t in df.dtypes]).alias("dtypes"),
        *[F.lit(v).alias(k) for k, v in (meta or {}).items()],
    )
    facts.coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}_metadata")


def write_feature_store(df: DataFrame, path: str, partition_by: str = "start_date") -> None:
    """Snappy Parquet by service date.

    Rows are gathered by date, and Spark splits a busy date into as many writers as its size asks for.
    """
    spread = df.hint("rebalance", partition_by)
    spread.write.mode("overwrite").option("compression", "snappy").partitionBy(partition_by).parquet(path)


def write_splits(df: DataFrame, path: str, split: str = "split", date: str = "start_date") -> None:
    """One table partitioned by split, and the split facts as JSON beside it."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)
    back = df.sparkSession.read.parquet(path)
    facts = back.groupBy(split).agg(
        F.count(F.lit(1)).alias("samples"), F.min(date).alias("first_date"), F.max(date).alias("last_date")
    )
    facts.coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}_info")


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_eval(metrics: DataFrame, path: str, model: str, config: str = "") -> None:
    append(metrics.withColumn("model_name", F.lit(model)).withColumn("config", F.lit(config)), path)


def compare_models(spark: SparkSession, path: str) -> DataFrame:
    """Stored evaluations, best first."""
    return spark.read.parquet(path).orderBy("mae", "model_name")


LOG = "view_name string, last_refresh_time timestamp_ntz, refresh_duration_seconds double, rows_affected bigint, status string, error_message string"


def refresh(spark: SparkSession, name: str, builder: Callable[[], DataFrame], root: str, log_path: str) -> str:
    """Materialize a view into a new version and append time, rows and status to the log."""
    began = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    rows, status, error = None, "success", None
    try:
        n = write_version(builder(), f"{root}/{name}")
        rows = spark.read.parquet(f"{root}/{name}/v={n}").count()
    except Exception as e:  # a failed refresh is a log row, not a crash of the caller
        status, error = "failed", str(e)
    took = (dt.datetime.now(dt.timezone.utc).replace(tzinfo=None) - began).total_seconds()
    append(spark.createDataFrame([(name, began, took, rows, status, error)], LOG), log_path)
    return status


def refresh_groups(
    source: DataFrame, root: str, keys: Sequence[str], ts: str, sums: Sequence[str] = (), least: Sequence[str] = (), most: Sequence[str] = ()
) -> int:
    """Bring a grouped table up to date with the rows that came after its last refresh; returns how many they were.

    The table holds, for each key, mergeable parts: ``n`` rows, ``sum_`` and ``n_`` (values that are not null) of ``sums``, ``min_`` of
    ``least`` and ``max_`` of ``most``; :func:`grouped` turns sums to means. Its state keeps the highest ``ts`` taken in. A refresh
    reads the source's rows above that mark (a predicate that reaches the scan) and the groups they touch, and writes those groups. ``ts``
    is the time of arrival: a row that comes with a time at or below the mark, or none, is not seen.
    """
    spark = source.sparkSession
    m = keyed.newest(spark, root)
    mark = m["seen"].get("mark") if m else None
    rows = source.where(F.col(ts).isNotNull())
    zone_free = dict(source.dtypes)[ts] != "timestamp"
    if mark is not None:
        at = F.timestamp_micros(F.lit(mark))
        rows = rows.where(F.col(ts) > (at.cast("timestamp_ntz") if zone_free else at))
    reach = F.unix_micros(F.max(F.col(ts)).cast("timestamp")).alias("_reach")
    parts = [F.count(F.lit(1)).alias("n")]
    parts += [f(x).alias(f"{p}_{x}") for xs, fs in ((sums, ((F.sum, "sum"), (F.count, "n"))), (least, ((F.min, "min"),)), (most, ((F.max, "max"),))) for x in xs for f, p in fs]
    fresh = stage(rows.groupBy(*keys).agg(*parts, reach), "refresh")
    new = fresh.agg(F.max("_reach"), F.sum("n")).first()
    if new[0] is None:
        return 0
    fresh = fresh.drop("_reach")
    if m:
        both = keyed.lookup(spark, root, m, fresh).unionByName(fresh)
        fold = {"min": F.min, "max": F.max}
        merged = both.groupBy(*keys).agg(*[fold.get(x.split("_")[0], F.sum)(x).alias(x) for x in fresh.columns if x not in keys])
        fresh = stage(merged, "refreshed")
    upsert(fresh, root, keys, ("mark", new[0]))
    return new[1]


def grouped(spark: SparkSession, root: str) -> DataFrame | None:
    """The table of :func:`refresh_groups` with means in place of sums."""
    d = current(spark, root)
    if d is None:
        return None
    means = {x[4:]: F.try_divide(F.col(x), F.col(f"n_{x[4:]}")) for x in d.columns if x.startswith("sum_")}
    return d.withColumns({f"mean_{k}": v for k, v in means.items()}).drop(*[f"{p}_{k}" for k in means for p in ("sum", "n")])


def refresh_status(log: DataFrame, as_of: str) -> DataFrame:
    """Latest log row per view with its age in minutes (one digit)."""
    last = log.groupBy("view_name").agg(
        F.max(F.struct("last_refresh_time", "status", "rows_affected")).alias("r")
    ).select("view_name", "r.*")
    age = (epoch(F.lit(as_of).cast("timestamp_ntz")) - epoch("last_refresh_time")) / 60
    return last.withColumn("minutes_since_refresh", F.round(age, 1))


def table_stats(df: DataFrame, route: str = "route_id", date: str = "start_date") -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct(route).alias("unique_routes"),
        F.count_distinct(date).alias("unique_dates"), F.min(date).alias("earliest_date"), F.max(date).alias("latest_date"),
    )


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table as one frame."""
    from headway.operators.sets import union_all

    return union_all(
        [t.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n, t in tables.items()]
    )


def monitor_counts(df: DataFrame, ts: str, as_of: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows of the last hour and the last 24 hours, per key."""
    at = F.lit(as_of).cast("timestamp_ntz")
    seen = df.where((F.col(ts) > at - F.expr("INTERVAL '24' HOUR")) & (F.col(ts) <= at))
    return seen.groupBy(*keys).agg(
        F.count_if(F.col(ts) > at - F.expr("INTERVAL '1' HOUR")).alias("last_hour"), F.count(F.lit(1)).alias("last_day"),
        F.max(ts).alias("latest"),
    )


def stops_geojson(stops: DataFrame) -> DataFrame:
    """One GeoJSON feature per stop as text; write it with ``write.text``."""
    shape = F.struct(
        F.lit("Point").alias("type"),
        F.array(F.col("stop_lon").cast("double"), F.col("stop_lat").cast("double")).alias("coordinates"),
    )
    props = F.struct("stop_id", "stop_name", "trip_headsigns", "route_names")
    return stops.select(
        "stop_id",
        F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), props.alias("properties"))).alias("feature"),
    )
