"""Registry, table bindings and the SQL that states the same bindings.

``obs`` reads events as observations, ``upd`` lineitem as stop-time updates, ``trips`` orders as
trips, ``stops`` suppliers and ``cstops`` customers as stops, ``tiles`` nations as 5 x 5 regions,
``wx`` hourly means of events as weather, ``services`` nations as weekly service patterns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from headway.functions.clock import epoch, hour_start, isodow
from headway.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CTES = {
    "obs": """SELECT event_id AS obs_id, ts, event_type AS route_id, CAST(user_id % 2 AS INTEGER) AS direction_id,
        user_id AS stop_id, (value - 50) * 20 AS delay, CASE WHEN value >= 10 THEN (value - 50) * 20 END AS gappy,
        CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(hour(ts) AS INTEGER) AS hour_of_day,
        CAST(isodow(ts) AS INTEGER) AS isodow FROM events""",
    "upd": """SELECT l_orderkey AS trip_id, l_linenumber AS stop_sequence, l_suppkey AS stop_id, l_partkey AS part_id,
        l_shipdate AS feed_time, (l_quantity - 25) * 20 AS delay,
        (l_quantity - 25) * 20 + (l_discount - 0.05) * 4000 AS pred, l_extendedprice AS price,
        l_returnflag AS flag, l_linestatus AS status FROM lineitem""",
    "trips": """SELECT o_orderkey AS trip_id, o_custkey AS route_id, CAST(o_orderdate AS DATE) AS start_date,
        o_orderpriority AS headsign, CAST(o_orderkey % 2 AS INTEGER) AS direction_id,
        CAST(o_custkey % 25 AS INTEGER) AS service_id FROM orders""",
    "stops": """SELECT s_suppkey AS stop_id, s_name AS stop_name, 49e0 + (s_suppkey * 37 % 100) / 250e0 AS stop_lat,
        -123.4e0 + (s_suppkey * 61 % 100) / 160e0 AS stop_lon FROM supplier""",
    "cstops": """SELECT c_custkey AS stop_id, c_name AS stop_name, 49e0 + (c_custkey * 37 % 1000) / 2500e0 AS stop_lat,
        -123.4e0 + (c_custkey * 61 % 1000) / 1600e0 AS stop_lon FROM customer""",
    "tiles": """SELECT n_name AS region_id, n_name AS region_name, -123.4e0 + (n_nationkey % 5) * 0.125e0 AS xmin,
        49e0 + (n_nationkey // 5) * 0.08e0 AS ymin, -123.4e0 + (n_nationkey % 5) * 0.125e0 + 0.125e0 AS xmax,
        49e0 + (n_nationkey // 5) * 0.08e0 + 0.08e0 AS ymax FROM nation""",
    "wx": """SELECT date_trunc('hour', ts) AS hour, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS unixtime,
        round(avg(value) / 5 + 1e-9, 4) AS temperature, round(min(value) / 10 + 1e-9, 4) AS dew_point,
        CASE WHEN max(value) < 250 THEN round(max(value) + 1e-9, 4) END AS visibility, CAST(count(*) % 9 AS DOUBLE) AS cloud,
        round(avg(value) * 1.5 + 1e-9, 4) AS humidity FROM events GROUP BY ALL""",
    "services": """SELECT n_nationkey AS service_id, CAST(n_nationkey & 1 AS INTEGER) AS monday,
        CAST((n_nationkey >> 1) & 1 AS INTEGER) AS tuesday, CAST((n_nationkey >> 2) & 1 AS INTEGER) AS wednesday,
        CAST((n_nationkey >> 3) & 1 AS INTEGER) AS thursday, CAST((n_nationkey >> 4) & 1 AS INTEGER) AS friday,
        CAST(n_nationkey & 1 AS INTEGER) AS saturday, CAST((n_nationkey >> 1) & 1 AS INTEGER) AS sunday,
        DATE '2001-01-01' + CAST(n_nationkey AS INTEGER) AS start_date,
        DATE '2001-03-01' + CAST(n_nationkey AS INTEGER) AS end_date FROM nation""",
    "exceptions": """SELECT CAST(o_custkey % 25 AS INTEGER) AS service_id, CAST(o_orderdate AS DATE) AS date,
        min(CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END) AS exception_type
        FROM orders GROUP BY 1, 2""",
}


def with_ctes(names: str, body: str) -> str:
    parts = [f"{n} AS ({CTES[n]})" for n in names.split()]
    word, body = ("WITH RECURSIVE ", body.removeprefix("RECURSIVE")) if body.startswith("RECURSIVE") else ("WITH ", body)
    return (word + ",\n".join(parts) + "\n" if parts else "") + body


def query(name: str, ctes: str = "", sql: str | None = None):
    """Register a query; ``sql`` states it for the comparison, on top of the named bindings."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(prepare(spark), sf_dir))

        run.__name__ = name
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_ctes(ctes, sql)
        return fn

    return wrap


def r6(x) -> Column:
    """Six digits, moved off exact ties."""
    return F.round((F.col(x) if isinstance(x, str) else x) + F.lit(1e-9), 6)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({x: r6(x) for x in cols})


class Tables:
    """The given tables and their bindings as frames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def obs(self) -> DataFrame:
        d = (F.col("value") - 50) * 20
        return self.raw("events").select(
            F.col("event_id").alias("obs_id"), "ts", F.col("event_type").alias("route_id"),
            (F.col("user_id") % 2).cast("int").alias("direction_id"), F.col("user_id").alias("stop_id"), d.alias("delay"),
            F.when(F.col("value") >= 10, d).alias("gappy"), F.get_json_object("props", "$.k").cast("int").alias("k"),
            F.hour("ts").alias("hour_of_day"), isodow("ts").alias("isodow"),
        )

    @property
    def upd(self) -> DataFrame:
        d = (F.col("l_quantity") - 25) * 20
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("trip_id"), F.col("l_linenumber").alias("stop_sequence"), F.col("l_suppkey").alias("stop_id"),
            F.col("l_partkey").alias("part_id"), F.col("l_shipdate").alias("feed_time"), d.alias("delay"),
            (d + (F.col("l_discount") - 0.05) * 4000).alias("pred"), F.col("l_extendedprice").alias("price"),
            F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
        )

    @property
    def trips(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("trip_id"), F.col("o_custkey").alias("route_id"), F.col("o_orderdate").cast("date").alias("start_date"),
            F.col("o_orderpriority").alias("headsign"), (F.col("o_orderkey") % 2).cast("int").alias("direction_id"),
            (F.col("o_custkey") % 25).cast("int").alias("service_id"),
        )

    def _stops(self, table, key, name, scale):
        k = F.col(key)
        return self.raw(table).select(
            k.alias("stop_id"), F.col(name).alias("stop_name"),
            (F.lit(49.0) + (k * 37 % (100 * scale)) / F.lit(250.0 * scale)).alias("stop_lat"),
            (F.lit(-123.4) + (k * 61 % (100 * scale)) / F.lit(160.0 * scale)).alias("stop_lon"),
        )

    @property
    def stops(self) -> DataFrame:
        return self._stops("supplier", "s_suppkey", "s_name", 1)

    @property
    def cstops(self) -> DataFrame:
        return self._stops("customer", "c_custkey", "c_name", 10)

    @property
    def tiles(self) -> DataFrame:
        n = F.col("n_nationkey")
        x, y = F.lit(-123.4) + (n % 5) * F.lit(0.125), F.lit(49.0) + F.floor(n / 5) * F.lit(0.08)
        t = self.raw("nation").select(F.col("n_name").alias("region_id"), F.col("n_name").alias("region_name"), F.lit("city").alias("region_type"), x.alias("x"), y.alias("y"))

        def corner(dx, dy):
            return F.struct((F.col("x") + F.lit(dx)).alias("x"), (F.col("y") + F.lit(dy)).alias("y"))

        ring = F.array(corner(0.0, 0.0), corner(0.125, 0.0), corner(0.125, 0.08), corner(0.0, 0.08))
        return t.select("region_id", "region_name", "region_type", F.array(ring).alias("rings"))

    @property
    def wx(self) -> DataFrame:
        v = F.col("value")
        return self.raw("events").groupBy(hour_start("ts").alias("hour")).agg(
            F.round(F.avg(v) / 5 + 1e-9, 4).alias("temperature"), F.round(F.min(v) / 10 + 1e-9, 4).alias("dew_point"),
            F.when(F.max(v) < 250, F.round(F.max(v) + 1e-9, 4)).alias("visibility"),
            (F.count(F.lit(1)) % 9).cast("double").alias("cloud"), F.round(F.avg(v) * 1.5 + 1e-9, 4).alias("humidity"),
        ).select("hour", epoch("hour").alias("unixtime"), "temperature", "dew_point", "visibility", "cloud", "humidity")

    @property
    def services(self) -> DataFrame:
        n = F.col("n_nationkey")

        def bit(i):
            return F.shiftright(n, i).bitwiseAND(F.lit(1)).cast("int")

        days = ("monday", "tuesday", "wednesday", "thursday", "friday")
        return self.raw("nation").select(
            n.alias("service_id"), *[bit(i).alias(d) for i, d in enumerate(days)], bit(0).alias("saturday"), bit(1).alias("sunday"),
            F.date_add(F.lit("2001-01-01").cast("date"), n).alias("start_date"), F.date_add(F.lit("2001-03-01").cast("date"), n).alias("end_date"),
        )

    @property
    def exceptions(self) -> DataFrame:
        kind = F.when(F.col("o_orderstatus") == "F", 2).otherwise(1)
        return (
            self.raw("orders").groupBy((F.col("o_custkey") % 25).cast("int").alias("service_id"), F.col("o_orderdate").cast("date").alias("date"))
            .agg(F.min(kind).alias("exception_type"))
        )
