"""Schedules, weather, station observations, regions and stored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from headway.functions.clock import c, parse_service_date, split_extended_time
from headway.functions.geo import region_slug, region_type, rings_from_geojson
from headway.sources.schemas import (
    CLOCK_COLUMNS, DATE_COLUMNS, REQUIRED, SCHEDULE, WEATHER, WEATHER_NUMBERS,
)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or glob) exists on whatever file system it names."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(hadoop)
    return found is not None and len(found) > 0


def type_schedule(name: str, df: DataFrame) -> DataFrame:
    """Dates and clock times of a raw schedule table parsed, the rest cast to its type.

    A column that the file lacks becomes null; unknown columns are dropped.
    """
    dates, clocks = DATE_COLUMNS.get(name, ()), CLOCK_COLUMNS.get(name, ())
    out = []
    for part in SCHEDULE[name].split(", "):
        x, kind = part.split(" ", 1)
        v = F.col(x) if x in df.columns else F.lit(None)
        if x in dates:
            out.append(parse_service_date(v).alias(x))
        elif x.removesuffix("_time") in clocks and x.endswith("_time"):
            at = split_extended_time(v)
            base = x.removesuffix("_time")
            out += [at["tod"].alias(f"{base}_secs"), at["day_offset"].alias(f"{base}_day_offset")]
        else:
            out.append(v.cast("string").try_cast(kind).alias(x))
    return df.select(*out)


def read_schedule(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The schedule tables of a folder of ``<name>.txt`` CSV files.

    The five required tables must be there; optional ones are left out when missing. Columns are
    taken by header name, in whatever order the file has them.
    """
    out = {}
    for name in SCHEDULE:
        path = f"{folder.rstrip('/')}/{name}.txt"
        if exists(spark, path):
            raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
            out[name] = type_schedule(name, raw)
        elif name in REQUIRED:
            raise FileNotFoundError(path)
    return out


def type_weather(df: DataFrame) -> DataFrame:
    """Local time without its zone suffix, text to numbers, anything unreadable to null."""
    local = F.regexp_replace("date_time_local", " P[DS]T", "")
    stamp = F.try_to_timestamp(local).cast("timestamp_ntz")
    cols = []
    for x in df.columns:
        if x == "date_time_local":
            cols.append(stamp.alias(x))
        elif x == "unixtime":
            cols.append(F.col(x).cast("string").try_cast("bigint").alias(x))
        elif x in WEATHER_NUMBERS:
            number = F.trim(F.col(x)).try_cast("double")
            cols.append(number.try_cast(WEATHER_NUMBERS[x]).alias(x))
        else:
            cols.append(F.col(x))
    return df.select(*cols)


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    return type_weather(spark.read.option("header", True).csv(path))


STATION_OBS = (
    "type string, features array<struct<type:string,id:string,"
    "geometry:struct<type:string,coordinates:array<double>>,properties:map<string,string>>>"
)


def read_station_obs(spark: SparkSession, path: str) -> DataFrame:
    """One row per feature of GeoJSON collections: coordinates and a property map."""
    docs = spark.read.schema(STATION_OBS).option("multiLine", True).json(path)
    return flatten_features(docs)


def flatten_features(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode("features").alias("f")).select(
        F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties")
    )


def station_columns(obs: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Chosen properties as typed columns: ``{property: type}``."""
    return obs.select(
        "coordinates",
        *[F.try_element_at("properties", F.lit(p)).try_cast(t).alias(p.replace("-", "_")) for p, t in cols.items()],
    )


def read_all(spark: SparkSession, folder: str, fmt: str = "parquet", text: Sequence[str] = ("start_date",)) -> DataFrame:
    """All files of a folder as one frame; columns of any file appear, the named ones as text."""
    reader = spark.read.option("mergeSchema", True) if fmt == "parquet" else spark.read.option("header", True)
    df = reader.format(fmt).load(folder)
    for x in text:
        if x in df.columns:
            df = df.withColumn(x, F.col(x).cast("string"))
    return df


def match_regions(names: DataFrame, shapes: DataFrame, index: str = "idx") -> DataFrame:
    """Names and shapes of the same row number as regions, the counts having to agree."""
    a, b = names.count(), shapes.count()
    if a != b:
        raise ValueError(f"{a} names but {b} shapes")
    return describe_regions(names.join(shapes, index).drop(index))


def describe_regions(df: DataFrame, name: str = "region_name") -> DataFrame:
    """Ids and types from region names.

    Two names with the same id (a city and its district) get the type appended, so none is lost.
    """
    out = df.withColumn("_slug", region_slug(name)).withColumn("region_type", region_type(name))
    shared = out.groupBy("_slug").agg(F.count(F.lit(1)).alias("_n"))
    full = F.when(F.col("_n") > 1, F.concat_ws("_", "_slug", "region_type")).otherwise(F.col("_slug"))
    return out.join(shared, "_slug").withColumn("region_id", full).drop("_slug", "_n")


def read_regions(spark: SparkSession, csv: str, geojson: str, name_col: str = "name", centre=("lat", "lon")) -> DataFrame:
    """Region names and centres (CSV) with polygons (GeoJSON), matched by position.

    Both files are small single documents; the row number of the CSV is its line order.
    """
    raw = spark.read.option("header", True).csv(csv)
    lines = raw.select(F.monotonically_increasing_id().alias("_at"), "*")
    from pyspark.sql import Window

    names = lines.select(
        (F.row_number().over(Window.orderBy("_at")) - 1).alias("idx"),
        F.col(name_col).alias("region_name"),
        F.col(centre[0]).try_cast("double").alias("center_lat"), F.col(centre[1]).try_cast("double").alias("center_lon"),
    )
    doc = spark.read.option("wholetext", True).text(geojson)
    parts = F.from_json(F.get_json_object("value", "$.features"), "array<string>")
    shapes = doc.select(F.posexplode(parts).alias("idx", "f")).select(
        "idx", rings_from_geojson(F.get_json_object("f", "$.geometry")).alias("rings")
    )
    return match_regions(names, shapes)


def scan(
    source: SparkSession, name: str, route_ids=None, start_date=None, end_date=None,
    columns: Sequence[str] | None = None, route="route_id", date="start_date", fmt: str | None = None,
    parse_dates: Sequence[str] = (), date_format: str | None = None, zone: str | None = None, **options,
) -> DataFrame:
    """A stored table or path with route, date and column selection pushed to the scan.

    Columns of ``parse_dates`` become timestamps, null where their text is none; with ``zone`` they are
    taken as UTC and given in that zone's local time. Both happen after the selection, on the result.
    """
    from headway.operators.filters import route_since

    if fmt:
        df = source.read.format(fmt).options(**options).load(name)
    elif "/" in name:
        df = source.read.parquet(name)
    else:
        df = source.table(name)
    df = route_since(df, route_ids, start_date, end_date, route, date)
    df = df.select(*columns) if columns else df

    def parsed(x):
        v = F.col(x).cast("string")
        at = F.try_to_timestamp(v, F.lit(date_format)) if date_format else v.try_cast("timestamp_ntz")
        at = at.cast("timestamp_ntz")
        return F.convert_timezone(F.lit("UTC"), F.lit(zone), at) if zone else at

    return df.withColumns({x: parsed(x) for x in parse_dates if x in df.columns})
