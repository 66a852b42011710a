"""Realtime snapshots: reading, checking and normalizing nested records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from headway.functions.encode import map_codes
from headway.functions.numbers import row_id
from headway.sources.schemas import FEED, SNAPSHOT
from headway.sources.wire import decode_batches

# Codes of the realtime format and their labels.
TRIP_RELATIONSHIP = {0: "SCHEDULED", 1: "ADDED", 2: "UNSCHEDULED", 3: "CANCELED", 5: "REPLACEMENT",
                     6: "DUPLICATED", 7: "DELETED", 8: "NEW"}
STOP_RELATIONSHIP = {0: "SCHEDULED", 1: "SKIPPED", 2: "NO_DATA", 3: "UNSCHEDULED"}
STOP_STATUS = {0: "INCOMING_AT", 1: "STOPPED_AT", 2: "IN_TRANSIT_TO"}
TEXT_TYPES = ("header_text", "description_text", "url", "cause_detail", "effect_detail")

# What a descriptor without a field gets.
NO_TRIP = {"trip_id": "UNKNOWN", "start_date": "20250101", "route_id": "UNKNOWN", "direction_id": 0}
NO_VEHICLE = {"vehicle_id": "UNKNOWN", "label": "UNKNOWN"}


def read_snapshots(spark: SparkSession, path: str, feed_type: str, fmt: str = "protobuf") -> DataFrame:
    """Snapshot files as nested records, one row per file.

    Binary files are decoded inside tasks, each file on its own; JSON files hold one record per
    line. A damaged binary file gives the entities that can be read and says what is wrong in ``error``.
    """
    if fmt == "json":
        df = spark.read.schema(FEED).json(path)
        return df.select(
            F.lit(feed_type).alias("feed_type"), F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_size").alias("file_size"), "header", "entity", F.lit(None).cast("string").alias("error"),
        )
    return decode_files(spark.read.format("binaryFile").load(path), feed_type)


def stream_snapshots(spark: SparkSession, path: str, feed_type: str, files: int | None = None) -> DataFrame:
    """Binary snapshot files of a folder as a stream, each file once; ``files`` bounds those of a batch."""
    r = spark.readStream.schema("path string, modificationTime timestamp, length bigint, content binary").format("binaryFile")
    return decode_files((r.option("maxFilesPerTrigger", files) if files else r).load(path), feed_type)


def decode_files(files: DataFrame, feed_type: str) -> DataFrame:
    """Rows (path, length, content) decoded, as a batch or a stream."""
    schema = T.StructType.fromDDL(SNAPSHOT)
    return files.select("path", "length", "content").mapInArrow(decode_batches(feed_type, to_arrow_schema(schema)), schema)


def validate_snapshots(df: DataFrame) -> DataFrame:
    """Adds ``valid`` (has a header) and ``n_entities``."""
    return df.withColumn("valid", F.col("header").isNotNull()).withColumn(
        "n_entities", F.coalesce(F.size("entity"), F.lit(0))
    ).withColumn("n_entities", F.greatest("n_entities", F.lit(0)))


def snapshots_to_json(df: DataFrame, path: str) -> None:
    """One record per snapshot with the original field names, compressed: most of the text is those names."""
    df.select("header", "entity").write.mode("overwrite").option("compression", "snappy").json(path)


def entity_type(e: str = "entity") -> Column:
    return (
        F.when(F.col(f"{e}.trip_update").isNotNull(), "trip_update")
        .when(F.col(f"{e}.vehicle").isNotNull(), "vehicle_position")
        .when(F.col(f"{e}.alert").isNotNull(), "alert")
        .otherwise("unknown")
    )


def _descriptor(trip: str) -> list[Column]:
    return [
        F.coalesce(F.col(f"{trip}.trip_id"), F.lit(NO_TRIP["trip_id"])).alias("trip_id"),
        F.coalesce(F.col(f"{trip}.start_date"), F.lit(NO_TRIP["start_date"])).alias("start_date"),
        map_codes(F.col(f"{trip}.schedule_relationship"), TRIP_RELATIONSHIP, "SCHEDULED").alias("schedule_relationship"),
        F.coalesce(F.col(f"{trip}.route_id"), F.lit(NO_TRIP["route_id"])).alias("route_id"),
        F.coalesce(F.col(f"{trip}.direction_id"), F.lit(NO_TRIP["direction_id"])).alias("direction_id"),
    ]


def _vehicle(v: str) -> list[Column]:
    return [
        F.coalesce(F.col(f"{v}.id"), F.lit(NO_VEHICLE["vehicle_id"])).alias("vehicle_id"),
        F.coalesce(F.col(f"{v}.label"), F.lit(NO_VEHICLE["label"])).alias("label"),
        F.col(f"{v}.license_plate").alias("license_plate"),
    ]


TRIP_KEY = ("trip_id", "route_id", "direction_id", "start_date")
VEHICLE_KEY = ("vehicle_id", "label")


def normalize_snapshots(df: DataFrame) -> dict[str, DataFrame]:
    """Flat tables from nested snapshots.

    Ids are hashes of natural keys (file for a message, message and entity id for an entity), so
    loading a file twice gives the same rows. An entity id seen twice in a message counts once;
    that is decided inside the message's own array, so entities are not shuffled.
    Keys that name descriptors are computed, so no table is looked up while normalizing.
    """
    msg = df.where(F.col("header").isNotNull()).withColumn("feed_message_id", row_id("feed_type", "file"))
    messages = msg.select("feed_message_id", "feed_type", "file_size")
    headers = msg.select(
        "feed_message_id",
        F.coalesce("header.gtfs_realtime_version", F.lit("2.0")).alias("gtfs_realtime_version"),
        F.when(F.coalesce("header.incrementality", F.lit(0)) == 0, "FULL_DATASET").otherwise("DIFFERENTIAL").alias("incrementality"),
        F.col("header.timestamp").alias("timestamp_seconds"), F.col("header.feed_version").alias("feed_version"),
    )
    ids = msg.select(
        "feed_message_id", F.col("header.timestamp").alias("timestamp_seconds"), "entity",
        F.array_sort(F.transform("entity", lambda e, i: F.struct(e["id"].alias("id"), i.alias("at")))).alias("ids"),
    )
    # In id order a repeated id stands next to its first; an entity without an id always counts.
    first = F.filter("ids", lambda x, i: x["id"].isNull() | (i == 0) | ~F.get("ids", i - 1)["id"].eqNullSafe(x["id"]))
    kept = (
        ids.select("feed_message_id", "timestamp_seconds", F.explode(F.transform(first, lambda x: F.get("entity", x["at"]))).alias("entity"))
        .withColumn("entity_id", F.col("entity.id"))
        .withColumn("feed_entity_id", row_id("feed_message_id", "entity_id"))
    )
    entities = kept.select(
        "feed_entity_id", "feed_message_id", "entity_id",
        F.coalesce("entity.is_deleted", F.lit(False)).alias("is_deleted"), entity_type().alias("entity_type"),
    )
    updates = kept.where(F.col("entity.trip_update").isNotNull()).select(
        "feed_entity_id", F.col("entity.trip_update").alias("u")
    ).select("feed_entity_id", "u", *_descriptor("u.trip"), *_vehicle("u.vehicle"))
    updates = updates.withColumns(
        {"trip_update_id": row_id("feed_entity_id", F.lit("tu")), "trip_descriptor_id": row_id(*TRIP_KEY),
         "vehicle_descriptor_id": row_id(*VEHICLE_KEY)}
    )
    seen = kept.where((entity_type() == "vehicle_position")).select(
        "feed_entity_id", F.col("entity.vehicle").alias("v")
    ).select("feed_entity_id", "v", *_descriptor("v.trip"), *_vehicle("v.vehicle"))
    seen = seen.withColumns(
        {"trip_descriptor_id": row_id(*TRIP_KEY), "vehicle_descriptor_id": row_id(*VEHICLE_KEY)}
    )
    # An entity names one trip and one vehicle, as an update or else as a position: descriptors of both come from one pass.
    u, v = F.col("entity.trip_update"), F.col("entity.vehicle")
    named = kept.where(u.isNotNull() | v.isNotNull()).select(
        F.when(u.isNotNull(), u["trip"]).otherwise(v["trip"]).alias("t"), F.when(u.isNotNull(), u["vehicle"]).otherwise(v["vehicle"]).alias("v")
    ).select(*_descriptor("t"), *_vehicle("v"))
    named = named.withColumns({"trip_descriptor_id": row_id(*TRIP_KEY), "vehicle_descriptor_id": row_id(*VEHICLE_KEY)})
    stops = updates.select("trip_update_id", F.explode("u.stop_time_update").alias("s")).select(
        "trip_update_id", "s.stop_sequence", "s.stop_id", F.col("s.arrival.delay").alias("arrival_delay"),
        F.col("s.arrival.time").alias("arrival_time"), F.col("s.departure.delay").alias("departure_delay"),
        F.col("s.departure.time").alias("departure_time"),
        map_codes(F.col("s.schedule_relationship"), STOP_RELATIONSHIP, "SCHEDULED").alias("schedule_relationship"),
    )
    alerts = kept.where(entity_type() == "alert").select(
        "feed_entity_id", row_id("feed_entity_id", F.lit("alert")).alias("alert_id"), F.col("entity.alert").alias("a"),
        "timestamp_seconds",
    )
    texts = F.array(
        *[F.struct(F.lit(t).alias("text_type"), F.col(f"a.{t}.translation").alias("tr")) for t in TEXT_TYPES]
    )
    trip_cols = ["trip_descriptor_id", "trip_id", "start_date", "schedule_relationship", "route_id", "direction_id"]
    vehicle_cols = ["vehicle_descriptor_id", "vehicle_id", "label", "license_plate"]

    def one_per_id(frame, key, cols):
        rest = [c for c in cols if c != key]
        return frame.groupBy(key).agg(F.min(F.struct(*rest)).alias("r")).select(key, "r.*")

    return {
        "feed_messages": messages, "feed_headers": headers, "feed_entities": entities,
        "trip_descriptors": one_per_id(named.select(*trip_cols), "trip_descriptor_id", trip_cols),
        "vehicle_descriptors": one_per_id(named.select(*vehicle_cols), "vehicle_descriptor_id", vehicle_cols),
        "trip_updates": updates.select("trip_update_id", "feed_entity_id", "trip_descriptor_id", "vehicle_descriptor_id"),
        "stop_time_updates": stops,
        "vehicle_positions": seen.select(
            "feed_entity_id", "trip_descriptor_id", "vehicle_descriptor_id",
            F.col("v.position.latitude").alias("latitude"), F.col("v.position.longitude").alias("longitude"),
            F.col("v.current_stop_sequence").alias("current_stop_sequence"),
            map_codes(F.col("v.current_status"), STOP_STATUS, "IN_TRANSIT_TO").alias("current_status"),
            F.col("v.timestamp").alias("timestamp_seconds"), F.col("v.stop_id").alias("stop_id"),
        ),
        "alerts": alerts.select(
            "alert_id", "feed_entity_id", F.coalesce("a.cause", F.lit("UNKNOWN_CAUSE")).alias("cause"),
            F.coalesce("a.effect", F.lit("UNKNOWN_EFFECT")).alias("effect"),
            F.coalesce("a.severity_level", F.lit("UNKNOWN_SEVERITY")).alias("severity_level"),
            F.timestamp_seconds("timestamp_seconds").cast("timestamp_ntz").alias("created_at"),
        ),
        "alert_active_periods": alerts.select("alert_id", F.explode("a.active_period").alias("p")).select(
            "alert_id", F.col("p.start").alias("period_start"), F.col("p.end").alias("period_end")
        ),
        "alert_informed_entities": alerts.select("alert_id", F.explode("a.informed_entity").alias("i")).select("alert_id", "i.*"),
        "alert_text": alerts.select("alert_id", F.inline(texts)).select("alert_id", "text_type", F.explode("tr").alias("t")).select(
            "alert_id", "text_type", "t.text", F.coalesce("t.language", F.lit("en")).alias("language")
        ),
    }
