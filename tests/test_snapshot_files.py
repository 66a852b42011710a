"""Feed files made from tables: bounded files, whole rows, and the decoder against its plain form."""

from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import functions as F

from headway.catalog import QUERIES, feeds
from headway.sources import snapshots as sn, wire


def updates(spark, n):
    return spark.range(n).select(
        F.col("id").alias("trip_id"), (F.col("id") % 7).cast("int").alias("stop_sequence"), (F.col("id") % 11).alias("stop_id"),
        F.when(F.col("id") != 3, F.col("id") / 4 + 0.1).alias("price"), F.lit("A").alias("flag"),
    )


def test_files_are_bounded_and_keep_the_price(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(feeds, "MESSAGES", 10)
    u = updates(spark, 95).coalesce(1)
    feeds.write_binary(SimpleNamespace(upd=u), str(tmp_path / "b"))
    d = sn.read_snapshots(spark, f"{tmp_path}/b/part-*", "vehicle")
    assert d.count() == 10 and d.agg(F.max(F.size("entity"))).first()[0] == 10
    got = {(r.trip, r.stop, r.stop_sequence, r.version, r.price) for r in feeds.seen_vehicles(d).collect()}
    assert got == {(str(r.trip_id), str(r.stop_id), r.stop_sequence, "2.0", r.price) for r in u.collect()}


def test_query_gives_price(spark):
    d = QUERIES["s05_decode_snapshots"](spark, "/root/testdata/sf0.001")
    assert "price" in d.columns


def test_batches_are_small():
    """A batch of records is sent on after a megabyte of content, and the collector is on again at the end."""
    import gc

    schema = pa.schema([("feed_type", pa.string()), ("file", pa.string()), ("file_size", pa.int64()), ("error", pa.string())])
    content = b"\x7a\xff\xff\x0f" + bytes((1 << 18) - 1)
    batch = pa.RecordBatch.from_pydict({"path": ["f"] * 16, "length": [1] * 16, "content": [content] * 16})
    out = list(wire.decode_batches("vehicle", schema)(iter([batch])))
    assert sum(b.num_rows for b in out) == 16 and max(b.num_rows for b in out) <= 5 and gc.isenabled()
