"""Conversion of legacy ARC archives to WARC, with revisit records in place of repeated payloads.

An ARC file begins with a version block, ``filedesc://name ...``, whose first body line states the version. Each record after it
is one header line of space-parted fields and a body of the declared length::

    version 1    URL IP-address Archive-date Content-type Archive-length
    version 2    URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length

Fields are split from the right, so that a URL may hold spaces. From them :func:`convert` makes what WARC asks for and ARC lacks: the
record's identifier (a UUID from the archive's name and the record's offset), an ISO timestamp, the type (version blocks become
warcinfo, bodies with an HTTP status line response, all others resource), SHA-1 digests of block and payload. Of responses with
equal payloads (SHA-256) the first stays, the others become revisit records that name it and keep their HTTP header.

On Spark. Archives are gzip files which Spark's text source reads and writes, on any store that it reaches and with its own commit of
task output: the writer's line separator is the separator of records; the reader hands on the lines of a file, which is not split, in order, and
the declared lengths put them together again. A task holds one record, not one file. Payloads are not grouped: one pass finds
the first record of each repeated payload from digests alone, the other writes. Their join takes the payloads that make up over a
thousandth of all repeats (fewer than a thousand) by broadcast and leaves the rest to the planner, so that a hot payload is not shuffled to one task.

Edge cases: null and empty payloads have length 0. A null URL becomes ``urn:record:`` and the key. Blanks and control characters of a URL
are percent-encoded. Rows without a key come after all keys and are told apart by archive and offset, as are rows that share
theirs. A header line that does not parse gives one record with the error ``header`` and the reader goes on at the next line that does;
a body cut short at the end of its file gives what is left with the error ``truncated``. Both stay out of the revisits and are not
written. Unknown dates take the archive's. An empty table writes no records and reads back none. An archive that is not compressed and
longer than a scan's partition is refused, since its lines would come in parts. Columns beside those named are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from headway.llm.common import col
from headway.sinks.tables import stage

#: The header fields of both versions, and their definition lines.
FIELDS = {
    1: ("url", "ip", "date", "mime", "length"),
    2: ("url", "ip", "date", "mime", "code", "checksum", "location", "offset", "filename", "length"),
}
DEFINITIONS = {
    1: b"URL IP-address Archive-date Content-type Archive-length",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: HTTP field that carries a row's key in an archive, and its WARC counterparts.
KEY_FIELD = b"X-Record-Key"
#: Bytes of records that are passed on together.
BATCH_BYTES = 4 << 20
ARC = "key string, archive string, offset long, version int, url string, ip string, date string, mime string, code string, type string, record_id string, info_id string, block_digest string, payload_digest string, payload_sha binary, payload_bytes long, error string"
WARC = "type string, record_id string, date string, url string, key string, payload_bytes long, payload_digest string, refers_to string, refers_to_key string, content_type string, valid boolean, error string"


def sha1_32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def urn(text: str) -> str:
    """A UUID that depends on the text alone."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, text)}"


def clean_url(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def iso_date(date: str) -> str | None:
    """14 digits (12 or 8 in old archives) as WARC writes an instant."""
    try:
        return datetime.strptime(date.ljust(14, "0"), "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ") if len(date) in (8, 12, 14) else None
    except ValueError:
        return None


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP header with its blank line, and body."""
    ends = [i + len(x) for x in (b"\r\n\r\n", b"\n\n") if (i := block.find(x)) >= 0]
    at = min(ends, default=len(block))
    return block[:at], block[at:]


def http_field(header: bytes, name: bytes) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name) + rb"[ \t]*:[ \t]*([^\r\n]*)", header)
    return found[1].decode("utf-8", "replace").strip() if found else None


class Source:
    """Lines of one file as a stream that also gives blocks of a stated length."""

    def __init__(self, lines: Iterable[bytes]):
        self.lines, self.rest, self.at = iter(lines), None, 0

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the file."""
        x = next(self.lines, None) if self.rest is None else self.rest
        self.rest = None
        if x is not None:
            self.at += len(x) + 1
        return x

    def block(self, n: int) -> bytes:
        """The next ``n`` bytes, or what is left. A line end right behind them goes with them."""
        parts, have = [], 0
        while have < n and (x := self.line()) is not None:
            parts.append(x)
            have += len(x) + 1
        data = b"\n".join(parts)
        if have > n + 1:
            self.rest = data[n:]
            self.at -= len(self.rest) + 1
        elif have == n and n:
            data += b"\n"
        return data[:n]


def arc_header(line: bytes, version: int | None) -> dict[str, str] | None:
    """The fields of a header line; without a known version the longer form is tried first."""
    for v in [version] if version else (2, 1):
        names = FIELDS[v]
        parts = line.rstrip(b"\r").rsplit(b" ", len(names) - 1)
        if len(parts) == len(names) and parts[0] and parts[-1].isdigit() and parts[2].isdigit():
            return {"version": v, **{k: x.decode("utf-8", "replace") for k, x in zip(names, parts)}}
    return None


def arc_records(lines: Iterable[bytes], archive: str, key_field: bytes = KEY_FIELD) -> Iterator[dict]:
    """The records of one ARC file, converted but for revisits; each has its block. ``archive`` is its name unless it states one."""
    src, version, began, info, lost = Source(lines), None, None, None, False
    while True:
        at = src.at
        line = src.line()
        if line is None:
            return
        if not line.strip():
            continue
        is_info = line.startswith(b"filedesc://")
        head = arc_header(line, None if is_info else version)
        if head is None:
            if not lost:
                yield {"archive": archive, "offset": at, "error": "header"}
            lost = True
            continue
        lost = False
        size = int(head["length"])
        block = src.block(size)
        r = {k: head.get(k) for k in ("version", "url", "ip", "mime", "code")}
        if is_info:
            said = block[:1]
            version = r["version"] = int(said) if said in (b"1", b"2") else head["version"]
            archive, began = head["url"].removeprefix("filedesc://"), iso_date(head["date"])
            info = urn(f"{archive}:{at}")
        payload, key = block, None
        if is_info:
            kind = "warcinfo"
        elif block.startswith(b"HTTP/"):
            kind = "response"
            header, payload = split_http(block)
            key = http_field(header, key_field)
        else:
            kind = "resource"
        yield r | {
            "key": key, "archive": archive, "offset": at, "date": iso_date(head["date"]) or began, "type": kind,
            "record_id": urn(f"{archive}:{at}"), "info_id": None if is_info else info, "block_digest": sha1_32(block),
            "payload_digest": sha1_32(payload), "payload_sha": hashlib.sha256(payload).digest(), "payload_bytes": len(payload),
            "error": None if len(block) == size else "truncated", "block": block,
        }


def warc_records(lines: Iterable[bytes], archive: str) -> Iterator[dict]:
    """The records of one WARC file."""
    src, lost = Source(lines), False
    while (line := src.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            if not lost:
                yield {"error": "header"}
            lost = True
            continue
        lost, fields, last = False, {}, None
        while (line := src.line()) is not None and (line := line.rstrip(b"\r")):
            if line[:1] in b" \t" and last:
                fields[last] += " " + line.decode("utf-8", "replace").strip()
            elif b":" in line:
                last, value = line.decode("utf-8", "replace").split(":", 1)
                fields[last := last.strip().lower()] = value.strip()
        if not fields.get("content-length", "").isdigit():
            yield {"error": "header"}
            lost = True
            continue
        size = int(fields["content-length"])
        block = src.block(size)
        kind = fields.get("warc-type")
        is_http = fields.get("content-type", "").startswith("application/http")
        payload = split_http(block)[1] if is_http else block
        stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        n, digest = len(payload), sha1_32(payload)
        if kind == "revisit":  # the payload is elsewhere
            length = fields.get("x-payload-length", "")
            n, digest = int(length) if length.isdigit() else None, stated or None
        yield {
            "type": kind, "record_id": fields.get("warc-record-id", "").strip("<>"), "date": fields.get("warc-date"),
            "url": fields.get("warc-target-uri"), "key": fields.get("x-record-key"), "payload_bytes": n, "payload_digest": digest,
            "refers_to": fields.get("warc-refers-to", "").strip("<>") or None, "refers_to_key": fields.get("x-refers-to-key"),
            "content_type": fields.get("content-type"), "error": None if len(block) == size else "truncated",
            "valid": fields.get("warc-block-digest", "").removeprefix("sha1:") == sha1_32(block) and (not stated or stated == digest),
            "block": block,
        }


def warc_bytes(r: dict) -> bytes:
    """A record's header and block, without the two line ends behind it."""
    block, kind = r["block"], r["type"]
    first = r.get("first")
    fields = [("WARC-Type", "revisit" if first else kind), ("WARC-Record-ID", f"<{r['record_id']}>"), ("WARC-Date", r["date"] or "1970-01-01T00:00:00Z")]
    if kind == "warcinfo":
        fields.append(("WARC-Filename", r["archive"]))
        block = b"software: converted from ARC version %d\r\n" % r["version"]
        content = "application/warc-fields"
    else:
        fields.append(("WARC-Target-URI", clean_url(r["url"])))
        fields += [("WARC-IP-Address", r["ip"])] if r["ip"] not in ("0.0.0.0", "-") else []
        fields += [("WARC-Warcinfo-ID", f"<{r['info_id']}>")] if r["info_id"] else []
        fields.append(("WARC-Payload-Digest", f"sha1:{r['payload_digest']}"))
        content = "application/http; msgtype=response" if kind == "response" else clean_url(r["mime"])
    if first:
        block = split_http(block)[0]
        fields += [
            ("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<{first['record_id']}>"), ("WARC-Refers-To-Target-URI", clean_url(first["url"])),
            ("WARC-Refers-To-Date", first["date"] or "1970-01-01T00:00:00Z"), ("X-Payload-Length", str(r["payload_bytes"])),
        ]
        fields += [("X-Refers-To-Key", first["key"])] if first["key"] is not None else []
    fields += [("X-Record-Key", r["key"])] if r["key"] is not None else []
    fields += [("WARC-Block-Digest", f"sha1:{sha1_32(block)}"), ("Content-Type", content), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block


def in_batches(rows: Iterable[dict], schema: pa.Schema, weight: str | None) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 200 + (len(r.get(weight) or b"") if weight else 0)
        if size > BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def parse_files(spark: SparkSession, path: str, parse: Callable[[Iterator[bytes], str], Iterator[dict]], ddl: str, block: bool) -> DataFrame:
    """The records of all archives below a path, with their blocks or without."""
    schema = T.StructType.fromDDL(ddl + (", block binary" if block else ""))
    arrow = to_arrow_schema(schema)
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    lines = lines.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))

    def rows(batches):
        for b in batches:
            yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for (file, start), group in itertools.groupby(rows(batches), key=lambda x: x[:2]):
                if start:
                    raise ValueError("an archive was split; compress it with gzip")
                yield from parse((x[2] for x in group), f"file-{file & (1 << 64) - 1:016x}")

        yield from in_batches(records(), arrow, "block" if block else None)

    return lines.mapInArrow(run, schema)


def write_text(df: DataFrame, path: str, separator: str) -> None:
    """The frame's one binary column, record by record, as one gzip file a task; fast compression, a little larger files."""
    name = df.columns[0]
    writer = df.select(F.col(name).cast("string").alias("value")).write.option("lineSep", separator).option("maxRecordsPerFile", 0)
    writer.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def write_arc(df: DataFrame, path: str, url: str, payload: str, key: str, captured: str, name: str = "pages", version: int | None = None) -> None:
    """Archive a payload a row as ARC files, one a task; without ``version`` they alternate between both.

    ``captured`` is the 14-digit time that all records get. Narrow: no shuffle.
    """
    sent = df.select(col(url).cast("string").alias("u"), col(payload).cast("binary").alias("p"), col(key).cast("string").alias("k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        v, file = version or 1 + part % 2, f"{name}-{part:05d}.arc"

        def line(url, mime, code, size):
            middle = [] if v == 1 else [code, "-", "-", "0", file]
            return " ".join([url, "0.0.0.0", captured, mime, *middle, str(size)]).encode() + b"\n"

        def records():
            about = b"%d 0 Archive\n%s\n" % (v, DEFINITIONS[v])
            started = False
            for b in batches:
                for u, p, k in zip(*[b.column(i).to_pylist() for i in range(3)]):
                    if not started:
                        yield {"value": line(f"filedesc://{file}", "text/plain", "200", len(about)) + about}
                        started = True
                    p = p or b""
                    own = b"" if k is None else KEY_FIELD + b": " + k.encode() + b"\r\n"
                    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n%sContent-Length: %d\r\n\r\n%s" % (own, len(p), p)
                    yield {"value": line(clean_url(u if u else f"urn:record:{k}"), "text/html", "200", len(body)) + body}

        yield from in_batches(records(), pa.schema([("value", pa.binary())]), "value")

    write_text(sent.mapInArrow(run, "value binary"), path, "\n")


def read_arc(spark: SparkSession, path: str, block: bool = False) -> DataFrame:
    """The records of ARC files with what :func:`convert` derives from them; ``block`` adds their bytes."""
    return parse_files(spark, path, arc_records, ARC, block)


def read_warc(spark: SparkSession, path: str, block: bool = False) -> DataFrame:
    """The records of WARC files. Payload length and digest are those of the full payload, of revisits too; ``valid``
    tells whether the block has the digest that its header states, and a payload that is there has its own."""
    return parse_files(spark, path, warc_records, WARC, block)


def numeric_first(key: Column) -> list[Column]:
    """Keys in ascending order of their number, then those that are no number, then missing ones."""
    number = F.expr("try_cast(key as bigint)")
    return [key.isNull(), number.isNull(), number, key]


def with_first(records: DataFrame, repeats: DataFrame, share: int = 1000) -> DataFrame:
    """Add ``first``, the response that has a record's payload, to the records that revisit it (others: null).

    Payloads with over one ``share``-th of all repeated records are fewer than ``share``, and so are broadcast; their records
    get join keys of their own and are dealt evenly.
    """
    total = repeats.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * share > total
    busy = repeats.where(hot).select("payload_sha", F.col("first").alias("_hot"))
    rest = repeats.where(~hot).select(F.col("payload_sha").alias("_sha"), F.col("first").alias("_rest"))
    d = records.join(F.broadcast(busy), "payload_sha", "left")
    own = F.concat_ws(":", "archive", F.col("offset").cast("string")).cast("binary")
    d = d.withColumn("_sha", F.when(F.col("_hot").isNull() & (F.col("type") == "response"), F.col("payload_sha")).otherwise(own))
    d = d.join(rest, "_sha", "left").withColumn("first", F.coalesce("_hot", "_rest"))
    mine = (F.col("type") == "response") & (F.col("first.record_id") != F.col("record_id"))
    return d.withColumn("first", F.when(mine, F.col("first"))).drop("_sha", "_hot", "_rest")


def convert(spark: SparkSession, arc: str, warc: str, least: int = 0) -> None:
    """Write the ARC archives below one path as WARC archives to another.

    Responses with payloads of ``least`` bytes or more that an earlier record has (by key as a number, then archive and offset) become revisits.
    """
    known = read_arc(spark, arc).where((F.col("type") == "response") & F.col("error").isNull() & (F.col("payload_bytes") >= least))
    order = F.struct(*[x.alias(f"o{i}") for i, x in enumerate(numeric_first(F.col("key")))], "archive", "offset", "record_id", "url", "date", "key")
    found = known.groupBy("payload_sha").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    small = F.struct(*[F.col(f"first.{x}").alias(x) for x in ("record_id", "url", "date", "key")])
    repeats = stage(found.select("payload_sha", small.alias("first"), "n"), "warc-repeats")
    records = with_first(read_arc(spark, arc, block=True).where(F.col("error").isNull()), repeats)
    names = ["archive", "version", "url", "ip", "date", "mime", "type", "record_id", "info_id", "payload_digest", "payload_bytes", "key", "first", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ({"value": warc_bytes(r)} for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist())
        yield from in_batches(rows, pa.schema([("value", pa.binary())]), "value")

    write_text(records.select(*names).mapInArrow(run, "value binary"), warc, "\r\n\r\n")
