"""ARC to WARC: both versions, damaged archives, revisits against a plain grouping, odd rows."""

import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from headway.llm import warc

V1_BODY = b"1 0 Archive\nURL IP-address Archive-date Content-type Archive-length\n"
V1 = b"filedesc://old.arc 0.0.0.0 19970101000000 text/plain %d\n%s\n" % (len(V1_BODY), V1_BODY)
V2_BODY = b"2 0 Archive\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
V2 = b"filedesc://new.arc 0.0.0.0 200001010000 text/plain 200 - - 0 new.arc %d\n%s\n" % (len(V2_BODY), V2_BODY)


def parsed(data: bytes):
    lines = data.split(b"\n")
    return list(warc.arc_records(lines[:-1] if not lines[-1] else lines, "nameless"))


def test_versions_and_types():
    page = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\n<p>\n\n\r\n\r\nhttp://not.a.header 1.2.3.4 19970102030405 text/html 9\n</p>\n"
    one = b"http://a.org/x y 1.2.3.4 19970102030405 text/html %d\n%s\n" % (len(page), page)
    dns = b"dns:a.org 1.2.3.4 19970102 text/dns 8\n19970102\n"
    empty = b"http://a.org/0 1.2.3.4 1997010203 text/html 0\n\n"
    got = parsed(V1 + one + dns + empty)
    assert [r["type"] for r in got] == ["warcinfo", "response", "resource", "resource"]
    assert [r["version"] for r in got] == [1] * 4 and {r["archive"] for r in got} == {"old.arc"}
    assert got[1]["url"] == "http://a.org/x y" and got[1]["date"] == "1997-01-02T03:04:05Z" and got[1]["block"] == page
    assert got[1]["payload_bytes"] == len(page) - page.index(b"<p>")
    assert got[1]["payload_digest"] == base64.b32encode(hashlib.sha1(page[page.index(b"<p>") :]).digest()).decode()
    assert got[2]["date"] == "1997-01-02T00:00:00Z" and got[3]["date"] == "1997-01-01T00:00:00Z" and got[3]["payload_bytes"] == 0
    assert len({r["record_id"] for r in got}) == 4 and {r["info_id"] for r in got[1:]} == {got[0]["record_id"]}
    assert got == parsed(V1 + one + dns + empty)
    starts = [0, len(V1), len(V1 + one), len(V1 + one + dns)]
    assert [r["offset"] for r in got] == starts
    two = b"http://b.org/ 1.2.3.4 20000102030405 text/html 200 sum - 99 new.arc %d\n%s\n" % (len(page), page)
    got = parsed(V2 + two)
    assert [r["version"] for r in got] == [2, 2] and got[1]["code"] == "200" and got[1]["block"] == page and got[0]["date"] == "2000-01-01T00:00:00Z"


def test_damage():
    good = b"http://a.org/ 1.2.3.4 19970102030405 text/plain 3\nabc\n"
    got = parsed(V1 + b"some junk\nmore junk\n" + good + b"http://a.org/2 1.2.3.4 19970102030405 text/plain 300\nabc\n")
    assert [r["error"] for r in got] == [None, "header", None, "truncated"] and got[2]["block"] == b"abc"
    assert parsed(good)[0]["archive"] == "nameless" and parsed(b"") == [] and parsed(b"\n\n") == []
    wrong = parsed(V1 + b"http://a.org/ 1.2.3.4 19970102030405 text/plain 2\nabc\n" + good)
    assert wrong[1]["block"] == b"ab" and wrong[-1]["block"] == b"abc" and wrong[2]["error"] == "header"
    assert [r["error"] for r in warc.warc_records([b"junk", b"WARC/1.1\r", b"Content-Length: x\r", b"\r", b""], "x")] == ["header", "header"]


def by_groups(rows):
    """record_type and refers_to by plain grouping; ids unique or null."""
    first = {}
    for i, html in sorted(rows, key=lambda x: (x[0] is None, x[0])):
        first.setdefault(html or "", i)
    return {(i, len((html or "").encode()), "response" if first[html or ""] == i else "revisit", None if first[html or ""] == i else first[html or ""]) for i, html in rows}


@pytest.mark.parametrize("version", [1, 2, None])
@pytest.mark.parametrize("light", [False, True])
def test_round_trip(spark, tmp_path, version, light):
    htmls = ["a\r\n\r\nb\n", "", None, "<p>é\U0001f642</p>", "x" * 300_000 + "\n" * 5, "WARC/1.1\r\nWARC-Type: x\r\n\r\n", "\n", "http://a 1.2.3.4 19990101000000 text/html 4\n"]
    rows = [(i, htmls[i * i % 11 % len(htmls)]) for i in range(60)] + [(1000 + i, "same") for i in range(500)] + [(-5, "x")]
    pages = spark.createDataFrame(rows, "page_id long, html string").repartition(5).withColumns(
        {"url": F.when(F.col("page_id") % 3 > 0, F.concat(F.lit("http://a.org/ \n"), "page_id")), "type": F.lit(1)}
    )
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    arc, out = f"{tmp_path}/arc", f"{tmp_path}/warc"
    try:
        if light:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        warc.write_arc(pages, arc, "url", "html", "page_id", "20240102030405", version=version)
        warc.convert(spark, arc, out)
        back = warc.read_warc(spark, out, block=True).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    found = [r for r in back if r["type"] != "warcinfo"]
    assert all(r["valid"] and r["error"] is None for r in back) and len(found) == len(rows)
    assert {(int(r["key"]), r["payload_bytes"], r["type"], r["refers_to_key"] and int(r["refers_to_key"])) for r in found} == by_groups(rows)
    ids = {r["record_id"]: r for r in found}
    assert len(ids) == len(rows)
    text = dict(rows)
    for r in found:
        raw = (text[int(r["key"])] or "").encode()
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        if r["type"] == "response":
            assert warc.split_http(r["block"])[1] == raw
        else:
            assert ids[r["refers_to"]]["key"] == r["refers_to_key"]
    versions = {r["version"] for r in warc.read_arc(spark, arc).collect()}
    assert versions == ({version} if version else {1, 2})


def test_rows_that_share_or_lack_a_key(spark, tmp_path):
    rows = [(7, "t"), (7, "t"), (None, "t"), (3, "t"), (None, "u"), (None, "u"), (9, None)]
    pages = spark.createDataFrame(rows, "page_id long, html string").withColumn("url", F.lit(None).cast("string"))
    warc.write_arc(pages, f"{tmp_path}/a", "url", "html", "page_id", "20240102030405")
    warc.convert(spark, f"{tmp_path}/a", f"{tmp_path}/w", least=1)
    got = warc.read_warc(spark, f"{tmp_path}/w").where("type <> 'warcinfo'").collect()
    assert sorted((r["key"] or "-", r["type"], r["refers_to_key"] or "-") for r in got) == sorted(
        [("7", "revisit", "3"), ("7", "revisit", "3"), ("-", "revisit", "3"), ("3", "response", "-"), ("-", "response", "-"), ("-", "revisit", "-"), ("9", "response", "-")]
    )
    warc.convert(spark, f"{tmp_path}/a", f"{tmp_path}/w2", least=2)
    assert warc.read_warc(spark, f"{tmp_path}/w2").where("type = 'revisit'").count() == 0


def test_empty_table_and_foreign_file(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_arc(pages, f"{tmp_path}/a", "url", "html", "page_id", "20240102030405")
    warc.convert(spark, f"{tmp_path}/a", f"{tmp_path}/w")
    assert warc.read_warc(spark, f"{tmp_path}/w").count() == 0
    (tmp_path / "b").mkdir()
    page = b"HTTP/1.0 200 OK\r\n\r\nsame"
    body = b"http://a.org/%d 1.2.3.4 19970102030405 text/html 23\n%s\n"
    with open(tmp_path / "b/old.arc.gz", "wb") as f:  # a gzip member for each record, as crawlers write
        for x in (V1, body % (1, page), body % (2, page)):
            f.write(gzip.compress(x))
    warc.convert(spark, f"{tmp_path}/b", f"{tmp_path}/bw")
    got = warc.read_warc(spark, f"{tmp_path}/bw").collect()
    assert sorted(r["type"] for r in got) == ["response", "revisit", "warcinfo"]
    assert [(r["url"], r["refers_to_key"]) for r in got if r["type"] == "revisit"] == [("http://a.org/2", None)]
