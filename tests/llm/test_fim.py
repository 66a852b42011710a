"""Fill-in-the-middle: the rotations against slices, the exact inverse, odd rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from headway.llm import fim


def by_slices(text: str, key, rate=100, spm=50, seed=7, marks=fim.SENTINELS):
    """The output put together from slices."""
    p, s, m = marks
    units = text.splitlines(keepends=True) if not set(text) & set("\r\v\f\x1c\x1d\x1e\x85  ") else None
    if units is None:
        parts = text.split("\n")
        units = [x + "\n" for x in parts[:-1]] + ([parts[-1]] if parts[-1] else [])
    h = [int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(x in text for x in marks) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm:
        return n, "spm", len(pre), len(mid), s + suf + p + pre + m + mid
    return n, "psm", len(pre), len(mid), p + pre + s + suf + m + mid


@pytest.mark.parametrize("size", [1, 2, 7, 40])
def test_rotations(size):
    rng = random.Random(size)
    marks = fim.check_sentinels(fim.SENTINELS)
    for _ in range(200):
        text = "".join(rng.choice("ab<>PSM/é\U0001f642\n") for _ in range(size)).encode()
        if any(x in text for x in marks):
            continue
        a, b = sorted(rng.choices(range(len(text) + 1), k=2))
        for form in ("psm", "spm"):
            p, m, s = b"<P>" + text[:a], b"<M>" + text[a:b], b"<S>" + text[b:]
            out = bytes(fim.arrange(text, a, b, form, marks))
            assert out == (p + s + m if form == "psm" else s + p + m)
            assert fim.restore(out, form) == text


@pytest.mark.parametrize("marks", [("<P>", "<S>", "<P>"), ("aba", "b", "c"), ("ab", "bc", "x"), ("", "b", "c")])
def test_sentinels_that_overlap_are_refused(marks):
    with pytest.raises(ValueError):
        fim.check_sentinels(marks)


def test_odd_rows(spark, odd):
    more = spark.createDataFrame(
        [(20, "a <S> b\nc"), (21, "\n\n\n"), (22, "x\r\ny\rz\n"), (23, "line\n" * 50_000), (24, "\U0001f642\né\n" * 30), (25, "a\x00b\n\x00")], "doc_id long, text string"
    )
    docs = odd.unionByName(more, allowMissingColumns=True).withColumn("form", F.lit("in the way")).withColumn("Output", F.lit(1))
    got = fim.restored(fim.fill_in_middle(docs, "text", "doc_id")).collect()
    assert len(got) == 19 and {"score", "n_words", "lang"} <= set(got[0].asDict())
    for r in got:
        want = by_slices(r["text"] or "", "null" if r["doc_id"] is None else r["doc_id"])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == want
        assert r["restored"] == (r["text"] or "")
    assert {r["form"] for r in got} == {"plain", "spm", "psm"}


def test_rates_and_empty_table(spark, odd):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a\n"), F.col("id").cast("string")).alias("text"))
    n = {r["form"]: r["count"] for r in fim.fill_in_middle(rows, "text", "doc_id", 60, 25).groupBy("form").count().collect()}
    assert n["plain"] == pytest.approx(1200, rel=0.1) and n["spm"] == pytest.approx(450, rel=0.2)
    assert fim.restored(fim.fill_in_middle(odd.limit(0), "text", "doc_id")).count() == 0


def test_bytes_that_are_no_utf8(spark):
    rows = spark.createDataFrame([(1, bytearray(b"\xff\xfe\n\x80abc\n"))], "doc_id long, text binary")
    got = fim.restored(fim.fill_in_middle(rows, "text", "doc_id")).select(F.expr("hex(cast(restored as binary))")).first()[0]
    assert got == b"\xff\xfe\n\x80abc\n".hex().upper()
