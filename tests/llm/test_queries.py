"""The registered queries against their SQL, and the pipeline stage by stage."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from check import TABLES, norm
from headway.llm import decontam
from headway.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import SF
from tests.llm.test_neardup import brute_groups


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark):
    con = duckdb.connect()
    for x in TABLES:
        con.execute(f"CREATE VIEW {x} AS SELECT * FROM '{SF}/{x}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert norm(got[list(want.columns)]) == norm(want)


def test_all_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")).unionByName(docs.limit(2)).unionByName(
        docs.limit(1).withColumns({"doc_id": F.lit(10**9).cast("long"), "text": F.lit(None).cast("string")})
    )
    first = before = docs.unionByName(extra)
    kept = {}
    for i, (name, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, before, SF).write.parquet(f"{tmp_path}/{i}")
        kept[name] = spark.read.parquet(f"{tmp_path}/{i}")
        if name != "mixture":
            assert kept[name].columns == docs.columns
        before = kept[name]
    ids = {n: [r["doc_id"] for r in k.select("doc_id").collect()] for n, k in kept.items()}
    assert 10**9 not in ids["language"] and len(ids["language"]) >= first.count() - 3
    groups = brute_groups([r["text"] for r in kept["language"].select("text").collect()])
    assert len(ids["near_duplicates"]) == len(set(groups)) == len(set(ids["near_duplicates"]))
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    bad = decontam.scan(kept["near_duplicates"], "text", items).where("n_hit > 0 and 20 * n_hit >= n_words")
    assert set(ids["decontamination"]) == set(ids["near_duplicates"]) - {r["doc_id"] for r in bad.select("doc_id").collect()}
    assert decontam.scan(kept["decontamination"], "text", items).where("n_hit > 0").count() == 0
    assert sorted(ids["private_data"]) == sorted(ids["decontamination"])
    assert kept["private_data"].where(F.length("text") != F.col("n_chars")).count() == 0
    both = kept["private_data"].select("doc_id", F.col("text").alias("new")).join(kept["decontamination"], "doc_id").where("new <> text").collect()
    assert both and all("@" not in r["text"] or r["new"] != r["text"] for r in both)
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    total = kept["private_data"].agg(F.sum(words)).first()[0]
    assert kept["mixture"].agg(F.sum("n")).first()[0] == pytest.approx(1.5 * total, rel=0.01)


def test_rows_that_share_an_id(spark, words):
    """Different texts under one id both survive; copies of one text, and rows without an id, leave the smallest."""
    a, b, c = (" ".join(words[i : i + 30]) for i in (0, 40, 80))
    rows = [(1, a, "en", "x"), (1, b, "en", "x"), (2, a, "en", "y"), (2, c, "en", "y"), (2, c, "en", "a"), (None, b, "en", "x"), (None, "alone " + c[::-1], None, None)]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for _ in range(2):
        got = sorted(map(str, corpus_pipeline.near_duplicates(spark, docs.repartition(3), "").collect()))
        assert got == sorted(str(spark.createDataFrame([(*rows[i], len(rows[i][1]))], docs.schema).first()) for i in (0, 1, 4, 6))
