import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from headway.llm import mixing


def brute_targets(sizes, weights=(3, 1, 2), ratio=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, fixed = ratio * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        if not free:
            return fixed
        left = budget - sum(fixed.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 900, "c": 5, None: 40}, {"a": 0, "b": 0}, {"z": 10, "é": 10, "Z": 1000, "_": 3, "b": 7000}, {None: 5},
])
def test_targets(spark, sizes):
    rows = [("" if s is None else "=" + s, s, n) for s, n in sizes.items()]
    out = mixing.targets(spark.createDataFrame(rows, "src string, source string, source_size long")).collect()
    want = brute_targets(sizes)
    assert {r["source"]: pytest.approx(r["target"], abs=1e-6) for r in out} == want


def test_tree_deals_exactly_the_quotas():
    quotas = np.array([5, 0, 100, 37])
    got = mixing.split_tree(quotas, mixing.even_shares(142, 7), [3])
    assert (got.sum(axis=1) == quotas).all() and (got.sum(axis=0) == mixing.even_shares(142, 7)).all()
    assert (got == mixing.split_tree(quotas, mixing.even_shares(142, 7), [3])).all()


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 101, 5000])
def test_blocks_are_permuted(spark, n):
    at = mixing.place_in(F.col("id"), F.lit(n).cast("long"), F.lit(1).cast("long"), F.lit(9).cast("long"), 5)
    out = [r["p"] for r in spark.range(n).select(at.alias("p")).collect()]
    assert sorted(out) == list(range(n))


def test_mix_of_odd_rows(spark, odd, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_SOURCES", 2)
    monkeypatch.setattr(mixing, "SLICE_DOCS", 3)
    out = mixing.mix(odd, "text", "source", "doc_id", shards=5).collect()
    assert len(out) == odd.count()
    sizes, taken, target = {}, {}, {}
    for r in out:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        got = sum(p["n"] for p in r["pieces"] or [])
        assert r["size"] == size and got <= 2 * size
        cover = np.zeros((2, size), int)
        for p in r["pieces"] or []:
            cover[p["copy"], p["first"] : p["first"] + p["n"]] += 1
            assert 1 <= p["shard"] <= 5
        assert cover.max(initial=0) <= 1  # the draws of one copy never overlap
        s = r["source"]
        sizes[s], taken[s], target[s] = sizes.get(s, 0) + size, taken.get(s, 0) + got, r["target"]
    want = brute_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s], abs=1e-6)
        assert abs(taken[s] - target[s]) <= max(64, sizes[s] / 100) + 1
    again = mixing.mix(odd, "text", "source", "doc_id", shards=5).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    assert mixing.mix(odd.limit(0), "text", "source", "doc_id").count() == 0


def test_mixture_holds_the_words_of_its_pieces(spark, odd):
    docs = {r["text"] for r in odd.collect()}
    rows = mixing.mixture(odd, "text", "source", "doc_id").collect()
    assert rows
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"])
        assert len(words) == r["n"] and any(r["text"] in (t or "") for t in docs)
