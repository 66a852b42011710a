"""The prefix trie against a plain dictionary of prefixes, in blocks of all sizes."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from headway.llm import trie


def by_prefixes(convs: dict[int, list[tuple[str, str]]]):
    members: dict[tuple, list[int]] = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids: dict[tuple, int] = {}
    for k in members:
        if k:
            kids[k[:-1]] = kids.get(k[:-1], 0) + 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    out = []
    for k, m in members.items():
        ended = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(k))
        parent = min(members[k[:-1]]) if k else None
        out.append((min(m), len(k), parent, len(m), kids.get(k, 0), leaves[k], saved[k], hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=str)


def nodes(spark, convs, cells=trie.CELLS):
    rows = [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"depth": F.lit("x"), "Hash": F.lit(1)})
    seq = trie.sequences(df, "conv_id", "turn", "role", "text")
    bare = spark.createDataFrame([(c, []) for c, t in convs.items() if not t], seq.schema)
    return sorted(map(tuple, trie.prefix_nodes(seq.unionByName(bare), cells).select(*trie.RESULT).collect()), key=str)


def made(seed, n=300, alphabet=3, longest=7):
    rng = random.Random(seed)
    return {rng.randrange(-1000, 10**6): [(rng.choice("ua"), rng.choice("aéb\U0001f642"[:alphabet]) * 2) for _ in range(rng.randrange(longest))] for _ in range(n)}


@pytest.mark.parametrize("cells", [trie.CELLS, 700, 60, 9])
def test_blocks(spark, cells):
    convs = made(cells)
    assert nodes(spark, convs, cells) == by_prefixes(convs)


def test_one_conversation_again_and_again(spark):
    convs = {i: [("u", "hello"), ("a", "hi")] for i in range(500)} | {1000 + i: [("u", "hello"), ("a", "hi"), ("u", str(i % 7))] for i in range(100)} | {-1: []}
    for cells in (trie.CELLS, 40):
        assert nodes(spark, convs, cells) == by_prefixes(convs)


def test_long_rows(spark):
    deep = [("u", str(i // 2)) for i in range(300)]
    convs = {1: deep, 2: deep[:299], 3: deep[:150] + [("a", "x")], 4: [("u", "z")], 5: deep}
    for cells in (trie.CELLS, 100):
        assert nodes(spark, convs, cells) == by_prefixes(convs)


def test_single_and_empty(spark):
    assert nodes(spark, {7: [("u", "x" * 100_000)]}) == by_prefixes({7: [("u", "x" * 100_000)]})
    assert nodes(spark, {7: []}) == [(7, 0, None, 1, 0, 1, 0, hashlib.sha256(b"7").hexdigest())]
    assert nodes(spark, {}) == []


def test_nulls_ties_and_roles(spark):
    rows = [(1, None, None, "b"), (1, 0, "u", None), (2, 0, "", "b"), (2, 0, "u", ""), (None, 0, "u", "x"), (3, 5, "u", "1"), (3, 5, "u", "1"), (4, 1, "u1", ""), (5, 1, "u", "1")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    seq = {r["conv_id"]: [t["id"] for t in r["turns"]] for r in trie.sequences(df, "conv_id", "turn", "role", "text").collect()}
    assert sorted(seq) == [1, 2, 3, 4, 5]
    assert len(seq[3]) == 2 and seq[3][0] == seq[3][1] == seq[5][0] != seq[4][0]
    assert sorted(seq[1]) == sorted(seq[2]) and seq[2] == sorted(seq[2])
