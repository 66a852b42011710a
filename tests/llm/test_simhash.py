import random
import re

import numpy as np
import pytest
import xxhash

from headway.llm import simhash


def brute_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(codes, radius):
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= radius
    label = np.arange(len(codes))
    while True:
        new = np.array([label[r].min() for r in near])
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize("text", [None, "", " \n ", "A b", "one", "The Cat sat\x0bon THE mat é İ", "a b c a b c a b c"])
def test_fingerprint(text):
    assert simhash.fingerprint_of(text) == brute_print(text)


def clustered(n, seed):
    """Codes with far, near and chained neighbours, many on one block."""
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(n // 10)] + [0, 2**64 - 1]
    out = set(base)
    while len(out) < n:
        c = rng.choice(base)
        for _ in range(rng.randint(0, 4)):
            c ^= 1 << rng.randrange(64)
        out.add(c)
        base.append(c)
    return np.array(sorted(out), np.uint64)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_leaf_forest_is_exact(radius):
    codes = clustered(700, radius)
    group = np.sort(np.random.default_rng(1).integers(0, 4, len(codes)))
    to = simhash.forest(codes, group, radius)
    for g in range(4):
        at = np.flatnonzero(group == g)
        want = brute_groups(codes[at], radius)
        got = to[at]
        assert len(set(got)) == len(set(want))
        assert len({(a, b) for a, b in zip(got, want)}) == len(set(want))


@pytest.mark.parametrize("leaf", [4, 1024])
def test_components_match_brute_force(spark, leaf):
    codes = clustered(900, 7)
    fps = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    links = simhash.leaf_links(simhash.leaves(fps, 2, leaf), 2)
    rows = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    got = np.array([rows.get(int(c), int(c)) for c in codes.view(np.int64)])
    want = brute_groups(codes, 2)
    assert len({(a, b) for a, b in zip(got, want)}) == len(set(want)) == len(set(got))


def test_a_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {r["root"] for r in simhash.components(links).collect()} == {0}


def test_components_of_random_links(spark):
    """Rings, stars, chains and clumps with negative and extreme ids, links of a node with itself and repeated links."""
    rng = random.Random(5)
    names = [rng.randint(-(2**63), 2**63 - 1) for _ in range(600)] + [-(2**63), 2**63 - 1, 0, -1]
    links = [(names[i], names[i + 1]) for i in range(0, 120)] + [(names[200], names[i]) for i in range(150, 260)]
    links += [tuple(rng.sample(names[300:600], 2)) for _ in range(140)] + [(names[-4], names[-3]), (0, -1), (0, 0)]
    links += [(b, a) for a, b in links[::3]] + links[::5] + [(a, a) for a, _ in links[::7]]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = simhash.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(got) == len(root) and {r["node"]: r["root"] for r in got} == {x: find(x) for x in root}


def test_odd_rows(spark, odd):
    out = simhash.near_duplicates(odd, "text", "doc_id").collect()
    assert len(out) == odd.count()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
    assert {r["component_id"] for i in (1, 2, 3) for r in by[i]} == {1}  # all without words
    assert by[1][0]["fingerprint"] == "0" * 16
    assert by[6][0]["component_id"] == 5
    assert len(by[7]) == 2
    assert simhash.near_duplicates(odd.limit(0), "text", "doc_id").count() == 0
