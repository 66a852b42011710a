"""URL rules, search, quality, token counts and licences against plain versions."""

import math
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from headway.llm import licenses, quality, search, tokens, urls
from headway.llm.common import SortedHashes
from headway.llm.decontam import words_of
from headway.llm.queries import URL_RULES
from tests.llm.conftest import SF


def test_sorted_hashes():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**64, 5000, dtype=np.uint64))
    table = SortedHashes(keys)
    probe = np.concatenate([keys, rng.integers(0, 2**64, 5000, dtype=np.uint64), [np.uint64(0), np.uint64(2**64 - 1)]])
    want = {int(k): i for i, k in enumerate(keys)}
    assert table.find(probe).tolist() == [want.get(int(p), -1) for p in probe]
    assert SortedHashes(keys[:0]).find(probe[:3]).tolist() == [-1, -1, -1]


# ---------------------------------------------------------------- URLs

URLS = [
    None, "", "no scheme", "http://", "http://NET", "http://a.net/", "http://a.net?x", "HTTP://x.EXAMPLE.net/en/1?q#f", "http://notexample.net/en/",
    "http://example.com/de/", "http://example.com/de", "http://w.example.com/DE/", "http://q.org/fr/x", "http://org/fr/", "http://a.org/fr",
    "a://b://c.net/d", "http://u:p@a.net:80/", "http://a.net./", "http://" + "a." * 5000 + "net/" + "p" * 20000, "http://.net/", "http://a.net/\nx",
]


def brute_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


@pytest.mark.parametrize("rules", [URL_RULES, [("", "", "block"), ("net", "", "block"), ("a.net", "/", "allow"), ("NET", "/", "allow"), ("net", "/", "block"), (None, "/", "block")], []])
def test_urls(spark, rules):
    pages = spark.createDataFrame([(i % 5, u, "clash") for i, u in enumerate(URLS + URLS[:6])], "page_id long, url string, verdict string")
    out = urls.verdicts(pages, "url", spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    listed = [(h.lower(), p, v) for h, p, v in rules if h is not None]
    blocked = {(h, p) for h, p, v in listed if v == "block"}
    listed = [(h, p, "block" if (h, p) in blocked else v) for h, p, v in listed]
    got = sorted((str(r["url"]), r["host"], r["path"], str(r["rule"]), r["verdict"]) for r in out)
    want = sorted((str(u), *[str(x) if i == 2 else x for i, x in enumerate(brute_verdict(u, listed))]) for u in URLS + URLS[:6])
    assert got == want
    assert urls.verdicts(pages.limit(0), "url", spark.createDataFrame(URL_RULES, "host string, path string, verdict string")).count() == 0


# ---------------------------------------------------------------- search


def brute_search(docs, queries, k):
    bags = [Counter(words_of(t)) for _, t in docs]
    lengths = [sum(b.values()) for b in bags]
    mean = max(1.0, sum(lengths) / max(1, len(docs)))
    df = Counter(w for b in bags for w in b)
    out = {}
    for q, text in queries:
        found = []
        for (key, _), bag, n in zip(docs, bags, lengths):
            s = sum(
                float(np.float32(math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * bag[w] * 2.2 / (bag[w] + 1.2 * (0.25 + 0.75 * n / mean))))
                for w in set(words_of(text)) if w in bag
            )
            if s > 0:
                found.append((-round(s, 6), key is None, key))
        out.setdefault(q, []).append([(x[2], -x[0]) for x in sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k]])
    return out


@pytest.mark.parametrize("shard_docs", [5, 16384])
def test_search_is_exact(spark, odd, words, shard_docs, monkeypatch):
    monkeypatch.setattr(search, "QUERY_TERMS", 150)
    docs = [(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] != 6]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    queries = [(100 + i, " ".join(words[i : i + 1 + 7 * i])) for i in range(12)] + [(1, None), (2, ""), (3, "nowhere"), (4, docs[4][1])]
    index = search.build_index(df, "text", "doc_id", shard_docs)
    rows = search.search(index, spark.createDataFrame(queries, "q long, text string"), "text", "q", 4).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["doc_id"], pytest.approx(r["score"], abs=2e-6)))
    assert got == {q: f[0] for q, f in brute_search(docs, queries, 4).items() if f[0]}
    assert search.search(search.build_index(df.limit(0), "text", "doc_id"), df, "text", "doc_id").count() == 0


@pytest.mark.parametrize("idf", [0.1 + 0.0137 * i for i in range(10)])
def test_search_ties_go_to_the_smaller_key_across_shards(idf):
    schema = pa.schema([("keys", pa.list_(pa.int64())), *[(x, pa.binary()) for x in ("lengths", "terms", "starts", "docs", "counts")], ("width", pa.int32())])
    shards = []
    for top in range(50, 0, -10):  # 50 equal texts, ids descending from shard to shard
        b = search.Builder()
        b.add(list(range(top, top - 10, -1)), ["equal words"] * 10)
        shards.append(pa.RecordBatch.from_pylist([b.row()], schema))
    wanted = np.unique(np.array([search._hash(b"equal"), search._hash(b"words")], np.uint64))
    shared = SimpleNamespace(value=([7], [np.arange(2)], wanted, np.array([idf, idf / 3]), 2.0))
    (out,) = search._searcher(shared, 10)(iter(shards))
    assert out.column(1).to_pylist() == list(range(1, 11))



def test_search_reads_postings_of_short_lists_only(monkeypatch):
    """Lists longer than a sixteenth of a shard are added by a product, those of at most that by posting; both are exact."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(w for j, w in enumerate(words) if rng.random() < 1 / (2 + j))) for i in range(300)]
    schema = pa.schema([("keys", pa.list_(pa.int64())), *[(x, pa.binary()) for x in ("lengths", "terms", "starts", "docs", "counts")], ("width", pa.int32())])
    b = search.Builder()
    b.add(*map(list, zip(*docs)))
    shard = pa.RecordBatch.from_pylist([b.row()], schema)
    wanted = np.unique(np.array([search._hash(w.encode()) for w in words], np.uint64))
    df = Counter(w for _, t in docs for w in t.split())
    idf = np.zeros(len(wanted))
    for w in words:
        idf[np.searchsorted(wanted, np.uint64(search._hash(w.encode())))] = math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5))
    mean = sum(len(t.split()) for _, t in docs) / len(docs)
    asked = [np.sort(np.searchsorted(wanted, np.array([search._hash(w.encode()) for w in t.split()], np.uint64))) for _, t in docs if t]
    read, ranges = [], search._ranges
    monkeypatch.setattr(search, "_ranges", lambda begin, size: read.append(size) or ranges(begin, size))
    shared = SimpleNamespace(value=(list(range(len(asked))), asked, wanted, idf, mean))
    (out,) = search._searcher(shared, 10)(iter([shard]))
    assert max(size.max(initial=0) for size in read[1:]) <= 300 // 16  # the first opens the shard
    got = {}
    for q, d, s in zip(*[out.column(i).to_pylist() for i in range(3)]):
        got.setdefault(q, []).append((d, pytest.approx(s, abs=2e-6)))
    assert got == {q: f[0] for q, f in brute_search(docs, enumerate(t for _, t in docs if t), 10).items()}


def test_queries_with_the_same_terms_are_searched_once_in_bounded_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_TERMS", 100)
    texts = [np.arange(i, i + 10, dtype=np.uint64).tobytes() for i in range(40)]
    coded = spark.createDataFrame([(i, bytearray(t), 10) for i, t in enumerate(texts + texts[:1] * 300)], "query_id long, terms binary, n long")
    sets, blocks = search.term_sets(coded.repartition(3))
    rows = sets.collect()
    assert len(rows) == len({bytes(r["terms"]) for r in rows}) == len({r["set_id"] for r in rows}) == 40
    sizes = Counter(r["block"] for r in rows)
    assert blocks == 4 and sorted(sizes) == [0, 1, 2, 3] and max(sizes.values()) <= 10


# ---------------------------------------------------------------- quality


def test_boosted_trees_learn_and_flatten():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(800, 4))
    x[:, 3] = 1.0
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    m = quality.fit(x, y, trees=40, depth=3)
    assert ((quality.log_odds(m, x) > 0) == y).mean() > 0.97

    def walk(row):
        s = m["base"]
        for f, t, leaf in zip(m["feature"], m["threshold"], m["leaf"]):
            i = 0
            while i < len(f):
                i = 2 * i + 2 if row[f[i]] > t[i] else 2 * i + 1
            s += leaf[i - len(f)]
        return s

    assert np.allclose(quality.log_odds(m, x[:50]), [walk(r) for r in x[:50]])


@pytest.mark.parametrize("y", [[], [1, 1, 1], [0, 1, 0]])
def test_quality_of_odd_rows(spark, odd, y):
    described = quality.with_statistics(odd, "text")
    labels = spark.createDataFrame([(i + 1, v) for i, v in enumerate(y)] + [(7, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(described, labels, "doc_id", "quality", F.lit(True))
    out = quality.predict(described, model).collect()
    assert len(out) == odd.count() and all(0 < r["score"] < 1 for r in out)
    if not y:
        assert {r["score"] for r in out} == {0.5}
    assert quality.predict(described.limit(0), model).count() == 0


def test_quality_held_out(spark):
    from headway.llm.queries import QUERIES
    from tests.llm.conftest import SF

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = QUERIES["op4_quality"](spark, SF).where("held_out").join(labels, "doc_id")
    assert out.where("predicted = quality").count() >= 0.85 * out.count() > 0


# ---------------------------------------------------------------- tokens

TEXTS = [
    None, "", " ", "Hello world", "aaaaaaa", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "naïve café 東京 \U0001f642\U0001f642", "x" * 5000, "\n\n \t  end  ",
    "don't WE'LL 12345 ½ \u00a0\u2028", "ab" * 3000 + "!!!!!!!",
]


def test_token_counts_equal_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS + TEXTS)], "doc_id long, text string, n_tokens string")
    out = {r["doc_id"]: r for r in tokens.count_tokens(df, "text", spec, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(TEXTS + TEXTS):
        assert out[i]["n_tokens"] == len(lib.encode(t or "", add_special_tokens=False).ids), t
        assert out[i]["n_bytes"] == len((t or "").encode())
    assert tokens.count_tokens(df.limit(0), "text", spec, public_tokenizers.PATTERN).count() == 0


# ---------------------------------------------------------------- licences


@pytest.fixture(scope="module")
def license_model(spark, odd):
    return licenses.train(odd, "text", "doc_id")


def test_templates_are_found_and_talk_is_not(license_model, words):
    filler = " ".join(words[:100])
    for family, phrases in licenses.TEMPLATES.items():
        for phrase in phrases:
            for text in (phrase, f"{filler}\n{phrase}\n{filler}", phrase.upper()):
                assert family in {licenses.FAMILIES[f] for f in license_model.scan([text])[0][1]}, text
    for text in (*licenses.NEAR_MISSES, filler, "Released under the Foo License.", "the of and to", "MIT", "License"):
        assert license_model.scan([text])[0][1] == [], text


def test_licenses_of_odd_rows(spark, odd, license_model):
    out = licenses.scan(odd, "text", license_model).collect()
    assert len(out) == odd.count() and all(r["licenses"] == [] for r in out)
    assert {r["n_windows"] for r in out if not (r["text"] or "").strip()} == {0}
    assert licenses.scan(odd.limit(0), "text", licenses.train(odd.limit(0), "text", "doc_id")).count() == 0


WRAPPED = """#!/bin/sh
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# See the file README.
"""
PERMISSION = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
NOTICES = [
    (WRAPPED, ["GPL-3.0"]),
    (WRAPPED.replace("version 3", "version 2"), ["GPL-2.0"]),
    (WRAPPED.replace("GNU General", "GNU Affero General"), ["AGPL-3.0"]),
    (WRAPPED.replace("version 3", "version 7"), []),
    ("it under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or", ["GPL-3.0"]),
    (PERMISSION, ["MIT"]),
    (PERMISSION[:75], ["MIT"]),
    ("Licensed under the MIT License. Licensed under the Apache License, Version 2.0.", ["Apache-2.0", "MIT"]),
    ("Licensed under the Apache License,\r\nVersion 2.0.", ["Apache-2.0"]),
    ("Licensed under the Apache License,\n\nVersion 2.0.", []),
    ("This work is licensed under a Creative Commons\nAttribution 4.0 International License.", ["CC-BY-4.0"]),
    ("// SPDX-License-Identifier: MIT OR Apache-2.0\nint main() {}", ["Apache-2.0", "MIT"]),
    ("SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0 AND BSD-3-Clause)", ["BSD-3-Clause", "GPL-2.0"]),
    ("SPDX-License-Identifier: Zlib OR ISC", ["ISC"]),
    ("SPDX-License-Identifier: MIT-0", []),
    ("SPDX-License-Identifier: Zlib\nIt came out in MIT or elsewhere.", []),
]


def found_in(model, text):
    return sorted(licenses.FAMILIES[f] for f in model.scan([text])[0][1])


@pytest.fixture(scope="module")
def corpus_model(spark):
    return licenses.train(spark.read.parquet(f"{SF}/documents.parquet"), "text", "doc_id")


@pytest.mark.parametrize("text, want", NOTICES)
@pytest.mark.parametrize("trained_on", ["license_model", "corpus_model"])
def test_wrapped_and_dual_notices(request, trained_on, text, want, words):
    model = request.getfixturevalue(trained_on)
    assert found_in(model, text) == want
    around = " ".join(words[:90])
    assert found_in(model, f"{around}\n\n{text}\n\n{around}") == want
    assert model.scan([text, None, around]) == [model.scan([x])[0] for x in (text, None, around)]


def brute_scan(model, text):
    """The licences of a text by single windows, and by every place where a template could stand."""
    paragraphs, now = [], []
    for line in [*(text or "").split("\n"), ""]:
        if words := words_of(line):
            now += words
        elif now:
            paragraphs.append(now)
            now = []
    found, n_windows, level = set(), 0, -math.log(1 / model.threshold - 1)
    for par in paragraphs:
        believed = []
        for a in [0] if len(par) <= 20 else range(0, 20 * (-(-len(par) // 20) - 1), 20):
            n_windows += 1
            part = par[a : a + 40]
            pairs = zip(par[a : a + 40], par[a + 1 : a + 41])
            x = np.zeros(model.width)
            for w in part:
                if w in model.vocab:
                    x[model.vocab[w]] += 1
            for v, w in pairs:
                key = model.vocab[v] * model.n_words + model.vocab[w] if v in model.vocab and w in model.vocab else -1
                x[model.n_words + np.flatnonzero(model.pairs == key)] += 1
            score = x @ model.weights + model.bias
            if families := {f for f in range(1, len(score)) if score[f] - score[0] >= level}:
                believed.append((a, families))
        regions = []
        for a, families in believed:
            lo, hi = max(0, a - 40), min(len(par), a + 80)
            if regions and lo <= regions[-1][1]:
                regions[-1] = (regions[-1][0], hi, regions[-1][2] | families)
            else:
                regions.append((lo, hi, families))
        for lo, hi, families in regions:
            found |= {f for f, _, _ in licenses._spdx(par[lo:hi])} | set(brute_templates(par[lo:hi], families))
    return sorted(licenses.FAMILIES[f] for f in found), n_windows


def brute_templates(words, families):
    here = list(zip(words, words[1:], words[2:]))
    fits = []
    order = 0
    for f, texts in enumerate(licenses.TEMPLATES.values(), 1):
        for t in map(words_of, texts):
            if t[0] == b"spdx":
                continue
            order += 1
            shape = set(zip(t, t[1:], t[2:]))
            short = len(shape) <= 6
            reach = len(shape) if short else len(t) + len(t) // 4 + 1
            best = max(range(len(here)), key=lambda i: (len(shape & set(here[i : i + reach])), i), default=0)
            first = min((i for i in range(len(here)) if len(shape & set(here[i : i + reach])) == len(shape & set(here[best : best + reach]))), default=0)
            count = len(shape & set(here[best : best + reach]))
            need = len(shape) if short else min(len(shape), 38, len(here) if len(here) > 6 else 38) / 2
            # the first place from which that many fit, without words before the first and after the last of them
            spots = [i for i in range(len(here)) if here[i] in shape]
            ends = [j for j in spots if j < first + reach and len(shape & set(here[max(0, j - reach + 1) : j + 1])) == count]
            if f not in families or not ends or count < need:
                continue
            at = {i for i in spots if ends[0] - reach < i <= ends[0]}
            if (digits := {x for x in shape if any(w.isdigit() for w in x)}) and not digits & {here[i] for i in at}:
                continue
            fits.append((-count, -count / len(shape), order, f, at))
    kept = []
    for *_, f, at in sorted(fits, key=lambda x: x[:3]):
        if all(f == g or 2 * len(at & other) < len(at) for g, other in kept):
            kept.append((f, at))
    return [f for f, _ in kept]


def test_scan_equals_windows_and_templates_one_by_one(spark, corpus_model, words):
    rng = np.random.default_rng(3)
    texts = [t for (t,) in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    phrases = [x for xs in licenses.TEMPLATES.values() for x in xs]
    for _ in range(150):  # notices, whole and cut, among words and each other, wrapped anywhere
        parts = []
        for _ in range(rng.integers(1, 6)):
            part = phrases[rng.integers(len(phrases))].split(" ") if rng.random() < 0.7 else words[: rng.integers(0, 60)]
            parts += part[: rng.integers(1, len(part) + 1)] if part and rng.random() < 0.3 else part
        texts.append("".join(w + [" ", "\n", "\n# \n"][rng.choice(3, p=[0.9, 0.08, 0.02])] for w in parts))
    texts += [x for x, _ in NOTICES]
    some = 0
    for text, (n, families, belief, _) in zip(texts, corpus_model.scan(texts)):
        want = brute_scan(corpus_model, text)
        assert (sorted(licenses.FAMILIES[f] for f in families), n) == want, text
        some += bool(families)
    assert some > 100
