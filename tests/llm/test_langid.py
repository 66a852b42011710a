import math
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from headway.llm import langid


def brute_models(samples):
    """{lang: p(symbol | three before)} by the textbook recursion over strings."""
    counts = {lang: Counter(t[i : i + 4] for t in texts for i in range(len(t) - 3)) for lang, texts in samples.items()}
    levels = {lang: [c] for lang, c in counts.items()}
    for lang, c in counts.items():
        for _ in range(3):
            c = Counter(g[1:] for g in c)
            levels[lang].insert(0, c)
    symbols = len({g for ls in levels.values() for g in ls[0]}) + 1

    def prob(lang, gram):
        p = 1 / symbols
        for k in range(1, 5):
            g = gram[4 - k :]
            c = levels[lang][k - 1]
            below = {x: n for x, n in c.items() if x[:-1] == g[:-1]}
            total = sum(below.values())
            if total:
                p = max(c.get(g, 0) - 0.75, 0) / total + 0.75 * len(below) / total * p
        return p

    return prob


def normal(text):
    out = "".join(c if c.isalpha() else " " for c in text.lower())
    return " ".join(out.split())


def test_scores_match_the_textbook(spark):
    rng = random.Random(3)
    raw = {lang: ["".join(rng.choice(a) for _ in range(60)) for _ in range(4)] for lang, a in {"x": "aabc  ", "y": "abdé ee"}.items()}
    samples = {lang: ["   " + normal(t) + " " for t in ts] for lang, ts in raw.items()}
    rows = spark.createDataFrame([(lang, t) for lang, ts in raw.items() for t in ts], "lang string, text string")
    got = langid.count_grams(rows).toPandas().sort_values(["lang", "gram"])
    codes = np.frombuffer("".join(got["gram"]).encode("utf-32-le"), np.uint32).reshape(-1, 4)
    model = langid.build(["x", "y"], np.searchsorted(["x", "y"], got["lang"]), codes, got["n"].to_numpy(float))
    prob = brute_models(samples)
    texts = ["abc abd!", "zz", "É dé, A", "", None, "..b"]
    sums, n = langid.Scorer(model).sums(texts)
    for i, t in enumerate(texts):
        s = normal(t or "")
        lead = "   " + s + (" " if s and not (t or "")[-1:].isalpha() or s else "")
        want = {lang: sum(math.log(prob(lang, lead[j : j + 4])) for j in range(len(lead) - 3)) if s else 0.0 for lang in "xy"}
        assert n[i] == (len(s) + 1 if s else 0)
        assert np.allclose(sums[i], [want["x"], want["y"]], rtol=1e-4)


def test_a_long_text_is_scored_whole(monkeypatch):
    model = langid.build(["x"], np.zeros(1, int), np.array([[97, 97, 97, 97]], np.uint32), np.ones(1))
    text = "ab " * 1000
    whole, n = langid.Scorer(model).sums([text])
    monkeypatch.setattr(langid, "PIECE", 300)
    cut, m = langid.Scorer(model).sums([text])
    assert n == m and np.allclose(whole, cut)


def test_odd_rows_and_no_labels(spark, odd):
    for usable in (F.lit(True), F.lit(False)):
        model = langid.train(odd, "text", "lang", "doc_id", usable)
        out = langid.predict(odd, "text", model).collect()
        assert len(out) == odd.count()
        for r in out:
            if r["text"] is None or not any(c.isalpha() for c in r["text"]):
                assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            assert 0 <= r["score"] <= 1
    assert langid.predict(odd.limit(0), "text", model).count() == 0


def test_held_out_accuracy(spark):
    from tests.llm.conftest import SF
    from headway.llm.queries import QUERIES

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    out = QUERIES["op5_language_id"](spark, SF).where("held_out").join(docs, "doc_id")
    assert out.where(F.col("lang") == F.col("lang_pred")).count() >= 0.98 * out.count()
