import random

import pytest

from headway.llm import decontam


def brute(text, items, window):
    w = decontam.words_of(text)
    hit, names = set(), set()
    for name, item in items:
        iw = decontam.words_of(item)
        if not iw:
            continue
        k = min(window, len(iw))
        wins = {tuple(iw[i : i + k]) for i in range(len(iw) - k + 1)}
        for i in range(len(w) - k + 1):
            if tuple(w[i : i + k]) in wins:
                hit |= set(range(i, i + k))
                names.add(name)
    return len(w), len(hit), sorted(x for x in names if x is not None)


@pytest.mark.parametrize("seed", range(6))
def test_automaton_matches_brute_force(seed):
    rng = random.Random(seed)
    alphabet = "abc" if seed % 2 else "abcdefgh"
    items = [(str(i), " ".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12)))) for i in range(8)]
    items += [("5", items[2][1]), (None, "a b a b a")]
    machine = decontam.Automaton([(n, decontam.words_of(t)) for n, t in items], 5)
    for _ in range(60):
        text = " ".join(rng.choice(alphabet + "z") for _ in range(rng.randint(0, 40)))
        n, spans, names = machine.scan(text)
        got = n, sum(b - a + 1 for a, b in spans), sorted(x for x in names if x is not None)
        assert got == brute(text, items, 5)


@pytest.mark.parametrize("shard_words", [200_000, 8])
def test_scan_over_odd_rows_and_several_automata(spark, odd, words, shard_words):
    long_text = next(r["text"] for r in odd.collect() if r["doc_id"] == 5)
    cut = long_text.split(" ")
    items = [(1, " ".join(cut[100:130])), (2, " ".join(cut[120:160])), (3, "ONE"), (4, None), (5, ""), (5, " ".join(cut[7:30])), (None, " ".join(cut[400:420]))]
    table = spark.createDataFrame(items, "item_id long, text string")
    out = decontam.scan(odd, "text", table, shard_words=shard_words).collect()
    named = [(str(i) if i is not None else None, t) for i, t in items]
    texts = sorted(str(r["text"]) for r in odd.collect())
    assert sorted(str(r["text"]) for r in out) == texts
    for r in out:
        assert (r["n_words"], r["n_hit"], r["items"]) == brute(r["text"], named, 13)


def test_clean_drops_and_cuts(spark):
    passage = " ".join(f"q{i}" for i in range(20))
    filler = " ".join(f"w{i}" for i in range(1000))
    docs = [(1, passage), (2, f"Start, {filler} {passage}! End.", ), (3, "nothing here"), (4, None)]
    df = spark.createDataFrame([(i, t, "keep") for i, t in docs], "doc_id long, text string, items string")
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    out = {r["doc_id"]: r for r in decontam.clean(df, "text", items).collect()}
    assert set(out) == {2, 3, 4}
    assert out[2]["text"] == f"Start, {filler} ! End." and out[2]["items"] == "keep"
    assert out[3]["text"] == "nothing here" and out[4]["text"] is None
    assert decontam.clean(df, "text", items.limit(0)).count() == 4
    assert decontam.clean(df.limit(0), "text", items).count() == 0
