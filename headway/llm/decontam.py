"""Benchmark decontamination with a generalised suffix automaton.

Test items are cut to words and put into one automaton over word numbers. Training words stream
through it; at every word the automaton knows the longest run ending there that occurs in any item.
A run of ``window`` words or more, or a whole item shorter than that, is a hit; hits are merged to
spans. :func:`clean` drops documents whose share of hit words reaches a coverage limit and cuts the
spans of at least a length limit from the others.

Words are runs of a-z, digits and non-ASCII characters after A-Z is lower-cased.

The items travel to the tasks as a broadcast automaton. Items are dealt to as many automata as
needed for each to hold at most ``shard_words`` words, so a broadcast is bounded whatever the size of
the benchmark; documents pass through one after the other and the spans are united.

Edge cases: null or word-less text has no words and no hit. Items without words are ignored; items
without an id make hits but are not listed. Repeated items count once. Empty tables give no hits or
no rows. An input column named like an output column is replaced.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

from headway.llm.common import annotate, col, others

WINDOW = 13
SHARD_WORDS = 200_000
SPAN = "array<struct<first:int,last:int>>"

#: Every byte that is no word byte becomes a space; A-Z becomes a-z.
_FOLD = bytes(
    b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)
_WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Automaton:
    """Suffix automaton of several word sequences.

    ``whole`` lists, at the state reached by a short item, (length, item); ``at_window`` lists at the
    state of a full window the items it occurs in.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window, self.vocab = window, {}
        self.length, self.link, self.next = [0], [-1], [{}]
        coded = []
        for name, words in items:
            codes = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
            if codes:
                coded.append((name, codes))
                last = 0
                for w in codes:
                    last = self._extend(last, w)
        self.shortest = min((min(len(c), window) for _, c in coded), default=window)
        self.whole: dict[int, list] = {}
        self.at_window: dict[int, set] = {}
        for name, codes in coded:
            state = 0
            for i, w in enumerate(codes):
                state = self.next[state][w]
                if i >= window:
                    state = self._shrink(state, window)
                if i >= window - 1:
                    self.at_window.setdefault(state, set()).add(name)
            if len(codes) < window:
                self.whole.setdefault(state, []).append((len(codes), name))

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q)
        new = self._state(self.length[last] + 1, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return new

    def _state(self, length: int, following: dict) -> int:
        self.length.append(length)
        self.link.append(0)
        self.next.append(following)
        return len(self.length) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[copy] = self.link[q]
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _shrink(self, state: int, size: int) -> int:
        """The state of the last ``size`` words of a match at ``state``."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set]:
        """Number of words, merged hit spans (first and last word) and the items hit."""
        words = words_of(text)
        n = len(words)
        known = self.vocab.get
        codes = np.fromiter((known(w, -1) for w in words), np.int64, n)
        inside = np.concatenate([[False], codes >= 0, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        spans, items = [], set()
        for a, b in edges.reshape(-1, 2):  # no match crosses an unknown word
            if b - a >= self.shortest:
                self._walk(codes[a:b].tolist(), int(a), spans, items)
        merged = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1] + 1:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return n, merged, items

    def _walk(self, codes: list[int], base: int, spans: list, items: set) -> None:
        following, link, length, window = self.next, self.link, self.length, self.window
        state = size = 0
        for i, w in enumerate(codes, base):
            while state and w not in following[state]:
                state = link[state]
                size = length[state]
            if w in following[state]:
                state = following[state][w]
                size += 1
            if size >= window:
                spans.append((i - window + 1, i))
                items |= self.at_window[self._shrink(state, window)]
            if self.whole:
                s = state
                while s > 0:
                    for k, name in self.whole.get(s, ()):
                        if k <= size:
                            spans.append((i - k + 1, i))
                            items.add(name)
                    s = link[s]


def automata(items: DataFrame, text: str, item_id: str, window: int, shard_words: int):
    """One automaton after the other, each over at most ``shard_words`` words (or one longer item)."""
    sized = items.select(
        col(item_id).cast("string").alias("id"), col(text).alias("text"), F.xxhash64(col(text)).alias("h"),
        F.coalesce(F.length(col(text)), F.lit(0)).alias("n"),
    ).where("n > 0")
    total = sized.agg(F.sum(F.col("n"))).first()[0] or 0
    shards = max(1, -(-total // (2 * shard_words)))  # a word and its gap take two characters at least
    for k in range(shards):
        rows = sized.where(F.pmod("h", F.lit(shards)) == k).select("id", "text").distinct().collect()
        yield Automaton([(r["id"], words_of(r["text"])) for r in rows], window)


def scan(
    df: DataFrame, text: str, items: DataFrame, item_text: str = "text", item_id: str = "item_id",
    window: int = WINDOW, shard_words: int = SHARD_WORDS, keep: list[str] | None = None,
) -> DataFrame:
    """Add ``n_words``, ``n_hit``, ``spans`` (merged, by word position) and ``items`` (sorted as strings)."""
    added = f"n_words long, spans {SPAN}, items array<string>"
    kept = [x for x in others(df, ["n_words", "n_hit", "spans", "items"]) if keep is None or x in keep]
    source = "_scanned"
    out = df.select(*[col(x) for x in kept], col(text).alias(source))
    found = []
    for k, automaton in enumerate(automata(items, item_text, item_id, window, shard_words)):
        out = _pass(out, source, automaton, added if not k else f"spans {SPAN}, items array<string>")
        out = out.withColumnsRenamed({"spans": f"_spans{k}", "items": f"_items{k}"})
        found.append(k)
    spans = F.col("_spans0") if len(found) == 1 else _united([F.col(f"_spans{k}") for k in found])
    names = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(f"_items{k}") for k in found]))))
    return out.withColumn("spans", spans).select(
        *[col(x) for x in kept], "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["last"] - s["first"] + 1).alias("n_hit"),
        "spans", names.alias("items"),
    )


def _pass(df: DataFrame, text: str, automaton: Automaton, added: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(automaton)

    def make():
        machine = shared.value

        def run(texts):
            n, spans, items = [], [], []
            for t in texts:
                size, hit, names = machine.scan(t)
                n.append(size)
                spans.append([{"first": a, "last": b} for a, b in hit])
                items.append(sorted(x for x in names if x is not None))
            return {"n_words": n, "spans": spans, "items": items}

        return run

    return annotate(df, text, added, make)


def _united(spans: list):
    """Spans of several automata merged into one sorted list."""
    every = F.array_sort(F.flatten(F.array(*spans)))

    def put(done, s):
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (s["first"] <= F.try_element_at(done, F.lit(-1))["last"] + 1)
        longer = F.struct(last["first"].alias("first"), F.greatest(last["last"], s["last"]).alias("last"))
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(every, F.expr(f"cast(array() as {SPAN})"), put)


def clean(
    df: DataFrame, text: str, items: DataFrame, max_coverage_of: int = 20, min_cut: int = WINDOW,
    item_text: str = "text", item_id: str = "item_id", **options,
) -> DataFrame:
    """The documents of ``df`` without contamination, same columns.

    A document is dropped when its hit words times ``max_coverage_of`` reach its words. From the
    others every hit span of ``min_cut`` words or more is cut, from its first to its last letter;
    texts without such a span come back unchanged.
    """
    wide = df.select("*", *[col(x).alias(f"_keep_{x}") for x in df.columns if x.lower() in ("n_words", "n_hit", "spans", "items", "cut")])
    found = scan(wide, text, items, item_text, item_id, **options)
    kept = found.where(~((F.col("n_hit") > 0) & (F.col("n_hit") * max_coverage_of >= F.col("n_words"))))

    def make():
        return lambda texts, spans: {"cut": [cut_spans(t, s, min_cut) for t, s in zip(texts, spans)]}

    done = annotate(kept, [text, "spans"], "cut string", make)
    names = {x.lower(): x for x in done.columns}
    return done.select(
        *[
            (F.col("cut") if x == text else col(f"_keep_{x}") if f"_keep_{x}".lower() in names else col(x)).alias(x)
            for x in df.columns
        ]
    )


def cut_spans(text: str | None, spans: list[dict], min_cut: int) -> str | None:
    """The text without its spans of at least ``min_cut`` words."""
    long_ones = [s for s in spans if s["last"] - s["first"] + 1 >= min_cut]
    if not long_ones:
        return text
    at = [m.span() for m in _WORD.finditer(text)]
    parts, done = [], 0
    for s in long_ones:
        parts.append(text[done : at[s["first"]][0]])
        done = at[s["last"]][1]
    return "".join([*parts, text[done:]])
