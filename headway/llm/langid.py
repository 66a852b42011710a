"""Language identification by interpolated Kneser-Ney character models.

Texts are lower-cased and cut to letters, each run of other characters becoming one space. For each
language an order-4 model is counted by Spark from a bounded sample of labelled rows; its lower
orders use continuation counts. All probabilities are worked out once, for every n-gram any
language has seen, and stored beside sorted 64-bit hashes, so that scoring a character is one hash
lookup when its 4-gram is known and a walk down the orders otherwise. The language with the lowest
cross-entropy per character wins. A prediction is rejected when that cross-entropy is both ``z``
deviations above what held-back sample rows of the language show for texts of that length and nearer
to what texts of other languages score under its model.

Edge cases: null text, empty text or text without a letter gives ``und`` with score 0 and is
rejected. Rows without a language or key are never learned from. With no labelled row at all every
text gives ``und``. Repeated rows are predicted alike. An input column named like an output column
is replaced.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F

from headway.llm.common import SortedHashes, annotate, col, mix, thinned

ORDER = 4
DISCOUNT = 0.75
#: Longest run of characters scored at once; a longer text is scored in such pieces and summed.
PIECE = 1 << 20
#: Bound on the variance of one symbol's log-probability, for the spread of short texts.
SYMBOL_VARIANCE = 4.0
STEP = np.uint64(0x100000001B3)
UNKNOWN = "und"
_NO_LETTER = regex.compile(r"\P{L}+")
ADDED = "lang_pred string, score double, entropy double, rejected boolean"


def sample_rows(df: DataFrame, text: str, lang: str, key: str, per_lang: int, usable: Column, max_langs: int = 1000) -> DataFrame:
    """At most ``per_lang`` labelled rows of each of the ``max_langs`` languages with most rows, the first by a hash of their key.

    Both broadcasts are bounded: the counts have ``max_langs`` rows, the ids ``per_lang`` times as many. Rows are thinned
    before they are dealt by language.
    """
    w = Window.partitionBy("lang").orderBy("h", "key")
    named = df.where(usable & col(lang).isNotNull() & col(text).isNotNull() & col(key).isNotNull()).select(
        col(lang).alias("lang"), col(key).alias("key"), F.xxhash64(col(key), F.lit(6)).alias("h")
    )
    have = named.groupBy("lang").agg(F.count(F.lit(1)).alias("have")).orderBy(F.desc("have"), "lang").limit(max_langs)
    ids = (
        thinned(named.join(F.broadcast(have), "lang"), "key", per_lang, F.col("have"), 5)
        .withColumn("n", F.row_number().over(w))
        .where(F.col("n") <= per_lang)
        .select("lang", "key", (F.col("n") % 4 == 0).alias("calibrate"))
        .groupBy("key").agg(F.min("lang").alias("lang"), F.min("calibrate").alias("calibrate"))
    )
    # The texts stay where they are.
    return df.select(col(key).alias("key"), col(text).alias("text")).join(F.broadcast(ids), "key").select("lang", "text", "calibrate")


def count_grams(rows: DataFrame) -> DataFrame:
    """Counts of the order-4 character n-grams of each language; a task sends each n-gram once a batch."""

    def count(batches):
        for pdf in batches:
            found: dict[tuple[str, str], int] = {}
            for lang, text in zip(pdf["lang"], pdf["text"]):
                letters = " ".join(_NO_LETTER.sub(" ", text.lower()).split())
                t = " " * (ORDER - 1) + letters + " "
                for i in range(len(t) - ORDER + 1 if letters else 0):
                    k = lang, t[i : i + ORDER]
                    found[k] = found.get(k, 0) + 1
            yield pd.DataFrame([(*k, n) for k, n in found.items()], columns=["lang", "gram", "n"])

    return rows.select("lang", "text").mapInPandas(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """Hashes of code point rows, oldest character first."""
    h = np.zeros(len(codes), np.uint64)
    for j in range(codes.shape[1]):
        h = h * STEP + (codes[:, j].astype(np.uint64) + np.uint64(1))
    return mix(h)


def build(langs: list[str], lang_of: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> dict:
    """Interpolated models of all languages from the order-4 counts of each.

    ``grams`` holds code points, a row for each counted n-gram.
    """
    n_lang = len(langs)
    levels = []
    for order in range(ORDER, 0, -1):
        levels.append((order, lang_of, grams, counts))
        if order > 1:  # continuation counts: distinct left extensions
            suffix = grams[:, 1:]
            keyed = np.column_stack([lang_of.astype(np.uint32), suffix])
            uniq, n = np.unique(keyed, axis=0, return_counts=True)
            lang_of, grams, counts = uniq[:, 0].astype(np.int64), uniq[:, 1:].astype(np.uint32), n
    symbols = len(np.unique(grams[:, 0])) + 1
    tables, lower = [], None
    base = np.full(n_lang, 1.0 / symbols)
    for order, langs_at, grams_at, counts_at in reversed(levels):
        contexts = gram_hashes(grams_at[:, : order - 1]) if order > 1 else np.zeros(len(grams_at), np.uint64)
        ctx_keys, ctx_at = np.unique(contexts, return_inverse=True)
        total, types = np.zeros((len(ctx_keys), n_lang)), np.zeros((len(ctx_keys), n_lang))
        np.add.at(total, (ctx_at, langs_at), counts_at)
        np.add.at(types, (ctx_at, langs_at), 1)
        back = np.where(total > 0, DISCOUNT * types / np.maximum(total, 1), 1.0)
        keys, first, at = np.unique(gram_hashes(grams_at), return_index=True, return_inverse=True)
        own = np.zeros((len(keys), n_lang))
        np.add.at(own, (at, langs_at), (counts_at - DISCOUNT) / total[ctx_at, langs_at])
        if lower is None:
            below = np.tile(base, (len(keys), 1))
        else:
            below = lower[1][SortedHashes(lower[0]).find(gram_hashes(grams_at[first][:, 1:]))]
        p = own + back[ctx_at[first]] * below
        lower = (keys, p)
        tables.append((keys, np.log(p).astype(np.float32), ctx_keys, np.log(back).astype(np.float32)))
    return {"langs": langs, "tables": tables, "base": np.log(base).astype(np.float32)}


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


class Scorer:
    """Sums of log-probabilities of texts under every language."""

    def __init__(self, model: dict):
        self.langs, self.base = model["langs"], model["base"]
        self.tables = [(SortedHashes(k), p, SortedHashes(c), b) for k, p, c, b in model["tables"]]

    def sums(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Per text the summed log-probability of each language and the number of symbols."""
        out, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        group, owner, size = [], [], 0
        for i, t in enumerate(texts):
            for a in range(0, len(t or ""), PIECE):
                piece = t[a : a + PIECE].lower()
                group.append(piece)
                owner.append(i)
                size += len(piece)
                if size >= PIECE:
                    self._add(group, owner, out, n)
                    group, owner, size = [], [], 0
        if group:
            self._add(group, owner, out, n)
        return out, n

    def _add(self, group: list[str], owner: list[int], out: np.ndarray, n: np.ndarray) -> None:
        pad = "\n" * ORDER
        x = np.frombuffer((pad + pad.join(group) + pad).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(g) + ORDER for g in group])
        own = size.copy()  # the space that ends a text stands first in the padding of the next one
        own[0] += 1
        own[-1] += ORDER - 1
        doc = np.repeat(np.arange(len(group)), own)
        is_letter = _letters()[x]
        x = np.where(is_letter, x, np.uint32(32))
        # Spaces count only after a letter; the first ORDER - 1 spaces before each text are its padding.
        scored = is_letter.copy()
        scored[1:] |= is_letter[:-1]
        start = np.cumsum(size) - size
        keep = scored.copy()
        for k in range(ORDER - 1):
            keep[start + ORDER - 1 - k] = True
        x, doc, scored = x[keep], doc[keep], scored[keep]
        codes = x.astype(np.uint64) + np.uint64(1)
        at = np.flatnonzero(scored)
        if not len(at):
            return
        logs = self._log_probs(codes, at)
        which = np.asarray(owner)[doc[at]]
        cut = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
        rows = which[cut]
        out[rows] += np.add.reduceat(logs, cut, axis=0, dtype=np.float64)
        n[rows] += np.diff(np.append(cut, len(which)))

    def _log_probs(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        logs = np.zeros((len(at), len(self.langs)), np.float32)
        left = np.arange(len(at))
        for order in range(ORDER, 0, -1):
            grams, p, contexts, back = self.tables[order - 1]
            pos = at[left]
            h = np.zeros(len(pos), np.uint64)
            for j in range(order - 1, 0, -1):
                h = h * STEP + codes[np.maximum(pos - j, 0)]
            row = grams.find(mix(h * STEP + codes[pos]))
            known = row >= 0
            logs[left[known]] += p[row[known]]
            left, h = left[~known], h[~known]
            if not len(left):
                return logs
            ctx = contexts.find(mix(h) if order > 1 else h)
            seen = ctx >= 0
            logs[left[seen]] += back[ctx[seen]]
        logs[left] += self.base
        return logs


def train(df: DataFrame, text: str, lang: str, key: str, usable: Column, per_lang: int = 400, max_cells: int = 8_000_000) -> dict:
    """Fit the models on a bounded sample.

    Bounds: ``per_lang`` rows of each language are read (three quarters counted, one quarter kept for
    calibration) and the probability table has at most ``max_cells`` cells: of each language its
    ``max_cells / languages ** 2`` most frequent n-grams stay.
    """
    rows = sample_rows(df, text, lang, key, per_lang, usable).persist()
    langs = sorted(r[0] for r in rows.select("lang").distinct().collect())
    if not langs:
        rows.unpersist()
        return {"langs": []}
    most = max(1000, max_cells // len(langs) ** 2)
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    kept = count_grams(rows.where(~F.col("calibrate"))).withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    got = kept.select("lang", "gram", "n").toPandas().sort_values(["lang", "gram"])
    if got.empty:
        rows.unpersist()
        return {"langs": []}
    langs = sorted(set(got["lang"]))
    codes = np.frombuffer("".join(got["gram"]).encode("utf-32-le"), np.uint32).reshape(-1, ORDER)
    model = build(langs, np.searchsorted(langs, got["lang"]), codes, got["n"].to_numpy(np.float64))
    model["limits"] = calibrate(rows, model)
    rows.unpersist()
    return model


def calibrate(rows: DataFrame, model: dict) -> dict[str, tuple[float, float, float]]:
    """Of each language: its texts' mean cross-entropy, the variance between them, and the level of foreign texts.

    The foreign level is the lowest mean cross-entropy that another language's texts have under this
    language's model; without another language it is the own mean.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    langs = model["langs"]

    def make():
        scorer = Scorer(shared.value)

        def run(texts):
            sums, n = scorer.sums(texts)
            return {"entropies": (-sums / np.maximum(n, 1)[:, None]).tolist(), "n": n}

        return run

    scored = annotate(rows, "text", "entropies array<double>, n long", make, ["lang", "calibrate"]).where(F.col("n") > 0)
    each = [F.col("entropies")[i] for i in range(len(langs))]
    stats = scored.groupBy("lang", "calibrate").agg(
        F.array(*[F.avg(e) for e in each]).alias("mean"), F.array(*[F.var_pop(e) for e in each]).alias("var")
    )
    best = {}
    for r in stats.orderBy("calibrate").collect():  # a language's held-back rows, where it has some
        best[r["lang"]] = r
    shared.unpersist()
    out = {}
    for i, lang in enumerate(langs):
        if lang in best:
            own = best[lang]["mean"][i]
            foreign = min((r["mean"][i] for other, r in best.items() if other != lang), default=own)
            out[lang] = (own, best[lang]["var"][i], foreign)
    return out


def predict(df: DataFrame, text: str, model: dict, keep: list[str] | None = None, z: float = 6.0) -> DataFrame:
    """Add ``lang_pred``, ``score``, ``entropy`` (nats per symbol) and ``rejected``.

    The score is the winner's share among all languages of exp(-entropy * sqrt(symbols)).
    """
    if not model["langs"]:
        model = {"langs": []}
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        if not m["langs"]:
            return lambda t: {"lang_pred": [UNKNOWN] * len(t), "score": [0.0] * len(t), "entropy": [None] * len(t), "rejected": [True] * len(t)}
        scorer = Scorer(m)
        names = np.array(m["langs"], dtype=object)
        mean, between, foreign = (np.array([m["limits"].get(x, (0.0, 1e9, 0.0))[i] for x in m["langs"]]) for i in range(3))

        def run(texts):
            sums, n = scorer.sums(texts)
            some = n > 0
            size = np.maximum(n, 1)
            e = -sums / size[:, None]
            best = e.argmin(axis=1)
            low = e[np.arange(len(e)), best]
            share = 1.0 / np.exp((low[:, None] - e) * np.sqrt(size)[:, None]).sum(axis=1)
            far = low > np.maximum(mean[best] + z * np.sqrt(between[best] + SYMBOL_VARIANCE / size), (mean[best] + foreign[best]) / 2)
            return {
                "lang_pred": np.where(some, names[best], UNKNOWN).tolist(),
                "score": np.where(some, share, 0.0),
                "entropy": [x if s else None for x, s in zip(low.tolist(), some.tolist())],
                "rejected": far | ~some,
            }

        return run

    return annotate(df, text, ADDED, make, keep)
