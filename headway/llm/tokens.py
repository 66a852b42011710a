"""Byte-level BPE token counts by rank-synchronous merging of ragged arrays.

Texts are cut to pre-tokens by the tokenizer's pattern. The distinct pre-tokens of a batch lie one
behind the other in a flat array of symbols. In each step every sequence looks up the rank of all its
neighbouring pairs, finds its lowest rank, and merges that pair wherever it stands (leftmost first
where occurrences overlap); sequences without a pair left drop out. What is left is counted, and a
text's count is the sum over its pre-tokens.

Special strings inside a text count as one token each, as the library does by default. Nothing is
added, cut or padded.

Edge cases: null text counts as empty: 0 bytes, 0 tokens. A pre-token of any length is merged whole.
Counts of known pre-tokens are kept in a bounded memory of each task. An input column named like an
output column is replaced.
"""

from __future__ import annotations

import json

import numpy as np
import regex
from pyspark.sql import DataFrame

from headway.llm.common import annotate

#: Entries of a task's memory of counts, and the longest pre-token kept there.
KNOWN = 500_000
KNOWN_LENGTH = 64
ADDED = "n_bytes long, n_tokens long"


class Merges:
    """Pairs of symbols with their ranks, as sorted arrays."""

    def __init__(self, first: np.ndarray, second: np.ndarray, merged: np.ndarray, size: int, byte_ids: np.ndarray):
        keys = first.astype(np.int64) * size + second
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.int64(2**62))
        self.rank = np.append(order, 0).astype(np.int64)
        self.merged = np.append(merged[order], 0)
        self.size, self.byte_ids = size, byte_ids

    NONE = np.int64(2**31)

    def counts(self, sequences: list[bytes]) -> np.ndarray:
        """Symbols left of each non-empty byte sequence after all merges."""
        out = np.array([len(s) for s in sequences], np.int64)
        live = np.flatnonzero(out > 1)
        flat = self.byte_ids[np.frombuffer(b"".join([sequences[i] for i in live]), np.uint8)]
        length = out[live]
        while len(live):
            start = np.cumsum(length) - length
            seq = np.repeat(np.arange(len(live)), length)
            rank = np.full(len(flat), self.NONE)
            at = np.searchsorted(self.keys, pair := flat[:-1].astype(np.int64) * self.size + flat[1:])
            hit = (self.keys[at] == pair) & (seq[1:] == seq[:-1])
            rank[:-1][hit] = self.rank[at[hit]]
            lowest = np.minimum.reduceat(rank, start)
            go = (rank == lowest[seq]) & (rank != self.NONE)
            where = np.flatnonzero(go)
            # In a run of overlapping occurrences every second one merges.
            fresh = np.concatenate([[True], np.diff(where) > 1])
            begin = np.flatnonzero(fresh)
            inside = np.arange(len(where)) - begin[np.cumsum(fresh) - 1]
            where = where[inside % 2 == 0]
            flat = flat.copy()
            new = np.searchsorted(self.keys, flat[where].astype(np.int64) * self.size + flat[where + 1])
            flat[where] = self.merged[new]
            stay = np.ones(len(flat), bool)
            stay[where + 1] = False
            length = length - np.bincount(seq[where], minlength=len(live))
            going = (lowest != self.NONE) & (length > 1)
            out[live] = length
            flat = flat[stay & going[seq]]
            live, length = live[going], length[going]
        return out


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def load(text: str) -> tuple[Merges, list[str]]:
    """The merges and special strings of a byte-level BPE file in JSON form."""
    spec = json.loads(text)
    vocab = spec["model"]["vocab"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    first, second, merged = (np.array(x, np.int32) for x in zip(*[(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]))
    ids = np.zeros(256, np.int32)
    for shown, b in byte_alphabet().items():
        ids[b] = vocab[shown]
    return Merges(first, second, merged, max(vocab.values()) + 1, ids), [t["content"] for t in spec["added_tokens"]]


def count_tokens(df: DataFrame, text: str, tokenizer_json: str, pattern: str, keep: list[str] | None = None) -> DataFrame:
    """Add ``n_bytes`` and ``n_tokens``.

    ``tokenizer_json`` is the content of the tokenizer's file (one to a few MB, broadcast);
    ``pattern`` is the expression that cuts pre-tokens.
    """
    shared = df.sparkSession.sparkContext.broadcast(tokenizer_json)

    def make():
        merges, special = load(shared.value)
        cut = regex.compile(pattern).findall
        at_special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        known: dict[str, int] = {}

        def run(texts):
            n_bytes, pieces, n_special = [], [], []
            for t in texts:
                t = t or ""
                n_bytes.append(len(t.encode("utf-8", "surrogatepass")))
                parts = at_special.split(t) if at_special and any(s in t for s in special) else [t]
                n_special.append(len(parts) - 1)
                pieces.append(cut(parts[0]) if len(parts) == 1 else [x for p in parts for x in cut(p)])
            new = list({x for p in pieces for x in p if x not in known})
            if len(known) + len(new) > KNOWN:
                known.clear()
                new = list({x for p in pieces for x in p})
            found = merges.counts([x.encode("utf-8", "surrogatepass") for x in new])
            known.update(zip(new, found.tolist()))
            get = known.__getitem__
            out = {"n_bytes": n_bytes, "n_tokens": [sum(map(get, p)) + s for p, s in zip(pieces, n_special)]}
            for x in new:
                if len(x) > KNOWN_LENGTH:
                    del known[x]
            return out

        return run

    return annotate(df, text, ADDED, make, keep)
