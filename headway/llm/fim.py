"""Fill-in-the-middle rewriting by rotation of blocks in place, and its exact inverse.

A text is cut into units (lines with their line break). Two cuts, drawn from a hash of the document's key, part it
into prefix, middle and suffix. The three sentinels are inserted into the text's bytes, so that they stand as
``P prefix M middle S suffix``, and a rotation exchanges the two neighbouring segments that the form has the other way
round::

    psm    P prefix | M middle | S suffix      rotates the last two:          P prefix  S suffix  M middle
    spm    P prefix   M middle | S suffix      rotates the last to the front: S suffix  P prefix  M middle

A rotation reverses both segments and then their whole, so that it is its own kind of inverse: restoring finds the
sentinels, rotates by the other length and deletes the sentinels. Nothing else of the text moves or is re-encoded.

Edge cases: null text counts as empty. An empty text, one that holds a sentinel, and one that the rate spares stay
plain: unchanged, without prefix and middle. A null key is hashed as the text ``null``. Bytes that are no UTF-8 are kept as they are.
Texts are cut whole, whatever their length; one text lies in a task's memory at a time, beside its batch. Rows repeat as often as they
come. An input column named like an output column is replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from headway.llm.common import annotate, col

#: Sentinels of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
ADDED = "n long, form string, prefix_chars long, middle_chars long, output binary"


def check_sentinels(sentinels: tuple[str, str, str]) -> tuple[bytes, bytes, bytes]:
    """Sentinels as bytes. None may be found at a seam of text and sentinel: no end of one begins another."""
    marks = tuple(s.encode() for s in sentinels)
    if len(set(marks)) < 3 or not all(marks):
        raise ValueError("three different sentinels are needed")
    for a in marks:
        for b in marks:
            if (a != b and a in b) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)))):
                raise ValueError(f"the sentinels {a!r} and {b!r} can overlap")
    return marks


def reverse(buf: bytearray, a: int, b: int) -> None:
    view = np.frombuffer(buf, np.uint8)[a:b]
    view[:] = view[::-1].copy()


def rotate(buf: bytearray, a: int, m: int, b: int) -> None:
    """Exchange the segments [a, m) and [m, b) by three reversals."""
    reverse(buf, a, m)
    reverse(buf, m, b)
    reverse(buf, a, b)


def draws(key: str, seed: int) -> list[int]:
    """Four unsigned numbers from the hash of seed and key."""
    h = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]


def unit_ends(text: bytes) -> np.ndarray:
    """Byte positions 0 and behind each unit: a line with its break, or the last line without one."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    if text and not text.endswith(b"\n"):
        ends = np.append(ends, len(text))
    return np.append(0, ends)


def chars(text: memoryview | bytes) -> int:
    """Code points of UTF-8 bytes."""
    b = np.frombuffer(text, np.uint8)
    return len(b) - int(np.count_nonzero((b & 0xC0) == 0x80))


def arrange(text: bytes, first: int, second: int, form: str, marks: tuple[bytes, bytes, bytes]) -> bytearray:
    """The text with its cuts at two byte positions, in the order of the form."""
    p, s, m = marks
    buf = bytearray(text)
    buf[second:second] = s
    buf[first:first] = m
    buf[:0] = p
    middle, suffix = len(p) + first, len(p) + second + len(m)
    rotate(buf, middle if form == "psm" else 0, suffix, len(buf))
    return buf


def restore(output: bytes, form: str, sentinels: tuple[str, str, str] = SENTINELS) -> bytes:
    """The text that a form's output came from."""
    buf = bytearray(output)
    if form == "plain":
        return bytes(buf)
    p, s, m = check_sentinels(sentinels)
    at_p, at_s, at_m = buf.find(p), buf.find(s), buf.find(m)
    if form == "psm":
        rotate(buf, at_s, at_m, len(buf))
        at_m, at_s = at_s, at_s + len(buf) - at_m
    else:
        rotate(buf, 0, at_p, len(buf))
        at_m, at_s = at_m - at_p, len(buf) - at_p
    for at, mark in ((at_s, s), (at_m, m), (0, p)):
        del buf[at : at + len(mark)]
    return bytes(buf)


def fill_in_middle(
    df: DataFrame,
    text: str,
    key: str,
    rate: int = 100,
    spm: int = 50,
    seed: int = 7,
    sentinels: tuple[str, str, str] = SENTINELS,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add the number of units ``n``, the ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` and the ``output`` text.

    ``rate`` is the percentage of texts to rewrite, ``spm`` that of them whose suffix comes first. Narrow: no shuffle.
    """
    marks = check_sentinels(sentinels)

    def make():
        def one(raw, k):
            raw = raw or b""
            h = draws("null" if k is None else k, seed)
            ends = unit_ends(raw)
            n = len(ends) - 1
            if not raw or any(x in raw for x in marks) or h[2] % 100 >= rate:
                return n, "plain", None, None, raw
            cuts = sorted(int(ends[x % (n + 1)]) for x in h[:2])
            form = "spm" if h[3] % 100 < spm else "psm"
            view = memoryview(raw)
            out = arrange(raw, *cuts, form, marks)
            return n, form, chars(view[: cuts[0]]), chars(view[cuts[0] : cuts[1]]), bytes(out)

        names = ["n", "form", "prefix_chars", "middle_chars", "output"]

        def run(texts, keys):
            return dict(zip(names, map(list, zip(*map(one, texts, keys)))))

        return run

    sent = df.withColumns({"_fim_raw": col(text).cast("binary"), "_fim_key": col(key).cast("string")})
    out = annotate(sent, ["_fim_raw", "_fim_key"], ADDED, make, df.columns if keep is None else keep)
    return out.withColumn("output", F.col("output").cast("string"))


def restored(df: DataFrame, output: str = "output", form: str = "form", sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """Add ``restored``, the text rebuilt from output and form alone."""
    check_sentinels(sentinels)

    def make():
        return lambda outputs, forms: {"restored": [None if o is None else restore(o, f, sentinels) for o, f in zip(outputs, forms)]}

    sent = df.withColumn("_fim_raw", col(output).cast("binary"))
    out = annotate(sent, ["_fim_raw", form], "restored binary", make, df.columns)
    return out.withColumn("restored", F.col("restored").cast("string"))
