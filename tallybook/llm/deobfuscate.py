"""Noisy-channel deobfuscation: the likeliest plain words behind leetspeak, spaced-out letters and repeated ones.

The language model gives P(letter | two letters before), counted over all documents. The channel turns a letter into itself, into a
look-alike sign, repeats it, or puts a separator behind it. A suspicious span becomes a lattice of what each sign may stand
for, itself among it, and Viterbi decoding finds the best path. Plain text is left as it is: only spans that show such marks are
decoded, and those whose signs are likeliest to stand for themselves stay.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of the model; any other letter counts as "?", everything else as a word's edge (place 0).
LETTERS = " abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýßœ?"
N = len(LETTERS)
#: What a sign may stand for (fixed values).
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "li", "+": "t",
         "€": "e", "£": "e", "(": "c", "<": "c", "¡": "i", "¥": "y", "§": "s", "ƒ": "f", "µ": "u", "¢": "c", "*": "aeiou", "#": "h", "?": "?"}
APART = " .-_*~'/,"
_LETTER, _SIGN = r"[^\W\d_]", r"0-9@$!|+€£(<¡¥§ƒµ¢*#"
#: Spans to decode: single letters set apart; a word of letters and look-alikes, wherever these are; a word with a letter three times in a row.
SPAN = re.compile(
    rf"(?<!\w)(?:{_LETTER}|[0-9@$!])(?:[ .\-_*~'/,](?:{_LETTER}|[0-9@$!])){{2,}}(?!\w)"
    rf"|(?<![\w{_SIGN}])(?={_LETTER}+[{_SIGN}]|[{_SIGN}]+{_LETTER})(?:{_LETTER}|[{_SIGN}])+(?![\w{_SIGN}])"
    rf"|(?<![^\W_]){_LETTER}*?({_LETTER})\1\1{_LETTER}*")
_THRICE = re.compile(rf"({_LETTER})\1\1")
REPEATED, MARKED, PLAIN = -0.3, -1.5, -0.01
#: A run of signs that stand for themselves: before and behind a word where such a sign is usual, and where it is not; each sign inside a word.
BEFORE, BEHIND = "(<*#¡", "!*"
USUAL, ODD, INSIDE = -1.5, -6.0, -10.0


def _classes() -> np.ndarray:
    table = np.zeros(1 << 16, np.uint8)
    for cp in range(1 << 16):
        c = chr(cp).lower()
        if len(c) == 1 and c in LETTERS[1:-1]:
            table[cp] = LETTERS.index(c)
        elif chr(cp).isalpha():
            table[cp] = N - 1
    return table


_TABLE: list[np.ndarray] = []


def classes(text: str) -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_classes())
    return _TABLE[0][np.frombuffer(text.encode("utf-16-le", "replace"), "<u2")]


def letter_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(gram, n): how often each three letters follow each other in all texts, edges included; gram = (a * N + b) * N + c."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = np.zeros(N**3, np.int64)
            for at in range(0, b.num_rows, 64):
                x = classes("  ".join(t or "" for t in b.column(text_col).slice(at, 64).to_pylist())).astype(np.int64)
                x = np.concatenate(([0, 0], x, [0]))
                x = x[np.concatenate(([True, True], (x[2:] > 0) | (x[1:-1] > 0)))]        # runs of edges count as one
                total += np.bincount((x[:-2] * N + x[1:-1]) * N + x[2:], minlength=N**3)
            gram = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(gram, pa.int32()), pa.array(total[gram], pa.int64())], ["gram", "n"])
    return docs.select(text_col).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(counts: DataFrame) -> np.ndarray:
    """Log probabilities (N, N, N) from the counts; at most N**3 rows come to the driver. Smoothed by shorter contexts."""
    tri = np.zeros(N**3)
    for r in counts.toLocalIterator():
        tri[r.gram] = r.n
    tri = tri.reshape(N, N, N)
    bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
    p1 = (uni + 1) / (uni.sum() + N)
    p2 = (bi + 50 * p1) / (bi.sum(axis=1, keepdims=True) + 50)
    p3 = (tri + 20 * p2[None]) / (tri.sum(axis=2, keepdims=True) + 20)
    return np.log(p3)


class Restorer:
    """Restores texts under one language model."""

    def __init__(self, model: np.ndarray):
        self.model = model
        self.word = lru_cache(1 << 16)(self._word)

    def _word(self, span: str) -> str:
        """Viterbi over states (letter before last, last letter); the span itself if all its signs stand for themselves.

        Two equal look-alikes are two letters ("a$$"), three may be one drawn out.
        """
        signs = span.lower()
        apart = {c for c in signs[1::2]} if len(signs) > 4 and all(c in APART for c in signs[1::2]) else set()
        letters = [i for i, c in enumerate(signs) if c.isalpha()]
        first, last = (letters[0], letters[-1]) if letters else (len(signs), -1)
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}       # cost, and what was read: (before, last)
        for i, sign in enumerate(signs):
            place = LETTERS.find(sign, 1, N - 1)
            between = sign in apart and i % 2 == 1
            if place > 0:
                stands, itself = [(place, PLAIN)], None
            elif sign.isalpha():
                stands, itself = [(N - 1, PLAIN)], None
            else:
                stands = [(LETTERS.index(x), MARKED) for x in LOOKS.get(sign, "")]
                usual = apart or (i < first and sign in BEFORE) or (i > last and sign in BEHIND)
                itself = PLAIN if between else USUAL if usual else INSIDE if first < i < last else ODD
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            twice = i > 0 and signs[i - 1] == sign
            drawn = REPEATED if itself is None or sign * 3 in signs[max(0, i - 2): i + 3] else ODD
            for (a, b), (cost, out) in best.items():
                steps = [((b, to), weight + self.model[a, b, to], (out, LETTERS[to] if to < N - 1 else sign)) for to, weight in stands]
                steps += [((a, b), drawn, out) for to, _ in stands if twice and to == b]
                if between and b:
                    steps.append(((a, b), PLAIN, out))
                if itself is not None:                           # a run of edges counts as one
                    steps.append(((b, 0), itself + self.model[a, b, 0], (out, sign)) if b else ((a, 0), itself if i == 0 or itself == INSIDE else REPEATED, (out, sign)))
                for state, gain, text in steps:
                    if state not in new or new[state][0] < cost + gain:
                        new[state] = (cost + gain, text)
            best = new
        _, out = max(((cost + (self.model[a, b, 0] if b else 0.0), out) for (a, b), (cost, out) in best.items()), key=lambda x: x[0])
        read = []
        while out is not None:
            out, sign = out
            read.append(sign)
        plain = "".join(reversed(read))
        if not _THRICE.search(signs) and [c for c in plain if not c.isalpha()] == [c for c in signs if not c.isalpha()]:
            return span                                          # double letters alone are no mark
        return span if plain == signs else plain

    def restore(self, text: str) -> tuple[str, int]:
        """The text with decoded spans, and how many were decoded."""
        n = 0

        def put(m: re.Match) -> str:
            nonlocal n
            out = self.word(m[0]) if len(m[0]) <= 64 else self._word(m[0])
            n += out != m[0]
            return out
        return SPAN.sub(put, text), n


_CLASS = np.zeros(256, np.uint8)       # of bytes: 1 letter, 2 digit or look-alike sign
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[[ord(c) for c in "0123456789@$!|+(<*#"]] = 2


def suspicious(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts of a buffer show a mark of obfuscation at all; the others need no decoding."""
    thrice = np.zeros(len(data) + 1, np.int64)
    for size, least in ((1, 0), (2, 192), (3, 224), (4, 240)):                  # the same letter three times, by its length in bytes
        if len(data) >= 3 * size:
            same = np.concatenate(([0], np.cumsum(data[:-size] != data[size:])))
            thrice[1: len(data) - 3 * size + 2] += (same[2 * size:] == same[:-2 * size]) & (_CLASS[data[: len(data) - 3 * size + 1]] == 1) & (data[: len(data) - 3 * size + 1] >= least)
    first = (data & 0xC0) != 0x80                                                # one place for each code point
    kind = _CLASS[data[first]]
    bounds = np.concatenate(([0], np.cumsum(first)))[offsets]
    mark = np.zeros(len(kind) + 1, np.int64)
    wide = np.isin(data[first], (194, 198, 206, 226))                            # lead bytes of the signs beyond ASCII
    if len(kind) > 1:
        sign = (kind == 2) | wide
        mark[1:-1] += (sign[:-1] & (kind[1:] == 1)) | ((kind[:-1] == 1) & sign[1:])
    if len(kind) > 4:
        mark[1: len(kind) - 3] += np.logical_and.reduce([kind[i: len(kind) - 4 + i] > 0 if i % 2 == 0 else (kind[i: len(kind) - 4 + i] != 1) for i in range(5)])
    a, b = np.cumsum(thrice), np.cumsum(mark)
    return (a[offsets[1:]] > a[offsets[:-1]]) | (b[bounds[1:]] > b[bounds[:-1]])
