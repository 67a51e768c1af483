"""Helpers on columns of texts: what a word is, buffers of Arrow columns, rolling hashes with numpy."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
NO_ID = np.iinfo(np.int64).max

_BASE = 0x9E3779B97F4A7C15                     # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOW = 4096                                    # powers are looked up as high * _LOW + low: no table as long as the text


def n_words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def one_spaced(text: Column) -> Column:
    """The words, joined by one space."""
    return F.regexp_replace(F.regexp_replace(text, GAP, " "), "^ | $", "")


def column(table: pa.Table, name: str) -> pa.Array:
    col = table.column(name)
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def buffer(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, one behind the other, and where each row starts; the last offset is the end."""
    col = column(table, name)
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset: col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def ids(table: pa.Table, name: str) -> np.ndarray:
    """A whole-number id as int64; null comes last of all."""
    return column(table, name).cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over all 64 (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _table(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _power(base: int, n: int) -> np.ndarray:
    """The first n powers modulo 2**64, as products of two short tables."""
    high = _table(pow(base, _LOW, 1 << 64), n // _LOW + 1)
    return np.multiply.outer(high, _table(base, _LOW)).reshape(-1)[:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Sums of value times base to the power of its place, modulo 2**64, before each place."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.multiply(values, _power(_BASE, len(values)), out=sums[1:])
    np.cumsum(sums[1:], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span; equal contents have equal hashes wherever they stand."""
    out = sums[ends] - sums[starts]
    out *= _table(pow(_INVERSE, _LOW, 1 << 64), len(sums) // _LOW + 1)[starts // _LOW]
    out *= _table(_INVERSE, _LOW)[starts % _LOW]
    return mix(out)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word of every row, and for each row the number of words before it."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begins, ends = offsets[:-1][offsets[:-1] < offsets[1:]], offsets[1:][offsets[:-1] < offsets[1:]]
    first[begins] = inside[begins]
    last[ends - 1] = inside[ends - 1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of n places lie in a window of that length that begins at one of the starts."""
    return within(n, starts, np.minimum(starts + length, n))


def within(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie from one of the starts up to before its end."""
    edge = np.bincount(starts, minlength=n + 1)
    edge -= np.bincount(ends, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of set flags."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
