"""Bounded samples that are the same in every run."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RANGE = 1 << 30


def at_most(df: DataFrame, n: int, total: int, *cols: str) -> DataFrame:
    """About the ``n`` rows with the smallest hash of ``cols``, never more. ``total``: rows of df.

    Rows are filtered by their hash first, so that little more than n rows meet in one task, however many there are.
    """
    h = F.xxhash64(*cols)
    share = min(1.0, (1.2 * n + 50) / max(total, 1))
    return df.where(F.pmod(h, F.lit(_RANGE)) < int(share * _RANGE)).orderBy(F.pmod(h, F.lit(_RANGE)), *cols).limit(n)
