"""Bounded samples by a hash of the id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def threshold(share: float) -> int:
    """Bound of ``place`` for a share of all rows; exact down to 2**-63, so a
    small sample of a very large table does not round to nothing."""
    return min(int(share * 2.0 ** 63), (1 << 63) - 1)


def place(id_col: str, salt: int) -> Column:
    """63 bits of a salted hash of the id; null ids share one place."""
    return F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("string"), F.lit(salt)), 1)
