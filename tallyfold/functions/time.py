"""Epoch-second helpers as Catalyst expressions (no session-zone dependence)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400
WEEK = 7 * DAY

# Test parquet timestamps load as timestamp_ntz; the difference to the NTZ
# epoch is zone-independent, unlike unix_timestamp().
_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def epoch_s(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.timestamp_diff("SECOND", F.expr(_EPOCH_NTZ), col.cast("timestamp_ntz"))


def ntz_of(epoch: str | Column) -> Column:
    """Epoch seconds -> timestamp_ntz (UTC wall clock)."""
    col = F.col(epoch) if isinstance(epoch, str) else epoch
    return F.timestamp_add("SECOND", col, F.expr(_EPOCH_NTZ))


def yyyymmdd(epoch: str | Column) -> Column:
    """``strftime('%Y%m%d', x, 'unixepoch')`` as int."""
    return F.date_format(ntz_of(epoch), "yyyyMMdd").cast("int")


def iso_date(epoch: str | Column) -> Column:
    """``toISOString().slice(0, 10)``."""
    return F.date_format(ntz_of(epoch), "yyyy-MM-dd")


def utc_date(epoch: str | Column) -> Column:
    return F.to_date(ntz_of(epoch))


def idiv(a: Column, b: int | Column) -> Column:
    """Integral division truncating toward zero (SQL ``div``), exact on longs."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))
