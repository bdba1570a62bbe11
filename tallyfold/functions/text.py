"""Small string helpers as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_int_prefix(s: Column) -> Column:
    """JavaScript ``parseInt(s, 10)``: optional spaces and sign, then leading
    digits; null when there are none (NaN)."""
    digits = F.regexp_extract(s, r"^\s*([+-]?[0-9]+)", 1)
    return F.when(digits != "", digits.try_cast("long"))


def last_path_segment(s: Column) -> Column:
    """``s.split('/').pop()``."""
    return F.element_at(F.split(s, "/"), -1)
