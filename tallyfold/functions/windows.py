"""Skew-safe ordered windows: running aggregates, lag/lead and last-non-null
over a group, computed per (group, chunk) with carries from earlier chunks.

A plain ``Window.partitionBy(user).orderBy(ts)`` puts a whole group in one
task, and AQE cannot split window partitions.  Here every group is cut into
ordered chunks (e.g. the hour of the event): the heavy work is a window over
``group + chunk`` (many small partitions, even for one hot user), and the
carry between chunks comes from a summary with one row per (group, chunk),
whose own window is tiny (a year of hourly chunks is 8,760 rows per group).
The result equals the un-chunked window exactly as long as chunk order agrees
with the row order, which holds when the chunk is a monotone function of the
leading order column.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_UNB = Window.unboundedPreceding


def _once(df: DataFrame) -> DataFrame:
    """Each helper reads its windowed input twice (rows, and the per-chunk
    summary joined back); column pruning makes the two branches differ, so
    Spark would not reuse the shuffle and stacked helpers would recompute
    their inputs 2^k times.  Materialise the intermediate once (spills to
    disk; lost blocks are recomputed from lineage; the context cleaner drops
    it when the DataFrame is no longer referenced)."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def chunked_running(df: DataFrame, group: list[str], order: list[str], chunk: str, value: Column,
                    out: str, how: str = "sum", exclusive: bool = False) -> DataFrame:
    """``out`` = running ``how`` (sum/min/max) of ``value`` over ``group``
    ordered by ``order``, including the current row unless ``exclusive``."""
    agg = {"sum": F.sum, "min": F.min, "max": F.max}[how]
    comb = {"sum": lambda a, b: a + b, "min": F.least, "max": F.greatest}[how]
    d = df.withColumn("__w_v", value)
    wl = Window.partitionBy(*group, chunk).orderBy(*order).rowsBetween(_UNB, -1 if exclusive else 0)
    d = _once(d.withColumn("__w_loc", agg("__w_v").over(wl)))
    summ = d.groupBy(*group, chunk).agg(agg("__w_v").alias("__w_tot"))
    ws = Window.partitionBy(*group).orderBy(chunk).rowsBetween(_UNB, -1)
    summ = summ.withColumn("__w_carry", agg("__w_tot").over(ws)).drop("__w_tot")
    d = d.join(summ, [*group, chunk], "left")
    res = F.when(F.col("__w_carry").isNull(), F.col("__w_loc")).otherwise(
        F.when(F.col("__w_loc").isNull(), F.col("__w_carry")).otherwise(comb(F.col("__w_carry"), F.col("__w_loc"))))
    return d.withColumn(out, res).drop("__w_v", "__w_loc", "__w_carry")


def chunked_lag(df: DataFrame, group: list[str], order: list[str], chunk: str, value: str,
                out: str) -> DataFrame:
    """``out`` = ``value`` of the previous row in the group (null for the first)."""
    wl = Window.partitionBy(*group, chunk).orderBy(*order)
    d = _once(df.withColumn("__w_loc", F.lag(value).over(wl)))
    summ = d.groupBy(*group, chunk).agg(F.max_by(F.col(value), F.struct(*order)).alias("__w_last"))
    ws = Window.partitionBy(*group).orderBy(chunk)
    summ = summ.withColumn("__w_prev", F.lag("__w_last").over(ws)).drop("__w_last")
    d = d.join(summ, [*group, chunk], "left")
    return d.withColumn(out, F.coalesce("__w_loc", "__w_prev")).drop("__w_loc", "__w_prev")


def chunked_lead(df: DataFrame, group: list[str], order: list[str], chunk: str, value: str,
                 out: str) -> DataFrame:
    """``out`` = ``value`` of the next row in the group (null for the last)."""
    wl = Window.partitionBy(*group, chunk).orderBy(*order)
    d = _once(df.withColumn("__w_loc", F.lead(value).over(wl)))
    summ = d.groupBy(*group, chunk).agg(F.min_by(F.col(value), F.struct(*order)).alias("__w_first"))
    ws = Window.partitionBy(*group).orderBy(chunk)
    summ = summ.withColumn("__w_next", F.lead("__w_first").over(ws)).drop("__w_first")
    d = d.join(summ, [*group, chunk], "left")
    # lead of the last row in a chunk is the next chunk's first value, even if null
    last_in_chunk = F.lead(F.lit(1)).over(wl).isNull()
    return (d.withColumn("__w_is_last", last_in_chunk)
            .withColumn(out, F.when(F.col("__w_is_last"), F.col("__w_next")).otherwise(F.col("__w_loc")))
            .drop("__w_loc", "__w_next", "__w_is_last"))


def chunked_last_non_null(df: DataFrame, group: list[str], order: list[str], chunk: str, value: str,
                          out: str) -> DataFrame:
    """``out`` = last non-null ``value`` at or before the row (as-of lookup)."""
    wl = Window.partitionBy(*group, chunk).orderBy(*order).rowsBetween(_UNB, 0)
    d = _once(df.withColumn("__w_loc", F.last(value, ignorenulls=True).over(wl)))
    summ = (d.where(F.col(value).isNotNull()).groupBy(*group, chunk)
            .agg(F.max_by(F.col(value), F.struct(*order)).alias("__w_lastv")))
    # carry = last non-null of all earlier chunks; chunks without values are
    # absent from the summary, so look them up with an as-of on the chunk key
    keys = d.select(*group, chunk).distinct()
    allk = keys.join(summ, [*group, chunk], "left")
    ws = Window.partitionBy(*group).orderBy(chunk).rowsBetween(_UNB, -1)
    allk = allk.withColumn("__w_carry", F.last("__w_lastv", ignorenulls=True).over(ws)).drop("__w_lastv")
    d = d.join(allk, [*group, chunk], "left")
    return d.withColumn(out, F.coalesce("__w_loc", "__w_carry")).drop("__w_loc", "__w_carry")


def chunked_frame_list(df: DataFrame, group: list[str], order: str, chunk: str, fields: list[str], n: int,
                       out: str, include_current: bool = True) -> DataFrame:
    """``out`` = the last ``n`` ``struct(fields)`` of the group up to the row
    (including it, or only the rows before it), like ``collect_list`` over a
    ``rows between n-1 preceding and current row`` frame, but with partitions
    per (group, chunk).  The entries a chunk needs from before its start are
    the tails (<= n entries) of up to n earlier chunks, carried by a window
    over the per-chunk summary, so sparse or empty chunks are exact too."""
    m = n if include_current else n + 1
    item = F.struct(F.col(order).alias("__o"), *[F.col(f) for f in fields])
    wl = Window.partitionBy(*group, chunk).orderBy(order).rowsBetween(-(m - 1), 0)
    d = _once(df.withColumn("__w_loc", F.collect_list(item).over(wl)))
    # tail of every chunk: its last m - 1 items (bounded)
    rk = Window.partitionBy(*group, chunk).orderBy(F.col(order).desc())
    tails = (d.withColumn("__w_rk", F.row_number().over(rk)).where(F.col("__w_rk") <= m - 1)
             .groupBy(*group, chunk).agg(F.array_sort(F.collect_list(item)).alias("__w_tail")))
    ws = Window.partitionBy(*group).orderBy(chunk).rowsBetween(-(m - 1), -1)
    tails = tails.withColumn("__w_prev", F.flatten(F.collect_list("__w_tail").over(ws))).drop("__w_tail")
    d = d.join(tails, [*group, chunk], "left")
    full = F.concat(F.coalesce("__w_prev", F.array().cast(d.schema["__w_loc"].dataType)), F.col("__w_loc"))
    last = F.slice(full, F.greatest(F.lit(1), F.size(full) - m + 1), m)
    if not include_current:
        last = F.slice(last, 1, F.size(last) - 1)
        last = F.slice(last, F.greatest(F.lit(1), F.size(last) - n + 1), n)
    strip = F.transform(last, lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    return d.withColumn(out, strip).drop("__w_loc", "__w_prev")


def adaptive_chunk(df: DataFrame, group: list[str], ts: str, out: str = "_chunk", base_s: int = 3600,
                   fine_s: int = 60, max_rows: int = 1_000_000) -> DataFrame:
    """Chunk key for the chunked windows: the start of the row's ``base_s``
    period, or of its ``fine_s`` period inside periods where one group has
    more than ``max_rows`` rows (a burst concentrated in one hour).  Keys are
    in seconds, so they stay monotone in ``ts`` within a group.  The heavy
    (group, period) list has at most ``rows / max_rows`` entries; it grows
    with the data, so the join is a plain one and AQE broadcasts it only after
    measuring its size."""
    base = F.col(ts) - F.pmod(F.col(ts), F.lit(base_s))
    heavy = (df.groupBy(*group, base.alias("__w_base")).agg(F.count(F.lit(1)).alias("__w_n"))
             .where(F.col("__w_n") > max_rows).select(*group, "__w_base", F.lit(True).alias("__w_heavy")))
    d = df.withColumn("__w_base", base).join(heavy, [*group, "__w_base"], "left")
    fine = F.col(ts) - F.pmod(F.col(ts), F.lit(fine_s))
    return (d.withColumn(out, F.when(F.col("__w_heavy"), fine).otherwise(F.col("__w_base")).cast("long"))
            .drop("__w_base", "__w_heavy"))
