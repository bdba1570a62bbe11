"""Positions within groups without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``keys``, null equal to null; each key column once."""
    right = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(right, on).drop(*(f"__{k}" for k in keys))


def ranked(stored: DataFrame, group: list[str], order: list[Column], folder: str) -> tuple[DataFrame, DataFrame]:
    """(rows, blocks) of a stored table.

    The rows are dealt by ranges of (group, order), so a large group spreads
    over many tasks, and written to ``folder`` with their range ``_block`` and
    their place ``_i`` in it.  A block is one group's part of one range:
    (group, _block, first, base, n) with its first place, the rows of the
    group in earlier ranges and the rows of the whole group.  There are at most
    as many blocks as ranges and groups.  Rows that agree in group and order
    share a range unless ``order`` ends in something that tells them apart.
    """
    keys = [F.col(g).asc_nulls_first() for g in group] + order
    place = F.monotonically_increasing_id()
    (stored.repartitionByRange(*keys).sortWithinPartitions(*keys)
     .select("*", F.shiftright(place, 33).alias("_block"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("_i"))
     .write.mode("overwrite").parquet(folder))
    rows = stored.sparkSession.read.parquet(folder)
    per = rows.groupBy(*group, "_block").agg(F.min("_i").alias("first"), F.count(F.lit(1)).alias("in_block"))
    of = Window.partitionBy(*group)
    blocks = per.select(*group, "_block", "first",
                        (F.sum("in_block").over(of.orderBy("_block")) - F.col("in_block")).alias("base"),
                        F.sum("in_block").over(of).alias("n"))
    return rows, blocks


def placed(rows: DataFrame, blocks: DataFrame, group: list[str], idx: str = "idx") -> DataFrame:
    """The rows with their position in the group (from 0) and every further
    column of ``blocks``."""
    return (join_null_safe(rows, blocks, [*group, "_block"]).withColumn(idx, F.col("base") + F.col("_i") - F.col("first"))
            .drop("_block", "_i", "base", "first"))
