"""ABC/XYZ assortment analytics.

ABC needs a cumulative share over all SKUs in revenue order: done as a
distributed prefix sum (range partitioning, per-partition sums, offsets
from a summary with one row per partition), never a single-task window.
XYZ needs the coefficient of variation over a dense SKU x period grid: the
zeros are accounted for analytically (sum and sum of squares over the
periods present, divided by the number of periods), so no grid is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import _once
from ..session import ensure_checkpoint_dir
from ..sources.reference_data import ABC_XYZ_POLICY

_UNB = Window.unboundedPreceding


# X1 -------------------------------------------------------------------------
def revenue_matrix(sales: DataFrame, periods: list[int]) -> DataFrame:
    """Long form SKU x period revenue, densified with zeros over ``periods``.
    Each SKU row is expanded with the literal period list (no join)."""
    agg = sales.groupBy("sku", "period").agg(F.sum("revenue").alias("revenue"))
    skus = sales.select("sku").distinct().withColumn("period", F.explode(F.array(*[F.lit(p) for p in periods])))
    return (skus.join(agg, ["sku", "period"], "left")
            .withColumn("revenue", F.coalesce("revenue", F.lit(0)).cast("long")))


def revenue_pivot(matrix: DataFrame, periods: list[int]) -> DataFrame:
    return matrix.groupBy("sku").pivot("period", periods).agg(F.first("revenue"))


# X2 -------------------------------------------------------------------------
def _parts(df: DataFrame, nparts: int | None) -> int:
    """Range partitions for a prefix sum: the session's shuffle partition
    count unless given (so it grows with the cluster)."""
    return nparts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def cumulative_before(df: DataFrame, value: str, order: list[Column], nparts: int | None = None) -> DataFrame:
    """Add ``cum_before`` (sum of ``value`` over all earlier rows in ``order``)
    and ``total``.  The offsets table has one row per range partition, so its
    broadcast is bounded by the partition count.

    The rows are read twice (local sums and offsets).  Range bounds come from
    a sample, and two shuffles of different columns may sample differently, so
    the partitioned rows are written once to the shared checkpoint folder and
    both readers see the same partition numbers, whatever columns follow."""
    ensure_checkpoint_dir(df.sparkSession)
    r = df.repartitionByRange(_parts(df, nparts), *order).withColumn("_pid", F.spark_partition_id()).checkpoint()
    wl = Window.partitionBy("_pid").orderBy(*order).rowsBetween(_UNB, -1)
    r = r.withColumn("_loc", F.coalesce(F.sum(value).over(wl), F.lit(0)))
    summ = r.groupBy("_pid").agg(F.sum(value).alias("_pt"))
    ws = Window.orderBy("_pid")
    summ = summ.select("_pid",
                       F.coalesce(F.sum("_pt").over(ws.rowsBetween(_UNB, -1)), F.lit(0)).alias("_off"),
                       F.sum("_pt").over(Window.partitionBy(F.lit(1))).alias("total"))
    r = r.join(F.broadcast(summ), "_pid")
    return r.withColumn("cum_before", (F.col("_loc") + F.col("_off")).cast("long")).drop("_pid", "_loc", "_off")


def abc_classes(sku_rev: DataFrame, a: int = 80, b: int = 95, nparts: int | None = None) -> DataFrame:
    """A while the share before the SKU is < a %, B while < b %, else C
    (the SKU crossing a boundary stays in the upper class); ties by sku."""
    c = cumulative_before(sku_rev, "revenue", [F.col("revenue").desc(), F.col("sku").asc()], nparts)
    cls = (F.when(F.col("cum_before") * 100 < F.col("total") * a, "A")
           .when(F.col("cum_before") * 100 < F.col("total") * b, "B").otherwise("C"))
    return c.withColumn("abc", cls).drop("total")


# X3 -------------------------------------------------------------------------
def xyz_classes(sales: DataFrame, n_periods: int, x: float = 10.0, y: float = 25.0) -> DataFrame:
    """CV = population sigma / mean * 100 over ``n_periods`` periods, absent
    periods counting as zero.  X < 10 <= Y <= 25 < Z; zero mean -> Z."""
    per = sales.groupBy("sku", "period").agg(F.sum("revenue").alias("r"))
    agg = per.groupBy("sku").agg(F.sum("r").alias("_s"), F.sum(F.col("r").cast("double") ** 2).alias("_ss"))
    mean = F.col("_s") / F.lit(float(n_periods))
    var = F.greatest(F.lit(0.0), F.col("_ss") / F.lit(float(n_periods)) - mean * mean)
    cv = F.when(mean > 0, F.sqrt(var) / mean * 100)
    return agg.select("sku", F.round(cv, 4).alias("cv"),
                      F.when(cv.isNull(), "Z").when(cv < x, "X").when(cv <= y, "Y").otherwise("Z").alias("xyz"))


# X4 -------------------------------------------------------------------------
def abc_xyz_matrix(classes: DataFrame, spark) -> DataFrame:
    """Nine classes (empty ones included): SKU count, revenue share, mean
    margin where present, recommendation code."""
    pol = spark.createDataFrame(ABC_XYZ_POLICY, "abc_xyz string, recommendation string")
    tot = classes.agg(F.sum("revenue").alias("_t"))
    g = (classes.withColumn("abc_xyz", F.concat("abc", "xyz")).groupBy("abc_xyz")
         .agg(F.count(F.lit(1)).alias("skus"), F.sum("revenue").alias("_rev"),
              F.avg("unit_margin").alias("mean_margin")))
    # the total is one row: attach it by a constant key (no Cartesian product)
    g = g.withColumn("_k", F.lit(1)).join(F.broadcast(tot.withColumn("_k", F.lit(1))), "_k").drop("_k")
    return (F.broadcast(pol).join(g, "abc_xyz", "left")
            .select("abc_xyz", F.coalesce("skus", F.lit(0)).cast("long").alias("skus"),
                    F.round(F.coalesce(F.col("_rev") / F.col("_t"), F.lit(0.0)), 4).alias("revenue_share"),
                    F.round("mean_margin", 4).alias("mean_margin"), "recommendation"))


# X5 -------------------------------------------------------------------------
def abc_xyz_shortlists(classes: DataFrame, k: int = 10) -> DataFrame:
    """Top-k AX by revenue and top-k CZ exit candidates (lowest revenue).

    Each list is a distributed top-k (``orderBy().limit()`` plans as
    TakeOrderedAndProject: k rows per partition, then a k-row merge), not a
    window over a whole class."""
    c = classes.withColumn("abc_xyz", F.concat("abc", "xyz"))
    ax = c.where(F.col("abc_xyz") == "AX").orderBy(F.desc("revenue"), "sku").limit(k)
    cz = c.where(F.col("abc_xyz") == "CZ").orderBy(F.asc("revenue"), "sku").limit(k)
    order = F.when(F.col("abc_xyz") == "AX", -F.col("revenue")).otherwise(F.col("revenue"))
    w = Window.partitionBy("abc_xyz").orderBy(order, F.col("sku"))  # over at most 2k rows
    return ax.unionByName(cz).withColumn("rank", F.row_number().over(w)) \
        .select("abc_xyz", "rank", "sku", "revenue")


# X6 -------------------------------------------------------------------------
def category_growth(classes: DataFrame) -> DataFrame:
    """Per category: share of A-class SKUs and of revenue in A; ranked."""
    g = classes.groupBy("category").agg(
        F.count(F.lit(1)).alias("skus"),
        F.count(F.when(F.col("abc") == "A", 1)).alias("a_skus"),
        F.sum("revenue").alias("revenue"),
        F.sum(F.when(F.col("abc") == "A", F.col("revenue")).otherwise(0)).alias("a_revenue"))
    g = g.withColumn("a_sku_share", F.round(F.col("a_skus") / F.col("skus"), 4)) \
        .withColumn("a_revenue_share", F.round(F.col("a_revenue") / F.col("revenue"), 4))
    return g.withColumn("growth_rank", F.rank().over(Window.orderBy(F.desc("a_revenue_share"), F.desc("a_sku_share"),
                                                                   "category")))


# X7 -------------------------------------------------------------------------
def assortment_guards(sales: DataFrame, min_skus: int = 30, min_periods: int = 6,
                      per_category_at: int = 1000) -> DataFrame:
    """Guards over ``sales (sku, period, ...)``; both counts come from the data."""
    n = sales.agg(F.count_distinct("sku").alias("skus"), F.count_distinct("period").cast("int").alias("periods"))
    return n.select("skus", "periods",
                    (F.col("skus") <= min_skus).alias("refuse"),
                    (F.col("periods") < min_periods).alias("abc_only"),
                    (F.col("skus") >= per_category_at).alias("per_category"))


def abc_classes_by(sku_rev: DataFrame, group: str, a: int = 80, b: int = 95, nparts: int | None = None) -> DataFrame:
    """ABC inside each ``group`` (e.g. category, for assortments of 1000+
    SKUs): the same distributed prefix sum, range-partitioned on (group,
    revenue desc, sku); the carry table has one row per (partition, group)
    that spans it, and its join is left to Catalyst/AQE (its size depends on
    the number of groups, so it is not forced into a broadcast)."""
    order = [F.col(group).asc(), F.col("revenue").desc(), F.col("sku").asc()]
    r = sku_rev.repartitionByRange(_parts(sku_rev, nparts), *order).withColumn("_pid", F.spark_partition_id())
    wl = Window.partitionBy("_pid", group).orderBy(F.col("revenue").desc(), F.col("sku").asc()) \
        .rowsBetween(_UNB, -1)
    r = _once(r.withColumn("_loc", F.coalesce(F.sum("revenue").over(wl), F.lit(0))))
    summ = r.groupBy("_pid", group).agg(F.sum("revenue").alias("_pt"))
    ws = Window.partitionBy(group).orderBy("_pid")
    summ = summ.select("_pid", group,
                       F.coalesce(F.sum("_pt").over(ws.rowsBetween(_UNB, -1)), F.lit(0)).alias("_off"),
                       F.sum("_pt").over(Window.partitionBy(group)).alias("_total"))
    r = r.join(summ, ["_pid", group]).withColumn("cum_before", (F.col("_loc") + F.col("_off")).cast("long"))
    cls = (F.when(F.col("cum_before") * 100 < F.col("_total") * a, "A")
           .when(F.col("cum_before") * 100 < F.col("_total") * b, "B").otherwise("C"))
    return r.withColumn("abc", cls).drop("_pid", "_loc", "_off", "_total")
