"""Connected components as Spark joins (alternating large and small stars)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ROUNDS = 60


def connected(edges: DataFrame, folder: str) -> DataFrame:
    """(x, y) links -> (id, root): every node that is not its component's least
    id, with that id.

    Large star: every node links its greater neighbours to its least one.
    Small star: it links its lesser neighbours to its least one.  Both are
    grouped minima and joins, so a hub is a key of an aggregate and never a
    collected list.  Each round is written to ``folder`` (shared storage).
    Converges in O(log n) rounds; raises if it does not within MAX_ROUNDS."""
    spark = edges.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    # u > v in every stored edge
    e = stored(edges.where("x != y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "0")
    last = None
    for i in range(1, MAX_ROUNDS + 1):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u != v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u")
                 .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")),
                                           F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p"))
                 .select("p.u", "p.v").where("u != v").distinct())
        e = stored(small, str(i))
        got = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if got == last:
            return e.select(F.col("u").alias("id"), F.col("v").alias("root"))
        last = got
    raise RuntimeError("connected components did not converge")


def relabel(classes: DataFrame, groups: DataFrame) -> DataFrame:
    """(id, class) with every class replaced by its component's root."""
    return classes.join(groups.select(F.col("id").alias("class"), "root"), "class", "left").select(
        "id", F.coalesce("root", "class").alias("class"))
