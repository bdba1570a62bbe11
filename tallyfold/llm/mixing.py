"""Mixing sources to target weights by entropy balancing.

Every document gets a rate w (how often the mix takes it).  Among all rates in
[0, 3] that give each source its target number of words, entropy balancing
takes those closest to 1 in relative entropy: w = min(3, exp(lambda_s * x)),
with x the document's words over the source's longest.  The multipliers are
the solution of a convex dual whose gradient is, per source, the words taken
less the target; the dual separates by source, so its Newton step is one
grouped aggregate over all sources.  A step that leaves the bracket of the root
is replaced by the bracket's middle.

A rate depends on (source, size) alone, so the aggregates run over the
histogram of sizes, and multipliers, brackets and targets are tables with one
row per source; the driver sees one number per round.  Sums run over scaled
integers, so that reruns agree to the bit.

Rounding: class (source, size) of n documents and rate w wants n*w copies.
Copies are rounded along the running sum of the fractions from long to short,
which leaves a source off by less than its longest document; the rest is then
repaired in a few rounds, each giving or taking copies of the longest size
that still fits.  Inside a class the copies go round by position in the order
of a hash of the id.

Sizes: words `[^\\x20\\x09-\\x0D]+` (null text: 0).  A source without words has
target 0.  Null is a source of its own, the last.  Null doc_ids and repeated
rows are documents of their own.  Documents without words take 0.  Extra
columns are ignored.  An empty table gives no row.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import join_null_safe, placed, ranked
from .text import blobs

CAP = 3  # most copies of a document
WEIGHTS = (5, 2, 1)  # fixed values, by position of the source
ROUNDS = 60  # Newton rounds at most; the bracket alone halves 60 times
REPAIRS = 12
UNIT = 1 << 20  # scaled integers of the sums


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size) of every row."""
    schema = "doc_id long, source string, size long"

    def run(batches):
        for batch in batches:
            n = [int(x) for _, _, b in blobs(batch.column(2)) for x in b.n_words]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "size"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text").mapInArrow(run, schema)


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def targets(sources: DataFrame, folder: str, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(s, source, source_size, longest, target) of (source, source_size,
    longest): all words shared by weight, no source above ``cap`` times its
    size.  Each round shares what the capped sources leave among the others."""
    one = sources.withColumn("all", F.lit(0).cast("long"))
    rows, blocks = ranked(_stored(one, f"{folder}/sources"), ["all"], [F.col("source").asc_nulls_last()], f"{folder}/ranked-sources")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod("s", F.lit(len(weights))) + 1).cast("int"))
    t = _stored(placed(rows, blocks, ["all"], "s").withColumn("weight", weight)
                .select("s", "source", "source_size", "longest", "weight", (F.lit(cap) * F.col("source_size")).alias("most")),
                f"{folder}/weights")
    share, capped = None, -1
    while True:
        full = F.lit(False) if share is None else F.col("most") <= F.col("weight") * F.lit(share)
        r = t.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("most")).otherwise(0)).alias("given"),
                  F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("weight"), F.sum(full.cast("int")).alias("capped")).first()
        if r["capped"] == capped or not r["weight"]:
            break
        capped, share = r["capped"], (r["all"] - r["given"]) / r["weight"]
    return t.select("s", "source", "source_size", "longest",
                    F.least(F.col("most").cast("double"), F.col("weight") * F.lit(float(share or 0))).alias("target"))


def _rate(lam: Column, cap: int) -> Column:
    """exp(lambda * x), at most ``cap``."""
    tilt = lam * F.col("size") / F.col("longest")
    return F.when(tilt >= F.log(F.lit(float(cap))), F.lit(float(cap))).otherwise(F.exp(tilt))


def _sum(c: Column) -> Column:
    """Exact sum of scaled integers: no order of addition changes it."""
    return F.sum(F.round(c * F.lit(float(UNIT))).cast("decimal(38,0)")).cast("double") / F.lit(float(UNIT))


def balance(histogram: DataFrame, goal: DataFrame, folder: str, cap: int = CAP) -> DataFrame:
    """(s, lambda): the multiplier of every source from the histogram
    (s, size, docs) and (s, source_size, longest, target).  Sources at the cap
    have lambda infinite; sources without words 0."""
    state = goal.where("source_size > 0").select(
        "s", "longest", "target", F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"),
        (F.col("target") >= F.lit(cap) * F.col("source_size")).alias("done"))
    state = state.withColumn("lam", F.when(F.col("done"), F.lit(float("inf"))).otherwise(F.col("lam")))
    state = _stored(state, f"{folder}/dual0")
    for k in range(1, ROUNDS + 1):
        if state.where("not done").isEmpty():
            break
        open_ = state.where("not done")
        x, w = F.col("size") / F.col("longest"), _rate(F.col("lam"), cap)
        slope = F.when(w < cap, F.col("docs") * F.col("size") * x * w).otherwise(0.0)
        step = histogram.where("size > 0").join(open_, "s").groupBy("s").agg(
            _sum(F.col("docs") * F.col("size") * w).alias("words"), _sum(slope).alias("slope"))
        gap = F.col("words") - F.col("target")
        lo = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - gap / F.col("slope")
        # Past the bracket (or where no document can move): its middle, or a
        # step outwards while one side is still open.
        out = F.when(F.col("lo").isNull(), F.least(F.lit(-1.0), 2 * F.col("hi"))) \
            .when(F.col("hi").isNull(), F.greatest(F.lit(1.0), 2 * F.col("lo"))).otherwise((F.col("lo") + F.col("hi")) / 2)
        fits = (F.col("slope") > 0) & (F.col("lo").isNull() | (newton > F.col("lo"))) & (F.col("hi").isNull() | (newton < F.col("hi"))) \
            & (F.abs(newton - F.col("lam")) <= 4 + 4 * F.abs("lam"))
        near = F.abs(gap) <= F.greatest(F.lit(1e-3), F.col("target") * 1e-9)
        stuck = (F.col("hi") - F.col("lo")) <= 1e-13 * F.greatest(F.lit(1.0), F.abs("hi"))
        moved = state.join(step, "s", "left").withColumns({"lo": F.when(F.col("done"), F.col("lo")).otherwise(lo),
                                                           "hi": F.when(F.col("done"), F.col("hi")).otherwise(hi)})
        end = F.col("done") | near | F.coalesce(stuck, F.lit(False))
        state = _stored(moved.select("s", "longest", "target", F.when(end, F.col("lam")).when(fits, newton).otherwise(out).alias("lam"),
                                     "lo", "hi", end.alias("done")), f"{folder}/dual{k}")
    return state.select("s", F.col("lam").alias("lambda"))


def copies(histogram: DataFrame, goal: DataFrame, dual: DataFrame, folder: str, cap: int = CAP) -> DataFrame:
    """(s, size, docs, copies): whole copies of every class."""
    c = histogram.join(goal.select("s", "longest", "target"), "s").join(dual, "s", "left")
    want = F.col("docs") * _rate(F.coalesce("lambda", F.lit(0.0)), cap)
    c = c.select("s", "size", "docs", F.round(F.when(F.col("size") == 0, F.lit(0.0)).otherwise(want), 9).alias("want"))
    c = c.withColumns({"copies": F.floor("want"), "part": F.round((F.col("want") - F.floor("want")) * UNIT).cast("long")})
    rows, blocks = ranked(_stored(c, f"{folder}/want"), ["s"], [F.col("size").desc()], f"{folder}/ranked-want")
    # Running sum of the fractions: inside a range, plus the ranges before it.
    before = rows.groupBy("s", "_block").agg(F.sum("part").alias("sum"))
    before = before.select("s", "_block", (F.sum("sum").over(Window.partitionBy("s").orderBy("_block")) - F.col("sum")).alias("carry"))
    local = F.sum("part").over(Window.partitionBy("s", "_block").orderBy("_i"))
    run = rows.withColumn("local", local).join(before, ["s", "_block"]).withColumn("upto", F.col("carry") + F.col("local"))
    half = F.lit(UNIT // 2)
    more = F.floor((F.col("upto") + half) / UNIT) - F.floor((F.col("upto") - F.col("part") + half) / UNIT)
    c = _stored(run.select("s", "size", "docs", F.least(F.col("copies") + more, cap * F.col("docs")).cast("long").alias("copies")), f"{folder}/copies0")
    for k in range(1, REPAIRS + 1):
        # The longest size that fits into what a source lacks (or has too much).
        off = c.groupBy("s").agg(F.sum(F.col("copies") * F.col("size")).alias("taken")).join(goal.select("s", "target"), "s") \
            .select("s", F.round(F.col("target") - F.col("taken")).cast("long").alias("off")).where("off != 0")
        room = F.when(F.col("off") > 0, cap * F.col("docs") - F.col("copies")).otherwise(F.col("copies"))
        times = F.least(room, F.floor(F.abs("off") / F.col("size")))
        pick = c.where("size > 0").join(off, "s").withColumn("times", times).where("times > 0").groupBy("s").agg(
            F.max(F.struct("size", (F.signum("off") * F.col("times")).cast("long").alias("give"))).alias("x")).select("s", "x.size", "x.give")
        pick = _stored(pick, f"{folder}/repair{k}")
        if pick.isEmpty():
            break
        c = _stored(c.join(pick, ["s", "size"], "left").select("s", "size", "docs", (F.col("copies") + F.coalesce("give", F.lit(0))).alias("copies")),
                    f"{folder}/copies{k}")
    return c


def mix(docs: DataFrame, folder: str, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, source) of every row;
    ``copies`` says how often the mix repeats it."""
    each = _stored(sizes(docs), f"{folder}/sizes")
    histogram = _stored(each.groupBy("source", "size").agg(F.count(F.lit(1)).alias("docs")), f"{folder}/by-source")
    goal = _stored(targets(histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"), F.max("size").alias("longest")),
                           folder, weights, cap), f"{folder}/targets")
    h = _stored(join_null_safe(histogram, goal.select("s", "source"), ["source"]).select("s", "size", "docs"), f"{folder}/histogram")
    c = copies(h, goal, balance(h, goal, folder, cap), folder, cap)
    # Positions inside a class: ranges of (source, size, hash), so that a class
    # of any size spreads; the place in the files spreads repeated rows.
    order = [F.xxhash64(F.coalesce("doc_id", F.lit(0))), F.col("doc_id").asc_nulls_first(), F.col("place").asc()]
    rows, blocks = ranked(each.withColumn("place", F.monotonically_increasing_id()), ["source", "size"], order, f"{folder}/ranked")
    classes = c.join(goal.select("s", "source", "source_size", "target"), "s").drop("s", "docs")
    out = placed(rows, join_null_safe(blocks, classes, ["source", "size"]), ["source", "size"])
    each_gets = F.floor(F.col("copies") / F.col("n")) + (F.col("idx") < F.pmod("copies", F.col("n"))).cast("long")
    return out.select("doc_id", "size", "source_size", "target", (each_gets * F.col("size")).cast("long").alias("taken"),
                      each_gets.cast("long").alias("copies"), "source")
