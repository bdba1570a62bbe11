"""Metamorphic: chunked windows equal plain windows for any chunking."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyfold.functions.windows import chunked_lag, chunked_last_non_null, chunked_lead, chunked_running


def test_chunked_equals_plain(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(3), i, rnd.randrange(1000), rnd.choice([None, rnd.randrange(50)])) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, id int, t int, v int")
    for size in (7, 100, 5000):
        d = df.withColumn("c", (F.col("t") / size).cast("int"))
        order = ["t", "id"]
        x = chunked_running(d, ["g"], order, "c", F.coalesce("v", F.lit(0)), "rs")
        x = chunked_lag(x, ["g"], order, "c", "t", "lg")
        x = chunked_lead(x, ["g"], order, "c", "t", "ld")
        x = chunked_last_non_null(x, ["g"], order, "c", "v", "ln")
        w = Window.partitionBy("g").orderBy(*order)
        ref = df.select("id", F.sum(F.coalesce("v", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("rs"),
                        F.lag("t").over(w).alias("lg"), F.lead("t").over(w).alias("ld"),
                        F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("ln"))
        got = sorted(tuple(r) for r in x.select("id", "rs", "lg", "ld", "ln").collect())
        assert got == sorted(tuple(r) for r in ref.collect())


def test_chunked_frame_list_equals_plain(spark):
    from tallyfold.functions.windows import chunked_frame_list

    rnd = random.Random(5)
    # sparse, irregular order keys so some chunks are short or empty
    rows = [(rnd.randrange(3), t, f"r{t % 3}", f"c{t}") for t in sorted(rnd.sample(range(500), 150))]
    df = spark.createDataFrame(rows, "g int, t int, role string, content string")
    for n, incl in [(4, True), (4, False), (8, True), (1, True)]:
        for size in (3, 10, 1000):
            d = df.withColumn("c", (F.col("t") / size).cast("int"))
            got = chunked_frame_list(d, ["g"], "t", "c", ["role", "content"], n, "ctx", include_current=incl)
            lo = -(n - 1) if incl else -n
            hi = 0 if incl else -1
            w = Window.partitionBy("g").orderBy("t").rowsBetween(lo, hi)
            ref = df.withColumn("ctx", F.collect_list(F.struct("role", "content")).over(w))
            a = sorted((r.g, r.t, tuple(tuple(x) for x in r.ctx)) for r in got.select("g", "t", "ctx").collect())
            b = sorted((r.g, r.t, tuple(tuple(x) for x in r.ctx)) for r in ref.select("g", "t", "ctx").collect())
            assert a == b, (n, incl, size)
