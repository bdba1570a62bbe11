"""Purge of day folders: pruned plan, untouched files, reruns."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from tallyfold.operators import cohorts
from tallyfold.session import ensure_checkpoint_dir

DAY = 86400


def _files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


@pytest.fixture()
def table(spark):
    path = ensure_checkpoint_dir(spark).rstrip("/") + f"/purge-{uuid.uuid4().hex[:8]}"
    rows = spark.range(600).select((F.lit(100 * DAY) + F.col("id") * 3600).alias("ts"), F.col("id").alias("x"))
    cohorts.store_by_day(rows.unionByName(spark.createDataFrame([(None, -1)], "ts long, x long")), path, "ts")
    return path


def test_only_expired_days_are_read_and_touched(spark, table):
    cutoff = 110 * DAY + 6 * 3600
    before = _files(table)
    last = 19700421
    plan = cohorts.expired_rows(spark.read.parquet(table), "ts", cutoff, last)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and f"<= {last}" in plan.split("PartitionFilters")[1].split("]")[0]
    got = {r.day: r.deleted for r in cohorts.purge_days(spark, table, "ts", cutoff).collect()}
    assert len(got) == 11 and got[last] == 6 and all(n == 24 for d, n in got.items() if d != last)
    after = _files(table)
    kept = {f: t for f, t in before.items() if f"day={last}" not in f and f in after}
    assert len({f.split("day=")[1].split("/")[0] for f in kept}) == 15  # 14 later days, rows without a time
    assert all(after[f] == t for f, t in kept.items())
    rows = spark.read.parquet(table)
    assert rows.count() == 601 - 246 and rows.where(F.col("ts") < cutoff).count() == 0 and rows.where("ts is null").count() == 1
    assert cohorts.purge_days(spark, table, "ts", cutoff).count() == 0  # nothing is left to do
    assert _files(table) == after


def test_a_cutoff_at_midnight_rewrites_nothing(spark, table):
    before = _files(table)
    cohorts.purge_days(spark, table, "ts", 105 * DAY)
    after = _files(table)
    assert set(after) < set(before) and all(before[f] == t for f, t in after.items())
