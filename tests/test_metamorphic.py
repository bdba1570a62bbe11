"""Metamorphic: the shuffle-partition count (and hence row order inside
tasks) must not change any result."""

import pytest

import __spark_entry__ as E
from oracle_check import digest

SF = "/root/testdata/sf0.001"
KEYS = ["a2_admission_decisions", "b3_payment_state", "b6_subscription_as_of", "u5_agent_as_of",
        "x2_abc_classes", "v3_fake_series", "r13_nudge_plan"]


@pytest.mark.parametrize("name", KEYS)
def test_invariant_to_partitioning(spark, name):
    q = E.queries()[name]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    out = []
    try:
        for n in ("3", "17"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.catalog.clearCache()
            df = q(spark, SF)
            out.append(digest(df.columns, [tuple(r) for r in df.collect()])[0])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert out[0] == out[1]
