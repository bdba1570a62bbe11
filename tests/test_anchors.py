"""SURVEY §7.3 sanity anchors at sf0.01 (AS_OF 1995-06-01), reproduced
exactly; R10/R12 read the folded subscription table (the survey's 8-row R10
count is on raw intervals)."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from tallyfold.operators.telemetry import invocation_cost
from tallyfold.sources.fixtures import Fixtures
from tallyfold.sources.reference_data import llm_rates

SF = "/root/testdata/sf0.01"


def _counts(df, col):
    return {r[0]: r[1] for r in df.groupBy(col).agg(F.count(F.lit(1))).collect()}


def test_anchors(spark):
    q = E.queries()
    assert tuple(q["r3_revenue_window"](spark, SF).first()) == (3184297, 12600342)
    assert q["r4_dau"](spark, SF).first().dau == 56
    assert q["r1_active_users"](spark, SF).count() == 161
    assert q["r5_mau"](spark, SF).first().mau == 515
    assert tuple(q["r6_plan_holders_raw"](spark, SF).first()) == (52, 24)
    l2 = q["l2_agent_usage_daily"](spark, SF)
    assert l2.count() == 145 and l2.agg(F.sum("invocations")).first()[0] == 751
    l3 = q["l3_error_rate"](spark, SF).first()
    assert (l3.errors, l3.total_calls) == (16, 29)
    assert q["b9_multi_account_flags"](spark, SF).count() == 31
    assert q["r12_silent_payers"](spark, SF).count() == 42
    assert q["r11_sub_expiring_raw"](spark, SF).count() == 1
    assert _counts(q["a2_admission_decisions"](spark, SF), "reason") == {
        "allowed": 7072, "daily_quota": 1261, "flood": 583, "free_daily": 49, "free_minute": 1035}
    assert _counts(q["x2_abc_classes"](spark, SF), "abc") == {"A": 1469, "B": 375, "C": 156}
    e2 = {(r.mp, r.commission_source): r.skus for r in q["e2_commission_rate"](spark, SF).collect()}
    assert e2[("Ozon", "ozon_14")] == 196 and e2[("Ozon", "ozon_20")] == 311
    assert e2[("Ozon", "category")] + e2[("Ozon", "baseline_to_confirm")] == 493
    assert e2[("WB", "category")] + e2[("WB", "baseline_to_confirm")] == 1000
    c3 = q["c3_price_position"](spark, SF)
    assert c3.count() == 51731 and c3.where("other_league").count() == 6008
    cost = invocation_cost(Fixtures(spark, SF).invocations(), llm_rates(spark)) \
        .groupBy("provider").agg(F.sum("cost_usd_e4")).collect()
    assert {r[0]: r[1] for r in cost} == {"groq": 1810556, "openrouter": 3212980, "yandex": 1712477}
