"""One day's batch run composed from the operators, over the fixture views.

usage: python examples/daily_cycle.py <sf_dir> <out_dir> [as_of_epoch]
Writes parquet folders under out_dir: payments (callbacks folded in),
subscriptions (folded and expired), dashboard, nudges, usage.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from tallyfold.operators import billing, cohorts, telemetry  # noqa: E402
from tallyfold.session import get_session  # noqa: E402
from tallyfold.sources.callbacks import parse_payment_callbacks  # noqa: E402
from tallyfold.sources.fixtures import AS_OF, TEST_SECRET_A, TEST_SECRET_B, Fixtures  # noqa: E402
from tallyfold.sources.reference_data import llm_rates, payment_status_map  # noqa: E402


def main() -> None:
    sf_dir, out = sys.argv[1], sys.argv[2].rstrip("/")
    as_of = int(sys.argv[3]) if len(sys.argv) > 3 else AS_OF
    spark = get_session("local[8]", 16, app="daily-cycle")
    fx = Fixtures(spark, sf_dir)

    # S4 -> B2 -> B3: verified callbacks folded into the payment table
    events = parse_payment_callbacks(fx.callbacks(), fx.payments(), TEST_SECRET_A, TEST_SECRET_B)
    events = billing.normalize_payment_status(events.where(F.col("outcome") == "ok"), payment_status_map(spark))
    payments = billing.apply_payment_events(fx.payments(), events)
    payments.write.mode("overwrite").parquet(f"{out}/payments")

    # B4 + B7: subscription table at as_of
    subs = billing.subscription_state(fx.subscriptions(), as_of)
    subs.write.mode("overwrite").parquet(f"{out}/subscriptions")
    subs = spark.read.parquet(f"{out}/subscriptions")  # later steps read the written table

    # L1 + L2: invocation cost and daily usage; R7 dashboard; R13 nudges (empty ledger)
    inv = telemetry.invocation_cost(fx.invocations().where(F.col("created_at") <= as_of), llm_rates(spark))
    telemetry.agent_usage_daily(inv, as_of).write.mode("overwrite").parquet(f"{out}/usage")
    users = fx.users_active(as_of)
    cohorts.stats_dashboard(users, subs, spark.read.parquet(f"{out}/payments"), inv, as_of) \
        .write.mode("overwrite").parquet(f"{out}/dashboard")
    ledger = spark.createDataFrame([], "tg_user_id long, event string, sent_at long")
    cohorts.nudge_plan(cohorts.nudge_segments(users, subs, inv, as_of), ledger, as_of) \
        .write.mode("overwrite").parquet(f"{out}/nudges")
    print({name: spark.read.parquet(f"{out}/{name}").count()
           for name in ("payments", "subscriptions", "usage", "dashboard", "nudges")})


if __name__ == "__main__":
    main()
