"""The cron cycle: runs across micro-batches, a crash inside a batch, a lost
checkpoint, and small cases of each job."""

import uuid

import pytest
from pyspark.sql import functions as F

from tallyfold.functions.time import epoch_s
from tallyfold.operators import cohorts
from tallyfold.plans.q_streaming import TICK_SHIFT, cron_sources
from tallyfold.session import ensure_checkpoint_dir
from tallyfold.sources.fixtures import Fixtures
from tallyfold.streaming import cron, jobs

SF = "/root/testdata/sf0.001"
DAY = 86400


def _folder(spark, name):
    return ensure_checkpoint_dir(spark).rstrip("/") + f"/test-{name}-{uuid.uuid4().hex[:8]}"


def _rows(df):
    return sorted((tuple(r) for r in df.drop("epoch").collect()), key=str)


def _landing(spark, parts):
    at = _folder(spark, "ticks")
    for i, p in enumerate(parts):
        p.coalesce(1).write.parquet(f"{at}/part={i}")
    return lambda: spark.readStream.schema("ts long, part int").option("maxFilesPerTrigger", 1).parquet(at).select("ts")


def test_a_crash_inside_a_batch_repeats_and_loses_nothing(spark):
    ev = Fixtures(spark, SF).t.events.select((epoch_s("ts") - TICK_SHIFT).alias("ts"))
    cuts = ev.select(F.percentile_approx("ts", [1 / 3, 2 / 3]).alias("q")).first()["q"]
    t = F.col("ts")
    ticks = _landing(spark, [ev.where(t < cuts[0]), ev.where((t >= cuts[0]) & (t < cuts[1])), ev.where(t >= cuts[1])])
    sources = [make() for make in cron_sources(spark, SF).values()]
    calls = {}

    def counted(job, fail_at=None):
        def run(r):
            calls[job.name] = calls.get(job.name, 0) + 1
            if calls[job.name] == fail_at:
                job.run(r).write.parquet(f"{root}/rows/{job.name}/epoch=1")  # rows without a commit
                raise RuntimeError("killed")
            return job.run(r)
        return cron.Job(job.name, run, job.daily)

    root = _folder(spark, "cycle")
    with pytest.raises(Exception, match="killed"):
        cron.run_cycle(spark, ticks(), [counted(j, 2 if j.name == "message_purge" else None) for j in sources], root)
    ledger = cron.CommitLedger(spark, root)
    assert ledger.committed("payment_recheck", 1) and not ledger.committed("message_purge", 1)
    done_before = dict(calls)
    cron.run_cycle(spark, ticks(), [counted(j) for j in sources], root)
    assert calls["payment_recheck"] == 3 and done_before["payment_recheck"] == 2  # batch 1 was not repeated
    whole = cron.run_cycle(spark, ev_stream(spark), sources, _folder(spark, "whole"))
    for job in sources:
        want = _rows(whole.rows(job.name))
        assert want and _rows(ledger.rows(job.name)) == want, job.name
    # a new stream without the checkpoint fires every tick again: nothing is added
    cron.run_cycle(spark, ticks(), sources, root, new_stream=True)
    for job in sources:
        assert _rows(ledger.rows(job.name)) == _rows(whole.rows(job.name)), job.name


def ev_stream(spark):
    return jobs.stream_table(spark, SF, "events").select((epoch_s("ts") - TICK_SHIFT).alias("ts"))


def _run(spark, job, *batches):
    """Rows of a job over batches of firing times."""
    ticks = _landing(spark, [spark.createDataFrame([(x,) for x in b], "ts long") for b in batches])
    rows = cron.run_cycle(spark, ticks(), [job], _folder(spark, "job")).rows(job.name)
    return _rows(rows)


def test_retry_chains(spark):
    item = '{"user_id":1,"chat_id":1,"agent_id":"a","attempts":%d,"enqueued_at":0}'
    queue = spark.createDataFrame([("ok", item % 0, 10), ("late", item % 0, 10), ("dead", item % 1, 310), ("bad", "{", 300), ("old", item % 0, -4000),
                                   ("gap", item % 0, 700), ("null", None, 20)], "key string, raw string, put_at long")
    outcomes = spark.createDataFrame([("ok", 0, True), ("late", 2, True), ("late", 0, False), ("gap", 1, True)], "key string, attempt int, ok boolean")
    got = _run(spark, cron.retry_drain(queue, outcomes), [300, 600], [900, 900 + 3600, 5000], [4800])
    short = [(r[0], r[1], r[5], r[6]) for r in got]
    assert sorted(short) == sorted([
        (300, "ok", "retried_ok", 0), (300, "late", "requeue", 1), (600, "late", "requeue", 2), (900, "late", "retried_ok", 2),
        (600, "dead", "requeue", 2), (900, "dead", "give_up", 3), (300, "bad", "drop_malformed", None), (300, "null", "drop_malformed", None),
        (900, "gap", "requeue", 1)])  # the next firing comes an hour later: expired


def test_daily_jobs_run_once_per_date(spark):
    d0 = 100 * DAY
    subs = spark.createDataFrame([
        (1, 7, "pro", d0 - 40 * DAY, d0 - 10, None), (2, 8, "pro", d0 - 40 * DAY, d0 - 10, d0 - 20), (3, 9, "pro", d0, d0 + DAY, None),
        (4, 9, "pro", d0 - 5, d0 + DAY - 1, None)], "payment_id long, tg_user_id long, plan string, started_at long, expires_at long, closed_at long")
    firings = [d0, d0 + 300], [d0 + 300, d0 + 3600, d0 + DAY + 300], [d0 + DAY, d0 + 2 * DAY + 900, d0 + 3 * DAY]
    got = _run(spark, cron.subscription_expiry(subs), *firings)
    # an hour later and 00:15 are no daily firings; d0 + DAY arrives late and is ignored
    assert [(r[0], r[1]) for r in got] == [(d0, 1), (d0 + DAY + 300, 3), (d0 + DAY + 300, 4)]
    messages = spark.createDataFrame([(d0 - 30 * DAY - 1,), (d0 - 30 * DAY,), (d0 - 29 * DAY,), (d0 + 10,), (d0 + 5 * DAY,)], "created_at long")
    got = _run(spark, cron.message_purge(messages), *firings)
    assert [(r[0] - d0, r[2], r[3]) for r in got] == [(0, 1, 2), (DAY + 300, 2, 1), (3 * DAY, 0, 1)]


def test_nudges_equal_the_single_run_cohorts(spark):
    """At one run the set of nudges is that of the single-run operators."""
    from tallyfold.operators import billing
    fx = Fixtures(spark, SF)
    users, inv = fx.users(), fx.invocations().select("tg_user_id", "agent_id", "created_at")
    subs = billing.activate_subscriptions(fx.subscriptions(), 2 ** 40)
    for at in (801964800, 801964800 + 200 * DAY):
        slots = spark.createDataFrame([(at,)], "slot long")
        got = cohorts.send_once(cron.nudge_candidates(users, subs, inv, slots), None)
        state = billing.subscription_state(fx.subscriptions(), at)
        none = spark.createDataFrame([], "tg_user_id long, event string, sent_at long")
        want = cohorts.nudge_plan(cohorts.nudge_segments(users, state, inv.where(F.col("created_at") <= at), at), none, at)
        cols = ["tg_user_id", "event", "params"]
        assert _rows(got.select(*cols)) == _rows(want.select(*cols))
        facts = cohorts.nudge_facts(users, subs, inv, [at - DAY, at])  # one fact row per user, two dates
        plan = facts._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [l_orderkey") == 1  # invocations are scanned once
        rules = cohorts.nudge_rules(facts, [at - DAY, at]).where(F.col("slot") == at)
        assert _rows(rules.groupBy("tg_user_id", "event").agg(F.min("params").alias("params")).select(*cols)) == _rows(want.select(*cols))


def test_send_once_honours_the_ttl(spark):
    cand = spark.createDataFrame([(100 * DAY, 1, "e", "b"), (100 * DAY, 1, "e", "a"), (101 * DAY, 1, "e", ""), (100 * DAY, 2, "e", "")],
                                 "slot long, tg_user_id long, event string, params string")
    sent = spark.createDataFrame([(39 * DAY, 1, "e"), (41 * DAY, 2, "e")], "slot long, tg_user_id long, event string")
    got = cohorts.send_once(cand, sent).collect()
    assert [tuple(r) for r in got] == [(100 * DAY, 1, "e", "a")]
