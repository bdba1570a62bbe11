"""Stream vs batch across several micro-batches: the keyed-state admission
stream continues from stored state and equals the batch decisions."""

import uuid

from pyspark.sql import functions as F

from tallyfold.functions.time import epoch_s
from tallyfold.operators import admission
from tallyfold.session import ensure_checkpoint_dir
from tallyfold.sources.fixtures import REQUEST_GAP_S, REQUEST_LIMITS, Fixtures
from tallyfold.streaming import jobs
from tallyfold.streaming.keyed_admission import Carry, fold, stream_admission

SF = "/root/testdata/sf0.001"


def test_admission_stream_over_three_batches_equals_batch(spark):
    fx = Fixtures(spark, SF)
    root = ensure_checkpoint_dir(spark).rstrip("/") + f"/test-t3-{uuid.uuid4().hex[:8]}"
    ev = fx.t.events
    # three files in time order: each becomes one micro-batch
    cuts = ev.select(F.percentile_approx(epoch_s("ts"), [1 / 3, 2 / 3]).alias("q")).first()["q"]
    t = epoch_s("ts")
    parts = [t < cuts[0], (t >= cuts[0]) & (t < cuts[1]), t >= cuts[1]]
    for i, cond in enumerate(parts):
        ev.where(cond).coalesce(1).write.parquet(f"{root}/landing/part={i}")
    u = F.col("user_id")
    stream = (spark.readStream.schema(ev.schema.add("part", "integer")).option("maxFilesPerTrigger", 1)
              .parquet(f"{root}/landing"))
    req = stream.select(F.col("event_id").alias("request_id"), u.alias("tg_user_id"),
                        F.col("event_type").alias("agent_id"), epoch_s("ts").alias("ts"),
                        F.when(u % 4 == 0, "free_trial").when(u % 4 == 1, "starter").when(u % 4 == 2, "pro")
                        .otherwise("business").alias("plan"))
    lim = {p: (f, dl, a) for p, f, dl, a in REQUEST_LIMITS}
    got = jobs.run_available_now(spark, stream_admission(req, lim, REQUEST_GAP_S), "t3test")
    want = admission.admission_decisions(fx.requests(), fx.request_limits(), gap=REQUEST_GAP_S)
    cols = ["request_id", "reason", "remaining"]
    assert sorted(tuple(r) for r in got.select(*cols).collect()) == sorted(tuple(r) for r in want.select(*cols).collect())


def _naive(rows, limits, gap_s):
    """Admission request by request, one user; rows in order."""
    last, burst, free, used, out = None, 0, {}, {}, []
    for r in rows:
        if r["plan"] is None:
            out.append(("no_active_plan", 0))
            continue
        if r["plan"] not in limits or r["agent_id"] is None:
            out.append(("unknown_plan" if r["plan"] not in limits else "no_agent", 0))
            continue
        flood, per_day, quota = limits[r["plan"]]
        burst = burst + 1 if last is not None and r["ts"] - last < gap_s else 1
        last, d = r["ts"], r["ts"] // 86400
        if burst > flood:
            out.append(("free_minute" if r["plan"] == "free_trial" else "flood", 0))
            continue
        if r["plan"] == "free_trial":
            free[d] = free.get(d, 0) + 1
            if per_day is not None and free[d] > per_day:
                out.append(("free_daily", 0))
                continue
        n = used.get((d, r["agent_id"]), 0) + 1
        if n > quota:
            out.append(("daily_quota", 0))
        else:
            used[d, r["agent_id"]] = n
            out.append(("allowed", quota - n))
    return out


def test_chunked_fold_equals_request_by_request():
    import random

    import pandas as pd
    limits = {"free_trial": (3, 4, 2), "pro": (5, None, 3), "business": (4, None, 1)}
    for seed in range(60):
        rnd = random.Random(seed)
        t, rows = 86400 * 100, []
        for i in range(rnd.randrange(1, 120)):
            t += rnd.choice([0, 1, 20, 60, 61, 400, 9000, 40000])
            rows.append({"request_id": i, "tg_user_id": 1, "agent_id": rnd.choice(["a", "b", "c", None] if seed % 3 else ["a"]), "ts": t,
                         "plan": rnd.choice(["free_trial", "pro", "business", "gold", None] if seed % 2 else ["free_trial"])})
        carry, got = Carry(), []
        step = rnd.randrange(1, 40)
        for i in range(0, len(rows), step):
            out = fold(pd.DataFrame(rows[i: i + step]).astype({"agent_id": object, "plan": object}), limits, 60, carry)
            got += list(zip(out["reason"], out["remaining"]))
        assert got == _naive(rows, limits, 60), seed


def test_idle_state_is_dropped_by_its_timer(spark):
    """Users idle for longer than ``idle_s`` behind the watermark leave no
    state; a user who returns later starts afresh."""
    root = ensure_checkpoint_dir(spark).rstrip("/") + f"/test-idle-{uuid.uuid4().hex[:8]}"
    t0 = 86400 * 100
    batches = [[(i, i, "a", t0 + i, "pro") for i in range(20)], [(100, 1, "a", t0 + 3 * 86400, "pro")], [(101, 1, "b", t0 + 3 * 86400 + 60, "pro")]]
    schema = "request_id long, tg_user_id long, agent_id string, ts long, plan string"
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(f"{root}/in/part={i}")
    stream = spark.readStream.schema(schema + ", part int").option("maxFilesPerTrigger", 1).parquet(f"{root}/in").drop("part")
    decided = stream_admission(stream, {"pro": (5, None, 3)}, 60, idle_s=86400)
    q = decided.writeStream.option("checkpointLocation", f"{root}/ckpt").trigger(availableNow=True).format("parquet").option("path", f"{root}/out").start()
    q.awaitTermination()
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(rows) >= 20 * 3 and rows[-1] < 10  # burst, quota day and a counter each; one user is left
    assert {r.remaining for r in spark.read.parquet(f"{root}/out").collect()} == {2}


def test_flood_session_stream_over_three_batches(spark):
    """Session windows across micro-batches equal the batch bursts that have
    closed before the final watermark (max event time - 1 day)."""
    fx = Fixtures(spark, SF)
    root = ensure_checkpoint_dir(spark).rstrip("/") + f"/test-t2-{uuid.uuid4().hex[:8]}"
    ev = fx.t.events
    cuts = ev.select(F.percentile_approx(epoch_s("ts"), [1 / 3, 2 / 3]).alias("q")).first()["q"]
    t = epoch_s("ts")
    for i, cond in enumerate([t < cuts[0], (t >= cuts[0]) & (t < cuts[1]), t >= cuts[1]]):
        ev.where(cond).coalesce(1).write.parquet(f"{root}/landing/part={i}")
    stream = (spark.readStream.schema(ev.schema.add("part", "integer")).option("maxFilesPerTrigger", 1)
              .parquet(f"{root}/landing"))
    req = stream.select(F.col("event_id").alias("request_id"), F.col("user_id").alias("tg_user_id"),
                        F.col("event_type").alias("agent_id"), epoch_s("ts").alias("ts"))
    got = jobs.run_available_now(spark, jobs.stream_flood_sessions(req, REQUEST_GAP_S), "t2test")
    batch = admission.flood_sessions(fx.requests(), gap=REQUEST_GAP_S)
    max_ts = fx.requests().agg(F.max("ts")).first()[0]
    want = batch.where(F.col("last_ts") + REQUEST_GAP_S <= max_ts - 86400)
    cols = ["tg_user_id", "start_ts", "last_ts", "requests"]
    assert sorted(tuple(r) for r in got.select(*cols).collect()) == sorted(tuple(r) for r in want.select(*cols).collect())


def test_kafka_source_is_gated(spark):
    import pytest

    with pytest.raises(RuntimeError, match="spark-sql-kafka"):
        jobs.kafka_raw(spark, "localhost:1", "updates")


def _payment_batches(spark, batches):
    """Transitions of (payments, callbacks) batches; a callback is (event_id,
    payment, raw status, ts)."""
    import base64
    import hashlib
    import hmac

    from tallyfold.sources.reference_data import payment_status_map
    from tallyfold.streaming import payments

    def signed(e, pid, raw, ts):
        body = '{"status":"%s","order_id":"%s"}' % (raw, pid)
        return e, "cryptocloud", body, ts, base64.b64encode(hmac.new(b"s", body.encode(), hashlib.sha256).digest()).decode()

    root = ensure_checkpoint_dir(spark).rstrip("/") + f"/test-t5-{uuid.uuid4().hex[:8]}"
    schema = "event_id long, provider string, body string, received_at long, signature string"
    out = []
    for i, (own, events) in enumerate(batches):
        spark.createDataFrame(own, "id long, status string").write.mode("append").parquet(f"{root}/payments")
        spark.createDataFrame([signed(*e) for e in events], schema).write.mode("append").parquet(f"{root}/callbacks")
        stream = payments.payment_transitions(spark.readStream.schema("id long, status string").parquet(f"{root}/payments"),
                                              spark.readStream.schema(schema).parquet(f"{root}/callbacks"), "a", "s", payment_status_map(spark))
        got = payments.run_transitions(spark, stream, root).collect()
        seen = {tuple(r) for rows in out for r in rows}
        out.append(sorted((r for r in got if tuple(r) not in seen), key=lambda r: r.payment_id))
    return [[(r.payment_id, r.status, r.finalized_at, r.event_id) for r in rows] for rows in out]


def test_payment_transitions_hold_only_changes(spark):
    got = _payment_batches(spark, [
        ([(1, "pending"), (2, "pending"), (3, "paid"), (4, "refunded"), (5, "pending")],
         [(10, 1, "expired", 100), (11, 2, "paid", 100), (12, 3, "cancel", 100), (13, 4, "expired", 100), (14, 9, "paid", 100), (15, 5, "created", 100)]),
        # redelivered and ignored events, a success after a failure, a payment that was unknown until now
        ([(9, "pending")], [(10, 1, "expired", 100), (20, 1, "paid", 200), (21, 2, "cancel", 200), (22, 4, "success", 200)]),
        ([], [(20, 1, "paid", 200), (30, 1, "cancel", 300), (31, 5, "fail", 50)]),
        ([], [(40, 5, "expired", 40)])])  # older than the failure that counts
    assert got == [[(1, "expired", 100, 10), (2, "paid", 100, 11)], [(1, "paid", 200, 20), (4, "paid", 200, 22), (9, "paid", 100, 14)],
                   [(5, "failed", 50, 31)], []]


def test_sketched_users_lie_within_the_error_bound(spark):
    from tallyfold.streaming import daily
    n = 60_000
    ev = spark.range(n).select(F.col("id").alias("tg_user_id"), F.lit("a").alias("agent_id"), F.lit(1).alias("input_tokens"),
                               F.lit(1).alias("output_tokens"), F.lit("success").alias("status"),
                               (F.lit(86400 * 100) + (F.col("id") % 40) * 86400 + F.col("id") % 1000).alias("created_at"))
    again = ev.where("tg_user_id % 3 = 0").withColumn("created_at", F.col("created_at") + 86400)  # users of two days count once
    root = ensure_checkpoint_dir(spark).rstrip("/") + f"/test-hll-{uuid.uuid4().hex[:8]}"
    ev.unionByName(again).write.parquet(root)
    days = jobs.run_available_now(spark, daily.daily_usage(spark.readStream.schema(ev.schema).parquet(root)), "hll")
    got = {r.date: r for r in daily.active_users(days).collect()}
    exact = ev.unionByName(again).select("tg_user_id", F.floor(F.col("created_at") / 86400).alias("d")).distinct()
    assert len(got) == 39  # the last day and the one before it are still open
    for offset in (0, 6, 20, 35):
        date = int(ev.select(F.date_format(F.timestamp_seconds(F.lit(86400 * (100 + offset))), "yyyyMMdd")).first()[0])
        for k in (1, 7, 30):
            true = exact.where(F.col("d").between(100 + offset - k + 1, 100 + offset)).select("tg_user_id").distinct().count()
            assert abs(got[date][f"users_{k}d"] - true) <= max(2, 4 * daily.RSE * true)


def test_payment_state_lies_on_disk_and_bodies_are_parsed_once(spark):
    import pathlib

    from tallyfold.operators.billing import normalize_payment_status
    from tallyfold.sources.callbacks import verify_callbacks
    from tallyfold.sources.reference_data import payment_status_map

    store = "spark.sql.streaming.stateStore.providerClass"
    was, at = spark.conf.get(store), pathlib.Path(ensure_checkpoint_dir(spark))
    old = set(at.glob("test-t5-*"))
    assert _payment_batches(spark, [([(1, "pending")], [(10, 1, "paid", 100)])]) == [[(1, "paid", 100, 10)]]
    (root,) = set(at.glob("test-t5-*")) - old
    files = {p.suffix for p in (root / "_checkpoint/state").rglob("1[._]*")}
    assert ".zip" in files and ".delta" not in files  # RocksDB, not maps on the heap
    assert spark.conf.get(store) == was
    raw = spark.createDataFrame([], "event_id long, provider string, body string, received_at long, signature string")
    ok = verify_callbacks(raw.repartition(2), "a", "b").where("outcome = 'ok'")
    plan = normalize_payment_status(ok, payment_status_map(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1


def test_one_delivery_holds_its_half_of_the_callbacks(spark, tmp_path):
    from tallyfold.sources.fixtures import Fixtures

    rows = [(k, k % 7, "OFP"[k % 3], 10.5, None, "1-URGENT") for k in (*range(1, 70), 70, 70)]  # a key that repeats
    (spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string")
     .write.parquet(f"{tmp_path}/orders.parquet"))
    fx = Fixtures(spark, str(tmp_path))
    both, halves = fx.callbacks().collect(), [fx.callbacks((e,)).collect() for e in (0, 1)]
    assert sorted(map(str, both)) == sorted(map(str, halves[0] + halves[1])) and len(both) == 2 * len([r for r in rows if r[0] % 10])
    assert all(r.event_id % 2 == e for e in (0, 1) for r in halves[e])
