"""Registered queries: stream forms (T*), run with availableNow into the shared
checkpoint folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.time import epoch_s
from ..sources.fixtures import REQUEST_GAP_S
from ..streaming import daily, jobs, payments
from ..streaming.keyed_admission import stream_admission
from .oracle_fixtures import with_fx
from .registry import query


@query("t2_stream_flood_sessions", with_fx("fx_requests") + f"""
, s as (select tg_user_id, min(ts) start_ts, max(ts) last_ts, count(*) requests
        from (select *, sum(case when prev is null or ts - prev >= {REQUEST_GAP_S} then 1 else 0 end) over (
                     partition by tg_user_id order by ts, request_id rows unbounded preceding) burst
              from (select *, lag(ts) over (partition by tg_user_id order by ts, request_id) prev from fx_requests))
        group by tg_user_id, burst)
select * from s where last_ts + {REQUEST_GAP_S} <= (select max(ts) from fx_requests) - 86400""")
def t2(spark, d):
    """Session windows emitted in append mode: equal to the batch bursts
    whose session has closed before the final watermark (max event time -
    1 day); the still-open ones stay in state until later data arrives."""
    s = jobs.stream_flood_sessions(jobs.requests_stream(spark, d), REQUEST_GAP_S)
    return jobs.run_available_now(spark, s, "t2").select(
        "tg_user_id", "start_ts", "last_ts", "requests")


_DATE = "cast(strftime(make_timestamp(cast({} as bigint) * 1000000), '%Y%m%d') as integer)"
# days that end a day or more before the latest event
_CLOSED = "({0} // 86400 + 2) * 86400 <= (select max({0}) from {1})"


def _usage_days(spark, d):
    li = jobs.stream_table(spark, d, "lineitem")
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey")
    ln, flag = F.col("l_linenumber"), F.concat("l_returnflag", "l_linestatus")
    inv = li.join(o, li.l_orderkey == o.o_orderkey).select(  # stream-static join
        F.col("o_custkey").alias("tg_user_id"),
        F.when(ln % 5 == 0, "mp_card_doctor").when(ln % 5 == 1, "mp_review_responder")
         .when(ln % 5 == 2, "mp_competitor_scout").when(ln % 5 == 3, "mp_abc_xyz_analyst")
         .otherwise("mp_unit_economics").alias("agent_id"),
        (F.col("l_quantity").cast("long") * 400).alias("input_tokens"),
        (F.col("l_quantity").cast("long") * 150).alias("output_tokens"),
        F.when(flag == "AF", "timeout").when(flag == "AO", "rate_limit").when(flag == "RF", "api_error")
         .when(flag == "RO", "retried_ok").otherwise("success").alias("status"),
        (epoch_s("l_shipdate") + F.col("l_partkey") % 86400).alias("created_at"))
    return jobs.run_available_now(spark, daily.daily_usage(inv), "t4")


@query("t4_stream_daily_usage", with_fx("fx_invocations") + f"""
select agent_id, {_DATE.format('created_at')} date, count(*) invocations, count(distinct tg_user_id) unique_users,
       cast(sum(input_tokens) as bigint) total_input_tokens, cast(sum(output_tokens) as bigint) total_output_tokens,
       count(*) filter (where status = 'success') success_count
from fx_invocations where {_CLOSED.format('created_at', 'fx_invocations')} group by 1, 2""")
def t4(spark, d):
    """Closed days; their users from the stored sketches (exact at this size)."""
    out = _usage_days(spark, d)
    return out.withColumn("unique_users", F.hll_sketch_estimate("users_sketch")).drop("users_sketch")


@query("t4_active_users", with_fx("fx_invocations") + f"""
, u as (select distinct created_at // 86400 as dn, tg_user_id from fx_invocations where {_CLOSED.format('created_at', 'fx_invocations')})
select {_DATE.format('d.dn * 86400')} date, count(distinct case when d.dn = u.dn then tg_user_id end) users_1d,
       count(distinct case when d.dn - u.dn < 7 then tg_user_id end) users_7d, count(distinct tg_user_id) users_30d
from (select distinct dn from u) d join u on u.dn between d.dn - 29 and d.dn group by 1""")
def t4_active(spark, d):
    """Users of the last 1, 7 and 30 days, merged from the stored sketches."""
    return daily.active_users(_usage_days(spark, d))


@query("t1_stream_updates", with_fx("fx_upd_dedup") + """
select update_id, kind, user_id, chat_id, ts, text, data, username, first_name, last_name, language_code
from fx_upd_dedup""")
def t1(spark, d):
    """Raw update JSON lands as files (written from the fixture once); the
    stream parses them and drops redeliveries within the watermark."""
    from ..session import ensure_checkpoint_dir
    from ..sources.fixtures import Fixtures
    import uuid

    landing = ensure_checkpoint_dir(spark).rstrip("/") + f"/landing/updates-{uuid.uuid4().hex[:12]}"
    Fixtures(spark, d).updates().write.mode("overwrite").parquet(landing)
    raw = spark.readStream.schema("raw string").parquet(landing)
    s = jobs.stream_updates(raw)
    out = jobs.run_available_now(spark, s, "t1")
    return out.select("update_id", "kind", "user_id", "chat_id", "ts", "text", "data", "username", "first_name",
                      "last_name", "language_code")


@query("t3_stream_admission", with_fx("fx_decisions") + "select * from fx_decisions")
def t3(spark, d):
    """Admission as a keyed-state stream over the request events; equals A2."""
    from ..sources.fixtures import REQUEST_LIMITS

    lim = {p: (f, dl, a) for p, f, dl, a in REQUEST_LIMITS}
    u = F.col("user_id")
    req = jobs.stream_table(spark, d, "events").select(
        F.col("event_id").alias("request_id"), u.alias("tg_user_id"), F.col("event_type").alias("agent_id"),
        epoch_s("ts").alias("ts"),
        F.when(u % 4 == 0, "free_trial").when(u % 4 == 1, "starter").when(u % 4 == 2, "pro")
         .otherwise("business").alias("plan"))
    return jobs.run_available_now(spark, stream_admission(req, lim, REQUEST_GAP_S), "t3")


def _transitions(spark, d):
    """Payments and first callbacks arrive, then the second callbacks: two runs
    of the stream over the same checkpoint."""
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..sources.fixtures import TEST_SECRET_A, TEST_SECRET_B, Fixtures
    from ..sources.reference_data import payment_status_map

    fx = Fixtures(spark, d)
    root = ensure_checkpoint_dir(spark).rstrip("/") + f"/t5-{uuid.uuid4().hex[:12]}"
    raw = "event_id long, provider string, body string, received_at long, signature string"
    fx.payments().select("id", "status").write.parquet(f"{root}/payments")
    out = None
    for part in (0, 1):
        fx.callbacks((part,)).where(F.col("event_id") % 2 == part).write.parquet(f"{root}/landing/part={part}")
        callbacks = spark.readStream.schema(raw + ", part int").parquet(f"{root}/landing").drop("part")
        stream = payments.payment_transitions(spark.readStream.schema("id long, status string").parquet(f"{root}/payments"), callbacks,
                                              TEST_SECRET_A, TEST_SECRET_B, payment_status_map(spark))
        out = payments.run_transitions(spark, stream, root)
    return fx, out


@query("t5_stream_payment_state", with_fx("fx_payment_state") + """
select id, tg_user_id, provider, amount_rub, plan, created_at, status, finalized_at, tx_hash from fx_payment_state""")
def t5(spark, d):
    """The payment table after the stream's transitions; equals B3."""
    fx, out = _transitions(spark, d)
    return payments.replay(fx.payments(), out)


_STEP = """(case when {ev} = 'paid' and {s} <> 'paid' then 'paid'
                 when {ev} in ('failed', 'expired', 'refunded') and {s} not in ('paid', 'refunded') then {ev} end)"""


@query("t5_payment_transitions", with_fx("fx_payments", "fx_norm_events") + f"""
, e as (select p.id, p.status s0, a.status a, a.ts a_ts, a.tx_hash a_tx, a.event_id a_id, b.status b, b.ts b_ts, b.tx_hash b_tx, b.event_id b_id
        from fx_payments p left join fx_norm_events a on a.payment_id = p.id and a.event_id % 2 = 0
        left join fx_norm_events b on b.payment_id = p.id and b.event_id % 2 = 1),
one as (select *, {_STEP.format(ev='a', s='s0')} t1 from e),
two as (select *, {_STEP.format(ev='b', s='coalesce(t1, s0)')} t2 from one)
select id payment_id, t1 status, a_ts finalized_at, case when t1 = 'paid' then a_tx end tx_hash, a_id event_id, 0 step from two where t1 is not null
union all
select id, t2, b_ts, case when t2 = 'paid' then b_tx end, b_id, 1 from two where t2 is not null""")
def t5_transitions(spark, d):
    """What each run of the stream changed, nothing else."""
    out = _transitions(spark, d)[1]
    second = out.agg(F.max("epoch")).first()[0]
    return out.withColumn("step", (F.col("epoch") == second).cast("int")).drop("epoch")


@query("t6_cron_cycle", with_fx("fx_decisions") + """
, usage as (select cast(strftime(make_timestamp(cast(ts as bigint) * 1000000), '%Y%m%d') as integer) date
            from fx_decisions where reason = 'allowed' group by tg_user_id, agent_id, 1),
runs as (select distinct cast(strftime(ts, '%Y%m%d') as integer) date from events
         where hour(ts) = 0 and minute(ts) < 10),
r as (select date, cast(strftime(strptime(date::varchar, '%Y%m%d') - interval 7 day, '%Y%m%d') as integer) cutoff
      from runs)
select r.date, r.cutoff, (select count(*) from usage u where u.date < r.cutoff) deleted_total,
       (select count(*) from usage u where u.date >= r.cutoff and u.date < r.date) kept
from r""")
def t6(spark, d):
    """Quota purge of the cron cycle; one firing per event, at its own time."""
    from ..operators import admission
    from ..streaming import cron
    from .q_admission import decisions

    usage = admission.usage_quota_daily(decisions(spark, d))
    fired = jobs.stream_table(spark, d, "events").select(epoch_s("ts").alias("ts"))
    ledger = cron.run_cycle(spark, fired, [cron.quota_purge(usage)], cron.fresh_root(spark, "quota"))
    return ledger.rows("quota_purge").select("date", "cutoff", "deleted_total", "kept")


@query("t4_stream_daily_revenue", with_fx("fx_payments") + f"""
, p as (select * from fx_payments where status = 'paid' and finalized_at is not null)
select {_DATE.format('finalized_at')} date, count(*) payments_count, cast(sum(amount_rub) as bigint) revenue_rub,
       count(distinct tg_user_id) unique_payers
from p where {_CLOSED.format('finalized_at', 'p')} group by 1""")
def t4r(spark, d):
    """R2 on closed UTC days over the order stream; payers from the sketches."""
    o = jobs.stream_table(spark, d, "orders")
    k = F.col("o_orderkey")
    created = epoch_s("o_orderdate")
    pay = o.select(F.col("o_custkey").alias("tg_user_id"), F.floor("o_totalprice").cast("long").alias("amount_rub"),
                   F.when(F.col("o_orderstatus") == "F", "paid").otherwise("other").alias("status"),
                   F.when(F.col("o_orderstatus") != "O", created + (k % 48) * 3600).alias("finalized_at"))
    out = jobs.run_available_now(spark, daily.daily_revenue(pay), "t4r")
    return out.withColumn("unique_payers", F.hll_sketch_estimate("payers_sketch")).drop("payers_sketch")


# The jobs of the cron cycle.  The firings are the events' times, moved to
# the month before the fixtures' as-of date.
TICK_SHIFT = 904_694_400  # 2024-01-31 becomes 1995-06-01
_TICKS = f"""
, slots as (select distinct (epoch_us(ts) // 1000000 - {TICK_SHIFT}) // 300 * 300 slot from events),
daily as (select min(slot) slot from slots where slot % 86400 < 600 group by slot // 86400)"""


def ticks(spark, d):
    return jobs.stream_table(spark, d, "events").select((epoch_s("ts") - TICK_SHIFT).alias("ts"))


def cron_sources(spark, d):
    """The jobs over the fixtures' tables: name -> function that makes it."""
    import uuid

    from ..operators import billing
    from ..sources.fixtures import Fixtures
    from ..sources.reference_data import plan_config
    from ..sources.tables import Tables
    from ..streaming import cron

    fx = Fixtures(spark, d)
    e = Tables(spark, d).events.where(F.col("event_type") == "error")
    k, u = F.col("event_id"), F.col("user_id")
    put = (epoch_s("ts") - TICK_SHIFT).alias("put_at")
    item = F.to_json(F.struct(u.alias("user_id"), u.alias("chat_id"), F.col("event_type").alias("agent_id"),
                              (k % 2).cast("int").alias("attempts"), (epoch_s("ts") - TICK_SHIFT).alias("enqueued_at")))
    queue = e.select(F.format_string("retry:%d:%d", u, k).alias("key"), F.when(k % 40 == 0, F.lit('{"user_id":')).otherwise(item).alias("raw"), put)
    tries = e.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(2))))
    outcomes = tries.select(F.format_string("retry:%d:%d", u, k).alias("key"), "attempt",
                            ((F.floor(k / 2) + F.col("attempt")) % 4 == 0).alias("ok"))
    messages = fx.invocations().select(
        "created_at", F.explode(F.when(F.col("status") == "success", F.array(F.lit("user"), F.lit("assistant"))).otherwise(F.array(F.lit("user")))).alias("role"))
    # tables of the service, not views: users, subscriptions with the start that closes them, calls
    root = cron.fresh_root(spark, "tables")

    def table(name, df):
        df.write.parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    def subs():
        return table(f"subscriptions-{uuid.uuid4().hex[:6]}", billing.activate_subscriptions(fx.subscriptions(), 2 ** 40))

    return {"retry_drain": lambda: cron.retry_drain(queue, outcomes),
            "payment_recheck": lambda: cron.payment_recheck(fx.payments(), fx.provider_snapshot(), plan_config(spark)),
            "message_purge": lambda: cron.message_purge(messages), "subscription_expiry": lambda: cron.subscription_expiry(subs()),
            "nudges": lambda: cron.nudges(table("users", fx.users()), subs(),
                                          table("calls", fx.invocations().select("tg_user_id", "agent_id", "created_at")))}


def cron_rows(spark, d, name):
    """Rows of one job of the cycle over all firings."""
    from ..streaming import cron

    job = cron_sources(spark, d)[name]()
    return cron.run_cycle(spark, ticks(spark, d), [job], cron.fresh_root(spark, name)).rows(name)


_TRY = """
select key, case when bad then null else user_id end user_id, case when bad then null else 'error' end agent_id, put_at, {slot} slot, a + {i} a, bad,
       case when bad then 'drop_malformed' when (k // 2 + a + {i}) % 4 = 0 then 'retried_ok' when a + {i} + 1 >= 3 then 'give_up' else 'requeue' end action
from {source} where {slot} - {since} < 3600"""


@query("t6_retry_drain", f"""
with recursive {_TICKS.lstrip().lstrip(',')},
nx as (select slot, lead(slot) over (order by slot) s2, lead(slot, 2) over (order by slot) s3 from slots),
q as (select format('retry:{{}}:{{}}', user_id, event_id) key, user_id, event_id k, event_id % 40 = 0 bad, event_id % 2 a,
             epoch_us(ts) // 1000000 - {TICK_SHIFT} put_at from events where event_type = 'error'),
s as (select q.*, nx.slot s1, s2, s3 from q asof join nx on q.put_at <= nx.slot),
t1 as ({_TRY.format(slot='s1', i='0', source='s', since='put_at')}),
again as (select s.* from s join t1 using (key) where action = 'requeue'),
t2 as ({_TRY.format(slot='s2', i='1', source='again', since='s1')}),
last as (select s.* from s join t2 using (key) where action = 'requeue'),
t3 as ({_TRY.format(slot='s3', i='2', source='last', since='s2')})
select slot, key, user_id, agent_id, put_at, action,
       cast(case when bad then null when action = 'retried_ok' then a else a + 1 end as integer) attempts
from (select * from t1 union all select * from t2 union all select * from t3)""")
def t6_retry(spark, d):
    """Queue items taken at each firing, over up to three tries."""
    return cron_rows(spark, d, "retry_drain").select("slot", "key", "user_id", "agent_id", "put_at", "action", "attempts")


@query("t6_payment_recheck", with_fx("fx_payments") + _TICKS + """
select slot, id, tg_user_id, provider, plan, slot finalized_at, slot started_at, slot + 30 * 86400 expires_at
from (select * from fx_payments where status = 'pending' and provider <> 'admin_manual' and id % 4 in (1, 2)) p
asof join slots on p.created_at + 3601 <= slots.slot""")
def t6_recheck(spark, d):
    """Pending payments paid at a firing, with the interval they open."""
    return cron_rows(spark, d, "payment_recheck").select("slot", "id", "tg_user_id", "provider", "plan", "finalized_at",
                                                         "started_at", "expires_at")


@query("t6_message_purge", with_fx("fx_invocations") + _TICKS + """
, m as (select created_at, unnest(range(case when status = 'success' then 2 else 1 end)) from fx_invocations),
r as (select slot, lag(slot) over (order by slot) prev from daily)
select slot, slot - 30 * 86400 cutoff,
       count(*) filter (where created_at < slot - 30 * 86400 and (prev is null or created_at >= prev - 30 * 86400)) deleted,
       count(*) filter (where created_at <= slot and created_at >= slot - 30 * 86400) kept
from r, m group by 1, 2""")
def t6_messages(spark, d):
    """Messages deleted and left at each daily run."""
    return cron_rows(spark, d, "message_purge").select("slot", "cutoff", "deleted", "kept")


_SUBS_CLOSED = """
, subs as (select *, lead(started_at) over (partition by tg_user_id order by started_at, payment_id nulls first) closed_at from fx_subscriptions)"""


@query("t6_subscription_expiry", with_fx("fx_subscriptions") + _TICKS + _SUBS_CLOSED + """
select slot, payment_id, tg_user_id, plan, started_at, expires_at
from (select *, greatest(expires_at + 1, started_at) ready from subs) s asof join daily on s.ready <= daily.slot
where closed_at is null or closed_at > slot""")
def t6_expiry(spark, d):
    """Subscription rows set inactive, with the daily run that did it."""
    return cron_rows(spark, d, "subscription_expiry").select("slot", "payment_id", "tg_user_id", "plan", "started_at", "expires_at")


@query("t6_nudges", with_fx("fx_users", "fx_subscriptions", "fx_invocations") + _TICKS + _SUBS_CLOSED + """
, live as (select * from fx_users where is_banned = 0 and is_deleted = 0),
act as (select s.*, slot from subs s join daily on started_at <= slot and (closed_at is null or closed_at > slot) and expires_at >= slot),
coh as (select tg_user_id, slot, k from live, daily, (values (1), (2), (4), (6)) t(k)
        where registered_at between slot - (k + 1) * 86400 and slot - k * 86400),
used as (select tg_user_id, slot, count(*) calls, count(distinct agent_id) agents
         from (select distinct tg_user_id, slot from coh) join fx_invocations using (tg_user_id) where created_at <= slot group by 1, 2),
trial as (select tg_user_id, slot, count(*) n from act where plan = 'free_trial' group by 1, 2),
c as (select coh.*, calls, coalesce(agents, 0) agents, coalesce(n, 0) n
      from coh left join used using (tg_user_id, slot) left join trial using (tg_user_id, slot)),
e as (
  select slot, tg_user_id, 'd' || k || '_no_first_request' event, '' params from c where k in (1, 2) and calls is null
  union all select slot, tg_user_id, 'd4_one_agent', '' from c where k = 4 and agents = 1
  union all select slot, tg_user_id, case when agents >= 3 then 'd7_trial_activated' else 'd7_trial_not_activated' end,
                   case when agents >= 3 then format('calls={};agents={}', calls * n, agents) else '' end from c where k = 6 and n > 0
  union all select slot, tg_user_id, 'sub_expiring_' || expires_at,
                   format('plan={};date={}', plan, strftime(make_timestamp(expires_at * 1000000), '%Y-%m-%d'))
            from act where plan <> 'free_trial' and expires_at between slot + 2 * 86400 and slot + 3 * 86400
  union all select slot, tg_user_id, 'silence_7d_' || slot // 604800, ''
            from (select distinct tg_user_id, slot from act semi join live using (tg_user_id) where plan <> 'free_trial') p
            where (select max(created_at) from fx_invocations i where i.tg_user_id = p.tg_user_id and i.created_at <= p.slot) < slot - 7 * 86400)
select min(slot) slot, tg_user_id, event, arg_min(params, (slot, params)) params from e group by tg_user_id, event""")
def t6_nudge(spark, d):
    """Nudges sent at the daily runs, each once."""
    return cron_rows(spark, d, "nudges").select("slot", "tg_user_id", "event", "params")
