"""Registered queries: flood sessions and admission (A*)."""

from __future__ import annotations

from ..operators import admission
from ..sources.fixtures import REQUEST_GAP_S, Fixtures
from .oracle_fixtures import with_fx
from .registry import query


def decisions(spark, d):
    fx = Fixtures(spark, d)
    return admission.admission_decisions(fx.requests(), fx.request_limits(), gap=REQUEST_GAP_S)


@query("a1_flood_sessions", with_fx("fx_requests") + f"""
select tg_user_id, burst, min(ts) start_ts, max(ts) last_ts, count(*) requests
from (select *, cast(sum(case when prev is null or ts - prev >= {REQUEST_GAP_S} then 1 else 0 end) over (
             partition by tg_user_id order by ts, request_id rows unbounded preceding) as bigint) burst
      from (select *, lag(ts) over (partition by tg_user_id order by ts, request_id) prev from fx_requests))
group by tg_user_id, burst""")
def a1(spark, d):
    return admission.flood_sessions(Fixtures(spark, d).requests(), gap=REQUEST_GAP_S)


@query("a2_admission_decisions", with_fx("fx_decisions") + "select * from fx_decisions")
def a2(spark, d):
    return decisions(spark, d)


@query("a3_usage_quota_daily", with_fx("fx_decisions") + """
select tg_user_id, agent_id, cast(strftime(make_timestamp(cast(ts as bigint) * 1000000), '%Y%m%d') as integer) date,
       count(*) count, max(ts) last_at
from fx_decisions where reason = 'allowed' group by 1, 2, 3""")
def a3(spark, d):
    return admission.usage_quota_daily(decisions(spark, d))


@query("a6_rejection_funnel", with_fx("fx_decisions") + """
select date, plan, reason, n, round(n / sum(n) over (partition by date, plan), 4) share
from (select cast(strftime(make_timestamp(cast(ts as bigint) * 1000000), '%Y%m%d') as integer) date, coalesce(plan, 'none') plan,
             reason, count(*) n
      from fx_decisions group by 1, 2, 3)""")
def a6(spark, d):
    return admission.rejection_funnel(decisions(spark, d))


# ---- retry queue (L4), remaining quota (A4), purge (R14) ------------------------
from pyspark.sql import functions as F  # noqa: E402

from ..functions.time import epoch_s  # noqa: E402
from ..operators import cohorts, telemetry  # noqa: E402
from ..sources.reference_data import AGENTS  # noqa: E402
from ..sources.tables import Tables  # noqa: E402

QUEUE_AS_OF = 1706659200  # 2024-01-31 00:00:00 UTC, the retry queue's own as_of
QUOTA_DATE, PURGE_CUTOFF = 20240115, 20240124


def retry_queue(spark, d):
    """fx_retry_queue: error events as queued retries; every 40th malformed."""
    e = Tables(spark, d).events.where(F.col("event_type") == "error")
    k, u = F.col("event_id"), F.col("user_id")
    item = F.to_json(F.struct(u.alias("user_id"), u.alias("chat_id"), F.col("event_type").alias("agent_id"),
                              F.array(F.struct(F.lit("user").alias("role"),
                                               F.format_string("q%d", k).alias("content"))).alias("messages"),
                              (F.lit(1) + k % 2).cast("int").alias("attempts"),
                              epoch_s("ts").alias("enqueued_at")))
    raw = F.when(k % 40 == 0, F.lit('{"user_id":')).otherwise(item)
    return e.select(F.format_string("retry:%d:%d", u, k).alias("key"), raw.alias("raw"),
                    (k % 3 == 0).alias("ok"))


@query("l4_retry_step", f"""
with q as (select format('retry:{{}}:{{}}', user_id, event_id) key, user_id, event_id % 40 = 0 bad,
                  1 + event_id % 2 attempts, epoch_us(ts) // 1000000 enqueued_at, event_id % 3 = 0 ok
           from events where event_type = 'error'),
t as (select * from q where bad or enqueued_at > {QUEUE_AS_OF} - 3600)
select key, case when bad then null else user_id end user_id,
       case when bad then null else 'error' end agent_id,
       case when bad then null else enqueued_at end enqueued_at,
       case when bad then 'drop_malformed' when ok then 'retried_ok' when attempts + 1 >= 3 then 'give_up'
            else 'requeue' end action,
       cast(case when bad then null when not ok then attempts + 1 else attempts end as integer) attempts
from t""")
def l4(spark, d):
    q = retry_queue(spark, d)
    return telemetry.retry_step(q.select("key", "raw"), q.select("key", "ok"), QUEUE_AS_OF)


@query("a4_remaining_quota", with_fx("fx_decisions", "fx_requests", "fx_limits") + f"""
, u as (select tg_user_id, case agent_id when 'view' then 'mp_card_doctor' when 'signup' then 'mp_review_responder'
                   when 'click' then 'mp_competitor_scout' when 'error' then 'mp_abc_xyz_analyst'
                   else 'mp_unit_economics' end agent_id,
               cast(strftime(make_timestamp(cast(ts as bigint) * 1000000), '%Y%m%d') as integer) date, count(*) used
        from fx_decisions where reason = 'allowed' group by 1, 2, 3)
select s.tg_user_id, a.agent_id, s.plan, l.agent_limit "limit", coalesce(u.used, 0) used,
       greatest(0, l.agent_limit - coalesce(u.used, 0)) remaining
from (select distinct tg_user_id, plan from fx_requests) s
join fx_limits l using (plan)
cross join (select unnest(['mp_card_doctor', 'mp_review_responder', 'mp_competitor_scout',
                           'mp_abc_xyz_analyst', 'mp_unit_economics']) agent_id) a
left join u on u.tg_user_id = s.tg_user_id and u.agent_id = a.agent_id and u.date = {QUOTA_DATE}""")
def a4(spark, d):
    fx = Fixtures(spark, d)
    agent = F.col("agent_id")  # the fixture's event types stand for the five agents
    for kind, name in zip(("view", "signup", "click", "error", "purchase"), AGENTS):
        agent = F.when(F.col("agent_id") == kind, name).otherwise(agent)
    usage = admission.usage_quota_daily(decisions(spark, d).withColumn("agent_id", agent))
    current = fx.requests().select("tg_user_id", "plan").distinct()
    return admission.remaining_quota(usage, current, fx.request_limits(), QUOTA_DATE, spark)


@query("r14_purge_report", with_fx("fx_decisions") + f"""
select 'usage_quota' table_name, count(*) filter (where not (date < {PURGE_CUTOFF})) kept,
       count(*) filter (where date < {PURGE_CUTOFF}) deleted
from (select tg_user_id, agent_id, cast(strftime(make_timestamp(cast(ts as bigint) * 1000000), '%Y%m%d') as integer) date
      from fx_decisions where reason = 'allowed' group by 1, 2, 3)""")
def r14(spark, d):
    usage = admission.usage_quota_daily(decisions(spark, d))
    return cohorts.purge_report(usage, "usage_quota", "date", PURGE_CUTOFF)


@query("a5_refund_quota", with_fx("fx_decisions") + f"""
, usage as (select tg_user_id, agent_id, cast(strftime(make_timestamp(cast(ts as bigint) * 1000000), '%Y%m%d') as integer) date,
                   count(*) count, max(ts) last_at
            from fx_decisions where reason = 'allowed' group by 1, 2, 3),
q as (select user_id, event_id % 40 = 0 bad, 1 + event_id % 2 attempts, epoch_us(ts) // 1000000 enqueued_at,
             event_id % 3 = 0 ok, format('retry:{{}}:{{}}', user_id, event_id) key
      from events where event_type = 'error'),
t as (select * from q where bad or enqueued_at > {QUEUE_AS_OF} - 3600),
g as (select user_id tg_user_id, 'error' agent_id,
             cast(strftime(make_timestamp(cast(enqueued_at as bigint) * 1000000), '%Y%m%d') as integer) date, count(*) n
      from t where not bad and not ok and attempts + 1 >= 3 group by 1, 2, 3)
select u.tg_user_id, u.agent_id, u.date, greatest(0, u.count - coalesce(g.n, 0)) count, u.last_at
from usage u left join g using (tg_user_id, agent_id, date)""")
def a5(spark, d):
    """Given-up retries hand their quota back on the request's own date."""
    from ..functions.time import yyyymmdd
    q = retry_queue(spark, d)
    step = telemetry.retry_step(q.select("key", "raw"), q.select("key", "ok"), QUEUE_AS_OF)
    give = step.where(F.col("action") == "give_up").select(
        F.col("user_id").alias("tg_user_id"), "agent_id", yyyymmdd(F.col("enqueued_at")).alias("date"))
    usage = admission.usage_quota_daily(decisions(spark, d))
    return admission.refund_quota(usage, give)
