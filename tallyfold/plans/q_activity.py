"""Registered queries: activity, revenue, cohorts (R*), telemetry (L*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import billing, cohorts, telemetry
from ..sources.fixtures import AS_OF, Fixtures
from ..sources.reference_data import llm_rates
from ..functions.windows import _once
from .oracle_fixtures import with_fx
from .registry import query

A = AS_OF
DAY = 86400


def _ctx(spark, d, shared: bool = False):
    """Users, folded subscriptions and invocations at ``A``.  With ``shared``
    (queries that read them several times) each is materialised once;
    single-use queries stream them straight into their one consumer."""
    keep = _once if shared else (lambda df: df)
    fx = Fixtures(spark, d)
    inv = keep(fx.invocations().where(F.col("created_at") <= A))
    users = keep(fx.users().join(inv.groupBy("tg_user_id").agg(F.max("created_at").alias("last_seen_at")),
                                 "tg_user_id", "left"))
    return fx, users, keep(billing.subscription_state(fx.subscriptions(), A)), inv


@query("r1_active_users", with_fx("fx_users_active", "fx_subs_state") + f"""
select u.tg_user_id, u.first_name, u.registered_at, u.last_seen_at,
       s.plan active_plan, s.expires_at plan_expires_at,
       cast(({A} - u.last_seen_at) // 86400 as integer) days_since_seen
from fx_users_active u left join fx_subs_state s on s.tg_user_id = u.tg_user_id and s.is_active = 1
where u.is_banned = 0 and u.is_deleted = 0 and u.last_seen_at > {A} - 7 * 86400""")
def r1(spark, d):
    fx, users, subs, inv = _ctx(spark, d)
    return cohorts.active_users(users, subs, A)


@query("r2_revenue_daily", with_fx("fx_payments") + """
select cast(strftime(make_timestamp(cast(finalized_at as bigint) * 1000000), '%Y%m%d') as integer) date,
       count(*) payments_count, cast(sum(amount_rub) as bigint) revenue_rub,
       count(distinct tg_user_id) unique_payers
from fx_payments where status = 'paid' and finalized_at is not null group by 1""")
def r2(spark, d):
    return cohorts.revenue_daily(Fixtures(spark, d).payments())


@query("r3_revenue_window", with_fx("fx_payments") + f"""
select cast(coalesce(sum(case when status = 'paid' and finalized_at > {A} - 7 * 86400
                               and finalized_at <= {A} then amount_rub end), 0) as bigint) revenue_7d,
       cast(coalesce(sum(case when status = 'paid' and finalized_at > {A} - 30 * 86400
                               and finalized_at <= {A} then amount_rub end), 0) as bigint) revenue_30d
from fx_payments""")
def r3(spark, d):
    return cohorts.revenue_windows(Fixtures(spark, d).payments(), A)


_R1_SQL = f"""
r1 as (select u.tg_user_id, cast(({A} - u.last_seen_at) // 86400 as integer) days_since_seen
       from fx_users_active u left join fx_subs_state s on s.tg_user_id = u.tg_user_id and s.is_active = 1
       where u.is_banned = 0 and u.is_deleted = 0 and u.last_seen_at > {A} - 7 * 86400)"""


@query("r4_dau", with_fx("fx_users_active", "fx_subs_state") + "," + _R1_SQL + """
select count(*) dau from r1 where days_since_seen <= 1""")
def r4(spark, d):
    fx, users, subs, inv = _ctx(spark, d)
    return cohorts.dau(cohorts.active_users(users, subs, A))


@query("r5_mau", with_fx("fx_users_active") + f"""
select count(*) mau from fx_users_active
where last_seen_at > {A} - 30 * 86400 and is_banned = 0 and is_deleted = 0""")
def r5(spark, d):
    fx, users, subs, inv = _ctx(spark, d)
    return cohorts.mau(users, A)


_R6_SQL = f"""
select count(distinct case when plan <> 'free_trial' then tg_user_id end) paying,
       count(distinct case when plan = 'free_trial' then tg_user_id end) trial
from fx_subs_state where is_active = 1 and expires_at > {A}"""


@query("r6_plan_holders", with_fx("fx_subs_state") + _R6_SQL)
def r6(spark, d):
    fx, users, subs, inv = _ctx(spark, d)
    return cohorts.plan_holders(subs, A)


@query("r6_plan_holders_raw", with_fx("fx_subscriptions") + f"""
select count(distinct case when plan <> 'free_trial' then tg_user_id end) paying,
       count(distinct case when plan = 'free_trial' then tg_user_id end) trial
from fx_subscriptions where is_active = 1 and expires_at > {A} and started_at <= {A}""")
def r6_raw(spark, d):
    fx = Fixtures(spark, d)
    return cohorts.plan_holders(fx.subscriptions_as_of(A), A)


@query("r7_stats_dashboard", with_fx("fx_users_active", "fx_subs_state", "fx_payments", "fx_inv_asof")
       + "," + _R1_SQL + f"""
select (select count(*) from r1 where days_since_seen <= 1) dau,
       (select count(*) from fx_users_active where last_seen_at > {A} - 30 * 86400
          and is_banned = 0 and is_deleted = 0) mau,
       h.paying, h.trial,
       (select cast(coalesce(sum(amount_rub), 0) as bigint) from fx_payments where status = 'paid'
          and finalized_at > {A} - 7 * 86400 and finalized_at <= {A}) revenue_7d,
       (select cast(coalesce(sum(amount_rub), 0) as bigint) from fx_payments where status = 'paid'
          and finalized_at > {A} - 30 * 86400 and finalized_at <= {A}) revenue_30d,
       e.total_calls, e.errors,
       case when e.total_calls > 0 then round(e.errors * 100.0 / e.total_calls, 1) else 0.0 end error_rate_pct
from ({_R6_SQL}) h,
     (select count(*) filter (where status not in ('success', 'retried_ok')) errors, count(*) total_calls
      from fx_inv_asof where created_at > {A} - 86400) e""")
def r7(spark, d):
    fx, users, subs, inv = _ctx(spark, d, shared=True)
    return cohorts.stats_dashboard(users, subs, fx.payments(), inv, A)


def _cohort_sql(k: int, a: int = A) -> str:
    return f"is_banned = 0 and is_deleted = 0 and registered_at between {a} - {k + 1} * 86400 and {a} - {k} * 86400"


def _use_sql(inv: str, name: str = "per_user") -> str:
    """One row per user with invocations."""
    return (f", {name} as (select tg_user_id, count(agent_id) calls, count(distinct agent_id) agents, "
            f"max(created_at) last_call from {inv} group by tg_user_id)")


@query("r8_no_first_request", with_fx("fx_users_active", "fx_inv_asof") + f"""
select tg_user_id, registered_at, 1 "day" from fx_users_active u
where {_cohort_sql(1)} and not exists (from fx_inv_asof i where i.tg_user_id = u.tg_user_id)
union all
select tg_user_id, registered_at, 2 from fx_users_active u
where {_cohort_sql(2)} and not exists (from fx_inv_asof i where i.tg_user_id = u.tg_user_id)""")
def r8(spark, d):
    fx, users, subs, inv = _ctx(spark, d, shared=True)
    return cohorts.no_first_request(users, inv, A, 1).unionByName(cohorts.no_first_request(users, inv, A, 2))


@query("r9_one_agent_only", with_fx("fx_users_active", "fx_inv_asof") + _use_sql("fx_inv_asof") + f"""
select tg_user_id, registered_at, agents unique_agents
from per_user join (select * from fx_users_active where {_cohort_sql(4)}) using (tg_user_id) where agents = 1""")
def r9(spark, d):
    fx, users, subs, inv = _ctx(spark, d)
    return cohorts.one_agent_only(users, inv, A)


@query("r10_trial_ending", with_fx("fx_users_active", "fx_inv_asof", "fx_subs_state") + _use_sql("fx_inv_asof") + f"""
, trials as (select tg_user_id, count(*) n from fx_subs_state where plan = 'free_trial' and is_active = 1 group by 1)
select tg_user_id, registered_at, coalesce(agents, 0) unique_agents, cast(coalesce(calls, 0) * n as bigint) total_calls,
       cast(coalesce(agents, 0) >= 3 as integer) activated
from trials join (select * from fx_users_active where {_cohort_sql(6)}) using (tg_user_id)
     left join per_user using (tg_user_id)""")
def r10(spark, d):
    fx, users, subs, inv = _ctx(spark, d)
    return cohorts.trial_ending(users, subs, inv, A)


def _expiring_sql(subs: str, a: int = A) -> str:
    return (f"(select tg_user_id, plan, expires_at, 'sub_expiring_' || expires_at event, "
            f"strftime(make_timestamp(cast(expires_at as bigint) * 1000000), '%Y-%m-%d') expires_date from {subs} "
            f"where plan <> 'free_trial' and is_active = 1 and expires_at - {a} between 2 * 86400 and 3 * 86400)")


@query("r11_sub_expiring", with_fx("fx_subs_state") + f"select * from {_expiring_sql('fx_subs_state')}")
def r11(spark, d):
    fx, users, subs, inv = _ctx(spark, d)
    return cohorts.sub_expiring(subs, A)


_RAW_SUBS = f"(select * from fx_subscriptions where started_at <= {A})"


@query("r11_sub_expiring_raw", with_fx("fx_subscriptions") + f"select * from {_expiring_sql(_RAW_SUBS)}")
def r11_raw(spark, d):
    return cohorts.sub_expiring(Fixtures(spark, d).subscriptions_as_of(A), A)


def _silent_sql(subs: str, a: int = A, use: str = "per_user") -> str:
    return (f"(select tg_user_id, registered_at, last_call, 'silence_7d_{a // (7 * DAY)}' event "
            f"from {use} join fx_users_active using (tg_user_id) "
            f"where {a} - last_call > 7 * 86400 and is_banned = 0 and is_deleted = 0 and tg_user_id in "
            f"(select tg_user_id from {subs} where is_active = 1 and plan <> 'free_trial'))")


@query("r12_silent_payers", with_fx("fx_users_active", "fx_inv_asof", "fx_subs_state") + _use_sql("fx_inv_asof")
       + f"select * from {_silent_sql('fx_subs_state')}")
def r12(spark, d):
    fx, users, subs, inv = _ctx(spark, d)
    return cohorts.silent_payers(users, subs, inv, A)


@query("r12_silent_payers_raw", with_fx("fx_users_active", "fx_inv_asof", "fx_subscriptions") + _use_sql("fx_inv_asof")
       + f"select * from {_silent_sql(_RAW_SUBS)}")
def r12_raw(spark, d):
    fx, users, subs, inv = _ctx(spark, d)
    return cohorts.silent_payers(users, fx.subscriptions_as_of(A), inv, A)


def _segments_sql(a: int, subs: str, use: str) -> str:
    """The six cohorts at ``a`` as (tg_user_id, event, params): one pass over
    the users with their use and subscription flags, then one row per event."""
    return f"""
select tg_user_id, unnest(list_filter([
         case when {_cohort_sql(1, a)} and agents is null then 'd1_no_first_request' end,
         case when {_cohort_sql(2, a)} and agents is null then 'd2_no_first_request' end,
         case when {_cohort_sql(4, a)} and agents = 1 then 'd4_one_agent' end,
         case when {_cohort_sql(6, a)} and trials > 0 and coalesce(agents, 0) < 3 then 'd7_trial_not_activated' end,
         case when is_banned = 0 and is_deleted = 0 and paid > 0 and {a} - last_call > 7 * 86400
              then 'silence_7d_{a // (7 * DAY)}' end], lambda x: x is not null)) as event, '' params
from fx_users_active left join {use} using (tg_user_id) left join (
  select tg_user_id, count(*) filter (where plan = 'free_trial') trials, count(*) filter (where plan <> 'free_trial') paid
  from {subs} where is_active = 1 group by 1) using (tg_user_id)
union all
select tg_user_id, 'd7_trial_activated', format('calls={{}};agents={{}}', calls * n, agents)
from (select * from fx_users_active where {_cohort_sql(6, a)}) join {use} using (tg_user_id) join (
  select tg_user_id, count(*) n from {subs} where is_active = 1 and plan = 'free_trial' group by 1) using (tg_user_id)
where agents >= 3
union all
select tg_user_id, event, format('plan={{}};date={{}}', plan, expires_date) from {_expiring_sql(subs, a)}"""


_PREV = A - DAY
_STATE_PREV = f"""
, subs_prev as (select *, case when closed_at is null and expires_at >= {_PREV} then 1 else 0 end is_active2
                from (select *, lead(started_at) over (partition by tg_user_id
                                                       order by started_at, payment_id nulls first) closed_at
                      from fx_subscriptions where started_at <= {_PREV})),
subs_prev2 as (select * exclude (is_active, is_active2), is_active2 is_active from subs_prev),
inv_prev as (select * from fx_inv_asof where created_at <= {_PREV}),
per_user_prev as (select tg_user_id, count(agent_id) calls, count(distinct agent_id) agents, max(created_at) last_call
                  from inv_prev group by 1),
per_user as (select tg_user_id, count(agent_id) calls, count(distinct agent_id) agents, max(created_at) last_call
             from fx_inv_asof group by 1),
ledger as (select tg_user_id, event, min(params) params from ({_segments_sql(_PREV, "subs_prev2", "per_user_prev")})
           group by 1, 2),
today as ({_segments_sql(A, "fx_subs_state", "per_user")})
select t.tg_user_id, t.event, min(t.params) params, {A}::bigint sent_at
from today t where not exists (select 1 from ledger l where l.tg_user_id = t.tg_user_id and l.event = t.event)
group by 1, 2"""


@query("r13_nudge_plan", with_fx("fx_users_active", "fx_inv_asof", "fx_subs_state", "fx_subscriptions") + _STATE_PREV)
def r13(spark, d):
    """Today's six cohorts minus what yesterday's run already sent, both from
    one fact row per user."""
    fx, dates = Fixtures(spark, d), [A - DAY, A]
    subs = billing.activate_subscriptions(fx.subscriptions().where(F.col("started_at") <= A), A)
    facts = cohorts.nudge_facts(fx.users(), subs, fx.invocations(), dates)
    sent = cohorts.send_once(cohorts.nudge_rules(facts, dates), None)
    return sent.where(F.col("slot") == A).select("tg_user_id", "event", "params", F.col("slot").alias("sent_at"))


@query("l1_invocation_cost", with_fx("fx_inv_cost") + """
select provider, count(*) calls, cast(sum(cost_usd_e4) as bigint) cost_usd_e4
from fx_inv_cost group by provider""")
def l1(spark, d):
    fx = Fixtures(spark, d)
    inv = telemetry.invocation_cost(fx.invocations(), llm_rates(spark))
    return inv.groupBy("provider").agg(F.count(F.lit(1)).alias("calls"),
                                       F.sum("cost_usd_e4").alias("cost_usd_e4"))


@query("l2_agent_usage_daily", with_fx("fx_inv_cost") + f"""
select agent_id, cast(strftime(make_timestamp(cast(created_at as bigint) * 1000000), '%Y%m%d') as integer) date,
       count(*) invocations, count(distinct tg_user_id) unique_users,
       cast(sum(input_tokens) as bigint) total_input_tokens,
       cast(sum(output_tokens) as bigint) total_output_tokens,
       round(avg(latency_ms), 4) avg_latency_ms, sum(cost_usd_e4) / 10000.0 total_cost_usd,
       count(*) filter (where status = 'success') success_count,
       count(*) filter (where status <> 'success' and status <> 'retried_ok') error_count
from fx_inv_cost where created_at > {A} - 30 * 86400 and created_at <= {A} group by 1, 2""")
def l2(spark, d):
    fx = Fixtures(spark, d)
    inv = telemetry.invocation_cost(fx.invocations().where(F.col("created_at") <= A), llm_rates(spark))
    return telemetry.agent_usage_daily(inv, A)


@query("l3_error_rate", with_fx("fx_inv_asof") + f"""
select errors, total_calls,
       case when total_calls > 0 then round(errors * 100.0 / total_calls, 1) else 0.0 end error_rate_pct
from (select count(*) filter (where status not in ('success', 'retried_ok')) errors, count(*) total_calls
      from fx_inv_asof where created_at > {A} - 86400)""")
def l3(spark, d):
    fx = Fixtures(spark, d)
    return cohorts.error_rate(fx.invocations(), A)
