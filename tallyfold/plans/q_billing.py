"""Registered queries: payment callbacks, payment and subscription state (B*, S4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import billing
from ..sources import callbacks as cb
from ..sources.fixtures import AS_OF, TEST_SECRET_A, TEST_SECRET_B, Fixtures
from ..sources.reference_data import payment_status_map, plan_config
from ..sources.tables import Tables
from .oracle_fixtures import with_fx
from .registry import query

A = AS_OF


def parsed_callbacks(spark, d):
    fx = Fixtures(spark, d)
    return cb.parse_payment_callbacks(fx.callbacks(), fx.payments(), TEST_SECRET_A, TEST_SECRET_B)


def normalized_events(spark, d):
    ok = parsed_callbacks(spark, d).where(F.col("outcome") == "ok")
    return billing.normalize_payment_status(ok, payment_status_map(spark))


def payment_state(spark, d):
    fx = Fixtures(spark, d)
    return billing.apply_payment_events(fx.payments(), normalized_events(spark, d))


@query("s4_payment_callbacks", with_fx("fx_callbacks") + """
select event_id, provider, payment_id, raw_status, tx_hash, ts, outcome from fx_callbacks""")
def s4(spark, d):
    return parsed_callbacks(spark, d).select("event_id", "provider", "payment_id", "raw_status", "tx_hash",
                                             "ts", "outcome")


@query("b2_normalize_payment_status", with_fx("fx_norm_events") + """
select event_id, provider, payment_id, raw_status, status, ts from fx_norm_events""")
def b2(spark, d):
    return normalized_events(spark, d).select("event_id", "provider", "payment_id", "raw_status", "status", "ts")


@query("b3_payment_state", with_fx("fx_payment_state") + """
select id, tg_user_id, provider, amount_rub, plan, created_at, status, finalized_at, tx_hash, changed
from fx_payment_state""")
def b3(spark, d):
    return payment_state(spark, d).select("id", "tg_user_id", "provider", "amount_rub", "plan", "created_at",
                                          "status", "finalized_at", "tx_hash", "changed")


@query("b4_subscription_state", with_fx("fx_subs_state") + """
select payment_id, tg_user_id, plan, started_at, expires_at, closed_at, is_active, expired_now
from fx_subs_state""")
def b4(spark, d):
    s = billing.subscription_state(Fixtures(spark, d).subscriptions(), A)
    return s.select("payment_id", "tg_user_id", "plan", "started_at", "expires_at", "closed_at", "is_active",
                    "expired_now")


@query("b5_current_subscription", with_fx("fx_subs_state") + """
select tg_user_id, plan, expires_at, started_at from (
  select *, row_number() over (partition by tg_user_id order by expires_at desc, started_at desc) rn
  from fx_subs_state where is_active = 1) where rn = 1""")
def b5(spark, d):
    return billing.current_subscription(billing.subscription_state(Fixtures(spark, d).subscriptions(), A))


@query("b6_subscription_as_of", with_fx("fx_invocations", "fx_subscriptions") + """
select tg_user_id, agent_id, created_at,
       case when sp.exp >= t then sp.plan end plan,
       case when sp.exp >= t then sp.exp end plan_expires_at,
       case when sp is null or sp.exp < t then 'no_active_plan' end plan_reason
from (select *, last_value(sub ignore nulls) over (
             partition by tg_user_id order by t, kind, pid rows between unbounded preceding and current row) sp
      from (select tg_user_id, agent_id, created_at, created_at t, 1 kind, null::bigint pid,
                   null::struct(plan varchar, exp bigint) sub from fx_invocations
            union all
            select tg_user_id, null, null, started_at, 0, coalesce(payment_id, -9223372036854775808),
                   {'plan': plan, 'exp': expires_at} from fx_subscriptions))
where kind = 1""")
def b6(spark, d):
    fx = Fixtures(spark, d)
    inv = fx.invocations().select("tg_user_id", "agent_id", "created_at")
    return billing.subscription_as_of(inv, fx.subscriptions(), ts_col="created_at")


@query("b7_expire_subscriptions", with_fx("fx_subs_state") + """
select count(*) filter (where expired_now) expired_now, count(*) filter (where is_active = 1) still_active,
       count(*) rows_total from fx_subs_state""")
def b7(spark, d):
    s = billing.subscription_state(Fixtures(spark, d).subscriptions(), A)
    return s.agg(F.count(F.when(F.col("expired_now"), 1)).alias("expired_now"),
                 F.count(F.when(F.col("is_active") == 1, 1)).alias("still_active"),
                 F.count(F.lit(1)).alias("rows_total"))


@query("b9_multi_account_flags", with_fx("fx_subscriptions") + f"""
select tg_user_id, count(*) subs_30d from fx_subscriptions
where created_at > {A} - 30 * 86400 and created_at <= {A} group by 1 having count(*) >= 2""")
def b9(spark, d):
    return billing.multi_account_flags(Fixtures(spark, d).subscriptions(), A)


@query("b10_profile_cards", with_fx("fx_users", "fx_subs_state") + f"""
select u.tg_user_id, coalesce(c.plan, 'inactive') plan,
       case when c.expires_at is not null then greatest(0, cast(floor((c.expires_at - {A}) / 86400) as bigint)) end
         days_left,
       q.daily_quota_per_agent daily_quota
from fx_users u
left join (select * from (select *, row_number() over (partition by tg_user_id
                                                       order by expires_at desc, started_at desc) rn
                          from fx_subs_state where is_active = 1) where rn = 1) c on c.tg_user_id = u.tg_user_id
left join (values ('free_trial', 5), ('starter', 50), ('pro', 200), ('business', 1000))
          q(plan, daily_quota_per_agent) on q.plan = c.plan""")
def b10(spark, d):
    fx = Fixtures(spark, d)
    return billing.profile_cards(fx.users(), billing.subscription_state(fx.subscriptions(), A), plan_config(spark), A)


_B11 = f"""
select id, tg_user_id, provider, plan, created_at from fx_payments
where status = 'pending' and {A} - created_at > 3600 and provider <> 'admin_manual'"""


@query("b11_pending_recheck", with_fx("fx_payments") + _B11)
def b11(spark, d):
    return billing.pending_recheck(Fixtures(spark, d).payments(), A)


@query("b12_reconcile_payments", with_fx("fx_payments") + f"""
, snap as (select id, provider,
                  case when provider = 'nowpayments'
                       then ['waiting', 'finished', 'confirmed', 'failed'][id % 4 + 1]
                       else ['created', 'paid', 'success', 'cancel'][id % 4 + 1] end remote_status
           from fx_payments where status = 'pending' and provider <> 'admin_manual')
, pend as ({_B11})
select p.id, p.tg_user_id, p.provider, p.plan, 'paid' status, {A}::bigint finalized_at
from pend p join snap s on s.id = p.id and s.provider = p.provider
where (p.provider = 'nowpayments' and s.remote_status in ('finished', 'confirmed'))
   or (p.provider = 'cryptocloud' and s.remote_status in ('paid', 'success'))""")
def b12(spark, d):
    fx = Fixtures(spark, d)
    return billing.reconcile_payments(billing.pending_recheck(fx.payments(), A), fx.provider_snapshot(), A)


@query("b12_activate_reconciled", with_fx("fx_payments") + f"""
, done as (select *, {A}::bigint paid_at from ({_B11}) p
           where id % 4 in (1, 2))
select id payment_id, tg_user_id, plan, paid_at started_at,
       paid_at + 86400 * case plan when 'free_trial' then 7 else 30 end expires_at
from done""")
def b12a(spark, d):
    """Activation after reconciliation, with the plan's own duration."""
    return billing.activation_intervals(b12(spark, d), plan_config(spark))


@query("b13_fallback_chain", """
with a as (select event_id request_id, r.rank,
                  ['groq', 'openrouter', 'yandex'][r.rank + 1] provider,
                  (event_id + r.rank * 3) % 5 = 0 ok,
                  [429, 500, 400, 503, null][(event_id * (r.rank + 1)) % 5 + 1] st
           from events, (values (0), (1), (2)) r(rank)),
b as (select *, case when ok then null else st end http_status,
             case when ok then null when st is null then 'request timeout' else 'http ' || st end error,
             ok or not (coalesce(st in (408, 425, 429, 500, 502, 503, 504), false)
                        or (st is null and not ok)) stop
      from a),
s as (select request_id, min(rank) filter (where stop) stop_rank from b group by 1),
t as (select b.* from b join s using (request_id) where s.stop_rank is null or b.rank <= s.stop_rank)
select request_id, case when bool_or(ok) then 'ok' else 'failed' end result,
       max(case when ok then provider end) provider_used, count(*)::integer attempts,
       coalesce(string_agg(case when not ok then provider || ': ' || error end, ' | ' order by rank), '') errors
from t group by 1""")
def b13(spark, d):
    return billing.resolve_fallback_chain(Fixtures(spark, d).attempts())


@query("b1_ensure_free_trial", with_fx("fx_subscriptions") + f"""
select c_custkey tg_user_id, 'free_trial' plan, 1 is_active, {A}::bigint started_at,
       {A + 7 * 86400}::bigint expires_at, 'trial_auto' source
from customer where c_custkey not in (select tg_user_id from fx_subscriptions where payment_id is not null)""")
def b1(spark, d):
    users = Tables(spark, d).customer.select(F.col("c_custkey").alias("tg_user_id"))
    paid = Fixtures(spark, d).subscriptions().where(F.col("payment_id").isNotNull())  # users without a payment have none
    return billing.ensure_free_trial(users, paid, A)


@query("b13_invoice_fallback", with_fx("fx_payments") + """
, a as (select id request_id, r.rank, case r.rank when 0 then 'nowpayments' else 'cryptocloud' end provider,
               case r.rank when 0 then id % 5 <> 0 else id % 7 <> 0 end ok,
               case when r.rank = 0 and id % 5 = 0 then 'http 503' when r.rank = 1 and id % 7 = 0 then 'http 400' end error
        from fx_payments, (values (0), (1)) r(rank) where provider <> 'admin_manual'),
s as (select request_id, min(rank) filter (where ok) stop_rank from a group by 1),
t as (select a.* from a join s using (request_id) where s.stop_rank is null or a.rank <= s.stop_rank)
select request_id, case when bool_or(ok) then 'ok' else 'failed' end result,
       max(case when ok then provider end) provider_used, count(*)::integer attempts,
       coalesce(string_agg(case when not ok then provider || ': ' || error end, ' | ' order by rank), '') errors,
       max(case when ok then (case provider when 'nowpayments' then 'np-' else 'cc-' end) || request_id end)
         provider_payment_id
from t group by 1""")
def b13i(spark, d):
    """Invoice creation: provider A, then B; every failure is retryable; both
    failing marks the payment failed; the id carries the provider prefix."""
    p = Fixtures(spark, d).payments().where(F.col("provider") != "admin_manual").select(F.col("id").alias("request_id"))
    att = p.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(1))))
    k, rk = F.col("request_id"), F.col("rank")
    ok = F.when(rk == 0, k % 5 != 0).otherwise(k % 7 != 0)
    att = att.select("request_id", "rank",
                     F.when(rk == 0, "nowpayments").otherwise("cryptocloud").alias("provider"), ok.alias("ok"),
                     F.lit(None).cast("int").alias("http_status"),
                     F.when(~ok, F.when(rk == 0, "http 503").otherwise("http 400")).alias("error"))
    out = billing.resolve_fallback_chain(att, all_retryable=True)
    prefix = F.when(F.col("provider_used") == "nowpayments", "np-").otherwise("cc-")
    return out.withColumn("provider_payment_id",
                          F.when(F.col("result") == "ok", F.concat(prefix, F.col("request_id").cast("string"))))
