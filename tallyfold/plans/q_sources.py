"""Registered queries: integrity report (S2), logs (S5), provider responses (S6), upsert sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import billing
from ..operators import integrity as I
from ..sources.fixtures import AS_OF, Fixtures
from ..sources.tables import Tables
from .oracle_fixtures import with_fx
from .registry import query


def _enum_sql(col: str, vals: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in vals) + ")"


# a state per conversation; one in five is none of the schema's states
_STATE_SQL = "case conv_id % 5 when 0 then 'idle' when 1 then 'awaiting_input' when 2 then 'processing' when 3 then 'error' else 'closed' end"


@query("s2_constraint_report", with_fx("fx_payments", "fx_users", "fx_subs_state", "fx_invocations") + f"""
select table_name, rule, cast(violations as bigint) violations from (
select 'payments' table_name, 'not_null:tg_user_id' rule, count(*) filter (where tg_user_id is null) violations
from fx_payments
union all select 'payments', 'not_null:amount_rub', count(*) filter (where amount_rub is null) from fx_payments
union all select 'payments', 'check:provider', count(*) filter (where provider not in {_enum_sql('p', I.PROVIDERS)})
from fx_payments
union all select 'payments', 'check:plan', count(*) filter (where plan not in {_enum_sql('p', I.PAID_PLANS)}) from fx_payments
union all select 'payments', 'check:status', count(*) filter (where status not in {_enum_sql('s', I.PAYMENT_STATUS)})
from fx_payments
union all select 'payments', 'unique:id', coalesce(sum(n - 1), 0) from (select id, count(*) n from fx_payments group by 1 having count(*) > 1)
union all select 'payments', 'fk:tg_user_id', count(*) from fx_payments p
  where tg_user_id is not null and not exists (select 1 from fx_users u where u.tg_user_id = p.tg_user_id)
union all select 'subscriptions', 'not_null:expires_at', count(*) filter (where expires_at is null) from fx_subs_state
union all select 'subscriptions', 'check:plan', count(*) filter (where plan not in {_enum_sql('p', I.PLANS)}) from fx_subs_state
union all select 'subscriptions', 'unique:payment_id', coalesce(sum(n - 1), 0)
  from (select payment_id, count(*) n from fx_subs_state where payment_id is not null group by 1 having count(*) > 1)
union all select 'subscriptions', 'fk:tg_user_id', count(*) from fx_subs_state s
  where tg_user_id is not null and not exists (select 1 from fx_users u where u.tg_user_id = s.tg_user_id)
union all select 'subscriptions', 'fk:payment_id', count(*) from fx_subs_state s
  where payment_id is not null and not exists (select 1 from fx_payments p where p.id = s.payment_id)
union all select 'subscriptions', 'one_active_per:tg_user_id', count(*)
  from (select tg_user_id from fx_subs_state where is_active = 1 group by 1 having count(*) > 1)
union all select 'agent_invocations', 'not_null:agent_id', count(*) filter (where agent_id is null) from fx_invocations
union all select 'agent_invocations', 'check:status',
  count(*) filter (where status not in {_enum_sql('s', I.INVOCATION_STATUS)}) from fx_invocations
union all select 'agent_invocations', 'fk:tg_user_id', count(*) from fx_invocations i
  where tg_user_id is not null and not exists (select 1 from fx_users u where u.tg_user_id = i.tg_user_id))""")
def s2(spark, d):
    fx = Fixtures(spark, d)
    users, pays = fx.users(), fx.payments()
    subs = billing.subscription_state(fx.subscriptions(), AS_OF)
    return I.constraint_report([
        I.TableRules("payments", pays, not_null=["tg_user_id", "amount_rub"],
                     enums={"provider": I.PROVIDERS, "plan": I.PAID_PLANS, "status": I.PAYMENT_STATUS},
                     keys=[["id"]], fks=[("tg_user_id", users, "tg_user_id")]),
        I.TableRules("subscriptions", subs, not_null=["expires_at"], enums={"plan": I.PLANS},
                     unique_not_null=[["payment_id"]],
                     fks=[("tg_user_id", users, "tg_user_id"), ("payment_id", pays, "id")],
                     one_active_per="tg_user_id"),
        I.TableRules("agent_invocations", fx.invocations(), not_null=["agent_id"],
                     enums={"status": I.INVOCATION_STATUS}, fks=[("tg_user_id", users, "tg_user_id")]),
    ])


@query("s2_chat_constraints", with_fx("fx_payments") + f"""
, sessions as (select conv_id tg_user_id, {_STATE_SQL} state from conversations),
quota as (select user_id tg_user_id, event_type agent_id,
                 cast(strftime(ts, '%Y%m%d') as integer) date from events),
pay as (select provider, case when provider <> 'admin_manual' then id // 2 end pid from fx_payments)
select table_name, rule, cast(violations as bigint) violations from (
select 'sessions' table_name, 'not_null:state' rule, count(*) filter (where state is null) violations from sessions
union all select 'sessions', 'check:state', count(*) filter (where state not in {_enum_sql('s', I.SESSION_STATE)}) from sessions
union all select 'sessions', 'unique:tg_user_id', count(*) - count(distinct tg_user_id) from sessions
union all select 'messages', 'not_null:content', count(*) filter (where text is null) from conversations
union all select 'messages', 'check:role', count(*) filter (where role not in {_enum_sql('r', I.MESSAGE_ROLE)}) from conversations
union all select 'messages', 'fk:conv_id', count(*) from conversations c
  where not exists (select 1 from customer u where u.c_custkey = c.conv_id)
union all select 'usage_quota', 'not_null:agent_id', count(*) filter (where agent_id is null) from quota
union all select 'usage_quota', 'unique:tg_user_id,agent_id,date', count(*) - (select count(*) from (select distinct * from quota))
from quota
union all select 'payments', 'unique:provider,provider_payment_id',
  count(*) - (select count(*) from (select distinct * from pay where pid is not null)) from pay where pid is not null)""")
def s2_chat(spark, d):
    """Rules of sessions, messages and usage_quota, and the partial unique
    provider key, over views that break some of them."""
    t = Tables(spark, d)
    conv = t.conversations
    sessions = conv.select(F.col("conv_id").alias("tg_user_id"), F.expr(_STATE_SQL).alias("state"))
    quota = t.events.select(F.col("user_id").alias("tg_user_id"), F.col("event_type").alias("agent_id"),
                            F.date_format("ts", "yyyyMMdd").cast("int").alias("date"))
    pay = Fixtures(spark, d).payments().select("provider", F.when(
        F.col("provider") != "admin_manual", F.floor(F.col("id") / 2)).alias("provider_payment_id"))
    return I.constraint_report([
        I.TableRules("sessions", sessions, not_null=["state"], enums={"state": I.SESSION_STATE}, keys=[["tg_user_id"]]),
        I.TableRules("messages", conv.select("conv_id", "role", F.col("text").alias("content")), not_null=["content"],
                     enums={"role": I.MESSAGE_ROLE}, fks=[("conv_id", t.customer, "c_custkey")]),
        I.TableRules("usage_quota", quota, not_null=["agent_id"], keys=[["tg_user_id", "agent_id", "date"]]),
        I.TableRules("payments", pay, unique_not_null=[["provider", "provider_payment_id"]]),
    ])


# ---- S5 logs -------------------------------------------------------------------
from ..operators.telemetry import invocation_cost  # noqa: E402
from ..session import ensure_checkpoint_dir  # noqa: E402
from ..sources import logs as L  # noqa: E402
from ..sources.reference_data import llm_rates  # noqa: E402

LOGS_SQL = """
lg as (select case when event_id % 50 = 7 then null else (epoch_us(ts) // 1000000) * 1000 end ts,
              case when event_id % 50 = 7 then null when event_id % 4 = 1 then 'warn' when event_id % 4 = 2 then 'error'
                   else 'info' end level,
              case when event_id % 50 = 7 then null else event_type end event,
              case when event_id % 50 = 7 then null else user_id end user_id,
              case when event_id % 50 = 7 then null else 'mp_card_doctor' end agent_id,
              case when event_id % 50 = 7 then null else event_id % 1000 end latency_ms,
              null::varchar error,
              case when event_id % 50 = 7 then 'malformed' else 'ok' end status
       from events)"""


@query("s5_parse_logs", "with " + LOGS_SQL + " select * from lg")
def s5(spark, d):
    return L.parse_logs(Fixtures(spark, d).logs())


@query("s5_log_counts", "with " + LOGS_SQL + " select event, level, count(*) n from lg where status = 'ok' group by 1, 2")
def s5c(spark, d):
    return L.log_counts(L.parse_logs(Fixtures(spark, d).logs()))


# ---- S6 provider responses --------------------------------------------------------
RESP_SQL = """
r as (select event_id k, cast(regexp_extract(props, '(\\d+)', 1) as bigint) n,
             case event_id % 3 when 0 then 'groq' when 1 then 'openrouter' else 'yandex' end provider from events),
resp as (select k request_id, provider,
                (k % 17 = 0 or (provider = 'groq' and k % 11 = 0)) bad, n, k from r),
norm as (select request_id, provider,
                case when bad then null when provider = 'groq' then 'llama-3.3-70b-versatile'
                     when provider = 'openrouter' then case when k % 2 = 0 then 'qwen/qwen-2.5-72b-instruct'
                                                             else 'qwen/qwen3.6-plus' end
                     else 'yandexgpt/latest' end model,
                case when bad then null when k % 13 = 0 then '' else 'answer ' || n end content,
                case when bad then null when provider <> 'groq' and k % 11 = 0 then 0 else n * 10 end input_tokens,
                case when bad then null when provider = 'openrouter' and k % 11 = 0 then 0 else n * 3 end output_tokens,
                case when bad then 'quarantine' else 'ok' end status
         from resp)"""


@query("s6_provider_responses", "with " + RESP_SQL + " select * from norm")
def s6(spark, d):
    return L.normalize_provider_responses(Fixtures(spark, d).responses())


@query("s6_response_cost", with_fx("llm_rates") + ", " + RESP_SQL + """
select provider, model, count(*) responses, cast(sum((input_tokens * r_in + output_tokens * r_out + 5000) // 10000)
       as bigint) cost_usd_e4
from norm join llm_rates using (provider, model) where status = 'ok' group by 1, 2""")
def s6c(spark, d):
    n = L.normalize_provider_responses(Fixtures(spark, d).responses()).where(F.col("status") == "ok")
    c = invocation_cost(n, llm_rates(spark))
    return c.groupBy("provider", "model").agg(F.count(F.lit(1)).alias("responses"),
                                              F.sum("cost_usd_e4").alias("cost_usd_e4"))


# ---- S7 upsert sink ---------------------------------------------------------------
@query("s7_upsert_payments", with_fx("fx_payment_state") + """
select id, tg_user_id, provider, amount_rub, plan, created_at, status, finalized_at from fx_payment_state""")
def s7(spark, d):
    """Write the payments table, then upsert the callback fold's changed rows
    twice (replay): the table equals the folded state."""
    import uuid

    from .q_billing import payment_state

    cols = ["id", "tg_user_id", "provider", "amount_rub", "plan", "created_at", "status", "finalized_at"]
    path = ensure_checkpoint_dir(spark).rstrip("/") + f"/tables/payments-{uuid.uuid4().hex[:12]}"
    base = Fixtures(spark, d).payments().select(*cols).withColumn("_v", F.lit(0))
    base.write.partitionBy("provider").parquet(path)
    changed = payment_state(spark, d).where(F.col("changed")).select(*cols).withColumn("_v", F.lit(1))
    changed.write.parquet(f"{path}-changed")  # computed once, delivered twice
    changed = spark.read.schema(changed.schema).parquet(f"{path}-changed")
    for _ in range(2):
        L.upsert_parquet(spark, changed, path, ["id"], ["_v"], ["provider"])
    return spark.read.parquet(path).select(*cols)
