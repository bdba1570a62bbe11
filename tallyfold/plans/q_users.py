"""Registered queries: chat updates, users, sessions, context (S3, U*, B8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import billing, users
from ..sources import updates as upd
from ..sources.fixtures import ADMIN_IDS, AS_OF, Fixtures
from ..sources.reference_data import AGENTS
from ..functions.windows import _once
from ..sources.tables import Tables
from .oracle_fixtures import with_fx
from .registry import query

PARSED_COLS = ["update_id", "kind", "user_id", "chat_id", "ts", "text", "data", "username", "first_name",
               "last_name", "language_code"]


def parsed(spark, d):
    return upd.parse_updates(Fixtures(spark, d).updates())


def deduped(spark, d):
    """Parsed, routed and de-duplicated updates, materialised once per query:
    the user, command and session jobs all read them."""
    return _once(upd.routed_updates(parsed(spark, d)))


def base_users(spark, d):
    fx = Fixtures(spark, d)
    return fx.users().select(
        "tg_user_id", F.lit(None).cast("string").alias("username"), "first_name",
        F.lit(None).cast("string").alias("last_name"), F.lit(None).cast("string").alias("language_code"),
        "registered_at", "is_banned", "is_deleted", F.col("last_order_at").alias("last_seen_at"),
        F.lit(None).cast("string").alias("utm_source"))


def merged_users(spark, d, dd=None):
    return users.upsert_users(base_users(spark, d), deduped(spark, d) if dd is None else dd)


def admin_cmds(spark, d, dd=None):
    """Commands of administrators who are not banned from the start."""
    dd = deduped(spark, d) if dd is None else dd
    flagged = merged_users(spark, d, dd).where("is_banned = 1").select(F.col("tg_user_id").alias("user_id"))
    sent = users.messages_of(dd).where(F.col("user_id").isin(ADMIN_IDS)).join(flagged, "user_id", "left_anti")
    return billing.admin_commands(sent.withColumn("command", users.classify_command(F.col("text"))), ADMIN_IDS)


def handled(spark, d, dd=None):
    """Messages handled: not banned when they arrived."""
    dd = deduped(spark, d) if dd is None else dd
    return users.handled_messages(dd, users.ban_intervals(merged_users(spark, d, dd), admin_cmds(spark, d, dd)))


@query("s3_parse_updates", with_fx("fx_updates") + "select * from fx_updates")
def s3(spark, d):
    return parsed(spark, d).select(*PARSED_COLS)


@query("u1_upsert_users", with_fx("fx_users_merged") + "select * from fx_users_merged")
def u1(spark, d):
    return merged_users(spark, d)


@query("u2_first_touch_attribution", with_fx("fx_users_merged", "fx_handled") + """
select u.tg_user_id, case when coalesce(u.utm_source, '') = '' then r.ref else u.utm_source end utm_source
from fx_users_merged u
join (select user_id, arg_min('ref_' || n, ts * 1000000000 + update_id) ref
      from (select *, case when coalesce(split_part(regexp_replace(text, '\\s+', ' ', 'g'), ' ', 2), '')
                                like 'ref_%'
                           then try_cast(nullif(regexp_extract(
                                  substr(split_part(regexp_replace(text, '\\s+', ' ', 'g'), ' ', 2), 5),
                                  '^\\s*([+-]?[0-9]+)', 1), '') as bigint) end n
            from fx_handled where command = 'start')
      where n is not null and n <> 0 and n <> user_id group by 1) r on r.user_id = u.tg_user_id""")
def u2(spark, d):
    dd = deduped(spark, d)
    u = users.first_touch_attribution(merged_users(spark, d, dd), handled(spark, d, dd))
    return u.where(F.col("utm_source").isNotNull()).select("tg_user_id", "utm_source")


@query("u3_command_mix", with_fx("fx_handled") + """
select cast(strftime(make_timestamp(cast(ts as bigint) * 1000000), '%Y%m%d') as integer) date, command, count(*) n
from fx_handled group by 1, 2""")
def u3(spark, d):
    return users.command_mix(handled(spark, d))


@query("u3_ban_intervals", with_fx("cmdv", "fx_users_merged") + """
, act as (select target user_id, ts, cmd_id id, sub from cmdv where valid and sub in ('ban', 'unban')
          union all select tg_user_id, -(2::bigint ** 62)::bigint, -(2::bigint ** 62)::bigint, 'ban' from fx_users_merged where is_banned = 1),
o as (select *, row_number() over (partition by user_id order by ts, id) n from act),
-- a ban counts if the command before it is no ban; it ends with the first unban after it
b as (select * from o where sub = 'ban' and not exists (select 1 from o p where p.user_id = o.user_id and p.n = o.n - 1 and p.sub = 'ban'))
select user_id, ts from_ts, id from_id,
       (select arg_min(ts, n) from o e where e.user_id = b.user_id and e.n > b.n and e.sub = 'unban') to_ts,
       (select arg_min(id, n) from o e where e.user_id = b.user_id and e.n > b.n and e.sub = 'unban') to_id
from b""")
def u3_bans(spark, d):
    """When each user is banned."""
    dd = deduped(spark, d)
    return users.ban_intervals(merged_users(spark, d, dd), admin_cmds(spark, d, dd))


@query("u4_session_state", with_fx("fx_selections") + """
select user_id tg_user_id, arg_max(agent_id, ts * 1000000000 + update_id) active_agent_id,
       max(ts) updated_at, 'awaiting_input' state
from fx_selections group by 1""")
def u4(spark, d):
    return users.session_state(deduped(spark, d)).drop("context_window")


@query("u5_agent_as_of", with_fx("fx_handled", "fx_selections") + """
select update_id, user_id, ts, text, coalesce(a, 'no_agent') agent_id
from (select *, last_value(sel ignore nulls) over (partition by user_id order by ts, kind2, update_id
                                                   rows between unbounded preceding and current row) a
      from (select update_id, user_id, ts, text, 1 kind2, null sel from fx_handled where command = 'free_text'
            union all
            select update_id, user_id, ts, null, 0, agent_id from fx_selections))
where kind2 = 1""")
def u5(spark, d):
    dd = deduped(spark, d)
    return users.agent_as_of(handled(spark, d, dd), dd)


def conv_messages(spark, d):
    c = Tables(spark, d).conversations
    return c.select(F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content"),
                    F.element_at(F.array(*[F.lit(a) for a in AGENTS]), (F.col("conv_id") % 5).cast("int") + 1)
                    .alias("agent_id"))


@query("u6_context_window", """
select session_id, turn, pos, role, content from (
  select c.conv_id session_id, c.turn, cast(h.turn - (c.turn - 3) as integer) pos, h.role, h.text content
  from conversations c join conversations h on h.conv_id = c.conv_id and h.turn between c.turn - 3 and c.turn)""")
def u6(spark, d):
    w = users.context_window(conv_messages(spark, d), n=4)
    # position relative to a full frame of 4, so short (early) frames align
    return (w.select("session_id", "turn", F.size("context").alias("_n"), F.posexplode("context").alias("p", "m"))
            .select("session_id", "turn", (F.col("p") + 4 - F.col("_n")).alias("pos"), "m.role",
                    "m.content"))


PROMPTS_FIXTURE = [(a, f"system prompt for {a}") for a in AGENTS if a != "mp_unit_economics"]


@query("u7_assemble_prompts", """
with c as (select conv_id session_id, turn, role, text content,
                  ['mp_card_doctor', 'mp_review_responder', 'mp_competitor_scout', 'mp_abc_xyz_analyst',
                   'mp_unit_economics'][conv_id % 5 + 1] agent_id from conversations),
p as (select session_id, turn, agent_id, content from c where role = 'user'),
h as (select p.session_id, p.turn, c.turn hturn, c.role, c.content from p
      join c on c.session_id = p.session_id and c.turn between p.turn - 8 and p.turn - 1)
select session_id, turn, cast(pos as integer) pos, role, content from (
select session_id, turn, 0 pos, 'system' role,
       case when agent_id = 'mp_unit_economics' then 'You are a helpful WB/Ozon seller assistant. Answer concisely in Russian.'
            else 'system prompt for ' || agent_id end content from p
union all
select session_id, turn, row_number() over (partition by session_id, turn order by hturn) pos, role, content from h
union all
select p.session_id, p.turn, (select count(*) from h where h.session_id = p.session_id and h.turn = p.turn) + 1,
       'user', p.content from p)""")
def u7(spark, d):
    prompts = spark.createDataFrame(PROMPTS_FIXTURE, "agent_id string, system_prompt string")
    pr = users.assemble_prompts(conv_messages(spark, d), prompts, n=8)
    return pr.select("session_id", "turn", F.posexplode("prompt").alias("pos", "m")).select(
        "session_id", "turn", "pos", "m.role", "m.content")


@query("u8_explode_exchanges", with_fx("fx_handled", "fx_selections") + """
, x as (select update_id, user_id, ts, text, coalesce(a, 'no_agent') agent_id
        from (select *, last_value(sel ignore nulls) over (partition by user_id order by ts, kind2, update_id
                                                           rows between unbounded preceding and current row) a
              from (select update_id, user_id, ts, text, 1 kind2, null sel from fx_handled
                    where command = 'free_text'
                    union all select update_id, user_id, ts, null, 0, agent_id from fx_selections))
        where kind2 = 1 and a is not null)
select user_id, agent_id, ts, 'user' role, text content from x where update_id % 3 <> 0
union all
select user_id, agent_id, ts, 'assistant', 'reply to ' || update_id from x""")
def u8(spark, d):
    return exchanges(spark, d)[1]


def exchanges(spark, d):
    """(invocation rows, message rows) of the handled free-text messages."""
    dd = deduped(spark, d)
    ex = users.agent_as_of(handled(spark, d, dd), dd).where(F.col("agent_id") != "no_agent")
    ex = ex.select("user_id", "agent_id", "ts", "text", F.format_string("reply to %d", F.col("update_id")).alias("reply"),
                   (F.col("update_id") % 3 == 0).alias("retried"), F.lit("groq").alias("provider"),
                   F.lit("llama-3.3-70b-versatile").alias("model"), F.lit(0).cast("long").alias("input_tokens"),
                   F.lit(0).cast("long").alias("output_tokens"))
    return users.explode_exchanges(ex)


_X_SQL = with_fx("fx_handled", "fx_selections") + """
, x as (select update_id, user_id, ts, text, a agent_id
        from (select *, last_value(sel ignore nulls) over (partition by user_id order by ts, kind2, update_id
                                                           rows between unbounded preceding and current row) a
              from (select update_id, user_id, ts, text, 1 kind2, null sel from fx_handled
                    where command = 'free_text'
                    union all select update_id, user_id, ts, null, 0, agent_id from fx_selections))
        where kind2 = 1 and a is not null)"""


@query("u8_invocation_rows", _X_SQL + """
select user_id, agent_id, ts, 'groq' provider, 'llama-3.3-70b-versatile' model, 0::bigint input_tokens,
       0::bigint output_tokens, case when update_id % 3 = 0 then 'retried_ok' else 'success' end status from x""")
def u8i(spark, d):
    return exchanges(spark, d)[0]


MESSAGE_CUTOFF = 1706659200 - 20 * 86400  # inside the fixture's month; a job passes now minus the 30-day message TTL


@query("r14_message_purge", _X_SQL + f"""
, m as (select ts from x where update_id % 3 <> 0 union all select ts from x)
select 'messages' table_name, count(*) filter (where ts >= {MESSAGE_CUTOFF}) kept,
       count(*) filter (where ts < {MESSAGE_CUTOFF}) deleted from m""")
def r14m(spark, d):
    from ..operators import cohorts
    return cohorts.purge_report(exchanges(spark, d)[1], "messages", "ts", MESSAGE_CUTOFF)


@query("b8_account_commands", with_fx("fx_subs_state", "fx_handled") + """
select payment_id, tg_user_id, plan, is_active,
       case when cancelled_now then 0 else auto_renew end auto_renew, cancelled_now
from (select s.*, coalesce(s.is_active = 1 and s.auto_renew = 1 and c.user_id is not null, false) cancelled_now
      from (select *, case when payment_id % 2 = 0 then 1 else 0 end auto_renew from fx_subs_state) s
      left join (select distinct user_id from fx_handled where command = 'cancel') c on c.user_id = s.tg_user_id)""")
def b8(spark, d):
    fx = Fixtures(spark, d)
    subs = billing.subscription_state(fx.subscriptions(), AS_OF).withColumn(
        "auto_renew", F.when(F.col("payment_id") % 2 == 0, 1).otherwise(0))
    dd = deduped(spark, d)
    cmds = handled(spark, d, dd).where(F.col("command") == "cancel").select(
        F.col("user_id").alias("tg_user_id"), "ts", F.col("update_id").alias("cmd_id"),
        F.lit("cancel").alias("action"))
    s, _ = billing.account_commands(subs, merged_users(spark, d, dd), cmds)
    return s.select("payment_id", "tg_user_id", "plan", "is_active", "auto_renew", "cancelled_now")


@query("b4_manual_activations", with_fx("cmdv") + """
select cmd_id, target tg_user_id, plan, "days", ts started_at, ts + "days" * 86400 expires_at,
       plan <> 'free_trial' creates_payment, 'admin_manual' source
from cmdv where valid and sub = 'activate'""")
def b4m(spark, d):
    return billing.manual_activations(admin_cmds(spark, d))


@query("b8_ban_fold", with_fx("cmdv", "fx_users_merged") + """
, last as (select target tg_user_id, arg_max(sub, ts * 1000000000 + cmd_id) last_action
           from cmdv where valid and sub in ('ban', 'unban') group by 1)
select u.tg_user_id, case when l.last_action = 'ban' then 1 when l.last_action = 'unban' then 0 else u.is_banned end
       is_banned, l.last_action is not null ban_changed
from fx_users_merged u left join last l using (tg_user_id)""")
def b8b(spark, d):
    dd = deduped(spark, d)
    return billing.ban_fold(merged_users(spark, d, dd), admin_cmds(spark, d, dd)).select(
        "tg_user_id", "is_banned", "ban_changed")


@query("r14_purged_days", _X_SQL + f"""
, m as (select ts from x where update_id % 3 <> 0 union all select ts from x)
select cast(strftime(make_timestamp(cast(ts as bigint) * 1000000), '%Y%m%d') as integer) "day",
       count(*) filter (where ts < {MESSAGE_CUTOFF + 43200}) deleted, count(*) filter (where ts >= {MESSAGE_CUTOFF + 43200}) "left" from m group by 1""")
def r14d(spark, d):
    """Messages stored by day, then purged at noon of a day: rows deleted and
    left per day, the latter read back from the table."""
    import uuid

    from ..operators import cohorts
    from ..session import ensure_checkpoint_dir

    path = ensure_checkpoint_dir(spark).rstrip("/") + f"/messages-{uuid.uuid4().hex[:12]}"
    cohorts.store_by_day(exchanges(spark, d)[1], path, "ts")
    deleted = cohorts.purge_days(spark, path, "ts", MESSAGE_CUTOFF + 43200)
    left = spark.read.parquet(path).groupBy("day").agg(F.count(F.lit(1)).alias("left"))
    none = F.lit(0).cast("long")
    return deleted.join(left, "day", "full").select("day", F.coalesce("deleted", none).alias("deleted"), F.coalesce("left", none).alias("left"))
