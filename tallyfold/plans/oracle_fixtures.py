"""DuckDB text of the fixture views (FIXTURES.md §2), used only by the oracle.

Each oracle query is prefixed with the CTEs it needs, so DuckDB computes the
same derived inputs from the raw parquet views that the Spark fixtures build.
"""

from __future__ import annotations

from ..sources.fixtures import ADMIN_IDS

AS_OF = 801964800  # 1995-06-01 00:00:00 UTC


def E(x: str) -> str:
    return f"(epoch_us({x}) // 1000000)"


FX: dict[str, tuple[list[str], str]] = {
    "fx_users": ([], f"""
        select c_custkey tg_user_id, c_name first_name,
               {E('min(o_orderdate)')} registered_at, {E('max(o_orderdate)')} last_order_at,
               case when c_custkey % 29 = 0 then 1 else 0 end is_banned,
               case when c_custkey % 31 = 0 then 1 else 0 end is_deleted
        from customer join orders on o_custkey = c_custkey
        group by c_custkey, c_name"""),
    "fx_payments": ([], f"""
        select o_orderkey id, o_custkey tg_user_id,
               case when o_orderkey % 10 = 0 then 'admin_manual'
                    when o_orderkey % 3 = 0 then 'cryptocloud' else 'nowpayments' end provider,
               cast(floor(o_totalprice) as bigint) amount_rub,
               case substr(o_orderpriority, 1, 1) when '1' then 'business' when '2' then 'pro'
                    else 'starter' end plan,
               case o_orderstatus when 'F' then 'paid' when 'O' then 'pending'
                    else case o_orderkey % 3 when 0 then 'failed' when 1 then 'expired'
                         else 'refunded' end end status,
               {E('o_orderdate')} created_at,
               case when o_orderstatus <> 'O'
                    then {E('o_orderdate')} + (o_orderkey % 48) * 3600 end finalized_at
        from orders"""),
    "fx_subscriptions": (["fx_payments", "fx_users"], """
        select id payment_id, tg_user_id, plan, 1 is_active, finalized_at started_at,
               finalized_at + 30 * 86400 expires_at, 'webhook' source, finalized_at created_at
        from fx_payments where status = 'paid'
        union all
        select null, tg_user_id, 'free_trial', 1, registered_at, registered_at + 7 * 86400,
               'trial_auto', registered_at
        from fx_users"""),
    "fx_invocations": ([], f"""
        select l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey tg_user_id,
               case l_linenumber % 5 when 0 then 'mp_card_doctor' when 1 then 'mp_review_responder'
                    when 2 then 'mp_competitor_scout' when 3 then 'mp_abc_xyz_analyst'
                    else 'mp_unit_economics' end agent_id,
               case l_suppkey % 3 when 0 then 'groq' when 1 then 'openrouter' else 'yandex' end provider,
               case l_suppkey % 3 when 0 then 'llama-3.3-70b-versatile' when 1 then 'qwen/qwen3.6-plus'
                    else 'yandexgpt/latest' end model,
               cast(l_quantity as bigint) * 400 input_tokens,
               cast(l_quantity as bigint) * 150 output_tokens,
               cast(floor(l_extendedprice) as bigint) % 30000 latency_ms,
               case l_returnflag || l_linestatus when 'AF' then 'timeout' when 'AO' then 'rate_limit'
                    when 'RF' then 'api_error' when 'RO' then 'retried_ok' else 'success' end status,
               {E('l_shipdate')} + l_partkey % 86400 created_at
        from lineitem join orders on l_orderkey = o_orderkey"""),
    "fx_inv_asof": (["fx_invocations"], f"""
        select * from fx_invocations where created_at <= {AS_OF}"""),
    "fx_users_active": (["fx_users", "fx_inv_asof"], """
        select u.*, s.last_seen_at from fx_users u
        left join (select tg_user_id, max(created_at) last_seen_at from fx_inv_asof group by 1) s
          on s.tg_user_id = u.tg_user_id"""),
    "fx_subs_state": (["fx_subscriptions"], f"""
        select payment_id, tg_user_id, plan, started_at, expires_at, source, created_at, closed_at,
               case when closed_at is null and expires_at >= {AS_OF} then 1 else 0 end is_active,
               (closed_at is null and expires_at < {AS_OF}) expired_now
        from (select *, lead(started_at) over (partition by tg_user_id
                                               order by started_at, payment_id nulls first) closed_at
              from fx_subscriptions where started_at <= {AS_OF})"""),
    "llm_rates": ([], """
        select * from (values ('groq', 'llama-3.3-70b-versatile', 59, 79),
                              ('groq', 'qwen-2.5-72b', 59, 79),
                              ('openrouter', 'qwen/qwen3.6-plus', 90, 180),
                              ('openrouter', 'qwen/qwen-2.5-72b-instruct', 80, 120),
                              ('yandex', 'yandexgpt/latest', 40, 120)) t(provider, model, r_in, r_out)"""),
    "fx_inv_cost": (["fx_invocations", "llm_rates"], """
        select i.*, cast(case when coalesce(r1.r_in, r2.r_in) is null then 0
                    else (i.input_tokens * coalesce(r1.r_in, r2.r_in)
                          + i.output_tokens * coalesce(r1.r_out, r2.r_out) + 5000) // 10000 end as bigint)
               cost_usd_e4
        from fx_invocations i
        left join llm_rates r1 on r1.provider = i.provider and r1.model = i.model
        left join llm_rates r2 on r2.provider = i.provider
              and r2.model = string_split(i.model, '/')[-1]"""),
}


def with_fx(*names: str) -> str:
    """Return a ``WITH`` clause defining ``names`` and their dependencies."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in FX[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    return "with " + ",\n".join(f"{n} as ({FX[n][1]})" for n in order) + "\n"

# fx_requests: events as chat requests; fixture limits (FIXTURES.md §2):
# gap 6 h, flood 1 free / 3 paid per burst, free day 2, agent day 1.
FX["fx_requests"] = ([], f"""
        select event_id request_id, user_id tg_user_id, event_type agent_id, {E('ts')} ts,
               case user_id % 4 when 0 then 'free_trial' when 1 then 'starter' when 2 then 'pro'
                    else 'business' end plan
        from events""")
FX["fx_limits"] = ([], """
        select * from (values ('free_trial', 1, 2, 1), ('starter', 3, null, 1), ('pro', 3, null, 1),
                              ('business', 3, null, 1)) t(plan, flood_limit, day_limit, agent_limit)""")
FX["fx_decisions"] = (["fx_requests", "fx_limits"], """
        select request_id, tg_user_id, agent_id, ts, plan,
               case when frej and plan = 'free_trial' then 'free_minute' when frej then 'flood'
                    when drej then 'free_daily' when i > agent_limit then 'daily_quota' else 'allowed' end reason,
               cast(case when not frej and not drej and i <= agent_limit then agent_limit - i else 0 end
                    as bigint) remaining
        from (select *, sum(case when not frej and not drej then 1 else 0 end) over (
                     partition by tg_user_id, agent_id, dt order by ts, request_id rows unbounded preceding) i
              from (select *, (plan = 'free_trial' and not frej and day_limit is not null and dc > day_limit) drej
                    from (select *, sum(case when plan = 'free_trial' and not frej then 1 else 0 end) over (
                                 partition by tg_user_id, dt order by ts, request_id rows unbounded preceding) dc
                          from (select *, fc > flood_limit frej
                                from (select *, row_number() over (partition by tg_user_id, burst
                                                                   order by ts, request_id) fc,
                                             strftime(make_timestamp(cast(ts as bigint) * 1000000), '%Y%m%d') dt
                                      from (select *, sum(case when prev is null or ts - prev >= 21600
                                                               then 1 else 0 end) over (
                                                   partition by tg_user_id order by ts, request_id
                                                   rows unbounded preceding) burst
                                            from (select r.*, l.flood_limit, l.day_limit, l.agent_limit,
                                                         lag(ts) over (partition by tg_user_id
                                                                       order by ts, request_id) prev
                                                  from fx_requests r join fx_limits l using (plan))))))))""")

_RA = "['waiting', 'finished', 'confirmed', 'failed', 'expired', 'refunded', 'partially_paid']"
_RB = "['created', 'success', 'paid', 'fail', 'expired', 'cancel', 'pending']"
FX["fx_callbacks"] = (["fx_payments"], f"""
        select event_id, provider, ts, payment_id, raw_status, tx_hash,
               case when k % 17 = 0 then 'bad_signature' when bad_json then 'bad_json'
                    when payment_id is null then 'no_order_id' when k % 29 = 0 and e = 0 then 'unknown_order'
                    else 'ok' end outcome
        from (select *, case when bad_json or oid = 'abc' then null else cast(oid as bigint) end payment_id,
                     case when bad_json then '' when provider = 'nowpayments' then {_RA}[idx + 1]
                          else {_RB}[idx + 1] end raw_status,
                     case when provider = 'nowpayments' then printf('0x%x', k) end tx_hash
              from (select p.id k, e.e, p.provider, p.id * 2 + e.e event_id, p.created_at + 600 + e.e * 3600 ts,
                           case when p.id % 23 = 0 and e.e = 1 then 'abc'
                                when p.id % 29 = 0 and e.e = 0 then cast(p.id + 1000000000 as varchar)
                                else cast(p.id as varchar) end oid,
                           (p.id * (e.e + 3) + e.e) % 7 idx,
                           (p.provider = 'cryptocloud' and p.id % 31 = 0 and e.e = 1) bad_json
                    from fx_payments p, (values (0), (1)) e(e) where p.provider <> 'admin_manual'))""")
FX["status_map"] = ([], """
        select * from (values ('nowpayments', 'finished', 'paid'), ('nowpayments', 'confirmed', 'paid'),
                              ('nowpayments', 'failed', 'failed'), ('nowpayments', 'expired', 'expired'),
                              ('nowpayments', 'refunded', 'refunded'), ('cryptocloud', 'success', 'paid'),
                              ('cryptocloud', 'paid', 'paid'), ('cryptocloud', 'expired', 'expired'),
                              ('cryptocloud', 'fail', 'failed'), ('cryptocloud', 'cancel', 'failed'))
               t(provider, raw_status, status)""")
FX["fx_norm_events"] = (["fx_callbacks", "status_map"], """
        select c.event_id, c.provider, c.payment_id, c.raw_status, m.status, c.ts, c.tx_hash
        from fx_callbacks c join status_map m on m.provider = c.provider and m.raw_status = c.raw_status
        where c.outcome = 'ok'""")
FX["fx_payment_state"] = (["fx_payments", "fx_norm_events"], """
        select id, tg_user_id, provider, amount_rub, plan, created_at,
               case when take_paid then 'paid' when take_fail then fail_status else s0 end status,
               case when take_paid then paid_ts when take_fail then fail_ts else f0 end finalized_at,
               case when take_paid then paid_tx end tx_hash,
               (take_paid or take_fail) changed
        from (select *, coalesce(paid_ev is not null and s0 <> 'paid', false) take_paid,
                     coalesce(not (paid_ev is not null and s0 <> 'paid') and fail_ev is not null
                              and s0 not in ('paid', 'refunded'), false) take_fail
              from (select p.id, p.tg_user_id, p.provider, p.amount_rub, p.plan, p.created_at,
                           p.status s0, p.finalized_at f0, h.paid_ev, pe.ts paid_ts, pe.tx_hash paid_tx,
                           l.fail_ev, fe.status fail_status, fe.ts fail_ts
                    from fx_payments p
                    left join (select payment_id, min(event_id) filter (where status = 'paid') paid_ev,
                                      min(event_id) filter (where status = 'refunded') ref_ev
                               from fx_norm_events group by 1) h on h.payment_id = p.id
                    left join (select e.payment_id, max(e.event_id) fail_ev
                               from fx_norm_events e
                               join (select payment_id, min(event_id) filter (where status = 'refunded') ref_ev
                                     from fx_norm_events group by 1) r on r.payment_id = e.payment_id
                               where e.status in ('failed', 'expired', 'refunded')
                                 and (r.ref_ev is null or e.event_id <= r.ref_ev)
                               group by 1) l on l.payment_id = p.id
                    left join fx_norm_events pe on pe.event_id = h.paid_ev
                    left join fx_norm_events fe on fe.event_id = l.fail_ev))""")

FX["fx_updates"] = ([], f"""
        select case when k % 97 = 0 then null else k end update_id,
               case when k % 97 = 0 then 'quarantine' when k % 7 = 0 then 'callback'
                    when k % 89 = 0 then 'quarantine' else 'message' end kind,
               case when k % 97 = 0 or (k % 7 <> 0 and k % 89 = 0) then null else u end user_id,
               case when k % 97 = 0 then null else u end chat_id,
               case when k % 97 = 0 then null else t end ts,
               case when k % 97 = 0 or k % 7 = 0 then null else txt end text,
               case when k % 97 <> 0 and k % 7 = 0
                    then 'agent:' || ['mp_card_doctor', 'mp_review_responder', 'mp_competitor_scout',
                                      'mp_abc_xyz_analyst', 'mp_unit_economics', 'unknown_bot'][k % 6 + 1] end data,
               case when k % 97 = 0 or (k % 7 <> 0 and k % 89 = 0) or u % 3 = 0 then null else 'u' || u end username,
               case when k % 97 = 0 or (k % 7 <> 0 and k % 89 = 0) then null else 'User' || u end first_name,
               null::varchar last_name,
               case when k % 97 = 0 or (k % 7 <> 0 and k % 89 = 0) then null
                    else ['ru', 'en'][u % 2 + 1] end language_code
        from (select event_id k, user_id u, {E('ts')} t,
                     case event_type when 'signup' then '/start ref_' || ((event_id * 7) % 151)
                          when 'purchase' then '/pay' when 'view' then '/me'
                          when 'click' then case when event_id % 2 = 0 then '/cancel' else '/menu' end
                          else case when event_id % 5 = 0 then '/admin stats'
                                    when event_id % 10 = 1 then concat_ws(' ', '/admin activate', ((event_id * 3) % 150)::varchar,
                                         ['starter', 'pro', 'business', 'free_trial', 'gold'][event_id % 5 + 1],
                                         case when event_id % 3 <> 0 then (7 * (event_id % 5 + 1))::varchar end)
                                    when event_id % 10 = 6 then '/admin ' || case when event_id % 20 = 6 then 'ban' else 'unban' end
                                         || ' ' || ((event_id * 11) % 150)
                                    else 'how do I price sku ' || event_id end end txt
              from events, (values (0), (1)) c(c) where c.c = 0 or event_id % 50 = 0)""")
FX["fx_upd_dedup"] = (["fx_updates"], """
        select distinct * from fx_updates where kind in ('message', 'callback')""")
FX["fx_base_users"] = (["fx_users"], """
        select tg_user_id, null::varchar username, first_name, null::varchar last_name,
               null::varchar language_code, registered_at, is_banned, is_deleted,
               last_order_at last_seen_at, null::varchar utm_source
        from fx_users""")
FX["fx_users_merged"] = (["fx_base_users", "fx_upd_dedup"], """
        select coalesce(b.tg_user_id, a.user_id) tg_user_id,
               case when a.user_id is not null then a.username else b.username end username,
               case when a.user_id is not null then a.first_name else b.first_name end first_name,
               case when a.user_id is not null then a.last_name else b.last_name end last_name,
               case when a.user_id is not null then a.language_code else b.language_code end language_code,
               coalesce(b.registered_at, a.first_ts) registered_at, coalesce(b.is_banned, 0) is_banned,
               coalesce(b.is_deleted, 0) is_deleted,
               case when a.user_id is not null then greatest(a.last_ts, coalesce(b.last_seen_at, a.last_ts))
                    else b.last_seen_at end last_seen_at,
               b.utm_source
        from fx_base_users b
        full join (select user_id, arg_max(username, ts * 1000000000 + update_id) username,
                          arg_max(first_name, ts * 1000000000 + update_id) first_name,
                          arg_max(last_name, ts * 1000000000 + update_id) last_name,
                          arg_max(language_code, ts * 1000000000 + update_id) language_code,
                          min(ts) first_ts, max(ts) last_ts
                   from fx_upd_dedup where kind = 'message' group by 1) a on a.user_id = b.tg_user_id""")
FX["fx_messages"] = (["fx_upd_dedup"], """
        select m.*, case when t like '/start%' then 'start' when t like '/help%' then 'help'
                         when t like '/agents%' then 'agents' when t like '/pay%' then 'pay'
                         when t like '/plans%' then 'pay' when t like '/me%' then 'me'
                         when t like '/profile%' then 'me' when t like '/about%' then 'about'
                         when t like '/cancel%' then 'cancel' when t like '/admin%' then 'admin'
                         else 'free_text' end command
        from (select * exclude (text), trim(text) t, trim(text) text from fx_upd_dedup where kind = 'message') m""")
# commands of administrators who are not banned from the start
FX["cmdv"] = (["fx_messages", "fx_users_merged"], """
        select *, coalesce((sub = 'activate' and target is not null and target <> 0
                            and plan in ('free_trial', 'starter', 'pro', 'business') and "days" is not null)
                           or (sub in ('ban', 'unban') and target is not null and target <> 0), false) valid
        from (select cmd_id, admin_id, ts, coalesce(parts[2], 'help') sub,
                     try_cast(nullif(regexp_extract(coalesce(parts[3], ''), '^\\s*([+-]?[0-9]+)', 1), '') as bigint) target,
                     case when coalesce(parts[2], 'help') = 'activate' then parts[4] end plan,
                     case when coalesce(parts[2], 'help') = 'activate' then
                          case when parts[5] is null then 30
                               else try_cast(nullif(regexp_extract(parts[5], '^\\s*([+-]?[0-9]+)', 1), '') as bigint) end end "days"
              from (select update_id cmd_id, user_id admin_id, ts, string_split_regex(trim(text), '\\s+') parts
                    from fx_messages where command = 'admin' and user_id in (""" + ", ".join(map(str, ADMIN_IDS)) + """)
                      and user_id not in (select tg_user_id from fx_users_merged where is_banned = 1)))""")
# the last ban or unban before a message, else the user's flag, decides
FX["fx_handled"] = (["fx_messages", "cmdv", "fx_users_merged"], """
        select * from fx_messages m where coalesce(
          (select arg_max(sub, ts * 1000000000 + cmd_id) from cmdv c where valid and sub in ('ban', 'unban') and c.target = m.user_id
             and c.ts * 1000000000 + c.cmd_id < m.ts * 1000000000 + m.update_id),
          (select case when max(is_banned) = 1 then 'ban' end from fx_users_merged u where u.tg_user_id = m.user_id), 'unban') <> 'ban'""")
FX["fx_selections"] = (["fx_upd_dedup"], """
        select *, substr(data, 7) agent_id from fx_upd_dedup
        where kind = 'callback' and data like 'agent:%'
          and substr(data, 7) in ('mp_card_doctor', 'mp_review_responder', 'mp_competitor_scout',
                                  'mp_abc_xyz_analyst', 'mp_unit_economics')""")
