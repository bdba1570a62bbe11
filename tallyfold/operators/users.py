"""Users, attribution, commands, sessions and conversation context.

Inputs are parsed updates (``sources.updates``): one row per update with
``kind`` in message / callback.  All folds are grouped aggregates or bounded
window frames; nothing is collected per user except the fixed-size context
frame (at most ``n`` entries).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import parse_int_prefix
from ..functions.time import DAY, idiv, yyyymmdd
from ..functions.windows import adaptive_chunk, chunked_frame_list, chunked_last_non_null
from ..sources.reference_data import AGENTS, DEFAULT_SYSTEM_PROMPT


def messages_of(updates: DataFrame) -> DataFrame:
    return updates.where(F.col("kind") == "message").withColumn("text", F.trim("text"))


# U1 -------------------------------------------------------------------------
def upsert_users(users: DataFrame, updates: DataFrame) -> DataFrame:
    """Fold message senders into ``users``: profile fields last-write-wins
    (nulls overwrite, as the upsert binds them), ``last_seen_at`` = latest
    message; registration, ban flag and ``utm_source`` kept from the
    existing row (new users register at their first message)."""
    m = messages_of(updates)
    prof = F.struct("username", "first_name", "last_name", "language_code")
    agg = m.groupBy(F.col("user_id").alias("tg_user_id")).agg(
        F.max_by(prof, F.struct("ts", "update_id")).alias("_p"),
        F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    base = users.select("tg_user_id", "username", "first_name", "last_name", "language_code", "registered_at",
                        "is_banned", "is_deleted", "last_seen_at", "utm_source")
    j = base.join(agg, "tg_user_id", "full")
    upd = F.col("_p").isNotNull()
    return j.select(
        "tg_user_id",
        *[F.when(upd, F.col("_p")[c]).otherwise(F.col(c)).alias(c)
          for c in ("username", "first_name", "last_name", "language_code")],
        F.coalesce("registered_at", "_first").alias("registered_at"),
        F.coalesce("is_banned", F.lit(0)).alias("is_banned"),
        F.coalesce("is_deleted", F.lit(0)).alias("is_deleted"),
        F.when(upd, F.greatest(F.col("_last"), F.coalesce("last_seen_at", F.col("_last"))))
         .otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        "utm_source")


# U3 -------------------------------------------------------------------------
# fixed command prefixes, in the order they are tested
COMMANDS = [("/start", "start"), ("/help", "help"), ("/agents", "agents"), ("/pay", "pay"), ("/plans", "pay"),
            ("/me", "me"), ("/profile", "me"), ("/about", "about"), ("/cancel", "cancel"), ("/admin", "admin")]


def classify_command(text: Column) -> Column:
    out = None
    for prefix, name in COMMANDS:
        cond = text.startswith(prefix)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.lit("free_text"))


def ban_intervals(users: DataFrame, cmds: DataFrame) -> DataFrame:
    """(user_id, from_ts, from_id, to_ts, to_id): when each user is banned, by
    (time, id) of the commands that begin and end it.  ``cmds`` are parsed
    administrator commands (``billing.admin_commands``); a user flagged in
    ``users`` is banned from the start until an unban.  Commands that change
    nothing are skipped; a last ban has no end."""
    first = -(2 ** 62)
    c = cmds.where(F.col("valid") & F.col("sub").isin("ban", "unban")).select(
        F.col("target").alias("user_id"), "ts", F.col("cmd_id").alias("id"), F.col("sub").alias("act"))
    flagged = users.where(F.col("is_banned") == 1).select(
        F.col("tg_user_id").alias("user_id"), F.lit(first).alias("ts"), F.lit(first).alias("id"), F.lit("ban").alias("act"))
    w = Window.partitionBy("user_id").orderBy("ts", "id")  # the commands about one user
    turn = c.unionByName(flagged).withColumn("_prev", F.coalesce(F.lag("act").over(w), F.lit("unban"))).where("act != _prev")
    turn = turn.select("user_id", "act", F.col("ts").alias("from_ts"), F.col("id").alias("from_id"),
                       F.lead("ts").over(w).alias("to_ts"), F.lead("id").over(w).alias("to_id"))
    return turn.where("act = 'ban'").drop("act")


def handled_messages(updates: DataFrame, bans: DataFrame) -> DataFrame:
    """Messages whose sender is not banned when they arrive (banned -> silent
    drop), with their command."""
    at = F.struct(F.col("ts").alias("t"), F.col("update_id").alias("i"))
    since = F.struct(F.col("from_ts").alias("t"), F.col("from_id").alias("i"))
    until = F.struct(F.col("to_ts").alias("t"), F.col("to_id").alias("i"))
    b = bans.withColumnRenamed("user_id", "_banned")
    out = messages_of(updates).join(
        b, (F.col("user_id") == F.col("_banned")) & (at > since) & (F.col("to_ts").isNull() | (at <= until)), "left_anti")
    return out.withColumn("command", classify_command(F.col("text")))


def command_mix(handled: DataFrame) -> DataFrame:
    return handled.groupBy(yyyymmdd("ts").alias("date"), "command").agg(F.count(F.lit(1)).alias("n"))


# U2 -------------------------------------------------------------------------
def first_touch_attribution(users: DataFrame, handled: DataFrame) -> DataFrame:
    """``/start ref_<n>``: first valid referral (n non-zero, not self) sets
    ``utm_source`` when it is empty."""
    s = handled.where(F.col("command") == "start")
    arg = F.coalesce(F.try_element_at(F.split("text", r"\s+"), F.lit(2)), F.lit(""))
    n = parse_int_prefix(F.substring(arg, 5, 1 << 20))
    ref = (s.withColumn("_n", F.when(arg.startswith("ref_"), n))
           .where(F.col("_n").isNotNull() & (F.col("_n") != 0) & (F.col("_n") != F.col("user_id")))
           .groupBy(F.col("user_id").alias("tg_user_id"))
           .agg(F.min_by(F.format_string("ref_%d", F.col("_n")), F.struct("ts", "update_id")).alias("_ref")))
    return (users.join(ref, "tg_user_id", "left")
            .withColumn("utm_source", F.when(F.coalesce(F.col("utm_source"), F.lit("")) == "", F.col("_ref"))
                        .otherwise(F.col("utm_source")))
            .drop("_ref"))


# U4 -------------------------------------------------------------------------
def agent_selections(updates: DataFrame) -> DataFrame:
    """Valid ``agent:<id>`` callbacks (known agents only; no ban check)."""
    c = updates.where((F.col("kind") == "callback") & F.col("data").startswith("agent:"))
    c = c.withColumn("agent_id", F.expr("substring(data, 7)"))
    return c.where(F.col("agent_id").isin(*AGENTS))


def session_state(updates: DataFrame) -> DataFrame:
    sel = agent_selections(updates)
    return (sel.groupBy(F.col("user_id").alias("tg_user_id"))
            .agg(F.max_by("agent_id", F.struct("ts", "update_id")).alias("active_agent_id"),
                 F.max("ts").alias("updated_at"))
            .withColumn("state", F.lit("awaiting_input"))
            .withColumn("context_window", F.array().cast("array<struct<role:string,content:string>>")))


# U5 -------------------------------------------------------------------------
def agent_as_of(handled: DataFrame, updates: DataFrame, chunk_s: int = DAY) -> DataFrame:
    """Agent in force when each free-text message arrived (as-of join by
    union + carried last selection, chunked per day); none -> ``no_agent``."""
    msgs = handled.where(F.col("command") == "free_text").select(
        "update_id", "user_id", "ts", "text", F.lit(1).alias("_kind"), F.lit(None).cast("string").alias("_agent"))
    sel = agent_selections(updates).select(
        "update_id", "user_id", "ts", F.lit(None).cast("string").alias("text"), F.lit(0).alias("_kind"),
        F.col("agent_id").alias("_agent"))
    u = adaptive_chunk(msgs.unionByName(sel), ["user_id"], "ts", "_chunk", base_s=chunk_s, fine_s=3600)
    u = chunked_last_non_null(u, ["user_id"], ["ts", "_kind", "update_id"], "_chunk", "_agent", "agent_id")
    return u.where(F.col("_kind") == 1).select(
        "update_id", "user_id", "ts", "text", F.coalesce("agent_id", F.lit("no_agent")).alias("agent_id"))


# U6 / U7 --------------------------------------------------------------------
def context_window(messages: DataFrame, n: int = 8, key: str = "session_id", order: str = "turn",
                   chunk_turns: int = 256) -> DataFrame:
    """History after each message: the last ``n`` (role, content) entries of
    the session.  A bounded frame per (session, turn chunk), so a very long
    session is spread over many tasks (``functions.windows``)."""
    d = messages.withColumn("_chunk", idiv(F.col(order), chunk_turns))
    return chunked_frame_list(d, [key], order, "_chunk", ["role", "content"], n, "context").drop("_chunk")


def assemble_prompts(messages: DataFrame, agent_prompts: DataFrame, n: int = 8, key: str = "session_id",
                     order: str = "turn", chunk_turns: int = 256) -> DataFrame:
    """Batch-inference input for each user turn: ``[system] + last n of the
    history before it + [user]``.  Missing prompt -> default text.
    ``agent_prompts`` has one row per agent (five), so it is broadcast."""
    d = messages.withColumn("_chunk", idiv(F.col(order), chunk_turns))
    hist = chunked_frame_list(d, [key], order, "_chunk", ["role", "content"], n, "_hist", include_current=False)
    u = hist.where(F.col("role") == "user").join(F.broadcast(agent_prompts), "agent_id", "left")
    system = F.struct(F.lit("system").alias("role"),
                      F.coalesce("system_prompt", F.lit(DEFAULT_SYSTEM_PROMPT)).alias("content"))
    user = F.struct(F.lit("user").alias("role"), F.col("content").alias("content"))
    return u.select(key, order, "agent_id", F.concat(F.array(system), F.col("_hist"), F.array(user)).alias("prompt"))


# U8 -------------------------------------------------------------------------
def explode_exchanges(handled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Handled exchanges ``(user_id, agent_id, ts, text, reply, retried, ...)``
    -> (invocation rows, message rows).  A direct exchange writes the user
    and the assistant message; a retried one only the assistant message."""
    inv = handled.select("user_id", "agent_id", "ts", "provider", "model", "input_tokens", "output_tokens",
                         F.when(F.col("retried"), "retried_ok").otherwise("success").alias("status"))
    both = F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")),
                   F.struct(F.lit("assistant").alias("role"), F.col("reply").alias("content")))
    only = F.array(F.struct(F.lit("assistant").alias("role"), F.col("reply").alias("content")))
    msgs = handled.select("user_id", "agent_id", "ts",
                          F.explode(F.when(F.col("retried"), only).otherwise(both)).alias("m"))
    return inv, msgs.select("user_id", "agent_id", "ts", "m.role", "m.content")
