"""Subscriptions and payments as set-based state folds.

The reference mutates one row per webhook; here every fold is a closed form
over the whole event history (window or grouped aggregate), so replaying the
same events is idempotent and the job has no driver-side loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import DAY
from ..functions.windows import adaptive_chunk, chunked_last_non_null, chunked_lead
from ..sources.reference_data import RETRYABLE_STATUS

PAID = "paid"
FAILURES = ("failed", "expired", "refunded")


# B1 -------------------------------------------------------------------------
def ensure_free_trial(users: DataFrame, subs: DataFrame, as_of: int, days: int = 7) -> DataFrame:
    """Rows to insert: users that never had any subscription get a trial."""
    return (users.select("tg_user_id")
            .join(subs.select("tg_user_id"), "tg_user_id", "left_anti")
            .select("tg_user_id", F.lit("free_trial").alias("plan"), F.lit(1).alias("is_active"),
                    F.lit(as_of).cast("long").alias("started_at"),
                    F.lit(as_of + days * DAY).cast("long").alias("expires_at"),
                    F.lit("trial_auto").alias("source")))


# B2 -------------------------------------------------------------------------
def normalize_payment_status(events: DataFrame, status_map: DataFrame) -> DataFrame:
    """Map ``(provider, raw_status)`` to the payment status; unknown -> dropped.

    The map has ten rows, so the broadcast is bounded by construction.
    """
    return events.join(F.broadcast(status_map), ["provider", "raw_status"], "inner")


# B3 -------------------------------------------------------------------------
def apply_payment_events(payments: DataFrame, events: DataFrame) -> DataFrame:
    """Fold normalised events ``(payment_id, ts, event_id, status, tx_hash,
    payload)`` into ``payments`` and return the new payment rows.

    Rules: *paid* is accepted unless already paid; a failure status is
    accepted unless the payment is paid or refunded.  Closed form per payment:
    the first paid event wins if any exists; otherwise the last failure at or
    before the first *refunded* one; a payment already paid is untouched, a
    payment already refunded only accepts *paid*.
    """
    order = F.struct("ts", "event_id")
    ev = F.struct("status", "ts", "tx_hash", "payload")
    is_paid, is_ref = F.col("status") == PAID, F.col("status") == "refunded"
    # One grouped aggregate, combined map-side even for a hot payment id.  The
    # last failure not after the first refund is that refund if there is one,
    # else the last failure.
    agg = events.groupBy("payment_id").agg(
        F.min_by(F.when(is_paid, ev), F.when(is_paid, order)).alias("_paid"),
        F.coalesce(F.min_by(F.when(is_ref, ev), F.when(is_ref, order)),
                   F.max_by(F.when(F.col("status").isin(*FAILURES), ev),
                            F.when(F.col("status").isin(*FAILURES), order))).alias("_fail"))
    p = payments.alias("p").join(agg.alias("e"), F.col("p.id") == F.col("e.payment_id"), "left")
    s0 = F.col("p.status")
    take_paid = F.col("_paid").isNotNull() & (s0 != PAID)
    take_fail = ~take_paid & F.col("_fail").isNotNull() & ~s0.isin(PAID, "refunded")
    new = F.when(take_paid, F.col("_paid")).when(take_fail, F.col("_fail"))
    out = p.select(
        "p.*",
        F.when(new.isNotNull(), new["status"]).otherwise(s0).alias("_status"),
        F.when(new.isNotNull(), new["ts"]).otherwise(F.col("p.finalized_at")).alias("_fin"),
        F.when(take_paid, new["tx_hash"]).otherwise(F.col("p.tx_hash") if "tx_hash" in payments.columns
                                                     else F.lit(None).cast("string")).alias("_tx"),
        (take_paid | take_fail).alias("changed"),
    )
    cols = [c for c in payments.columns if c not in ("status", "finalized_at", "tx_hash")]
    return out.select(*[F.col(c) for c in cols], F.col("_status").alias("status"),
                      F.col("_fin").alias("finalized_at"), F.col("_tx").alias("tx_hash"), "changed")


# B4 -------------------------------------------------------------------------
def activate_subscriptions(intervals: DataFrame, as_of: int) -> DataFrame:
    """Fold raw intervals (one per paid payment, plus trials) into the
    subscription table at ``as_of``: each new row closes the user's earlier
    rows.  Idempotent on ``payment_id``: duplicates of a payment collapse to
    its first row.
    """
    base = intervals.where(F.col("started_at") <= as_of)
    # replayed webhooks: keep one row per payment (trials have no payment id)
    keyed = base.where(F.col("payment_id").isNotNull())
    once = (keyed.groupBy("payment_id")
            .agg(F.min_by(F.struct(*[c for c in base.columns if c != "payment_id"]), F.col("started_at")).alias("r"))
            .select("payment_id", "r.*").select(*base.columns))
    rows = once.unionByName(base.where(F.col("payment_id").isNull()))
    # next start per user; chunked by 30-day period so a user with a huge
    # history is still spread over many window partitions
    rows = adaptive_chunk(rows, ["tg_user_id"], "started_at", "_chunk", base_s=30 * DAY, fine_s=DAY) \
        .withColumn("_pid", F.coalesce(F.col("payment_id"), F.lit(-(2 ** 63)).cast("long")))
    rows = chunked_lead(rows, ["tg_user_id"], ["started_at", "_pid"], "_chunk", "started_at", "closed_at")
    return rows.drop("_chunk", "_pid").withColumn("is_active", F.col("closed_at").isNull().cast("int"))


# B5 -------------------------------------------------------------------------
def current_subscription(subs: DataFrame) -> DataFrame:
    """Active row with the greatest ``expires_at`` per user (one partial
    aggregate per user; no sort of the whole table)."""
    a = subs.where(F.col("is_active") == 1)
    return (a.groupBy("tg_user_id")
            .agg(F.max_by(F.struct("plan", "expires_at", "started_at"),
                          F.struct("expires_at", "started_at")).alias("s"))
            .select("tg_user_id", "s.plan", "s.expires_at", "s.started_at"))


# B6 -------------------------------------------------------------------------
def subscription_as_of(requests: DataFrame, subs: DataFrame, ts_col: str = "ts",
                       chunk_s: int = 30 * DAY) -> DataFrame:
    """Plan in force at each request: the latest subscription row started at
    or before the request time; none, or ``expires_at < t`` -> no_active_plan.

    As-of join without a range join: requests and subscription starts are
    unioned and the last non-null subscription is carried forward per user
    (chunked window, so one hot user does not become one task).  Ties on
    start time resolve by ``payment_id`` (trial first), as B4 orders rows.
    """
    r = requests.select("*", F.lit(1).alias("_kind"), F.col(ts_col).alias("_t"),
                        F.lit(None).cast("long").alias("_pid"),
                        F.lit(None).cast("struct<plan:string,exp:long>").alias("_sub"))
    s = subs.select("tg_user_id", F.lit(0).alias("_kind"), F.col("started_at").alias("_t"),
                    F.coalesce(F.col("payment_id"), F.lit(-(2 ** 63)).cast("long")).alias("_pid"),
                    F.struct(F.col("plan").alias("plan"), F.col("expires_at").alias("exp")).alias("_sub"))
    for c in requests.columns:
        if c not in s.columns:
            s = s.withColumn(c, F.lit(None).cast(requests.schema[c].dataType))
    u = r.unionByName(s.select(*r.columns))
    u = adaptive_chunk(u, ["tg_user_id"], "_t", "_chunk", base_s=chunk_s, fine_s=DAY)
    u = chunked_last_non_null(u, ["tg_user_id"], ["_t", "_kind", "_pid"], "_chunk", "_sub", "_sp")
    u = u.where(F.col("_kind") == 1)
    ok = F.col("_sp").isNotNull() & (F.col("_sp.exp") >= F.col("_t"))
    return u.select(*requests.columns,
                    F.when(ok, F.col("_sp.plan")).alias("plan"),
                    F.when(ok, F.col("_sp.exp")).alias("plan_expires_at"),
                    F.when(~ok, F.lit("no_active_plan")).alias("plan_reason"))


# B7 -------------------------------------------------------------------------
def expire_subscriptions(subs: DataFrame, as_of: int) -> DataFrame:
    """``is_active = 1 and expires_at < as_of`` -> 0; ``expired_now`` marks
    the changed rows."""
    hit = (F.col("is_active") == 1) & (F.col("expires_at") < as_of)
    return subs.withColumn("expired_now", hit).withColumn(
        "is_active", F.when(hit, 0).otherwise(F.col("is_active")))


def subscription_state(intervals: DataFrame, as_of: int) -> DataFrame:
    """B4 then B7: the subscription table as the service would hold it."""
    return expire_subscriptions(activate_subscriptions(intervals, as_of), as_of)


# B8 -------------------------------------------------------------------------
def account_commands(subs: DataFrame, users: DataFrame, cmds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fold ``cmds (tg_user_id, ts, action in cancel/ban/unban)``.

    Returns (subs with auto_renew cleared for users that issued /cancel while
    an active auto-renewing row existed, users with the last ban/unban applied).
    """
    cancel = cmds.where(F.col("action") == "cancel").select("tg_user_id").distinct()
    hit = (F.col("is_active") == 1) & (F.col("auto_renew") == 1)
    s = (subs.join(cancel.withColumn("_c", F.lit(True)), "tg_user_id", "left")
         .withColumn("cancelled_now", hit & F.col("_c").isNotNull())
         .withColumn("auto_renew", F.when(F.col("cancelled_now"), 0).otherwise(F.col("auto_renew"))).drop("_c"))
    bans = (cmds.where(F.col("action").isin("ban", "unban")).groupBy("tg_user_id")
            .agg(F.max_by("action", F.struct("ts", "cmd_id")).alias("_last")))
    u = (users.join(bans, "tg_user_id", "left")
         .withColumn("is_banned", F.when(F.col("_last") == "ban", 1).when(F.col("_last") == "unban", 0)
                     .otherwise(F.col("is_banned"))).drop("_last"))
    return s, u


# B9 -------------------------------------------------------------------------
def multi_account_flags(subs: DataFrame, as_of: int, days: int = 30, min_subs: int = 2) -> DataFrame:
    w = subs.where((F.col("created_at") > as_of - days * DAY) & (F.col("created_at") <= as_of))
    return (w.groupBy("tg_user_id").agg(F.count(F.lit(1)).alias("subs_30d"))
            .where(F.col("subs_30d") >= min_subs))


# B10 ------------------------------------------------------------------------
def profile_cards(users: DataFrame, subs: DataFrame, plan_cfg: DataFrame, as_of: int) -> DataFrame:
    cur = current_subscription(subs)
    cfg = F.broadcast(plan_cfg.select("plan", "daily_quota_per_agent"))  # 4 rows
    return (users.select("tg_user_id").join(cur, "tg_user_id", "left").join(cfg, "plan", "left")
            .select("tg_user_id",
                    F.coalesce("plan", F.lit("inactive")).alias("plan"),
                    F.when(F.col("expires_at").isNotNull(),
                           F.greatest(F.lit(0).cast("long"),
                                      F.floor((F.col("expires_at") - F.lit(as_of)) / F.lit(DAY)).cast("long")))
                    .alias("days_left"),
                    F.col("daily_quota_per_agent").alias("daily_quota")))


# B11 ------------------------------------------------------------------------
def pending_recheck(payments: DataFrame, as_of: int, limit: int | None = None) -> DataFrame:
    """Online payments pending for over an hour; ``limit`` is an optional batch
    size (oldest first), the default is all of them."""
    p = payments.where((F.col("status") == "pending") & (F.col("created_at") < as_of - 3600) &
                       (F.col("created_at") <= as_of))
    p = p.where(F.col("provider").isin("nowpayments", "cryptocloud"))
    if limit is not None:
        p = p.orderBy("created_at", "id").limit(limit)
    return p.select("id", "tg_user_id", "provider", "plan", "created_at")


# B12 ------------------------------------------------------------------------
# provider -> raw statuses its status endpoint reports for a completed payment
SNAPSHOT_SUCCESS = {"nowpayments": ("finished", "confirmed"), "cryptocloud": ("paid", "success")}


def remote_completed() -> Column:
    """The provider's endpoint reports the payment as completed."""
    ok = F.lit(False)
    for prov, sts in SNAPSHOT_SUCCESS.items():
        ok = ok | ((F.col("provider") == prov) & F.col("remote_status").isin(*sts))
    return ok


def reconcile_payments(pending: DataFrame, snapshot: DataFrame, as_of: int) -> DataFrame:
    """Pending payments the provider now reports as completed -> paid."""
    return (pending.join(snapshot, ["id", "provider"], "inner").where(remote_completed())
            .select("id", "tg_user_id", "provider", "plan", F.lit("paid").alias("status"),
                    F.lit(as_of).cast("long").alias("finalized_at")))


def activation_intervals(paid: DataFrame, plans: DataFrame) -> DataFrame:
    """Subscription intervals that paid payments open at ``finalized_at`` for
    the plan's own ``duration_days`` (input of B4); ``plans`` is the plan table."""
    days = F.broadcast(plans.select("plan", "duration_days"))  # one row per plan
    return paid.join(days, "plan").select(
        F.col("id").alias("payment_id"), "tg_user_id", "plan", F.col("finalized_at").alias("started_at"),
        (F.col("finalized_at") + F.col("duration_days") * DAY).cast("long").alias("expires_at"))


# B13 ------------------------------------------------------------------------
def retryable(http_status: Column, error: Column) -> Column:
    """A failed attempt is retryable by status set, or when it aborted/timed out."""
    return F.coalesce(http_status.isin(*RETRYABLE_STATUS), F.lit(False)) | \
        F.coalesce(error.rlike("(?i)(aborted|timeout)"), F.lit(False))


def resolve_fallback_chain(attempts: DataFrame, all_retryable: bool = False) -> DataFrame:
    """Per request walk providers by ``rank``: stop at the first success or
    the first non-retryable failure.  ``attempts (request_id, rank, provider,
    ok, http_status, error)``.  Pure grouped aggregate, no per-request loop."""
    retry = F.lit(True) if all_retryable else retryable(F.col("http_status"), F.col("error"))
    stop = F.col("ok") | ~retry
    per = attempts.groupBy("request_id").agg(
        F.min(F.when(stop, F.col("rank"))).alias("_stop"),
        F.collect_list(F.struct("rank", "provider", "ok", "http_status", "error")).alias("_a"))
    tried = F.filter(F.array_sort("_a"), lambda x: F.col("_stop").isNull() | (x["rank"] <= F.col("_stop")))
    per = per.withColumn("_t", tried)
    last = F.element_at("_t", -1)
    ok = F.coalesce(last["ok"], F.lit(False))
    return per.select(
        "request_id",
        F.when(ok, "ok").otherwise("failed").alias("result"),
        F.when(ok, last["provider"]).alias("provider_used"),
        F.size("_t").alias("attempts"),
        F.array_join(F.transform(F.filter("_t", lambda x: ~x["ok"]),
                                 lambda x: F.concat(x["provider"], F.lit(": "), F.coalesce(x["error"], F.lit("")))),
                     " | ").alias("errors"))


# B4 (manual variant) and B8 (ban/unban) ------------------------------------------
def admin_commands(handled: DataFrame, admin_ids: list[int]) -> DataFrame:
    """``/admin <sub> ...`` messages of administrators, parsed:
    ``activate <user> <plan> [days=30]`` and ``ban|unban <user>``; a command
    is valid when the user id is a non-zero integer and (for activate) the
    plan exists.  Messages from other users are refused (no rows)."""
    from ..functions.text import parse_int_prefix
    from ..sources.reference_data import PLAN_CONFIG

    a = handled.where((F.col("command") == "admin") & F.col("user_id").isin(*admin_ids))
    parts = F.split(F.trim("text"), r"\s+")
    sub = F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("help"))
    target = parse_int_prefix(F.coalesce(F.try_element_at(parts, F.lit(3)), F.lit("")))
    plan = F.try_element_at(parts, F.lit(4))
    days_raw = F.try_element_at(parts, F.lit(5))
    days = F.when(days_raw.isNull(), F.lit(30).cast("long")).otherwise(parse_int_prefix(days_raw))
    ok_user = target.isNotNull() & (target != 0)
    valid = (((sub == "activate") & ok_user & plan.isin(*[p for p, *_ in PLAN_CONFIG]) & days.isNotNull())
             | (sub.isin("ban", "unban") & ok_user))
    return a.select(F.col("update_id").alias("cmd_id"), F.col("user_id").alias("admin_id"), "ts",
                    sub.alias("sub"), target.alias("target"), F.when(sub == "activate", plan).alias("plan"),
                    F.when(sub == "activate", days).alias("days"), F.coalesce(valid, F.lit(False)).alias("valid"))


def manual_activations(cmds: DataFrame) -> DataFrame:
    """Valid ``activate`` commands -> subscription intervals with custom days
    (source ``admin_manual``); paid plans also create a zero-amount paid
    ``admin_manual`` payment, trials create none.  The intervals then go
    through the same fold as webhook activations (B4)."""
    c = cmds.where(F.col("valid") & (F.col("sub") == "activate"))
    return c.select("cmd_id", F.col("target").alias("tg_user_id"), "plan", "days",
                    F.col("ts").alias("started_at"), (F.col("ts") + F.col("days") * DAY).alias("expires_at"),
                    (F.col("plan") != "free_trial").alias("creates_payment"),
                    F.lit("admin_manual").alias("source"))


def ban_fold(users: DataFrame, cmds: DataFrame) -> DataFrame:
    """Last valid ban/unban per user wins."""
    b = cmds.where(F.col("valid") & F.col("sub").isin("ban", "unban")).select(
        F.col("target").alias("tg_user_id"), "ts", "cmd_id", F.col("sub").alias("action"))
    last = b.groupBy("tg_user_id").agg(F.max_by("action", F.struct("ts", "cmd_id")).alias("_last"))
    return (users.join(last, "tg_user_id", "left")
            .withColumn("is_banned", F.when(F.col("_last") == "ban", 1).when(F.col("_last") == "unban", 0)
                        .otherwise(F.col("is_banned")))
            .withColumn("ban_changed", F.col("_last").isNotNull()).drop("_last"))
