"""Activity, revenue and retention cohorts.

All operators are pure DataFrame transformations parameterised by ``as_of``
(epoch seconds) instead of reading the wall clock.  Cohorts filter the small
user side first and then join the large invocation fact, so AQE can turn the
join into a broadcast of the cohort at run time when it is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import DAY, WEEK, idiv, iso_date, yyyymmdd
from ..session import drop_folder
from ..sources.reference_data import AGENTS


def live_users(users: DataFrame) -> DataFrame:
    return users.where((F.col("is_banned") == 0) & (F.col("is_deleted") == 0))


# R1 -------------------------------------------------------------------------
def active_users(users: DataFrame, subs: DataFrame, as_of: int, days: int = 7) -> DataFrame:
    """Users seen in the last ``days`` with their active subscription (fans out
    if several rows are active, as the reference view does)."""
    u = live_users(users).where(F.col("last_seen_at") > as_of - days * DAY)
    s = subs.where(F.col("is_active") == 1).select(
        "tg_user_id", F.col("plan").alias("active_plan"), F.col("expires_at").alias("plan_expires_at"))
    cols = [c for c in ("tg_user_id", "username", "first_name", "registered_at", "last_seen_at") if c in u.columns]
    return u.select(*cols).join(s, "tg_user_id", "left").select(
        *cols, "active_plan", "plan_expires_at",
        idiv(F.lit(as_of) - F.col("last_seen_at"), DAY).cast("int").alias("days_since_seen"))


# R2 -------------------------------------------------------------------------
def revenue_daily(payments: DataFrame, approx: bool = False) -> DataFrame:
    """Paid and finalised payments per UTC day.  The exact distinct payer
    count is planned as expand + two-phase aggregate; ``approx`` switches to
    ``approx_count_distinct`` (HyperLogLog) for very large days."""
    p = payments.where((F.col("status") == "paid") & F.col("finalized_at").isNotNull())
    payers = F.approx_count_distinct("tg_user_id") if approx else F.count_distinct("tg_user_id")
    return p.groupBy(yyyymmdd("finalized_at").alias("date")).agg(
        F.count(F.lit(1)).alias("payments_count"),
        F.sum("amount_rub").alias("revenue_rub"),
        payers.alias("unique_payers"))


# R3 -------------------------------------------------------------------------
def revenue_window(payments: DataFrame, as_of: int, days: int) -> Column:
    """Aggregate column: paid sum finalised in ``(as_of - days, as_of]``."""
    cond = (F.col("status") == "paid") & (F.col("finalized_at") > as_of - days * DAY) & \
        (F.col("finalized_at") <= as_of)
    return F.coalesce(F.sum(F.when(cond, F.col("amount_rub"))), F.lit(0)).cast("long")


def revenue_windows(payments: DataFrame, as_of: int, days: tuple[int, ...] = (7, 30)) -> DataFrame:
    return payments.agg(*[revenue_window(payments, as_of, d).alias(f"revenue_{d}d") for d in days])


# R4 / R5 / R6 ---------------------------------------------------------------
def dau(active: DataFrame) -> DataFrame:
    """Rows of R1 with ``days_since_seen <= 1`` (i.e. seen in the last 48 h)."""
    return active.where(F.col("days_since_seen") <= 1).agg(F.count(F.lit(1)).alias("dau"))


def mau(users: DataFrame, as_of: int, days: int = 30) -> DataFrame:
    return live_users(users).where(F.col("last_seen_at") > as_of - days * DAY).agg(F.count(F.lit(1)).alias("mau"))


def plan_holder_counts(subs: DataFrame, as_of: int) -> list[Column]:
    live = (F.col("is_active") == 1) & (F.col("expires_at") > as_of)
    return [
        F.count_distinct(F.when(live & (F.col("plan") != "free_trial"), F.col("tg_user_id"))).alias("paying"),
        F.count_distinct(F.when(live & (F.col("plan") == "free_trial"), F.col("tg_user_id"))).alias("trial"),
    ]


def plan_holders(subs: DataFrame, as_of: int) -> DataFrame:
    return subs.agg(*plan_holder_counts(subs, as_of))


# R7 -------------------------------------------------------------------------
def stats_dashboard(users: DataFrame, subs: DataFrame, payments: DataFrame, inv: DataFrame,
                    as_of: int) -> DataFrame:
    """One row: the eight displayed figures plus the error count.

    Each table is scanned once with fused conditional aggregates; the 1-row
    results are joined on a constant key.
    """
    act = active_users(users, subs, as_of)
    a = dau(act)
    m = mau(users, as_of)
    h = plan_holders(subs, as_of)
    r = revenue_windows(payments, as_of)
    e = error_rate(inv, as_of)
    # each part is a single row; attach them by a constant key (no Cartesian product)
    parts = [x.withColumn("_k", F.lit(1)) for x in (a, m, h, r, e)]
    out = parts[0]
    for x in parts[1:]:
        out = out.join(F.broadcast(x), "_k")
    return out.select("dau", "mau", "paying", "trial", "revenue_7d", "revenue_30d",
                      "total_calls", "errors", "error_rate_pct")


# L3 (lives here because R7 embeds it) ---------------------------------------
def error_rate(inv: DataFrame, as_of: int, secs: int = DAY) -> DataFrame:
    w = inv.where((F.col("created_at") > as_of - secs) & (F.col("created_at") <= as_of))
    err = ~F.col("status").isin("success", "retried_ok")
    agg = w.agg(F.count(F.when(err, 1)).alias("errors"), F.count(F.lit(1)).alias("total_calls"))
    return agg.select("errors", "total_calls",
                      F.when(F.col("total_calls") > 0,
                             F.round(F.col("errors") * 100.0 / F.col("total_calls"), 1))
                      .otherwise(F.lit(0.0)).alias("error_rate_pct"))


# R8 / R9 / R10 -------------------------------------------------------------
def _registered_between(users: DataFrame, as_of: int, k: int) -> DataFrame:
    lo, hi = as_of - k * DAY - DAY, as_of - k * DAY
    return live_users(users).where(F.col("registered_at").between(lo, hi)).select("tg_user_id", "registered_at")


def _capped(df: DataFrame, limit: int | None, order: list[str]) -> DataFrame:
    """An optional batch size for callers that send in batches; ``order`` makes
    it deterministic.  Every default is the whole cohort."""
    return df.orderBy(*order).limit(limit) if limit is not None else df


def no_first_request(users: DataFrame, inv: DataFrame, as_of: int, day: int,
                     limit: int | None = None) -> DataFrame:
    cohort = _registered_between(users, as_of, day)
    out = cohort.join(inv.select("tg_user_id"), "tg_user_id", "left_anti")
    return _capped(out, limit, ["tg_user_id"]).withColumn("day", F.lit(day))


def one_agent_only(users: DataFrame, inv: DataFrame, as_of: int, day: int = 4,
                   limit: int | None = None) -> DataFrame:
    cohort = _registered_between(users, as_of, day)
    per = (cohort.join(inv.select("tg_user_id", "agent_id"), "tg_user_id", "left")
           .groupBy("tg_user_id", "registered_at")
           .agg(F.count_distinct("agent_id").alias("unique_agents"))
           .where(F.col("unique_agents") == 1))
    return _capped(per, limit, ["tg_user_id"])


def trial_ending(users: DataFrame, subs: DataFrame, inv: DataFrame, as_of: int, day: int = 6,
                 limit: int | None = None, activated_at: int = 3) -> DataFrame:
    cohort = _registered_between(users, as_of, day)
    trial = subs.where((F.col("is_active") == 1) & (F.col("plan") == "free_trial")).select("tg_user_id")
    # the join with subscriptions may fan out; the group-by collapses it and
    # count(a.id) then counts each invocation once per matching trial row
    per = (cohort.join(trial, "tg_user_id")
           .join(inv.select("tg_user_id", "agent_id"), "tg_user_id", "left")
           .groupBy("tg_user_id", "registered_at")
           .agg(F.count_distinct("agent_id").alias("unique_agents"),
                F.count("agent_id").alias("total_calls")))
    out = _capped(per, limit, ["tg_user_id"])
    return out.withColumn("activated", (F.col("unique_agents") >= activated_at).cast("int"))


# R11 / R12 -----------------------------------------------------------------
def sub_expiring(subs: DataFrame, as_of: int, days: int = 3, limit: int | None = None) -> DataFrame:
    lo, hi = as_of + days * DAY - DAY, as_of + days * DAY
    s = subs.where((F.col("is_active") == 1) & (F.col("plan") != "free_trial") &
                   F.col("expires_at").between(lo, hi)).select("tg_user_id", "plan", "expires_at")
    s = _capped(s, limit, ["tg_user_id", "expires_at"])
    return s.select("tg_user_id", "plan", "expires_at",
                    F.format_string("sub_expiring_%d", F.col("expires_at")).alias("event"),
                    iso_date("expires_at").alias("expires_date"))


def silent_payers(users: DataFrame, subs: DataFrame, inv: DataFrame, as_of: int, days: int = 7,
                  limit: int | None = None) -> DataFrame:
    paid = subs.where((F.col("is_active") == 1) & (F.col("plan") != "free_trial")).select("tg_user_id")
    u = live_users(users).select("tg_user_id", "registered_at").join(paid, "tg_user_id")
    # one row per payer first, then only the payers' invocations are aggregated
    payers = u.groupBy("tg_user_id", "registered_at").agg(F.lit(1).alias("_one")).drop("_one")
    last = (inv.select("tg_user_id", "created_at").join(payers.select("tg_user_id"), "tg_user_id", "left_semi")
            .groupBy("tg_user_id").agg(F.max("created_at").alias("last_call")))
    per = payers.join(last, "tg_user_id").where(F.col("last_call") < as_of - days * DAY)
    per = _capped(per, limit, ["tg_user_id"])
    week = as_of // WEEK
    return per.withColumn("event", F.lit(f"silence_7d_{week}"))


# R13 ------------------------------------------------------------------------
def nudge_plan(segments: list[DataFrame], ledger: DataFrame, as_of: int, ttl_days: int = 60) -> DataFrame:
    """Union of segment rows ``(tg_user_id, event, params)`` minus what the
    send-once ledger already holds (younger than the TTL); one row per key."""
    u = segments[0]
    for s in segments[1:]:
        u = u.unionByName(s)
    fresh = ledger.where(F.col("sent_at") > as_of - ttl_days * DAY).select("tg_user_id", "event")
    out = u.join(fresh, ["tg_user_id", "event"], "left_anti")
    # one row per (user, event): keep the smallest params deterministically
    return out.groupBy("tg_user_id", "event").agg(F.min("params").alias("params")) \
        .withColumn("sent_at", F.lit(as_of).cast("long"))


def send_once(candidates: DataFrame, sent: DataFrame | None, ttl_days: int = 60) -> DataFrame:
    """``candidates (slot, tg_user_id, event, params)`` of several runs: the
    first run of each (user, event) sends it, with the least params, unless
    ``sent`` (earlier rows) holds it within the TTL.  The runs of one call span
    less than the TTL (event keys name a day, a date or a week)."""
    if sent is not None:
        first = candidates.agg(F.min("slot")).first()[0]
        if first is not None:
            fresh = sent.where(F.col("slot") > first - ttl_days * DAY).select("tg_user_id", "event")
            candidates = candidates.join(fresh, ["tg_user_id", "event"], "left_anti")
    pick = F.min(F.struct("slot", "params")).alias("_m")
    return candidates.groupBy("tg_user_id", "event").agg(pick).select(
        F.col("_m.slot").alias("slot"), "tg_user_id", "event", F.col("_m.params").alias("params"))


def nudge_segments(users: DataFrame, subs: DataFrame, inv: DataFrame, as_of: int) -> list[DataFrame]:
    """The six reference cohorts as ``(tg_user_id, event, params)``."""
    d1 = no_first_request(users, inv, as_of, 1).select(
        "tg_user_id", F.lit("d1_no_first_request").alias("event"), F.lit("").alias("params"))
    d2 = no_first_request(users, inv, as_of, 2).select(
        "tg_user_id", F.lit("d2_no_first_request").alias("event"), F.lit("").alias("params"))
    d4 = one_agent_only(users, inv, as_of).select(
        "tg_user_id", F.lit("d4_one_agent").alias("event"), F.lit("").alias("params"))
    d7 = trial_ending(users, subs, inv, as_of).select(
        "tg_user_id",
        F.when(F.col("activated") == 1, "d7_trial_activated").otherwise("d7_trial_not_activated").alias("event"),
        F.when(F.col("activated") == 1,
               F.format_string("calls=%d;agents=%d", F.col("total_calls"), F.col("unique_agents")))
         .otherwise(F.lit("")).alias("params"))
    ex = sub_expiring(subs, as_of).select(
        "tg_user_id", "event", F.format_string("plan=%s;date=%s", F.col("plan"), F.col("expires_date")).alias("params"))
    si = silent_payers(users, subs, inv, as_of).select("tg_user_id", "event", F.lit("").alias("params"))
    return [d1, d2, d4, d7, ex, si]


def active_at(as_of: int) -> Column:
    """A subscription row (with ``closed_at``, B4) that is active at a time."""
    return (F.col("started_at") <= as_of) & (F.col("closed_at").isNull() | (F.col("closed_at") > as_of)) & (F.col("expires_at") >= as_of)


def nudge_facts(users: DataFrame, subs: DataFrame, inv: DataFrame, dates: list[int], agents: list[str] = AGENTS) -> DataFrame:
    """One row per user with all that the six cohorts ask, at each of
    ``dates``: calls, a bitmap of the agents used, last call; active trials and
    paid rows, and the paid rows that end in two to three days.  Invocations
    and subscriptions are each read and shuffled once, whatever the number of
    dates.  Agents outside ``agents`` share one bit."""
    bit = F.lit(1 << len(agents))
    for i, name in enumerate(agents):
        bit = F.when(F.col("agent_id") == name, 1 << i).otherwise(bit)
    calls, rows = [], []
    for k, a in enumerate(dates):
        by = F.col("created_at") <= a
        calls += [F.count(F.when(by, 1)).alias(f"calls{k}"), F.coalesce(F.bit_or(F.when(by & F.col("agent_id").isNotNull(), bit)), F.lit(0)).alias(f"agents{k}"),
                  F.max(F.when(by, F.col("created_at"))).alias(f"last{k}")]
        on, trial = active_at(a), F.col("plan") == "free_trial"
        ends = on & ~trial & F.col("expires_at").between(a + 2 * DAY, a + 3 * DAY)
        rows += [F.count(F.when(on & trial, 1)).alias(f"trials{k}"), F.count(F.when(on & ~trial, 1)).alias(f"paid{k}"),
                 F.collect_list(F.when(ends, F.struct("plan", "expires_at"))).alias(f"ending{k}")]  # active rows of one user
    people = users.select("tg_user_id", "registered_at", ((F.col("is_banned") == 0) & (F.col("is_deleted") == 0)).alias("live"))
    facts = people.join(subs.groupBy("tg_user_id").agg(*rows), "tg_user_id", "full")
    return facts.join(inv.where(F.col("created_at") <= max(dates)).groupBy("tg_user_id").agg(*calls), "tg_user_id", "left")


def nudge_rules(facts: DataFrame, dates: list[int]) -> DataFrame:
    """(slot, tg_user_id, event, params): every cohort's rule as a struct of
    the fact row, at each date; what holds is exploded."""
    out = []
    for k, a in enumerate(dates):
        def rule(event, params, when):
            return F.when(when, F.struct(F.lit(a).cast("long").alias("slot"), event.alias("event"), params.alias("params")))

        def since(day):
            return F.col("live") & F.col("registered_at").between(a - (day + 1) * DAY, a - day * DAY)

        calls, agents = F.coalesce(f"calls{k}", F.lit(0).cast("long")), F.bit_count(F.coalesce(f"agents{k}", F.lit(0)))
        trials, none = F.col(f"trials{k}"), F.lit("")
        out += [F.array(
            rule(F.lit("d1_no_first_request"), none, since(1) & (calls == 0)), rule(F.lit("d2_no_first_request"), none, since(2) & (calls == 0)),
            rule(F.lit("d4_one_agent"), none, since(4) & (agents == 1)),
            rule(F.lit("d7_trial_activated"), F.format_string("calls=%d;agents=%d", calls * trials, agents), since(6) & (trials > 0) & (agents >= 3)),
            rule(F.lit("d7_trial_not_activated"), none, since(6) & (trials > 0) & (agents < 3)),
            rule(F.lit(f"silence_7d_{a // WEEK}"), none, F.col("live") & (F.col(f"paid{k}") > 0) & (F.col(f"last{k}") < a - 7 * DAY))),
            F.transform(F.coalesce(f"ending{k}", F.array().cast("array<struct<plan:string,expires_at:bigint>>")), lambda s: F.struct(
                F.lit(a).cast("long").alias("slot"), F.format_string("sub_expiring_%d", s["expires_at"]).alias("event"),
                F.format_string("plan=%s;date=%s", s["plan"], F.date_format(F.timestamp_seconds(s["expires_at"]), "yyyy-MM-dd")).alias("params")))]
    x = facts.select("tg_user_id", F.explode(F.filter(F.concat(*out), lambda r: r.isNotNull())).alias("r"))
    return x.select("r.slot", "tg_user_id", "r.event", "r.params")


# R14 ------------------------------------------------------------------------
def store_by_day(df: DataFrame, path: str, ts_col: str, day_col: str = "day") -> None:
    """Appends rows as one folder per UTC day (``day_col``, yyyymmdd; rows
    without a time go to their own), rows of a day side by side in a task."""
    (df.withColumn(day_col, yyyymmdd(ts_col)).repartition(day_col, F.pmod(F.xxhash64(ts_col), F.lit(DAY_TASKS)))
     .write.mode("append").partitionBy(day_col).parquet(path))


DAY_TASKS = 8  # tasks that a large day is spread over


def purge_days(spark: SparkSession, path: str, ts_col: str, cutoff: int, day_col: str = "day") -> DataFrame:
    """TTL delete on a table of day folders: rows with ``ts_col < cutoff`` go.

    Days that lie wholly before the cutoff are dropped as folders; the one day
    that the cutoff cuts is rewritten from its own folder; no other file is
    read or touched.  Returns the deleted rows per day, counted before.  Run
    again after a crash, it finishes what is left."""
    last = spark.range(1).select(yyyymmdd(F.lit(cutoff).cast("long")).alias("d")).first()["d"]
    table = spark.read.option("basePath", path).parquet(path)
    gone = expired_rows(table, ts_col, cutoff, last, day_col)
    report = gone.groupBy(F.col(day_col).alias("day")).agg(F.count(F.lit(1)).alias("deleted")).checkpoint(eager=True)  # its files go below
    days = [r["day"] for r in report.collect()]  # one row per expired day: bounded by the calendar
    if last in days:
        rest = table.where(F.col(day_col) == last).where(F.col(ts_col) >= cutoff).checkpoint(eager=True)
        if rest.isEmpty():
            drop_folder(spark, f"{path}/{day_col}={last}")
        else:
            rest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day_col).parquet(path)
    for day in days:
        if day != last:
            drop_folder(spark, f"{path}/{day_col}={day}")
    return report


def expired_rows(table: DataFrame, ts_col: str, cutoff: int, last: int, day_col: str = "day") -> DataFrame:
    """The rows a purge deletes; the day filter prunes every later folder."""
    return table.where(F.col(day_col) <= last).where((F.col(day_col) < last) | (F.col(ts_col) < cutoff))


def purge(df: DataFrame, col: str, cutoff: int) -> tuple[DataFrame, DataFrame]:
    """TTL delete: rows with ``col < cutoff`` go; returns (kept, deleted).

    When the table is partitioned on ``col`` (e.g. quota ``date``) the filter
    prunes whole partitions, so a rewrite touches only the surviving ones.
    """
    return df.where(~(F.col(col) < cutoff) | F.col(col).isNull()), df.where(F.col(col) < cutoff)


def purge_report(df: DataFrame, table: str, col: str, cutoff: int) -> DataFrame:
    gone = F.col(col) < cutoff
    return df.agg(F.lit(table).alias("table_name"),
                  F.count(F.when(~gone | F.col(col).isNull(), 1)).alias("kept"),
                  F.count(F.when(gone, 1)).alias("deleted"))
