"""Flood sessions, quota/flood admission and quota bookkeeping.

The reference decides one request at a time against three key-value
counters and one table counter.  Here the whole request history is decided
at once with ordered running counts (skew-safe chunked windows, see
``functions.windows``): all windows are keyed by the user prefix, so rows of
one user never need a second shuffle key, and a hot user is split by hour.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.time import yyyymmdd
from ..functions.windows import _once, adaptive_chunk, chunked_lag, chunked_running
from ..sources.reference_data import (AGENTS, FLOOD_GAP_S, FREE_PER_DAY, FREE_PER_MIN, PAID_FLOOD_PER_MIN,
                                      PLAN_CONFIG)

ORDER = ["ts", "request_id"]


def default_limits(spark: SparkSession) -> DataFrame:
    """Per plan: flood limit per burst, free daily cap (free plan only) and
    per-agent daily quota, from the reference constants."""
    rows = [(p, FREE_PER_MIN if p == "free_trial" else PAID_FLOOD_PER_MIN,
             FREE_PER_DAY if p == "free_trial" else None, q) for p, q, _, _ in PLAN_CONFIG]
    return spark.createDataFrame(rows, "plan string, flood_limit int, day_limit int, agent_limit int")


# A1 -------------------------------------------------------------------------
def mark_bursts(requests: DataFrame, gap: int = FLOOD_GAP_S, chunk_s: int = 3600,
                group: tuple[str, ...] = ("tg_user_id",)) -> DataFrame:
    """Add ``_burst`` (1-based burst number per user): a new burst starts when
    the previous request of the user is ``gap`` seconds or more in the past
    (the flood key's TTL is refreshed on every attempt)."""
    g = list(group)
    d = adaptive_chunk(requests, g, "ts", "_chunk", base_s=chunk_s)
    d = chunked_lag(d, g, ORDER, "_chunk", "ts", "_prev")
    new = (F.col("_prev").isNull() | (F.col("ts") - F.col("_prev") >= gap)).cast("int")
    return chunked_running(d, g, ORDER, "_chunk", new, "_burst")


def flood_sessions(requests: DataFrame, gap: int = FLOOD_GAP_S, chunk_s: int = 3600) -> DataFrame:
    d = mark_bursts(requests, gap, chunk_s)
    return d.groupBy("tg_user_id", F.col("_burst").alias("burst")).agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("requests"))


# A2 -------------------------------------------------------------------------
def admission_decisions(requests: DataFrame, limits: DataFrame, gap: int = FLOOD_GAP_S,
                        chunk_s: int = 3600, max_chunk_rows: int = 1_000_000) -> DataFrame:
    """Decide every request ``(request_id, tg_user_id, agent_id, ts, plan)``.

    Order of checks per request: no plan -> ``no_active_plan``; a plan that
    ``limits`` does not know -> ``unknown_plan``; no agent -> ``no_agent``
    (these three touch no counter and are never allowed); flood count in the current burst > limit -> ``free_minute`` /
    ``flood``; free plan: running count of flood-passed free requests per
    UTC day > cap -> ``free_daily``; per-agent daily counter > quota ->
    ``daily_quota`` (that increment is rolled back); else ``allowed`` with
    ``remaining``.  Flood and day increments are never rolled back.

    Plan: one hash shuffle of the requests by (user, hour chunk).  Every
    counter group (user; user+burst; user+day; user+agent+day) is evaluated
    inside those partitions with local windows; what a chunk needs from the
    user's earlier chunks comes from small per-chunk summaries (one row per
    user-hour) joined back on the same keys, so the request rows are never
    shuffled again and a hot user is spread over its hours; an hour in
    which one user has more than ``max_chunk_rows`` requests is cut into
    minutes (``functions.windows.adaptive_chunk``).
    """
    lim = F.broadcast(limits.withColumn("_known", F.lit(True)))  # one row per plan
    r = requests.join(lim, "plan", "left")
    bad = (F.when(F.col("plan").isNull(), "no_active_plan").when(F.col("_known").isNull(), "unknown_plan")
           .when(F.col("agent_id").isNull(), "no_agent"))
    r = r.withColumn("_bad", bad).drop("_known")
    none = r.where(F.col("_bad").isNotNull()).select(
        "request_id", "tg_user_id", "agent_id", "ts", "plan",
        F.col("_bad").alias("reason"), F.lit(0).cast("long").alias("remaining"))
    U, C = "tg_user_id", "_chunk"
    K = [U, C]
    d = adaptive_chunk(r.where(F.col("_bad").isNull()).drop("_bad"), [U], "ts", C, base_s=chunk_s,
                       max_rows=max_chunk_rows)
    d = d.withColumn("_date", yyyymmdd(F.col("ts"))).repartition(U, C)
    w = Window.partitionBy(*K).orderBy(*ORDER)
    run = w.rowsBetween(Window.unboundedPreceding, 0)

    # pass 1: bursts (a gap >= ``gap`` starts one) and the flood count
    lagged = F.lag("ts").over(w)
    d = (d.withColumn("_rn", F.row_number().over(w))
         .withColumn("_new", F.when(lagged.isNotNull(), (F.col("ts") - lagged >= gap).cast("int"))))
    d = _once(d.withColumn("_start_loc", F.max(F.when(F.col("_new") == 1, F.col("_rn"))).over(run)))
    ws = Window.partitionBy(U).orderBy(C)
    before = ws.rowsBetween(Window.unboundedPreceding, -1)
    s1 = (d.groupBy(*K).agg(F.min("ts").alias("_first_ts"), F.max("ts").alias("_last_ts"),
                            F.count(F.lit(1)).alias("_n"), F.max(F.when(F.col("_new") == 1, F.col("_rn"))).alias("_sl"))
          .withColumn("_first_new", (F.lag("_last_ts").over(ws).isNull() |
                                     (F.col("_first_ts") - F.lag("_last_ts").over(ws) >= gap)))
          .withColumn("_cnt_before", F.coalesce(F.sum("_n").over(before), F.lit(0))))
    s1 = (s1.withColumn("_chunk_start", F.when(F.col("_sl").isNotNull(), F.col("_cnt_before") + F.col("_sl"))
                        .when(F.col("_first_new"), F.col("_cnt_before") + 1))
          .withColumn("_start_before", F.max("_chunk_start").over(before))
          .select(*K, "_first_new", "_cnt_before", "_start_before"))
    d = d.join(s1, K)
    start = F.coalesce(F.col("_cnt_before") + F.col("_start_loc"),
                       F.when(F.col("_first_new"), F.col("_cnt_before") + 1), F.col("_start_before"))
    fc = F.col("_cnt_before") + F.col("_rn") - start + 1
    free = F.col("plan") == "free_trial"
    d = d.withColumn("_flood_rej", fc > F.col("flood_limit"))

    # pass 2: free-day counter per (user, UTC day); a chunk lies inside one day
    d = _once(d.withColumn("_dv", (free & ~F.col("_flood_rej")).cast("int"))
              .withColumn("_dc_loc", F.sum("_dv").over(run)))
    wd = Window.partitionBy(U, "_date").orderBy(C).rowsBetween(Window.unboundedPreceding, -1)
    s2 = (d.groupBy(*K, "_date").agg(F.sum("_dv").alias("_dt"))
          .withColumn("_dc_before", F.coalesce(F.sum("_dt").over(wd), F.lit(0))).select(*K, "_dc_before"))
    d = d.join(s2, K)
    dc = F.col("_dc_before") + F.col("_dc_loc")
    day_rej = free & ~F.col("_flood_rej") & F.col("day_limit").isNotNull() & (dc > F.col("day_limit"))
    d = d.withColumn("_passed", ~F.col("_flood_rej") & ~day_rej).withColumn("_day_rej", day_rej)

    # pass 3: per-agent counter per (user, agent, day) and the group's limit range
    wa = Window.partitionBy(*K, "agent_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    L = F.col("agent_limit")
    d = _once(d.withColumn("_i_loc", F.sum(F.col("_passed").cast("int")).over(wa)))
    wg = Window.partitionBy(U, "agent_id", "_date")
    s3 = (d.groupBy(*K, "agent_id", "_date").agg(
            F.sum(F.col("_passed").cast("int")).alias("_it"),
            F.min(F.when(F.col("_passed"), L)).alias("_mn"), F.max(F.when(F.col("_passed"), L)).alias("_mx"))
          .withColumn("_i_before", F.coalesce(F.sum("_it").over(wg.orderBy(C).rowsBetween(Window.unboundedPreceding, -1)),
                                              F.lit(0)))
          .withColumn("_varying", F.coalesce(F.min("_mn").over(wg) != F.max("_mx").over(wg), F.lit(False)))
          # at most one entry per agent: collapse to one row per (user, chunk)
          .groupBy(*K).agg(F.collect_list(F.struct("agent_id", "_i_before", "_varying")).alias("_agents")))
    d = d.join(s3, K)
    me = F.get(F.filter("_agents", lambda x: x["agent_id"] == F.col("agent_id")), F.lit(0))
    i = me["_i_before"] + F.col("_i_loc")
    ok = F.coalesce(F.col("_passed") & (i <= L), F.lit(False))  # allowed only on proof
    reason = (F.when(F.col("_flood_rej") & free, "free_minute").when(F.col("_flood_rej"), "flood")
              .when(F.col("_day_rej"), "free_daily").when(ok, "allowed").otherwise("daily_quota"))
    d = d.select("request_id", U, "agent_id", "ts", "plan", reason.alias("reason"),
                 F.when(ok, (L - i).cast("long")).otherwise(F.lit(0).cast("long")).alias("remaining"),
                 me["_varying"].alias("_varying"), "_date", "_passed", "agent_limit")
    # with one limit per group the counter is min(i, L); a plan change inside
    # (user, agent, day) changes the limit: those rare groups get the exact
    # sequential counter
    d = _once(d)
    good = d.where(~F.col("_varying")).drop("_varying", "_date", "_passed", "agent_limit")
    redo = _fold_downgraded(d.where(F.col("_varying")))
    return none.unionByName(good).unionByName(redo)


def _fold_downgraded(d: DataFrame) -> DataFrame:
    """Exact counter for the rare (user, agent, day) groups whose limit changes
    mid-day (plan change), in closed form: inside a run of equal limit L that
    starts at count c, the i-th passed request is allowed iff c + i <= L, and
    the run of n leaves the count at min(c + n, max(c, L)).  Runs (one per plan
    change) are folded in order; rows only look their run's start up."""
    G = ["tg_user_id", "agent_id", "_date"]
    w = Window.partitionBy(*G).orderBy(*ORDER)
    p = d.where("_passed").withColumn(
        "_new", F.coalesce((F.lag("agent_limit").over(w) != F.col("agent_limit")).cast("int"), F.lit(0)))
    p = p.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    p = p.withColumn("_i", F.row_number().over(Window.partitionBy(*G, "_run").orderBy(*ORDER)).cast("long"))
    runs = p.groupBy(*G, "_run").agg(F.first("agent_limit").cast("long").alias("l"), F.count(F.lit(1)).alias("n"))
    runs = runs.groupBy(*G).agg(F.sort_array(F.collect_list(F.struct("_run", "l", "n"))).alias("_rs"))
    zero = F.struct(F.lit(0).cast("long").alias("c"),
                    F.array().cast("array<struct<_run:bigint,c:bigint>>").alias("starts"))
    fold = F.aggregate("_rs", zero, lambda s, r: F.struct(
        F.least(s["c"] + r["n"], F.greatest(s["c"], r["l"])).alias("c"),
        F.concat(s["starts"], F.array(F.struct(r["_run"].cast("long").alias("_run"), s["c"].alias("c")))).alias("starts")))
    starts = runs.select(*G, F.explode(fold["starts"]).alias("_s")).select(*G, "_s._run", F.col("_s.c").alias("_c"))
    done = p.join(starts, [*G, "_run"])
    ok = F.col("_c") + F.col("_i") <= F.col("agent_limit")
    cols = ["request_id", "tg_user_id", "agent_id", "ts", "plan"]
    passed = done.select(*cols, F.when(ok, "allowed").otherwise("daily_quota").alias("reason"),
                         F.when(ok, F.col("agent_limit") - F.col("_c") - F.col("_i")).otherwise(0).cast("long").alias("remaining"))
    return passed.unionByName(d.where("not _passed").select(*cols, "reason", F.lit(0).cast("long").alias("remaining")))


# A3 -------------------------------------------------------------------------
def usage_quota_daily(decisions: DataFrame) -> DataFrame:
    a = decisions.where(F.col("reason") == "allowed")
    return a.groupBy("tg_user_id", "agent_id", yyyymmdd(F.col("ts")).alias("date")).agg(
        F.count(F.lit(1)).alias("count"), F.max("ts").alias("last_at"))


# A4 -------------------------------------------------------------------------
def remaining_quota(usage: DataFrame, subs_current: DataFrame, limits: DataFrame, date: int,
                    spark: SparkSession) -> DataFrame:
    """Every user with a current plan x every agent: limit, used, remaining.

    Each user row is expanded with the fixed five-agent list (``explode`` of
    a literal array, no join), so the output is exactly 5 rows per user."""
    u = usage.where(F.col("date") == date).select("tg_user_id", "agent_id", F.col("count").alias("used"))
    base = subs_current.select("tg_user_id", "plan").join(F.broadcast(limits.select("plan", "agent_limit")), "plan")
    base = base.withColumn("agent_id", F.explode(F.array(*[F.lit(a) for a in AGENTS])))
    return (base.join(u, ["tg_user_id", "agent_id"], "left")
            .select("tg_user_id", "agent_id", "plan", F.col("agent_limit").alias("limit"),
                    F.coalesce("used", F.lit(0).cast("long")).alias("used"),
                    F.greatest(F.lit(0).cast("long"), F.col("agent_limit") - F.coalesce("used", F.lit(0)))
                    .cast("long").alias("remaining")))


# A5 -------------------------------------------------------------------------
def refund_quota(usage: DataFrame, giveups: DataFrame) -> DataFrame:
    """``count = max(0, count - n)`` for given-up retries, keyed by the
    request's own date (the reference uses the drain day; see README)."""
    n = giveups.groupBy("tg_user_id", "agent_id", "date").agg(F.count(F.lit(1)).alias("_n"))
    return (usage.join(n, ["tg_user_id", "agent_id", "date"], "left")
            .withColumn("count", F.greatest(F.lit(0).cast("long"),
                                            F.col("count") - F.coalesce("_n", F.lit(0)).cast("long")))
            .drop("_n"))


# A6 -------------------------------------------------------------------------
def rejection_funnel(decisions: DataFrame) -> DataFrame:
    """Counts and share by reason per (UTC date, plan)."""
    g = decisions.groupBy(yyyymmdd(F.col("ts")).alias("date"), F.coalesce("plan", F.lit("none")).alias("plan"),
                          "reason").agg(F.count(F.lit(1)).alias("n"))
    tot = g.groupBy("date", "plan").agg(F.sum("n").alias("_tot"))
    return g.join(tot, ["date", "plan"]).select(
        "date", "plan", "reason", "n", F.round(F.col("n") / F.col("_tot"), 4).alias("share"))

