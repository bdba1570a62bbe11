"""The cron cycle as one stream of firings that drives several jobs.

Every firing (a 5-minute slot) drains the retry queue and rechecks pending
payments; the first firing of a date between 00:00 and 00:10 UTC also purges
messages, expires subscriptions and sends nudges.  One micro-batch may hold one
slot or a backlog of many: a job gets the batch's slots as a table and computes
all its runs at once, each fact joined to the slot that handles it, so there is
no loop over runs.

Commits.  ``CommitLedger`` holds one folder per (job, epoch).  A batch first
commits its slots and daily slots; then each job writes its rows and commits.  A replayed batch
(same epoch) finds the committed slots, skips the jobs that committed and
overwrites what an unfinished one has left, so no run of a job is done twice
and none is lost.  A firing older than the last committed slot is ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.time import DAY, WEEK, yyyymmdd
from ..functions.windows import adaptive_chunk, chunked_last_non_null
from ..operators.billing import activation_intervals, remote_completed
from ..operators.cohorts import live_users, send_once
from ..operators.telemetry import MAX_ATTEMPTS, QUEUE_TTL_S, parse_retry_items
from ..session import ensure_checkpoint_dir, path_exists

SLOT_S = 300
DAILY_WINDOW_S = 600


@dataclass(frozen=True)
class Runs:
    """What a job is asked to do: its new ``slots (slot)``, the last slot of
    earlier batches (None at first), all slots so far, and its earlier rows."""

    slots: DataFrame
    before: int | None
    known: DataFrame
    done: DataFrame | None


@dataclass(frozen=True)
class Job:
    name: str
    run: Callable[[Runs], DataFrame]  # rows with a ``slot`` column
    daily: bool = False


class CommitLedger:
    """Rows and commits of the jobs: ``<root>/rows/<job>/epoch=<n>`` and
    ``<root>/commits/<job>/epoch=<n>``, the slots committed in that epoch."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, kind: str, job: str, epoch: int | None = None) -> str:
        return f"{self.root}/{kind}/{job}" + ("" if epoch is None else f"/epoch={epoch}")

    def committed(self, job: str, epoch: int) -> bool:
        return path_exists(self.spark, self._at("commits", job, epoch) + "/_SUCCESS")

    def slots(self, job: str) -> DataFrame | None:
        at = self._at("commits", job)
        return self.spark.read.schema("slot long, epoch int").parquet(at) if path_exists(self.spark, at) else None

    def last_epoch(self, job: str) -> int | None:
        seen = self.slots(job)
        return None if seen is None else seen.agg(F.max("epoch")).first()[0]

    def rows(self, job: str, before: int | None = None) -> DataFrame | None:
        """The job's rows of committed epochs (below ``before``)."""
        at, seen = self._at("rows", job), self.slots(job)
        if seen is None or not path_exists(self.spark, at):
            return None
        # a batch without rows or slots of a job leaves folders without data
        rows, epochs = self.spark.read.parquet(at), seen.select("epoch").distinct()
        if before is not None:
            rows = rows.where(F.col("epoch") < before)
        return rows.join(epochs, "epoch", "left_semi")

    def commit(self, job: str, epoch: int, slots: DataFrame, rows: DataFrame | None = None) -> None:
        if rows is not None:
            rows.write.mode("overwrite").parquet(self._at("rows", job, epoch))
        slots.select("slot").write.mode("overwrite").parquet(self._at("commits", job, epoch))


def daily_slots(slots: DataFrame) -> DataFrame:
    """The first slot of every date inside the daily window."""
    d = slots.where(F.pmod("slot", F.lit(DAY)) < DAILY_WINDOW_S)
    return d.groupBy(F.floor(F.col("slot") / DAY).alias("_d")).agg(F.min("slot").alias("slot")).select("slot")


def at_next_slot(rows: DataFrame, slots: DataFrame, ready: Column, more: int = 0) -> DataFrame:
    """Each row with the first slot at or after ``ready`` (``slot``) and the
    ``more`` slots after it (``slot2``...); rows that no slot follows drop out.

    Slots lie on the 5-minute grid, so the as-of lookup is an equi-join on the
    grid cell; slots and cells are bounded by the calendar the batch spans."""
    w = Window.orderBy("slot")
    ahead = [F.lead("slot", i).over(w).alias(f"slot{i + 1}") for i in range(1, more + 1)]
    cal = slots.select("slot", F.coalesce(F.lag("slot").over(w) + SLOT_S, F.col("slot")).alias("_from"), *ahead)
    cells = cal.select(F.explode(F.sequence("_from", "slot", F.lit(SLOT_S))).alias("_cell"),
                       "slot", *(f"slot{i + 1}" for i in range(1, more + 1)))
    first = slots.agg(F.min("slot")).first()[0]  # one number
    cell = F.greatest(F.ceil(ready / F.lit(SLOT_S)) * SLOT_S, F.lit(first)).cast("long")
    return rows.withColumn("_cell", cell).join(cells, "_cell").drop("_cell")


# Jobs ------------------------------------------------------------------------
def retry_drain(queue: DataFrame, outcomes: DataFrame) -> Job:
    """``queue (key, raw, put_at)`` and ``outcomes (key, attempt, ok)``, the
    result of the call that finds the item with ``attempt`` attempts.

    An item is taken at the first slot after it was put, unless its hour is
    over; a failure puts it back for the next slot, until the attempts are used
    up.  One row per taken item and slot."""

    def run(r: Runs) -> DataFrame:
        first = r.slots.agg(F.min("slot")).first()[0]
        reach = first - MAX_ATTEMPTS * QUEUE_TTL_S  # an older item cannot have a try left
        ok = outcomes.groupBy("key").agg(*(
            F.max(F.when(F.col("attempt") == a, F.col("ok"))).alias(f"_ok{a}") for a in range(MAX_ATTEMPTS)))
        items = at_next_slot(parse_retry_items(queue.where(F.col("put_at") > reach)), r.known.where(F.col("slot") > reach),
                             F.col("put_at"), MAX_ATTEMPTS - 1).join(ok, "key", "left")
        start = F.coalesce(F.col("item.attempts"), F.lit(0))
        alive, put, tries = F.lit(True), F.col("put_at"), []
        for i in range(MAX_ATTEMPTS):
            slot, a = F.col("slot" if i == 0 else f"slot{i + 1}"), start + i
            good = F.lit(False)
            for k in range(MAX_ATTEMPTS):
                good = F.when(a == k, F.coalesce(F.col(f"_ok{k}"), F.lit(False))).otherwise(good)
            alive = alive & F.coalesce(slot - put < QUEUE_TTL_S, F.lit(False))
            action = (F.when(~F.col("parsed"), "drop_malformed").when(good, "retried_ok")
                      .when(a + 1 >= MAX_ATTEMPTS, "give_up").otherwise("requeue"))
            tries.append(F.when(alive, F.struct(slot.alias("slot"), action.alias("action"),
                                                F.when(F.col("parsed"), F.when(good, a).otherwise(a + 1)).cast("int").alias("attempts"))))
            alive, put = alive & (action == "requeue"), slot
        x = items.withColumn("_t", F.explode(F.array(*tries))).where(F.col("_t").isNotNull())
        out = x.select(F.col("_t.slot").alias("slot"), "key", F.col("item.user_id").alias("user_id"),
                       F.col("item.agent_id").alias("agent_id"), "put_at", F.col("_t.action").alias("action"),
                       F.col("_t.attempts").alias("attempts"))
        return out.join(r.slots, "slot", "left_semi")

    return Job("retry_drain", run)


def payment_recheck(payments: DataFrame, snapshot: DataFrame, plans: DataFrame) -> Job:
    """Online payments pending for over an hour that ``snapshot (id, provider,
    remote_status)`` reports as completed: paid at the slot, with the
    subscription interval they open."""

    def run(r: Runs) -> DataFrame:
        p = payments.where(F.col("status") == "pending").select("id", "tg_user_id", "provider", "plan", "created_at")
        p = p.join(snapshot.where(remote_completed()), ["id", "provider"])
        if r.done is not None:
            p = p.join(r.done.select("id"), "id", "left_anti")
        paid = at_next_slot(p, r.slots, F.col("created_at") + 3601).withColumn("finalized_at", F.col("slot"))
        spans = activation_intervals(paid, plans).select(F.col("payment_id").alias("id"), "started_at", "expires_at")
        return paid.select("slot", "id", "tg_user_id", "provider", "plan", "finalized_at").join(spans, "id")

    return Job("payment_recheck", run)


def purge_ledger(runs: DataFrame, usage_counts: DataFrame, keep_days: int = 7) -> DataFrame:
    """For each daily run date ``D`` (yyyymmdd int): the quota purge cutoff
    (``D - keep_days``), rows deleted so far (date < cutoff) and rows kept
    (cutoff <= date < D).  Computed as prefix sums on one date timeline
    (usage counts per date plus two probe rows per run), whose size is
    bounded by the calendar, not by the data."""
    d = F.to_date(F.col("date").cast("string"), "yyyyMMdd")
    r = runs.select(F.col("date").alias("run"),
                    F.date_format(F.date_sub(d, keep_days), "yyyyMMdd").cast("int").alias("cutoff"))
    probes = (r.select(F.col("cutoff").alias("date"), "run", F.lit("cut").alias("role"))
              .unionByName(r.select(F.col("run").alias("date"), "run", F.lit("run").alias("role"))))
    tl = (probes.select("date", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("n"), "run", "role")
          .unionByName(usage_counts.select("date", F.lit(1).alias("kind"), F.col("n").cast("long"),
                                           F.lit(None).cast("int").alias("run"), F.lit(None).cast("string").alias("role"))))
    # probes sort before same-date counts, so the running sum at a probe is sum(n | date < probe)
    w = Window.orderBy("date", "kind").rowsBetween(Window.unboundedPreceding, 0)
    tl = tl.withColumn("cum", F.sum("n").over(w)).where(F.col("kind") == 0)
    g = tl.groupBy("run").agg(F.max(F.when(F.col("role") == "cut", F.col("cum"))).alias("deleted_total"),
                              F.max(F.when(F.col("role") == "run", F.col("cum"))).alias("_upto"),
                              F.max(F.when(F.col("role") == "cut", F.col("date"))).alias("cutoff"))
    return g.select(F.col("run").alias("date"), "cutoff", "deleted_total",
                    (F.col("_upto") - F.col("deleted_total")).alias("kept"))


def quota_purge(usage: DataFrame, keep_days: int = 7) -> Job:
    """Quota rows (``date``) older than ``keep_days`` go: per run the cutoff
    date, the rows deleted so far and those left."""
    counts = usage.groupBy("date").agg(F.count(F.lit(1)).alias("n"))

    def run(r: Runs) -> DataFrame:
        dated = r.slots.select("slot", yyyymmdd("slot").alias("date"))
        return purge_ledger(dated, counts, keep_days).join(dated, "date").select("slot", "date", "cutoff", "deleted_total", "kept")

    return Job("quota_purge", run, daily=True)


def message_purge(messages: DataFrame, keep_days: int = 30) -> Job:
    """Messages (``created_at``) older than ``keep_days`` at a run go: per run
    the cutoff, the messages deleted and those left.  The table is counted by
    5-minute cells first; what follows is bounded by the calendar."""

    def run(r: Runs) -> DataFrame:
        m = messages
        if r.before is not None:  # what earlier runs deleted is gone
            m = m.where(F.col("created_at") + keep_days * DAY >= r.before)
        h = m.groupBy((F.ceil(F.col("created_at") / SLOT_S) * SLOT_S).cast("long").alias("come"),
                      (F.ceil((F.col("created_at") + keep_days * DAY + 1) / SLOT_S) * SLOT_S).cast("long").alias("go")
                      ).agg(F.count(F.lit(1)).alias("n"))
        come = at_next_slot(h, r.slots, F.col("come")).select("slot", F.col("n").alias("come"), F.lit(0).alias("gone"))
        gone = at_next_slot(h, r.slots, F.col("go")).select("slot", F.lit(0).alias("come"), F.col("n").alias("gone"))
        none = r.slots.select("slot", F.lit(0).alias("come"), F.lit(0).alias("gone"))
        per = come.unionByName(gone).unionByName(none).groupBy("slot").agg(F.sum("come").alias("come"), F.sum("gone").alias("gone"))
        left = F.sum(F.col("come") - F.col("gone")).over(Window.orderBy("slot"))  # one row per run
        return per.select("slot", (F.col("slot") - keep_days * DAY).alias("cutoff"), F.col("gone").cast("long").alias("deleted"),
                          left.cast("long").alias("kept"))

    return Job("message_purge", run, daily=True)


def subscription_expiry(subs: DataFrame) -> Job:
    """Subscription rows (with ``closed_at``, B4) that are active and past
    ``expires_at`` at a run are set inactive there, once."""

    def run(r: Runs) -> DataFrame:
        ready = F.greatest(F.col("expires_at") + 1, F.col("started_at"))
        s = subs if r.before is None else subs.where(ready > r.before)
        x = at_next_slot(s, r.slots, ready).where(F.col("closed_at").isNull() | (F.col("closed_at") > F.col("slot")))
        return x.select("slot", "payment_id", "tg_user_id", "plan", "started_at", "expires_at")

    return Job("subscription_expiry", run, daily=True)


def _on_days(rows: DataFrame, slots: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """Rows with every daily slot in [lo, hi]; ``hi`` lies at most a paid
    period after ``lo``, so a row meets a bounded number of dates."""
    d = rows.withColumns({"_lo": lo, "_hi": hi}).where(F.col("_lo") <= F.col("_hi"))
    d = d.withColumn("_d", F.explode(F.sequence(F.floor(F.col("_lo") / DAY), F.floor(F.col("_hi") / DAY))))
    by_day = slots.select("slot", F.floor(F.col("slot") / DAY).alias("_d"))
    return d.join(by_day, "_d").where(F.col("slot").between(F.col("_lo"), F.col("_hi"))).drop("_d", "_lo", "_hi")


def nudge_candidates(users: DataFrame, subs: DataFrame, inv: DataFrame, slots: DataFrame) -> DataFrame:
    """The six cohorts at every slot at once: (slot, tg_user_id, event, params).
    ``subs`` has ``closed_at``; a row is active at a slot from its start until
    it is closed or expires."""
    bounds = slots.agg(F.min("slot").alias("a"), F.max("slot").alias("b")).first()
    a, b = bounds["a"], bounds["b"]
    people = live_users(users).select("tg_user_id", "registered_at")
    # users whose registration puts them into a cohort at some slot, with the day of the cohort
    cohort = people.where(F.col("registered_at").between(a - 8 * DAY, b)).withColumn("day", F.explode(F.array(*map(F.lit, (1, 2, 4, 6)))))
    cohort = _on_days(cohort, slots, F.col("registered_at") + F.col("day") * DAY, F.col("registered_at") + (F.col("day") + 1) * DAY)
    active = (F.col("started_at") <= F.col("slot")) & (F.col("closed_at").isNull() | (F.col("closed_at") > F.col("slot"))) \
        & (F.col("expires_at") >= F.col("slot"))
    trials = (cohort.where(F.col("day") == 6).join(subs.where(F.col("plan") == "free_trial").drop("plan"), "tg_user_id").where(active)
              .groupBy("tg_user_id", "slot").agg(F.count(F.lit(1)).alias("trials")))
    calls = inv.select("tg_user_id", "agent_id", "created_at").join(cohort.select("tg_user_id").distinct(), "tg_user_id", "left_semi")
    used = (cohort.select("tg_user_id", "slot").distinct().join(calls, "tg_user_id").where(F.col("created_at") <= F.col("slot"))
            .groupBy("tg_user_id", "slot").agg(F.count_distinct("agent_id").alias("agents"), F.count("agent_id").alias("calls")))
    c = cohort.join(used, ["tg_user_id", "slot"], "left").join(trials, ["tg_user_id", "slot"], "left")
    agents, day, trial = F.coalesce("agents", F.lit(0)), F.col("day"), F.coalesce("trials", F.lit(0))
    event = (F.when((day == 1) & F.col("calls").isNull(), "d1_no_first_request")
             .when((day == 2) & F.col("calls").isNull(), "d2_no_first_request")
             .when((day == 4) & (agents == 1), "d4_one_agent")
             .when((day == 6) & (trial > 0) & (agents >= 3), "d7_trial_activated")
             .when((day == 6) & (trial > 0), "d7_trial_not_activated"))
    params = F.when(event == "d7_trial_activated", F.format_string("calls=%d;agents=%d", F.col("calls") * trial, agents)).otherwise("")
    young = c.select("slot", "tg_user_id", event.alias("event"), params.alias("params")).where(F.col("event").isNotNull())

    paid = subs.where((F.col("plan") != "free_trial") & (F.col("started_at") <= b) & (F.col("expires_at") >= a))
    e = F.col("expires_at")
    ending = _on_days(paid, slots, e - 3 * DAY, e - 2 * DAY).where(active)
    ending = ending.select("slot", "tg_user_id", F.format_string("sub_expiring_%d", e).alias("event"),
                           F.format_string("plan=%s;date=%s", F.col("plan"), F.date_format(F.timestamp_seconds(e), "yyyy-MM-dd")).alias("params"))

    # payers at every slot of their paid time, and their last call before it
    payer = _on_days(paid, slots, F.greatest("started_at", F.lit(a)), F.least(e, F.coalesce(F.col("closed_at") - 1, e), F.lit(b)))
    payer = payer.join(people.select("tg_user_id"), "tg_user_id", "left_semi").select("tg_user_id", "slot").distinct()
    ask = payer.select("tg_user_id", F.col("slot").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("call"))
    told = (inv.where(F.col("created_at") <= b).join(payer.select("tg_user_id").distinct(), "tg_user_id", "left_semi")
            .groupBy("tg_user_id", F.floor(F.col("created_at") / DAY).alias("d"))  # a run sees a day's last call, or its own day's up to the slot
            .agg(F.array(F.max("created_at"), *(F.max(F.when(F.pmod("created_at", F.lit(DAY)) <= x, F.col("created_at")))
                                                for x in range(0, DAILY_WINDOW_S, SLOT_S))).alias("t")))
    told = told.select("tg_user_id", F.explode(F.array_distinct("t")).alias("t")).where(F.col("t").isNotNull())
    u = ask.unionByName(told.select("tg_user_id", "t", F.lit(0).alias("kind"), F.col("t").alias("call")))
    u = adaptive_chunk(u, ["tg_user_id"], "t", "_chunk", base_s=30 * DAY, fine_s=DAY)
    u = chunked_last_non_null(u, ["tg_user_id"], ["t", "kind"], "_chunk", "call", "last_call").where(F.col("kind") == 1)
    silent = u.where(F.col("last_call") < F.col("t") - 7 * DAY).select(
        F.col("t").alias("slot"), "tg_user_id", F.concat(F.lit("silence_7d_"), F.floor(F.col("t") / WEEK).cast("string")).alias("event"),
        F.lit("").alias("params"))
    return young.unionByName(ending).unionByName(silent)


def nudges(users: DataFrame, subs: DataFrame, inv: DataFrame, ttl_days: int = 60) -> Job:
    """Nudges of the six cohorts, each (user, event) once within the TTL."""

    def run(r: Runs) -> DataFrame:
        return send_once(nudge_candidates(users, subs, inv, r.slots), r.done, ttl_days)

    return Job("nudges", run, daily=True)


# Cycle -----------------------------------------------------------------------
def run_cycle(spark: SparkSession, ticks: DataFrame, jobs: list[Job], root: str, new_stream: bool = False) -> CommitLedger:
    """Runs the stream ``ticks (ts)`` to its present end with ``jobs``; a later
    call with the same ``root`` goes on where this one stopped or failed.
    ``new_stream`` starts a stream without a checkpoint over the same ledger
    (the old one is lost or its source has changed): its epochs follow the
    committed ones, and firings up to the last committed slot are ignored."""
    ledger = CommitLedger(spark, root)
    base = ledger.last_epoch("stream")
    if base is None or new_stream:
        base = max([-1, *(e for e in (base, ledger.last_epoch("tick")) if e is not None)]) + 1
        ledger.commit("stream", base, spark.range(1).select(F.lit(base).cast("long").alias("slot")))

    def batch(rows: DataFrame, number: int) -> None:
        epoch = base + number
        if not ledger.committed("tick", epoch):
            new = rows.select((F.floor(F.col("ts") / SLOT_S) * SLOT_S).cast("long").alias("slot")).distinct()
            seen = ledger.slots("tick")
            last = None if seen is None else seen.where(F.col("epoch") < epoch).agg(F.max("slot")).first()[0]
            ledger.commit("tick", epoch, new if last is None else new.where(F.col("slot") > last))
        if not ledger.committed("day", epoch):
            known = ledger.slots("tick").where(F.col("epoch") <= epoch)
            ledger.commit("day", epoch, daily_slots(known).join(known.where(F.col("epoch") == epoch), "slot", "left_semi"))
        for job in jobs:
            if ledger.committed(job.name, epoch):
                continue
            known = ledger.slots("day" if job.daily else "tick").where(F.col("epoch") <= epoch)
            before = known.where(F.col("epoch") < epoch).agg(F.max("slot")).first()[0]
            mine = known.where(F.col("epoch") == epoch).select("slot")
            if mine.isEmpty():
                ledger.commit(job.name, epoch, mine)
            else:
                ledger.commit(job.name, epoch, mine, job.run(Runs(mine, before, known.select("slot"), ledger.rows(job.name, epoch))))

    q = (ticks.writeStream.option("checkpointLocation", f"{ledger.root}/_checkpoint/{base}").trigger(availableNow=True)
         .foreachBatch(batch).start())
    q.awaitTermination()
    return ledger


def fresh_root(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/cron/{name}-{uuid.uuid4().hex[:12]}"
