"""L1–L4: LLM-call telemetry, cost model and the retry queue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import DAY, idiv, yyyymmdd


# L1 -------------------------------------------------------------------------
def invocation_cost(inv: DataFrame, rates: DataFrame) -> DataFrame:
    """Add ``cost_usd_e4 = round((in*r_in + out*r_out) / 1e6 * 1e4)``.

    Lookup on ``(provider, model)`` first, then ``(provider, last path segment
    of model)``; no rate -> 0.  Rates are integer hundredths, so the rounding
    is exact integer half-up: ``(in*R_in + out*R_out + 5000) div 10000``.
    ``rates`` is the fixed five-row table: both joins broadcast it.
    """
    r = F.broadcast(rates)
    full = r.select("provider", "model", F.col("r_in").alias("_i1"), F.col("r_out").alias("_o1"))
    tail = r.select("provider", F.col("model").alias("_tail"), F.col("r_in").alias("_i2"),
                    F.col("r_out").alias("_o2"))
    x = (inv.join(full, ["provider", "model"], "left")
         .withColumn("_tail", F.element_at(F.split("model", "/"), -1))
         .join(tail, ["provider", "_tail"], "left"))
    ri, ro = F.coalesce("_i1", "_i2"), F.coalesce("_o1", "_o2")
    cost = F.when(ri.isNull(), F.lit(0).cast("long")).otherwise(
        idiv(F.col("input_tokens") * ri + F.col("output_tokens") * ro + 5000, 10000))
    return x.withColumn("cost_usd_e4", cost.cast("long")).drop("_i1", "_o1", "_i2", "_o2", "_tail")


# L2 -------------------------------------------------------------------------
def agent_usage_daily(inv: DataFrame, as_of: int, days: int = 30, approx: bool = False) -> DataFrame:
    w = inv.where((F.col("created_at") > as_of - days * DAY) & (F.col("created_at") <= as_of))
    users = F.approx_count_distinct("tg_user_id") if approx else F.count_distinct("tg_user_id")
    return w.groupBy("agent_id", yyyymmdd("created_at").alias("date")).agg(
        F.count(F.lit(1)).alias("invocations"),
        users.alias("unique_users"),
        F.sum("input_tokens").alias("total_input_tokens"),
        F.sum("output_tokens").alias("total_output_tokens"),
        F.round(F.avg("latency_ms"), 4).alias("avg_latency_ms"),
        (F.sum("cost_usd_e4") / F.lit(10000.0)).alias("total_cost_usd"),
        F.count(F.when(F.col("status") == "success", 1)).alias("success_count"),
        F.count(F.when(~F.col("status").isin("success", "retried_ok"), 1)).alias("error_count"))


# L4 -------------------------------------------------------------------------
MAX_ATTEMPTS = 3
QUEUE_TTL_S = 3600


def parse_retry_items(queue: DataFrame) -> DataFrame:
    """Queue rows with ``item`` (the JSON of ``raw``) and ``parsed``."""
    schema = ("user_id long, chat_id long, agent_id string, "
              "messages array<struct<role:string,content:string>>, attempts int, enqueued_at long, "
              "original_msg_id long")
    q = queue.withColumn("item", F.from_json("raw", schema))
    return q.withColumn("parsed", F.col("item").isNotNull() & F.col("item.user_id").isNotNull())


def retry_step(queue: DataFrame, outcomes: DataFrame, as_of: int, batch: int | None = None) -> DataFrame:
    """One drain cycle of the retry queue.

    ``queue (key, raw)`` holds JSON items; ``outcomes (key, ok)`` the result
    of the retried call.  Items older than the TTL since their last enqueue
    have expired; malformed JSON is deleted.  ``batch`` optionally bounds a
    cycle (key order); the default drains every item.  Output: one row per taken item with ``action`` in
    ``retried_ok / requeue / give_up / drop_malformed`` and the new attempts.
    """
    q = parse_retry_items(queue)
    parsed_ok = F.col("parsed")
    # TTL: keys expire 1 h after their last put
    live = q.where(~parsed_ok | (F.col("item.enqueued_at") > as_of - QUEUE_TTL_S))
    if batch is not None:
        live = live.orderBy("key").limit(batch)
    x = live.join(outcomes, "key", "left")
    new_att = F.col("item.attempts") + 1
    action = (F.when(~parsed_ok, "drop_malformed")
              .when(F.coalesce(F.col("ok"), F.lit(False)), "retried_ok")
              .when(new_att >= MAX_ATTEMPTS, "give_up").otherwise("requeue"))
    return x.select("key", F.col("item.user_id").alias("user_id"), F.col("item.agent_id").alias("agent_id"),
                    F.col("item.enqueued_at").alias("enqueued_at"), action.alias("action"),
                    F.when(parsed_ok & ~F.coalesce(F.col("ok"), F.lit(False)), new_att)
                    .otherwise(F.col("item.attempts")).alias("attempts"))
