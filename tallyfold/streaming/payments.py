"""T5: payment state (B3) as a stream of transitions.

Payment rows and provider callbacks are two inputs of one stream.  A grouped
aggregate in update mode keeps, per payment, its own status, the first paid,
the first refunded and the last failed event, which is all that B3's closed
form needs; partial aggregates combine a hot payment before the shuffle, and no
batch reads or rewrites a payment table.  Every row carries the time of the
micro-batch that brought it (``current_timestamp``, fixed for a batch and equal
when it is replayed).  A payment is emitted only if the event that decides its
state, or the payment row itself, came in this batch, so the output is the
transitions and nothing else.  Callbacks of a payment that has not arrived wait
in the state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.billing import FAILURES, PAID, normalize_payment_status
from ..sources.callbacks import verify_callbacks

# The state holds every payment: on local disk, with bounded memory beside the heap; counting its rows would read each
# key once more.
_STORE = "spark.sql.streaming.stateStore."
STATE_STORE = {_STORE + "providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
               _STORE + "rocksdb.boundedMemoryUsage": "true", _STORE + "rocksdb.trackTotalNumberOfRows": "false"}
TRANSITION = "payment_id", "status", "finalized_at", "tx_hash", "event_id"


def first_of(e: Column) -> tuple[Column, ...]:
    return e["ts"].alias("ts"), e["event_id"].alias("event_id"), e["at"].alias("at")


def payment_transitions(payments: DataFrame, callbacks: DataFrame, secret_a: str, secret_b: str, status_map: DataFrame) -> DataFrame:
    """Streams ``payments (id, status)`` and raw ``callbacks`` -> transitions
    (payment_id, status, finalized_at, tx_hash, event_id), update mode."""
    now = F.unix_micros(F.current_timestamp())
    event = "struct<status:string,ts:bigint,tx_hash:string,event_id:bigint,at:bigint>"
    ev = normalize_payment_status(verify_callbacks(callbacks, secret_a, secret_b).where(F.col("outcome") == "ok"), status_map)
    ev = ev.select("payment_id", F.lit(None).cast("struct<at:bigint,status:string>").alias("own"),
                   F.struct("status", "ts", "tx_hash", "event_id", now.alias("at")).cast(event).alias("ev"))
    own = payments.select(F.col("id").alias("payment_id"), F.struct(now.alias("at"), "status").alias("own"), F.lit(None).cast(event).alias("ev"))
    # A redelivered event keeps the batch that brought it first.  Each struct begins with what orders it and goes on
    # with what is returned, so the state holds nothing twice.
    first, last = ("ev.ts", "ev.event_id", "ev.at"), ("ev.ts", "ev.event_id", (-F.col("ev.at")).alias("neg"))
    paid, refund, failed = F.col("ev.status") == PAID, F.col("ev.status") == "refunded", F.col("ev.status").isin(*FAILURES)
    state = own.unionByName(ev).groupBy("payment_id").agg(
        F.min("own").alias("own"), F.min(F.when(paid, F.struct(*first, "ev.tx_hash"))).alias("paid"),
        F.min(F.when(refund, F.struct(*first))).alias("refund"), F.max(F.when(failed, F.struct(*last, "ev.status"))).alias("failed"))
    refund, failed = F.col("refund"), F.col("failed")
    nothing = F.lit(None).cast("string").alias("tx_hash")
    fail = F.when(refund.isNotNull(), F.struct(F.lit("refunded").alias("status"), *first_of(refund), nothing)).when(
        failed.isNotNull(), F.struct("failed.status", "failed.ts", "failed.event_id", (-failed.neg).alias("at"), nothing))
    paid = F.when(F.col("paid").isNotNull(), F.struct(F.lit(PAID).alias("status"), *first_of(F.col("paid")), "paid.tx_hash"))
    state = state.select("payment_id", "own", paid.alias("paid"), fail.alias("fail"))
    s0 = F.col("own.status")
    new = F.when(F.col("paid").isNotNull() & (s0 != PAID), F.col("paid")).when(
        F.col("paid").isNull() & F.col("fail").isNotNull() & ~s0.isin(PAID, "refunded"), F.col("fail"))
    state = state.select("payment_id", "own", new.alias("new")).where(F.col("new").isNotNull() & F.col("own").isNotNull())
    state = state.where((F.col("new.at") == now) | (F.col("own.at") == now))
    return state.select("payment_id", "new.status", F.col("new.ts").alias("finalized_at"),
                        "new.tx_hash", "new.event_id")


def run_transitions(spark: SparkSession, transitions: DataFrame, root: str) -> DataFrame:
    """Runs the stream to its present end; each batch writes its own folder,
    so a replayed batch replaces its rows.  Returns all transitions so far."""
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/transitions/epoch={epoch}")

    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        (transitions.writeStream.option("checkpointLocation", f"{root}/_checkpoint").trigger(availableNow=True)
         .outputMode("update").foreachBatch(write).start().awaitTermination())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(transitions.schema.add("epoch", "integer")).parquet(f"{root}/transitions")


def replay(payments: DataFrame, transitions: DataFrame) -> DataFrame:
    """The payment rows after their last transition."""
    last = transitions.groupBy("payment_id").agg(F.max_by(F.struct("status", "finalized_at", "tx_hash"), "epoch").alias("t"))
    p = payments.join(last.withColumnRenamed("payment_id", "id"), "id", "left")
    return p.select(*(F.col(c) for c in payments.columns if c not in ("status", "finalized_at")),
                    F.coalesce("t.status", "status").alias("status"),
                    F.when(F.col("t").isNotNull(), F.col("t.finalized_at")).otherwise(F.col("finalized_at")).alias("finalized_at"),
                    F.col("t.tx_hash").alias("tx_hash"))
