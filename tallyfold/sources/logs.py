"""S5 structured logs, S6 provider responses, S7 idempotent upsert sink."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parse_int_prefix
from ..session import ensure_checkpoint_dir, path_exists

# ---- S5 -----------------------------------------------------------------------
# allow-list: the only log keys that leave the parser (names, usernames and
# message text are personal data and are never selected)
LOG_FIELDS = [("ts", "bigint"), ("level", "string"), ("event", "string"), ("user_id", "bigint"),
              ("agent_id", "string"), ("latency_ms", "bigint"), ("error", "string")]


def parse_logs(raw: DataFrame, col: str = "line") -> DataFrame:
    """JSON-lines log -> typed events; missing level -> ``info``; lines that
    are not JSON objects or lack ``event`` are marked ``malformed``."""
    v = F.try_parse_json(F.col(col))
    sel = [F.try_variant_get(v, f"$.{k}", t).alias(k) for k, t in LOG_FIELDS]
    x = raw.select(*sel, v.isNotNull().alias("_json"))
    ok = F.col("_json") & F.col("event").isNotNull()
    return x.select(*[F.when(ok, F.col(k)).alias(k) if k != "level" else
                      F.when(ok, F.coalesce(F.col("level"), F.lit("info"))).alias("level") for k, _ in LOG_FIELDS],
                    F.when(ok, "ok").otherwise("malformed").alias("status"))


def log_counts(logs: DataFrame) -> DataFrame:
    return logs.where(F.col("status") == "ok").groupBy("event", "level").agg(F.count(F.lit(1)).alias("n"))


# ---- S6 -----------------------------------------------------------------------
# fixed model defaults of the three providers
GROQ_MODEL = "llama-3.3-70b-versatile"
OPENROUTER_MODEL = "qwen/qwen3.6-plus"
YANDEX_MODEL = "yandexgpt/latest"


def _has(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant").isNotNull()


def normalize_provider_responses(raw: DataFrame) -> DataFrame:
    """``raw (request_id, provider, body)`` -> one row per response with
    ``(content, input_tokens, output_tokens, provider, model, status)``.

    First shape: choices and usage are required (else quarantined); second:
    choices required, usage optional (missing -> 0), model optional (default);
    third: result.alternatives and result.usage required, token counts are
    strings parsed like ``parseInt(x) || 0``.  Missing content -> ''."""
    v = F.try_parse_json(F.col("body"))
    p = F.col("provider")
    g_ok = _has(v, "$.choices") & _has(v, "$.usage")
    o_ok = _has(v, "$.choices")
    y_ok = _has(v, "$.result.alternatives") & _has(v, "$.result.usage") & \
        (~_has(v, "$.result.alternatives[0]") | _has(v, "$.result.alternatives[0].message"))
    ok = v.isNotNull() & F.coalesce(F.when(p == "groq", g_ok).when(p == "openrouter", o_ok)
                                    .when(p == "yandex", y_ok), F.lit(False))
    chat_content = F.coalesce(F.try_variant_get(v, "$.choices[0].message.content", "string"), F.lit(""))
    content = F.when(p == "yandex", F.coalesce(F.try_variant_get(v, "$.result.alternatives[0].message.text",
                                                                  "string"), F.lit(""))).otherwise(chat_content)
    zero = F.lit(0).cast("long")

    def yandex_tokens(path: str) -> Column:
        n = parse_int_prefix(F.try_variant_get(v, path, "string"))
        return F.when(F.coalesce(n, zero) == 0, zero).otherwise(n)

    tin = (F.when(p == "groq", F.try_variant_get(v, "$.usage.prompt_tokens", "bigint"))
           .when(p == "openrouter", F.coalesce(F.try_variant_get(v, "$.usage.prompt_tokens", "bigint"), zero))
           .otherwise(yandex_tokens("$.result.usage.inputTextTokens")))
    tout = (F.when(p == "groq", F.try_variant_get(v, "$.usage.completion_tokens", "bigint"))
            .when(p == "openrouter", F.coalesce(F.try_variant_get(v, "$.usage.completion_tokens", "bigint"), zero))
            .otherwise(yandex_tokens("$.result.usage.completionTokens")))
    model = (F.when(p == "groq", F.lit(GROQ_MODEL))
             .when(p == "openrouter", F.coalesce(F.try_variant_get(v, "$.model", "string"), F.lit(OPENROUTER_MODEL)))
             .otherwise(F.lit(YANDEX_MODEL)))
    return raw.select("request_id", "provider", F.when(ok, model).alias("model"),
                      F.when(ok, content).alias("content"), F.when(ok, tin).alias("input_tokens"),
                      F.when(ok, tout).alias("output_tokens"),
                      F.when(ok, "ok").otherwise("quarantine").alias("status"))


# ---- S7 -----------------------------------------------------------------------
def _drop_partitions(spark: SparkSession, path: str, parts: DataFrame, partition_by: list[str]) -> None:
    """Remove the folders of partitions that hold no row any more (a handful:
    only those that an update emptied)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    esc = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    for row in parts.toLocalIterator():
        name = "/".join(esc.getPartitionPathString(c, None if row[c] is None else str(row[c])) for c in partition_by)
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        at.getFileSystem(conf).delete(at, True)


def upsert_parquet(spark: SparkSession, updates: DataFrame, path: str, keys: list[str], version: list[str],
                   partition_by: list[str]) -> None:
    """Idempotent latest-state sink (no table format assumed).

    Only the partitions that receive updates, and those that hold an older row
    of an updated key, are rewritten: their current rows are unioned with the updates, the latest version per key survives
    and is stored under the checkpoint folder (the rows are read from
    the same folder they are written to), and the partitions are replaced
    with dynamic partition overwrite.  The updates are computed once and stored
    there too, as several steps read them.  Replaying the same updates yields the
    same table."""
    stage = f"{ensure_checkpoint_dir(spark).rstrip('/')}/upsert-{uuid.uuid4().hex}"

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{stage}/{name}")
        return spark.read.schema(df.schema).parquet(f"{stage}/{name}")

    updates = stored(updates, "updates")
    if not set(partition_by) <= set(keys):
        # a key could move: the partition that holds its old row is rewritten too
        moved = updates.select(*keys).distinct()
    else:
        moved = None
    exists = path_exists(spark, path)
    if exists:  # any error while reading it surfaces; nothing is overwritten then
        table = spark.read.parquet(path)
        touched = updates.select(*partition_by)
        if moved is not None:
            touched = touched.unionByName(table.join(moved, keys, "left_semi").select(*partition_by))
        current = table.join(touched.distinct(), partition_by, "left_semi")
        merged = current.unionByName(updates.select(*current.columns))
    else:
        merged = updates
    # latest version per key as a partial aggregate (a hot key is combined map-side)
    cols = merged.columns
    latest = (merged.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*version)).alias("_r"))
              .select("_r.*").select(*cols))
    latest = stored(latest, "latest")
    emptied = None
    if exists and moved is not None:  # known before the write, removed after it
        emptied = stored(touched.distinct().join(latest.select(*partition_by).distinct(), partition_by, "left_anti"), "emptied")
    (latest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_by).parquet(path))
    if emptied is not None:  # a replay after a crash here finds and drops them again
        _drop_partitions(spark, path, emptied, partition_by)
