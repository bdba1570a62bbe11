"""S1 — typed scans of the input tables.

Schemas are declared up front so a scan never infers; Catalyst prunes the
columns a query does not touch and pushes filters into the parquet reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_L, _I, _S, _D, _TS = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType(), T.TimestampNTZType()


def _st(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# Driver-generated test tables (TESTDATA.md).
TEST_SCHEMAS: dict[str, T.StructType] = {
    "region": _st(("r_regionkey", _I), ("r_name", _S)),
    "nation": _st(("n_nationkey", _I), ("n_name", _S), ("n_regionkey", _I)),
    "customer": _st(("c_custkey", _L), ("c_name", _S), ("c_nationkey", _I), ("c_acctbal", _D),
                    ("c_mktsegment", _S)),
    "supplier": _st(("s_suppkey", _L), ("s_name", _S), ("s_nationkey", _I), ("s_acctbal", _D)),
    "part": _st(("p_partkey", _L), ("p_name", _S), ("p_brand", _S), ("p_type", _S), ("p_size", _I),
                ("p_retailprice", _D)),
    "orders": _st(("o_orderkey", _L), ("o_custkey", _L), ("o_orderstatus", _S), ("o_totalprice", _D),
                  ("o_orderdate", _TS), ("o_orderpriority", _S)),
    "lineitem": _st(("l_orderkey", _L), ("l_partkey", _L), ("l_suppkey", _L), ("l_linenumber", _I),
                    ("l_quantity", _D), ("l_extendedprice", _D), ("l_discount", _D), ("l_tax", _D),
                    ("l_returnflag", _S), ("l_linestatus", _S), ("l_shipdate", _TS)),
    "events": _st(("event_id", _L), ("ts", _TS), ("user_id", _L), ("event_type", _S), ("value", _D),
                  ("props", _S)),
    "documents": _st(("doc_id", _L), ("text", _S), ("lang", _S), ("source", _S), ("n_chars", _L)),
    "embeddings": _st(("vec_id", _L), ("embedding", T.ArrayType(T.FloatType())), ("label", _I)),
    "pages": _st(("page_id", _L), ("url", _S), ("html", _S)),
    "benchmark": _st(("item_id", _L), ("text", _S)),
    "labels": _st(("doc_id", _L), ("quality", _I), ("toxic", _I)),
    "conversations": _st(("conv_id", _L), ("turn", _L), ("role", _S), ("text", _S)),
}

# Native schemas of the application tables (FIXTURES.md §1).
NATIVE_SCHEMAS: dict[str, T.StructType] = {
    "users": _st(("tg_user_id", _L), ("username", _S), ("first_name", _S), ("last_name", _S),
                 ("language_code", _S), ("registered_at", _L), ("is_banned", _I), ("is_deleted", _I),
                 ("last_seen_at", _L), ("utm_source", _S)),
    "subscriptions": _st(("id", _L), ("tg_user_id", _L), ("plan", _S), ("is_active", _I),
                         ("started_at", _L), ("expires_at", _L), ("payment_id", _L), ("auto_renew", _I),
                         ("source", _S), ("created_at", _L)),
    "payments": _st(("id", _L), ("tg_user_id", _L), ("provider", _S), ("provider_payment_id", _S),
                    ("amount_rub", _L), ("crypto_amount", _S), ("crypto_currency", _S), ("plan", _S),
                    ("status", _S), ("tx_hash", _S), ("raw_payload", _S), ("created_at", _L),
                    ("finalized_at", _L)),
    "sessions": _st(("tg_user_id", _L), ("active_agent_id", _S), ("state", _S), ("context_window", _S),
                    ("updated_at", _L)),
    "messages": _st(("id", _L), ("tg_user_id", _L), ("agent_id", _S), ("role", _S), ("content", _S),
                    ("tg_message_id", _L), ("invocation_id", _L), ("created_at", _L)),
    "agent_invocations": _st(("id", _L), ("tg_user_id", _L), ("agent_id", _S), ("model", _S),
                             ("provider", _S), ("input_tokens", _L), ("output_tokens", _L),
                             ("latency_ms", _L), ("status", _S), ("error_message", _S),
                             ("cost_usd_e4", _L), ("created_at", _L)),
    "usage_quota": _st(("tg_user_id", _L), ("agent_id", _S), ("date", _I), ("count", _L),
                       ("last_at", _L)),
}


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Typed parquet scan of ``{sf_dir}/{name}.parquet`` (or a folder of parts)."""
    schema = TEST_SCHEMAS.get(name) or NATIVE_SCHEMAS.get(name)
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path)


class Tables:
    """Lazy accessor: ``Tables(spark, dir).orders`` is a pruned, typed scan."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return load_table(self.spark, self.sf_dir, name)
