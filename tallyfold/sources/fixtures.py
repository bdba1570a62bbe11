"""Fixture views over the driver test tables (FIXTURES.md §2), built in Spark.

They give the application-shaped inputs (users, payments, subscriptions,
invocations, ...) a deterministic derivation from the TPC-H-style parquet, so
every operator runs over the whole given tables and has a DuckDB twin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import epoch_s
from .tables import Tables

AS_OF = 801964800  # 1995-06-01 00:00:00 UTC


class Fixtures:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.t = Tables(spark, sf_dir)

    # -- fx_users --------------------------------------------------------------
    def users(self) -> DataFrame:
        c, o = self.t.customer, self.t.orders
        # aggregate orders per customer first (partial agg before the shuffle),
        # then join the customer dimension on its key
        per_cust = o.groupBy(F.col("o_custkey").alias("tg_user_id")).agg(
            F.min("o_orderdate").alias("_first"), F.max("o_orderdate").alias("_last"))
        return (per_cust.join(c.select(F.col("c_custkey").alias("tg_user_id"), F.col("c_name").alias("first_name")),
                              "tg_user_id")
                .select("tg_user_id", "first_name",
                        epoch_s("_first").alias("registered_at"),
                        epoch_s("_last").alias("last_order_at"),
                        F.when(F.col("tg_user_id") % 29 == 0, 1).otherwise(0).alias("is_banned"),
                        F.when(F.col("tg_user_id") % 31 == 0, 1).otherwise(0).alias("is_deleted")))

    def users_active(self, as_of: int = AS_OF) -> DataFrame:
        """fx_users with ``last_seen_at`` = last invocation at or before ``as_of``."""
        seen = (self.invocations().where(F.col("created_at") <= as_of)
                .groupBy("tg_user_id").agg(F.max("created_at").alias("last_seen_at")))
        return self.users().join(seen, "tg_user_id", "left")

    # -- fx_payments -----------------------------------------------------------
    def payments(self) -> DataFrame:
        o = self.t.orders
        k = F.col("o_orderkey")
        created = epoch_s("o_orderdate")
        return o.select(
            k.alias("id"),
            F.col("o_custkey").alias("tg_user_id"),
            F.when(k % 10 == 0, "admin_manual").when(k % 3 == 0, "cryptocloud")
             .otherwise("nowpayments").alias("provider"),
            F.floor("o_totalprice").cast("long").alias("amount_rub"),
            F.when(F.substring("o_orderpriority", 1, 1) == "1", "business")
             .when(F.substring("o_orderpriority", 1, 1) == "2", "pro").otherwise("starter").alias("plan"),
            F.when(F.col("o_orderstatus") == "F", "paid").when(F.col("o_orderstatus") == "O", "pending")
             .when(k % 3 == 0, "failed").when(k % 3 == 1, "expired").otherwise("refunded").alias("status"),
            created.alias("created_at"),
            F.when(F.col("o_orderstatus") != "O", created + (k % 48) * 3600).alias("finalized_at"),
        )

    # -- fx_subscriptions (raw intervals, input of B4) -------------------------
    def subscriptions(self) -> DataFrame:
        p = self.payments().where(F.col("status") == "paid")
        paid = p.select(
            F.col("id").alias("payment_id"), "tg_user_id", "plan", F.lit(1).alias("is_active"),
            F.col("finalized_at").alias("started_at"),
            (F.col("finalized_at") + 30 * 86400).alias("expires_at"),
            F.lit("webhook").alias("source"), F.col("finalized_at").alias("created_at"))
        trial = self.users().select(
            F.lit(None).cast("long").alias("payment_id"), "tg_user_id", F.lit("free_trial").alias("plan"),
            F.lit(1).alias("is_active"), F.col("registered_at").alias("started_at"),
            (F.col("registered_at") + 7 * 86400).alias("expires_at"),
            F.lit("trial_auto").alias("source"), F.col("registered_at").alias("created_at"))
        return paid.unionByName(trial)

    def subscriptions_as_of(self, as_of: int = AS_OF) -> DataFrame:
        """Raw intervals that exist at ``as_of`` (created at or before it)."""
        return self.subscriptions().where(F.col("started_at") <= as_of)

    # -- fx_invocations --------------------------------------------------------
    def invocations(self) -> DataFrame:
        li = self.t.lineitem
        o = self.t.orders.select("o_orderkey", "o_custkey")
        ln, sk = F.col("l_linenumber"), F.col("l_suppkey")
        flag = F.concat("l_returnflag", "l_linestatus")
        return li.join(o, li.l_orderkey == o.o_orderkey).select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            F.col("o_custkey").alias("tg_user_id"),
            F.when(ln % 5 == 0, "mp_card_doctor").when(ln % 5 == 1, "mp_review_responder")
             .when(ln % 5 == 2, "mp_competitor_scout").when(ln % 5 == 3, "mp_abc_xyz_analyst")
             .otherwise("mp_unit_economics").alias("agent_id"),
            F.when(sk % 3 == 0, "groq").when(sk % 3 == 1, "openrouter").otherwise("yandex").alias("provider"),
            F.when(sk % 3 == 0, "llama-3.3-70b-versatile").when(sk % 3 == 1, "qwen/qwen3.6-plus")
             .otherwise("yandexgpt/latest").alias("model"),
            (F.col("l_quantity").cast("long") * 400).alias("input_tokens"),
            (F.col("l_quantity").cast("long") * 150).alias("output_tokens"),
            (F.floor("l_extendedprice").cast("long") % 30000).alias("latency_ms"),
            F.when(flag == "AF", "timeout").when(flag == "AO", "rate_limit").when(flag == "RF", "api_error")
             .when(flag == "RO", "retried_ok").otherwise("success").alias("status"),
            (epoch_s("l_shipdate") + F.col("l_partkey") % 86400).alias("created_at"),
        )

    # -- fx_requests (A1–A6, T2, T3) -------------------------------------------
    def requests(self) -> DataFrame:
        u = F.col("user_id")
        return self.t.events.select(
            F.col("event_id").alias("request_id"), u.alias("tg_user_id"),
            F.col("event_type").alias("agent_id"), epoch_s("ts").alias("ts"),
            F.when(u % 4 == 0, "free_trial").when(u % 4 == 1, "starter").when(u % 4 == 2, "pro")
             .otherwise("business").alias("plan"))

    def request_limits(self) -> DataFrame:
        """Fixture limits: flood 1 free / 3 paid per burst, free day 2, agent day 1."""
        return self.spark.createDataFrame(REQUEST_LIMITS,
                                          "plan string, flood_limit int, day_limit int, agent_limit int")


    def callbacks(self, deliveries: tuple[int, ...] = (0, 1)) -> DataFrame:
        """fx_callbacks: two provider callbacks per non-manual payment; one
        delivery alone holds the first or the second of each."""
        p = self.payments().where(F.col("provider") != "admin_manual").select("id", "provider", "created_at")
        k = F.col("id")
        # the signer is Python: spread it over all cores even when the source is one small file
        p = p.repartition(self.spark.sparkContext.defaultParallelism)
        x = p.withColumn("e", F.explode(F.array(*map(F.lit, deliveries))))  # two callbacks per payment
        oid = (F.when((k % 23 == 0) & (F.col("e") == 1), F.lit("abc"))
               .when((k % 29 == 0) & (F.col("e") == 0), (k + 1000000000).cast("string"))
               .otherwise(k.cast("string")))
        idx = k * (F.col("e") + 3) + F.col("e")
        a_body = F.format_string('{"payment_status":"%s","order_id":"%s","payin_hash":"0x%x"}',
                                 _pick(RAW_STATUS_A, idx), oid, k)
        b_body = F.format_string('{"status":"%s","order_id":"%s","invoice_id":"INV-%d"}',
                                 _pick(RAW_STATUS_B, idx), oid, k)
        # every 31st second callback of provider B is truncated (malformed JSON)
        b_body = F.when((k % 31 == 0) & (F.col("e") == 1), F.regexp_replace(b_body, r"\}$", "")).otherwise(b_body)
        x = x.select((k * 2 + F.col("e")).alias("event_id"), "provider",
                     F.when(F.col("provider") == "nowpayments", a_body).otherwise(b_body).alias("body"),
                     (F.col("created_at") + 600 + F.col("e") * 3600).alias("received_at"), k.alias("k"))
        return x.mapInArrow(_sign_bodies, "event_id long, provider string, body string, received_at long, "
                                          "signature string")

    def provider_snapshot(self) -> DataFrame:
        """fx_provider_snapshot: what each provider reports for pending payments."""
        p = self.payments().where((F.col("status") == "pending") & (F.col("provider") != "admin_manual"))
        k = F.col("id")
        return p.select("id", "provider",
                        F.when(F.col("provider") == "nowpayments", _pick(SNAPSHOT_A, k))
                        .otherwise(_pick(SNAPSHOT_B, k)).alias("remote_status"))

    def attempts(self) -> DataFrame:
        """fx_attempts: three provider attempts per request (event)."""
        ev = self.t.events.select(F.col("event_id").alias("request_id"))
        x = ev.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(2))))  # three attempts per request
        k, rk = F.col("request_id"), F.col("rank")
        ok = (k + rk * 3) % 5 == 0
        st = _pick(ATTEMPT_FAIL_STATUS, k * (rk + 1))
        return x.select("request_id", "rank", _pick(ATTEMPT_PROVIDERS, rk).alias("provider"), ok.alias("ok"),
                        F.when(~ok, st).cast("int").alias("http_status"),
                        F.when(ok, F.lit(None).cast("string")).when(st.isNull(), F.lit("request timeout"))
                        .otherwise(F.format_string("http %d", st)).alias("error"))

    def updates(self) -> DataFrame:
        """fx_updates: chat updates as raw JSON strings ``(raw)``."""
        e = self.t.events
        k, u, t = F.col("event_id"), F.col("user_id"), epoch_s("ts")
        typ = F.col("event_type")
        text = (F.when(typ == "signup", F.format_string("/start ref_%d", (k * 7) % 151))
                .when(typ == "purchase", F.lit("/pay")).when(typ == "view", F.lit("/me"))
                .when(typ == "click", F.when(k % 2 == 0, F.lit("/cancel")).otherwise(F.lit("/menu")))
                .otherwise(F.when(k % 5 == 0, F.lit("/admin stats"))
                           .when(k % 10 == 1, F.concat_ws(" ", F.lit("/admin activate"), ((k * 3) % 150).cast("string"),
                                                          _pick(ADMIN_PLANS, k), F.when(k % 3 != 0, (7 * (k % 5 + 1)).cast("string"))))
                           .when(k % 10 == 6, F.format_string("/admin %s %d", F.when(k % 20 == 6, F.lit("ban")).otherwise(F.lit("unban")),
                                                              (k * 11) % 150))
                           .otherwise(F.format_string("how do I price sku %d", k))))
        sender = F.struct(u.alias("id"), F.format_string("User%d", u).alias("first_name"),
                          F.when(u % 3 != 0, F.format_string("u%d", u)).alias("username"),
                          F.element_at(F.array(F.lit("ru"), F.lit("en")), (u % 2).cast("int") + 1).alias("language_code"))
        chat = F.struct(u.alias("id"), F.lit("private").alias("type"))
        msg = F.struct(k.alias("message_id"), F.when(k % 89 != 0, sender).alias("from"), chat.alias("chat"),
                       t.alias("date"), text.alias("text"))
        cbq = F.struct(F.format_string("cb%d", k).alias("id"), sender.alias("from"),
                       F.struct(k.alias("message_id"), chat.alias("chat"), t.alias("date")).alias("message"),
                       F.concat(F.lit("agent:"), _pick(CALLBACK_AGENTS, k)).alias("data"))
        body = F.when(k % 7 == 0, F.to_json(F.struct(k.alias("update_id"), cbq.alias("callback_query")))) \
            .otherwise(F.to_json(F.struct(k.alias("update_id"), msg.alias("message"))))
        raw = F.when(k % 97 == 0, F.format_string('{"update_id": %d, "message": {', k)).otherwise(body)
        # every 50th update is delivered twice (at-least-once webhook delivery)
        return (e.select(raw.alias("raw"), k.alias("_k"))
                .withColumn("_copy", F.explode(F.sequence(F.lit(0), F.when(F.col("_k") % 50 == 0, 1).otherwise(0))))
                .select("raw"))

    def sku_sales(self, grain: str = "part", period: str = "month") -> DataFrame:
        """fx_sku_sales: line revenue in kopecks by SKU grain and period.

        grain: part (l_partkey) | supplier (l_suppkey) | brand (p_brand);
        period: month (yyyymm) | quarter (yyyyq) | year (yyyy)."""
        li, p = self.t.lineitem, self.t.part
        x = li.join(p, li.l_partkey == p.p_partkey)
        sku = {"part": F.col("l_partkey").cast("string"), "supplier": F.col("l_suppkey").cast("string"),
               "brand": F.col("p_brand")}[grain]
        d = F.col("l_shipdate")
        per = {"month": F.year(d) * 100 + F.month(d), "quarter": F.year(d) * 10 + F.quarter(d),
               "year": F.year(d)}[period]
        return x.select(sku.alias("sku"), F.col("p_type").alias("category"), per.cast("int").alias("period"),
                        F.round(F.col("l_extendedprice") * 100).cast("long").alias("revenue"))

    def sku_economics(self) -> DataFrame:
        p = self.t.part
        k = F.col("p_partkey")
        dd = "decimal(18,4)"
        price = F.round(F.col("p_retailprice").cast(dd) * F.col("p_size") * F.lit(0.02).cast(dd), 2).cast("decimal(18,2)")
        return p.select(
            k.cast("string").alias("sku"), F.col("p_name").alias("name"), F.col("p_type").alias("category"),
            price.alias("price"),
            F.round(price * _pick(COST_FACTORS, k).cast(dd), 2).cast("decimal(18,2)").alias("cost"),
            F.when(k % 2 == 0, "WB").otherwise("Ozon").alias("mp"),
            F.when(k % 7 == 0, F.lit(None)).otherwise(10 + k % 15).cast("decimal(18,4)").alias("category_commission"),
            F.when(k % 3 == 0, "FBS").otherwise("FBO").alias("delivery_model"),
            (F.lit(0.5) + (k % 10).cast("double") * 0.05).cast("decimal(18,4)").alias("buyout_rate"),
            ((k % 4) * 10).cast("decimal(18,2)").alias("ad_per_unit"),
            (F.col("p_size") / 10.0).cast("decimal(18,4)").alias("volume_l"))

    def tariffs(self) -> DataFrame:
        return self.spark.createDataFrame(
            TARIFFS, "mp string, delivery_model string, logistics double, storage_l_day double, "
                     "turnover_days int, return_logistics double")

    def logs(self) -> DataFrame:
        """fx_logs: events as JSON log lines carrying personal keys to strip."""
        e = self.t.events
        k, u = F.col("event_id"), F.col("user_id")
        level = (F.when(k % 4 == 1, F.lit("warn")).when(k % 4 == 2, F.lit("error"))
                 .when(k % 4 == 3, F.lit("info")))
        line = F.to_json(F.struct(
            (epoch_s("ts") * 1000).alias("ts"), level.alias("level"), F.col("event_type").alias("event"),
            u.alias("user_id"), F.lit("mp_card_doctor").alias("agent_id"), (k % 1000).alias("latency_ms"),
            F.format_string("u%d", u).alias("username"), F.format_string("User%d", u).alias("first_name"),
            F.format_string("private text %d", k).alias("text")))
        return e.select(F.when(k % 50 == 7, F.lit("not a json line")).otherwise(line).alias("line"))

    def responses(self) -> DataFrame:
        """fx_responses: events.props wrapped in the three provider response shapes."""
        e = self.t.events
        k = F.col("event_id")
        n = F.regexp_extract("props", r"(\d+)", 1).cast("long")
        content = F.format_string("answer %d", n)
        choices = F.when(k % 13 == 0, F.array().cast("array<struct<message:struct<content:string>>>")) \
            .otherwise(F.array(F.struct(F.struct(content.alias("content")).alias("message"))))
        usage = F.when(k % 11 != 0, F.struct((n * 10).alias("prompt_tokens"), (n * 3).alias("completion_tokens")))
        groq = F.to_json(F.struct(choices.alias("choices"), usage.alias("usage")))
        orr = F.to_json(F.struct(F.when(k % 2 == 0, F.lit("qwen/qwen-2.5-72b-instruct")).alias("model"),
                                 choices.alias("choices"), usage.alias("usage")))
        alts = F.when(k % 13 == 0, F.array().cast("array<struct<message:struct<role:string,text:string>>>")) \
            .otherwise(F.array(F.struct(F.struct(F.lit("assistant").alias("role"), content.alias("text")).alias("message"))))
        yusage = F.struct(F.when(k % 11 == 0, F.lit("abc")).otherwise((n * 10).cast("string")).alias("inputTextTokens"),
                          (n * 3).cast("string").alias("completionTokens"))
        yandex = F.to_json(F.struct(F.struct(alts.alias("alternatives"), yusage.alias("usage")).alias("result")))
        prov = F.when(k % 3 == 0, "groq").when(k % 3 == 1, "openrouter").otherwise("yandex")
        body = F.when(k % 17 == 0, F.lit("<html>upstream error</html>")) \
            .otherwise(F.when(k % 3 == 0, groq).when(k % 3 == 1, orr).otherwise(yandex))
        return e.select(k.alias("request_id"), prov.alias("provider"), body.alias("body"))


REQUEST_GAP_S = 6 * 3600
# fixture limits per plan: (plan, flood per burst, free day cap, per-agent daily quota)
REQUEST_LIMITS = [("free_trial", 1, 2, 1), ("starter", 3, None, 1), ("pro", 3, None, 1), ("business", 3, None, 1)]


# ---- fixed fixture values (payment callbacks, provider snapshots, attempts) ----
TEST_SECRET_A = "fixture-secret-provider-a"
TEST_SECRET_B = "fixture-secret-provider-b"
RAW_STATUS_A = ["waiting", "finished", "confirmed", "failed", "expired", "refunded", "partially_paid"]
RAW_STATUS_B = ["created", "success", "paid", "fail", "expired", "cancel", "pending"]
SNAPSHOT_A = ["waiting", "finished", "confirmed", "failed"]
SNAPSHOT_B = ["created", "paid", "success", "cancel"]
ATTEMPT_PROVIDERS = ["groq", "openrouter", "yandex"]
ATTEMPT_FAIL_STATUS = [429, 500, 400, 503, None]  # None = aborted by timeout


def _pick(values: list, idx) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx % len(values)).cast("int") + 1)


def _sign_bodies(it):
    """Sign fixture bodies with Python's hmac module (independent of the
    Catalyst implementation the parser uses)."""
    import base64
    import hmac
    import json

    import pyarrow as pa

    canonical = json.JSONEncoder(sort_keys=True, separators=(",", ":")).encode
    key_a, key_b = TEST_SECRET_A.encode(), TEST_SECRET_B.encode()
    for batch in it:
        sigs = []
        for prov, body, k in zip(*(batch.column(c).to_pylist() for c in ("provider", "body", "k"))):
            if k is not None and k % 17 == 0:
                s = "deadbeef"
            elif prov == "nowpayments":
                try:
                    canon = canonical(json.loads(body))
                except ValueError:
                    canon = body
                s = hmac.digest(key_a, canon.encode(), "sha512").hex()
            else:
                s = base64.b64encode(hmac.digest(key_b, body.encode(), "sha256")).decode()
            sigs.append(s)
        kept = "event_id", "provider", "body", "received_at"
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sigs, pa.string())], [*kept, "signature"])


# ---- fixed fixture values (chat updates) --------------------------------------
ADMIN_IDS = list(range(0, 150, 10))  # fixture administrators: user ids divisible by 10
ADMIN_PLANS = ["starter", "pro", "business", "free_trial", "gold"]  # "gold" is not a plan: rejected
CALLBACK_AGENTS = ["mp_card_doctor", "mp_review_responder", "mp_competitor_scout", "mp_abc_xyz_analyst",
                   "mp_unit_economics", "unknown_bot"]


YEARS = list(range(1992, 1999))
QUARTERS = [y * 10 + q for y in YEARS for q in range(1, 5)]


# ---- fixed fixture values (unit economics) -------------------------------------
COST_FACTORS = [0.3, 0.4, 0.5, 0.6, 1.1]
# (mp, delivery model, logistics RUB, storage RUB per litre-day, turnover days, return logistics RUB)
TARIFFS = [("WB", "FBO", 50.0, 0.08, 30, 50.0), ("WB", "FBS", 60.0, 0.0, 0, 60.0),
           ("Ozon", "FBO", 45.0, 0.07, 30, 45.0), ("Ozon", "FBS", 55.0, 0.0, 0, 55.0)]
ECON_REGIME, ECON_TURNOVER = "USN6", 18_000_000


# ---- fixture logs and provider responses ------------------------------------------
