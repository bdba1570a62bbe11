"""Small, fixed reference tables.

Each is a handful of rows with a size fixed by the code below, so it is safe
to ``broadcast()`` it into any join regardless of the fact-table size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---- fixed values that must equal the reference's --------------------------
# plan -> (daily quota per agent, price in RUB, duration in days)
PLAN_CONFIG = [
    ("free_trial", 5, 0, 7),
    ("starter", 50, 1500, 30),
    ("pro", 200, 3500, 30),
    ("business", 1000, 7900, 30),
]
# the five agent ids, in their listed order
AGENTS = [
    "mp_card_doctor",
    "mp_review_responder",
    "mp_competitor_scout",
    "mp_abc_xyz_analyst",
    "mp_unit_economics",
]
# free tier: 1 request per minute, 20 per day in total; paid: 30 per minute
FREE_PER_MIN = 1
FREE_PER_DAY = 20
PAID_FLOOD_PER_MIN = 30
FLOOD_GAP_S = 60
# (provider, model) -> USD per million tokens in, out
LLM_RATES = [
    ("groq", "llama-3.3-70b-versatile", 0.59, 0.79),
    ("groq", "qwen-2.5-72b", 0.59, 0.79),
    ("openrouter", "qwen/qwen3.6-plus", 0.9, 1.8),
    ("openrouter", "qwen/qwen-2.5-72b-instruct", 0.8, 1.2),
    ("yandex", "yandexgpt/latest", 0.4, 1.2),
]
RETRYABLE_STATUS = [408, 425, 429, 500, 502, 503, 504]
# raw provider status -> normalised payment status
PAYMENT_STATUS_MAP = [
    ("nowpayments", "finished", "paid"),
    ("nowpayments", "confirmed", "paid"),
    ("nowpayments", "failed", "failed"),
    ("nowpayments", "expired", "expired"),
    ("nowpayments", "refunded", "refunded"),
    ("cryptocloud", "success", "paid"),
    ("cryptocloud", "paid", "paid"),
    ("cryptocloud", "expired", "expired"),
    ("cryptocloud", "fail", "failed"),
    ("cryptocloud", "cancel", "failed"),
]
# ABC/XYZ class -> recommendation code (short English codes, not prompt prose)
ABC_XYZ_POLICY = [
    ("AX", "protect_core"),
    ("AY", "stock_for_peak"),
    ("AZ", "check_volatility"),
    ("BX", "grow_to_a"),
    ("BY", "hold_level"),
    ("BZ", "spot_work_no_scale"),
    ("CX", "keep_for_width"),
    ("CY", "optimize"),
    ("CZ", "exit_candidate"),
]
DEFAULT_SYSTEM_PROMPT = "You are a helpful WB/Ozon seller assistant. Answer concisely in Russian."
# -----------------------------------------------------------------------------


def plan_config(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        PLAN_CONFIG, "plan string, daily_quota_per_agent int, price_rub int, duration_days int")


def agents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, i) for i, a in enumerate(AGENTS)], "agent_id string, agent_rank int")


def llm_rates(spark: SparkSession) -> DataFrame:
    # rates stored as integer hundredths of a USD per million tokens so the
    # cost formula stays in exact integer arithmetic
    rows = [(p, m, int(round(i * 100)), int(round(o * 100))) for p, m, i, o in LLM_RATES]
    return spark.createDataFrame(rows, "provider string, model string, r_in long, r_out long")


def payment_status_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PAYMENT_STATUS_MAP, "provider string, raw_status string, status string")


def abc_xyz_policy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ABC_XYZ_POLICY, "abc_xyz string, recommendation string")
