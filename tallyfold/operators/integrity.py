"""S2 — constraint report: violation counts per table and rule.

Row-local rules (NOT NULL, CHECK enums) are fused into one conditional
aggregate per table; key rules are grouped counts; foreign keys are
``left_anti`` joins on the key (Catalyst picks the join strategy).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- fixed values: CHECK enumerations of the schema ----------------------------
PLANS = ["free_trial", "starter", "pro", "business"]
PAID_PLANS = ["starter", "pro", "business"]
PROVIDERS = ["nowpayments", "cryptocloud", "admin_manual"]
PAYMENT_STATUS = ["pending", "paid", "failed", "expired", "refunded"]
SESSION_STATE = ["idle", "awaiting_input", "processing", "error"]
MESSAGE_ROLE = ["user", "assistant", "system"]
INVOCATION_STATUS = ["success", "timeout", "rate_limit", "api_error", "retried_ok"]
# -------------------------------------------------------------------------------


@dataclass
class TableRules:
    name: str
    df: DataFrame
    not_null: list[str] = field(default_factory=list)
    enums: dict[str, list[str]] = field(default_factory=dict)
    keys: list[list[str]] = field(default_factory=list)          # PK / unique: duplicates beyond the first
    unique_not_null: list[list[str]] = field(default_factory=list)  # partial unique (rows with non-null key)
    fks: list[tuple[str, DataFrame, str]] = field(default_factory=list)
    one_active_per: str | None = None                          # at most one is_active = 1 row per key


def constraint_report(tables: list[TableRules]) -> DataFrame:
    parts: list[DataFrame] = []
    for t in tables:
        aggs = [F.count(F.when(F.col(c).isNull(), 1)).alias(f"not_null:{c}") for c in t.not_null]
        aggs += [F.count(F.when(F.col(c).isNotNull() & ~F.col(c).isin(*vals), 1)).alias(f"check:{c}")
                 for c, vals in t.enums.items()]
        if aggs:
            wide = t.df.agg(*aggs)
            cols = [a for a in wide.columns]
            stack = ", ".join(f"'{c}', `{c}`" for c in cols)
            parts.append(wide.selectExpr(f"'{t.name}' as table_name",
                                         f"stack({len(cols)}, {stack}) as (rule, violations)"))
        for key in t.keys + t.unique_not_null:
            d = t.df
            if key in t.unique_not_null:
                for c in key:
                    d = d.where(F.col(c).isNotNull())
            dup = (d.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
                   .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("violations")))
            parts.append(dup.select(F.lit(t.name).alias("table_name"),
                                    F.lit("unique:" + ",".join(key)).alias("rule"), "violations"))
        for col, parent, pcol in t.fks:
            orphans = (t.df.where(F.col(col).isNotNull()).select(F.col(col).alias("_k"))
                       .join(parent.select(F.col(pcol).alias("_k")), "_k", "left_anti")
                       .agg(F.count(F.lit(1)).alias("violations")))
            parts.append(orphans.select(F.lit(t.name).alias("table_name"), F.lit(f"fk:{col}").alias("rule"),
                                        "violations"))
        if t.one_active_per:
            k = t.one_active_per
            multi = (t.df.where(F.col("is_active") == 1).groupBy(k).agg(F.count(F.lit(1)).alias("_n"))
                     .where(F.col("_n") > 1).agg(F.count(F.lit(1)).alias("violations")))
            parts.append(multi.select(F.lit(t.name).alias("table_name"),
                                      F.lit(f"one_active_per:{k}").alias("rule"), "violations"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("violations", F.col("violations").cast("long"))
