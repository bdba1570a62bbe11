"""Per-SKU unit economics, taxes, flags and scenarios.

Money is ``decimal(18,4)`` inside and ``decimal(18,2)`` on output, so sums
are exact.  Tariffs and the scenario list are small fixed tables: tariffs
are broadcast, scenarios are expanded per SKU with ``explode`` (no join).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- fixed values that must equal the reference's --------------------------
OZON_TIER_1_MAX, OZON_TIER_1_RATE = 200, 14   # price <= 200 -> 14 %
OZON_TIER_2_MAX, OZON_TIER_2_RATE = 500, 20   # 200 < price <= 500 -> 20 %
BASELINE_COMMISSION = {"WB": 19, "Ozon": 18}  # category rate missing -> baseline, "to confirm"
ACQUIRING = {"WB": 1.5, "Ozon": 2.0}          # percent of price
USN_LIMIT = 20_000_000                        # simplified-tax turnover limit, RUB/year
VAT_5_MAX, VAT_7_MAX = 250_000_000, 450_000_000
VAT_RATE = 22                                  # percent
VAT_SHARE = "0.18032787"                       # 22/122: VAT inside a VAT-inclusive amount
# -----------------------------------------------------------------------------

D = "decimal(18,4)"
M = "decimal(18,2)"
REGIMES = ["USN6", "USN15", "USN_VAT", "USN15_VAT", "OSNO", "AUSN", "AUSN20"]


def _d(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast(D)


# E2 -------------------------------------------------------------------------
def commission_rate(price: Column, mp: Column, category: Column) -> tuple[Column, Column]:
    """(rate in percent, source): Ozon price tiers override the category rate;
    missing rate -> marketplace baseline marked ``to_confirm``."""
    ozon = mp == "Ozon"
    base = F.when(ozon, F.lit(BASELINE_COMMISSION["Ozon"])).otherwise(F.lit(BASELINE_COMMISSION["WB"]))
    rate = (F.when(ozon & (price <= OZON_TIER_1_MAX), F.lit(OZON_TIER_1_RATE))
            .when(ozon & (price <= OZON_TIER_2_MAX), F.lit(OZON_TIER_2_RATE))
            .otherwise(F.coalesce(category, base)))
    src = (F.when(ozon & (price <= OZON_TIER_1_MAX), "ozon_14")
           .when(ozon & (price <= OZON_TIER_2_MAX), "ozon_20")
           .when(category.isNull(), "baseline_to_confirm").otherwise("category"))
    return _d(rate), src


# E3 -------------------------------------------------------------------------
def cm_waterfall(skus: DataFrame, tariffs: DataFrame, price_factor: Column | None = None,
                 commission_add: Column | None = None, returns_factor: Column | None = None) -> DataFrame:
    """price - commission - acquiring - logistics - storage - returns - cost = CM1;
    CM1 - ad = CM2.  ``tariffs (mp, delivery_model, logistics, storage_l_day,
    turnover_days, return_logistics)`` has one row per (mp, model): broadcast."""
    t = tariffs.select("mp", "delivery_model", *[F.col(c).alias("t_" + c) for c in
                                                  ("logistics", "storage_l_day", "turnover_days", "return_logistics")])
    x = skus.join(F.broadcast(t), ["mp", "delivery_model"], "left")
    price = _d(F.col("price")) if price_factor is None else _d(F.round(_d(F.col("price")) * price_factor, 2))
    rate, src = commission_rate(price, F.col("mp"), F.col("category_commission").cast(D))
    if commission_add is not None:
        rate = rate + commission_add
    acq_rate = F.when(F.col("mp") == "Ozon", F.lit(ACQUIRING["Ozon"])).otherwise(F.lit(ACQUIRING["WB"]))
    ret_share = _d(1) - _d(F.col("buyout_rate"))
    if returns_factor is not None:
        ret_share = F.least(_d(1), ret_share * returns_factor)
    items = {
        "commission": price * _d(rate * _d(0.01)),
        "acquiring": price * _d(_d(acq_rate) * _d(0.01)),
        "logistics": _d(F.col("t_logistics")),
        "storage": _d(F.col("t_storage_l_day")) * _d(F.col("t_turnover_days")) * _d(F.col("volume_l")),
        "returns": _d(F.coalesce(F.col("t_return_logistics"), F.col("t_logistics"))) * ret_share,
        "cost": _d(F.col("_unit_cost")),
    }
    x = x.withColumnRenamed("cost", "_unit_cost")
    out = x.select("*", price.alias("_price"), rate.alias("commission_rate"), src.alias("commission_source"),
                   *[_d(v).alias(k) for k, v in items.items()])
    cm1 = F.col("_price") - sum((F.col(k) for k in items), _d(0))
    out = out.withColumn("cm1", _d(cm1)).withColumn("cm2", _d(F.col("cm1") - _d(F.col("ad_per_unit"))))
    var = _d(F.col("logistics") + F.col("storage") + F.col("returns") + F.col("cost") + _d(F.col("ad_per_unit")))
    share = 1.0 - F.col("commission_rate").cast("double") / 100 - _d(acq_rate).cast("double") / 100
    return (out.withColumn("cm2_pct", F.round(F.col("cm2").cast("double") * 100 / F.col("_price").cast("double"), 2))
            .withColumn("break_even_price", F.when(share > 0, F.round(var.cast("double") / share, 2)))
            .withColumn("price", F.col("_price").cast(M)).drop("_price", "_unit_cost"))


# E4 -------------------------------------------------------------------------
def tax(regime: Column, price: Column, cm2: Column, vat_costs: Column, turnover: Column) -> Column:
    """Tax per unit under ``regime``; negative bases are floored at 0.
    AUSN is 8 % of income; AUSN20 is its 20 % of (income - expenses) variant.
    USN_VAT and USN15_VAT add 5 % VAT (turnover to 250M) or 7 % (to 450M) to
    either variant of the simplified tax; beyond 450M they have no tax (null)."""
    usn6 = price * _d(0.06)
    vat_in = _d((price - vat_costs) * F.lit(VAT_SHARE).cast("decimal(18,8)"))
    vat_extra = F.when(turnover <= VAT_5_MAX, price * _d(0.05)).otherwise(price * _d(0.07))
    osno = F.greatest(_d(0), vat_in) + F.greatest(_d(0), cm2 - F.greatest(_d(0), vat_in)) * _d(0.25)
    vat_extra = F.when(turnover <= VAT_7_MAX, vat_extra)  # above it the special rates end: no such regime
    t = (F.when(regime == "USN15_VAT", F.greatest(_d(0), cm2) * _d(0.15) + vat_extra)
         .when(regime == "USN6", usn6).when(regime == "USN15", F.greatest(_d(0), cm2) * _d(0.15))
         .when(regime == "USN_VAT", usn6 + vat_extra).when(regime == "OSNO", osno)
         .when(regime == "AUSN", price * _d(0.08))
         .when(regime == "AUSN20", F.greatest(_d(0), cm2) * _d(0.20)))
    return _d(t)


def tax_and_net(cm: DataFrame, regime: str | Column, turnover: int | Column) -> DataFrame:
    reg = regime if isinstance(regime, Column) else F.lit(regime)
    to = _d(turnover if isinstance(turnover, Column) else F.lit(turnover))
    vat_costs = F.col("commission") + F.col("acquiring") + F.col("logistics") + F.col("storage") + F.col("returns")
    t = tax(reg, _d(F.col("price")), F.col("cm2"), _d(vat_costs), to)
    return cm.withColumn("tax", t).withColumn("net", _d(F.col("cm2") - F.col("tax")))


def money(df: DataFrame, cols: list[str]) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.round(F.col(c), 2).cast(M))
    return df


# E1 -------------------------------------------------------------------------
def validate_skus(skus: DataFrame, regime: str, turnover: int, segment_at: int = 100) -> DataFrame:
    # batch size as a one-row aggregate attached by constant key (broadcast of one row)
    n = skus.agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", F.lit(1))
    reasons = F.array_compact(F.array(
        F.when(F.col("price") < F.col("cost"), F.lit("price_below_cost")),
        F.when(F.col("cost") < 0, F.lit("negative_cost")),
        F.when(F.lit(regime.startswith("USN") and turnover > USN_LIMIT), F.lit("usn_over_limit")),
        F.when(F.col("category_commission").isNull(), F.lit("missing_commission")),
        F.when(F.col("buyout_rate").isNull(), F.lit("missing_buyout"))))
    x = skus.withColumn("_k", F.lit(1)).join(F.broadcast(n), "_k")
    return x.select("sku", reasons.alias("issues"), (F.col("_n") > segment_at).alias("segment_by_category"))


# E5 -------------------------------------------------------------------------
def margin_flags(net: DataFrame) -> DataFrame:
    pct = F.col("net").cast("double") * 100 / F.col("price").cast("double")
    return net.withColumn("flag", F.when(F.col("net") < 0, "loss").when(pct < 10, "low_margin").otherwise("ok"))


# E6 -------------------------------------------------------------------------
COST_ITEMS = ["commission", "acquiring", "logistics", "storage", "returns", "cost", "ad_per_unit", "tax"]


def loss_leaks(net: DataFrame) -> DataFrame:
    loss = net.where(F.col("net") < 0)
    cols = ", ".join(f"'{c}', cast({c} as {D})" for c in COST_ITEMS)
    long = loss.selectExpr("sku", f"stack({len(COST_ITEMS)}, {cols}) as (item, amount)")
    w = Window.partitionBy("sku").orderBy(F.desc("amount"), "item")
    return long.withColumn("rank", F.row_number().over(w)).withColumn("amount", F.round("amount", 2).cast(M))


# E7 / E8 --------------------------------------------------------------------
def top_profit(net: DataFrame, k: int = 5) -> DataFrame:
    return net.orderBy(F.desc("net"), "sku").limit(k).select("sku", F.round("net", 2).cast(M).alias("net"))


def batch_summary(net: DataFrame) -> DataFrame:
    return net.agg(F.round(F.sum("net"), 2).cast(M).alias("total_net"),
                   F.round(F.avg("cm2_pct"), 2).alias("mean_cm2_pct"),
                   F.round(F.count(F.when(F.col("net") < 0, 1)) / F.count(F.lit(1)), 4).alias("loss_share"))


# E9 -------------------------------------------------------------------------
SCENARIOS = [("base", 1.0, 0.0, 1.0), ("price_minus_10", 0.9, 0.0, 1.0), ("commission_plus_5", 1.0, 5.0, 1.0),
             ("returns_plus_20", 1.0, 0.0, 1.2)]


def sensitivity(skus: DataFrame, tariffs: DataFrame, regime: str, turnover: int) -> DataFrame:
    """Batch net profit per scenario; the waterfall (and Ozon price tiers) is
    recomputed under each scenario's inputs."""
    sc = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(p).alias("pf"), F.lit(c).alias("ca"),
                            F.lit(r).alias("rf")) for n, p, c, r in SCENARIOS])
    x = skus.withColumn("_s", F.explode(sc)).select("*", "_s.*").drop("_s")
    cm = cm_waterfall(x, tariffs, price_factor=_d(F.col("pf")), commission_add=_d(F.col("ca")),
                      returns_factor=_d(F.col("rf")))
    net = tax_and_net(cm, regime, turnover)
    return net.groupBy("scenario").agg(F.round(F.sum("net"), 2).cast(M).alias("total_net"))


# E10 ------------------------------------------------------------------------
def regime_compare(cm: DataFrame, turnover: int, k: int = 5, near: float = 0.8) -> DataFrame:
    """Net profit of the top-k SKUs (by USN6 net) under every regime, side by
    side, with the risk mark when turnover approaches the USN limit."""
    top = tax_and_net(cm, "USN6", turnover).orderBy(F.desc("net"), "sku").limit(k).select("sku")
    x = cm.join(top, "sku", "left_semi")  # k SKUs only meet the six regimes
    x = x.withColumn("regime", F.explode(F.array(*[F.lit(r) for r in REGIMES])))
    net = tax_and_net(x, F.col("regime"), turnover)
    p = (net.groupBy("sku").pivot("regime", REGIMES)
         .agg(F.first(F.round("net", 2).cast(M))))
    return p.withColumn("usn_limit_risk", F.lit(turnover >= near * USN_LIMIT))
