"""Registered queries: unit economics (E*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import unit_econ as U
from ..sources.fixtures import COST_FACTORS, ECON_REGIME, ECON_TURNOVER, TARIFFS, Fixtures
from .registry import query

D = "decimal(18,4)"
M = "decimal(18,2)"
_COST_SQL = "[" + ", ".join(f"{c}::{D}" for c in COST_FACTORS) + "]"
_TARIFF_SQL = ", ".join(f"('{a}', '{b}', {c}, {e}, {f}, {g})" for a, b, c, e, f, g in TARIFFS)

SKUS = f"""
skus as (select cast(p_partkey as varchar) sku, p_type category,
                round(p_retailprice::{D} * p_size * 0.02::{D}, 2)::{M} price,
                round(round(p_retailprice::{D} * p_size * 0.02::{D}, 2)::{M} * {_COST_SQL}[p_partkey % 5 + 1], 2)::{M} cost,
                case when p_partkey % 2 = 0 then 'WB' else 'Ozon' end mp,
                case when p_partkey % 7 = 0 then null else 10 + p_partkey % 15 end::{D} category_commission,
                case when p_partkey % 3 = 0 then 'FBS' else 'FBO' end delivery_model,
                (0.5 + (p_partkey % 10) * 0.05)::{D} buyout_rate,
                ((p_partkey % 4) * 10)::{M} ad_per_unit, (p_size / 10.0)::{D} volume_l
         from part),
tariffs as (select * from (values {_TARIFF_SQL})
            t(mp, delivery_model, logistics, storage_l_day, turnover_days, return_logistics))"""


def waterfall_sql(name: str, pf: float = 1.0, ca: float = 0.0, rf: float = 1.0) -> str:
    price = "s.price::{D}" if pf == 1.0 else f"round(s.price::{D} * {pf}::{D}, 2)::{D}"
    price = price.format(D=D)
    rate_base = (f"case when s.mp = 'Ozon' and {price} <= 200 then 14 when s.mp = 'Ozon' and {price} <= 500 then 20 "
                 f"else coalesce(s.category_commission, case when s.mp = 'Ozon' then 18 else 19 end) end::{D}")
    rate = rate_base if ca == 0.0 else f"({rate_base} + {ca}::{D})"
    ret_share = f"(1::{D} - s.buyout_rate::{D})" if rf == 1.0 else f"least(1::{D}, (1::{D} - s.buyout_rate::{D}) * {rf}::{D})"
    return f"""
{name} as (
  select *, (price - (commission + acquiring + logistics + storage + returns + cost))::{D} cm1,
         ((price - (commission + acquiring + logistics + storage + returns + cost))::{D} - ad_per_unit::{D})::{D} cm2
  from (select s.sku, s.mp, s.ad_per_unit, {price} price, {rate} commission_rate,
               case when s.mp = 'Ozon' and {price} <= 200 then 'ozon_14' when s.mp = 'Ozon' and {price} <= 500 then 'ozon_20'
                    when s.category_commission is null then 'baseline_to_confirm' else 'category' end commission_source,
               case when s.mp = 'Ozon' then 2.0 else 1.5 end acq_rate,
               ({price} * ({rate} * 0.01::{D})::{D})::{D} commission,
               ({price} * ((case when s.mp = 'Ozon' then 2.0 else 1.5 end)::{D} * 0.01::{D})::{D})::{D} acquiring,
               t.logistics::{D} logistics,
               (t.storage_l_day::{D} * t.turnover_days::{D} * s.volume_l::{D})::{D} storage,
               (coalesce(t.return_logistics, t.logistics)::{D} * {ret_share})::{D} returns,
               s.cost::{D} cost
        from skus s left join tariffs t on t.mp = s.mp and t.delivery_model = s.delivery_model))"""


def net_sql(src: str) -> str:
    return f"""select *, (price * 0.06::{D})::{D} tax, (cm2 - (price * 0.06::{D})::{D})::{D} net from {src}"""


def cm(spark, d):
    fx = Fixtures(spark, d)
    return U.cm_waterfall(fx.sku_economics(), fx.tariffs())


def net(spark, d):
    return U.tax_and_net(cm(spark, d), ECON_REGIME, ECON_TURNOVER)


@query("e2_commission_rate", "with " + SKUS + "," + waterfall_sql("w") + """
select mp, commission_source, count(*) skus from w group by 1, 2""")
def e2(spark, d):
    return cm(spark, d).groupBy("mp", "commission_source").agg(F.count(F.lit(1)).alias("skus"))


@query("e3_cm_waterfall", "with " + SKUS + "," + waterfall_sql("w") + f"""
select sku, price::{M} price, commission_rate, round(cm1, 2)::{M} cm1, round(cm2, 2)::{M} cm2,
       round(cm2::double * 100 / price::double, 2) cm2_pct,
       case when 1.0 - commission_rate::double / 100 - acq_rate::double / 100 > 0
            then round((logistics + storage + returns + cost + ad_per_unit::{D})::{D}::double
                       / (1.0 - commission_rate::double / 100 - acq_rate::double / 100), 2) end break_even_price
from w""")
def e3(spark, d):
    c = U.money(cm(spark, d), ["cm1", "cm2"])
    return c.select("sku", "price", "commission_rate", "cm1", "cm2", "cm2_pct", "break_even_price")


@query("e4_tax_and_net", "with " + SKUS + "," + waterfall_sql("w") + f", n as ({net_sql('w')})" + f"""
select sku, round(tax, 2)::{M} tax, round(net, 2)::{M} net from n""")
def e4(spark, d):
    return U.money(net(spark, d), ["tax", "net"]).select("sku", "tax", "net")


@query("e5_margin_flags", "with " + SKUS + "," + waterfall_sql("w") + f", n as ({net_sql('w')})" + """
select sku, case when net < 0 then 'loss' when net::double * 100 / price::double < 10 then 'low_margin'
                 else 'ok' end flag from n""")
def e5(spark, d):
    return U.margin_flags(net(spark, d)).select("sku", "flag")


@query("e6_loss_leaks", "with " + SKUS + "," + waterfall_sql("w") + f", n as ({net_sql('w')})" + f"""
, l as (select sku, item, amount from n
        unpivot (amount for item in (commission, acquiring, logistics, storage, returns, cost,
                                     ad_per_unit, tax))
        where net < 0)
select sku, item, round(amount::{D}, 2)::{M} amount,
       cast(row_number() over (partition by sku order by amount::{D} desc, item) as integer) rank
from l""")
def e6(spark, d):
    return U.loss_leaks(net(spark, d))


@query("e7_top_profit", "with " + SKUS + "," + waterfall_sql("w") + f", n as ({net_sql('w')})" + f"""
select sku, round(net, 2)::{M} net from n order by net desc, sku limit 5""")
def e7(spark, d):
    return U.top_profit(net(spark, d))


@query("e8_batch_summary", "with " + SKUS + "," + waterfall_sql("w") + f", n as ({net_sql('w')})" + f"""
select round(sum(net), 2)::{M} total_net, round(avg(round(cm2::double * 100 / price::double, 2)), 2) mean_cm2_pct,
       round(count(*) filter (where net < 0) / count(*), 4) loss_share from n""")
def e8(spark, d):
    return U.batch_summary(net(spark, d))


@query("e9_sensitivity", "with " + SKUS + "," + ",".join(
    waterfall_sql(f"w_{n}", pf, ca, rf) for n, pf, ca, rf in U.SCENARIOS) + "\n" + "\nunion all\n".join(
    f"select '{n}' scenario, round(sum(net), 2)::{M} total_net from ({net_sql(f'w_{n}')})"
    for n, _, _, _ in U.SCENARIOS))
def e9(spark, d):
    fx = Fixtures(spark, d)
    return U.sensitivity(fx.sku_economics(), fx.tariffs(), ECON_REGIME, ECON_TURNOVER)


@query("e1_validate_skus", "with " + SKUS + f"""
select sku, array_to_string(list_filter([case when price < cost then 'price_below_cost' end,
                                         case when cost < 0 then 'negative_cost' end,
                                         {"'usn_over_limit'" if ECON_REGIME.startswith("USN") and ECON_TURNOVER > U.USN_LIMIT
                                          else "null::varchar"},
                                         case when category_commission is null then 'missing_commission' end,
                                         case when buyout_rate is null then 'missing_buyout' end], lambda x: x is not null),
                            ',') issues,
       (select count(*) from skus) > 100 segment_by_category
from skus""")
def e1(spark, d):
    v = U.validate_skus(Fixtures(spark, d).sku_economics(), ECON_REGIME, ECON_TURNOVER)
    return v.select("sku", F.array_join("issues", ",").alias("issues"), "segment_by_category")


def _tax_sql(reg: str) -> str:
    vat_in = f"((price - (commission + acquiring + logistics + storage + returns)::{D}) * 0.18032787::decimal(18,8))::{D}"
    vat_extra = f"(price * {'0.05' if ECON_TURNOVER <= U.VAT_5_MAX else '0.07'}::{D})"
    return {"USN6": f"(price * 0.06::{D})::{D}",
            "USN15": f"(greatest(0::{D}, cm2) * 0.15::{D})::{D}",
            "USN15_VAT": f"((greatest(0::{D}, cm2) * 0.15::{D}) + {vat_extra})::{D}",
            "USN_VAT": f"((price * 0.06::{D}) + {vat_extra})::{D}",
            "OSNO": f"(greatest(0::{D}, {vat_in}) + greatest(0::{D}, cm2 - greatest(0::{D}, {vat_in})) * 0.25::{D})::{D}",
            "AUSN": f"(price * 0.08::{D})::{D}",
            "AUSN20": f"(greatest(0::{D}, cm2) * 0.20::{D})::{D}"}[reg]


@query("e10_regime_compare", "with " + SKUS + "," + waterfall_sql("w") + f", n as ({net_sql('w')})" + f"""
, top as (select sku from n order by net desc, sku limit 5)
select sku, """ + ", ".join(f"round((cm2 - {_tax_sql(r)})::{D}, 2)::{M} \"{r}\"" for r in U.REGIMES) + f""",
       {str(ECON_TURNOVER >= 0.8 * U.USN_LIMIT).lower()} usn_limit_risk
from w where sku in (select sku from top)""")
def e10(spark, d):
    return U.regime_compare(cm(spark, d), ECON_TURNOVER)


@query("e4_tax_by_regime", "with " + SKUS + "," + waterfall_sql("w") + f"""
, r as (select unnest({U.REGIMES}) regime)
select w.sku, r.regime, round(case r.regime """ + " ".join(
    f"when '{g}' then {_tax_sql(g)}" for g in U.REGIMES) + f""" end, 2)::{M} tax,
       round((w.cm2 - case r.regime """ + " ".join(f"when '{g}' then {_tax_sql(g)}" for g in U.REGIMES) + f""" end)::{D},
             2)::{M} net
from w, r""")
def e4r(spark, d):
    """Tax and net profit per SKU under every regime."""
    x = cm(spark, d).withColumn("regime", F.explode(F.array(*[F.lit(r) for r in U.REGIMES])))
    n = U.tax_and_net(x, F.col("regime"), ECON_TURNOVER)
    return U.money(n, ["tax", "net"]).select("sku", "regime", "tax", "net")
