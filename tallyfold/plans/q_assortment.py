"""Registered queries: ABC/XYZ assortment analytics (X*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assortment as X
from ..sources.fixtures import QUARTERS, YEARS, Fixtures
from .registry import query

_SALES = """
sales_{g} as (select {sku} sku, p_type category, {per} period,
                     cast(round(l_extendedprice * 100) as bigint) revenue
              from lineitem join part on l_partkey = p_partkey)"""
_SKU = {"part": "cast(l_partkey as varchar)", "supplier": "cast(l_suppkey as varchar)", "brand": "p_brand"}
_PER = {"month": "year(l_shipdate) * 100 + month(l_shipdate)", "quarter": "year(l_shipdate) * 10 + quarter(l_shipdate)",
        "year": "year(l_shipdate)"}


def sales_sql(g: str, per: str) -> str:
    return _SALES.format(g=g, sku=_SKU[g], per=_PER[per])


def abc_sql(g: str) -> str:
    return f"""
abc_{g} as (select sku, revenue, cum_before,
                   case when cum_before * 100 < total * 80 then 'A' when cum_before * 100 < total * 95 then 'B'
                        else 'C' end abc
            from (select sku, revenue,
                         cast(coalesce(sum(revenue) over (order by revenue desc, sku
                                   rows between unbounded preceding and 1 preceding), 0) as bigint) cum_before,
                         sum(revenue) over () total
                  from (select sku, cast(sum(revenue) as bigint) revenue from sales_{g} group by sku)))"""


def xyz_sql(g: str, n: int) -> str:
    return f"""
xyz_{g} as (select sku, round(cv, 4) cv,
                   case when cv is null then 'Z' when cv < 10 then 'X' when cv <= 25 then 'Y' else 'Z' end xyz
            from (select sku, case when s / {n}.0 > 0
                                   then sqrt(greatest(0.0, ss / {n}.0 - (s / {n}.0) * (s / {n}.0))) / (s / {n}.0) * 100
                              end cv
                  from (select sku, sum(r) s, sum(cast(r as double) * cast(r as double)) ss
                        from (select sku, period, sum(revenue) r from sales_{g} group by 1, 2) group by 1)))"""


def sku_rev(sales):
    return sales.groupBy("sku").agg(F.sum("revenue").alias("revenue"))


def supplier_classes(spark, d):
    s = Fixtures(spark, d).sku_sales("supplier", "year")
    abc = X.abc_classes(sku_rev(s))
    xyz = X.xyz_classes(s, len(YEARS))
    return abc.join(xyz, "sku").withColumn("unit_margin", F.lit(None).cast("double"))


@query("x1_revenue_matrix", "with " + sales_sql("brand", "quarter") + f"""
, q as (select unnest({QUARTERS}) period), b as (select distinct sku from sales_brand)
select b.sku, q.period, cast(coalesce(sum(s.revenue), 0) as bigint) revenue
from b cross join q left join sales_brand s on s.sku = b.sku and s.period = q.period
group by 1, 2""")
def x1(spark, d):
    return X.revenue_matrix(Fixtures(spark, d).sku_sales("brand", "quarter"), QUARTERS)


@query("x2_abc_classes", "with " + sales_sql("part", "month") + "," + abc_sql("part") + """
select sku, revenue, cum_before, abc from abc_part""")
def x2(spark, d):
    return X.abc_classes(sku_rev(Fixtures(spark, d).sku_sales("part", "month")))


@query("x3_xyz_classes", "with " + sales_sql("supplier", "year") + "," + xyz_sql("supplier", len(YEARS)) + """
select sku, cv, xyz from xyz_supplier""")
def x3(spark, d):
    return X.xyz_classes(Fixtures(spark, d).sku_sales("supplier", "year"), len(YEARS))


_SUPP = "with " + sales_sql("supplier", "year") + "," + abc_sql("supplier") + "," + xyz_sql("supplier", len(YEARS)) + """
, cls as (select a.sku, a.revenue, a.abc, x.xyz, a.abc || x.xyz abc_xyz from abc_supplier a join xyz_supplier x using (sku))
"""


@query("x4_abc_xyz_matrix", _SUPP + """
, pol as (select * from (values ('AX', 'protect_core'), ('AY', 'stock_for_peak'), ('AZ', 'check_volatility'),
                                 ('BX', 'grow_to_a'), ('BY', 'hold_level'), ('BZ', 'spot_work_no_scale'),
                                 ('CX', 'keep_for_width'), ('CY', 'optimize'), ('CZ', 'exit_candidate'))
                 t(abc_xyz, recommendation))
select p.abc_xyz, coalesce(g.skus, 0)::bigint skus,
       round(coalesce(g.rev / (select sum(revenue) from cls), 0.0), 4) revenue_share,
       null::double mean_margin, p.recommendation
from pol p left join (select abc_xyz, count(*) skus, sum(revenue) rev from cls group by 1) g using (abc_xyz)""")
def x4(spark, d):
    return X.abc_xyz_matrix(supplier_classes(spark, d), spark)


@query("x5_abc_xyz_shortlists", _SUPP + """
select abc_xyz, cast(rank as integer) rank, sku, revenue from (
  select *, row_number() over (partition by abc_xyz order by case when abc_xyz = 'AX' then -revenue else revenue end,
                               sku) rank
  from cls where abc_xyz in ('AX', 'CZ')) where rank <= 10""")
def x5(spark, d):
    return X.abc_xyz_shortlists(supplier_classes(spark, d))


@query("x6_category_growth", "with " + sales_sql("part", "month") + "," + abc_sql("part") + """
, c as (select a.*, cat.category from abc_part a
        join (select sku, min(category) category from sales_part group by 1) cat using (sku))
select category, skus, a_skus, revenue, a_revenue, round(a_skus / skus, 4) a_sku_share,
       round(a_revenue / revenue, 4) a_revenue_share,
       cast(rank() over (order by round(a_revenue / revenue, 4) desc, round(a_skus / skus, 4) desc, category)
            as integer) growth_rank
from (select category, count(*) skus, count(*) filter (where abc = 'A') a_skus, cast(sum(revenue) as bigint) revenue,
             cast(sum(case when abc = 'A' then revenue else 0 end) as bigint) a_revenue
      from c group by 1)""")
def x6(spark, d):
    s = Fixtures(spark, d).sku_sales("part", "month")
    cat = s.groupBy("sku").agg(F.min("category").alias("category"))
    return X.category_growth(X.abc_classes(sku_rev(s)).join(cat, "sku"))


@query("x7_assortment_guards", "with " + sales_sql("part", "month") + """
select count(distinct sku) skus, cast(count(distinct period) as integer) periods, count(distinct sku) <= 30 refuse,
       count(distinct period) < 6 abc_only, count(distinct sku) >= 1000 per_category
from sales_part""")
def x7(spark, d):
    return X.assortment_guards(Fixtures(spark, d).sku_sales("part", "month"))


@query("x7_abc_by_category", "with " + sales_sql("part", "month") + """
, r as (select sku, min(category) category, cast(sum(revenue) as bigint) revenue from sales_part group by 1)
select sku, category, revenue, cum_before,
       case when cum_before * 100 < total * 80 then 'A' when cum_before * 100 < total * 95 then 'B' else 'C' end abc
from (select *, cast(coalesce(sum(revenue) over (partition by category order by revenue desc, sku
                              rows between unbounded preceding and 1 preceding), 0) as bigint) cum_before,
             sum(revenue) over (partition by category) total from r)""")
def x7c(spark, d):
    """Per-category ABC (the guard's recommendation for 1000+ SKUs)."""
    s = Fixtures(spark, d).sku_sales("part", "month")
    rev = s.groupBy("sku").agg(F.min("category").alias("category"), F.sum("revenue").alias("revenue"))
    return X.abc_classes_by(rev, "category").select("sku", "category", "revenue", "cum_before", "abc")


@query("x1_revenue_pivot", "with " + sales_sql("brand", "quarter") + f"""
, b as (select sku, period, cast(sum(revenue) as bigint) revenue from sales_brand group by 1, 2)
select sku, """ + ", ".join(f'cast(coalesce(sum(revenue) filter (where period = {q}), 0) as bigint) "{q}"' for q in QUARTERS) + """
from b group by sku""")
def x1p(spark, d):
    """The SKU x period matrix in wide form (one column per period; the
    period list is a parameter, so the pivot needs no extra pass)."""
    m = X.revenue_matrix(Fixtures(spark, d).sku_sales("brand", "quarter"), QUARTERS)
    p = X.revenue_pivot(m, QUARTERS)
    return p.select("sku", *[F.col(str(q)).cast("long").alias(str(q)) for q in QUARTERS])


@query("x3_xyz_brand_quarter", "with " + sales_sql("brand", "quarter") + "," + xyz_sql("brand", len(QUARTERS)) + """
select sku, cv, xyz from xyz_brand""")
def x3b(spark, d):
    return X.xyz_classes(Fixtures(spark, d).sku_sales("brand", "quarter"), len(QUARTERS))


MONTHS = [y * 100 + m for y in YEARS for m in range(1, 13)]


@query("x3_xyz_part_month", "with " + sales_sql("part", "month") + "," + xyz_sql("part", len(MONTHS)) + """
select sku, cv, xyz from xyz_part""")
def x3p(spark, d):
    return X.xyz_classes(Fixtures(spark, d).sku_sales("part", "month"), len(MONTHS))


from .q_unit_econ import SKUS as _ECON_SKUS, waterfall_sql as _waterfall_sql  # noqa: E402


@query("x4_abc_xyz_matrix_part", "with " + sales_sql("part", "quarter") + "," + abc_sql("part") + ","
       + xyz_sql("part", len(QUARTERS)) + "," + _ECON_SKUS + "," + _waterfall_sql("w") + """
, cls as (select a.sku, a.revenue, a.abc || x.xyz abc_xyz, w.cm2 unit_margin
          from abc_part a join xyz_part x using (sku) left join w using (sku)),
pol as (select * from (values ('AX', 'protect_core'), ('AY', 'stock_for_peak'), ('AZ', 'check_volatility'),
                               ('BX', 'grow_to_a'), ('BY', 'hold_level'), ('BZ', 'spot_work_no_scale'),
                               ('CX', 'keep_for_width'), ('CY', 'optimize'), ('CZ', 'exit_candidate'))
               t(abc_xyz, recommendation))
select p.abc_xyz, coalesce(g.skus, 0)::bigint skus,
       round(coalesce(g.rev / (select sum(revenue) from cls), 0.0), 4) revenue_share,
       round(g.mm::double, 4) mean_margin, p.recommendation
from pol p left join (select abc_xyz, count(*) skus, sum(revenue) rev, avg(unit_margin) mm from cls group by 1) g
  using (abc_xyz)""")
def x4p(spark, d):
    """Part-level matrix; the unit margin comes from unit economics (E3 CM2),
    as the assortment spec prescribes when the sales data has none."""
    from . import q_unit_econ

    s = Fixtures(spark, d).sku_sales("part", "quarter")
    cls = X.abc_classes(sku_rev(s)).join(X.xyz_classes(s, len(QUARTERS)), "sku")
    margin = q_unit_econ.cm(spark, d).select("sku", F.col("cm2").alias("unit_margin"))
    out = X.abc_xyz_matrix(cls.join(margin, "sku", "left"), spark)
    return out.withColumn("mean_margin", F.round(F.col("mean_margin").cast("double"), 4))
