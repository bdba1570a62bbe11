"""Registered queries: price history (C3), token index (D2), photos, visibility
and graded scores of cards (D1, D3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.time import epoch_s
from ..operators import listing as L
from ..sources.tables import Tables
from .oracle_fixtures import E
from .q_market import CARDS_SQL, cards
from .registry import query


# ---- dated offers over lineitem x part --------------------------------------------
def observations(spark, d):
    t = Tables(spark, d)
    price = F.floor("p_retailprice").cast("long") * (100 - F.round(F.col("l_discount") * 100).cast("long"))
    return t.lineitem.join(t.part.select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_partkey").alias("sku"), (F.col("l_suppkey") % 5).alias("competitor"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("obs_id"),
        epoch_s("l_shipdate").alias("seen_at"), price.alias("price"))


OBS_SQL = f"""
obs as (select l_partkey sku, l_suppkey % 5 competitor, l_orderkey * 10 + l_linenumber obs_id, {E('l_shipdate')} seen_at,
               cast(floor(p_retailprice) as bigint) * (100 - cast(round(l_discount * 100) as bigint)) price
        from lineitem join part on l_partkey = p_partkey),
lagged as (select *, lag(price) over (partition by sku, competitor order by seen_at, obs_id) prev from obs),
marked as (select *, sum(case when prev is null or prev <> price then 1 else 0 end) over (
                  partition by sku, competitor order by seen_at, obs_id rows unbounded preceding) run from lagged),
runs as (select sku, competitor, cast(run as bigint) run, min(price) price, min(seen_at) from_ts, max(seen_at) to_ts, count(*) observations,
                coalesce(bool_or(prev > price), false) discounted from marked group by 1, 2, 3)"""


@query("c3_price_history", "with " + OBS_SQL + " select * from runs")
def c3h(spark, d):
    """Runs of equal price of every offer."""
    return L.price_runs(observations(spark, d))


@query("c3_price_reference", "with " + OBS_SQL + """
, o as (select sku, competitor, arg_max(price, run) price, max(run) runs,
               round(sum(case when discounted then observations else 0 end) / sum(observations), 4) discount_freq from runs group by 1, 2),
own as (select sku, min(competitor) mine from o group by 1),
j as (select o.*, mine, (select avg(p.price) from o p where p.sku = o.sku and p.competitor <> o.competitor) others,
             (select max(p.price) from o p where p.sku = o.sku and p.competitor = mine) own_price,
             (select count(*) from o p where p.sku = o.sku and p.price < o.price) cheaper, (select count(*) from o p where p.sku = o.sku) n
      from o join own using (sku))
select sku, competitor, price, runs, discount_freq, round(price / others, 4) vs_others,
       case when n > 1 then round(cheaper / (n - 1), 4) else 0.0 end pct_rank, competitor = mine is_own, round(price / own_price, 4) vs_own,
       coalesce(price >= 2 * others, false) other_league
from j""")
def c3r(spark, d):
    """Offers against the others and the own offer (lowest competitor key)."""
    runs = c3h(spark, d)
    own = runs.groupBy("sku").agg(F.min("competitor").alias("competitor"))
    return L.price_reference(runs, own)


# ---- cards with photos and search positions ----------------------------------------
def photo_cards(spark, d):
    k = F.col("card_id")
    photo = F.transform(F.sequence(F.lit(0), F.greatest(F.col("photos") - 1, F.lit(0))), lambda i: F.struct(
        (600 + (k * 7 + i * 13) % 8 * 100).alias("width"), (900 + (k * 3 + i * 5) % 6 * 100).alias("height"), ((k + i) % 4 != 0).alias("white")))
    large = F.transform(photo, lambda p: F.struct(F.lit(1200).cast("long").alias("width"), F.lit(1600).cast("long").alias("height"), p["white"].alias("white")))
    photos = F.when(k % 3 == 0, large).otherwise(photo)
    return cards(spark, d).withColumn("photos", F.when(F.col("photos") > 0, photos).otherwise(F.slice(photo, 1, 0)))


def positions(spark, d):
    c = cards(spark, d).select("card_id", F.explode(F.sequence(F.lit(1), F.when(F.col("card_id") % 7 == 0, 4).when(F.col("card_id") % 11 == 0, 6).otherwise(5)))
                               .alias("q"))
    k, q = F.col("card_id"), F.col("q")
    return c.select("card_id", F.format_string("query %d", q).alias("query"), F.when((k + q) % 9 != 0, (k * 17 + q * q * 31) % F.when(k % 5 == 0, 15).otherwise(150) + 1)
                    .alias("position"))


LIST_SQL = CARDS_SQL + """,
photo as (select card_id, i, case when card_id % 3 = 0 then 1200 else 600 + (card_id * 7 + i * 13) % 8 * 100 end width,
                 case when card_id % 3 = 0 then 1600 else 900 + (card_id * 3 + i * 5) % 6 * 100 end height, (card_id + i) % 4 <> 0 white
          from (select card_id, unnest(range(photos)) i from cards)),
media as (select c.card_id, count(i) n, count(i) filter (where width >= 900 and height >= 1200) large, coalesce(bool_or(i = 0 and white), false) white
          from cards c left join photo using (card_id) group by 1),
pos as (select card_id, q, case when (card_id + q) % 9 <> 0 then (card_id * 17 + q * q * 31) % (case when card_id % 5 = 0 then 15 else 150 end) + 1 end position
        from (select card_id, unnest(range(1, 1 + case when card_id % 7 = 0 then 4 when card_id % 11 = 0 then 6 else 5 end)) q from cards)),
vis as (select card_id, count(*) queries, sum(case when position <= 10 then 10 when position <= 20 then 7 when position <= 50 then 4 when position <= 100 then 1
                                                   else 0 end) pts from pos group by 1),
seen as (select card_id, case when queries = 5 then pts // 5 end points from vis)"""


@query("d1_media_visibility", "with " + LIST_SQL + """
select card_id, 'photo_size' block, n > 0 and large = n ok, n - large as value from media
union all select card_id, 'main_photo_white', white, white::bigint from media
union all select card_id, 'visibility', coalesce(points >= 4, false), points::bigint from seen""")
def d1m(spark, d):
    """Photo size and background, and visibility over five queries."""
    return L.media_checks(photo_cards(spark, d)).unionByName(L.visibility_checks(L.visibility(positions(spark, d))))


@query("d2_key_index", "with " + CARDS_SQL + r"""
, w as (
        select card_id, unnest(ws) token, unnest(range(len(ws))) pos from (
            select card_id, list_filter(regexp_split_to_array(lower(description), '[^\p{L}\p{N}]+'), lambda x: length(x) > 0) ws from cards)),
k as (select distinct card_id, unnest(list_filter(regexp_split_to_array(lower(title), '[^\p{L}\p{N}]+'), lambda x: length(x) >= 4)) as key from cards),
t as (select card_id, count(*) words from w group by 1),
u as (select k.card_id, k.key, count(w.pos) n, min(w.pos) first_pos from k left join w on w.card_id = k.card_id and w.token = k.key group by 1, 2)
select card_id, key, n, first_pos::integer first_pos, round(n / words, 4) density, n between 8 and 12 in_band, coalesce(n / words > 0.03, false) spam
from u left join t using (card_id)""")
def d2i(spark, d):
    """Uses of every title key, from the positional index."""
    c = cards(spark, d)
    return L.key_stats(c, L.token_index(c))


def _over_sql(v: str, most: str) -> str:
    return f"(case when {v} is not null then greatest(0, 10 - ceil(10 * greatest(0, {v} - {most}) / {most})) end)"


def _band_sql(v: str, lo: int, hi: int) -> str:
    return f"(case when {v} < {lo} then floor(10 * {v} / {lo}) else {_over_sql(v, str(hi))} end)"


_SCORES = "with " + LIST_SQL + f""",
score as (select card_id, unnest([
    {{'b': 'title_length', 'w': 3, 's': {_over_sql('length(title)', "(case when mp = 'WB' then 100 else 200 end)")}}},
    {{'b': 'title_stop_words', 'w': 2, 's': case when lower(title) like '%лучший%' or lower(title) like '%№1%' or lower(title) like '%уникальный%' then 0 else 10 end}},
    {{'b': 'description_length', 'w': 2, 's': {_band_sql('length(description)', 1500, 2500)}}},
    {{'b': 'attributes_complete', 'w': 3, 's': floor(10 * (4 - attrs_missing) / 4)}},
    {{'b': 'attributes_unique', 'w': 1, 's': 10 - 5 * attrs_dup}},
    {{'b': 'slides', 'w': 2, 's': {_band_sql('slides', 5, 8)}}},
    {{'b': 'photos', 'w': 3, 's': {_band_sql('photos', 6, 10)}}},
    {{'b': 'photo_size', 'w': 2, 's': case when n > 0 then floor(10 * large / n) else 0 end}},
    {{'b': 'main_photo_white', 'w': 3, 's': case when white then 10 else 0 end}},
    {{'b': 'video', 'w': 1, 's': coalesce({_band_sql('video_sec', 15, 30)}, 0)}},
    {{'b': 'price_index', 'w': 3, 's': case when price_index is null then 10 else {_over_sql('price_index', '59')} end}},
    {{'b': 'unanswered_negatives', 'w': 2, 's': 10 - 5 * unanswered_negatives}},
    {{'b': 'visibility', 'w': 3, 's': points}}]) x
  from cards join media using (card_id) join seen using (card_id)),
flat as (select card_id, x.b block, x.s::integer score, x.w weight from score where x.s is not null)"""


@query("d3_graded_scores", _SCORES + " select card_id, block, score, weight from flat")
def d3s(spark, d):
    """Points of every block, 0 to 10."""
    return L.graded_scores(photo_cards(spark, d), L.visibility(positions(spark, d)))


@query("d3_graded_scorecard", _SCORES + """
select card_id, block, score, lost, case when lost >= 15 then 'critical' when lost >= 5 then 'medium' else 'cosmetic' end priority,
       cast(rank as integer) rank
from (select *, weight * (10 - score) lost, row_number() over (partition by card_id order by weight * (10 - score) desc, block) rank
      from flat where score < 10) where rank <= 5""")
def d3g(spark, d):
    """The five blocks that cost each card most."""
    return L.graded_scorecard(d3s(spark, d))
