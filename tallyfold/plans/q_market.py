"""Registered queries: competitors (C*), reviews (V*), cards (D*), routing (G*)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import market as M
from ..sources.reference_data import AGENTS
from ..sources.tables import Tables
from .registry import query

AG_SQL = "[" + ", ".join(f"'{a}'" for a in AGENTS) + "]"

OFFERS_SQL = """
offers as (select cast(l_partkey as varchar) sku, l_suppkey competitor, avg(l_extendedprice / l_quantity) price,
                  round(avg(case when l_discount > 0 then 1.0 else 0.0 end), 4) discount_freq
           from lineitem group by 1, 2)"""


def offers(spark, d):
    li = Tables(spark, d).lineitem
    return li.groupBy(F.col("l_partkey").cast("string").alias("sku"), F.col("l_suppkey").alias("competitor")) \
        .agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
             F.round(F.avg(F.when(F.col("l_discount") > 0, 1.0).otherwise(0.0)), 4).alias("discount_freq"))


def axis_scores(spark, d):
    """fx_axis_scores: 12 axes per offer; the lowest supplier key is 'own'.  Offers
    are shuffled by SKU before they become 12 rows each; the partitions are not
    merged by their small size, as what follows sorts twelve times as much."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    o = offers(spark, d).select("sku", "competitor").where(F.col("sku").isNotNull()).repartition(n, "sku")
    x = o.withColumn("_own", F.min("competitor").over(Window.partitionBy("sku"))).withColumn("axis", F.explode(F.sequence(F.lit(0), F.lit(M.N_AXES - 1))))
    return x.select("sku", "competitor", "axis", (F.col("competitor") == F.col("_own")).alias("is_own"),
                    ((F.col("sku").cast("long") * 7 + F.col("competitor") * 3 + F.col("axis") * 5) % 11)
                    .cast("int").alias("score"))


AXIS_SQL = OFFERS_SQL + """,
own as (select sku, min(competitor) own from offers group by 1),
scores as (select o.sku, o.competitor, a.axis, o.competitor = w.own is_own,
                  cast((cast(o.sku as bigint) * 7 + o.competitor * 3 + a.axis * 5) % 11 as integer) score
           from offers o join own w using (sku), (select cast(unnest(range(12)) as integer) axis) a),
matrix as (select o.sku, o.axis, o.score own, b.best best_competitor, o.score - b.best gap
           from (select * from scores where is_own) o
           left join (select sku, axis, max(score) best from scores where not is_own group by 1, 2) b using (sku, axis))"""


@query("c3_price_position", "with " + OFFERS_SQL + """
select sku, competitor, discount_freq,
       cast(rank() over (partition by sku order by price, competitor) as integer) price_rank,
       round(price / avg(price) over (partition by sku), 4) vs_mean,
       price >= 2.0 * avg(price) over (partition by sku) other_league,
       count(*) over (partition by sku) offers
from offers""")
def c3(spark, d):
    p = M.price_position(offers(spark, d))
    return p.select("sku", "competitor", "discount_freq", "price_rank", "vs_mean",
                    "other_league", "offers")


@query("c4_comparison_guard", "with " + OFFERS_SQL + """
select sku, count(distinct competitor) competitors, count(distinct competitor) >= 3 representative
from offers group by 1""")
def c4(spark, d):
    return M.comparison_guard(offers(spark, d))


@query("c1_axis_matrix", "with " + AXIS_SQL + " select * from matrix")
def c1(spark, d):
    return M.axis_matrix(axis_scores(spark, d))


@query("c1_competitor_columns", "with " + AXIS_SQL + """
, n as (select *, dense_rank() over (partition by sku order by competitor) place from scores where not is_own),
g as (select sku, axis, count(*) competitors, max(score) filter (where place = 1) competitor_1,
             max(score) filter (where place = 2) competitor_2, max(score) filter (where place = 3) competitor_3,
             max(score) filter (where place = 4) competitor_4, max(score) filter (where place = 5) competitor_5
      from n group by 1, 2)
select o.sku, o.axis, o.score own, coalesce(competitors, 0) competitors, competitor_1, competitor_2, competitor_3,
       competitor_4, competitor_5
from (select * from scores where is_own) o left join g using (sku, axis)""")
def c1c(spark, d):
    return M.competitor_columns(axis_scores(spark, d))


@query("c2_axis_extremes", "with " + AXIS_SQL + """
, r as (select *, row_number() over (partition by sku order by gap, axis) l,
               row_number() over (partition by sku order by gap desc, axis) w from matrix)
select sku, axis, gap, case when l <= 3 then 'lagging' else 'winning' end kind,
       cast(case when l <= 3 then l else w end as integer) rank
from r where l <= 3 or w <= 2""")
def c2(spark, d):
    return M.axis_extremes(M.axis_matrix(axis_scores(spark, d)))


@query("c5_rank_fixes", "with " + AXIS_SQL + """
, r as (select *, row_number() over (partition by sku order by gap, axis) l from matrix),
f as (select sku, 'raise_axis_' || axis fix, -gap effect, axis % 3 + 1 effort from r where l <= 3)
select sku, fix, effect, effort, ratio, cast(rank as integer) rank from (
  select *, round(effect / effort, 4) ratio, row_number() over (partition by sku order by round(effect / effort, 4) desc, fix) rank
  from f) where rank <= 5""")
def c5(spark, d):
    """Fixes proposed from the lagging axes: effect = -gap, effort by axis."""
    lag = M.axis_extremes(M.axis_matrix(axis_scores(spark, d))).where(F.col("kind") == "lagging")
    fixes = lag.select("sku", F.format_string("raise_axis_%d", F.col("axis")).alias("fix"),
                       (-F.col("gap")).alias("effect"), (F.col("axis") % 3 + 1).alias("effort"))
    return M.rank_fixes(fixes)


# ---- reviews over documents -------------------------------------------------------
# fixed rule table: problem category, pattern, priority (lowest wins)
REVIEW_RULES = [("defect", "(?i)(defect|broken|cass|kaputt|брак|слома)", 1),
                ("size", "(?i)(size|taille|größe|размер)", 2),
                ("delivery", "(?i)(deliver|livr|liefer|доставк)", 3),
                ("mismatch", "(?i)(differ|pas conforme|anders|не соответ)", 4),
                ("suspected_fake", "(?i)(fake|faux|gefälscht|подделк)", 5),
                ("question", "\\?", 6)]



REVIEWS_SQL = """
rv as (select doc_id review_id, source sku, cast(1 + doc_id % 5 as integer) stars, text from documents),
rules as (select * from (values """ + ", ".join(
    "('%s', '%s', %d)" % (c, p.replace("'", "''"), pr) for c, p, pr in REVIEW_RULES) + """) t(category, pattern, priority)),
cls as (select rv.review_id, rv.sku, rv.stars,
               case when rv.stars <= 2 then 'negative' when rv.stars = 3 then 'neutral' else 'positive' end tone,
               case when rv.stars <= 2 then 3 when rv.stars = 3 then 2 else 1 end min_sentences,
               case when rv.stars <= 2 then 5 when rv.stars = 3 then 3 else 2 end max_sentences,
               coalesce(h.problem, 'none') problem
        from rv left join (select review_id, arg_min(category, priority * 100 + 0) problem
                           from rv join rules on regexp_matches(rv.text, rules.pattern) group by 1) h using (review_id))"""


def reviews(spark, d):
    doc = Tables(spark, d).documents
    return doc.select(F.col("doc_id").alias("review_id"), F.col("source").alias("sku"),
                      (F.lit(1) + F.col("doc_id") % 5).cast("int").alias("stars"), "text")


@query("v1_classify_reviews", "with " + REVIEWS_SQL + " select * from cls")
def v1(spark, d):
    return M.classify_reviews(reviews(spark, d), REVIEW_RULES)


@query("v2_top_themes", "with " + REVIEWS_SQL + """
select sku, problem, n, cast(rank as integer) rank, n >= 3 systemic from (
  select *, row_number() over (partition by sku order by n desc, problem) rank
  from (select sku, problem, count(*) n from cls where problem <> 'none' group by 1, 2)) where rank <= 3""")
def v2(spark, d):
    return M.top_themes(v1(spark, d))


@query("v2_batch_themes", "with " + REVIEWS_SQL + """
, p as (select problem, count(*) n, count(distinct sku) skus from cls where problem <> 'none' group by 1)
select problem, n, skus, round(n / (select sum(n) from p), 4) share, cast(rank as integer) rank
from (select *, row_number() over (order by n desc, problem) rank from p) where rank <= 3""")
def v2b(spark, d):
    return M.batch_themes(v1(spark, d))


@query("v3_fake_series", """
with n as (select doc_id review_id, source sku,
                  trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\s]', '', 'g'), '\\s+', ' ', 'g')) t
           from documents),
g as (select t, min(review_id) series_id, count(*) size, count(distinct sku) skus from n group by t having count(*) >= 2)
select n.review_id, n.sku, g.series_id, g.size, g.skus from n join g using (t)""")
def v3(spark, d):
    return M.fake_series(reviews(spark, d))


BANNED_CLICHES = M.BANNED_REPLY_PHRASES


@query("v4_lint_replies", """
with rep as (select format('{}-{}', conv_id, turn) reply_id, cast(1 + conv_id % 5 as integer) stars, text reply
             from conversations where role = 'assistant'),
x as (select *, cast(len(list_filter(regexp_split_to_array(trim(reply), '[.!?]+'), lambda s: length(trim(s)) > 0))
                     as integer) sentences,
             case when stars <= 2 then 3 when stars = 3 then 2 else 1 end lo,
             case when stars <= 2 then 5 when stars = 3 then 3 else 2 end hi
      from rep)
select reply_id, stars, sentences,
       array_to_string(list_filter([case when stars <= 2 and contains(reply, '!') then 'exclamation_in_negative' end,
                                    case when """ + " or ".join(f"contains(lower(reply), '{b}')" for b in BANNED_CLICHES)
       + """ then 'banned_cliche' end,
                                    case when regexp_matches(reply, '""" + M.COMPETITOR_PATTERN + """')
                                         then 'competitor_mention' end,
                                    case when regexp_matches(reply, '""" + M.PRIVATE_PROMISE_PATTERN + """')
                                         then 'private_promise' end,
                                    case when sentences < lo or sentences > hi then 'sentence_count' end],
                                   lambda v: v is not null), ',') violations
from x""")
def v4(spark, d):
    c = Tables(spark, d).conversations.where(F.col("role") == "assistant")
    rep = c.select(F.format_string("%d-%d", F.col("conv_id"), F.col("turn")).alias("reply_id"),
                   (F.lit(1) + F.col("conv_id") % 5).cast("int").alias("stars"), F.col("text").alias("reply"))
    out = M.lint_replies(rep, BANNED_CLICHES)
    return out.withColumn("violations", F.array_join("violations", ","))


# ---- cards over documents x part --------------------------------------------------
def cards(spark, d):
    t = Tables(spark, d)
    doc, part = t.documents, t.part
    n = part.agg(F.max("p_partkey").alias("_n"))
    x = doc.withColumn("_k", F.lit(1)).join(F.broadcast(n.withColumn("_k", F.lit(1))), "_k")
    x = x.withColumn("p_partkey", F.col("doc_id") % F.col("_n") + 1).join(part.select("p_partkey", "p_name"),
                                                                        "p_partkey")
    k = F.col("doc_id")
    attr = F.struct
    attrs = F.array_compact(F.array(
        attr(F.lit("brand").alias("name"), F.lit("b").alias("value")),
        attr(F.lit("type").alias("name"), F.lit("t").alias("value")),
        F.when(k % 5 != 0, attr(F.lit("size").alias("name"), F.lit("s").alias("value"))),
        attr(F.lit("color").alias("name"), F.lit("c").alias("value")),
        F.when(k % 6 == 0, attr(F.lit("color").alias("name"), F.lit("c2").alias("value")))))
    return x.select(k.alias("card_id"), F.when(k % 2 == 0, "WB").otherwise("Ozon").alias("mp"),
                    F.col("p_name").alias("title"), F.col("text").alias("description"), attrs.alias("attributes"),
                    F.when(k % 4 == 0, k % 3).otherwise(0).cast("int").alias("unanswered_negatives"),
                    (k % 10).cast("int").alias("slides"), (k % 12).cast("int").alias("photos"),
                    F.when(k % 3 != 0, k % 40).cast("int").alias("video_sec"),
                    F.when(k % 4 != 0, k % 100).cast("int").alias("price_index"))


CARDS_SQL = """
cards as (select doc_id card_id, case when doc_id % 2 = 0 then 'WB' else 'Ozon' end mp, p_name title, text description,
                 doc_id % 10 slides, doc_id % 12 photos, case when doc_id % 3 <> 0 then doc_id % 40 end video_sec,
                 case when doc_id % 4 <> 0 then doc_id % 100 end price_index,
                 case when doc_id % 4 = 0 then doc_id % 3 else 0 end unanswered_negatives,
                 case when doc_id % 5 <> 0 then 0 else 1 end attrs_missing,
                 case when doc_id % 6 = 0 then 1 else 0 end attrs_dup
          from documents join part on p_partkey = doc_id % (select max(p_partkey) from part) + 1)"""


@query("d1_card_checks", "with " + CARDS_SQL + """
select card_id, block, ok, value from (
  select card_id, 'title_length' block, length(title) <= case when mp = 'WB' then 100 else 200 end ok,
         length(title)::bigint value from cards
  union all select card_id, 'description_length', length(description) between 1500 and 2500,
         length(description)::bigint from cards
  union all select card_id, 'slides', slides between 5 and 8, slides::bigint from cards
  union all select card_id, 'photos', photos between 6 and 10, photos::bigint from cards
  union all select card_id, 'video', coalesce(video_sec between 15 and 30, false), video_sec::bigint from cards
  union all select card_id, 'price_index', coalesce(price_index < 60, true), price_index::bigint from cards
  union all select card_id, 'title_stop_words', not (contains(lower(title), 'лучший') or contains(lower(title), '№1')
                   or contains(lower(title), 'уникальный')),
         cast(contains(lower(title), 'лучший') or contains(lower(title), '№1') or contains(lower(title), 'уникальный')
              as integer)::bigint from cards
  union all select card_id, 'attributes_complete', attrs_missing = 0, attrs_missing::bigint from cards
  union all select card_id, 'attributes_unique', attrs_dup = 0, attrs_dup::bigint from cards
  union all select card_id, 'unanswered_negatives', unanswered_negatives = 0, unanswered_negatives::bigint from cards)""")
def d1(spark, d):
    return M.card_checks(cards(spark, d))


@query("d2_keyword_stats", "with " + CARDS_SQL + """
, w as (select card_id,
               list_filter(regexp_split_to_array(lower(description), '[^\\p{L}\\p{N}]+'), lambda x: length(x) > 0) words,
               list_distinct(list_filter(regexp_split_to_array(lower(title), '[^\\p{L}\\p{N}]+'),
                                         lambda x: length(x) >= 4)) ks, title
        from cards)
select card_id, cast(len(words) as integer) words, cast(len(ks) as integer) keys,
       coalesce(list_bool_and(list_transform(
           list_slice(list_transform(list_sort(list_transform(ks, lambda k: {'m': -len(list_filter(words, lambda w: w = k)), 'k': k})),
                                     lambda x: x.k), 1, 3),
           lambda k: contains(lower(left(title, 50)), k))), true) top3_in_head,
       cast(len(list_filter(words, lambda x: list_contains(ks, x))) as integer) key_hits,
       case when len(words) > 0 then round(len(list_filter(words, lambda x: list_contains(ks, x))) / len(words), 4) end density,
       coalesce(len(words) > 0 and len(list_filter(words, lambda x: list_contains(ks, x))) / len(words) > 0.03, false) spam
from w""")
def d2(spark, d):
    return M.keyword_stats(cards(spark, d))


@query("d3_card_scorecard", "with " + CARDS_SQL + """
, chk as (select card_id, 'title_length' block, length(title) <= case when mp = 'WB' then 100 else 200 end ok from cards
  union all select card_id, 'description_length', length(description) between 1500 and 2500 from cards
  union all select card_id, 'slides', slides between 5 and 8 from cards
  union all select card_id, 'photos', photos between 6 and 10 from cards
  union all select card_id, 'video', coalesce(video_sec between 15 and 30, false) from cards
  union all select card_id, 'price_index', coalesce(price_index < 60, true) from cards
  union all select card_id, 'title_stop_words', not (contains(lower(title), 'лучший') or contains(lower(title), '№1')
                   or contains(lower(title), 'уникальный')) from cards
  union all select card_id, 'attributes_complete', attrs_missing = 0 from cards
  union all select card_id, 'attributes_unique', attrs_dup = 0 from cards
  union all select card_id, 'unanswered_negatives', unanswered_negatives = 0 from cards),
wt as (select * from (values """ + ", ".join(f"('{b}', {w})" for b, w in M.BLOCK_WEIGHTS) + """) t(block, weight))
select card_id, block, priority, weight, cast(rank as integer) rank from (
  select c.card_id, c.block, w.weight,
         case when w.weight >= 3 then 'critical' when w.weight = 2 then 'medium' else 'cosmetic' end priority,
         row_number() over (partition by c.card_id order by w.weight * 10 desc, c.block) rank
  from chk c join wt w using (block) where not c.ok) where rank <= 5""")
def d3(spark, d):
    return M.card_scorecard(M.card_checks(cards(spark, d)))


# ---- router outputs over events ---------------------------------------------------
def router_raw(spark, d):
    """fx_router: one model output per event, a second candidate for every 4th."""
    e = Tables(spark, d).events
    k = F.col("event_id")
    ag = F.element_at(F.array(*[F.lit(a) for a in AGENTS]), (k % 5).cast("int") + 1)
    ag2 = F.element_at(F.array(*[F.lit(a) for a in AGENTS]), ((k + 2) % 5).cast("int") + 1)
    first = (F.when(k % 6 == 0, F.format_string('{"agent":"%s","reason":"fits","confidence":0.9,"reply":""}', ag))
             .when(k % 6 == 1, F.format_string('{"agent":"%s","reason":"unsure","confidence":0.3,"reply":""}', ag))
             .when(k % 6 == 2, F.lit('{"agent":null,"reason":"off domain","confidence":1.0,"reply":"only WB/Ozon"}'))
             .when(k % 6 == 3, F.lit('{"agent": '))
             .when(k % 6 == 4, F.lit('{"agent":"mp_weather","reason":"fits","confidence":0.8,"reply":""}'))
             .otherwise(F.lit('{"agent":null,"reason":"prompt injection attempt","confidence":1.0,"reply":"no"}')))
    second = F.format_string('{"agent":"%s","reason":"also fits","confidence":0.8,"reply":""}', ag2)
    arr = F.when(k % 4 == 0, F.array(first, second)).otherwise(F.array(first))
    return e.select(k.alias("request_id"), F.explode(arr).alias("raw"))


ROUTER_SQL = f"""
raw as (select event_id request_id, c, event_id % 6 m,
               {AG_SQL}[event_id % 5 + 1] ag, {AG_SQL}[(event_id + 2) % 5 + 1] ag2
        from events, (values (0), (1)) t(c) where c = 0 or event_id % 4 = 0),
parsed as (select request_id,
                  case when c = 1 then ag2 when m in (0, 1) then ag when m = 4 then 'mp_weather' end agent,
                  case when c = 1 then 'also fits' when m = 0 then 'fits' when m = 1 then 'unsure'
                       when m = 2 then 'off domain' when m = 4 then 'fits' when m = 5 then 'prompt injection attempt' end reason,
                  case when c = 1 then 0.8 when m = 0 then 0.9 when m = 1 then 0.3 when m in (2, 5) then 1.0
                       when m = 4 then 0.8 end::double confidence,
                  case when c = 1 or m in (0, 1, 4) then '' when m = 2 then 'only WB/Ozon' when m = 5 then 'no' end reply,
                  case when c = 0 and m in (3, 4) then 'quarantine' else 'ok' end status
           from raw)"""


@query("g1_parse_router_outputs", "with " + ROUTER_SQL + " select * from parsed")
def g1(spark, d):
    return M.parse_router_outputs(router_raw(spark, d))


@query("g2_resolve_routes", "with " + ROUTER_SQL + f"""
, ok as (select *, coalesce(list_position(['mp_unit_economics', 'mp_competitor_scout', 'mp_card_doctor',
                                           'mp_abc_xyz_analyst', 'mp_review_responder'], agent), 99) prio
         from parsed where status = 'ok'),
g as (select request_id, max(case when lower(coalesce(reason, '')) like '%injection%' then 1 else 0 end) inj,
             max(case when agent is null then 1 else 0 end) off,
             arg_min(agent, prio * 100 + coalesce(list_position({AG_SQL}, agent), 0)) best,
             arg_min(confidence, prio * 100 + coalesce(list_position({AG_SQL}, agent), 0)) conf
      from ok group by 1)
select request_id,
       case when inj = 1 then 'refuse_injection' when off = 1 then 'refuse_off_domain' when conf < 0.5 then 'clarify'
            else 'route' end decision,
       case when inj = 0 and off = 0 and conf >= 0.5 then best end agent
from g""")
def g2(spark, d):
    return M.resolve_routes(M.parse_router_outputs(router_raw(spark, d)))


# brute force for the oracle: all pairs within the size bound, exact Jaccard,
# components by a recursive closure (fine at test scale, quadratic in general)
NEAR_SQL = """
with recursive v as (
  select doc_id rid, source sku,
         list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\s]', '', 'g'),
                                                                    '\\s+', ' ', 'g')), ' '), lambda w: length(w) > 0)) voc
  from documents),
n as (select *, len(voc) k from v where len(voc) > 0),
e as (select a.rid a, b.rid b from n a join n b
        on a.rid < b.rid and least(a.k, b.k) >= 0.8 * greatest(a.k, b.k)
      where len(list_intersect(a.voc, b.voc)) >= 0.8 * (a.k + b.k - len(list_intersect(a.voc, b.voc)))),
u as (select a, b from e union select b, a from e),
r(node, label) as (select a, a from u union select u.b, r.label from r join u on u.a = r.node),
comp as (select node rid, min(label) series_id from r group by node),
m as (select n.rid review_id, n.sku, c.series_id from n join comp c using (rid))
select review_id, sku, series_id, count(*) over (partition by series_id) size,
       count(distinct sku) over (partition by series_id) skus
from m"""


@query("v3_near_copy_series", NEAR_SQL.replace("\\\\", "\\"))
def v3n(spark, d):
    """Near-identical vocabulary (Jaccard >= 0.8) via MinHash bands, star
    edges and connected components; the oracle is brute force."""
    return M.near_copy_series(reviews(spark, d))


@query("g2_routing_mix", "with " + ROUTER_SQL + f"""
, ok as (select *, coalesce(list_position(['mp_unit_economics', 'mp_competitor_scout', 'mp_card_doctor',
                                           'mp_abc_xyz_analyst', 'mp_review_responder'], agent), 99) prio
         from parsed where status = 'ok'),
g as (select request_id, max(case when lower(coalesce(reason, '')) like '%injection%' then 1 else 0 end) inj,
             max(case when agent is null then 1 else 0 end) off,
             arg_min(agent, prio * 100 + coalesce(list_position({AG_SQL}, agent), 0)) best,
             arg_min(confidence, prio * 100 + coalesce(list_position({AG_SQL}, agent), 0)) conf
      from ok group by 1),
dec as (select request_id,
               case when inj = 1 then 'refuse_injection' when off = 1 then 'refuse_off_domain'
                    when conf < 0.5 then 'clarify' else 'route' end decision,
               case when inj = 0 and off = 0 and conf >= 0.5 then best end agent from g)
select cast(strftime(e.ts, '%Y%m%d') as integer) date, decision, coalesce(agent, 'none') agent, count(*) n
from dec join events e on e.event_id = dec.request_id group by 1, 2, 3""")
def g2m(spark, d):
    """Routing mix by UTC day (decision and agent counts)."""
    from ..functions.time import epoch_s, yyyymmdd

    dec = M.resolve_routes(M.parse_router_outputs(router_raw(spark, d)))
    ev = Tables(spark, d).events.select(F.col("event_id").alias("request_id"), epoch_s("ts").alias("_t"))
    return (dec.join(ev, "request_id").groupBy(yyyymmdd(F.col("_t")).alias("date"), "decision",
                                                F.coalesce("agent", F.lit("none")).alias("agent"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("v3_suspect_reviews", """
with rv as (select doc_id review_id, source sku, text,
                   trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\s]', '', 'g'), '\\s+', ' ', 'g')) t
            from documents),
ser as (select t from rv group by t having count(*) >= 2)
select review_id, sku, t in (select t from ser) in_series,
       regexp_matches(text, '""" + M.COMPETITOR_PATTERN + """') competitor_mention,
       regexp_matches(text, '""" + M.OFF_PRODUCT_PATTERN + """') off_product,
       (t in (select t from ser)) or regexp_matches(text, '""" + M.COMPETITOR_PATTERN + """')
         or regexp_matches(text, '""" + M.OFF_PRODUCT_PATTERN + """') complaint_candidate
from rv""")
def v3s(spark, d):
    """Complaint candidates: same-vocabulary series (exact copies),
    competitor mentions, accusations beyond the product."""
    r = reviews(spark, d)
    return M.suspect_reviews(r, M.fake_series(r))
