"""C1–C5 competitor comparison, V1–V4 review triage, D1–D3 card audit and
G1–G2 request routing: the measurable parts of the seller-analytics specs,
as deterministic table jobs."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.components import connected, relabel
from ..functions.windows import _once
from ..session import drop_folder, ensure_checkpoint_dir
from ..sources.reference_data import AGENTS

# ---- fixed values -------------------------------------------------------------
N_AXES = 12
MIN_COMPETITORS = 3
OTHER_LEAGUE_FACTOR = 2.0
# router: agent priority when a request fits several (lower wins)
ROUTE_PRIORITY = ["mp_unit_economics", "mp_competitor_scout", "mp_card_doctor", "mp_abc_xyz_analyst",
                  "mp_review_responder"]
CONFIDENCE_MIN = 0.5
# card rules: title limit per marketplace, description length band, slide and photo counts,
# video length band, price index ceiling
TITLE_MAX = {"WB": 100, "Ozon": 200}
DESC_MIN, DESC_MAX = 1500, 2500
SLIDES = (5, 8)
PHOTOS = (6, 10)
VIDEO = (15, 30)
PRICE_INDEX_MAX = 60
KEY_COUNT = (8, 12)
KEY_DENSITY_SPAM = 0.03
TITLE_STOP_WORDS = ["лучший", "№1", "уникальный"]
REQUIRED_ATTRIBUTES = ["brand", "type", "size", "color"]
TITLE_HEAD = 50
# review triage: phrases a reply must not use, and markers of replies / reviews
BANNED_REPLY_PHRASES = ["спасибо за ваш отзыв", "в связи с вышеизложенным", "уважаемый покупатель"]
COMPETITOR_PATTERN = r"(?i)(конкурент|competitor|concurrent|konkurrent|другой продавец|other seller)"
PRIVATE_PROMISE_PATTERN = r"(?i)(скидк|подар|discount|gift).{0,40}(личк|личн|private|direct message)"
OFF_PRODUCT_PATTERN = r"(?i)(мошенн|обман|scam|fraud|arnaque|betrug)"
# review tone bands: stars -> (tone, min sentences, max sentences)
TONE = [(1, "negative", 3, 5), (2, "negative", 3, 5), (3, "neutral", 2, 3), (4, "positive", 1, 2),
        (5, "positive", 1, 2)]
# -------------------------------------------------------------------------------


# C3 / C4 -----------------------------------------------------------------------
def price_position(offers: DataFrame) -> DataFrame:
    """Per offer: price vs the SKU mean, rank, and the other-league mark
    (competitor at >= 2x the mean).  The mean is a partial aggregate joined
    back; the rank window holds one SKU's offers, i.e. one row per
    competitor of that SKU (offers are already aggregated per pair)."""
    st = offers.groupBy("sku").agg(F.avg("price").alias("mean_price"), F.count(F.lit(1)).alias("offers"))
    w = Window.partitionBy("sku").orderBy("price", "competitor")
    return (offers.join(st, "sku")
            .withColumn("price_rank", F.rank().over(w))
            .withColumn("vs_mean", F.round(F.col("price") / F.col("mean_price"), 4))
            .withColumn("other_league", F.col("price") >= OTHER_LEAGUE_FACTOR * F.col("mean_price")))


def comparison_guard(offers: DataFrame, min_competitors: int = MIN_COMPETITORS) -> DataFrame:
    g = offers.groupBy("sku").agg(F.count_distinct("competitor").alias("competitors"))
    return g.withColumn("representative", F.col("competitors") >= min_competitors)


# C1 / C2 / C5 ------------------------------------------------------------------
def axis_matrix(scores: DataFrame) -> DataFrame:
    """Per (sku, axis): own score, best competitor score, gap = own - best.  A
    SKU without competitors stays, with null best and gap.  A window on one
    axis of a SKU (one row per offer): no join, and no shuffle if the scores
    are already together by SKU."""
    axis = Window.partitionBy("sku", "axis")
    best = F.max(F.when(~F.col("is_own"), F.col("score"))).over(axis)
    m = scores.withColumn("best_competitor", best).where(F.col("is_own")).select("sku", "axis", F.col("score").alias("own"), "best_competitor")
    return m.withColumn("gap", F.col("own") - F.col("best_competitor"))


def competitor_columns(scores: DataFrame, k: int = 5) -> DataFrame:
    """Per (sku, axis): own score and one column per competitor, numbered by
    competitor id; ``k`` columns and the count say whether there are more.  A
    rank and a window, both within the SKU: no join, and no shuffle if the
    scores are already together by SKU."""
    place = F.dense_rank().over(Window.partitionBy("sku", "is_own").orderBy("competitor"))
    axis, rival = Window.partitionBy("sku", "axis"), ~F.col("is_own")
    return scores.withColumn("place", place).withColumns(
        {"competitors": F.count(F.when(rival, 1)).over(axis)}
        | {f"competitor_{i}": F.max(F.when(rival & (F.col("place") == i), F.col("score"))).over(axis) for i in range(1, k + 1)},
    ).where(F.col("is_own")).select("sku", "axis", F.col("score").alias("own"), "competitors", *[f"competitor_{i}" for i in range(1, k + 1)])


def axis_extremes(matrix: DataFrame, k_lag: int = 3, k_win: int = 2) -> DataFrame:
    lag = Window.partitionBy("sku").orderBy("gap", "axis")
    win = Window.partitionBy("sku").orderBy(F.desc("gap"), "axis")
    m = matrix.withColumn("_l", F.row_number().over(lag)).withColumn("_w", F.row_number().over(win))
    return (m.where((F.col("_l") <= k_lag) | (F.col("_w") <= k_win))
            .select("sku", "axis", "gap", F.when(F.col("_l") <= k_lag, "lagging").otherwise("winning").alias("kind"),
                    F.when(F.col("_l") <= k_lag, F.col("_l")).otherwise(F.col("_w")).alias("rank")))


def rank_fixes(fixes: DataFrame, k: int = 5) -> DataFrame:
    """Fixes ``(sku, fix, effect, effort)`` by effect/effort, top-k per SKU."""
    w = Window.partitionBy("sku").orderBy(F.desc("ratio"), "fix")
    return (fixes.withColumn("ratio", F.round(F.try_divide(F.col("effect"), F.col("effort")), 4))
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))


# V1–V4 ------------------------------------------------------------------------
def classify_reviews(reviews: DataFrame, rules: list[tuple[str, str, int]]) -> DataFrame:
    """Tone band by stars; problem category by the matching rule with the
    lowest priority number (ties by name).  ``rules`` are (category, pattern,
    priority) and fold into one ``when`` chain: no join and no shuffle.  Null
    stars or stars outside 1-5 have tone ``quarantine`` and no sentence band."""
    tone = F.array(*[F.struct(F.lit(s).alias("stars"), F.lit(t).alias("tone"), F.lit(a).alias("min_sent"),
                              F.lit(b).alias("max_sent")) for s, t, a, b in TONE])
    r = reviews.withColumn("_b", F.filter(tone, lambda x: x["stars"] == F.col("stars")))
    r = r.withColumn("_b", F.get("_b", F.lit(0)))
    problem = F.lit("none")
    for category, pattern, _ in sorted(rules, key=lambda x: (x[2], x[0]), reverse=True):
        problem = F.when(F.col("text").rlike(pattern), category).otherwise(problem)
    return r.select("review_id", "sku", "stars", F.coalesce("_b.tone", F.lit("quarantine")).alias("tone"),
                    F.col("_b.min_sent").alias("min_sentences"), F.col("_b.max_sent").alias("max_sentences"),
                    problem.alias("problem"))


def top_themes(classified: DataFrame, k: int = 3, systemic_at: int = 3) -> DataFrame:
    g = (classified.where(F.col("problem") != "none").groupBy("sku", "problem")
         .agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy("sku").orderBy(F.desc("n"), "problem")
    return (g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .withColumn("systemic", F.col("n") >= systemic_at))


def batch_themes(classified: DataFrame, k: int = 3) -> DataFrame:
    """The batch summary: the ``k`` most frequent problems over all SKUs, with
    their share of the reviews that name a problem and the SKUs they touch."""
    g = (classified.where(F.col("problem") != "none").groupBy("problem")
         .agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sku").alias("skus")))  # a handful of rows
    w = Window.partitionBy(F.lit(1))
    return (g.withColumn("share", F.round(F.col("n") / F.sum("n").over(w), 4))
            .withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "problem"))).where(F.col("rank") <= k))


def normalized_text(text: Column) -> Column:
    """Lower-case letters and single spaces only: copies that differ by
    punctuation, digits, case or spacing normalise to the same string."""
    t = F.regexp_replace(F.lower(text), r"[^\p{L}\s]", "")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def fake_series(reviews: DataFrame, min_size: int = 2) -> DataFrame:
    """Series of reviews with identical normalised vocabulary: one shuffle
    keyed by the hash of the whole normalised text (no pairwise join, so a
    very frequent text is just a large group, combined map-side)."""
    k = _once(reviews.withColumn("_h", F.sha2(normalized_text(F.col("text")), 256)))  # grouped and joined back
    g = k.groupBy("_h").agg(F.min("review_id").alias("series_id"), F.count(F.lit(1)).alias("size"),
                            F.count_distinct("sku").alias("skus"))
    g = g.where(F.col("size") >= min_size)
    return k.join(g, "_h").select("review_id", "sku", "series_id", "size", "skus")


def suspect_reviews(reviews: DataFrame, series: DataFrame) -> DataFrame:
    """Complaint candidates: a review in a same-vocabulary series, or one
    that mentions a competitor, or accuses beyond the product."""
    inser = series.select("review_id", F.lit(True).alias("in_series")).distinct()
    r = reviews.join(inser, "review_id", "left").select(
        "review_id", "sku", F.coalesce("in_series", F.lit(False)).alias("in_series"),
        F.col("text").rlike(COMPETITOR_PATTERN).alias("competitor_mention"),
        F.col("text").rlike(OFF_PRODUCT_PATTERN).alias("off_product"))
    return r.withColumn("complaint_candidate", F.col("in_series") | F.col("competitor_mention") | F.col("off_product"))


def lint_replies(replies: DataFrame, banned: list[str] | None = None) -> DataFrame:
    """Violations per reply ``(reply_id, stars, reply, author?)``: client name
    used, exclamation in a negative, banned phrases, competitor mention,
    private discount/gift promise, sentence count outside the star band."""
    banned = BANNED_REPLY_PHRASES if banned is None else banned
    sentences = F.size(F.filter(F.split(F.trim("reply"), r"[.!?]+"), lambda s: F.length(F.trim(s)) > 0))
    band = F.array(*[F.struct(F.lit(s).alias("stars"), F.lit(a).alias("lo"), F.lit(b).alias("hi"))
                     for s, _, a, b in TONE])
    b = F.get(F.filter(band, lambda x: x["stars"] == F.col("stars")), F.lit(0))  # null outside 1-5
    no_band = ~F.coalesce(F.col("stars").between(1, 5), F.lit(False))
    low = F.lower(F.col("reply"))
    banned_hit = F.lit(False)
    for w in banned:
        banned_hit = banned_hit | low.contains(w)
    name_used = (F.coalesce(F.length("author") > 0, F.lit(False)) & F.col("reply").contains(F.col("author"))
                 if "author" in replies.columns else F.lit(False))
    reasons = F.array_compact(F.array(
        F.when(F.coalesce(name_used, F.lit(False)), F.lit("client_name")),
        F.when((F.col("stars") <= 2) & F.col("reply").contains("!"), F.lit("exclamation_in_negative")),
        F.when(banned_hit, F.lit("banned_cliche")),
        F.when(F.col("reply").rlike(COMPETITOR_PATTERN), F.lit("competitor_mention")),
        F.when(F.col("reply").rlike(PRIVATE_PROMISE_PATTERN), F.lit("private_promise")),
        F.when((sentences < b["lo"]) | (sentences > b["hi"]), F.lit("sentence_count")),
        F.when(no_band, F.lit("quarantine_stars"))))
    return replies.select("reply_id", "stars", sentences.alias("sentences"), reasons.alias("violations"))


# D1–D3 ------------------------------------------------------------------------
def card_checks(cards: DataFrame) -> DataFrame:
    """One row per (card, block): ok flag and measured value."""
    low = F.lower("title")
    stop = F.lit(False)
    for w in TITLE_STOP_WORDS:
        stop = stop | low.contains(w)
    names = F.transform("attributes", lambda a: a["name"])
    missing = F.size(F.array_except(F.array(*[F.lit(n) for n in REQUIRED_ATTRIBUTES]), names))
    dup = F.size(names) - F.size(F.array_distinct(names))
    title_max = F.when(F.col("mp") == "WB", F.lit(TITLE_MAX["WB"])).otherwise(F.lit(TITLE_MAX["Ozon"]))
    checks = [
        ("title_length", F.length("title") <= title_max, F.length("title")),
        ("description_length", F.length("description").between(DESC_MIN, DESC_MAX), F.length("description")),
        ("slides", F.col("slides").between(*SLIDES), F.col("slides")),
        ("photos", F.col("photos").between(*PHOTOS), F.col("photos")),
        ("video", F.coalesce(F.col("video_sec").between(*VIDEO), F.lit(False)), F.col("video_sec")),
        ("price_index", F.coalesce(F.col("price_index") < PRICE_INDEX_MAX, F.lit(True)), F.col("price_index")),
        ("title_stop_words", ~stop, stop.cast("int")),
        ("attributes_complete", missing == 0, missing),
        ("attributes_unique", dup == 0, dup),
        ("unanswered_negatives", F.coalesce(F.col("unanswered_negatives") == 0, F.lit(True)),
         F.col("unanswered_negatives")),
    ]
    arr = F.array(*[F.struct(F.lit(n).alias("block"), ok.alias("ok"), v.cast("long").alias("value"))
                    for n, ok, v in checks])
    return cards.select("card_id", F.inline(arr))


def keyword_stats(cards: DataFrame) -> DataFrame:
    """Title words (length >= 4) counted in the description: hits, density."""
    words = F.split(F.lower("description"), r"[^\p{L}\p{N}]+")
    words = F.filter(words, lambda w: F.length(w) > 0)
    keys = F.array_distinct(F.filter(F.split(F.lower("title"), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 4))
    x = cards.select("card_id", "title", words.alias("_w"), keys.alias("_k"))
    hits = F.size(F.filter("_w", lambda w: F.array_contains(F.col("_k"), w)))
    # top-3 keys: the title keys most frequent in the description (ties by key)
    freq = F.transform("_k", lambda k: F.struct(F.size(F.filter("_w", lambda w: w == k)).alias("n"), k.alias("k")))
    top3 = F.slice(F.transform(F.sort_array(F.transform(freq, lambda x: F.struct((-x["n"]).alias("m"), x["k"].alias("k")))),
                               lambda x: x["k"]), 1, 3)
    head = F.lower(F.substring("title", 1, TITLE_HEAD))
    x = x.withColumn("_top3", top3).withColumn("_head", head)
    top_in_head = F.forall("_top3", lambda k: F.col("_head").contains(k))
    x = x.select("card_id", F.size("_w").alias("words"), F.size("_k").alias("keys"), hits.alias("key_hits"),
                 top_in_head.alias("top3_in_head"))
    dens = F.when(F.col("words") > 0, F.col("key_hits") / F.col("words"))
    return x.withColumn("density", F.round(dens, 4)).withColumn("spam", F.coalesce(dens > KEY_DENSITY_SPAM, F.lit(False)))


BLOCK_WEIGHTS = [("title_length", 3), ("description_length", 2), ("slides", 2), ("photos", 3), ("video", 1),
                 ("price_index", 3), ("title_stop_words", 2), ("attributes_complete", 3), ("attributes_unique", 1),
                 ("unanswered_negatives", 2)]


def card_scorecard(checks: DataFrame, k: int = 5) -> DataFrame:
    w = F.broadcast(checks.sparkSession.createDataFrame(BLOCK_WEIGHTS, "block string, weight int"))
    x = checks.join(w, "block").withColumn("score", F.when(F.col("ok"), 10).otherwise(0))
    x = x.withColumn("priority", F.when(F.col("ok"), "none").when(F.col("weight") >= 3, "critical")
                     .when(F.col("weight") == 2, "medium").otherwise("cosmetic"))
    r = Window.partitionBy("card_id").orderBy(F.desc(F.col("weight") * (10 - F.col("score"))), "block")
    return (x.where(~F.col("ok")).withColumn("rank", F.row_number().over(r)).where(F.col("rank") <= k)
            .select("card_id", "block", "priority", "weight", "rank"))


# G1 / G2 ----------------------------------------------------------------------
ROUTER_SCHEMA = "agent string, reason string, confidence double, reply string"


def parse_router_outputs(raw: DataFrame) -> DataFrame:
    """Strict JSON: the whole text is one object on one line with all four
    keys (a null ``agent`` or ``reply`` is a value, a missing key is not);
    anything else, an unknown agent or a confidence outside [0, 1] ->
    ``quarantine``, with null fields if the text is not such an object."""
    keys = F.array(*[F.lit(f.split()[0]) for f in ROUTER_SCHEMA.split(", ")])
    line = ~F.coalesce(F.col("raw").rlike(r"[\r\n]"), F.lit(True))
    # as the only element of an array the text may have nothing after the object
    whole = F.coalesce(F.json_array_length(F.concat(F.lit("["), "raw", F.lit("]"))) == 1, F.lit(False))
    has = F.size(F.array_except(keys, F.coalesce(F.json_object_keys("raw"), F.array().cast("array<string>")))) == 0
    p = raw.withColumn("_ok_json", line & whole & has)
    p = p.withColumn("o", F.when(F.col("_ok_json"), F.from_json("raw", ROUTER_SCHEMA)))
    agent_ok = F.col("o.agent").isNull() | F.col("o.agent").isin(*AGENTS)
    conf_ok = F.col("o.confidence").between(0.0, 1.0)
    good = F.col("_ok_json") & agent_ok & F.coalesce(conf_ok, F.lit(False))
    return p.select("request_id", F.col("o.agent").alias("agent"), F.col("o.reason").alias("reason"),
                    F.col("o.confidence").alias("confidence"), F.col("o.reply").alias("reply"),
                    F.when(good, "ok").otherwise("quarantine").alias("status"))


def resolve_routes(parsed: DataFrame) -> DataFrame:
    """Per request: injection -> refuse (1.0); any null agent -> refuse;
    confidence < 0.5 -> clarify; else the highest-priority candidate."""
    pr = F.array(*[F.lit(a) for a in ROUTE_PRIORITY])
    ok = parsed.where(F.col("status") == "ok").withColumn("_prio", F.array_position(pr, F.col("agent")))
    inj = F.lower(F.coalesce(F.col("reason"), F.lit(""))).contains("injection")
    g = ok.groupBy("request_id").agg(
        F.max(inj.cast("int")).alias("_inj"), F.max(F.col("agent").isNull().cast("int")).alias("_off"),
        F.min_by("agent", F.struct(F.coalesce(F.col("_prio"), F.lit(99)), "agent")).alias("_best"),
        F.min_by("confidence", F.struct(F.coalesce(F.col("_prio"), F.lit(99)), "agent")).alias("_conf"))
    return g.select("request_id",
                    F.when(F.col("_inj") == 1, "refuse_injection").when(F.col("_off") == 1, "refuse_off_domain")
                    .when(F.col("_conf") < CONFIDENCE_MIN, "clarify").otherwise("route").alias("decision"),
                    F.when((F.col("_inj") == 0) & (F.col("_off") == 0) & (F.col("_conf") >= CONFIDENCE_MIN),
                           F.col("_best")).alias("agent"))


# V3 near copies -----------------------------------------------------------------
def vocabulary(text: Column) -> Column:
    """Distinct words of the normalised text."""
    return F.array_distinct(F.filter(F.split(normalized_text(text), " "), lambda w: F.length(w) > 0))


PARITY = 4  # longs of a text's parity bits
WIDE = PARITY * 64 * 8 // 5  # texts of more words than this have more bits in ``wide``
RARE_OFF = 3  # most words that ``certain_groups`` leaves out


HEAD_WORDS = 1 << 17  # most words whose counts are broadcast
FEWEST_PARTS = 16  # of a group of words
GROUP = 48  # words of a group in the longest text of its class
MARKS = 1 << 18  # most longs of a broadcast bitmap
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def frequent_words(counts: DataFrame, most: int = HEAD_WORDS) -> DataFrame:
    """The words (w, df) of at least some number of texts, at most ``most``:
    found on a histogram of counts in steps of 1/16 octave, no sort."""
    step, n, least = F.floor(F.log2("df") * 16), 0, None
    for r in counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("s")).collect():
        n += r["c"]
        if n > most:
            break
        least = r["s"]
    return counts.where(step >= least if least is not None else F.lit(False))


def described_texts(words: DataFrame, head: DataFrame, threshold: float) -> DataFrame:
    """``described`` of ``words (rid, w)``, the distinct words of texts."""
    return described(words.groupBy("rid").agg(F.collect_list("w").alias("voc")), head, threshold)


def _mixed(w: np.ndarray, seed: int) -> np.ndarray:
    w = (w + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    w = (w ^ (w >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    w = (w ^ (w >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return w ^ (w >> np.uint64(31))


def _order(*keys: np.ndarray) -> np.ndarray:
    """Stable order by ``keys`` (not negative, the first one leads): sorted as
    one long if they fit."""
    bits = [int(k.max(initial=0)).bit_length() for k in keys]
    at = len(keys[0]).bit_length()
    if sum(bits) + at > 63:
        return np.lexsort(keys[::-1])
    x = np.zeros(len(keys[0]), np.int64)
    for k, b in zip(keys, bits):
        x = (x << b) | k
    x = (x << at) | np.arange(len(x))
    x.sort()
    return x & ((1 << at) - 1)


def _parts(n: np.ndarray, doc: np.ndarray, u: np.ndarray, weight: np.ndarray, pos: np.ndarray,
           threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts of ``n`` words ``u`` -> (doc, key, pos, some) of the parts that bring
    two texts together.

    All words are dealt to groups, and those of a group to m parts, by hash.  Of
    s groups, two texts that differ in at most d words differ in at most d / s in
    one; there they have at least m - d / s parts with the same words, so they
    share one among the first d / s + 1 parts of each in any one order of parts:
    here the heaviest first, then by number; a part's weight is that of its words
    (the rarer, the heavier), so words in many texts come in company or not at
    all.  s and m follow from the class (power of two) of the longer text, so a
    text near the end of its class has parts for the next one also.  ``pos`` is
    the place of the part's first word in its text, 0 for an empty part;
    ``some`` are 64 parity bits of its group's words (``few_in_group``)."""
    r = (1 - threshold) / (1 + threshold)
    own = np.frexp(n.astype(float))[1]
    last = np.frexp(np.floor(n / threshold + 1e-9))[1]  # class of the longest text within the threshold
    where, content, out = _mixed(u, 3), _mixed(u, 4), []
    flip = np.uint64(1) << (_mixed(u, 7) & np.uint64(63))
    name = lambda k, part, x: _mixed(x ^ _mixed(part + (k << np.uint64(32)), 5), 6)
    for step in range(int((last - own).max()) + 1):
        mine, top = own + step <= last, (1 << (own + step).astype(np.int64)) - 1
        s = np.maximum(top // GROUP, 1)
        cap = (np.floor(2 * top * r + 1e-9) // s).astype(np.int64)
        m = np.maximum(cap + cap // 2 + 1, FEWEST_PARTS)
        keep = (np.floor(np.minimum(n * (1 - threshold) / threshold, (n + top) * r) + 1e-9) // s).astype(np.int64) + 1
        at = np.flatnonzero(mine[doc])
        if not len(at):
            continue
        d = doc[at]
        part = (where[at] % (m * s)[d].astype(np.uint64)).astype(np.int64)
        o = _order(d, part)  # the first word of a part is its rarest
        at, d, part = at[o], d[o], part[o]
        k, groups = (own + step).astype(np.uint64), np.where(mine, s, 0)
        begin = np.cumsum(groups) - groups  # groups are numbered through the batch
        group = begin[d] + part // m[d]
        edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        bits = np.zeros(int(groups.sum()), np.uint64)
        bits[group[edge]] = np.bitwise_xor.reduceat(flip[at], edge)
        edge = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (part[1:] != part[:-1])])
        d, part, group, first = d[edge], part[edge], group[edge], pos[at][edge]
        key = name(k[d], part.astype(np.uint64), np.bitwise_xor.reduceat(content[at], edge))
        light = np.add.reduceat(weight[at], edge)
        o = _order(group, light.max() - light)
        have = np.bincount(group, minlength=len(bits))
        ends = np.cumsum(have)
        kept = o[np.arange(len(o)) - (ends - have)[group[o]] < keep[d[o]]]
        out.append((d[kept], key[kept], first[kept], bits[group[kept]]))
        of = np.repeat(np.arange(len(n)), groups)
        for g in np.flatnonzero(have < keep[of]):  # empty parts come last, by number; seldom reached
            i = of[g]
            none = np.arange(m[i]) + (g - begin[i]) * m[i]
            none = np.setdiff1d(none, part[ends[g] - have[g]:ends[g]])[:keep[i] - have[g]].astype(np.uint64)
            zero = np.zeros(len(none), np.uint64)
            out.append((np.full(len(none), i), name(k[i], none, zero), np.zeros(len(none), np.int64), zero + bits[g]))
    d, key, first, some = (np.concatenate(x) for x in zip(*out))
    o = np.argsort(d, kind="stable")
    return d[o], key[o], first[o], some[o]


def few_in_group(threshold: float) -> Column:
    """Two texts of (na, nb) words that share a part may reach the threshold by
    the parity bits (sa, sb) of its group."""
    longer = F.pow(F.lit(2.0), F.length(F.bin(F.greatest("na", "nb")))) - 1
    most = F.floor((F.col("na") + F.col("nb")) * F.lit((1 - threshold) / (1 + threshold)) + 1e-9)
    return F.bit_count(F.col("sa").bitwiseXOR(F.col("sb"))) <= most / F.greatest(F.floor(longer / GROUP), F.lit(1))


def described(texts: DataFrame, head: DataFrame, threshold: float) -> DataFrame:
    """``texts (rid, voc)`` with one or more distinct words each -> one row per
    text: its size n, the prefix, parity bits and remainders; no shuffle.

    Words are ordered from rare to frequent: those outside ``head`` (w, df) by
    hash, then the head by the number of texts.  ``prefix`` holds the parts of
    a text (``_parts``) of which two texts with Jaccard >= threshold share one,
    as (w, pos, some): the part's hash, its rarest word's place and bits of its
    group.  Every word flips one
    of 256 ``bits``: two texts differ in at least as many words as bits.  They
    fill up in long texts, so a text of more than WIDE words also has ``wide``
    bits, a power of two in proportion to its words.  ``rest`` holds two hashes
    of the text without its 0, 1... rarest words."""
    top = head.toArrow()  # at most HEAD_WORDS rows
    hw, hdf = top["w"].to_numpy(), top["df"].to_numpy()
    o = np.argsort(hw)
    most = 2 * max(hdf, default=1)
    weights = np.round(256 * np.log2(most / np.maximum(hdf[o], 1))).astype(np.int64)
    shared = texts.sparkSession.sparkContext.broadcast((hw[o], hdf[o], weights, round(256 * math.log2(most))))

    def run(batches):
        hw, hdf, weights, heaviest = shared.value
        for batch in batches:
            w, n = batch.column(1).flatten().to_numpy(), batch.column(1).value_lengths().to_numpy().astype(np.int64)
            if not len(n):
                continue
            doc, df, weight = np.repeat(np.arange(len(n)), n), np.zeros(len(w), np.int64), np.full(len(w), heaviest)
            if len(hw):
                at = np.minimum(np.searchsorted(hw, w), len(hw) - 1)
                df, weight = np.where(hw[at] == w, hdf[at], 0), np.where(hw[at] == w, weights[at], heaviest)
            order = _order(doc, df)  # words come sorted
            w = w[order]
            start = np.cumsum(n) - n
            u = w.view(np.uint64)
            of, key, pos, some = _parts(n, doc, u, weight[order], np.arange(len(w)) - start[doc], threshold)
            prefix = pa.StructArray.from_arrays([pa.array(key.view(np.int64)), pa.array(pos.astype(np.int32)), pa.array(some.view(np.int64))],
                                                    names=["w", "pos", "some"])
            keep = np.bincount(of, minlength=len(n))
            flip, slot = np.uint64(1) << (u & np.uint64(63)), u >> np.uint64(6)

            def parity(size, mine):
                """Bits in ``size`` longs per text, of the texts ``mine``."""
                edge = np.concatenate([[0], np.cumsum(size)])
                out, some = np.zeros(edge[-1], np.uint64), mine[doc]
                d = doc[some]
                np.bitwise_xor.at(out, edge[d] + (slot[some] & (size[d] - 1).astype(np.uint64)).astype(np.int64), flip[some])
                return pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(out.view(np.int64)))

            long = n > WIDE
            longs = np.where(long, PARITY << np.ceil(np.log2(np.maximum(n, WIDE) / WIDE)).astype(np.int64), 0)
            xs = [np.bitwise_xor.reduceat(_mixed(u, seed), start) for seed in (1, 2)]
            rest = []
            for k in range(RARE_OFF + 1):
                rest.append([n - k, np.full(len(n), k), *xs])
                gone = u[np.minimum(start + k, len(u) - 1)]
                xs = [x ^ np.where(k < n, _mixed(gone, seed), 0).astype(np.uint64) for x, seed in zip(xs, (1, 2))]
            r, k, a, b = (np.stack([x[i] for x in rest], 1).ravel() for i in range(4))
            rest = pa.StructArray.from_arrays([pa.array(r.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(a.view(np.int64)),
                                               pa.array(b.view(np.int64))], names=["r", "k", "a", "b"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n.astype(np.int32)), parity(np.full(len(n), PARITY), np.ones(len(n), bool)), parity(longs, long),
                 pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(keep)]).astype(np.int32)), prefix),
                 pa.ListArray.from_arrays(pa.array((np.arange(len(n) + 1) * (RARE_OFF + 1)).astype(np.int32)), rest)],
                names=["rid", "n", "bits", "wide", "prefix", "rest"])

    rid = texts.schema["rid"].dataType.simpleString()
    return texts.select("rid", F.sort_array("voc")).mapInArrow(run, f"rid {rid}, n int, bits array<long>, wide array<long>, prefix array<struct<w:long,pos:int,some:long>>, "
                                                      "rest array<struct<r:int,k:int,a:long,b:long>>")


def _few(differ: Column, threshold: float) -> Column:
    """Two texts of (na, nb) words may differ in that many and reach the threshold."""
    return differ <= (F.col("na") + F.col("nb")) * F.lit((1 - threshold) / (1 + threshold)) + 1e-9


def near_by_wide_bits(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """``pairs (a, b, na, nb, ...)`` that may reach the threshold by their wide
    bits.  Sizes are powers of two: the longer one is folded onto the shorter."""
    def fold(x, y):
        h = F.greatest((F.size(x) / 2).cast("int"), F.lit(1))
        return F.when(F.size(x) > F.size(y), F.zip_with(F.slice(x, F.lit(1), h), F.slice(x, h + 1, h), lambda p, q: p.bitwiseXOR(q))).otherwise(F.col(x))

    both = F.least("na", "nb") > WIDE
    wide = texts.where(F.col("n") > WIDE)
    x = pairs.where(both).join(wide.select(F.col("rid").alias("a"), F.col("wide").alias("_wa")), "a") \
        .join(wide.select(F.col("rid").alias("b"), F.col("wide").alias("_wb")), "b")
    bits = F.zip_with(fold("_wa", "_wb"), fold("_wb", "_wa"), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    x = x.where(_few(F.aggregate(bits, F.lit(0), lambda s, c: s + c), threshold))
    return pairs.where(~both).unionByName(x.select(*pairs.columns))


def may_reach(threshold: float) -> Column:
    """Bounds on a pair that shares a word at positions (pa, pb) of its (na,
    nb) words: ``by_place``, and the words that differ at least (parity bits
    ba, bb)."""
    differ = sum((F.bit_count(F.col("ba")[i].bitwiseXOR(F.col("bb")[i])) for i in range(PARITY)), F.lit(0))
    return by_place(threshold) & _few(differ, threshold)


def by_place(threshold: float) -> Column:
    """The sizes, and the overlap that can still follow."""
    na, nb = F.col("na"), F.col("nb")
    least = F.ceil((na + nb) * F.lit(threshold / (1 + threshold)) - 1e-9)
    here = F.least(F.col("pa"), F.col("pb")) + F.least(na - F.col("pa"), nb - F.col("pb"))
    return (F.least(na, nb) >= F.greatest(na, nb) * F.lit(threshold) - 1e-9) & (here >= least)


def certain_groups(texts: DataFrame, threshold: float) -> DataFrame:
    """(x, y) links without a comparison: texts that have the same words but
    for up to k of their rarest, with k small enough that any two of them reach
    the threshold.  Each group is a star on its least text."""
    g = texts.select("rid", F.explode("rest").alias("_g")).select("rid", "_g.*")
    g = g.where((F.col("r") > 0) & (F.col("k") <= F.col("r") * F.lit((1 - threshold) / (2 * threshold)) + 1e-9))
    least = g.groupBy("r", "a", "b").agg(F.min("rid").alias("y"), F.count(F.lit(1)).alias("c")).where("c > 1")
    return g.join(least, ["r", "a", "b"]).where("rid != y").select(F.col("rid").alias("x"), "y").distinct()


def marked(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` is in ``keys``.  A bitmap of hashed keys is
    broadcast first (MARKS longs at most), so that few other rows are shuffled."""
    slot = F.expr(f"cast(shiftrightunsigned(xxhash64({key}), 6) % {MARKS} as int)")
    bit = F.expr(f"shiftleft(1L, cast(xxhash64({key}) & 63 as int))")
    marks = keys.select(slot.alias("_slot"), bit.alias("_bit")).groupBy("_slot").agg(F.bit_or("_bit").alias("_marks"))
    some = rows.withColumn("_slot", slot).join(F.broadcast(marks), "_slot").where(F.col("_marks").bitwiseAND(bit) != 0)
    return some.drop("_slot", "_marks").join(keys, key, "left_semi")


def near_copy_series(reviews: DataFrame, threshold: float = 0.8, growth: int = 16) -> DataFrame:
    """Series of reviews whose vocabularies are near-identical (Jaccard >=
    ``threshold``): a set-similarity join by prefix filtering, without comparing
    all pairs.

    1. Identical vocabularies collapse to one representative; texts that are
       equal but for a few of their rarest words are linked as stars
       (``certain_groups``).
    2. The words are dealt to parts, and the rarest parts of every text put
       texts into buckets (``_parts``): texts that share frequent words only
       seldom meet.  A pair of a bucket becomes a row only if its sizes, the
       positions of the part's rarest word and some of its bits let it reach the
       threshold; then all its bits count, of which long texts have more.  What is
       left is verified by the exact Jaccard.
    3. Buckets are worked off in rounds: leaders meet the members of other
       series, ``growth`` times as many leaders each round; a bucket is done
       when its members are one series or all have led.  No pair within the
       threshold is lost, and a bucket of near copies is done after one round.
    4. Series are merged by connected components, which raise if they do not
       converge.

    Words are compared by 64-bit hashes.  Intermediate tables go to the shared
    checkpoint folder.  Vocabularies are written once and only those of pairs
    to verify are moved; shuffle files go as soon as their table is written."""
    spark = reviews.sparkSession
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        return _near_copy_series(reviews, threshold, growth)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


def _near_copy_series(reviews: DataFrame, threshold: float, growth: int) -> DataFrame:
    spark = reviews.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/near-copies-{uuid.uuid4().hex}"

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    v = reviews.select("review_id", "sku", F.transform(vocabulary(F.col("text")), lambda w: F.xxhash64(w)).alias("_voc"))
    v = v.withColumn("_voc", F.sort_array("_voc"))
    v = stored(v.withColumn("_vh", F.struct(F.xxhash64(F.lit(1), "_voc").alias("a"), F.xxhash64(F.lit(2), "_voc").alias("b")))
               .withColumn("_row", F.monotonically_increasing_id()), "vocabularies")
    reps = stored(v.where(F.size("_voc") > 0).groupBy("_vh").agg(F.min(F.struct(F.col("review_id").alias("rid"), "_row")).alias("_m"))
                  .select("_vh", "_m.*"), "reps")
    voc = v.where(F.size("_voc") > 0).select("_row", F.col("_voc").alias("voc"))
    words = voc.select(F.explode("voc").alias("w"))
    counts = stored(words.groupBy("w").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "counts")
    # every review is described where it lies; only then are representatives picked
    texts_of_all = stored(described(voc.withColumnRenamed("_row", "rid"), frequent_words(counts), threshold).withColumnRenamed("rid", "_row"), "texts")
    texts = texts_of_all.join(reps.select("_row", "rid"), "_row")
    labels = reps.select("rid", F.col("rid").alias("label"))

    def merged(labels: DataFrame, links: DataFrame, step: int) -> DataFrame:
        if links.isEmpty():
            return labels
        out = relabel(labels.select(F.col("rid").alias("id"), F.col("label").alias("class")), connected(links, f"{folder}/merge-{step}"))
        return stored(out.select(F.col("id").alias("rid"), F.col("class").alias("label")), f"labels-{step}")

    labels = merged(labels, stored(certain_groups(texts, threshold), "stars"), 0)
    bucket = Window.partitionBy("w")
    entries = texts_of_all.select("_row", F.explode("prefix").alias("_p")).select("_row", "_p.*")
    entries = stored(entries.withColumn("_c", F.count(F.lit(1)).over(bucket)).where("_c > 1").drop("_c"), "shared")  # a part of one text makes no pair
    named = labels.join(texts.select("_row", "rid", "n"), "rid")
    entries, last = entries.join(named, "_row").select("rid", "label", "n", "w", "pos", "some"), "shared"
    done, upto, step = 0, growth, 0
    while True:
        step += 1
        open_ = entries.withColumns({"_lo": F.min("label").over(bucket), "_hi": F.max("label").over(bucket), "_c": F.count(F.lit(1)).over(bucket)})
        open_ = open_.where((F.col("_lo") != F.col("_hi")) & (F.col("_c") > done))
        members = stored(open_.drop("_lo", "_hi", "_c"), f"open-{step}")  # a settled bucket stays settled
        drop_folder(spark, f"{folder}/{last}")
        last = f"open-{step}"
        if members.isEmpty():
            break
        # one shuffle by part for leaders and members alike: the same filter on both sides, or it is not reused
        now = members.dropna().repartition("w")
        rank = F.row_number().over(Window.partitionBy("w").orderBy("n", "rid"))
        lead = now.withColumn("_r", rank).where(F.col("_r") <= upto).where(F.col("_r") > done)
        lead = lead.select("w", F.col("rid").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"),
                           F.col("pos").alias("pa"), F.col("some").alias("sa"))
        # a member that ranks before the leader has met it as a leader itself
        after = (F.col("nb") > F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("b") > F.col("a")))
        pairs = (now.select("w", F.col("rid").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("some").alias("sb"))
                 .join(lead, "w").where((F.col("la") != F.col("lb")) & after & by_place(threshold) & few_in_group(threshold))
                 .groupBy("a", "b", "la", "lb", "na", "nb").agg(F.min(F.struct("pa", "pb")).alias("_p")).select("a", "b", "la", "lb", "na", "nb", "_p.*"))
        bits = texts.select("rid", "bits")
        pairs = stored(pairs, f"pairs-{step}").join(bits.toDF("a", "ba"), "a").join(bits.toDF("b", "bb"), "b").where(may_reach(threshold))
        pairs = pairs.select("a", "b", "la", "lb", "na", "nb").distinct()
        pairs = stored(near_by_wide_bits(pairs, texts, threshold).select("a", "b", "la", "lb"), f"near-{step}")
        # only the vocabularies of these pairs are moved
        need = pairs.select(F.col("a").alias("rid")).union(pairs.select(F.col("b").alias("rid"))).distinct()
        need = stored(need.join(reps.select("rid", "_row"), "rid"), f"need-{step}")
        some = marked(voc, need.select("_row"), "_row").join(need, "_row")
        some = stored(some.select("rid", "voc"), f"verified-{step}")
        va = some.select(F.col("rid").alias("a"), F.col("voc").alias("va"))
        vb = some.select(F.col("rid").alias("b"), F.col("voc").alias("vb"))
        j = F.size(F.array_intersect("va", "vb")) / F.size(F.array_union("va", "vb"))
        links = stored(pairs.join(va, "a").join(vb, "b").where(j >= threshold)
                       .select(F.col("la").alias("x"), F.col("lb").alias("y")).distinct(), f"links-{step}")
        done, upto = upto, upto * growth
        labels = merged(labels, links, step)
        entries = members.drop("label").join(labels, "rid")
    # expand representatives back to every review with that vocabulary
    lab = reps.join(labels, "rid").select("_vh", F.col("label").alias("series_id"))
    m = v.join(lab, "_vh")
    g = m.groupBy("series_id").agg(F.count(F.lit(1)).alias("size"), F.count_distinct("sku").alias("skus"))
    return (m.join(g.where(F.col("size") >= 2), "series_id")
            .select("review_id", "sku", "series_id", "size", "skus"))
