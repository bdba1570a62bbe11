"""C3, D1-D3 over histories and nested parts: price runs of offers, the token
index of cards, photo and visibility checks, graded block scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import DAY
from ..functions.windows import adaptive_chunk, chunked_lag, chunked_running
from .market import (DESC_MAX, DESC_MIN, KEY_COUNT, KEY_DENSITY_SPAM, OTHER_LEAGUE_FACTOR, PHOTOS, PRICE_INDEX_MAX, REQUIRED_ATTRIBUTES, SLIDES,
                     TITLE_MAX, TITLE_STOP_WORDS, VIDEO)

# Fixed values of the card rules: least photo size, queries of the visibility
# check, and points (last position, points) of a search position.
PHOTO_MIN = (900, 1200)
VISIBILITY_QUERIES = 5
POSITION_POINTS = [(10, 10), (20, 7), (50, 4), (100, 1)]


# C3 -------------------------------------------------------------------------
def price_runs(observations: DataFrame) -> DataFrame:
    """Dated offers ``(sku, competitor, obs_id, seen_at, price)`` -> runs of
    equal price: (sku, competitor, run, price, from_ts, to_ts, observations,
    discounted).  A run is discounted if it is cheaper than the run before it.
    The order windows are chunked by month, so an offer seen very often does
    not become one task."""
    key, order = ["sku", "competitor"], ["seen_at", "obs_id"]
    d = adaptive_chunk(observations, key, "seen_at", "_chunk", base_s=30 * DAY, fine_s=DAY)
    d = chunked_lag(d, key, order, "_chunk", "price", "_prev")
    new = (F.col("_prev").isNull() | (F.col("price") != F.col("_prev"))).cast("int")
    d = chunked_running(d, key, order, "_chunk", new, "run")
    # the first row of a run still knows the price before it
    first = F.min_by(F.col("_prev") > F.col("price"), F.struct(*order))
    return d.groupBy(*key, "run").agg(F.min("price").alias("price"), F.min("seen_at").alias("from_ts"), F.max("seen_at").alias("to_ts"),
                                      F.count(F.lit(1)).alias("observations"), F.coalesce(first, F.lit(False)).alias("discounted"))


def price_reference(runs: DataFrame, own: DataFrame) -> DataFrame:
    """Per offer: its present price and share of discounted observations,
    against the other offers of the SKU (the offer itself is not in their mean)
    and against the own offer, ``own (sku, competitor)``."""
    o = runs.groupBy("sku", "competitor").agg(
        F.max_by("price", "run").alias("price"), F.max("run").alias("runs"), F.sum("observations").alias("_n"),
        F.sum(F.when(F.col("discounted"), F.col("observations")).otherwise(0)).alias("_d"))
    w = Window.partitionBy("sku")  # one row per offer of a SKU
    others = (F.sum("price").over(w) - F.col("price")) / (F.count(F.lit(1)).over(w) - 1)
    many = F.count(F.lit(1)).over(w) > 1
    mine = own.select("sku", F.col("competitor").alias("_own"))
    o = o.join(mine, "sku", "left").withColumns({
        "discount_freq": F.round(F.col("_d") / F.col("_n"), 4), "_mean": F.when(many, others), "pct_rank": F.round(F.percent_rank().over(w.orderBy("price")), 4),
        "is_own": F.coalesce(F.col("competitor") == F.col("_own"), F.lit(False))})
    own_price = F.max(F.when(F.col("is_own"), F.col("price"))).over(w)
    return o.select("sku", "competitor", "price", "runs", "discount_freq", F.round(F.col("price") / F.col("_mean"), 4).alias("vs_others"), "pct_rank",
                    "is_own", F.round(F.col("price") / own_price, 4).alias("vs_own"),
                    F.coalesce(F.col("price") >= OTHER_LEAGUE_FACTOR * F.col("_mean"), F.lit(False)).alias("other_league"))


# D2 -------------------------------------------------------------------------
def _words(c: str) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)


def token_index(cards: DataFrame) -> DataFrame:
    """Positional index of the descriptions: (card_id, token, n, positions).
    Whole descriptions are shuffled by card, never single words; the partitions
    are not merged by their size, as their words take more."""
    n = int(cards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = cards.select("card_id", "description").repartition(n, "card_id").select("card_id", F.posexplode(_words("description")).alias("pos", "token"))
    return at.groupBy("card_id", "token").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("pos")).alias("positions"))


def key_stats(cards: DataFrame, index: DataFrame) -> DataFrame:
    """Each title key (words of four letters or more) in its card's index: uses,
    first position, share of the words, whether used 8 to 12 times, spam.  The
    index is met by card, where it lies; only entries of keys move on."""
    keys = F.array_distinct(F.filter(_words("title"), lambda w: F.length(w) >= 4))
    k = cards.select("card_id", F.explode(keys).alias("token"))
    mine = k.groupBy("card_id").agg(F.collect_set("token").alias("_keys"))
    words = index.groupBy("card_id").agg(F.sum("n").alias("words"))
    used = index.join(mine, "card_id").where(F.array_contains("_keys", F.col("token"))).select(
        "card_id", "token", "n", F.get("positions", F.lit(0)).alias("first_pos"))
    x = k.join(used, ["card_id", "token"], "left").join(words, "card_id", "left")
    n = F.coalesce("n", F.lit(0).cast("long"))
    share = F.when(F.col("words") > 0, n / F.col("words"))
    return x.select("card_id", F.col("token").alias("key"), n.alias("n"), "first_pos",
                    F.round(share, 4).alias("density"), n.between(*KEY_COUNT).alias("in_band"), F.coalesce(share > KEY_DENSITY_SPAM, F.lit(False)).alias("spam"))


# D1 -------------------------------------------------------------------------
def media_checks(cards: DataFrame) -> DataFrame:
    """Blocks of ``photos (array of width, height, white)``: every photo large
    enough (value: how many are not), the first on white."""
    def large(p):
        return (p["width"] >= PHOTO_MIN[0]) & (p["height"] >= PHOTO_MIN[1])

    small = F.size(F.filter("photos", lambda p: ~large(p)))
    white = F.coalesce(F.get("photos", F.lit(0))["white"], F.lit(False))
    rows = F.array(F.struct(F.lit("photo_size").alias("block"), ((F.size("photos") > 0) & F.forall("photos", large)).alias("ok"), small.cast("long").alias("value")),
                   F.struct(F.lit("main_photo_white").alias("block"), white.alias("ok"), white.cast("long").alias("value")))
    return cards.select("card_id", F.inline(rows))


def visibility(positions: DataFrame) -> DataFrame:
    """``positions (card_id, query, position)`` -> (card_id, queries, points):
    mean points of the five key queries; null unless there are exactly five
    (the user is asked for the rest).  A query that does not show the card has
    a null position and no points; repeated rows count once, at their best."""
    pts = F.lit(0)
    for last, p in reversed(POSITION_POINTS):
        pts = F.when(F.col("position") <= last, p).otherwise(pts)
    best = positions.groupBy("card_id", "query").agg(F.min("position").alias("position"))
    g = best.groupBy("card_id").agg(F.count(F.lit(1)).alias("queries"), F.sum(pts).alias("_s"))
    return g.select("card_id", "queries", F.when(F.col("queries") == VISIBILITY_QUERIES, F.floor(F.col("_s") / VISIBILITY_QUERIES)).cast("int").alias("points"))


def visibility_checks(seen: DataFrame, least: int = 4) -> DataFrame:
    """The visibility block: ok from ``least`` points on."""
    return seen.select("card_id", F.lit("visibility").alias("block"), F.coalesce(F.col("points") >= least, F.lit(False)).alias("ok"),
                       F.col("points").cast("long").alias("value"))


# D3 -------------------------------------------------------------------------
# Block weights.
WEIGHTS = [("title_length", 3), ("title_stop_words", 2), ("description_length", 2), ("attributes_complete", 3), ("attributes_unique", 1), ("slides", 2),
           ("photos", 3), ("photo_size", 2), ("main_photo_white", 3), ("video", 1), ("price_index", 3), ("unanswered_negatives", 2), ("visibility", 3)]


def _over(v: Column, most: Column | int) -> Column:
    """10, less one point for every tenth of ``most`` begun beyond it; null
    where nothing was measured."""
    most = most if isinstance(most, Column) else F.lit(most)
    return F.when(v.isNotNull(), F.greatest(F.lit(0), 10 - F.ceil(10 * F.greatest(F.lit(0), v - most) / most)))


def _band(v: Column, lo: int, hi: int) -> Column:
    return F.when(v < lo, F.floor(10 * v / lo)).otherwise(_over(v, hi))


def graded_scores(cards: DataFrame, seen: DataFrame) -> DataFrame:
    """(card_id, block, score): 0 to 10 points per block, in proportion to how
    far a measure lies off its band or how much of it is there.  Visibility is
    left out where it was not measured; no title, description or video is worth
    0, no price index 10."""
    low = F.lower("title")
    stop = F.lit(False)
    for w in TITLE_STOP_WORDS:
        stop = stop | low.contains(w)
    names = F.transform("attributes", lambda a: a["name"])
    required = len(REQUIRED_ATTRIBUTES)
    missing = F.size(F.array_except(F.array(*map(F.lit, REQUIRED_ATTRIBUTES)), names))
    large = F.size(F.filter("photos", lambda p: (p["width"] >= PHOTO_MIN[0]) & (p["height"] >= PHOTO_MIN[1])))
    n_photos = F.size("photos")
    score = {
        "title_length": F.coalesce(_over(F.length("title"), F.when(F.col("mp") == "WB", TITLE_MAX["WB"]).otherwise(TITLE_MAX["Ozon"])), F.lit(0)),
        "title_stop_words": F.when(stop, 0).otherwise(10),
        "description_length": F.coalesce(_band(F.length("description"), DESC_MIN, DESC_MAX), F.lit(0)),
        "attributes_complete": F.floor(10 * (required - missing) / required),
        "attributes_unique": F.greatest(F.lit(0), 10 - 5 * (F.size(names) - F.size(F.array_distinct(names)))),
        "slides": _band(F.col("slides"), *SLIDES),
        "photos": _band(n_photos, *PHOTOS),
        "photo_size": F.when(n_photos > 0, F.floor(10 * large / n_photos)).otherwise(0),
        "main_photo_white": F.when(F.coalesce(F.get("photos", F.lit(0))["white"], F.lit(False)), 10).otherwise(0),
        "video": F.coalesce(_band(F.col("video_sec"), *VIDEO), F.lit(0)),
        "price_index": F.coalesce(_over(F.col("price_index"), PRICE_INDEX_MAX - 1), F.lit(10)),
        "unanswered_negatives": F.greatest(F.lit(0), 10 - 5 * F.coalesce("unanswered_negatives", F.lit(0))),
        "visibility": F.col("points"),
    }
    x = cards.join(seen.select("card_id", "points"), "card_id", "left")
    rows = F.array(*(F.struct(F.lit(b).alias("block"), c.cast("int").alias("score"), F.lit(w).alias("weight")) for b, w in WEIGHTS for c in [score[b]]))
    return x.select("card_id", F.inline(rows)).where(F.col("score").isNotNull())


def graded_scorecard(scores: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` blocks that cost a card most (weight times missing points),
    with their priority."""
    lost = F.col("weight") * (10 - F.col("score"))
    x = scores.where(F.col("score") < 10).withColumn("lost", lost)
    x = x.withColumn("priority", F.when(lost >= 15, "critical").when(lost >= 5, "medium").otherwise("cosmetic"))
    r = Window.partitionBy("card_id").orderBy(F.desc("lost"), "block")  # at most one row per block
    return x.withColumn("rank", F.row_number().over(r)).where(F.col("rank") <= k).select("card_id", "block", "score", "lost", "priority", "rank")
