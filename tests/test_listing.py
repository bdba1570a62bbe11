"""Price histories, token index, photo, visibility and graded card scores on
small cases."""

import random

import pytest
from pyspark.sql import functions as F

from tallyfold.operators import listing as L

DAY = 86400


def test_price_runs_across_chunks(spark):
    rnd = random.Random(2)
    rows, want = [], {}
    for offer in (("s1", 1), ("s1", 2), ("s2", 1)):
        t, price, runs = 0, 100, []
        for i in range(120):
            t += rnd.choice([0, 3600, 40 * DAY])
            price = rnd.choice([price, price, 90, 100])
            rows.append((*offer, len(rows), t, price))
            if runs and runs[-1][0] == price:
                runs[-1][2], runs[-1][3] = t, runs[-1][3] + 1
            else:
                runs.append([price, t, t, 1, bool(runs) and price < runs[-1][0]])
        want.update({(*offer, i + 1): tuple(r) for i, r in enumerate(runs)})
    df = spark.createDataFrame(rows, "sku string, competitor long, obs_id long, seen_at long, price long").repartition(4)
    got = {(r.sku, r.competitor, r.run): (r.price, r.from_ts, r.to_ts, r.observations, r.discounted) for r in L.price_runs(df).collect()}
    assert got == want


def test_an_offer_is_not_in_its_own_mean(spark):
    runs = spark.createDataFrame([("a", 1, 1, 100, 0, 0, 3, False), ("a", 1, 2, 80, 0, 0, 1, True), ("a", 2, 1, 160, 0, 0, 1, False), ("a", 3, 1, 400, 0, 0, 2, False),
                                  ("b", 9, 1, 50, 0, 0, 1, False)],
                                 "sku string, competitor long, run long, price long, from_ts long, to_ts long, observations long, discounted boolean")
    own = spark.createDataFrame([("a", 1)], "sku string, competitor long")
    got = {(r.sku, r.competitor): r for r in L.price_reference(runs, own).collect()}
    assert (got["a", 1].price, got["a", 1].discount_freq, got["a", 1].is_own) == (80, 0.25, True)
    assert got["a", 1].vs_others == round(80 / 280, 4) and got["a", 3].other_league and not got["a", 2].other_league
    assert got["a", 3].vs_own == 5.0 and got["a", 2].pct_rank == 0.5
    assert got["b", 9].vs_others is None and got["b", 9].vs_own is None and not got["b", 9].is_own


def test_positional_index_and_keys(spark):
    cards = spark.createDataFrame([(1, "Blue chair, blue oak", "chair " * 9 + "oak. Blue-chair! x"), (2, "Tall tables", None), (3, "abc", "")],
                                  "card_id long, title string, description string")
    index = L.token_index(cards)
    assert {(r.token, tuple(r.positions)) for r in index.where("card_id = 1 and token != 'x'").collect()} == {
        ("chair", (*range(9), 11)), ("oak", (9,)), ("blue", (10,))}
    got = {(r.card_id, r.key): (r.n, r.first_pos, r.in_band, r.spam) for r in L.key_stats(cards, index).collect()}
    assert got == {(1, "blue"): (1, 10, False, True), (1, "chair"): (10, 0, True, True), (2, "tall"): (0, None, False, False), (2, "tables"): (0, None, False, False)}


def test_visibility_needs_exactly_five_queries(spark):
    rows = [(1, f"q{i}", p) for i, p in enumerate([1, 20, 50, 100, None])] + [(1, "q0", 700)] + [(2, f"q{i}", 1) for i in range(4)] + [(3, f"q{i}", 1) for i in range(6)]
    got = {r.card_id: (r.queries, r.points) for r in L.visibility(spark.createDataFrame(rows, "card_id long, query string, position long")).collect()}
    assert got == {1: (5, (10 + 7 + 4 + 1) // 5), 2: (4, None), 3: (6, None)}


PHOTO = "array<struct<width:long,height:long,white:boolean>>"
CARD = (f"card_id long, mp string, title string, description string, attributes array<struct<name:string,value:string>>, unanswered_negatives int, "
        f"slides int, photos {PHOTO}, video_sec int, price_index int")


def _card(i, **over):
    base = {"card_id": i, "mp": "WB", "title": "t" * 100, "description": "d" * 1500, "attributes": [(a, "v") for a in ("brand", "type", "size", "color")],
            "unanswered_negatives": 0, "slides": 5, "photos": [(900, 1200, True)] * 6, "video_sec": 15, "price_index": 59}
    return tuple((base | over).values())


@pytest.mark.parametrize("over, block, score", [
    ({}, "photos", 10), ({"title": "t" * 101}, "title_length", 9), ({"title": "t" * 250}, "title_length", 0), ({"description": "d" * 1499}, "description_length", 9),
    ({"description": "d" * 2750}, "description_length", 9), ({"photos": []}, "photo_size", 0), ({"photos": [(900, 1200, False)] + [(899, 1200, True)] * 5}, "photo_size", 1),
    ({"photos": [(900, 1200, False)] * 3}, "main_photo_white", 0), ({"photos": [(900, 1200, True)] * 3}, "photos", 5), ({"video_sec": None}, "video", 0),
    ({"description": None}, "description_length", 0), ({"video_sec": 33}, "video", 9), ({"price_index": None}, "price_index", 10), ({"price_index": 60}, "price_index", 9), ({"unanswered_negatives": 1}, "unanswered_negatives", 5),
    ({"attributes": [("brand", "b"), ("brand", "c")]}, "attributes_complete", 2), ({"attributes": [("brand", "b"), ("brand", "c")]}, "attributes_unique", 5)])
def test_graded_scores(spark, over, block, score):
    seen = spark.createDataFrame([(1, 5, 7)], "card_id long, queries long, points int")
    rows = {r.block: r.score for r in L.graded_scores(spark.createDataFrame([_card(1, **over)], CARD), seen).collect()}
    assert rows[block] == score and rows["visibility"] == 7 and len(rows) == len(L.WEIGHTS)


def test_photo_checks_and_unmeasured_visibility(spark):
    cards = spark.createDataFrame([_card(1), _card(2, photos=[]), _card(3, photos=[(900, 1199, None)])], CARD)
    got = {(r.card_id, r.block): (r.ok, r.value) for r in L.media_checks(cards).collect()}
    assert got == {(1, "photo_size"): (True, 0), (1, "main_photo_white"): (True, 1), (2, "photo_size"): (False, 0), (2, "main_photo_white"): (False, 0),
                   (3, "photo_size"): (False, 1), (3, "main_photo_white"): (False, 0)}
    seen = spark.createDataFrame([(1, 4, None)], "card_id long, queries long, points int")
    blocks = L.graded_scores(cards, seen).where(F.col("block") == "visibility").count()
    assert blocks == 0
    top = L.graded_scorecard(L.graded_scores(cards, seen)).where("card_id = 2").orderBy("rank").collect()
    assert [(r.block, r.lost) for r in top] == [("main_photo_white", 30), ("photos", 30), ("photo_size", 20)]
