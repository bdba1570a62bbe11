"""Bounded samples and the cascade's order."""

import itertools
import random

from pyspark.sql import functions as F

from tallyfold.llm import langid, quality, toxicity
from tallyfold.llm.sample import place, threshold


def test_a_tiny_share_is_not_nothing(spark):
    assert threshold(1500 / 10 ** 13) > 0 and threshold(1.0) == (1 << 63) - 1 and threshold(0.0) == 0
    ids = spark.range(1 << 22).withColumnRenamed("id", "doc_id")
    for share in (1.0, 2.0 ** -6, 2.0 ** -21, 2.0 ** -23):
        n, want = ids.where(place("doc_id", 5) <= threshold(share)).count(), share * (1 << 22)
        assert abs(n - want) <= 5 * want ** 0.5 and (share < 1 or n == want)


def test_small_shares_learn_every_class(spark):
    """Shares below 2**-20 of a language and of both label classes."""
    docs = (spark.range(1 << 23).withColumnRenamed("id", "doc_id")
            .withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "de").otherwise("en"))
            .withColumn("text", F.when(F.col("lang") == "de", "der hund und die katze").otherwise("the dog and the cat")))
    model = langid.train(docs, docs_per_lang=3)
    got = {r.doc_id: r.lang_pred for r in langid.predict(
        docs.where("doc_id < 20").select("doc_id", F.lit(True).alias("held_out"), "text"), model).collect()}
    assert got == {i: ("en" if i % 2 else "de") for i in range(20)}
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))
    weights = toxicity.train(docs, labels, max_toxic=3, max_clean=3)
    scored = toxicity.score(docs.where("doc_id < 20").select("doc_id", F.lit(True).alias("held_out"), "text"), weights).collect()
    assert len(weights["hash"]) == 0 or all((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in scored)
    assert weights["intercept"] not in (20.0, -20.0)


def _spent(order, masks, cost):
    """Seconds of a cascade: a document pays for every rule until one rejects it."""
    total = 0.0
    for m, n in masks.items():
        for i in order:
            total += n * cost[i]
            if m >> i & 1:
                break
    return total


def test_greedy_order_counts_what_is_left():
    # Rule 1 rejects most of what rule 0 does; rule 2 rejects others, so it goes before rule 1.
    masks = {0b011: 50, 0b001: 10, 0b100: 20, 0: 20}
    assert quality.greedy(masks, [1.0, 1.0, 1.0]) == [0, 2, 1]
    rnd = random.Random(4)
    for _ in range(50):
        cost = [rnd.uniform(0.1, 2) for _ in range(4)]
        masks = {m: rnd.randint(0, 30) for m in range(16)}
        best = min(_spent(p, masks, cost) for p in itertools.permutations(range(4)))
        assert _spent(quality.greedy(masks, cost), masks, cost) <= 4 * best  # known bound of the greedy order


def test_order_is_fitted_on_survivors_of_the_base_test(spark):
    words = [" ".join(f"wort{i}x{j}" for j in range(30)) for i in range(60)]
    rows = [(i, "short text") for i in range(300)]  # rejected by the base test
    rows += [(1000 + i, w.replace("x", "#") if i % 2 else w) for i, w in enumerate(words)]
    rows += [(2000 + i, None) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert quality.plan_cascade(df)[0].name == "too_few_words"
    assert quality.plan_cascade(df, after_base=True)[0].name == "symbols_per_word"
    assert quality.plan_cascade(df.where("doc_id < 0")) == quality.RULES
