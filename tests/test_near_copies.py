"""V3 near copies against brute force: all pairs of vocabularies with exact
Jaccard >= 0.8, connected components, on the sf0.01 documents."""

import itertools

import pyarrow.parquet as pq
import regex

from tallyfold.operators.market import near_copy_series
from tallyfold.plans.q_market import reviews

SF = "/root/testdata/sf0.01"
_NON_LETTER = regex.compile(r"[^\p{L} \t\n\x0b\f\r]")
_WS = regex.compile(r"[ \t\n\x0b\f\r]+")


def _vocab(text):
    t = _WS.sub(" ", _NON_LETTER.sub("", text.lower())).strip(" \t\n\x0b\f\r")
    return frozenset(w for w in t.split(" ") if w)


def _brute(threshold=0.8):
    tab = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    voc = {i: _vocab(t) for i, t in zip(tab["doc_id"], tab["text"])}
    ids = [i for i in voc if voc[i]]
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        va, vb = voc[a], voc[b]
        if min(len(va), len(vb)) < threshold * max(len(va), len(vb)):
            continue  # size bound: Jaccard cannot reach the threshold
        if len(va & vb) / len(va | vb) >= threshold:
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    comp = {}
    for i in ids:
        comp.setdefault(find(i), []).append(i)
    return {(i, min(c)) for c in comp.values() if len(c) >= 2 for i in c}


def test_near_copies_equal_brute_force(spark):
    got = {(r.review_id, r.series_id) for r in near_copy_series(reviews(spark, SF)).collect()}
    assert got == _brute()


def _texts(spark, texts):
    return spark.createDataFrame([(i, "s", " ".join(t)) for i, t in enumerate(texts)], "review_id long, sku string, text string")


def _pairs(texts, threshold=0.8):
    sets = [frozenset(t) for t in texts]
    return {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}


def test_bounds_keep_every_pair_and_little_else(spark):
    """Candidates of the prefix join hold all true pairs; texts of one
    template below the threshold make hardly any."""
    import random

    from pyspark.sql import functions as F

    from tallyfold.operators import market as M
    rnd = random.Random(3)
    word = lambda n=9: "".join(rnd.choices("ijklmnopq", k=n))
    base, pool, texts = [word() for _ in range(20)], [word(3) for _ in range(60)], []
    for _ in range(250):
        texts.append(base[:rnd.randrange(10, 16)] + rnd.sample(pool, 3) + [word() for _ in range(rnd.randrange(4, 9))])
    for t in list(texts[:60]):
        texts.append(t[:-1] + [word()] * rnd.randrange(2))
    texts += [rnd.sample(pool, rnd.randrange(1, 12)) for _ in range(120)]
    texts = [sorted(set(t)) for t in texts]
    texts = [list(t) for t in dict.fromkeys(map(tuple, texts))]
    words = _texts(spark, texts).select(F.col("review_id").alias("rid"), F.explode(M.vocabulary(F.col("text"))).alias("_w")).select("rid", F.xxhash64("_w").alias("w"))
    counts = words.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    head = M.frequent_words(counts, 40)  # the order has a rare part and a counted part
    assert 0 < head.count() <= 40
    described = M.described_texts(words, head, 0.8)
    m = described.select("rid", "n", "bits", F.explode("prefix").alias("p")).select("rid", "n", "bits", "p.w", "p.pos")
    side = lambda x: m.select("w", F.col("rid").alias(x), F.col("n").alias("n" + x), F.col("pos").alias("p" + x), F.col("bits").alias("b" + x))
    got = {(r.a, r.b) for r in side("a").join(side("b"), "w").where((F.col("a") < F.col("b")) & M.may_reach(0.8)).select("a", "b").distinct().collect()}
    true = _pairs(texts)
    assert true <= got and len(got) <= 3 * len(true) + 100
    sure = {tuple(sorted((r.x, r.y))) for r in M.certain_groups(described, 0.8).collect()}
    assert sure <= true and sure


def test_a_template_with_one_own_word_is_one_series_without_pairs(spark):
    from tallyfold.operators.market import near_copy_series
    letters = "abcdefghij"
    base = [c * 4 for c in letters * 2][:10] + [c * 5 for c in letters]
    own = lambda i: "z" + "".join(letters[int(d)] for d in str(i))
    texts = [base + [own(i)] for i in range(4000)]  # eight million pairs, all true
    got = {r.series_id for r in near_copy_series(_texts(spark, texts)).collect()}
    assert got == {0}


def test_unrelated_long_texts_are_dropped_before_their_words_are_compared(spark):
    """256 or 512 parity bits fill up in texts of thousands of words, which
    all passed; wide bits of both sizes drop them and keep every true pair."""
    import random

    from pyspark.sql import functions as F

    from tallyfold.operators import market as M
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices("abcdefghij", k=9))
    shared, texts = [word() for _ in range(300)], []
    for n in (500, 810, 830, 1600, 1650, 3300):
        t = shared + [word() for _ in range(n)]
        texts += [t, t[:-n // 12] + [word() for _ in range(n // 12)], t[:-n // 12]]
        texts += [shared + [word() for _ in range(n)] for _ in range(2)]
    texts = [sorted(set(t)) for t in texts]
    voc = _texts(spark, texts).select(F.col("review_id").alias("rid"), F.transform(M.vocabulary(F.col("text")), lambda w: F.xxhash64(w)).alias("voc"))
    described = M.described(voc, spark.createDataFrame([], "w long, df long"), 0.8)
    side = lambda x: described.select(F.col("rid").alias(x), F.col("n").alias("n" + x))
    near = side("a").crossJoin(side("b")).where("a < b and least(na, nb) >= 0.8 * greatest(na, nb)")
    got = {(r.a, r.b) for r in M.near_by_wide_bits(near, described, 0.8).where(f"least(na, nb) > {M.WIDE}").collect()}
    true = _pairs(texts)
    assert len(true) >= 18 and got == true


def test_texts_of_common_words_seldom_meet(spark):
    """Words that many texts have bring two texts together only in company: with
    buckets of single words nearly all pairs met."""
    import random

    from pyspark.sql import functions as F

    from tallyfold.operators import market as M
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choices("abcdefghij", k=9))
    pool, texts = [word() for _ in range(3000)], []
    for _ in range(120):
        t = rnd.sample(pool, rnd.randrange(100, 300))
        texts += [t, t[:-len(t) // 12], t[:-len(t) // 16] + [word() for _ in range(len(t) // 16)]]
    texts += [rnd.sample(pool, n) for n in range(1, 40) for _ in range(2)]
    texts = [sorted(t) for t in texts]
    words = _texts(spark, texts).select(F.col("review_id").alias("rid"), F.explode(M.vocabulary(F.col("text"))).alias("_w")).select("rid", F.xxhash64("_w").alias("w"))
    described = M.described_texts(words, words.groupBy("w").agg(F.count(F.lit(1)).alias("df")), 0.8)
    m = described.select("rid", F.explode("prefix").alias("p")).select("rid", "p.w")
    got = {(r.a, r.b) for r in m.toDF("a", "w").join(m.toDF("b", "w"), "w").where("a < b").select("a", "b").distinct().collect()}
    true = _pairs(texts)
    assert len(true) >= 360 and true <= got and len(got) <= 0.2 * len(texts) ** 2 / 2


def test_marked_rows_are_those_of_the_keys(spark):
    from tallyfold.operators import market as M
    rows = spark.range(20000).withColumnRenamed("id", "k").selectExpr("k", "k % 7 v")
    keys = rows.where("k % 37 = 5 or k > 19990").select("k")
    assert {r.k for r in M.marked(rows, keys, "k").collect()} == {k for k in range(20000) if k % 37 == 5 or k > 19990}
    assert M.marked(rows, keys.where("k < 0"), "k").count() == 0


def test_bits_of_a_group_drop_unrelated_long_texts(spark):
    """Texts of a thousand words fill 256 bits, and all that shared a part were
    stored as pairs; the bits of a part's group are few words'."""
    import random

    from pyspark.sql import functions as F

    from tallyfold.operators import market as M
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choices("abcdefghij", k=9))
    pool, texts = [word() for _ in range(3000)], []
    for n in (260, 500, 515, 900, 1020, 1030, 1100):
        for _ in range(4):
            t = rnd.sample(pool, n)
            texts += [t, t[:-n // 10] + [word() for _ in range(n // 12)], t[:-n // 6]]
    texts = [sorted(set(t)) for t in texts]
    words = _texts(spark, texts).select(F.col("review_id").alias("rid"), F.explode(M.vocabulary(F.col("text"))).alias("_w")).select("rid", F.xxhash64("_w").alias("w"))
    described = M.described_texts(words, words.groupBy("w").agg(F.count(F.lit(1)).alias("df")), 0.8)
    m = described.select("rid", "n", F.explode("prefix").alias("p")).select("p.w", "rid", "n", "p.some")
    both = m.toDF("w", "a", "na", "sa").join(m.toDF("w", "b", "nb", "sb"), "w").where("a < b")
    got = {(r.a, r.b) for r in both.where(M.few_in_group(0.8)).select("a", "b").distinct().collect()}
    true = _pairs(texts)
    assert len(true) >= 50 and true <= got and len(got) <= 2 * len(true)
