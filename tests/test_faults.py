"""Inputs that once crashed or silently gave wrong rows."""

import random

import pytest
from pyspark.sql import functions as F

from tallyfold.operators import admission, assortment, market, users
from tallyfold.sources.logs import upsert_parquet
from tallyfold.streaming.keyed_admission import stream_admission


def test_admission_fails_closed(spark):
    rows = [(1, 1, "a", 1000, "gold"), (2, 1, "a", 5000, None), (3, 1, None, 9000, "pro"),
            (4, 1, "a", 20000, "pro"), (5, 2, None, 1000, None), (6, 2, "a", 2000, "gold")]
    req = spark.createDataFrame(rows, "request_id long, tg_user_id long, agent_id string, ts long, plan string")
    got = {r.request_id: (r.reason, r.remaining) for r in
           admission.admission_decisions(req, admission.default_limits(spark)).collect()}
    assert got[1] == ("unknown_plan", 0) and got[2] == ("no_active_plan", 0) and got[3] == ("no_agent", 0)
    assert got[4][0] == "allowed" and got[5] == ("no_active_plan", 0) and got[6] == ("unknown_plan", 0)


def test_plan_changes_inside_a_day_match_a_fold(spark):
    rnd = random.Random(5)
    limits = {"s": 3, "m": 6, "l": 9}
    rows = [(i, 1, "a", 1_000_000 + 600 * i, rnd.choice("sml") if i % 4 == 0 else None) for i in range(140)]
    plan = "s"
    for k, (i, u, a, ts, p) in enumerate(rows):
        plan = p or plan
        rows[k] = (i, u, a, ts, plan)
    lim = spark.createDataFrame([(p, 100, None, n) for p, n in limits.items()],
                                "plan string, flood_limit int, day_limit int, agent_limit int")
    req = spark.createDataFrame(rows, "request_id long, tg_user_id long, agent_id string, ts long, plan string")
    got = {r.request_id: (r.reason, r.remaining) for r in admission.admission_decisions(req, lim).collect()}
    used, want = {}, {}
    for i, _, _, ts, p in rows:
        d = ts // 86400
        if used.get(d, 0) + 1 <= limits[p]:
            used[d] = used.get(d, 0) + 1
            want[i] = ("allowed", limits[p] - used[d])
        else:
            want[i] = ("daily_quota", 0)
    assert got == want


def test_bare_start(spark):
    handled = spark.createDataFrame([(1, 7, 10, "/start", "start"), (2, 8, 11, "/start ref_7", "start")],
                                    "update_id long, user_id long, ts long, text string, command string")
    u = spark.createDataFrame([(7, None), (8, None)], "tg_user_id long, utm_source string")
    assert {r.tg_user_id: r.utm_source for r in users.first_touch_attribution(u, handled).collect()} == {7: None, 8: "ref_7"}


def test_stars_outside_the_bands(spark):
    rev = spark.createDataFrame([(1, "s", None, "x"), (2, "s", 0, "late delivery"), (3, "s", 5, "late and broken")],
                                "review_id long, sku string, stars int, text string")
    rules = [("delivery", "late", 2), ("quality", "broken", 1)]
    got = {r.review_id: (r.tone, r.problem) for r in market.classify_reviews(rev, rules).collect()}
    assert got == {1: ("quarantine", "none"), 2: ("quarantine", "delivery"), 3: ("positive", "quality")}
    rep = spark.createDataFrame([(1, None, "Hello."), (2, 9, "Hello."), (3, 5, "Hello.")], "reply_id long, stars int, reply string")
    v = {r.reply_id: r.violations for r in market.lint_replies(rep).collect()}
    assert v == {1: ["quarantine_stars"], 2: ["quarantine_stars"], 3: []}


def test_router_output_is_strict(spark):
    good = '{"agent":null,"reason":"r","confidence":1.0,"reply":null}'
    raw = [good, good + " trailing", '{"agent":null,\n"reason":"r","confidence":1.0,"reply":""}',
           '{"agent":null,"reason":"r","confidence":1.0}', "[1]", None]
    df = spark.createDataFrame(list(enumerate(raw)), "request_id long, raw string")
    got = [r.status for r in market.parse_router_outputs(df).orderBy("request_id").collect()]
    assert got == ["ok"] + ["quarantine"] * 5


def test_prefix_sum_with_an_extra_column(spark):
    n = 1_000_000
    df = spark.range(n).select(F.col("id").alias("sku"), (F.xxhash64("id") % 1000 + 1000).alias("revenue"),
                               F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("extra"))
    c = assortment.cumulative_before(df, "revenue", [F.col("revenue").desc(), F.col("sku").asc()], 8)
    w = c.agg(F.count("*").alias("n"), F.sum(F.length("extra")).alias("e"),
              F.sum((F.col("cum_before") + F.col("revenue") == F.col("total")).cast("int")).alias("last"),
              F.count_distinct("cum_before").alias("starts")).first()
    assert w.n == n and w.last >= 1 and w.starts >= n - df.where("revenue = 0").count()


def test_near_copies_of_one_template(spark):
    rnd = random.Random(11)
    base = [f"w{''.join(rnd.choices('abcdefgh', k=6))}" for _ in range(60)]
    word = lambda: "".join(rnd.choices("ijklmnopq", k=9))
    texts, pairs = [], []
    for i in range(800):
        own = base[:36] + [word() for _ in range(24)]  # template: below the threshold
        texts.append(own)
        if i < 100:
            pairs.append((len(texts) - 1, len(texts)))
            texts.append(own[:-3] + [word() for _ in range(3)])
    df = spark.createDataFrame([(i, "s", " ".join(t)) for i, t in enumerate(texts)], "review_id long, sku string, text string")
    got = {r.review_id: r.series_id for r in market.near_copy_series(df).collect()}
    assert got == {x: a for a, b in pairs for x in (a, b)}


def test_sink_moves_keys_and_keeps_rows_on_errors(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "id long, p string, v long"
    up = lambda rows: upsert_parquet(spark, spark.createDataFrame(rows, schema), path, ["id"], ["v"], ["p"])
    up([(1, "a", 1), (2, "a", 1), (3, "b", 1)])
    up([(3, "a", 2)])
    read = lambda: sorted((r.id, r.p, r.v) for r in spark.read.schema(schema).parquet(path).collect())
    assert read() == [(1, "a", 1), (2, "a", 1), (3, "a", 2)]
    with pytest.raises(Exception):
        upsert_parquet(spark, spark.createDataFrame([(1, "a")], "id long, p string"), path, ["id"], ["v"], ["p"])
    assert read() == [(1, "a", 1), (2, "a", 1), (3, "a", 2)]


def test_stream_state_of_users_without_plan(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, 1, "a", 1000, None), (2, 2, "a", 1000, "gold"), (3, 3, None, 1000, "pro"), (4, 3, "a", 1001, "pro")],
                          "request_id long, tg_user_id long, agent_id string, ts long, plan string").write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    out = stream_admission(stream, {"pro": (5, None, 10)}, 60)
    q = (out.writeStream.format("memory").queryName("t3_faults").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r.request_id: r.reason for r in spark.table("t3_faults").collect()}
    assert got == {1: "no_active_plan", 2: "unknown_plan", 3: "no_agent", 4: "allowed"}


def _shuffles_above_explode(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[:plan.index("Generate ")].count("Exchange ")


def test_scores_are_shuffled_before_they_become_twelve_rows(spark):
    from tallyfold.operators import market as M
    from tallyfold.plans import q_market

    scores = q_market.axis_scores(spark, "/root/testdata/sf0.001")
    for df in (M.competitor_columns(scores), M.axis_matrix(scores)):
        assert _shuffles_above_explode(df) == 0
    rows = [("a", 5, 0, True, 3), ("a", 5, 1, True, 4), ("a", 7, 0, False, 9), ("a", 9, 0, False, 2), ("a", 9, 1, False, 6), ("b", 1, 0, True, 1),
            ("c", 2, 0, False, 8)]
    df = spark.createDataFrame(rows, "sku string, competitor long, axis int, is_own boolean, score int")
    got = {tuple(r) for r in M.competitor_columns(df, 2).collect()}
    assert got == {("a", 0, 3, 2, 9, 2), ("a", 1, 4, 1, None, 6), ("b", 0, 1, 0, None, None)}
    assert {tuple(r) for r in M.axis_matrix(df).collect()} == {("a", 0, 3, 9, -6), ("a", 1, 4, 6, -2), ("b", 0, 1, None, None)}


def test_descriptions_are_shuffled_whole_and_the_index_is_met_by_card(spark):
    from tallyfold.operators import listing as L

    cards = spark.createDataFrame([(1, "Good good shoe lamp", "shoe good, shoe Good."), (2, "lamp", None), (2, "lamp rope", "rope lamp"), (None, "rope", "rope")],
                                  "card_id long, title string, description string")
    assert _shuffles_above_explode(L.token_index(cards)) == 0
    got = sorted(((r.card_id or -1, r.key, r.n, r.first_pos, r.density) for r in L.key_stats(cards, L.token_index(cards)).collect()), key=str)
    assert got == sorted([(1, "good", 2, 1, 0.5), (1, "shoe", 2, 0, 0.5), (1, "lamp", 0, None, 0.0), (2, "lamp", 1, 1, 0.5), (2, "lamp", 1, 1, 0.5),
                          (2, "rope", 1, 0, 0.5), (-1, "rope", 0, None, None)], key=str)


def test_upsert_computes_its_updates_once(spark, tmp_path):
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    path = str(tmp_path / "table")
    rows = spark.createDataFrame([(i, "ab"[i % 2], 0) for i in range(20)], "id long, p string, v int")
    rows.write.partitionBy("p").parquet(path)
    updates = rows.where("id < 10").withColumn("p", F.lit("c")).withColumn("v", F.lit(1)).mapInPandas(count, rows.schema)
    upsert_parquet(spark, updates, path, ["id"], ["v"], ["p"])
    assert seen.value == 10
    assert {(r.id, r.p, r.v) for r in spark.read.parquet(path).collect()} == {(i, "c", 1) if i < 10 else (i, "ab"[i % 2], 0) for i in range(20)}
