"""Ban state at the time of a message."""

from pyspark.sql import functions as F

from tallyfold.operators import users

DAY = 86400
CMDS = "cmd_id long, admin_id long, ts long, sub string, target long, plan string, days long, valid boolean"


def _cmds(spark, rows):
    return spark.createDataFrame([(i, 1, ts, sub, target, None, None, ok) for i, ts, sub, target, ok in rows], CMDS)


def test_a_ban_holds_from_its_command_to_the_unban(spark):
    cmds = _cmds(spark, [(50, 5 * DAY, "ban", 7, True), (51, 6 * DAY, "ban", 7, True), (80, 8 * DAY, "unban", 7, True), (90, 9 * DAY, "ban", 7, True),
                         (91, 9 * DAY, "unban", 7, True), (30, 3 * DAY, "unban", 8, True), (31, 4 * DAY, "ban", 10, False), (32, 4 * DAY, "help", 10, True)])
    people = spark.createDataFrame([(7, 0), (8, 1), (9, 1), (10, 0)], "tg_user_id long, is_banned int")
    bans = users.ban_intervals(people, cmds)
    got = sorted((r.user_id, r.from_ts // DAY if r.from_ts > 0 else None, r.to_ts and r.to_ts // DAY) for r in bans.collect())
    assert got == [(7, 5, 8), (7, 9, 9), (8, None, 3), (9, None, None)]
    sent = [(1, 7, 4 * DAY), (49, 7, 5 * DAY), (52, 7, 5 * DAY), (60, 7, 7 * DAY), (79, 7, 8 * DAY), (81, 7, 8 * DAY), (92, 7, 9 * DAY),
            (2, 8, 2 * DAY), (40, 8, 3 * DAY + 1), (3, 9, 20 * DAY), (4, 10, 5 * DAY), (5, 11, 0), (6, None, 9)]
    msgs = spark.createDataFrame([(i, u, t, "message", "hello") for i, u, t in sent], "update_id long, user_id long, ts long, kind string, text string")
    assert sorted(r.update_id for r in users.handled_messages(msgs, bans).collect()) == [1, 4, 5, 6, 40, 49, 81, 92]


def test_a_hot_sender_with_many_bans(spark):
    """A third of all messages from one user with many bans."""
    cmds = _cmds(spark, [(i, i * 100, "ban" if i % 2 else "unban", 7, True) for i in range(400)])
    bans = users.ban_intervals(spark.createDataFrame([(7, 0)], "tg_user_id long, is_banned int"), cmds)
    msgs = spark.range(30_000).select((F.col("id") + 10_000).alias("update_id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("user_id"),
                                      (F.col("id") % 40_000).alias("ts"), F.lit("message").alias("kind"), F.lit("x").alias("text"))
    out = users.handled_messages(msgs, bans)
    want = sum(1 for i in range(30_000) if i % 3 or i == 7 or (i // 100) % 2 == 0)
    assert out.count() == want - (1 if (7 // 100) % 2 else 0)
