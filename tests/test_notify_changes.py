"""Notification plans, message rendering and master-table changes."""

import datetime as dt

from pyspark.sql import functions as F

from liftlake import schemas
from liftlake.functions import exprs as H
from liftlake.operators import changes as K
from liftlake.operators.quota import should_send, zone_period_start_utc
from liftlake.plans import notify as NT

NOW = dt.datetime(2025, 1, 31, 16, 0, 0)   # 2025-02-01 01:00 in Tokyo


def users(spark):
    return spark.createDataFrame([
        ("user_001", "ユーザー1", "U1", True, dt.datetime(2025, 1, 1)),
        ("user_002", "ユーザー2", "U2", True, dt.datetime(2025, 1, 1)),
        ("user_003", "ユーザー3", "U3", True, dt.datetime(2025, 1, 1))],
        "user_id string, user_name string, line_user_id string, is_active boolean, created_at timestamp_ntz")


def log(spark, rows):
    return spark.createDataFrame(rows, schemas.NOTIFICATION_LOG)


def test_tokyo_periods():
    assert zone_period_start_utc(NOW, "month") == dt.datetime(2025, 1, 31, 15, 0, 0)
    assert zone_period_start_utc(NOW, "day") == dt.datetime(2025, 1, 31, 15, 0, 0)
    assert zone_period_start_utc(dt.datetime(2025, 1, 31, 14, 0), "month") == dt.datetime(2024, 12, 31, 15, 0)


def test_zone_truncation_expression(spark):
    df = spark.createDataFrame([(NOW,)], "ts timestamp")
    r = df.select(H.zone_truncated_timestamp("ts", "month").alias("m"),
                  H.zone_truncated_timestamp("ts", "day").alias("d")).first()
    assert (r.m, r.d) == (dt.datetime(2025, 1, 31, 15, 0, 0), dt.datetime(2025, 1, 31, 15, 0, 0))


def test_small_helpers(spark):
    df = spark.createDataFrame([("2025-01-20T01:02:03",)], "s string")
    r = df.select(H.iso_timestamp("s").alias("t"), H.row_uuid().alias("u"), H.today_in_zone().alias("d"),
                  H.format_volume(F.lit(1234.5)).alias("f0"), H.format_volume(F.lit(-12.25), 1, True).alias("f1"),
                  H.format_period(F.lit(dt.date(2025, 1, 5))).alias("p")).first()
    assert r.t == dt.datetime(2025, 1, 20, 1, 2, 3) and len(r.u) == 36 and isinstance(r.d, dt.date)
    assert (r.f0, r.f1, r.p) == ("1,234", "-12.2", "2025年01月")


def test_quota_rule():
    assert [should_send(c, "3day") for c in (179, 189, 190)] == [True, True, False]
    assert [should_send(c, "7day") for c in (179, 180)] == [True, False]
    assert [should_send(c, "weekly_ranking") for c in (199, 200)] == [True, False]


def test_digest_message(spark):
    rk = spark.createDataFrame([
        ("user_001", "ユーザー1", dt.date(2025, 1, 20), 1305.0, 2, 1, "DOWN"),
        ("user_003", "ユーザー3", dt.date(2025, 1, 20), 5110.5, 1, None, "NEW"),
        ("user_002", "ユーザー2", dt.date(2025, 1, 20), 950.0, 4, 4, "SAME"),
        ("user_001", "ユーザー1", dt.date(2025, 1, 13), 722.5, 1, None, "NEW")],
        "user_id string, user_name string, week_start date, total_volume double, rank bigint, prev_rank bigint, "
        "rank_change string")
    text = NT.render_message(NT.digest_lines(rk, users(spark), "weekly", app_url="https://example.invalid/"))
    assert text == "\n".join([
        "🏆 週間ランキング（2025-01-20〜2025-01-26）\n",
        "🥇 ユーザー3: 5,110 kg  NEW ",
        "🥈 ユーザー1: 1,305 kg  ↓ (前回1位)",
        "4位 ユーザー2: 950 kg  → (前回4位)",
        "\n📱 詳細を見る: https://example.invalid/"])
    empty = rk.where("rank < 0")
    assert NT.render_message(NT.digest_lines(empty, users(spark), "weekly")) is None


def test_start_plan_branches(spark):
    u = users(spark)
    sent_today = log(spark, [("n1", "user_001", "start", "sent", dt.datetime(2025, 1, 31, 15, 30))])
    status, plan = NT.start_plan(sent_today, u, "user_001", "chest", NOW, base_count=0)
    assert status == "already_sent" and plan.count() == 0
    status, plan = NT.start_plan(log(spark, []), u, "user_001", "chest", NOW, base_count=200)
    assert status == "suppressed" and [r.status for r in plan.collect()] == ["suppressed"]
    status, plan = NT.start_plan(log(spark, []), u, "user_999", "chest", NOW, base_count=0)
    assert status == "error"
    status, plan = NT.start_plan(log(spark, []), u, "user_001", "chest", NOW, base_count=199)
    rows = plan.collect()
    assert status == "completed" and sorted(r.user_id for r in rows) == ["user_002", "user_003"]
    assert rows[0].message.startswith("🏋️ ユーザー1がトレーニングを開始しました！\n今日のメニュー: chest")


def test_merge_same_day_and_log(spark):
    plan = spark.createDataFrame([("u1", "3day", "sent", 1, "a"), ("u1", "7day", "sent", 1, "b"),
                                  ("u2", "7day", "suppressed", None, "c")],
                                 "user_id string, notification_type string, status string, position bigint, message string")
    m = {r.user_id: (r.message, r.merged) for r in NT.merge_same_day(plan).collect()}
    assert m == {"u1": ("a\n\nb", 2)}
    failed = spark.createDataFrame([("u1", "7day")], "user_id string, notification_type string")
    lg = {(r.user_id, r.notification_type): r.status for r in NT.log_attempts(plan, NOW, failed).collect()}
    assert lg == {("u1", "3day"): "sent", ("u1", "7day"): "failed", ("u2", "7day"): "suppressed"}


def master(spark):
    return spark.createDataFrame([
        ("bench_press", "ベンチプレス", "chest", True, True, 1, dt.datetime(2025, 1, 1)),
        ("squat", "Squat", "leg", True, True, 1, dt.datetime(2025, 1, 1))], schemas.EXERCISE_MASTER)


def requests(spark):
    return spark.createDataFrame([
        ("r1", "user_001", "Cable Fly", "chest", None, "pending", None, dt.datetime(2025, 1, 2), None)],
        schemas.EXERCISE_REQUEST)


def test_submit_and_review_requests(spark):
    new = spark.createDataFrame([
        ("n1", "user_002", "x", "arm", ""), ("n2", "user_002", "SQUAT", "leg", ""),
        ("n3", "user_002", "cable fly", "chest", ""), ("n4", "user_002", "Dips", "chest", "why"),
        ("n5", "user_003", "dips", "chest", "")],
        "request_id string, user_id string, exercise_name string, body_part_id string, reason string")
    dec, after = K.submit_requests(requests(spark), master(spark), new, NOW)
    assert {r.request_id: r.decision for r in dec.collect()} == {
        "n1": "invalid_length", "n2": "exists_in_master", "n3": "pending_duplicate",
        "n4": "accepted", "n5": "pending_duplicate"}
    assert after.count() == 2
    appr = spark.createDataFrame([("r1", "user_001")], "request_id string, reviewer string")
    req2, m2 = K.approve_requests(requests(spark), master(spark), appr, NOW)
    r = req2.first()
    assert (r.status, r.reviewed_by, r.reviewed_at) == ("approved", "user_001", NOW)
    assert {x.exercise_id for x in m2.collect()} == {"bench_press", "squat", "cable_fly"}
    rej = K.reject_requests(req2, spark.createDataFrame([("r1", "u9")], "request_id string, reviewer string"), NOW)
    assert rej.first().status == "approved"          # final states do not change


def test_master_changes(spark):
    m = master(spark)
    off = K.deactivate_exercises(m, spark.createDataFrame([("squat",)], "exercise_id string"), NOW)
    assert {r.exercise_id: r.is_active for r in off.collect()} == {"bench_press": True, "squat": False}
    assert {r.exercise_id: r.is_compound for r in K.update_exercise_flag(m, "squat", False).collect()}["squat"] is False
    new = spark.createDataFrame([("ok_id", "OK", "arm", None, None), ("bad id", "Bad", "arm", None, None),
                                 ("squat", "Again", "leg", None, None), ("ab", "Short", "arm", None, None)],
                                "exercise_id string, exercise_name string, body_part_id string, "
                                "is_compound boolean, display_order int")
    dec, after = K.add_exercises(m, new, NOW)
    assert {r.exercise_id: r.decision for r in dec.collect()} == {
        "ok_id": "accepted", "bad id": "invalid_id", "squat": "id_taken", "ab": "invalid_id"}
    assert after.count() == 3


def test_users_and_validation(spark):
    u = users(spark)
    ch = spark.createDataFrame([("user_002", "U2-new"), ("user_009", "U9")], "user_id string, line_user_id string")
    out = {r.user_id: r.line_user_id for r in K.maintain_users(u, ch).collect()}
    assert out["user_002"] == "U2-new" and out["user_009"] == "U9" and len(out) == 4
    rows = spark.createDataFrame([
        ("a", None, 5, 8.0, dt.date(2025, 1, 20), 1, None),
        ("b", 501.0, 0, 5.0, dt.date(2025, 1, 30), 21, "x" * 201),
        ("c", 80.0, 5, None, dt.date(2024, 10, 1), 1, None)],
        "log_id string, weight_kg double, reps int, rpe double, training_date date, set_number int, memo string")
    checked, good, bad = K.validate_input_rows(rows, dt.date(2025, 1, 21))
    errs = {r.log_id: list(r.errors) for r in checked.collect()}
    assert errs["a"] == ["weight_required"]
    assert errs["b"] == ["weight_range", "reps_range", "rpe_range", "date_future", "set_number_range", "memo_too_long"]
    assert errs["c"] == ["date_too_old"]
    assert good.count() == 0 and bad.count() == 3
    assert K.autosave_gate(rows.fillna({"weight_kg": 0.0})).count() == 1


def test_seed_inline_and_parameters(spark):
    from liftlake.sources import seed
    from liftlake.plans import models as M
    assert seed.seed_exercises(spark).count() == 19
    assert seed.seed_users(spark).where("is_admin").count() == 1
    a = sorted(map(tuple, seed.inline_dimension(spark).collect()))
    b = sorted(map(tuple, M.d_body_part(spark).collect()))
    assert a == b
    ex = seed.seed_exercises(spark)
    ex.createOrReplaceTempView("seed_ex")
    got = seed.parameterised_query(spark, "SELECT exercise_id FROM seed_ex WHERE body_part_id = :bp "
                                          "AND display_order <= :n", bp="leg", n=2).collect()
    assert sorted(r.exercise_id for r in got) == ["leg_press", "squat"]
    assert K.optional_filter(ex, "body_part_id", "all").count() == 19
    assert K.optional_filter(ex, "body_part_id", "arm").count() == 3
    assert K.case_insensitive_match(ex, "exercise_id", "SQUAT").count() == 1
