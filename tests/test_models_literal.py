"""Mart models on the original 16-row batch with hand-computed values."""

import datetime as dt

from literal import fact, user_master

from liftlake.plans import models as M

D17, D20 = dt.date(2025, 1, 17), dt.date(2025, 1, 20)
AS_OF = dt.date(2025, 1, 21)


def rows(df, *order):
    return [r.asDict() for r in (df.orderBy(*order) if order else df).collect()]


def test_staging_and_fact_counts(spark):
    f = fact(spark)
    assert f.count() == 16
    assert f.where("exercise_id IS NULL").count() == 0
    v = f.where("log_id = 'test-001'").first()
    assert v.volume == 400.0 and v.body_part_name == "胸" and v.is_compound is True


def test_progress_curve(spark):
    c = {(r["exercise_id"], r["metric_date"]): r
         for r in rows(M.m_progress_curve(fact(spark)).where("user_id = 'user_001'"), "metric_date")}
    b20 = c[("bench_press", D20)]
    assert (b20["total_sets"], b20["daily_volume"], b20["max_weight"]) == (3, 745.0, 90.0)
    b17 = c[("bench_press", D17)]
    assert (b17["total_sets"], b17["daily_volume"], b17["max_weight"]) == (3, 722.5, 87.5)
    assert b20["volume_7d_ma"] == 733.75
    assert b20["wow_change_pct"] is None


def test_calendar(spark):
    cal = {(r["user_id"], r["training_date"]): r for r in rows(M.m_calendar(fact(spark)), "user_id")}
    u1 = cal[("user_001", D20)]
    assert (u1["exercise_count"], u1["total_volume"]) == (2, 1305.0)
    assert u1["exercise_summary"] == "インクラインDBプレス: 32.5kg / ベンチプレス: 90kg"
    assert u1["body_parts"] == "胸"
    assert cal[("user_002", D20)]["total_volume"] == 950.0
    u3 = cal[("user_003", D20)]
    assert (u3["exercise_count"], u3["total_volume"]) == (2, 5110.0)


def test_weekly_ranking(spark):
    w = M.m_ranking_weekly(fact(spark), M.d_user(user_master(spark)))
    wk20 = rows(w.where(f"week_start = DATE'{D20}'"), "rank")
    assert [r["user_id"] for r in wk20] == ["user_003", "user_001", "user_002"]
    u1 = [r for r in wk20 if r["user_id"] == "user_001"][0]
    assert (u1["rank"], u1["prev_rank"], u1["rank_change"], u1["rank_diff"]) == (2, 1, "DOWN", -1)
    assert u1["week_end"] == dt.date(2025, 1, 26)
    wk13 = rows(w.where("week_start = DATE'2025-01-13'"), "rank")
    assert [(r["user_id"], r["total_volume"], r["rank"], r["rank_change"]) for r in wk13] == \
        [("user_001", 722.5, 1, "NEW")]


def test_personal_records(spark):
    pr = M.m_personal_record(fact(spark), M.d_user(user_master(spark)), AS_OF)
    got = {r["record_type"]: r for r in rows(pr.where("user_id = 'user_001' AND exercise_id = 'bench_press'"))}
    assert (got["max_weight"]["record_value"], got["max_weight"]["achieved_date"],
            got["max_weight"]["previous_value"]) == (90.0, D20, 87.5)
    assert (got["max_volume"]["record_value"], got["max_volume"]["achieved_date"],
            got["max_volume"]["previous_value"]) == (400.0, D20, 387.5)
    assert got["max_weight"]["is_new"] is True


def test_alltime_and_bodypart(spark):
    u = M.d_user(user_master(spark))
    at = rows(M.m_ranking_alltime(fact(spark), u), "rank")
    assert [r["user_id"] for r in at] == ["user_003", "user_001", "user_002"]
    assert [r["rank"] for r in at] == [1, 2, 3]
    bp = M.m_ranking_bodypart(fact(spark), u)
    assert bp.where("period_type = 'alltime'").where("period_start IS NOT NULL").count() == 0
    chest = rows(bp.where("body_part_id = 'chest' AND period_type = 'monthly'"))
    assert [(r["user_id"], r["total_volume"], r["rank"]) for r in chest] == [("user_001", 722.5 + 1305.0, 1)]


def test_last_training(spark):
    lt = {(r["user_id"], r["body_part_id"]): r for r in rows(M.m_last_training(fact(spark), dt.date(2025, 1, 28)))}
    u1 = lt[("user_001", "chest")]
    assert (u1["days_since_last_bodypart"], u1["days_since_last_any"]) == (8, 8)
    assert u1["needs_3day_reminder"] is True and u1["needs_7day_reminder"] is True


def test_latest_per_set_number(spark):
    from liftlake.plans import ml as ML
    got = {r.set_number: (r.weight_kg, r.training_date) for r in
           ML.latest_per_set_number(fact(spark), "user_001", "bench_press").collect()}
    assert got == {1: (80.0, D20), 2: (85.0, D20), 3: (90.0, D20)}
    fb = {r.set_number: (r.suggested_weight_kg, r.suggested_reps) for r in
          ML.fallback_suggest(fact(spark)).where("user_id = 'user_001' AND exercise_id = 'bench_press'").collect()}
    # RPE 8.0 -> x1.025, 9.0 -> x1.025, 9.5 -> same weight and one more rep
    assert fb == {1: (82.0, 5), 2: (87.1, 3), 3: (90.0, 2)}
