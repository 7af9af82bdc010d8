"""One test per semantic trap with a decision."""

import datetime as dt

from literal import BATCH16, TS, exercise_master, log_rows, raw_log
from pyspark.sql import functions as F

from liftlake import schemas
from liftlake.functions import exprs as H
from liftlake.operators.latest import latest_active_by_key, latest_by_key, training_log_order
from liftlake.operators.upsert import watermark_value
from liftlake.plans import models as M


def _log(spark, rows):
    return spark.createDataFrame(rows, schemas.TRAINING_LOG)


def test_t1_t6_staging_vs_screen_latest(spark):
    r = BATCH16[0]
    old = log_rows([r], ts=TS)[0]
    new_deleted = log_rows([r[:6] + (99.0,) + r[7:]], ts=TS, deleted=True, updated=TS + dt.timedelta(hours=1))[0]
    df = _log(spark, [old, new_deleted])
    stg = M.stg_training_log(df, tiebreak=())
    # staging drops deleted versions first: the older live version comes back
    assert [x.weight_kg for x in stg.collect()] == [80.0]
    # the screen's order (de-dup first) removes the key
    assert latest_active_by_key(df, ["log_id"], training_log_order(())).count() == 0
    assert M.stg_training_log(df, tiebreak=(), tombstones=True).count() == 0
    # equal update time: the deletion wins the tie (total order)
    tie = _log(spark, [old, log_rows([r], ts=TS, deleted=True)[0]])
    assert latest_by_key(tie, ["log_id"], training_log_order(())).first().is_deleted is True


def test_t4_empty_target_watermark(spark):
    empty = _log(spark, [])
    assert watermark_value(empty, "updated_at") == dt.datetime(1970, 1, 1)


def test_t9_strict_greatest(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, 2.0)], "a double, b double")
    got = [r.g for r in df.select(H.null_strict_greatest("a", "b").alias("g")).collect()]
    assert got == [None, 2.0]


def test_t10_unicode_trim(spark):
    df = spark.createDataFrame([("　ab ",), (" Ab　",)], "s string")
    assert [r.n for r in df.select(H.normalise_name("s").alias("n")).collect()] == ["ab", "ab"]


def test_t11_number_to_string(spark):
    df = spark.createDataFrame([(80.0,), (87.5,), (1e7,), (0.5,)], "v double")
    assert [r.s for r in df.select(H.num_to_string("v").alias("s")).collect()] == ["80", "87.5", "10000000", "0.5"]


def test_t12_week_and_month_are_dates(spark):
    df = spark.createDataFrame([(dt.date(2025, 1, 26),)], "d date")  # a Sunday
    r = df.select(H.week_start("d").alias("w"), H.week_end("d").alias("e"), H.month_start("d").alias("m")).first()
    assert (r.w, r.e, r.m) == (dt.date(2025, 1, 20), dt.date(2025, 1, 26), dt.date(2025, 1, 1))


def test_t14_safe_divide(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (3.0, 2.0)], "a double, b double")
    assert [r.x for r in df.select(H.safe_divide("a", "b").alias("x")).collect()] == [None, None, 1.5]


def test_t15_null_exercise_has_no_previous(spark):
    rows = [BATCH16[0], BATCH16[8]]
    unknown = [r[:2] + ("unknown lift",) + r[3:] for r in rows]
    f = M.fct_training_set(M.stg_training_log(raw_log(spark, unknown), tiebreak=()),
                           M.d_exercise(exercise_master(spark)), M.d_body_part(spark))
    pr = M.m_personal_record(f, M.d_user(spark.createDataFrame([], schemas.USER_MASTER)), dt.date(2025, 1, 21))
    assert pr.where("exercise_id IS NULL").count() == 2
    assert pr.where("previous_value IS NOT NULL").count() == 0


def test_t20_t21_rank_ties_and_latest_achieved(spark):
    rows = [("a", "u1", "ベンチプレス", "chest", "2025-01-01", 1, 50.0, 2, 8.0),
            ("b", "u1", "ベンチプレス", "chest", "2025-01-05", 1, 50.0, 2, 8.0),
            ("c", "u2", "ベンチプレス", "chest", "2025-01-05", 1, 25.0, 4, 8.0),
            ("d", "u3", "ベンチプレス", "chest", "2025-01-05", 1, 50.0, 2, 8.0),
            ("e", "u4", "ベンチプレス", "chest", "2025-01-05", 1, 10.0, 1, 8.0)]
    f = M.fct_training_set(M.stg_training_log(raw_log(spark, rows), tiebreak=()),
                           M.d_exercise(exercise_master(spark)), M.d_body_part(spark))
    users = M.d_user(spark.createDataFrame([], schemas.USER_MASTER))
    expect = {"u1": 1, "u2": 2, "u3": 2, "u4": 4}
    for parts in (1, 2, 4):
        at = {r.user_id: r.rank for r in M.m_ranking_alltime(f.repartition(parts), users).collect()}
        from liftlake.operators.rank import global_rank
        ranged = global_rank(f.repartition(parts).groupBy("user_id").agg(F.sum("volume").alias("v")), "v")
        assert {r.user_id: r.rank for r in ranged.collect()} == expect
        assert at == expect
    wk = {r.user_id: r.rank for r in M.m_ranking_weekly(f, users).where("week_start = DATE'2024-12-30'").collect()}
    assert wk == expect
    rec = M.m_personal_record(f, users, dt.date(2025, 1, 1)).where("user_id = 'u1' AND record_type = 'max_weight'").first()
    # the latest date reaching the maximum; previous best may equal it
    assert (rec.achieved_date, rec.previous_value) == (dt.date(2025, 1, 5), 50.0)
    # A future achieved date still counts as new
    assert rec.is_new is True


def test_t24_other_part_never_needs_7day(spark):
    rows = [("o", "u1", "プランク", "other", "2025-01-01", 1, 0.0, 1, None),
            ("p", "u1", "ベンチプレス", "chest", "2025-01-01", 1, 50.0, 1, None)]
    f = M.fct_training_set(M.stg_training_log(raw_log(spark, rows), tiebreak=()),
                           M.d_exercise(exercise_master(spark)), M.d_body_part(spark))
    lt = {r.body_part_id: r for r in M.m_last_training(f, dt.date(2025, 2, 1)).collect()}
    assert lt["other"].needs_7day_reminder is False
    assert lt["chest"].needs_7day_reminder is True
    assert lt["other"].needs_3day_reminder is True


def test_rpe_range_and_volume_from_unrounded_weight(spark):
    rows = [(f"r{i}", "u1", "ベンチプレス", "chest", "2025-01-01", 1, 33.33, 3, rpe)
            for i, rpe in enumerate([5.5, 6.0, 10.0, 10.5, None])]
    stg = {r.log_id: r for r in M.stg_training_log(raw_log(spark, rows), tiebreak=()).collect()}
    assert [stg[f"r{i}"].rpe for i in range(5)] == [None, 6.0, 10.0, None, None]
    assert stg["r0"].weight_kg == 33.3 and stg["r0"].volume == 100.0


def test_unicode_padded_name_joins(spark):
    rows = [("x", "u1", "　ベンチプレス ", " CHEST", "2025-01-01", 1, 50.0, 1, 8.0)]
    f = M.fct_training_set(M.stg_training_log(raw_log(spark, rows), tiebreak=()),
                           M.d_exercise(exercise_master(spark)), M.d_body_part(spark)).first()
    assert (f.exercise_id, f.body_part_id) == ("bench_press", "chest")



def test_t6_total_order_without_source_keys(spark):
    # two versions with the same update time and flag: the business columns decide
    r = BATCH16[0]
    a = log_rows([r])[0]
    b = log_rows([r[:6] + (82.5,) + r[7:]])[0]
    for rows in ([a, b], [b, a]):
        got = M.stg_training_log(_log(spark, rows).repartition(2), tiebreak=()).first()
        assert got.weight_kg == 82.5
