"""More semantic traps and hot-key behaviour."""

import datetime as dt

from literal import BATCH16, TS, exercise_master, log_rows, raw_log
from pyspark.sql import functions as F

from liftlake import schemas
from liftlake.operators.latest import latest_by_key
from liftlake.operators.quality import exercise_name_unique
from liftlake.operators.rank import global_rank
from liftlake.operators.trend import moving_average_days, moving_average_rows
from liftlake.operators.upsert import merge_upsert, watermark_filter
from liftlake.plans import models as M
from liftlake.plans import notify as NT
from liftlake.plans import reports as R

NO_USERS = schemas.USER_MASTER


def _fact(spark, rows):
    return M.fct_training_set(M.stg_training_log(raw_log(spark, rows), tiebreak=()),
                              M.d_exercise(exercise_master(spark)), M.d_body_part(spark))


def test_t2_tombstones_option(spark):
    t = spark.createDataFrame([(1, "a", False), (2, "b", False)], "k int, v string, deleted boolean")
    s = spark.createDataFrame([(1, "a", True), (3, "c", False)], "k int, v string, deleted boolean")
    assert sorted(map(tuple, merge_upsert(t, s, ["k"]).collect())) == [(1, "a", True), (2, "b", False), (3, "c", False)]
    assert sorted(r.k for r in merge_upsert(t, s, ["k"], delete_when="deleted").collect()) == [2, 3]


def test_t5_late_rows_and_lookback(spark):
    src = spark.createDataFrame([(dt.datetime(2025, 1, 1, 10),), (dt.datetime(2025, 1, 1, 12),)], "u timestamp_ntz")
    tgt = spark.createDataFrame([(dt.datetime(2025, 1, 1, 12),)], "u timestamp_ntz")
    assert watermark_filter(src, "u", tgt, "u").count() == 0          # strict >, late row lost
    assert watermark_filter(src, "u", tgt, "u", lookback=dt.timedelta(hours=3)).count() == 2


def test_t7_rows_not_days(spark):
    days = [dt.date(2025, 1, 1) + dt.timedelta(days=d) for d in (0, 1, 20)]
    df = spark.createDataFrame([("u", d, float(i + 1)) for i, d in enumerate(days)], "k string, d date, v double")
    rows = {r.d: r.m for r in moving_average_rows(df, ["k"], "d", "v", "m", rows=7).collect()}
    cal = {r.d: r.m for r in moving_average_days(df, ["k"], "d", "v", "m", days=7).collect()}
    assert rows[days[2]] == 2.0 and cal[days[2]] == 3.0


def test_t8_previous_participating_period(spark):
    rows = [("a", "u1", "ベンチプレス", "chest", "2025-01-06", 1, 50.0, 2, 8.0),
            ("b", "u1", "ベンチプレス", "chest", "2025-01-27", 1, 50.0, 1, 8.0)]
    w = M.m_ranking_weekly(_fact(spark, rows), M.d_user(spark.createDataFrame([], NO_USERS)))
    late = w.where("week_start = DATE'2025-01-27'").first()
    assert (late.prev_rank, late.prev_volume, late.rank_change) == (1, 100.0, "SAME")


def test_t19_summary_order_is_deterministic(spark):
    f = _fact(spark, BATCH16)
    a = M.m_calendar(f).collect()
    b = M.m_calendar(f.repartition(7).orderBy(F.rand(1))).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_t25_name_uniqueness_check(spark):
    m = exercise_master(spark)
    assert exercise_name_unique(m).count() == 0
    dup = m.unionByName(m.where("exercise_id = 'squat'").withColumn("exercise_id", F.lit("squat2"))
                        .withColumn("exercise_name", F.lit(" スクワット　")))
    assert [r.name_key for r in exercise_name_unique(dup).collect()] == ["スクワット"]


def test_t26_screen_joins_raw_body_part(spark):
    rows = [("x", "u1", "ベンチプレス", "CHEST", "2025-01-20", 1, 50.0, 2, 8.0)]
    wk = R.current_week(raw_log(spark, rows), M.d_body_part(spark), dt.date(2025, 1, 22)).first()
    assert wk.body_parts is None and wk.total_volume == 100.0
    assert _fact(spark, rows).first().body_part_id == "chest"


def test_t27_inactive_exercise_loses_its_id(spark):
    m = exercise_master(spark).withColumn("is_active", F.col("exercise_id") != "squat")
    f = M.fct_training_set(M.stg_training_log(raw_log(spark, BATCH16), tiebreak=()), M.d_exercise(m),
                           M.d_body_part(spark))
    assert f.where("exercise_id IS NULL").count() == 3


def test_t28_t29_t30_notification_gates(spark):
    users = spark.createDataFrame([("u1", "A", "L1", False, True, TS), ("u2", "B", "L2", False, True, TS)],
                                  schemas.USER_MASTER)
    now = dt.datetime(2025, 1, 31, 16, 0)
    # the sender *received* a start notice today: the original's check finds it
    log = spark.createDataFrame([("n", "u1", "start", "sent", dt.datetime(2025, 1, 31, 15, 30))], schemas.NOTIFICATION_LOG)
    assert NT.start_plan(log, users, "u1", "chest", now, base_count=0)[0] == "already_sent"
    assert NT.start_plan(log, users, "u2", "chest", now, base_count=0)[0] == "completed"
    # batch gate: at 199 every other user still gets the notice
    status, plan = NT.start_plan(log.where("false"), users, "u1", "chest", now, base_count=199)
    assert status == "completed" and plan.count() == 1
    # a closed gate at the start logs nothing
    three = spark.createDataFrame([("u1", 5)], "user_id string, days_since_last_any int")
    seven = spark.createDataFrame([], "user_id string, body_part_name string, last_training_date date")
    assert NT.daily_plan(three, seven, 190).count() == 0
    assert [r.status for r in NT.daily_plan(three, seven, 189).collect()] == ["sent"]


def test_t31_d_user_has_no_admin_flag(spark):
    u = spark.createDataFrame([("u1", "A", "L1", True, True, TS)], schemas.USER_MASTER)
    assert M.d_user(u).columns == ["user_id", "user_name", "line_user_id", "is_active", "created_at"]


def test_hot_key_dedup_and_rank(spark):
    # one key holds a third of all rows; the aggregate combines it map-side
    rows = [("hot", i, False) for i in range(300)] + [(f"k{i}", i, False) for i in range(600)]
    df = spark.createDataFrame(rows, "log_id string, updated_at int, is_deleted boolean").repartition(8)
    latest = latest_by_key(df, ["log_id"], [F.col("updated_at")])
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        latest.explain()
    assert "partial_max_by" in buf.getvalue()
    got = {r.log_id: r.updated_at for r in latest.collect()}
    assert got["hot"] == 299 and len(got) == 601
    vals = spark.createDataFrame([(i, 7 if i % 3 == 0 else i) for i in range(900)], "id int, v int")
    ranks = {r.id: r.rank for r in global_rank(vals, "v").collect()}
    greater_than_7 = sum(1 for i in range(900) if i % 3 != 0 and i > 7)
    assert ranks[0] == greater_than_7 + 1 and ranks[3] == ranks[0]

