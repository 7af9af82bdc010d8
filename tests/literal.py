"""Literal fixtures: the application's 16-row first batch, its seeded users
and the exercises that batch uses (test data of the original project)."""

from __future__ import annotations

import datetime as dt

from liftlake import schemas

TS = dt.datetime(2025, 1, 20, 12, 0, 0)

# (log_id, user, exercise, part, date, set, weight, reps, rpe)
BATCH16 = [
    ("test-001", "user_001", "ベンチプレス", "chest", "2025-01-20", 1, 80.0, 5, 8.0),
    ("test-002", "user_001", "ベンチプレス", "chest", "2025-01-20", 2, 85.0, 3, 9.0),
    ("test-003", "user_001", "ベンチプレス", "chest", "2025-01-20", 3, 90.0, 1, 9.5),
    ("test-004", "user_001", "インクラインDBプレス", "chest", "2025-01-20", 1, 30.0, 10, 7.5),
    ("test-005", "user_001", "インクラインDBプレス", "chest", "2025-01-20", 2, 32.5, 8, 8.0),
    ("test-006", "user_002", "ハーフデッドリフト", "back", "2025-01-20", 1, 100.0, 5, 8.0),
    ("test-007", "user_002", "ハーフデッドリフト", "back", "2025-01-20", 2, 110.0, 3, 8.5),
    ("test-008", "user_002", "ハーフデッドリフト", "back", "2025-01-20", 3, 120.0, 1, 9.5),
    ("test-009", "user_001", "ベンチプレス", "chest", "2025-01-17", 1, 77.5, 5, 8.0),
    ("test-010", "user_001", "ベンチプレス", "chest", "2025-01-17", 2, 82.5, 3, 8.5),
    ("test-011", "user_001", "ベンチプレス", "chest", "2025-01-17", 3, 87.5, 1, 9.5),
    ("test-012", "user_003", "スクワット", "leg", "2025-01-20", 1, 100.0, 8, 8.0),
    ("test-013", "user_003", "スクワット", "leg", "2025-01-20", 2, 110.0, 5, 8.5),
    ("test-014", "user_003", "スクワット", "leg", "2025-01-20", 3, 120.0, 3, 9.0),
    ("test-015", "user_003", "レッグプレス", "leg", "2025-01-20", 1, 150.0, 12, 7.5),
    ("test-016", "user_003", "レッグプレス", "leg", "2025-01-20", 2, 160.0, 10, 8.0),
]

EXERCISES = [
    ("bench_press", "ベンチプレス", "chest", True, True, 1),
    ("incline_db_press", "インクラインDBプレス", "chest", False, True, 2),
    ("half_deadlift", "ハーフデッドリフト", "back", True, True, 1),
    ("squat", "スクワット", "leg", True, True, 1),
    ("leg_press", "レッグプレス", "leg", False, True, 2),
]

USERS = [
    ("user_001", "ユーザー1", "U_LINE_ID_001", True, True),
    ("user_002", "ユーザー2", "U_LINE_ID_002", False, True),
    ("user_003", "ユーザー3", "U_LINE_ID_003", False, True),
]


def log_rows(rows, ts=TS, deleted=False, updated=None):
    out = []
    for (lid, u, ex, bp, d, sn, w, r, rpe) in rows:
        out.append((lid, u, ex, bp, dt.date.fromisoformat(d), sn, w, r, rpe, None, "streamlit", ts,
                    updated or ts, deleted))
    return out


def raw_log(spark, rows=None):
    return spark.createDataFrame(log_rows(rows or BATCH16), schemas.TRAINING_LOG)


def exercise_master(spark):
    return spark.createDataFrame([e + (TS,) for e in EXERCISES], schemas.EXERCISE_MASTER)


def user_master(spark):
    return spark.createDataFrame([u[:3] + (u[3], u[4], TS) for u in USERS], schemas.USER_MASTER)


def fact(spark, rows=None):
    from liftlake.plans import models as M
    stg = M.stg_training_log(raw_log(spark, rows), tiebreak=())
    return M.fct_training_set(stg, M.d_exercise(exercise_master(spark)), M.d_body_part(spark))
