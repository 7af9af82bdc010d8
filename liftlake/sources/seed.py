"""Literal tables, seeded master rows and parameterised SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftlake import schemas

# ---------------------------------------------------------------------------
# The application's seeded masters (3 users, 19 exercises)
# ---------------------------------------------------------------------------
SEED_USERS = [
    ("user_001", "ユーザー1", "U_LINE_ID_001", True, True),
    ("user_002", "ユーザー2", "U_LINE_ID_002", False, True),
    ("user_003", "ユーザー3", "U_LINE_ID_003", False, True),
]
SEED_EXERCISES = [
    ("bench_press", "ベンチプレス", "chest", True, True, 1),
    ("incline_db_press", "インクラインDBプレス", "chest", False, True, 2),
    ("cable_fly", "ケーブルフライ", "chest", False, True, 3),
    ("dips", "ディップス", "chest", False, True, 4),
    ("half_deadlift", "ハーフデッドリフト", "back", True, True, 1),
    ("lat_pulldown", "ラットプルダウン", "back", False, True, 2),
    ("seated_row", "シーテッドロウ", "back", False, True, 3),
    ("overhead_press", "オーバーヘッドプレス", "shoulder", True, True, 1),
    ("side_raise", "サイドレイズ", "shoulder", False, True, 2),
    ("face_pull", "フェイスプル", "shoulder", False, True, 3),
    ("squat", "スクワット", "leg", True, True, 1),
    ("leg_press", "レッグプレス", "leg", False, True, 2),
    ("leg_curl", "レッグカール", "leg", False, True, 3),
    ("leg_extension", "レッグエクステンション", "leg", False, True, 4),
    ("barbell_curl", "バーベルカール", "arm", False, True, 1),
    ("triceps_pushdown", "トライセプスプッシュダウン", "arm", False, True, 2),
    ("hammer_curl", "ハンマーカール", "arm", False, True, 3),
    ("plank", "プランク", "other", False, True, 1),
    ("ab_rollout", "アブローラー", "other", False, True, 2),
]
# ---------------------------------------------------------------------------


def seed_rows(spark: SparkSession, rows: list[tuple], schema, ts_column: str) -> DataFrame:
    """Literal rows plus the load time in ``ts_column``."""
    fields = [f for f in schema.fields if f.name != ts_column]
    from pyspark.sql import types as T
    df = spark.createDataFrame(rows, T.StructType(fields))
    return df.withColumn(ts_column, F.localtimestamp()).select(*schema.fieldNames())


def seed_users(spark: SparkSession) -> DataFrame:
    return seed_rows(spark, SEED_USERS, schemas.USER_MASTER, "created_at")


def seed_exercises(spark: SparkSession) -> DataFrame:
    return seed_rows(spark, SEED_EXERCISES, schemas.EXERCISE_MASTER, "updated_at")


def inline_dimension(spark: SparkSession) -> DataFrame:
    """The body-part dimension built in SQL from literals (typed NULL
    training day for 'other')."""
    from liftlake.functions.exprs import BODY_PARTS
    items = ", ".join(
        "named_struct('body_part_id', {}, 'body_part_name', {}, 'training_day', {}, 'sort_order', CAST({} AS BIGINT))"
        .format(*[f"'{v}'" if isinstance(v, str) else ("CAST(NULL AS STRING)" if v is None else str(v)) for v in bp])
        for bp in BODY_PARTS)
    return spark.sql(f"SELECT inline(array({items}))")


def parameterised_query(spark: SparkSession, sql: str, **params) -> DataFrame:
    """Named parameters (``:name`` markers) bound by Spark, never
    formatted into the SQL text."""
    return spark.sql(sql, args=params)
