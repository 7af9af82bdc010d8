"""Mart models (I1-I14) as DataFrame functions.

Each model takes DataFrames (and ``as_of`` where "today" matters) and returns
a lazy DataFrame; nothing is collected. Aggregations run before name joins
(a user id determines its name), and every dimension join is a broadcast of
a side whose size is checked or fixed.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftlake.functions.exprs import (BODY_PARTS, as_of_date, concat_label, days_between,
                                      month_start, normalise_name, reminder_flags,
                                      rpe_in_range, week_end, week_start)
from liftlake.operators.joins import broadcast_if_bounded
from liftlake.operators.latest import latest_by_key, training_log_order
from liftlake.operators.lists import concat_distinct, concat_list
from liftlake.operators.rank import global_rank, lag_by, rank_in_partition, with_rank_movement
from liftlake.operators.records import records_with_previous
from liftlake.operators.trend import change_vs_lag, moving_average_rows

STG_COLUMNS = ["log_id", "user_id", "exercise_name", "body_part", "training_date", "set_number",
               "weight_kg", "reps", "volume", "rpe", "memo", "created_at", "updated_at"]
FCT_COLUMNS = ["log_id", "user_id", "training_date", "exercise_id", "exercise_name", "is_compound",
               "body_part_id", "body_part_name", "set_number", "weight_kg", "reps", "volume",
               "rpe", "memo", "created_at"]


# I1 ------------------------------------------------------------------------
def cleanse(df: DataFrame) -> DataFrame:
    """Normalised names, 1-digit weight, volume from the unrounded weight,
    RPE outside 6-10 becomes NULL."""
    return df.select(
        "log_id", "user_id",
        normalise_name("exercise_name").alias("exercise_name"),
        normalise_name("body_part").alias("body_part"),
        "training_date", "set_number",
        F.round("weight_kg", 1).alias("weight_kg"),
        "reps",
        F.round(F.col("weight_kg") * F.col("reps"), 1).alias("volume"),
        rpe_in_range("rpe").alias("rpe"),
        "memo", "created_at", "updated_at")


def stg_training_log(raw: DataFrame, tiebreak: Sequence[str] = (),
                     tombstones: bool = False) -> DataFrame:
    """Staging: drop deleted rows, keep the latest version per log_id, cleanse.

    Default (the original semantics): deleted versions are removed *before*
    de-duplication, so an older live version survives a deletion.
    ``tombstones=True`` de-duplicates first and then drops deleted keys.
    """
    # after the given source keys the business columns decide equal versions
    order = training_log_order(tiebreak, () if tiebreak else raw.columns)
    if tombstones:
        latest = latest_by_key(raw, ["log_id"], order)
        latest = latest.where(~F.col("is_deleted"))
    else:
        latest = latest_by_key(raw, ["log_id"], order, where=~F.col("is_deleted"))
    return cleanse(latest)


# I2-I4 ---------------------------------------------------------------------
def d_body_part(spark: SparkSession) -> DataFrame:
    # literal rows, whose size the optimizer knows: joins broadcast them at once
    # instead of planning a shuffle of the other side by a handful of ids
    text = lambda v: "NULL" if v is None else f"'{v}'"
    rows = ", ".join(f"({text(i)}, {text(name)}, {text(day)}, {place}L)" for i, name, day, place in BODY_PARTS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(body_part_id, body_part_name, training_day, sort_order)")


def d_exercise(exercise_master: DataFrame) -> DataFrame:
    return exercise_master.where(F.col("is_active")).select(
        "exercise_id", "exercise_name", "body_part_id", "is_compound", "is_active",
        "display_order", "updated_at")


def d_user(user_master: DataFrame) -> DataFrame:
    return user_master.where(F.col("is_active")).select(
        "user_id", "user_name", "line_user_id", "is_active", "created_at")


# I5 ------------------------------------------------------------------------
def fct_training_set(stg: DataFrame, exercises: DataFrame, body_parts: DataFrame) -> DataFrame:
    """Attach exercise (by normalised name) and body part (by normalised id)."""
    ex = exercises.select(normalise_name("exercise_name").alias("_ex_key"), "exercise_id",
                          F.col("exercise_name").alias("_ex_name"), "is_compound")
    bp = body_parts.select("body_part_id", "body_part_name")
    j = (stg.withColumn("_ex_key", normalise_name("exercise_name"))
            .withColumn("_bp_key", normalise_name("body_part"))
            .join(broadcast_if_bounded(ex), "_ex_key", "left")
            .join(broadcast_if_bounded(bp), F.col("_bp_key") == bp.body_part_id, "left"))
    return j.select("log_id", "user_id", "training_date", "exercise_id",
                    F.col("_ex_name").alias("exercise_name"), "is_compound",
                    bp.body_part_id, "body_part_name", "set_number", "weight_kg", "reps",
                    "volume", "rpe", "memo", "created_at")


def user_names(users: DataFrame) -> DataFrame:
    return broadcast_if_bounded(users.select("user_id", "user_name"))


# I6 ------------------------------------------------------------------------
def m_progress_curve(fct: DataFrame) -> DataFrame:
    daily = fct.groupBy("user_id", "exercise_id", "exercise_name", "is_compound",
                        F.col("training_date").alias("metric_date")).agg(
        F.sum("volume").alias("daily_volume"),
        F.count(F.lit(1)).alias("total_sets"),
        F.max("weight_kg").alias("max_weight"))
    keys = ["user_id", "exercise_id"]
    out = moving_average_rows(daily, keys, "metric_date", "daily_volume", "volume_7d_ma", rows=7)
    return change_vs_lag(out, keys, "metric_date", "volume_7d_ma", "wow_change_pct", offset=7)


# I7 ------------------------------------------------------------------------
def m_last_training(fct: DataFrame, as_of=None) -> DataFrame:
    from pyspark.sql import Window
    today = as_of_date(as_of)
    per_part = fct.groupBy("user_id", "body_part_id", "body_part_name").agg(
        F.max("training_date").alias("last_training_date"))
    # the overall last date is the maximum over the user's body parts: a
    # window over the aggregate instead of a second scan + join of the fact
    last_any = F.max("last_training_date").over(Window.partitionBy("user_id"))
    out = per_part.select(
        "user_id", "body_part_id", "body_part_name", "last_training_date",
        days_between(today, "last_training_date").alias("days_since_last_bodypart"),
        days_between(today, last_any).alias("days_since_last_any"))
    three, seven = reminder_flags("days_since_last_any", "days_since_last_bodypart", "body_part_id")
    return out.withColumn("needs_3day_reminder", three).withColumn("needs_7day_reminder", seven)


# I8-I10 --------------------------------------------------------------------
def _period_ranking(fct: DataFrame, users: DataFrame, period_col: str, period_expr) -> DataFrame:
    totals = fct.groupBy("user_id", period_expr.alias(period_col)).agg(
        F.sum("volume").alias("total_volume"))
    named = totals.join(user_names(users), "user_id", "left")
    ranked = rank_in_partition(named, [period_col], "total_volume")
    prev = lag_by(ranked, ["user_id"], period_col, {"prev_rank": "rank", "prev_volume": "total_volume"})
    return with_rank_movement(prev)


def m_ranking_weekly(fct: DataFrame, users: DataFrame) -> DataFrame:
    out = _period_ranking(fct, users, "week_start", week_start("training_date"))
    return out.select("user_id", "user_name", "week_start",
                      F.date_add("week_start", 6).alias("week_end"), "total_volume", "rank",
                      "prev_rank", "prev_volume", "rank_change", "rank_diff")


def m_ranking_monthly(fct: DataFrame, users: DataFrame) -> DataFrame:
    out = _period_ranking(fct, users, "month", month_start("training_date"))
    return out.select("user_id", "user_name", "month", "total_volume", "rank", "prev_rank",
                      "prev_volume", "rank_change", "rank_diff")


def m_ranking_alltime(fct: DataFrame, users: DataFrame) -> DataFrame:
    totals = fct.groupBy("user_id").agg(F.sum("volume").alias("total_volume"))
    named = totals.join(user_names(users), "user_id", "left")
    ranked = global_rank(named, "total_volume")
    return ranked.select("user_id", "user_name", "total_volume", "rank")


# I11 -----------------------------------------------------------------------
def m_ranking_bodypart(fct: DataFrame, users: DataFrame) -> DataFrame:
    """Weekly, monthly and all-time totals per user and body part in one
    aggregation: each fact row is expanded to its three (type, start) grains
    so a single shuffle serves all three, then ranked per part and period."""
    grains = F.array(
        F.struct(F.lit("weekly").alias("period_type"), week_start("training_date").alias("period_start")),
        F.struct(F.lit("monthly").alias("period_type"), month_start("training_date").alias("period_start")),
        F.struct(F.lit("alltime").alias("period_type"), F.lit(None).cast("date").alias("period_start")))
    expanded = fct.select("user_id", "body_part_id", "body_part_name", "volume",
                          F.inline(grains))
    totals = expanded.groupBy("user_id", "body_part_id", "body_part_name", "period_type",
                              "period_start").agg(F.sum("volume").alias("total_volume"))
    named = totals.join(user_names(users), "user_id", "left")
    ranked = rank_in_partition(named, ["body_part_id", "period_type", "period_start"], "total_volume")
    return ranked.select("user_id", "user_name", "body_part_id", "body_part_name", "period_type",
                         "period_start", "total_volume", "rank")


# I12 -----------------------------------------------------------------------
def m_personal_record(fct: DataFrame, users: DataFrame, as_of=None) -> DataFrame:
    rec = records_with_previous(fct, ["user_id", "exercise_id", "exercise_name"], "training_date",
                                {"max_weight": "weight_kg", "max_volume": "volume"},
                                null_key="exercise_id")
    named = rec.join(user_names(users), "user_id", "left")
    today = as_of_date(as_of)
    return named.select("user_id", "user_name", "exercise_id", "exercise_name", "record_type",
                        "record_value", "achieved_date", "previous_value",
                        (F.datediff(today, F.col("achieved_date")) <= 7).alias("is_new"))


# I13 -----------------------------------------------------------------------
def m_calendar(fct: DataFrame) -> DataFrame:
    """Per user and day: ordered distinct body parts, volume, distinct
    exercises, and the ordered ``name: <max>kg`` summary. Labels go by body
    part and exercise *name* (two ids of one name give one label), the count by
    id: the ids of a name are kept as a set while rows collapse. Two
    aggregations, one scan of the fact."""
    per_name = fct.groupBy("user_id", "training_date", "body_part_name", "exercise_name").agg(
        F.max("weight_kg").alias("max_weight"), F.sum("volume").alias("volume"),
        F.collect_set("exercise_id").alias("ids"))
    return per_name.groupBy("user_id", "training_date").agg(
        concat_distinct("body_part_name", ", ").alias("body_parts"),
        F.sum("volume").alias("total_volume"),
        F.size(F.array_distinct(F.flatten(F.collect_list("ids")))).cast("bigint").alias("exercise_count"),
        concat_list(concat_label("exercise_name", "max_weight"), " / ").alias("exercise_summary"))
