"""Table-driven data-quality checks.

A check is (model, column, kind, args). ``run_suite`` evaluates all checks of
a table in as few passes as possible: every not_null / between / accepted
values check of one table is a count inside a single aggregate (one scan),
and all uniqueness checks of all tables are one stacked aggregate by (check,
key). Foreign keys are checked likewise: children and parents of all
relations are stacked and grouped once, without a join. A check of a model
without a table is an error. The result has one row per
check: model, column_name, check_name, failures, status ('pass' or the
severity, e.g. 'warn'); a failing check never stops the job.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    model: str
    column: str
    kind: str  # not_null | unique | accepted_values | between
    args: tuple = field(default=())


def not_null(df: DataFrame, col: str) -> DataFrame:
    """L1: failing rows."""
    return df.where(F.col(col).isNull())


def unique(df: DataFrame, col: str) -> DataFrame:
    """L2: repeated non-NULL key values with their counts."""
    return (df.where(F.col(col).isNotNull()).groupBy(col)
              .agg(F.count(F.lit(1)).alias("n_records")).where("n_records > 1"))


def accepted_values(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """L3: values outside the list, counted per value (NULL passes)."""
    return (df.where(F.col(col).isNotNull() & ~F.col(col).isin(list(values))).groupBy(col)
              .agg(F.count(F.lit(1)).alias("n_records")))


def between(df: DataFrame, col: str, lo, hi) -> DataFrame:
    """L4: rows outside [lo, hi] (NULL passes)."""
    return df.where(F.col(col).isNotNull() & ~F.col(col).between(lo, hi))


def referential(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose non-NULL key has no parent."""
    p = parent.select(F.col(parent_key).alias(child_key)).distinct()
    return child.where(F.col(child_key).isNotNull()).join(p, child_key, "left_anti")


def _row_checks(df: DataFrame, model: str, checks: list[Check]) -> DataFrame:
    aggs = []
    for i, c in enumerate(checks):
        col = F.col(c.column)
        if c.kind == "not_null":
            aggs.append(F.count_if(col.isNull()).alias(f"c{i}"))
        elif c.kind == "accepted_values":
            aggs.append(F.count_distinct(F.when(~col.isin(list(c.args)), col)).alias(f"c{i}"))
        else:
            lo, hi = c.args
            aggs.append(F.count_if(~col.between(lo, hi)).alias(f"c{i}"))
    one = df.agg(*aggs)
    stack = ", ".join(f"{i}, c{i}" for i in range(len(checks)))
    long = one.select(F.expr(f"stack({len(checks)}, {stack}) AS (idx, failures)"))
    meta = df.sparkSession.createDataFrame(
        [(i, model, c.column, c.kind) for i, c in enumerate(checks)],
        "idx int, model string, column_name string, check_name string")
    return long.join(F.broadcast(meta), "idx").select("model", "column_name", "check_name",
                                                       F.col("failures").cast("bigint"))


def _unique_checks(tables: dict[str, DataFrame], checks: list[Check]) -> DataFrame:
    """All uniqueness checks in one pass: keys of every checked column under
    the number of their check, counted by one combining aggregate."""
    parts = [tables[c.model].where(F.col(c.column).isNotNull()).select(
        F.lit(i).alias("idx"), F.col(c.column).cast("string").alias("key")) for i, c in enumerate(checks)]
    keys = reduce(DataFrame.unionByName, parts).groupBy("idx", "key").agg(F.count(F.lit(1)).alias("n"))
    failed = keys.groupBy("idx").agg(F.count_if(F.col("n") > 1).alias("failures"))
    spark = parts[0].sparkSession
    meta = spark.createDataFrame([(i, c.model, c.column, c.kind) for i, c in enumerate(checks)],
                                 "idx int, model string, column_name string, check_name string")
    return meta.join(failed, "idx", "left").select(
        "model", "column_name", "check_name", F.coalesce("failures", F.lit(0)).cast("bigint").alias("failures"))


def run_suite(tables: dict[str, DataFrame], checks: Sequence[Check], severity: str = "warn") -> DataFrame:
    """One row per check with its failure count and status."""
    parts = []
    by_model: dict[str, list[Check]] = {}
    unique_checks = [c for c in checks if c.kind == "unique"]
    for c in checks:
        if c.model not in tables:
            raise KeyError(f"no table for the check of {c.model}.{c.column}")
        if c.kind != "unique":
            by_model.setdefault(c.model, []).append(c)
    if unique_checks:
        parts.append(_unique_checks(tables, unique_checks))
    for model, cs in by_model.items():
        parts.append(_row_checks(tables[model], model, cs))
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("status", F.when(F.col("failures") != 0, F.lit(severity)).otherwise(F.lit("pass")))


@dataclass(frozen=True)
class Relation:
    """A foreign key: every non-NULL child value is a parent value."""
    child: str
    column: str
    parent: str
    parent_column: str


# Fixed values. L8: the declared foreign keys.
DECLARED_RELATIONS = [Relation(*r) for r in (
    ("training_log", "user_id", "user_master", "user_id"),
    ("training_log", "exercise_name", "exercise_master", "exercise_name"),
    ("exercise_master", "body_part_id", "d_body_part", "body_part_id"),
    ("exercise_request", "user_id", "user_master", "user_id"),
    ("exercise_request", "body_part_id", "d_body_part", "body_part_id"),
    ("exercise_request", "reviewed_by", "user_master", "user_id"),
    ("notification_log", "user_id", "user_master", "user_id"),
    ("stg_training_log", "log_id", "training_log", "log_id"),
    ("fct_training_set", "user_id", "d_user", "user_id"),
    ("fct_training_set", "exercise_id", "d_exercise", "exercise_id"),
    ("fct_training_set", "body_part_id", "d_body_part", "body_part_id"),
    ("d_exercise", "body_part_id", "d_body_part", "body_part_id"),
    ("m_progress_curve", "user_id", "d_user", "user_id"),
    ("m_progress_curve", "exercise_id", "d_exercise", "exercise_id"),
    ("m_last_training", "user_id", "d_user", "user_id"),
    ("m_last_training", "body_part_id", "d_body_part", "body_part_id"),
    ("m_ranking_weekly", "user_id", "d_user", "user_id"),
    ("m_ranking_monthly", "user_id", "d_user", "user_id"),
    ("m_ranking_alltime", "user_id", "d_user", "user_id"),
    ("m_ranking_bodypart", "user_id", "d_user", "user_id"),
    ("m_ranking_bodypart", "body_part_id", "d_body_part", "body_part_id"),
    ("m_personal_record", "user_id", "d_user", "user_id"),
    ("m_personal_record", "exercise_id", "d_exercise", "exercise_id"),
    ("m_calendar", "user_id", "d_user", "user_id"),
    ("m_ml_suggestion", "user_id", "d_user", "user_id"),
    ("m_ml_suggestion", "exercise_id", "d_exercise", "exercise_id"),
)]


def run_relations(tables: dict[str, DataFrame], relations: Sequence[Relation], severity: str = "warn") -> DataFrame:
    """One row per relation: child rows without a parent (``failures``),
    their distinct values (``orphan_keys``) and the status.

    Every table is read once: a row gives one stacked row (relation, key, is it
    a parent) for each relation that its table is in. One combining aggregate
    by (relation, key) then tells orphans, so a key that a large share of the
    rows holds costs a row for each task, and no join is needed."""
    for name in {t for r in relations for t in (r.child, r.parent)} - set(tables):
        raise KeyError(f"no table for the relations of {name}")
    uses: dict[str, list] = {}
    for i, r in enumerate(relations):
        uses.setdefault(r.child, []).append((i, r.column, 1))
        uses.setdefault(r.parent, []).append((i, r.parent_column, 0))
    stacked = []
    for name, own in uses.items():
        rows = F.array(*[F.struct(F.lit(i).alias("idx"), F.col(c).cast("string").alias("key"), F.lit(n).cast("bigint").alias("child"))
                         for i, c, n in own])
        stacked.append(tables[name].select(F.inline(rows)).where(F.col("key").isNotNull()))
    keys = reduce(DataFrame.unionByName, stacked).groupBy("idx", "key").agg(
        F.sum("child").alias("rows"), F.min("child").alias("all_children"))
    orphan = F.col("all_children") == 1
    found = keys.groupBy("idx").agg(F.sum(F.when(orphan, F.col("rows"))).alias("failures"), F.count_if(orphan).alias("orphan_keys"))
    meta = stacked[0].sparkSession.createDataFrame(
        [(i, r.child, r.column, r.parent, r.parent_column) for i, r in enumerate(relations)],
        "idx int, model string, column_name string, parent string, parent_column string")
    out = meta.join(found, "idx", "left").select(
        "model", "column_name", "parent", "parent_column",
        F.coalesce("failures", F.lit(0)).cast("bigint").alias("failures"), F.coalesce("orphan_keys", F.lit(0)).cast("bigint").alias("orphan_keys"))
    return out.withColumn("status", F.when(F.col("failures") != 0, F.lit(severity)).otherwise(F.lit("pass")))


BODY_PART_IDS = ("chest", "back", "shoulder", "leg", "arm", "other")

# Fixed values. L7: the declared suite (staging, dimensions, fact, metrics,
# ML), plus the range checks on the fact.
DOCUMENTED_SUITE = [
    Check("stg_training_log", "log_id", "unique"),
    Check("stg_training_log", "log_id", "not_null"),
    Check("stg_training_log", "user_id", "not_null"),
    Check("stg_training_log", "exercise_name", "not_null"),
    Check("stg_training_log", "training_date", "not_null"),
    Check("stg_training_log", "weight_kg", "not_null"),
    Check("stg_training_log", "reps", "not_null"),
    Check("stg_training_log", "volume", "not_null"),
    Check("d_body_part", "body_part_id", "unique"),
    Check("d_body_part", "body_part_id", "not_null"),
    Check("d_exercise", "exercise_id", "unique"),
    Check("d_exercise", "exercise_id", "not_null"),
    Check("d_exercise", "body_part_id", "not_null"),
    Check("d_exercise", "body_part_id", "accepted_values", BODY_PART_IDS),
    Check("d_user", "user_id", "unique"),
    Check("d_user", "user_id", "not_null"),
    Check("fct_training_set", "log_id", "unique"),
    Check("fct_training_set", "log_id", "not_null"),
    Check("fct_training_set", "user_id", "not_null"),
    Check("fct_training_set", "training_date", "not_null"),
    Check("fct_training_set", "weight_kg", "not_null"),
    Check("fct_training_set", "weight_kg", "between", (0, 500)),
    Check("fct_training_set", "reps", "not_null"),
    Check("fct_training_set", "reps", "between", (1, 100)),
    Check("fct_training_set", "rpe", "between", (6.0, 10.0)),
    Check("fct_training_set", "volume", "not_null"),
    Check("fct_training_set", "volume", "between", (0, 50000)),
    Check("m_progress_curve", "user_id", "not_null"),
    Check("m_progress_curve", "exercise_id", "not_null"),
    Check("m_progress_curve", "metric_date", "not_null"),
    Check("m_last_training", "user_id", "not_null"),
    Check("m_last_training", "body_part_id", "not_null"),
    Check("m_ranking_weekly", "rank", "not_null"),
    Check("m_ranking_monthly", "rank", "not_null"),
    Check("m_ranking_alltime", "rank", "not_null"),
    Check("m_ranking_bodypart", "rank", "not_null"),
    Check("m_ranking_bodypart", "period_type", "accepted_values", ("weekly", "monthly", "alltime")),
    Check("m_personal_record", "record_type", "accepted_values", ("max_weight", "max_volume")),
    Check("m_calendar", "user_id", "not_null"),
    Check("m_calendar", "training_date", "not_null"),
    Check("m_ml_suggestion", "user_id", "not_null"),
    Check("m_ml_suggestion", "exercise_id", "not_null"),
    Check("m_ml_suggestion", "suggested_weight_kg", "not_null"),
    Check("m_ml_suggestion", "suggested_reps", "not_null"),
    Check("m_ml_suggestion", "model_version", "not_null"),
]


def planned_checks(curve: DataFrame, users: DataFrame, ranking: DataFrame, fct: DataFrame,
                   max_sets_per_day: int = 100) -> DataFrame:
    """Change-curve volume within 0-100000, every active user present in
    the all-time ranking, no user-day with more than ``max_sets_per_day``."""
    a = between(curve, "daily_volume", 0, 100000).agg(F.count(F.lit(1)).alias("failures")) \
        .select(F.lit("m_progress_curve").alias("model"), F.lit("daily_volume").alias("column_name"),
                F.lit("between").alias("check_name"), "failures")
    b = users.select("user_id").join(ranking.select("user_id"), "user_id", "left_anti") \
        .agg(F.count(F.lit(1)).alias("failures")) \
        .select(F.lit("m_ranking_alltime").alias("model"), F.lit("user_id").alias("column_name"),
                F.lit("all_users_ranked").alias("check_name"), "failures")
    c = fct.groupBy("user_id", "training_date").agg(F.count(F.lit(1)).alias("n")) \
        .where(F.col("n") > max_sets_per_day).agg(F.count(F.lit(1)).alias("failures")) \
        .select(F.lit("fct_training_set").alias("model"), F.lit("training_date").alias("column_name"),
                F.lit("sets_per_day").alias("check_name"), "failures")
    out = a.unionByName(b).unionByName(c).withColumn("failures", F.col("failures").cast("bigint"))
    return out.withColumn("status", F.when(F.col("failures") != 0, "warn").otherwise("pass"))


def exercise_name_unique(master: DataFrame) -> DataFrame:
    """T25 guard: normalised active exercise names must be unique (the fact
    joins by name)."""
    from liftlake.functions.exprs import normalise_name
    return unique(master.where("is_active").select(normalise_name("exercise_name").alias("name_key")), "name_key")
