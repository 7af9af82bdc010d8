"""State-changing operations on log and master tables (K4-K13), as batch
transforms: current table + a DataFrame of change requests -> new table.
Change frames are small relative to the tables, so they are broadcast after
a size check; the tables themselves are only scanned. Several changes of one
key in a batch are first reduced to one by a combining aggregate, so a key that
much of a batch names costs a row for each task."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftlake.functions.exprs import as_of_date, normalise_name, ntz, slug, valid_identifier
from liftlake.operators.joins import broadcast_if_bounded


def _now(now: _dt.datetime):
    return ntz(now)


def soft_delete_log_rows(log: DataFrame, ids: DataFrame | None = None, prefix: str | None = None) -> DataFrame:
    """K4: flag raw rows deleted by id list and/or id prefix."""
    cond = F.lit(False)
    out = log
    if ids is not None:
        k = broadcast_if_bounded(ids.select("log_id").distinct().withColumn("_hit", F.lit(True)))
        out = out.join(k, "log_id", "left")
        cond = cond | F.coalesce(F.col("_hit"), F.lit(False))
    if prefix is not None:
        cond = cond | F.col("log_id").startswith(prefix)
    return out.withColumn("is_deleted", F.col("is_deleted") | cond).select(*log.columns)


def submit_requests(requests: DataFrame, master: DataFrame, new: DataFrame,
                    now: _dt.datetime, min_len: int = 2, max_len: int = 30):
    """K5: accept a request as pending unless its name is too short/long, is
    already an exercise (case-insensitive) or is already pending. Within a
    batch the first request (by ``request_id``) of a name wins.

    Returns (decisions, requests_after). decisions: request_id,
    exercise_name, decision in (accepted, invalid_length, exists_in_master,
    pending_duplicate)."""
    names = broadcast_if_bounded(master.select(F.lower("exercise_name").alias("_n")).distinct()
                                 .withColumn("_in_master", F.lit(True)))
    pend = broadcast_if_bounded(requests.where(F.col("status") == "pending")
                                .select(F.lower("exercise_name").alias("_n")).distinct()
                                .withColumn("_pending", F.lit(True)))
    n = (new.withColumn("_n", F.lower("exercise_name"))
            .join(names, "_n", "left").join(pend, "_n", "left"))
    length = F.length("exercise_name")
    decision = (F.when(F.col("exercise_name").isNull() | (length < min_len) | (length > max_len), "invalid_length")
                 .when(F.coalesce(F.col("_in_master"), F.lit(False)), "exists_in_master")
                 .when(F.coalesce(F.col("_pending"), F.lit(False)), "pending_duplicate"))
    n = n.withColumn("decision", decision)
    # the first undecided request of each name: a combinable minimum, so a name
    # that a large share of the batch asks for costs one row a task
    first = (n.where(F.col("decision").isNull()).groupBy("_n").agg(F.min("request_id").alias("_first")))
    n = n.join(first, "_n", "left")
    n = n.withColumn("decision", F.when(F.col("decision").isNull(),
                                        F.when(F.col("request_id") == F.col("_first"), "accepted").otherwise("pending_duplicate"))
                     .otherwise(F.col("decision")))
    decisions = n.select("request_id", "exercise_name", "decision")
    accepted = n.where(F.col("decision") == "accepted").select(
        "request_id", "user_id", "exercise_name", "body_part_id",
        F.when(F.col("reason") == "", None).otherwise(F.col("reason")).alias("reason"),
        F.lit("pending").alias("status"), F.lit(None).cast("string").alias("reviewed_by"),
        _now(now).alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("reviewed_at"))
    return decisions, requests.unionByName(accepted)


def _review(requests: DataFrame, decisions: DataFrame, status: str, now: _dt.datetime) -> DataFrame:
    # of several decisions on one request the first reviewer by name counts
    d = broadcast_if_bounded(decisions.groupBy("request_id").agg(F.min("reviewer").alias("_rev")))
    j = requests.join(d, "request_id", "left")
    hit = F.col("_rev").isNotNull() & (F.col("status") == "pending")
    return j.select(*[
        F.when(hit, F.lit(status)).otherwise(F.col(c)).alias(c) if c == "status" else
        F.when(hit, F.col("_rev")).otherwise(F.col(c)).alias(c) if c == "reviewed_by" else
        F.when(hit, _now(now)).otherwise(F.col(c)).alias(c) if c == "reviewed_at" else
        F.col(c) for c in requests.columns])


def _first_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, first): the smallest ``order`` of each non-NULL key."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("_first"))


def approve_requests(requests: DataFrame, master: DataFrame, approvals: DataFrame,
                     now: _dt.datetime, default_order: int = 10):
    """K6: pending requests become exercises (id = given or slug of the name,
    compound flag and display order as given, default False / 10) and are
    marked approved. Returns (requests_after, master_after).

    Ids and normalised names stay unique in the master: a request whose id or
    name the master has, or that an earlier approved request (by
    ``request_id``) of the batch has too, adds no row; it is marked approved
    all the same, since the exercise it asks for is there."""
    # of several approvals of one request one counts
    rest = [c for c in approvals.columns if c != "request_id"]
    a = approvals.groupBy("request_id").agg(F.min(F.struct(*rest)).alias("_a")).select("request_id", "_a.*")
    for c, v in (("exercise_id", None), ("is_compound", False), ("display_order", default_order)):
        if c not in a.columns:
            a = a.withColumn(c, F.lit(v))
    pend = requests.where(F.col("status") == "pending").select(
        "request_id", F.col("exercise_name").alias("_name"), F.col("body_part_id").alias("_bp"))
    wanted = a.join(pend, "request_id", "inner").select(
        "request_id", normalise_name("_name").alias("_key"),
        F.coalesce(F.col("exercise_id").cast("string"), slug("_name")).alias("exercise_id"),
        F.col("_name").alias("exercise_name"), F.col("_bp").alias("body_part_id"),
        F.coalesce(F.col("is_compound").cast("boolean"), F.lit(False)).alias("is_compound"),
        F.lit(True).alias("is_active"),
        F.coalesce(F.col("display_order").cast("bigint"), F.lit(default_order).cast("bigint")).alias("display_order"),
        _now(now).alias("updated_at"))
    # an id and a name each have their first request
    by_id = _first_of(wanted, "exercise_id", "request_id")
    by_name = _first_of(wanted, "_key", "request_id").withColumnRenamed("_first", "_first_named")
    new_ex = (wanted.join(by_id, "exercise_id").join(by_name, "_key")
              .where((F.col("request_id") == F.col("_first")) & (F.col("request_id") == F.col("_first_named")))
              .join(master.select("exercise_id").distinct(), "exercise_id", "left_anti")
              .join(master.select(normalise_name("exercise_name").alias("_key")).distinct(), "_key", "left_anti"))
    return _review(requests, a, "approved", now), master.unionByName(new_ex.select(*master.columns))


def reject_requests(requests: DataFrame, rejections: DataFrame, now: _dt.datetime) -> DataFrame:
    """K7: pending requests become rejected with reviewer and time."""
    return _review(requests, rejections, "rejected", now)


def deactivate_exercises(master: DataFrame, ids: DataFrame, now: _dt.datetime) -> DataFrame:
    """K8: is_active = FALSE and a new updated_at for the listed ids."""
    k = broadcast_if_bounded(ids.select("exercise_id").distinct().withColumn("_hit", F.lit(True)))
    j = master.join(k, "exercise_id", "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    return j.select(*[
        F.when(hit, F.lit(False)).otherwise(F.col(c)).alias(c) if c == "is_active" else
        F.when(hit, _now(now)).otherwise(F.col(c)).alias(c) if c == "updated_at" else
        F.col(c) for c in master.columns])


def add_exercises(master: DataFrame, new: DataFrame, now: _dt.datetime):
    """K9: manual add; the id must be alphanumeric/underscore (3-30 chars) and
    unused (also within the batch: the first sound row by name wins). Returns
    (decisions, master_after)."""
    fields = ["exercise_id", "exercise_name", "body_part_id", "is_compound", "display_order"]
    # equal rows are one row with a number; they are told apart again at the end
    n = new.select(*fields).groupBy(*fields).agg(F.count(F.lit(1)).alias("_copies"))
    used = broadcast_if_bounded(master.select("exercise_id").distinct().withColumn("_used", F.lit(True)))
    n = n.join(used, "exercise_id", "left")
    flaw = (F.when(F.col("exercise_id").isNull() | F.col("exercise_name").isNull()
                   | (F.col("exercise_name") == ""), "missing_field")
             .when(~valid_identifier("exercise_id"), "invalid_id")
             .when(F.coalesce(F.col("_used"), F.lit(False)), "id_taken"))
    n = n.withColumn("_flaw", flaw).withColumn("_row", F.struct("exercise_name", "body_part_id", "is_compound", "display_order"))
    # the first sound row of an id, so that a faulty one never takes the id
    first = n.where(F.col("_flaw").isNull()).groupBy("exercise_id").agg(F.min("_row").alias("_first"))
    n = n.join(first, "exercise_id", "left")
    n = n.withColumn("_wins", F.col("_flaw").isNull() & F.col("_row").eqNullSafe(F.col("_first")))
    decisions = n.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies")))).select(
        "exercise_id", "exercise_name",
        F.coalesce("_flaw", F.when(F.col("_wins") & (F.col("_copy") == 1), "accepted").otherwise("id_taken")).alias("decision"))
    rows = n.where("_wins").select(
        "exercise_id", "exercise_name", "body_part_id",
        F.coalesce(F.col("is_compound").cast("boolean"), F.lit(False)).alias("is_compound"),
        F.lit(True).alias("is_active"),
        F.coalesce(F.col("display_order").cast("bigint"), F.lit(10).cast("bigint")).alias("display_order"),
        _now(now).alias("updated_at"))
    return decisions, master.unionByName(rows)


def update_exercise_flag(master: DataFrame, exercise_id: str, is_compound: bool) -> DataFrame:
    """Set is_compound of one exercise."""
    return master.withColumn("is_compound", F.when(F.col("exercise_id") == exercise_id, F.lit(is_compound))
                             .otherwise(F.col("is_compound")))


VALIDATION_RULES = ["weight_required", "weight_range", "reps_required", "reps_range", "rpe_range",
                    "date_future", "date_too_old", "set_number_range", "memo_too_long"]


def validate_input_rows(rows: DataFrame, as_of=None, max_age_days: int = 90):
    """One boolean per rule, collected into an ``errors`` array.
    Returns (checked rows with ``errors`` and ``is_valid``, good, rejected)."""
    today = as_of_date(as_of)
    w, r, rpe = F.col("weight_kg"), F.col("reps"), F.col("rpe")
    checks = [
        ("weight_required", w.isNull()),
        ("weight_range", w.isNotNull() & ((w < 0) | (w > 500))),
        ("reps_required", r.isNull()),
        ("reps_range", r.isNotNull() & ((r < 1) | (r > 100))),
        ("rpe_range", rpe.isNotNull() & ((rpe < 6.0) | (rpe > 10.0))),
        ("date_future", F.col("training_date") > today),
        ("date_too_old", F.col("training_date") < F.date_sub(today, max_age_days)),
        ("set_number_range", (F.col("set_number") < 1) | (F.col("set_number") > 20)),
        ("memo_too_long", F.coalesce(F.length("memo"), F.lit(0)) > 200),
    ]
    errs = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks]))
    out = rows.withColumn("errors", errs).withColumn("is_valid", F.size("errors") == 0)
    return out, out.where("is_valid"), out.where("NOT is_valid")


def autosave_gate(rows: DataFrame) -> DataFrame:
    """Only rows with a positive weight and reps are auto-saved."""
    return rows.where((F.col("weight_kg") > 0) & (F.col("reps") > 0))


def maintain_users(users: DataFrame, changes: DataFrame, order: str | None = None) -> DataFrame:
    """Insert unknown users; for known users take the changed push
    address (other columns keep their values).

    Several changes of a user are one: of each column the newest value by
    ``order`` that is not NULL counts (the greatest value without an order).
    Changes without a user id are left out."""
    fields = [c for c in users.columns if c != "user_id" and c in changes.columns]

    def newest(c: str):
        at = F.struct(*([order] if order else []), c)
        return F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_new_{c}")
    one = (changes.where(F.col("user_id").isNotNull()).groupBy(F.col("user_id").alias("_user"))
           .agg(F.count(F.lit(1)).alias("_seen"), *[newest(c) for c in fields]))
    # one full outer join: known, changed and new users at once
    both = users.withColumn("_known", F.lit(True)).join(one, F.col("user_id") == F.col("_user"), "full")

    def value(c: str):
        if c == "user_id":
            return F.coalesce("user_id", "_user").alias(c)
        if c not in fields:
            return F.col(c)
        if c == "line_user_id":
            return F.coalesce(f"_new_{c}", c).alias(c)
        return F.when(F.col("_known"), F.col(c)).otherwise(F.col(f"_new_{c}")).alias(c)
    return both.select(*[value(c) for c in users.columns])


def optional_filter(df: DataFrame, column: str, value, all_value: str = "all") -> DataFrame:
    """Add the predicate only when a concrete choice was made."""
    if value is None or value == all_value:
        return df
    return df.where(F.col(column) == value)


def case_insensitive_match(df: DataFrame, column: str, name: str) -> DataFrame:
    """LOWER(column) = LOWER(name)."""
    return df.where(F.lower(F.col(column)) == F.lower(F.lit(name)))


def not_deleted(df: DataFrame, column: str = "is_deleted") -> DataFrame:
    """The soft-delete filter (a missing flag counts as live)."""
    return df.where(~F.coalesce(F.col(column), F.lit(False)))
