"""Report queries behind the application's screens.

Each screen query filtered on one user. Here every report takes an optional
``user_id``: ``None`` computes the report for all users at once (one
distributed job, grouped by user), a value restricts it to that user's rows
before any other work, as the screen did. Parameters are column literals;
nothing is interpolated into SQL text.
"""

from __future__ import annotations

import datetime as _dt
from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from liftlake.functions.exprs import (as_of_date, format_volume, month_end, ntz, percent_difference,
                                      week_end, week_start)
from liftlake.operators.joins import broadcast_if_bounded
from liftlake.operators.latest import latest_by_key, training_log_order
from liftlake.operators.lists import concat_distinct


def _user(df: DataFrame, user_id: str | None, col: str = "user_id") -> DataFrame:
    return df if user_id is None else df.where(F.col(col) == user_id)


def _live_latest(raw: DataFrame, start, end, user_id=None, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Filter user and date range *before* de-duplication (screen semantics),
    keep each (user, log_id)'s latest version, then drop deleted ones."""
    r = _user(raw, user_id).where(F.col("training_date").between(start, end))
    latest = latest_by_key(r, ["user_id", "log_id"], training_log_order(tiebreak, () if tiebreak else raw.columns))
    return latest.where(~F.col("is_deleted"))


def current_week(raw: DataFrame, body_parts: DataFrame, as_of=None, user_id=None,
                 tiebreak: Sequence[str] = ()) -> DataFrame:
    """Per user and day of the Monday-Sunday week of ``as_of``: body parts
    (raw id joined without normalising), volume (sum of per-row rounded
    volume) and distinct exercise names."""
    d = as_of_date(as_of)
    live = _live_latest(raw, week_start(d), week_end(d), user_id, tiebreak)
    bp = broadcast_if_bounded(body_parts.select("body_part_id", "body_part_name"))
    j = live.join(bp, live.body_part == bp.body_part_id, "left")
    return j.groupBy("user_id", "training_date").agg(
        concat_distinct("body_part_name", ", ").alias("body_parts"),
        F.sum(F.round(F.col("weight_kg") * F.col("reps"), 1)).alias("total_volume"),
        F.countDistinct("exercise_name").alias("exercise_count"))


def week_grid(week: DataFrame, users: DataFrame, as_of=None, user_id=None) -> DataFrame:
    """Seven calendar days per user left-joined to N1; rest days empty."""
    d = as_of_date(as_of)
    days = _user(users, user_id).select("user_id", F.explode(F.sequence(week_start(d), week_end(d))).alias("training_date"))
    return days.join(week, ["user_id", "training_date"], "left").select(
        "user_id", "training_date", F.dayofweek("training_date").alias("weekday"),
        "body_parts", "total_volume", "exercise_count",
        F.col("total_volume").isNotNull().alias("trained"))


def week_summary(week: DataFrame) -> DataFrame:
    """Days trained and total volume per user."""
    return week.groupBy("user_id").agg(F.count(F.lit(1)).alias("training_days"),
                                       F.sum("total_volume").alias("total_volume"))


def last_week_summary(raw: DataFrame, as_of=None, user_id=None, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Distinct training days and volume of the previous week. For one
    user it is a global aggregate (one row, NULL volume without data)."""
    d = as_of_date(as_of)
    start = F.date_sub(week_start(d), 7)
    live = _live_latest(raw, start, F.date_sub(week_start(d), 1), user_id, tiebreak)
    aggs = [F.countDistinct("training_date").alias("training_days"),
            F.sum(F.round(F.col("weight_kg") * F.col("reps"), 1)).alias("total_volume")]
    if user_id is not None:
        return live.agg(*aggs).select(F.lit(user_id).alias("user_id"), "*")
    return live.groupBy("user_id").agg(*aggs)


def week_over_week(this_week: DataFrame, last_week: DataFrame) -> DataFrame:
    """Volume difference and percent against last week per user."""
    a = this_week.select("user_id", F.col("total_volume").alias("this_volume"))
    b = last_week.select("user_id", F.col("total_volume").alias("last_volume"))
    j = a.join(b, "user_id", "full")
    now, prev = F.coalesce("this_volume", F.lit(0.0)), F.coalesce("last_volume", F.lit(0.0))
    diff, pct = percent_difference(now, prev)
    return j.select("user_id", now.alias("this_volume"), prev.alias("last_volume"),
                    diff.alias("diff"), pct.alias("pct"))


def _latest(df: DataFrame, period: str, part: list[str] | None = None) -> DataFrame:
    w = Window.partitionBy(*part) if part else None
    if w is None:
        mx = df.agg(F.max(period).alias("_mx"))
        return df.join(F.broadcast(mx), F.col(period) == F.col("_mx")).drop("_mx")
    return df.withColumn("_mx", F.max(period).over(w)).where(F.col(period) == F.col("_mx")).drop("_mx")


def latest_weekly_ranking(weekly: DataFrame) -> DataFrame:
    """Newest week, by rank."""
    return _latest(weekly, "week_start").select(
        "week_start", "week_end", "user_id", "user_name", "total_volume", "rank", "rank_change",
        "prev_rank").orderBy("rank", "user_id")


def latest_monthly_ranking(monthly: DataFrame) -> DataFrame:
    """Newest month, by rank."""
    return _latest(monthly, "month").select(
        "month", "user_id", "user_name", "total_volume", "rank", "rank_change",
        "prev_rank").orderBy("rank", "user_id")


def alltime_ranking(alltime: DataFrame) -> DataFrame:
    """All users by rank."""
    return alltime.select("user_name", "total_volume", "rank").orderBy("rank", "user_name")


def body_part_ranking(bodypart: DataFrame, body_part_id: str | None = None,
                      period_type: str | None = None) -> DataFrame:
    """Per part and period type the newest period, or the NULL-period
    (all-time) rows, by rank."""
    df = bodypart
    if body_part_id is not None:
        df = df.where(F.col("body_part_id") == body_part_id)
    if period_type is not None:
        df = df.where(F.col("period_type") == period_type)
    # newest period per (part, type): a tiny aggregate (parts x types rows)
    # joined back, instead of a window whose partitions hold every user
    mx = df.groupBy("body_part_id", "period_type").agg(F.max("period_start").alias("_mx")) \
        .withColumnRenamed("body_part_id", "_bp").withColumnRenamed("period_type", "_pt")
    j = df.join(F.broadcast(mx), df.body_part_id.eqNullSafe(mx._bp) & (df.period_type == mx._pt), "left")
    return (j.where((F.col("period_start") == F.col("_mx")) | F.col("period_start").isNull())
              .select("body_part_id", "period_type", "period_start", "user_name", "total_volume", "rank")
              .orderBy("body_part_id", "period_type", "rank", "user_name"))


def kpi_cards(curve: DataFrame, user_id=None, target: float = 1.0) -> DataFrame:
    """Change % of compound exercises on each user's newest compound date."""
    c = _user(curve, user_id).where(F.col("is_compound"))
    c = _latest(c, "metric_date", ["user_id"])
    pct = F.col("wow_change_pct")
    return c.select("user_id", "exercise_name", "wow_change_pct",
                    F.coalesce(pct >= target, F.lit(False)).alias("on_target"))


def progress_series(curve: DataFrame, as_of=None, days: int = 30, user_id=None) -> DataFrame:
    """7-row average of compound exercises within the last ``days``."""
    c = _user(curve, user_id).where(F.col("is_compound") & (F.col("metric_date") >= F.date_sub(as_of_date(as_of), days)))
    return c.select("user_id", "metric_date", "exercise_name", "volume_7d_ma").orderBy("user_id", "metric_date", "exercise_name")


def exercise_list(curve: DataFrame, user_id=None) -> DataFrame:
    """Distinct exercise names per user."""
    return _user(curve, user_id).select("user_id", "exercise_name").distinct().orderBy("user_id", "exercise_name")


def exercise_series(curve: DataFrame, as_of=None, days: int = 9999, user_id=None,
                    exercise_name: str | None = None) -> DataFrame:
    """One exercise's (or every exercise's) daily series."""
    c = _user(curve, user_id).where(F.col("metric_date") >= F.date_sub(as_of_date(as_of), days))
    if exercise_name is not None:
        c = c.where(F.col("exercise_name") == exercise_name)
    return c.select("user_id", "exercise_name", "metric_date", "daily_volume", "volume_7d_ma",
                    "max_weight", "total_sets").orderBy("user_id", "exercise_name", "metric_date")


def calendar_month(calendar: DataFrame, year: int, month: int, user_id=None) -> DataFrame:
    """Calendar rows of one month."""
    first = _dt.date(year, month, 1)
    c = _user(calendar, user_id).where(F.col("training_date").between(F.lit(first), month_end(F.lit(first))))
    return c.select("user_id", "training_date", "body_parts", "total_volume", "exercise_count",
                    "exercise_summary").orderBy("user_id", "training_date")


def month_grid(month_rows: DataFrame, users: DataFrame, year: int, month: int, user_id=None) -> DataFrame:
    """The month as a Monday-first grid (week row, weekday column) per
    user, marking trained days."""
    first = F.lit(_dt.date(year, month, 1))
    days = _user(users, user_id).select("user_id", F.explode(F.sequence(first, month_end(first))).alias("d"))
    days = days.select("user_id", "d",
                       (F.datediff("d", week_start(first)) / 7).cast("int").alias("week_row"),
                       ((F.dayofweek("d") + 5) % 7).alias("weekday"))
    t = month_rows.select("user_id", F.col("training_date").alias("d"), "body_parts")
    return days.join(t, ["user_id", "d"], "left").select(
        "user_id", F.col("d").alias("day"), "week_row", "weekday", "body_parts",
        F.col("body_parts").isNotNull().alias("trained"))


def day_detail(fct: DataFrame, training_date, user_id=None, body_part_id: str | None = None) -> DataFrame:
    """Sets of a day (optional part filter, "all" = no filter) by exercise
    and set number."""
    f = _user(fct, user_id).where(F.col("training_date") == F.lit(training_date))
    if body_part_id not in (None, "all"):
        f = f.where(F.col("body_part_id") == body_part_id)
    return f.select("user_id", "exercise_name", "set_number", "weight_kg", "reps", "rpe", "volume") \
        .orderBy("user_id", "exercise_name", "set_number")


def day_editable(raw: DataFrame, training_date, now: _dt.datetime, user_id=None, hours: int = 3) -> DataFrame:
    """Earliest live creation time of the day + 3 h > now, per user."""
    r = _user(raw, user_id).where((F.col("training_date") == F.lit(training_date)) & ~F.col("is_deleted"))
    e = r.groupBy("user_id").agg(F.min("created_at").alias("earliest"))
    limit = F.col("earliest") + F.make_dt_interval(F.lit(0), F.lit(hours))
    return e.withColumn("editable", ntz(now) < limit)


def exercise_history(fct: DataFrame, sessions: int = 3, user_id=None, exercise_id: str | None = None,
                     row_cap: int | None = None) -> DataFrame:
    """Set rows of each (user, exercise)'s latest ``sessions``
    distinct dates, with the per-date total. ``row_cap`` reproduces the
    screen's cap on the newest rows before grouping.

    The date ranking runs on the per-day aggregate (one row per series and
    day), not on the set rows, so a very active user does not put all of its
    sets into one sorted window partition; the chosen days are joined back."""
    f = _user(fct, user_id)
    if exercise_id is not None:
        f = f.where(F.col("exercise_id") == exercise_id)
    part = ["user_id", "exercise_id"]
    if row_cap is not None:
        w = Window.partitionBy(*part).orderBy(F.col("training_date").desc(), F.col("set_number").asc(),
                                              F.col("log_id").asc())
        f = f.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= row_cap).drop("_rn")
    days = f.groupBy(*part, "training_date").agg(F.sum("volume").alias("session_volume"))
    dr = F.dense_rank().over(Window.partitionBy(*part).orderBy(F.col("training_date").desc()))
    days = days.withColumn("session_rank", dr.cast("bigint")).where(F.col("session_rank") <= sessions)
    d = days.select(F.col("user_id").alias("_u"), F.col("exercise_id").alias("_e"),
                    F.col("training_date").alias("_d"), "session_rank", "session_volume")
    j = f.join(d, f.user_id.eqNullSafe(d._u) & f.exercise_id.eqNullSafe(d._e) & (f.training_date == d._d))
    return j.select("user_id", "exercise_id", "training_date", "session_rank", "set_number", "weight_kg",
                    "reps", "rpe", "volume", "session_volume")


def session_restore(raw: DataFrame, training_date, now: _dt.datetime, user_id=None,
                    exercise_name: str | None = None, hours: int = 3) -> DataFrame:
    """Live raw rows of a user, exercise and day with the edit flag."""
    r = _user(raw, user_id).where((F.col("training_date") == F.lit(training_date)) & ~F.col("is_deleted"))
    if exercise_name is not None:
        r = r.where(F.col("exercise_name") == exercise_name)
    limit = F.col("created_at") + F.make_dt_interval(F.lit(0), F.lit(hours))
    return r.select("user_id", "log_id", "exercise_name", "set_number", "weight_kg", "reps", "rpe", "memo",
                    (ntz(now) < limit).alias("editable"))


def session_volume_vs_previous(current: DataFrame, history: DataFrame) -> DataFrame:
    """Current session total against the latest previous session total
    per (user, exercise)."""
    cur = current.groupBy("user_id", "exercise_id").agg(
        F.sum(F.col("weight_kg") * F.col("reps")).alias("current_volume"))
    last = history.where(F.col("session_rank") == 1).groupBy("user_id", "exercise_id").agg(
        F.max("session_volume").alias("previous_volume"))
    # null-safe keys: an unknown exercise (NULL id) is one series, as in the
    # grouping that built the history
    last = last.withColumnRenamed("user_id", "_u").withColumnRenamed("exercise_id", "_e")
    j = cur.join(last, cur.user_id.eqNullSafe(last._u) & cur.exercise_id.eqNullSafe(last._e), "left")
    diff, pct = percent_difference(F.col("current_volume"), F.coalesce("previous_volume", F.lit(0.0)))
    return j.select("user_id", "exercise_id", "current_volume", "previous_volume",
                    diff.alias("diff"), pct.alias("pct"))


# Icon and label of a new record.
RECORD_WEIGHT = ("🎉", "最高重量")
RECORD_VOLUME = ("💪", "最高ボリューム")


def record_feed(records: DataFrame) -> DataFrame:
    """New records, newest first, with the feed's text; a missing or zero
    value before the record is shown as ``---``."""
    r = records.where(F.col("is_new"))
    weight = F.col("record_type") == "max_weight"
    before = F.when(F.col("previous_value") != 0, format_volume("previous_value", 1))
    text = F.concat(
        F.when(weight, RECORD_WEIGHT[0]).otherwise(RECORD_VOLUME[0]), F.lit(" **"), F.col("achieved_date").cast("string"),
        F.lit("** "), F.coalesce("user_name", F.lit("None")), F.lit("が**"), F.coalesce("exercise_name", F.lit("None")),
        F.lit("**の"), F.when(weight, RECORD_WEIGHT[1]).otherwise(RECORD_VOLUME[1]), F.lit("を更新！ "),
        F.coalesce(before, F.lit("---")), F.lit(" → **"), format_volume("record_value", 1), F.lit("** kg"))
    return r.select("user_id", "user_name", "exercise_name", "record_type", "record_value", "previous_value",
                    "achieved_date", text.alias("text")).orderBy(F.col("achieved_date").desc(), "user_id", "exercise_name", "record_type")


def request_history(requests: DataFrame, user_id=None) -> DataFrame:
    """A user's requests newest first."""
    return _user(requests, user_id).select("user_id", "request_id", "exercise_name", "status", "created_at",
                                           "reviewed_at").orderBy(F.col("created_at").desc(), "request_id")


def pending_requests(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Pending requests with the requester's name, oldest first."""
    p = requests.where(F.col("status") == "pending")
    u = users.select("user_id", "user_name")
    return p.join(u, "user_id", "left").select("request_id", "user_id", "user_name", "exercise_name",
                                                "body_part_id", "reason", "created_at").orderBy("created_at", "request_id")


def exercise_picker(exercises: DataFrame, body_part_id: str | None = None) -> DataFrame:
    """Exercises of a part by display order (all parts if None)."""
    e = exercises if body_part_id is None else exercises.where(F.col("body_part_id") == body_part_id)
    return e.select("body_part_id", "exercise_id", "exercise_name", "display_order",
                    "is_compound").orderBy("body_part_id", "display_order", "exercise_id")


def master_list(master: DataFrame, body_part_id: str | None = None) -> DataFrame:
    """The whole exercise master, inactive ones too, by part and display order."""
    m = master if body_part_id is None else master.where(F.col("body_part_id") == body_part_id)
    return m.select("exercise_id", "exercise_name", "body_part_id", "is_compound", "is_active",
                    "display_order").orderBy("body_part_id", "display_order", "exercise_id")


def user_list(users: DataFrame) -> DataFrame:
    """Active users by id."""
    return users.where(F.col("is_active")).select("user_id", "user_name").orderBy("user_id")


def document_audit(docs: DataFrame, pending_only: bool = True, newest: int | None = None) -> DataFrame:
    """Document headers with set counts; pending only, or the newest n."""
    d = docs.where(F.col("sync_status") == "pending") if pending_only else docs
    out = d.select("doc_id", "user_id", "training_date", "exercise_id", "status", "sync_status",
                   F.size("sets").cast("bigint").alias("n_sets"), "updated_at", "created_at")
    if newest is not None:
        out = out.orderBy(F.col("created_at").desc(), F.col("doc_id").asc()).limit(newest)
    return out.drop("created_at")


def suggestion_lookup(suggestions: DataFrame, user_id=None, exercise_id: str | None = None) -> DataFrame:
    """Suggestions by set number with the total suggested volume."""
    s = _user(suggestions, user_id)
    if exercise_id is not None:
        s = s.where(F.col("exercise_id") == exercise_id)
    tot = F.sum("suggested_volume").over(Window.partitionBy("user_id", "exercise_id"))
    return s.select("user_id", "exercise_id", "set_number", "suggested_weight_kg", "suggested_reps",
                    "suggested_volume", tot.alias("total_volume")).orderBy("user_id", "exercise_id", "set_number")
