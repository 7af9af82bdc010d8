"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the driver's tables through the adapter views (whole
tables, no sampling) and runs an operator or model of the engine. The DuckDB
twin of each query is in ``oracle_sql.Q`` under the same name.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from liftlake.plans import models as M
from liftlake.session import keep_long_texts_once
from liftlake.sources import fixtures as FX

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# shared building blocks ----------------------------------------------------
def raw_log(spark, sf):
    return FX.training_log(spark, sf)


def stg(spark, sf):
    return M.stg_training_log(raw_log(spark, sf), FX.TIE_KEYS)


def dims(spark, sf):
    return (M.d_exercise(FX.exercise_master(spark, sf)), M.d_user(FX.user_master(spark, sf)),
            M.d_body_part(spark))


def fct(spark, sf):
    ex, _, bp = dims(spark, sf)
    return M.fct_training_set(stg(spark, sf), ex, bp)


def users(spark, sf):
    return M.d_user(FX.user_master(spark, sf))


# mart models ----------------------------------------------------------------
@register("I1_stg_training_log")
def q_stg(spark, sf):
    return stg(spark, sf)


@register("I3_d_exercise")
def q_d_exercise(spark, sf):
    return M.d_exercise(FX.exercise_master(spark, sf))


@register("I4_d_user")
def q_d_user(spark, sf):
    return users(spark, sf)


@register("I5_fct_training_set")
def q_fct(spark, sf):
    return fct(spark, sf)


@register("I6_m_progress_curve")
def q_progress(spark, sf):
    return M.m_progress_curve(fct(spark, sf))


@register("I7_m_last_training")
def q_last(spark, sf):
    return M.m_last_training(fct(spark, sf), FX.AS_OF)


@register("I8_m_ranking_weekly")
def q_weekly(spark, sf):
    return M.m_ranking_weekly(fct(spark, sf), users(spark, sf))


@register("I9_m_ranking_monthly")
def q_monthly(spark, sf):
    return M.m_ranking_monthly(fct(spark, sf), users(spark, sf))


@register("I10_m_ranking_alltime")
def q_alltime(spark, sf):
    return M.m_ranking_alltime(fct(spark, sf), users(spark, sf))


@register("I11_m_ranking_bodypart")
def q_bodypart(spark, sf):
    return M.m_ranking_bodypart(fct(spark, sf), users(spark, sf))


@register("I12_m_personal_record")
def q_records(spark, sf):
    return M.m_personal_record(fct(spark, sf), users(spark, sf), FX.AS_OF)


@register("I13_m_calendar")
def q_calendar(spark, sf):
    return M.m_calendar(fct(spark, sf))


# ---------------------------------------------------------------------------
# scans, generic operators on the driver's tables
# ---------------------------------------------------------------------------
import datetime as _dt  # noqa: E402


from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from liftlake.functions import exprs as H  # noqa: E402
from liftlake.operators import changes as K  # noqa: E402
from liftlake.operators import documents as DOC  # noqa: E402
from liftlake.operators import quality as QL  # noqa: E402
from liftlake.operators.latest import latest_by_key, training_log_order  # noqa: E402
from liftlake.operators.lists import concat_distinct, concat_list  # noqa: E402
from liftlake.operators.rank import global_rank, rank_in_partition  # noqa: E402
from liftlake.operators.records import records_with_previous  # noqa: E402
from liftlake.operators.trend import change_vs_lag, moving_average_rows  # noqa: E402
from liftlake.operators.upsert import merge_upsert, read_upserted, scratch_path, stored, watermark_filter, write_upsert  # noqa: E402

LOG14 = ["log_id", "user_id", "exercise_name", "body_part", "training_date", "set_number", "weight_kg",
         "reps", "rpe", "memo", "input_source", "created_at", "updated_at", "is_deleted"]
CHANGE_NOW = _dt.datetime(2001, 11, 5, 9, 0, 0)


@register("A1_scan_training_log")
def q_scan_log(spark, sf):
    return raw_log(spark, sf).select(*LOG14)


@register("A2_scan_masters")
def q_scan_masters(spark, sf):
    return FX.exercise_master(spark, sf)


@register("A3_scan_requests_notifications")
def q_scan_notifications(spark, sf):
    return FX.notification_log(spark, sf)


@register("A2_scan_users")
def q_scan_users(spark, sf):
    return FX.user_master(spark, sf)


@register("A3_scan_requests")
def q_scan_requests(spark, sf):
    return FX.exercise_request(spark, sf)


@register("B5_date_range_filter")
def q_date_range(spark, sf):
    f = fct(spark, sf)
    return f.where(F.col("training_date").between(F.date_sub(F.lit(FX.AS_OF), 30), F.lit(FX.AS_OF))) \
        .select("log_id", "user_id", "training_date", "volume")


@register("E1_dedup_latest")
def q_dedup_latest(spark, sf):
    return latest_by_key(raw_log(spark, sf), ["log_id"], training_log_order(FX.TIE_KEYS, ())).select(*LOG14)


@register("E2_dedup_latest_active")
def q_dedup_latest_active(spark, sf):
    latest = latest_by_key(raw_log(spark, sf), ["log_id"], training_log_order(FX.TIE_KEYS, ()))
    return latest.where(~F.col("is_deleted")).select(*LOG14)


def _orders_monthly(spark, sf):
    o = FX.read_table(spark, sf, "orders")
    return o.groupBy("o_custkey", F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month")).agg(
        F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("total_cents"),
        F.count(F.lit(1)).alias("n_orders"))


@register("E5_rank_in_period")
def q_rank_period(spark, sf):
    return rank_in_partition(_orders_monthly(spark, sf), ["month"], "total_cents")


@register("E6_rank_global")
def q_rank_global(spark, sf):
    o = FX.read_table(spark, sf, "orders")
    per = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"))
    return global_rank(per, "n_orders")


def _events_daily(spark, sf):
    e = FX.read_table(spark, sf, "events")
    return e.groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(
        F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("value_cents"))


@register("E9_moving_average_7")
def q_moving_avg(spark, sf):
    d = _events_daily(spark, sf)
    out = moving_average_rows(d, ["user_id"], "day", "value_cents", "avg_7", rows=7)
    return out.withColumn("avg_7", F.round("avg_7", 6))


@register("E10_change_vs_lag7")
def q_change_lag(spark, sf):
    d = _events_daily(spark, sf).withColumn("value_cents", F.col("value_cents").cast("double"))
    return change_vs_lag(d, ["user_id"], "day", "value_cents", "change_pct", offset=7)


@register("D4_max_with_arg")
def q_max_with_arg(spark, sf):
    li = FX.read_table(spark, sf, "lineitem").select(
        "l_suppkey", F.col("l_shipdate").cast("date").alias("ship_day"), "l_quantity", "l_extendedprice")
    return records_with_previous(li, ["l_suppkey"], "ship_day",
                                 {"max_quantity": "l_quantity", "max_price": "l_extendedprice"})


@register("D6_concat_list")
def q_concat_list(spark, sf):
    n = FX.read_table(spark, sf, "nation")
    return n.groupBy("n_regionkey").agg(concat_list("n_name", " / ").alias("nations"),
                                        concat_distinct(F.substring("n_name", 1, 1), ", ").alias("initials"))


@register("D12_status_breakdown")
def q_status_breakdown(spark, sf):
    return FX.notification_log(spark, sf).groupBy("notification_type", "status").agg(
        F.count(F.lit(1)).alias("n"))


@register("H_scalar_functions")
def q_scalars(spark, sf):
    f = fct(spark, sf)
    diff, pct = H.percent_difference(F.col("volume"), F.col("weight_kg"))
    return f.select(
        "log_id",
        H.concat_label("exercise_name", "weight_kg").alias("label"),
        H.week_start("training_date").alias("week_start"), H.week_end("training_date").alias("week_end"),
        H.month_start("training_date").alias("month_start"), H.month_end("training_date").alias("month_end"),
        H.days_between(F.lit(FX.AS_OF), "training_date").alias("age_days"),
        H.reps_rule("rpe", "reps").alias("next_reps"),
        H.document_key("user_id", "training_date", "exercise_id").alias("doc_key"),
        H.slug("exercise_name").alias("slug"),
        H.valid_identifier(H.slug("exercise_name")).alias("slug_valid"),
        H.format_volume("volume").alias("volume_text"),
        H.format_period("training_date").alias("period_text"),
        H.recency_flag(FX.AS_OF, "training_date", 7).alias("recent"),
        F.round(diff, 6).alias("diff"), F.round(pct, 6).alias("pct"),
        H.safe_divide(F.col("volume"), F.col("rpe") - F.col("rpe")).alias("safe_div"),
        H.null_strict_greatest("rpe", "weight_kg").alias("greatest_strict"))


# ---------------------------------------------------------------------------
# incremental loading
# ---------------------------------------------------------------------------
def _split(df, col="updated_at"):
    return F.col(col) < H.ntz(FX.INCREMENTAL_SPLIT)


@register("J4_incremental_staging")
def q_incr_staging(spark, sf):
    raw = raw_log(spark, sf)
    # the first load plays the stored target: materialise it like a table
    first = M.stg_training_log(raw.where(_split(raw)), FX.TIE_KEYS).checkpoint()
    delta_src = watermark_filter(raw.where(~F.col("is_deleted")), "updated_at", first, "updated_at")
    delta = M.stg_training_log(delta_src, FX.TIE_KEYS)
    return merge_upsert(first, delta, ["log_id"])


@register("J5_incremental_fact")
def q_incr_fact(spark, sf):
    ex, _, bp = dims(spark, sf)
    s = stg(spark, sf).checkpoint()
    first = M.fct_training_set(s.where(_split(s)), ex, bp)
    src = watermark_filter(s, "updated_at", first, "created_at")
    delta = M.fct_training_set(src, ex, bp)
    return merge_upsert(first, delta, ["log_id"])


@register("A11_merge_upsert")
def q_merge_upsert(spark, sf):
    li = FX.read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey",
                                                      "l_quantity", "l_shipdate")
    early = li.where(F.col("l_shipdate") < H.ntz(FX.INCREMENTAL_SPLIT))
    target = latest_by_key(early, ["l_orderkey", "l_linenumber"],
                           [F.col("l_shipdate"), F.col("l_suppkey"), F.col("l_partkey")])
    late = li.where(F.col("l_shipdate") >= H.ntz(FX.INCREMENTAL_SPLIT))
    source = latest_by_key(late, ["l_orderkey", "l_linenumber"],
                           [F.col("l_shipdate"), F.col("l_suppkey"), F.col("l_partkey")])
    return merge_upsert(target, source, ["l_orderkey", "l_linenumber"])


@register("A11_upsert_table")
def q_upsert_table(spark, sf):
    """Three upserts of a stored table: early versions, late ones, and the
    late ones again. The first line of an order has no number, so a part of
    the key is NULL."""
    key = ["l_orderkey", "line"]
    li = FX.read_table(spark, sf, "lineitem").select(
        "l_orderkey", F.when(F.col("l_linenumber") != 1, F.col("l_linenumber")).alias("line"), "l_suppkey", "l_partkey", "l_quantity",
        F.col("l_shipdate").cast("date").alias("ship_day"), F.trunc(F.col("l_shipdate").cast("date"), "year").alias("ship_year"))
    late = F.col("ship_day") >= F.lit(FX.INCREMENTAL_SPLIT.date())
    order = [F.col("ship_day"), F.col("l_suppkey"), F.col("l_partkey")]
    path = scratch_path(spark, "upserted")
    for batch in (li.where(~late), li.where(late), li.where(late)):
        write_upsert(spark, latest_by_key(batch, key, order), path, key, "ship_year", buckets=4)
    return read_upserted(spark, path)


# ---------------------------------------------------------------------------
# documents
# ---------------------------------------------------------------------------
def docs(spark, sf):
    return FX.documents(spark, sf)


@register("J1_explode_documents")
def q_explode(spark, sf):
    return DOC.explode_documents(DOC.scan_pending(docs(spark, sf)))


@register("D15_array_fold_totals")
def q_fold(spark, sf):
    d = docs(spark, sf)
    cnt, tot = DOC.array_fold_totals(F.col("sets"))
    return d.select("doc_id", cnt.alias("set_count"), tot.alias("total_volume"))


@register("J3_sync_report")
def q_sync_report(spark, sf):
    return DOC.sync_report(docs(spark, sf))


@register("N22_document_audit")
def q_doc_audit(spark, sf):
    from liftlake.plans import reports as R
    return R.document_audit(docs(spark, sf), pending_only=True)


@register("F2_top_n")
def q_top_n(spark, sf):
    d = docs(spark, sf).select("doc_id", "user_id", "training_date", F.size("sets").cast("bigint").alias("n_sets"))
    return d.orderBy(F.col("training_date").desc(), F.col("doc_id").asc()).limit(10)


def _doc_header(d):
    cnt, tot = DOC.array_fold_totals(F.col("sets"))
    return d.select("doc_id", "status", "is_deleted", "sync_status", "synced_at", "sync_version",
                    "updated_at", cnt.alias("live_sets"), tot.alias("live_volume"))


@register("J2_mark_synced")
def q_mark_synced(spark, sf):
    d = docs(spark, sf)
    # documents whose rows were written: every pending document with sets
    keys = d.where((F.col("sync_status") == "pending") & (F.size("sets") > 0)).select("doc_id")
    return _doc_header(DOC.mark_synced(d, keys, CHANGE_NOW))


@register("K3_soft_delete_documents")
def q_soft_delete_docs(spark, sf):
    d = docs(spark, sf)
    # delete every document that has no live set left
    live = F.size(F.filter("sets", lambda x: ~F.coalesce(x["is_deleted"], F.lit(False))))
    keys = d.where(live == 0).select("doc_id")
    return _doc_header(DOC.soft_delete_documents(d, keys, CHANGE_NOW))


@register("K2_soft_delete_sets")
def q_soft_delete_sets(spark, sf):
    d = docs(spark, sf)
    # remove the first set of every document that has more than one
    req = d.where(F.size("sets") > 1).select("doc_id", F.col("sets")[0]["set_id"].alias("set_id"))
    out = DOC.soft_delete_sets(d, req, CHANGE_NOW)
    return _doc_header(out)


def _saved_docs(spark, sf):
    # the documents are read by the saves and the table they go to
    d = stored(docs(spark, sf), "saved")
    # edits: every pending document re-saved with its sets plus one new set;
    # new documents: each deleted document re-entered on the following day
    base = d.where(F.col("sync_status") == "pending")
    extra = F.struct(F.lit(None).cast("string").alias("set_id"), F.lit(99).cast("bigint").alias("set_number"),
                     F.lit(20.0).alias("weight_kg"), F.lit(10).cast("bigint").alias("reps"),
                     F.lit(None).cast("double").alias("rpe"), F.lit("").alias("memo"),
                     F.lit(False).alias("is_deleted"), F.lit(None).cast("string").alias("created_at"),
                     F.lit(None).cast("string").alias("updated_at"))
    edits = base.select("user_id", "user_name", "training_date", "body_part_id", "body_part_name", "exercise_id",
                        "exercise_name", F.concat("sets", F.array(extra)).alias("sets"))
    fresh = d.where(F.col("status") == "deleted").select(
        "user_id", "user_name", F.date_add(F.to_date("training_date"), 1).cast("string").alias("training_date"),
        "body_part_id", "body_part_name", "exercise_id", "exercise_name", "sets")
    fresh = (fresh.withColumn("_k", H.document_key("user_id", "training_date", "exercise_id"))
                  .join(d.select(F.col("doc_id").alias("_k")), "_k", "left_anti").drop("_k"))
    saves = edits.unionByName(fresh)
    return DOC.save_documents(d, saves, CHANGE_NOW)


@register("K1_save_documents")
def q_save_docs(spark, sf):
    return _doc_header(_saved_docs(spark, sf))


@register("K1_saved_sets")
def q_saved_sets(spark, sf):
    """The sets of all documents after the saves."""
    return _saved_docs(spark, sf).select("doc_id", F.explode("sets").alias("s")).select(
        "doc_id", "s.set_id", "s.set_number", "s.weight_kg", "s.reps", "s.is_deleted", "s.created_at", "s.updated_at")


def _stored_docs(spark, sf):
    path = scratch_path(spark, "documents")
    DOC.write_documents(docs(spark, sf), path)
    return spark.read.parquet(path)


@register("A5_get_documents")
def q_get_documents(spark, sf):
    """The documents of the first set of every order, by their keys."""
    log = raw_log(spark, sf).where(F.col("set_number") == 1)
    keys = log.select("user_id", F.col("training_date").cast("string").alias("training_date"),
                      F.replace(F.lower(H.trim_ws("exercise_name")), F.lit(" "), F.lit("_")).alias("exercise_id"))
    return _doc_header(DOC.get_documents(_stored_docs(spark, sf), keys))


@register("A6_list_documents_by_days")
def q_documents_by_days(spark, sf):
    """All documents of every user's last training day."""
    days = raw_log(spark, sf).groupBy("user_id").agg(F.max("training_date").cast("string").alias("training_date"))
    return _doc_header(DOC.list_documents_by_days(_stored_docs(spark, sf), days))


# ---------------------------------------------------------------------------
# state changes on log and masters
# ---------------------------------------------------------------------------
@register("K4_soft_delete_log_rows")
def q_soft_delete_log(spark, sf):
    # withdraw every set of an order still in process (status 'P'), plus the
    # prefix rule used to purge test rows
    li = FX.read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    od = FX.read_table(spark, sf, "orders").where(F.col("o_orderstatus") == "P").select("o_orderkey")
    ids = li.join(od, li.l_orderkey == od.o_orderkey, "left_semi").select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("log_id"))
    return K.soft_delete_log_rows(raw_log(spark, sf).select(*LOG14), ids=ids, prefix="test-") \
        .select("log_id", "is_deleted")


def _new_requests(spark, sf):
    c = FX.read_table(spark, sf, "customer")
    a = c.select(F.concat(F.lit("new_"), F.col("c_custkey").cast("string")).alias("request_id"),
                 F.concat(F.lit("user_"), (F.lit(1) + F.col("c_custkey") % 10).cast("string")).alias("user_id"),
                 F.concat(F.lower("c_mktsegment"), F.lit(" "), (F.col("c_nationkey") % 7).cast("string")).alias("exercise_name"),
                 F.lit("chest").alias("body_part_id"), F.lit("").alias("reason"))
    p = FX.read_table(spark, sf, "part")
    b = p.select(F.concat(F.lit("newp_"), F.col("p_partkey").cast("string")).alias("request_id"),
                 F.lit("user_2").alias("user_id"),
                 F.when(F.col("p_size") > 25, F.upper("p_name")).otherwise(F.substring("p_name", 1, 1)).alias("exercise_name"),
                 F.lit("leg").alias("body_part_id"), F.col("p_type").alias("reason"))
    return a.unionByName(b)


@register("K5_submit_requests")
def q_submit(spark, sf):
    dec, _ = K.submit_requests(FX.exercise_request(spark, sf), FX.exercise_master(spark, sf),
                               _new_requests(spark, sf), CHANGE_NOW)
    return dec


@register("K5_requests_after")
def q_requests_after(spark, sf):
    _, after = K.submit_requests(FX.exercise_request(spark, sf), FX.exercise_master(spark, sf),
                                 _new_requests(spark, sf), CHANGE_NOW)
    return after


def _first_pending_per_name(req, first: bool):
    """Review batch: the oldest pending request of each (case-insensitive)
    name is approved, later duplicates of it are rejected."""
    w = Window.partitionBy(F.lower("exercise_name")).orderBy("created_at", "request_id")
    p = req.where(F.col("status") == "pending").withColumn("_rn", F.row_number().over(w))
    return p.where(F.col("_rn") == 1) if first else p.where(F.col("_rn") > 1)


@register("K6_approve_requests")
def q_approve(spark, sf):
    req = FX.exercise_request(spark, sf)
    appr = _first_pending_per_name(req, True).select("request_id", F.lit("user_1").alias("reviewer"))
    _, master = K.approve_requests(req, FX.exercise_master(spark, sf), appr, CHANGE_NOW)
    return master


def _approve_all(spark, sf):
    # every pending request, also those that ask for the same exercise; some
    # under an id that the master has
    req, master = FX.exercise_request(spark, sf), FX.exercise_master(spark, sf)
    number = F.regexp_extract("request_id", "([0-9]+)", 1).cast("bigint")
    taken = master.agg(F.min("exercise_id").alias("id")).first()["id"]
    appr = req.where(F.col("status") == "pending").select(
        "request_id", F.lit("user_1").alias("reviewer"), F.when(number % 4 == 0, F.lit(taken)).alias("exercise_id"))
    return K.approve_requests(req, master, appr, CHANGE_NOW)


@register("K6_approve_all_master")
def q_approve_all_master(spark, sf):
    return _approve_all(spark, sf)[1]


@register("K6_approve_all_requests")
def q_approve_all_requests(spark, sf):
    return _approve_all(spark, sf)[0]


@register("K7_reject_requests")
def q_reject(spark, sf):
    req = FX.exercise_request(spark, sf)
    rej = _first_pending_per_name(req, False).select("request_id", F.lit("user_3").alias("reviewer"))
    return K.reject_requests(req, rej, CHANGE_NOW)


@register("K8_deactivate_exercises")
def q_deactivate(spark, sf):
    # deactivate every exercise nobody trained in the year before as_of
    m = FX.exercise_master(spark, sf)
    recent = fct(spark, sf).where(F.col("training_date") > F.date_sub(F.lit(FX.AS_OF), 365)) \
        .select("exercise_id").distinct()
    return K.deactivate_exercises(m, m.select("exercise_id").join(recent, "exercise_id", "left_anti"), CHANGE_NOW)


def _added(spark, sf):
    n = FX.read_table(spark, sf, "nation")
    new = n.select(F.regexp_replace(F.lower("n_name"), " ", "_").alias("exercise_id"),
                   F.concat(F.lower("n_name"), F.lit(" press")).alias("exercise_name"),
                   F.lit("arm").alias("body_part_id"), (F.col("n_regionkey") == 0).alias("is_compound"),
                   (F.col("n_nationkey") + 1).alias("display_order"))
    p = FX.read_table(spark, sf, "part").select(
        F.replace(F.col("p_name"), F.lit(" "), F.lit("_")).alias("exercise_id"), F.col("p_name").alias("exercise_name"),
        F.lit("arm").alias("body_part_id"), F.lit(False).alias("is_compound"), F.lit(5).alias("display_order"))
    return K.add_exercises(FX.exercise_master(spark, sf), new.unionByName(p).distinct(), CHANGE_NOW)


@register("K9_add_exercises")
def q_add_ex(spark, sf):
    return _added(spark, sf)[0]


@register("K9_master_after")
def q_master_after(spark, sf):
    return _added(spark, sf)[1]


@register("K10_update_exercise_flag")
def q_update_flag(spark, sf):
    return K.update_exercise_flag(FX.exercise_master(spark, sf), "red_widget", True)


@register("K13_maintain_users")
def q_maintain_users(spark, sf):
    """An address for the user of every customer number, several for some, most
    of unknown users."""
    c = FX.read_table(spark, sf, "customer")
    return K.maintain_users(FX.user_master(spark, sf), c.select(
        F.concat(F.lit("user_"), (F.col("c_custkey") % 700).cast("string")).alias("user_id"),
        F.col("c_name").alias("user_name"),
        F.when(F.col("c_nationkey") > 3, F.concat(F.lit("C_"), F.col("c_custkey").cast("string"))).alias("line_user_id"),
        F.lit(False).alias("is_admin"), F.lit(True).alias("is_active"), H.ntz(CHANGE_NOW).alias("created_at"),
        F.col("c_custkey").alias("changed")), order="changed")


@register("B6_optional_filter")
def q_optional_filter(spark, sf):
    """One part chosen of the first column, all of the second."""
    m = K.optional_filter(FX.exercise_master(spark, sf), "body_part_id", "leg")
    return K.optional_filter(m, "is_active", "all")


@register("B8_key_prefix_filter")
def q_prefix(spark, sf):
    return K.soft_delete_log_rows(raw_log(spark, sf).select(*LOG14), prefix="1").where("is_deleted").select("log_id", "updated_at")


@register("B10_case_insensitive_match")
def q_match(spark, sf):
    return K.case_insensitive_match(raw_log(spark, sf).select("log_id", "exercise_name", "body_part"), "body_part", "Chest")


@register("K11_validate_input_rows")
def q_validate(spark, sf):
    out, _, _ = K.validate_input_rows(raw_log(spark, sf).select(*LOG14), FX.AS_OF)
    return out.select("log_id", "updated_at", "is_valid", F.array_join("errors", ",").alias("errors"))


@register("K12_autosave_gate")
def q_autosave(spark, sf):
    return K.autosave_gate(raw_log(spark, sf)).select("log_id", "updated_at", "weight_kg", "reps")


# ---------------------------------------------------------------------------
# data quality
# ---------------------------------------------------------------------------
def _quality_tables(spark, sf):
    # every checked model is written once to the shared scratch folder, as the
    # daily job does, and checked from there
    root = scratch_path(spark, "quality")

    def kept(name, df):
        df.write.parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")
    s = kept("stg", stg(spark, sf))
    ex, _, bp = dims(spark, sf)
    f = kept("fct", M.fct_training_set(s, ex, bp))
    u = kept("d_user", users(spark, sf))
    models = {
        "d_exercise": lambda: M.d_exercise(FX.exercise_master(spark, sf)), "m_progress_curve": lambda: M.m_progress_curve(f),
        "m_last_training": lambda: M.m_last_training(f, FX.AS_OF), "m_ranking_weekly": lambda: M.m_ranking_weekly(f, u),
        "m_ranking_monthly": lambda: M.m_ranking_monthly(f, u), "m_ranking_alltime": lambda: M.m_ranking_alltime(f, u),
        "m_ranking_bodypart": lambda: M.m_ranking_bodypart(f, u),
        "m_personal_record": lambda: M.m_personal_record(f, u, FX.AS_OF), "m_calendar": lambda: M.m_calendar(f),
        "m_ml_suggestion": lambda: ML.suggest(_fixed_prediction(f), FX.AS_OF),
    }
    # the models depend on the fact alone: their jobs run side by side
    with ThreadPoolExecutor(5) as pool:
        done = dict(zip(models, pool.map(lambda name: kept(name, models[name]()), models)))
    return {"stg_training_log": s, "fct_training_set": f, "d_body_part": bp, "d_user": u, **done}


def _fixed_prediction(f):
    """Latest sets with a plain rule in the model's place: half the sets are
    predicted lower, every seventh has no prediction."""
    n = F.col("set_number") + F.dayofmonth("training_date")
    return ML.latest_per_set(f, FX.AS_OF).withColumn("predicted_next_weight_kg", F.when(
        n % 7 != 0, F.col("weight_kg") * F.when(n % 2 == 0, 1.03125).otherwise(0.96875)))


@register("O6_suggest")
def q_suggest(spark, sf):
    return ML.suggest(_fixed_prediction(fct(spark, sf)), FX.AS_OF)


@register("L7_documented_suite")
def q_suite(spark, sf):
    return QL.run_suite(_quality_tables(spark, sf), QL.DOCUMENTED_SUITE)


@register("L6_planned_checks")
def q_planned(spark, sf):
    f = fct(spark, sf).checkpoint()
    u = users(spark, sf)
    return QL.planned_checks(M.m_progress_curve(f), u, M.m_ranking_alltime(f, u), f)


@register("L8_referential")
def q_referential(spark, sf):
    return QL.referential(fct(spark, sf), "user_id", users(spark, sf), "user_id").select("log_id", "user_id")


@register("L8_declared_relations")
def q_relations(spark, sf):
    """All declared foreign keys over the raw tables and the models."""
    tables = _quality_tables(spark, sf) | {
        "training_log": raw_log(spark, sf), "user_master": FX.user_master(spark, sf),
        "exercise_master": FX.exercise_master(spark, sf), "exercise_request": FX.exercise_request(spark, sf),
        "notification_log": FX.notification_log(spark, sf)}
    return QL.run_relations(tables, QL.DECLARED_RELATIONS)


@register("L2_unique_exercise_name")
def q_unique_names(spark, sf):
    return QL.exercise_name_unique(FX.exercise_master(spark, sf))


# ---------------------------------------------------------------------------
# notifications
# ---------------------------------------------------------------------------
from liftlake.plans import ml as ML  # noqa: E402
from liftlake.plans import notify as NT  # noqa: E402
from liftlake.plans import reports as R  # noqa: E402


def _last_training(spark, sf):
    # read by two candidate queries and a count: materialise once
    return M.m_last_training(fct(spark, sf), FX.AS_OF).checkpoint()


def _base_count(spark, sf):
    return NT.sent_count_value(FX.notification_log(spark, sf), FX.NOTIFY_NOW)


@register("M1_monthly_sent_count")
def q_sent_count(spark, sf):
    from liftlake.operators.quota import monthly_sent_count
    return monthly_sent_count(FX.notification_log(spark, sf), FX.COUNT_NOW)


@register("M3_three_day_candidates")
def q_three(spark, sf):
    return NT.three_day_candidates(_last_training(spark, sf), users(spark, sf))


@register("M4_seven_day_candidates")
def q_seven(spark, sf):
    return NT.seven_day_candidates(_last_training(spark, sf), users(spark, sf))


@register("M5_daily_plan")
def q_daily_plan(spark, sf):
    lt, u = _last_training(spark, sf), users(spark, sf)
    return NT.daily_plan(NT.three_day_candidates(lt, u), NT.seven_day_candidates(lt, u), _base_count(spark, sf))


@register("M6_weekly_digest")
def q_weekly_digest(spark, sf):
    u = users(spark, sf)
    return NT.digest_lines(M.m_ranking_weekly(fct(spark, sf), u), u, "weekly")


@register("M6_monthly_digest")
def q_monthly_digest(spark, sf):
    u = users(spark, sf)
    return NT.digest_lines(M.m_ranking_monthly(fct(spark, sf), u), u, "monthly")


def _weekly_digest(spark, sf, f=None):
    u, ranking = users(spark, sf), M.m_ranking_weekly(f or fct(spark, sf), users(spark, sf)).checkpoint()
    lines = NT.digest_lines(ranking, u, "weekly")
    return u, lines, NT.digest_name(lines, ranking, "week_start", "weekly_ranking")


@register("M6_digest_text")
def q_digest_text(spark, sf):
    """Both digests as the numbered chunks of their texts."""
    # the fact is derived once for both rankings
    f = fct(spark, sf).select("user_id", "training_date", "volume").checkpoint()
    _, lines, name = _weekly_digest(spark, sf, f)
    ranking = M.m_ranking_monthly(f, users(spark, sf)).checkpoint()
    monthly = NT.digest_lines(ranking, users(spark, sf), "monthly")
    return NT.digest_chunks(lines, name or "").unionByName(
        NT.digest_chunks(monthly, NT.digest_name(monthly, ranking, "month", "monthly_ranking") or ""))


@register("M7_digest_plan")
def q_digest_plan(spark, sf):
    """Every active user's row with the whole digest text."""
    # one text on all rows, several MB with many users
    keep_long_texts_once(spark)
    u, lines, name = _weekly_digest(spark, sf)
    return NT.digest_messages(NT.digest_plan(name, u, _base_count(spark, sf), "weekly_ranking"), NT.digest_chunks(lines, name or ""))


@register("M7_digest_deliveries")
def q_digest_deliveries(spark, sf):
    u, lines, name = _weekly_digest(spark, sf)
    return NT.digest_deliveries(NT.digest_plan(name, u, _base_count(spark, sf), "weekly_ranking"), NT.digest_chunks(lines, name or ""))


@register("M8_start_plan")
def q_start_plan(spark, sf):
    _, plan = NT.start_plan(FX.notification_log(spark, sf), users(spark, sf), "user_2", "chest", FX.NOTIFY_NOW)
    return plan


@register("M9_log_attempts")
def q_log_attempts(spark, sf):
    lt, u = _last_training(spark, sf), users(spark, sf)
    plan = NT.daily_plan(NT.three_day_candidates(lt, u), NT.seven_day_candidates(lt, u), _base_count(spark, sf))
    return NT.log_attempts(plan, FX.NOTIFY_NOW).drop("notification_id")


# ---------------------------------------------------------------------------
# reports (all users at once)
# ---------------------------------------------------------------------------
DAY = FX.REPORT_DAY


def _week(spark, sf):
    return R.current_week(raw_log(spark, sf), M.d_body_part(spark), DAY, tiebreak=FX.TIE_KEYS)


@register("N1_current_week")
def q_n1(spark, sf):
    return _week(spark, sf)


@register("N2_week_grid")
def q_n2(spark, sf):
    return R.week_grid(_week(spark, sf), users(spark, sf), DAY)


@register("N3_week_summary")
def q_n3(spark, sf):
    return R.week_summary(_week(spark, sf))


@register("N4_last_week_summary")
def q_n4(spark, sf):
    return R.last_week_summary(raw_log(spark, sf), DAY, tiebreak=FX.TIE_KEYS)


@register("N5_week_over_week")
def q_n5(spark, sf):
    return R.week_over_week(R.week_summary(_week(spark, sf)), R.last_week_summary(raw_log(spark, sf), DAY, tiebreak=FX.TIE_KEYS))


@register("N6_latest_weekly_ranking")
def q_n6(spark, sf):
    return R.latest_weekly_ranking(M.m_ranking_weekly(fct(spark, sf), users(spark, sf)))


@register("N7_latest_monthly_ranking")
def q_n7(spark, sf):
    return R.latest_monthly_ranking(M.m_ranking_monthly(fct(spark, sf), users(spark, sf)))


@register("N8_alltime_ranking")
def q_n8(spark, sf):
    return R.alltime_ranking(M.m_ranking_alltime(fct(spark, sf), users(spark, sf)))


@register("N9_body_part_ranking")
def q_n9(spark, sf):
    return R.body_part_ranking(M.m_ranking_bodypart(fct(spark, sf), users(spark, sf)))


def _curve(spark, sf):
    return M.m_progress_curve(fct(spark, sf))


@register("N10_kpi_cards")
def q_n10(spark, sf):
    return R.kpi_cards(_curve(spark, sf))


@register("N11_progress_series")
def q_n11(spark, sf):
    return R.progress_series(_curve(spark, sf), FX.AS_OF, 90)


@register("N12_exercise_list")
def q_n12a(spark, sf):
    return R.exercise_list(_curve(spark, sf))


@register("N12_exercise_series")
def q_n12b(spark, sf):
    return R.exercise_series(_curve(spark, sf), FX.AS_OF, 180)


def _calendar(spark, sf):
    return M.m_calendar(fct(spark, sf))


@register("N13_calendar_month")
def q_n13a(spark, sf):
    return R.calendar_month(_calendar(spark, sf), 2001, 10)


@register("N13_month_grid")
def q_n13b(spark, sf):
    return R.month_grid(R.calendar_month(_calendar(spark, sf), 2001, 10), users(spark, sf), 2001, 10)


@register("N14_day_detail")
def q_n14(spark, sf):
    return R.day_detail(fct(spark, sf), DAY)


@register("N15_day_editable")
def q_n15(spark, sf):
    return R.day_editable(raw_log(spark, sf), DAY, CHANGE_NOW)


@register("N16_exercise_history")
def q_n16(spark, sf):
    return R.exercise_history(fct(spark, sf), 3)


@register("N17_session_restore")
def q_n17(spark, sf):
    return R.session_restore(raw_log(spark, sf), DAY, CHANGE_NOW)


@register("N18_session_volume_vs_previous")
def q_n18(spark, sf):
    f = fct(spark, sf)
    cur = f.where(F.col("training_date") == F.lit(DAY))
    hist = R.exercise_history(f.where(F.col("training_date") < F.lit(DAY)), 1)
    return R.session_volume_vs_previous(cur, hist)


@register("N19_record_feed")
def q_n19(spark, sf):
    return R.record_feed(M.m_personal_record(fct(spark, sf), users(spark, sf), FX.AS_OF))


@register("N20_request_history")
def q_n20a(spark, sf):
    return R.request_history(FX.exercise_request(spark, sf))


@register("N20_pending_requests")
def q_n20b(spark, sf):
    return R.pending_requests(FX.exercise_request(spark, sf), users(spark, sf))


@register("N21_exercise_picker")
def q_n21(spark, sf):
    return R.exercise_picker(M.d_exercise(FX.exercise_master(spark, sf)))


@register("N21_master_list")
def q_n21_master(spark, sf):
    return R.master_list(FX.exercise_master(spark, sf))


@register("N21_user_list")
def q_n21_users(spark, sf):
    return R.user_list(FX.user_master(spark, sf))


@register("N23_suggestion_lookup")
def q_n23(spark, sf):
    return R.suggestion_lookup(ML.fallback_suggest(fct(spark, sf)))


# ---------------------------------------------------------------------------
# machine learning
# ---------------------------------------------------------------------------
_MODELS: dict = {}


def _ml_fact(spark, sf):
    """The fact's columns that training and suggestions read, derived once."""
    return stored(fct(spark, sf).select("log_id", *ML.SERIES, "exercise_name", "weight_kg", "reps", "volume", "rpe",
                                        "training_date", "created_at"), "series")


def trained_model(spark, sf, f=None):
    """The predictor for ``sf`` (trained once per session and scale)."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _MODELS:
        _MODELS[key] = ML.train_predictor(ML.training_pairs(f or fct(spark, sf)))
    return _MODELS[key]


@register("O1_training_pairs")
def q_o1(spark, sf):
    return ML.training_pairs(fct(spark, sf), keep_keys=True)


@register("O2_pair_counts")
def q_o2(spark, sf):
    return ML.pair_counts(fct(spark, sf))


@register("E3_latest_per_set")
def q_e3(spark, sf):
    return ML.latest_per_set(fct(spark, sf), FX.AS_OF)


@register("E4_latest_per_set_number")
def q_e4(spark, sf):
    return ML.latest_per_set_number(fct(spark, sf), "user_1", "red_widget")


@register("O7_fallback_suggest")
def q_o7(spark, sf):
    return ML.fallback_suggest(fct(spark, sf))


@register("O7_fallback_flat")
def q_o7_flat(spark, sf):
    return ML.fallback_suggest(fct(spark, sf), flat=True)


@register("O4_evaluate_predictor")
def q_o4(spark, sf):
    return ML.evaluate_predictor(trained_model(spark, sf), ML.training_pairs(fct(spark, sf)))


@register("O4_evaluate_fixed")
def q_o4_fixed(spark, sf):
    """The scores of a plain rule in the model's place: the weight before, a
    thirty-second more for odd sets; every seventh pair has no prediction."""
    pairs = ML.training_pairs(fct(spark, sf), keep_keys=True)
    n = F.col("set_number") + F.dayofmonth("training_date")
    return ML.evaluate(pairs.withColumn("predicted_next_weight_kg", F.when(
        n % 7 != 0, F.col("prev_weight_kg") * F.when(n % 2 == 1, 1.03125).otherwise(1.0))))


@register("I14_m_ml_suggestion")
def q_i14(spark, sf):
    f = _ml_fact(spark, sf)
    return ML.m_ml_suggestion(f, trained_model(spark, sf, f), FX.AS_OF)


@register("O8_suggest_with_fallback")
def q_o8(spark, sf):
    f = _ml_fact(spark, sf)
    return ML.suggest_with_fallback(ML.m_ml_suggestion(f, trained_model(spark, sf, f), FX.AS_OF), ML.fallback_suggest(f))


# ---------------------------------------------------------------------------
# streaming
# ---------------------------------------------------------------------------
@register("J6_microbatch_sync")
def q_j6(spark, sf):
    from liftlake.operators.upsert import scratch_path
    from liftlake.streaming.microbatch import run_to_completion
    base = scratch_path(spark, "j6")
    # the files' text is several times as large as their compressed form
    docs(spark, sf).write.mode("overwrite").option("compression", "gzip").json(f"{base}/incoming")
    return run_to_completion(spark, f"{base}/incoming", f"{base}/raw_training_log", f"{base}/checkpoint", buckets=2)


@register("H11_zone_truncated_timestamp")
def q_zone_trunc(spark, sf):
    log = FX.notification_log(spark, sf)
    ts = F.col("sent_at").cast("timestamp")
    return log.select("notification_id", "sent_at",
                      H.zone_truncated_timestamp(ts, "month").cast("timestamp_ntz").alias("month_start_utc"),
                      H.zone_truncated_timestamp(ts, "day").cast("timestamp_ntz").alias("day_start_utc"))


@register("H10_today_in_zone")
def q_today(spark, sf):
    """Days from every user's last training to today in Tokyo."""
    last = raw_log(spark, sf).groupBy("user_id").agg(F.max("training_date").alias("last_day"))
    return last.select("user_id", "last_day", H.days_between(H.today_in_zone(), "last_day").alias("days_ago"))


@register("M10_merge_same_day")
def q_merge_same_day(spark, sf):
    lt, u = _last_training(spark, sf), users(spark, sf)
    plan = NT.daily_plan(NT.three_day_candidates(lt, u), NT.seven_day_candidates(lt, u), _base_count(spark, sf))
    return NT.merge_same_day(plan)


_LAKES: dict = {}


def _daily_lake(spark, sf):
    """A fresh lake in the shared scratch folder after one daily job (run once
    per application and scale): pending documents are synced, staged, joined
    into the fact, metrics, checks and notifications are written."""
    from liftlake.plans.daily import Layout, daily_refresh
    key = (spark.sparkContext.applicationId, sf)
    if key not in _LAKES:
        lay = Layout(scratch_path(spark, "lake"), buckets=2)
        FX.exercise_master(spark, sf).write.parquet(lay.raw("exercise_master"))
        FX.user_master(spark, sf).write.parquet(lay.raw("user_master"))
        docs_path = f"{lay.root}/documents"
        docs(spark, sf).write.parquet(docs_path)
        daily_refresh(spark, lay, docs_path, _dt.date(2001, 11, 6), _dt.datetime(2001, 11, 6, 21, 0, 0))
        _LAKES[key] = lay
    return _LAKES[key]


@register("J7_daily_refresh")
def q_daily(spark, sf):
    """The fact table that the daily job leaves."""
    return read_upserted(spark, _daily_lake(spark, sf).mart("fct_training_set"))


@register("J7_daily_last_training")
def q_daily_last(spark, sf):
    """A metric that the daily job leaves, as of the run's day."""
    return spark.read.parquet(_daily_lake(spark, sf).mart("m_last_training"))


@register("J7_daily_sync_states")
def q_daily_states(spark, sf):
    """The sync states that the daily job records."""
    from liftlake.plans.daily import read_runs
    return read_runs(spark, _daily_lake(spark, sf).raw("document_sync"))


@register("A14_parameterised_query")
def q_params(spark, sf):
    """SQL text with named parameter markers, values bound by Spark (and
    GROUP BY ordinals, D16), over a temporary view of the fact."""
    from liftlake.sources.seed import parameterised_query
    view = "fct_of_query"
    fct(spark, sf).createOrReplaceTempView(view)
    return parameterised_query(
        spark, f"SELECT user_id, training_date, COUNT(*) AS n_sets, SUM(volume) AS day_volume "
               f"FROM {view} WHERE training_date >= :since AND body_part_id = :part GROUP BY 1, 2",
        since=_dt.date(2001, 1, 1), part="chest")
