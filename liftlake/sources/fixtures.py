"""Adapter views: the application's raw tables derived from the driver's
TPC-H-like tables (mapping in FIXTURES.md section 3).

Each function reads only the columns it needs, so the parquet scans prune
columns, and returns the raw table's schema. The DuckDB twin of every view
lives in ``fixture_sql`` and must stay expression-for-expression identical.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from liftlake.functions.exprs import ntz, trim_ws

# Constant "today" of all fixture-based queries (day after the last ship date).
AS_OF = _dt.date(2001, 11, 5)
# Constant load time of the master tables.
MASTER_TS = _dt.datetime(2001, 1, 1, 0, 0, 0)
# Split point between the first load and the delta of incremental runs.
# source columns that order versions with equal update times
TIE_KEYS = ("l_suppkey", "l_partkey")
INCREMENTAL_SPLIT = _dt.datetime(1999, 1, 1, 0, 0, 0)
# "now" of the notification plans: the month after the event log, so the
# monthly quota starts from the counts of that month.
NOTIFY_NOW = _dt.datetime(2024, 2, 1, 3, 0, 0)
# "now" for the monthly count: inside the month covered by the event log.
COUNT_NOW = _dt.datetime(2024, 1, 20, 12, 0, 0)
# Day shown by the weekly screens (the last day with data; AS_OF is a Monday).
REPORT_DAY = _dt.date(2001, 11, 4)

_BODY_PART_OF_TYPE = {
    "STANDARD": "chest", "PROMO": "back", "SMALL": "shoulder",
    "LARGE": "leg", "ECONOMY": "arm", "MEDIUM": "other",
}


# Column types of the driver's tables (parquet footers, FIXTURES.md section 3).
# Declaring them skips the footer-reading schema inference job on every read.
DRIVER_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
               "o_orderdate timestamp_ntz, o_orderpriority string"),
    "lineitem": ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                 "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                 "l_linestatus string, l_shipdate timestamp_ntz"),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from liftlake.sources.scan import read_parquet
    return read_parquet(spark, f"{sf_dir.rstrip('/')}/{name}.parquet", schema=DRIVER_SCHEMAS.get(name))


def _body_part_of(p_type: Column) -> Column:
    expr = None
    for k, v in _BODY_PART_OF_TYPE.items():
        expr = (F.when(p_type == k, v) if expr is None else expr.when(p_type == k, v))
    return expr


def _ntz(value: _dt.datetime) -> Column:
    return ntz(value)


def _log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's columns of the training log: each lineitem with its order's
    date and its part. Both return flags become one before the joins."""
    deleted = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity",
        "l_discount", "l_tax", "l_shipdate", deleted.alias("is_deleted"))
    od = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    pt = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    return (li.join(od, li.l_orderkey == od.o_orderkey, "inner")
              .join(pt, li.l_partkey == pt.p_partkey, "inner"))


def _log_columns() -> dict[str, Column]:
    """raw.training_log from :func:`_log_lines`."""
    odd = (F.col("p_partkey") % 2) == 1
    # odd part keys carry upper case and ideographic-space padding so that
    # the name normalisation is exercised
    ex_name = F.when(odd, F.concat(F.lit("　"), F.upper("p_name"), F.lit(" "))).otherwise(F.col("p_name"))
    bp = _body_part_of(F.col("p_type"))
    bp = F.when((F.col("p_partkey") % 5) == 0, F.upper(bp)).otherwise(bp)
    return {
        "log_id": F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")),
        "user_id": _user_id("l_suppkey"),
        "exercise_name": ex_name,
        "body_part": bp,
        "training_date": F.col("l_shipdate").cast("date"),
        "set_number": F.col("l_linenumber").cast("bigint"),
        "weight_kg": F.col("l_quantity") * 2.5,
        "reps": F.lit(1) + F.round(F.col("l_discount") * 100).cast("bigint"),
        "rpe": F.lit(5.5) + F.lit(0.5) * F.round(F.col("l_tax") * 100),
        "memo": F.lit(None).cast("string"),
        "input_source": F.lit("streamlit"),
        "created_at": F.col("o_orderdate"),
        "updated_at": F.col("l_shipdate"),
        "is_deleted": F.col("is_deleted"),
    }


def _user_id(suppkey: str) -> Column:
    return F.concat(F.lit("user_"), F.col(suppkey).cast("string"))


def training_log(spark: SparkSession, sf_dir: str, with_tiebreak: bool = True) -> DataFrame:
    """raw.training_log: one physical row per lineitem; (order, line) is the
    logical set key, so repeated (order, line) pairs are versions."""
    cols = [c.alias(name) for name, c in _log_columns().items()]
    if with_tiebreak:
        cols += [F.col("l_suppkey"), F.col("l_partkey")]
    return _log_lines(spark, sf_dir).select(*cols)


def exercise_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    pt = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    g = pt.groupBy("p_name").agg(F.min("p_partkey").alias("pk"),
                                 F.min_by("p_type", "p_partkey").alias("p_type"))
    return g.select(
        F.replace(F.col("p_name"), F.lit(" "), F.lit("_")).alias("exercise_id"),
        F.col("p_name").alias("exercise_name"),
        _body_part_of(F.col("p_type")).alias("body_part_id"),
        ((F.col("pk") % 4) == 0).alias("is_compound"),
        ((F.col("pk") % 16) != 15).alias("is_active"),
        (F.lit(1) + F.col("pk") % 100).cast("bigint").alias("display_order"),
        _ntz(MASTER_TS).alias("updated_at"),
    )


def user_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return s.select(
        F.concat(F.lit("user_"), F.col("s_suppkey").cast("string")).alias("user_id"),
        F.col("s_name").alias("user_name"),
        F.concat(F.lit("U_"), F.col("s_suppkey").cast("string")).alias("line_user_id"),
        (F.col("s_suppkey") == 1).alias("is_admin"),
        ((F.col("s_suppkey") % 20) != 19).alias("is_active"),
        _ntz(MASTER_TS).alias("created_at"),
    )


def exercise_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    status = (F.when(F.col("c_custkey") % 3 == 0, "pending")
              .when(F.col("c_custkey") % 3 == 1, "approved").otherwise("rejected"))
    parts = list(_BODY_PART_OF_TYPE.values())
    bp = None
    for i, p in enumerate(parts):
        cond = (F.col("c_nationkey") % 6) == i
        bp = F.when(cond, p) if bp is None else bp.when(cond, p)
    created = _ntz(MASTER_TS) + F.make_dt_interval(F.lit(0), (F.col("c_custkey") % 8760).cast("int"))
    reviewed = status != "pending"
    return c.select(
        F.concat(F.lit("req_"), F.col("c_custkey").cast("string")).alias("request_id"),
        F.concat(F.lit("user_"), (F.lit(1) + F.col("c_custkey") % 10).cast("string")).alias("user_id"),
        F.concat(F.lower(F.col("c_mktsegment")), F.lit(" "), (F.col("c_nationkey") % 5).cast("string")).alias("exercise_name"),
        bp.alias("body_part_id"),
        F.col("c_name").alias("reason"),
        status.alias("status"),
        F.when(reviewed, F.lit("user_1")).alias("reviewed_by"),
        created.alias("created_at"),
        F.when(reviewed, created + F.make_dt_interval(F.lit(1))).alias("reviewed_at"),
    )


_TYPE_OF_EVENT = {"view": "start", "click": "3day", "signup": "7day",
                  "error": "weekly_ranking", "purchase": "monthly_ranking"}


def notification_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    typ = None
    for k, v in _TYPE_OF_EVENT.items():
        typ = F.when(F.col("event_type") == k, v) if typ is None else typ.when(F.col("event_type") == k, v)
    status = (F.when(F.col("event_id") % 10 == 8, "failed")
              .when(F.col("event_id") % 10 == 9, "suppressed").otherwise("sent"))
    return e.select(
        F.col("event_id").cast("string").alias("notification_id"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("user_id"),
        typ.alias("notification_type"),
        status.alias("status"),
        F.col("ts").cast("timestamp_ntz").alias("sent_at"),
    )


def _iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested training documents: one per (user, date, exercise) built from
    every physical log row (set ids may repeat across versions)."""
    log = _log_columns()
    ex_id = F.replace(F.lower(trim_ws("exercise_name")), F.lit(" "), F.lit("_"))
    # numbers and times are grouped; their texts are made of the groups
    rows = (_log_lines(spark, sf_dir).withColumn("exercise_name", log["exercise_name"])
            .select("l_suppkey", log["training_date"].alias("training_date"), ex_id.alias("exercise_id"),
                    F.lower(log["body_part"]).alias("body_part_id"),
                    F.struct("l_orderkey", "l_linenumber", log["weight_kg"].alias("weight_kg"), log["reps"].alias("reps"),
                             log["rpe"].alias("rpe"), "is_deleted", "o_orderdate", "l_shipdate").alias("s")))

    def a_set(s: Column) -> Column:
        return F.struct(
            F.concat(s["l_orderkey"].cast("string"), F.lit("-"), s["l_linenumber"].cast("string")).alias("set_id"),
            s["l_linenumber"].cast("bigint").alias("set_number"), s["weight_kg"].alias("weight_kg"), s["reps"].alias("reps"),
            s["rpe"].alias("rpe"), F.lit(None).cast("string").alias("memo"), s["is_deleted"].alias("is_deleted"),
            _iso(s["o_orderdate"]).alias("created_at"), _iso(s["l_shipdate"]).alias("updated_at"))
    g = rows.groupBy("l_suppkey", "training_date", "exercise_id").agg(
        F.min("body_part_id").alias("body_part_id"), F.collect_list("s").alias("s"))
    g = g.select(
        _user_id("l_suppkey").alias("user_id"), "training_date", "exercise_id", "body_part_id",
        (F.datediff(F.col("training_date"), F.lit(_dt.date(1995, 1, 1))) + F.col("l_suppkey")).alias("key_num"),
        F.array_sort(F.transform("s", a_set)).alias("sets"))
    return g.select(
        F.concat_ws("_", "user_id", F.col("training_date").cast("string"), "exercise_id").alias("doc_id"),
        "user_id",
        F.lit(None).cast("string").alias("user_name"),
        F.col("training_date").cast("string").alias("training_date"),
        "body_part_id",
        F.lit(None).cast("string").alias("body_part_name"),
        "exercise_id",
        F.replace(F.col("exercise_id"), F.lit("_"), F.lit(" ")).alias("exercise_name"),
        F.when(F.col("key_num") % 3 == 0, F.lit(None).cast("string")).otherwise(F.lit("streamlit")).alias("input_source"),
        F.when(F.col("key_num") % 17 == 0, "deleted").otherwise("active").alias("status"),
        (F.col("key_num") % 17 == 0).alias("is_deleted"),
        "sets",
        F.size("sets").cast("bigint").alias("set_count"),
        F.lit(None).cast("double").alias("total_volume"),
        _iso(F.col("training_date").cast("timestamp_ntz")).alias("created_at"),
        _iso(F.col("training_date").cast("timestamp_ntz")).alias("updated_at"),
        F.lit(None).cast("string").alias("last_edited_at"),
        F.lit(None).cast("string").alias("editable_until"),
        F.when(F.col("key_num") % 2 == 0, "pending").otherwise("synced").alias("sync_status"),
        F.lit(None).cast("string").alias("synced_at"),
        F.lit(1).cast("bigint").alias("sync_version"),
        F.lit(1).cast("bigint").alias("schema_version"),
    )
