"""State changes that name a key more than once, and look-ups of stored documents."""

import datetime as dt
import os

from pyspark.sql import functions as F

from liftlake import schemas
from liftlake.operators import changes as K
from liftlake.operators import documents as DOC
from liftlake.operators import quality as QL
from liftlake.plans import notify as NT
from test_documents import docs
from test_notify_changes import NOW, master


def requests(spark, names):
    return spark.createDataFrame([(f"r{i}", "u", n, "leg", None, "pending", None, dt.datetime(2025, 1, 2), None)
                                  for i, n in enumerate(names)], schemas.EXERCISE_REQUEST)


def test_approvals_keep_ids_and_names_unique(spark):
    req = requests(spark, ["Leg Ext", "leg_ext", " LEG EXT", "Squat", "Curl", "curl"])
    appr = spark.createDataFrame([(f"r{i}", "u1") for i in range(6)], "request_id string, reviewer string")
    after, m = K.approve_requests(req, master(spark), appr, NOW)
    assert sorted(r.exercise_id for r in m.collect()) == ["bench_press", "curl", "leg_ext", "squat"]
    assert [r.exercise_name for r in m.where("exercise_id = 'leg_ext'").collect()] == ["Leg Ext"]
    assert {r.status for r in after.collect()} == {"approved"}


def test_a_faulty_row_never_takes_an_id(spark):
    kind = "exercise_id string, exercise_name string, body_part_id string, is_compound boolean, display_order int"
    new = spark.createDataFrame([("abc1", "", "arm", None, None), ("abc1", "Real", "arm", None, None), ("abc1", "Rest", "arm", None, None),
                                 ("twin", "T", "arm", None, 3), ("twin", "T", "arm", None, 3), (None, "X", "arm", None, None)], kind)
    dec, m = K.add_exercises(master(spark), new, NOW)
    assert sorted((r.exercise_id or "", r.exercise_name, r.decision) for r in dec.collect()) == [
        ("", "X", "missing_field"), ("abc1", "", "missing_field"), ("abc1", "Real", "accepted"), ("abc1", "Rest", "id_taken"),
        ("twin", "T", "accepted"), ("twin", "T", "id_taken")]
    assert sorted(r.exercise_id for r in m.collect()) == ["abc1", "bench_press", "squat", "twin"]


def test_a_user_is_changed_or_added_once(spark):
    u = spark.createDataFrame([("u1", "A", "L1", False, True, NOW), ("u2", "B", "L2", False, True, NOW)], schemas.USER_MASTER)
    ch = spark.createDataFrame([("u1", "x", 1), ("u1", "y", 3), ("u1", None, 5), ("u9", "n", 2), ("u9", "m", 1), (None, "z", 9)],
                               "user_id string, line_user_id string, at int")
    got = {r.user_id: r.line_user_id for r in K.maintain_users(u, ch, order="at").collect()}
    assert got == {"u1": "y", "u2": "L2", "u9": "n"}
    assert K.maintain_users(u, ch, order="at").count() == 3


def test_look_ups_open_one_bucket(spark, scratch):
    d = docs(spark)
    DOC.write_documents(d, f"{scratch}/docs", buckets=32)
    stored = spark.read.parquet(f"{scratch}/docs")
    live = d.where(~F.coalesce("is_deleted", F.lit(False)))
    for row in live.collect():
        keys = spark.createDataFrame([(row.user_id, row.training_date, row.exercise_id)], "user_id string, training_date string, exercise_id string")
        found = DOC.get_documents(stored, keys, buckets=32)
        assert [r.doc_id for r in found.collect()] == [r.doc_id for r in DOC.get_document(d, row.user_id, row.training_date, row.exercise_id).collect()]
        assert len({os.path.dirname(f) for f in found.inputFiles()}) <= 32
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [doc_bucket" in plan.replace("isnotnull(doc_bucket#", "[doc_bucket#") or "doc_bucket" in plan.split("PartitionFilters")[1].split("]")[0]
        day = DOC.list_documents_by_days(stored, keys, buckets=32)
        assert {r.doc_id for r in day.collect()} == {r.doc_id for r in DOC.list_documents_by_day(d, row.user_id, row.training_date).collect()}


def test_relations_and_uniqueness_in_one_pass(spark):
    child = spark.createDataFrame([("a",), ("b",), ("b",), ("z",), ("z",), (None,)], "k string")
    parent = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    got = QL.run_relations({"c": child, "p": parent}, [QL.Relation("c", "k", "p", "k"), QL.Relation("p", "k", "p", "k")]).collect()
    assert {(r.model, r.failures, r.orphan_keys, r.status) for r in got} == {("c", 2, 1, "warn"), ("p", 0, 0, "pass")}
    suite = QL.run_suite({"c": child, "p": parent}, [QL.Check("c", "k", "unique"), QL.Check("p", "k", "unique"), QL.Check("c", "k", "not_null")])
    assert {(r.model, r.check_name): r.failures for r in suite.collect()} == {("c", "unique"): 2, ("p", "unique"): 0, ("c", "not_null"): 1}


def test_a_long_digest_in_chunks(spark):
    n = 3 * NT.CHUNK_LINES + 7
    lines = spark.range(n).select(F.lit(1).alias("section"), F.col("id").alias("rank"), F.lit("u").alias("user_id"),
                                  F.concat(F.lit("line "), F.col("id").cast("string")).alias("text")).repartition(5)
    chunks = NT.digest_chunks(lines, "d")
    assert [r.chunk for r in chunks.orderBy("chunk").collect()] == [0, 1, 2, 3]
    assert NT.render_message(lines).split("\n") == [f"line {i}" for i in range(n)]
    plan = spark.createDataFrame([("a", "L", "t", "sent", 1, "d"), ("b", "L", "t", "suppressed", None, "d")],
                                 "user_id string, line_user_id string, notification_type string, status string, position bigint, digest string")
    assert {(r.user_id, r.chunk) for r in NT.digest_deliveries(plan, chunks).collect()} == {("a", i) for i in range(4)}


def test_every_plan_row_has_the_whole_digest(spark):
    n = 2 * NT.CHUNK_LINES + 3
    lines = spark.range(n).select(F.lit(1).alias("section"), F.col("id").alias("rank"), F.lit("u").alias("user_id"),
                                  F.concat(F.lit("line "), F.col("id").cast("string")).alias("text")).repartition(5)
    who = spark.createDataFrame([("a", "A"), ("b", "B")], "user_id string, line_user_id string")
    plan = NT.digest_plan("d", who, 199, "weekly_ranking")
    got = {r.user_id: r for r in NT.digest_messages(plan, NT.digest_chunks(lines, "d")).collect()}
    assert {u: r.status for u, r in got.items()} == {"a": "sent", "b": "suppressed"}
    assert all(r.message == "\n".join(f"line {i}" for i in range(n)) for r in got.values())
