"""Cases that once lost, doubled or changed rows."""

import datetime as dt
import os
import subprocess
import sys
import textwrap

import pytest
from literal import BATCH16, log_rows
from pyspark.sql import functions as F
from test_documents import docs

from liftlake import schemas
from liftlake.operators import documents as DOC
from liftlake.operators import quality as QL
from liftlake.operators.latest import latest_by_key, training_log_order
from liftlake.operators.quota import gate
from liftlake.operators.upsert import write_upsert
from liftlake.plans import models as M
from liftlake.plans import notify as NT
from liftlake.streaming.microbatch import reject_path, run_to_completion

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_upsert_keeps_rows_without_a_date(spark, scratch):
    kind = "log_id string, training_date date, v int"
    path = f"{scratch}/t"
    for rows in ([("a", None, 1), ("c", dt.date(2025, 1, 3), 1)], [("b", None, 2)], [("a", dt.date(2025, 1, 9), 3)], [("c", None, 4)]):
        write_upsert(spark, spark.createDataFrame(rows, kind), path, ["log_id"], "training_date")
    got = {r.log_id: (r.training_date, r.v) for r in spark.read.parquet(path).collect()}
    assert got == {"a": (dt.date(2025, 1, 9), 3), "b": (None, 2), "c": (None, 4)}


def test_gate_with_null_and_equal_keys(spark):
    c = spark.createDataFrame([("u1", None), ("u1", "leg"), ("u2", "arm"), ("u2", "arm"), ("u3", None)], "user_id string, part string")
    for allowance in range(7):
        got = gate(c, [F.col("user_id").asc(), F.col("part").asc_nulls_first()], allowance, "7day", ["user_id", "part"]).collect()
        assert len(got) == 5 and sum(r.status == "sent" for r in got) == min(allowance, 5)
        assert sorted(r.position for r in got if r.status == "sent") == list(range(1, min(allowance, 5) + 1))
        assert sorted((r.user_id, r.part or "") for r in got) == sorted((r.user_id, r.part or "") for r in c.collect())


def test_calendar_labels_go_by_name(spark):
    f = spark.createDataFrame([
        ("u", dt.date(2025, 1, 1), "chest", "bench", "b1", 60.0, 600.0), ("u", dt.date(2025, 1, 1), "chest", "bench", "b2", 80.0, 800.0),
        ("u", dt.date(2025, 1, 1), None, "bench", "b2", 70.0, 10.0)],
        "user_id string, training_date date, body_part_name string, exercise_name string, exercise_id string, weight_kg double, volume double")
    got = M.m_calendar(f).first()
    assert (got.exercise_count, got.total_volume, got.body_parts) == (2, 1410.0, "chest")
    assert got.exercise_summary == "bench: 70kg / bench: 80kg"
    assert M.m_calendar(f.where("body_part_name is not null")).first().exercise_summary == "bench: 80kg"


def test_suite_does_not_skip_checks(spark):
    with pytest.raises(KeyError):
        QL.run_suite({"d_user": spark.createDataFrame([("u",)], "user_id string")}, QL.DOCUMENTED_SUITE)


def test_documents_with_offsets_and_bad_dates(spark):
    d = docs(spark)
    pending = DOC.scan_pending(d)
    n = DOC.explode_documents(pending).count()
    moved = pending.withColumn("sets", F.transform("sets", lambda s: s.withField("created_at", F.lit("2025-01-20T09:00:00+09:00"))))
    assert {r.created_at for r in DOC.explode_documents(moved).collect()} == {dt.datetime(2025, 1, 20, 0, 0)}
    one = pending.orderBy("doc_id").first().doc_id
    bad = pending.withColumn("training_date", F.when(F.col("doc_id") == one, "20th of May").otherwise(F.col("training_date")))
    lost = pending.where(F.col("doc_id") == one).select(F.size("sets")).first()[0]
    assert DOC.explode_documents(bad).count() == n - lost
    assert [r.doc_id for r in DOC.rejected_documents(bad).collect()] == [one]
    r = DOC.sync_report(bad).first()
    assert r.documents_total - r.documents_ok == 1 and r.rows_written == n - lost


def test_stream_keeps_what_it_cannot_read(spark, scratch):
    d = docs(spark)
    src = f"{scratch}/in"
    d.coalesce(1).write.json(src)
    good = sorted(tuple(r) for r in run_to_completion(spark, src, f"{scratch}/a", f"{scratch}/ck1").collect())
    with open(f"{src}/broken.json", "w") as f:
        f.write('{"doc_id": "x", "sets": [\n')
    out = run_to_completion(spark, src, f"{scratch}/b", f"{scratch}/ck2")
    assert sorted(tuple(r) for r in out.collect()) == good
    assert [r.record for r in spark.read.parquet(reject_path(f"{scratch}/b")).collect()] == ['{"doc_id": "x", "sets": [']


def test_version_order_without_source_columns(spark):
    raw = spark.createDataFrame(log_rows(BATCH16), schemas.TRAINING_LOG)
    again = raw.unionByName(raw.withColumn("memo", F.lit("zz")))
    got = latest_by_key(again, ["log_id"], training_log_order())
    assert {r.memo for r in got.collect()} == {"zz"}


def test_digest_text_of_many_lines(spark):
    n = 12_000
    lines = spark.range(n).select(F.lit(1).alias("section"), F.col("id").alias("rank"), F.col("id").cast("string").alias("user_id"),
                                  F.concat(F.lit("line "), F.col("id").cast("string")).alias("text"))
    assert NT.render_message(lines).split("\n") == [f"line {i}" for i in range(n)]
    assert NT.render_message(lines.limit(0)) is None


_ZONES = textwrap.dedent("""
    import datetime as dt, sys
    sys.path.insert(0, sys.argv[1])
    from liftlake.session import get_spark
    from liftlake.operators.quota import monthly_sent_count
    from liftlake.operators.upsert import watermark_filter
    s = get_spark("local[2]", 2)
    t = [dt.datetime(2025, 1, 31, 14, 59, 59), dt.datetime(2025, 1, 31, 15, 0), dt.datetime(2025, 2, 3, 0, 0)]
    log = s.sql("SELECT * FROM VALUES " + ", ".join(f"('sent', TIMESTAMP_NTZ '{x}')" for x in t) + " AS v(status, sent_at)")
    print("COUNT", monthly_sent_count(log, dt.datetime(2025, 2, 3)).first()["cnt"])
    old = log.where("sent_at < TIMESTAMP_NTZ '2025-02-01 00:00:00'")
    print("NEW", watermark_filter(log, "sent_at", old, "sent_at").count())
""")


@pytest.mark.parametrize("zone", ["Asia/Tokyo", "America/New_York"])
def test_results_do_not_depend_on_the_drivers_zone(zone, scratch):
    env = os.environ | {"TZ": zone}
    out = subprocess.run([sys.executable, "-c", _ZONES, ROOT], env=env, capture_output=True, text=True, timeout=300, cwd=scratch)
    assert "COUNT 2" in out.stdout and "NEW 1" in out.stdout, out.stdout + out.stderr[-2000:]
