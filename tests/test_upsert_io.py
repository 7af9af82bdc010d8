"""On-disk upsert: incremental runs equal a full run; moved rows; idempotence."""

import datetime as dt

from literal import BATCH16, log_rows
from pyspark.sql import functions as F

from liftlake import schemas
from liftlake.operators.upsert import write_upsert
from liftlake.plans import models as M


def _read(spark, path):
    return sorted(tuple(r) for r in spark.read.parquet(path).drop("training_month").collect())


def test_incremental_equals_full_and_is_idempotent(spark, scratch):
    raw = spark.createDataFrame(log_rows(BATCH16), schemas.TRAINING_LOG)
    full = M.stg_training_log(raw, tiebreak=())
    inc_path, full_path = f"{scratch}/inc", f"{scratch}/full"
    write_upsert(spark, full, full_path, ["log_id"], "training_date")
    first = full.where(F.col("training_date") < dt.date(2025, 1, 20))
    rest = full.where(F.col("training_date") >= dt.date(2025, 1, 20))
    write_upsert(spark, first, inc_path, ["log_id"], "training_date")
    write_upsert(spark, rest, inc_path, ["log_id"], "training_date")
    assert _read(spark, inc_path) == _read(spark, full_path)
    write_upsert(spark, rest, inc_path, ["log_id"], "training_date")
    assert _read(spark, inc_path) == _read(spark, full_path)


def test_changed_date_moves_between_month_partitions(spark, scratch):
    raw = spark.createDataFrame(log_rows(BATCH16[:2]), schemas.TRAINING_LOG)
    path = f"{scratch}/t"
    write_upsert(spark, M.stg_training_log(raw, tiebreak=()), path, ["log_id"], "training_date")
    moved = raw.where("log_id = 'test-001'").withColumn("training_date", F.lit(dt.date(2024, 12, 31)))
    write_upsert(spark, M.stg_training_log(moved, tiebreak=()), path, ["log_id"], "training_date")
    got = {r.log_id: r.training_date for r in spark.read.parquet(path).collect()}
    assert got == {"test-001": dt.date(2024, 12, 31), "test-002": dt.date(2025, 1, 20)}
    # deleting the only row of a month removes that partition
    gone = raw.where("log_id = 'test-002'").withColumn("is_deleted", F.lit(True))
    src = M.cleanse(gone).withColumn("is_deleted", F.lit(True))
    write_upsert(spark, src, path, ["log_id"], "training_date", delete_when="is_deleted")
    months = {r.training_month for r in spark.read.parquet(path).select("training_month").distinct().collect()}
    assert months == {dt.date(2024, 12, 1)}


def _log(spark, rows):
    return spark.createDataFrame(rows, "log_id string, updated_at timestamp_ntz, training_date date, v long")


def test_null_keys_replay_to_one_row(spark, scratch):
    """A NULL in a key equals NULL: three deliveries of a row are one row."""
    path, day = f"{scratch}/n", dt.date(2025, 1, 20)
    rows = [("a", None, day, 1), (None, dt.datetime(2025, 1, 1), day, 2), (None, None, None, 3)]
    for turn in range(3):
        write_upsert(spark, _log(spark, [(*r[:3], r[3] + turn) for r in rows]), path, ["log_id", "updated_at"], "training_date")
    got = sorted(r.v for r in spark.read.parquet(path).collect())
    assert got == [3, 4, 5]


def test_only_touched_buckets_are_read_and_written(spark, scratch):
    """A batch of one key opens the folders of its bucket and rewrites one or,
    where the row moves to another month, two; all other files stay as they are."""
    import glob
    import os
    path = f"{scratch}/b"
    days = [dt.date(2025, m, 3) for m in range(1, 7)]
    write_upsert(spark, _log(spark, [(f"k{i}", dt.datetime(2025, 1, 1), days[i % 6], i) for i in range(400)]),
                 path, ["log_id"], "training_date", buckets=8)

    def files():
        return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}
    before = files()
    assert len({os.path.dirname(f) for f in before}) == 48
    report = write_upsert(spark, _log(spark, [("k7", dt.datetime(2025, 2, 1), days[0], -1)]), path, ["log_id"], "training_date", buckets=99)
    assert (report["opened"], report["folders"]) == (6, 2)
    after = files()
    changed = {os.path.dirname(f) for f in set(before) ^ set(after)}
    assert len(changed) == 2 and len({d.rpartition("=")[2] for d in changed}) == 1
    got = {r.log_id: (r.v, r.training_date) for r in spark.read.parquet(path).collect()}
    assert len(got) == 400 and got["k7"] == (-1, days[0])


def test_empty_batches(spark, scratch):
    path = f"{scratch}/e"
    assert write_upsert(spark, _log(spark, []), path, ["log_id"], "training_date")["folders"] == 0
    write_upsert(spark, _log(spark, [("a", None, None, 1)]), path, ["log_id"], "training_date")
    assert write_upsert(spark, _log(spark, []), path, ["log_id"], "training_date")["folders"] == 0
    assert [r.v for r in spark.read.schema("v long").parquet(path).collect()] == [1]


def test_keys_of_a_large_batch_are_not_broadcast(spark, scratch):
    """Files that compress well say nothing of the rows that the driver would hold."""
    from liftlake.operators.joins import BROADCAST_ROWS
    from liftlake.operators.upsert import merge_upsert

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()
    spark.range(1000).selectExpr("'a long key, always the same' AS k", "id AS v").write.parquet(f"{scratch}/d")
    rows = spark.read.parquet(f"{scratch}/d")
    assert "Broadcast" in plan(merge_upsert(rows, rows, ["k"], rows=1000))
    assert "Broadcast" not in plan(merge_upsert(rows, rows, ["k"], rows=BROADCAST_ROWS + 1))
    # nothing is there yet: no join at all
    assert "Join" not in plan(merge_upsert(rows.limit(0), rows, ["k"], rows=1000))


def test_upsert_of_a_large_batch(spark, scratch, monkeypatch):
    from liftlake.operators import joins
    monkeypatch.setattr(joins.broadcast_if_few, "__defaults__", (1,))
    raw = spark.createDataFrame(log_rows(BATCH16), schemas.TRAINING_LOG)
    full = M.stg_training_log(raw, tiebreak=())
    write_upsert(spark, full, f"{scratch}/t", ["log_id"], "training_date")
    first = _read(spark, f"{scratch}/t")
    heavier = full.withColumn("weight_kg", F.col("weight_kg") + 1)
    write_upsert(spark, heavier, f"{scratch}/t", ["log_id"], "training_date")
    write_upsert(spark, heavier, f"{scratch}/t", ["log_id"], "training_date")
    again = _read(spark, f"{scratch}/t")
    assert len(again) == len(first) == full.count() and again != first
