"""Micro-batch document sync: several files, replay-safe upsert."""

from pyspark.sql import functions as F

from liftlake.streaming.microbatch import run_to_completion
from test_documents import docs


def test_stream_sync_is_idempotent(spark, scratch):
    d = docs(spark)
    src, tgt, ck = f"{scratch}/in", f"{scratch}/raw", f"{scratch}/ck"
    d.where(F.col("doc_id").contains("bench")).write.mode("overwrite").json(f"{src}/a")
    d.where(~F.col("doc_id").contains("bench")).write.mode("overwrite").json(f"{src}/b")
    # the stream reads the folder of files; move both sets into one folder
    d.write.mode("overwrite").json(src + "_all")
    out = run_to_completion(spark, src + "_all", tgt, ck, max_files=1)
    first = sorted(tuple(r) for r in out.collect())
    assert {r.log_id for r in out.collect()} == {"s1", "s2", "s3"}
    # a second delivery of the same documents (new files, fresh checkpoint) changes nothing
    d.write.mode("overwrite").json(src + "_again")
    again = run_to_completion(spark, src + "_again", tgt, ck + "2", max_files=1)
    assert sorted(tuple(r) for r in again.collect()) == first


def _files(path):
    import os
    return sorted((os.path.join(at, n), os.stat(os.path.join(at, n)).st_mtime_ns) for at, _, names in os.walk(path) for n in names)


def test_replay_is_decided_by_state(spark, scratch):
    """Delivered again into the same stream: no file of the table is touched,
    also for versions without an update time; a change is taken over alone."""
    d = docs(spark).withColumn("sets", F.transform("sets", lambda s: s.withField("updated_at", F.lit(None).cast("string"))))
    src, tgt, ck = f"{scratch}/in3", f"{scratch}/raw3", f"{scratch}/ck3"
    d.coalesce(1).write.mode("append").json(src)
    first = sorted(run_to_completion(spark, src, tgt, ck).collect())
    assert [r.log_id for r in first] == ["s1", "s2", "s3"] and {r.updated_at for r in first} == {None}
    before = _files(tgt)
    d.coalesce(1).write.mode("append").json(src)
    assert sorted(run_to_completion(spark, src, tgt, ck).collect()) == first
    assert _files(tgt) == before
    # one set gets heavier, its version key stays: the larger row stands; a lighter one does not come back
    for more in (5.0, -5.0):
        changed = d.where("doc_id like '%bench%'").withColumn("sets", F.transform("sets", lambda s: s.withField(
            "weight_kg", s["weight_kg"] + F.when(s["set_number"] == 1, more).otherwise(0.0))))
        changed.coalesce(1).write.mode("append").json(src)
        got = {r.log_id: r.weight_kg for r in run_to_completion(spark, src, tgt, ck).collect()}
        assert got == {"s1": 85.0, "s2": 85.0, "s3": 100.0}


def test_newest_version_per_set(spark, scratch):
    """Keyed by the set alone, a late older version changes nothing."""
    from liftlake.operators.upsert import read_upserted
    from liftlake.streaming.microbatch import microbatch_sync
    src, tgt, ck = f"{scratch}/in4", f"{scratch}/raw4", f"{scratch}/ck4"
    for stamp, weight in (("2025-01-20T10:00:00", 90.0), ("2025-01-20T09:00:00", 95.0), ("2025-01-20T11:00:00", 70.0)):
        (docs(spark).where("doc_id like '%squat' and user_id = 'user_1'").withColumn("sets", F.transform("sets", lambda s: s.withField(
            "updated_at", F.lit(stamp)).withField("weight_kg", F.lit(weight)))).coalesce(1).write.mode("append").json(src))
        q = microbatch_sync(spark, src, tgt, ck, key=("log_id",))
        q.awaitTermination()
        rows = read_upserted(spark, tgt).collect()
        assert [r.weight_kg for r in rows] == [70.0 if weight == 70.0 else 90.0]


def test_rejects_are_taken_once(spark, scratch):
    import os
    from liftlake.streaming.microbatch import reject_path
    src, tgt, ck = f"{scratch}/in5", f"{scratch}/raw5", f"{scratch}/ck5"
    os.makedirs(src)
    for n in range(2):
        with open(f"{src}/{n}.json", "w") as f:
            f.write("{no document\n")
        run_to_completion(spark, src, tgt, ck)
    assert [r.record for r in spark.read.parquet(reject_path(tgt)).collect()] == ["{no document"]
