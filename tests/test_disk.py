"""What queries leave on disk."""

import os
import time

from pyspark.sql import functions as F

import __spark_entry__ as entry
from liftlake.plans import notify as NT
from liftlake.session import free_shuffles, keep_long_texts_once


def _bytes(path):
    return sum(os.path.getsize(f"{at}/{f}") for at, _, names in os.walk(path) for f in names)


def test_long_digest_is_stored_once_a_file(spark, scratch):
    line = F.concat(*[F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"-{i}")), 256) for i in range(20)])
    lines = spark.range(1200).select(F.lit(1).alias("section"), "id", line.alias("text"))
    chunks = lines.groupBy(F.lit("d").alias("digest"), F.floor(F.col("id") / 100).alias("chunk")).agg(F.max("text").alias("one"), F.array_join(F.collect_list("text"), "\n").alias("text"))
    users = spark.range(80).select(F.concat(F.lit("u"), "id").alias("user_id"))
    plan = NT.digest_plan("d", users, 0, "weekly_ranking")
    before = spark.conf.get("parquet.dictionary.page.size", None)
    try:
        keep_long_texts_once(spark)
        out = NT.digest_messages(plan, chunks.drop("one"))
        out.write.parquet(scratch + "/out")
    finally:
        spark.conf.unset("parquet.dictionary.page.size") if before is None else spark.conf.set("parquet.dictionary.page.size", before)
    length = 1200 * (20 * 64 + 1) - 1
    back = spark.read.parquet(scratch + "/out")
    assert back.select("user_id", F.length("message"), F.md5("message")).distinct().count() == 80
    assert {r[0] for r in back.select(F.length("message")).collect()} == {length}
    # some 1.5 MB a file, not for each of 80 rows
    files = len([f for f in os.listdir(scratch + "/out") if f.endswith(".parquet")])
    assert files == 4 and _bytes(scratch + "/out") < 2 * files * length


def test_steps_free_their_shuffles(spark):
    queries = entry.queries()
    try:
        queries["I7_m_last_training"](spark, "/root/testdata/sf0.001")
        df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
        folders = [str(f) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

        def held():
            return {f for d in folders for at, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}
        there = held()
        df.write.format("noop").mode("overwrite").save()
        for _ in range(50):
            if not held() - there:
                break
            time.sleep(0.1)
        assert not held() - there
        # a frame that is executed again makes its files anew
        assert sorted(r["count"] for r in df.collect()) == sorted(r["count"] for r in df.collect())
    finally:
        free_shuffles(spark, False)


def test_documents_are_written_in_shares(spark, scratch):
    from liftlake.operators import documents as DOC
    docs = spark.range(300).select(F.concat(F.lit("d"), "id").alias("doc_id"), F.concat(F.lit("u"), F.col("id") % 40).alias("user_id"),
                                   F.when(F.col("id") % 9 != 0, F.lit("2001-01-01")).alias("training_date"), F.lit(False).alias("is_deleted"))
    root = os.path.dirname(DOC.scratch_path(spark, "x").replace("file:", ""))
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    for _ in range(2):          # a table that is there is replaced
        DOC.write_documents(docs, scratch + "/docs", buckets=16)
    back = spark.read.parquet(scratch + "/docs")
    assert sorted(map(tuple, back.drop("doc_bucket").collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
    wrong = back.where(~F.col("doc_bucket").eqNullSafe(DOC.document_bucket("user_id", "training_date", 16)))
    assert wrong.isEmpty() and set(os.listdir(root)) == before
    files = [f for at, _, names in os.walk(scratch + "/docs") for f in names if f.endswith(".parquet")]
    assert len(files) == back.select("doc_bucket").distinct().count()


def test_kept_frames_are_compressed_columns(spark, scratch):
    from liftlake.operators.upsert import stored
    df = spark.range(20000).select((F.col("id") % 3).alias("k"), F.lit("the same text in every row").alias("t"), F.lit(None).cast("string").alias("n"))
    kept = stored(df, "kept")
    assert kept.schema == df.schema or kept.dtypes == df.dtypes
    assert sorted(map(tuple, kept.groupBy("k", "t", "n").count().collect())) == sorted(map(tuple, df.groupBy("k", "t", "n").count().collect()))
    [path] = {os.path.dirname(f.replace("file://", "").replace("file:", "")) for f in kept.inputFiles()}
    assert _bytes(path) < 20000 * 8
