"""Stateful streaming exact deduplication (dealt operator 4).

Built from DataFrame and SQL functions alone.  Every row's normalised text is
digested; a Structured Streaming query keeps state by digest in RocksDB (on
disk, without watermark or expiry): the stable identifier and content locator
of the row that stays, and how many rows have come.  A digest seen more than
once is a hit, and hits are decided on full bytes: the texts of a hit are
joined with the text at the keeper's locator and compared.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from liftlake.llm.runtime import scratch, written

_ROCKS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # commit small change logs; full snapshots are uploaded in the background
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # no space set aside ahead: 4 MB for each open store is more than a small
    # partition's whole state
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # an executor may have a store open for each of many partitions: all share
    # one block cache and one budget of write buffers, outside the heap
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
}
#: On a mounted file system the default manager of checkpoint files asks a new
#: process (a copy of the executor's) about every file; this one does not.
_MOUNTED = {"spark.sql.streaming.checkpointFileManagerClass":
            "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager"}
#: Files that one micro-batch takes, at most; the state carries over.
FILES_PER_BATCH = 10_000


def normalised(text: Column) -> Column:
    """The text with every run of space and \\x09-\\x0D as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _digest(body: Column) -> Column:
    return F.unhex(F.sha2(body.cast("binary"), 256))


def _place(docs: DataFrame) -> tuple[Column, Column]:
    """Where a row is found: (file, row) for one scan of files, else nulls (also
    for a union of scans, whose rows have no common source)."""
    found = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    try:
        docs.select(*found)
    except AnalysisException:
        return F.lit(None).cast("string"), F.lit(None).cast("long")
    return found


def _with_locator(docs: DataFrame) -> DataFrame:
    """doc_id, text and the row's locator (file, row)."""
    file, row = _place(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       file.alias("file"), row.alias("row"))


def _ident() -> Column:
    """Order of rows: by id (null last), then by place for repeated ids."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")


def keyed_state(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """Run a streaming frame (digest, doc_id, file, row) to its present end
    through disk-backed keyed state; digest, keeper and n of every digest.

    A micro-batch writes what it changed to a folder of its own number, so one
    that is run again after a failure replaces its own output; the newest
    entry of a digest counts.
    """
    out, at = scratch(spark, "exact-state"), scratch(spark, "exact-stream")
    state = stream.groupBy("digest").agg(F.min(_ident()).alias("keeper"), F.count(F.lit(1)).alias("n"))

    def put(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/batch={number}")

    settings = _ROCKS | (_MOUNTED if at.startswith(("file:", "/")) else {})
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        (state.writeStream.outputMode("update").option("checkpointLocation", at)
         .trigger(availableNow=True).foreachBatch(put).start().awaitTermination())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    found = spark.read.schema("digest binary, keeper struct<no_id:boolean,doc_id:bigint,file:string,row:bigint>, "
                              "n bigint, batch int").parquet(out)
    return (found.groupBy("digest").agg(F.max_by(F.struct("keeper", "n"), "batch").alias("last"))
            .select("digest", "last.keeper", "last.n"))


def exact_dedup(docs: DataFrame, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, and
    the row's locator (file, row).

    Null texts count as empty, so all null, empty and equal texts group as
    their normalised bytes say.  Of rows with one id and equal texts the first
    by file and row stays; a row without an id stays only if no row of its
    group has one.  Empty tables give an empty result; other columns do not
    matter.  A frame that is not read from files has no locators: rows that
    also share their id are then told apart by nothing, and all of them count
    as the row that stays.
    """
    spark = docs.sparkSession
    docs = _with_locator(docs)
    log_path = scratch(spark, "exact-log")
    (docs.select("doc_id", "file", "row", _digest(normalised(F.col("text"))).alias("digest"))
     .write.parquet(log_path))
    log = spark.read.parquet(log_path)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", files_per_batch).parquet(log_path)
    groups = written(keyed_state(stream, spark), "exact-groups")
    hits = groups.where("n > 1")

    # full bytes: texts of hits against the text at their keeper's locator
    member = log.join(hits, "digest").select(
        "digest", "doc_id", "file", "row", "keeper",
        _ident().eqNullSafe(F.col("keeper")).alias("is_keeper"))
    texts = written(
        docs.alias("t").join(member.alias("m"),
                             F.col("t.doc_id").eqNullSafe(F.col("m.doc_id")) & F.col("t.file").eqNullSafe(F.col("m.file"))
                             & F.col("t.row").eqNullSafe(F.col("m.row")))
        .select("m.digest", "m.doc_id", "m.file", "m.row", "m.is_keeper", normalised(F.col("t.text")).alias("body")), "exact-hits")
    keeper_text = (texts.where("is_keeper").groupBy("digest").agg(F.min("body").alias("keeper_body")))
    other = (texts.join(keeper_text, "digest").where("body != keeper_body")
             .select("digest", "doc_id", "file", "row", "body"))
    # different bytes under one digest: groups of their own, by the bytes
    split = (other.join(other.groupBy("digest", "body").agg(F.min(_ident()).alias("own_keeper"), F.count(F.lit(1)).alias("own_n")),
                        ["digest", "body"]).select("digest", "doc_id", "file", "row", "own_keeper", "own_n"))
    split = written(split, "exact-split")
    rows = log.join(groups, "digest").select("digest", "doc_id", "file", "row", "keeper", F.col("n").alias("group_size"))
    if not split.isEmpty():
        lost = split.groupBy("digest").agg(F.count(F.lit(1)).alias("lost"))
        same = (F.col("r.doc_id").eqNullSafe(F.col("s.doc_id")) & F.col("r.file").eqNullSafe(F.col("s.file"))
                & F.col("r.row").eqNullSafe(F.col("s.row")) & (F.col("r.digest") == F.col("s.digest")))
        rows = rows.join(lost, "digest", "left").alias("r").join(split.alias("s"), same, "left").select(
            "r.digest", "r.doc_id", "r.file", "r.row", F.coalesce("s.own_keeper", "r.keeper").alias("keeper"),
            F.coalesce(F.col("s.own_n"), F.col("r.group_size") - F.coalesce("r.lost", F.lit(0))).alias("group_size"))
    return rows.select(
        "doc_id", F.col("keeper.doc_id").alias("keep_id"), "group_size",
        _ident().eqNullSafe(F.col("keeper")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "file", "row")


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that stay by ``exact_dedup(docs)``."""
    stay = found.where("kept").select(F.col("doc_id").alias("keep_id"), F.col("file").alias("keep_file"), F.col("row").alias("keep_row"))
    # the rows as one column, so that none of theirs can be hidden
    file, row = _place(docs)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("all"), F.col("doc_id").cast("long").alias("own_id"),
                       file.alias("own_file"), row.alias("own_row"))
    same = (F.col("own_id").eqNullSafe(F.col("keep_id")) & F.col("own_file").eqNullSafe(F.col("keep_file"))
            & F.col("own_row").eqNullSafe(F.col("keep_row")))
    return rows.join(stay, same, "left_semi").select("all.*")
