"""Document sync as a micro-batch stream.

New or changed documents land as JSON files in a folder. A file stream
reads them with the declared document schema and flattens the pending ones to
training-log rows (J1). Keyed state on disk holds, for every version key
(log_id, updated_at, is_deleted), the row that stands and when it first came;
a delivery that changes nothing there, such as a replay, writes nothing. What
the state took over is upserted into a month-partitioned table. Progress and
state are kept in the checkpoint folder, so a restarted or failed query resumes
where it stopped; a batch that is run again finds the state before it and
writes the same rows again, and the upsert makes that idempotent.
"""

from __future__ import annotations

from contextlib import contextmanager
from typing import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from liftlake.operators.documents import explode_documents, rejected_documents, scan_pending
from liftlake.operators.upsert import BUCKETS, path_exists, read_upserted, scratch_path, write_upsert
from liftlake.schemas import DOCUMENT, TRAINING_LOG

VERSION_KEY = ("log_id", "updated_at", "is_deleted")
# Remaining business columns, in the order that breaks ties between two
# deliveries of the same version key (largest wins).
TIE_ORDER = ("weight_kg", "reps", "rpe", "set_number", "created_at", "user_id", "exercise_name",
             "body_part", "memo", "input_source", "training_date")


def document_stream(spark: SparkSession, source_dir: str, max_files: int | None = None) -> DataFrame:
    """Documents as they arrive; text that is no document is kept whole in
    ``_corrupt_record``."""
    reader = (spark.readStream.schema(StructType([*DOCUMENT.fields, StructField("_corrupt_record", StringType())]))
              .option("columnNameOfCorruptRecord", "_corrupt_record"))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.json(source_dir)


# State grows with the number of versions, so it lies on disk; the stores of an
# executor share one budget of memory outside the heap.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Session settings while a query starts (it keeps a copy of its own)."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def flattened(arrived: DataFrame) -> DataFrame:
    """Training-log rows of the documents that can be read, and one row with
    ``_doc_id`` and ``_record`` for each of the others."""
    fine = F.col("_corrupt_record").isNull()
    rows = explode_documents(scan_pending(arrived.where(fine)))
    bad = arrived.where(~fine).select(F.col("doc_id").alias("_doc_id"), F.col("_corrupt_record").alias("_record")).unionByName(
        rejected_documents(scan_pending(arrived.where(fine))).select(
            F.col("doc_id").alias("_doc_id"), F.to_json(F.struct(*arrived.columns)).alias("_record")))
    return rows.unionByName(bad, allowMissingColumns=True)


def standing_versions(rows: DataFrame, key: Sequence[str] = VERSION_KEY) -> DataFrame:
    """Keyed state of a stream of ``flattened`` rows: of every key the row that
    stands (the newest version, then the largest by ``TIE_ORDER``), with
    ``is_new``: whether this batch brought it. NULLs in a key are equal.

    The state is one maximum a key, so a hot key is combined before the
    shuffle. The row's first arrival is its last component, negated: of equal
    rows the first one stays, and only a row that arrived first in the present
    batch is new.
    """
    order = [c for c in (*VERSION_KEY, *TIE_ORDER) if c not in key]
    groups = [*key, "_doc_id", "_record"]
    stamped = rows.withColumn("_come", F.unix_micros(F.current_timestamp()))
    kept = stamped.groupBy(*groups).agg(F.max(F.struct(*order, (-F.col("_come")).alias("_first"))).alias("_row"),
                                        F.max("_come").alias("_last"))
    return kept.select(*groups, *[F.col(f"_row.{c}").alias(c) for c in order],
                       (F.col("_row._first") == -F.col("_last")).alias("is_new"))


def reject_path(target_path: str) -> str:
    """Where a sync leaves what it could not read."""
    return f"{target_path.rstrip('/')}-rejects"


def microbatch_sync(spark: SparkSession, source_dir: str, target_path: str, checkpoint_path: str,
                    max_files: int | None = None, available_now: bool = True, key=VERSION_KEY, buckets: int = BUCKETS):
    """Start the sync stream; with ``available_now`` it processes everything
    present and stops (a scheduled 5-15 minute trigger in production)."""
    versions = standing_versions(flattened(document_stream(spark, source_dir, max_files)), key)

    def upsert_batch(batch: DataFrame, epoch_id: int) -> None:
        session = batch.sparkSession
        # the state is advanced by one action; the rest starts from what it wrote
        at = scratch_path(session, "sync-batch")
        batch.where("is_new").drop("is_new").write.parquet(at)
        taken = session.read.schema(batch.drop("is_new").schema).parquet(at)
        # what cannot be read goes to a table of its own (a folder for each
        # batch, so a replay replaces it) and stops nothing
        (taken.where("_record is not null").select(F.col("_doc_id").alias("doc_id"), F.col("_record").alias("record"))
         .write.mode("overwrite").parquet(f"{reject_path(target_path)}/batch={epoch_id}"))
        rows = taken.where("_record is null").select(*TRAINING_LOG.names)
        if not rows.isEmpty() or not path_exists(session, target_path):
            write_upsert(session, rows, target_path, list(key), "training_date", buckets=buckets)

    writer = (versions.writeStream.outputMode("update").foreachBatch(upsert_batch)
                  .option("checkpointLocation", checkpoint_path))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 minutes")
    with _settings(spark, STATE_STORE):
        return writer.start()


def run_to_completion(spark: SparkSession, source_dir: str, target_path: str, checkpoint_path: str,
                      max_files: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    q = microbatch_sync(spark, source_dir, target_path, checkpoint_path, max_files=max_files, buckets=buckets)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    if not path_exists(spark, target_path):
        return spark.createDataFrame([], TRAINING_LOG)
    return read_upserted(spark, target_path)
