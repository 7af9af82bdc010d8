"""Incremental loading without a MERGE-capable table format.

``merge_upsert`` is the DataFrame form of ``MERGE ... WHEN MATCHED UPDATE
WHEN NOT MATCHED INSERT`` (no delete branch unless asked). ``write_upsert``
applies it to a parquet table laid out by month and, inside a month, by a
hash bucket of the key: the rows that a batch can replace lie in the buckets
of its keys, so only files of those buckets are opened, and only the folders
that hold a replaced row or get a new one are rewritten (through a staging
folder). Keys compare null-safe everywhere.
"""

from __future__ import annotations

import datetime as _dt
import json
import uuid
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from liftlake.functions.exprs import col_of, month_start, ntz
from liftlake.operators.joins import broadcast_if_few, null_safe_join

EPOCH = _dt.datetime(1970, 1, 1)


def watermark_value(target: DataFrame, column: str, default=EPOCH):
    """MAX(column) of the target as a driver-side literal; an empty target
    yields ``default`` (a NULL maximum would otherwise load nothing, forever)."""
    row = target.agg(F.max(column).alias("m")).first()
    return default if row is None or row["m"] is None else row["m"]


def watermark_filter(source: DataFrame, source_col: str, target: DataFrame, target_col: str,
                     lookback: _dt.timedelta | None = None, default=EPOCH) -> DataFrame:
    """Rows of ``source`` strictly newer than the target's maximum. The bound
    is a literal, so the comparison is pushed into the parquet scan."""
    mark = watermark_value(target, target_col, default)
    if lookback:
        mark = mark - lookback
    bound = ntz(mark) if isinstance(mark, _dt.datetime) and mark.tzinfo is None else F.lit(mark)
    return source.where(F.col(source_col) > bound)


def merge_upsert(target: DataFrame, source: DataFrame, keys: Sequence[str],
                 delete_when: str | Column | None = None, rows: int | None = None) -> DataFrame:
    """Replace target rows whose key occurs in ``source`` and insert the new
    keys; a NULL in a key matches NULL. ``source`` must hold one row per key. With ``delete_when`` the
    matching source rows remove the key instead (tombstones). ``rows``: how
    many rows ``source`` has, if known."""
    keys = list(keys)
    src_keys = source.select(*keys)
    kept = null_safe_join(target, broadcast_if_few(src_keys, rows), keys, "left_anti")
    incoming = source
    if delete_when is not None:
        incoming = source.where(~F.coalesce(col_of(delete_when), F.lit(False)))
    return kept.unionByName(incoming.select(*target.columns))


def with_month(df: DataFrame, date_col: str, month_col: str = "training_month") -> DataFrame:
    return df.withColumn(month_col, month_start(date_col))


def append_rows(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Append; any write error raises (no silently ignored rows)."""
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def full_refresh(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """A10: replace the whole table with a query result."""
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_month_partitioned(df: DataFrame, path: str, date_col: str,
                            month_col: str = "training_month", mode: str = "overwrite") -> None:
    """Layout by month of a date column (filters must repeat the month
    predicate to prune)."""
    with_month(df, date_col, month_col).write.mode(mode).partitionBy(month_col).parquet(path)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _fs(spark, path)
    return bool(fs.exists(p))


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh folder under the shared checkpoint directory (never machine-local
    on a cluster)."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder."""
    fs, p, _ = _fs(spark, path)
    fs.delete(p, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a scratch folder and read from it: cuts the lineage like
    a checkpoint, in compressed columns of which later steps read those they need."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Folder level under a month, and its number of buckets for new tables.
BUCKET = "key_bucket"
BUCKETS = 16


def key_bucket(keys: Sequence[str], buckets: int) -> Column:
    """Bucket of a key (NULLs included); a function of the key alone."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _buckets_of(spark: SparkSession, path: str, wanted: int) -> int:
    """The table's number of buckets, fixed when it is created (a marker file
    that readers skip)."""
    fs, root, jvm = _fs(spark, path)
    for found in fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, "_buckets-*")) or []:
        return int(found.getPath().getName().rpartition("-")[2])
    fs.mkdirs(root)
    fs.create(jvm.org.apache.hadoop.fs.Path(root, f"_buckets-{wanted}")).close()
    return wanted


def _folders(spark: SparkSession, path: str, month_col: str) -> dict[tuple[str, int], str]:
    """The folders of a table by (month as in the folder's name, bucket)."""
    fs, root, jvm = _fs(spark, path)
    out = {}
    for found in fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, f"{month_col}=*/{BUCKET}=*")) or []:
        p = found.getPath()
        out[p.getParent().getName().partition("=")[2], int(p.getName().partition("=")[2])] = p.toString()
    return out


def read_upserted(spark: SparkSession, path: str, month_col: str = "training_month") -> DataFrame:
    """A table of ``write_upsert`` without its layout columns, after any
    publication that a dead run left half-way."""
    _publish(spark, path, month_col)
    return spark.read.parquet(path).drop(month_col, BUCKET)


def _publish(spark: SparkSession, path: str, month_col: str) -> None:
    """Finish the publication that a table's marker names, if there is one: the
    staged folders replace those of the table, emptied ones go. The staged
    rows are complete before the marker is written and stay until it is gone,
    so a run that died half-way is finished by the next one."""
    fs, root, jvm = _fs(spark, path)
    marker = jvm.org.apache.hadoop.fs.Path(root, "_publish")
    if not fs.exists(marker):
        return
    text = fs.open(marker)
    todo = json.loads(jvm.org.apache.commons.io.IOUtils.toString(text, "UTF-8"))
    text.close()
    (spark.read.schema(StructType.fromJson(todo["schema"])).parquet(todo["stage"]).repartition(month_col, BUCKET)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(month_col, BUCKET).parquet(path))
    for folder in todo["emptied"]:
        gone = jvm.org.apache.hadoop.fs.Path(folder)
        fs.delete(gone, True)
        if fs.exists(gone.getParent()) and not fs.listStatus(gone.getParent()):
            fs.delete(gone.getParent(), True)
    fs.delete(marker, False)
    fs.delete(jvm.org.apache.hadoop.fs.Path(todo["stage"]), True)


def write_upsert(spark: SparkSession, source: DataFrame, path: str, keys: Sequence[str],
                 date_col: str, month_col: str = "training_month",
                 delete_when: str | Column | None = None, buckets: int = BUCKETS) -> dict:
    """Upsert ``source`` (one row per key) into the table at ``path``, laid out
    by month of a date and bucket of the key.

    A key's bucket does not change, so replaced rows are looked for in the
    folders of the batch's buckets only, by their key columns; then the folders
    that hold one, and those that the batch's rows go to, are read, merged and
    staged, and a marker is left from which the publication can be finished by
    the next run if this one dies. A folder left without rows is removed.
    Idempotent: replaying a batch gives the same table, also for keys with
    NULLs. ``buckets`` counts for a new table only.
    """
    keys = list(keys)
    buckets = _buckets_of(spark, path, buckets)
    _publish(spark, path, month_col)
    # the delta is written once; every later step reads that table
    delta, stage = scratch_path(spark, "upsert-delta"), scratch_path(spark, "upsert-stage")
    laid = with_month(source, date_col, month_col).withColumn(BUCKET, key_bucket(keys, buckets))
    laid.write.parquet(delta)
    src = spark.read.schema(laid.schema).parquet(delta)
    fs, root, jvm = _fs(spark, path)
    there = _folders(spark, path, month_col)

    def place(row) -> tuple[str, int]:
        return "__HIVE_DEFAULT_PARTITION__" if row[0] is None else str(row[0]), row[1]

    def read(folders: list[str]) -> DataFrame:
        if not folders:
            # known to be empty, so no join with it is run
            return src.limit(0)
        return spark.read.schema(laid.schema).option("basePath", path).parquet(*folders)
    rows = src.count()
    goes = {place(r) for r in src.select(month_col, BUCKET).distinct().collect()}
    hit = {b for _, b in goes}
    opened = [f for (_, b), f in there.items() if b in hit]
    held = null_safe_join(read(opened).select(*keys, month_col, BUCKET), broadcast_if_few(src.select(*keys), rows), keys, "left_semi")
    touched = goes | ({place(r) for r in held.select(month_col, BUCKET).distinct().collect()} if opened else set())
    report = {"months": sorted({m for m, _ in touched}), "folders": len(touched), "opened": len(opened), "created": not there}
    if touched:
        merged = merge_upsert(read([f for k, f in there.items() if k in touched]), src, keys, delete_when, rows)
        # a folder is written by one task, as one file
        merged.repartition(month_col, BUCKET).write.partitionBy(month_col, BUCKET).parquet(stage)
        present = _folders(spark, stage, month_col)
        todo = {"stage": stage, "schema": laid.schema.jsonValue(),
                "emptied": [there[k] for k in (touched & set(there)) - set(present)]}
        # renamed into place, so that a marker is whole
        made = jvm.org.apache.hadoop.fs.Path(root, f"_publish-{uuid.uuid4().hex}")
        out = fs.create(made)
        out.write(json.dumps(todo).encode())
        out.close()
        fs.rename(made, jvm.org.apache.hadoop.fs.Path(root, "_publish"))
        _publish(spark, path, month_col)
    elif not there:
        # an empty table keeps its schema
        laid.limit(0).write.mode("append").parquet(path)
    fs.delete(jvm.org.apache.hadoop.fs.Path(delta), True)
    return report
