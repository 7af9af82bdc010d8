"""Helpers shared by the corpus operators: scratch tables, Arrow slices."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from liftlake.session import ensure_checkpoint_dir

#: Text bytes handed to one round of array operations inside a task.  The
#: arrays made from a slice take some tens of bytes for each text byte, so
#: this bounds a task's memory whatever the batch or the document length.
SLICE_BYTES = 1 << 20


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back, so that later
    steps and lost executors start from files."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that this run made."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most ``limit`` text bytes each, or
    one row where a text alone is longer."""
    if batch.num_rows == 0:
        return
    col = batch.column(batch.schema.get_field_index(text))
    sizes = np.asarray(pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        stop = max(int(np.searchsorted(ends, base + limit, side="right")), at + 1)
        yield batch.slice(at, stop - at)
        at = stop


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]],
               schema: str, text: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` of a function on bounded slices of the rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, limit):
                yield from fn(part)
    return df.mapInArrow(run, schema)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of at most so many rows for the jobs run inside: texts are
    long rows, and a task holds a batch on both sides of the boundary."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array: the first ``counts[0]`` values, the next ``counts[1]``, ..."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
