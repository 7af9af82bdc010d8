"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from liftlake.llm.runtime import written


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for all nodes of the links but
    the smallest ones themselves."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    label = np.arange(len(names))
    while True:
        new = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        new = np.minimum(new, new[label])
        if np.array_equal(new, label):
            break
        label = new
    child = label != np.arange(len(names))
    return names[child], names[label[child]]


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one partition as stars; never more rows than came."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        a = np.concatenate([a, batch.column(0).to_numpy()])
        b = np.concatenate([b, batch.column(1).to_numpy()])
        if len(a) > 500_000:
            a, b = forest(a, b)
    a, b = forest(a, b) if len(a) else (a, b)
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (u, v: long), root being the
    smallest node that it reaches; smallest nodes themselves included.

    Every partition first replaces its links by stars.  Large-star and
    small-star steps (Kiveris et al. 2014) then alternate until nothing
    changes; each reads a written table and groups with a combining aggregate,
    so no node's links meet in one row or task.
    """
    step = written(links.select("u", "v").where("u != v").mapInArrow(_thin, "u long, v long"), "links")

    def stamp(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = stamp(step)
    while before[0]:
        # large-star: every node's larger neighbours point at its smallest one
        both = step.unionByName(step.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        # small-star: a node and its smaller neighbours point at the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        step = written(small.select("e.*").where("u != v").distinct(), "links")
        after = stamp(step)
        if after == before:
            break
        before = after
    return step.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        step.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
