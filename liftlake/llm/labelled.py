"""Labelled rows, bounded samples of them, and the fold rule of the contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def _labels(label: DataFrame, parts: int, kept_out: int) -> DataFrame:
    """One label for each document outside the held-out fold, the smallest."""
    return (label.where("doc_id is not null and label is not null")
            .where(fold(F.col("doc_id"), parts) != kept_out)
            .groupBy("doc_id").agg(F.min("label").alias("label")))


def _texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .join(chosen, "doc_id")
            .groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label"))


def learnt(docs: DataFrame, label: DataFrame, parts: int, kept_out: int) -> DataFrame:
    """Every labelled text outside the held-out fold: columns doc_id, text,
    label.  Labels and repeated ids count as in :func:`sample`."""
    return _texts(docs.where(fold(F.col("doc_id").cast("long"), parts) != kept_out), _labels(label, parts, kept_out))


def sample(docs: DataFrame, label: DataFrame, parts: int, kept_out: int, per_class: int) -> DataFrame:
    """At most ``per_class`` texts of every label value, outside the held-out
    fold: columns doc_id, text, label.

    ``label`` has doc_id and label; rows with a null in either are left out,
    and of several labels of a document the smallest counts.  The rows of a
    class are taken in the order of a hash of the id, so the choice does not
    depend on partitioning; the limit is applied before the shuffle as well
    (WindowGroupLimit), so of a class of any size a task gets at most
    ``per_class`` rows from each task before it.  Of several rows of one id the
    smallest text counts, found before the shuffle as far as possible, so the
    bound holds however often an id repeats; null texts come only alone.
    """
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = (_labels(label, parts, kept_out)
              .withColumn("place", F.row_number().over(order))
              .where(F.col("place") <= per_class).select("doc_id", "label"))
    # the sample is bounded by per_class rows a class, so it may be broadcast
    return _texts(docs, F.broadcast(chosen))
