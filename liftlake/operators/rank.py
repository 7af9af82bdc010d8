"""Ranking operators."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from liftlake.functions.exprs import rank_change_label, rank_diff
from liftlake.operators.joins import null_safe_join
from liftlake.operators.ordered import AT, PART, dealt, running_before


def rank_in_partition(df: DataFrame, partition: Sequence[str], value: str,
                      out: str = "rank", descending: bool = True) -> DataFrame:
    """RANK() (gaps on ties) per partition, as BIGINT; a partition that holds a
    large share of all rows is still spread over many tasks (see
    :func:`global_rank`)."""
    return global_rank(df, value, out=out, descending=descending, partition=partition)


def lag_by(df: DataFrame, partition: Sequence[str], order: str,
           cols: dict[str, str], offset: int = 1) -> DataFrame:
    """Add ``{new: lag(src, offset)}`` over one shared window (one sort)."""
    w = Window.partitionBy(*partition).orderBy(F.col(order).asc())
    for new, src in cols.items():
        df = df.withColumn(new, F.lag(src, offset).over(w))
    return df


def with_rank_movement(df: DataFrame, rank: str = "rank", prev: str = "prev_rank") -> DataFrame:
    return (df.withColumn("rank_change", rank_change_label(rank, prev))
              .withColumn("rank_diff", rank_diff(rank, prev)))


def global_rank(df: DataFrame, value: str, out: str = "rank", descending: bool = True,
                partition: Sequence[str] = ()) -> DataFrame:
    """RANK() OVER ([PARTITION BY partition] ORDER BY value) without funnelling
    a large group of rows into one task.

    rank(v) = 1 + rows of the same partition ranked strictly before v:
      1. rows are dealt to tasks by ranges of (partition, value) that Spark
         samples from them, so values in a narrow band spread like any others;
         rows of one value are ordered by a hash, so a value that a third of
         the rows holds spreads too;
      2. a running count inside a task plus one offset for each task and
         partition gives the place of a row, and the first place among its
         equals is its rank;
      3. equals may lie in several tasks, but only values at the edge of a
         task: at most one for each task, whose first places are broadcast.
    The dealt rows are written while the frame is built, so the ranges are the
    same for every later step and what comes before is computed once. NULL
    values sort last for descending and first for ascending order, and NULL
    partition keys form one partition, as in the window function.
    """
    P = list(partition)
    v = F.col(value)
    o = v.desc_nulls_last() if descending else v.asc_nulls_first()
    others = [c for c in df.columns if c not in (out, value) and not isinstance(df.schema[c].dataType, MapType)] or [value]
    rows = dealt(df.drop(out).withColumn("_tie", F.xxhash64(*others)), [*[F.asc(c) for c in P], o, F.asc("_tie")])
    placed = running_before(rows, P, F.lit(1).cast("bigint"), "_before").withColumn(
        "_first", F.min("_before").over(Window.partitionBy(PART, *P, value)))
    edges = rows.where(F.col(AT) == 0).select(*P, value).distinct()
    shared = (null_safe_join(placed, F.broadcast(edges), [*P, value], "left_semi")
              .groupBy(*P, value).agg(F.min("_before").alias("_shared")))
    ranked = null_safe_join(placed, F.broadcast(shared), [*P, value], "left")
    return ranked.withColumn(out, (F.coalesce("_shared", "_first") + 1).cast("bigint")).select(*[c for c in df.columns if c != out], out)
