"""Global order without a global sort in one task.

Rows are dealt to tasks by ranges of their order (Spark samples the ranges
from the data, whatever its distribution) and the dealt table is written, so
that every later step sees the same parts. A row then knows its part and its
place in it, and what a row needs from other parts is small: a count for each
part and group (positions, ranks), or the last few rows before a part (lag,
moving windows, running maxima). A group or series that holds a large share
of all rows is thus worked on by many tasks.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from liftlake.operators.joins import null_safe_join
from liftlake.operators.upsert import scratch_path

PART, AT, PLACE, BORDER = "_part", "_at", "_place", "_border"


def dealt(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``df`` in ranges of ``order``, written: ``_part`` numbers the ranges in
    order, ``_at`` the rows of a range from 0."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "ordered")
    low = (1 << 33) - 1
    out = (df.repartitionByRange(*order).sortWithinPartitions(*order)
             .withColumn(AT, F.monotonically_increasing_id())
             .withColumn(PART, F.shiftright(AT, 33).cast("int"))
             .withColumn(AT, F.col(AT).bitwiseAND(F.lit(low))))
    out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def running_before(rows: DataFrame, group: Sequence[str], weight: Column, out: str) -> DataFrame:
    """To dealt rows whose order begins with ``group``: the sum of ``weight``
    over the rows of the group before each row."""
    group = list(group)
    rows = rows.withColumn("_w", weight)
    inside = Window.partitionBy(PART, *group).orderBy(AT).rowsBetween(Window.unboundedPreceding, -1)
    # a row for each group and part; a part cuts one group at most at each end
    parts = rows.groupBy(*group, PART).agg(F.sum("_w").alias("_t"))
    earlier = Window.partitionBy(*group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*group, PART, F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_off"))
    return (null_safe_join(rows.withColumn("_in", F.coalesce(F.sum("_w").over(inside), F.lit(0))), offsets, [*group, PART])
            .withColumn(out, F.col("_off") + F.col("_in")).drop("_w", "_in", "_off"))


def positions(df: DataFrame, order: Sequence[Column], out: str = "position", group: Sequence[str] = ()) -> DataFrame:
    """``df`` with each row's place by ``order`` (from 1), or within its group."""
    rows = dealt(df, [*[F.asc(c) for c in group], *order])
    placed = running_before(rows, group, F.lit(1).cast("bigint"), "_before")
    return placed.withColumn(out, F.col("_before") + 1).drop(PART, AT, "_before")


def series_scan(df: DataFrame, series: Sequence[str], order: Sequence[Column], before: int) -> tuple[DataFrame, WindowSpec]:
    """Rows for a window over ordered series that looks back at most ``before``
    rows, and that window. A part of a series also holds copies of the
    ``before`` rows ahead of it (marked; :func:`scanned` drops them), so the
    window runs over (part, series) and a series of any length over many tasks."""
    spark = df.sparkSession
    rows = dealt(df, [*[F.asc(c) for c in series], *order])
    # one count for each part: as many as the shuffle has tasks
    counts = {r[PART]: r["n"] for r in rows.groupBy(PART).agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = [], 0
    for part in sorted(counts):
        starts.append((part, total))
        total += counts[part]
    kind = f"{PART} int, _start bigint"
    rows = rows.join(F.broadcast(spark.createDataFrame(starts, kind)), PART).withColumn(PLACE, F.col("_start") + F.col(AT)).drop("_start", AT)
    wanted = [(s - i, part) for part, s in starts for i in range(1, before + 1) if s - i >= 0]
    copies = (rows.drop(PART).join(F.broadcast(spark.createDataFrame(wanted, f"{PLACE} bigint, {PART} int")), PLACE)
              .select(*rows.columns, F.lit(True).alias(BORDER)))
    both = rows.withColumn(BORDER, F.lit(False)).unionByName(copies)
    return both, Window.partitionBy(PART, *series).orderBy(PLACE)


def scanned(df: DataFrame) -> DataFrame:
    """The rows of a :func:`series_scan` without its copies and helper columns."""
    return df.where(~F.col(BORDER)).drop(BORDER, PART, PLACE)


def running_max_before(df: DataFrame, series: Sequence[str], order: Sequence[Column], value: str, out: str) -> DataFrame:
    """The greatest ``value`` of the series before each row, over series of any
    length: the maximum inside the row's part and that of the parts before."""
    series = list(series)
    rows = dealt(df, [*[F.asc(c) for c in series], *order])
    inside = Window.partitionBy(PART, *series).orderBy(AT).rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*series, PART).agg(F.max(value).alias("_m"))
    earlier = Window.partitionBy(*series).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(*series, PART, F.max("_m").over(earlier).alias("_carried"))
    return (null_safe_join(rows.withColumn("_in", F.max(value).over(inside)), carried, [*series, PART])
            .withColumn(out, F.greatest("_in", "_carried")).drop("_in", "_carried", PART, AT))
