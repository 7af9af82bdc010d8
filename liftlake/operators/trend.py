"""Time-series operators over per-key ordered rows.

Series of daily or period values are as long as the calendar at most, so they
take one window partition each; with ``long_series``, and always for series of
raw rows, the series are scanned in parts (see :mod:`ordered`)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from liftlake.functions.exprs import days_between, safe_divide
from liftlake.operators.ordered import scanned, series_scan


def moving_average_rows(df: DataFrame, partition: Sequence[str], order: str, value: str,
                        out: str, rows: int = 7, long_series: bool = False) -> DataFrame:
    """AVG over the current and ``rows - 1`` preceding *rows* (not days)."""
    if long_series:
        df, w = series_scan(df, partition, [F.col(order).asc()], rows - 1)
        return scanned(df.withColumn(out, F.avg(value).over(w.rowsBetween(-(rows - 1), 0))))
    w = Window.partitionBy(*partition).orderBy(F.col(order).asc()).rowsBetween(-(rows - 1), 0)
    return df.withColumn(out, F.avg(value).over(w))


def moving_average_days(df: DataFrame, partition: Sequence[str], order: str, value: str,
                        out: str, days: int = 7) -> DataFrame:
    """Calendar variant: AVG over the rows of the last ``days`` days."""
    day_no = F.datediff(F.col(order), F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy(*partition).orderBy(day_no).rangeBetween(-(days - 1), 0)
    return df.withColumn(out, F.avg(value).over(w))


def change_vs_lag(df: DataFrame, partition: Sequence[str], order: str, value: str,
                  out: str, offset: int = 7, digits: int = 2, long_series: bool = False) -> DataFrame:
    """ROUND(SAFE_DIVIDE(v - LAG(v, k), LAG(v, k)) * 100, digits)."""
    if long_series:
        df, w = series_scan(df, partition, [F.col(order).asc()], offset)
    else:
        w = Window.partitionBy(*partition).orderBy(F.col(order).asc())
    prev = F.lag(value, offset).over(w)
    df = df.withColumn(out, F.round(safe_divide(F.col(value) - prev, prev) * 100, digits))
    return scanned(df) if long_series else df


def session_pairs(df: DataFrame, partition: Sequence[str], order: Sequence, cols: Sequence[str],
                  date_col: str = "training_date", prefix: str = "prev_",
                  gap_col: str = "days_since_last") -> DataFrame:
    """Previous row's ``cols`` (as ``prev_*``) and the day gap to it. Raw rows
    have no bound on a series (a user's unknown exercises are one), so parts of
    series are scanned, each with the one row ahead of it."""
    df, w = series_scan(df, partition, order, 1)
    for c in cols:
        df = df.withColumn(prefix + c, F.lag(c).over(w))
    return scanned(df.withColumn(gap_col, days_between(F.col(date_col), F.lag(date_col).over(w))))
