"""Latest version per key.

The log is append-only: one logical row has many physical versions. The
latest one is chosen with a *total* order so the result never depends on
partitioning or input order.

Implementation: the first row of a window by the order, newest first.
Catalyst turns the ``= 1`` filter into a WindowGroupLimit that also runs before
the shuffle, so a hot key (one key holding a large share of all versions) costs
one row per map task; columns that a query does not read are neither sorted nor
shuffled, and those that order the versions are shuffled once. By a single term,
which costs little twice, versions are combined by one ``max_by`` instead.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftlake.functions.exprs import col_of


def latest_by_key(df: DataFrame, keys: Sequence[str], order: Sequence,
                  where: Column | None = None) -> DataFrame:
    """One row per ``keys``: the row with the greatest ``order`` tuple (all
    terms mean "larger wins"; :func:`latest_by_window` takes mixed orders).

    ``where`` is applied *before* de-duplication (the staging semantics in
    which a deleted latest version lets an older live version through).
    """
    if where is not None:
        df = df.where(where)
    rest = [c for c in df.columns if c not in keys]
    if len(order) == 1 and rest:
        row = F.max_by(F.struct(*rest), F.struct(col_of(order[0]).alias("_o"))).alias("_row")
        return df.groupBy(*keys).agg(row).select(*keys, "_row.*").select(*df.columns)
    # as in a comparison of structs, a missing value is less than any other
    newest = [col_of(c).desc_nulls_last() for c in order]
    return latest_by_window(df, keys, newest)


def latest_active_by_key(df: DataFrame, keys: Sequence[str], order: Sequence,
                         deleted_col: str = "is_deleted") -> DataFrame:
    """De-duplicate first, then drop keys whose latest version is deleted."""
    latest = latest_by_key(df, keys, order)
    return latest.where(~F.coalesce(F.col(deleted_col), F.lit(False)))


def latest_by_window(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                     n: int = 1, rank_col: str | None = None) -> DataFrame:
    """Top-``n`` rows per key by a row_number window (mixed sort directions).
    Catalyst turns the ``<= n`` filter into a WindowGroupLimit that also runs
    before the shuffle."""
    from pyspark.sql import Window
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    if rank_col:
        return out.withColumnRenamed("_rn", rank_col)
    return out.drop("_rn")


# Business columns of a log version after (updated_at, is_deleted); used to
# make the version order total when no source tie-break keys are present.
LOG_BUSINESS_COLUMNS = ("user_id", "exercise_name", "body_part", "training_date", "set_number",
                        "weight_kg", "reps", "rpe", "memo", "input_source", "created_at")


# Version order of the training log: newest update first; on equal update
# times a deletion wins over the live row; then the given tie-break keys and
# finally the remaining business columns make the order total.
def training_log_order(extra: Sequence[str] = (),
                       columns: Sequence[str] = LOG_BUSINESS_COLUMNS) -> list:
    order = [F.col("updated_at"), F.col("is_deleted").cast("int")] + [F.col(c) for c in extra]
    return order + [F.col(c) for c in LOG_BUSINESS_COLUMNS if c in columns and c not in extra]
