"""What the shared steps shuffle, and their rows."""

import datetime as dt

from pyspark.sql import functions as F

from liftlake.operators.latest import latest_by_key
from liftlake.sources import fixtures as FX


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_latest_reads_needed_columns(spark):
    df = spark.createDataFrame([("a", 1, "x", "wide"), ("a", 2, None, "w"), (None, None, "n", "w"), (None, 3, "m", "w")],
                               "k string, t int, v string, unread string")
    df = df.withColumn("v", F.upper("v"))
    got = latest_by_key(df, ["k"], ["t", F.col("v")])
    assert {(r.k, r.t, r.v) for r in got.collect()} == {("a", 2, None), (None, 3, "M")}
    text = plan(got.select("k", "v"))
    above = [line for line in text.splitlines() if "RDD" not in line and "LocalRelation" not in line]
    assert "WindowGroupLimit" in text and not any("unread" in line for line in above)


def test_documents_group_numbers_and_times(spark, tmp_path):
    """Texts of sets are made after the groups, in the order of their ids."""
    day = dt.datetime(2001, 5, 1)
    lines = [(order, 1, 7, 1, 10.0, 100.0, 0.04, 0.02, flag, "O", day) for order, flag in ((9, "N"), (10, "R"), (None, None))]
    for name, rows in (("lineitem", lines), ("orders", [(9, 1, "O", 1.0, day, "x"), (10, 1, "O", 1.0, None, "x")]),
                       ("part", [(1, "Red Widget", "b", "PROMO", 1, 1.0)])):
        spark.createDataFrame(rows, FX.DRIVER_SCHEMAS[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = FX.documents(spark, str(tmp_path))
    (d,) = docs.collect()
    assert (d.doc_id, d.user_id, d.set_count, d.body_part_id) == ("user_7_2001-05-01_red_widget", "user_7", 2, "back")
    assert [tuple(s) for s in d.sets] == [
        ("10-1", 1, 25.0, 5, 6.5, None, True, None, "2001-05-01T00:00:00"),
        ("9-1", 1, 25.0, 5, 6.5, None, False, "2001-05-01T00:00:00", "2001-05-01T00:00:00")]
    text = plan(docs)
    assert "date_format" not in text[text.index("Project", text.index("Aggregate")):]
