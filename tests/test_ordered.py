"""Ranks and series scans over parts: equal to plain windows, and spread."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from liftlake.operators import ordered
from liftlake.operators.rank import global_rank
from liftlake.operators.trend import change_vs_lag, moving_average_rows, session_pairs


@pytest.fixture(scope="module")
def hot(spark):
    """A series with most rows, small ones, and one without a key."""
    return spark.range(6000).select(
        F.when(F.col("id") % 3 != 0, F.lit("hot")).when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("s"), F.col("id") % 40)).alias("s"),
        F.col("id").alias("t"), (F.xxhash64("id") % 1000).cast("double").alias("v"),
        F.date_add(F.lit("2001-01-01").cast("date"), (F.col("id") / 10).cast("int")).alias("training_date")).repartition(7)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(autouse=True)
def many_parts(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_lag_and_moving_average_over_parts(spark, hot):
    for f in (lambda long: moving_average_rows(hot, ["s"], "t", "v", "ma", rows=7, long_series=long),
              lambda long: change_vs_lag(hot, ["s"], "t", "v", "chg", offset=7, long_series=long)):
        assert rows(f(True)) == rows(f(False))


def test_parts_shorter_than_the_window(spark):
    """Borders reach back over several parts."""
    few = spark.range(14).select(F.lit("a").alias("s"), F.col("id").alias("t"), F.col("id").cast("double").alias("v"))
    assert rows(moving_average_rows(few, ["s"], "t", "v", "ma", rows=5, long_series=True)) == rows(
        moving_average_rows(few, ["s"], "t", "v", "ma", rows=5))


def test_session_pairs_spread_a_hot_series(spark, hot):
    got = session_pairs(hot, ["s"], [F.col("t").asc()], ["v"])
    w = Window.partitionBy("s").orderBy("t")
    want = hot.withColumn("prev_v", F.lag("v").over(w)).withColumn(
        "days_since_last", F.datediff("training_date", F.lag("training_date").over(w)))
    assert rows(got.select(*want.columns)) == rows(want)
    dealt, _ = ordered.series_scan(hot, ["s"], [F.col("t").asc()], 1)
    largest = dealt.where("s = 'hot' and not _border").groupBy("_part").count().agg(F.max("count")).first()[0]
    assert largest <= 4000 / 6                      # the hot series lies in many tasks


def test_running_max_over_parts(spark, hot):
    w = Window.partitionBy("s").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    got = ordered.running_max_before(hot, ["s"], [F.col("t").asc()], "v", "top")
    assert rows(got) == rows(hot.withColumn("top", F.max("v").over(w)))


def test_positions(spark, hot):
    got = {r.t: r.position for r in ordered.positions(hot, [F.col("v").desc(), F.col("t").asc()]).collect()}
    order = sorted(hot.collect(), key=lambda r: (-r.v, r.t))
    assert got == {r.t: i for i, r in enumerate(order, 1)}
    assert ordered.positions(hot.limit(0), [F.col("t").asc()]).count() == 0


@pytest.mark.parametrize("value", ["1000000 + id", "1 + id / 1e9", "id / 2e6", "if(id % 3 = 0, 0, id)", "if(id = 5, 1e15, id / 1e7)"])
def test_rank_of_narrow_bands(spark, value):
    """Whatever band the values lie in, they spread over all tasks, and a value
    that a third of the rows holds is ranked like any other."""
    df = spark.range(20000).select("id", F.expr(f"cast({value} as double)").alias("v"))
    want = df.withColumn("rank", F.rank().over(Window.orderBy(F.desc("v"))).cast("bigint"))
    assert rows(global_rank(df, "v")) == rows(want)
    parts = ordered.dealt(df.groupBy("v").count(), [F.desc("v")]).groupBy("_part").count()
    sizes = [r["count"] for r in parts.collect()]
    assert len(sizes) >= 10 and max(sizes) <= 2.5 * sum(sizes) / 12


def test_rank_with_helper_names_and_maps(spark):
    df = spark.createDataFrame([(1, 5.0, {"a": 1}, 9), (2, 5.0, {}, 9), (3, None, None, 9), (4, 7.0, {"b": 2}, 9)], "id long, v double, m map<string,int>, rank long")
    assert {r.id: r["rank"] for r in global_rank(df, "v").collect()} == {4: 1, 1: 2, 2: 2, 3: 4}
