"""Property tests: rewritten operators equal their naive definitions."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from liftlake.operators.latest import latest_by_key
from liftlake.operators.quota import gate, limit_for, should_send
from liftlake.operators.rank import global_rank
from liftlake.operators.records import records_with_previous
from liftlake.operators.upsert import merge_upsert
from liftlake.plans.notify import daily_plan

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))

versions = st.lists(st.tuples(st.integers(0, 5), st.integers(0, 3), st.booleans(), st.integers(0, 9)),
                    min_size=1, max_size=30)


@SETTINGS
@given(rows=versions, parts=st.integers(1, 5))
def test_dedup_independent_of_order_and_partitioning(spark, rows, parts):
    df = spark.createDataFrame(rows, "k int, t int, deleted boolean, v int")
    order = [F.col("t"), F.col("deleted").cast("int"), F.col("v")]
    a = sorted(latest_by_key(df, ["k"], order).collect())
    b = sorted(latest_by_key(df.repartition(parts).orderBy(F.rand(3)), ["k"], order).collect())
    expect = {}
    for k, t, d, v in rows:
        if k not in expect or (t, int(d), v) > (expect[k][1], int(expect[k][2]), expect[k][3]):
            expect[k] = (k, t, d, v)
    assert a == b == sorted(tuple(x) for x in [tuple(e) for e in expect.values()])


@SETTINGS
@given(vals=st.lists(st.one_of(st.none(), st.integers(0, 6)), min_size=1, max_size=40), parts=st.integers(1, 6))
def test_global_rank_equals_window_rank(spark, vals, parts):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id int, v int")
    mine = {r.id: r.rank for r in global_rank(df.repartition(parts), "v").collect()}
    # values far apart, of both signs, in the outermost cells
    far = F.col("v").cast("double") * 1e7 - 2.5e7
    wide = df.withColumn("v", F.when(F.col("v") == 6, float("inf")).when(F.col("v") == 5, float("nan")).otherwise(far))
    big = {r.id: r.rank for r in global_rank(wide, "v").collect()}
    ref_big = {r.id: r.rank for r in wide.withColumn("rank", F.rank().over(Window.orderBy(F.col("v").desc()))).collect()}
    assert big == ref_big
    ref = {r.id: r.rank for r in df.withColumn("rank", F.rank().over(Window.orderBy(F.col("v").desc()))).collect()}
    assert mine == ref
    asc = {r.id: r.rank for r in global_rank(df, "v", descending=False).collect()}
    ref_asc = {r.id: r.rank for r in df.withColumn("rank", F.rank().over(Window.orderBy(F.col("v").asc()))).collect()}
    assert asc == ref_asc


def _loop_plan(base, n3, n7):
    """The original one-at-a-time loop (every delivery succeeds)."""
    out, count = [], base
    if not should_send(count, "3day"):
        return out
    for i in range(n3):
        if should_send(count, "3day"):
            out.append(("3day", i, "sent"))
            count += 1
        else:
            out.append(("3day", i, "suppressed"))
    if should_send(count, "7day"):
        for j in range(n7):
            if should_send(count, "7day"):
                out.append(("7day", j, "sent"))
                count += 1
            else:
                out.append(("7day", j, "suppressed"))
    return out


def test_quota_plan_equals_loop(spark):
    for base in (0, 150, 179, 180, 185, 189, 190, 199, 200):
        for n3, n7 in ((0, 0), (5, 30), (15, 3), (40, 40)):
            three = spark.createDataFrame([(f"u{i:03d}", 3) for i in range(n3)],
                                          "user_id string, days_since_last_any int")
            seven = spark.createDataFrame([(f"u{j:03d}", "胸", dt.date(2025, 1, 1)) for j in range(n7)],
                                          "user_id string, body_part_name string, last_training_date date")
            plan = daily_plan(three, seven, base).collect()
            got = sorted((r.notification_type, int(r.user_id[1:]), r.status) for r in plan)
            assert got == sorted(_loop_plan(base, n3, n7)), (base, n3, n7)


def test_gate_positions(spark):
    c = spark.createDataFrame([(f"u{i}",) for i in range(7)], "user_id string")
    g = {r.user_id: (r.status, r.position) for r in gate(c, [F.col("user_id")], 3, "weekly_ranking", ["user_id"]).collect()}
    assert g["u0"] == ("sent", 1) and g["u2"] == ("sent", 3) and g["u3"] == ("suppressed", None)
    assert limit_for("weekly_ranking") == 200 and limit_for("7day") == 180


@SETTINGS
@given(target=st.dictionaries(st.integers(0, 9), st.integers(0, 99), max_size=8),
       source=st.dictionaries(st.integers(0, 9), st.integers(0, 99), max_size=8))
def test_upsert_idempotent_and_correct(spark, target, source):
    t = spark.createDataFrame(list(target.items()) or [], "k int, v int")
    s = spark.createDataFrame(list(source.items()) or [], "k int, v int")
    once = merge_upsert(t, s, ["k"])
    twice = merge_upsert(once, s, ["k"])
    expect = dict(target)
    expect.update(source)
    assert dict(once.collect()) == expect == dict(twice.collect())


@SETTINGS
@given(rows=st.lists(st.tuples(st.integers(0, 2), st.integers(0, 6), st.integers(0, 20)), min_size=1, max_size=30))
def test_records_equal_naive_correlated_subquery(spark, rows):
    base = dt.date(2025, 1, 1)
    data = [(k, base + dt.timedelta(days=d), float(v)) for k, d, v in rows]
    df = spark.createDataFrame(data, "k int, d date, v double")
    got = {(r.k, r.record_type): (r.record_value, r.achieved_date, r.previous_value)
           for r in records_with_previous(df, ["k"], "d", {"best": "v"}).collect()}
    expect = {}
    for k in {r[0] for r in data}:
        mine = [r for r in data if r[0] == k]
        best = max(r[2] for r in mine)
        ach = max(r[1] for r in mine if r[2] == best)
        prev = [r[2] for r in mine if r[1] < ach]
        expect[(k, "best")] = (best, ach, max(prev) if prev else None)
    assert got == expect


@SETTINGS
@given(rows=st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 2)), st.one_of(st.none(), st.integers(0, 5))),
                     min_size=1, max_size=40),
       parts=st.integers(1, 5), desc=st.booleans())
def test_partitioned_range_rank_equals_window(spark, rows, parts, desc):
    from liftlake.operators.rank import rank_in_partition
    df = spark.createDataFrame([(i, p, v) for i, (p, v) in enumerate(rows)], "id int, p int, v int")
    mine = {r.id: r.rank for r in rank_in_partition(df.repartition(parts), ["p"], "v", descending=desc).collect()}
    o = F.col("v").desc() if desc else F.col("v").asc()
    ref = {r.id: r.rank for r in df.withColumn("rank", F.rank().over(Window.partitionBy("p").orderBy(o))).collect()}
    assert mine == ref
