"""Personal records and the fact's body parts: one window, no shuffle by six ids."""

from __future__ import annotations

import datetime as dt
import random

from liftlake.operators.records import records_with_previous
from liftlake.plans import models as M

NAN = float("nan")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_measures_go_through_one_window(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["u", "v", None]), rnd.choice(["e", None]), rnd.choice([dt.date(2001, 1, d) for d in range(1, 9)] + [None]),
             rnd.choice([1.0, 2.5, 4.0, None]), rnd.choice([10.0, 20.0, None])) for _ in range(200)]
    rows += [("nothing", "e", dt.date(2001, 1, 1), None, None)]
    df = spark.createDataFrame(rows, "user string, ex string, day date, w double, v double")
    out = records_with_previous(df, ["user", "ex"], "day", {"max_w": "w", "max_v": "v"}, null_key="ex")
    assert plan(out).count("Window [") == 1
    want = set()
    for key in {r[:2] for r in rows}:
        for name, at in (("max_w", 3), ("max_v", 4)):
            own = [(r[at], r[2]) for r in rows if r[:2] == key and r[at] is not None]
            if own:
                best = max(v for v, _ in own)
                days = [d for v, d in own if v == best and d is not None]
                when = max(days) if days else None
                # a missing day comes before all others
                before = [v for v, d in own if when is not None and (d is None or d < when)]
                want.add((*key, name, best, when, max(before) if before and key[1] else None))
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert not any(r[0] == "nothing" for r in got)


def test_nan_is_the_greatest_value(spark):
    df = spark.createDataFrame([("u", dt.date(2001, 1, 1), 5.0), ("u", dt.date(2001, 1, 2), NAN), ("u", dt.date(2001, 1, 3), 7.0)],
                               "user string, day date, w double")
    (r,) = records_with_previous(df, ["user"], "day", {"max_w": "w"}).collect()
    assert r.record_value != r.record_value and r.achieved_date == dt.date(2001, 1, 2) and r.previous_value == 5.0


def test_body_parts_are_broadcast(spark):
    parts = M.d_body_part(spark)
    assert [(f.name, f.dataType.simpleString(), f.nullable) for f in parts.schema] == [
        ("body_part_id", "string", False), ("body_part_name", "string", False), ("training_day", "string", True), ("sort_order", "bigint", False)]
    assert sorted(map(tuple, parts.collect()), key=lambda r: r[3]) == M.BODY_PARTS
    raw = spark.createDataFrame([("1", "u", "Bench ", "CHEST", dt.date(2001, 1, 1), 1, 80.0, 5, 8.0, None, None, None)],
                                "log_id string, user_id string, exercise_name string, body_part string, training_date date, set_number bigint,"
                                " weight_kg double, reps bigint, rpe double, memo string, created_at timestamp_ntz, updated_at timestamp_ntz")
    ex = spark.sql("SELECT 'bench' AS exercise_id, 'bench' AS exercise_name, true AS is_compound")
    f = M.fct_training_set(M.cleanse(raw), ex, parts)
    assert "SortMergeJoin" not in plan(f) and "hashpartitioning" not in plan(f)
    assert f.first().body_part_id == "chest"
