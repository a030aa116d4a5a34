import random
import time
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyforge.functions.expressions import exact_median
from tallyforge.operators import economics
from tallyforge.operators.intervals import containing, containing_or_none


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    points = [(i, rng.choice("ab"), rng.choice([None, rng.randint(-5000, 5000)])) for i in range(400)]
    windows = [(i, rng.choice("ab"), s, s + rng.choice([-3, 0, 1, 2, 7, 8, 9, 100, 4096, 9000])) for i in range(120) for s in (rng.randint(-5000, 5000),)] + [(900, "a", None, 5), (901, "a", 1, None), (902, "a", -(1 << 62), 1 << 62)]
    p, w = spark.createDataFrame(points, "id int, k string, t bigint").repartition(3), spark.createDataFrame(windows, "w int, k string, s bigint, e bigint")
    want = sorted((i, j) for i, a, t in points for j, b, s, e in windows if a == b and None not in (t, s, e) and s <= t < e)
    found = containing(p, w, "t", "s", "e", ["k"])
    assert sorted((r.id, r.w) for r in found.collect()) == want
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    kept = sorted((r.id, -1 if r.w is None else r.w) for r in containing_or_none(p, w, "t", "s", "e", ["k"]).collect())
    assert kept == sorted(want + [(i, -1) for i, _, _ in points if i not in {x for x, _ in want}])


def test_types_and_empty_tables(spark):
    day = date(2020, 2, 28)
    p, w = spark.createDataFrame([(day,), (date(2020, 3, 1),), (date(1969, 12, 31),)], "t date"), spark.createDataFrame([(1, day, date(2020, 3, 1)), (2, date(1960, 1, 1), date(1970, 1, 1))], "w int, s date, e date")
    assert sorted((str(r.t), r.w) for r in containing(p, w, "t", "s", "e").collect()) == [("1969-12-31", 2), ("2020-02-28", 1)]
    now = datetime(2021, 1, 1)
    p, w = spark.createDataFrame([(now,), (now + timedelta(microseconds=1),)], "t timestamp"), spark.createDataFrame([(now, now + timedelta(microseconds=1))], "s timestamp, e timestamp")
    assert [r.t for r in containing(p, w, "t", "s", "e").collect()] == [now]
    assert containing(p, w.limit(0), "t", "s", "e").count() == 0 and containing(p.limit(0), w, "t", "s", "e").count() == 0
    with pytest.raises(TypeError):
        containing(spark.range(1).selectExpr("'a' t"), spark.range(1).selectExpr("'a' s", "'b' e"), "t", "s", "e")


def test_running_medians_and_long_series(spark):
    rng = random.Random(3)
    values = [rng.choice([0.0, 1.5, -2.0, rng.random()]) for _ in range(200)]
    by_sort = lambda x: (sorted(x)[(len(x) - 1) // 2] + sorted(x)[len(x) // 2]) / 2
    assert economics.running_medians(values) == [by_sort(values[: i + 1]) for i in range(200)]
    frame = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)], "k string, occurred_at int, value double")
    got = economics.change_points(frame, ["k"]).first().change_points
    want = [i for i in range(3, 198) for a, b in ((by_sort(values[:i]), by_sort(values[i:])),) if (b != 0 if a == 0 else abs(b - a) / abs(a) >= 0.5)]
    assert got == want
    assert spark.createDataFrame([(values,)], "v array<double>").select(exact_median(F.col("v"))).first()[0] == by_sort(values)
    long = spark.range(100_000).select(F.lit("k").alias("k"), F.col("id").alias("occurred_at"), F.when(F.col("id") < 60_000, F.rand(1)).otherwise(F.rand(2) + 5).alias("value"))
    begin = time.perf_counter()
    assert 60_000 in economics.change_points(long, ["k"]).first().change_points
    assert time.perf_counter() - begin < 60


def test_lines_are_counted_by_day_before_windows_meet_them(spark):
    from tallyforge.plans.catalog import QUERIES

    plan = QUERIES["window_containment"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan.split("Join", 1)[1]
