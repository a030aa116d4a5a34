import statistics
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tallyforge.operators import medians

CENTS = st.decimals(min_value=Decimal("-99999"), max_value=Decimal("99999"), places=2)


def by_key(rows):
    groups = {}
    for key, value in rows:
        if value is not None:
            groups.setdefault(key, []).append(value)
    return groups


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.none() | CENTS | st.just(Decimal("1.00"))), min_size=1, max_size=60))
def test_deviations_equal_sorted_decimals(spark, rows):
    frame = spark.createDataFrame(rows, "k string, x decimal(18,2)")
    got = {r.k: (r.total, r.median, r.deviation) for r in medians.deviations(frame, ["k"], "x", bins=3, most=2).collect()}
    want = {}
    for key, values in by_key(rows).items():
        middle = statistics.median(values)
        want[key] = (len(values), middle, statistics.median([abs(x - middle) for x in values]))
    assert got == want


def test_narrowing_of_a_hot_group(spark):
    """A third of all rows in one group, most of them at one value, one value far off: equal to sorting, whatever the limits."""
    rows = [("hot", Decimal(i * i % 9973) / 100) for i in range(3000)] + [("hot", Decimal("7.77"))] * 500 + [("hot", Decimal("99999999999.99"))] + [(f"k{i % 50}", Decimal(i) / 4) for i in range(700)]
    frame = spark.createDataFrame(rows, "k string, x decimal(18,2)")
    groups = {k: sorted(v) for k, v in by_key([(k, x.quantize(Decimal("0.01"))) for k, x in rows]).items()}
    for limits in ({"bins": 4, "most": 5}, {"bins": 1024, "most": 100}, {}):
        got = {r.k: r["median"] for r in medians.medians(frame, ["k"], "x", **limits).collect()}
        assert got == {k: statistics.median(v) for k, v in groups.items()}
        ranks = {r.k: (r.p50, r.p95) for r in medians.nearest_ranks(frame, ["k"], "x", {"p50": "0.5", "p95": "0.95"}, **limits).collect()}
        assert ranks == {k: (v[-(-len(v) // 2) - 1], v[-(-len(v) * 95 // 100) - 1]) for k, v in groups.items()}


def test_values_that_doubles_cannot_tell_apart(spark):
    low = Decimal("123456789012345678901234.00")
    frame = spark.createDataFrame([(low + i,) for i in range(9)], "x decimal(38,2)")
    assert medians.medians(frame, [], "x", bins=2, most=2).first()["median"] == low + 4


def test_doubles_infinity_and_nothing(spark):
    inf = float("inf")
    frame = spark.createDataFrame([(1, x) for x in (inf, -inf, 1.0, 2.0, float("nan"), None, 5.0)] + [(2, None)], "k int, x double")
    assert [tuple(r) for r in medians.medians(frame, ["k"], "x", bins=2, most=1).collect()] == [(1, 5, 2.0)]
    assert medians.medians(frame.limit(0), ["k"], "x").count() == 0


def test_outliers(spark):
    rows = [(1, "a", Decimal(x)) for x in ("10", "11", "12", "13", "14", "90", "90")] + [(2, "b", Decimal("1"))] * 5 + [(2, "b", Decimal("9"))]
    frame = spark.createDataFrame(rows, "k int, median_name string, x decimal(18,2)")
    got = medians.outliers(frame, ["k"], "x").collect()
    assert [(r.k, r.x, r["median"], r.deviation) for r in got] == [(1, Decimal("90.00"), Decimal("13.000"), Decimal("2.0000"))] * 2


def test_no_list_in_the_plan(spark):
    frame = spark.createDataFrame([(1, Decimal("1"))], "k int, x decimal(18,2)")
    plan = medians.deviations(frame, ["k"], "x")._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("shares", [{"a": "0.01"}, {"a": "1"}])
def test_ends_of_ranks(spark, shares):
    frame = spark.createDataFrame([(float(x),) for x in (3, 1, 2)], "x double")
    assert medians.nearest_ranks(frame, [], "x", shares).first()["a"] == (1.0 if shares["a"] == "0.01" else 3.0)
