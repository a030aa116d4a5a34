"""Rules and repeats found by hashes in one pass: as by the rows themselves."""

from pyspark.sql import functions as F

from tallyforge.operators import invariants


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def plan(found):
    return found._jdf.queryExecution().executedPlan().toString()


def test_rules_and_repeats_in_one_pass(spark):
    rules = {"positive": F.col("v") > 0, "small": F.col("v") < 10}
    rows = frame(spark, [("a", 1), ("b", 2), ("b", 20), ("c", None), ("d", 3), (None, 4), (None, 5)], "k string, v int")
    found = sorted(map(str, invariants.violated(rows, "k", rules).collect()))
    assert found == sorted(map(str, invariants.broken(rows, "k", rules).unionByName(invariants.repeated(rows, "k")).collect())) and len(found) == 5
    right = rows.where("v < 4 and v <> 20")
    assert invariants.violated(right, "k", rules).count() == 0 and "Exchange hashpartitioning" not in plan(invariants.broken(right, "k", rules))
    known = frame(spark, [("a",)], "k string")
    assert sorted(map(tuple, invariants.orphans(rows.na.drop(), "k", known, "k").collect())) == [("known_k", "b"), ("known_k", "d")]
    # An orphan that comes often is looked up once.
    assert plan(invariants.orphans(rows, "k", known, "k")).index("Join") < plan(invariants.orphans(rows, "k", known, "k")).index("HashAggregate")
