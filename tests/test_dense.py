"""Dense search by blocks of matrices against plain expressions over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tallyforge.functions.expressions import dot, prefix_vector
from tallyforge.operators import retrieval


def plain(rows, queries, size, k):
    found = rows.select("candidate_id", prefix_vector(F.col("embedding"), size).alias("v")).join(queries.select("query_id", prefix_vector(F.col("embedding"), size).alias("q")))
    found = found.where("query_id <> candidate_id").withColumn("score", F.round(dot(F.col("v"), F.col("q")), 6)).where("score is not null")
    return {(r.query_id, r.candidate_id, str(r.score), r["rank"]) for r in retrieval.ranked(found, k, ["query_id"]).collect()}


@pytest.mark.parametrize("many_blocks", [False, True])
def test_against_all_pairs(spark, monkeypatch, many_blocks):
    rng = random.Random(5)
    vector = lambda: [rng.choice([-1.0, 0.0, 0.5, 1.0, rng.random()]) for _ in range(8)]
    same = vector()
    values = [same if i % 3 == 0 else vector() for i in range(180)] + [None, [], [0.0] * 8, [1.0, None, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0], [1.0, 2.0, 3.0, 4.0], [float("nan")] * 8, [1e200] * 8]
    rows = spark.createDataFrame(list(enumerate(values)), "candidate_id bigint, embedding array<double>")
    queries = rows.where("candidate_id % 5 = 0").withColumnRenamed("candidate_id", "query_id")
    monkeypatch.setattr(retrieval, "VECTORS", 16)
    monkeypatch.setattr(retrieval, "QUERIES", 7)
    if many_blocks:
        monkeypatch.setattr(retrieval, "BLOCK_BYTES", 1500)
    got = retrieval.dense_by_size(queries, rows, (4, 8), 6).collect()
    for size in (4, 8):
        assert {(r.query_id, r.candidate_id, str(r.score), r["rank"]) for r in got if r.size == size} == plain(rows, queries, size, 6)


def test_all_pairs_are_no_rows(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(40)], "candidate_id bigint, embedding array<double>")
    plan = retrieval.dense_candidates(rows.withColumnRenamed("candidate_id", "query_id"), rows, 2, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan
