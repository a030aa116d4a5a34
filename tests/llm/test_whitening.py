import math
from fractions import Fraction

import numpy as np
import pytest

from tallyforge.llm import whitening
from tallyforge.llm.whitening import _limbs, clean, fit, identity_error, op13_whitening, scatter, transform

SCHEMA = "vec_id bigint, embedding array<double>, component string, whitened int"


def integers(rows):
    return [[math.floor(Fraction(c) * 1024) + 100_000 for c in row] for row in rows]


def exact_scatter(rows):
    """n * X'X - S S' by sums over all rows in Python's integers."""
    x, n = integers(rows), len(rows)
    d = len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    return [[n * sum(r[i] * r[j] for r in x) - sums[i] * sums[j] for j in range(d)] for i in range(d)], sums


def frame(spark, rows, ids=None):
    return spark.createDataFrame([(k if ids is None else ids[k], r, "clash", 1) for k, r in enumerate(rows)], SCHEMA).repartition(3)


@pytest.mark.parametrize("kind", ["near", "far", "huge", "mixed"])
def test_scatter_is_exact(spark, kind):
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(200, 5)) * {"near": 0.1, "far": 1e-3, "huge": 1e40, "mixed": 1.0}[kind]
    rows = rows + {"far": 6e4, "near": 0, "huge": 0, "mixed": 0}[kind]
    if kind == "mixed":
        rows[7] = 1e300
    rows = rows.tolist()
    want, sums = exact_scatter(rows)
    for shift in (0, 100_000, -7, 1 << 40):
        n, got_sums, got = scatter(clean(frame(spark, rows)), shift)
        assert (n, got) == (200, want)
        assert got_sums == [s - 200 * shift for s in sums]


def test_limbs_hold_any_number():
    for value in (0, 1, -1, 1 << 31, (1 << 32) - 1, -(1 << 32), 10**40, -(10**40), (1 << 62) - 1, -(1 << 62)):
        assert sum(v << 32 * place for place, v in _limbs(value)) == value
        assert all(-(1 << 31) <= v < 1 << 32 for _, v in _limbs(value))


@pytest.mark.parametrize("scale", [0.1, 3e4, 1e7])
def test_values_against_brute_force(spark, scale):
    rng = np.random.default_rng(5)
    rows = (rng.normal(size=(150, 12)) @ rng.normal(size=(12, 12)) * scale).tolist()
    want, sums = exact_scatter(rows)
    n, x = len(rows), integers(rows)
    held = clean(frame(spark, rows))
    model = fit(held)
    covariance = np.array([[float(Fraction(v, n * n)) for v in row] for row in want])
    values, vectors = np.linalg.eigh(covariance)
    assert np.allclose(model.variances, values[::-1][:8], rtol=1e-12)
    assert np.allclose(model.explained, values[::-1][:8] / values.sum(), rtol=1e-12)
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(r, sums, strict=True)] for r in x])
    found = transform(held, model)
    got = {r.vec_id: r for r in found.collect()}
    for k in range(n):
        assert got[k].deviation == sum((n * a - s) ** 2 for a, s in zip(x[k], sums, strict=True))
        for c in range(8):
            expect = centred[k] @ vectors[:, -1 - c] / math.sqrt(values[-1 - c])
            assert abs(abs(got[k].whitened[c]) - abs(expect)) < 1e-8
    # A whitening's covariance is the identity, measured on its rows.
    white = np.array([got[k].whitened for k in range(n)])
    assert np.abs(np.cov(white.T, bias=True) - np.eye(8)).max() < 1e-9
    assert identity_error(found, model) < 1e-9


def test_any_partitioning_gives_the_same(spark):
    rows = np.random.default_rng(1).normal(size=(300, 6)).tolist()
    models = [fit(clean(frame(spark, rows).repartition(k))) for k in (1, 7)]
    assert models[0].sums == models[1].sums and np.array_equal(models[0].components, models[1].components)


def test_deviation_by_halves_and_by_integers(spark):
    """A far shift makes the same rows go by Python's integers."""
    rows = (np.random.default_rng(2).normal(size=(80, 4)) * 1e4).tolist()
    held = clean(frame(spark, rows))
    near, far = fit(held), fit(held, shift=1 << 50)
    assert {r.vec_id: r.deviation for r in transform(held, near).collect()} == {r.vec_id: r.deviation for r in transform(held, far).collect()}


def test_greatest_doubles(spark):
    rows = (np.random.default_rng(4).normal(size=(30, 3)) * 1e307).tolist()
    held = clean(frame(spark, [*rows, [1.0, 2.0, 3.0]]))
    model = fit(held)
    found = transform(held, model)
    assert identity_error(found, model) < 1e-9
    assert {r.deviation for r in found.collect()} == {None}


def test_rows_that_do_not_count(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0], [2.0, 1.0], [2.0, 1.0], [0.5, 9.0]]
    rows = [*good, None, [1.0, None], [nan, 1.0], [inf, 0.0], [-inf, 0.0], [1.0], [], [1.0, 2.0, 3.0]]
    ids = [1, 2, 2, None, *range(10, 18)]
    held = clean(frame(spark, rows, ids))
    assert sorted(str(r.vec_id) for r in held.collect()) == ["1", "2", "2", "None"]
    model = fit(held)
    assert model.n == 4 and len(model.variances) == 2
    assert transform(held, model).count() == 4


def test_without_variance(spark):
    for rows in ([[3.0, 4.0]], [[3.0, 4.0]] * 5):
        held = clean(frame(spark, rows))
        model = fit(held)
        found = transform(held, model)
        assert {(r.deviation, tuple(r.whitened)) for r in found.collect()} == {(0, (0.0, 0.0))}
        assert model.explained.tolist() == [0.0, 0.0] and identity_error(found, model) == 0.0
    line = clean(frame(spark, [[float(k), 2.0 * k, 0.0] for k in range(9)]))
    model = fit(line)
    assert (model.variances > 0).tolist() == [True, False, False]
    assert identity_error(transform(line, model), model) < 1e-12


def test_empty_tables(spark, tmp_path):
    for rows in ([], [None], [[]]):
        held = clean(frame(spark, rows).coalesce(1) if rows else spark.createDataFrame([], SCHEMA))
        model = fit(held)
        assert transform(held, model).selectExpr("posexplode(whitened)").count() == 0
        spark.createDataFrame([(1, r) for r in rows], "vec_id bigint, embedding array<float>").write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
        assert op13_whitening(spark, str(tmp_path)).count() == 0


def test_query(spark):
    got = op13_whitening(spark, "/root/testdata/sf0.001")
    assert got.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    rows, n = got.collect(), spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    assert len(rows) == 8 * n and {r.component for r in rows} == set(range(1, 9))
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9
    white = np.zeros((n, 8))
    place = {v: k for k, v in enumerate(sorted({r.vec_id for r in rows}))}
    for r in rows:
        white[place[r.vec_id], r.component - 1] = r.whitened
    assert np.abs(white.T @ white / n - np.eye(8)).max() < 1e-9
