import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from tallyforge.llm.quality import Extractor, dual_coordinate_descent, fit, held_out, sample_labels, score, train

GOOD = "The quiet reader was here and then went on to the other side of it."
BAD = "BUY!! NOW!! CHEAP!! CHEAP!! %%% ###"


def test_extractor_indicators():
    extract = Extractor()
    one, two = extract.columns("aa bb aa"), extract.columns("aa bb aa bb aa")
    assert extract.columns("").tolist() == [0] and one[0] == 0
    assert set(one) <= set(two)
    assert extract.columns("x y").tolist() != extract.columns("x x").tolist() != extract.columns("x").tolist()
    assert Extractor().columns(BAD).tolist() == extract.columns(BAD).tolist()


def test_every_character_counts():
    """Words beyond any length, and texts without white space, differ by their last character."""
    extract = Extractor()
    for size in (40, 63, 70, 10_000):
        one, two = extract.columns("x" * size + "a"), extract.columns("x" * size + "b")
        assert one.tolist() != two.tolist()
    long = "".join(chr(0x4E00 + i * 7 % 5000) for i in range(5_000))
    one, two = set(extract.columns(long)), set(extract.columns(long[:2_000] + "!" + long[2_001:]))
    # Windows that the change doesn't touch are shared.
    assert 0 < len(one - two) < 12 < len(one & two)


def test_scores_equal_plain_arithmetic():
    """An independent scorer from the definition: indicators times ratios over their length, times weights."""
    extract = Extractor(12)
    texts = [GOOD + f" w{i}" if i % 2 else BAD + f" w{i}" for i in range(60)]
    rows, labels = [extract.columns(t) for t in texts], np.arange(60) % 2
    model = fit(rows, labels, 12)
    with_column = lambda c, y: sum(1 for r, z in zip(rows, labels) if z == y and c in set(r.tolist()))
    counts = {c: [with_column(c, y) + 1 for y in (0, 1)] for c in range(1 << 12)}
    totals = [sum(v[y] for v in counts.values()) for y in (0, 1)]
    ratio = lambda c: math.log(counts[c][1] / totals[1]) - math.log(counts[c][0] / totals[0]) if c else 1.0
    for row in rows[:6]:
        values = [ratio(c) for c in row.tolist()]
        length = math.sqrt(sum(v * v for v in values))
        decision = sum(v / length * model.weights[c] for c, v in zip(row.tolist(), values))
        assert math.isclose(model.score(row), 1 / (1 + math.exp(model.slope * decision + model.offset)), rel_tol=1e-9)


def test_dual_solution_meets_its_conditions():
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(40, 6, replace=False)) for _ in range(120)]
    labels = np.array([int(x.sum() > 117) for x in rows])
    values = [np.full(6, 6**-0.5) for _ in rows]
    w = dual_coordinate_descent(rows, values, labels, 40, cost=1.0, rounds=400)
    primal = lambda v: 0.5 * v @ v + sum(max(0.0, 1 - (2 * y - 1) * v[r] @ x) for r, x, y in zip(rows, values, labels))
    best = primal(w)
    assert all(primal(w + 0.05 * rng.standard_normal(40)) >= best - 1e-3 for _ in range(200))


def test_fit_of_one_class_and_none():
    x = [Extractor().columns(GOOD)] * 3
    assert fit(x, np.array([1, 1, 1])).score(x[0]) > 0.99
    assert fit([], np.array([], dtype=int)).score(np.array([0])) == 0.5


def test_frame(spark):
    rows = [(i, (GOOD if i % 2 else BAD) + f" w{i}") for i in range(200)] + [(300, None), (301, ""), (None, GOOD), (7, GOOD)]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id bigint, text string, quality int")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(None, 1, 0), (5, None, 1), (6, 0, 0)], "doc_id bigint, quality int, toxic int")
    got = {(r.doc_id, r.score) for r in score(docs, train(docs, labels)).collect()}
    assert len(got) == len(rows)
    assert all(0 <= s <= 1 and (s > 0.5) == bool(i % 2) for i, s in got if i is not None and i < 200)
    assert sample_labels(labels, 10).count() < 40
    assert score(docs.limit(0), train(docs, labels)).count() == 0
    assert train(docs.limit(0), labels).score(np.array([0])) == 0.5
    marks = docs.where("doc_id < 200").select("doc_id", held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in marks)
