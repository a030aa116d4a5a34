import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyforge.llm.hmm import Model, expected_counts, log_likelihoods, score

RNG = np.random.default_rng(2)
MODEL = Model(RNG.dirichlet(np.ones(3)), RNG.dirichlet(np.ones(3), 3), RNG.dirichlet(np.ones(5), 3))


def paths(sequence):
    """Every state path with its probability."""
    for path in itertools.product(range(3), repeat=len(sequence)):
        p = MODEL.start[path[0]] * MODEL.emit[path[0], sequence[0]]
        for a, b, x in zip(path, path[1:], sequence[1:]):
            p *= MODEL.move[a, b] * MODEL.emit[b, x]
        yield path, p


def test_recursions_equal_sums_over_paths():
    sequences = [np.array(RNG.integers(0, 5, n)) for n in (1, 4, 2, 6, 4, 1)]
    logs = log_likelihoods(MODEL, sequences)
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5))
    for sequence, log in zip(sequences, logs, strict=True):
        ways = list(paths(sequence))
        total = sum(p for _, p in ways)
        assert math.isclose(log, math.log10(total))
        for path, p in ways:
            start[path[0]] += p / total
            for a, b in zip(path, path[1:]):
                move[a, b] += p / total
            for s, x in zip(path, sequence):
                emit[s, x] += p / total
    for got, want in zip(expected_counts(MODEL, sequences), (start, move, emit), strict=True):
        assert np.allclose(got, want)


def test_blocks_of_a_long_sequence_change_nothing():
    sequences = [np.array(RNG.integers(0, 5, n)) for n in (50, 7, 21, 1, 14, 8)]
    assert np.allclose(log_likelihoods(MODEL, sequences, span=7), log_likelihoods(MODEL, sequences))
    for got, want in zip(expected_counts(MODEL, sequences, span=7), expected_counts(MODEL, sequences), strict=True):
        assert np.allclose(got, want)


def test_long_sequence_is_finite():
    assert np.isfinite(log_likelihoods(MODEL, [np.zeros(30_000, dtype=int)])).all()


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    tongues = [[f"{x}{i}" for i in range(40)] for x in ("la", "der", "the")]
    texts = [" ".join(rng.choice(tongues[i % 3], rng.integers(1, 60))) for i in range(300)]
    return [*enumerate(texts), (900, None), (901, " "), (902, "Never SEEN\x0bwords"), (None, "the1 the2"), (5, "la1 la1"), (903, "la3 " * 20_000)]


def test_frame(spark, rows):
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id bigint, text string, score double").repartition(3)
    got = score(docs, states=4, bits=8, rounds=6).collect()
    assert len(got) == len(rows)
    tokens = [[w for w in (t or "").lower().replace("\x0b", " ").split()] + [None] for _, t in rows]
    out = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    counts = Counter(w for t, h in zip(tokens, out, strict=True) if not h for w in t)
    n, v = sum(counts.values()), len(counts)
    want = Counter((i, h, len(t), sum(w in counts for w in t), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 4)) for (i, _), t, h in zip(rows, tokens, out, strict=True))
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got)
    fresh = [r for r in got if r.held_out and r.doc_id < 300]
    assert sum(r.score for r in fresh) > sum(r.base_score for r in fresh) * 0.9
    assert score(docs.limit(0), states=4, bits=8, rounds=1).count() == 0


def test_no_training_rows(spark):
    docs = spark.createDataFrame([(i, "a b") for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0], "doc_id bigint, text string")
    got = score(docs, states=2, bits=6, rounds=1).collect()
    assert {(r.n_known, r.train_tokens) for r in got} == {(0, 0)} and all(math.isclose(r.base_score, 0.0, abs_tol=1e-9) for r in got)
