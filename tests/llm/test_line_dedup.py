import random

import numpy as np
import pytest

from tallyforge.llm import line_dedup, ngram_join
from tallyforge.llm.line_dedup import WIDTH, band_keys, drop_similar_lines, line_decisions, normal_lines, numbered


def brute_set(line):
    return {line[i : i + WIDTH] for i in range(len(line) - WIDTH + 1)} if len(line) >= WIDTH else {line}


def brute(rows):
    """Places of the lines that go, by comparing all pairs of distinct lines."""
    lines = [(i is None, i or 0, r, p, x) for r, (i, t) in enumerate(rows) for p, x in enumerate(normal_lines(t) if t else []) if x]
    distinct = sorted({x[4] for x in lines})
    sets = {x: brute_set(x) for x in distinct}
    root = {x: x for x in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(distinct):
        for b in distinct[k + 1 :]:
            x, y = sets[a], sets[b]
            if 10 * len(x & y) >= 8 * len(x | y):
                root[find(b)] = find(a)
    first = {}
    for key in sorted(lines):
        first.setdefault(find(key[4]), key)
    gone = {r: [] for r in range(len(rows))}
    for key in lines:
        if first[find(key[4])] != key:
            gone[key[2]].append(key[3])
    return gone


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij é", k=rng.randrange(2, 9)))
    base = [" ".join(word() for _ in range(rng.choice([1, 4, 30, 60]))) for _ in range(60)]
    out = []
    for _ in range(100):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            line = rng.choice(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at = rng.randrange(len(line))
                line = line[:at] + rng.choice("XYZ ") + line[at + 1 :]
            lines.append(line)
        out.append("\n".join(lines))
    return [*zip(rng.sample(range(1000), 100), out), (5000, None), (5001, ""), (None, base[2] + "\n\n" + base[2]), (5002, "Short\nshort\n \nSHORT "), (5002, "Short\nshort\n \nSHORT ")]


@pytest.mark.parametrize(("seed", "unit", "most"), [(16, 512, 8_000_000), (2, 4, 0)])
def test_equals_all_pairs(spark, seed, unit, most, monkeypatch):
    """In one unit or several; with recurring halves in tasks, or by shuffling."""
    monkeypatch.setattr(ngram_join, "UNIT", unit)
    monkeypatch.setattr(line_dedup, "MOST_HALVES", most)
    monkeypatch.setattr(line_dedup, "MOST_IDS", most)
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, row int").repartition(3)
    got = line_decisions(numbered(docs)).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), r.n_lines, sorted(r.dropped)) for r in got) == sorted((str(i), len(normal_lines(t)) if t else 0, sorted(want[k])) for k, (i, t) in enumerate(rows))


def test_texts(spark):
    long = "long line of words " * 10_000
    docs = spark.createDataFrame([(2, "a line that stays\nb", 7), (3, "A  line that stays\n\nc", 8), (4, None, 9), (6, long, 1), (7, long + "end", 1)], "doc_id bigint, text string, place int")
    got = drop_similar_lines(docs)
    assert got.columns == docs.columns
    assert {r.doc_id: r.text for r in got.collect()} == {2: "a line that stays\nb", 3: "\nc", 4: None, 6: long, 7: ""}
    assert drop_similar_lines(docs.limit(0)).count() == 0


def test_bands_find_similar_lines():
    rng = np.random.default_rng(3)
    missed = 0
    for _ in range(300):
        line = "".join(rng.choice(list("abcdefghijklmnop"), 200))
        other = list(line)
        for at in rng.choice(200, 2, replace=False):
            other[at] = "#"
        keys = band_keys([line, "between", "".join(other)])
        missed += not (keys[0] == keys[2]).any()
    assert missed <= 3
