import random

import pytest

from tallyforge.llm import ngram_join
from tallyforge.llm.components import connected_components
from tallyforge.llm.ngram_join import drop_near_copies, link_counts, near_duplicates


def brute_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """(doc_id, n_shingles, component_id) by comparing all pairs."""
    sets = {i: brute_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                a_, b_ = sorted((find(a), find(b)))
                root[b_] = a_
    return {(i, len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    """Documents with chains of near copies around the threshold, copies, a shared passage, tiny and empty texts."""
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randrange(3000))
    passage = [word() for _ in range(40)]
    texts = []
    for _ in range(60):
        size = rng.choice([1, 3, 5, 6, 9, 20, 60, 150])
        base = [word() for _ in range(size)]
        if rng.random() < 0.5:
            at = rng.randrange(size + 1)
            base[at:at] = passage
        texts.append(base)
    for _ in range(140):
        copy = list(rng.choice(texts))
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            at = rng.randrange(len(copy))
            copy[at : at + rng.choice([0, 1, 1])] = [word()]
        texts.append(copy)
    out = [" ".join(t) for t in texts] + ["", "  \n ", None, "A b\tC d e f", "a B c  D E f", "one", "ONE"]
    ids = rng.sample(range(10_000), len(out))
    return list(zip(ids, out, strict=True))


@pytest.mark.parametrize("seed", range(3))
def test_equals_all_pairs(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, n int").repartition(5)
    got = near_duplicates(docs, bits=14 + 2 * seed).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute(rows)


@pytest.mark.parametrize(("seed", "unit"), [(0, 512), (1, 6), (2, 20)])
def test_counts_all_links(spark, monkeypatch, seed, unit):
    """Every link between different sets counts, those within one family too, in one unit or several."""
    monkeypatch.setattr(ngram_join, "UNIT", unit)
    rng, rows = random.Random(seed), corpus(seed)
    base = [f"b{i}" for i in range(150)]
    for i in range(40):
        copy = list(base)
        for at in rng.sample(range(150), rng.choice([1, 1, 2, 3, 4])):
            copy[at] = f"e{i}x{at}"
        rows.append((20_000 + i, " ".join(copy)))
    sets = {i: frozenset(brute_set(t)) for i, t in rows}
    once = set(sets.values()) - {frozenset()}
    want = {x: sum(x != y and 100 * len(x & y) >= 80 * len(x | y) for y in once) for x in once}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = link_counts(docs, bits=14 + 2 * seed).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute(rows) and len(got) == len(rows)
    assert {r.doc_id: r.n_links for r in got} == {i: want.get(x, 0) for i, x in sets.items()}
    assert max(want.values()) > 20


def test_string_ids_and_shuffled_halves(spark, monkeypatch):
    """Ids of any ordered type; the ways for large tables (no broadcast ids, no halves in tasks) give the same."""
    monkeypatch.setattr(ngram_join, "MOST_HALVES", 0)
    monkeypatch.setattr(ngram_join, "BROADCAST_BYTES", 0)
    rows = [(f"{i:05d}", t) for i, t in corpus(7)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id string, text string, token string")
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs, bits=14).collect()} == brute(rows)
    kept = drop_near_copies(docs, bits=14)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {c for _, _, c in brute(rows)}


def test_nulls_repeats_and_long_text(spark):
    long = " ".join(f"t{i}" for i in range(60_000))
    rows = [(5, long), (6, long + " end"), (5, long), (None, long), (None, "alone and only here"), (None, None), (9, ""), (8, "x y")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, component_id int")
    got = sorted(((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in near_duplicates(docs, bits=14).collect()))
    assert got == sorted([(5, 59_996, 5), (5, 59_996, 5), (6, 59_997, 5), (-1, 59_996, 5), (-1, 1, -1), (-1, 0, -1), (9, 0, 9), (8, 1, 8)])
    kept = drop_near_copies(docs, bits=14)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["5", "5", "8", "9", "None", "None", "None"]
    assert near_duplicates(docs.limit(0), bits=14).count() == 0 and drop_near_copies(docs.limit(0), bits=14).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 200), (200, 300), (None, 1)]
    got = {(r.node, r.component) for r in connected_components(spark.createDataFrame(edges, "x bigint, y bigint")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(i, 100) for i in range(100, 160)} | {(200, 200), (300, 200)}
