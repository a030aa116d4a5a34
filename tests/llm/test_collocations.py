import gc
import random
import re
import weakref
from collections import Counter

import duckdb
import numpy as np
import pytest

from tallyforge.llm import collocations as module
from tallyforge.llm.collocations import ORACLE_SQL, Bitmaps, Shard, _parts, collocations, mine, op11_collocations

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words_of(text):
    return [[w for w in re.split(r"[ \t]+", piece) if w] for piece in re.split(r"[.,;:!?\n-\r]", lower(text or ""))]


def brute(rows, longest=3, least=10, top=2000, covers=50):
    """The definition, with Python's integers."""
    counts, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in words_of(text):
            n[lang] += len(piece)
            for k in range(1, longest + 1):
                counts.update((lang, tuple(piece[i : i + k])) for i in range(len(piece) - k + 1))
    cands = {p: f for p, f in counts.items() if len(p[1]) > 1 and f >= least}
    inner = {}
    for (lang, words), f in cands.items():
        for m in range(2, len(words)):
            for i in range(len(words) - m + 1):
                inner[lang, words[i : i + m]] = max(f, inner.get((lang, words[i : i + m]), 0))
    out = []
    for lang in n:
        found = []
        for (at, words), a in cands.items():
            if at == lang and not 100 * inner.get((lang, words), -1) >= covers * a:
                cut = min((1_000_000 * a * a // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words)))
                found.append((-cut[0], -a, " ".join(words).encode(), counts[lang, words[: cut[1]]], counts[lang, words[cut[1] :]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(k, t, g, "clash", 1) for k, (g, t) in enumerate(rows)], "doc_id int, text string, lang string, phrase string, f int").repartition(3)


def result(found):
    return sorted(tuple(r[c] for c in COLUMNS) for r in found.collect())


def random_rows(seed, n=250):
    rng = random.Random(seed)
    words = ["a", "B", "the", "The", "ß", "日本", "x y", "o'k", "é", "end"]
    gaps = [" ", "  ", "\t", " ", " ", ". ", ",", "\n", "\r\n", " ! "]
    return [(rng.choice(["en", "de", None, "und", ""]), "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(0, 40)))) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, monkeypatch, seed):
    rows = random_rows(seed)
    assert result(collocations(frame(spark, rows))) == brute(rows)
    assert result(collocations(frame(spark, rows), longest=4, least=3, top=7, covers=80)) == brute(rows, 4, 3, 7, 80)


def test_small_shards_and_full_gates(spark, monkeypatch):
    """Many shards, ranges of one block and gates that let nearly everything through: the same result."""
    rows = random_rows(3, 120)
    want = brute(rows, least=4)
    body = [t.encode() for _, t in rows]
    monkeypatch.setattr(module, "SHARD_BYTES", 300)
    monkeypatch.setattr(module, "CHUNK", 3)
    full = [np.full(module.GATE_BITS // 8, 255, dtype=np.uint8)] * 2
    got = Counter()
    for texts in ([x] for x in body):
        shard = Shard(texts, ["en"])
        for members, counts, _ in mine(shard, 3, full):
            if members.shape[1] == 2:
                continue
            out = shard.rows(members, counts)
            for phrase, f in zip(out["phrase"].to_pylist(), out["f"].to_pylist(), strict=True):
                got[phrase] += f
    assert got == Counter(" ".join(p[i : i + 3]) for _, t in rows for p in words_of(t) for i in range(len(p) - 2))
    assert result(collocations(frame(spark, rows), least=4)) == want


def test_bitmaps():
    """Shift, AND and popcount over block borders."""
    rng = np.random.default_rng(1)
    item = rng.integers(0, 5, 1000)
    position = np.arange(1000) + np.cumsum(rng.random(1000) < 0.1)
    maps = Bitmaps.of(position, item)
    node, follower, _, mask = maps.follow(maps.item, maps.block, maps.mask)
    got = Counter()
    for a, b, f in zip(node.tolist(), follower.tolist(), np.bitwise_count(mask).tolist(), strict=True):
        got[a, b] += f
    assert got == Counter((a, b) for a, b, p, q in zip(item.tolist(), item[1:].tolist(), position, position[1:], strict=False) if q == p + 1)
    assert len(maps.mask) < 700


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(module, "SHARD_BYTES", 10)
    assert list(_parts(b"one two. three, four five six seven eight. nine")) == [b"one two.", b" three,", b" four five six seven eight.", b" nine"]
    assert list(_parts(b"")) == [b""] and list(_parts(b"no end at all here")) == [b"no end at all here"]


def test_empty_and_odd_rows(spark):
    assert result(collocations(frame(spark, [("en", "a b")]).limit(0))) == []
    rows = [("en", None), (None, ""), ("en", " \t. "), (None, "a b " * 10), (None, "a b"), ("en", "z " * 30)]
    assert result(collocations(frame(spark, rows))) == brute(rows)
    same = [("en", "new york city")] * 12 + [("en", "new york")] * 12
    assert result(collocations(frame(spark, same))) == brute(same)


def test_a_very_long_text(spark, monkeypatch):
    rows = [("en", "one two three, four! " * 30_000), ("en", "one two")]
    assert result(collocations(frame(spark, rows))) == brute(rows)


def test_query_against_its_sql(spark):
    path = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    got = op11_collocations(spark, path)
    assert got.dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), *((x, "bigint") for x in ("a", "l", "r", "n", "score"))]
    rows = spark.read.parquet(f"{path}/documents.parquet").select("lang", "text").collect()
    want = brute([(r.lang, r.text) for r in rows])
    assert want and result(got) == want == sorted(db.execute(ORACLE_SQL).fetchall())


def test_a_mined_shard_is_freed_at_once(monkeypatch):
    """No shard's bitmaps wait for a collection of garbage; a task that works on many would hold them all."""
    alive, make = [], Bitmaps.of.__func__
    monkeypatch.setattr(Bitmaps, "of", classmethod(lambda cls, *x: (maps := make(cls, *x), alive.append(weakref.ref(maps)))[0]))
    full = [np.full(module.GATE_BITS // 8, 255, dtype=np.uint8)] * 2
    gc.disable()
    try:
        for sums_only in (False, True):
            assert sum(len(counts) for _, counts, _ in mine(Shard([b"one two three four"], ["en"]), 3, full, sums_only))
        assert len(alive) == 2 and not any(x() for x in alive)
    finally:
        gc.enable()
