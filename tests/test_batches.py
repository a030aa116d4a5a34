"""Plans of batches against a plain walk over all chunks."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyforge.operators.proposals import BatchPolicy, output_tokens, plan_batches

SCHEMA = "bundle_id string, cohort string, chunk_id string, place int, text string, table_id string, output_tokens int, batch_id string"


def plain(rows, policy):
    """The rules, over lists of whole cohorts; chunks are (bundle, chunk, tokens, output)."""

    def fits(x):
        return len(x) <= policy.most_chunks and len({c[0] for c in x}) <= policy.most_bundles and sum(c[2] for c in x) <= policy.most_tokens and (
            policy.most_output_tokens is None or 1_200 + sum(c[3] for c in x) <= policy.most_output_tokens)

    def pack(units):
        expanded = []
        for unit in units:
            if fits(unit):
                expanded.append(unit)
                continue
            now = []
            for c in unit:
                if now and not fits(now + [c]):
                    expanded.append(now)
                    now = []
                now = now + [c]
            expanded.append(now)
        packed, now = [], []
        for unit in expanded:
            if now and ((len(now) >= policy.least_chunks and sum(c[2] for c in now) >= policy.target_tokens) or not fits(now + unit)):
                packed.append(now)
                now = []
            now = now + unit
        packed += [now] if now else []
        if len(packed) > 1 and len(packed[-1]) < policy.least_chunks:
            a, b = packed[-2:]
            k = policy.least_chunks - len(b)
            if fits(a + b):
                packed[-2:] = [a + b]
            elif all(Counter(c[0] for c in a)[c[0]] == 1 for c in a[-k:]) and len(a) - k >= policy.least_chunks and fits(a[:-k]) and fits(a[-k:] + b):
                packed[-2:] = [a[:-k], a[-k:] + b]
        return packed

    cohorts = {}
    for bundle, cohort, chunk, place, text, table, output, *_ in rows:
        tokens = -(-len(text) // 3)
        cohorts.setdefault(cohort, {}).setdefault(bundle, []).append((place, chunk, table, (bundle, chunk, tokens, output)))
    packed = []
    for _, bundles in sorted(cohorts.items()):
        units = []
        for _, chunks in sorted(bundles.items()):
            chunks = sorted(chunks, key=lambda x: x[:2])
            if fits([c[3] for c in chunks]):
                units.append([c[3] for c in chunks])
                continue
            tables = {}
            for i, c in enumerate(chunks):
                tables.setdefault(c[2] or i, []).append(c[3])
            units += list(tables.values())
        packed += pack(units)
    small = [x for x in packed if fits(x) and len(x) < policy.least_chunks]
    packed = [x for x in packed if not (fits(x) and len(x) < policy.least_chunks)] + pack(small)
    sound = [x for x in packed if fits(x) and len(x) >= policy.least_chunks]
    return sorted([c[1] for c in x] for x in sound), sorted(c[1] for x in packed if x not in sound for c in x)


def planned(found):
    groups, left = {}, []
    for r in found.collect():
        groups.setdefault(r.batch_id, []).append(r.chunk_id) if r.batch_id else left.append(r.chunk_id)
    return sorted(sorted(x) for x in groups.values()), sorted(left)


def random_rows(seed):
    rng, rows = random.Random(seed), []
    for c in range(rng.randint(1, 6)):
        for b in range(rng.randint(1, 8)):
            for k in range(rng.choice([1, 1, 2, 3, 9])):
                text = "x" * rng.choice([3, 9, 30, 60, 200])
                rows.append((f"b{c}{b}", f"c{c}", f"{c}/{b}/{k}", k, text, rng.choice([None, None, "t", "u"]), rng.choice([220, 700]), "clash"))
    return rows


POLICIES = (
    BatchPolicy(20, 40, 2, 6, 3),
    BatchPolicy(10, 25, 3, 8, 2),
    BatchPolicy(30, 60, 4, 5, 9, most_output_tokens=3_500),
    BatchPolicy(15, 30, 2, 4, 4, most_output_tokens=2_200),
)


@pytest.mark.parametrize("seed", range(6))
def test_equals_a_plain_walk(spark, seed):
    rows = random_rows(seed)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for policy in POLICIES[seed % 2 :: 2]:
        sound, left = plain(rows, policy)
        assert planned(plan_batches(frame, policy, shards=1)) == (sorted(map(sorted, sound)), left)


def test_shards_keep_every_chunk_once(spark):
    rows = [r for s in range(5) for r in random_rows(s)]
    rows = [(f"{i}-{r[0]}", *r[1:2], f"{i}", *r[3:]) for i, r in enumerate(rows)]
    policy = POLICIES[0]
    found = plan_batches(spark.createDataFrame(rows, SCHEMA), policy, shards=4).collect()
    assert Counter(r.chunk_id for r in found) == Counter(r[2] for r in rows)
    size = {r[2]: -(-len(r[4]) // 3) for r in rows}
    for batch in {r.batch_id for r in found if r.batch_id}:
        chunks = [r for r in found if r.batch_id == batch]
        assert 2 <= len(chunks) <= 6 and len({r.bundle_id for r in chunks}) <= 3 and sum(size[r.chunk_id] for r in chunks) <= 40


def test_repairs(spark):
    one = lambda bundle, k, n: (bundle, "c", f"{bundle}{k}", k, "x" * n, None, 0, "")
    # The last chunk alone joins the batch before it, or takes a chunk of it, or goes to another cohort's.
    merged = [one("a", 0, 30), one("b", 0, 30), one("c", 0, 30)]
    assert planned(plan_batches(spark.createDataFrame(merged, SCHEMA), BatchPolicy(20, 40, 2, 6, 6), 1)) == ([["a0", "b0", "c0"]], [])
    moved = [one("a", 0, 30), one("b", 0, 30), one("c", 0, 30), one("d", 0, 60)]
    assert planned(plan_batches(spark.createDataFrame(moved, SCHEMA), BatchPolicy(30, 40, 2, 3, 6), 1)) == ([["a0", "b0"], ["c0", "d0"]], [])
    apart = [("a", "c1", "a", 0, "x", None, 0, ""), ("b", "c2", "b", 0, "x", None, 0, ""), ("c", "c3", "c", 0, "x" * 999, None, 0, "")]
    assert planned(plan_batches(spark.createDataFrame(apart, SCHEMA), BatchPolicy(30, 40, 2, 3, 6), 1)) == ([["a", "b"]], ["c"])


def test_odd_rows(spark):
    rows = [("a", None, "1", 0, None, None, None, ""), ("a", None, "2", 0, "", None, None, ""), (None, "", "3", None, "x", None, None, "")]
    found = plan_batches(spark.createDataFrame(rows, SCHEMA), BatchPolicy(10, 20, 2, 5, 5)).collect()
    assert sorted(r.chunk_id for r in found) == ["1", "2", "3"]
    assert plan_batches(spark.createDataFrame([], SCHEMA)).count() == 0
    one = spark.range(1).select(output_tokens(F.lit(1), F.lit(2), F.lit(None).cast("int"), F.lit(1), F.lit(1)).alias("x")).first()
    assert one.x == 220 + 180 + 360 + 120 + 50
