import random
import re

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import linkage
from tallyforge.plans import linkage_queries

EVIDENCE = "evidence_id string, message_id string, kind string, order_id string"
MESSAGES = "message_id string, attachments array<string>"
REGIONS = "region_id string, financial_role string, source_ids array<string>, order_ids array<string>"


@pytest.mark.parametrize("bits", [1 << 24, 1 << 16, 64])
def test_known_tokens(spark, bits):
    """Equal to a search of every text, however full the table of bits is."""
    pick = random.Random(5)
    known = [str(pick.randrange(10**9, 10**14)) for _ in range(200)]
    texts = [(i, " ".join(pick.choice([pick.choice(known), str(pick.randrange(10**9, 10**14)), pick.choice(known) + "7", "x" + pick.choice(known), "-"]) for _ in range(30))) for i in range(40)]
    texts += [(100, None), (101, ""), (None, f"a{known[0]}b"), (102, ("9" * 16 + " ") * 50_000 + known[1]), (103, f"{known[2]} {known[2]}"), (103, known[2])]
    want = {(k, t) for k, text in texts for t in re.findall(r"(?<!\d)\d{10,15}(?!\d)", text or "") if t in set(known)}
    ids = spark.createDataFrame([(x,) for x in [*known, known[0], None]], "id string")
    got = [tuple(r) for r in linkage.known_tokens(spark.createDataFrame(texts, "k int, text string"), "k", "text", ids, "id", bits).collect()]
    assert set(got) == want and len(got) == len(want) and (None, known[0]) in want
    assert linkage.known_tokens(spark.createDataFrame(texts, "k int, text string"), "k", "text", ids.limit(0), "id", bits).count() == 0


def test_bits_come_before_the_exact_join(spark):
    texts, ids = spark.createDataFrame([(1, "1234567890")], "k int, text string"), spark.createDataFrame([("1234567890",)], "id string")
    plan = linkage.known_tokens(texts, "k", "text", ids, "id")._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert len(joins) == 2 and "token" in joins[0] and "getbit" not in joins[0] and "getbit" in joins[1] and "LeftSemi" not in plan
    assert "Cartesian" not in plan


def collection(seed):
    pick = random.Random(seed)
    some = lambda name, n: [f"{name}{pick.randrange(n)}" for _ in range(pick.randrange(4))]
    messages = [(f"m{i}", pick.choice([None, some("d", 9)])) for i in range(8)]
    kinds = ("history_row", "pdf_label", None)
    evidence = [(f"e{i}", f"m{pick.randrange(9)}", pick.choice(kinds), pick.choice([None, f"o{pick.randrange(5)}"])) for i in range(40)]
    regions = [(f"r{i}", pick.choice(["item", "charge", None]), some("m", 8) + some("d", 9), some("o", 5)) for i in range(25)]
    regions += [("hot", "item", ["m0", "m1", "m0"], [f"o{i}" for i in range(5)]), ("bare", "item", [], []), ("null", "item", None, None)]
    return evidence, messages, regions


def plain_links(evidence, messages, regions):
    scope = {m: {m, *(a or [])} for m, a in messages}
    return {
        (e, r) for e, m, kind, order in evidence for r, _, sources, orders in regions
        if m in scope and scope[m] & set(sources or []) and (kind != "history_row" or (order is not None and order in (orders or [])))
    }


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_links_equal_all_pairs(spark, seed):
    evidence, messages, regions = collection(seed)
    frames = [spark.createDataFrame(rows, schema) for rows, schema in ((evidence, EVIDENCE), (messages, MESSAGES), (regions, REGIONS))]
    links = linkage.region_links(*frames)
    got = [tuple(r) for r in links.collect()]
    want = plain_links(evidence, messages, regions)
    assert set(got) == want and len(got) == len(want)
    faults = {tuple(r) for r in linkage.link_faults(*frames, links).collect()}
    known = {m for m, _ in messages}
    assert faults == {(e, "unknown_message") for e, m, *_ in evidence if m not in known} | {(e, "no_region") for e, m, *_ in evidence if m in known and e not in {x for x, _ in want}}
    resolved = frames[0].select("evidence_id", F.col("order_id").alias("order")).where("order is not null")
    orders = linkage.region_orders(links, resolved)
    by_region = {}
    for e, r in want:
        for x, _, _, order in evidence:
            if x == e and order:
                by_region.setdefault(r, set()).add(order)
    assert {tuple(r) for r in orders.collect()} == {(r, o) for r, os in by_region.items() for o in os}
    assert {tuple(r) for r in linkage.item_regions(frames[2], orders).collect()} == {(r, next(iter(by_region[r]))) for r, role, *_ in regions if role == "item" and len(by_region.get(r, ())) == 1}


def test_repeated_ids_and_empty_tables(spark):
    empty = [spark.createDataFrame([], x) for x in (EVIDENCE, MESSAGES, REGIONS)]
    assert linkage.region_links(*empty).count() == 0 and linkage.link_faults(*empty, linkage.region_links(*empty)).count() == 0
    messages = spark.createDataFrame([("m", None), ("m", ["d"])], MESSAGES)
    regions = spark.createDataFrame([("r", "item", ["m"], ["o"])] * 2, REGIONS)
    evidence = spark.createDataFrame([("e", "m", "history_row", "o")], EVIDENCE)
    links = linkage.region_links(evidence, messages, regions)
    assert [tuple(r) for r in links.collect()] == [("e", "r")]
    assert {tuple(r) for r in linkage.link_faults(evidence, messages, regions, links).collect()} == {("m", "repeated_message"), ("r", "repeated_region")}


def test_from_chunks_to_reconciliations(spark):
    orders = spark.createDataFrame([("r1", "o1"), ("r2", "o1"), ("r2", "o2")], "region_id string, order string")
    chunks = spark.createDataFrame([("c1", "r1"), ("c2", "r2"), ("c3", "r3")], "chunk_id string, region_id string")
    assert {tuple(r) for r in linkage.chunk_orders(chunks, orders).collect()} == {("c1", "r1", "o1"), ("c2", "r2", "o1"), ("c2", "r2", "o2"), ("c3", "r3", None)}
    meant = spark.createDataFrame([("r1", "k1"), ("r2", "k2"), ("r3", "k3"), ("r1", "gone")], "region_id string, component_id string")
    components = spark.createDataFrame([("k1", "c1"), ("k2", "c2"), ("k3", "c3")], "component_id string, chunk_id string")
    found, missing = linkage.interpreted_components(meant, components, orders)
    assert {(r.component_id, r.chunk_id, r.order) for r in found.collect()} == {("k1", "c1", "o1"), ("k2", "c2", "o1"), ("k2", "c2", "o2"), ("k3", "c3", None)}
    assert [r.component_id for r in missing.collect()] == ["gone"]
    runs = spark.createDataFrame([("x", "k1"), ("x", "k2"), ("x", "k3"), ("y", "k3"), ("z", "k2")], "run_id string, component_id string")
    assert sorted(tuple(r) for r in linkage.reconciled_orders(runs, found).collect()) == [("x", "o1"), ("x", "o2"), ("z", "o1"), ("z", "o2")]


def test_links_carry_columns_and_are_counted_without_joining_again(spark):
    evidence, messages, regions = (spark.createDataFrame(rows, schema) for rows, schema in zip(collection(4), (EVIDENCE, MESSAGES, REGIONS)))
    links = linkage.region_links(evidence, messages, regions, "kind")
    assert sorted(map(str, links.collect())) == sorted(map(str, linkage.region_links(evidence, messages, regions).join(evidence.select("evidence_id", "kind"), "evidence_id").collect()))
    plan = linkage_queries.evidence_region_links(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and plan.count("Join Inner") == 4


def test_texts_without_an_id_name_their_numbers(spark, tmp_path):
    """A null id takes no number away; a number that a text has by itself is found (the SQL, which reads no text, knows none)."""
    spark.createDataFrame([(None, "x"), (1, "see 1000000009"), (2, None)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7,), (9,), (20,)], "o_orderkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    got = {tuple(r) for r in linkage_queries.known_id_tokens(spark, str(tmp_path)).collect()}
    assert got == {(None, "1000000007"), (1, "1000000007"), (2, "1000000007"), (1, "1000000020"), (1, "1000000009")}
