from datetime import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from tallyforge.operators import answers, traversal
from tallyforge.plans import answer_queries

EVIDENCE = "chunk_id string, source_id string, source_hash string"
FULL = ("c", "s", "h")


def bound(spark, template, ids, slots):
    rows = [(i, [template], slots) for i in ids]
    return traversal.bind_slots(spark.createDataFrame(rows, "question_id string, templates array<string>, slots map<string,string>"))


def rows(frame):
    return {r.question_id: r for r in frame.collect()}


SUM_SLOTS = {"component_type": "platform_fee", "platform": "asia", "limit": "1"}
SUM = f"question_id string, component_id string, component_type string, platform string, amount decimal(18,2), currency string, {EVIDENCE}, quality_flags array<string>"


def fact(q, component, amount, currency="INR", evidence=FULL, flags=None):
    return (q, component, "platform_fee", "asia", Decimal(amount), currency, *evidence, flags)


def test_sums(spark):
    found = [
        fact("two", "b", "2.50"), fact("two", "a", "1.25"), fact("two", "a", "1.25", evidence=("c2", "s2", "h2")),
        fact("one", "a", "0.10"), fact("one", None, "9.99"),
        fact("conflict", "a", "1.00"), fact("conflict", "a", "2.00"),
        fact("mixed", "a", "1.00"), fact("mixed", "b", "1.00", "EUR"),
        fact("bare", "a", "1.00", evidence=("c", None, "h")), fact("bare", "b", "1.00", evidence=("c", "", "h")),
        fact("optional", "a", "1.00"), fact("optional", "b", "2.00", evidence=(None, None, None)),
        fact("flagged", "a", "1.00", flags=["conflicting"]),
        *[fact("long", f"k{i:02}", "1.00") for i in range(21)],
    ]
    ids = ["two", "one", "conflict", "mixed", "bare", "optional", "flagged", "long", "none"]
    questions = bound(spark, "financial_component_sum", ids, SUM_SLOTS)
    facts = spark.createDataFrame(found, SUM)
    got = rows(answers.grounded(questions, facts, "financial_component_sum"))
    assert {k: (r.status, r.abstention_reason, r.facts, r.citations) for k, r in got.items()} == {
        "two": ("verified", None, 2, 3), "one": ("verified", None, 1, 2), "conflict": ("refused", "conflicting_components", 1, 2), "mixed": ("refused", "mixed_currencies", 2, 2),
        "bare": ("abstained", "incomplete_evidence_coverage", 2, 0), "optional": ("verified", None, 2, 1), "flagged": ("abstained", "conflicting_evidence", 1, 1),
        "long": ("verified", None, 21, 21), "none": ("abstained", "incomplete_evidence_coverage", 0, 0),
    }
    assert got["two"].direct_answer == "The evidence-backed platform fee total for Asia is INR 3.75 across 2 distinct components."
    assert (got["two"].calculation, got["two"].limitation) == ("INR 1.25 + INR 2.50 = INR 3.75", answers.SUM_LIMIT)
    assert got["one"].direct_answer.endswith("INR 0.10 across 1 distinct component.")
    assert got["long"].calculation.startswith("Decimal sum of 21 distinct source-backed components = INR 21.00; term digest=")
    assert all(got[k].direct_answer is None and got[k].calculation is None for k in ids if got[k].status != "verified")
    again = rows(answers.grounded(questions, facts.orderBy(F.desc("component_id")).repartition(7), "financial_component_sum"))
    assert again == got
    budget = rows(answers.grounded(questions, facts, "financial_component_sum", budget=True))
    assert budget["long"].abstention_reason == "query_action_budget_exhausted" and budget["two"].status == "verified"


PRICE = f"question_id string, order_id bigint, amount decimal(18,2), currency string, occurred_at timestamp, {EVIDENCE}"


def seen(q, order, amount, day, currency="INR"):
    return (q, order, Decimal(amount), currency, datetime(2024, 1, day, 12) if day else None, *FULL)


def test_price_histories(spark):
    found = [
        seen("rise", 2, "12.00", 9), seen("rise", 1, "10.00", 3), seen("rise", 1, "10.00", 3), seen("rise", 5, "99.00", None),
        seen("one", 1, "7.00", 2), seen("free", 1, "0.00", 1), seen("free", 2, "3.00", 2), seen("tiny", 1, "500.01", 1), seen("tiny", 2, "500.00", 2),
        seen("half", 1, "800.00", 1), seen("half", 2, "801.00", 2), seen("tie", 9, "5.00", 1), seen("tie", 1, "4.00", 1),
        seen("conflict", 1, "1.00", 1), seen("conflict", 1, "2.00", 1), seen("mixed", 1, "1.00", 1), seen("mixed", 2, "1.00", 2, "EUR"), seen("undated", 1, "1.00", None),
    ]
    questions = bound(spark, "merchant_item_price_history", sorted({x[0] for x in found}), {"merchant_name": "m", "item_name": "i"})
    got = rows(answers.grounded(questions, spark.createDataFrame(found, PRICE), "merchant_item_price_history"))
    assert got["rise"].direct_answer == "The source-backed item price changed from INR 10.00 on 2024-01-03 to INR 12.00 on 2024-01-09."
    assert got["rise"].calculation == "INR 12.00 - INR 10.00 = INR 2.00 (20.00%)"
    assert (got["one"].direct_answer, got["one"].calculation, got["one"].limitation) == ("The source-backed item price was INR 7.00 on 2024-01-02.", None, answers.ONE_PRICE_LIMIT)
    assert got["free"].calculation == "INR 3.00 - INR 0.00 = INR 3.00"
    assert got["tiny"].calculation == "INR 500.00 - INR 500.01 = INR -0.01 (-0.00%)"
    assert got["half"].calculation == "INR 801.00 - INR 800.00 = INR 1.00 (0.12%)"
    assert got["tie"].calculation == "INR 5.00 - INR 4.00 = INR 1.00 (25.00%)"
    assert {k: got[k].abstention_reason for k in ("conflict", "mixed", "undated")} == {"conflict": "conflicting_observations", "mixed": "mixed_currencies", "undated": "no_graph_facts"}


def test_counts_and_unbound_questions(spark):
    counts = spark.createDataFrame([("a", 1, *FULL), ("b", 7, *FULL), ("b", 7, *FULL), ("c", 0, *FULL)], f"question_id string, order_count bigint, {EVIDENCE}")
    got = rows(answers.grounded(bound(spark, "merchant_order_count", ["a", "b", "c"], {"merchant_name": "m"}), counts, "merchant_order_count"))
    assert [got[k].direct_answer for k in "abc"] == ["The graph links this merchant to 1 source-backed order.", "The graph links this merchant to 7 source-backed orders.", None]
    assert got["c"].abstention_reason == "no_graph_facts"
    mentions = spark.createDataFrame([("a", 5, *FULL), ("a", 5, *FULL), ("a", None, *FULL)], f"question_id string, order_id bigint, {EVIDENCE}")
    got = rows(answers.grounded(bound(spark, "delivery_mention_count", ["a"], {"delivery_name": "x"}), mentions, "delivery_mention_count"))
    assert got["a"].direct_answer == "The source evidence links this delivery-person mention to 1 distinct order."
    unbound = bound(spark, "order_reconstruction", ["a"], {"order_id": " "})
    got = rows(answers.grounded(unbound, mentions, "order_reconstruction"))
    assert (got["a"].status, got["a"].abstention_reason, got["a"].direct_answer) == ("abstained", "missing_query_slot:order_id", None)
    assert answers.grounded(unbound.limit(0), mentions.limit(0), "order_reconstruction").count() == 0


def test_pages(spark):
    frame = spark.range(1000).select((F.col("id") % 2).alias("question_id"), "id")
    got = answers.paged(frame, ["question_id"], [F.desc("id")])
    assert sorted(r.id for r in got.collect()) == list(range(600, 1000))
    assert "WindowGroupLimit" in got._jdf.queryExecution().optimizedPlan().toString()


def test_products_of_orders_are_paged_where_they_lie(spark):
    from tallyforge.plans import answer_queries
    from tallyforge.operators import traversal

    asked = answer_queries._questions(spark.createDataFrame([(i,) for i in range(40)], "k bigint"), F.col("k"), "order_reconstruction", order_id=F.col("k"))
    facts = answer_queries.reconstruction_facts(spark, "/root/testdata/sf0.001", traversal.bind_slots(asked))
    plan = facts._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert dealt and not any("question_id" in line.split("hashpartitioning(")[1].split("#")[0] for line in dealt)


def test_merchants_of_one_name_and_lines_without_an_order(spark, tmp_path):
    """Sellers of one name are one merchant; a repeated line is one chunk; lines of unknown orders and sellers count nowhere; lines move by no order's key."""
    save = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    save("region", [(0, "ASIA")], "r_regionkey int, r_name string")
    save("nation", [(0, "INDIA", 0)], "n_nationkey int, n_name string, n_regionkey int")
    save("supplier", [(1, "A", 0), (2, "B", 0), (3, "A", 0), (4, "C", 0)], "s_suppkey bigint, s_name string, s_nationkey int")
    save("orders", [(i, 1, "O", 1.0, None) for i in (1, 2, 2, 3)], "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp")
    lines = [(1, 1, 1), (1, 3, 1), (2, 3, 1), (2, 3, 1), (9, 1, 1), (None, 1, 1), (3, 2, 1), (3, 2, 2), (3, 77, 1), (3, None, 1)]
    lines = [(o, 5, s, n, 1.0, 2.0, 0.0, 0.0, "O", None) for o, s, n in lines]
    save("lineitem", lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_linestatus string, l_shipdate timestamp")
    got = {r.question_id: (r.status, r.facts, r.citations) for r in answer_queries.answers_merchant_orders(spark, str(tmp_path)).collect()}
    assert got == {"1": ("verified", 2, 3), "3": ("verified", 2, 3), "2": ("verified", 1, 2), "4": ("abstained", 0, 0)}
    bound = traversal.bind_slots(answer_queries._questions(spark.range(1), F.lit(1), "merchant_order_count", merchant_name=F.lit("a")))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        facts = answer_queries.merchant_order_facts(spark, str(tmp_path), bound)
        assert facts.count() == 3 and "hashpartitioning(orderkey" not in answer_queries.merchant_order_facts(spark, str(tmp_path), bound)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_long_sums_are_not_sorted_and_lines_do_not_move(spark, tmp_path):
    """Components of a large sum are added up by hashing, without a sort; a line without an order is a fact without a source."""
    rows = [("q", f"c{i:02}", i, "INR" if i else "USD", "tax", "p") for i in range(25)] + [("r", "a", 1, "INR", "tax", "p"), ("r", "b", None, "INR", "tax", "p"), ("s", "a", 1, "", "tax", "p")]
    schema = "question_id string, component_id string, amount int, currency string, component_type string, platform string"
    facts = spark.createDataFrame(rows, schema).withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    seen = {}

    def kept(frame, label, **more):
        seen[label] = frame._jdf.queryExecution().executedPlan().toString()
        return keep(frame, label, **more)

    keep, answers.materialise = answers.materialise, kept
    try:
        found = {r.question_id: r for r in answers.component_sums(facts).collect()}
    finally:
        answers.materialise = keep
    assert {k: (r.facts, r.fault) for k, r in found.items()} == {"q": (25, "mixed_currencies"), "r": (1, None)} and found["r"].calculation == "INR 1.00 = INR 1.00"
    assert seen["sums"].count("HashAggregate") >= 2 and "question_id" in seen["sums"]
    # Sorted are at most the rows of the second sum, one for each question and currency.
    assert "Sort" not in seen["sums"][seen["sums"].rindex("hashpartitioning") :]
    line = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_linestatus string, l_shipdate string"
    spark.createDataFrame([(1, 1, 1, 1, 1.0, 2.0, 0.0, 0.0, "O", None), (9, 1, 1, 1, 1.0, 2.0, 0.0, 0.0, "O", None), (None, 1, 1, 1, 1.0, 2.0, 0.0, 0.0, "O", None), (1, 1, 5, 1, 1.0, 2.0, 0.0, 0.0, "O", None)], line).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 1, "O", 2.0, None)], "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, "a", 0)], "s_suppkey bigint, s_name string, s_nationkey bigint").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(0, "n", 0)], "n_nationkey bigint, n_name string, n_regionkey bigint").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(0, "ASIA")], "r_regionkey bigint, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    bound = spark.createDataFrame([("q", "financial_component_sum", {"component_type": "tax", "platform": "asia", "limit": "50"}, None)], "question_id string, template string, parameters map<string,string>, abstention_reason string")
    facts = answer_queries.component_sum_facts(spark, str(tmp_path), bound)
    assert sorted((r.chunk_id.split("|")[0], r.source_id or "") for r in facts.collect()) == [("1", ""), ("1", "order:1"), ("9", "")]
    assert "hashpartitioning" not in facts._jdf.queryExecution().executedPlan().toString()


def test_pages_of_odd_orders(spark, tmp_path):
    """Pages hold the first rows of all pairs, also where lines or orders repeat or are more than a page may hold; they are made without sorting the pairs."""
    line = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_linestatus string, l_shipdate string"
    parts = {1: [2, 20, 3], 2: [2, 2, 2, 20], 3: list(range(205)), 4: [n % 120 for n in range(210)], 8: [1]}
    spark.createDataFrame([(o, p, 1, 1, 1.0, 2.0, 0.0, 0.0, "O", "1996-01-01") for o, ps in parts.items() for p in ps], line).write.parquet(f"{tmp_path}/lineitem.parquet")
    customers = {1: [None], 2: [2], 3: [3], 4: [4], 6: [6, 6]}
    spark.createDataFrame([(o, c, "O", 2.0, None) for o, cs in customers.items() for c in cs], "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    want = []
    for o, cs in customers.items():
        lines = [f"{o}|{p}|1|1|1.00|2.00|0.0000|0.0000|1996-01-01" for p in parts.get(o, [])]
        near = [("HAS_COMPONENT", f"{k}:{t}") for k in lines for t in ("item_gross", "coupon_discount", "tax")] + [("HAS_ITEM_OBSERVATION", f"observation:{k}") for k in lines]
        for c in cs:
            near += [("HAS_COMPONENT", f"{o}:customer_total"), ("DOCUMENTED_BY", f"order:{o}")] + ([("HAS_DELIVERY_MENTION", f"mention/{c}/{o}")] if c else [])
        pairs = sorted((*n, c) for n in near for c in lines + [str(o)] * len(cs))
        want += [(f"{o}/{limit}", *p) for limit in (1, 7, 50, 200) for p in pairs[:limit]]
    asked = spark.createDataFrame([(f"{o}/{limit}", ["order_reconstruction"], {"order_id": str(o), "limit": str(limit)}) for o in (*customers, 8, 9) for limit in (1, 7, 50, 200)], "question_id string, templates array<string>, slots map<string,string>")
    facts = answer_queries.reconstruction_facts(spark, str(tmp_path), traversal.bind_slots(asked))
    answered = answers.grounded(traversal.bind_slots(asked), facts, "order_reconstruction")
    for found in (facts, answered):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Window [") == 1 and "neighbour_id" not in plan.split("Window [")[1]
    assert sorted((r.question_id, r.relationship_type, r.neighbour_id, r.chunk_id) for r in facts.collect()) == sorted(want)
    counted = {}
    for question, *_ in want:
        counted[question] = counted.get(question, 0) + 1
    assert {r.question_id: r.facts for r in answered.collect() if r.facts} == counted
