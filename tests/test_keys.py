"""Steps that move hashes of wide keys: results as by the keys themselves, also where hashes meet."""

from decimal import Decimal

from pyspark.sql import functions as F

from tallyforge.operators import answers, events, evidence_graph, finance, graph, keys, traversal
from tallyforge.sources import domain


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def plan(found):
    return found._jdf.queryExecution().executedPlan().toString()


def test_rows_that_do_not_repeat_stay(spark):
    pairs = frame(spark, [("a", "1"), ("b", "1"), (None, "a"), ("a", None)], "x string, y string")
    alone, several = keys.divided(pairs, "x", "y")
    # A null and a value give the hash of the value alone, so these two are compared by their keys.
    assert sorted(map(str, several.collect())) == ["Row(x='a', y=None)", "Row(x=None, y='a')"] and alone.count() == 2
    assert keys.once(pairs).count() == 4
    assert keys.once(pairs.unionByName(pairs)).count() == 4
    assert keys.once(pairs.unionByName(pairs), "x").count() == 3
    assert "Exchange" not in plan(keys.once(frame(spark, [("a", "1"), ("b", "1")], "x string, y string")))


def test_relations_move_no_pair(spark):
    pairs = frame(spark, [("a", "1"), ("b", "1")], "component_id string, order_id string")
    found = evidence_graph.edges({"component_orders": pairs})
    assert found.count() == 2 and "Exchange" not in plan(found)


def test_given_pairs_need_no_join(spark):
    tables = {"used_components": frame(spark, [("r", "a")], "reconciliation_id string, component_id string"), "component_orders": frame(spark, [("a", "1")], "component_id string, order_id string")}
    given = tables | {"reconciled_orders": frame(spark, [("1", "r")], "order_id string, reconciliation_id string")}
    rows = [sorted(map(str, evidence_graph.edges(x).collect())) for x in (tables, given)]
    assert rows[0] == rows[1] and len(rows[0]) == 3 and "Join" not in plan(evidence_graph.edges(given))


def test_edges_of_several_types_are_those_of_each(spark):
    rows = frame(spark, [("1", "a"), ("2", None), (None, "b")], "x string, y string")
    kinds = [("HAS_COMPONENT", ("Order", F.col("x")), ("MoneyComponent", F.col("y"))), ("RESOLVES_TO", ("ResolutionDecision", F.col("y")), ("Order", F.col("x")))]
    each = [tuple(r) for kind in kinds for r in rows.select(*graph.edge(*kind)).collect()]
    assert sorted(map(str, each)) == sorted(str(tuple(r)) for r in graph.edges_of(rows, *kinds).collect())


def test_faults_of_every_kind(spark):
    schema = "relationship_id string, source_node_id string, target_node_id string"
    nodes = frame(spark, [("a",), ("b",), ("b",), ("c",)], "node_id string")
    edges = frame(spark, [("1", "a", "b"), ("1", "a", "b"), ("2", "x", "c"), ("3", "a", "y"), ("4", "x", "y"), ("5", None, "c")], schema)
    wanted = [("duplicate_node", "b"), ("duplicate_relationship", "1"), ("missing_source", "2"), ("missing_source", "4"), ("missing_target", "3"), ("missing_target", "4")]
    assert sorted(map(tuple, graph.faults(nodes, edges).collect())) == wanted
    assert graph.faults(nodes.distinct(), edges.where("relationship_id = '9'")).count() == 0


def test_events_whose_ends_are_missing(spark):
    nodes = frame(spark, [("order:1", "Order", {}), ("money:a", "MoneyComponent", {}), ("chunk:k", "EvidenceChunk", {})], "node_id string, label string, properties map<string,string>")
    edges = nodes.limit(0).select(*graph.edge("T", ("Order", F.col("node_id")), ("Order", F.col("node_id"))))
    events = frame(spark, [("e", "1", "a", "k", "t", "1", "INR"), ("f", "1", "a", "z", "t", "1", "INR")], "event_id string, orderkey string, component_key string, source_key string, event_type string, amount string, currency string")
    links = frame(spark, [("f", "e")], "new_id string, old_id string")
    more, linked, missing = traversal.extend_with_events(nodes, edges, events, links)
    assert more.count() == 5 and linked.count() == 7 and [r.node_id for r in missing.collect()] == ["chunk:z"]
    again = traversal.extend_with_events(more, linked, events, links)
    assert again[0].count() == 5 and again[1].count() == 7


def test_components_that_come_once_stay_where_they_are(spark):
    rows = [("q", f"c{i:02}", i, "INR", "tax", "p") for i in range(25)] + [("q", "c00", 0, "INR", "tax", "p"), ("s", "a", 1, "INR", "tax", "p"), ("s", "b", 2, "INR", "tax", "p"), ("s", "a", 1, "INR", "tax", "p"), ("t", "a", 1, "INR", "tax", "p"), ("t", "a", 2, "INR", "tax", "p")]
    facts = frame(spark, [(q, c, Decimal(amount), *rest) for q, c, amount, *rest in rows], "question_id string, component_id string, amount decimal(18,2), currency string, component_type string, platform string")
    found = {r.question_id: r for r in answers.component_sums(facts).collect()}
    assert {k: (r.facts, r.fault) for k, r in found.items()} == {"q": (25, None), "s": (2, None), "t": (1, "conflicting_components")}
    assert found["s"].calculation == "INR 1.00 + INR 2.00 = INR 3.00" and "= INR 300.00; term digest=" in found["q"].calculation
    kept, several = keys.divided(facts, "question_id", "component_id")
    assert kept.count() == 25 and {(r.question_id, r.component_id) for r in several.collect()} == {("q", "c00"), ("s", "a"), ("t", "a")}


def test_coverage_counts_as_by_keys(spark):
    rows = lambda *values: frame(spark, [(x,) for x in values], "component_key string")
    found = events.uncovered(rows("a", "b", "b", "c", None), rows("a", "b", "d", "d", "e", None))
    wanted = {("b", 2, 1), ("c", 1, None), ("d", None, 2), ("e", None, 1), (None, 1, None), (None, None, 1)}
    assert {(r.component_key, r.wanted, r.got) for r in found.collect()} == wanted and found.count() == 6
    # Counted without the keys, hashes alone are moved.
    assert "min(component_key" not in plan(found.groupBy("wanted", "got").count())


def test_timed_components_are_those_that_meet_their_order(spark, tmp_path):
    frame(spark, [(1, 1, 1, 1, 1.0, 2.0, 0.0, 0.0, "O", "1996-01-01"), (3, 1, 1, 1, 1.0, 2.0, 0.5, 0.1, "F", "1996-01-02")],
          "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_linestatus string, l_shipdate string").write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = frame(spark, [(1, 1, "O", 2.0, "1996-01-01"), (2, 1, "O", 3.0, "1996-01-01"), (2, 1, "O", 3.0, "1996-02-01")], "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate string")
    orders.withColumn("o_orderdate", F.to_timestamp("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    timed = events.timed_events(domain.timed_components(spark, str(tmp_path)))
    joined = events.financial_events(domain.money_components(spark, str(tmp_path)), domain.orders(spark, str(tmp_path)))
    assert timed.columns == joined.columns and sorted(map(str, timed.collect())) == sorted(map(str, joined.collect())) and timed.count() == 11


def test_dealt_components_are_the_same_and_move_once(spark, tmp_path):
    frame(spark, [(1, 1, 1, 1, 1.0, 2.0, 0.0, 0.0, "O", "1996-01-01"), (1, 2, 1, 1, 1.0, 5.0, 0.5, 0.1, "O", "1996-01-01"), (3, 1, 1, 1, None, 2.0, 0.5, 0.1, "F", None), (None, 1, 1, 1, 1.0, 2.0, 0.5, 0.1, "F", "1996-01-02")],
          "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_linestatus string, l_shipdate string").write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = frame(spark, [(1, 1, "O", 7.0), (2, 1, "O", None), (2, 1, "O", 3.0), (None, 1, "O", 3.0)], "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double")
    orders.withColumn("o_orderdate", F.lit(None).cast("timestamp")).write.parquet(f"{tmp_path}/orders.parquet")
    one, other = domain.dealt_components(spark, str(tmp_path)), domain.money_components(spark, str(tmp_path))
    assert one.columns and sorted(map(str, one.select(other.columns).collect())) == sorted(map(str, other.collect())) and one.count() == 16
    found = finance.reconcile_bundles(one)
    assert sorted(map(str, found.collect())) == sorted(map(str, finance.reconcile_bundles(other).collect()))
    assert plan(finance.reconcile_bundles(one)).count("Exchange hashpartitioning") == 1


def test_values_are_counted_by_hashes(spark):
    rows = frame(spark, [("g", "a", "x"), ("g", "a", "y"), ("h", "a", "a"), ("g", None, "x"), (None, "b", "b")], "g string, p string, q string")
    found = keys.values(rows, "g", "p", "q")
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, [("g", "p", 2), ("g", "q", 2), ("g", "q", 1), ("h", "p", 1), ("h", "q", 1), (None, "p", 1), (None, "q", 1)]))


def test_nodes_are_counted_without_their_properties(spark):
    mentions = frame(spark, [("a", "merchant", "A", None, "p"), ("b", None, None, None, None), ("c", "delivery_partner", "C", "c", "p"), (None, "merchant", "A", "a", "p")], "mention_id string, entity_type string, raw_value string, normalized_value string, platform string")
    tables = {"mentions": mentions, "platforms": frame(spark, [("x",), (None,)], "platform string"), "merchants": frame(spark, [], "merchant_id string, platform string, display_name string, normalized_name string")}
    found = evidence_graph.node_counts(tables)
    filled = F.size(F.map_filter("properties", lambda k, v: v.isNotNull()))
    wanted = evidence_graph.nodes(tables).groupBy("label").agg(F.count("*").alias("n"), F.sum(filled).cast("bigint").alias("filled"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect())) and found.schema.simpleString() == wanted.schema.simpleString()
    assert {r.label for r in found.collect()} == {"EntityMention", "PersonMention", "Platform"} and "map(" not in plan(evidence_graph.node_counts(tables))


def commerce(spark, lines, orders):
    """Tables of a small shop: lines (orderkey, suppkey, line_key), orders, three sellers, and the components of both."""
    line = frame(spark, lines, "orderkey bigint, suppkey bigint, line_key string").withColumns({"gross": F.lit(Decimal(1)), "discount": F.lit(Decimal(1)), "tax": F.lit(Decimal(1))})
    order = frame(spark, [(o, f"t{o}", Decimal(1)) for o in orders], "orderkey bigint, occurred_at string, total decimal(18,2)")
    sellers = frame(spark, [(1, "a", "p"), (2, "b", "p"), (20, "c", "q")], "suppkey bigint, merchant string, platform string")
    return order, line, sellers, domain._with_totals(domain.line_components(line), order)


def test_faults_of_doubtful_orders_are_all_faults(spark):
    key = F.substring_index("node_id", ":", -1).cast("bigint")
    torn = lambda nodes: nodes.where(~((F.col("label") == "Merchant") & (key % 10 == 0)) & ~((F.col("label") == "Order") & (key == 9))).unionByName(nodes.where((F.col("label") == "Order") & (key == 3)))
    sound = [(1, 1, "1|1"), (1, 2, "1|2"), (2, 20, "2|20"), (3, 20, "3|20")]
    tables = {
        "sound": (sound, [1, 2, 3, 4]),
        "repeated line, unknown order and seller": ([*sound, (1, 2, "1|2"), (5, 1, "5|1"), (2, 7, "2|7")], [1, 2, 3, 4, 9]),
        "repeated order": (sound, [1, 1, 2, 3, 9]),
        "without order or seller": ([*sound, (None, 1, "1|1"), (2, None, "2|x")], [1, 2, 3, None]),
        "empty": ([], []),
    }
    for name, (lines, orders) in tables.items():
        shop = commerce(spark, lines, orders)
        for change in (lambda nodes: nodes, torn):
            nodes, edges = graph.commerce_graph(*shop)
            want = sorted(map(str, graph.faults(change(nodes), edges).collect()))
            assert sorted(map(str, graph.commerce_faults(*shop, change).collect())) == want, name
            assert bool(want) == (name not in ("sound", "empty") or (name == "sound" and change is torn))


def test_sound_orders_move_a_row_for_each_line(spark):
    order, line, _, _ = commerce(spark, [(1, 1, "1|1"), (1, 2, "1|2"), (2, 1, "2|1"), (2, 1, "2|1")], [1, 2])
    assert [r.orderkey for r in graph.doubtful_orders(order, line, order).collect()] == [2]
    assert [r.orderkey for r in graph.doubtful_orders(order, line.dropDuplicates(), order.where("orderkey = 1")).collect()] == [2]
    assert graph.doubtful_orders(order, line.dropDuplicates(), order).count() == 0


def test_edges_that_events_add_are_counted_as_extended(spark):
    """Counts by sound and doubtful orders are those of the whole extended graph."""
    sound = [(1, 1, "1|1"), (1, 2, "1|2"), (2, 20, "2|20"), (3, 20, "3|20")]
    total = lambda *pairs: frame(spark, [(f"{a}:customer_total", f"{b}:customer_total") for a, b in pairs], "new_key string, old_key string")
    for lines, orders, pairs in ((sound, [1, 2, 3], [(2, 1), (3, 2), (3, 2)]), ([*sound, (1, 2, "1|2"), (5, 1, "5|1")], [1, 2, 2, 3, 4], [(2, 1), (4, 8)]), ([*sound, (None, 1, "1|1")], [1, 2, 3, None], [(2, 1)]), ([], [], [])):
        shop, superseded = commerce(spark, lines, orders), total(*pairs)
        found = {r.kind: (r.edges, r.missing) for r in traversal.event_edge_counts(*shop, superseded).collect()}
        event = lambda key: events.content_id(F.lit("financial-event-v1"), F.col(key))
        _, linked, missing = traversal.extend_with_events(*graph.commerce_graph(*shop), events.events_of(shop[3]), superseded.select(event("new_key").alias("new_id"), event("old_key").alias("old_id")))
        want = {"HAS_FINANCIAL_EVENT": 0, "EVENT_FOR_COMPONENT": 0, "EVENT_EVIDENCE": 0, "SUPERSEDES": 0}
        for r in linked.where("source_node_id like 'financial_event:%' or target_node_id like 'financial_event:%'").collect():
            want["EVENT_EVIDENCE" if r.relationship_type == "EVIDENCED_BY" else r.relationship_type] += 1
        assert found == {kind: (n, missing.count()) for kind, n in want.items()}


def test_rows_among_many_hashes_are_foretold_before_they_move(spark, monkeypatch):
    monkeypatch.setattr(keys, "MOST_HASHES", 2)
    rows = frame(spark, [(f"k{i % 50}", i) for i in range(200)] + [(None, 1)], "k string, v int")
    hashes = frame(spark, [(f"k{i}",) for i in (3, 7, 7, 11, 99)], "k string").select(F.xxhash64("k").alias("_h"))
    found = keys.among(rows, "k", hashes)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shape = plan(keys.among(rows, "k", hashes))
        # The bits are met below the exchange of the rows.
        assert shape.index("SortMergeJoin") < shape.index("hashpartitioning(_h") < shape.index("BroadcastHashJoin")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(tuple, found.collect())) == sorted((f"k{i % 50}", i) for i in range(200) if i % 50 in (3, 7, 11)) and found.columns == ["k", "v"]
