from datetime import datetime
from decimal import Decimal

import pytest

from tallyforge.operators import events as ev
from tallyforge.operators import graph, resolution


def at(day):
    return datetime(2024, 1, day)


EVENTS = "event_id string, event_type string, orderkey int, currency string, valid_from timestamp, valid_to timestamp, observed_at timestamp"


def test_supersession_rules(spark):
    events = spark.createDataFrame(
        [("a", "x", 1, "INR", at(1), at(2), at(1)), ("b", "x", 1, "INR", at(2), None, at(3)), ("c", "y", 1, "INR", at(2), None, at(3)), ("d", "x", 1, "INR", at(5), None, at(3)), ("e", "x", 1, "INR", at(2), None, at(1)), ("f", "x", 2, "INR", at(2), None, at(3))], EVENTS
    )
    links = lambda *rows: spark.createDataFrame([(n, o, at(9)) for n, o in rows], "new_id string, old_id string, decided_at timestamp")
    fault = lambda *rows: {r.fault for r in ev.supersession_faults(links(*rows), events).collect()}
    assert fault(("b", "a")) == set()
    assert fault(("c", "a")) == {"type_differs"} and fault(("d", "a")) == {"validity_not_contiguous"}
    assert fault(("e", "a")) == {"not_observed_later"} and fault(("f", "a")) == {"order_or_currency_differs"}
    assert fault(("b", "a"), ("d", "a")) == {"superseded_twice"} and fault(("z", "a")) == {"unknown_event"}
    assert [r.event_id for r in ev.current_events(events, links(("b", "a"))).orderBy("event_id").collect()] == ["b", "c", "d", "e", "f"]
    assert ev.cyclic(links(("b", "a"), ("c", "b"))).count() == 0
    assert ev.cyclic(links(("b", "a"), ("a", "b"), ("c", "b"))).count() == 2


def components(spark):
    rows = [("k1", 1, 7, "item_gross", Decimal("10"), "s1"), ("k2", 1, 7, "tax", Decimal("1"), "s1"), ("k3", 2, 8, "refund", Decimal("2"), "s2")]
    return spark.createDataFrame([(*r, "INR") for r in rows], "component_key string, orderkey int, suppkey int, component_type string, amount decimal(18,2), source_key string, currency string")


def test_events_and_rollup_do_not_depend_on_order(spark):
    sources = spark.createDataFrame([(1, at(1)), (2, at(2))], "orderkey int, occurred_at timestamp")
    entities = spark.createDataFrame([(1, "merchant:7"), (2, "merchant:8"), (2, "merchant:8")], "orderkey int, entity_id string")
    rows = lambda frame: sorted(map(tuple, ev.rollup(ev.financial_events(frame, sources), entities).collect()))
    assert rows(components(spark)) == rows(components(spark).orderBy("amount").repartition(3))
    levels = ev.rollup(ev.financial_events(components(spark), sources), entities).groupBy("level").count().collect()
    assert {r.level: r["count"] for r in levels} == {"evidence_cell": 3, "event": 3, "order_bundle": 2, "entity": 2, "year_window": 1}
    events = ev.financial_events(components(spark), sources)
    assert {r.component_key: r.event_type for r in events.collect()} == {"k1": "purchase_asserted", "k2": "tax_assessed", "k3": "refund_asserted"}
    assert ev.uncovered(components(spark), events).count() == 0
    assert ev.uncovered(components(spark), events.unionByName(events.limit(1))).count() == 1
    assert ev.untimed(ev.financial_events(components(spark), sources.limit(0))).count() == 3


def test_closure(spark):
    nodes = spark.createDataFrame([("a", "Order"), ("b", "Merchant"), ("b", "Merchant")], "node_id string, label string")
    edges = spark.createDataFrame([("r1", "ORDERED_FROM", "a", "b"), ("r1", "ORDERED_FROM", "a", "b"), ("r2", "X", "a", "z")], "relationship_id string, relationship_type string, source_node_id string, target_node_id string")
    assert {(r.fault, r.id) for r in graph.faults(nodes, edges).collect()} == {("duplicate_node", "b"), ("duplicate_relationship", "r1"), ("missing_target", "r2")}
    start = nodes.where("label = 'Order'").select("node_id")
    assert graph.neighbours(edges.distinct(), start, ("ORDERED_FROM",)).count() == 1
    with pytest.raises(ValueError):
        graph.neighbours(edges, start, ("X",))
    shown, kept = graph.visible(nodes.distinct(), edges.distinct(), ["Order", "Merchant"], ["ORDERED_FROM", "X"])
    assert (shown.count(), kept.count()) == (2, 1)
    assert {r.node_id for r in graph.focus(edges, "a").collect()} == {"b", "z"}
    again = graph.upsert(nodes.distinct(), nodes.distinct(), "node_id")
    assert again.count() == 2


def test_resolution(spark):
    evidence = [("p", "m1", "email", "1"), ("p", "m2", "history_row", "1"), ("p", "m2", "history_row", "2"), ("p", "m3", "email", None)]
    frame = spark.createDataFrame(evidence, "platform string, message_id string, kind string, order_id string")
    for rows in (frame, frame.orderBy("message_id", ascending=False)):
        got = resolution.order_counts(rows).first()
        assert (got.resolved, got.provisional, got.total, got.history_duplicates) == (2, 1, 3, 1)
    assert {(r.status, r.evidence) for r in resolution.resolve_orders(frame).collect()} == {("resolved", 2), ("resolved", 1), ("provisional", 1)}
    names = spark.createDataFrame([(1, "Zed"), (1, "Zed"), (1, "abc"), (1, "ABC")], "k int, n string")
    assert resolution.preferred_names(names, ["k"], "n").first().display_name == "Zed"
    assert resolution.preferred_names(names, ["k"], "n", "first_alias").first().display_name == "ABC"
    items = spark.createDataFrame([(1, "Dosa"), (2, "dosa "), (3, "Dosa")], "orderkey int, raw_name string")
    merchants = spark.createDataFrame([(1, 10), (2, 11), (3, 10)], "orderkey int, merchant int")
    assert resolution.resolve_items(items, merchants).count() == 2
    pairs = resolution.overlapping(spark.createDataFrame([(1, ["a", "b"])], "x int, s array<string>"), spark.createDataFrame([(5, ["b", "b"]), (6, ["c"])], "y int, s array<string>"), "x", "y", "s")
    assert [tuple(r) for r in pairs.collect()] == [(1, 5)]
