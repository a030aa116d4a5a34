from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyforge.functions.expressions import content_id, exact_median, nearest_rank, tolerance, unit_price
from tallyforge.operators import finance

SCHEMA = "orderkey int, component_key string, component_type string, amount decimal(18,2), currency string, source_precision int, role string"
MERCHANT, PLATFORM, SUMMARY = "zomato_merchant_invoice", "zomato_platform_fee_invoice", "zomato_order_summary"


def components(spark, rows):
    return spark.createDataFrame([(o, f"{i:03}", kind, Decimal(amount), "INR", 2, role) for i, (o, kind, amount, role) in enumerate(rows)], SCHEMA)


def test_document_closes(spark):
    rows = [(1, "item_gross", "100.00", ""), (1, "packing_charge", "10.00", ""), (1, "coupon_discount", "20.00", ""), (1, "invoice_total", "90.00", "")]
    rows += [(2, "item_gross", "100.00", ""), (2, "invoice_total", "100.03", "")]
    rows += [(3, "item_gross", "1.00", ""), (4, "invoice_total", "1.00", ""), (4, "customer_total", "1.00", ""), (4, "tax", "1.00", "")]
    rows += [(5, "item_gross", "5.00", ""), (5, "invoice_total", "0.00", "")]
    got = {r.orderkey: r for r in finance.reconcile_documents(components(spark, rows), ["orderkey"]).collect()}
    assert set(got) == {1, 2, 5}
    assert (got[1].expected_amount, got[1].calculated_amount, got[1].residual, got[1].status) == (Decimal(90), Decimal(90), Decimal(0), "exact")
    assert got[1].formula == "ITEM_GROSS + PACKING_CHARGE - COUPON_DISCOUNT = INVOICE_TOTAL" and got[1].explained_value_ratio == 1
    assert got[2].status == "within_rounding" and got[2].residual == Decimal("0.03")
    assert got[5].status == "conflicting" and got[5].explained_value_ratio == 0


def test_bundles(spark):
    rows = [(1, "item_gross", "400", MERCHANT), (1, "tax", "20", MERCHANT), (1, "platform_fee", "10", PLATFORM), (1, "customer_total", "430", SUMMARY)]
    rows += [(2, "item_gross", "400", MERCHANT), (2, "item_gross", "400", SUMMARY), (2, "customer_total", "400", SUMMARY)]
    rows += [(3, "item_gross", "300", MERCHANT), (3, "customer_total", "280", MERCHANT), (3, "membership_benefit", "50", PLATFORM)]
    rows += [(4, "item_gross", "5", MERCHANT)]
    rows += [(5, "item_gross", "5", MERCHANT), (5, "customer_total", "5", SUMMARY), (5, "invoice_total", "6", SUMMARY)]
    got = {r.orderkey: r for r in finance.reconcile_bundles(components(spark, rows)).collect()}
    assert (got[1].status, got[1].calculated_amount, got[1].residual, got[1].selected) == ("exact", Decimal(430), Decimal(0), 4)
    assert (got[2].status, got[2].calculated_amount, got[2].rejected) == ("exact", Decimal(400), 1)
    assert (got[3].status, got[3].calculated_amount, got[3].residual) == ("conflicting", Decimal(250), Decimal(30))
    assert (got[4].status, got[4].residual) == ("partial", None)
    assert (got[5].status, got[5].residual) == ("conflicting", None)


def test_authority(spark):
    pairs = [("item_gross", MERCHANT, 100), ("item_gross", SUMMARY, 60), ("item_gross", PLATFORM, 30), ("platform_fee", SUMMARY, 80), ("delivery_charge", MERCHANT, 40), ("customer_total", "swiggy_order_history_report", 95), ("refund", MERCHANT, 50)]
    frame = spark.createDataFrame(pairs, "k string, r string, want int")
    assert frame.where(finance.role_authority(F.col("k"), F.col("r")) != F.col("want")).count() == 0
    one = spark.range(1).select(finance.source_authority(F.lit("platform_service_fee"), F.lit("order_summary")).alias("a"), finance.source_authority(F.lit("x"), F.lit("y")).alias("b")).first()
    assert (one.a, one.b) == (Decimal("0.65"), Decimal("0.00"))


def test_component_types(spark):
    cases = [("charge", "order", "platform_fee", "platform_fee"), ("charge", "order", "x", "other_charge"), ("total", "order", "", "customer_total"), ("total", "item", "", "invoice_total"), ("benefit", "", "", "membership_benefit"), ("?", "", "", "unresolved")]
    frame = spark.createDataFrame(cases, "m string, s string, t string, want string")
    assert frame.where(finance.component_type(F.col("m"), F.col("s"), F.col("t")) != F.col("want")).count() == 0


def test_counterfactual(spark):
    rows = [(1, "item_gross", "300", ""), (1, "platform_fee", "12", ""), (1, "coupon_discount", "50", "")]
    frame = components(spark, rows)
    got = finance.counterfactual(frame, [("platform_fee", "replace", "0")], ["orderkey"]).first()
    assert (got.observed_total, got.simulated_total, got.difference) == (Decimal(262), Decimal(250), Decimal(-12))
    both = finance.counterfactual(frame, [("platform_fee", "replace", "10"), ("platform_fee", "scale", "0.5")], ["orderkey"]).first()
    assert both.simulated_total == Decimal(265)
    assert finance.unobserved(frame, ["refund"], ["orderkey"]).count() == 1


def test_sum_counts_a_component_once_and_refuses_two_values(spark):
    rows = spark.createDataFrame([("a", Decimal("10.10"), "INR"), ("a", Decimal("10.10"), "INR"), ("b", Decimal("0.20"), "INR"), (None, None, None)], "component_key string, amount decimal(18,2), currency string")
    got = finance.distinct_sum(rows, []).first()
    assert (got.components, got.total) == (2, Decimal("10.30"))
    assert finance.conflicting_components(rows).count() == 0
    two = rows.unionByName(spark.createDataFrame([("a", Decimal("9"), "INR")], rows.schema))
    with pytest.raises(finance.RuleBroken):
        finance.require_none(finance.conflicting_components(two), "one amount")
    assert finance.mixed_currency(two.withColumn("g", F.lit(1)), ["g"]).count() == 0


def test_expressions(spark):
    import uuid

    names = ["a", "item:é:ß", "x" * 100]
    frame = spark.createDataFrame([(x,) for x in names], "v string").select("v", content_id("v").alias("id"))
    assert all(r.id == str(uuid.uuid5(uuid.NAMESPACE_URL, r.v)) for r in frame.collect())
    one = spark.range(1).select(
        exact_median(F.array(F.lit(Decimal("1.10")), F.lit(Decimal("3.30")), F.lit(Decimal("2.20")))).alias("odd"),
        exact_median(F.array(F.lit(1.0), F.lit(4.0))).alias("even"),
        nearest_rank(F.array(*[F.lit(x) for x in (10, 20, 30, 100)]), 0.5).alias("p50"),
        nearest_rank(F.array(*[F.lit(x) for x in (10, 20, 30, 100)]), 0.95).alias("p95"),
        tolerance(F.lit(2)).alias("t"),
        unit_price(F.lit(Decimal("10.00")), F.lit(Decimal("3.00"))).alias("u"),
    ).first()
    assert (one.odd, one.even, one.p50, one.p95, one.t, one.u) == (Decimal("2.20"), 2.5, 20, 100, Decimal("0.01"), Decimal("3.33"))


def test_sums_of_components_that_repeat(spark):
    """Repeated components count once, by their greatest amount; those that come once move by no key."""
    rows = components(spark, [(1, "tax", "1", ""), (1, "tax", "2", ""), (2, "tax", "4", ""), (2, "item_gross", "8", "")])
    plan = finance.distinct_sum(rows, ["orderkey"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(orderkey" in plan and "component_key" not in plan.split("Exchange hashpartitioning")[1].split("\n")[0]
    again = rows.unionByName(rows.where("amount = 1").withColumn("amount", F.lit(Decimal("1.50")).cast("decimal(18,2)"))).unionByName(rows.withColumn("currency", F.lit(None).cast("string")))
    got = {tuple(r) for r in finance.distinct_sum(again, ["orderkey"]).collect()}
    assert got == {(1, "INR", 2, Decimal("3.50")), (2, "INR", 2, Decimal("12.00"))}
    assert {tuple(r) for r in finance.distinct_sum(again, []).collect()} == {("INR", 4, Decimal("15.50"))}
