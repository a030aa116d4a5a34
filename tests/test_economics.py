from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from tallyforge.operators import economics


def basket(spark, rows):
    return spark.createDataFrame([(1, g, g is not None, f"o{i}", Decimal(q), Decimal(p) * Decimal(q)) for i, (g, p, q) in enumerate(rows)], "k int, comparable_group string, reviewed boolean, observation_id string, quantity decimal(18,2), spend decimal(18,2)")


@pytest.fixture
def baskets(spark):
    return basket(spark, [("meal:a", 100, 2), ("meal:b", 50, 1)]), basket(spark, [("meal:a", 120, 3), ("meal:c", 80, 1)])


def test_price_index(baskets):
    base, current = (economics.basket_groups(x, ["k"], True) for x in baskets)
    got = economics.price_index(base, current, ["k"]).first()
    assert (got.index_value, got.base_basket_cost, got.repriced_basket_cost, got.coverage_ratio, got.matched_groups) == (120, Decimal(200), 240, 0.8, 1)
    assert got.paasche == 120 and got.fisher == 120
    assert economics.price_index(base.limit(0), current, ["k"]).count() == 0


def test_decomposition_closes(spark, baskets):
    base, current = (economics.basket_groups(x, ["k"], False) for x in baskets)
    schema = "k int, fees decimal(18,2), taxes decimal(18,2), discounts decimal(18,2), benefits decimal(18,2), observed_total decimal(18,2)"
    old = spark.createDataFrame([(1, *map(Decimal, (10, 5, 20, 0, 245)))], schema)
    new = spark.createDataFrame([(1, *map(Decimal, (15, 6, 30, 10, 421)))], schema)
    got = economics.decompose_spending(base, current, old, new, ["k"]).first()
    effects = [got[x] for x in ("price_effect", "quantity_effect", "interaction_effect", "item_mix_effect", "fee_effect", "tax_effect", "discount_effect", "membership_effect", "unexplained_residual")]
    assert effects == [40, 100, 20, 30, 5, 1, -10, -10, 0] and sum(effects) == got.observed_change == 176


def test_decomposition_of_prices_without_an_end(spark):
    basket = lambda *row: spark.createDataFrame([(1, "a", *map(Decimal, row))], "k int, `group` string, quantity decimal(38,2), spend decimal(38,2)")
    schema = "k int, fees decimal(18,2), taxes decimal(18,2), discounts decimal(18,2), benefits decimal(18,2), observed_total decimal(18,2)"
    old = spark.createDataFrame([(1, *map(Decimal, (0, 0, 0, 0, 100)))], schema)
    new = spark.createDataFrame([(1, *map(Decimal, (0, 0, 0, 0, 100_000_000)))], schema)
    got = economics.decompose_spending(basket(3, 100), basket(3_000_000, 100_000_000), old, new, ["k"]).first()
    # Old and new price are both 100 / 3.
    assert (got.price_effect, got.quantity_effect, got.interaction_effect, got.unexplained_residual) == (0, 99_999_900, 0, 0)


def test_platform_economics(spark):
    schema = "k int, gross decimal(18,2), fees decimal(18,2), discounts decimal(18,2), benefits decimal(18,2), cost decimal(18,2), observed_total decimal(18,2), orders int"
    frame = spark.createDataFrame([(1, *map(Decimal, (440, 15, 30, 10, 100, 421)), 2), (2, *map(Decimal, (0, 1, 0, 0, 0, 0)), 1), (3, *map(Decimal, (1, 1, 0, 0, 5, 1)), 1)], schema)
    got = {r.k: r for r in economics.platform_economics(frame, ["k"]).collect()}
    assert (got[1].fee_burden, got[1].discount_capture, got[1].membership_net_value, got[1].membership_roi, got[1].break_even_orders) == (round(15 / 421, 6), round(40 / 440, 6), -90, -0.9, 20)
    assert (got[2].fee_burden, got[2].discount_capture, got[2].membership_roi, got[2].break_even_orders) == (None, None, None, 0)
    assert got[3].break_even_orders is None


def series(spark, rows, names):
    begin = datetime(2024, 1, 1)
    return spark.createDataFrame([(1, begin + timedelta(days=i), *map(float, r)) for i, r in enumerate(rows)], f"k int, occurred_at timestamp, {names}")


def test_elasticity(spark):
    frame = series(spark, [(100, 10), (110, 9), (120, 8), (130, 7)], "price double, quantity double")
    got = economics.elasticity(frame, ["k"]).first()
    assert got.transitions == 3 and got.elasticity == pytest.approx(-1.352941, abs=1e-6)
    assert economics.elasticity(frame.limit(3), ["k"]).count() == 0
    assert economics.repeated_times(frame, ["k"]).count() == 0


def test_substitution(spark):
    frame = series(spark, [(100, 10, 2), (110, 9, 3), (120, 8, 4), (130, 7, 5)], "focal_price double, focal_quantity double, other_quantity double")
    got = economics.substitution(frame, ["k"]).first()
    assert (got.score, got.qualifying) == (1, 3)


def test_anomalies_and_changes(spark):
    frame = series(spark, [(x,) for x in (10, 10, 11, 10, 50, 51, 50, 52)], "value double")
    got = economics.anomalies(frame, ["k"]).first()
    assert (got["median"], got.deviation, got.anomalies) == (30.5, 20.5, [])
    assert economics.change_points(frame, ["k"]).first().change_points == [3, 4, 5]
    spike = series(spark, [(x,) for x in (10, 11, 10, 12, 11, 10, 90)], "value double")
    assert economics.anomalies(spike, ["k"]).first().anomalies == [6]
    assert economics.anomalies(frame.limit(5), ["k"]).count() == 0
