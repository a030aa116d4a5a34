"""Price indices, spending decompositions, platform economics and time-series signals."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.expressions import MONEY, exact_median, ratio

SUM = "decimal(38,2)"


def basket_groups(basket: DataFrame, keys: list[str], comparable_only: bool) -> DataFrame:
    """Quantity and spend by comparable group.

    Expects comparable_group, reviewed, observation_id, quantity, spend. Unreviewed observations
    are left out, or stand alone as `unmatched:<observation_id>`.
    """
    reviewed = F.col("reviewed") & F.col("comparable_group").isNotNull()
    name = F.when(reviewed, F.col("comparable_group")).otherwise(F.concat(F.lit("unmatched:"), F.col("observation_id").cast("string")))
    rows = basket.where(reviewed) if comparable_only else basket
    return rows.withColumn("group", name).groupBy(*keys, "group").agg(F.sum("quantity").cast(SUM).alias("quantity"), F.sum("spend").cast(SUM).alias("spend"))


def _paired(base: DataFrame, current: DataFrame, keys: list[str], how: str) -> DataFrame:
    left = base.select(*keys, "group", F.col("quantity").alias("q0"), F.col("spend").alias("s0"))
    right = current.select(*keys, "group", F.col("quantity").alias("q1"), F.col("spend").alias("s1"))
    return left.join(right, [*keys, "group"], how)


def price_index(base: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Laspeyres index of the matched groups (base quantities at current unit prices), with coverage and, beside it, Paasche and Fisher.

    Expects frames of `basket_groups(..., comparable_only=True)`; series without a matched group have no row.
    """
    repriced = F.col("q0").cast("double") * F.col("s1").cast("double") / F.col("q1").cast("double")
    old_cost = F.col("q1").cast("double") * F.col("s0").cast("double") / F.col("q0").cast("double")
    # One outer join gives the matched sums and the eligible base cost at once.
    both = F.col("s0").isNotNull() & F.col("s1").isNotNull()
    found = _paired(base, current, keys, "full_outer").groupBy(*keys).agg(
        F.count_if(both).alias("matched_groups"),
        F.sum(F.when(both, F.col("s0"))).cast(SUM).alias("base_basket_cost"),
        F.sum(F.when(both, repriced)).alias("repriced"),
        F.sum(F.when(both, F.col("s1").cast("double"))).alias("current_cost"),
        F.sum(F.when(both, old_cost)).alias("old_cost"),
        F.sum("s0").cast(SUM).alias("eligible"),
    )
    found = found.where("matched_groups > 0 and base_basket_cost > 0")
    laspeyres, paasche = ratio(F.col("repriced"), F.col("base_basket_cost")) * 100, ratio(F.col("current_cost"), F.col("old_cost")) * 100
    return found.select(
        *keys,
        "matched_groups",
        "base_basket_cost",
        F.round("repriced", 2).alias("repriced_basket_cost"),
        F.round(laspeyres, 6).alias("index_value"),
        F.round(paasche, 6).alias("paasche"),
        F.round(F.sqrt(laspeyres * paasche), 6).alias("fisher"),
        F.round(ratio(F.col("base_basket_cost"), F.col("eligible")), 6).alias("coverage_ratio"),
    )


#: Quantities of a group in a decomposition: with spend as MONEY, a product fits 38 digits and its quotient keeps eight places.
QUANTITY = "decimal(13,2)"


def decompose_spending(base: DataFrame, current: DataFrame, base_totals: DataFrame, current_totals: DataFrame, keys: list[str]) -> DataFrame:
    """Change of the observed total, split into effects that sum to it exactly.

    Baskets are frames of `basket_groups(..., comparable_only=False)`; totals have fees, taxes,
    discounts, benefits and observed_total. A group's spend at the other period's price is rounded to eight
    places once and enters all three effects alike, so they close; unit prices are never rounded.
    """
    prices = _paired(base, current, keys, "full_outer")
    s0, s1, q0, q1 = (F.col(x).cast(kind) for x, kind in (("s0", MONEY), ("s1", MONEY), ("q0", QUANTITY), ("q1", QUANTITY)))
    # Old quantities at new prices, and new quantities at old prices.
    repriced, old_cost = s1 * q0 / q1, s0 * q1 / q0
    both = F.col("s0").isNotNull() & F.col("s1").isNotNull()
    part = lambda x: F.coalesce(F.sum(F.when(both, x.cast("decimal(38,8)"))), F.lit(0)).cast("decimal(38,8)")
    mix = F.when(F.col("s0").isNull(), F.col("s1")).when(F.col("s1").isNull(), -F.col("s0"))
    effects = prices.groupBy(*keys).agg(
        part(repriced - s0).alias("price_effect"),
        part(old_cost - s0).alias("quantity_effect"),
        part(s1 + s0 - repriced - old_cost).alias("interaction_effect"),
        F.coalesce(F.sum(mix), F.lit(0)).cast(SUM).alias("item_mix_effect"),
    )
    names = ("fees", "taxes", "discounts", "benefits", "observed_total")
    old = base_totals.select(*keys, *[F.col(x).alias(f"old_{x}") for x in names])
    both_totals = old.join(current_totals.select(*keys, *names), keys)
    change = lambda x: (F.col(x) - F.col(f"old_{x}")).cast(SUM)
    found = effects.join(both_totals, keys).withColumns(
        {
            "fee_effect": change("fees"),
            "tax_effect": change("taxes"),
            "discount_effect": -change("discounts"),
            "membership_effect": -change("benefits"),
            "observed_change": change("observed_total"),
        }
    )
    parts = ("price_effect", "quantity_effect", "interaction_effect", "item_mix_effect", "fee_effect", "tax_effect", "discount_effect", "membership_effect")
    explained = sum((F.col(x).cast("decimal(38,8)") for x in parts[1:]), F.col(parts[0]).cast("decimal(38,8)"))
    residual = (F.col("observed_change").cast("decimal(38,8)") - explained).cast("decimal(38,8)")
    return found.select(*keys, "observed_change", *parts, residual.alias("unexplained_residual"))


def platform_economics(periods: DataFrame, keys: list[str]) -> DataFrame:
    """Fee burden, discount capture, membership value, return and break-even orders of each period.

    Expects gross, fees, discounts, benefits, cost, observed_total, orders. Shares are null where their base isn't positive.
    """
    positive = lambda top, base: F.when(base > 0, ratio(top, base))
    saved, net = F.col("discounts") + F.col("benefits"), F.col("benefits") - F.col("cost")
    average = F.col("benefits").cast("double") / F.col("orders")
    even = F.when(F.col("cost") == 0, 0).when((F.col("cost") > 0) & (average > 0), F.ceil(F.round(F.col("cost").cast("double") / average, 9)))
    return periods.select(
        *keys,
        F.round(positive(F.col("fees"), F.col("observed_total")), 6).alias("fee_burden"),
        F.round(positive(saved, F.col("gross")), 6).alias("discount_capture"),
        net.cast(SUM).alias("membership_net_value"),
        F.round(positive(net, F.col("cost")), 6).alias("membership_roi"),
        even.cast("bigint").alias("break_even_orders"),
    )


def _in_time(keys: list[str], time: str = "occurred_at") -> Window:
    return Window.partitionBy(*keys).orderBy(time)


def repeated_times(series: DataFrame, keys: list[str], time: str = "occurred_at") -> DataFrame:
    """Series that have two observations at one time; signals need one at most."""
    return series.groupBy(*keys, time).count().where("count > 1")


def _midpoint(now: Column, before: Column) -> Column:
    return (now - before) / ((now + before) / 2)


def elasticity(series: DataFrame, keys: list[str]) -> DataFrame:
    """Median midpoint elasticity of quantity on price: series of four observations and three price changes or more.

    Expects occurred_at, price, quantity (decimals or doubles) of series that are short by nature, such as one item's months.
    """
    order = _in_time(keys)
    price, quantity = F.col("price").cast("double"), F.col("quantity").cast("double")
    moves = series.withColumns({"dp": _midpoint(price, F.lag(price).over(order)), "dq": _midpoint(quantity, F.lag(quantity).over(order))})
    found = moves.groupBy(*keys).agg(F.count("*").alias("observations"), F.collect_list(F.when(F.col("dp") != 0, F.col("dq") / F.col("dp"))).alias("moves"))
    found = found.where((F.col("observations") >= 4) & (F.size("moves") >= 3))
    return found.select(*keys, F.round(exact_median(F.col("moves")), 6).alias("elasticity"), F.size("moves").cast("bigint").alias("transitions"))


def substitution(series: DataFrame, keys: list[str]) -> DataFrame:
    """Share of focal-price rises at which focal quantity fell and the alternative's rose: four observations and one rise or more.

    Expects occurred_at, focal_price, focal_quantity, other_quantity.
    """
    order = _in_time(keys)
    before = lambda x: F.lag(x).over(order)
    rose = F.col("focal_price") > before("focal_price")
    moved = series.withColumns({"rise": rose, "switch": rose & (F.col("focal_quantity") < before("focal_quantity")) & (F.col("other_quantity") > before("other_quantity"))})
    found = moved.groupBy(*keys).agg(F.count("*").alias("observations"), F.count_if("rise").alias("rises"), F.count_if("switch").alias("switches"))
    found = found.where("observations >= 4 and rises >= 1")
    return found.select(*keys, F.round(ratio(F.col("switches"), F.col("rises")), 6).alias("score"), F.col("rises").alias("qualifying"))


def anomalies(series: DataFrame, keys: list[str], threshold: float = 3.5, segment: int = 3) -> DataFrame:
    """Median, median absolute deviation and the places (from 0) more than `threshold` robust deviations off; none if the deviation is 0.

    Expects occurred_at and value. Series are bounded by nature (days, months); shorter ones than two segments have no row.
    """
    values = series.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("occurred_at", F.col("value").cast("double").alias("value")))), lambda x: x["value"]).alias("values"))
    found = values.where(F.size("values") >= 2 * segment).withColumn("median", exact_median(F.col("values")))
    found = found.withColumn("deviation", exact_median(F.transform("values", lambda x: F.abs(x - F.col("median")))))
    places = F.filter(F.sequence(F.lit(0), F.size("values") - 1), lambda i: F.abs(F.get("values", i) - F.col("median")) > threshold * 1.4826 * F.col("deviation"))
    return found.select(
        *keys, "values", F.round("median", 6).alias("median"), F.round("deviation", 6).alias("deviation"), F.when(F.col("deviation") > 0, places).otherwise(F.array().cast("array<int>")).alias("anomalies")
    )


def running_medians(values: list[float]) -> list[float]:
    """The median of each prefix, by a heap of the lower half and one of the upper half."""
    low, high, out = [], [], []
    for x in values:
        heapq.heappush(low, -heapq.heappushpop(high, x))
        if len(low) > len(high) + 1:
            heapq.heappush(high, -heapq.heappop(low))
        out.append(-low[0] if len(low) > len(high) else (-low[0] + high[0]) / 2)
    return out


def change_points(series: DataFrame, keys: list[str], segment: int = 3, threshold: float = 0.5) -> DataFrame:
    """Splits at which the median after differs from the one before by `threshold` of it or more (from 0: by anything).

    Medians of all prefixes and of all suffixes come from one run each, so a series of n takes n log n steps.
    """

    @F.udf("array<int>", useArrow=True)
    def splits(values):
        values = list(values)
        before, after = running_medians(values), running_medians(values[::-1])[::-1]
        changed = lambda a, b: b != 0 if a == 0 else abs(b - a) / abs(a) >= threshold
        return [i for i in range(segment, len(values) - segment + 1) if changed(before[i - 1], after[i])]

    return anomalies(series, keys, segment=segment).select(*keys, splits("values").alias("change_points"))
