"""Money components: naming, reconciliation of documents and of bundles, exact sums, counterfactuals.

Every operator takes and returns DataFrames. Inputs that break a rule (mixed currency, one id with
two values) are returned by a `*_violations` query, and `require_none` turns them into an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.expressions import MONEY, tolerance
from tallyforge.functions.vocabulary import DISCOUNTS, NOT_CALCULATED, NOT_CALCULATED_IN_BUNDLES, OTHER_AUTHORITY, ROLE_AUTHORITY, SOURCE_AUTHORITY, TOTALS
from tallyforge.operators.keys import divided

SUM = "decimal(38,2)"


class RuleBroken(ValueError):
    """Rows break a rule that a result depends on."""


def require_none(violations: DataFrame, rule: str) -> None:
    """Raises if there is any row; reads one."""
    if rows := violations.limit(1).collect():
        raise RuleBroken(f"{rule}: {rows[0].asDict()}")


def component_type(meaning: Column, scope: Column, source_type: Column) -> Column:
    """The canonical type of an interpreted amount."""
    charges = ("packing_charge", "handling_fee", "delivery_charge", "platform_fee")
    same = ("item_gross", "item_net", "subtotal", "tax", "payment_assertion", "refund")
    return (
        F.when(meaning.isin(*same), meaning)
        .when(meaning == "charge", F.when(source_type.isin(*charges), source_type).otherwise("other_charge"))
        .when(meaning == "discount", "coupon_discount")
        .when(meaning == "benefit", "membership_benefit")
        .when(meaning == "total", F.when(scope == "order", "customer_total").otherwise("invoice_total"))
        .otherwise("unresolved")
    )


def signed(kind: Column, amount: Column) -> Column:
    """The amount as it moves what a customer pays: discounts are negative."""
    return F.when(kind.isin(*DISCOUNTS), -amount).otherwise(amount)


def status_of(residual: Column, allowed: Column) -> Column:
    """exact, within_source_precision, within_rounding or conflicting."""
    size = F.abs(residual)
    return (
        F.when(residual == 0, "exact").when(size <= allowed, "within_source_precision").when(size <= F.lit("0.05").cast(MONEY), "within_rounding").otherwise("conflicting")
    )


def explained_share(expected: Column, residual: Column) -> Column:
    """How much of the expected amount the parts explain, 0 to 1."""
    part = 1 - F.abs(residual).cast("double") / F.abs(expected).cast("double")
    return F.when((expected == 0) & (residual == 0), 1.0).when(expected != 0, F.greatest(F.lit(0.0), part)).otherwise(0.0)


def _formula(positive: Column, negative: Column, total: Column) -> Column:
    minus = F.when(F.size(negative) > 0, F.concat(F.lit(" - "), F.array_join(negative, " - "))).otherwise("")
    return F.concat(F.array_join(positive, " + "), minus, F.lit(" = "), total)


def reconcile_documents(components: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each group of `keys` with exactly one total, two components and a calculable one.

    Expects component_key, component_type, amount, currency, source_precision. The sums combine
    before the shuffle; only type names travel as lists, in the order of component keys.
    """
    kind, amount = F.col("component_type"), F.col("amount")
    total, calculated = kind.isin(*TOTALS), ~kind.isin(*NOT_CALCULATED)
    names = lambda those: F.transform(F.array_sort(F.collect_list(F.when(those, F.struct("component_key", F.upper(kind).alias("name"))))), lambda x: x["name"])
    groups = components.groupBy(*keys).agg(
        F.count("*").alias("components"),
        F.count_if(total).alias("totals"),
        F.count_if(calculated).alias("parts"),
        F.max(F.when(total, amount)).alias("expected"),
        F.max(F.when(total, F.upper(kind))).alias("total_name"),
        F.sum(F.when(calculated, signed(kind, amount))).cast(SUM).alias("calculated"),
        F.max("source_precision").alias("precision"),
        names(calculated & ~kind.isin(*DISCOUNTS)).alias("plus"),
        names(calculated & kind.isin(*DISCOUNTS)).alias("minus"),
    )
    found = groups.where("components >= 2 and totals = 1 and parts >= 1")
    found = found.withColumn("residual", (F.col("expected") - F.col("calculated")).cast(SUM)).withColumn("tolerance", tolerance(F.col("precision")))
    return found.select(
        *keys,
        "components",
        _formula(F.col("plus"), F.col("minus"), F.col("total_name")).alias("formula"),
        F.col("expected").alias("expected_amount"),
        F.col("calculated").alias("calculated_amount"),
        "residual",
        "tolerance",
        explained_share(F.col("expected"), F.col("residual")).alias("explained_value_ratio"),
        status_of(F.col("residual"), F.col("tolerance")).alias("status"),
    )


def mixed_currency(components: DataFrame, keys: list[str]) -> DataFrame:
    """Groups whose components have more than one currency."""
    return components.groupBy(*keys).agg(F.min("currency").alias("one"), F.max("currency").alias("other")).where("one <> other")


def role_authority(kind: Column, role: Column) -> Column:
    """How much a document role's word counts on a component type."""
    score = None
    for kinds, ranked, other in ROLE_AUTHORITY:
        inner = None
        for roles, value in ranked:
            inner = F.when(role.isin(*roles), value) if inner is None else inner.when(role.isin(*roles), value)
        score = F.when(kind.isin(*kinds), inner.otherwise(other)) if score is None else score.when(kind.isin(*kinds), inner.otherwise(other))
    return score.otherwise(OTHER_AUTHORITY)


def source_authority(family: Column, source: Column) -> Column:
    """Authority of a source kind for a family of facts; 0 for unknown pairs."""
    table = F.create_map(*[F.lit(x) for family_, row in SOURCE_AUTHORITY.items() for kind, score in row.items() for x in (f"{family_}|{kind}", score)])
    return F.coalesce(F.try_element_at(table, F.concat_ws("|", family, source)), F.lit("0")).cast("decimal(3,2)")


def reconcile_bundles(components: DataFrame, order: str = "orderkey") -> DataFrame:
    """One row for each order: what its most authoritative documents say, and whether they close.

    A family is a component type, all totals being one. Of each family the components of highest
    authority are selected; of several equally authoritative totals one is, if they agree on the
    amount, and none if not. Without an agreed total or a calculable component nothing is calculated:
    `conflicting` if there are totals that disagree, else `partial`. Three aggregations, each of which
    combines before it shuffles; components that come dealt by order (`domain.dealt_components`) aren't
    shuffled at all. Nothing is joined.
    """
    kind, amount = F.col("component_type"), F.col("amount")
    family = F.when(kind.isin(*TOTALS), "total").otherwise(kind)
    levels = components.groupBy(order, family.alias("family"), role_authority(kind, F.col("role")).alias("authority")).agg(
        F.count("*").alias("n"), F.sum(signed(kind, amount)).cast(SUM).alias("sum"), F.min("amount").alias("least"), F.max("amount").alias("most"), F.max("source_precision").alias("precision")
    )
    families = levels.groupBy(order, "family").agg(F.max(F.struct("authority", "n", "sum", "least", "most")).alias("top"), F.sum("n").alias("n"), F.max("precision").alias("precision"))
    is_total, agreed = F.col("family") == "total", F.col("top.least") == F.col("top.most")
    selected = F.when(is_total, F.coalesce(agreed, F.lit(False)).cast("bigint")).when(F.col("family").isin(*NOT_CALCULATED_IN_BUNDLES), 0).otherwise(F.col("top.n"))
    part = ~is_total & (selected > 0)
    groups = families.groupBy(order).agg(
        F.sum(selected).alias("selected"),
        F.sum(F.col("n") - selected).alias("rejected"),
        F.sum(F.when(is_total, F.col("n")).otherwise(0)).alias("totals"),
        F.max(F.when(is_total & agreed, F.col("top.least"))).alias("total"),
        F.sum(F.when(part, selected).otherwise(0)).alias("parts"),
        F.sum(F.when(part, F.col("top.sum"))).cast(SUM).alias("sum"),
        F.max("precision").alias("precision"),
    )
    closes = F.col("total").isNotNull() & (F.col("parts") > 0)
    groups = groups.withColumns({"expected_amount": F.when(closes, F.col("total")), "calculated_amount": F.when(closes, F.col("sum"))})
    groups = groups.withColumn("residual", (F.col("expected_amount") - F.col("calculated_amount")).cast(SUM))
    without = F.when((F.col("totals") > 0) & F.col("total").isNull(), "conflicting").otherwise("partial")
    return groups.select(
        order, "selected", "rejected", "expected_amount", "calculated_amount", "residual", F.when(closes, status_of(F.col("residual"), tolerance(F.col("precision")))).otherwise(without).alias("status")
    )


def distinct_sum(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Exact sums over components counted once each, however often evidence repeats them: keys, currency, components, total.

    Most components come once: they stay where they are, and only those that may repeat meet by their keys.
    """
    told = [*keys, "component_key", "currency"]
    once, several = divided(rows.where("component_key is not null and currency is not null").select(*told, "amount"), *told)
    if several is not None:
        once = once.unionByName(several.groupBy(*told).agg(F.max("amount").alias("amount")))
    return once.groupBy(*keys, "currency").agg(F.count("*").alias("components"), F.sum("amount").cast(SUM).alias("total"))


def conflicting_components(rows: DataFrame) -> DataFrame:
    """Component ids that come with more than one amount or currency."""
    values = rows.where("component_key is not null").groupBy("component_key").agg(
        F.min("amount").alias("low"), F.max("amount").alias("high"), F.min("currency").alias("one"), F.max("currency").alias("other")
    )
    return values.where("low <> high or one <> other")


def counterfactual(components: DataFrame, interventions: list[tuple[str, str, str]], keys: list[str]) -> DataFrame:
    """Observed and simulated totals if component types had other amounts.

    `interventions` are (type, "replace" or "scale", number), applied in order: a replacement sets a
    group's amount of that type, a scale multiplies it by 1 + number. Expects one amount for each
    group and type; a type that a group lacks is left out of it (see `unobserved`).
    """
    amount = F.col("amount").cast("decimal(38,8)")
    for kind, how, number in interventions:
        value = F.lit(number).cast("decimal(18,4)")
        changed = value.cast("decimal(38,8)") if how == "replace" else (amount * (1 + value)).cast("decimal(38,8)")
        amount = F.when(F.col("component_type") == kind, changed).otherwise(amount)
    kind = F.col("component_type")
    return components.groupBy(*keys).agg(
        F.sum(signed(kind, F.col("amount"))).cast(SUM).alias("observed_total"), F.sum(signed(kind, amount)).cast("decimal(38,8)").alias("simulated_total")
    ).withColumn("difference", (F.col("simulated_total") - F.col("observed_total")).cast("decimal(38,8)"))


def unobserved(components: DataFrame, kinds: list[str], keys: list[str]) -> DataFrame:
    """Groups that lack one of the component types."""
    return components.groupBy(*keys).agg(*[F.max(F.col("component_type") == x).alias(x) for x in kinds]).where(" or ".join(f"not {x}" for x in kinds))


def latest_prices(observations: DataFrame, keys: list[str]) -> DataFrame:
    """First and last price of each series (time, then order, decides), the change and its share of the first."""
    rank = F.struct("occurred_on", "orderkey", "price")
    found = observations.groupBy(*keys).agg(F.count("*").alias("observations"), F.min(rank).alias("a"), F.max(rank).alias("b"))
    delta = (F.col("b.price") - F.col("a.price")).cast(MONEY)
    change = F.when(F.col("a.price") != 0, F.round(delta.cast("double") / F.col("a.price").cast("double") * 100, 4))
    return found.select(*keys, "observations", F.col("a.price").alias("first_price"), F.col("b.price").alias("last_price"), delta.alias("delta"), change.alias("change_pct"))


def max_authority_window(components: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of highest authority in each group, ties kept; for groups known to be small, such as one order's documents."""
    ranked = components.withColumn("authority", role_authority(F.col("component_type"), F.col("role")))
    return ranked.withColumn("place", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc("authority")))).where("place = 1").drop("place")
