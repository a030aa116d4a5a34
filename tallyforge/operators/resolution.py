"""Resolution of orders, merchants, outlets, people and items from evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.expressions import content_id, normal_name, sorted_set

#: Confidence of an order id by where it was found (fixed values).
ID_CONFIDENCE = {"pdf_label": "1.00", "email_field": "0.95", "history_row": "1.00", "attachment_filename": "0.60", "manifest_hint": "0.50"}
STRONG_SOURCES = ("pdf_label", "email_field", "history_row")


def strong_order_id(candidates: Column) -> Column:
    """The one order id that strong sources agree on, else null; `candidates` is an array of (value, source)."""
    strong = F.array_distinct(F.transform(F.filter(candidates, lambda x: x["source"].isin(*STRONG_SOURCES)), lambda x: x["value"]))
    return F.when(F.size(strong) == 1, F.get(strong, F.lit(0)))


def order_counts(evidence: DataFrame) -> DataFrame:
    """resolved, provisional, total orders and history duplicates from (platform, message_id, kind, order_id): one row.

    Resolved: distinct (platform, id). Provisional: distinct messages without an id, history rows
    aside. Duplicates: ids seen in history rows and elsewhere. Both counts group before they sum.
    """
    history = F.col("kind") == "history_row"
    by_id = evidence.where("order_id is not null").groupBy("platform", "order_id").agg(F.max(history).alias("in_history"), F.max(~history).alias("elsewhere"))
    ids = by_id.agg(F.count("*").alias("resolved"), F.count_if(F.col("in_history") & F.col("elsewhere")).alias("history_duplicates"))
    loose = evidence.where(~history & F.col("order_id").isNull()).select("platform", "message_id").distinct().agg(F.count("*").alias("provisional"))
    # Two tables of one row each.
    both = ids.withColumn("one", F.lit(1)).join(F.broadcast(loose.withColumn("one", F.lit(1))), "one")
    return both.select("resolved", "provisional", (F.col("resolved") + F.col("provisional")).alias("total"), "history_duplicates")


def resolve_orders(evidence: DataFrame) -> DataFrame:
    """One row for each order: by (platform, order id), or by message where there is none.

    The order's id is a content id of its key, so it doesn't depend on the rows' order or number.
    """
    key = F.coalesce(F.concat(F.lit("id:"), F.col("order_id")), F.concat(F.lit("message:"), F.col("message_id")))
    groups = evidence.withColumn("order_key", key).groupBy("platform", "order_key").agg(
        F.count("*").alias("evidence"), F.countDistinct("message_id").alias("messages"), F.max("order_id").alias("order_id")
    )
    return groups.select(
        content_id(F.lit("order-v1"), F.col("platform"), F.col("order_key")).alias("resolved_id"),
        "platform",
        "order_key",
        F.when(F.col("order_id").isNotNull(), "resolved").otherwise("provisional").alias("status"),
        "evidence",
        "messages",
    )


def preferred_names(mentions: DataFrame, keys: list[str], name: str, policy: str = "most_frequent") -> DataFrame:
    """The display name of each group and its number of aliases.

    `most_frequent`: the commonest spelling, ties by lower case then spelling. `first_alias`: the
    first spelling in that order, however common.
    """
    spelled = mentions.groupBy(*keys, name).agg(F.count("*").alias("__times"))
    rank = F.struct(*([-F.col("__times")] if policy == "most_frequent" else []), F.lower(name), F.col(name))
    return spelled.groupBy(*keys).agg(F.min_by(name, rank).alias("display_name"), F.count("*").alias("aliases"), F.sum("__times").alias("mentions"))


def resolve_merchants(mentions: DataFrame) -> DataFrame:
    """Merchants by (platform, normalised name): merchant_id, display name, aliases, mentions, orders."""
    named = mentions.withColumn("normalized_name", normal_name(F.col("raw_name")))
    keys = ["platform", "normalized_name"]
    reach = named.select(*keys, "orderkey").distinct().groupBy(*keys).agg(F.count("orderkey").alias("orders"))
    found = preferred_names(named, keys, "raw_name").join(reach, keys)
    return found.select(content_id(F.lit("merchant-v1"), F.col("platform"), F.col("normalized_name")).alias("merchant_id"), "*")


def outlets(mentions: DataFrame) -> DataFrame:
    """One provisional outlet for each merchant and order; outlets are never merged on a name alone."""
    named = mentions.withColumn("normalized_name", normal_name(F.col("raw_name")))
    return named.select("platform", "normalized_name", "orderkey").distinct().withColumn(
        "outlet_id", content_id(F.lit("outlet-v1"), F.col("platform"), F.col("normalized_name"), F.col("orderkey").cast("string"))
    )


def only_merchant(order_merchants: DataFrame) -> DataFrame:
    """(orderkey, merchant): the merchant of orders that have exactly one."""
    found = order_merchants.groupBy("orderkey").agg(F.min("merchant").alias("merchant"), F.max("merchant").alias("other"))
    return found.where("merchant = other").select("orderkey", "merchant")


def resolve_items(observations: DataFrame, order_merchants: DataFrame) -> DataFrame:
    """Merchant items: observations (orderkey, raw_name) grouped by normalised name within the order's only merchant, or else within the order."""
    scoped = observations.join(only_merchant(order_merchants), "orderkey", "left").withColumns(
        {
            "scope": F.coalesce(F.concat(F.lit("merchant:"), F.col("merchant").cast("string")), F.concat(F.lit("order:"), F.col("orderkey").cast("string"))),
            "normalized_name": normal_name(F.col("raw_name")),
        }
    )
    found = preferred_names(scoped, ["scope", "normalized_name"], "raw_name")
    return found.select(content_id(F.lit("merchant-item-v1"), F.col("scope"), F.col("normalized_name")).alias("merchant_item_id"), "*")


def overlapping(left: DataFrame, right: DataFrame, left_id: str, right_id: str, array: str) -> DataFrame:
    """Pairs whose arrays share a value, by exploding both sides and joining on the value."""
    a = left.select(left_id, F.explode(F.array_distinct(array)).alias("value"))
    b = right.select(right_id, F.explode(F.array_distinct(array)).alias("value"))
    return a.join(b, "value").select(left_id, right_id).distinct()


def two_types(mentions: DataFrame) -> DataFrame:
    """Mention ids that are claimed by more than one entity type."""
    return mentions.groupBy("mention_id").agg(F.min("entity_type").alias("one"), F.max("entity_type").alias("other")).where("one <> other")


def match_names(raw: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct spellings of each group in order, for review."""
    return raw.groupBy(*keys).agg(sorted_set("raw_name").alias("spellings"))
