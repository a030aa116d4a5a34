"""Constraints as queries: each returns the rows that break a rule, with the rule's name; none drops them silently."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.expressions import content_id
from tallyforge.operators import keys
from tallyforge.operators.finance import require_none


def broken(frame: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(rule, key) for each row and rule that doesn't hold; a rule that is null for a row doesn't hold. One pass over the rows."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    return frame.select(F.explode(failed).alias("rule"), F.col(key).cast("string").alias("key"))


def repeated(frame: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once."""
    return frame.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(f"unique_{key}").alias("rule"), F.col(key).cast("string").alias("key"))


def violated(frame: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """`broken` and `repeated` together: one pass finds the hashes of keys that may recur or break a rule, and only rows that have one are looked at again."""
    wrong = reduce(or_, [~F.coalesce(rule, F.lit(False)) for rule in rules.values()], F.lit(False))
    hashes = keys.suspects(frame, key, wrong)
    rows = frame.limit(0) if hashes.isEmpty() else keys.among(frame, key, hashes)
    return broken(rows, key, rules).unionByName(repeated(rows, key))


def orphans(frame: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """Keys that `known` lacks. Each goes once to where it is looked up."""
    return frame.select(key).distinct().join(known.select(F.col(known_key).alias(key)), key, "left_anti").select(F.lit(f"known_{key}").alias("rule"), F.col(key).cast("string").alias("key"))


def together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def component_rules() -> dict[str, Column]:
    """What holds for every money component."""
    return {
        "amount_is_exact": F.round("amount", 2) == F.col("amount"),
        "currency_is_a_code": F.col("currency").rlike("^[A-Z]{3}$"),
        "precision_is_not_negative": F.col("source_precision") >= 0,
        "has_a_source": F.length("source_key") > 0,
    }


def reconciliation_rules() -> dict[str, Column]:
    """What holds for every reconciliation."""
    return {
        "residual_is_the_difference": F.col("expected_amount") - F.col("calculated_amount") == F.col("residual"),
        "share_is_between_0_and_1": F.col("explained_value_ratio").between(0, 1),
        "exact_means_no_residual": (F.col("status") == "exact") == (F.col("residual") == 0),
    }


def event_rules() -> dict[str, Column]:
    """What holds for every financial event."""
    return {
        "id_follows_from_the_content": F.col("event_id") == content_id(F.lit("financial-event-v1"), F.col("component_key")),
        "validity_is_in_order": F.coalesce(F.col("valid_to") > F.col("valid_from"), F.lit(True)),
        "source_hash_is_the_source's": F.col("source_hash") == F.sha2("source_key", 256),
        "has_a_time": F.col("occurred_at").isNotNull(),
    }


def check(violations: DataFrame) -> None:
    """Raises at the first violation."""
    require_none(violations, "broken rule")
