"""Grounded answers to many questions at once, from the facts that their templates found.

Facts are rows of a question (question_id), each with the evidence it rests on (chunk_id, source_id,
source_hash; null where there is none). A draft counts and words a question's facts; `grounded` lets it
stand only if at least one fact names its evidence in full and none is flagged as conflicting. Every
step aggregates by question and fact before it aggregates by question, so a question of very many facts
is many groups first.

What would be an error for one question (components or prices that contradict each other, several
currencies) is a row here: status `refused`, with the rule as the reason.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators import keys
from tallyforge.operators.traversal import MOST_ROWS
from tallyforge.session import materialise

TOTAL = "decimal(38,2)"
EVIDENCE = ["chunk_id", "source_id", "source_hash"]
#: Pages that one question may read, and components up to which a sum is written out.
MOST_PAGES, WRITTEN_TERMS = 12, 20

# Sentences of answers and their limitations: fixed values.
SUM_LIMIT = "This is a sum of source-asserted components, not a bank-confirmed debit."
ONE_PRICE_LIMIT = "Only one matching price observation was available for this scope."
PRICES_LIMIT = "The comparison covers matched merchant-item observations, not a causal inflation estimate."
MERCHANT_LIMIT = "Merchant identity follows the current reviewed resolution state."
MENTION_LIMIT = "Repeated names are mention-level evidence unless a reviewed person identity resolution exists."


def paged(facts: DataFrame, keys: list[str], order: list[Column | str], place: Callable[[], Column] = F.row_number) -> DataFrame:
    """The first rows of each group in the given order, with their `place`, as many as any question may read; each task keeps no more of a group before the shuffle.

    With `dense_rank`, rows that repeat share a place.
    """
    return facts.withColumn("place", place().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= MOST_ROWS)


def _amount(value: Column, currency: Column) -> Column:
    return F.concat(currency, F.lit(" "), F.bround(value, 2).cast(TOTAL).cast("string"))


def _counted(n: Column, before: str, one: str, many: str) -> Column:
    """A sentence with a number and its noun; none for 0."""
    return F.when(n > 0, F.concat(F.lit(before), n.cast("string"), F.when(n == 1, f" {one}.").otherwise(f" {many}.")))


def _draft(frame: DataFrame, facts: Column, answer: Column, limitation: Column | None = None, calculation: Column | None = None, fault: Column | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    none = F.lit(None).cast("string")
    pick = lambda x: none if x is None else x
    return frame.select("question_id", facts.cast("bigint").alias("facts"), answer.alias("direct_answer"), pick(calculation).alias("calculation"), pick(limitation).alias("limitation"), pick(fault).alias("fault"), *more)


def component_sums(facts: DataFrame) -> DataFrame:
    """Drafts of exact sums: facts with component_id, amount, currency, component_type and platform (the question's own slots).

    A component counts once, however much evidence repeats it. Up to WRITTEN_TERMS terms are written
    out in order of their ids; longer sums carry a digest: the SHA-256 of the sum of the terms' 60-bit
    hashes, which needs no list of terms and doesn't depend on their order.
    """
    kept = facts.where("coalesce(component_id, '') <> '' and coalesce(currency, '') <> '' and amount is not null")
    # Most components come once: they stay where they are, and only those that may repeat meet by their ids.
    alone, several = keys.divided(kept.select("question_id", "component_id", "amount", "currency", "component_type", "platform"), "question_id", "component_id")
    once = alone.withColumns({"most": F.col("amount"), "other": F.col("currency")})
    if several is not None:
        again = several.groupBy("question_id", "component_id").agg(
            F.min("amount").alias("amount"), F.max("amount").alias("most"), F.min("currency").alias("currency"), F.max("currency").alias("other"),
            F.min("component_type").alias("component_type"), F.min("platform").alias("platform"),
        )
        once = once.unionByName(again)
    term = F.concat_ws("|", "component_id", "currency", F.col("amount").cast("string"))
    hashed = F.conv(F.substring(F.sha2(term, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    # Texts are keys here: as least and greatest values they would have every component sorted by its question.
    conflict = (F.col("amount") != F.col("most")) | (F.col("currency") != F.col("other"))
    parts = once.groupBy("question_id", "currency", "other", "component_type", "platform").agg(F.count("*").alias("n"), F.sum("amount").alias("total"), F.max(conflict).alias("conflict"), F.sum(hashed).alias("hashes"))
    sums = parts.groupBy("question_id").agg(
        F.sum("n").alias("n"), F.sum("total").cast(TOTAL).alias("total"), F.min("currency").alias("currency"), F.max("other").alias("other"),
        F.max("conflict").alias("conflict"), F.sum("hashes").cast("decimal(38,0)").alias("hashes"),
        F.min("component_type").alias("component_type"), F.min("platform").alias("platform"),
    )
    # One row for each question.
    sums = materialise(sums, "sums")
    # Only the terms of short sums are gathered: their number is the bound. Where there are none, no component is looked at again.
    short = sums.where(F.col("n") <= WRITTEN_TERMS).select("question_id")
    few = once.limit(0) if short.isEmpty() else once.join(keys.near(short), "question_id", "left_semi")
    terms = few.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("component_id", _amount(F.col("amount"), F.col("currency")).alias("t")))).alias("terms"))
    both = sums.join(terms, "question_id", "left")
    total = _amount(F.col("total"), F.col("currency"))
    written = F.concat(F.array_join(F.transform("terms", lambda x: x["t"]), " + "), F.lit(" = "), total)
    long = F.concat(F.lit("Decimal sum of "), F.col("n").cast("string"), F.lit(" distinct source-backed components = "), total, F.lit("; term digest="), F.sha2(F.col("hashes").cast("string"), 256))
    text = F.concat(
        F.lit("The evidence-backed "), F.replace(F.col("component_type"), F.lit("_"), F.lit(" ")), F.lit(" total for "), F.initcap("platform"), F.lit(" is "), total,
        F.lit(" across "), F.col("n").cast("string"), F.lit(" distinct "), F.when(F.col("n") == 1, "component.").otherwise("components."),
    )
    fault = F.when(F.col("conflict"), "conflicting_components").when(F.col("currency") != F.col("other"), "mixed_currencies")
    return _draft(both, F.col("n"), text, F.lit(SUM_LIMIT), F.when(F.col("n") <= WRITTEN_TERMS, written).otherwise(long), fault)


def price_histories(facts: DataFrame) -> DataFrame:
    """Drafts of price changes: facts with order_id, amount, currency and occurred_at.

    One observation for each order; the earliest and the latest are compared (order ids decide ties).
    Orders that come with more than one price, time or currency are a contradiction.
    """
    kept = facts.where("order_id is not null and amount is not null and coalesce(currency, '') <> '' and occurred_at is not null")
    seen = F.struct("occurred_at", "amount", "currency")
    once = kept.groupBy("question_id", "order_id").agg(F.min(seen).alias("x"), F.max(seen).alias("y"))
    rank = F.struct(F.col("x.occurred_at").alias("at"), "order_id", F.col("x.amount").alias("amount"))
    span = once.groupBy("question_id").agg(
        F.count("*").alias("n"), F.max(F.col("x") != F.col("y")).alias("conflict"), F.min("x.currency").alias("currency"), F.max("x.currency").alias("other"), F.min(rank).alias("a"), F.max(rank).alias("b")
    )
    a, b, currency = F.col("a"), F.col("b"), F.col("currency")
    day = lambda x: F.to_date(x["at"]).cast("string")
    delta = (b["amount"] - a["amount"]).cast("decimal(38,2)")
    share = F.bround(delta.cast("decimal(28,2)") / a["amount"].cast("decimal(18,2)") * 100, 2).cast(TOTAL)
    percent = F.concat(F.lit(" ("), F.when((delta < 0) & (share == 0), "-0.00").otherwise(share.cast("string")), F.lit("%)"))
    at = lambda x: F.concat(_amount(x["amount"], currency), F.lit(" on "), day(x))
    one = F.concat(F.lit("The source-backed item price was "), at(a), F.lit("."))
    many = F.concat(F.lit("The source-backed item price changed from "), at(a), F.lit(" to "), at(b), F.lit("."))
    change = F.concat(_amount(b["amount"], currency), F.lit(" - "), _amount(a["amount"], currency), F.lit(" = "), _amount(delta, currency), F.when(a["amount"] != 0, percent).otherwise(""))
    single = F.col("n") == 1
    fault = F.when(F.col("conflict"), "conflicting_observations").when(currency != F.col("other"), "mixed_currencies")
    return _draft(span, F.col("n"), F.when(single, one).otherwise(many), F.when(single, ONE_PRICE_LIMIT).otherwise(PRICES_LIMIT), F.when(~single, change), fault)


def merchant_orders(facts: DataFrame) -> DataFrame:
    """Drafts of a merchant's number of orders: facts with order_count, the same in all rows of a question."""
    found = facts.where("order_count is not null").groupBy("question_id").agg(F.min("order_count").alias("n"), F.max("order_count").alias("other"))
    text = _counted(F.col("n"), "The graph links this merchant to ", "source-backed order", "source-backed orders")
    return _draft(found, F.col("n"), text, F.lit(MERCHANT_LIMIT), fault=F.when(F.col("n") != F.col("other"), "conflicting_counts"))


def delivery_mentions(facts: DataFrame) -> DataFrame:
    """Drafts of the number of distinct orders that mention a person: facts with order_id."""
    found = facts.where("order_id is not null").groupBy("question_id", "order_id").count().groupBy("question_id").agg(F.count("*").alias("n"))
    text = _counted(F.col("n"), "The source evidence links this delivery-person mention to ", "distinct order", "distinct orders")
    return _draft(found, F.col("n"), text, F.lit(MENTION_LIMIT))


def found_facts(facts: DataFrame) -> DataFrame:
    """Drafts for the other templates: how many rows there are."""
    return _found(facts.groupBy("question_id").agg(F.count("*").alias("rows")))


def _found(counted: DataFrame, *more: str) -> DataFrame:
    n = F.col("rows")
    return _draft(counted, n, F.concat(F.lit("The governed graph query returned "), n.cast("string"), F.lit(" source-backed facts.")), more=more)


DRAFTS = {
    "merchant_order_count": merchant_orders,
    "merchant_item_price_history": price_histories,
    "delivery_mention_count": delivery_mentions,
    "financial_component_sum": component_sums,
    "evidence_for_money_component": found_facts,
    "order_reconstruction": found_facts,
    "fulltext_evidence": found_facts,
}


def grounded(bound: DataFrame, facts: DataFrame, template: str, budget: bool = False) -> DataFrame:
    """One row for each question that was bound to a template (question_id, parameters, abstention_reason).

    status verified, abstained or refused; facts, citations (rows with full evidence), direct_answer,
    calculation, limitation, abstention_reason. In this order: a question that wasn't bound keeps its
    reason; contradicting facts are refused; with `budget`, a sum that MOST_PAGES full pages of
    `row_limit` rows don't hold is `query_action_budget_exhausted`; flagged evidence is
    `conflicting_evidence`; facts without any evidence, or none at all, are
    `incomplete_evidence_coverage`; evidence without countable facts is `no_graph_facts`. Only verified
    answers show their text. Repeated question ids are an error of the caller's: they would share facts.
    """
    full = F.lit(True)
    for name in EVIDENCE:
        full = full & (F.coalesce(name, F.lit("")) != "")
    flagged = F.array_contains("quality_flags", "conflicting") if "quality_flags" in facts.columns else F.lit(False)
    cited = facts.groupBy("question_id").agg(F.count_if(full).alias("citations"), F.count_if(full & flagged).alias("flagged"), F.count("*").alias("rows"))
    rows = bound.where(F.col("template") == template)
    if DRAFTS[template] is found_facts:
        # The draft counts the rows that are counted here, so facts are made once.
        rows = rows.join(_found(cited, "citations", "flagged", "rows"), "question_id", "left")
    else:
        rows = rows.join(cited, "question_id", "left").join(DRAFTS[template](facts), "question_id", "left")
    limit = F.element_at("parameters", "limit").cast("bigint")
    over = F.lit(budget and template == "financial_component_sum") & (F.col("rows") >= MOST_PAGES * limit)
    reason = (
        F.when(F.col("abstention_reason").isNotNull(), F.col("abstention_reason"))
        .when(F.col("fault").isNotNull(), F.col("fault"))
        .when(over, "query_action_budget_exhausted")
        .when(F.col("flagged") > 0, "conflicting_evidence")
        .when(F.coalesce("citations", F.lit(0)) == 0, "incomplete_evidence_coverage")
        .when(F.coalesce("facts", F.lit(0)) == 0, "no_graph_facts")
    )
    unbound = F.col("abstention_reason").isNotNull()
    status = F.when(reason.isNull(), "verified").when(~unbound & F.col("fault").isNotNull(), "refused").otherwise("abstained")
    shown = lambda name: F.when(F.col("status") == "verified", F.col(name)).alias(name)
    count = lambda name: F.coalesce(name, F.lit(0)).cast("bigint").alias(name)
    return rows.withColumns({"status": status, "reason": reason}).select(
        "question_id", "status", count("facts"), count("citations"), shown("direct_answer"), shown("calculation"), shown("limitation"), F.col("reason").alias("abstention_reason")
    )
