"""The seven governed templates, as builders of DataFrames, and answers with their evidence.

A template takes exactly its named parameters; texts are compared as literals and never become
part of a query. Answers are composed from exact sums; what isn't evidenced is abstained from.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.expressions import normal_name, unit_price
from tallyforge.operators import finance, governance, retrieval
from tallyforge.plans.catalog import query
from tallyforge.plans.economics_queries import COMPONENTS, PLATFORMS
from tallyforge.session import table
from tallyforge.sources import domain

MOST_ROWS = 200
#: Pages that one question may read at MOST_ROWS rows each, where a budget is asked for.
MOST_ACTIONS = 12
#: Terms up to which a sum is written out; longer ones are given by their digest.
WRITTEN_TERMS = 20


def merchant_order_count(spark: SparkSession, sf_dir: str, normalized_name: str) -> DataFrame:
    """Orders of a merchant that have evidence: order_count."""
    sellers = domain.platforms(spark, sf_dir).where(normal_name(F.col("merchant")) == F.lit(normalized_name)).select("suppkey")
    return domain.lines(spark, sf_dir).join(sellers, "suppkey").agg(F.countDistinct("orderkey").alias("order_count"))


def merchant_item_price_history(spark: SparkSession, sf_dir: str, merchant_name: str, item_name: str) -> DataFrame:
    """Prices of a merchant's items whose name contains the given one, in time."""
    sellers = domain.platforms(spark, sf_dir).where(normal_name(F.col("merchant")) == F.lit(merchant_name)).select("suppkey")
    bought = domain.item_observations(spark, sf_dir).where(F.col("item").contains(F.lit(item_name))).join(sellers, "suppkey")
    return bought.select("orderkey", "item", unit_price(F.col("spend"), F.col("quantity")).alias("amount"), F.lit(domain.CURRENCY).alias("currency"), "occurred_on", F.sha2("line_key", 256).alias("source_hash"))


def delivery_mention_count(spark: SparkSession, sf_dir: str, normalized_name: str) -> DataFrame:
    """Orders that mention a person, by the mention's normalised name."""
    people = table(spark, sf_dir, "customer").where(normal_name(F.col("c_name")) == F.lit(normalized_name)).select(F.col("c_custkey").alias("custkey"))
    return domain.orders(spark, sf_dir).join(people, "custkey").select("orderkey", F.concat_ws("/", F.lit("mention"), "custkey", "orderkey").alias("mention_id"))


def financial_component_sum(spark: SparkSession, sf_dir: str, component_type: str, platform: str) -> DataFrame:
    """Components of a type on a platform, with their evidence; both filters come before any join that widens."""
    components = domain.money_components(spark, sf_dir).where(F.col("component_type") == F.lit(component_type))
    sellers = domain.platforms(spark, sf_dir).where(F.col("platform") == F.lit(platform)).select("suppkey")
    return components.join(sellers, "suppkey").select("component_key", "amount", "currency", F.col("source_key").alias("chunk_id"), F.sha2("source_key", 256).alias("source_hash"))


def evidence_for_money_component(spark: SparkSession, sf_dir: str, component_id: str) -> DataFrame:
    return domain.money_components(spark, sf_dir).where(F.col("component_key") == F.lit(component_id)).select(
        "component_key", "amount", "currency", F.col("source_key").alias("chunk_id"), F.sha2("source_key", 256).alias("source_hash")
    )


def order_reconstruction(spark: SparkSession, sf_dir: str, order_id: int) -> DataFrame:
    """Everything an order is connected with; an order without anything keeps one row."""
    order = domain.orders(spark, sf_dir).where(F.col("orderkey") == F.lit(order_id)).select("orderkey")
    near = domain.money_components(spark, sf_dir).where(F.col("orderkey") == F.lit(order_id)).select(
        "orderkey", F.lit("HAS_COMPONENT").alias("relationship_type"), F.col("component_key").alias("neighbour_id"), F.sha2("source_key", 256).alias("source_hash")
    )
    return order.join(near, "orderkey", "left")


def fulltext_evidence(spark: SparkSession, sf_dir: str, query_text: str, limit: int = 50) -> DataFrame:
    """The best documents for a text by BM25."""
    asked = spark.createDataFrame([(0, query_text)], "query_id int, text string")
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("candidate_id"), "text")
    return retrieval.lexical_candidates(asked, documents, limit).select("candidate_id", "score", "rank")


TEMPLATES: dict[str, tuple[Callable[..., DataFrame], frozenset[str]]] = {
    "merchant_order_count": (merchant_order_count, frozenset({"normalized_name"})),
    "merchant_item_price_history": (merchant_item_price_history, frozenset({"merchant_name", "item_name"})),
    "delivery_mention_count": (delivery_mention_count, frozenset({"normalized_name"})),
    "financial_component_sum": (financial_component_sum, frozenset({"component_type", "platform"})),
    "evidence_for_money_component": (evidence_for_money_component, frozenset({"component_id"})),
    "order_reconstruction": (order_reconstruction, frozenset({"order_id"})),
    "fulltext_evidence": (fulltext_evidence, frozenset({"query_text"})),
}


def bind(spark: SparkSession, sf_dir: str, template: str, parameters: dict[str, str | int]) -> DataFrame:
    """The DataFrame of a template; parameters must be exactly its own, texts or whole numbers."""
    build, names = TEMPLATES[template]
    if set(parameters) != names:
        raise ValueError(f"{template} takes {sorted(names)}, not {sorted(parameters)}")
    if any(isinstance(x, bool) or not isinstance(x, (str, int)) for x in parameters.values()):
        raise ValueError("parameters are texts or whole numbers")
    return build(spark, sf_dir, **parameters)


@dataclass(frozen=True)
class Answer:
    """A verified answer, or the reason why there is none."""

    status: str
    facts: int
    text: str | None = None
    calculation: str | None = None
    reason: str | None = None


def _money(value: Decimal) -> str:
    return str(value.quantize(Decimal("0.01"), rounding=ROUND_HALF_EVEN))


def answer_component_sum(spark: SparkSession, sf_dir: str, component_type: str, platform: str, budget: bool = False) -> Answer:
    """The exact total of a component type on a platform, with its calculation.

    The sum is one aggregation whatever the number of components. With `budget`, more components
    than MOST_ACTIONS pages hold are abstained from, as a paging reader would.
    """
    rows = bind(spark, sf_dir, "financial_component_sum", {"component_type": component_type, "platform": platform})
    finance.require_none(finance.conflicting_components(rows), "one component has one amount")
    found = finance.distinct_sum(rows.where("chunk_id is not null"), []).limit(2).collect()
    if not found:
        return Answer("abstained", 0, reason="no_graph_facts")
    if len(found) > 1:
        raise finance.RuleBroken("currencies aren't summed together")
    currency, count, total = found[0]
    if budget and count > MOST_ACTIONS * MOST_ROWS:
        return Answer("abstained", count, reason="query_action_budget_exhausted")
    name = component_type.replace("_", " ")
    text = f"The evidence-backed {name} total for {platform.title()} is {currency} {_money(total)} across {count} distinct {'component' if count == 1 else 'components'}."
    return Answer("verified", count, text, _calculation(rows, currency, count, total))


def _calculation(rows: DataFrame, currency: str, count: int, total: Decimal) -> str:
    if count > WRITTEN_TERMS:
        # A digest that adds up in every partition, so no list of all terms is needed.
        once = rows.select("component_key", "currency", "amount").distinct()
        digest = once.agg(F.sum(F.xxhash64("component_key", "currency", F.col("amount").cast("string")).cast("decimal(38,0)")).alias("d")).first()["d"]
        return f"Decimal sum of {count} distinct source-backed components = {currency} {_money(total)}; term digest={hashlib.sha256(str(digest).encode()).hexdigest()}"
    terms = rows.select("component_key", "amount").distinct().orderBy("component_key").limit(WRITTEN_TERMS).collect()
    return " + ".join(f"{currency} {_money(r['amount'])}" for r in terms) + f" = {currency} {_money(total)}"


def answer_price_history(prices: DataFrame) -> Answer:
    """The change from the first price to the last of (orderkey, amount, currency, occurred_on)."""
    span = prices.agg(
        F.countDistinct("orderkey").alias("n"),
        F.countDistinct("currency").alias("currencies"),
        F.min(F.struct("occurred_on", "orderkey", "amount", "currency")).alias("a"),
        F.max(F.struct("occurred_on", "orderkey", "amount", "currency")).alias("b"),
    ).first()
    if not span["n"]:
        return Answer("abstained", 0, reason="no_graph_facts")
    if span["currencies"] > 1:
        raise finance.RuleBroken("prices of several currencies aren't compared")
    a, b, currency = span["a"], span["b"], span["a"]["currency"]
    if span["n"] == 1:
        return Answer("verified", 1, f"The source-backed item price was {currency} {_money(a['amount'])} on {a['occurred_on']}.")
    delta = b["amount"] - a["amount"]
    share = f" ({(delta / a['amount'] * 100).quantize(Decimal('0.01'), rounding=ROUND_HALF_EVEN)}%)" if a["amount"] else ""
    text = f"The source-backed item price changed from {currency} {_money(a['amount'])} on {a['occurred_on']} to {currency} {_money(b['amount'])} on {b['occurred_on']}."
    return Answer("verified", span["n"], text, f"{currency} {_money(b['amount'])} - {currency} {_money(a['amount'])} = {currency} {_money(delta)}{share}")


@query(
    "financial_component_sum",
    f"""WITH {COMPONENTS}, {PLATFORMS} SELECT 'INR' AS currency, count(*) AS components, CAST(sum(amount) AS DECIMAL(38,2)) AS total
    FROM components JOIN platforms USING (suppkey) WHERE component_type = 'tax' AND platform = 'asia'""",
)
def component_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: components of one type on one platform, their evidence, and the exact sum over distinct components."""
    return finance.distinct_sum(bind(spark, sf_dir, "financial_component_sum", {"component_type": "tax", "platform": "asia"}), [])


@query(
    "merchant_order_count",
    f"WITH {PLATFORMS} SELECT merchant, count(DISTINCT l_orderkey) AS order_count FROM lineitem JOIN platforms ON l_suppkey = suppkey GROUP BY merchant",
)
def order_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The template's count for every merchant at once."""
    counts = domain.lines(spark, sf_dir).groupBy("suppkey").agg(F.countDistinct("orderkey").alias("order_count"))
    return counts.join(domain.platforms(spark, sf_dir), "suppkey").groupBy("merchant").agg(F.sum("order_count").alias("order_count"))


@query(
    "evidence_for_component",
    """SELECT 'orders' AS kind, o_orderkey || ':customer_total' AS component_key, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, sha256(CAST(o_orderkey AS VARCHAR)) AS source_hash
    FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)""",
)
def evidence_for_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = domain.orders(spark, sf_dir).agg(F.min("orderkey")).first()[0]
    found = bind(spark, sf_dir, "evidence_for_money_component", {"component_id": f"{first}:customer_total"})
    return found.select(F.lit("orders").alias("kind"), "component_key", "amount", "source_hash")


@query(
    "order_reconstruction",
    f"""WITH {COMPONENTS} SELECT o_orderkey AS orderkey, component_type, count(*) AS neighbours FROM orders JOIN components ON orderkey = o_orderkey GROUP BY ALL""",
)
def reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The template's neighbours for every order at once, by what they are."""
    near = domain.money_components(spark, sf_dir).groupBy("orderkey", "component_type").agg(F.count("*").alias("neighbours"))
    return domain.orders(spark, sf_dir).select("orderkey").join(near, "orderkey")


def plan_questions(questions: DataFrame) -> DataFrame:
    """Routes questions (question): cleaned text, refusal, intent, templates, slots."""
    cleaned = questions.withColumn("question", governance.clean_question(F.col("question")))
    return cleaned.withColumn("refusal", governance.refusal(F.col("question"))).withColumns(
        {"intent": F.when(F.col("refusal").isNull(), governance.intent(F.col("question"))), "templates": F.when(F.col("refusal").isNull(), governance.templates(F.col("question")))}
    ).withColumn("slots", governance.slots(F.col("question")))
