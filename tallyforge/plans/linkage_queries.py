"""Registered queries from evidence to regions, orders, components and reconciliations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import keys, linkage
from tallyforge.plans.catalog import query
from tallyforge.session import table

FIRST = 1_000_000_000


def _named(prefix: str, *keys: str) -> Column:
    return F.concat_ws("-", F.lit(prefix), *[F.col(k).cast("string") for k in keys])


def _collection(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Evidence, messages and regions: a message with an attachment for each order, a statement for each customer.

    Each order has a label in its message and a row in its customer's statement; each line is a region
    of the message or of its attachment; a statement has a region for each order priority.
    """
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderpriority").alias("p"))
    text = F.col("k").cast("string").alias("order_id")
    labels = orders.select(_named("label", "k").alias("evidence_id"), _named("m", "k").alias("message_id"), F.lit("pdf_label").alias("kind"), text)
    rows = orders.select(_named("row", "k").alias("evidence_id"), _named("h", "c").alias("message_id"), F.lit("history_row").alias("kind"), text)
    messages = orders.select(_named("m", "k").alias("message_id"), F.array(_named("d", "k")).alias("attachments"))
    messages = messages.unionByName(orders.select("c").distinct().select(_named("h", "c").alias("message_id"), F.array().cast("array<string>").alias("attachments")))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).distinct()
    source = F.when(F.col("n") % 2 == 0, _named("d", "k")).otherwise(_named("m", "k"))
    role = F.when(F.col("n") % 2 == 0, "item").otherwise("charge").alias("financial_role")
    regions = lines.select(_named("line", "k", "n").alias("region_id"), role, F.array(source).alias("source_ids"), F.array(F.col("k").cast("string")).alias("order_ids"))
    # One customer's orders of one priority are few.
    parts = orders.groupBy("c", "p").agg(F.collect_set(F.col("k").cast("string")).alias("order_ids"))
    parts = parts.select(_named("part", "c", "p").alias("region_id"), F.lit("item").alias("financial_role"), F.array(_named("h", "c")).alias("source_ids"), "order_ids")
    return labels.unionByName(rows), messages, regions.unionByName(parts)


def _orders_of(evidence: DataFrame, links: DataFrame) -> DataFrame:
    return linkage.region_orders(links, evidence.withColumnRenamed("order_id", "order"))


LINES = "l AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem), o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority AS p FROM orders)"


@query(
    "evidence_region_links",
    f"""WITH {LINES}, x AS (SELECT 'pdf_label' AS kind, o.k AS e, concat('line-', l.k, '-', l.n) AS r FROM o JOIN l ON l.k = o.k UNION SELECT 'history_row', o.k, concat('part-', c, '-', p) FROM o)
    SELECT kind, count(*) AS links, count(DISTINCT e) AS evidence, count(DISTINCT r) AS regions FROM x GROUP BY kind""",
)
def evidence_region_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How labels and statements' rows link to regions."""
    evidence, messages, regions = _collection(spark, sf_dir)
    links = linkage.region_links(evidence, messages, regions, "kind")
    # A link is there once and so is its side of a pair of ends: both ends are counted as rows of hashes, and links with the evidence's.
    n = lambda end: F.count_if(F.col("end") == end)
    ends = keys.values(links, "kind", "evidence_id", "region_id")
    return ends.groupBy("kind").agg(F.sum(F.when(F.col("end") == "evidence_id", F.col("n"))).alias("links"), n("evidence_id").alias("evidence"), n("region_id").alias("regions"))


@query(
    "item_region_orders",
    f"""WITH {LINES} SELECT concat('line-', l.k, '-', l.n) AS region_id, CAST(l.k AS VARCHAR) AS "order" FROM l JOIN o ON l.k = o.k WHERE n % 2 = 0
    UNION ALL SELECT concat('part-', c, '-', p), CAST(min(k) AS VARCHAR) FROM o GROUP BY c, p HAVING count(*) = 1""",
)
def item_region_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions that describe items and have exactly one order."""
    evidence, messages, regions = _collection(spark, sf_dir)
    return linkage.item_regions(regions, _orders_of(evidence, linkage.region_links(evidence, messages, regions)))


@query(
    "reconciled_orders",
    f"""WITH {LINES}, x AS (SELECT DISTINCT l.k % 97 AS run, l.k FROM l JOIN o ON l.k = o.k WHERE n <> 3)
    SELECT concat('run-', run) AS run_id, count(*) AS orders FROM x GROUP BY run""",
)
def reconciled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk to region to order to reconciliation: orders of each run, whose components are interpretations of lines; every third line's component is missing."""
    evidence, messages, regions = _collection(spark, sf_dir)
    orders = _orders_of(evidence, linkage.region_links(evidence, messages, regions))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).distinct()
    component = _named("component", "k", "n").alias("component_id")
    interpretations = lines.select(_named("line", "k", "n").alias("region_id"), component)
    components = lines.where("n <> 3").select(component, _named("chunk", "k", "n").alias("chunk_id"))
    found, _ = linkage.interpreted_components(interpretations, components, orders)
    runs = lines.select(F.concat(F.lit("run-"), (F.col("k") % 97).cast("string")).alias("run_id"), component)
    return linkage.reconciled_orders(runs, found).groupBy("run_id").agg(F.count("*").alias("orders"))


@query(
    "known_id_tokens",
    f"""WITH t AS (SELECT doc_id, {FIRST} + doc_id * 20 AS a, {FIRST} + 7 AS b FROM documents)
    SELECT doc_id, CAST(a AS VARCHAR) AS token FROM t WHERE a - {FIRST} IN (SELECT o_orderkey FROM orders) UNION SELECT doc_id, CAST(b AS VARCHAR) FROM t WHERE 7 IN (SELECT o_orderkey FROM orders)""",
)
def known_id_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order numbers that whole texts name; each text is given one of its own, one that all share, and longer runs of digits."""
    # A row without an id is given the shared number alone.
    own, shared = F.coalesce((F.lit(FIRST) + F.col("doc_id") * 20).cast("string"), F.lit("")), F.lit(str(FIRST + 7))
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" order "), own, F.lit("; and "), shared, F.lit(", not "), own, F.lit("000000"), F.lit(" x"), shared, F.lit("x"))
    texts = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    known = table(spark, sf_dir, "orders").select((F.lit(FIRST) + F.col("o_orderkey")).cast("string").alias("id"))
    return linkage.known_tokens(texts, "doc_id", "text", known, "id")
