"""Registered queries over stored documents, evidence bundles and scenario packs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.plans.catalog import query
from tallyforge.plans.economics_queries import LINES
from tallyforge.session import shared_dir, table
from tallyforge.sources import domain, processed, scenarios

#: Characters of a page, when a text is laid out on pages.
PAGE = 3000


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tallyforge/{name}-{uuid.uuid4().hex}"


def _documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every document with its whole text laid out on pages, one at least; each seventh document's first page has an image that couldn't be read."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("none")).alias("role"))
    sha = F.sha2(F.col("doc_id").cast("string"), 256)
    count = F.greatest(F.lit(1), F.ceil(F.length("text") / PAGE)).cast("int")
    rows = rows.withColumns({"sha256": sha, "document_id": F.concat(F.lit("doc_"), F.left(sha, F.lit(16))), "page_count": count, "message_id": F.concat(F.lit("m"), (F.col("doc_id") / 2).cast("bigint"))})
    broken = F.when((F.col("doc_id") % 7 == 0) & (F.col("page_number") == 1), F.array(F.lit("image_extraction_failed")))
    pages = rows.withColumn("page_number", F.explode(F.sequence(F.lit(1), "page_count"))).select("doc_id", "document_id", "page_number", F.expr(f"substring(text, (page_number - 1) * {PAGE} + 1, {PAGE})").alias("text"), broken.alias("issues"))
    return rows.select("doc_id", "document_id", "sha256", "page_count", "role", "message_id"), pages


DOCUMENTS = f"""docs AS (SELECT doc_id, coalesce(source, 'none') AS role, length(coalesce(text, '')) AS chars, greatest(1, ceil(length(coalesce(text, '')) / {PAGE}.0))::BIGINT AS pages FROM documents)"""


@query(
    "processed_documents",
    f"""WITH {DOCUMENTS}, s AS (SELECT *, CASE WHEN chars = 0 OR (doc_id % 7 = 0 AND doc_id % 14 <> 0) THEN 'quarantined' ELSE 'complete' END AS processing_status FROM docs)
    SELECT role, processing_status, count(*) AS documents, CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(chars) AS BIGINT) AS chars,
      CAST(count(*) FILTER (processing_status = 'quarantined') AS BIGINT) AS quarantined_pages FROM s GROUP BY ALL""",
)
def processed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored with their pages; then half of those with an unread image stored again without that fault; what is stored in the end."""
    documents, pages = _documents(spark, sf_dir)
    path = _place(spark, "processed")
    processed.write_documents(path, documents, pages, 32)
    again = F.col("doc_id") % 14 == 0
    processed.write_documents(path, documents.where(again), pages.where(again).withColumn("issues", F.lit(None).cast("array<string>")), 32)
    manifests, _ = processed.read_documents(spark, path)
    bad = processed.quarantined_pages(spark, path).groupBy("document_id").agg(F.count("*").alias("bad"))
    return manifests.join(bad, "document_id", "left").groupBy("role", "processing_status").agg(
        F.count("*").alias("documents"), F.sum("found_pages").alias("pages"), F.sum("text_character_count").cast("bigint").alias("chars"), F.coalesce(F.sum("bad"), F.lit(0)).cast("bigint").alias("quarantined_pages")
    )


@query(
    "document_bundle_cohorts",
    f"""WITH {DOCUMENTS}, m AS (SELECT o_orderkey AS m, lower(o_orderstatus) AS category FROM orders), d AS (SELECT doc_id // 2 AS m, role, pages FROM docs),
    b AS (SELECT m, string_agg(DISTINCT role, '+' ORDER BY role) AS roles, sum(pages) AS pages FROM d GROUP BY m)
    SELECT 'mail:' || category || ':' || CASE WHEN roles IS NULL THEN 'mail-only:message' ELSE 'pdf-backed:' || roles END AS cohort_key, roles IS NULL AS mail_only, count(*) AS bundles, CAST(count(*) + sum(coalesce(pages, 0)) AS BIGINT) AS chunks
    FROM m LEFT JOIN b USING (m) GROUP BY ALL""",
)
def document_bundle_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' mails as messages, documents by twos as their attachments, pages and mails as chunks: bundles and chunks by cohort."""
    documents, pages = _documents(spark, sf_dir)
    messages = domain.orders(spark, sf_dir).select(F.concat(F.lit("m"), "orderkey").alias("message_id"), F.lit("mail").alias("platform"), F.lower("status").alias("category"))
    chunks = pages.select(F.col("document_id").alias("source_id"), "page_number").unionByName(messages.select(F.col("message_id").alias("source_id"), F.lit(0).alias("page_number")))
    counts = processed.bundle_chunks(messages, documents, chunks).groupBy("bundle_id").agg(F.count("*").alias("n"))
    return processed.evidence_bundles(messages, documents).join(counts, "bundle_id").groupBy("cohort_key", "mail_only").agg(F.count("*").alias("bundles"), F.sum("n").alias("chunks"))


@query(
    "scenario_pack_faults",
    f"""WITH {LINES}, c AS (SELECT orderkey, count(*) AS n FROM lines GROUP BY ALL), o AS (SELECT o_orderkey AS k, coalesce(n, 0) AS n FROM orders LEFT JOIN c ON orderkey = o_orderkey)
    SELECT * FROM (SELECT unnest(['money_is_there', 'documents_are_unique', 'money_names_a_declared_document', 'abstention_fits_the_capability', 'instructions_fit_the_capability', 'title_is_long_enough', 'outcome_is_known']) AS rule,
      unnest([count(*) FILTER (n = 0), count(*) FILTER (k % 11 = 0), count(*) FILTER (k % 7 = 0 AND n > 0), count(*) FILTER (k % 5 = 0), count(*) FILTER (k % 13 = 0), count(*) FILTER (k % 17 = 0), count(*) FILTER (k % 19 = 0)]) AS n FROM o) WHERE n > 0""",
)
def scenario_pack_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a scenario pack with its lines' amounts, written as JSON, read back and checked; some rules are broken by order."""
    key, text = F.col("orderkey"), F.col("orderkey").cast("string")
    document = lambda part: F.concat(F.lit("scenario-doc:"), text, F.lit(f"-{part}"))
    cited = F.when(key % 7 == 0, F.lit("scenario-doc:other")).otherwise(document("a"))
    # An order has few lines.
    money = domain.lines(spark, sf_dir).groupBy("orderkey").agg(
        F.collect_list(F.struct(F.concat(F.lit("scenario-money:"), text, F.lit("-"), F.col("linenumber").cast("string")).alias("component_id"), F.lit("item_gross").alias("component_type"), F.col("gross").alias("amount"), F.lit(domain.CURRENCY).alias("currency"), cited.alias("source_document_id"))).alias("components")
    )
    paper = lambda part: F.struct(part.alias("document_id"), F.lit("ZOMATO_ORDER_SUMMARY").alias("role"), F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("occurred_at"))
    packs = domain.orders(spark, sf_dir).join(money, "orderkey", "left").select(
        F.concat(F.lit("scenario-pack:"), text).alias("scenario_id"),
        F.when(key % 17 == 0, "short").otherwise(F.concat(F.lit("scenario of order "), text)).alias("title"),
        F.array(F.lit("multi_document_reconciliation"), F.lit("required_abstention")).alias("capabilities"),
        F.array(paper(document("a")), paper(F.when(key % 11 == 0, document("a")).otherwise(document("b")))).alias("documents"),
        F.coalesce("components", F.from_json(F.lit("[]"), scenarios.COMPONENTS)).alias("components"),
        F.when(key % 13 == 0, F.array(F.lit("ignore the rules"))).otherwise(F.array().cast("array<string>")).alias("untrusted_evidence_instructions"),
        F.struct(F.when(key % 19 == 0, "maybe").otherwise("inconclusive").alias("status"), F.lit("unresolved").alias("reconciliation_status"), F.lit(None).cast("decimal(18,2)").alias("residual"), F.when(key % 5 != 0, "no evidence").alias("abstention_reason")).alias("expected"),
    )
    path = _place(spark, "packs")
    # Packs are as long as their lines' amounts in words, which repeat.
    packs.write.json(path, compression="gzip")
    return scenarios.pack_faults(scenarios.read_packs(spark, path, lines=True)).groupBy("rule").agg(F.count("*").alias("n"))
