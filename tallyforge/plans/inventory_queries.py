"""Registered queries over a mail collection that Spark writes from the conversations first."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.plans.catalog import query
from tallyforge.session import shared_dir, table
from tallyforge.sources.inventory import build_inventory


def _collection(spark: SparkSession, sf_dir: str) -> str:
    """Every turn as a mail in a mailbox: users write from one platform, assistants from the other, others from neither; two of three mails name an order."""
    role = F.col("role")
    number = F.lpad(F.col("conv_id").cast("string"), 8, "0")
    order = F.when(F.col("turn") % 3 == 0, "none").when(role == "user", F.concat(F.lit("Order ID: 12345"), number)).otherwise(F.concat(F.lit("Order ID: 12"), number))
    sender = F.when(role == "user", "x@swiggy.in").when(role == "assistant", "Y <y@mail.zomato.com>").otherwise("z@home.org")
    body = F.regexp_replace(F.coalesce("text", F.lit("")), "(?m)^From ", ">From ")
    mail = F.concat(F.lit("From a@b Mon Jan  1 00:00:00 2024\nFrom: "), sender, F.lit("\nSubject: turn "), F.concat_ws("/", "conv_id", "turn"), F.lit("\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"), order, F.lit("\n"), body)
    root = f"{shared_dir(spark)}/tallyforge/collection-{uuid.uuid4().hex}"
    table(spark, sf_dir, "conversations").select(mail.alias("value")).write.text(f"{root}/takeout/Takeout/Mail/all.mbox")
    return root


@query(
    "mail_inventory_summary",
    """WITH m AS (SELECT role, conv_id, turn % 3 <> 0 AS named, role IN ('user', 'assistant') AS known FROM conversations)
    SELECT count(*) FILTER (known) AS relevant_messages, count(*) FILTER (NOT known) AS excluded_messages, 0::BIGINT AS unique_documents, count(*) FILTER (known) AS mail_only,
      count(DISTINCT CASE WHEN named AND known THEN role || conv_id END) AS resolved, count(*) FILTER (known AND NOT named) AS provisional,
      count(DISTINCT CASE WHEN named AND known THEN role || conv_id END) + count(*) FILTER (known AND NOT named) AS total FROM m""",
)
def mail_inventory_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_inventory(spark, _collection(spark, sf_dir)).summary().select("relevant_messages", "excluded_messages", "unique_documents", "mail_only", "resolved", "provisional", "total")


@query(
    "mail_order_evidence",
    """SELECT CASE role WHEN 'user' THEN 'swiggy' ELSE 'zomato' END AS platform, 'EMAIL_ONLY' AS kind, CASE WHEN turn % 3 <> 0 THEN CASE role WHEN 'user' THEN '12345' ELSE '12' END || lpad(conv_id::VARCHAR, 8, '0') END AS order_id,
      count(*) AS messages FROM conversations WHERE role IN ('user', 'assistant') GROUP BY ALL""",
)
def mail_order_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_inventory(spark, _collection(spark, sf_dir)).evidence.groupBy("platform", "kind", "order_id").agg(F.countDistinct("message_id").alias("messages"))
