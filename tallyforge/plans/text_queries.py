"""Registered queries over texts, sessions, events and proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import governance, ingestion, proposals, research
from tallyforge.plans.catalog import query
from tallyforge.plans.templates import plan_questions
from tallyforge.session import table
from tallyforge.streaming import events as streams


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as questions, whole; null as empty."""
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("question"))


def _found(patterns: tuple[str, ...]) -> str:
    """SQL of `governance`'s patterns over `question`."""
    return "regexp_matches(question, '(?i)" + "|".join(f"(?:{x})" for x in patterns).replace("'", "''") + "')"


def _has(*words: str) -> str:
    return "(" + " OR ".join(f"contains(l, '{x}')" for x in words) + ")"


Q = r"q AS (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS question, lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS l FROM conversations WHERE role = 'user')"
REFUSED = f"""CASE WHEN {_found(governance.PROMPT_EXTRACTION)} THEN 'prompt_or_secret_extraction' WHEN {_found(governance.ARBITRARY_QUERY)} THEN 'arbitrary_query'
    WHEN {_found(governance.OFF_SCOPE)} AND ({_found(governance.OFF_SCOPE[: governance.ALWAYS_OFF_SCOPE])} OR NOT {_found((governance.IN_SCOPE,))}) THEN 'off_scope' WHEN question = '' THEN 'empty' END"""
INTENT = f"""CASE WHEN {_has("offset", "comparable", "multi-hop")} AND {_has("discount", "fee", "price", "meal")} THEN 'multi_hop_economic' WHEN {_has("prove", "show evidence", "source for")} THEN 'evidence_request'
    WHEN l LIKE 'find %' OR l LIKE 'search %' OR l LIKE 'locate %' OR {_has("containing", "invoice rows")} THEN 'lexical_lookup' WHEN {_has("felt ", "seemed ", "which orders")} THEN 'semantic_discovery'
    WHEN {_has("how much", "total fee", "total spend", "did i pay", "sum of")} THEN 'financial_aggregation' ELSE 'exact_graph' END"""
PLATFORM = r"CASE WHEN regexp_matches(l, '\bswiggy\b') THEN 'swiggy' WHEN regexp_matches(l, '\bzomato\b') THEN 'zomato' END"
COMPONENT = "CASE " + " ".join(f"WHEN {_has(*words)} THEN '{name}'" for name, words in governance.COMPONENT_WORDS) + " END"


@query("guardrail_reasons", f"WITH {Q} SELECT {REFUSED} AS refusal, count(*) AS questions FROM q GROUP BY ALL")
def guardrail_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = _questions(spark, sf_dir).withColumn("question", governance.clean_question(F.col("question")))
    return cleaned.groupBy(governance.refusal(F.col("question")).alias("refusal")).agg(F.count("*").alias("questions"))


@query(
    "intent_classification",
    f"WITH {Q}, r AS (SELECT *, {INTENT} AS intent, {PLATFORM} AS platform FROM q WHERE ({REFUSED}) IS NULL) SELECT intent, count(*) AS questions, count(*) FILTER (platform = 'swiggy') AS on_swiggy FROM r GROUP BY intent",
)
def intent_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = plan_questions(_questions(spark, sf_dir)).where("refusal is null")
    return planned.groupBy("intent").agg(F.count("*").alias("questions"), F.count_if(F.col("slots.platform") == "swiggy").alias("on_swiggy"))


@query(
    "template_routing",
    f"""WITH {Q}, r AS (SELECT *, {INTENT} AS intent FROM q WHERE ({REFUSED}) IS NULL),
    t AS (SELECT CASE WHEN {_has("delivery")} AND {_has("who", "person", "times", "delivered")} THEN ['delivery_mention_count'] WHEN {_has("price", "cost")} AND {_has("ago", "history", "year", "same")} THEN ['merchant_item_price_history']
      WHEN intent = 'financial_aggregation' THEN ['financial_component_sum'] WHEN intent = 'evidence_request' THEN ['evidence_for_money_component'] WHEN intent = 'lexical_lookup' THEN ['fulltext_evidence']
      WHEN intent = 'semantic_discovery' THEN ['fulltext_evidence', 'order_reconstruction'] WHEN intent = 'multi_hop_economic' THEN ['merchant_item_price_history', 'financial_component_sum'] ELSE ['merchant_order_count'] END AS names FROM r)
    SELECT template, count(*) AS questions FROM (SELECT unnest(names) AS template FROM t) GROUP BY template""",
)
def template_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = plan_questions(_questions(spark, sf_dir)).where("refusal is null")
    return planned.select(F.explode("templates").alias("template")).groupBy("template").agg(F.count("*").alias("questions"))


@query(
    "privacy_violations",
    r"""SELECT doc_id, kind FROM (
      SELECT doc_id, unnest([CASE WHEN regexp_matches(text, '\b[^\s@]+@[^\s@]+\.[^\s@]+\b') THEN 'email' END, CASE WHEN regexp_matches(text, '(^|[^0-9])[0-9]{10,}([^0-9]|$)') THEN 'long_number' END,
        CASE WHEN regexp_matches(text, '\b[0-9a-fA-F]{64}\b') THEN 'content_hash' END]) AS kind FROM documents) WHERE kind IS NOT NULL""",
)
def privacy_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.private_values(table(spark, sf_dir, "documents"), "doc_id", ["text"]).select("doc_id", "kind")


@query(
    "session_last_turns",
    "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2",
)
def session_last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.last_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn", 2).select("conv_id", "turn", "role")


@query(
    "slot_carry_forward",
    f"""WITH {Q}, s AS (SELECT conv_id, turn, {PLATFORM} AS platform, {COMPONENT} AS component_type FROM q)
    SELECT conv_id, turn, last_value(platform IGNORE NULLS) OVER w AS platform, last_value(component_type IGNORE NULLS) OVER w AS component_type FROM s
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)""",
)
def slot_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _questions(spark, sf_dir).withColumn("s", governance.slots(F.col("question"))).select("conv_id", "turn", "s.platform", "s.component_type")
    return governance.carry_slots(named, "conv_id", "turn", ["platform", "component_type"])


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query(
    "tumbling_daily",
    "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS events, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total FROM events GROUP BY ALL",
)
def tumbling_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = streams.tumbling_frame(_events(spark, sf_dir), "1 day", ["event_type"])
    return found.select(F.to_date("window_start").cast("string").alias("day"), "event_type", "events", "total")


@query(
    "event_session_windows",
    """WITH l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events)
    SELECT user_id, count(*) FILTER (prev IS NULL OR ts >= prev + INTERVAL 30 MINUTE) AS sessions, count(*) AS events FROM l GROUP BY user_id""",
)
def event_session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = streams.session_frame(_events(spark, sf_dir), "30 minutes", ["user_id"])
    return found.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("events").alias("events"))


@query("rate_limit_decisions")
def rate_limit_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two events an hour and user; tests hold it against a plain walk."""
    return streams.limited(_events(spark, sf_dir), 2, 3600.0)


#: The character references that the pages use.
NAMED = (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))
_PLAIN = "regexp_replace(t, '</?[A-Za-z][^>]*>', ' ', 'g')"
for _name, _sign in NAMED:
    _PLAIN = f"replace({_PLAIN}, '{_name}', '{_sign}')"


@query(
    "html_visible_text",
    rf"""WITH a AS (SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->|<[!?][^>]*>', ' ', 'g') AS t FROM pages),
    b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?is)<script[^>]*>.*?</script[^>]*>', ' ', 'g'), '(?is)<style[^>]*>.*?</style[^>]*>', ' ', 'g') AS t FROM a),
    c AS (SELECT page_id, regexp_replace(t, '(?is)<head(\s[^>]*)?>.*?</head[^>]*>', ' ', 'g') AS t FROM b),
    d AS (SELECT page_id, regexp_replace(t, '(?i)</?({'|'.join(ingestion.BLOCKS)})([\s/][^>]*)?>', chr(10), 'g') AS t FROM c),
    e AS (SELECT page_id, string_split({_PLAIN}, chr(10)) AS lines FROM d),
    v AS (SELECT page_id, array_to_string(list_filter(list_transform(lines, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS visible FROM e)
    SELECT page_id, length(visible) AS length, sha256(visible) AS sha256 FROM v""",
)
def html_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("visible", ingestion.visible_text(F.col("html")))
    return pages.select("page_id", F.length("visible").alias("length"), F.sha2("visible", 256).alias("sha256"))


@query("fact_spans")
def fact_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingestion.fact_spans(_receipts(spark, sf_dir), "orderkey")


@query("money_spans")
def money_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingestion.money_spans(_receipts(spark, sf_dir), "orderkey").select("orderkey", "start", "end", "kind", "amount", "precision")


def _receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the text of a receipt."""
    order = table(spark, sf_dir, "orders")
    total = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    text = F.concat(
        F.lit("Order ID: "), F.lpad(F.col("o_orderkey").cast("string"), 12, "9"), F.lit("\nOrdered on: "), F.to_date("o_orderdate").cast("string"), F.lit("\nSold By: Store "), F.col("o_custkey").cast("string"),
        F.lit("\nPlatform fee: ₹5.00\nGrand total: ₹"), total, F.lit("\n"),
    )
    return order.select(F.col("o_orderkey").alias("orderkey"), "o_orderpriority", text.alias("text"))


@query(
    "receipt_totals",
    "SELECT count(*) AS receipts, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total, CAST(count(*) * 5 AS DECIMAL(38,2)) AS fees FROM orders",
)
def receipt_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts read back from receipt texts, summed."""
    spans = ingestion.money_spans(_receipts(spark, sf_dir), "orderkey")
    value = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("amount").cast("decimal(18,2)"))).cast("decimal(38,2)")
    return spans.agg(F.countDistinct("orderkey").alias("receipts"), value("invoice_total").alias("total"), value("platform_fee").alias("fees"))


@query(
    "receipt_order_ids",
    "SELECT o_orderkey AS orderkey, lpad(CAST(o_orderkey AS VARCHAR), 12, '9') AS order_id, 'order_header' AS chunk_type FROM orders",
)
def receipt_order_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _receipts(spark, sf_dir).withColumn("ids", ingestion.order_ids(F.lit("swiggy"), F.col("text")))
    return found.select("orderkey", F.get("ids", F.lit(0)).alias("order_id"), ingestion.chunk_type(F.col("text")).alias("chunk_type"))


@query(
    "chunk_types",
    r"""SELECT CASE WHEN lower(text) LIKE '%refund%' THEN 'refund_block' WHEN lower(text) LIKE '%discount%' OR lower(text) LIKE '%coupon%' THEN 'discount_block' WHEN regexp_matches(lower(text), '\b(?:cgst|sgst|igst|gst|tax)\b') THEN 'tax_block' ELSE 'other' END AS kind,
    count(*) AS chunks FROM benchmark GROUP BY ALL""",
)
def chunk_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = ingestion.chunk_type(F.col("text"))
    kind = F.when(kind.isin("refund_block", "discount_block", "tax_block"), kind).otherwise("other")
    return table(spark, sf_dir, "benchmark").groupBy(kind.alias("kind")).agg(F.count("*").alias("chunks"))


@query(
    "document_roles",
    """SELECT CASE WHEN doc_id % 4 = 0 THEN 'zomato_platform_fee_invoice' WHEN doc_id % 4 = 1 THEN 'zomato_merchant_invoice' WHEN doc_id % 4 = 2 THEN 'zomato_order_summary' ELSE 'swiggy_instamart_seller_invoice' END AS role,
    CASE doc_id % 4 WHEN 0 THEN 'fee_and_tax' WHEN 2 THEN 'order_component' ELSE 'table_preserving_invoice' END AS strategy, count(*) AS documents FROM documents GROUP BY ALL""",
)
def document_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id") % 4
    names = F.when(d == 0, "user_charge_invoice.pdf").when(d == 1, "Order_Invoice.pdf").when(d == 2, "order_id_1.pdf").otherwise("a.pdf")
    role = ingestion.document_role(F.when(d < 3, "zomato").otherwise("swiggy"), F.when(d == 3, "instamart").otherwise("food"), names, F.lit(""))
    return table(spark, sf_dir, "documents").groupBy(role.alias("role"), ingestion.chunk_strategy(role).alias("strategy")).agg(F.count("*").alias("documents"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as chunks of their conversation's bundle."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("bundle_id"), F.col("role").alias("cohort"), F.concat_ws("/", "conv_id", "turn").alias("chunk_id"), F.col("turn").alias("place"), "text"
    )


@query("batch_packing_summary")
def batch_packing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = proposals.plan_batches(_chunks(spark, sf_dir), proposals.BatchPolicy(target_tokens=400, most_tokens=800, most_chunks=16, most_bundles=8))
    return planned.groupBy("batch_id").agg(F.count("*").alias("chunks"), F.countDistinct("bundle_id").alias("bundles"))


@query("batch_coverage", "SELECT count(*) AS chunks, count(*) AS planned FROM conversations")
def batch_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk is in the plan once, placed or not."""
    chunks = _chunks(spark, sf_dir)
    planned = proposals.plan_batches(chunks, proposals.BatchPolicy(target_tokens=400, most_tokens=800))
    return chunks.join(planned.select("chunk_id").withColumn("there", F.lit(1)), "chunk_id", "left").agg(F.count("*").alias("chunks"), F.sum("there").alias("planned"))


@query(
    "token_estimates",
    "SELECT conv_id, turn, CAST(ceil(len(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) / 3.0) + strlen(text) - len(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) AS BIGINT) AS tokens FROM conversations",
)
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", proposals.input_tokens(F.col("text")).alias("tokens"))


@query(
    "finding_verdicts",
    """WITH s AS (SELECT event_type AS hypothesis_id, value > 90 AS supports, value < 5 AS refutes FROM events)
    SELECT hypothesis_id, CASE WHEN bool_or(supports) AND bool_or(refutes) THEN 'inconclusive' WHEN bool_or(supports) THEN 'supported' WHEN bool_or(refutes) THEN 'refuted' ELSE 'inconclusive' END AS verdict,
    round(count(*) FILTER (supports OR refutes) / count(*), 6) AS confidence, count(*) AS steps FROM s GROUP BY ALL""",
)
def finding_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = _events(spark, sf_dir).select(F.col("event_type").alias("hypothesis_id"), (F.col("value") > 90).alias("supports"), (F.col("value") < 5).alias("refutes"))
    return research.findings(steps)


@query(
    "hypothesis_deduplication",
    """WITH h AS (SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS s, lang FROM documents)
    SELECT lang AS metric, count(DISTINCT s) AS hypotheses FROM h GROUP BY lang""",
)
def hypothesis_deduplication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as statements: each once, spelling of spaces and letter case aside."""
    proposed = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("hypothesis_id"), F.col("text").alias("statement"), F.col("lang").alias("metric"), F.lit("all").alias("window"))
    ledger = proposed.limit(0).select(F.lit("").alias("fingerprint"))
    return research.new_hypotheses(proposed, ledger).groupBy("metric").agg(F.count("*").alias("hypotheses"))
