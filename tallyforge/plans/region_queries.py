"""Registered queries over document and message chunks, mail dates and texts for retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.operators import ingestion, regions
from tallyforge.plans.catalog import query
from tallyforge.session import table

#: A key for the tests of public aliases; a deployment passes its own.
SAMPLE_KEY = bytes(range(32))
_INNER, _OUTER = (bytes(b ^ mask for b in SAMPLE_KEY.ljust(64, b"\0")).hex() for mask in (0x36, 0x5C))


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as invoices: every fifth of an unknown role, every seventh badly read."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("source_id"), F.when(key % 5 == 0, "unknown").otherwise("zomato_merchant_invoice").alias("role"), (key % 7 != 0).alias("complete"), F.lit(True).alias("quality_accepted")
    )


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of text above the table of every third order."""
    orders = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0")
    return orders.select(F.col("o_orderkey").alias("source_id"), F.lit(1).alias("page"), F.concat(F.lit("Order "), F.col("o_orderpriority")).alias("text"), F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.lit(0).alias("reading_order"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as a table: a header row whose last header spans two columns, and a row for each line number. Lines are dealt by order once, before they become cells."""
    amount = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    row = F.col("l_linenumber").cast("int")
    # A line is small and its cells are much work, so the number of parts is given: parts joined by their size would be too few.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice").repartition(parts, "l_orderkey")
    lines = dealt.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_quantity", "l_extendedprice")).alias("m")).select("l_orderkey", "l_linenumber", "m.*")
    cell = lambda column, text, span=1: F.struct(row.alias("row_index"), F.lit(column).alias("column_index"), F.lit(span).alias("column_span"), F.lit(False).alias("is_header"), text.alias("text"), F.lit(column * 10).alias("x0"), (row * 10 + 100).alias("y0"))
    head = lambda column, text, span=1: F.struct(F.lit(0).alias("row_index"), F.lit(column).alias("column_index"), F.lit(span).alias("column_span"), F.lit(True).alias("is_header"), F.lit(text).alias("text"), F.lit(column * 10).alias("x0"), F.lit(100).alias("y0"))
    body = F.array(cell(0, F.concat(F.lit(" part "), F.col("l_partkey").cast("string"))), cell(1, F.col("l_quantity").cast("int").cast("string")), cell(2, amount), cell(3, F.lit("INR")))
    top = F.array(head(0, "Item"), head(1, "Quantity"), head(2, "Amount", 2))
    # An order's first line brings the header row.
    first = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")) == 1
    cells = lines.withColumn("first", first).select("l_orderkey", F.explode(F.when(F.col("first"), F.concat(top, body)).otherwise(body)).alias("c"))
    return cells.select(
        F.col("l_orderkey").alias("source_id"), F.lit(1).alias("page"), F.concat(F.lit("t"), F.col("l_orderkey").cast("string")).alias("table_id"), "c.*", F.lit(0).alias("table_x0"), F.lit(100).alias("table_y0")
    )


ROWS = """l AS (SELECT l_orderkey AS k, l_linenumber AS n, min({'p': l_partkey, 'q': l_quantity, 'e': l_extendedprice}) AS m FROM lineitem GROUP BY ALL),
r AS (SELECT k, n, 'part ' || m.p || ' | ' || CAST(m.q AS INT) || ' | ' || CAST(m.e AS DECIMAL(18,2)) || ' | INR' AS text, CAST(m.e AS DECIMAL(18,2)) AS amount FROM l)"""
JUDGED = """j AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'unknown_layout' ELSE 'table_preserving_invoice' END AS strategy,
  CASE WHEN o_orderkey % 5 = 0 THEN 'unknown_document_role' WHEN o_orderkey % 7 = 0 THEN 'phase1_quality_rejected' WHEN o_orderkey % 3 <> 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) THEN 'no_chunkable_regions' END AS reason FROM orders)"""


@query(
    "table_chunks",
    f"""WITH {ROWS}, t AS (SELECT k, 'Item | Quantity | Amount' || chr(10) || string_agg(text, chr(10) ORDER BY n) AS text FROM r GROUP BY k)
    SELECT k AS source_id, 'item_table' AS chunk_type, 0 AS row_index, sha256(text) AS text_sha256, CAST(NULL AS DECIMAL(18,2)) AS amount, 'Item/Quantity/Amount/Amount' AS headers FROM t
    UNION ALL SELECT k, 'item_row', CAST(n AS INT), sha256(text), amount, 'Item/Quantity/Amount/Amount' FROM r""",
)
def table_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = regions.table_regions(_cells(spark, sf_dir))
    return found.select("source_id", "chunk_type", "row_index", F.sha2("text", 256).alias("text_sha256"), F.col("amount.value").cast("decimal(18,2)").alias("amount"), F.array_join("column_headers", "/").alias("headers"))


@query(
    "document_chunks",
    f"""WITH {ROWS}, {JUDGED}, c AS (
      SELECT o_orderkey AS k, 0 AS y, 0 AS kind FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT DISTINCT k, 100, 1 FROM r UNION ALL SELECT k, 100 + 10 * n, 2 FROM r)
    SELECT k AS source_id, kind, y AS y0, row_number() OVER (PARTITION BY k ORDER BY y, kind) - 1 AS reading_order FROM c JOIN j USING (k) WHERE reason IS NULL""",
)
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, chunks = regions.chunk_documents(_sources(spark, sf_dir), _blocks(spark, sf_dir), _cells(spark, sf_dir))
    return chunks.select("source_id", "kind", "y0", F.col("reading_order").cast("bigint").alias("reading_order"))


@query(
    "chunk_archive_summary",
    f"""WITH {ROWS}, {JUDGED}, s AS (SELECT k, count(*) + 1 AS n FROM r GROUP BY k)
    SELECT strategy, reason, count(*) AS sources, count(*) FILTER (reason IS NULL) AS accepted_sources, count(reason) AS quarantined_sources,
    CAST(sum(CASE WHEN reason IS NULL THEN coalesce(n, 0) + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END ELSE 0 END) AS BIGINT) AS chunks FROM j LEFT JOIN s USING (k) GROUP BY ALL""",
)
def chunk_archive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    results, _ = regions.chunk_documents(_sources(spark, sf_dir), _blocks(spark, sf_dir), _cells(spark, sf_dir))
    return regions.archive_summary(results, ["strategy", "reason"])


@query(
    "chunk_archive_benchmark",
    f"""WITH {ROWS}, {JUDGED}, t AS (SELECT count(DISTINCT k) AS tables, count(*) AS n FROM r JOIN j USING (k) WHERE reason IS NULL)
    SELECT (SELECT count(*) FROM j) AS expected_sources, (SELECT count(*) FROM j) AS evaluated_sources, (SELECT count(*) FROM j WHERE reason IS NULL) AS accepted_sources, (SELECT count(reason) FROM j) AS quarantined_sources,
    tables + n + (SELECT count(*) FROM j WHERE reason IS NULL AND k % 3 = 0) AS valid_chunks, CAST(0 AS BIGINT) AS invalid_chunks, tables AS item_table_chunks, tables, CAST(0 AS DOUBLE) AS unsupported_rate, true AS passed FROM t""",
)
def chunk_archive_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources, cells = _sources(spark, sf_dir), _cells(spark, sf_dir)
    results, chunks = regions.chunk_documents(sources, _blocks(spark, sf_dir), cells)
    tables = cells.select("source_id", "table_id").distinct().join(results.where("status = 'accepted'").select("source_id"), "source_id", "left_semi")
    return regions.archive_benchmark(sources, results, chunks, tables)


@query(
    "message_chunks",
    r"""WITH m AS (SELECT conv_id, turn, trim(coalesce(text, ''), E' \t\n\r') AS body, role FROM conversations)
    SELECT conv_id || '/' || turn AS source_id, 'accepted' AS status, conv_id || '/' || turn || ':' || CASE WHEN body <> '' THEN 'body' ELSE 'subject' END AS source_region_id, sha256(CASE WHEN body <> '' THEN body ELSE role END) AS text_sha256 FROM m""",
)
def message_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("source_id"), F.col("text").alias("body"), F.col("role").alias("subject"))
    results, chunks = regions.chunk_messages(messages)
    return results.select("source_id", "status").join(chunks, "source_id").select("source_id", "status", "source_region_id", F.sha2("text", 256).alias("text_sha256"))


@query(
    "chunk_proposals",
    """WITH p AS (SELECT l_orderkey AS k, l_linenumber AS c, l_quantity = 50 AS bad FROM lineitem),
    c AS (SELECT k, c, count(*) AS n, count(*) FILTER (bad) AS bad FROM p GROUP BY ALL), s AS (SELECT k, sum(n) AS n, sum(bad + CASE WHEN n > 1 THEN 1 ELSE 0 END) AS bad FROM c GROUP BY k)
    SELECT o_orderkey AS source_id, CASE WHEN n IS NULL OR bad > 0 THEN 'quarantined' ELSE 'accepted' END AS status, CASE WHEN n IS NULL THEN 'empty_chunk_proposal' WHEN bad > 0 THEN 'invalid_chunk_proposal' END AS reason,
    CAST(CASE WHEN n IS NULL OR bad > 0 THEN 0 ELSE n END AS BIGINT) AS chunks FROM orders LEFT JOIN s ON k = o_orderkey""",
)
def chunk_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as proposals; those of quantity 50 aren't accepted."""
    proposed = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("source_id"), F.col("l_linenumber").alias("chunk_id"), F.when(F.col("l_quantity") == 50, "quarantined").otherwise("accepted").alias("status"), F.lit("a line").alias("text"), F.col("l_linenumber").alias("reading_order")
    )
    return regions.validate_proposals(_sources(spark, sf_dir), proposed)


@query(
    "mail_times",
    """SELECT o_orderkey AS orderkey, CAST(CASE o_orderkey % 5 WHEN 3 THEN CAST(o_orderdate AS TIMESTAMP) - INTERVAL 330 MINUTE WHEN 4 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) END AS VARCHAR) AS sent_at FROM orders""",
)
def mail_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written as seconds, milliseconds, ISO, a mail date at +0530, or not at all, and read back."""
    at = F.col("o_orderdate").cast("timestamp")
    way = F.col("o_orderkey") % 5
    written = (
        F.when(way == 0, F.unix_seconds(at).cast("string"))
        .when(way == 1, F.unix_millis(at).cast("string"))
        .when(way == 2, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(way == 3, F.date_format(at, "EEE, d MMM yyyy HH:mm:ss '+0530'"))
        .otherwise(F.lit("some day"))
    )
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"), F.date_format(regions.parse_time(written), "yyyy-MM-dd HH:mm:ss").alias("sent_at"))


@query(
    "public_order_aliases",
    f"""SELECT o_orderkey AS orderkey, 'ORD-' || CASE WHEN o_orderkey % 2 = 0 THEN 'ZM' ELSE 'SW' END || '-' || upper(left(sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') ||
    encode('public-order-v1:' || CASE WHEN o_orderkey % 2 = 0 THEN 'zomato' ELSE 'swiggy' END || ':' || o_orderkey || ':' || o_custkey)))), 12)) AS alias FROM orders""",
)
def public_order_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    platform = F.when(F.col("o_orderkey") % 2 == 0, "zomato").otherwise("swiggy")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"), regions.public_order_id(platform, F.col("o_orderkey"), F.col("o_custkey").cast("string"), SAMPLE_KEY).alias("alias"))


def _clean(name: str) -> str:
    return rf"trim(coalesce({name}, ''), E' \t\n\r')"


@query(
    "evidence_texts",
    rf"""WITH p AS (SELECT item_id, {_clean("text")} AS t FROM benchmark) SELECT item_id, sha256(left(CASE WHEN t = '' OR t = left(t, 40) THEN nullif(left(t, 40), '') ELSE {_clean("left(t, 40)")} || chr(10) || chr(10) || 'Source evidence:' || chr(10) || t END, 4000)) AS evidence_sha256,
    sha256(left(left(t, 40) || chr(10) || 'Evidence: ' || t, 8000)) AS embedded_sha256 FROM p""",
)
def evidence_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages with their first 40 characters as summary."""
    named = table(spark, sf_dir, "benchmark").withColumn("t", regions.stripped(F.coalesce("text", F.lit("")))).withColumn("s", F.left("t", F.lit(40)))
    return named.select("item_id", F.sha2(regions.evidence_text(F.col("s"), F.col("t")), 256).alias("evidence_sha256"), F.sha2(regions.embedded_text(F.col("s"), F.col("t")), 256).alias("embedded_sha256"))


@query(
    "embedding_batches",
    """WITH n AS (SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1) // 96 AS batch FROM embeddings)
    SELECT batch, count(*) AS inputs, 'batches/' || sha256('{"dimension":64,"model":"m","node_ids":[' || string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY vec_id) || ']}') || '.json' AS path FROM n GROUP BY batch""",
)
def embedding_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = regions.embedding_batches(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id")), 96, "m", 64)
    return found.select("batch", F.size("node_ids").cast("bigint").alias("inputs"), "path")


@query(
    "receipt_fields",
    """SELECT o_orderkey AS orderkey, 0 AS line, 'Order' AS name, o_orderpriority AS value FROM orders UNION ALL SELECT o_orderkey, 2, 'Clerk name', o_orderstatus FROM orders""",
)
def receipt_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Order: "), F.col("o_orderpriority"), F.lit("\nno field here\nClerk name :  "), F.col("o_orderstatus"), F.lit("  "))
    return regions.key_values(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"), text.alias("text")), "orderkey")


@query(
    "entity_mentions",
    """SELECT o_orderkey AS orderkey, 'merchant' AS entity_type, 'Store ' || o_custkey AS value, 'store ' || o_custkey AS normalized, CAST(0.90 AS DECIMAL(3,2)) AS confidence FROM orders
    UNION ALL SELECT o_orderkey, 'delivery_partner', 'Rider ' || o_orderstatus, 'rider ' || lower(o_orderstatus), CAST(0.90 AS DECIMAL(3,2)) FROM orders""",
)
def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Sold By: Store "), F.col("o_custkey").cast("string"), F.lit("\nDelivery Partner: Rider "), F.col("o_orderstatus"), F.lit("\n"))
    facts = ingestion.fact_spans(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"), text.alias("text")), "orderkey")
    return regions.entity_mentions(facts, "orderkey").select("orderkey", "entity_type", "value", "normalized", "confidence")
