"""Chunks of documents and messages: page regions, tables and their rows, reading order, quarantine, archive checks.

Sources: source_id, role, complete, quality_accepted. Text blocks: source_id, page, text, x0, y0,
reading_order. Cells: source_id, page, table_id, row_index, column_index, column_span, is_header,
text, x0, y0 (and the table's table_x0, table_y0). A table lies on one page, so its cells are a
small group; everything is partitioned by source, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators import ingestion

#: Words by which a column of amounts is known, and the form of an amount cell.
AMOUNT_LABELS = "amount|price|total|value|rate"
AMOUNT_CELL = r"^-?\d[\d,]*(?:\.\d+)?$"
#: Kinds of facts that name an entity.
ENTITY_KINDS = {"merchant": "merchant", "ordered_from": "merchant", "legal_entity": "legal_entity", "delivery_partner": "delivery_partner"}
MENTION_CONFIDENCE = "0.90"
#: Lengths that texts for retrieval are cut to.
EVIDENCE_LENGTH, SPARSE_LENGTH, RETRIEVAL_LENGTH, EMBEDDED_LENGTH = 4_000, 1_200, 1_600, 8_000
KEY_VALUE = r"^\s*([A-Za-z][A-Za-z0-9 /&().-]{1,60}?)\s*[:：]\s*(\S.*?)\s*$"

REGION = ["source_id", "page", "y0", "x0", "kind", "row_index", "chunk_type", "text", "table_id", "column_headers", "amount"]


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def column_headers(cells: Column, width: Column) -> Column:
    """The header over each column: that of the first header cell, in order, whose span covers it; else empty."""
    headers = F.filter(cells, lambda c: c["is_header"])
    over = lambda i: F.get(F.filter(headers, lambda c: (c["column_index"] <= i) & (i < c["column_index"] + c["column_span"])), F.lit(0))["text"]
    return F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.coalesce(over(i), F.lit("")))


def row_amount(raw: Column, cells: Column, headers: Column) -> Column:
    """The first number in a column of amounts, with its last place in the row's text: (value, start, end); null if none."""
    header = lambda c: F.lower(F.coalesce(F.get(headers, c["column_index"]), F.lit("")))
    found = F.filter(cells, lambda c: header(c).rlike(AMOUNT_LABELS) & stripped(c["text"]).rlike(AMOUNT_CELL))
    value = stripped(F.get(found, F.lit(0))["text"])
    start = F.length(raw) - F.instr(F.reverse(raw), F.reverse(value)) + 1 - F.length(value)
    return F.when(value.isNotNull(), F.struct(value.alias("value"), start.alias("start"), (start + F.length(value)).alias("end")))


def table_regions(cells: DataFrame) -> DataFrame:
    """A parent region for each table and a region for each row that isn't all headers and has a text."""
    cell = F.struct("row_index", "column_index", "column_span", "is_header", "text", "x0", "y0")
    tables = cells.withColumn("text", F.coalesce("text", F.lit(""))).groupBy("source_id", "page", "table_id").agg(
        F.array_sort(F.collect_list(cell)).alias("cells"),
        F.max(F.col("column_index") + F.col("column_span")).alias("width"),
        F.array_sort(F.collect_set("row_index")).alias("rows"),
        F.min("table_x0").alias("x0"),
        F.min("table_y0").alias("y0"),
    )
    line = lambda cs: F.array_join(F.transform(cs, lambda c: stripped(c["text"])), " | ")
    row = lambda i: F.filter(F.col("cells"), lambda c: c["row_index"] == i)
    tables = tables.withColumn("column_headers", column_headers(F.col("cells"), F.col("width"))).withColumn("lines", F.transform("rows", lambda i: F.struct(i.alias("row_index"), row(i).alias("cells"), line(row(i)).alias("text"))))
    parents = tables.select(
        "source_id", "page", "y0", "x0", F.lit(1).alias("kind"), F.lit(0).alias("row_index"), F.lit("item_table").alias("chunk_type"),
        F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("text"), "table_id", "column_headers", F.lit(None).cast("struct<value:string,start:int,end:int>").alias("amount"),
    )
    kept = F.filter("lines", lambda x: F.exists(x["cells"], lambda c: ~c["is_header"]) & x["text"].rlike(r"[^ |]"))
    rows = tables.select("source_id", "page", "table_id", "column_headers", F.explode(kept).alias("r"))
    rows = rows.select(
        "source_id", "page", F.array_min(F.transform("r.cells", lambda c: c["y0"])).alias("y0"), F.array_min(F.transform("r.cells", lambda c: c["x0"])).alias("x0"), F.lit(2).alias("kind"),
        "r.row_index", F.lit("item_row").alias("chunk_type"), "r.text", "table_id", "column_headers", row_amount(F.col("r.text"), F.col("r.cells"), F.col("column_headers")).alias("amount"),
    )
    return parents.unionByName(rows).select(*REGION)


def block_regions(blocks: DataFrame) -> DataFrame:
    """A region for each block of text."""
    return blocks.select(
        "source_id", "page", "y0", "x0", F.lit(0).alias("kind"), F.col("reading_order").alias("row_index"), ingestion.chunk_type(F.col("text")).alias("chunk_type"), "text",
        F.lit(None).cast("string").alias("table_id"), F.array().cast("array<string>").alias("column_headers"), F.lit(None).cast("struct<value:string,start:int,end:int>").alias("amount"),
    )


def chunk_documents(sources: DataFrame, blocks: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What became of each document, and the chunks of those accepted, in reading order.

    Results: source_id, strategy, status, reason, chunks. A document is refused whole: for a role
    that nobody knows, for a failed extraction, or for having nothing to cut.
    """
    # Blocks go to their source before they meet its tables, so that what follows finds regions by source and moves no text again.
    regions = block_regions(blocks.repartition("source_id")).unionByName(table_regions(cells))
    strategy = ingestion.chunk_strategy(F.col("role"))
    sound = F.coalesce(F.col("complete") & F.col("quality_accepted"), F.lit(False))
    judged = sources.select("source_id", strategy.alias("strategy"), F.when(strategy == "unknown_layout", "unknown_document_role").when(~sound, "phase1_quality_rejected").alias("reason"))
    sizes = regions.groupBy("source_id").agg(F.count("*").alias("regions"))
    results = judged.join(sizes, "source_id", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("regions").isNull(), "no_chunkable_regions")))
    results = results.select(
        "source_id", "strategy", F.when(F.col("reason").isNull(), "accepted").otherwise("quarantined").alias("status"), "reason",
        F.when(F.col("reason").isNull(), F.col("regions")).otherwise(F.lit(0)).cast("bigint").alias("chunks"),
    )
    order = Window.partitionBy("source_id").orderBy("page", "y0", "x0", "kind", "row_index", "text")
    chunks = regions.join(judged.where("reason is null").select("source_id", "strategy"), "source_id")
    return results, chunks.withColumn("reading_order", F.row_number().over(order) - 1)


def chunk_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same for messages (source_id, body, subject): one chunk each, of the body or else the subject; none if both are blank."""
    body, subject = (stripped(F.coalesce(name, F.lit(""))) for name in ("body", "subject"))
    named = messages.select("source_id", F.when(body != "", body).otherwise(subject).alias("text"), F.when(body != "", "body").otherwise("subject").alias("region"))
    blank = F.col("text") == ""
    results = named.select(
        "source_id", F.lit("message_order").alias("strategy"), F.when(blank, "quarantined").otherwise("accepted").alias("status"), F.when(blank, "no_message_text").alias("reason"),
        F.when(blank, 0).otherwise(1).cast("bigint").alias("chunks"),
    )
    chunks = named.where(~blank).select("source_id", ingestion.chunk_type(F.col("text")).alias("chunk_type"), "text", F.concat_ws(":", F.col("source_id").cast("string"), "region").alias("source_region_id"), F.lit(0).alias("reading_order"))
    return results, chunks


def entity_mentions(facts: DataFrame, key: str) -> DataFrame:
    """The facts (see `ingestion.fact_spans`) that name a merchant, a legal entity or a delivery partner: key, entity_type, value, normalized, start, end, confidence."""
    kind = F.create_map(*[F.lit(x) for pair in ENTITY_KINDS.items() for x in pair])[F.col("kind")]
    normal = F.lower(F.regexp_replace(stripped(F.col("value")), r"(?U)\s+", " "))
    return facts.select(key, kind.alias("entity_type"), "value", normal.alias("normalized"), "start", "end", F.lit(MENTION_CONFIDENCE).cast("decimal(3,2)").alias("confidence")).where("entity_type is not null")


def query_families(chunk_type: Column, fact_kinds: Column, entity_types: Column, has_money: Column) -> Column:
    """What questions a chunk can help with, in order; every chunk serves as evidence."""
    kind = F.lower(chunk_type)
    cases = {
        "delivery_analysis": F.array_contains(entity_types, "delivery_partner"),
        "evidence_replay": F.lit(True),
        "financial_breakdown": has_money,
        "item_search": kind.isin("item_table", "item_row"),
        "merchant_analysis": F.array_contains(entity_types, "merchant"),
        "order_lookup": F.array_contains(fact_kinds, "order_id"),
        "payment_analysis": kind == "payment_assertion",
        "tax_analysis": kind == "tax_block",
    }
    return F.filter(F.array(*[F.when(F.coalesce(hit, F.lit(False)), name) for name, hit in cases.items()]), lambda x: x.isNotNull())


def validate_proposals(sources: DataFrame, proposals: DataFrame) -> DataFrame:
    """Accepts or refuses each source's proposed chunks as a whole: source_id, status, reason, chunks.

    Proposals: source_id, chunk_id, status, text, reading_order. One that lacks a field, isn't accepted
    itself or repeats an id refuses its source, and so does having none.
    """
    bad = F.col("chunk_id").isNull() | F.coalesce(F.col("status") != "accepted", F.lit(True)) | F.coalesce(stripped(F.col("text")) == "", F.lit(True)) | F.coalesce(F.col("reading_order") < 0, F.lit(True))
    by_chunk = proposals.groupBy("source_id", "chunk_id").agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"))
    by_source = by_chunk.groupBy("source_id").agg(F.sum("n").alias("n"), F.sum(F.col("bad") + F.when(F.col("n") > 1, 1).otherwise(0)).alias("bad"))
    reason = F.when(F.col("n").isNull(), "empty_chunk_proposal").when(F.col("bad") > 0, "invalid_chunk_proposal")
    judged = sources.select("source_id").join(by_source, "source_id", "left").withColumn("reason", reason)
    return judged.select("source_id", F.when(F.col("reason").isNull(), "accepted").otherwise("quarantined").alias("status"), "reason", F.when(F.col("reason").isNull(), F.col("n")).otherwise(F.lit(0)).cast("bigint").alias("chunks"))


def archive_summary(results: DataFrame, keys: list[str]) -> DataFrame:
    """Sources accepted and refused, and chunks, in one aggregation; `keys` may be empty."""
    return results.groupBy(*keys).agg(
        F.count("*").alias("sources"), F.count_if(F.col("status") == "accepted").alias("accepted_sources"), F.count_if(F.col("status") == "quarantined").alias("quarantined_sources"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks")
    )


def archive_benchmark(expected: DataFrame, results: DataFrame, chunks: DataFrame, tables: DataFrame) -> DataFrame:
    """One row: whether every expected source was judged, every table has its chunk and every chunk is sound.

    Expected: source_id. Chunks: source_id, chunk_type, text. Tables: source_id, table_id of accepted sources.
    """
    invalid = F.coalesce(stripped(F.col("text")) == "", F.lit(True))
    judged = expected.select("source_id").join(results.select("source_id", "status").withColumn("judged", F.lit(True)), "source_id", "left").agg(
        F.count("*").alias("expected_sources"), F.count("judged").alias("evaluated_sources"), F.count_if(F.col("status") == "accepted").alias("accepted_sources"), F.count_if(F.col("status") == "quarantined").alias("quarantined_sources")
    )
    counted = chunks.agg(F.count_if(~invalid).alias("valid_chunks"), F.count_if(invalid).alias("invalid_chunks"), F.count_if(F.col("chunk_type") == "item_table").alias("item_table_chunks"))
    found = tables.agg(F.count("*").alias("tables"))
    # One row each.
    both = judged.crossJoin(counted).crossJoin(found)
    rate = F.coalesce(F.try_divide(F.col("invalid_chunks"), F.col("valid_chunks") + F.col("invalid_chunks")), F.lit(0.0))
    passed = (F.col("evaluated_sources") == F.col("expected_sources")) & (F.col("accepted_sources") + F.col("quarantined_sources") == F.col("expected_sources")) & (F.col("invalid_chunks") == 0) & (F.col("item_table_chunks") == F.col("tables"))
    return both.withColumns({"unsupported_rate": F.round(rate, 6), "passed": passed})


def evidence_text(summary: Column, text: Column) -> Column:
    """Summary and text of a chunk, once if they are equal; null if both are blank."""
    parts = F.array_distinct(F.filter(F.array(stripped(summary), stripped(text)), lambda x: x.isNotNull() & (x != "")))
    joined = F.when(F.size(parts) == 1, F.get(parts, F.lit(0))).when(F.size(parts) > 1, F.array_join(parts, "\n\nSource evidence:\n"))
    return F.left(joined, F.lit(EVIDENCE_LENGTH))


def embedded_text(summary: Column, text: Column) -> Column:
    """What of a chunk is embedded."""
    return F.left(F.concat(F.coalesce(summary, F.lit("")), F.lit("\nEvidence: "), F.coalesce(text, F.lit(""))), F.lit(EMBEDDED_LENGTH))


def retrieval_text(title: Column, summary: Column, chunk_type: Column, financial_role: Column, families: Column) -> Column:
    """The sentence by which a region is found."""
    spaced = lambda x: F.replace(x, F.lit("_"), F.lit(" "))
    role = F.when(financial_role == "none", "").otherwise(F.concat(F.lit(" Financial role: "), financial_role, F.lit(".")))
    whole = F.concat(title, F.lit(". "), summary, F.lit(" Evidence type: "), F.lower(spaced(chunk_type)), F.lit("."), role, F.lit(" Retrieval intents: "), spaced(F.array_join(families, ", ")), F.lit("."))
    return stripped(F.left(whole, F.lit(RETRIEVAL_LENGTH)))


def sparse_summary(title: Column, summary: Column, source_summaries: Column) -> Column:
    """A thin summary made richer by its sources', each once, if that gives eight words; else as it was."""
    parts = F.filter(F.array_distinct(F.transform(source_summaries, stripped)), lambda x: x != "")
    richer = stripped(F.concat(title, F.lit(". "), F.array_join(parts, " ")))
    words = F.size(F.filter(F.split(richer, r"(?U)\s+"), lambda x: x != ""))
    return F.when(words >= 8, F.left(richer, F.lit(SPARSE_LENGTH))).otherwise(summary)


def key_values(frame: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Lines "name: value" of texts: key, line, name, value."""
    lines = frame.select(key, F.posexplode(F.split(text, "\n")).alias("line", "t")).where(F.col("t").rlike(KEY_VALUE))
    return lines.select(key, "line", F.regexp_extract("t", KEY_VALUE, 1).alias("name"), F.regexp_extract("t", KEY_VALUE, 2).alias("value"))


#: Month names and zone names of mail dates.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
ZONES = {"UT": "+00:00", "UTC": "+00:00", "GMT": "+00:00", "Z": "+00:00", "AST": "-04:00", "ADT": "-03:00", "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00", "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00"}
ISO_TIME = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?))?(Z|[+-]\d{2}:?\d{2})?$"
MAIL_TIME = r"^(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})[\s-]+([A-Za-z]{3})[A-Za-z]*[\s-]+(\d{4}|\d{2})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?(?:\s+([+-]\d{4}|[A-Za-z]{1,4}))?(?:\s*\(.*\))?$"


def parse_time(value: Column) -> Column:
    """A time of a mail or manifest: seconds or milliseconds since 1970, ISO, or a mail date; without a zone it is UTC; null if it is none of these."""
    text = stripped(value.cast("string"))
    number = text.try_cast("bigint")
    seconds = F.when(number > 10_000_000_000, F.floor(number / 1000)).otherwise(number)
    zone = lambda z: F.regexp_replace(z, r"^([+-]\d{2}):?(\d{2})$", "$1:$2")
    part = lambda pattern, i: F.regexp_extract(text, pattern, i)
    given = lambda x, other: F.when(x == "", other).otherwise(x)
    minute = given(part(ISO_TIME, 2), "00:00")
    clock = F.when(F.length(minute) > 5, minute).otherwise(F.concat(minute, F.lit(":00")))
    iso = F.concat(part(ISO_TIME, 1), F.lit("T"), clock, given(zone(part(ISO_TIME, 3)), "+00:00"))
    year = part(MAIL_TIME, 3)
    year = F.when(F.length(year) == 4, year).when(year < "69", F.concat(F.lit("20"), year)).otherwise(F.concat(F.lit("19"), year))
    month = F.create_map(*[F.lit(x) for i, name in enumerate(MONTHS, 1) for x in (name, f"{i:02}")])[F.lower(part(MAIL_TIME, 2))]
    named = F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair])[F.upper(part(MAIL_TIME, 7))]
    offset = F.when(part(MAIL_TIME, 7).rlike(r"^[+-]\d{4}$"), zone(part(MAIL_TIME, 7))).otherwise(F.coalesce(named, F.lit("+00:00")))
    clock = F.concat_ws(":", F.lpad(part(MAIL_TIME, 4), 2, "0"), part(MAIL_TIME, 5), given(part(MAIL_TIME, 6), "00"))
    mail = F.concat(year, F.lit("-"), month, F.lit("-"), F.lpad(part(MAIL_TIME, 1), 2, "0"), F.lit("T"), clock, offset)
    return F.when(text.rlike(r"^\d+$"), F.timestamp_seconds(seconds)).when(text.rlike(ISO_TIME), iso.try_cast("timestamp")).when(text.rlike(MAIL_TIME), mail.try_cast("timestamp"))


def public_order_id(platform: Column, order_id: Column, private_id: Column, key: bytes, scope: str = "public-order-v1") -> Column:
    """An order's public alias: twelve digits of an HMAC-SHA-256 under `key` (32 bytes at least), by its definition as two hashes."""
    import hashlib

    if len(key) < 32:
        raise ValueError("a key for public identifiers has 32 bytes at least")
    padded = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ mask for b in padded).hex())) for mask in (0x36, 0x5C))
    message = F.encode(F.concat_ws(":", F.lit(scope), platform, order_id.cast("string"), private_id), "UTF-8")
    digest = F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)
    return F.concat(F.lit("ORD-"), F.when(platform == "zomato", "ZM").otherwise("SW"), F.lit("-"), F.upper(F.left(digest, F.lit(12))))


def embedding_batches(inputs: DataFrame, size: int, model: str, dimension: int) -> DataFrame:
    """Batches of at most `size` inputs (node_id) in the order of their ids, each named by its content: batch, node_ids, path.

    Numbers run over the whole order without one task seeing it all: partitions are ranges, and
    each adds the sizes of those before it (one row a partition).
    """
    from tallyforge.session import materialise

    if size <= 0:
        raise ValueError("a batch has one input at least")
    parts = inputs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranged = materialise(inputs.select("node_id").repartitionByRange(int(parts), "node_id").withColumn("part", F.spark_partition_id()), "embedding-inputs")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    numbered = ranged.join(F.broadcast(starts), "part").withColumn("at", F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy("node_id")) - 1)
    # At most `size` ids a batch.
    batches = numbered.groupBy(F.floor(F.col("at") / size).alias("batch")).agg(F.array_sort(F.collect_list("node_id")).alias("node_ids"))
    identity = F.concat(F.lit(f'{{"dimension":{dimension},"model":"{model}","node_ids":'), F.to_json("node_ids"), F.lit("}"))
    return batches.withColumn("path", F.concat(F.lit("batches/"), F.sha2(identity, 256), F.lit(".json")))
