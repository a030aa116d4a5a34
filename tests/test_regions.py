"""Chunks, mail dates and aliases against values known by hand and Python's own parsers."""

import hashlib
import hmac
from datetime import UTC
from email.utils import parsedate_to_datetime

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import regions

CELL = "source_id int, page int, table_id string, row_index int, column_index int, column_span int, is_header boolean, text string, x0 int, y0 int, table_x0 int, table_y0 int"
SOURCE = "source_id int, role string, complete boolean, quality_accepted boolean"
BLOCK = "source_id int, page int, text string, x0 int, y0 int, reading_order int"


def cells(spark, rows):
    return spark.createDataFrame([(1, 1, "t", r, c, span, head, text, c, 10 + r, 0, 10) for r, c, span, head, text in rows], CELL)


def test_rows_of_tables(spark):
    found = regions.table_regions(cells(spark, [(0, 0, 1, True, "Item"), (0, 1, 2, True, "Total price"), (1, 0, 1, False, " Tea "), (1, 1, 1, False, "2"), (1, 2, 1, False, "1,200.50"), (2, 0, 1, False, " "), (2, 1, 1, False, None)]))
    rows = {(r["chunk_type"], r["row_index"]): r for r in found.collect()}
    assert set(rows) == {("item_table", 0), ("item_row", 1)}
    assert rows["item_table", 0]["text"] == "Item | Total price\nTea | 2 | 1,200.50\n | "
    row = rows["item_row", 1]
    assert row["column_headers"] == ["Item", "Total price", "Total price"]
    # The first number under a header of amounts counts; its last place in the row's text is given.
    assert (row["amount"]["value"], row["amount"]["start"], row["amount"]["end"]) == ("2", row["text"].rfind("2"), row["text"].rfind("2") + 1)


def test_amount_is_found_at_its_last_place(spark):
    found = regions.table_regions(cells(spark, [(0, 0, 1, True, "Qty"), (0, 1, 1, True, "Amount"), (1, 0, 1, False, "55"), (1, 1, 1, False, "55")]))
    amount = found.where("chunk_type = 'item_row'").first()["amount"]
    assert (amount["value"], amount["start"], amount["end"]) == ("55", 5, 7)


def test_documents_are_taken_whole_or_not_at_all(spark):
    sources = spark.createDataFrame([(1, "zomato_merchant_invoice", True, True), (2, "unknown", True, True), (3, "zomato_merchant_invoice", False, True), (4, "zomato_merchant_invoice", True, True), (5, "zomato_merchant_invoice", None, True)], SOURCE)
    blocks = spark.createDataFrame([(s, 1, f"text {s}", 0, 50, 0) for s in (1, 2, 3, 5)] + [(1, 1, "first", 0, 0, 0)], BLOCK)
    results, chunks = regions.chunk_documents(sources, blocks, cells(spark, [(0, 0, 1, True, "Item"), (1, 0, 1, False, "Tea")]))
    assert {r["source_id"]: (r["reason"], r["chunks"]) for r in results.collect()} == {1: (None, 4), 2: ("unknown_document_role", 0), 3: ("phase1_quality_rejected", 0), 4: ("no_chunkable_regions", 0), 5: ("phase1_quality_rejected", 0)}
    assert [r["text"] for r in chunks.orderBy("reading_order").collect()] == ["first", "Item\nTea", "Tea", "text 1"]


def test_messages(spark):
    results, chunks = regions.chunk_messages(spark.createDataFrame([(1, " hello ", "s"), (2, None, "subject"), (3, " \n", None)], "source_id int, body string, subject string"))
    assert {r["source_id"]: r["reason"] for r in results.collect()} == {1: None, 2: None, 3: "no_message_text"}
    assert {(r["source_id"], r["text"], r["source_region_id"]) for r in chunks.collect()} == {(1, "hello", "1:body"), (2, "subject", "2:subject")}


def test_proposals_are_judged_by_source(spark):
    sources = spark.createDataFrame([(i,) for i in range(1, 5)], "source_id int")
    rows = [(1, "a", "accepted", "x", 0), (1, "b", "accepted", "x", 1), (2, "a", "accepted", "x", 0), (2, "a", "accepted", "x", 1), (3, "a", None, "x", 0)]
    found = regions.validate_proposals(sources, spark.createDataFrame(rows, "source_id int, chunk_id string, status string, text string, reading_order int"))
    assert {r["source_id"]: (r["reason"], r["chunks"]) for r in found.collect()} == {1: (None, 2), 2: ("invalid_chunk_proposal", 0), 3: ("invalid_chunk_proposal", 0), 4: ("empty_chunk_proposal", 0)}


MAILS = ["Fri, 21 Nov 1997 09:55:06 -0600", "21 Nov 97 09:55 GMT", "Mon, 1 Jan 2024 00:00:00 +0530 (IST)", "Tue, 02 Jan 2024 10:00:00", "3 Feb 2021 01:02:03 EST"]


@pytest.mark.parametrize("text", MAILS)
def test_mail_dates_as_python_reads_them(spark, text):
    want = parsedate_to_datetime(text)
    want = want.replace(tzinfo=UTC) if want.tzinfo is None else want
    assert spark.range(1).select(F.unix_seconds(regions.parse_time(F.lit(text)))).first()[0] == want.timestamp()


def test_other_times(spark):
    times = {"1700000000": 1700000000, "1700000000123": 1700000000, " 2024-01-02T03:04:05Z ": 1704164645, "2024-01-02T03:04:05+0530": 1704144845, "2024-01-02": 1704153600, "2024-13-02": None, "soon": None, "": None, None: None, "9" * 40: None}
    frame = spark.createDataFrame([(x,) for x in times], "t string")
    assert {r["t"]: r["s"] for r in frame.select("t", F.unix_seconds(regions.parse_time(F.col("t"))).alias("s")).collect()} == times


@pytest.mark.parametrize("size", [32, 64, 100])
def test_aliases_are_keyed_hashes(spark, size):
    key = bytes(range(size))
    found = spark.range(1).select(regions.public_order_id(F.lit("zomato"), F.lit(7), F.lit("p1"), key)).first()[0]
    assert found == "ORD-ZM-" + hmac.new(key, b"public-order-v1:zomato:7:p1", hashlib.sha256).hexdigest()[:12].upper()
    with pytest.raises(ValueError):
        regions.public_order_id(F.lit("zomato"), F.lit(7), F.lit("p1"), key[:31])


def test_texts_for_retrieval(spark):
    one = lambda column: spark.range(1).select(column).first()[0]
    lit, none = F.lit, F.lit(None).cast("string")
    assert one(regions.evidence_text(lit(" a "), lit("a"))) == "a"
    assert one(regions.evidence_text(none, lit(" "))) is None
    assert one(regions.evidence_text(lit("a"), lit("b"))) == "a\n\nSource evidence:\nb"
    assert len(one(regions.evidence_text(none, lit("x" * 9_000)))) == 4_000
    assert one(regions.retrieval_text(lit("T"), lit("S."), lit("TAX_BLOCK"), lit("none"), F.array(lit("tax_analysis")))) == "T. S. Evidence type: tax block. Retrieval intents: tax analysis."
    assert one(regions.sparse_summary(lit("T"), lit("short"), F.array(lit("a b c d "), lit("a b c d"), lit("e f g h")))) == "T. a b c d e f g h"
    assert one(regions.sparse_summary(lit("T"), lit("short"), F.array(lit("a")))) == "short"
    assert one(regions.query_families(lit("ITEM_ROW"), F.array(lit("order_id")), F.array().cast("array<string>"), lit(True))) == ["evidence_replay", "financial_breakdown", "item_search", "order_lookup"]


def test_batches_of_inputs(spark):
    found = {r["batch"]: r for r in regions.embedding_batches(spark.range(10).select(F.col("id").alias("node_id")), 4, "m", 8).collect()}
    assert [found[i]["node_ids"] for i in range(3)] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]
    assert found[2]["path"] == "batches/" + hashlib.sha256(b'{"dimension":8,"model":"m","node_ids":[8,9]}').hexdigest() + ".json"
    with pytest.raises(ValueError):
        regions.embedding_batches(spark.range(1).select(F.col("id").alias("node_id")), 0, "m", 8)


def test_text_of_dealt_cells_moves_once(spark):
    rows = cells(spark, [(0, 0, 1, True, "Amount"), (1, 0, 1, False, "5")]).repartition("source_id")
    plan = lambda found: found._jdf.queryExecution().executedPlan().toString()
    assert "ENSURE_REQUIREMENTS" not in plan(regions.table_regions(rows))
    sources = spark.createDataFrame([(1, "zomato_merchant_invoice", True, True)], SOURCE)
    blocks = spark.createDataFrame([(1, 1, "Order", 0, 0, 0)], BLOCK)
    _, chunks = regions.chunk_documents(sources, blocks, rows)
    # Cells, blocks and sources are dealt by source; regions aren't dealt again for their order.
    assert "Union" in plan(chunks) and "ENSURE_REQUIREMENTS" not in plan(chunks).split("Union")[0]
    assert [(r.kind, r.reading_order) for r in chunks.orderBy("reading_order").collect()] == [(0, 0), (1, 1), (2, 2)]
