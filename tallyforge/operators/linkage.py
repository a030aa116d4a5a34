"""From evidence to regions, chunks, orders, components and reconciliations, by joins on shared values.

Links stay rows, never lists, so that a region with very many orders is many rows. Broken references
come back as rows of fault tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An id in a text: 10 to 15 digits with none beside them (fixed value).
ID_TOKEN = r"(?<!\p{Nd})(\p{Nd}{10,15})(?!\p{Nd})"
#: Bits of the table that foretells whether an id is known: 2 MB, whatever the number of ids.
ID_BITS = 1 << 24


def _positions(value: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(bits))


def id_bits(known: DataFrame, token: str, bits: int = ID_BITS) -> DataFrame:
    """A bit for each known id's hash, in bitmaps of 4 KB: (bucket, bitmap), of fixed size in all."""
    place = known.where(F.col(token).isNotNull()).select(_positions(F.col(token), bits).alias("p"))
    return place.groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bitmap"))


def known_tokens(texts: DataFrame, key: str, text: str, known: DataFrame, token: str, bits: int = ID_BITS) -> DataFrame:
    """(key, token): the known ids that whole texts name as bare runs of 10 to 15 digits, once each.

    A table of bits, broadcast because its size is fixed, drops nearly all other numbers in the tasks
    that read the texts; what passes is compared exactly. Null and empty texts name nothing; null keys
    are kept; a longer run of digits isn't a token.
    """
    found = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(ID_TOKEN), F.lit(1)))).alias("token"))
    ids = known.select(F.col(token).cast("string").alias("token")).where("token is not null").distinct()
    place = _positions(F.col("token"), bits)
    found = found.withColumns({"bucket": F.bitmap_bucket_number(place), "bit": F.bitmap_bit_position(place)})
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    near = found.join(F.broadcast(id_bits(ids, "token", bits)), "bucket").where(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1)
    # An inner join with distinct ids: a semi join would be pushed below the table of bits.
    return near.select(key, "token").join(ids, "token").select(key, "token").distinct()


def region_links(evidence: DataFrame, messages: DataFrame, regions: DataFrame, *more: str) -> DataFrame:
    """(evidence_id, region_id, more columns of the evidence): regions that share a source with an evidence's message or its attachments.

    evidence: evidence_id, message_id, kind, order_id; messages: message_id, attachments; regions:
    region_id, source_ids, order_ids. A history row links only to regions that name its order too: a
    statement's many rows and regions meet on source and order, not on the source alone.
    """
    scope = messages.select("message_id", F.explode(F.array_distinct(F.concat(F.array("message_id"), F.coalesce("attachments", F.array().cast("array<string>"))))).alias("source"))
    reach = evidence.select("evidence_id", "message_id", "order_id", *dict.fromkeys(("kind", *more))).join(scope, "message_id")
    link = ["evidence_id", "region_id", *more]
    sources = regions.select("region_id", "order_ids", F.explode(F.array_distinct("source_ids")).alias("source"))
    history = F.col("kind") == "history_row"
    named = sources.select("region_id", "source", F.explode(F.array_distinct("order_ids")).alias("order_id"))
    rows = reach.where(history).join(named, ["source", "order_id"]).select(*link)
    others = reach.where(~F.coalesce(history, F.lit(False))).join(sources.drop("order_ids"), "source").select(*link)
    # Links are dealt before they are told apart: nearly all differ, so that a task that joins them would only fill its memory with them.
    parts = int(evidence.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.unionByName(others).repartition(parts, "evidence_id", "region_id").distinct()


def link_faults(evidence: DataFrame, messages: DataFrame, regions: DataFrame, links: DataFrame) -> DataFrame:
    """(id, fault): repeated messages and regions, evidence of unknown messages, evidence without a region."""
    twice = lambda frame, key, fault: frame.groupBy(key).count().where("count > 1").select(F.col(key).alias("id"), F.lit(fault).alias("fault"))
    unknown = evidence.join(messages.select("message_id"), "message_id", "left_anti").select(F.col("evidence_id").alias("id"), F.lit("unknown_message").alias("fault"))
    known = evidence.join(messages.select("message_id"), "message_id", "left_semi")
    loose = known.join(links.select("evidence_id"), "evidence_id", "left_anti").select(F.col("evidence_id").alias("id"), F.lit("no_region").alias("fault"))
    return twice(messages, "message_id", "repeated_message").unionByName(twice(regions, "region_id", "repeated_region")).unionByName(unknown).unionByName(loose)


def region_orders(links: DataFrame, resolved: DataFrame) -> DataFrame:
    """(region_id, order): the orders that a region's evidence (evidence_id, order) was resolved to."""
    return links.join(resolved.select("evidence_id", "order"), "evidence_id").select("region_id", "order").distinct()


def chunk_orders(region_chunks: DataFrame, orders: DataFrame) -> DataFrame:
    """(chunk_id, region_id, order): a chunk belongs to one region and so to its orders; null for a region without any."""
    return region_chunks.join(orders, "region_id", "left").select("chunk_id", "region_id", "order")


def item_regions(regions: DataFrame, orders: DataFrame) -> DataFrame:
    """(region_id, order): regions that describe an item and have exactly one order, by least and greatest, without lists."""
    span = orders.groupBy("region_id").agg(F.min("order").alias("order"), F.max("order").alias("other")).where(F.col("order") == F.col("other"))
    return regions.where("financial_role = 'item'").select("region_id").join(span.drop("other"), "region_id")


def interpreted_components(interpretations: DataFrame, components: DataFrame, orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Interpretations (region_id, component_id, ...) with their source component's columns and orders; and those whose component isn't there.

    The first frame has a row for each order of a region, one with a null order where there is none.
    """
    found = interpretations.join(components, "component_id").join(orders, "region_id", "left")
    return found, interpretations.join(components.select("component_id"), "component_id", "left_anti")


def reconciled_orders(runs: DataFrame, components: DataFrame) -> DataFrame:
    """(run_id, order): the orders of the components that a reconciliation (run_id, component_id) used, once each."""
    return runs.join(components.where(F.col("order").isNotNull()).select("component_id", "order"), "component_id").select("run_id", "order").distinct()
