"""Financial events, their roll-up chunks at five levels, and corrections of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.expressions import content_id, lines_digest, sorted_set
from tallyforge.operators import keys
from tallyforge.session import materialise

#: Component types of each event type (fixed values); what isn't listed is a residual.
EVENT_TYPES = {
    "purchase_asserted": ("item_gross", "item_net", "subtotal", "invoice_total", "customer_total"),
    "charge_assessed": ("packing_charge", "handling_fee", "delivery_charge", "platform_fee", "other_charge"),
    "discount_applied": ("item_discount", "coupon_discount"),
    "membership_benefit_realized": ("membership_benefit",),
    "tax_assessed": ("cgst", "sgst", "igst", "cess", "tax"),
    "payment_asserted": ("payment_assertion",),
    "refund_asserted": ("refund",),
}
RESIDUAL = "reconciliation_residual"
SUM = "decimal(38,2)"


def event_type(component_type: Column) -> Column:
    """The event type of a component type."""
    found = None
    for name, kinds in EVENT_TYPES.items():
        found = F.when(component_type.isin(*kinds), name) if found is None else found.when(component_type.isin(*kinds), name)
    return found.otherwise(RESIDUAL)


def financial_events(components: DataFrame, sources: DataFrame) -> DataFrame:
    """One event for each component, at its source's time.

    `sources` has orderkey and occurred_at. Components whose source has no time are found by
    `untimed`. The observation clock is the latest time of the sources joined (see `observed_at`).
    """
    return timed_events(components.join(sources.select("orderkey", "occurred_at"), "orderkey", "left"))


def timed_events(components: DataFrame) -> DataFrame:
    """One event for each component that has its source's time, occurred_at, with it."""
    return events_of(components, "occurred_at", F.col("occurred_at").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"))


def events_of(components: DataFrame, *times: Column | str) -> DataFrame:
    """One event for each component, with the given columns of its times; without any, no source is met."""
    return components.select(
        content_id(F.lit("financial-event-v1"), F.col("component_key")).alias("event_id"),
        "component_key",
        "orderkey",
        "suppkey",
        event_type(F.col("component_type")).alias("event_type"),
        "component_type",
        "amount",
        "currency",
        *times,
        "source_key",
        F.sha2("source_key", 256).alias("source_hash"),
    )


def untimed(events: DataFrame) -> DataFrame:
    return events.where("occurred_at is null")


def observed_at(events: DataFrame) -> DataFrame:
    """The observation clock: one row."""
    return events.agg(F.max("occurred_at").alias("observed_at"))


def event_digest(events: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and exact totals by event type of each group, its first and last time, and one digest text.

    Two aggregations: by (keys, currency, type) first, so the text lists are a handful of entries.
    """
    parts = events.groupBy(*keys, "currency", "event_type").agg(
        F.count("*").alias("n"), F.sum("amount").cast(SUM).alias("total"), F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at")
    )
    counts = F.transform(F.array_sort(F.collect_list(F.struct("event_type", "n"))), lambda x: F.concat(x["event_type"], F.lit("="), x["n"].cast("string")))
    totals = F.transform(
        F.array_sort(F.collect_list(F.struct("currency", "event_type", "total"))), lambda x: F.concat(x["currency"], F.lit(" "), x["event_type"], F.lit("="), x["total"].cast("string"))
    )
    return parts.groupBy(*keys).agg(
        F.sum("n").alias("events"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.array_join(counts, ", ").alias("counts"), F.array_join(totals, ", ").alias("totals")
    )


def bounded_text(text: Column, limit: int = 8_000, marker: str = "\n[middle omitted]\n") -> Column:
    """The text, or both its ends around a marker where it is longer than `limit`."""
    side = (limit - len(marker)) // 2
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(side)), F.lit(marker), F.right(text, F.lit(side))))


def rollup(events: DataFrame, entities: DataFrame) -> DataFrame:
    """Chunks of five levels: evidence_cell, event, order_bundle, entity and year_window.

    `entities` has (orderkey, entity_id). Each chunk has its level, identity, number of events,
    exact total, period, and a digest of its events' ids. The digests stand for the lineage, which
    is joined from `events` when needed; a year's event ids are never gathered in one row. Bundles, entities
    and years are added up from one aggregation by order and year, whose exchange they share; nothing is written, so columns that a reader leaves out are never made.
    """
    lineage = F.xxhash64("event_id").cast("decimal(38,0)")
    one = lambda level, identity: events.select(
        F.lit(level).alias("level"),
        F.col(identity).alias("identity"),
        F.lit(1).cast("bigint").alias("events"),
        F.col("amount").cast(SUM).alias("total"),
        F.col("occurred_at").alias("period_start"),
        F.col("occurred_at").alias("period_end"),
        lineage.alias("lineage"),
    )
    sums = events.groupBy("orderkey", F.year("occurred_at").alias("year")).agg(
        F.count("*").alias("events"), F.sum("amount").cast(SUM).alias("total"), F.min("occurred_at").alias("period_start"), F.max("occurred_at").alias("period_end"), F.sum(lineage).cast("decimal(38,0)").alias("lineage")
    )
    many = lambda level, frame, identity: frame.groupBy(F.lit(level).alias("level"), identity.alias("identity")).agg(
        F.sum("events").alias("events"), F.sum("total").cast(SUM).alias("total"), F.min("period_start").alias("period_start"), F.max("period_end").alias("period_end"), F.sum("lineage").cast("decimal(38,0)").alias("lineage")
    )
    chunks = [
        one("evidence_cell", "component_key"),
        one("event", "event_id"),
        many("order_bundle", sums, F.col("orderkey").cast("string")),
        many("entity", sums.join(entities.select("orderkey", "entity_id").distinct(), "orderkey"), F.col("entity_id")),
        many("year_window", sums, F.col("year").cast("string")),
    ]
    found = chunks[0]
    for chunk in chunks[1:]:
        found = found.unionByName(chunk)
    return found.withColumn("chunk_id", content_id(F.lit("financial-chunk-v1"), F.col("level"), F.col("identity")))


def uncovered(components: DataFrame, events: DataFrame) -> DataFrame:
    """Component keys that don't have exactly one event, and events of unknown components."""
    found = keys.times(components.select("component_key"), events.select("component_key"), "component_key").withColumnsRenamed({"left": "wanted", "right": "got"})
    return found.where("wanted is null or got is null or wanted <> 1 or got <> 1")


def archive_digest(frame: DataFrame, line: Column, keys: list[str]) -> DataFrame:
    """A digest of each group's rows that doesn't depend on their order; groups are bounded by the caller."""
    return frame.groupBy(*keys).agg(lines_digest(line).alias("sha256"))


def supersession_faults(links: DataFrame, events: DataFrame) -> DataFrame:
    """Corrections that break a rule, with the rule: links (new_id, old_id, decided_at) between events.

    An event is corrected once at most; both are of one type, order and currency; the old one's
    validity ends where the new one's begins; the new one was observed later, before the decision.
    Expects events with event_id, event_type, orderkey, currency, valid_from, valid_to, observed_at.
    """
    side = lambda name: events.select(*[F.col(c).alias(f"{name}_{c}") for c in ("event_id", "event_type", "orderkey", "currency", "valid_from", "valid_to", "observed_at")])
    twice = links.groupBy("old_id").agg(F.count("*").alias("times"))
    both = links.join(twice, "old_id").join(side("new"), F.col("new_id") == F.col("new_event_id"), "left").join(side("old"), F.col("old_id") == F.col("old_event_id"), "left")
    fault = (
        F.when(F.col("new_event_id").isNull() | F.col("old_event_id").isNull(), "unknown_event")
        .when(F.col("times") > 1, "superseded_twice")
        .when(F.col("new_event_type") != F.col("old_event_type"), "type_differs")
        .when((F.col("new_orderkey") != F.col("old_orderkey")) | (F.col("new_currency") != F.col("old_currency")), "order_or_currency_differs")
        .when(~F.col("old_valid_to").eqNullSafe(F.col("new_valid_from")), "validity_not_contiguous")
        .when(F.col("new_observed_at") <= F.col("old_observed_at"), "not_observed_later")
        .when(F.col("decided_at") < F.col("new_observed_at"), "decided_before_observed")
    )
    return both.withColumn("fault", fault).where("fault is not null").select("new_id", "old_id", "fault")


def cyclic(links: DataFrame) -> DataFrame:
    """Links (new_id, old_id) whose newer event has been corrected without end: it lies on a cycle or was corrected by way of one.

    Steps double: a round joins the ways of a length with themselves, until no event has a way so
    long, or as many have one as had one of half the length, which then never end. So there are log2
    of the longest chain as many rounds. An event corrected twice (a fault by itself) has several ways.
    """
    known = materialise(links.select("new_id", "old_id").distinct(), "links")
    ways, before = known.select(F.col("old_id").alias("start"), F.col("new_id").alias("stop")), -1
    while (count := ways.select("start").distinct().count()) not in (0, before):
        before = count
        further = ways.select(F.col("start").alias("stop"), F.col("stop").alias("end"))
        ways = materialise(ways.join(further, "stop").select("start", F.col("end").alias("stop")).distinct(), "ways")
    return known.join(ways.select(F.col("start").alias("new_id")).distinct(), "new_id", "left_semi")


def current_events(events: DataFrame, links: DataFrame) -> DataFrame:
    """Events that nothing supersedes."""
    return events.join(links.select(F.col("old_id").alias("event_id")), "event_id", "left_anti")


def entity_events(events: DataFrame, entities: DataFrame) -> DataFrame:
    """Events of each entity over its orders: entity_id, events, total, first and last time."""
    return events.join(entities.select("orderkey", "entity_id").distinct(), "orderkey").groupBy("entity_id").agg(
        F.count("*").alias("events"), F.sum("amount").cast(SUM).alias("total"), F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at")
    )


def provenance(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct event ids and source hashes behind each group, in order; for groups that an answer cites."""
    return rows.groupBy(*keys).agg(sorted_set("event_id").alias("event_ids"), sorted_set("source_hash").alias("source_hashes"))
