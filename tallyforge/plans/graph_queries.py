"""Registered queries over events, roll-ups, resolution and the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.expressions import MONEY, content_id, unit_price
from tallyforge.operators import events as ev
from tallyforge.operators import graph, resolution
from tallyforge.plans.catalog import query
from tallyforge.plans.economics_queries import BOUGHT, COMPONENTS, LINES, PLATFORMS
from tallyforge.session import table
from tallyforge.sources import domain

EVENT_TYPE = "CASE component_type WHEN 'item_gross' THEN 'purchase_asserted' WHEN 'customer_total' THEN 'purchase_asserted' WHEN 'coupon_discount' THEN 'discount_applied' WHEN 'tax' THEN 'tax_assessed' END"
EVENTS = COMPONENTS + f""",
events_ AS (SELECT orderkey, suppkey, {EVENT_TYPE} AS event_type, amount, CAST(o_orderdate AS TIMESTAMP) AS occurred_at FROM components JOIN orders ON orderkey = o_orderkey)
"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.timed_events(domain.timed_components(spark, sf_dir))


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merchants of each order, as entities."""
    return domain.lines(spark, sf_dir).select("orderkey", F.concat(F.lit("merchant:"), F.col("suppkey").cast("string")).alias("entity_id"))


@query(
    "financial_events",
    f"""WITH {EVENTS} SELECT event_type, year(occurred_at) AS year, count(*) AS events, CAST(sum(amount) AS DECIMAL(38,2)) AS total,
    CAST(CAST(min(occurred_at) AS DATE) AS VARCHAR) AS first_on, CAST(CAST(max(occurred_at) AS DATE) AS VARCHAR) AS last_on FROM events_ GROUP BY ALL""",
)
def financial_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("event_type", F.year("occurred_at").alias("year")).agg(
        F.count("*").alias("events"), F.sum("amount").cast("decimal(38,2)").alias("total"), F.to_date(F.min("occurred_at")).cast("string").alias("first_on"), F.to_date(F.max("occurred_at")).cast("string").alias("last_on")
    )


@query(
    "event_digest_by_year",
    f"""WITH {EVENTS},
    p AS (SELECT year(occurred_at) AS year, event_type, count(*) AS n, CAST(sum(amount) AS DECIMAL(38,2)) AS total FROM events_ GROUP BY ALL)
    SELECT year, CAST(sum(n) AS BIGINT) AS events, string_agg(event_type || '=' || n, ', ' ORDER BY event_type) AS counts,
           string_agg('INR ' || event_type || '=' || total, ', ' ORDER BY event_type) AS totals FROM p GROUP BY year""",
)
def event_digest_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.event_digest(_events(spark, sf_dir).withColumn("year", F.year("occurred_at")), ["year"]).select("year", "events", "counts", "totals")


@query(
    "rollup_chunk_counts",
    f"""WITH {EVENTS},
    m AS (SELECT DISTINCT orderkey, suppkey AS merchant FROM lines),
    c AS (SELECT 'evidence_cell' AS level, 1 AS chunks, 1 AS events, amount AS total FROM events_
          UNION ALL SELECT 'event', 1, 1, amount FROM events_
          UNION ALL (SELECT 'order_bundle', 1, count(*), sum(amount) FROM events_ GROUP BY orderkey)
          UNION ALL (SELECT 'entity', 1, count(*), sum(amount) FROM events_ JOIN m USING (orderkey) GROUP BY merchant)
          UNION ALL (SELECT 'year_window', 1, count(*), sum(amount) FROM events_ GROUP BY year(occurred_at)))
    SELECT level, CAST(sum(chunks) AS BIGINT) AS chunks, CAST(sum(events) AS BIGINT) AS events, CAST(sum(total) AS DECIMAL(38,2)) AS total FROM c GROUP BY level""",
)
def rollup_chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = ev.rollup(_events(spark, sf_dir), _entities(spark, sf_dir))
    return chunks.groupBy("level").agg(F.count("*").alias("chunks"), F.sum("events").alias("events"), F.sum("total").cast("decimal(38,2)").alias("total"))


@query(
    "entity_history_events",
    f"""WITH {EVENTS}, m AS (SELECT DISTINCT orderkey, 'merchant:' || suppkey AS entity_id FROM lines)
    SELECT entity_id, count(*) AS events, CAST(sum(amount) AS DECIMAL(38,2)) AS total, CAST(CAST(min(occurred_at) AS DATE) AS VARCHAR) AS first_on, CAST(CAST(max(occurred_at) AS DATE) AS VARCHAR) AS last_on
    FROM events_ JOIN m USING (orderkey) GROUP BY entity_id""",
)
def entity_history_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ev.entity_events(_events(spark, sf_dir), _entities(spark, sf_dir))
    return found.select("entity_id", "events", "total", F.to_date("first_at").cast("string").alias("first_on"), F.to_date("last_at").cast("string").alias("last_on"))


@query("event_coverage_violations", "SELECT 0 AS violations")
def event_coverage_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.uncovered(domain.money_components(spark, sf_dir), _events(spark, sf_dir)).agg(F.count("*").cast("int").alias("violations"))


def _corrections(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each customer's orders as versions of one standing event, each superseding the one before."""
    base = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("orderkey"), F.col("o_orderdate").alias("valid_from"))
    order = ev_window("orderkey")
    versions = base.withColumns({"valid_to": F.lead("valid_from").over(order), "old_id": F.lag("event_id").over(order)})
    versions = versions.withColumns({"event_type": F.lit("purchase_asserted"), "currency": F.lit("INR"), "observed_at": F.col("valid_from")})
    links = versions.where("old_id is not null").select(F.col("event_id").alias("new_id"), "old_id", F.col("observed_at").alias("decided_at"))
    return versions.drop("old_id"), links


def ev_window(key: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy("valid_from", "event_id")


@query(
    "supersession_chain",
    """WITH v AS (SELECT o_orderkey AS id, o_custkey AS c, o_orderdate AS f, lag(o_orderkey) OVER w AS old, lag(o_orderdate) OVER w AS old_f FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
    SELECT count(old) AS links, count(*) FILTER (old IS NOT NULL AND f <= old_f) AS not_observed_later, count(DISTINCT c) AS current_events, 0::BIGINT AS cyclic FROM v""",
)
def supersession_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, links = _corrections(spark, sf_dir)
    faults = ev.supersession_faults(links, events).groupBy().agg(F.count_if(F.col("fault") == "not_observed_later").alias("not_observed_later"))
    current = ev.current_events(events, links).groupBy().agg(F.count("*").alias("current_events"))
    cyclic = ev.cyclic(links).groupBy().agg(F.count("*").alias("cyclic"))
    one = links.groupBy().agg(F.count("*").alias("links"))
    # Each side is one row.
    for side in (faults, current, cyclic):
        one = one.join(F.broadcast(side))
    return one


@query(
    "order_resolution_summary",
    """WITH e AS (SELECT source AS platform, doc_id, lang, CASE WHEN doc_id % 7 = 0 THEN 'history_row' ELSE 'email' END AS kind, CASE WHEN doc_id % 5 <> 0 THEN (doc_id % 400)::VARCHAR END AS order_id FROM documents),
    i AS (SELECT platform, order_id, bool_or(kind = 'history_row') AS h, bool_or(kind <> 'history_row') AS o FROM e WHERE order_id IS NOT NULL GROUP BY ALL)
    SELECT (SELECT count(*) FROM i) AS resolved, (SELECT count(*) FROM (SELECT DISTINCT platform, doc_id FROM e WHERE kind <> 'history_row' AND order_id IS NULL)) AS provisional,
           (SELECT count(*) FROM i) + (SELECT count(*) FROM (SELECT DISTINCT platform, doc_id FROM e WHERE kind <> 'history_row' AND order_id IS NULL)) AS total,
           (SELECT count(*) FROM i WHERE h AND o) AS history_duplicates""",
)
def order_resolution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.order_counts(_order_evidence(spark, sf_dir))


def _order_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as order evidence: most name an order, every seventh is a history row."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("platform"),
        d.cast("string").alias("message_id"),
        F.when(d % 7 == 0, "history_row").otherwise("email").alias("kind"),
        F.when(d % 5 != 0, (d % 400).cast("string")).alias("order_id"),
    )


@query(
    "order_resolution_by_platform",
    """WITH e AS (SELECT source AS platform, doc_id, CASE WHEN doc_id % 5 <> 0 THEN 'id:' || (doc_id % 400) ELSE 'message:' || doc_id END AS k FROM documents),
    g AS (SELECT platform, k, count(*) AS n, count(DISTINCT doc_id) AS m FROM e GROUP BY ALL)
    SELECT platform, CASE WHEN k LIKE 'id:%' THEN 'resolved' ELSE 'provisional' END AS status, count(*) AS orders, CAST(sum(n) AS BIGINT) AS evidence, CAST(sum(m) AS BIGINT) AS messages FROM g GROUP BY ALL""",
)
def order_resolution_by_platform(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolution.resolve_orders(_order_evidence(spark, sf_dir))
    return found.groupBy("platform", "status").agg(F.count("*").alias("orders"), F.sum("evidence").alias("evidence"), F.sum("messages").alias("messages"))


@query(
    "merchant_item_groups",
    f"""WITH {LINES}, m AS (SELECT orderkey, CASE WHEN min(suppkey) = max(suppkey) THEN min(suppkey) END AS merchant FROM lines GROUP BY ALL),
    o AS (SELECT coalesce('merchant:' || merchant, 'order:' || orderkey) AS scope, lower(p_name) AS n FROM lines JOIN part ON partkey = p_partkey JOIN m USING (orderkey))
    SELECT CASE WHEN scope LIKE 'merchant:%' THEN 'merchant' ELSE 'order' END AS scope_kind, count(DISTINCT scope || '|' || n) AS merchant_items, count(*) AS observations FROM o GROUP BY ALL""",
)
def merchant_item_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = domain.lines(spark, sf_dir)
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("partkey"), F.col("p_name").alias("raw_name"))
    observed = lines.join(parts, "partkey").select("orderkey", "raw_name")
    found = resolution.resolve_items(observed, lines.select("orderkey", F.col("suppkey").alias("merchant")))
    return found.groupBy(F.substring_index("scope", ":", 1).alias("scope_kind")).agg(F.count("*").alias("merchant_items"), F.sum("mentions").alias("observations"))


@query(
    "preferred_alias",
    """WITH s AS (SELECT lower(p_name) AS n, CASE WHEN p_size % 3 = 0 THEN upper(p_name) WHEN p_size % 3 = 1 THEN p_name ELSE lower(p_name) END AS raw FROM part),
    c AS (SELECT n, raw, count(*) AS k FROM s GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY k DESC, lower(raw), raw) AS place FROM c)
    SELECT n AS normalized_name, max(CASE WHEN place = 1 THEN raw END) AS display_name, count(*) AS aliases, CAST(sum(k) AS BIGINT) AS mentions FROM r GROUP BY n""",
)
def preferred_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, kind = F.col("p_name"), F.col("p_size") % 3
    mentions = table(spark, sf_dir, "part").select(
        F.lower(name).alias("normalized_name"), F.when(kind == 0, F.upper(name)).when(kind == 1, name).otherwise(F.lower(name)).alias("raw_name")
    )
    return resolution.preferred_names(mentions, ["normalized_name"], "raw_name")


@query(
    "merchant_resolution",
    f"""WITH {LINES}, {PLATFORMS}
    SELECT platform, merchant AS normalized_name, count(*) AS mentions, count(DISTINCT orderkey) AS orders FROM lines JOIN platforms USING (suppkey) GROUP BY ALL""",
)
def merchant_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions = domain.lines(spark, sf_dir).select("orderkey", "suppkey").join(domain.platforms(spark, sf_dir), "suppkey").withColumnRenamed("merchant", "raw_name")
    return resolution.resolve_merchants(mentions).select("platform", "normalized_name", "mentions", "orders")


@query(
    "content_ids",
    """WITH h AS (SELECT p_partkey, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode('item:' || p_partkey || ':' || p_name)) AS h FROM part)
    SELECT p_partkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM h""",
)
def content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", content_id(F.lit("item"), F.col("p_partkey").cast("string"), F.col("p_name")).alias("id"))


def _commerce(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return domain.orders(spark, sf_dir), domain.lines(spark, sf_dir), domain.platforms(spark, sf_dir), domain.money_components(spark, sf_dir)


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return graph.commerce_graph(*_commerce(spark, sf_dir))


@query(
    "graph_node_counts",
    f"""WITH {LINES} SELECT * FROM (VALUES
      ('Platform', (SELECT count(DISTINCT r_name) FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)),
      ('Order', (SELECT count(*) FROM orders)),
      ('Merchant', (SELECT count(*) FROM supplier) + (SELECT count(*) FROM (SELECT DISTINCT orderkey, suppkey FROM lines))),
      ('MoneyComponent', (SELECT 3 * count(*) FROM lines) + (SELECT count(*) FROM orders)),
      ('Evidence', (SELECT count(*) FROM lines) + (SELECT count(*) FROM orders))) t(class, n)""",
)
def graph_node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.node_counts(_graph(spark, sf_dir)[0])


@query(
    "graph_edge_counts",
    f"""WITH {LINES}, {PLATFORMS} SELECT * FROM (VALUES
      ('Order', 'Platform', 'PLACED_ON', (SELECT count(*) FROM (SELECT DISTINCT orderkey, platform FROM lines JOIN platforms USING (suppkey)))),
      ('Order', 'Merchant', 'ORDERED_FROM', (SELECT count(*) FROM (SELECT DISTINCT orderkey, suppkey FROM lines))),
      ('Merchant', 'Merchant', 'OUTLET_OF', (SELECT count(*) FROM (SELECT DISTINCT orderkey, suppkey FROM lines))),
      ('Order', 'MoneyComponent', 'HAS_COMPONENT', (SELECT 3 * count(*) FROM lines) + (SELECT count(*) FROM orders)),
      ('MoneyComponent', 'Evidence', 'EVIDENCED_BY', (SELECT 3 * count(*) FROM lines) + (SELECT count(*) FROM orders))) t(source_class, target_class, relationship_type, n)""",
)
def graph_edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.topology(_graph(spark, sf_dir)[1])


@query("closure_violations", "SELECT 0 AS violations")
def closure_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.commerce_faults(*_commerce(spark, sf_dir)).agg(F.count("*").cast("int").alias("violations"))


@query(
    "closure_faults_of_a_torn_graph",
    f"WITH {LINES} SELECT 'missing_target' AS fault, count(*) AS n FROM (SELECT DISTINCT orderkey, suppkey FROM lines) WHERE suppkey % 10 = 0 HAVING count(*) > 0 "
    "UNION ALL SELECT 'duplicate_node', count(*) FROM orders WHERE o_orderkey % 1000 = 0 HAVING count(*) > 0",
)
def closure_faults_of_a_torn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What `faults` finds after some merchants are taken out and some orders are put in twice."""
    key = F.substring_index("node_id", ":", -1).cast("bigint")
    gone = (F.col("label") == "Merchant") & (key % 10 == 0)
    twice = (F.col("label") == "Order") & (key % 1000 == 0)
    torn = lambda nodes: nodes.where(~gone).unionByName(nodes.where(twice))
    return graph.commerce_faults(*_commerce(spark, sf_dir), torn).groupBy("fault").agg(F.count("*").alias("n"))


@query(
    "customer_mention_count",
    "SELECT lower(c_name) AS normalized_name, count(DISTINCT o_orderkey) AS orders, count(*) AS mentions FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL",
)
def customer_mention_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People are counted as mentions: a repeated name is no proof of one person."""
    orders = domain.orders(spark, sf_dir).groupBy("custkey").agg(F.count("*").alias("mentions"), F.countDistinct("orderkey").alias("orders"))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), F.lower("c_name").alias("normalized_name"))
    return orders.join(people, "custkey").groupBy("normalized_name").agg(F.sum("orders").alias("orders"), F.sum("mentions").alias("mentions"))


@query(
    "merchant_item_price_history",
    f"""WITH {BOUGHT}, {PLATFORMS},
    p AS (SELECT merchant, item, orderkey, occurred_on, CAST((2 * CAST(spend * 100 AS BIGINT) * 100 + CAST(quantity * 100 AS BIGINT)) // (2 * CAST(quantity * 100 AS BIGINT)) AS DECIMAL(18,2)) / 100 AS pr FROM bought JOIN platforms USING (suppkey))
    SELECT merchant, item, orderkey, CAST(occurred_on AS VARCHAR) AS occurred_on, CAST(pr AS DECIMAL(18,2)) AS price FROM p WHERE item LIKE '%widget%'""",
)
def merchant_item_price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    bought = domain.item_observations(spark, sf_dir).where(F.col("item").contains("widget"))
    prices = bought.select("suppkey", "item", "orderkey", "occurred_on", unit_price(F.col("spend"), F.col("quantity")).alias("price"))
    return prices.join(domain.platforms(spark, sf_dir).select("suppkey", "merchant"), "suppkey").select(
        "merchant", "item", "orderkey", F.col("occurred_on").cast("string").alias("occurred_on"), F.col("price").cast(MONEY).alias("price")
    )
