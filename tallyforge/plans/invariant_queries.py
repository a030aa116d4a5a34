"""Registered queries that hold the engine's own results to their rules, and measure answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import finance, graph, invariants, resolution, retrieval
from tallyforge.operators import events as ev
from tallyforge.plans.catalog import query
from tallyforge.plans.economics_queries import COMPONENTS, LINES, PLATFORMS
from tallyforge.session import table
from tallyforge.sources import domain


@query("component_violations", "SELECT 0::BIGINT AS violations")
def component_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    components = domain.money_components(spark, sf_dir)
    found = invariants.violated(components, "component_key", invariants.component_rules())
    orders = domain.orders(spark, sf_dir)
    return invariants.together([found, invariants.orphans(components, "orderkey", orders, "orderkey")]).agg(F.count("*").alias("violations"))


@query("reconciliation_violations", "SELECT 0::BIGINT AS violations")
def reconciliation_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = finance.reconcile_documents(domain.money_components(spark, sf_dir), ["orderkey"])
    return invariants.broken(runs, "orderkey", invariants.reconciliation_rules()).agg(F.count("*").alias("violations"))


@query("event_violations", "SELECT 0::BIGINT AS violations")
def event_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = ev.timed_events(domain.timed_components(spark, sf_dir))
    return invariants.violated(events, "event_id", invariants.event_rules()).agg(F.count("*").alias("violations"))


def _planted(wrong: str, value: Column, name: str) -> Column:
    """The column, or `value` in the rows that the condition picks."""
    return F.when(F.expr(wrong), value).otherwise(F.col(name))


def _by_rule(faults: DataFrame) -> DataFrame:
    return faults.groupBy("rule").agg(F.count("*").alias("n"))


def _counted(source: str, rules: dict[str, str]) -> str:
    """SQL that counts a table's rows by condition; rules that nothing breaks have no row."""
    return " UNION ALL ".join(f"SELECT '{rule}' AS rule, count(*) AS n FROM {source} WHERE {where} HAVING count(*) > 0" for rule, where in rules.items())


@query(
    "component_faults",
    f"""WITH {COMPONENTS} """
    + _counted("components", {"currency_is_a_code": "orderkey % 7 = 0", "precision_is_not_negative": "orderkey % 11 = 0", "has_a_source": "orderkey % 13 = 0", "amount_is_exact": "orderkey % 17 = 0"})
    + " UNION ALL SELECT 'known_orderkey', count(DISTINCT orderkey) FROM components WHERE orderkey % 19 = 0 HAVING count(*) > 0",
)
def component_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components with faults planted by order, counted by the rule that each breaks."""
    components = domain.money_components(spark, sf_dir).withColumns({
        "currency": _planted("orderkey % 7 = 0", F.lit("inr"), "currency"),
        "source_precision": _planted("orderkey % 11 = 0", F.lit(-1), "source_precision"),
        "source_key": _planted("orderkey % 13 = 0", F.lit(""), "source_key"),
        "amount": _planted("orderkey % 17 = 0", (F.col("amount") + F.lit("0.001").cast("decimal(18,3)")).cast("decimal(20,3)"), "amount"),
    })
    orders = domain.orders(spark, sf_dir).where("orderkey % 19 <> 0")
    return _by_rule(invariants.together([invariants.broken(components, "component_key", invariants.component_rules()), invariants.orphans(components, "orderkey", orders, "orderkey")]))


@query(
    "reconciliation_faults",
    f"""WITH {COMPONENTS}, g AS (SELECT orderkey FROM components GROUP BY orderkey
      HAVING count(*) FILTER (component_type = 'customer_total') = 1 AND count(*) FILTER (component_type <> 'customer_total') >= 1) """
    + _counted("g", {"residual_is_the_difference": "orderkey % 7 = 0", "share_is_between_0_and_1": "orderkey % 11 = 0"}),
)
def reconciliation_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reconciliations with faults planted by order, counted by the rule that each breaks."""
    runs = finance.reconcile_documents(domain.money_components(spark, sf_dir), ["orderkey"]).withColumns({
        "residual": _planted("orderkey % 7 = 0", F.col("residual") + 1_000_000, "residual"),
        "explained_value_ratio": _planted("orderkey % 11 = 0", F.lit(2.0), "explained_value_ratio"),
    })
    return _by_rule(invariants.broken(runs, "orderkey", invariants.reconciliation_rules()))


@query(
    "event_faults",
    f"""WITH {COMPONENTS} """
    + _counted(
        "components JOIN orders ON orderkey = o_orderkey",
        {"id_follows_from_the_content": "orderkey % 7 = 0", "validity_is_in_order": "orderkey % 11 = 0", "source_hash_is_the_source''s": "orderkey % 13 = 0", "has_a_time": "orderkey % 17 = 0"},
    ),
)
def event_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with faults planted by order, counted by the rule that each breaks."""
    events = ev.timed_events(domain.timed_components(spark, sf_dir)).withColumns({
        # Some ids have no letter, so upper case alone would leave them right.
        "event_id": _planted("orderkey % 7 = 0", F.concat(F.lit("x"), "event_id"), "event_id"),
        "valid_from": _planted("orderkey % 11 = 0", F.lit("2001-01-01").cast("timestamp"), "valid_from"),
        "valid_to": _planted("orderkey % 11 = 0", F.lit("2000-01-01").cast("timestamp"), "valid_to"),
        "source_hash": _planted("orderkey % 13 = 0", F.lit(""), "source_hash"),
        "occurred_at": _planted("orderkey % 17 = 0", F.lit(None).cast("timestamp"), "occurred_at"),
    })
    return _by_rule(invariants.broken(events, "event_id", invariants.event_rules()))


@query(
    "event_coverage_faults",
    f"""WITH {COMPONENTS} SELECT 'without_event' AS fault, count(*) AS n FROM components WHERE orderkey % 7 = 0 HAVING count(*) > 0
    UNION ALL SELECT 'several_events', count(*) FROM components WHERE orderkey % 7 <> 0 AND orderkey % 11 = 0 HAVING count(*) > 0
    UNION ALL SELECT 'unknown_component', count(*) FROM components WHERE orderkey % 7 <> 0 AND orderkey % 11 <> 0 AND orderkey % 13 = 0 HAVING count(*) > 0""",
)
def event_coverage_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What coverage finds where one order's events are gone, another's are doubled and a third's components are gone."""
    components = domain.money_components(spark, sf_dir)
    events = ev.timed_events(domain.timed_components(spark, sf_dir))
    times = F.when(F.expr("orderkey % 7 = 0"), 0).when(F.expr("orderkey % 11 = 0"), 2).otherwise(1)
    events = events.withColumn("copy", F.explode(F.array_repeat(F.lit(1), times)))
    kept = components.where("orderkey % 7 = 0 or orderkey % 11 = 0 or orderkey % 13 <> 0")
    fault = F.when(F.col("wanted").isNull(), "unknown_component").when(F.col("got").isNull(), "without_event").when(F.col("got") > 1, "several_events").otherwise("other")
    return ev.uncovered(kept, events).groupBy(fault.alias("fault")).agg(F.count("*").alias("n"))


@query(
    "reconciliation_outcomes",
    f"""WITH {COMPONENTS}, g AS (SELECT orderkey FROM components GROUP BY orderkey HAVING count(*) FILTER (component_type <> 'customer_total') >= 1),
    o AS (SELECT CASE orderkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 0.01 WHEN 2 THEN -0.01 WHEN 3 THEN 0.05 WHEN 4 THEN 0.06 END AS off FROM g WHERE orderkey % 6 <> 5)
    SELECT CASE WHEN off = 0 THEN 'exact' WHEN abs(off) <= 0.01 THEN 'within_source_precision' WHEN abs(off) <= 0.05 THEN 'within_rounding' ELSE 'conflicting' END AS status,
           count(*) AS runs, CAST(sum(off) AS DECIMAL(38,2)) AS residual FROM o GROUP BY ALL""",
)
def reconciliation_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose total is the sum of their parts and a known difference (none for every sixth): how each reconciles."""
    parts = domain.money_components(spark, sf_dir).where("component_type <> 'customer_total'").select("component_key", "orderkey", "component_type", "amount", "currency", "source_precision")
    off = F.when(F.expr("orderkey % 6 = 1"), "0.01").when(F.expr("orderkey % 6 = 2"), "-0.01").when(F.expr("orderkey % 6 = 3"), "0.05").when(F.expr("orderkey % 6 = 4"), "0.06").otherwise("0")
    totals = parts.where("orderkey % 6 <> 5").groupBy("orderkey").agg(F.sum(finance.signed(F.col("component_type"), F.col("amount"))).alias("amount"))
    totals = totals.select(
        F.concat_ws(":", F.col("orderkey").cast("string"), F.lit("customer_total")).alias("component_key"), "orderkey", F.lit("customer_total").alias("component_type"),
        (F.col("amount") + off.cast("decimal(18,2)")).cast("decimal(18,2)").alias("amount"), F.lit(domain.CURRENCY).alias("currency"), F.lit(2).alias("source_precision"),
    )
    runs = finance.reconcile_documents(parts.unionByName(totals), ["orderkey"])
    return runs.groupBy("status").agg(F.count("*").alias("runs"), F.sum("residual").cast("decimal(38,2)").alias("residual"))


@query(
    "line_number_repeats",
    "SELECT CAST(l_orderkey AS VARCHAR) || '/' || l_linenumber AS key FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
)
def line_number_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule that the tables do break: line numbers aren't unique within an order."""
    lines = domain.lines(spark, sf_dir).select(F.concat_ws("/", "orderkey", "linenumber").alias("line"))
    return invariants.repeated(lines, "line").select("key")


@query(
    "archive_digests",
    f"WITH {COMPONENTS} SELECT component_type, count(*) AS rows, CAST(sum(amount) AS DECIMAL(38,2)) AS total, true AS stable FROM components GROUP BY ALL",
)
def archive_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each type's rows, and whether they stay the same when the rows are dealt differently."""
    components = domain.money_components(spark, sf_dir)
    digest = lambda frame, name: frame.groupBy("component_type").agg(
        F.count("*").alias("rows"), F.sum("amount").cast("decimal(38,2)").alias("total"), F.sum(F.xxhash64("component_key", F.col("amount").cast("string")).cast("decimal(38,0)")).alias(name)
    )
    dealt = digest(components.repartition("amount"), "again").select("component_type", "again")
    return digest(components, "once").join(dealt, "component_type").select("component_type", "rows", "total", (F.col("once") == F.col("again")).alias("stable"))


@query(
    "graph_upsert_idempotence",
    f"WITH {LINES} SELECT (SELECT count(*) FROM supplier) + (SELECT count(*) FROM (SELECT DISTINCT orderkey, suppkey FROM lines)) AS nodes, 0::BIGINT AS changed",
)
def graph_upsert_idempotence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merchants and outlets written twice: as many nodes as once."""
    nodes = _graph(spark, sf_dir)[0].where("label in ('Merchant', 'Outlet')").select("node_id", "label")
    twice = graph.upsert(graph.upsert(nodes.limit(0), nodes, "node_id"), nodes, "node_id")
    return twice.agg(F.count("*").alias("nodes"), (F.count("*") - F.countDistinct("node_id")).alias("changed"))


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return graph.commerce_graph(domain.orders(spark, sf_dir), domain.lines(spark, sf_dir), domain.platforms(spark, sf_dir), domain.money_components(spark, sf_dir))


@query(
    "visible_subgraph",
    f"""WITH {LINES}, {PLATFORMS} SELECT 'PLACED_ON' AS relationship_type, count(*) AS n FROM (SELECT DISTINCT orderkey, platform FROM lines JOIN platforms USING (suppkey))
    UNION ALL SELECT 'ORDERED_FROM', count(*) FROM (SELECT DISTINCT orderkey, suppkey FROM lines)""",
)
def visible_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    _, kept = graph.visible(nodes, edges, ["Order", "Platform", "Outlet"], ["PLACED_ON", "ORDERED_FROM", "OUTLET_OF"])
    return kept.groupBy("relationship_type").agg(F.count("*").alias("n"))


@query(
    "order_neighbours",
    f"""WITH {LINES}, k AS (SELECT orderkey, count(*) AS n, count(DISTINCT suppkey) AS outlets FROM lines GROUP BY orderkey)
    SELECT 'order:' || orderkey AS node_id, 'ORDERED_FROM' AS relationship_type, outlets AS n FROM k
    UNION ALL SELECT 'order:' || o_orderkey, 'HAS_COMPONENT', 1 + 3 * coalesce(n, 0) FROM orders LEFT JOIN k ON orderkey = o_orderkey""",
)
def order_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's outlets and components."""
    nodes, edges = _graph(spark, sf_dir)
    start = domain.orders(spark, sf_dir).select(F.concat(F.lit("order:"), "orderkey").alias("node_id"))
    return graph.neighbours(edges, start, ("ORDERED_FROM", "HAS_COMPONENT")).groupBy("node_id", "relationship_type").agg(F.count("*").alias("n"))


@query(
    "only_merchant_orders",
    f"WITH {LINES} SELECT count(*) AS orders FROM (SELECT orderkey FROM lines GROUP BY orderkey HAVING min(suppkey) = max(suppkey))",
)
def only_merchant_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.only_merchant(domain.lines(spark, sf_dir).select("orderkey", F.col("suppkey").alias("merchant"))).agg(F.count("*").alias("orders"))


@query(
    "answer_evaluation",
    f"""WITH {COMPONENTS}, {PLATFORMS}, g AS (SELECT platform, component_type FROM components JOIN platforms USING (suppkey) GROUP BY ALL)
    SELECT count(*) AS cases, 1.0::DOUBLE AS status_accuracy, 1.0::DOUBLE AS answer_accuracy, 1.0::DOUBLE AS calculation_accuracy, 1.0::DOUBLE AS count_accuracy, 1.0::DOUBLE AS citation_accuracy, 1.0::DOUBLE AS abstention_accuracy FROM g""",
)
def answer_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by the template's way against goldens counted another way: from whole-cent integers, platform by platform."""
    components, sellers = domain.money_components(spark, sf_dir), domain.platforms(spark, sf_dir)
    # A component has one seller, so its platform is met after the sum by seller.
    sums = finance.distinct_sum(components.where("suppkey is not null"), ["suppkey", "component_type"])
    answers = sums.join(sellers, "suppkey").groupBy("platform", "component_type", "currency").agg(F.sum("components").alias("components"), F.sum("total").cast(finance.SUM).alias("total"))
    cents = components.where("suppkey is not null").groupBy("suppkey", "component_type").agg(F.sum((F.col("amount") * 100).cast("bigint")).alias("c"), F.count("*").alias("n"))
    goldens = cents.join(sellers, "suppkey").groupBy("platform", "component_type").agg(F.sum("c").alias("cents"), F.sum("n").alias("n"))
    both = goldens.join(answers, ["platform", "component_type"], "left")
    exact = (F.col("total") * 100).cast("bigint") == F.col("cents")
    outcomes = both.select(
        F.col("total").isNotNull().alias("status_ok"), exact.alias("answer_ok"), exact.alias("calculation_ok"), (F.col("components") == F.col("n")).alias("count_ok"), (F.col("components") > 0).alias("citation_ok"),
        F.lit(True).alias("abstention_ok"), F.lit(False).alias("abstained"),
    )
    return retrieval.answer_metrics(outcomes)


@query(
    "latency_percentiles",
    "SELECT event_type, CAST(quantile_disc(value, 0.5) AS DOUBLE) AS p50, CAST(quantile_disc(value, 0.95) AS DOUBLE) AS p95 FROM events GROUP BY event_type",
)
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles; event values stand in for latencies, which a query can't measure of itself."""
    runs = table(spark, sf_dir, "events").select("event_type", F.col("value").alias("latency_ms"))
    return retrieval.latency_metrics(runs, ["event_type"])
