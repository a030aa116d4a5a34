"""Registered queries over traversals, bound questions, citations, the extended graph and archive checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import traversal
from tallyforge.plans.catalog import query
from tallyforge.plans.economics_queries import COMPONENTS
from tallyforge.plans.templates import plan_questions
from tallyforge.plans.text_queries import COMPONENT, PLATFORM, REFUSED, Q, _questions
from tallyforge.session import table
from tallyforge.sources import domain

STEP_ACTION = "CASE l_returnflag WHEN 'A' THEN 'finish_answer' WHEN 'R' THEN 'run_metric' ELSE 'expand_neighbors' END"
STEP_KIND = "CASE WHEN l_returnflag = 'N' THEN CASE WHEN l_linestatus = 'O' THEN 'ORDERED_FROM' ELSE 'PLACED_ON' END END"


@query(
    "traversal_faults",
    f"""WITH s AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, CAST(l_quantity AS INT) % 6 AS depth, {STEP_ACTION} AS action, {STEP_KIND} AS kind FROM lineitem),
    b AS (SELECT *, coalesce(lag(depth) OVER w, 0) AS before, row_number() OVER w AS i, count(*) OVER (PARTITION BY k) AS size FROM s WINDOW w AS (PARTITION BY k ORDER BY n, p, depth, action, kind NULLS FIRST)),
    f AS (SELECT k, i, size, CASE WHEN depth > 4 THEN 'depth_exceeded' WHEN depth > before + 1 THEN 'depth_skipped' WHEN kind = 'PLACED_ON' THEN 'relationship_not_allowed' WHEN action = 'finish_answer' AND i < size THEN 'finish_not_last' END AS fault FROM b)
    SELECT k AS traversal_id, CASE WHEN max(size) > 12 THEN 'action_budget_exceeded' ELSE arg_min(fault, i) FILTER (fault IS NOT NULL) END AS fault FROM f GROUP BY k""",
)
def traversal_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as steps, most of them wrong in some way."""
    step = F.struct(F.expr(STEP_ACTION).alias("action"), (F.col("l_quantity").cast("int") % 6).alias("depth"), F.expr(STEP_KIND).alias("relationship_type"))
    ranked = F.struct("l_linenumber", "l_partkey", step["depth"].alias("d"), step["action"].alias("a"), step["relationship_type"].alias("r"), step.alias("step"))
    found = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(ranked)).alias("steps"))
    return found.select(F.col("l_orderkey").alias("traversal_id"), traversal.traversal_fault(F.col("steps.step")).alias("fault"))


def _bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that aren't refused, each bound as a sum, a text search and an order, with the slots their texts name."""
    asked = _questions(spark, sf_dir).withColumn("question_id", F.concat_ws("/", "conv_id", "turn"))
    planned = plan_questions(asked).where("refusal is null")
    slots = F.create_map(F.lit("platform"), F.col("slots.platform"), F.lit("component_type"), F.col("slots.component_type"), F.lit("lexical_query"), F.col("question"))
    return traversal.bind_slots(planned.select("question_id", F.array(F.lit("financial_component_sum"), F.lit("fulltext_evidence"), F.lit("order_reconstruction")).alias("templates"), slots.alias("slots")))


@query(
    "bound_questions",
    f"""WITH {Q}, s AS (SELECT conv_id || '/' || turn AS question_id, question, {PLATFORM} AS platform, {COMPONENT} AS component_type FROM q WHERE ({REFUSED}) IS NULL)
    SELECT question_id, 'financial_component_sum' AS template, CASE WHEN component_type IS NULL THEN 'missing_query_slot:component_type' WHEN platform IS NULL THEN 'missing_query_slot:platform' END AS abstention_reason,
      CASE WHEN platform IS NOT NULL AND component_type IS NOT NULL THEN component_type || '|' || platform || '|50' END AS bound FROM s
    UNION ALL SELECT question_id, 'fulltext_evidence', NULL, question || '|50' FROM s
    UNION ALL SELECT question_id, 'order_reconstruction', 'missing_query_slot:order_id', NULL FROM s""",
)
def bound_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bound(spark, sf_dir).select("question_id", "template", "abstention_reason", F.array_join(F.map_values("parameters"), "|").alias("bound"))


@query(
    "traversal_steps",
    f"""WITH {Q}, s AS (SELECT count(*) AS n FROM q WHERE ({REFUSED}) IS NULL) SELECT * FROM (VALUES ('resolve_entity', 0, NULL), ('search_evidence', 0, NULL), ('expand_neighbors', 1, 'ORDERED_FROM'), ('run_metric', 1, NULL),
    ('expand_neighbors', 2, 'EVIDENCED_BY'), ('verify_path', 2, NULL), ('finish_answer', 2, NULL)) AS v(action, depth, relationship_type), (SELECT n AS questions FROM s)""",
)
def traversal_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps of the three templates of `bound_questions`."""
    templates = _bound(spark, sf_dir).groupBy("question_id").agg(F.collect_list("template").alias("templates"))
    steps = templates.select(F.explode(traversal.traversal(F.col("templates"))).alias("s")).select("s.*")
    return steps.groupBy("action", "depth", "relationship_type").agg(F.count("*").alias("questions"))


@query(
    "finalised_answers",
    """WITH l AS (SELECT l_orderkey AS k, count(*) FILTER (l_returnflag <> 'A') AS cited, coalesce(bool_or(l_quantity = 50) FILTER (l_returnflag <> 'A'), false) AS conflict FROM lineitem GROUP BY ALL),
    a AS (SELECT o_orderkey AS k, o_custkey % 10 = 0 AS differs, coalesce(cited, 0) AS cited, coalesce(conflict, false) AS conflict FROM orders LEFT JOIN l ON k = o_orderkey)
    SELECT k AS pack_id, CASE WHEN differs THEN 'contract_differs' WHEN conflict OR cited = 0 THEN 'abstained' ELSE 'verified' END AS status,
    CASE WHEN differs THEN NULL WHEN conflict THEN 'conflicting_evidence' WHEN cited = 0 THEN 'incomplete_evidence_coverage' END AS abstention_reason, CASE WHEN NOT differs AND NOT conflict AND cited > 0 THEN 'total' END AS direct_answer FROM a""",
)
def finalised_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer for each order, cited by its lines; returned lines have no hash, those of quantity 50 conflict."""
    line = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("string").alias("chunk_id"), F.col("l_suppkey").cast("string").alias("source_id"), F.when(F.col("l_returnflag") != "A", "h").otherwise("").alias("source_hash"),
        F.lit("total").alias("claim"), F.when(F.col("l_quantity") == 50, F.array(F.lit("conflicting"))).alias("quality_flags"),
    )
    drafts = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("pack_id"), F.array(F.lit("total")).alias("claim_ids"), F.array(F.when(F.col("o_custkey") % 10 == 0, "other").otherwise("total")).alias("evidence_claim_ids"), F.lit("total").alias("direct_answer"), F.lit("sum").alias("calculation")
    )
    return traversal.finalise(drafts, traversal.citations(line, "l_orderkey", "claim")).drop("calculation")


@query(
    "expanded_evidence",
    """SELECT item_id % 20 AS query_id, item_id // 20 AS position, item_id AS candidate_id, sha256(trim(left(text, 10) || chr(10) || 'Evidence: ' || text)) AS text_sha256, item_id * 2 AS source_id FROM benchmark WHERE text IS NOT NULL""",
)
def expanded_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages as candidates, each with two sources."""
    item = table(spark, sf_dir, "benchmark").where("text is not null")
    candidates = item.select((F.col("item_id") % 20).alias("query_id"), F.expr("item_id div 20").alias("position"), F.col("item_id").alias("candidate_id"))
    chunks = item.select(F.col("item_id").alias("candidate_id"), F.left("text", F.lit(10)).alias("summary"), "text", F.lit("h").alias("source_hash"))
    owners = item.select(F.col("item_id").alias("candidate_id"), F.explode(F.array(F.col("item_id") * 2, F.col("item_id") * 2 + 1)).alias("source_id"))
    found = traversal.expand_evidence(candidates, chunks, owners)
    return found.select("query_id", "position", "candidate_id", F.sha2("text", 256).alias("text_sha256"), "source_id")


@query("top_merchants", "SELECT l_suppkey AS suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey ORDER BY n DESC, suppkey LIMIT 10")
def top_merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.top_names(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("suppkey")), "suppkey", 10)


@query(
    "extended_graph_counts",
    f"""WITH {COMPONENTS}, k AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS DECIMAL(18,2)), CAST(l_extendedprice AS DECIMAL(18,2)), CAST(l_discount AS DECIMAL(18,4)), CAST(l_tax AS DECIMAL(18,4)), CAST(l_shipdate AS DATE), count(*) AS n FROM lineitem GROUP BY ALL),
    e AS (SELECT 3 * count(*) + (SELECT count(*) FROM orders) AS n FROM k), v AS (SELECT count(*) - count(DISTINCT o_custkey) AS n FROM orders)
    SELECT kind, e.n AS edges, CAST(0 AS BIGINT) AS missing FROM e, (VALUES ('HAS_FINANCIAL_EVENT'), ('EVENT_FOR_COMPONENT'), ('EVENT_EVIDENCE')) AS t(kind) UNION ALL SELECT 'SUPERSEDES', n, 0 FROM v""",
)
def extended_graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that events add to the graph; a customer's orders' totals supersede each other."""
    components, orders = domain.money_components(spark, sf_dir), domain.orders(spark, sf_dir)
    from pyspark.sql import Window

    # Totals are put in order by numbers; their keys, which are long, are made after.
    before = F.lag("orderkey").over(Window.partitionBy("custkey").orderBy("occurred_at", "orderkey"))
    totals = orders.where("orderkey is not null").select("orderkey", before.alias("old"))
    total = lambda key: F.concat_ws(":", F.col(key).cast("string"), F.lit("customer_total"))
    superseded = totals.where("old is not null").select(total("orderkey").alias("new_key"), total("old").alias("old_key"))
    return traversal.event_edge_counts(orders, domain.lines(spark, sf_dir), domain.platforms(spark, sf_dir), components, superseded)


@query(
    "attachment_ownership",
    """SELECT fault, count(*) AS n FROM (SELECT CASE WHEN o_orderkey IS NULL OR o_custkey % 3 = 0 THEN 'unknown_or_foreign_document' WHEN o_orderstatus = 'F' THEN 'platform_or_category_differs' END AS fault FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey) WHERE fault IS NOT NULL GROUP BY fault""",
)
def attachment_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line as a message that names its order's document; every third customer's documents are another message's, fulfilled ones of another platform."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("message_id"), F.lit("a").alias("platform"), F.lit("c").alias("category"), F.array("l_orderkey").alias("document_ids"))
    documents = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("document_id"), F.when(F.col("o_custkey") % 3 == 0, -1).otherwise(F.col("o_orderkey")).alias("message_id"), F.when(F.col("o_orderstatus") == "F", "b").otherwise("a").alias("platform"), F.lit("c").alias("category")
    )
    return traversal.ownership_faults(line, documents).groupBy("fault").agg(F.count("*").alias("n"))


@query(
    "resolution_archive_faults",
    """WITH f AS (SELECT CASE WHEN o_custkey % 4 = 0 THEN 'bundle_reference_invalid' WHEN o_custkey % 4 = 1 AND o_orderkey % 2 = 0 THEN 'resolution_reference_invalid' WHEN o_custkey % 4 = 2 AND o_orderkey % 3 = 0 THEN 'candidates_differ' END AS fault FROM orders
      UNION ALL SELECT 'not_in_exactly_one_order' FROM orders WHERE o_orderkey % 50 = 0)
    SELECT fault, count(*) AS n FROM f WHERE fault IS NOT NULL GROUP BY fault""",
)
def resolution_archive_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as resolved orders with faults planted in bundles, decisions and candidates."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    base = table(spark, sf_dir, "orders").select(key.alias("order_id"), key.alias("bundle_id"), key.alias("resolution_id"), F.array(key * 2).alias("candidate_ids"), customer.alias("c"))
    bundles = base.select("bundle_id", F.when(F.col("c") % 4 == 0, -1).otherwise(F.col("order_id")).alias("order_id"), "candidate_ids")
    differ = (F.col("c") % 4 == 2) & (F.col("order_id") % 3 == 0)
    decisions = base.where(~((F.col("c") % 4 == 1) & (F.col("order_id") % 2 == 0))).select("resolution_id", F.when(differ, F.array(F.lit(-1))).otherwise(F.col("candidate_ids")).alias("candidate_ids"))
    spare = base.where("order_id % 50 = 0").select((F.col("order_id") * 2 + 1).alias("candidate_id"))
    candidates = base.select((F.col("order_id") * 2).alias("candidate_id")).unionByName(spare)
    return traversal.archive_faults(candidates, base.drop("c"), bundles, decisions).groupBy("fault").agg(F.count("*").alias("n"))


@query(
    "cell_provenance_faults",
    """WITH f AS (SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'not_exactly_one_cell' WHEN o_orderkey % 9 = 1 THEN 'provenance_differs' WHEN o_orderkey % 9 = 2 THEN 'not_exactly_one_cell' END AS fault FROM orders)
    SELECT fault, count(*) AS n FROM f WHERE fault IS NOT NULL GROUP BY fault""",
)
def cell_provenance_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of order events: every ninth is missing, every ninth has another hash, every ninth occurs twice."""
    events = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.lit("total").alias("component_key"), F.col("o_orderkey").cast("string").alias("source_key"), F.lit("h").alias("source_hash"))
    way = F.col("event_id") % 9
    cells = events.where(way != 0).withColumn("source_hash", F.when(way == 1, "x").otherwise(F.col("source_hash")))
    cells = cells.unionByName(cells.where(way == 2))
    return traversal.provenance_faults(cells, events).groupBy("fault").agg(F.count("*").alias("n"))
