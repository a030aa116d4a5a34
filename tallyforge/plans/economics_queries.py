"""Registered queries over money: sums, reconciliations, indices, decompositions, signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.expressions import MONEY, unit_price
from tallyforge.operators import economics, finance
from tallyforge.plans.catalog import query
from tallyforge.sources import domain

#: The same views in SQL, shared by the oracles below.
LINES = """
lines AS (
  SELECT l_orderkey AS orderkey, l_partkey AS partkey, l_suppkey AS suppkey, l_linestatus AS linestatus, CAST(l_shipdate AS DATE) AS shipdate,
         CAST(l_quantity AS DECIMAL(18,2)) AS quantity, CAST(l_extendedprice AS DECIMAL(18,2)) AS gross,
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,4)) AS DECIMAL(18,2)) AS discount,
         CAST((CAST(l_extendedprice AS DECIMAL(18,2)) - CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,4)) AS DECIMAL(18,2)))
              * CAST(l_tax AS DECIMAL(18,4)) AS DECIMAL(18,2)) AS tax
  FROM lineitem)
"""
COMPONENTS = (
    LINES
    + """,
components AS (
  SELECT orderkey, suppkey, 'item_gross' AS component_type, gross AS amount FROM lines
  UNION ALL SELECT orderkey, suppkey, 'coupon_discount', discount FROM lines
  UNION ALL SELECT orderkey, suppkey, 'tax', tax FROM lines
  UNION ALL SELECT o_orderkey, NULL, 'customer_total', CAST(o_totalprice AS DECIMAL(18,2)) FROM orders)
"""
)
PLATFORMS = """
platforms AS (
  SELECT s_suppkey AS suppkey, lower(s_name) AS merchant, lower(r_name) AS platform
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""
BOUGHT = (
    LINES
    + """,
bought AS (
  SELECT orderkey, suppkey, lower(p_name) AS item, quantity, gross AS spend, discount, tax, shipdate AS occurred_on, year(shipdate) AS year
  FROM lines JOIN part ON partkey = p_partkey)
"""
)


@query(
    "component_sum_by_platform_type",
    f"""WITH {COMPONENTS}, {PLATFORMS}
    SELECT platform, component_type, count(*) AS components, CAST(sum(amount) AS DECIMAL(38,2)) AS total
    FROM components JOIN platforms USING (suppkey) GROUP BY ALL""",
)
def component_sum_by_platform_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    components = domain.money_components(spark, sf_dir).where("suppkey is not null")
    sums = components.groupBy("suppkey", "component_type").agg(F.count("*").alias("n"), F.sum("amount").alias("s"))
    return sums.join(domain.platforms(spark, sf_dir), "suppkey").groupBy("platform", "component_type").agg(F.sum("n").alias("components"), F.sum("s").cast("decimal(38,2)").alias("total"))


@query(
    "document_reconciliation",
    f"""WITH {COMPONENTS},
    g AS (SELECT orderkey, count(*) AS components, count(*) FILTER (component_type <> 'customer_total') AS parts,
                 max(amount) FILTER (component_type = 'customer_total') AS expected_amount, count(*) FILTER (component_type = 'customer_total') AS totals,
                 sum(CASE component_type WHEN 'coupon_discount' THEN -amount WHEN 'customer_total' THEN 0 ELSE amount END) AS calculated_amount
          FROM components GROUP BY orderkey)
    SELECT orderkey, components, expected_amount, CAST(calculated_amount AS DECIMAL(38,2)) AS calculated_amount,
           CAST(expected_amount - calculated_amount AS DECIMAL(38,2)) AS residual,
           CASE WHEN expected_amount = calculated_amount THEN 'exact' WHEN abs(expected_amount - calculated_amount) <= 0.01 THEN 'within_source_precision'
                WHEN abs(expected_amount - calculated_amount) <= 0.05 THEN 'within_rounding' ELSE 'conflicting' END AS status,
           round(CASE WHEN expected_amount = 0 AND calculated_amount = 0 THEN 1.0
                WHEN expected_amount <> 0 THEN greatest(0.0, 1 - CAST(abs(expected_amount - calculated_amount) AS DOUBLE) / CAST(abs(expected_amount) AS DOUBLE)) ELSE 0.0 END, 6) AS explained_value_ratio
    FROM g WHERE components >= 2 AND totals = 1 AND parts >= 1""",
)
def document_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = finance.reconcile_documents(domain.money_components(spark, sf_dir), ["orderkey"])
    return found.select(
        "orderkey", "components", "expected_amount", "calculated_amount", "residual", "status", F.round("explained_value_ratio", 6).alias("explained_value_ratio")
    )


@query(
    "reconciliation_status_counts",
    f"""WITH {COMPONENTS},
    g AS (SELECT orderkey, max(amount) FILTER (component_type = 'customer_total') AS e, count(*) FILTER (component_type <> 'customer_total') AS parts,
                 sum(CASE component_type WHEN 'coupon_discount' THEN -amount WHEN 'customer_total' THEN 0 ELSE amount END) AS c
          FROM components GROUP BY orderkey)
    SELECT CASE WHEN e = c THEN 'exact' WHEN abs(e - c) <= 0.01 THEN 'within_source_precision' WHEN abs(e - c) <= 0.05 THEN 'within_rounding' ELSE 'conflicting' END AS status,
           count(*) AS runs FROM g WHERE parts >= 1 AND e IS NOT NULL GROUP BY ALL""",
)
def reconciliation_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finance.reconcile_documents(domain.money_components(spark, sf_dir), ["orderkey"]).groupBy("status").agg(F.count("*").alias("runs"))


@query(
    "bundle_reconciliation",
    f"""WITH {COMPONENTS},
    roles AS (SELECT *, CASE component_type WHEN 'item_gross' THEN 100 WHEN 'tax' THEN 100 WHEN 'coupon_discount' THEN 100 ELSE 100 END AS authority FROM components),
    g AS (SELECT orderkey, count(*) AS selected, count(*) FILTER (component_type <> 'customer_total') AS parts,
                 max(amount) FILTER (component_type = 'customer_total') AS total,
                 sum(CASE component_type WHEN 'coupon_discount' THEN -amount WHEN 'customer_total' THEN 0 ELSE amount END) AS s
          FROM roles GROUP BY orderkey)
    SELECT orderkey, selected, 0::BIGINT AS rejected, CASE WHEN parts > 0 THEN total END AS expected_amount,
           CAST(CASE WHEN parts > 0 THEN s END AS DECIMAL(38,2)) AS calculated_amount, CAST(CASE WHEN parts > 0 THEN total - s END AS DECIMAL(38,2)) AS residual,
           CASE WHEN parts = 0 THEN 'partial' WHEN total = s THEN 'exact' WHEN abs(total - s) <= 0.01 THEN 'within_source_precision'
                WHEN abs(total - s) <= 0.05 THEN 'within_rounding' ELSE 'conflicting' END AS status
    FROM g""",
)
def bundle_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finance.reconcile_bundles(domain.dealt_components(spark, sf_dir))


@query(
    "price_index_yearly",
    f"""WITH {BOUGHT},
    g AS (SELECT year, item, CAST(sum(quantity) AS DOUBLE) AS q, CAST(sum(spend) AS DECIMAL(38,2)) AS s FROM bought GROUP BY ALL),
    m AS (SELECT c.year, b.q AS q0, b.s AS s0, c.q AS q1, c.s AS s1 FROM g b JOIN g c ON b.item = c.item AND c.year = b.year + 1),
    e AS (SELECT year + 1 AS year, sum(s) AS eligible FROM g GROUP BY ALL)
    SELECT year, count(*) AS matched_groups, CAST(sum(s0) AS DECIMAL(38,2)) AS base_basket_cost, round(sum(q0 * CAST(s1 AS DOUBLE) / q1), 2) AS repriced_basket_cost,
           round(sum(q0 * CAST(s1 AS DOUBLE) / q1) / CAST(sum(s0) AS DOUBLE) * 100, 6) AS index_value,
           round(CAST(sum(s0) AS DOUBLE) / CAST(any_value(eligible) AS DOUBLE), 6) AS coverage_ratio
    FROM m JOIN e USING (year) GROUP BY year""",
)
def price_index_yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, current = _yearly_baskets(spark, sf_dir)
    return economics.price_index(base, current, ["year"]).drop("paasche", "fisher")


def _yearly_baskets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each year's basket as current, and the year before's as its base."""
    bought = domain.item_observations(spark, sf_dir).select(
        "year", F.col("item").alias("comparable_group"), F.lit(True).alias("reviewed"), F.col("line_key").alias("observation_id"), "quantity", "spend"
    )
    current = economics.basket_groups(bought, ["year"], comparable_only=False)
    return current.withColumn("year", F.col("year") + 1), current


def _yearly_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    bought = domain.item_observations(spark, sf_dir)
    return bought.groupBy("year").agg(
        F.sum("spend").alias("gross"),
        F.sum("tax").alias("taxes"),
        F.sum("discount").alias("discounts"),
        F.sum(F.lit(0).cast(MONEY)).alias("fees"),
        F.sum(F.lit(0).cast(MONEY)).alias("benefits"),
        F.sum(F.lit(0).cast(MONEY)).alias("cost"),
        F.sum((F.col("spend") - F.col("discount") + F.col("tax")).cast(MONEY)).alias("observed_total"),
        F.countDistinct("orderkey").alias("orders"),
    )


@query(
    "spending_decomposition",
    f"""WITH {BOUGHT},
    g AS (SELECT year, item, CAST(sum(quantity) AS DOUBLE) AS q, CAST(sum(spend) AS DOUBLE) AS s FROM bought GROUP BY ALL),
    t AS (SELECT year, sum(tax) AS tax, sum(discount) AS discount, sum(spend - discount + tax) AS observed FROM bought GROUP BY ALL),
    f AS (SELECT coalesce(c.year, b.year + 1) AS year, b.q AS q0, b.s AS s0, c.q AS q1, c.s AS s1 FROM g b FULL JOIN g c ON b.item = c.item AND c.year = b.year + 1),
    e AS (SELECT year, sum((s1 / q1 - s0 / q0) * q0) AS p, sum((q1 - q0) * s0 / q0) AS q, sum((s1 / q1 - s0 / q0) * (q1 - q0)) AS i,
                 sum(CASE WHEN s0 IS NULL THEN s1 WHEN s1 IS NULL THEN -s0 ELSE 0 END) AS mix FROM f GROUP BY ALL)
    SELECT e.year, CAST(c.observed - b.observed AS DECIMAL(38,2)) AS observed_change, round(p, 2) AS price_effect, round(q, 2) AS quantity_effect, round(i, 2) AS interaction_effect,
           CAST(round(mix, 2) AS DECIMAL(38,2)) AS item_mix_effect, CAST(c.tax - b.tax AS DECIMAL(38,2)) AS tax_effect, CAST(b.discount - c.discount AS DECIMAL(38,2)) AS discount_effect,
           abs(round(CAST(c.observed - b.observed AS DOUBLE) - (p + q + i + mix) - CAST(c.tax - b.tax AS DOUBLE) - CAST(b.discount - c.discount AS DOUBLE), 1)) AS residual_size
    FROM e JOIN t c ON c.year = e.year JOIN t b ON b.year = e.year - 1""",
)
def spending_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, current = _yearly_baskets(spark, sf_dir)
    totals = _yearly_totals(spark, sf_dir)
    found = economics.decompose_spending(base, current, totals.withColumn("year", F.col("year") + 1), totals, ["year"])
    effects = ("price_effect", "quantity_effect", "interaction_effect")
    return found.select(
        "year",
        "observed_change",
        *[F.round(F.col(x).cast("double"), 2).alias(x) for x in effects],
        "item_mix_effect",
        "tax_effect",
        "discount_effect",
        F.abs(F.round(F.col("unexplained_residual").cast("double"), 1)).alias("residual_size"),
    )


@query(
    "platform_economics",
    f"""WITH {BOUGHT}, {PLATFORMS},
    t AS (SELECT platform, year, CAST(sum(spend) AS DOUBLE) AS gross, CAST(sum(discount) AS DOUBLE) AS discounts, CAST(sum(tax) AS DOUBLE) AS fees,
                 CAST(sum(spend - discount + tax) AS DOUBLE) AS observed FROM bought JOIN platforms USING (suppkey) GROUP BY ALL)
    SELECT platform, year, round(fees / observed, 6) AS fee_burden, round(discounts / gross, 6) AS discount_capture,
           CAST(0 AS DECIMAL(38,2)) AS membership_net_value, CAST(NULL AS DOUBLE) AS membership_roi, 0::BIGINT AS break_even_orders FROM t""",
)
def platform_economics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taxes stand in for fees, which the tables lack."""
    bought = domain.item_observations(spark, sf_dir).groupBy("suppkey", "year").agg(
        F.sum("spend").alias("gross"), F.sum("discount").alias("discounts"), F.sum("tax").alias("fees"), F.sum((F.col("spend") - F.col("discount") + F.col("tax")).cast(MONEY)).alias("observed_total")
    )
    zero = F.sum(F.lit(0).cast(MONEY))
    periods = bought.join(domain.platforms(spark, sf_dir), "suppkey").groupBy("platform", "year").agg(
        *[F.sum(x).alias(x) for x in ("gross", "discounts", "fees", "observed_total")], zero.alias("benefits"), zero.alias("cost"), F.lit(1).alias("orders")
    )
    return economics.platform_economics(periods, ["platform", "year"])


MONTHS = "m AS (SELECT item, date_trunc('month', occurred_on) AS t, CAST(sum(quantity) AS DOUBLE) AS q, CAST(sum(spend) AS DOUBLE) / CAST(sum(quantity) AS DOUBLE) AS p FROM bought GROUP BY ALL)"


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit price and quantity of each item and month: at most a few hundred rows for each item."""
    months = domain.item_observations(spark, sf_dir).groupBy("item", F.trunc("occurred_on", "month").alias("occurred_at")).agg(F.sum("quantity").alias("q"), F.sum("spend").alias("s"))
    return months.select("item", "occurred_at", F.col("q").cast("double").alias("quantity"), (F.col("s").cast("double") / F.col("q").cast("double")).alias("price"))


@query(
    "elasticity_by_item",
    f"""WITH {BOUGHT}, {MONTHS},
    l AS (SELECT item, p, q, lag(p) OVER w AS p0, lag(q) OVER w AS q0 FROM m WINDOW w AS (PARTITION BY item ORDER BY t)),
    e AS (SELECT item, ((q - q0) / ((q + q0) / 2)) / ((p - p0) / ((p + p0) / 2)) AS e FROM l WHERE p0 IS NOT NULL AND p <> p0)
    SELECT item, round(median(e), 6) AS elasticity, count(*) AS transitions FROM e GROUP BY item HAVING count(*) >= 3""",
)
def elasticity_by_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return economics.elasticity(_monthly(spark, sf_dir), ["item"])


@query(
    "substitution_score",
    f"""WITH {BOUGHT}, {MONTHS},
    k AS (SELECT item, lead(item) OVER (ORDER BY item) AS other FROM (SELECT DISTINCT item FROM m)),
    j AS (SELECT k.item, a.t, a.p, a.q, b.q AS oq FROM k JOIN m a ON a.item = k.item JOIN m b ON b.item = k.other AND b.t = a.t),
    l AS (SELECT item, p, q, oq, lag(p) OVER w AS p0, lag(q) OVER w AS q0, lag(oq) OVER w AS oq0 FROM j WINDOW w AS (PARTITION BY item ORDER BY t)),
    s AS (SELECT item, count(*) AS n, count(*) FILTER (p > p0) AS rises, count(*) FILTER (p > p0 AND q < q0 AND oq > oq0) AS switches FROM l GROUP BY item)
    SELECT item, round(switches / rises, 6) AS score, rises AS qualifying FROM s WHERE n >= 4 AND rises >= 1""",
)
def substitution_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item against the next one by name, month by month."""
    months = _monthly(spark, sf_dir)
    items = months.select("item").distinct()
    pairs = items.select("item", F.lead("item").over(economics.Window.orderBy("item")).alias("other"))
    other = months.select(F.col("item").alias("other"), "occurred_at", F.col("quantity").alias("other_quantity"))
    series = months.join(pairs, "item").join(other, ["other", "occurred_at"]).select("item", "occurred_at", F.col("price").alias("focal_price"), F.col("quantity").alias("focal_quantity"), "other_quantity")
    return economics.substitution(series, ["item"])


DAYS = """
d AS (SELECT event_type, CAST(ts AS DATE) AS t, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS v FROM events GROUP BY ALL),
s AS (SELECT event_type, list(v ORDER BY t) AS values FROM d GROUP BY ALL HAVING count(*) >= 6),
c AS (SELECT *, list_aggregate(values, 'median') AS med FROM s),
a AS (SELECT *, list_aggregate(list_transform(values, lambda x: abs(x - med)), 'median') AS mad FROM c)
"""


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.session import table

    events = table(spark, sf_dir, "events")
    return events.groupBy("event_type", F.to_date("ts").alias("occurred_at")).agg(F.sum(F.col("value").cast(MONEY)).cast("double").alias("value"))


@query(
    "anomaly_daily",
    f"""WITH {DAYS}
    SELECT event_type, round(med, 6) AS median, round(mad, 6) AS deviation,
           CASE WHEN mad > 0 THEN len(list_filter(values, lambda x: abs(x - med) > 3.5 * 1.4826 * mad)) ELSE 0 END AS anomalies FROM a""",
)
def anomaly_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return economics.anomalies(_daily(spark, sf_dir), ["event_type"]).select("event_type", "median", "deviation", F.size("anomalies").cast("bigint").alias("anomalies"))


@query(
    "change_points_monthly",
    f"""WITH {BOUGHT},
    q AS (SELECT item, year * 4 + quarter(occurred_on) AS t, CAST(sum(spend) AS DOUBLE) AS v FROM bought GROUP BY ALL),
    s AS (SELECT item, list(v ORDER BY t) AS v FROM q GROUP BY ALL HAVING count(*) >= 6),
    x AS (SELECT item, v, unnest(range(3, len(v) - 2)) AS i FROM s),
    y AS (SELECT item, i, list_aggregate(v[:i], 'median') AS a, list_aggregate(v[i + 1:], 'median') AS b FROM x)
    SELECT item, count(*) FILTER (CASE WHEN a = 0 THEN b <> 0 ELSE abs(b - a) / abs(a) >= 0.5 END) AS change_points FROM y GROUP BY item""",
)
def change_points_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly spend of each item."""
    bought = domain.item_observations(spark, sf_dir)
    series = bought.groupBy("item", (F.col("year") * 4 + F.quarter("occurred_on")).alias("occurred_at")).agg(F.sum("spend").cast("double").alias("value"))
    return economics.change_points(series, ["item"]).select("item", F.size("change_points").cast("bigint").alias("change_points"))


def _order_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    components = domain.money_components(spark, sf_dir).where("component_type <> 'customer_total'")
    return components.groupBy("orderkey", "component_type").agg(F.sum("amount").cast("decimal(38,2)").alias("amount"))


def _four_places(found: DataFrame) -> DataFrame:
    return found.withColumns({x: F.col(x).cast("decimal(38,4)") for x in ("simulated_total", "difference")})


def _counterfactual_sql(simulated: str) -> str:
    return f"""WITH {COMPONENTS},
    t AS (SELECT orderkey, component_type, CAST(sum(amount) AS DECIMAL(18,2)) AS amount FROM components WHERE component_type <> 'customer_total' GROUP BY ALL),
    s AS (SELECT orderkey, sum(CASE component_type WHEN 'coupon_discount' THEN -amount ELSE amount END) AS o, {simulated} AS s FROM t GROUP BY ALL)
    SELECT orderkey, CAST(o AS DECIMAL(38,2)) AS observed_total, CAST(s AS DECIMAL(38,4)) AS simulated_total, CAST(s - o AS DECIMAL(38,4)) AS difference FROM s"""


@query("counterfactual_no_tax", _counterfactual_sql("sum(CASE component_type WHEN 'coupon_discount' THEN -amount WHEN 'tax' THEN 0 ELSE amount END)"))
def counterfactual_no_tax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _four_places(finance.counterfactual(_order_types(spark, sf_dir), [("tax", "replace", "0")], ["orderkey"]))


@query(
    "counterfactual_discount_cut",
    _counterfactual_sql("sum(CASE component_type WHEN 'coupon_discount' THEN -(amount * CAST(0.5 AS DECIMAL(4,2))) ELSE amount END)"),
)
def counterfactual_discount_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _four_places(finance.counterfactual(_order_types(spark, sf_dir), [("coupon_discount", "scale", "-0.5")], ["orderkey"]))


@query(
    "price_history_change",
    f"""WITH {BOUGHT}, {PLATFORMS},
    r AS (SELECT merchant, item, orderkey, occurred_on, CAST((2 * CAST(spend * 100 AS BIGINT) * 100 + CAST(quantity * 100 AS BIGINT)) // (2 * CAST(quantity * 100 AS BIGINT)) AS DECIMAL(18,2)) / 100 AS pr FROM bought JOIN platforms USING (suppkey)),
    h AS (SELECT merchant, item, orderkey, occurred_on, CAST(pr AS DECIMAL(18,2)) AS price FROM r),
    g AS (SELECT merchant, item, count(*) AS observations, min({{'d': occurred_on, 'o': orderkey, 'p': price}}).p AS first_price,
                 max({{'d': occurred_on, 'o': orderkey, 'p': price}}).p AS last_price FROM h GROUP BY ALL)
    SELECT merchant, item, observations, first_price, last_price, CAST(last_price - first_price AS DECIMAL(18,2)) AS delta,
           CASE WHEN first_price <> 0 THEN round(CAST(last_price - first_price AS DOUBLE) / CAST(first_price AS DOUBLE) * 100, 4) END AS change_pct FROM g""",
)
def price_history_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    observed = domain.item_observations(spark, sf_dir).withColumn("price", unit_price(F.col("spend"), F.col("quantity")))
    found = finance.latest_prices(observed, ["suppkey", "item"])
    return found.join(domain.platforms(spark, sf_dir).select("suppkey", "merchant"), "suppkey").drop("suppkey")
