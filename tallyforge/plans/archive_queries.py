"""Registered queries over content digests and time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import archives, intervals
from tallyforge.plans.catalog import query
from tallyforge.session import table

LINE = "concat_ws('|', o_orderkey, o_custkey, o_orderstatus)"
LINES = f"lines AS (SELECT sha256({LINE}) AS h, count(*) AS n FROM orders GROUP BY 1)"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


@query(
    "merkle_nodes",
    f"""WITH {LINES},
    l2 AS (SELECT substr(h, 1, 2) AS prefix, sha256(string_agg(h || ':' || n, ',' ORDER BY h)) AS digest, CAST(sum(n) AS BIGINT) AS rows FROM lines GROUP BY 1),
    l1 AS (SELECT substr(prefix, 1, 1) AS p, sha256(string_agg(prefix || ':' || digest, ',' ORDER BY prefix)) AS digest, CAST(sum(rows) AS BIGINT) AS rows FROM l2 GROUP BY 1),
    l0 AS (SELECT '' AS p, sha256(string_agg(p || ':' || digest, ',' ORDER BY p)) AS digest, CAST(sum(rows) AS BIGINT) AS rows FROM l1)
    SELECT 2 AS level, * FROM l2 UNION ALL SELECT 1, * FROM l1 UNION ALL SELECT 0, * FROM l0""",
)
def merkle_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders' tree with leaves of two digits."""
    return archives.merkle_nodes(archives.entries(_orders(spark, sf_dir), F.expr(LINE)), 2)


@query(
    "merkle_difference",
    f"""WITH {LINES}, changed AS (SELECT sha256(concat_ws('|', o_orderkey, o_custkey, CASE WHEN o_orderkey % 100 = 0 THEN 'X' ELSE o_orderstatus END)) AS h FROM orders WHERE o_orderkey % 100 <> 1),
    other AS (SELECT h, count(*) AS n FROM changed GROUP BY 1)
    SELECT coalesce(l.h, o.h) AS line_sha256, coalesce(l.n, 0) AS left_times, coalesce(o.n, 0) AS right_times FROM lines l FULL JOIN other o ON l.h = o.h WHERE coalesce(l.n, 0) <> coalesce(o.n, 0)""",
)
def merkle_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of which some were changed and some left out, found by descending into leaves that differ."""
    orders = _orders(spark, sf_dir)
    other = orders.where("o_orderkey % 100 <> 1").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 100 == 0, "X").otherwise(F.col("o_orderstatus")))
    return archives.differing_lines(orders, other, 2, LINE)


@query(
    "layout_groups",
    "SELECT count(*) AS rows FROM lineitem GROUP BY l_returnflag, l_linestatus",
)
def layout_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items' flags as nested maps whose keys stand in an order by row: as many layouts as pairs of flags."""
    flag, status = F.struct(F.lit("flag").alias("k"), F.col("l_returnflag").alias("v")), F.struct(F.lit("status").alias("k"), F.col("l_linestatus").alias("v"))
    shape = F.map_from_entries(F.when(F.col("l_orderkey") % 2 == 0, F.array(flag, status)).otherwise(F.array(status, flag)))
    nested = table(spark, sf_dir, "lineitem").select(F.struct(shape.alias("page"), F.lit(1).alias("pages")).alias("shape"))
    return archives.layout_groups(nested, "shape").select("rows")


@query(
    "window_containment",
    """WITH w AS (SELECT o_orderkey AS window_id, CAST(o_orderdate AS DATE) AS begins, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 700 AS INTEGER) AS ends FROM orders WHERE o_orderkey % 400 = 3)
    SELECT window_id, count(*) AS lines, CAST(min(CAST(l_shipdate AS DATE)) AS VARCHAR) AS first_on FROM lineitem JOIN w ON CAST(l_shipdate AS DATE) >= begins AND CAST(l_shipdate AS DATE) < ends GROUP BY window_id""",
)
def window_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipped lines in windows of a day to two years, which overlap; lines of a day are counted before windows meet them, so a pair is a window and a day."""
    begins = F.col("o_orderdate").cast("date")
    windows = _orders(spark, sf_dir).where("o_orderkey % 400 = 3").select(F.col("o_orderkey").alias("window_id"), begins.alias("begins"), F.date_add(begins, (F.col("o_orderkey") % 700).cast("int")).alias("ends"))
    days = table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("shipped")).agg(F.count("*").alias("n"))
    return intervals.containing(days, windows, "shipped", "begins", "ends").groupBy("window_id").agg(F.sum("n").alias("lines"), F.min("shipped").cast("string").alias("first_on"))
