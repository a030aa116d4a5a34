"""Registered queries over exact order statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.expressions import money
from tallyforge.operators import medians
from tallyforge.plans.catalog import query
from tallyforge.session import table

PRICES = "p AS (SELECT l_returnflag AS flag, l_suppkey AS suppkey, l_orderkey AS orderkey, CAST(l_extendedprice AS DECIMAL(18,2)) AS x FROM lineitem)"


def _median(rows: str, key: str, value: str, name: str) -> str:
    """SQL of the exact median of each group, by ordering it."""
    return f"""SELECT {key}, max(n) AS total, (max({value}) FILTER (i = (n + 1) // 2) + max({value}) FILTER (i = n // 2 + 1)) * CAST(0.5 AS DECIMAL(2,1)) AS {name}
    FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {value}) AS i, count(*) OVER (PARTITION BY {key}) AS n FROM {rows}) GROUP BY {key}"""


def _deviations(key: str) -> str:
    return f"""m AS ({_median("p", key, "x", "median")}), far AS (SELECT p.*, abs(x - median) AS d FROM p JOIN m USING ({key})), v AS ({_median("far", key, "d", "deviation")})"""


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("flag"), F.col("l_suppkey").alias("suppkey"), F.col("l_orderkey").alias("orderkey"), money("l_extendedprice").alias("x")
    )


@query(
    "median_deviation_by_flag",
    f"WITH {PRICES}, {_deviations('flag')} SELECT flag, m.total, CAST(median AS DECIMAL(38,4)) AS median, CAST(deviation AS DECIMAL(38,4)) AS deviation FROM m JOIN v USING (flag)",
)
def median_deviation_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few and huge groups: medians and median deviations of all line amounts, by narrowing."""
    found = medians.deviations(_prices(spark, sf_dir), ["flag"], "x")
    return found.select("flag", "total", *[F.col(c).cast("decimal(38,4)").alias(c) for c in ("median", "deviation")])


@query(
    "price_outliers",
    f"""WITH {PRICES}, {_deviations('suppkey')} SELECT p.suppkey, p.orderkey, p.x AS amount, CAST(median AS DECIMAL(38,4)) AS median, CAST(deviation AS DECIMAL(38,4)) AS deviation
    FROM p JOIN m USING (suppkey) JOIN v USING (suppkey) WHERE deviation > 0 AND abs(x - median) > CAST(2.22390 AS DECIMAL(6,5)) * deviation""",
)
def price_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line amounts 1.5 robust deviations off their merchant's median."""
    found = medians.outliers(_prices(spark, sf_dir), ["suppkey"], "x", "1.5")
    return found.select("suppkey", "orderkey", F.col("x").alias("amount"), *[F.col(c).cast("decimal(38,4)").alias(c) for c in ("median", "deviation")])


@query(
    "amount_percentiles",
    f"""WITH {PRICES}, r AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY x) AS i, count(*) OVER (PARTITION BY flag) AS n FROM p)
    SELECT flag, max(n) AS total, max(x) FILTER (i = greatest(1, (n * 50 + 99) // 100)) AS p50, max(x) FILTER (i = greatest(1, (n * 95 + 99) // 100)) AS p95 FROM r GROUP BY flag""",
)
def amount_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles of line amounts."""
    return medians.nearest_ranks(_prices(spark, sf_dir), ["flag"], "x", {"p50": "0.5", "p95": "0.95"})
