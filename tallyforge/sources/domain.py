"""The commerce domain over the star-schema tables, as lazily built views.

Platform = region of the supplier, merchant = supplier, order = order, item = part name,
money components = line amounts unpivoted plus each order's total, evidence = the line or order
row itself, hashed. Doubles become decimals here and nowhere else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.expressions import MONEY, money
from tallyforge.session import table

CURRENCY = "INR"
#: Document role that each line amount is taken from, by whether the line is open or fulfilled.
LINE_ROLES = {"item_gross": "zomato_merchant_invoice", "tax": "zomato_merchant_invoice", "coupon_discount": "zomato_order_summary"}

#: A line's component types and their columns.
AMOUNTS = (("item_gross", "gross"), ("coupon_discount", "discount"), ("tax", "tax"))


def platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(suppkey, merchant, platform): five platforms, one for each merchant. Nation and region are fixed small tables."""
    nations = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    nations = nations.select("n_nationkey", F.lower("r_name").alias("platform"))
    suppliers = table(spark, sf_dir, "supplier").join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey"))
    return suppliers.select(F.col("s_suppkey").alias("suppkey"), F.lower("s_name").alias("merchant"), "platform")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with exact amounts and a key: whole rows are unique where line numbers aren't."""
    return lines_of(table(spark, sf_dir, "lineitem"))


def lines_of(raw: DataFrame, *more: str) -> DataFrame:
    """`lines` of rows of the table, with further columns of theirs; what is joined to raw rows moves no key and no amount."""
    frame = raw.select(
        F.col("l_orderkey").alias("orderkey"),
        F.col("l_partkey").alias("partkey"),
        F.col("l_suppkey").alias("suppkey"),
        F.col("l_linenumber").alias("linenumber"),
        money("l_quantity").alias("quantity"),
        money("l_extendedprice").alias("gross"),
        F.col("l_discount").cast("decimal(18,4)").alias("discount_rate"),
        F.col("l_tax").cast("decimal(18,4)").alias("tax_rate"),
        F.col("l_linestatus").alias("linestatus"),
        F.to_date("l_shipdate").alias("shipdate"),
        *more,
    )
    frame = frame.withColumn("discount", (F.col("gross") * F.col("discount_rate")).cast(MONEY))
    frame = frame.withColumn("tax", ((F.col("gross") - F.col("discount")) * F.col("tax_rate")).cast(MONEY))
    parts = ("orderkey", "partkey", "suppkey", "linenumber", "quantity", "gross", "discount_rate", "tax_rate", "shipdate")
    return frame.withColumn("line_key", F.concat_ws("|", *[F.col(x).cast("string") for x in parts]))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(orderkey, custkey, total, occurred_at, status)"""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("orderkey"),
        F.col("o_custkey").alias("custkey"),
        money("o_totalprice").alias("total"),
        F.col("o_orderdate").alias("occurred_at"),
        F.col("o_orderstatus").alias("status"),
    )


def money_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(component_key, orderkey, suppkey, component_type, amount, currency, source_precision, scope, source_key, role)

    One pass over the lines makes three components each; the union with order totals moves no row.
    """
    return _with_totals(line_components(lines(spark, sf_dir)), orders(spark, sf_dir))


def dealt_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`money_components` with all of an order's in one part: lines and totals move once, dealt by order, as rows of amounts, and components are made where these then lie.

    What is grouped by order, or by order and more, moves nothing again. An order has few lines.
    """
    none, whole = F.lit(None), F.col("whole")
    rows = lines(spark, sf_dir).select("orderkey", "suppkey", "line_key", *(name for _, name in AMOUNTS), none.cast(MONEY).alias("total"), F.lit(False).alias("whole"))
    totals = orders(spark, sf_dir).select("orderkey", none.cast("bigint").alias("suppkey"), none.cast("string").alias("line_key"), *(none.cast(MONEY).alias(name) for _, name in AMOUNTS), "total", F.lit(True).alias("whole"))
    dealt = rows.unionByName(totals).repartition("orderkey")
    source = F.coalesce("line_key", F.col("orderkey").cast("string"))
    of_order = F.array(_entry("customer_total", "total", "zomato_order_summary"))
    made = dealt.select("orderkey", "suppkey", source.alias("source_key"), F.explode(F.when(whole, of_order).otherwise(_line_entries())).alias("c"))
    return _named(made.select(F.concat_ws(":", "source_key", "c.component_type").alias("component_key"), "orderkey", "suppkey", "c.component_type", "c.amount", "c.role", "source_key"))


def timed_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`money_components` with occurred_at of their order, null for an unknown one; lines meet it as rows of the table, before each makes three components."""
    order = orders(spark, sf_dir)
    times = order.select("orderkey", "occurred_at")
    raw = table(spark, sf_dir, "lineitem").join(times.withColumnRenamed("orderkey", "l_orderkey"), "l_orderkey", "left")
    return _with_totals(line_components(lines_of(raw, "occurred_at"), "occurred_at"), order.drop("occurred_at").join(times, "orderkey", "left"), "occurred_at")


def _with_totals(from_lines: DataFrame, order: DataFrame, *more: str) -> DataFrame:
    totals = order.select(
        F.concat_ws(":", F.col("orderkey").cast("string"), F.lit("customer_total")).alias("component_key"),
        "orderkey",
        F.lit(None).cast("bigint").alias("suppkey"),
        F.lit("customer_total").alias("component_type"),
        F.col("total").alias("amount"),
        F.lit("zomato_order_summary").alias("role"),
        F.col("orderkey").cast("string").alias("source_key"),
        *more,
    )
    return _named(from_lines.unionByName(totals))


def _named(components: DataFrame) -> DataFrame:
    return components.withColumns({"currency": F.lit(CURRENCY), "source_precision": F.lit(2), "scope": F.lit("order")})


def _entry(kind: str, amount: str, role: str) -> Column:
    return F.struct(F.lit(kind).alias("component_type"), F.col(amount).alias("amount"), F.lit(role).alias("role"))


def _line_entries() -> Column:
    return F.array(*[_entry(kind, name, LINE_ROLES[kind]) for kind, name in AMOUNTS])


def line_components(lines: DataFrame, *more: str) -> DataFrame:
    """The three components of each line, with further columns of the line's."""
    made = lines.select("line_key", "orderkey", "suppkey", *more, F.explode(_line_entries()).alias("c"))
    return made.select(
        F.concat_ws(":", "line_key", "c.component_type").alias("component_key"), "orderkey", "suppkey", "c.component_type", "c.amount", "c.role", F.col("line_key").alias("source_key"), *more
    )


def item_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(orderkey, suppkey, item, quantity, unit_price, spend, discount, tax, occurred_on, year, line_key): what was bought, at what price."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("partkey"), F.lower("p_name").alias("item"))
    bought = lines(spark, sf_dir).join(parts, "partkey")
    return bought.select(
        "orderkey", "suppkey", "item", "quantity", F.col("gross").alias("spend"), "discount", "tax", F.col("shipdate").alias("occurred_on"), F.year("shipdate").alias("year"), "line_key"
    )
