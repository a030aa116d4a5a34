"""Exact order statistics, medians and median deviations of decimals or doubles, without gathering a group.

Values are counted first, so that a value shared by many rows is one row. A group of many distinct
values is narrowed: its range is cut into bins, the bins are counted, and only the bin that holds the
wanted rank is read on, until few values are left to be put in order. No list of a group is made, no
task orders more than `most` values of a group, and what is returned are values of the rows themselves.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.session import materialise

#: Bins that a range is cut into at a time.
BINS = 1024
#: Distinct values that a group may still have when they are put in order.
MOST = 20_000
#: A normal deviation for each median deviation: a fixed value.
NORMAL = Decimal("1.4826")


def _matched(keys: list[str]) -> Column:
    """Equality of each key with its copy that is named with an underscore, null being equal to null."""
    found = F.lit(True)
    for key in keys:
        found = found & F.col(key).eqNullSafe(F.col(f"_{key}"))
    return found


def _copied(frame: DataFrame, keys: list[str], *columns: Column | str) -> DataFrame:
    """Columns of a frame with its keys under those copies' names."""
    return frame.select(*[F.col(k).alias(f"_{k}") for k in keys], *columns)


def _joined(left: DataFrame, right: DataFrame, keys: list[str], **renamed: str) -> DataFrame:
    """Left rows with the right's columns `renamed` (old name to new one) of the same keys."""
    other = _copied(right, keys, *[F.col(old).alias(new) for old, new in renamed.items()])
    return left.join(other, _matched(keys)).drop(*[f"_{k}" for k in keys])


def counted(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys, value and `times`: each distinct value once. Null and NaN are left out."""
    kept = rows.where(F.col(value).isNotNull())
    if dict(rows.dtypes)[value] in ("double", "float"):
        kept = kept.where(~F.isnan(value))
    return kept.groupBy(*keys, F.col(value).alias("value")).agg(F.count("*").alias("times"))


def at_ranks(counts: DataFrame, keys: list[str], ranks: dict[str, Column], bins: int = BINS, most: int = MOST) -> DataFrame:
    """The values at ranks (from 1) of each group: keys, `total`, and a column for each of `ranks`.

    `counts` is what `counted` returns; a rank is an expression over `total`, the group's number of
    values. Null keys are a group like any other; a table without values gives no row; a rank below 1
    or above the total gives null. Infinite values are ordered without narrowing.
    """
    # Written once: every round reads it again.
    counts = materialise(counts.select(*keys, "value", "times"), "value-counts")
    groups = counts.groupBy(*keys).agg(F.sum("times").alias("total"), F.count("*").alias("left"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("bigint").alias("rank")) for name, rank in ranks.items()])
    open_ = groups.withColumn("w", F.explode(wanted)).select(*keys, "total", "w.name", "w.rank", F.lit(0).cast("bigint").alias("before"), "left", "lo", "hi")
    span = F.col("hi").cast("double") - F.col("lo").cast("double")
    wide = (F.col("left") > most) & (span > 0) & (span < F.lit(float("inf")))
    ready = None
    while True:
        open_ = materialise(open_, "rank-targets")
        settled = open_.where(~wide)
        ready = settled if ready is None else ready.unionByName(settled)
        if not open_.where(wide).limit(1).collect():
            break
        pieces = _inside(counts, open_.where(wide), keys)
        place = F.floor((F.col("value").cast("double") - F.col("lo").cast("double")) / span * bins)
        cut = pieces.groupBy(*keys, "total", "name", "rank", "before", place.alias("bin")).agg(
            F.sum("times").alias("times"), F.count("*").alias("left"), F.min("value").alias("lo"), F.max("value").alias("hi")
        )
        # At most `bins` + 1 rows to a window.
        upto = F.col("before") + F.sum("times").over(Window.partitionBy(*keys, "name").orderBy("bin"))
        cut = cut.withColumn("upto", upto).where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("times")))
        open_ = cut.select(*keys, "total", "name", "rank", (F.col("upto") - F.col("times")).alias("before"), "left", "lo", "hi")
    pieces = _inside(counts, ready, keys)
    upto = F.col("before") + F.sum("times").over(Window.partitionBy(*keys, "name").orderBy("value"))
    hits = pieces.withColumn("upto", upto).where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("times")))
    values = hits.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in ranks])
    return _copied(groups, keys, "total").join(values, _matched(keys), "left").select(*[F.col(f"_{k}").alias(k) for k in keys], "total", *ranks)


def _inside(counts: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """The counted values within the range of each target of their group."""
    other = _copied(targets, keys, "total", "name", "rank", "before", "lo", "hi")
    return counts.join(other, _matched(keys) & F.col("value").between(F.col("lo"), F.col("hi"))).drop(*[f"_{k}" for k in keys])


def _middle(low: Column, high: Column, kind: str) -> Column:
    """The mean of two values: exact for decimals, with one more digit."""
    return (low + high) * (F.lit(Decimal("0.5")) if kind.startswith("decimal") else F.lit(0.5))


def _medians(counts: DataFrame, keys: list[str], **limits: int) -> DataFrame:
    kind = dict(counts.dtypes)["value"]
    total = F.col("total")
    found = at_ranks(counts, keys, {"low": F.floor((total + 1) / 2), "high": F.floor(total / 2) + 1}, **limits)
    return found.select(*keys, "total", _middle(F.col("low"), F.col("high"), kind).alias("median"))


def medians(rows: DataFrame, keys: list[str], value: str, **limits: int) -> DataFrame:
    """Keys, `total` and the exact `median` of each group: the mean of the two middle values where there are two.

    A decimal's median is a decimal with one digit more; nothing passes through doubles. Nulls and NaN
    are no values; groups without a value have no row.
    """
    return _medians(counted(rows, keys, value), keys, **limits)


def nearest_ranks(rows: DataFrame, keys: list[str], value: str, shares: dict[str, str], **limits: int) -> DataFrame:
    """Nearest-rank percentiles: the ceil(share * total)-th value, by a name for each share (a decimal text such as "0.95")."""
    ranks = {name: F.greatest(F.lit(1), F.ceil(F.lit(Decimal(share)) * F.col("total"))) for name, share in shares.items()}
    return at_ranks(counted(rows, keys, value), keys, ranks, **limits)


def deviations(rows: DataFrame, keys: list[str], value: str, **limits: int) -> DataFrame:
    """Keys, `total`, `median` and `deviation`: the median of the distances from the median, exactly."""
    counts = materialise(counted(rows, keys, value), "values")
    middle = materialise(_medians(counts, keys, **limits), "medians")
    far = _joined(counts, middle, keys, median="median")
    far = far.groupBy(*keys, F.abs(F.col("value") - F.col("median")).alias("value")).agg(F.sum("times").alias("times"))
    return _joined(middle, _medians(far, keys, **limits), keys, median="deviation")


def outliers(rows: DataFrame, keys: list[str], value: str, threshold: str = "3.5", **limits: int) -> DataFrame:
    """The rows more than `threshold` robust deviations from their group's median, with `median` and `deviation` added.

    One row of output for each such row, ties and repeats included; none in a group whose deviation is
    0. Decimals are compared as decimals. Only rows move: the groups' medians come to them by a join
    that adaptive execution can split, so a hot group isn't one task.
    """
    found = _joined(rows, deviations(rows, keys, value, **limits), keys, median="median", deviation="deviation")
    decimal = dict(rows.dtypes)[value].startswith("decimal")
    limit = F.lit(Decimal(threshold) * NORMAL if decimal else float(threshold) * float(NORMAL))
    return found.where((F.col("deviation") > 0) & (F.abs(F.col(value) - F.col("median")) > limit * F.col("deviation")))
