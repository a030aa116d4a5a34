"""Joins of points in time with windows that hold them (start <= point < end), as equi-joins.

A window lies in the bins of a width that is at least its own length, a power of two, so in two bins at most,
however long it is. A point lies in one bin of each width that some window has. Point and window thus meet in
exactly one bin, an exact filter decides, and hot bins are split by adaptive execution like any join key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.session import materialise


def _number(column: Column, kind: T.DataType) -> Column:
    """A time as whole microseconds, a date as days, an integer as it is."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(column.cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("bigint")
    if isinstance(kind, T.IntegralType):
        return column.cast("bigint")
    raise TypeError(f"no points of type {kind.simpleString()}")


def containing(points: DataFrame, windows: DataFrame, point: str, start: str, end: str, keys: list[str] | None = None) -> DataFrame:
    """Each point's columns with those of every window of equal `keys` that holds it.

    Points and ends are of one type: timestamps, dates or integers. Null points and windows with a null end or end <= start meet nothing. The two
    frames share no column names but `keys`.
    """
    keys = keys or []
    number = lambda frame, name: _number(F.col(name), frame.schema[name].dataType)
    spans = windows.withColumns({"_start": number(windows, start), "_end": number(windows, end)}).where("_end > _start")
    # The exponent of the least power of two that isn't less than the length; lengths past a long have the largest.
    length = F.try_subtract("_end", "_start")
    spans = spans.withColumn("_level", F.when(length == 1, 0).otherwise(F.coalesce(F.length(F.bin(length - 1)), F.lit(63))).cast("int"))
    # 64 widths at most.
    levels = sorted(r[0] for r in spans.select("_level").distinct().collect())
    bin_of = lambda value, level: F.call_function("shiftright", value, level)
    last = bin_of(F.col("_end") - 1, F.col("_level"))
    first = bin_of(F.col("_start"), F.col("_level"))
    spans = spans.withColumn("_bin", F.explode(F.array_distinct(F.array(first, last))))
    asked = points.withColumn("_at", number(points, point)).where("_at is not null")
    asked = asked.withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))).withColumn("_bin", bin_of(F.col("_at"), F.col("_level")))
    met = asked.join(spans, [*keys, "_level", "_bin"]).where("_at >= _start and _at < _end")
    shown = [c for c in windows.columns if c not in keys]
    return met.select(*points.columns, *shown)


def containing_or_none(points: DataFrame, windows: DataFrame, point: str, start: str, end: str, keys: list[str] | None = None) -> DataFrame:
    """The same with points in no window kept, the window's columns null."""
    # Points are met again by a number, so they are written once for it to stay.
    written = materialise(points.withColumn("_row", F.monotonically_increasing_id()), "points")
    shown = [c for c in windows.columns if c not in (keys or [])]
    found = containing(written, windows, point, start, end, keys).select("_row", *shown)
    return written.join(found, "_row", "left").select(*points.columns, *shown)
