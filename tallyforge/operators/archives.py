"""Content digests of whole tables, and archives of tables whose manifests carry them.

A table's digest is the root of a tree of sha256 sums. Its rows become canonical lines; equal lines are one
leaf entry with their number; entries are ordered by the line's sum and cut into leaves by its first hex digits,
as many as keep a leaf near LEAF entries. A node's sum is over its children in order. So the root
is that of an ordered list, yet no task sees more than a leaf or sixteen children, and neither order nor
partitions of the input matter. Two tables that differ can be compared from the root down: only leaves below
differing nodes are read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.session import materialise

#: Entries of a leaf, about.
LEAF = 1_024


def canonical(column: Column, kind: T.DataType) -> Column:
    """A value in one form: fields of structs and keys of maps in order, at any depth; numbers without trailing zeros as text. Arrays keep their order."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda x: x.name)
        return F.when(column.isNotNull(), F.struct(*[canonical(column[f.name], f.dataType).alias(f.name) for f in fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: canonical(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(column), lambda x: F.struct(canonical(x["key"], kind.keyType).alias("key"), canonical(x["value"], kind.valueType).alias("value")))
        return F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    if isinstance(kind, T.DecimalType):
        text = column.cast("string")
        return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
    if isinstance(kind, T.BinaryType):
        return F.hex(column)
    return column


def canonical_line(frame: DataFrame, columns: list[str] | None = None) -> Column:
    """A row as JSON text: columns by name, nulls kept, values canonical. Columns' order and decimals' scales don't change it."""
    names = sorted(columns or frame.columns)
    return F.to_json(F.struct(*[canonical(F.col(f"`{x}`"), frame.schema[x].dataType).alias(x) for x in names]), {"ignoreNullFields": "false"})


def layout(column: Column, kind: T.DataType) -> Column:
    """The sha256 of a nested value's canonical form."""
    return F.sha2(F.to_json(F.struct(canonical(column, kind).alias("layout")), {"ignoreNullFields": "false"}), 256)


def layout_groups(frame: DataFrame, column: str) -> DataFrame:
    """layout, rows, example: rows by equal layout of a nested column, whatever the order of its keys."""
    return frame.groupBy(layout(F.col(column), frame.schema[column].dataType).alias("layout")).agg(F.count("*").alias("rows"), F.min_by(F.to_json(F.struct(column)), F.to_json(F.struct(column))).alias("example"))


def entries(frame: DataFrame, line: Column | None = None) -> DataFrame:
    """line_sha256, times: the table's distinct lines."""
    line = canonical_line(frame) if line is None else line
    return frame.select(F.sha2(F.coalesce(line, F.lit("")).cast("binary"), 256).alias("line_sha256")).groupBy("line_sha256").agg(F.count("*").alias("times"))


def _depth(n: int) -> int:
    """Hex digits of a leaf's prefix."""
    depth = 0
    while n > LEAF << 4 * depth:
        depth += 1
    return depth


def merkle_nodes(lines: DataFrame, depth: int | None = None) -> DataFrame:
    """level, prefix, digest, rows of every node of the tree over `entries`, the root at level 0; `depth`: digits of a leaf's prefix, by the number of entries unless given.

    An empty table has a root, the sum of empty text. Trees of different depths have different roots, so compare those of one depth.
    """
    depth = _depth(lines.count()) if depth is None else depth
    join = lambda items, left, right: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*items))), lambda x: F.concat(x[left], F.lit(":"), x[right].cast("string"))), ","), 256)
    level = lines.groupBy(F.substring("line_sha256", 1, depth).alias("prefix")).agg(join(("line_sha256", "times"), "line_sha256", "times").alias("digest"), F.sum("times").alias("rows"))
    level = materialise(level, "leaves")
    out = level.select(F.lit(depth).alias("level"), "prefix", "digest", "rows")
    for at in range(depth - 1, -1, -1):
        level = level.groupBy(F.substring("prefix", 1, at).alias("prefix")).agg(join(("prefix", "digest"), "prefix", "digest").alias("digest"), F.sum("rows").alias("rows"))
        out = out.unionByName(level.select(F.lit(at).alias("level"), "prefix", "digest", "rows"))
    none = lines.sparkSession.range(1).select(F.lit(0).alias("level"), F.lit("").alias("prefix"), F.lit(hashlib.sha256(b"").hexdigest()).alias("digest"), F.lit(0).cast("bigint").alias("rows"))
    return out.unionByName(none.join(level.limit(1).select(F.lit(1).alias("some")), F.lit(True), "left_anti"))


def merkle_root(frame: DataFrame, line: Column | None = None, depth: int | None = None) -> tuple[int, str]:
    """Rows and root of a table."""
    root = merkle_nodes(materialise(entries(frame, line), "entries"), depth).where("level = 0").first()
    return root["rows"], root["digest"]


def differing_lines(left: DataFrame, right: DataFrame, depth: int = 2, line: str | None = None) -> DataFrame:
    """line_sha256, left_times, right_times of lines that two tables don't have equally often; only leaves that differ are joined by line."""
    sides = [materialise(entries(x, None if line is None else F.expr(line)), "entries") for x in (left, right)]
    leaves = [merkle_nodes(x, depth).where(F.col("level") == depth).select("prefix", "digest") for x in sides]
    apart = leaves[0].join(leaves[1].withColumnRenamed("digest", "other"), "prefix", "full_outer").where(~F.col("digest").eqNullSafe(F.col("other"))).select("prefix")
    near = [x.withColumn("prefix", F.substring("line_sha256", 1, depth)).join(apart, "prefix", "left_semi").select("line_sha256", F.col("times").alias(name)) for x, name in zip(sides, ("left_times", "right_times"), strict=True)]
    both = near[0].join(near[1], "line_sha256", "full_outer").na.fill(0, ["left_times", "right_times"])
    return both.where("left_times <> right_times")


def chain(upstream: str, tables: dict[str, tuple[int, str]]) -> str:
    """An archive's digest: over what it was made from, and its tables by name with rows and roots."""
    return hashlib.sha256("\n".join([upstream, *(f"{name}:{n}:{root}" for name, (n, root) in sorted(tables.items()))]).encode()).hexdigest()


MANIFEST = "name string, rows bigint, digest string, upstream string, archive string"


def write_archive(tables: dict[str, DataFrame], path: str, upstream: str = "") -> dict[str, tuple[int, str]]:
    """Writes the tables as Parquet with a manifest of their rows and digests; returns these by name.

    Each table's job commits as a whole, its digest is of what can be read back, and the manifest is written last: an archive without one
    isn't complete. `upstream` is the digest of the archive that this one was made from; the manifest's `archive` carries it on.
    """
    found = {}
    for name, frame in sorted(tables.items()):
        frame.write.mode("overwrite").parquet(f"{path}/{name}")
        found[name] = merkle_root(frame.sparkSession.read.parquet(f"{path}/{name}"))
    spark = next(iter(tables.values())).sparkSession
    rows = [(name, n, digest, upstream, chain(upstream, found)) for name, (n, digest) in found.items()]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return found


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """name, rows, digest, upstream, archive of a complete archive."""
    return spark.read.schema(MANIFEST).option("mode", "FAILFAST").json(f"{path}/manifest")


def archive_faults(spark: SparkSession, path: str, upstream: str | None = None) -> list[tuple[str, str]]:
    """(table, fault) of an archive: rows or content that its manifest doesn't bear out, a broken chain, another upstream than the given one."""
    stated = {r["name"]: r for r in read_manifest(spark, path).collect()}
    found = {name: merkle_root(spark.read.parquet(f"{path}/{name}")) for name in sorted(stated)}
    out = [(name, "rows_differ" if n != stated[name]["rows"] else "digest_differs") for name, (n, digest) in found.items() if (n, digest) != (stated[name]["rows"], stated[name]["digest"])]
    told = {(r["upstream"], r["archive"]) for r in stated.values()}
    if len(told) != 1 or next(iter(told))[1] != chain(next(iter(told))[0], {k: (r["rows"], r["digest"]) for k, r in stated.items()}):
        out.append(("", "chain_broken"))
    if upstream is not None and {x for x, _ in told} != {upstream}:
        out.append(("", "other_upstream"))
    return out
