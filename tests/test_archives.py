import hashlib
import shutil
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.operators import archives


def tree(lines, depth):
    """The root, by the definition."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    counts = {}
    for line in lines:
        counts[sha(line)] = counts.get(sha(line), 0) + 1
    level = {}
    for h in sorted(counts):
        level.setdefault(h[:depth], []).append(f"{h}:{counts[h]}")
    digests = {p: sha(",".join(x)) for p, x in level.items()}
    for at in range(depth - 1, -1, -1):
        level = {}
        for p in sorted(digests):
            level.setdefault(p[:at], []).append(f"{p}:{digests[p]}")
        digests = {p: sha(",".join(x)) for p, x in level.items()}
    return digests.get("", sha(""))


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_root_by_definition(spark, depth):
    lines = [f"line {i % 700}" for i in range(1000)]
    frame = spark.createDataFrame([(x,) for x in lines], "line string")
    for parts in (1, 7):
        assert archives.merkle_root(frame.repartition(parts), F.col("line"), depth) == (1000, tree(lines, depth))
    assert archives.merkle_root(frame.limit(0), F.col("line"), depth) == (0, hashlib.sha256(b"").hexdigest())


def test_one_row_changes_the_root(spark, monkeypatch):
    monkeypatch.setattr(archives, "LEAF", 8)
    frame = spark.range(500).withColumn("v", F.col("id") * 2)
    root = archives.merkle_root(frame)
    assert archives._depth(500) == 2
    assert archives.merkle_root(frame.orderBy(F.rand(1)).select("v", "id")) == root
    others = [frame.where("id <> 3"), frame.unionByName(frame.limit(1)), frame.withColumn("v", F.when(F.col("id") == 9, None).otherwise(F.col("v")))]
    assert len({archives.merkle_root(x)[1] for x in others} | {root[1]}) == 4


def test_canonical_forms(spark):
    schema = T.StructType([T.StructField("m", T.MapType(T.StringType(), T.DecimalType(9, 3))), T.StructField("s", T.StructType([T.StructField("b", T.BinaryType()), T.StructField("a", T.ArrayType(T.IntegerType()))]))])
    rows = [({"x": Decimal("1.50"), "y": Decimal(100)}, (bytearray(b"\x01"), [2, 1])), ({"y": Decimal("100.000"), "x": Decimal("1.5")}, (bytearray(b"\x01"), [2, 1])), (None, None), ({}, (None, None))]
    got = [r[0] for r in spark.createDataFrame(rows, schema).select(archives.canonical_line(spark.createDataFrame(rows, schema))).collect()]
    assert got[0] == got[1] == '{"m":[{"key":"x","value":"1.5"},{"key":"y","value":"100"}],"s":{"a":[2,1],"b":"01"}}'
    assert got[2] == '{"m":null,"s":null}' and len(set(got)) == 3


def test_layouts_ignore_the_order_of_keys(spark):
    frame = spark.sql("SELECT map('a', 1, 'b', 2) AS x UNION ALL SELECT map('b', 2, 'a', 1) UNION ALL SELECT map('a', 2, 'b', 1) UNION ALL SELECT NULL")
    assert sorted(r.rows for r in archives.layout_groups(frame, "x").collect()) == [1, 1, 2]


def test_differences(spark):
    a, b = (spark.createDataFrame([(x,) for x in rows], "line string") for rows in (["p", "q", "q", "r"], ["p", "q", "s"]))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = {tuple(r) for r in archives.differing_lines(a, b, 1, "line").collect()}
    assert got == {(sha("q"), 2, 1), (sha("r"), 1, 0), (sha("s"), 0, 1)}
    assert archives.differing_lines(a, a.repartition(3), 2, "line").count() == 0


def test_archive_and_chain(spark, tmp_path):
    one, two = spark.range(30).withColumn("v", F.lit(None).cast("string")), spark.range(5)
    base = archives.write_archive({"one": one}, f"{tmp_path}/base")
    stated = archives.read_manifest(spark, f"{tmp_path}/base").first()
    next_ = archives.write_archive({"one": one.repartition(3), "two": two}, f"{tmp_path}/next", stated.archive)
    assert next_["one"] == base["one"] and stated.archive == archives.chain("", base)
    assert archives.archive_faults(spark, f"{tmp_path}/next", stated.archive) == []
    assert archives.archive_faults(spark, f"{tmp_path}/next", "other") == [("", "other_upstream")]
    two.limit(4).write.mode("overwrite").parquet(f"{tmp_path}/next/two")
    one.withColumn("v", F.lit("x")).write.mode("overwrite").parquet(f"{tmp_path}/next/one")
    assert archives.archive_faults(spark, f"{tmp_path}/next") == [("one", "digest_differs"), ("two", "rows_differ")]
    shutil.rmtree(f"{tmp_path}/next/manifest")
    forged = [("one", *base["one"], "", "not the chain")]
    spark.createDataFrame(forged, archives.MANIFEST).write.json(f"{tmp_path}/base2/manifest")
    one.write.parquet(f"{tmp_path}/base2/one")
    assert archives.archive_faults(spark, f"{tmp_path}/base2") == [("", "chain_broken")]
