"""Exact deduplication with a heavy-hitter split, in DataFrame operations only.

A Misra-Gries summary (`freqItems`) over the digests names every digest that more than a
fraction `support` of the rows carries, besides some false ones: at most 1 / support names in
all. A second pass counts these names exactly, with map-side combining, and finds their
winners; that table has at most 1 / support rows whatever the input, so it is broadcast and
the copies in hot groups are decided where they are read. The rest is counted with map-side
combining too and joined with its counts; only rows of small groups shuffle.

Null text counts as empty text. Of equal rows (same text, same id) one stays. A null id loses
against any other id. An empty table gives an empty result. A very long text is hashed whole where it
is read. Other columns are not read, so their names don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.session import materialise, table

SUPPORT = 0.001
#: Estimated bytes of copies that are broadcast, and of a row of them besides a string id's own.
BROADCAST_BYTES, ROW_BYTES = 64 << 20, 250


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the text with each run of ASCII white space made one space."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "), 256)


def dedup_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row for each input row: id, keep_id, group_size, kept, text_sha256."""
    rows = materialise(
        docs.select(
            F.col(id_col).alias("doc_id"),
            digest(F.col(text_col)).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )
    rows = rows.withColumn("rank", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    named = rows.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    found = (
        rows.join(F.broadcast(named), "digest")
        .groupBy("digest")
        .agg(F.min("rank").alias("best"), F.count("*").alias("group_size"))
    )
    winners = F.broadcast(found)
    heavy = rows.join(winners, "digest")
    light = rows.join(F.broadcast(found.select("digest")), "digest", "left_anti")
    # Tasks reduce their copies before the shuffle, so that no group is gathered or sorted whole.
    groups = light.groupBy("digest").agg(F.min("rank").alias("best"), F.count("*").alias("group_size"))
    light = light.join(groups, "digest")
    return heavy.unionByName(light).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """`docs` without the copies, its columns unchanged.

    Ids are taken to be unique but for whole repeats: of rows with equal id and equal text one
    stays. Rows without an id stay unless a row with an id has the same text.
    """
    groups = dedup_groups(docs, id_col, text_col, support)
    gone = materialise(groups.where(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), "text_sha256", "keep_id"), "copies")
    other = gone.where(~F.col("gone_id").eqNullSafe(F.col("keep_id"))).select("gone_id", "text_sha256").distinct()
    same = gone.where(F.col("gone_id").eqNullSafe(F.col("keep_id"))).select("gone_id", "text_sha256").distinct()
    mine, sha = docs[id_col], digest(docs[text_col])
    # Copies are few columns of those rows alone; up to BROADCAST_BYTES of them go to the texts, more are met by shuffling.
    size = gone.agg(F.coalesce(F.sum(F.length(F.col("gone_id").cast("string")) + ROW_BYTES), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        other, same = F.broadcast(other), F.broadcast(same)
    matches = lambda side: mine.eqNullSafe(side["gone_id"]) & (sha == side["text_sha256"])
    left = docs.join(other, matches(other), "left_anti")
    if same.isEmpty():
        return left
    repeated = left.join(same, matches(same), "left_semi")
    once = repeated.withColumn("__sha", digest(repeated[text_col])).dropDuplicates([id_col, "__sha"]).drop("__sha")
    return left.join(same, matches(same), "left_anti").unionByName(once)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_groups(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM d
"""
