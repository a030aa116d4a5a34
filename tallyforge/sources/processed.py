"""Processed documents and chunked sources as stored tables, their quarantine, and evidence bundles.

Rows of a source are replaced as a whole; the quarantine is read from the stored rows, so it can't disagree with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.session import exists, materialise, remove

#: What a page without text is marked with (fixed value).
NO_TEXT = "native_text_missing"
COMPLETE, QUARANTINED = "complete", "quarantined"


def page_quality(pages: DataFrame) -> DataFrame:
    """Pages with text_character_count, sorted issues and accepted: a page without text has an issue of its own, one without issues is accepted.

    pages: document_id, page_number, text, issues (array of strings, may be null), and any other columns.
    """
    size = F.coalesce(F.length("text"), F.lit(0))
    issues = F.array_sort(F.array_distinct(F.concat(F.coalesce("issues", F.array().cast("array<string>")), F.when(size == 0, F.array(F.lit(NO_TEXT))).otherwise(F.array().cast("array<string>")))))
    return pages.withColumns({"text_character_count": size, "issues": issues}).withColumn("accepted", F.size("issues") == 0)


def document_manifests(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """One manifest for each document: counts, digest of the whole text, processing status, and faults against what the inventory declared.

    documents: document_id, sha256, page_count, role, message_id. A document with a page that isn't accepted is quarantined and needs
    OCR; one without pages is complete only if it declares none. Pages of no document aren't seen here (`page_faults`). The digest is
    the SHA-256 of the sum of its pages' 60-bit hashes (over number and text), so texts aren't moved and a document of very many pages is no single task's work.
    """
    judged = page_quality(pages)
    page_hash = F.conv(F.left(F.sha2(F.concat_ws(":", "page_number", F.coalesce("text", F.lit(""))), 256), F.lit(15)), 16, 10).cast("decimal(38,0)")
    whole = judged.groupBy("document_id").agg(
        F.count("*").alias("found_pages"), F.sum("text_character_count").alias("text_character_count"), F.every("accepted").alias("quality_accepted"), F.every(F.col("text_character_count") > 0).alias("native_text_available"),
        F.sha2(F.sum(page_hash).cast("string"), 256).alias("full_text_digest"),
    )
    both = documents.join(whole, "document_id", "left").withColumns({"found_pages": F.coalesce("found_pages", F.lit(0)), "text_character_count": F.coalesce("text_character_count", F.lit(0))})
    accepted = F.coalesce("quality_accepted", F.lit(True))
    content_id = F.concat(F.lit("doc_"), F.left("sha256", F.lit(16)))
    faults = F.array_compact(F.array(F.when(F.col("document_id") != content_id, "document_id_differs"), F.when(~F.col("found_pages").eqNullSafe(F.col("page_count").cast("bigint")), "page_count_differs")))
    return both.withColumns(
        {"quality_accepted": accepted, "ocr_required": ~accepted, "native_text_available": F.coalesce("native_text_available", F.lit(False)), "processing_status": F.when(accepted, COMPLETE).otherwise(QUARANTINED), "faults": faults}
    )


def page_faults(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages that belong to no document, and page numbers that a document repeats: document_id, page_number, fault."""
    lost = pages.join(documents.select("document_id"), "document_id", "left_anti").select("document_id", "page_number", F.lit("unknown_document").alias("fault"))
    twice = pages.groupBy("document_id", "page_number").count().where("count > 1").select("document_id", "page_number", F.lit("repeated_page").alias("fault"))
    return lost.unionByName(twice)


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def replace_rows(path: str, new: DataFrame, sources: DataFrame, key: str, buckets: int = 256) -> None:
    """In the table at `path` (made if there is none), replaces all rows of the given sources (a frame with `key`) by `new`.

    The table is laid out by a bucket of the key's hash, and only touched buckets are read and written. A source without new
    rows loses its old ones. `new` has rows of these sources only. Running it again changes nothing; `buckets` stays what it was at first.
    """
    spark = new.sparkSession
    ids = materialise(sources.select(key).distinct().withColumn("bucket", _bucket(key, buckets)), "sources", small=True)
    touched = {r.bucket for r in ids.select("bucket").distinct().collect()}  # `buckets` numbers at most
    if not touched:
        return
    # New rows of a bucket meet, a large bucket in several tasks; kept rows lie by bucket already and aren't moved.
    rows = new.withColumn("bucket", _bucket(key, buckets)).hint("rebalance", "bucket")
    emptied: set[int] = set()
    if exists(spark, path):
        kept = spark.read.schema(rows.schema).parquet(path).where(F.col("bucket").isin(*touched)).join(ids.select(key), key, "left_anti").select(*rows.columns)
        rows = kept.unionByName(rows)
        emptied = touched - {r.bucket for r in rows.select("bucket").distinct().collect()}
    # Written apart first and put in place when all parts are there, so the table may be read meanwhile.
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    # An overwrite by parts leaves a part alone that has no row any more.
    for bucket in emptied:
        remove(spark, f"{path}/bucket={bucket}")


def write_documents(path: str, documents: DataFrame, pages: DataFrame, buckets: int = 256) -> DataFrame:
    """Stores documents with their pages below `path`, in place of what was stored of them, and returns their manifests.

    Documents with faults aren't stored, nor are pages of no document. Refused ids are narrow; where they are few, the pages
    that carry the texts aren't shuffled to leave them out.
    """
    manifests = materialise(document_manifests(documents, pages), "manifests")
    sound = manifests.where(F.size("faults") == 0).drop("faults")
    refused = materialise(pages.select("document_id").distinct().join(sound.select("document_id"), "document_id", "left_anti"), "refused", small=True)
    replace_rows(f"{path}/pages", page_quality(pages).join(refused, "document_id", "left_anti"), sound, "document_id", buckets)
    replace_rows(f"{path}/documents", sound, sound, "document_id", buckets)
    return manifests


def read_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Stored manifests, and stored pages with their document's role and status."""
    manifests, pages = (spark.read.parquet(f"{path}/{name}").drop("bucket") for name in ("documents", "pages"))
    return manifests, pages.join(manifests.select("document_id", "role", "processing_status"), "document_id")


def quarantined_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages that keep a stored document in quarantine: document_id, page_number, issues, ocr_required."""
    manifests, pages = read_documents(spark, path)
    return pages.where((F.col("processing_status") == QUARANTINED) & ~F.col("accepted")).select("document_id", "page_number", "issues", F.lit(True).alias("ocr_required"))


def write_chunks(path: str, results: DataFrame, chunks: DataFrame, buckets: int = 256) -> None:
    """Stores chunking results (source_id, source_kind, validation_status, quarantine_reasons) and their chunks (source_id, ...), in place of what was stored of these sources."""
    replace_rows(f"{path}/chunks", chunks.join(results.select("source_id"), "source_id", "left_semi"), results, "source_id", buckets)
    replace_rows(f"{path}/results", results, results, "source_id", buckets)


def quarantined_sources(spark: SparkSession, path: str) -> DataFrame:
    """Stored sources whose chunks failed validation: source_id, reasons."""
    return spark.read.parquet(f"{path}/results").where(F.col("validation_status") == QUARANTINED).select("source_id", F.col("quarantine_reasons").alias("reasons"))


def evidence_bundles(messages: DataFrame, documents: DataFrame) -> DataFrame:
    """A bundle for each message: bundle_id, platform, category, mail_only, evidence_kind, cohort_key.

    messages: message_id, platform, category; documents: document_id, message_id, role. Bundles of one cohort are of the same platform, category,
    kind and roles; roles are few, so only their set is gathered. Documents of no message are in no bundle.
    """
    roles = documents.groupBy("message_id").agg(F.array_join(F.array_sort(F.collect_set(F.coalesce("role", F.lit("UNKNOWN")))), "+").alias("roles"))
    both = messages.join(roles, "message_id", "left")
    kind = F.when(F.upper("roles").contains("HISTORY_REPORT"), "history-report").when(F.col("roles").isNull(), "mail-only").otherwise("pdf-backed")
    both = both.withColumns({"mail_only": F.col("roles").isNull(), "evidence_kind": kind})
    return both.select(F.col("message_id").alias("bundle_id"), "platform", "category", "mail_only", "evidence_kind", F.concat_ws(":", F.coalesce("platform", F.lit("")), F.coalesce("category", F.lit("")), "evidence_kind", F.coalesce("roles", F.lit("message"))).alias("cohort_key"))


def bundle_chunks(messages: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks by bundle, as rows: bundle_id, part (0 the message, 1 its documents), source_id, and the chunk's columns.

    A bundle's order is part, source_id, then the chunk's place. chunks: source_id, ...; chunks of no message or document fall out.
    """
    owners = messages.select(F.col("message_id").alias("bundle_id"), F.lit(0).alias("part"), F.col("message_id").alias("source_id"))
    attached = documents.join(messages.select("message_id"), "message_id", "left_semi")
    owners = owners.unionByName(attached.select(F.col("message_id").alias("bundle_id"), F.lit(1).alias("part"), F.col("document_id").alias("source_id")))
    return owners.join(chunks, "source_id").select("bundle_id", "part", *chunks.columns)
