"""Readers and writers: typed JSON lines, mailboxes, pages, attachments, digested archives, embeddings."""

from __future__ import annotations

import email
import email.policy
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.operators.archives import write_archive  # noqa: F401
from tallyforge.operators.ingestion import visible_text

MAIL = "path string, place bigint, message_id string, raw_sha256 string, provider_id string, sender string, subject string, sent_at string, body string, is_html boolean, attachments array<struct<name: string, bytes: bigint, is_pdf: boolean, sha256: string>>"


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a strict schema: a line that doesn't parse fails the read; nothing is inferred."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_manifests(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One row for each JSON file (which may span lines), with its path."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("path", F.col("_metadata.file_path"))


def _parts(raw: bytes) -> dict:
    import hashlib

    message = email.message_from_bytes(raw, policy=email.policy.default)
    body, is_html, files = "", False, []
    for part in message.walk():
        if part.is_multipart():
            continue
        payload = part.get_payload(decode=True) or b""
        name = part.get_filename()
        if name or payload.startswith(b"%PDF-"):
            files.append({"name": name, "bytes": len(payload), "is_pdf": payload.startswith(b"%PDF-"), "sha256": hashlib.sha256(payload).hexdigest()})
        elif part.get_content_maintype() == "text" and not body:
            text = payload.decode(part.get_content_charset() or "utf-8", "replace") if _known(part.get_content_charset()) else payload.decode("utf-8", "replace")
            body, is_html = text, part.get_content_subtype() == "html"
    return {
        "message_id": "msg_" + (digest := hashlib.sha256(raw).hexdigest())[:16],
        "raw_sha256": digest,
        "provider_id": str(message.get("message-id", "") or ""),
        "sender": str(message.get("from", "")),
        "subject": str(message.get("subject", "")),
        "sent_at": str(message.get("date", "")),
        "body": body,
        "is_html": is_html,
        "attachments": files,
    }


def _known(charset: str | None) -> bool:
    import codecs

    try:
        return charset is None or codecs.lookup(charset) is not None
    except LookupError:
        return False


def read_mailboxes(spark: SparkSession, path: str) -> DataFrame:
    """The messages of mbox files, equal ones once."""
    return read_messages(spark, path).dropDuplicates(["message_id"])


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """One row for each message of mbox files: Spark splits the files at "From " lines.

    Messages are read as records, so a mailbox of any size is never in memory whole. A record's bytes
    are handed on as they are in the file: each part is decoded by its own character set. The body is
    the first text part, a page's as what a reader sees of it.
    """
    lines = spark.read.option("lineSep", "\nFrom ").text(path).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("place"), F.col("value").cast("binary").alias("value"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, at, value in zip(batch.path, batch.place, batch.value, strict=True):
                _, _, raw = value.partition(b"\n")
                if raw.strip():
                    rows.append({"path": p, "place": at, **_parts(raw)})
            yield pd.DataFrame(rows, columns=["path", "place", "message_id", "raw_sha256", "provider_id", "sender", "subject", "sent_at", "body", "is_html", "attachments"])

    mails = lines.mapInPandas(work, MAIL)
    return mails.withColumn("body", F.when(F.col("is_html"), visible_text(F.col("body"))).otherwise(F.col("body"))).drop("is_html")


def attachment_faults(files: DataFrame, declared: DataFrame) -> DataFrame:
    """Declared attachments (path, bytes, sha256) that the binary files don't bear out: path, fault."""
    read = files.select("path", F.col("length").alias("actual"), F.sha2("content", 256).alias("digest"), F.substring("content", 1, 5).alias("head"))
    both = declared.join(read, "path", "left")
    fault = (
        F.when(F.col("path").contains(".."), "outside_bundle")
        .when(F.col("actual").isNull(), "missing")
        .when(F.col("actual") != F.col("bytes"), "size_differs")
        .when(F.col("digest") != F.col("sha256"), "digest_differs")
        .when(F.col("head") != F.encode(F.lit("%PDF-"), "UTF-8"), "not_a_pdf")
    )
    return both.withColumn("fault", fault).where("fault is not null").select("path", "fault")


def embedding_faults(vectors: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """Vectors that break their contract and inputs without one: candidate_id, fault."""
    bad = F.when(F.size("embedding") != size, "wrong_size").when(F.exists("embedding", lambda x: x.isNull() | F.isnan(x)), "not_a_number")
    wrong = vectors.withColumn("fault", bad).where("fault is not null").select("candidate_id", "fault")
    twice = vectors.groupBy("candidate_id").count().where("count > 1").select("candidate_id", F.lit("repeated").alias("fault"))
    missing = wanted.select("candidate_id").join(vectors.select("candidate_id"), "candidate_id", "left_anti").withColumn("fault", F.lit("missing"))
    return wrong.unionByName(twice).unionByName(missing)


def write_vectors(vectors: DataFrame, path: str, sizes: tuple[int, ...]) -> None:
    """Normalised prefixes of each size, one folder for each, so a search reads only the size it needs."""
    from tallyforge.functions.expressions import prefix_vector

    parts = None
    for size in sizes:
        part = vectors.select("candidate_id", F.lit(size).alias("size"), prefix_vector(F.col("embedding"), size).alias("embedding")).where("embedding is not null")
        parts = part if parts is None else parts.unionByName(part)
    parts.write.mode("overwrite").partitionBy("size").parquet(path)
