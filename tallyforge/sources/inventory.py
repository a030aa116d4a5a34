"""The inventory of a mail collection: acquisition bundles and mailboxes become messages, documents and evidence of orders.

A collection has `swiggy/<bundle>/` and `zomato/<bundle>/` folders with manifest.json, and maybe email.eml, body.html and attachments, and mailboxes
below `*/Takeout/Mail/`. Files are read by Spark's binary reader, so any store that Spark reads will do; their bytes become digests and texts where
they are read, and only those move. Everything else is joins by bundle and path and aggregations by content id. What a document's pages say comes
from outside, as `texts` (sha256, text, pages).

An attachment that its manifest doesn't bear out sets its whole bundle aside: it is in `faults`, and no message is made of it.
"""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import ingestion, resolution
from tallyforge.session import materialise
from tallyforge.sources.files import read_messages

#: The folders of bundles, and the names of a bundle's own files.
PLATFORMS = ("swiggy", "zomato")
MANIFEST_FILE, MAIL_FILE, BODY_FILE = "manifest.json", "email.eml", "body.html"
#: A manifest's keys.
MANIFEST = """struct<vendor: string, category: string, orderId: string, email: struct<`from`: string, subject: string, internalDate: string, messageIdHeader: string>,
attachments: array<struct<path: string, filename: string, mimeType: string, bytes: bigint, sha256: string, validPdfSignature: boolean>>>"""
#: How sure an order id is by where it was found.
CONFIDENCE = {"PDF_LABEL": "1.00", "EMAIL_FIELD": "0.95", "HISTORY_ROW": "1.00", "MANIFEST_HINT": "0.50"}
HISTORY_ROLE = "swiggy_order_history_report"
CANDIDATES = "array<struct<value: string, source: string, confidence: decimal(3,2)>>"


@dataclass(frozen=True)
class Inventory:
    """messages, documents and evidence, each once by its id; faults (locator, fault) of bundles set aside; excluded (rows of messages of no known platform)."""

    messages: DataFrame
    documents: DataFrame
    evidence: DataFrame
    faults: DataFrame
    excluded: DataFrame
    repeated_documents: DataFrame

    def summary(self) -> DataFrame:
        """One row: messages, excluded, documents, pages, repeated documents, history reports, messages with documents and without, and the orders they tell of."""
        one = lambda frame, **columns: frame.agg(*[x.alias(n) for n, x in columns.items()])
        kind = lambda name: F.countDistinct(F.when(F.col("kind") == name, F.col("message_id")))
        parts = [
            one(self.messages, relevant_messages=F.count("*")),
            one(self.excluded, excluded_messages=F.count("*")),
            one(self.documents, unique_documents=F.count("*"), pages=F.coalesce(F.sum("pages"), F.lit(0)), history_reports=F.count_if(F.col("role") == HISTORY_ROLE)),
            one(self.repeated_documents, repeated_documents=F.coalesce(F.sum("times"), F.lit(0))),
            one(self.evidence, with_documents=kind("PDF_BUNDLE"), mail_only=kind("EMAIL_ONLY")),
            resolution.order_counts(self.evidence.withColumn("kind", F.lower("kind"))),
        ]
        found = parts[0]
        for part in parts[1:]:
            found = found.join(F.broadcast(part))  # one row each
        return found


def _found(spark: SparkSession, pattern: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def _candidates(values: Column, source: str) -> Column:
    return F.transform(values, lambda x: F.struct(x.alias("value"), F.lit(source).alias("source"), F.lit(CONFIDENCE[source]).cast("decimal(3,2)").alias("confidence"))).cast(CANDIDATES)


def _category(instamart: Column) -> Column:
    return F.when(instamart, "instamart").otherwise("food")


def _document_id(sha: Column) -> Column:
    return F.concat(F.lit("doc_"), F.left(sha, F.lit(16)))


NO_FILES = "array<struct<place: int, name: string, locator: string, mime: string, bytes: bigint, sha256: string>>"


def read_bundles(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Messages of the acquisition bundles with their declared files, and (locator, fault) of bundles set aside.

    Messages: message_id, raw_sha256, platform, category, occurred, subject, sender, locator, provider_id, body_sha256, body, hint, files.
    """
    tail = urlparse(root).path.rstrip("/") or root.rstrip("/")
    paths = [f"{root}/{name}" for name in PLATFORMS if _found(spark, f"{root}/{name}/*/{MANIFEST_FILE}")]
    empty = spark.createDataFrame([], "message_id string, raw_sha256 string, platform string, category string, occurred string, subject string, sender string, locator string, provider_id string, body_sha256 string, body string, hint string, files " + NO_FILES)
    if not paths:
        return empty, spark.createDataFrame([], "locator string, fault string")
    relative = F.expr(f"substring(path, instr(path, '{tail}/') + {len(tail) + 1})")
    own = F.col("name").isin(MANIFEST_FILE, BODY_FILE)
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).withColumn("relative", relative)
        .withColumn("bundle", F.substring_index("relative", "/", 2)).withColumn("name", F.expr("substring(relative, length(bundle) + 2)"))
        .select("bundle", "name", "path", "length", F.sha2("content", 256).alias("sha256"), (F.substring("content", 1, 5) == F.encode(F.lit("%PDF-"), "UTF-8")).alias("is_pdf"),
                F.when(own, F.make_valid_utf8(F.col("content").cast("string"))).alias("text"))
    )
    files = materialise(files, "files")
    manifests = files.where(F.col("name") == MANIFEST_FILE).select("bundle", F.col("path").alias("manifest"), F.col("sha256").alias("manifest_sha"), F.from_json(F.when(F.col("name") == MANIFEST_FILE, F.col("text")), MANIFEST, {"mode": "FAILFAST"}).alias("m"))
    named = lambda name, *columns: files.where(F.col("name") == name).select("bundle", *columns)
    mails = named(MAIL_FILE, F.col("path").alias("mail"), F.col("sha256").alias("mail_sha"))
    bodies = named(BODY_FILE, F.col("sha256").alias("body_sha256"), F.col("text").alias("page"))
    declared = manifests.select("bundle", "manifest", F.posexplode("m.attachments").alias("place", "a"))
    # A path is taken as it is; one that leaves its bundle has no file there.
    got = files.select("bundle", F.col("name").alias("inside"), F.col("path").alias("locator"), "length", F.col("sha256").alias("actual"), "is_pdf")
    both = declared.withColumn("inside", F.regexp_replace("a.path", r"^(\./)+", "")).join(got, ["bundle", "inside"], "left")
    fault = (
        F.when(F.col("inside").rlike(r"(^|/)\.\.(/|$)|^/"), "outside_bundle")
        .when(F.col("locator").isNull(), "missing")
        .when(~F.col("length").eqNullSafe(F.col("a.bytes")), "size_differs")
        .when(~F.col("actual").eqNullSafe(F.col("a.sha256")), "digest_differs")
        .when(~F.col("is_pdf") | ~F.coalesce(F.col("a.validPdfSignature"), F.lit(False)), "not_a_pdf")
    )
    checked = both.withColumn("fault", fault)
    faults = checked.where("fault is not null").groupBy("bundle").agg(F.min_by(F.struct(F.col("manifest").alias("locator"), "fault"), "place").alias("x"))
    file = F.struct("place", F.coalesce("a.filename", F.lit("")).alias("name"), "locator", F.coalesce("a.mimeType", F.lit("application/pdf")).alias("mime"), F.col("length").alias("bytes"), F.col("actual").alias("sha256"))
    attached = checked.where("fault is null").groupBy("bundle").agg(F.array_sort(F.collect_list(file)).cast(NO_FILES).alias("files"))
    sound = manifests.join(faults.select("bundle"), "bundle", "left_anti").join(mails, "bundle", "left").join(bodies, "bundle", "left").join(attached, "bundle", "left")
    raw = F.coalesce("mail_sha", "manifest_sha")
    text = lambda name: F.coalesce(f"m.email.{name}", F.lit(""))
    messages = sound.select(
        F.concat(F.lit("msg_"), F.left(raw, F.lit(16))).alias("message_id"), raw.alias("raw_sha256"), F.lower("m.vendor").alias("platform"), _category(F.lower(F.coalesce("m.category", F.lit(""))) == "instamart").alias("category"),
        F.col("m.email.internalDate").alias("occurred"), text("subject").alias("subject"), text("from").alias("sender"), F.coalesce("mail", "manifest").alias("locator"), F.nullif("m.email.messageIdHeader", F.lit("")).alias("provider_id"),
        F.coalesce("body_sha256", F.sha2(F.lit(""), 256)).alias("body_sha256"), ingestion.visible_text(F.coalesce("page", F.lit(""))).alias("body"), F.when(F.col("m.orderId").rlike(r"\A\d+\z"), F.col("m.orderId")).alias("hint"),
        F.coalesce("files", F.array().cast(NO_FILES)).alias("files"),
    )
    return messages, faults.select("x.*")


def read_mail(spark: SparkSession, pattern: str) -> tuple[DataFrame, DataFrame]:
    """Messages of mailboxes in the same columns, and the messages of no known platform (locator), which are left out."""
    found = read_messages(spark, pattern).withColumn("platform", ingestion.platform(F.col("sender"), F.col("subject"))).withColumn("locator", F.concat_ws("#message-", "path", "place"))
    found = materialise(found, "mail")
    files = F.transform(
        F.filter("attachments", lambda x: x["is_pdf"] | F.lower(x["name"]).endswith(".pdf")),
        lambda x, i: F.struct(i.alias("place"), F.when(F.coalesce(x["name"], F.lit("")) == "", "attachment.pdf").otherwise(x["name"]).alias("name"), F.concat(F.col("locator"), F.lit(":attachment-"), i.cast("string")).alias("locator"), F.lit("application/pdf").alias("mime"), x["bytes"].alias("bytes"), x["sha256"].alias("sha256")),
    )
    named = F.lower(F.concat_ws(" ", "sender", "subject")).contains("instamart")
    messages = found.where("platform is not null").select(
        "message_id", "raw_sha256", "platform", _category(named).alias("category"), F.nullif("sent_at", F.lit("")).alias("occurred"), "subject", "sender", "locator", F.nullif("provider_id", F.lit("")).alias("provider_id"),
        F.sha2(F.col("body").cast("binary"), 256).alias("body_sha256"), "body", F.lit(None).cast("string").alias("hint"), files.cast(NO_FILES).alias("files"),
    )
    return messages, found.where("platform is null").select("locator")


def build_inventory(spark: SparkSession, root: str, texts: DataFrame | None = None) -> Inventory:
    """The inventory of a collection; of equal messages the first counts (bundles before mailboxes, then by locator), of equal documents that of the first message.

    `texts`: sha256, text, pages of documents, as far as they are known. Two messages are equal if their bytes are; a collection without any of
    the folders gives empty tables.
    """
    root = root.rstrip("/")
    bundles, faults = read_bundles(spark, root)
    messages = bundles.withColumn("first", F.lit(0))
    pattern, excluded = f"{root}/*/Takeout/Mail/*.mbox", spark.createDataFrame([], "locator string")
    if _found(spark, pattern):
        mail, excluded = read_mail(spark, pattern)
        messages = messages.unionByName(mail.withColumn("first", F.lit(1)))
    everything = F.struct(*[c for c in messages.columns if c != "message_id"])
    messages = materialise(messages.groupBy("message_id").agg(F.min_by(everything, F.struct("first", "locator")).alias("x")).select("message_id", "x.*"), "messages")
    texts = spark.createDataFrame([], "sha256 string, text string, pages int") if texts is None else texts.select("sha256", "text", "pages").dropDuplicates(["sha256"])
    held = messages.select("message_id", "platform", "category", "first", F.col("locator").alias("message_locator"), F.explode("files").alias("f"))
    held = held.select("message_id", "platform", "category", "first", "message_locator", "f.*").join(texts, "sha256", "left").withColumn("text", F.coalesce("text", F.lit("")))
    held = held.withColumns({
        "role": ingestion.document_role(F.col("platform"), F.col("category"), F.col("name"), F.col("text")),
        "order_candidates": _candidates(ingestion.order_ids(F.col("platform"), F.col("text")), "PDF_LABEL"),
        "history": ingestion.history_ids(F.col("text")), "has_text": F.trim("text") != "",
    }).drop("text").withColumn("history", F.when(F.col("role") == HISTORY_ROLE, F.col("history")).otherwise(F.array().cast("array<string>")))
    held = materialise(held, "documents")
    document = F.struct("message_id", "platform", "category", "role", F.col("name").alias("filename"), "locator", F.col("mime").alias("mime_type"), F.col("bytes").alias("byte_count"), "pages", "has_text", "order_candidates")
    grouped = held.groupBy("sha256").agg(F.min_by(document, F.struct("first", "message_locator", "place")).alias("d"), (F.count("*") - 1).alias("times"))
    documents = grouped.select(_document_id(F.col("sha256")).alias("document_id"), "sha256", "d.*")
    # A message has few documents; their ids and order ids are gathered by it.
    by_message = held.groupBy("message_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "sha256"))), lambda x: _document_id(x["sha256"])).alias("document_ids"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", F.transform("order_candidates", lambda x: x["value"]).alias("ids")))), lambda x: x["ids"])).alias("document_orders"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("history")))).alias("history"),
    )
    none = F.array().cast("array<string>")
    whole = messages.join(by_message, "message_id", "left").withColumns({c: F.coalesce(c, none) for c in ("document_ids", "document_orders", "history")})
    # A mailbox's subject is searched with the body, a bundle's isn't.
    mailed = ingestion.order_ids(F.col("platform"), F.when(F.col("first") == 1, F.concat_ws(" ", "subject", "body")).otherwise(F.col("body")))
    hint = F.when(F.col("hint").isNotNull(), F.array("hint")).otherwise(none)
    whole = whole.withColumn("mail_orders", mailed).withColumn("order_candidates", F.concat(_candidates(F.col("mail_orders"), "EMAIL_FIELD"), _candidates(F.col("document_orders"), "PDF_LABEL"), _candidates(hint, "MANIFEST_HINT")))
    strong = F.array_distinct(F.concat("mail_orders", "document_orders"))
    kind = F.when(F.size("history") > 0, "HISTORY_ROW").when(F.size("document_ids") > 0, "PDF_BUNDLE").otherwise("EMAIL_ONLY")
    orders = F.when(kind == "HISTORY_ROW", F.col("history")).otherwise(F.array(F.when(F.size(strong) == 1, F.get(strong, F.lit(0)))))
    evidence = whole.select("message_id", "platform", kind.alias("kind"), F.explode(orders).alias("order_id"))
    identity = F.concat_ws("|", "message_id", "kind", F.coalesce("order_id", F.lit("provisional")))
    evidence = evidence.select(F.concat(F.lit("ev_"), F.left(F.sha2(identity, 256), F.lit(16))).alias("evidence_id"), "message_id", "platform", "kind", "order_id")
    shown = ("message_id", "raw_sha256", "platform", "category", "occurred", "subject", "sender", "locator", "provider_id", "body_sha256", "body", "document_ids", "order_candidates")
    return Inventory(whole.select(*shown), documents, evidence, faults, excluded, grouped.select("times"))
