"""The corpus pipeline: quality filter, exact dedup, near-duplicate removal, PII redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's docs. All but the last return the columns of `documents`, whatever
others the table has beside id and text. An empty table gives an empty result in every stage; very long
texts are taken whole, each by the task that reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import exact_dedup, ngram_join, packing, pii, quality
from tallyforge.session import materialise, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects (score below the threshold).

    Null and empty texts are scored by the model's bias alone; repeated rows fare alike; a score equal to
    the threshold is kept. Without labels nothing is learned, every score is 0.5 and all documents go.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.scorer(docs, model) >= quality.THRESHOLD)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least id of each group of equal texts.

    Null texts equal empty ones. Of rows with the same id and text one stays; a null id loses against others.
    """
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least id of each group of near-duplicates.

    Null and empty texts have no shingles, link with nothing and stay, as do rows without an id. Rows of one id share its fate.
    """
    return ngram_join.drop_near_copies(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind's mark and counts the characters anew.

    Null texts stay null, with a null count. Rows are redacted one by one, repeated ones alike.
    """
    return docs.withColumn("text", pii.redacted()).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts into sequences of up to 2048 tokens.

    Null and empty texts are their end id alone. Repeated rows are packed as separate documents.
    """
    import public_tokenizers

    return packing.piece_digests(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("redaction", redact_personal_data),
    ("packing", pack_sequences),
]

#: Classifier, shingle sets and tokens can't be stated in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`, each one's rows written before the next one reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
