"""Registered queries over vectors and documents: dense, lexical and fused retrieval with its measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.expressions import prefix_vector
from tallyforge.operators import retrieval
from tallyforge.plans.catalog import query
from tallyforge.session import table

SIZES = (8, 16, 32, 64)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("candidate_id"), "embedding", "label")


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 20."""
    return _vectors(spark, sf_dir).where("candidate_id % 20 = 0").withColumnRenamed("candidate_id", "query_id")


def _dense_sql(size: int, k: int) -> str:
    return f"""v AS (SELECT vec_id, label, list_transform(embedding[1:{size}], lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
    n AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS len FROM v),
    u AS (SELECT vec_id, label, list_transform(e, lambda x: x / len) AS e FROM n WHERE len > 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id AS candidate_id, round(list_dot_product(q.e, c.e), 6) AS score FROM u q JOIN u c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id) AS rank FROM s),
    top AS (SELECT * FROM r WHERE rank <= {k})"""


def dense(spark: SparkSession, sf_dir: str, size: int, k: int = 10) -> DataFrame:
    return retrieval.dense_candidates(_queries(spark, sf_dir), _vectors(spark, sf_dir), size, k).select("query_id", "candidate_id", "score", F.col("rank").cast("bigint").alias("rank"))


for _size in SIZES:
    query("dense_topk" if _size == 64 else f"mrl_topk_{_size}", f"WITH {_dense_sql(_size, 10)} SELECT query_id, candidate_id, score, rank FROM top")(
        lambda spark, sf_dir, size=_size: dense(spark, sf_dir, size)
    )


def _measures_sql(size: int) -> str:
    return f"""SELECT {size} AS size, count(*) AS queries, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_5,
    round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_10, round(avg(coalesce(1.0 / rank, 0.0)), 6) AS mrr FROM (
      WITH {_dense_sql(size, 10)}
      SELECT q.vec_id, min(top.rank) FILTER (c.label = q.label) AS rank FROM embeddings q LEFT JOIN top ON top.query_id = q.vec_id LEFT JOIN embeddings c ON c.vec_id = top.candidate_id
      WHERE q.vec_id % 20 = 0 GROUP BY q.vec_id)"""


@query(
    "mrl_metrics",
    "WITH m AS ("
    + " UNION ALL ".join(f"({_measures_sql(x)})" for x in SIZES)
    + "), b AS (SELECT hit_at_10 AS h, mrr AS r FROM m WHERE size = 64) SELECT size, hit_at_10, mrr, hit_at_10 >= h - 0.01 AND mrr >= 0.98 * r AS non_inferior FROM m, b",
)
def mrl_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevant: equal label. Each size against the full one."""
    queries, vectors = _queries(spark, sf_dir), _vectors(spark, sf_dir)
    relevant = queries.select("query_id", "label")
    hits = retrieval.dense_by_size(queries, vectors, SIZES, 10).join(vectors.select("candidate_id", "label"), "candidate_id").join(relevant, ["query_id", "label"])
    ranks = queries.select("query_id", F.explode(F.array(*[F.lit(x) for x in SIZES])).alias("size")).join(hits.groupBy("query_id", "size").agg(F.min("rank").alias("rank")), ["query_id", "size"], "left")
    return retrieval.not_inferior(retrieval.rank_metrics(ranks, ["size"]), 64)


@query(
    "mrl_prefix_norms",
    "WITH v AS (SELECT vec_id, list_transform(embedding[1:16], lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS l FROM v)"
    " SELECT vec_id, round(e[1] / l, 6) AS first, len(e) AS size FROM n WHERE l > 0",
)
def mrl_prefix_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _vectors(spark, sf_dir).select(F.col("candidate_id").alias("vec_id"), prefix_vector(F.col("embedding"), 16).alias("v")).where("v is not null")
    return found.select("vec_id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.size("v").cast("bigint").alias("size"))


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: passages whose id is divisible by 20."""
    return table(spark, sf_dir, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "text")


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("candidate_id"), "text")


BM25 = r"""
w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS words FROM documents),
c AS (SELECT count(*) AS n, avg(len(words)) AS mean FROM w),
q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS term FROM benchmark WHERE item_id % 20 = 0),
x AS (SELECT doc_id, len(words) AS l, unnest(words) AS term FROM w),
tf AS (SELECT doc_id, l, term, count(*) AS tf FROM x WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT query_id, doc_id AS candidate_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))), 6) AS score
      FROM q JOIN tf USING (term) JOIN df USING (term), c GROUP BY ALL),
lexical AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id) AS rank FROM s) WHERE rank <= 10)
"""


@query("bm25_topk", f"WITH {BM25} SELECT query_id, candidate_id, rank FROM lexical")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.lexical_candidates(_passages(spark, sf_dir), _corpus(spark, sf_dir), 10)
    return found.select("query_id", "candidate_id", F.col("rank").cast("bigint").alias("rank"))


@query(
    "rrf_fused",
    f"""WITH {_dense_sql(64, 30)},
    e AS ({_dense_sql(16, 30).replace("v AS", "WITH v AS", 1)} SELECT * FROM top),
    f AS (SELECT query_id, candidate_id, sum(1.0::DOUBLE / (60 + rank)) AS score, count(*) AS channels FROM (SELECT query_id, candidate_id, rank FROM top UNION ALL SELECT query_id, candidate_id, rank FROM e) GROUP BY ALL),
    g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, candidate_id) AS rank FROM f)
    SELECT query_id, candidate_id, channels, rank FROM g WHERE rank <= 10""",
)
def rrf_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full vectors and their short prefixes as two channels."""
    channels = dense(spark, sf_dir, 64, 30).withColumn("channel", F.lit("full")).unionByName(dense(spark, sf_dir, 16, 30).withColumn("channel", F.lit("prefix")))
    return retrieval.fuse(channels, 10).select("query_id", "candidate_id", F.size("channels").cast("bigint").alias("channels"), F.col("rank").cast("bigint").alias("rank"))


@query(
    "hybrid_verified",
    f"""WITH {BM25},
    e AS (SELECT query_id, candidate_id, rank FROM lexical JOIN documents ON doc_id = candidate_id WHERE trim(text) <> '')
    SELECT item_id AS query_id, CASE WHEN count(e.candidate_id) > 0 THEN 'verified_degraded' ELSE 'abstained' END AS status, count(e.candidate_id) AS citations
    FROM benchmark LEFT JOIN e ON e.query_id = item_id WHERE item_id % 20 = 0 GROUP BY item_id""",
)
def hybrid_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages have no vectors, so the dense channel is out and a supported answer is `verified_degraded`."""
    queries, corpus = _passages(spark, sf_dir), _corpus(spark, sf_dir)
    channel = retrieval.lexical_candidates(queries, corpus, 10).select("query_id", "candidate_id", "rank", F.lit("lexical").alias("channel"))
    top = retrieval.rerank(retrieval.fuse(channel, 60), corpus, lambda text: F.lit(0), 10)
    claims = queries.select(F.col("query_id").alias("pack_id"), F.concat(F.lit("claim:"), "query_id").alias("claim_id"))
    cited = top.select(F.col("query_id").alias("pack_id"), F.col("candidate_id").alias("citation_id"), F.array(F.concat(F.lit("claim:"), "query_id")).alias("claim_ids"), F.array().cast("array<string>").alias("quality_flags"))
    found = retrieval.verify(claims, cited)
    counts = cited.groupBy("pack_id").agg(F.count("*").alias("citations"))
    status = F.when(F.col("status") == "verified", "verified_degraded").otherwise("abstained")
    return found.join(counts, "pack_id", "left").select(F.col("pack_id").alias("query_id"), status.alias("status"), F.coalesce("citations", F.lit(0)).alias("citations"))


@query(
    "stratified_query_sample",
    """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(text), text, doc_id) AS place FROM documents)
    SELECT lang, count(*) AS sampled, min(place) AS first_place, max(place) AS last_place FROM r WHERE place <= 20 GROUP BY lang""",
)
def stratified_query_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: 20 documents of each language, always the same."""
    found = retrieval.stratified_sample(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "lang", "text", 20)
    return found.groupBy("lang").agg(F.count("*").alias("sampled"), F.min("place").cast("bigint").alias("first_place"), F.max("place").cast("bigint").alias("last_place"))
