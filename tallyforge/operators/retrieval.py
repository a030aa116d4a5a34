"""Dense and lexical retrieval, rank fusion, reranking, evidence checks and evaluation.

Queries are a DataFrame, so one plan serves them all; a query set is small against the documents.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.session import materialise

RANK_CONSTANT = 60
K1, B = 1.2, 0.75
#: Query vectors up to so many bytes are broadcast against the documents; larger sets are cut into such blocks.
BLOCK_BYTES = 32 << 20
#: Vectors and queries of one matrix product: 8 MB of scores.
VECTORS, QUERIES = 2048, 512
SCORE = "decimal(34,30)"


def ranked(scores: DataFrame, k: int, keys: list[str], candidate: str = "candidate_id") -> DataFrame:
    """The k best of each query: rank 1 for the highest score, ties by candidate. Spark keeps k rows a task and query before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc(candidate))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _matrix(vectors: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first `size` numbers of each vector as a matrix, and which rows have them."""
    lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = vectors.flatten()
    if vectors.null_count == 0 and flat.null_count == 0 and len(lengths) and lengths[0] >= size and (lengths == lengths[0]).all():
        return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lengths), -1)[:, :size], np.ones(len(lengths), bool)
    heads, there = np.zeros((len(vectors), size)), np.zeros(len(vectors), bool)
    for i, v in enumerate(vectors.to_pylist()):
        if v is not None and len(v) >= size and all(x is not None for x in v[:size]):
            heads[i], there[i] = v[:size], True
    return heads, there


def _prefixes(vectors: pa.Array, sizes: tuple[int, ...]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each size the vectors' prefixes brought to length 1, and which rows have one, as `prefix_vector` does; sums run in order of the numbers."""
    scaled, known = [], []
    for size in sizes:
        heads, there = _matrix(vectors, size)
        squares = np.zeros(len(heads))
        for i in range(size):
            squares += heads[:, i] * heads[:, i]
        # NaN counts as a length, as it does in SQL.
        there = there & ~(squares <= 0)
        with np.errstate(invalid="ignore"):
            scaled.append(heads / np.sqrt(np.where(there, squares, 1.0))[:, None])
        known.append(there)
    return scaled, known


def _rounded(scores: np.ndarray) -> np.ndarray:
    """Steps of 1e-6, halves away from zero; near a half the decimal itself decides. NaN is the largest, as it is in SQL."""
    steps = np.abs(scores) * 1e6
    whole = np.floor(steps + 0.5)
    for i in np.flatnonzero(np.abs(steps - np.floor(steps) - 0.5) < 1e-6):
        whole[i] = int(Decimal(repr(abs(float(scores[i])))).scaleb(6).to_integral_value(ROUND_HALF_UP))
    return np.where(np.isnan(scores), np.inf, np.copysign(whole, scores) + 0.0)


class _Nearest:
    """The k best of each query among the vectors seen so far, for one size: steps of 1e-6 and candidates, best first."""

    def __init__(self, queries: int, k: int):
        self.k, self.steps, self.found = k, np.full((queries, k), -np.inf), np.full((queries, k), -1, np.int64)
        self.filled = np.zeros(queries, np.int64)

    def add(self, rows: np.ndarray, ids: np.ndarray, asked: np.ndarray, candidates: np.ndarray, heads: np.ndarray) -> None:
        """Queries (`rows` of all, their ids and vectors) against some vectors. A matrix product names the pairs that may count; these are scored again number by number."""
        rough = asked @ heads.T
        rough[np.isnan(rough)] = np.inf
        rough[ids[:, None] == candidates[None, :]] = -np.inf
        least = self.steps[rows, -1] * 1e-6
        if rough.shape[1] >= self.k:
            least = np.maximum(least, np.partition(rough, -self.k, axis=1)[:, -self.k])
        q, c = np.nonzero((rough >= (least - 2e-6)[:, None]) & (rough > -np.inf))
        scores = np.zeros(len(q))
        for i in range(asked.shape[1]):
            scores += asked[q, i] * heads[c, i]
        kept, place = np.nonzero(np.arange(self.k) < self.filled[rows][:, None])
        at = np.concatenate([kept, q])
        steps = np.concatenate([self.steps[rows[kept], place], _rounded(scores)])
        names = np.concatenate([self.found[rows[kept], place], candidates[c]])
        order = np.lexsort((names, -steps, at))
        at, steps, names = at[order], steps[order], names[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        best = rank < self.k
        self.steps[rows[at[best]], rank[best]], self.found[rows[at[best]], rank[best]] = steps[best], names[best]
        self.filled[rows] = np.minimum(np.bincount(at, minlength=len(rows)), self.k)


def _nearest_of(asked, sizes: tuple[int, ...], k: int):
    """A function over Arrow batches of vectors: each task's k best of each query of a broadcast block."""

    def run(batches):
        ids, queries, known = asked.value
        best = [_Nearest(len(ids), k) for _ in sizes]
        for batch in batches:
            for begin in range(0, batch.num_rows, VECTORS):
                part = batch.slice(begin, VECTORS)
                candidates = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                heads, there = _prefixes(part.column(1), sizes)
                for n in range(len(sizes)):
                    rows, some = np.flatnonzero(known[n]), np.flatnonzero(there[n])
                    for at in range(0, len(rows), QUERIES) if len(some) else ():
                        mine = rows[at : at + QUERIES]
                        best[n].add(mine, ids[mine], queries[n][mine], candidates[some], heads[n][some])
        for size, found in zip(sizes, best):
            q, place = np.nonzero(np.arange(k) < found.filled[:, None])
            for at in range(0, len(q), 1 << 16):
                x, y = q[at : at + (1 << 16)], place[at : at + (1 << 16)]
                steps = found.steps[x, y]
                scores = np.where(np.isinf(steps), np.nan, steps / 1e6)
                yield pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(found.found[x, y]), pa.array(np.full(len(x), size, np.int32)), pa.array(scores, from_pandas=False)], ["query_id", "candidate_id", "size", "score"])

    return run


def dense_by_size(queries: DataFrame, vectors: DataFrame, sizes: tuple[int, ...], k: int) -> DataFrame:
    """Exact cosine top-k for each of several prefix lengths: queries (query_id, embedding) against vectors (candidate_id, embedding); ids are integers.

    Rows are query_id, candidate_id, size, score, rank. The queries are cut into blocks of BLOCK_BYTES, and a block goes to
    every task as matrices against its vectors, some thousand at a time; all sizes are scored in that one pass.
    A task keeps k rows of a query, and Spark ranks what the tasks kept. The work is all pairs by nature; its memory is a
    block's. With more than one block each one's results are written, so the plan stays as small as for one. A query doesn't
    find itself (query_id = candidate_id).
    """
    spark = vectors.sparkSession
    asked = queries.select(F.col("query_id").cast("bigint").alias("query_id"), "embedding").where("query_id is not null")
    blocks = max(1, -(-asked.count() * (8 * sum(sizes) + 32) // BLOCK_BYTES))
    asked = asked if blocks == 1 else materialise(asked, "queries")
    source = vectors.select(F.col("candidate_id").cast("bigint").alias("candidate_id"), "embedding").where("candidate_id is not null")
    # A small table may be one file, and the work is its square: it is dealt to all cores once.
    source = source.repartition(spark.sparkContext.defaultParallelism)
    source = source if blocks == 1 else materialise(source, "vectors")
    found = None
    for block in range(blocks):
        some = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        # At most about BLOCK_BYTES.
        rows = some.toArrow()
        scaled, known = _prefixes(rows.column("embedding").combine_chunks(), sizes)
        shared = spark.sparkContext.broadcast((rows.column("query_id").to_numpy(), scaled, known))
        kept = source.mapInArrow(_nearest_of(shared, sizes, k), "query_id bigint, candidate_id bigint, size int, score double")
        part = ranked(kept, k, ["query_id", "size"])
        part = part if blocks == 1 else materialise(part, "nearest", small=True)
        found = part if found is None else found.unionByName(part)
    return found


def dense_candidates(queries: DataFrame, vectors: DataFrame, size: int, k: int) -> DataFrame:
    """The same by the first `size` numbers alone: query_id, candidate_id, score, rank."""
    return dense_by_size(queries, vectors, (size,), k).drop("size")


def terms(text: Column) -> Column:
    """Runs of letters and digits, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def lexical_candidates(queries: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """BM25 top-k of queries (query_id, text) over documents (candidate_id, text); k1 = 1.2, b = 0.75.

    Only terms that queries use are kept past the scan, and counts of each term and document are
    made before anything shuffles; the corpus' size and mean length are one row. How the queries'
    terms are joined is left to adaptive execution, as they grow with the query set.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    words = documents.select("candidate_id", terms(F.coalesce("text", F.lit(""))).alias("words"))
    sizes = words.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean"))
    used = asked.select("term").distinct()
    hits = words.select("candidate_id", F.size("words").alias("length"), F.explode("words").alias("term")).join(used, "term")
    hits = hits.groupBy("term", "candidate_id", "length").agg(F.count("*").alias("tf"))
    spread = hits.groupBy("term").agg(F.count("*").alias("df"))
    weighed = hits.join(spread, "term").join(F.broadcast(sizes))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    scores = weighed.withColumn("part", part).join(asked, "term").groupBy("query_id", "candidate_id").agg(F.round(F.sum("part"), 6).alias("score"))
    return ranked(scores, k, ["query_id"])


def fuse(channels: DataFrame, k: int, constant: int = RANK_CONSTANT) -> DataFrame:
    """Reciprocal rank fusion of (query_id, channel, candidate_id, rank): score, channels, rank; exact decimals, ties by candidate."""
    part = F.lit("1").cast("decimal(29,28)") / (F.lit(constant) + F.col("rank")).cast("decimal(7,0)")
    scores = channels.groupBy("query_id", "candidate_id").agg(F.sum(part.cast(SCORE)).alias("score"), F.array_sort(F.collect_set("channel")).alias("channels"))
    return ranked(scores, k, ["query_id"])


def repeated_candidates(channels: DataFrame) -> DataFrame:
    """Candidates that a channel names twice for one query."""
    return channels.groupBy("query_id", "channel", "candidate_id").count().where("count > 1")


def rerank(fused: DataFrame, evidence: DataFrame, score: Callable[[Column], Column], k: int) -> DataFrame:
    """The fused candidates that have a text, in the order of `score` (given the text column), ties by fused rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "fused_rank")
    known = fused.withColumnRenamed("rank", "fused_rank").join(evidence.where(F.trim("text") != ""), "candidate_id")
    return known.withColumn("rerank_score", score(F.col("text"))).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def verify(claims: DataFrame, citations: DataFrame) -> DataFrame:
    """Status and reason of each pack: claims (pack_id, claim_id), citations (pack_id, citation_id, claim_ids, quality_flags).

    Conflicting evidence outranks missing claims, and those outrank having no citation at all.
    """
    conflict = citations.groupBy("pack_id").agg(F.count("*").alias("citations"), F.max(F.array_contains("quality_flags", "conflicting")).alias("conflict"))
    covered = citations.select("pack_id", F.explode("claim_ids").alias("claim_id")).distinct().withColumn("covered", F.lit(True))
    found = claims.join(covered, ["pack_id", "claim_id"], "left").groupBy("pack_id").agg(F.count_if(F.col("covered").isNull()).alias("missing"))
    found = found.join(conflict, "pack_id", "left")
    reason = (
        F.when(F.coalesce("conflict", F.lit(False)), "conflicting_evidence").when(F.col("missing") > 0, "incomplete_evidence_coverage").when(F.col("citations").isNull(), "no_evidence")
    )
    return found.select("pack_id", F.when(reason.isNull(), "verified").otherwise("abstained").alias("status"), reason.alias("abstention_reason"), "missing")


def first_relevant(results: DataFrame, relevant: DataFrame, queries: DataFrame) -> DataFrame:
    """The rank of each query's first relevant result; null if there is none."""
    hits = results.join(relevant, ["query_id", "candidate_id"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    return queries.select("query_id").join(hits, "query_id", "left")


def rank_metrics(ranks: DataFrame, keys: list[str]) -> DataFrame:
    """Share of first ranks within 1, 5 and 10, and mean reciprocal rank."""
    hit = lambda n: F.round(F.avg(F.when(F.col("rank") <= n, 1.0).otherwise(0.0)), 6).alias(f"hit_at_{n}")
    return ranks.groupBy(*keys).agg(F.count("*").alias("queries"), hit(1), hit(5), hit(10), F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


def latency_metrics(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Nearest-rank p50 and p95 of measured latencies; nulls don't count.

    Values are cut at approximate percentiles of their key. The pieces' exact counts tell which piece
    holds a rank, and only those pieces' distinct values, a hundredth of a key's or so, are ordered; no key is gathered, and a value that
    many rows share is one row.
    """
    known = runs.where(F.col("latency_ms").isNotNull())
    cuts = known.groupBy(*keys).agg(F.percentile_approx("latency_ms", [i / 100 for i in range(1, 100)], 1_000).alias("cuts"))
    values = known.groupBy(*keys, "latency_ms").agg(F.count("*").alias("times"))
    cut = values.join(cuts, keys).withColumn("piece", F.size(F.filter("cuts", lambda x: x < F.col("latency_ms")))).drop("cuts")
    so_far = Window.partitionBy(*keys).orderBy("piece")
    # At most a hundred pieces a key.
    pieces = cut.groupBy(*keys, "piece").agg(F.sum("times").alias("n")).withColumn("end", F.sum("n").over(so_far)).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    shares = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.ceil(F.lit(share) * F.col("all")).alias("rank")) for name, share in (("p50", 0.5), ("p95", 0.95))]))
    wanted = pieces.select(*keys, "piece", "n", "end", shares.alias("x")).where("x.rank <= end and x.rank > end - n").select(*keys, "piece", "x.name", (F.col("x.rank") - F.col("end") + F.col("n")).alias("place"))
    placed = cut.join(wanted.select(*keys, "piece").distinct(), [*keys, "piece"]).withColumn("at", F.sum("times").over(Window.partitionBy(*keys, "piece").orderBy("latency_ms")))
    found = placed.join(wanted, [*keys, "piece"]).where("place > at - times and place <= at").groupBy(*keys)
    return found.agg(*[F.max(F.when(F.col("name") == name, F.col("latency_ms"))).alias(name) for name in ("p50", "p95")])


def not_inferior(metrics: DataFrame, reference: int) -> DataFrame:
    """Sizes whose hit@10 is within 0.01 and whose mrr is at least 0.98 of the reference size's."""
    base = metrics.where(F.col("size") == reference).select(F.col("hit_at_10").alias("h"), F.col("mrr").alias("m"))
    return metrics.join(F.broadcast(base)).select("size", "hit_at_10", "mrr", ((F.col("hit_at_10") >= F.col("h") - 0.01) & (F.col("mrr") >= 0.98 * F.col("m"))).alias("non_inferior"))


def answer_metrics(outcomes: DataFrame) -> DataFrame:
    """Accuracies over (status_ok, answer_ok, calculation_ok, count_ok, citation_ok, abstention_ok, abstained): one row; abstention counts abstained goldens only, 1 if there are none."""
    rate = lambda name: F.round(F.avg(F.col(name).cast("double")), 6)
    return outcomes.agg(
        F.count("*").alias("cases"),
        *[rate(f"{x}_ok").alias(f"{x}_accuracy") for x in ("status", "answer", "calculation", "count", "citation")],
        F.coalesce(F.round(F.avg(F.when(F.col("abstained"), F.col("abstention_ok").cast("double"))), 6), F.lit(1.0)).alias("abstention_accuracy"),
    )


def stratified_sample(rows: DataFrame, stratum: str, text: str, n: int) -> DataFrame:
    """n rows of each stratum in the order of their texts' SHA-256: the same rows at every run."""
    order = Window.partitionBy(stratum).orderBy(F.sha2(text, 256), text)
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
