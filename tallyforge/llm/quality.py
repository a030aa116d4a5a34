"""Quality classifier: naive Bayes support vectors.

Indicators of unigrams, bigrams and trigrams of words and of word shapes are hashed to 2**BITS
columns; a chunk of over LONG characters without white space also has indicators of the
overlapping windows that cover it. Each is scaled by its class log-count ratio, rows are
brought to unit length, and a linear hinge-loss model is fitted by dual coordinate descent. Decision
values of held-out halves of the training rows calibrate the score (Platt's method).

Training reads a sample of at most about `max_labelled` labelled rows, chosen by a hash of the id
(a documented bound: it keeps the fit on the driver small at any size); scoring reads every row.
A document's labels are averaged and count as 1 from 0.5 on; rows with null labels are left out.
Without rows of both classes the score is the labelled rows' share of class 1 (0.5 without any).
Null and empty texts have the bias feature only. Repeated rows get equal scores; an empty table gives
an empty result; a very long text is read whole by the task that has it. Of documents only id and text
are read, of labels id and quality, so other columns' names don't matter.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.batches import give_back, id_and_text, map_batches, pieces, texts
from tallyforge.session import table

BITS = 20
MAX_LABELLED = 12_000
THRESHOLD = 0.7
#: Chunks whose hashes are kept at a time.
KEPT = 200_000
#: Characters of a chunk that windows of WINDOW characters, STEP apart, don't have to cover.
LONG, WINDOW, STEP = 64, 16, 8
_LOWER, _UPPER, _DIGIT = re.compile(r"[^\W\d_A-Z]+"), re.compile(r"[A-Z]+"), re.compile(r"\d+")
_PRIME, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


def _crc(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def _grams(codes: np.ndarray, kind: int) -> list[np.ndarray]:
    """Hashes of the runs of one, two and three codes."""
    out = []
    for size in (1, 2, 3):
        found = np.full(max(0, len(codes) - size + 1), 4 * kind + size, dtype=np.uint64)
        for k in range(size):
            found = (found ^ codes[k : len(codes) - size + 1 + k]) * _PRIME if len(found) else found
            found ^= found >> _TURN
        out.append(found)
    return out


class Extractor:
    """Hashed indicator columns of texts; column 0 is the bias."""

    def __init__(self, bits: int = BITS):
        self.mask = np.uint64((1 << bits) - 1)
        self.words: dict[str, tuple[int, int]] = {}

    def _word(self, chunk: str) -> tuple[int, int]:
        """Hashes of a chunk and of its shape."""
        found = _crc(chunk), _crc(_DIGIT.sub("9", _UPPER.sub("A", _LOWER.sub("a", chunk))))
        if len(chunk) <= LONG:
            self.words[chunk] = found
        return found

    def columns(self, text: str) -> np.ndarray:
        """Sorted distinct columns of a text."""
        if len(self.words) > KEPT:
            self.words.clear()
        get, make, chunks = self.words.get, self._word, text.split()
        codes = np.array([get(x) or make(x) for x in chunks], dtype=np.uint64).reshape(-1, 2)
        windows = [_crc(x[i : i + WINDOW]) for x in chunks if len(x) > LONG for i in range(0, len(x), STEP)]
        found = np.concatenate([*_grams(codes[:, 0], 1), *_grams(codes[:, 1], 2), *_grams(np.array(windows, dtype=np.uint64), 3)[:1]])
        columns = np.unique((found >> np.uint64(20)) & self.mask).astype(np.int32)
        return np.concatenate([np.zeros(1, dtype=np.int32), columns[columns > 0]])


@dataclass(frozen=True)
class Model:
    """score = 1 / (1 + exp(slope * decision + offset)); decision = sum of weights over columns / length of the scaled row."""

    weights: np.ndarray
    ratios: np.ndarray
    slope: float
    offset: float

    def decision(self, columns: np.ndarray) -> float:
        r = self.ratios[columns]
        return float((self.weights[columns] * r).sum() / np.sqrt((r * r).sum()))

    def score(self, columns: np.ndarray) -> float:
        return float(1 / (1 + np.exp(np.clip(self.slope * self.decision(columns) + self.offset, -500, 500))))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, size: int, smooth: float = 1.0) -> np.ndarray:
    """Naive Bayes log-count ratio of each column; 1 for the bias."""
    counts = np.full((2, size), smooth)
    for row, y in zip(rows, labels, strict=True):
        counts[y][row] += 1
    r = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    r[0] = 1.0
    return r


class Scaled:
    """Rows' values: the ratios of their columns, brought to unit length; made when asked for, as they take more room than the columns."""

    def __init__(self, rows: list[np.ndarray], ratios: np.ndarray):
        self.rows, self.ratios = rows, ratios
        self.lengths = [float(np.sqrt((ratios[x] ** 2).sum())) for x in rows]

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ratios[self.rows[i]] / self.lengths[i]


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray] | Scaled, labels: np.ndarray, size: int, cost: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Weights of an L2-regularised hinge-loss model; rows have unit length."""
    w, alpha, sign = np.zeros(size), np.zeros(len(rows)), np.where(labels > 0, 1.0, -1.0)
    order = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(rows)):
            x, at = values[i], rows[i]
            gradient = sign[i] * float(w[at] @ x) - 1.0
            new = min(max(alpha[i] - gradient, 0.0), cost)
            if (step := new - alpha[i]) != 0.0:
                w[at] += step * sign[i] * x
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


def _platt(decisions: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through decision values, by Newton's method."""
    n1, n0 = labels.sum(), (1 - labels).sum()
    target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([-decisions, -np.ones_like(decisions)], axis=1)
    b = np.array([1.0, np.log((n1 + 1) / (n0 + 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(np.clip(x @ b, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (target - p))
        b = b - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(-b[0]), float(-b[1])


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS) -> Model:
    """The whole model from hashed columns and 0/1 labels."""
    size = 1 << bits
    share = float(labels.mean()) if len(labels) else 0.5
    if len(set(labels.tolist())) < 2:
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(size), np.ones(size), 0.0, float(np.log((1 - share) / share)))

    def train(some):
        mine, y = [rows[i] for i in some], labels[some]
        r = log_count_ratios(mine, y, size)
        return dual_coordinate_descent(mine, Scaled(mine, r), y, size), r

    decisions, half = np.zeros(len(rows)), np.arange(len(rows)) % 2
    for k in (0, 1):
        w, r = train(np.flatnonzero(half != k))
        part = Model(w, r, -1.0, 0.0)
        for i in np.flatnonzero(half == k):
            decisions[i] = part.decision(rows[i])
    slope, offset = _platt(decisions, labels)
    w, r = train(np.arange(len(rows)))
    return Model(w, r, slope, offset)


def held_out(id_col: Column) -> Column:
    """Whether a document is kept from training; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def sample_labels(labels: DataFrame, max_labelled: int) -> DataFrame:
    """(doc_id, quality) of about `max_labelled` training documents at most, by a hash of the id."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    share = max_labelled / max(1, rows.count())
    if share >= 1:
        return rows
    return rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, max_labelled: int = MAX_LABELLED) -> Model:
    """Fits the model; `labels` has doc_id and quality."""
    chosen = sample_labels(labels.select(F.col("doc_id"), F.col("quality").cast("double").alias("quality")), max_labelled)
    frame = id_and_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        extract = Extractor(bits)
        for batch in pieces(batches, "text"):
            yield {"doc_id": batch.column("doc_id"), "quality": batch.column("quality"), "columns": [extract.columns(x).tobytes() for x in texts(batch)]}

    kind = frame.schema["doc_id"].dataType.simpleString()
    got = map_batches(frame, work, f"doc_id {kind}, quality int, columns binary").toArrow()
    # The arrays stay in Arrow's buffers.
    rows = [np.frombuffer(x.as_buffer(), dtype=np.int32) for x in got.column("columns")]
    ids, labels = got.column("doc_id").to_pylist(), got.column("quality").to_pylist()
    order = sorted(range(len(rows)), key=lambda i: (ids[i], zlib.crc32(rows[i])))
    model = fit([rows[i] for i in order], np.array([labels[i] for i in order], dtype=np.int64), bits)
    del got, rows
    give_back()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """doc_id, score for every row. The model is two arrays of 2**bits numbers, whatever the input."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        extract = Extractor(bits)
        for batch in pieces(batches, "text"):
            yield {"doc_id": batch.column("doc_id"), "score": [shared.value.score(extract.columns(x)) for x in texts(batch)]}

    frame = id_and_text(docs, id_col, text_col)
    return map_batches(frame, work, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, score double")


def scorer(docs: DataFrame, model: Model, text_col: str = "text", bits: int = BITS) -> Column:
    """The score as a column of `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def value(column):
        extract = Extractor(bits)
        return column.fillna("").map(lambda x: shared.value.score(extract.columns(x))).astype(float)

    return value(F.col(text_col).cast("string"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    )
