"""Sequence language model: a hidden Markov model over word classes, and its unigram base.

A word belongs to one of 2**CLASS_BITS classes by the CRC of its last letters and its length, so
words with equal endings share one; the model's size doesn't grow with the corpus. A state emits classes,
a class emits its words by their training counts. Baum-Welch trains the states: each task runs
the scaled forward and backward recursions over its documents' class sequences and adds up
expected counts, and the counts of all tasks are summed in a shuffle, round by round.

A text's exact log10 probability is the scaled forward likelihood of its class sequence plus,
for each token, log10 of (c + 0.1) / (the class's count + 0.1 for each of its words and for an
unseen one). Outcomes are the training tokens and one unseen word in each class.

Words are looked up without moving every token: words that make up 1 / HEAVY of all training
tokens or more (HEAVY words at most, so their table is broadcast) are scored where they are read,
the others as (row, word hash, number) rows joined with the counts by shuffling.

Null text counts as empty: one end token. Repeated rows are scored alike. With no training rows
all counts are 0. An empty table gives an empty result. Only id and text are read, so other columns'
names don't matter. A very long text's words are held by the task that reads it (as 16-bit classes past
the first step); the recursions go over it in blocks of SPAN tokens, whose boundary values alone are kept.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.batches import id_and_text, map_batches, pieces, texts
from tallyforge.session import materialise, table

STATES = 8
CLASS_BITS = 12
ROUNDS = 4
HEAVY = 20_000
#: Words kept at a time by a task.
KEPT = 300_000
#: Tokens whose forward values are held at a time.
SPAN = 1_500_000
#: The end token; no word holds a space.
END = b" "
SMOOTH = 0.1


def word_class(word: bytes, bits: int = CLASS_BITS) -> int:
    """The class of a word: a CRC of its last three bytes and its length up to 12."""
    return zlib.crc32(word[-3:] + bytes([min(len(word), 12)])) >> (32 - bits)


def held_out(id_col: Column) -> Column:
    """Whether a document is kept from training; a null id trains (its remainder is not 0)."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 10 == 0, F.lit(False))


class Words(dict):
    """word -> place in the arrays `hash` (signed 64 bits), `group` (class), `log` and `heavy`."""

    def __init__(self, bits: int, heavy: dict[int, int] | None = None):
        super().__init__()
        self.bits, self.counts = bits, heavy or {}
        self.rows: list[tuple[int, int, float, bool]] = []
        self.arrays()

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word) - (1 << 63)
        c = self.counts.get(h)
        found = self[word] = len(self)
        self.rows.append((h, word_class(word, self.bits), 0.0 if c is None else math.log10(c + SMOOTH), c is not None))
        return found

    def arrays(self) -> None:
        """Brings the arrays up to the words met by now."""
        columns = list(zip(*self.rows, strict=True)) or [(), (), (), ()]
        self.hash, self.group = np.array(columns[0], dtype=np.int64), np.array(columns[1], dtype="<u2")
        self.log, self.heavy = np.array(columns[2], dtype=float), np.array(columns[3], dtype=bool)

    def forget(self) -> None:
        self.clear()
        self.rows.clear()


def tokens_of(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text, A-Z lower-cased and split at ASCII white space, then the end."""
    return [*text.lower().split(), END]


def _count_words(docs: DataFrame, bits: int) -> DataFrame:
    """(hash, class, c) over all rows of `docs`; each task counts before the shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        counts: Counter[bytes] = Counter()

        def out():
            keys = list(counts)
            yield {"hash": [xxhash.xxh64_intdigest(x) - (1 << 63) for x in keys], "class": [word_class(x, bits) for x in keys], "c": list(counts.values())}
            counts.clear()

        for batch in pieces(batches, "text"):
            for text in texts(batch):
                counts.update(tokens_of(text))
            if len(counts) > KEPT:
                yield from out()
        if counts:
            yield from out()

    return map_batches(docs.select("text"), work, "hash bigint, class int, c bigint").groupBy("hash", "class").agg(F.sum("c").alias("c"))


@dataclass(frozen=True)
class Model:
    """Start, transition and emission probabilities (states x classes)."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def first_model(mass: np.ndarray, states: int = STATES, seed: int = 5) -> Model:
    """Classes by their share, each state leaning to classes of its own; states tend to stay."""
    rng = np.random.default_rng(seed)
    lean = rng.dirichlet(np.full(states, 0.5), len(mass)).T + 0.02
    emit = lean * (mass / mass.sum())
    emit /= emit.sum(axis=1, keepdims=True)
    move = np.full((states, states), 0.2 / states) + 0.8 * np.eye(states)
    return Model(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit)


def _batches(sequences: list[np.ndarray], span: int = SPAN) -> Iterator[list[int]]:
    """Numbers of sequences, longest first, in groups of `span` tokens at most (or one sequence)."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    group, size = [], 0
    for i in order:
        if group and size + len(sequences[i]) > span:
            yield group
            group, size = [], 0
        group.append(i)
        size += len(sequences[i])
    if group:
        yield group


def _columns(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences (longest first) as one array by time, and how many are still running at each time."""
    lengths = np.array([len(x) for x in sequences])
    running = len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")
    begins = np.concatenate([[0], np.cumsum(running)])
    out = np.empty(int(lengths.sum()), dtype=np.int64)
    for i, x in enumerate(sequences):
        out[begins[: len(x)] + i] = x
    return out, begins


def _forward(model: Model, flat: np.ndarray, begins: np.ndarray, kind: type = np.float64, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward values by time, and the scale of each; `before`: the values of the time before the first, for a later block of a text."""
    values = np.ascontiguousarray(model.emit.T, dtype=kind)[flat]
    scales = np.empty(len(flat), dtype=kind)
    if before is None:
        values[: begins[1]] *= model.start.astype(kind)
    move = model.move.astype(kind)
    space = np.empty((begins[1], len(model.start)), dtype=kind)
    for t in range(len(begins) - 1):
        a, b = begins[t], begins[t + 1]
        now, scale = values[a:b], scales[a:b]
        if before is not None:
            now *= np.matmul(before[: b - a], move, out=space[: b - a])
        np.add.reduce(now, axis=1, out=scale)
        now /= scale[:, None]
        before = now
    return values, scales


def _blocks(model: Model, sequence: np.ndarray, span: int, kind: type) -> Iterator[tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]]:
    """A long sequence block by block: the block, the forward values before it, its own and their scales."""
    before = None
    for a in range(0, len(sequence), span):
        block = sequence[a : a + span].astype(np.int64)
        values, scales = _forward(model, block, np.arange(len(block) + 1), kind, before)
        yield block, before, values, scales
        before = values[-1:].copy()


def log_likelihoods(model: Model, sequences: list[np.ndarray], span: int = SPAN) -> np.ndarray:
    """log10 probability of each class sequence (of one class at least), by the scaled forward recursion."""
    out = np.zeros(len(sequences))
    for group in _batches(sequences, span):
        if len(sequences[group[0]]) > span:
            out[group[0]] = sum(float(np.log10(scales).sum()) for *_, scales in _blocks(model, sequences[group[0]], span, np.float64))
            continue
        flat, begins = _columns([sequences[i] for i in group])
        scales = np.log10(_forward(model, flat, begins)[1])
        logs = np.zeros(len(group))
        for a, b in zip(begins[:-1], begins[1:], strict=True):
            logs[: b - a] += scales[a:b]
        out[group] = logs
    return out


def _long_counts(model: Model, sequence: np.ndarray, span: int, kind: type, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
    """Adds a long sequence's expected counts: forward once for the blocks' boundaries, then block by block from the last one."""
    boundaries = [(a, before) for a, (_, before, _, _) in zip(range(0, len(sequence), span), _blocks(model, sequence, span, kind), strict=True)]
    turned, edge = np.ascontiguousarray(model.move.T, dtype=kind), None
    for a, before in reversed(boundaries):
        block = sequence[a : a + span].astype(np.int64)
        alpha, scales = _forward(model, block, np.arange(len(block) + 1), kind, before)
        after = np.ascontiguousarray(model.emit.T, dtype=kind)[block] / scales[:, None]
        back = np.ones_like(after)
        if edge is not None:
            np.matmul(edge, turned, out=back[-1:])
            move += (alpha[-1:].T @ edge) * model.move
        for t in range(len(block) - 1, 0, -1):
            after[t] *= back[t]
            np.matmul(after[t], turned, out=back[t - 1])
        move += (alpha[:-1].T @ after[1:]) * model.move
        edge = after[:1] * back[:1]
        back *= alpha
        if before is None:
            start += back[0]
        for s in range(len(start)):
            emit[:, s] += np.bincount(block, weights=back[:, s], minlength=len(emit))


def expected_counts(model: Model, sequences: list[np.ndarray], kind: type = np.float64, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and emissions (states x classes) of the sequences.

    `kind` is the type of the recursions' numbers, which stay near 1 by scaling; sums are doubles.
    """
    k, classes = model.emit.shape
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((classes, k))
    for group in _batches(sequences, span):
        if len(sequences[group[0]]) > span:
            _long_counts(model, sequences[group[0]], span, kind, start, move, emit)
            continue
        flat, begins = _columns([sequences[i] for i in group])
        alpha, scales = _forward(model, flat, begins, kind)
        after = np.ascontiguousarray(model.emit.T, dtype=kind)[flat]
        after /= scales[:, None]
        back, turned = np.ones_like(after), np.ascontiguousarray(model.move.T, dtype=kind)
        for t in range(len(begins) - 2, 0, -1):
            b, c = begins[t], begins[t + 1]
            a = begins[t - 1]
            after[b:c] *= back[b:c]
            np.matmul(after[b:c], turned, out=back[a : a + c - b])
        # Each token but the first of its text comes after the one in the same place of the time before.
        sizes = np.diff(begins)
        before = np.arange(begins[1], len(flat)) - np.repeat(sizes[:-1], sizes[1:])
        move += (alpha[before].T @ after[begins[1] :]) * model.move
        back *= alpha
        start += back[: begins[1]].sum(axis=0, dtype=np.float64)
        for s in range(k):
            emit[:, s] += np.bincount(flat, weights=back[:, s], minlength=classes)
    return start, move, emit.T


def _gathered(batches: Iterator[pa.RecordBatch], tokens: int = 4_000_000) -> Iterator[list[np.ndarray]]:
    """Class sequences in lists of up to about `tokens` tokens."""
    held, size = [], 0
    for batch in pieces(batches, "classes"):
        for x in texts(batch, "classes"):
            held.append(np.frombuffer(x, dtype="<u2"))
            size += len(held[-1])
        if size >= tokens:
            yield held
            held, size = [], 0
    if held:
        yield held


def train(sequences: DataFrame, mass: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all rows of `sequences` (classes: little-endian 16-bit integers as bytes).

    Emissions are smoothed with the classes' overall shares; what a round sends to the driver is
    one number for each state and class, whatever the input.
    """
    model = first_model(mass, states)
    context = sequences.sparkSession.sparkContext
    share = mass / mass.sum()
    for _ in range(rounds):
        shared = context.broadcast(model)

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[dict]:
            total = None
            for sequences in _gathered(batches):
                found = expected_counts(shared.value, sequences, np.float32)
                total = found if total is None else tuple(x + y for x, y in zip(total, found, strict=True))
            if total is not None:
                start, move, emit = total
                rows = [("s", 0, start), *(("m", i, x) for i, x in enumerate(move))]
                used = np.flatnonzero(emit.any(axis=0))
                yield {"part": [x[0] for x in rows], "place": [x[1] for x in rows], "n": [x[2] for x in rows]}
                yield {"part": ["e"] * len(used), "place": used, "n": list(emit.T[used])}

        parts = map_batches(sequences.select("classes"), work, "part string, place int, n array<double>")
        sums = parts.groupBy("part", "place").agg(*(F.sum(F.col("n")[i]).alias(f"n{i}") for i in range(states)))
        start, move, emit = np.full(states, 0.1), np.full((states, states), 0.1), np.zeros((states, len(mass)))
        for row in sums.toLocalIterator():
            n = np.array(row[2:])
            if row["part"] == "s":
                start += n
            elif row["part"] == "m":
                move[row["place"]] += n
            else:
                emit[:, row["place"]] = n
        emit += 1e-3 * share * (1 + emit.sum(axis=1, keepdims=True))
        model = Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))
    return model


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, bits: int = CLASS_BITS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    frame = id_and_text(docs, id_col, text_col, raw=True).withColumn("held_out", held_out(F.col("doc_id")))
    counts = materialise(_count_words(frame.where("not held_out"), bits), "counts")
    spark = docs.sparkSession
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    mass = np.full(1 << bits, SMOOTH)
    # One row for each class.
    for row in counts.groupBy("class").agg(F.sum(F.col("c") + SMOOTH).alias("m")).toLocalIterator():
        mass[row["class"]] += row["m"]
    # At most HEAVY words can have so many tokens.
    heavy = {r["hash"]: r["c"] for r in counts.where(F.col("c") >= max(1, total // HEAVY)).select("hash", "c").toLocalIterator()} if total >= HEAVY else {}
    shared = spark.sparkContext.broadcast((heavy, np.log10(mass)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        heavy, logs = shared.value
        words = Words(bits, heavy)
        for batch in pieces(batches, "text"):
            if len(words) > KEPT:
                words.forget()
            out: dict[str, list] = {x: [] for x in ("n_tokens", "n_known", "classes", "class_log", "known_log", "rest", "rest_n")}
            lists = [np.fromiter(map(words.__getitem__, x), dtype=np.int64, count=len(x)) for x in map(tokens_of, texts(batch))]
            words.arrays()
            for places in lists:
                classes, easy = words.group[places], words.heavy[places]
                rest, n = np.unique(places[~easy], return_counts=True)
                out["n_tokens"].append(len(places))
                out["n_known"].append(int(easy.sum()))
                out["classes"].append(classes.tobytes())
                out["class_log"].append(float(logs[classes].sum()))
                out["known_log"].append(float(words.log[places].sum()))
                out["rest"].append(words.hash[rest])
                out["rest_n"].append(n.astype(np.int32))
            yield out | {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out")}

    kind = frame.schema["doc_id"].dataType.simpleString()
    rows = map_batches(
        frame, read, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, classes binary, class_log double, known_log double, rest array<bigint>, rest_n array<int>"
    )
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "tokens")
    model = train(rows.where("not held_out"), mass, states, rounds)

    rest = rows.select("row", F.explode(F.arrays_zip("rest", "rest_n")).alias("x")).select("row", F.col("x.rest").alias("hash"), F.col("x.rest_n").alias("n"))
    looked = rest.join(counts.select("hash", "c"), "hash", "left").groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)).alias("rest_log"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("rest_known")
    )
    fitted = spark.sparkContext.broadcast(model)

    def likelihood(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            logs = log_likelihoods(fitted.value, [np.frombuffer(x, dtype="<u2") for x in texts(batch, "classes")])
            yield {name: batch.column(name) for name in ("row", "doc_id", "held_out", "n_tokens", "n_known", "class_log", "known_log")} | {"hmm": logs}

    chains = map_batches(
        rows.select("row", "doc_id", "held_out", "n_tokens", "n_known", "classes", "class_log", "known_log"),
        likelihood,
        f"row bigint, doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, class_log double, known_log double, hmm double",
    )
    word_log = F.col("known_log") + F.coalesce("rest_log", F.lit(0.0))
    return chains.join(looked, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (word_log - F.col("n_tokens") * float(np.log10(total + SMOOTH * (distinct + 1)))).alias("base_score"),
        (F.col("hmm") + word_log - F.col("class_log")).alias("score"),
    )


def op3_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
