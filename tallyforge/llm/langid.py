"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's
probability in a language is the sum over all its segmentations into pieces, by the forward
algorithm; a text's is the product over its words (runs of letters, lower-cased). Probabilities
are trained by expectation maximisation: word counts for each language are gathered by Spark, the
expected piece counts of each round are summed over partitions.

Training reads about `max_docs` documents at most, chosen by language by a hash of the id (a
documented bound): all rows of a small language, equally many of each larger one, and about
LEAST of each even where that exceeds `max_docs`. So every labelled language is learned at any
size. A language's prior is its share of the words of all usable rows, estimated from the sample.
Prediction reads every row and whole text. A text that is null or has no letter is
`und` with score 0, as is every text if nothing could be learned. Ties go to the language first
in order. Letters outside the vocabulary count as one unknown piece each. The piece table has
(pieces x languages) numbers, whatever the input. Repeated rows are scored alike (and count as often as
they occur in training); an empty table gives an empty result; a very long text is scored whole, word
by word, by the task that reads it. Only the named columns are read.
"""

from __future__ import annotations

import itertools
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.batches import id_and_text, map_batches, pieces, texts
from tallyforge.session import materialise, table

MAX_DOCS = 4_000
#: Documents of each larger language that are read at least, about.
LEAST = 50
ROUNDS = 3
SMOOTH = 0.05
START = "▁"
UNKNOWN = 0
#: Chunks whose scores are kept at a time.
KEPT = 300_000
#: What str.isalpha() takes for letters; not numbers like a half or Roman numeral signs.
_LETTERS = regex.compile(r"\p{L}+")
_WORDS = re.compile(r"[^\W\d_]+")


def letter_runs(text: str) -> list[str]:
    """The runs of letters; those of letters and numeric signs, which the faster expression finds, are nearly always the same."""
    found = _WORDS.findall(text)
    if all(map(str.isalpha, found)):
        return found
    return [y for x in found for y in ((x,) if x.isalpha() else _LETTERS.findall(x))]


def vocabulary(path: str) -> list[str]:
    """The pieces of a sentencepiece model that letters can make up; place 0 is the unknown piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return ["", *sorted({x for x in found if (y := x.removeprefix(START)).isalpha() or x == START} | {START})]


class Lattice:
    """All pieces of many words: arrays of (start, end, piece), ends ascending, over the words' concatenated positions."""

    def __init__(self, names: list[str]):
        self.automaton = ahocorasick.Automaton()
        for i, name in enumerate(names):
            if name:
                self.automaton.add_word(name, i << 8 | len(name))
        self.automaton.make_automaton()
        #: By code point: whether a letter alone is a piece (or the mark between words).
        self.known = np.zeros(0x110000, dtype=bool)
        self.known[[ord(x) for x in names if len(x) == 1] + [ord("\n")]] = True

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """start, end, piece of each match; first and last position of each word. Position p stands before letter p."""
        text = "\n".join(START + x for x in words)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        at, value = np.fromiter(itertools.chain.from_iterable(self.automaton.iter(text)), dtype=np.int64).reshape(-1, 2).T
        end, size, piece = at + 1, value & 255, value >> 8
        unknown = np.flatnonzero(~self.known[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)])
        start = np.concatenate([end - size, unknown])
        end, piece = np.concatenate([end, unknown + 1]), np.concatenate([piece, np.full(len(unknown), UNKNOWN)])
        order = np.argsort(end, kind="stable")
        return start[order], end[order], piece[order], first, first + sizes


def _by_step(place: np.ndarray, step: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges by their step within the word: (edge numbers sorted by place, where each place begins)."""
    order = np.lexsort((place, step))
    cuts = np.flatnonzero(np.diff(step[order], prepend=-1, append=-1))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        edges = order[a:b]
        yield edges, np.flatnonzero(np.diff(place[edges], prepend=-1))


def _sums(start, end, piece, first, last, logp, backward: bool = False) -> np.ndarray:
    """Log sums over all segmentations from a word's begin to each position (or from each position to its end), by language."""
    n = int(last[-1]) + 1
    out = np.full((n, logp.shape[1]), -np.inf)
    seeds, place, come = (last, start, end) if backward else (first, end, start)
    out[seeds] = 0.0
    word = np.searchsorted(first, start, side="right") - 1
    step = last[word] - start if backward else end - first[word]
    for edges, begins in _by_step(place, step):
        value = out[come[edges]] + logp[piece[edges]]
        most = np.maximum.reduceat(value, begins, axis=0)
        safe = np.where(np.isfinite(most), most, 0.0)
        spread = np.repeat(safe, np.diff(np.append(begins, len(edges))), axis=0)
        with np.errstate(divide="ignore"):
            out[place[edges[begins]]] = np.log(np.add.reduceat(np.exp(value - spread), begins, axis=0)) + safe
    return out


def word_scores(lattice: Lattice, words: list[str], logp: np.ndarray) -> np.ndarray:
    """(words, languages): log probability of each word, all segmentations summed."""
    if not words:
        return np.zeros((0, logp.shape[1]))
    edges = lattice.edges(words)
    return _sums(*edges, logp)[edges[4]]


def expected_counts(lattice: Lattice, words: list[str], counts: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """(pieces, languages): expected piece counts of words with `counts` (words, languages)."""
    out = np.zeros_like(logp)
    if not words:
        return out
    start, end, piece, first, last = edges = lattice.edges(words)
    alpha, beta = _sums(*edges, logp), _sums(*edges, logp, backward=True)
    word = np.searchsorted(first, start, side="right") - 1
    share = np.exp(alpha[start] + logp[piece] + beta[end] - alpha[last][word]) * counts[word]
    np.add.at(out, piece, share)
    return out


@dataclass(frozen=True)
class Model:
    names: list[str]
    languages: list[str]
    logp: np.ndarray
    prior: np.ndarray


class Scorer:
    """Scores texts; keeps the scores of chunks met."""

    def __init__(self, model: Model):
        self.model, self.lattice = model, Lattice(model.names)
        self.rows: dict[str, int] = {}
        self.table = np.zeros((0, len(model.languages)))

    def _learn(self, lists: list[list[str]]) -> None:
        if len(self.rows) > KEPT:
            self.rows, self.table = {}, self.table[:0]
        new = [x for x in set().union(*lists) if x not in self.rows]
        runs = [letter_runs(x) for x in new]
        words = list(set().union(*runs))
        place = dict(zip(words, range(len(words)), strict=True))
        parts = [word_scores(self.lattice, words[i : i + 20_000], self.model.logp) for i in range(0, len(words), 20_000)]
        scores = np.concatenate([*parts, np.zeros((1, self.table.shape[1]))])
        flat = np.array([place[w] for r in runs for w in (r or ())] + [len(words)], dtype=np.int64)
        begins = np.cumsum([0, *(len(r) for r in runs)])
        total = np.cumsum(np.concatenate([np.zeros((1, scores.shape[1])), scores[flat[:-1]]]), axis=0)
        self.rows.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
        self.table = np.concatenate([self.table, total[begins[1:]] - total[begins[:-1]]])

    def predict(self, batch: list[str]) -> tuple[list[str], list[float]]:
        """The likeliest language of each text and its posterior probability."""
        lists = [x.lower().split() for x in batch]
        self._learn(lists)
        tags, scores = [], []
        for text, chunks in zip(batch, lists, strict=True):
            total = self.table[np.fromiter(map(self.rows.__getitem__, chunks), dtype=np.int64, count=len(chunks))].sum(axis=0)
            if not self.model.languages or (not total.any() and not _LETTERS.search(text)):
                tags.append("und")
                scores.append(0.0)
                continue
            total = total + self.model.prior
            best = int(total.argmax())
            tags.append(self.model.languages[best])
            scores.append(float(1 / np.exp(total - total[best]).sum()))
        return tags, scores


#: The scorer of the last model used in this process, under the model's key.
_last: dict[str, Scorer] = {}


def scorer_of(key: str, model: Model) -> Scorer:
    """One scorer for all tasks that a Python worker runs with a model, so that later tasks find the words of earlier ones."""
    if key not in _last:
        _last.clear()
        _last[key] = Scorer(model)
    return _last[key]


def held_out(id_col: Column) -> Column:
    """Whether a document is kept from training; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over `docs` (lang, text), counted in each task before the shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in pieces(batches, "text"):
            counts: dict[tuple[str, str], int] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), texts(batch), strict=True):
                for word in letter_runs(text.lower()):
                    counts[lang, word] = counts.get((lang, word), 0) + 1
            yield {"lang": [k[0] for k in counts], "word": [k[1] for k in counts], "n": list(counts.values())}

    return map_batches(docs, work, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def sample_shares(rows: dict[str, int], max_docs: int) -> dict[str, float]:
    """The share of each language's rows to read: all of small languages, equally many rows of the others."""
    left, quota = max_docs, float(LEAST)
    for place, n in enumerate(sorted(rows.values())):
        if n * (len(rows) - place) > left:
            quota = max(quota, left / (len(rows) - place))
            break
        left, quota = left - n, max(quota, n)
    return {lang: min(1.0, quota / n) for lang, n in rows.items()}


def train(docs: DataFrame, pieces_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_DOCS, rounds: int = ROUNDS) -> Model:
    """Fits piece probabilities; held-out rows and rows without text or language aren't read."""
    names = vocabulary(pieces_path)
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    usable = usable.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    # One row for each language.
    shares = sample_shares({r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}, max_docs)
    if any(share < 1 for share in shares.values()):
        bounds = docs.sparkSession.createDataFrame([(lang, int(share * (1 << 30))) for lang, share in shares.items()], "lang string, bound bigint")
        usable = usable.join(F.broadcast(bounds), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("bound"))
    words = materialise(word_counts(usable.select("lang", "text")).groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("n")), "words")
    sizes = {r["lang"]: r["n"] / shares[r["lang"]] for r in words.select(F.explode("n").alias("lang", "n")).groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(sizes)
    prior = np.log(np.array([sizes[x] for x in languages], dtype=float)) - np.log(max(1, sum(sizes.values()))) if languages else np.zeros(0)
    logp = np.full((len(names), len(languages)), -np.log(len(names)))
    context = docs.sparkSession.sparkContext
    for _ in range(rounds if languages else 0):
        shared = context.broadcast((names, logp))

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[dict]:
            names, logp = shared.value
            lattice, total = Lattice(names), np.zeros_like(logp)
            column = {x: i for i, x in enumerate(languages)}
            for batch in batches:
                rows = list(zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True))
                for begin in range(0, len(rows), 20_000):
                    some = rows[begin : begin + 20_000]
                    counts = np.zeros((len(some), len(languages)))
                    for i, (_, by) in enumerate(some):
                        for lang, n in by:
                            counts[i, column[lang]] = n
                    total += expected_counts(lattice, [x[0] for x in some], counts, logp)
            used = np.flatnonzero(total.any(axis=1))
            yield {"piece": used, "expected": list(total[used])}

        parts = map_batches(words, work, "piece bigint, expected array<double>").select("piece", F.posexplode("expected").alias("lang", "n"))
        total = np.zeros_like(logp)
        # At most one row for each piece and language.
        for row in parts.groupBy("piece", "lang").agg(F.sum("n").alias("n")).toLocalIterator():
            total[row["piece"], row["lang"]] = row["n"]
        total += SMOOTH
        logp = np.log(total / total.sum(axis=0))
    return Model(names, languages, logp, prior)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        scorer = scorer_of(key, shared.value)
        for batch in pieces(batches, "text"):
            tags, scores = scorer.predict(texts(batch))
            yield {"doc_id": batch.column("doc_id"), "lang_pred": tags, "score": scores}

    frame = id_and_text(docs, id_col, text_col)
    return map_batches(frame, work, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    model = train(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
