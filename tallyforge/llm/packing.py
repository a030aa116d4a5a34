"""Hierarchical packing of documents into sequences of several context sizes.

Each task tokenizes its documents as they stream by and packs them at once, so tokens never
shuffle. A document's full windows of the largest context become sequences of their own; its
rest is routed to the tier of the smallest context that holds it. When a task has gathered
POOL_TOKENS of rests, it packs tier by tier from the longest: each window opens with the longest
rest of its tier, its gap is filled with the largest rests of shorter tiers that fit, and what
gap remains is closed by cutting a piece off another rest. So a sequence has exactly its tier's
length, a power of two, and needs no padding. At a task's end the few tokens left over go out
in powers of two as well. Sequences are dealt into step groups of STEP_TOKENS, longest first,
which the tiers fill exactly.

Null text counts as empty: its ids are the end id alone. Repeated rows are packed as separate
documents. Other columns than the two named aren't read. An empty table gives no pieces.
A pool's size bounds memory; it doesn't grow with the documents, however long they are.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.batches import id_and_text, map_batches, pieces, texts
from tallyforge.llm.bpe import Merges, WordTable
from tallyforge.session import table

CONTEXTS = (2048, 1024, 512, 256)
POOL_TOKENS = 1 << 19
STEP_TOKENS = 64 * 2048
END_ID = 1
#: Chunks whose ids are kept at a time.
KEPT_CHUNKS = 400_000
#: Characters of such chunks, so that long ones don't pile up.
KEPT_BYTES = 16 << 20
#: White space to Python's `split`, but not to the vocabulary's rule.
SEPARATORS = (b"\x1c", b"\x1d", b"\x1e", b"\x1f")
#: Fixed value: the vocabulary's splitting rule, its classes of letters and numbers spelled out within Latin-1 in lower case.
LATIN_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\sa-zªµºß-öø-ÿ0-9²³¹¼-¾]+"


class ChunkTokenizer:
    """Ids as the `tokenizers` library gives them, found once for each white-space-free chunk of plain texts.

    The vocabulary's rule drops white space and never looks across it, so a text's ids are those
    of its chunks; chunks met first go through the rank array encoder. Texts with letters beyond
    Latin-1 (where normal forms could reach further), with information separators, or with a
    special token's string go to the library whole.
    """

    def __init__(self, path: str):
        self.path, self.library = path, None
        self.split = re.compile(LATIN_PIECES).findall
        self.kept: dict[str, bytes] = {}
        self.pieces = WordTable(Merges(path), str.encode)
        self.room = 0

    @staticmethod
    def odd(text: str) -> bool:
        """Whether a text must go to the library whole."""
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return True
        return b"<|" in raw or any(x in raw for x in SEPARATORS)

    def _learn(self, chunks: list[str]) -> None:
        found = [self.split(x.lower()) for x in chunks]
        self.pieces.learn(found)
        get = self.pieces.__getitem__
        self.room += sum(map(len, chunks))
        self.kept.update((chunk, get(x[0]) if len(x) == 1 else b"".join(map(get, x))) for chunk, x in zip(chunks, found, strict=True))

    def encode_batch(self, batch: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.kept) > KEPT_CHUNKS or self.room > KEPT_BYTES:
            self.kept.clear()
            self.room = 0
        lists = [None if self.odd(x) else x.split() for x in batch]
        self._learn([x for x in set().union(*(x for x in lists if x)) if x not in self.kept])
        get = self.kept.__getitem__
        return [self._whole(text) if chunks is None else b"".join(map(get, chunks)) for text, chunks in zip(batch, lists, strict=True)]

    def _whole(self, text: str) -> bytes:
        if self.library is None:  # few texts need it, and it takes memory
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.no_truncation()
            self.library.no_padding()
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


class Packer:
    """Packs (doc_id, ids) into pieces; `rows` are (doc_id, start, ids, doc_tokens, sequence_id, offset, context, step_group)."""

    def __init__(self, first_id: int, contexts: tuple[int, ...] = CONTEXTS, pool_tokens: int = POOL_TOKENS, step_tokens: int = STEP_TOKENS):
        self.contexts, self.pool_tokens, self.step_tokens = contexts, pool_tokens, step_tokens
        self.tiers: list[list[tuple]] = [[] for _ in contexts]  # of (length, number, doc_id, start, ids, doc_tokens), shortest first
        self.held, self.number = 0, 0
        self.sequence = self.step = first_id
        self.open: list[list[int]] = []  # step groups with room: [room, id]
        self.ready: list[tuple[int, list[tuple]]] = []
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        most, total = self.contexts[0], len(ids)
        for start in range(0, total, most):
            part = ids[start : start + most]
            if len(part) == most:
                self._close(most, [(most, 0, doc_id, start, part, total)])
            else:
                self._hold(doc_id, start, part, total)
        if self.held >= self.pool_tokens:
            self.pack()

    def _hold(self, doc_id, start, ids, total) -> None:
        self.number += 1
        tier = max(i for i, c in enumerate(self.contexts) if len(ids) <= c)
        insort(self.tiers[tier], (len(ids), self.number, doc_id, start, ids, total), key=lambda x: x[:2])
        self.held += len(ids)

    def _take(self, tier: int, at: int) -> tuple:
        item = self.tiers[tier].pop(at)
        self.held -= item[0]
        return item

    def _fill(self, room: int, tier: int) -> list[tuple]:
        """Items of this tier and shorter ones that fill `room` as far as there are any."""
        found = []
        for t in range(tier, len(self.tiers)):
            while room and (at := bisect_right(self.tiers[t], room, key=lambda x: x[0])):
                found.append(item := self._take(t, at - 1))
                room -= item[0]
        while room and (t := next((t for t in range(len(self.tiers) - 1, -1, -1) if self.tiers[t]), None)) is not None:
            # No shorter tier's item fits: take the least of what there is, whole or cut; its rest is routed anew.
            length, number, doc_id, start, ids, total = self._take(t, 0)
            used = min(room, length)
            found.append((used, number, doc_id, start, ids[:used], total))
            if used < length:
                self._hold(doc_id, start + used, ids[used:], total)
            room -= used
        return found

    def pack(self) -> None:
        """Turns the pool into full windows, longest tier first; less than a window stays."""
        for tier, context in enumerate(self.contexts):
            while self.tiers[tier] and self.held >= context:
                first = self._take(tier, -1)
                self._close(context, [first, *self._fill(context - first[0], tier + 1)])
        self.flush()

    def finish(self) -> None:
        """Packs all, the last tokens in powers of two."""
        self.pack()
        while self.held:
            size = 1 << (self.held.bit_length() - 1)
            self._close(size, self._fill(size, 0))
        self.flush()

    def _close(self, context: int, items: list[tuple]) -> None:
        self.ready.append((context, items))

    def flush(self) -> None:
        """Deals the finished sequences into step groups, longest first, and numbers them."""
        for context, items in sorted(self.ready, key=lambda x: -x[0]):
            group = next((g for g in self.open if g[0] >= context), None)
            if group is None:
                self.open.append(group := [self.step_tokens, self.step])
                self.step += 1
            group[0] -= context
            if not group[0]:
                self.open.remove(group)
            offset = 0
            for length, _, doc_id, start, ids, total in items:
                self.rows.append((doc_id, start, ids, total, self.sequence, offset, context, group[1]))
                offset += length
            self.sequence += 1
        self.ready.clear()


COLUMNS = ("doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset", "context", "step_group")


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, ids (bytes of little-endian unsigned 32-bit integers), doc_tokens,
    sequence_id, offset, context (the sequence's length), step_group.

    `vocabulary` is the path of the tokenizer file, the same on every executor. Sequence and
    group numbers are unique, with the partition's number in their upper bits.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        coder = ChunkTokenizer(vocabulary)
        packer = Packer(TaskContext.get().partitionId() << 40)

        def out():
            if len(packer.ready) > 512:
                packer.flush()
            rows, packer.rows = packer.rows, []
            for begin in range(0, len(rows), 2_000):
                yield {name: [x.tobytes() for x in column] if name == "ids" else list(column) for name, column in zip(COLUMNS, zip(*rows[begin : begin + 2_000], strict=True), strict=True)}

        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in pieces(batches, "text"):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), coder.encode_batch(texts(batch)), strict=True):
                packer.add(doc_id, np.frombuffer(ids + end, dtype="<u4"))
                if len(packer.ready) > 512:
                    yield from out()
            yield from out()
        packer.finish()
        yield from out()

    frame = id_and_text(docs, id_col, text_col)
    kind = frame.schema["doc_id"].dataType.simpleString()
    return map_batches(
        frame, work, f"doc_id {kind}, start bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, context bigint, step_group bigint"
    )


def piece_digests(packed: DataFrame) -> DataFrame:
    """The pieces with length and checksum in place of their ids."""
    return packed.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "context", "step_group"
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_digests(pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
