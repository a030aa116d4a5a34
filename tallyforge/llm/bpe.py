"""Byte-pair encoding and decoding with contiguous rank arrays.

A short word is held as one array of its parts and one of the ranks of adjacent parts. The
least rank is found by a scan, its boundary deleted, and the two neighbouring ranks looked up
anew, until no rank is left. Words of equal length are held as the rows of one matrix, so each
scan, deletion and refresh is one numpy call for thousands of words. A word longer than
LONG_WORD bytes (a scan for each merge would take quadratic time) goes by a heap instead.

Words come from the tokenizer file's own splitting rule; ids of a word are kept for its next
occurrence, in a table that is emptied when its bytes are too many; very long words aren't kept. The tokenizer file's path is a
parameter; results equal those of the `tokenizers` library without special tokens added. A
special token's own string in a text becomes its id, as there.

Null text counts as empty text and has no ids. Repeated rows are encoded alike; an empty table gives an
empty result; a very long text is split into words and encoded whole by the task that reads it. Of equal
ranks the leftmost is merged first. Only the two named columns are read, so other columns' names don't matter.
"""

from __future__ import annotations

import heapq
import json
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.batches import id_and_text, map_batches, pieces, texts
from tallyforge.session import table

LONG_WORD = 64
#: Bytes of words and their ids that are kept at a time (about), what an entry takes besides them, and the longest word that is kept.
KEPT_BYTES, ENTRY_BYTES, KEPT_WORD = 64 << 20, 200, 1 << 10
NONE = np.int32(1 << 30)

#: Fixed value: the splitting rule of byte-level BPE.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next code point from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, spare = [], 256
    for b in range(256):
        letters.append(chr(b if b in plain else spare))
        spare += b not in plain
    return letters


class Merges:
    """A tokenizer file's vocabulary and merge ranks, ready for lookups by pairs of ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab = model["vocab"]
        letters = byte_letters()
        ending = model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.first = np.array([vocab[x] for x in letters], dtype=np.int32)
        self.last = np.array([vocab[x + ending] for x in letters], dtype=np.int32)
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], dtype=np.int64)
        merged = np.array([vocab[a + (b)] for a, b in pairs], dtype=np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of = keys[order], order.astype(np.int32)
        self.merged = np.append(merged, np.int32(-1))
        self.ranks = {int(k): i for i, k in enumerate(keys)}
        back = {x: b for b, x in enumerate(letters)}
        self.bytes_of = {i: bytes(back[c] for c in x) for x, i in vocab.items() if not ending} | {i: x.encode() for x, i in self.special.items()}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs of ids; NONE where there is no merge."""
        want = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.rank_of[at], NONE)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word (of one byte at least), as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        by_length: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            if len(word) > LONG_WORD:
                out[i] = self._long(word)
            else:
                by_length.setdefault(len(word), []).append(i)
        for n, where in by_length.items():
            rows = np.frombuffer(b"".join([words[i] for i in where]), dtype=np.uint8).reshape(len(where), n)
            for i, ids in zip(where, self._equal_length(rows), strict=True):
                out[i] = ids
        return out

    def _start(self, rows: np.ndarray) -> np.ndarray:
        parts = self.first[rows]
        parts[:, -1] = self.last[rows[:, -1]]
        return parts

    def _equal_length(self, rows: np.ndarray) -> list[bytes]:
        parts = self._start(rows)
        out = np.empty(len(rows), dtype=object)
        where = np.arange(len(rows))
        ranks = self.rank(parts[:, :-1], parts[:, 1:])
        while True:
            n = parts.shape[1]
            if n == 1:
                size = 4
                flat = parts.astype("<u4").tobytes()
                out[where] = [flat[i : i + size] for i in range(0, len(flat), size)]
                return out.tolist()
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(ranks)), at]
            done = least >= NONE
            if done.any():
                flat, size = parts[done].astype("<u4").tobytes(), 4 * n
                out[where[done]] = [flat[i : i + size] for i in range(0, len(flat), size)]
                if done.all():
                    return out.tolist()
                parts, ranks, where, at, least = parts[~done], ranks[~done], where[~done], at[~done], least[~done]
            row = np.arange(len(parts))
            parts[row, at] = self.merged[least]
            columns = np.arange(n - 1)
            parts = np.take_along_axis(parts, columns + (columns > at[:, None]), axis=1)
            columns = columns[:-1]
            ranks = np.take_along_axis(ranks, columns + (columns >= at[:, None]), axis=1)
            if n == 2:
                continue
            for has, pair in ((at > 0, at - 1), (at < n - 2, at)):
                r, c = row[has], pair[has]
                ranks[r, c] = self.rank(parts[r, c], parts[r, c + 1])

    def _long(self, word: bytes) -> bytes:
        parts = self._start(np.frombuffer(word, dtype=np.uint8)[None, :])[0].tolist()
        n, get = len(parts), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get(parts[i] << 20 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue
            parts[i], parts[j] = int(self.merged[rank]), -1
            after[i] = j = after[j]
            if j < n:
                before[j] = i
                if (r := get(parts[i] << 20 | parts[j])) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[j]))
            if (h := before[i]) >= 0 and (r := get(parts[h] << 20 | parts[i])) is not None:
                heapq.heappush(heap, (r, h, parts[h], parts[i]))
        ids = [p for p in parts if p >= 0]
        return struct.pack(f"<{len(ids)}I", *ids)


class WordTable(dict):
    """Ids of words met so far, within KEPT_BYTES and one batch."""

    def __init__(self, merges: Merges, to_bytes: Callable[[str], bytes]):
        super().__init__()
        self.merges, self.to_bytes, self.bytes, self.long = merges, to_bytes, 0, []

    def learn(self, lists: list[list[str]]) -> None:
        """Makes the ids of all words of the lists available until the next call; long ones of the last call go."""
        for word in self.long:
            self.pop(word, None)
        if self.bytes > KEPT_BYTES:
            self.clear()
            self.bytes = 0
        new = [x for x in set().union(*lists) if x not in self]
        ids = self.merges.encode_words([self.to_bytes(x) for x in new])
        self.update(zip(new, ids, strict=True))
        self.long = [x for x in new if len(x) > KEPT_WORD]
        self.bytes += sum(ENTRY_BYTES + 4 * len(x) + len(i) for x, i in zip(new, ids, strict=True) if len(x) <= KEPT_WORD)


class ByteLevelEncoder:
    """Encodes and decodes whole texts for byte-level vocabularies."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.words = WordTable(self.merges, str.encode)
        self.split = regex.compile(BYTE_LEVEL).findall
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.merges.special, key=len, reverse=True))) + ")").split
        self.marks = list(self.merges.special)

    def encode_batch(self, batch: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        lists, special = [], {}
        for text in batch:
            if any(mark in text for mark in self.marks):
                found = []
                for k, part in enumerate(self.parts(text)):
                    if k % 2:
                        special[mark := (part,)] = struct.pack("<I", self.merges.special[part])
                        found.append(mark)
                    else:
                        found += self.split(part)
                lists.append(found)
            else:
                lists.append(self.split(text))
        self.words.learn([[x for x in found if isinstance(x, str)] for found in lists] if special else lists)
        self.words.update(special)
        get = self.words.__getitem__
        out = [b"".join(map(get, found)) for found in lists]
        for mark in special:
            del self.words[mark]
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that aren't UTF-8 become replacement characters."""
        get = self.merges.bytes_of.__getitem__
        return b"".join(map(get, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: each whole text's ids as bytes of little-endian unsigned 32-bit integers.

    `vocabulary` is the path of the tokenizer file, the same on every executor.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        coder = ByteLevelEncoder(vocabulary)
        for batch in pieces(batches, "text"):
            yield {"doc_id": batch.column("doc_id"), "ids": coder.encode_batch(texts(batch))}

    frame = id_and_text(docs, id_col, text_col)
    return map_batches(frame, work, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids, text: the decoded text beside its ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        coder = ByteLevelEncoder(vocabulary)
        for batch in pieces(batches, "ids"):
            yield {"doc_id": batch.column("doc_id"), "ids": batch.column("ids"), "text": [coder.decode(x) for x in texts(batch, "ids")]}

    return map_batches(encoded, work, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids binary, text string")


def digests(decoded: DataFrame) -> DataFrame:
    """Counts and digests of ids and decoded texts."""
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return digests(decode(encode(table(spark, sf_dir, "documents"), path), path))
