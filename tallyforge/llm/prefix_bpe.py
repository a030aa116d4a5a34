"""Byte-level BPE by prefix dynamic programming over a file of ranks.

For each byte prefix of a piece there is exactly one token that its encoding ends in. A token
that ends at a prefix's end is that one if it can stand after the last token of the prefix
before it: pairs of neighbouring tokens decide alone whether a whole sequence is the one that
merging by least rank gives. So one pass from left to right fills a table of last tokens, and
walking back from the end gives the ids.

The table of a prefix doesn't depend on what follows it. `append` therefore only fills in the new
bytes' entries, and `edit` works on the pieces that an edit reaches, from its first byte until
the entries agree with the old ones over the longest token's length; all others are kept.

Whether a pair can stand is decided by undoing its merges, latest first: of the two tokens at the
border the one of greater rank was made later (of equal ones the right one, as merging goes
from the left). Before that merge the pair that lay at the border must not have had a
lesser rank. This needs ranks in order of merging; a file in which a token is made of later ones is refused.

A piece that is a token as a whole is that token, as in the `tiktoken` library. Null text counts as empty
and has no ids; repeated rows are encoded alike; an empty table gives an empty result; a very
long text is split and encoded whole by the task that reads it, in time linear in its bytes. Only the named columns
are read, so other columns' names don't matter.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.batches import id_and_text, map_batches, pieces, texts
from tallyforge.session import table

#: Pieces over so many bytes are walked one by one; shorter ones of a batch together.
LONG_PIECE = 64
#: Bytes of pieces and their ids that a worker keeps for their next occurrence (about; emptied when full).
KEPT_BYTES = 48 << 20
#: Bytes that an entry of a Python dict takes besides its contents (about), and the longest piece that is kept.
ENTRY_BYTES, KEPT_PIECE = 200, 1 << 10
#: Characters behind a piece's end that the splitting rule may have looked at.
LOOKAHEAD = 2
NONE = np.int64(1 << 40)


class PrefixCoder:
    """Encodes pieces by the ranks of a file: lines of a base64 token and its rank."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.rank = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.size = max(self.rank.values()) + 1
        self.longest = max(map(len, self.rank))
        self.bytes_of: list[bytes] = [b""] * self.size
        for token, rank in self.rank.items():
            self.bytes_of[rank] = token
        self.length = np.fromiter(map(len, self.bytes_of), dtype=np.int64, count=self.size)
        self._grow_trie()
        self._find_splits()

    def _grow_trie(self) -> None:
        child: dict[int, int] = {}
        token_at = [-1]
        for token, rank in self.rank.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                node = child.get(key, -1)
                if node < 0:
                    node = child[key] = len(token_at)
                    token_at.append(-1)
            token_at[node] = rank
        keys = np.fromiter(child, dtype=np.int64, count=len(child))
        nodes = np.fromiter(child.values(), dtype=np.int64, count=len(child))
        order = np.argsort(keys)
        self.trie_keys, self.trie_nodes, self.token_at = keys[order], nodes[order], np.array(token_at, dtype=np.int64)

    def _find_splits(self) -> None:
        """The two tokens that each token is merged from last; `made`: its rank, -1 for bytes; tokens that no merging makes are left out."""
        self.made = np.full(self.size, -1, dtype=np.int64)
        self.left, self.right = np.zeros(self.size, dtype=np.int64), np.zeros(self.size, dtype=np.int64)
        self.reachable = self.length == 1
        self.pair_keys, self.pair_ranks = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        for n in np.unique(self.length[self.length > 1]).tolist():
            ranks = np.flatnonzero(self.length == n).tolist()
            tries = [(r, a, b) for r in ranks for token in (self.bytes_of[r],) for k in range(1, n) if (a := self.rank.get(token[:k])) is not None and (b := self.rank.get(token[k:])) is not None]
            if tries:
                whole, a, b = np.array(tries, dtype=np.int64).T
                held = self.reachable[a] & self.reachable[b]
                whole, a, b = whole[held], a[held], b[held]
                fits = self.fits(a, b)
                whole, a, b = whole[fits], a[fits], b[fits]
                if (np.maximum(self.made[a], self.made[b]) >= whole).any():
                    raise ValueError("ranks aren't in order of merging")
                self.made[whole], self.left[whole], self.right[whole], self.reachable[whole] = whole, a, b, True
                keys, values = np.append(self.pair_keys, a * self.size + b), np.append(self.pair_ranks, whole)
                order = np.argsort(keys)
                self.pair_keys, self.pair_ranks = keys[order], values[order]
        self.known: dict[int, bool] = {}

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.pair_keys):
            return np.full(len(left), NONE)
        want = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, want), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == want, self.pair_ranks[at], NONE)

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For pairs of tokens: whether they can be neighbours in an encoding."""
        out = np.zeros(len(left), dtype=bool)
        at, limit = np.arange(len(left)), np.full(len(left), NONE)
        while len(at):
            held = self._pair(left, right) >= limit
            at, left, right = at[held], left[held], right[held]
            a, b = self.made[left], self.made[right]
            bytes_only = (a < 0) & (b < 0)
            out[at[bytes_only]] = True
            go = ~bytes_only
            at, left, right, a, b = at[go], left[go], right[go], a[go], b[go]
            undo_left = a > b
            limit = np.where(undo_left, a, b + 1)
            left, right = np.where(undo_left, self.right[left], left), np.where(undo_left, right, self.left[right])
        return out

    def _fits_one(self, left: int, right: int) -> bool:
        key = left * self.size + right
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= 1 << 17:
                self.known.clear()
            found = self.known[key] = bool(self.fits(np.array([left]), np.array([right]))[0])
        return found

    def matches(self, buffer: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end, token) of every token that occurs inside a piece of the buffer, by end and then the longest first; `ends`: for each byte its piece's end."""
        start, node = np.arange(len(buffer)), np.zeros(len(buffer), dtype=np.int64)
        found_end, found_token, depth = [], [], 0
        while len(start):
            inside = start + depth < ends[start]
            start, node = start[inside], node[inside]
            want = node << 8 | buffer[start + depth]
            at = np.minimum(np.searchsorted(self.trie_keys, want), len(self.trie_keys) - 1)
            goes = self.trie_keys[at] == want
            start, node = start[goes], self.trie_nodes[at[goes]]
            depth += 1
            token = self.token_at[node]
            whole = token >= 0
            whole[whole] = self.reachable[token[whole]]
            found_end.append(start[whole] + depth)
            found_token.append(token[whole])
        end, token = np.concatenate(found_end or [start]), np.concatenate(found_token or [start])
        order = np.lexsort((-self.length[token], end))
        return end[order], token[order]

    def fill(self, words: list[bytes]) -> list[np.ndarray]:
        """For each piece the last token of each of its prefixes."""
        last, first, _ = self._fill(words)
        return np.split(last, first[1:]) if words else []

    def _fill(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The entries of all pieces in one array, with each piece's begin and size."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        first = np.cumsum(sizes) - sizes
        buffer = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
        owner = np.repeat(np.arange(len(words)), sizes)
        end, token = self.matches(buffer, (first + sizes)[owner])
        last = np.full(len(buffer), -1, dtype=np.int64)
        within = end - first[owner[end - 1]]
        long = sizes[owner[end - 1]] > LONG_PIECE
        for i in np.flatnonzero(sizes > LONG_PIECE).tolist():
            a, b = np.searchsorted(end, [first[i] + 1, first[i] + sizes[i] + 1])
            self._walk(last[first[i] : first[i] + sizes[i]], (end[a:b] - first[i]).tolist(), token[a:b].tolist())
        end, token, within = end[~long], token[~long], within[~long]
        order = np.argsort(within, kind="stable")
        bounds = np.searchsorted(within[order], np.arange(1, LONG_PIECE + 2))
        for k in range(LONG_PIECE):
            here = order[bounds[k] : bounds[k + 1]]
            e, t = end[here], token[here]
            while len(e):
                new = np.ones(len(e), dtype=bool)
                np.not_equal(e[1:], e[:-1], out=new[1:])
                te, tt = e[new], t[new]
                before = te - self.length[tt]
                good = self.length[tt] == k + 1
                rest = np.flatnonzero(~good)
                good[rest] = self.fits(last[before[rest] - 1], tt[rest])
                last[te[good] - 1] = tt[good]
                # Of prefixes that are settled no further token is tried; of the others the next one.
                left = ~new & (last[e - 1] < 0)
                e, t = e[left], t[left]
        return last, first, sizes

    def _walk(self, last: np.ndarray, ends: list[int], tokens: list[int], begin: int = 0) -> None:
        """Fills one piece's entries from `begin` on, of matches in order."""
        table, length, done = last.tolist(), self.length, begin
        for e, t in zip(ends, tokens, strict=True):
            if e > done:
                before = e - int(length[t])
                if before == 0 or self._fits_one(table[before - 1], t):
                    table[e - 1], done = t, e
        last[:] = table

    def extend(self, piece: bytes, last: np.ndarray, old: np.ndarray | None = None, same: int = 0) -> tuple[np.ndarray, int]:
        """The entries of a piece of which the first len(last) are known, and how many were worked out.

        `old`: entries of the piece's end, as they were before an edit, whose last `same` bytes are as they were; once as
        many entries as the longest token has bytes agree there, the rest is taken over.
        """
        known, n = len(last), len(piece)
        out = np.concatenate([last, np.full(n - known, -1, dtype=np.int64)])
        step = max(256, 4 * self.longest)
        while known < n:
            upto = min(n, known + step)
            low = max(0, known - self.longest)
            window = np.frombuffer(piece[low:upto], dtype=np.uint8).astype(np.int64)
            end, token = self.matches(window, np.full(len(window), len(window)))
            new = end + low > known
            part = out[:upto]
            self._walk(part, (end[new] + low).tolist(), token[new].tolist(), known)
            known = upto
            # The window of agreement lies in unchanged bytes, and so do all bytes its tokens can begin at.
            if old is not None and n - known <= len(old) and same - (n - known) >= 2 * self.longest:
                back = len(old) - (n - known)
                if back >= self.longest and np.array_equal(out[known - self.longest : known], old[back - self.longest : back]):
                    out[known:] = old[back:]
                    return out, known - len(last)
        return out, n - len(last)

    def ids(self, piece: bytes, last: np.ndarray) -> list[int]:
        """The piece's ids, from the table of its prefixes."""
        if (whole := self.rank.get(piece)) is not None:
            return [whole]
        out, at, table, length = [], len(piece), last, self.length
        while at:
            token = int(table[at - 1])
            out.append(token)
            at -= int(length[token])
        return out[::-1]

    def encode_pieces(self, words: list[bytes]) -> list[bytes]:
        """Ids of each piece (of one byte at least), as little-endian unsigned 32-bit integers."""
        out = [self.rank[x].to_bytes(4, "little") if x in self.rank else b"" for x in words]
        where = [i for i, x in enumerate(out) if not x]
        last, first, sizes = self._fill([words[i] for i in where])
        for k in np.flatnonzero(sizes > LONG_PIECE).tolist():
            ids = self.ids(words[where[k]], last[first[k] : first[k] + sizes[k]].tolist())
            out[where[k]] = np.array(ids, dtype="<u4").tobytes()
        who = np.flatnonzero(sizes <= LONG_PIECE)
        at, owners, tokens = (first + sizes)[who], [who[:0]], [last[:0]]
        # One step back for all pieces at a time.
        while len(who):
            owners.append(who)
            tokens.append(last[at - 1])
            at = at - self.length[tokens[-1]]
            more = at > first[who]
            who, at = who[more], at[more]
        owner, token = np.concatenate(owners[::-1]), np.concatenate(tokens[::-1])
        order = np.argsort(owner, kind="stable")
        flat, ends = token[order].astype("<u4").tobytes(), np.cumsum(np.bincount(owner, minlength=len(where)) * 4).tolist()
        begin = 0
        for i, end in zip(where, ends, strict=True):
            if end > begin:
                out[i] = flat[begin:end]
            begin = end
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


class KeptPieces(dict):
    """Ids of pieces met so far, within KEPT_BYTES."""

    def __init__(self, coder: PrefixCoder):
        super().__init__()
        self.coder, self.bytes = coder, 0

    def encode(self, lists: list[list[str]]) -> list[bytes]:
        """The ids of texts, given as lists of pieces."""
        if self.bytes > KEPT_BYTES:
            self.clear()
            self.bytes = 0
        new = [x for x in set().union(*lists) if x not in self]
        found = dict(zip(new, self.coder.encode_pieces([x.encode() for x in new]), strict=True))
        self.update(found)
        get = self.__getitem__
        out = [b"".join(map(get, x)) for x in lists]
        for x, ids in found.items():
            if len(x) > KEPT_PIECE:
                del self[x]
            else:
                self.bytes += ENTRY_BYTES + 4 * len(x) + len(ids)
        return out


@functools.lru_cache(maxsize=1)
def coder_of(path: str) -> tuple[PrefixCoder, KeptPieces]:
    """A worker's coder and its kept pieces, made once for all of its tasks."""
    coder = PrefixCoder(path)
    return coder, KeptPieces(coder)


class PrefixText:
    """A text with its pieces' ends and the last token of each byte prefix of each piece."""

    def __init__(self, coder: PrefixCoder, pattern: str, text: str = "", ends: list[int] | None = None, last: np.ndarray | None = None):
        self.coder, self.pattern, self.text = coder, regex.compile(pattern), text
        if ends is None:
            found = self.pattern.findall(text)
            ends = np.cumsum([len(x) for x in found]).tolist()
            last = np.concatenate([np.empty(0, dtype=np.int64), *coder.fill([x.encode() for x in found])])
        self.ends, self.last = ends, last

    def _bytes(self, upto: int) -> int:
        return len(self.text[:upto].encode())

    def ids(self) -> bytes:
        """The ids, as little-endian unsigned 32-bit integers."""
        out, at, begin = [], 0, 0
        for end in self.ends:
            piece = self.text[begin:end].encode()
            out += self.coder.ids(piece, self.last[at : at + len(piece)])
            at, begin = at + len(piece), end
        return np.array(out, dtype="<u4").tobytes()

    def append(self, more: str) -> int:
        """Adds text at the end; returns how many entries were worked out."""
        return self.edit(len(self.text), 0, more)

    def edit(self, at: int, removed: int, inserted: str) -> int:
        """Puts `inserted` in place of `removed` characters from `at` on (both cut to the text); returns how many entries were worked out.

        Pieces that end before what the edit can reach stay. The text is split anew from there until a
        piece ends where an old one did behind the edit; in the first of these pieces the
        entries before the edit are kept.
        """
        at = min(max(at, 0), len(self.text))
        stop = min(len(self.text), at + max(removed, 0))
        new = self.text[:at] + inserted + self.text[stop:]
        if new == self.text:
            return 0
        moved, old_ends = len(new) - len(self.text), set(self.ends)
        kept = int(np.searchsorted(self.ends, at - LOOKAHEAD, side="right"))
        begin = self.ends[kept - 1] if kept else 0
        ends, place, resumed = self.ends[:kept], begin, len(self.text)
        fresh: list[tuple[int, int]] = []
        while place < len(new):
            end = self.pattern.match(new, place).end()
            fresh.append((place, end))
            ends.append(end)
            place = end
            if end - moved >= stop and end >= at + len(inserted) and end - moved in old_ends:
                resumed = end - moved
                break
        first_byte, resumed_byte, edit_byte = self._bytes(begin), self._bytes(resumed), self._bytes(at)
        parts, worked, from_byte = [self.last[:first_byte]], 0, first_byte
        stop_byte = self._bytes(stop)
        # An old piece's entries help a new one of the same beginning or the same end.
        old_begin = begin
        for a, b in fresh:
            piece = new[a:b].encode()
            keep = min(max(0, edit_byte - from_byte), len(piece)) if a == old_begin and a <= at else 0
            old_end = self.ends[int(np.searchsorted(self.ends, a, side="right"))] if a == old_begin and a < len(self.text) else a
            keep = min(keep, self._bytes(old_end) - from_byte)
            tail, same = None, 0
            if b - moved == old_end and b == resumed + moved and a == old_begin:
                tail, same = self.last[from_byte:resumed_byte], resumed_byte - stop_byte
            entries, n = self.coder.extend(piece, self.last[from_byte : from_byte + keep], tail, same)
            parts.append(entries)
            worked += n
            old_begin = b if b <= at and b in old_ends else -1
            from_byte += len(piece)
        parts.append(self.last[resumed_byte:])
        ends += [e + moved for e in self.ends[int(np.searchsorted(self.ends, resumed, side="right")) :]]
        self.text, self.ends, self.last = new, ends, np.concatenate(parts)
        return worked


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: each whole text's ids as bytes of little-endian unsigned 32-bit integers.

    `ranks` is the path of the file of ranks, the same on every executor; `pattern` splits a text into pieces.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        kept, split = coder_of(ranks)[1], regex.compile(pattern).findall
        for batch in pieces(batches, "text"):
            yield {"doc_id": batch.column("doc_id"), "ids": kept.encode([split(x) for x in texts(batch)])}

    frame = id_and_text(docs, id_col, text_col)
    return map_batches(frame, work, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """doc_id, ids, decoded: the bytes that the ids stand for."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        back = coder_of(ranks)[0].decode
        for batch in pieces(batches, "ids"):
            yield {"doc_id": batch.column("doc_id"), "ids": batch.column("ids"), "decoded": [back(x) for x in texts(batch, "ids")]}

    return map_batches(encoded, work, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids binary, decoded binary")


def prefixes(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, ends, last: the state that `edited` goes on from (piece ends in characters; four bytes for each byte of text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        coder = coder_of(ranks)[0]
        for batch in pieces(batches, "text"):
            states = [PrefixText(coder, pattern, x) for x in texts(batch)]
            yield _state_columns(batch.column("doc_id"), states)

    frame = id_and_text(docs, id_col, text_col)
    return map_batches(frame, work, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, text string, ends binary, last binary")


def _state_columns(ids: pa.Array, states: list[PrefixText]) -> dict:
    return {
        "doc_id": ids,
        "text": [x.text for x in states],
        "ends": [np.array(x.ends, dtype="<u4").tobytes() for x in states],
        "last": [x.last.astype("<u4").tobytes() for x in states],
    }


def edited(state: DataFrame, edits: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """The states after one edit for each document, with ids and `worked`, the number of entries that were worked out.

    `edits` has doc_id, at, removed (characters) and inserted; an append is an edit at the text's end or past it. Documents without
    an edit stay as they are; a null in an edit counts as 0 or as empty text. Several edits of one document come as several rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        coder = coder_of(ranks)[0]
        for batch in pieces(batches, "last"):
            states, worked = [], []
            columns = [texts(batch, x) for x in ("text", "ends", "last", "inserted")]
            for text, ends, last, inserted, at, removed in zip(*columns, batch.column("at").to_pylist(), batch.column("removed").to_pylist(), strict=True):
                one = PrefixText(coder, pattern, text, np.frombuffer(ends, dtype="<u4").tolist(), np.frombuffer(last, dtype="<u4").astype(np.int64))
                worked.append(one.edit(at or 0, removed or 0, inserted))
                states.append(one)
            yield _state_columns(batch.column("doc_id"), states) | {"ids": [x.ids() for x in states], "worked": worked}

    changes = edits.select("doc_id", F.col("at").cast("bigint").alias("at"), F.col("removed").cast("bigint").alias("removed"), F.col("inserted").cast("string").alias("inserted"))
    both = state.select("doc_id", "text", "ends", "last").join(changes, "doc_id", "left")
    return map_batches(both, work, f"doc_id {state.schema['doc_id'].dataType.simpleString()}, text string, ends binary, last binary, ids binary, worked bigint")


def digests(decoded: DataFrame) -> DataFrame:
    """Counts and digests of ids and decoded bytes."""
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return digests(decode(encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path))
