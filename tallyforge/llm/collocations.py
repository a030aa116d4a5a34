"""Phrase collocations mined from bitmaps of word positions.

A shard is some megabytes of texts inside a task. Its words take positions in text order, with an
empty position between pieces, and each word (of a language) has a compressed bitmap of its positions: 64-bit blocks,
empty ones left out. A phrase's bitmap, of the positions its last word stands at, is shifted by one and
ANDed with the bitmaps of the words in the same blocks; what is left are the phrases one word longer, and popcounts are their
counts. Phrases are extended depth-first, a range of first words at a time, and an empty position stops every one.
Spark sums the popcounts over shards.

A phrase reaches the least count only if all its parts do. So words are counted first, then longer phrases by
their checksums alone (a sum over all phrases of a checksum is no less than each one's), and from each
length on a table of bits says which phrases may be frequent enough and go on. In the end those and the longest ones are counted by
their words. A table's size is fixed (GATE_BITS); what it lets through by chance only costs counting, never
correctness. A table that fills up, as the corpus grows, prunes less.

Scores are quotients of whole numbers with 38 digits. The highest-ranked phrases of a language are picked in two
steps, within hash classes first, so that no task sorts all candidates of a language.

Null texts count as empty, a null language as `und`; an empty table gives an empty result; repeated rows count
each. A very long text is cut between pieces into several shards (one piece is worked on whole). Only the two
named columns are read, so other columns' names don't matter. Ties in score and count go by the phrase's bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.batches import map_batches, texts
from tallyforge.session import materialise, table

#: Bytes of text in a shard.
SHARD_BYTES = 2 << 20
#: Bitmap blocks that are extended at a time; each meets the words of its block, 64 at most.
CHUNK = 1 << 12
#: Bits of a gate: 8 MB.
GATE_BITS = 1 << 26
#: Classes of the first step of ranking.
CLASSES = 64
UNKNOWN = "und"
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


def _parts(text: bytes) -> Iterator[bytes]:
    """A text in parts of SHARD_BYTES at most, cut behind a byte that ends a piece; longer where a piece is longer."""
    begin = 0
    while len(text) - begin > SHARD_BYTES:
        kinds = _KIND[np.frombuffer(text, dtype=np.uint8, offset=begin)]
        ends = np.flatnonzero(kinds == 2) + 1
        if not len(ends):
            break
        at = max(0, int(np.searchsorted(ends, SHARD_BYTES, side="right")) - 1)
        yield text[begin : begin + int(ends[at])]
        begin += int(ends[at])
    yield text[begin:]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[str]]]:
    """Texts with their languages, some SHARD_BYTES at a time."""
    body, langs, size = [], [], 0
    for batch in batches:
        for text, lang in zip(texts(batch), texts(batch, "lang"), strict=True):
            for part in _parts(text):
                if size and size + len(part) > SHARD_BYTES:
                    yield body, langs
                    body, langs, size = [], [], 0
                body.append(part)
                langs.append(lang)
                size += len(part) + 1
    if body:
        yield body, langs


class Shard:
    """The words of some texts: positions, and items, which are words of a language."""

    def __init__(self, body: list[bytes], langs: list[str]):
        raw = (b"\n".join(body) + b"\n").lower()
        buffer = np.frombuffer(raw, dtype=np.uint8)
        kind = _KIND[buffer]
        word = kind == 0
        edges = np.flatnonzero(word[1:] != word[:-1]) + 1
        if word[0]:
            edges = np.concatenate([[0], edges])
        starts, ends = edges[0::2], edges[1::2]
        piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
        new = np.zeros(len(starts), dtype=np.int64)
        new[1:] = piece[1:] != piece[:-1]
        self.position = np.arange(len(starts)) + np.cumsum(new)
        offsets = np.zeros(len(starts) + 1, dtype=np.int32)
        np.cumsum(ends - starts, out=offsets[1:])
        # Words keep their bytes: cutting at ASCII bytes leaves UTF-8 whole.
        found = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(buffer[word])]).dictionary_encode()
        names = sorted(set(langs))
        number = {x: i for i, x in enumerate(names)}
        sizes = np.fromiter(map(len, body), dtype=np.int64, count=len(body)) + 1
        first = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
        lang = np.repeat(np.fromiter((number[x] for x in langs), dtype=np.int64, count=len(langs)), np.diff(first))
        width = max(1, len(found.dictionary))
        items, self.item = np.unique(lang * width + found.indices.to_numpy(zero_copy_only=False), return_inverse=True)
        self.langs, self.lang_of = pa.array(names, pa.string()), items // width
        self.word_of = pa.array(items % width)
        self.words = found.dictionary
        self.count = np.bincount(self.item, minlength=len(items))

    def crcs(self) -> tuple[list[int], list[bytes]]:
        """Each item's checksum of language and word, and its word with a space before it."""
        seeds = [zlib.crc32(x.encode() + b"\0") for x in self.langs.to_pylist()]
        words = self.words.cast(pa.binary()).take(self.word_of).to_pylist()
        return [zlib.crc32(w, seeds[k]) for w, k in zip(words, self.lang_of.tolist(), strict=True)], [b" " + x for x in words]

    def rows(self, members: np.ndarray, counts: np.ndarray) -> dict:
        """Columns lang, phrase and count of phrases, given as rows of items."""
        words = [self.words.take(self.word_of.take(pa.array(x))) for x in members.T]
        return {"lang": self.langs.take(pa.array(self.lang_of[members[:, 0]])), "phrase": pc.binary_join_element_wise(*words, " "), "f": pa.array(counts.astype(np.int64))}


@dataclass
class Bitmaps:
    """Blocks of items' bitmaps, by block and then item; `first`: where each block begins."""

    block: np.ndarray
    item: np.ndarray
    mask: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, position: np.ndarray, item: np.ndarray) -> Bitmaps:
        block, bit = position >> 6, np.uint64(1) << (position & 63).astype(np.uint64)
        order = np.lexsort((item, block))
        block, item, bit = block[order], item[order], bit[order]
        new = np.ones(len(block), dtype=bool)
        new[1:] = (block[1:] != block[:-1]) | (item[1:] != item[:-1])
        at = np.flatnonzero(new)
        mask = np.bitwise_or.reduceat(bit, at) if len(at) else bit
        block, item = block[at], item[at]
        first = np.searchsorted(block, np.arange((int(block[-1]) if len(block) else 0) + 3))
        return cls(block, item, mask, first)

    def follow(self, node: np.ndarray, block: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """node, item, block and mask of what follows the bits: these shifted by one position, ANDed with each item of the block."""
        over = np.flatnonzero(mask >> np.uint64(63))
        node, block = np.concatenate([node, node[over]]), np.concatenate([block, block[over] + 1])
        mask = np.concatenate([mask << np.uint64(1), np.ones(len(over), dtype=np.uint64)])
        low = self.first[block]
        counts = self.first[block + 1] - low
        who = np.repeat(np.arange(len(node)), counts)
        entry = np.arange(len(who)) + np.repeat(low - np.cumsum(counts) + counts, counts)
        both = mask[who] & self.mask[entry]
        hit = np.flatnonzero(both)
        who, entry = who[hit], entry[hit]
        return node[who], self.item[entry], block[who], both[hit]


class Mining:
    """A shard's bitmaps on their way through phrases; methods and no nested functions, which would name each other and so keep every shard until a collection of garbage."""

    def __init__(self, shard: Shard, size: int, gates: list[np.ndarray], sums_only: bool):
        self.size, self.gates, self.sums_only = size, gates, sums_only
        self.crc, self.spaced = shard.crcs()
        held = self.opens(0, self.crc)[shard.item]
        self.maps = Bitmaps.of(shard.position[held], shard.item[held])
        self.n_items = len(shard.count)

    def opens(self, k: int, sums: list[int]) -> np.ndarray:
        """Which checksums the gate of phrases of k + 1 words lets through."""
        at = np.array(sums, dtype=np.int64) % GATE_BITS
        return (self.gates[k][at >> 3] >> (at & 7)) & 1 > 0

    def phrases(self) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
        maps, order = self.maps, np.argsort(self.maps.item, kind="stable")
        yield from self.ranges(np.arange(self.n_items)[:, None], self.crc, maps.item[order], maps.block[order], maps.mask[order])

    def ranges(self, members: np.ndarray, sums: list[int], node: np.ndarray, block: np.ndarray, mask: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
        for begin in range(0, len(node), CHUNK):
            part = slice(begin, begin + CHUNK)
            low, high = int(node[part][0]), int(node[part][-1]) + 1
            yield from self.extend(members[low:high], sums[low:high], node[part] - low, block[part], mask[part])

    def extend(self, members: np.ndarray, sums: list[int], node: np.ndarray, block: np.ndarray, mask: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
        """Phrases that begin with those of `members`; entries (node, block, mask) are the bitmaps."""
        crc, spaced = self.crc, self.spaced
        parent, item, block, mask = self.maps.follow(node, block, mask)
        codes, node = np.unique(parent * self.n_items + item, return_inverse=True)
        parent, item = codes // self.n_items, codes % self.n_items
        members = np.hstack([members[parent], item[:, None]])
        length = members.shape[1]
        counts = np.bincount(node, weights=np.bitwise_count(mask), minlength=len(codes))
        if length == self.size:
            if self.size > 2:
                # The first words have been let through on the way; now all but the first.
                tails = [crc[x] for x in members[:, 1].tolist()]
                for column in members[:, 2:].T:
                    tails = [zlib.crc32(spaced[x], s) for x, s in zip(column.tolist(), tails, strict=True)]
                good = self.opens(self.size - 2, tails)
                members, counts, item, parent = members[good], counts[good], item[good], parent[good]
            yield members, counts, [zlib.crc32(spaced[x], sums[p]) for x, p in zip(item.tolist(), parent.tolist(), strict=True)] if self.sums_only else []
            return
        sums = [zlib.crc32(spaced[x], sums[p]) for x, p in zip(item.tolist(), parent.tolist(), strict=True)]
        good = self.opens(length - 1, sums)
        if not self.sums_only:
            yield members[good], counts[good], []
        rest = np.flatnonzero(good[node])
        # Entries by node again, so that a range of them is a range of phrases.
        rest = rest[np.argsort(node[rest], kind="stable")]
        yield from self.ranges(members, sums, node[rest], block[rest], mask[rest])


def mine(shard: Shard, size: int, gates: list[np.ndarray], sums_only: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
    """(items of phrases, counts, checksums) of the shard's phrases of 2 to `size` words that the gates let through.

    gates[k] is for phrases of k + 1 words; of the longest phrases, which have no gate, all parts are let through. `sums_only`:
    just the longest ones; else their checksums are left out. A phrase may come in several parts, whose counts add up.
    """
    yield from Mining(shard, size, gates, sums_only).phrases()


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, phrase, f of all words; all words of a language together under phrase null."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for shard in (Shard(*x) for x in _shards(batches)):
            yield shard.rows(np.arange(len(shard.count))[:, None], shard.count)
            totals = np.bincount(shard.lang_of, weights=shard.count, minlength=len(shard.langs)).astype(np.int64)
            yield {"lang": shard.langs, "phrase": [None] * len(totals), "f": totals}

    return map_batches(docs, work, "lang string, phrase string, f bigint").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def sum_counts(docs: DataFrame, size: int, gates: list) -> DataFrame:
    """crc, f: how many phrases of `size` words that the gates (broadcast tables) let through have a checksum."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        tables = [np.frombuffer(x.value, dtype=np.uint8) for x in gates]
        for shard in (Shard(*x) for x in _shards(batches)):
            for _, counts, sums in mine(shard, size, tables, sums_only=True):
                yield {"crc": np.array(sums, dtype=np.uint32).view(np.int32), "f": counts.astype(np.int64)}

    return map_batches(docs, work, "crc int, f bigint").groupBy("crc").agg(F.sum("f").alias("f")).select(F.expr("crc & 4294967295L").alias("crc"), "f")


def counted(docs: DataFrame, size: int, gates: list) -> DataFrame:
    """lang, phrase, f: how often each phrase of 2 to `size` words that the gates (broadcast tables) let through occurs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        tables = [np.frombuffer(x.value, dtype=np.uint8) for x in gates]
        for shard in (Shard(*x) for x in _shards(batches)):
            for members, counts, _ in mine(shard, size, tables):
                yield shard.rows(members, counts)

    return map_batches(docs, work, "lang string, phrase string, f bigint").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def gate_of(sums: DataFrame) -> bytes:
    """GATE_BITS bits, set where a checksum of column `crc` falls."""
    found = sums.select((F.col("crc") % GATE_BITS + 1).alias("bit"))
    out = bytearray(GATE_BITS // 8)
    for number, bits in found.groupBy(F.bitmap_bucket_number("bit").alias("number")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit"))).collect():
        out[(number - 1) * len(bits) : number * len(bits)] = bits
    return bytes(out)


def phrase_counts(docs: DataFrame, longest: int = 3, least: int = 10, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """lang, phrase, f of the words and of the phrases of 2 to `longest` words that occur `least` times; with the words, all words of a language under phrase null."""
    context = docs.sparkSession.sparkContext
    read = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).cast("string").cast("binary").alias("text"))
    words = materialise(word_counts(read).where((F.col("f") >= least) | F.col("phrase").isNull()), "words")
    known = words.where(F.col("phrase").isNotNull()).select(F.crc32(F.concat("lang", F.lit("\0"), "phrase").cast("binary")).alias("crc"))
    gates = [context.broadcast(gate_of(known))]
    for size in range(2, longest):
        gates.append(context.broadcast(gate_of(sum_counts(read, size, gates).where(F.col("f") >= least))))
    return words, materialise(counted(read, longest, gates).where(F.col("f") >= least), "phrases")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, top: int = 2_000, covers: int = 50, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each language's first `top` phrases of 2 to `longest` words: lang, rank, phrase, a, l, r, n, score.

    A phrase's score is that of its weakest cut; phrases inside a longer candidate that has at least `covers` per cent of their
    count are dropped.
    """
    words, found = phrase_counts(docs, longest, least, text_col, lang_col)
    known = words.where(F.col("phrase").isNotNull()).unionByName(found)
    phrases = found.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    parts = phrases.where(F.size("words") > 2).select(
        "lang", "a", F.explode(F.expr("flatten(transform(sequence(2, size(words) - 1), m -> transform(sequence(1, size(words) - m + 1), i -> array_join(slice(words, i, m), ' '))))")).alias("phrase")
    )
    covered = parts.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = phrases.join(covered, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * covers)).select("lang", "phrase", "a", "words")
    cuts = kept.select(
        "lang", "phrase", "a", F.expr("explode(transform(sequence(1, size(words) - 1), k -> struct(k AS k, array_join(slice(words, 1, k), ' ') AS left, array_join(slice(words, k + 1, size(words)), ' ') AS right))) AS cut")
    ).select("lang", "phrase", "a", "cut.*")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    exact = {x: f"CAST({x} AS decimal(19,0))" for x in "alr"}
    score = F.expr(f"(CAST(1000000 AS decimal(7,0)) * ({exact['a']} * {exact['a']})) div ({exact['l']} * {exact['r']})")
    scored = cuts.groupBy("lang", "phrase").agg(F.min("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    scored = scored.select("lang", "phrase", "a", "cut.score", "cut.l", "cut.r")
    order = F.desc("score"), F.desc("a"), F.asc("phrase")
    classes = Window.partitionBy("lang", F.crc32(F.col("phrase").cast("binary")) % CLASSES).orderBy(*order)
    some = scored.withColumn("rank", F.row_number().over(classes)).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    totals = words.where(F.col("phrase").isNull()).select("lang", F.col("f").alias("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM pieces),
grams AS (
  SELECT lang, 1 AS k, unnest(ws) AS phrase FROM worded
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM worded WHERE len(ws) >= 2
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM worded WHERE len(ws) >= 3),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
cands AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM counts WHERE k >= 2 AND f >= 10),
inside AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, ws[1] || ' ' || ws[2] AS phrase FROM cands WHERE k = 3
    UNION ALL SELECT lang, a, ws[2] || ' ' || ws[3] FROM cands WHERE k = 3) GROUP BY ALL),
kept AS (SELECT c.* FROM cands c LEFT JOIN inside i ON i.lang = c.lang AND i.phrase = c.phrase WHERE i.longer IS NULL OR 100 * i.longer < 50 * c.a),
cuts AS (
  SELECT lang, phrase, a, 1 AS cut, ws[1] AS lhs, CASE WHEN k = 2 THEN ws[2] ELSE ws[2] || ' ' || ws[3] END AS rhs FROM kept
  UNION ALL SELECT lang, phrase, a, 2, ws[1] || ' ' || ws[2], ws[3] FROM kept WHERE k = 3),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, ((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.lhs JOIN counts y ON y.lang = c.lang AND y.phrase = c.rhs),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest)
SELECT r.lang, r.rank::BIGINT AS rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
