"""Fuzzy line deduplication by MinHash.

Lines (split at newlines, A-Z lower-cased, white space runs made one space, ends trimmed) are sets
of WIDTH-character shingles; a shorter line is one shingle. Each distinct line gets a signature of
BANDS x ROWS minima, whose bands find candidates: two lines of Jaccard similarity s share a band
with probability 1 - (1 - s**5)**16, which is over 0.998 from s = 0.8 on. Lines that share a bucket
and have a similarity of 0.8 or more are linked, by exact comparison. Of each component of links the
first line (least doc_id, then place) stays.

No bucket is expanded into its pairs. The line of a bucket that meets the most others leads it; lines
near their leader are kept as differences from it, and buckets then list families and not lines
(see `ngram_join.decided`). So a large bucket costs a comparison for each line and what its
families have to settle among them, and all its pairs are decided.

Bands move only where their hash recurs: 32-bit halves are counted first. A line that several tasks
have signed counts once.

Blank lines stay. Null text has no lines. Lines of rows with a null id come after all others.
Repeated rows are separate documents, so the second one's lines go. An empty table gives an empty
result. A very long text is held whole by the task that reads it, a very long line by those that
compare it. Only id and text are read, so other columns' names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.batches import map_batches, pieces, texts
from tallyforge.llm.components import connected_components
from tallyforge.llm.ngram_join import MOST_HALVES, _small, decided, repeated_halves, rooted, sorted_halves
from tallyforge.session import materialise, table

WIDTH = 8
BANDS, ROWS = 16, 5
#: Up to so many ids of lines (32 MB) go to all tasks; more are met by shuffling.
MOST_IDS = 4_000_000
#: Lines a task remembers having signed.
KEPT = 500_000
BLOCK = 1 << 16
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(20)
_MULTIPLY = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_TURN = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def normal_lines(text: str) -> list[str]:
    """The text's lines in the form that is compared; "" for blank ones."""
    return [" ".join(x.split()) for x in text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass").split("\n")]


def line_id(line: str) -> int:
    """A signed 64-bit hash of a line's compared form."""
    return xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)


def _shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the windows of all lines, one after another; where each line's begin and end."""
    padded = [x if len(x) >= WIDTH else x + chr(0) * (WIDTH - len(x)) for x in lines]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, padded), dtype=np.int64, count=len(padded))
    begin = np.cumsum(sizes) - sizes
    hashes = np.zeros(len(codes) - WIDTH + 1, dtype=np.uint64)
    for k in range(WIDTH):
        hashes = hashes * np.uint64(0x100000001B3) + codes[k : len(codes) - WIDTH + 1 + k]
    hashes *= _PRIME
    hashes ^= hashes >> np.uint64(29)
    hashes *= _PRIME
    return hashes, begin, begin + sizes - WIDTH + 1


def band_keys(lines: list[str]) -> np.ndarray:
    """(lines, BANDS) bucket keys."""
    out = np.empty((len(lines), BANDS), dtype=np.int64)
    at = 0
    while at < len(lines):
        end, size = at, 0
        while end < len(lines) and (end == at or size + len(lines[end]) <= BLOCK):
            size += len(lines[end])
            end += 1
        hashes, begin, stop = _shingle_hashes(lines[at:end])
        short = np.append((hashes >> np.uint64(32)).astype(np.uint32), np.uint32(0xFFFFFFFF))
        places = np.stack([begin, np.minimum(stop, len(short) - 1)], axis=1).ravel()
        # The odd segments lie between lines; the last one's end is the appended value.
        rows, turned = [], np.empty_like(short)
        for times, turn in zip(_MULTIPLY, _TURN, strict=True):
            np.bitwise_xor(short, turn, out=turned)
            np.multiply(turned, times, out=turned)
            rows.append(np.minimum.reduceat(turned, places)[::2])
        for band in range(BANDS):
            key = np.full(end - at, np.uint64(band + 1))
            for row in rows[band * ROWS : (band + 1) * ROWS]:
                key = (key ^ row.astype(np.uint64)) * _PRIME
                key ^= key >> np.uint64(29)
            out[at:end, band] = key.view(np.int64)
        at = end
    return out


def signed_lines(frame: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For (row, doc_id, text): each row's line ids (null: blank), and (id, keys) of lines, repeated at most once for each task's forgetting."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen: set[int] = set()
        for batch in pieces(batches, "text"):
            if len(seen) > KEPT:
                seen.clear()
            ids, new = [], {}
            for text in texts(batch):
                mine = []
                for line in normal_lines(text) if text else []:
                    mine.append(line_id(line) if line else None)
                    if line and mine[-1] not in seen:
                        seen.add(mine[-1])
                        new[mine[-1]] = line
                ids.append(mine)
            n = len(ids)
            yield {"row": batch.column("row"), "doc_id": batch.column("doc_id"), "ids": ids, "id": [None] * n, "keys": [None] * n}
            some = list(new)
            keys = band_keys(list(new.values())) if new else np.empty((0, BANDS))
            nothing = [None] * len(some)
            yield {"row": nothing, "doc_id": nothing, "ids": nothing, "id": some, "keys": list(keys)}

    kind = frame.schema["doc_id"].dataType.simpleString()
    both = materialise(map_batches(frame, work, f"row bigint, doc_id {kind}, ids array<bigint>, id bigint, keys array<bigint>"), "signatures")
    return both.where("id is null").select("row", "doc_id", "ids"), both.where("id is not null").select("id", "keys")


def _texts_of(frame: DataFrame, chosen: DataFrame) -> DataFrame:
    """(id, line) of the chosen lines (written before)."""
    few = chosen.count() <= MOST_IDS
    # Tasks get the ids if they are few, so that only chosen lines leave them.
    shared = frame.sparkSession.sparkContext.broadcast(np.sort(chosen.toArrow().column("id").to_numpy()) if few else None)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        known = shared.value
        for batch in pieces(batches, "text"):
            new = {line_id(x): x for text in texts(batch) for x in normal_lines(text) if x}
            ids, lines = np.fromiter(new, dtype=np.int64, count=len(new)), list(new.values())
            if known is not None:
                some = np.flatnonzero(known[np.minimum(np.searchsorted(known, ids), len(known) - 1)] == ids) if len(known) else []
                ids, lines = ids[some], [lines[i] for i in some]
            yield {"id": ids, "line": lines}

    lines = map_batches(frame.select("text"), work, "id bigint, line string")
    lines = lines if few else lines.join(chosen, "id", "left_semi")
    return lines.groupBy("id").agg(F.first("line").alias("line"))


def line_arrays(lines: list[bytes]) -> list[np.ndarray]:
    """Shingle hashes of lines in their compared form, as the exact join takes them."""
    out, at = [], 0
    while at < len(lines):
        end, size = at, 0
        while end < len(lines) and (end == at or size + len(lines[end]) <= BLOCK):
            size += len(lines[end])
            end += 1
        hashes, begin, stop = _shingle_hashes([x.decode("utf-8", "surrogatepass") for x in lines[at:end]])
        hashes = hashes.view(np.int64)
        for a, b in zip(begin.tolist(), stop.tolist(), strict=True):
            own = np.sort(hashes[a:b])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        at = end
    return out


def _once(signed: DataFrame) -> DataFrame:
    """(id, keys) with each id once; only those that several rows have are shuffled."""
    again = materialise(signed.groupBy("id").count().where("count > 1").select("id"), "again", small=True)
    again = _small(again)
    return signed.join(again, "id", "left_anti").unionByName(signed.join(again, "id", "left_semi").dropDuplicates(["id"]))


def _entries(signed: DataFrame) -> DataFrame:
    """(id, key, n): the bands of buckets with several lines, n of them."""
    halves = repeated_halves(signed, "keys")
    if halves.count() <= MOST_HALVES:
        shared = signed.sparkSession.sparkContext.broadcast(sorted_halves(halves))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            known = shared.value
            for batch in batches:
                keys = batch.column("keys").flatten().to_numpy()
                half = (keys & 0x7FFFFFFF).astype(np.int32)
                keep = known[np.minimum(np.searchsorted(known, half), len(known) - 1)] == half if len(known) else np.zeros(len(half), dtype=bool)
                yield {"id": np.repeat(batch.column("id").to_numpy(), BANDS)[keep], "key": keys[keep]}

        entries = map_batches(signed.select("id", "keys"), work, "id bigint, key bigint")
    else:
        entries = signed.select("id", F.explode("keys").alias("key"))
    entries = materialise(entries, "bands")
    sizes = materialise(entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes", small=True)
    return materialise(entries.join(_small(sizes), "key"), "buckets")


def line_links(frame: DataFrame, signed: DataFrame) -> DataFrame:
    """Links (a, b) between similar lines, enough of them to connect every component."""
    buckets = _entries(_once(signed))
    weights = materialise(buckets.groupBy("id").agg((-F.sum("n")).alias("less")), "weights", small=True)
    ranked = buckets.join(_small(weights), "id")
    leaders = ranked.groupBy("key").agg(F.min(F.struct("less", "id")).alias("head")).select("key", F.col("head.id").alias("leader"))
    star = rooted(ranked.join(leaders, "key").where("id <> leader").select(F.col("id").alias("doc"), "leader"))
    lines = materialise(_texts_of(frame, weights.select("id")), "texts")

    def meet(members: DataFrame) -> DataFrame:
        heads = buckets.join(_small(members.withColumnRenamed("doc", "id")), "id", "left").select("key", F.coalesce("leader", "id").alias("head")).distinct()
        heads = materialise(heads, "heads")
        one, other = heads.select("key", F.col("head").alias("a")), heads.select("key", F.col("head").alias("b"))
        return materialise(one.join(other, "key").where("a < b").select("a", "b").distinct(), "meetings", small=True)

    def wholes(ids: DataFrame) -> DataFrame:
        return lines.join(_small(ids.withColumnRenamed("doc_id", "id")), "id", "left_semi").select(F.col("id").alias("doc"), F.col("line").cast("binary").alias("hashes"))

    return materialise(decided(star, meet, wholes, line_arrays)[0], "found", small=True)


def line_decisions(frame: DataFrame) -> DataFrame:
    """For (row, doc_id, text) with distinct rows: row, doc_id, n_lines, dropped (places of the lines that go, from 0)."""
    rows, signed = signed_lines(frame)
    parts = connected_components(line_links(frame, signed)).select(F.col("node").alias("id"), "component")
    places = rows.select("row", "doc_id", F.posexplode("ids").alias("place", "id")).where("id is not null")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "place")
    firsts = materialise(places.groupBy("id").agg(F.min(rank).alias("first")).join(parts, "id", "left").withColumn("component", F.coalesce("component", "id")), "firsts")
    best = firsts.groupBy("component").agg(F.min("first").alias("best"))
    stays = firsts.join(best, "component").select("id", F.col("best.row").alias("best_row"), F.col("best.place").alias("best_place"))
    gone = places.join(stays, "id").where("not (row = best_row and place = best_place)").groupBy("row").agg(F.sort_array(F.collect_list("place")).alias("dropped"))
    return rows.join(gone, "row", "left").select("row", "doc_id", F.size("ids").cast("bigint").alias("n_lines"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def drop_similar_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with each text's dropped lines cut out; null texts stay null, other columns unchanged."""
    held = materialise(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    found = line_decisions(held.select(F.col("__row").alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    found = found.select(F.col("row").alias("__row"), F.col("dropped").alias("__dropped"))
    kept = F.filter(F.split(text_col, "\n", -1), lambda x, i: ~F.array_contains("__dropped", i))
    return held.join(found, "__row").withColumn(text_col, F.when(F.size("__dropped") > 0, F.array_join(kept, "\n")).otherwise(F.col(text_col))).select(*docs.columns)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_decisions(numbered(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_lines", (F.col("n_lines") - F.size("dropped")).alias("n_kept"), "dropped")
