"""Exact Jaccard self-join on word shingles with set-relation skipping, and its components.

Documents with equal shingle sets are one set with one representative (the least id). A set's
shingles are ordered by how often they occur (a count sketch over all documents, of a fixed
size; the order decides only cost), then by hash. Two sets that link share a shingle among the
first n/5 + 1 of the larger and the first n/9 + 1 of the smaller one, so inverted lists of these
prefixes, with positions and sizes, hold every link.

Families: each list block has a leader, the set with the fewest shingles of its own. A set whose
leader (followed to its root) shares half of their union with it is kept as two differences: the
root's shingles that it lacks, and those that it has besides. With signed differences D,
    |a & b| = |p & q| + D(a) . q + p . D(b) + D(a) . D(b)
for sets a and b of families with roots p and q. So all answers of a family follow from its
root's answers and from the differences, which are short.

Skipping in lists: list entries of one family are one entry, blocks of sizes that can't link don't
meet, and two families meet only where the positions leave enough shingles. So a list costs by
its families, not by its members. Then the roots are compared, and a pair of families is done with
where the largest differences couldn't make up for what the roots lack.

Members are compared in units of at most UNIT sets or DIFFERENCES differing shingles: a task takes
two units and gives the number of links of each set and enough links to connect what links; pairs
are never rows. In families of more than one unit, sets are in levels by s = 5 * |p - a| + 4 * |a - p|;
a and b surely link if s(a) + s(b) <= |p|, so pairs of levels that ensure it are only counted.

Null and empty texts have no shingles and link with nothing. Rows with a null id get a null
component unless a row with an id has the same set. Repeated rows have equal results. An id with
several texts stands for each of them. An empty table gives an empty result. A very long text is
one large set, held whole by the task that reads it. Only id and text columns are read, so other
columns' names don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.batches import give_back, id_and_text, map_batches, pieces, texts
from tallyforge.llm.components import connected_components
from tallyforge.llm.shingles import set_key, shingle_arrays
from tallyforge.session import discard, materialise, table

#: Counters of the sketch (2**bits); more of them tell rare shingles from common ones in a larger corpus.
SKETCH_BITS = 24
#: Lists with more entries than this in a first index have their shingle moved to the end of the order.
LONG_LIST = 32
#: How many such shingles there are at most; tasks get them as 32-bit halves of hashes.
MOST_LONG = 2_000_000
#: Up to so many halves of repeated shingles (32 MB) go to all tasks; more are met by shuffling.
MOST_HALVES = 8_000_000
CHUNK = 1 << 14
#: Halves are counted in 2**RANGE_BITS ranges; so many are held at a time.
RANGE_BITS, RANGE_ROOM = 9, 1 << 20
#: Estimated bytes of an id list that is broadcast; larger ones are joined by shuffling.
BROADCAST_BYTES = 64 << 20
#: Bytes that a broadcast hash table takes for a column of a row, about, besides a string's own.
ROW_BYTES = 80
#: Sets and differing shingles of a unit, but for a single larger set.
UNIT = 512
DIFFERENCES = 250_000
#: Levels of s in a family of several units.
LEVELS = 8
#: Shingles of a block of the matrices that units are compared by.
SPAN = 4_096


#: Makes sorted distinct 64-bit hashes of each UTF-8 text, or of each set as it is stored.
Arrays = Callable[[list[bytes]], list[np.ndarray]]


def stored_arrays(raw: list[bytes]) -> list[np.ndarray]:
    """Sets that are stored as their hashes' bytes."""
    return [np.frombuffer(x, dtype=np.int64) for x in raw]


def _small(ids: DataFrame) -> DataFrame:
    """`ids` (written before), marked for broadcast if its estimated bytes are within BROADCAST_BYTES."""
    wide = [F.coalesce(F.length(x.name), F.lit(0)) for x in ids.schema if x.dataType.simpleString() == "string"]
    size = ids.agg(F.coalesce(F.sum(sum(wide, F.lit(ROW_BYTES * len(ids.columns)))), F.lit(0))).first()[0]
    return F.broadcast(ids) if size <= BROADCAST_BYTES else ids


def shingle_sets(docs: DataFrame, bits: int = SKETCH_BITS, arrays: Arrays = shingle_arrays) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n_shingles, key) of every row, and the sketch's frequency level of each hash bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        counts = np.zeros(1 << bits, dtype=np.uint16)
        for batch in pieces(batches, "text"):
            sets = arrays(texts(batch))
            for start in range(0, len(sets), 256):
                held = np.concatenate(sets[start : start + 256])
                np.add.at(counts, (held.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64), np.uint16(1))
            n = len(sets)
            yield {"doc_id": batch.column("doc_id"), "n_shingles": [len(x) for x in sets], "key": [set_key(x) for x in sets], "chunk": [None] * n, "counts": [None] * n}
        if counts.any():
            for begin in range(0, 1 << bits, CHUNK):
                packed = zlib.compress(counts[begin : begin + CHUNK].tobytes(), 1)
                yield {"doc_id": [None], "n_shingles": [0], "key": [None], "chunk": [begin // CHUNK], "counts": [packed]}

    kind = docs.schema["doc_id"].dataType.simpleString()
    both = materialise(map_batches(docs, work, f"doc_id {kind}, n_shingles bigint, key string, chunk int, counts binary"), "sets")
    rows = both.where("chunk is null").select("doc_id", "n_shingles", "key")
    rows.materialised_at = both.materialised_at
    return rows, _levels(both.where("chunk is not null").select("chunk", "counts"), bits)


def _levels(chunks: DataFrame, bits: int) -> np.ndarray:
    """Sums the tasks' counters chunk by chunk; a counter's level grows with its logarithm."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, packed in zip(batch.column("chunk").to_pylist(), texts(batch, "counts"), strict=True):
                counts = np.frombuffer(zlib.decompress(packed), dtype=np.uint16)
                sums[chunk] = sums[chunk] + counts if chunk in sums else counts.astype(np.uint64)
        for chunk, counts in sums.items():
            # 4 * log2 of a counter, as a byte: the order needs no more.
            yield {"chunk": [chunk], "levels": [zlib.compress((4 * np.log2(counts + 1)).astype(np.uint8).tobytes(), 1)]}

    levels = np.zeros(1 << bits, dtype=np.uint8)
    # One row for each chunk of the fixed-size sketch.
    for row in map_batches(chunks.repartition("chunk"), add, "chunk int, levels binary").toLocalIterator():
        found = np.frombuffer(zlib.decompress(bytes(row["levels"])), dtype=np.uint8)
        levels[row["chunk"] * CHUNK : row["chunk"] * CHUNK + len(found)] = found
    return levels


def prefixes(docs: DataFrame, levels: np.ndarray, long: np.ndarray | None = None, arrays: Arrays = shingle_arrays) -> DataFrame:
    """(doc, n, prefix): each set's size and its first n/5 + 1 shingles, rare ones first.

    Shingles whose halves are in `long` (sorted) come after all others.
    """
    shared, bits = docs.sparkSession.sparkContext.broadcast((levels, long)), int(len(levels)).bit_length() - 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        levels, long = shared.value
        for batch in pieces(batches, "text"):
            sizes, out = [], []
            for hashes in arrays(texts(batch)):
                rank = levels[hashes.view(np.uint64) >> np.uint64(64 - bits)]
                if long is not None and len(long):
                    half = (hashes & 0x7FFFFFFF).astype(np.int32)
                    at = np.minimum(np.searchsorted(long, half), len(long) - 1)
                    rank = np.where(long[at] == half, np.uint8(255), rank)
                order = np.argsort(rank, kind="stable")
                sizes.append(len(hashes))
                out.append(hashes[order[: len(hashes) // 5 + 1]])
            yield {"doc": batch.column("doc_id"), "n": sizes, "prefix": out}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs, work, f"doc {kind}, n bigint, prefix array<bigint>")


def repeated_halves(heads: DataFrame, column: str = "prefix") -> DataFrame:
    """(half, count): the 32-bit halves that more than one of the lists' hashes have.

    Halves move as bytes by ranges of them; a range is counted in an array of a fixed size, whatever the input.
    """
    width = 1 << (31 - RANGE_BITS)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held, size = [], 0

        def out() -> dict:
            halves = np.sort(np.concatenate(held))
            cuts = np.searchsorted(halves, np.arange(1, 1 << RANGE_BITS) * width)
            some = [(k, x.tobytes()) for k, x in enumerate(np.split(halves, cuts)) if len(x)]
            held.clear()
            return {"range": [k for k, _ in some], "halves": [x for _, x in some]}

        for batch in batches:
            held.append((batch.column(column).flatten().to_numpy() & 0x7FFFFFFF).astype(np.int32))
            size += len(held[-1])
            if size > RANGE_ROOM:
                yield out()
                size = 0
        if size:
            yield out()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now, held, size, counts = None, [], 0, None

        def add() -> tuple[np.ndarray, np.ndarray]:
            return np.unique(np.concatenate(held), return_counts=True)

        def out() -> dict:
            if counts is None:
                halves, n = add()
            else:
                at, n = add()
                counts[at - now * width] += n
                halves = np.flatnonzero(counts > 1)
                halves, n = (halves + now * width).astype(np.int32), counts[halves]
            return {"half": halves[n > 1], "count": n[n > 1]}

        for batch in batches:
            for k, raw in zip(batch.column("range").to_pylist(), batch.column("halves").to_pylist(), strict=True):
                if k != now:
                    if held:
                        yield out()
                    now, held, size, counts = k, [], 0, None
                held.append(np.frombuffer(raw, dtype=np.int32))
                size += len(held[-1])
                if size > RANGE_ROOM:
                    counts = np.zeros(width, dtype=np.int64) if counts is None else counts
                    at, n = add()
                    counts[at - now * width] += n
                    held, size = [held[-1][:0]], 0
        if held:
            yield out()

    ranges = map_batches(heads.select(column), split, "range int, halves binary")
    return materialise(map_batches(ranges.repartition("range").sortWithinPartitions("range"), count, "half int, count bigint"), "twice")


def _long_lists(halves: DataFrame) -> np.ndarray:
    """Halves of the shingles in more than LONG_LIST lists' entries, sorted.

    Entries over `limit` bound how many there can be, so a limit that keeps them within MOST_LONG
    always exists; the least power of two of them is taken.
    """
    sizes = halves.where(F.col("count") > LONG_LIST).groupBy(F.floor(F.log2("count")).cast("int").alias("power")).agg(F.count("*").alias("n")).collect()
    limit, kept = LONG_LIST, sum(r["n"] for r in sizes)
    for row in sorted(sizes, key=lambda r: r["power"]):
        if kept <= MOST_LONG:
            break
        limit, kept = 2 ** (row["power"] + 1) - 1, kept - row["n"]
    return sorted_halves(halves.where(F.col("count") > limit))


def sorted_halves(halves: DataFrame) -> np.ndarray:
    """The halves as a sorted array; their number is bounded by the caller."""
    found = np.sort(halves.select("half").toArrow().column("half").to_numpy().astype(np.int32))
    give_back()
    return found


def live_entries(heads: DataFrame, halves: np.ndarray) -> DataFrame:
    """(doc, n, spare, pos, token) of the prefixes' shingles whose halves are in `halves` (sorted); `spare` is the number of the others."""
    shared = heads.sparkSession.sparkContext.broadcast(halves)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        known = shared.value
        for batch in batches:
            lists = batch.column("prefix")
            tokens = lists.flatten().to_numpy()
            sizes = np.diff(lists.offsets.to_numpy())
            half = (tokens & 0x7FFFFFFF).astype(np.int32)
            keep = known[np.minimum(np.searchsorted(known, half), len(known) - 1)] == half if len(known) else np.zeros(len(half), dtype=bool)
            row = np.repeat(np.arange(len(sizes)), sizes)
            pos = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            spare = (sizes - np.bincount(row[keep], minlength=len(sizes)))[row[keep]]
            row, at = pa.array(row[keep]), pos[keep].astype(np.int32)
            yield {"doc": batch.column("doc").take(row), "n": batch.column("n").take(row), "spare": spare, "pos": at, "token": tokens[keep]}

    kind = heads.schema["doc"].dataType.simpleString()
    return map_batches(heads, work, f"doc {kind}, n bigint, spare bigint, pos int, token bigint")


def _whole_sets(docs: DataFrame, arrays: Arrays = shingle_arrays) -> DataFrame:
    """(doc, hashes): whole sets as bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in pieces(batches, "text"):
            yield {"doc": batch.column("doc_id"), "hashes": [x.tobytes() for x in arrays(texts(batch))]}

    return map_batches(docs, work, f"doc {docs.schema['doc_id'].dataType.simpleString()}, hashes binary")


def _within(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of x are in y (sorted)."""
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x if len(y) else np.zeros(len(x), dtype=bool)


def overlaps(pairs: DataFrame, sets: DataFrame, decode: Arrays = stored_arrays, differences: bool = False) -> DataFrame:
    """(a, b, na, nb, both): sizes and intersections of pairs of sets; `differences` adds the sorted shingles `lost` (in a alone) and `gained` (in b alone) as bytes.

    `sets` has (doc, hashes), which `decode` makes sets of.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in pieces(batches, "ha"):
            out: dict[str, list] = {x: [] for x in ("na", "nb", "both", "lost", "gained")}
            for x, y in zip(decode(texts(batch, "ha")), decode(texts(batch, "hb")), strict=True):
                same = _within(x, y)
                for name, value in zip(out, (len(x), len(y), int(same.sum()), None, None), strict=True):
                    out[name].append(value)
                if differences:
                    out["lost"][-1], out["gained"][-1] = x[~same].tobytes(), y[~_within(y, x)].tobytes()
            yield {"a": batch.column("a"), "b": batch.column("b")} | out

    kind = pairs.schema["a"].dataType.simpleString()
    side = lambda x: sets.select(F.col("doc").alias(x), F.col("hashes").alias(f"h{x}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ha", "hb")
    found = map_batches(joined, work, f"a {kind}, b {kind}, na bigint, nb bigint, both bigint, lost binary, gained binary")
    return found if differences else found.drop("lost", "gained")


#: 100 * both >= 80 * (na + nb - both)
LINKED = "9 * both >= 4 * (na + nb)"
#: A root and a set of its family share half of their union.
OF_FAMILY = "3 * both >= na + nb"


def _blocks(index: DataFrame) -> DataFrame:
    """Adds the size block: sizes within a block, or of neighbouring blocks, may link; others can't."""
    return index.withColumn("block", F.floor(F.log("n") / F.lit(float(np.log(1.25)))).cast("int"))


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = SKETCH_BITS, arrays: Arrays = shingle_arrays) -> tuple[DataFrame, DataFrame]:
    """Rows with their representatives (doc_id, n_shingles, rep), and verified links (a, b) between
    representatives, enough of them to connect every component.

    `arrays` makes the sets; five-word shingles if not given."""
    rows, edges, _ = _answers(docs, id_col, text_col, bits, arrays, False)
    return rows, edges


def all_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = SKETCH_BITS, arrays: Arrays = shingle_arrays) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What links() gives, and the number of links (rep, n_links) of each representative that has any: all pairs of different sets are decided."""
    return _answers(docs, id_col, text_col, bits, arrays, True)


def _answers(docs: DataFrame, id_col: str, text_col: str, bits: int, arrays: Arrays, count: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with representatives, links (a, b) that connect the components, and the numbers of links (if `count`)."""
    frame = id_and_text(docs, id_col, text_col, raw=True)
    rows, levels, sources, several = _representatives(frame, bits, arrays)
    live = _lists(sources, levels, arrays)
    star = _stars(live, several)

    def meet(members: DataFrame) -> DataFrame:
        found = materialise(_meetings(live.join(_small(members), "doc", "left").withColumn("head", F.coalesce("leader", "doc"))), "meetings", small=True)
        discard(live)
        return found

    def wholes(ids: DataFrame) -> DataFrame:
        return _whole_sets(sources.join(_small(ids), "doc_id", "left_semi"), arrays)

    return rows, *decided(star, meet, wholes, count=count)


def decided(star: DataFrame, meet: Callable[[DataFrame], DataFrame], wholes: Callable[[DataFrame], DataFrame], decode: Arrays = stored_arrays, count: bool = False) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that connect all sets that link, and (rep, n_links) of sets with links (all pairs are decided if `count`).

    `star` has sets b and the roots a that they follow (no root follows another); `meet` writes the
    distinct pairs (a, b), a < b, of families' roots (or sets without a family) that may hold links, from
    the families' (doc, leader); `wholes` the (doc, hashes) of ids (doc_id), which `decode` makes sets of.
    """
    chosen = materialise(_ends(star), "chosen", small=True)
    sets = materialise(wholes(chosen), "wholes")
    members = overlaps(star, sets, decode).where(OF_FAMILY)
    members = materialise(members.selectExpr("a as leader", "b as doc", "na as size", "5 * (na - both) + 4 * (nb - both) as apart", "4 * (na - both) + 5 * (nb - both) as gain"), "members")
    edges = members.where("apart <= size").select(F.col("leader").alias("a"), F.col("doc").alias("b"))
    meetings = meet(members.select("doc", "leader"))
    families = materialise(members.groupBy("leader").agg(F.count("*").alias("sets"), F.max("gain").alias("gain"), F.max("apart").alias("apart"), F.first("size").alias("size")), "families", small=True)
    others = materialise(_ends(meetings).join(chosen, "doc_id", "left_anti"), "others", small=True)
    if not others.isEmpty():
        sets = sets.unionByName(materialise(wholes(others), "wholes"))
    # The roots' answers; what their families may add to them decides whether the members meet.
    gain = lambda x: families.select(F.col("leader").alias(x), F.col("gain").alias(f"gain_{x}"))
    met = overlaps(meetings, sets, decode).join(gain("a"), "a", "left").join(gain("b"), "b", "left")
    met = materialise(met.where("9 * both + coalesce(gain_a, 0) + coalesce(gain_b, 0) >= 4 * (na + nb)"), "roots")
    alone = met.where("gain_a is null and gain_b is null").select("a", "b").distinct()
    near = met.where("gain_a is not null or gain_b is not null").select("a", "b").distinct()
    # A root and its only other member are decided; to connect components, so are members that link with their root.
    own = families.where(F.col("sets") > 1) if count else families.where("sets > 1 and apart > size")
    pairs = near.unionByName(own.select(F.col("leader").alias("a"), F.col("leader").alias("b")))
    wanted = members.join(_ends(pairs).withColumnRenamed("doc_id", "leader"), "leader", "left_semi").select(F.col("leader").alias("a"), F.col("doc").alias("b"))
    differing = overlaps(wanted, sets, decode, True).selectExpr(
        "a as leader", "b as doc", "na as size", "5 * (na - both) + 4 * (nb - both) as apart", "lost", "gained", "octet_length(lost) + octet_length(gained) as bytes"
    )
    differing = materialise(differing, "differences")
    compared = materialise(_compared(pairs, _units(differing, near, sets), decode), "compared")
    ends = lambda links: links.select(F.explode(F.array("a", "b")).alias("rep"), F.lit(1).cast("bigint").alias("n"))
    two = members.join(families.where("sets = 1").select("leader"), "leader", "left_semi").where("apart <= size")
    counts = compared.where("b is null").select(F.col("a").alias("rep"), "n").unionByName(_sure(differing)).unionByName(ends(alone))
    counts = counts.unionByName(ends(two.select(F.col("leader").alias("a"), F.col("doc").alias("b"))))
    edges = edges.unionByName(alone).unionByName(compared.where("b is not null").select("a", "b"))
    return edges, counts.groupBy("rep").agg(F.sum("n").alias("n_links")).where("n_links > 0")


def _representatives(frame: DataFrame, bits: int, arrays: Arrays) -> tuple[DataFrame, np.ndarray, DataFrame, DataFrame]:
    """Rows with representatives, the sketch's levels, the representatives' texts, and the ids that stand for several sets."""
    counted, levels = shingle_sets(frame, bits, arrays)
    groups = materialise(counted.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep")), "groups")
    rows = materialise(counted.join(groups, "key", "left").select("doc_id", "n_shingles", "rep"), "rows")
    discard(counted)
    several = groups.groupBy("rep").count().where("count > 1").select(F.col("rep").alias("doc"))
    copies = materialise(rows.where("doc_id <> rep or n_shingles = 0").select("doc_id").distinct(), "copies", small=True)
    own = materialise(rows.where("doc_id = rep").select("doc_id").distinct().join(copies, "doc_id", "left_semi"), "own", small=True)
    copies = copies if own.isEmpty() else materialise(copies.join(own, "doc_id", "left_anti"), "copies", small=True)
    sources = frame.where("doc_id is not null").join(_small(copies), "doc_id", "left_anti")
    return rows, levels, sources, materialise(several, "several", small=True)


def _lists(sources: DataFrame, levels: np.ndarray, arrays: Arrays) -> DataFrame:
    """(doc, n, spare, pos, token, block, short): the entries of lists of more than one; `spare` is the number of a set's prefix's others."""
    # Most shingles stand in one list only. Half of a hash is enough to leave out nearly all of those before any entry moves.
    heads = materialise(prefixes(sources, levels, arrays=arrays).where("n > 0"), "prefixes")
    twice = repeated_halves(heads)
    work = twice.agg(F.count("*").alias("halves"), F.sum("count").alias("entries"), F.sum(F.when(F.col("count") > LONG_LIST, F.col("count") * F.col("count"))).alias("pairs")).first()
    if (work["pairs"] or 0) > 10 * (work["entries"] or 0):
        # Long lists would cost more than another pass over the texts; which order is used doesn't change the links.
        long = _long_lists(twice)
        discard(heads)
        discard(twice)
        heads = materialise(prefixes(sources, levels, long, arrays).where("n > 0"), "prefixes")
        twice = repeated_halves(heads)
        work = twice.agg(F.count("*").alias("halves")).first()
    if work["halves"] <= MOST_HALVES:
        entries = live_entries(heads, sorted_halves(twice))
    else:
        entries = heads.select("doc", "n", F.posexplode("prefix").alias("pos", "token"))
        entries = entries.join(entries.groupBy("token").count().where("count > 1").select("token"), "token", "left_semi")
        spare = entries.groupBy("doc", "n").agg((F.floor(F.col("n") / 5) + 1 - F.count("*")).alias("spare"))
        entries = entries.join(spare, ["doc", "n"])
    live = materialise(_blocks(entries).withColumn("short", F.col("pos") <= F.floor(F.col("n") / 9)), "lists")
    discard(heads)
    discard(twice)
    return live


def _stars(live: DataFrame, several: DataFrame) -> DataFrame:
    """(b, a): sets and the roots of the leaders that they follow."""
    # The set with the fewest shingles of its own in its prefix leads: the original of a family of edited copies, if it is there.
    # Leaders come before their followers in order of (spare, id), so following leaders ends.
    ranked = live if several.isEmpty() else live.join(several, "doc", "left_anti")
    first = F.min(F.struct("spare", "doc", F.col("n").alias("size"), F.col("pos").alias("place")))
    leaders = ranked.where("short").groupBy("token", "block").agg(first.alias("head"))
    star = ranked.join(leaders, ["token", "block"]).select("doc", "n", "pos", "spare", "head.*").toDF("doc", "n", "pos", "spare", "best", "leader", "size", "place").where(
        "(best < spare or best = spare and leader < doc) and 5 * least(n, size) >= 4 * greatest(n, size) and 9 * (1 + least(n - 1 - pos, size - 1 - place)) >= 4 * (n + size)"
    )
    return rooted(star)


def rooted(star: DataFrame) -> DataFrame:
    """(b, a): of (doc, leader) rows, each doc with the last leader (a) of the chain from the leader that it has the most rows with.

    Leaders come before their docs in some order.
    """
    star = star.groupBy("doc", "leader").agg((-F.count("*")).alias("less")).groupBy("doc").agg(F.min(F.struct("less", "leader")).alias("best"))
    star = materialise(star.select(F.col("doc").alias("b"), F.col("best.leader").alias("a")), "stars", small=True)
    while True:
        above = star.select(F.col("b").alias("a"), F.col("a").alias("top"))
        moved = materialise(star.join(above, "a", "left").select("b", F.coalesce("top", "a").alias("a"), F.col("top").isNotNull().alias("moved")), "stars", small=True)
        discard(star)
        star = moved
        if star.where("moved").isEmpty():
            return star.select("b", "a")


def _ends(pairs: DataFrame) -> DataFrame:
    """The distinct ids in pairs (a, b)."""
    return pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct().withColumnRenamed("a", "doc_id")


def _meetings(placed: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, of roots of families that meet in lists where sizes and positions allow a link."""
    rest = F.max(F.col("n") - 1 - F.col("pos")).alias("rest")
    entries = lambda some: some.groupBy("token", "block", "head").agg(F.min("n").alias("low"), F.max("n").alias("high"), rest)
    named = lambda frame, k: frame.select("token", "block", *(F.col(x).alias(f"{x}_{k}") for x in ("head", "low", "high", "rest")))
    large, small = named(entries(placed), "x"), named(entries(placed.where("short")), "y")
    # The smaller set stands in the larger one's block or the one below.
    fits = "head_x <> head_y and high_x >= low_y and 5 * high_y >= 4 * low_x and 9 * (1 + least(rest_x, rest_y)) >= 4 * (low_x + low_y)"
    pair = lambda small: large.join(small, ["token", "block"]).where(fits).select(F.least("head_x", "head_y").alias("a"), F.greatest("head_x", "head_y").alias("b"))
    return pair(small).unionByName(pair(small.withColumn("block", F.col("block") + 1))).distinct()


def _levelled(members: DataFrame) -> DataFrame:
    """Members and roots (which differ from themselves in nothing) with their level in a family of several units (`large`)."""
    families = members.groupBy("leader").agg(F.first("size").alias("size"), ((F.count("*") >= UNIT) | (F.sum("bytes") > 8 * DIFFERENCES)).alias("large"))
    roots = families.select("leader", F.col("leader").alias("doc"), "size", F.lit(0).cast("bigint").alias("apart"), F.lit(b"").alias("lost"), F.lit(b"").alias("gained"), F.lit(0).alias("bytes"))
    level = F.when(F.col("large"), F.least(F.floor(LEVELS * F.col("apart") / F.col("size")), F.lit(LEVELS))).otherwise(0).cast("int")
    return members.select(*roots.columns).unionByName(roots).join(families.select("leader", "large"), "leader").withColumn("level", level)


def _units(members: DataFrame, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(leader, level, part, large, root, docs, aparts, losts, gaineds): the families' sets in units, and those without a family in `pairs` as units of their own."""
    every = _levelled(members)
    sizes = every.where("large").groupBy("leader", "level").agg(F.count("*").alias("n"), F.sum("bytes").alias("all"))
    sizes = sizes.select("leader", "level", F.greatest(F.ceil(F.col("n") * 2 / UNIT), F.ceil(F.col("all") * 2 / (8 * DIFFERENCES))).alias("split"))
    part = F.coalesce(F.pmod(F.xxhash64("doc"), F.greatest("split", F.lit(1))), F.lit(0)).cast("int")
    dealt = every.join(sizes, ["leader", "level"], "left").withColumn("part", part)
    packed = dealt.groupBy("leader", "level", "part", "large").agg(F.collect_list(F.struct("doc", "apart", "lost", "gained")).alias("x"))
    fields = [F.col(f"x.{c}").alias(f"{c}s") for c in ("doc", "apart", "lost", "gained")]
    single = _ends(pairs).withColumnRenamed("doc_id", "leader").join(members.select("leader"), "leader", "left_anti")
    single = single.select("leader", F.lit(0).alias("level"), F.lit(0).alias("part"), F.lit(False).alias("large"), F.expr("array(named_struct('doc', leader, 'apart', 0L, 'lost', X'', 'gained', X''))").alias("x"))
    root = sets.select(F.col("doc").alias("leader"), F.col("hashes").alias("root"))
    return materialise(packed.unionByName(single).join(root, "leader").select("leader", "level", "part", "large", "root", *fields), "units")


def _sure(members: DataFrame) -> DataFrame:
    """(rep, n): links of sets of large families with sets of levels that ensure a link."""
    every = _levelled(members).where("large").select("leader", "level", "doc")
    sizes = every.groupBy("leader", "level").agg(F.count("*").alias("n"))
    other = sizes.select("leader", F.col("level").alias("other"), "n")
    reach = sizes.drop("n").join(other, "leader").where(f"level + other + 2 <= {LEVELS}").groupBy("leader", "level").agg(F.sum("n").alias("n"))
    own = F.when(F.col("level") * 2 + 2 <= LEVELS, 1).otherwise(0)
    return every.join(reach, ["leader", "level"]).select(F.col("doc").alias("rep"), (F.col("n") - own).alias("n"))


def _compared(pairs: DataFrame, units: DataFrame, decode: Arrays) -> DataFrame:
    """For pairs (a, b) of families' roots (a = b: within the family): the sets' numbers of links (a, null, n), and links (a, b, 1) that connect what links.

    Pairs of levels that ensure a link are left out.
    """
    keys = lambda x: units.select(F.col("leader").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("level", "part", "large")))
    met = pairs.join(keys("a"), "a").join(keys("b"), "b")
    met = met.where(f"a <> b or (level_a < level_b or level_a = level_b and part_a <= part_b) and not (large_a and level_a + level_b + 2 <= {LEVELS})").drop("large_a", "large_b")
    met = materialise(met.withColumn("same", F.expr("a = b and level_a = level_b and part_a = part_b")), "meet", small=True)
    fields = ("root", "docs", "aparts", "losts", "gaineds")
    side = lambda x: units.select(F.col("leader").alias(x), F.col("level").alias(f"level_{x}"), F.col("part").alias(f"part_{x}"), *(F.col(c).alias(f"{c}_{x}") for c in fields))
    # By unit and not by family, so that the units of a large family go to many tasks.
    met = met.join(side("a"), ["a", "level_a", "part_a"]).join(side("b"), ["b", "level_b", "part_b"])
    kind = pairs.schema["a"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                x, y = (_Unit(row, k, decode) for k in "ab")
                linked = x.links(y)
                if row["same"]:
                    np.fill_diagonal(linked, False)
                ids = list(zip(x.docs, linked.sum(axis=1).tolist(), strict=True))
                ids += [] if row["same"] else zip(y.docs, linked.sum(axis=0).tolist(), strict=True)
                ids = [(doc, n) for doc, n in ids if n]
                joins = _joins(x, y, linked, row["a"] == row["b"], row["same"])
                yield {"a": [i for i, _ in ids] + [i for i, _ in joins], "b": [None] * len(ids) + [j for _, j in joins], "n": [n for _, n in ids] + [1] * len(joins)}

    columns = [f"{c}_{x}" for x in "ab" for c in fields]
    return map_batches(met.select("a", "b", "same", *columns), work, f"a {kind}, b {kind}, n bigint")


class _Unit:
    """The sets of a unit as differences from their root."""

    def __init__(self, row: dict, side: str, decode: Arrays):
        self.root, self.docs = decode([row[f"root_{side}"]])[0], row[f"docs_{side}"]
        #: Whether a set links with its root.
        self.held = np.array(row[f"aparts_{side}"]) <= len(self.root)
        both = stored_arrays([x for pair in zip(row[f"losts_{side}"], row[f"gaineds_{side}"], strict=True) for x in pair])
        sizes = np.array([len(x) for x in both], dtype=np.int64)
        self.tokens = np.concatenate(both)
        self.rows = np.repeat(np.arange(len(sizes)) // 2, sizes)
        self.signs = np.repeat(np.where(np.arange(len(sizes)) % 2, 1, -1), sizes)
        self.sizes = len(self.root) + self.summed(np.ones(len(self.tokens), dtype=bool))

    def summed(self, some: np.ndarray) -> np.ndarray:
        """The signs of some of the differences added up for each set."""
        return np.bincount(self.rows[some], self.signs[some], len(self.docs)).astype(np.int64)

    def matrix(self, tokens: np.ndarray) -> np.ndarray:
        """Signs by set and token (sorted ones)."""
        out, some = np.zeros((len(self.docs), len(tokens)), dtype=np.float32), _within(self.tokens, tokens)
        out[self.rows[some], np.searchsorted(tokens, self.tokens[some])] = self.signs[some]
        return out

    def links(self, other: _Unit) -> np.ndarray:
        """Which sets link with which of the other unit."""
        both = int(_within(self.root, other.root).sum()) + self.summed(_within(self.tokens, other.root))[:, None] + other.summed(_within(other.tokens, self.root))
        shared = np.intersect1d(self.tokens, other.tokens)
        for at in range(0, len(shared), SPAN):
            both += np.rint(self.matrix(shared[at : at + SPAN]) @ other.matrix(shared[at : at + SPAN]).T).astype(np.int64)
        return 9 * both >= 4 * (self.sizes[:, None] + other.sizes)


def _joins(x: _Unit, y: _Unit, linked: np.ndarray, family: bool, same: bool) -> list[tuple]:
    """Links that connect the sets of two units as `linked` does, where those that link with their root are connected already."""
    n, m = linked.shape
    docs = x.docs if same else [*x.docs, *y.docs]
    held = x.held if same else np.concatenate([x.held, y.held])
    labels = np.arange(len(docs))
    sides = [slice(0, len(docs))] if family else [slice(0, n), slice(n, n + m)]
    for side in sides:
        mine = np.flatnonzero(held[side]) + side.start
        labels[mine] = mine[:1]
    first, lx, ly = labels.copy(), labels[:n], labels if same else labels[n:]
    i, j = np.nonzero(linked)
    before = None
    while before is None or (before != labels).any():
        before = labels.copy()
        np.minimum.at(ly, j, lx[i])
        np.minimum.at(lx, i, ly[j])
        # All that had one label at first keep one.
        least = np.arange(len(docs))
        np.minimum.at(least, first, labels)
        np.minimum(labels, least[first], out=labels)
    return [(docs[k], docs[labels[k]]) for k in np.flatnonzero((first == np.arange(len(docs))) & (labels != first)).tolist()]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = SKETCH_BITS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rows, edges = links(docs, id_col, text_col, bits)
    found = connected_components(edges).withColumnRenamed("node", "rep")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id"))
    return rows.join(found, "rep", "left").select("doc_id", "n_shingles", F.coalesce(own, "component", "rep").alias("component_id"))


def link_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = SKETCH_BITS) -> DataFrame:
    """near_duplicates() and n_links of every row: with how many other shingle sets its own set links (null where the set has no id)."""
    rows, edges, counts = all_links(docs, id_col, text_col, bits)
    found = connected_components(edges).withColumnRenamed("node", "rep")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id"))
    n_links = F.when(F.col("rep").isNotNull() | (F.col("n_shingles") == 0), F.coalesce("n_links", F.lit(0).cast("bigint")))
    return rows.join(found, "rep", "left").join(counts, "rep", "left").select("doc_id", "n_shingles", F.coalesce(own, "component", "rep").alias("component_id"), n_links.alias("n_links"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = SKETCH_BITS) -> DataFrame:
    """`docs` with the least id of each component; rows without an id or words stay. Columns are unchanged."""
    found = near_duplicates(docs, id_col, text_col, bits)
    kept = found.where("doc_id = component_id").select("doc_id").distinct()
    gone = materialise(found.where("doc_id <> component_id").select("doc_id").distinct().join(kept, "doc_id", "left_anti"), "gone")
    gone = _small(gone).withColumnRenamed("doc_id", "__gone")
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_counts(table(spark, sf_dir, "documents"))
