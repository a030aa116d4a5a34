"""Wide keys met by their hashes: what recurs and what is missing is found before any row moves.

A key that no other row has is known by its 64-bit hash alone; rows whose hash recurs are compared by the
key itself, so equal hashes of different keys cost a little and change nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.session import materialise

#: Up to so many hashes go to all tasks; more are met by shuffling.
MOST_HASHES = 1_000_000
#: Bits of the table that foretells whether a hash is among many: 16 MB, whatever their number.
HASH_BITS = 1 << 27


def near(hashes: DataFrame) -> DataFrame:
    """Hashes (written before), marked for broadcast where they are few."""
    return F.broadcast(hashes) if hashes.count() <= MOST_HASHES else hashes


def _dealt(hashes: DataFrame) -> DataFrame:
    """Hashes dealt by themselves before they are counted: nearly all differ, so that counting them in each task first would fill its memory and save nothing.

    They are small and pack well, so parts joined by their size would be too much for a task's memory: their number is given.
    """
    return hashes.repartition(int(hashes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_h")


def divided(rows: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose keys no other row has, and those whose keys may recur (None: there are none)."""
    h = F.xxhash64(*keys)
    again = materialise(_dealt(rows.select(h.alias("_h"))).groupBy("_h").count().where("count > 1").select("_h"), "again")
    if again.isEmpty():
        return rows, None
    marked, again = rows.withColumn("_h", h), near(again)
    return marked.join(again, "_h", "left_anti").drop("_h"), marked.join(again, "_h", "left_semi").drop("_h")


def once(rows: DataFrame, *keys: str) -> DataFrame:
    """One row for each value of the keys (all columns: distinct rows), for rows that seldom repeat: only hashes move, and what recurs."""
    alone, several = divided(rows, *(keys or rows.columns))
    return alone if several is None else alone.unionByName(several.dropDuplicates(list(keys) or None))


def uneven(known: list[tuple[DataFrame, str]], named: list[tuple[DataFrame, list[str]]], wrong: str) -> DataFrame:
    """(_h): hashes of ids for which `wrong` holds of `nodes`, how often `known` has them; those of `named` alone have 0.

    Only 64 bits an id are moved. A repeated id always shows; an id that is missing would be overlooked
    only if its hash were that of a known one (a chance of the number of known ids to 2**64).
    """
    sides = [frame.select(F.xxhash64(key).alias("_h"), F.lit(1).alias("node")) for frame, key in known]
    sides += [frame.select(F.explode(F.array(*columns)).alias("id")).select(F.xxhash64("id").alias("_h"), F.lit(0).alias("node")) for frame, columns in named]
    return materialise(_dealt(reduce(DataFrame.unionByName, sides)).groupBy("_h").agg(F.sum("node").alias("nodes")).where(wrong), "uneven")


def suspects(rows: DataFrame, key: str, bad: Column) -> DataFrame:
    """(_h): hashes of keys that may recur, or of which a row is bad; one row each, so that where nothing is wrong there are none."""
    marks = _dealt(rows.select(F.xxhash64(key).alias("_h"), F.when(bad, 2).otherwise(1).cast("bigint").alias("_n")))
    return materialise(marks.groupBy("_h").agg(F.sum("_n").alias("_n")).where("_n > 1").select("_h"), "suspects")


def times(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, left, right): how often either side has a key, null for never; a null key meets none of the other side.

    Keys are told apart by 96 bits, two hashes of different kinds; a reader that leaves the key out moves hashes alone.
    """
    side = lambda rows, at: rows.select(F.when(F.col(key).isNull(), F.lit(at)).otherwise(F.xxhash64(key)).alias("_h"), F.hash(key).alias("_g"), F.lit(at == 1).alias("_r"), key)
    both = _dealt(side(left, 0).unionByName(side(right, 1))).groupBy("_h", "_g")
    n = lambda where: F.nullif(F.count_if(where), F.lit(0).cast("bigint"))
    return both.agg(F.min(key).alias(key), n(~F.col("_r")).alias("left"), n(F.col("_r")).alias("right")).drop("_h", "_g")


def lacking(rows: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """(key): the values of a narrow key that `known` has not, once each (null among them); only the keys move."""
    return materialise(rows.select(key).distinct().join(known.select(key), key, "left_anti"), "lacking")


def known_rows(rows: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """The rows whose key `known` has. Where all have one, as is usual, no row moves or is looked at again; else the few keys that are missing go to the rows."""
    rows, lost = rows.where(F.col(key).isNotNull()), lacking(rows.where(F.col(key).isNotNull()), key, known)
    return rows if lost.isEmpty() else rows.join(near(lost), key, "left_anti")


def values(rows: DataFrame, group: str, *columns: str) -> DataFrame:
    """(group, end, n): a row for each value of each column in a group, with the column's name and how many rows have it; nulls are left out.

    Values are told apart by 96 bits, two hashes of different kinds, so no value moves.
    """
    ends = [F.when(F.col(c).isNotNull(), F.struct(F.lit(i).cast("tinyint").alias("end"), F.xxhash64(F.lit(i), c).alias("_h"), F.hash(F.lit(i), c).alias("_g"))) for i, c in enumerate(columns, 1)]
    told = rows.select(group, F.explode(F.filter(F.array(*ends), lambda x: x.isNotNull())).alias("e")).select(group, "e.*")
    each = _dealt(told).groupBy(group, "end", "_h", "_g").agg(F.count("*").alias("n"))
    return each.select(group, F.element_at(F.array(*map(F.lit, columns)), F.col("end").cast("int")).alias("end"), "n")


def among(rows: DataFrame, key: str, hashes: DataFrame) -> DataFrame:
    """The rows whose id is among hashes (written before). Of many hashes a table of bits, of fixed size, goes to the rows first, so that few others move."""
    rows, hashes = rows.withColumn("_h", F.xxhash64(key)), hashes.select("_h")
    if hashes.count() > MOST_HASHES:
        # An inner join with distinct hashes: a semi join would be pushed below the table of bits.
        return _foretold(rows, hashes).join(hashes.distinct(), "_h").drop("_h")
    return rows.join(F.broadcast(hashes), "_h", "left_semi").drop("_h")


def _foretold(rows: DataFrame, hashes: DataFrame) -> DataFrame:
    """The rows whose hash has its bit set; a hash that is among them always has."""
    place = F.pmod("_h", F.lit(HASH_BITS))
    bits = hashes.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("_b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("_bits"))
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    # The table has a fixed size.
    met = rows.withColumn("_b", F.bitmap_bucket_number(place)).join(F.broadcast(bits), "_b")
    return met.where(F.getbit(byte, (bit % 8).cast("int")) == 1).drop("_b", "_bits")


def absent(ends: DataFrame, known: DataFrame) -> DataFrame:
    """(_h, kind): hashes of `ends` (_h, kind; over 0) that `known` (_h) lacks; a hash has one kind, and only hashes move."""
    both = _dealt(ends.select("_h", "kind").unionByName(known.select("_h", F.lit(0).cast("tinyint").alias("kind"))))
    return materialise(both.groupBy("_h").agg(F.min("kind").alias("least"), F.max("kind").alias("kind")).where("least > 0").select("_h", "kind"), "absent")


def without(rows: DataFrame, key: str, others: DataFrame) -> DataFrame:
    """The rows whose id `others` lack; ids are told apart by 96 bits, two hashes of different kinds, so no id moves."""
    told = {"_h": F.xxhash64(key), "_g": F.hash(key)}
    return rows.withColumns(told).join(others.select(*(x.alias(name) for name, x in told.items())), ["_h", "_g"], "left_anti").drop("_h", "_g")
