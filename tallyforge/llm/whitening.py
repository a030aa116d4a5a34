"""Whitening of embeddings from an exact integer scatter.

Entries become integers. Each task subtracts a shift, adds up the integers' sums and cross-products without
rounding (products of blocks that doubles hold exactly, added as Python integers) and hands
over their 32-bit limbs, which Spark sums by cell; a cell's value may have any number of
limbs. From these sums n * X'X - S S' is formed in integers. Only that matrix becomes doubles,
and `eigh` decomposes it, so nothing is lost to cancellation, however far from zero the data lie
and in whatever order tasks end. What comes to the driver has a size by the dimension alone.

Rows whose vector is null, or holds null or non-finite entries, are dropped. All vectors need one
length: of several, the most frequent counts (of equally frequent ones the longest) and rows of another
length are dropped; empty vectors have no components. Repeated rows each count and each come back; other columns aren't read. No row left,
or an empty table: an empty result. A component without variance (fewer distinct rows
than dimensions, one row) has whitened values 0 and explained 0, and stays out of the error. Equal eigenvalues leave the choice of
their components open; it is the same for all rows. A component's largest entry (the first of equals) is positive.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.batches import map_batches, pieces
from tallyforge.session import table

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
LIMB = 32
#: Integers below are exact in a double.
EXACT = 1 << 53
#: Integers from here on are Python integers and not doubles, so that a product of two doubles is exact.
LARGE = 1 << 26
#: Rows that are multiplied at a time.
ROWS = 4_096
#: Bits of a half of a number below 2**52; sums of some thousand products of halves fit a long.
HALF = 26
#: A component with less than this part of the greatest variance has none, as far as doubles tell.
LEAST = 1e-14


def clean(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, vector (doubles): the rows that count, by null and finite entries and by length."""
    one = F.col(vector_col).cast("array<double>")
    held = vectors.select(F.col(id_col).alias("vec_id"), one.alias("vector")).where(
        F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    )
    sizes = held.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    return held.where(F.size("vector") == (sizes[0]["size"] if sizes else 0))


def _integers(batch: pa.RecordBatch, shift: int) -> np.ndarray:
    """floor(SCALE * c) + SHIFT - shift of a batch's vectors, as rows of doubles while these are exact, else of Python integers."""
    column = batch.column("vector")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        rows = np.floor(flat * SCALE) + float(SHIFT - shift)
    if not np.abs(rows).max(initial=0) < LARGE:
        rows = np.array([math.floor(Fraction(x) * SCALE) + SHIFT - shift for x in flat.tolist()], dtype=object)
    return rows.reshape(batch.num_rows, len(flat) // batch.num_rows)


def _products(rows: np.ndarray) -> np.ndarray:
    """X'X of integer rows, as Python integers."""
    if rows.dtype == object:
        return rows.T @ rows
    most = max(1, int(np.abs(rows).max(initial=0)))
    out, step = np.zeros((rows.shape[1],) * 2, dtype=object), min(ROWS, max(1, (EXACT - 1) // (most * most)))
    for begin in range(0, len(rows), step):
        part = rows[begin : begin + step]
        out += (part.T @ part).astype(np.int64)
    return out


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """The places and values of a number's limbs; the last one has the sign."""
    place = 0
    while not -(1 << 62) < value < 1 << 62:
        yield place, value & ((1 << LIMB) - 1)
        value >>= LIMB
        place += 1
    low, high = value & ((1 << LIMB) - 1), value >> LIMB
    yield place, low
    if high:
        yield place + 1, high


@dataclass(frozen=True)
class Whitening:
    """A fit: rows, shifted sums, unit components (rows) by falling variance, variances and their parts of the whole.

    Variances are those of rows divided by 2**power, which is 1 unless they would pass a double.
    """

    n: int
    shift: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    power: int = 0


def scatter(held: DataFrame, shift: int = SHIFT) -> tuple[int, list[int], list[list[int]]]:
    """n, S and n * X'X - S S' of the rows' integers less the shift, exactly."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        n, sums, products = 0, 0, 0
        for batch in pieces(batches):
            rows = _integers(batch, shift)
            n += len(rows)
            # Sums of a batch's doubles below 2**27 are exact.
            sums = sums + (rows.sum(axis=0) if rows.dtype == object else rows.sum(axis=0).astype(np.int64).astype(object))
            products = products + _products(rows)
        if n:
            d = len(sums)
            cells = [("n", 0, 0, n), *(("s", i, 0, int(sums[i])) for i in range(d)), *(("p", i, j, int(products[i, j])) for i in range(d) for j in range(i, d))]
            found = [(kind, i, j, place, value) for kind, i, j, cell in cells for place, value in _limbs(cell)]
            yield dict(zip(("kind", "i", "j", "place", "value"), map(list, zip(*found, strict=True)), strict=True))

    limbs = map_batches(held.select("vector"), work, "kind string, i int, j int, place int, value bigint")
    # A limb's sum holds for 2**30 tasks; sums past a long would fail and not wrap.
    cells: dict[tuple[str, int, int], int] = {}
    for kind, i, j, place, value in limbs.groupBy("kind", "i", "j", "place").agg(F.sum("value").alias("value")).collect():
        cells[kind, i, j] = cells.get((kind, i, j), 0) + (value << LIMB * place)
    n, d = cells.get(("n", 0, 0), 0), sum(kind == "s" for kind, _, _ in cells)
    sums = [cells["s", i, 0] for i in range(d)]
    return n, sums, [[n * cells["p", min(i, j), max(i, j)] - sums[i] * sums[j] for j in range(d)] for i in range(d)]


def fit(held: DataFrame, components: int = COMPONENTS, shift: int = SHIFT) -> Whitening:
    """Fits on all rows of `clean`."""
    n, sums, central = scatter(held, shift)
    d = len(sums)
    if not d:
        return Whitening(n, shift, sums, np.empty((0, 0)), np.empty(0), np.empty(0))
    power = max(0, (max(central[i][i] for i in range(d)) // (n * n)).bit_length() // 2 - 400)
    # Only here do integers become doubles, each rounded once.
    covariance = np.array([[float(Fraction(x, n * n << 2 * power)) for x in row] for row in central])
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[: min(components, d)]
    values, unit = values[order], vectors.T[order]
    unit = unit * np.sign(np.take_along_axis(unit, np.abs(unit).argmax(axis=1)[:, None], axis=1))
    values = np.where(values > LEAST * max(values[0], 0.0), np.maximum(values, 0.0), 0.0)
    trace = float(Fraction(sum(central[i][i] for i in range(d)), n * n << 2 * power))
    return Whitening(n, shift, sums, unit, values, values / trace if trace else np.zeros(len(values)), power)


def transform(held: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, deviation (decimal; null beyond 38 digits), whitened (an array by component)."""
    n, sums, shift, power = model.n, np.array(model.sums, dtype=object), model.shift, model.power
    scale = np.divide(1.0, np.sqrt(model.variances), out=np.zeros(len(model.variances)), where=model.variances > 0)
    weights = (model.components * scale[:, None]).T if len(model.sums) else np.empty((0, 0))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in pieces(batches):
            rows = _integers(batch, shift)
            if rows.dtype == object or n * int(np.abs(rows).max(initial=0)) + max(map(abs, model.sums), default=0) >= 1 << 52:
                central = np.array([int(x) for x in rows.ravel()], dtype=object).reshape(rows.shape) * n - sums
                squares = (central * central).sum(axis=1)
                centred = np.array([float(Fraction(x, n << power)) for x in central.ravel().tolist()]).reshape(central.shape)
            else:
                central = rows.astype(np.int64) * n - sums.astype(np.int64)
                high, low = central >> HALF, central & ((1 << HALF) - 1)
                squares = sum((x * y).sum(axis=1).astype(object) << k for x, y, k in ((high, high, 2 * HALF), (high, low, HALF + 1), (low, low, 0)))
                centred = central / n * 2.0**-power
            yield {
                "vec_id": batch.column("vec_id"),
                "deviation": [str(int(x)) for x in squares],
                "whitened": list(centred @ weights) if len(sums) else [[] for _ in range(batch.num_rows)],
            }

    out = map_batches(held, work, f"vec_id {held.schema['vec_id'].dataType.simpleString()}, deviation string, whitened array<double>")
    return out.select("vec_id", F.expr("try_cast(deviation AS decimal(38,0))").alias("deviation"), "whitened")


def identity_error(whitened: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, over components with variance."""
    live = np.flatnonzero(model.variances > 0).tolist()
    pairs = [(i, j) for i in live for j in live if i <= j]
    if not pairs:
        return 0.0
    found = whitened.agg(*(F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    return max(abs(x - (i == j)) for x, (i, j) in zip(found, pairs, strict=True))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = clean(table(spark, sf_dir, "embeddings"))
    model = fit(held)
    found = transform(held, model)
    error = identity_error(found, model)
    explained = F.array(*(F.lit(float(x)) for x in model.explained)) if len(model.explained) else F.expr("array()").cast("array<double>")
    return found.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened")).select(
        "vec_id",
        (F.col("place") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("bigint").alias("n"),
        # Null where the sum passes a long, which takes some ten million rows; `transform` has it as a decimal.
        F.expr("try_cast(deviation AS bigint)").alias("deviation"),
        "whitened",
        explained[F.col("place")].alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )
