"""Helpers for operators that read texts in Arrow batches inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows and text bytes that a task's Python side works on at a time; a word list takes some ten times a text's bytes.
BATCH_ROWS = 2_000
BATCH_BYTES = 2 << 20
#: Bytes of an Arrow batch between Spark and Python.
ARROW_BYTES = 4 << 20


def pieces(batches: Iterator[pa.RecordBatch], text: str | None = None) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that none has more than BATCH_ROWS rows or (but for one row) BATCH_BYTES of `text`."""
    for batch in batches:
        begin, size = 0, 0
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist() if text else [0] * batch.num_rows
        for at, n in enumerate(lengths):
            if at > begin and (at - begin >= BATCH_ROWS or size + n > BATCH_BYTES):
                yield batch.slice(begin, at - begin)
                begin, size = at, 0
            size += n
        if batch.num_rows > begin:
            yield batch.slice(begin)


def texts(batch: pa.RecordBatch, name: str = "text") -> list:
    """A column's values, null as empty text (or bytes)."""
    column = batch.column(name)
    empty = b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else ""
    return [empty if x is None else x for x in column.to_pylist()]


def _trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; before the first and after the last, memory that earlier tasks of this worker have freed goes back to the system."""
    give_back()
    yield from batches
    give_back()


def give_back() -> None:
    """Returns freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size to ARROW_BYTES, so that rows with long values don't pile up in a task."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(name).rstrip("bB"))
    if now > ARROW_BYTES:
        spark.conf.set(name, str(ARROW_BYTES))


def map_batches(frame: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """`mapInArrow` for functions that yield columns as dicts of lists; `schema` is DDL."""
    bound_batches(frame.sparkSession)
    kind = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in work(_trimmed(batches)):
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, field.type) for field, x in ((f, out[f.name]) for f in arrow)], schema=arrow)

    return frame.mapInArrow(run, kind)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", raw: bool = False) -> DataFrame:
    """Just id and text under fixed names; `raw`: text as UTF-8 bytes. Other columns aren't read."""
    body = F.col(text_col).cast("binary") if raw else F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), body.alias("text"))
