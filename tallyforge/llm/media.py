"""Audio columns: texts stored as 8-bit WAV samples, read back and fingerprinted.

`encode` stores a payload losslessly as the samples of a mono 8-bit WAV file; `decode` reads
them back. `fingerprints` takes a short-time Fourier transform of the samples, picks the
strongest spectral peaks of each frame and pairs each with the weaker ones of its frame and peaks of the next
frames; a pair (frequency bin, frequency bin, frame distance) with its time makes one code of a bigint array:
time << 32 | first bin << 16 | second bin << 4 | distance.

Null text counts as empty text, whose payload is 64 zero bytes. Equal texts give equal values.
Other columns than the two named aren't read; an empty table gives an empty result. A very long
text's samples become numbers and are transformed in blocks of frames, so beside its bytes and codes (some two thirds of a byte for
each sample) it takes no more memory than a short one.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.batches import id_and_text, map_batches, pieces, texts
from tallyforge.session import table

RATE = 8_000
#: Frames overlap by half, so that every sample stands near the middle of some window.
FRAME, HOP = 512, 256
PEAKS, AHEAD = 3, 2
#: Frames that are transformed at a time.
BLOCK = 512
_WINDOW = np.hanning(FRAME)


def payload_of(text: bytes) -> bytes:
    """The bytes with zero bytes up to a positive multiple of 64."""
    return text + bytes(-len(text) % 64 if text else 64)


def encode(payload: bytes) -> bytes:
    """A mono 8-bit WAV file whose samples are the payload."""
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(1)
        file.setframerate(RATE)
        file.writeframes(payload)
    return out.getvalue()


def decode(media: bytes) -> bytes:
    """The samples of a WAV file."""
    with wave.open(io.BytesIO(media), "rb") as file:
        return file.readframes(file.getnframes())


def _peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames, bins) of 8-bit samples: the PEAKS strongest local maxima of each frame, by magnitude then bin; bin -1: none."""
    n = max(1, -(-len(samples) // HOP))
    bins = np.full((n, PEAKS), -1, dtype=np.int64)
    for begin in range(0, n, BLOCK):
        end = min(n, begin + BLOCK)
        part = samples[begin * HOP : (end - 1) * HOP + FRAME]
        padded = np.zeros((end - begin - 1) * HOP + FRAME)
        np.subtract(part, 128.0, out=padded[: len(part)])
        frames = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
        power = np.round(np.log1p(np.abs(np.fft.rfft(frames * _WINDOW, axis=1))), 6)
        inner = power[:, 1:-1]
        inner = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]), inner, -1.0)
        for k in range(PEAKS):
            best = inner.argmax(axis=1)
            value = np.take_along_axis(inner, best[:, None], axis=1)[:, 0]
            bins[begin:end, k] = np.where(value > 0, best + 1, -1)
            np.put_along_axis(inner, best[:, None], -1.0, axis=1)
    return np.arange(n), bins


def fingerprints(samples: bytes) -> np.ndarray:
    """Time-coded peak pairs of 8-bit samples, in order of time, then of bins."""
    time, bins = _peaks(np.frombuffer(samples, dtype=np.uint8))
    codes, n = [], len(time)
    for ahead in range(AHEAD + 1):
        for i in range(PEAKS):
            for j in range(0 if ahead else i + 1, PEAKS):
                a, b = bins[: max(0, n - ahead), i], bins[ahead:, j]
                both = (a >= 0) & (b >= 0)
                codes.append(time[: len(a)][both] << 32 | a[both] << 16 | b[both] << 4 | ahead)
    return np.sort(np.concatenate(codes))


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text as a WAV file."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in pieces(batches, "text"):
            raw = texts(batch)
            yield {"doc_id": batch.column("doc_id"), "n_bytes": [len(x) for x in raw], "media": [encode(payload_of(x)) for x in raw]}

    frame = id_and_text(docs, id_col, text_col, raw=True)
    return map_batches(frame, work, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, media binary")


def features(stored: DataFrame) -> DataFrame:
    """For rows of `store`: the payload read back, its digests and the fingerprint codes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in pieces(batches, "media"):
            media = texts(batch, "media")
            payload = [decode(x) for x in media]
            codes = [fingerprints(x) for x in payload]
            yield {
                "doc_id": batch.column("doc_id"),
                "n_bytes": batch.column("n_bytes"),
                "payload_bytes": [len(x) for x in payload],
                "payload_sha256": [hashlib.sha256(x).hexdigest() for x in payload],
                "tail_crc32": [zlib.crc32(x[-64:]) for x in payload],
                "media_bytes": [len(x) for x in media],
                "media_sha256": [hashlib.sha256(x).hexdigest() for x in media],
                "feature": [f"{max(1, -(-len(x) // HOP))}f{len(c)}p:{hashlib.sha256(c.astype('<i8').tobytes()).hexdigest()}" for x, c in zip(payload, codes, strict=True)],
                "fingerprint": codes,
            }

    kind = stored.schema["doc_id"].dataType.simpleString()
    return map_batches(
        stored,
        work,
        f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, "
        "media_sha256 string, feature string, fingerprint array<bigint>",
    )


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(store(table(spark, sf_dir, "documents"))).select("*", F.size("fingerprint").alias("n_pairs"))
