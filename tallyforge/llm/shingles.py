"""Word shingles of texts as sorted distinct 64-bit hashes."""

from __future__ import annotations

import hashlib

import numpy as np

from tallyforge.llm.words import Words, blocks

WIDTH = 5
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(29)


def _windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each `size` neighbouring words."""
    out = np.full(len(hashes) - size + 1, np.uint64(size), dtype=np.uint64)
    for k in range(size):
        out = (out ^ hashes[k : len(hashes) - size + 1 + k]) * _PRIME
        out ^= out >> _TURN
    return out.view(np.int64)


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    new = np.empty(len(values), dtype=bool)
    new[:1] = True
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values[new]


def shingle_arrays(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """For each UTF-8 text the sorted distinct hashes of its `width`-word windows, A-Z lower-cased and split at ASCII white space.

    A text of fewer words has one shingle, its whole sequence; one without words has none.
    """
    out = []
    for begin, end in blocks(texts):
        words = Words(texts[begin:end])
        windows = _windows(words.hashes, width) if len(words.hashes) >= width else np.empty(0, dtype=np.int64)
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            if b - a >= width:
                out.append(_distinct(windows[a : b - width + 1]))
            else:
                out.append(_windows(words.hashes[a:b], b - a) if b > a else np.empty(0, dtype=np.int64))
    return out


def set_key(hashes: np.ndarray) -> str | None:
    """A digest that equal sets share; none for the empty set."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).hexdigest() if len(hashes) else None
