"""Words of many texts at once, as 64-bit hashes, without a Python object for each word.

A word's hash is the sum of random numbers for its bytes times powers of an odd base, mod 2**64,
mixed at the end. Prefix sums over a buffer give every word's sum by one subtraction, and the
inverse powers take away the word's place in the buffer.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(64)
_BYTES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PRIME = np.uint64(0xC2B2AE3D27D4EB4F)
_TURN = np.uint64(29)
#: Bytes of text that are worked on at a time (a longer text is one block).
BLOCK = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = (np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64))


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for `size` places at least."""
    global _powers
    if len(_powers[0]) < size:
        steps = np.full(max(size, BLOCK + 1), np.uint64(1)), np.full(max(size, BLOCK + 1), np.uint64(1))
        for array, factor in zip(steps, (_BASE, _INVERSE), strict=True):
            array[1:] = np.uint64(factor)
            np.multiply.accumulate(array, out=array)
        _powers = steps
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _TURN)) * _PRIME
    return x ^ (x >> _TURN)


def blocks(texts: list[bytes]) -> list[tuple[int, int]]:
    """Ranges of texts of BLOCK bytes together at most, or one text."""
    out, begin, size = [], 0, 0
    for i, text in enumerate(texts):
        if i > begin and size + len(text) > BLOCK:
            out.append((begin, i))
            begin, size = i, 0
        size += len(text) + 1
    if begin < len(texts):
        out.append((begin, len(texts)))
    return out


class Words:
    """The words of a block of UTF-8 texts: A-Z lower-cased, split at ASCII white space.

    `hashes` of all words, text by text; text i has those from `first[i]` to `first[i + 1]`;
    `starts` and `ends` are their places in `buffer`.
    """

    def __init__(self, texts: list[bytes]):
        self.buffer = np.frombuffer((b"\n".join(texts) + b"\n").lower(), dtype=np.uint8)
        space = _SPACE[self.buffer]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edges = np.concatenate([[0], edges])
        # The buffer ends in white space, so edges are word begins and ends by turns.
        self.starts, self.ends = edges[0::2], edges[1::2]
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        self.first = np.searchsorted(self.starts, np.concatenate([[0], np.cumsum(sizes)]))
        power, inverse = powers(len(self.buffer))
        sums = np.zeros(len(self.buffer) + 1, dtype=np.uint64)
        np.cumsum(_BYTES[self.buffer] * power[: len(self.buffer)], out=sums[1:])
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * inverse[self.starts])
