import hashlib
import math
import random
import zlib

import numpy as np

from tallyforge.llm import media
from tallyforge.llm.media import AHEAD, FRAME, HOP, PEAKS, decode, encode, features, fingerprints, payload_of, store


def test_round_trip_and_values(spark):
    texts = ["", None, "a", "x" * 64, "é" * 4000, "lang " * 60_000, "a"]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, media string")
    got = {r.doc_id: r for r in features(store(docs)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        want = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(want))
        assert r.payload_sha256 == hashlib.sha256(want).hexdigest() and r.tail_crc32 == zlib.crc32(want[-64:])
        assert r.media_sha256 == hashlib.sha256(encode(want)).hexdigest() and r.media_bytes == len(encode(want))
        assert decode(encode(payload_of(raw))) == want
    assert got[2].feature == got[6].feature != got[4].feature != got[5].feature
    assert features(store(docs.limit(0))).count() == 0


def test_tones_pair():
    t = np.arange(FRAME * 6)
    wave = 128 + 50 * np.sin(2 * np.pi * 40 * t / FRAME) + 40 * np.sin(2 * np.pi * 90 * t / FRAME)
    codes = fingerprints(wave.astype(np.uint8).tobytes())
    pairs = {(int(c) >> 16 & 0xFFFF, int(c) >> 4 & 0xFFF) for c in codes}
    assert {(40, 40), (40, 90), (90, 40), (90, 90)} <= pairs
    assert np.all(np.diff(codes >> 32) >= 0)


def brute_codes(samples):
    """Peak pairs from plain sums of the Fourier transform, frame by frame."""
    n = -(-len(samples) // HOP)
    peaks = []
    for i in range(n):
        frame = [0.0] * FRAME
        for k, x in enumerate(samples[i * HOP : i * HOP + FRAME]):
            frame[k] = (x - 128) * (0.5 - 0.5 * math.cos(2 * math.pi * k / (FRAME - 1)))
        turns = np.exp(-2j * np.pi * np.outer(np.arange(FRAME // 2 + 1), np.arange(FRAME)) / FRAME)
        power = [round(math.log1p(abs(x)), 6) for x in turns @ np.array(frame)]
        tops = [(-power[k], k) for k in range(1, FRAME // 2) if power[k - 1] < power[k] >= power[k + 1] and power[k] > 0]
        peaks.append([k for _, k in sorted(tops)[:PEAKS]])
    found = []
    for i in range(n):
        for ahead in range(min(AHEAD, n - 1 - i) + 1):
            for x, a in enumerate(peaks[i]):
                found += [i << 32 | a << 16 | b << 4 | ahead for y, b in enumerate(peaks[i + ahead]) if ahead or y > x]
    return sorted(found)


def test_equals_plain_transform():
    rng = random.Random(4)
    for size in (64, 700, 3_000):
        samples = bytes(rng.choice(b"the quick brown fox ") for _ in range(size))
        assert fingerprints(samples).tolist() == brute_codes(samples)
    # Samples at a frame's edge stand in the middle of the next one.
    quiet = bytearray([128] * FRAME * 4)
    loud = quiet.copy()
    loud[FRAME - 4 : FRAME + 4] = bytes([0, 255] * 4)
    assert len(fingerprints(bytes(quiet))) == 0 < len(fingerprints(bytes(loud)))


def test_long_texts_go_in_blocks(monkeypatch):
    """Codes don't depend on the blocks, and numbers of a whole text are never made at once."""
    import tracemalloc

    samples = np.random.default_rng(1).integers(0, 256, 200_000, dtype=np.uint8).tobytes()
    whole = media.fingerprints(samples)
    monkeypatch.setattr(media, "BLOCK", 7)
    assert np.array_equal(media.fingerprints(samples), whole)
    monkeypatch.undo()
    long = samples * 50
    tracemalloc.start()
    codes = media.fingerprints(long)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Codes twice over while they are sorted, the peaks, and a block; eight bytes a sample would be 80 MB.
    assert peak < 4 * codes.nbytes + (24 << 20) < 8 * len(long)
