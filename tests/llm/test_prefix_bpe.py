import base64
import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import prefix_bpe
from tallyforge.llm.prefix_bpe import KeptPieces, PrefixCoder, PrefixText, decode, digests, edited, encode, prefixes

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
CODER = PrefixCoder(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=CODER.rank, special_tokens={})
TEXTS = [
    "", " ", "\n\n  a", "Hello world's they'll 12345 !!", "a<|endoftext|> b<|endoftext|>", "ß ü é 日本語 🎉🎉", "x" * 3000, "日本語テキスト" * 60,
    " " * 500, "   a\x85b\x1c c", "ab" * 100 + "é" * 200, "aaa bbb\r\n\tccc  ", "internationalization" * 20, "=" * 700 + "-" * 333,
]


def ids_of(text):
    ids = LIBRARY.encode_ordinary(text)
    return struct.pack(f"<{len(ids)}I", *ids)


def encoded(batch):
    return KeptPieces(CODER).encode([prefix_bpe.regex.findall(PATTERN, x) for x in batch])


@pytest.mark.parametrize("text", TEXTS)
def test_equals_library(text):
    ids = encoded([text, "between", text])
    assert ids[0] == ids[2] == ids_of(text)
    assert CODER.decode(ids[0]) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=4))
def test_fuzz(batch):
    assert encoded(batch) == [ids_of(x) for x in batch]


def test_bytes_of_any_kind():
    """Pieces as bytes, short and long, of letters that merge in many ways."""
    rng = random.Random(12)
    for alphabet in (b"ae", b"the n", b"-=_", bytes(range(256)), "日本の".encode()):
        words = [bytes(rng.choices(alphabet, k=rng.randint(1, 200))) for _ in range(150)]
        want = [np.array(LIBRARY._core_bpe.encode_single_piece(x), dtype="<u4").tobytes() for x in words]
        assert CODER.encode_pieces(words) == want


def test_each_prefix_has_one_last_token():
    piece = b"antidisestablishmentarianism"
    last = CODER.fill([piece])[0]
    for n in range(1, len(piece) + 1):
        want = LIBRARY._core_bpe.encode_single_piece(piece[:n])
        assert CODER.ids(piece[:n], last[:n]) == want
        matches = [t for k in range(n) if (t := CODER.rank.get(piece[k:n])) is not None and CODER.reachable[t]]
        fitting = [t for t in matches if CODER.length[t] == n or CODER._fits_one(int(last[n - CODER.length[t] - 1]), t)]
        assert fitting == [last[n - 1]]


def test_refuses_other_orders(tmp_path):
    """A token that is made of tokens of later rank isn't merged in order of rank."""
    tokens = [bytes([x]) for x in range(256)] + [b"abcd", b"ab", b"cd"]
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    with pytest.raises(ValueError):
        PrefixCoder(str(path))


def test_appends_and_edits_equal_encoding_anew():
    rng = random.Random(7)
    parts = ["the ", "Inter", "national", "'s", "'", "r", "e", " ", "  ", "\n", "12", "日本", "é", "-" * 40, "word" * 30, "x", "!"]
    for _ in range(150):
        text = "".join(rng.choices(parts, k=rng.randint(0, 25)))
        one = PrefixText(CODER, PATTERN, text)
        for _ in range(4):
            at, removed, inserted = rng.randint(0, len(one.text) + 1), rng.choice([0, 0, 1, 2, 9]), "".join(rng.choices(parts, k=rng.randint(0, 3)))
            want = one.text[: min(at, len(one.text))] + inserted + one.text[min(at, len(one.text)) + removed :]
            one.edit(at, removed, inserted)
            again = PrefixText(CODER, PATTERN, want)
            assert (one.text, one.ends, one.ids()) == (want, again.ends, ids_of(want))
            assert np.array_equal(one.last, again.last)


def test_edits_stay_near():
    words = " ".join(f"word{i} and" for i in range(5000))
    one = PrefixText(CODER, PATTERN, words)
    assert one.append(" more") <= 20
    assert one.edit(20_000, 3, "abc") <= 40
    letters = "".join(random.Random(1).choices("abcdefgh", k=50_000))
    long = PrefixText(CODER, PATTERN, letters)
    assert long.edit(25_000, 1, "zz") < 3_000
    assert long.append("abc") == 3
    assert long.ids() == ids_of(long.text)


def test_kept_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(prefix_bpe, "KEPT_BYTES", 100_000)
    kept = KeptPieces(CODER)
    for i in range(60):
        batch = [f"{i}x{k}y" * 3 for k in range(100)] + ["a" * 5000 + str(i)]
        assert kept.encode([[x] for x in batch]) == [np.array(LIBRARY._core_bpe.encode_single_piece(x.encode()), dtype="<u4").tobytes() for x in batch]
        assert kept.bytes < 200_000 and max(map(len, kept)) <= prefix_bpe.KEPT_PIECE


def test_frame(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(99, None), (None, "a"), (99, None), (100, "long text " * 100_000)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, ids string")
    got = digests(decode(encode(docs, PATH, PATTERN), PATH)).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), len(ids_of(t or "")) // 4, hashlib.sha256(ids_of(t or "")).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert digests(decode(encode(docs.limit(0), PATH, PATTERN), PATH)).count() == 0


def test_edited_frame(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, None), (3, "same"), (4, "x" * 400)], "doc_id bigint, text string")
    edits = spark.createDataFrame([(1, 4, 3, "TWO's"), (2, 0, 0, "new"), (4, None, None, None), (1, 99, 0, " four")], "doc_id bigint, at int, removed int, inserted string")
    got = edited(prefixes(docs, PATH, PATTERN), edits, PATH, PATTERN).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, "one TWO's three"), (1, "one two three four"), (2, "new"), (3, "same"), (4, "x" * 400)]
    assert all(r.ids == ids_of(r.text) for r in got)
    assert {r.doc_id: r.worked for r in got}[3] == 0


def test_query_over_the_table(spark):
    got = {r.doc_id: r for r in prefix_bpe.op12_prefix_bpe(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        assert got[doc_id].ids_sha256 == hashlib.sha256(ids_of(text or "")).hexdigest()
