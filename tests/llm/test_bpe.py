import hashlib
import struct

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyforge.llm import bpe
from tallyforge.llm.bpe import ByteLevelEncoder, Merges, decode, digests, encode

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
CODER = ByteLevelEncoder(PATH)


def ids_of(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    return struct.pack(f"<{len(ids)}I", *ids)


TEXTS = [
    "", " ", "\n\n  a", "Hello world's they'll 12345 !!", "a<|endoftext|> b<|endoftext|>", "<|endoftext|", "ß ü é 日本語 🎉🎉", "x" * 3000,
    " " * 500, "   a\x85b\x1c c", "ab" * 100 + "é" * 200, "aaa bbb\r\n\tccc  ", "́e‍",
]


@pytest.mark.parametrize("text", TEXTS)
def test_equals_library(text):
    ids = CODER.encode_batch([text, "between", text])
    assert ids[0] == ids[2] == ids_of(text)
    assert CODER.decode(ids[0]) == LIBRARY.decode(list(struct.unpack(f"<{len(ids[0]) // 4}I", ids[0])), skip_special_tokens=False) == text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=4))
def test_fuzz(batch):
    assert CODER.encode_batch(batch) == [ids_of(x) for x in batch]


def test_long_words_by_either_way():
    merges = Merges(PATH)
    for word in (b"internationalization", b"the" * 20, b"aaaaaaa", b"\xff\xfe\x00"):
        assert merges.encode_words([word]) == [merges._long(word)]


def test_frame(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(99, None), (None, "a"), (99, None)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, ids string")
    got = digests(decode(encode(docs, PATH), PATH)).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), len(ids_of(t or "")) // 4, hashlib.sha256(ids_of(t or "")).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert digests(decode(encode(docs.limit(0), PATH), PATH)).count() == 0


def test_kept_words_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_BYTES", 100_000)
    coder = ByteLevelEncoder(PATH)
    for i in range(40):
        batch = [f"{i}x{k}y" * 3 for k in range(100)] + ["a" * 5000 + chr(97 + i % 26)]
        assert coder.encode_batch(batch) == [ids_of(x) for x in batch]
        assert coder.words.bytes < 300_000 and sum(len(x) > bpe.KEPT_WORD for x in coder.words) <= 1
