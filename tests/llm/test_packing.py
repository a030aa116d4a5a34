import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyforge.llm.packing import ChunkTokenizer, Packer, pack, piece_digests

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
CODER = ChunkTokenizer(PATH)


def ids_of(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60) | st.text(alphabet="aB'sé \t\n\x85\xa0\x1c1,<|", max_size=40), max_size=4))
def test_ids_equal_library(batch):
    assert [np.frombuffer(x, "<u4").tolist() for x in CODER.encode_batch(batch)] == [ids_of(x) for x in batch]


def test_ids_of_marks():
    for text in ("a<|endoftext|>b", "<|startoftext|>", "Σίσυφος ΟΔΟΣ", "é É", "they'LL"):
        assert np.frombuffer(CODER.encode_batch([text])[0], "<u4").tolist() == ids_of(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 9000), max_size=60), st.integers(1, 20_000))
def test_packer_covers_each_token_once(sizes, pool):
    packer = Packer(0, pool_tokens=pool)
    for i, n in enumerate(sizes):
        packer.add(i, np.arange(n))
    packer.finish()
    docs, sequences, steps = defaultdict(list), defaultdict(list), defaultdict(dict)
    for doc, start, ids, total, seq, offset, context, step in packer.rows:
        assert len(ids) and total == sizes[doc] and ids[0] == start
        docs[doc].append((start, len(ids)))
        sequences[seq].append((offset, len(ids), context))
        steps[step][seq] = context
    for i, n in enumerate(sizes):
        at = 0
        for start, length in sorted(docs[i]):
            assert start == at
            at += length
        assert at == n
    for parts in sequences.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at == parts[0][2] and at & (at - 1) == 0 and at <= 2048
    assert all(sum(x.values()) <= 64 * 2048 for x in steps.values())


def test_frame(spark):
    rows = [(i, "Some words of a text, " * (i * 37 % 400)) for i in range(150)] + [(7, None), (7, None), (None, "x"), (500, "long text " * 30_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, start int").repartition(3)
    got = piece_digests(pack(docs, PATH)).toPandas()
    want = sum(len(ids_of(t or "")) + 1 for _, t in rows)
    assert got.length.sum() == want
    for (_, g) in got.groupby("sequence_id"):
        assert g.sort_values("offset").length.cumsum().shift(fill_value=0).tolist() == sorted(g.offset) and g.length.sum() == g.context.iloc[0]
    long = got[got.doc_id == 500].sort_values("start")
    ids = np.array([*ids_of(rows[-1][1]), 1], dtype="<u4")
    assert long.doc_tokens.unique().tolist() == [len(ids)]
    assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(long.start, long.length)] == long.ids_crc32.tolist()
    assert len(got[got.doc_id == 7]) == 3
    assert pack(docs.limit(0), PATH).count() == 0
