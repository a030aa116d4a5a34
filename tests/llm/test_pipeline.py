import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tallyforge.llm import quality
from tests.llm.test_ngram_join import brute as near_groups
from tests.llm.test_pii import RULES

LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    texts = [" ".join(word() for _ in range(rng.randrange(20, 90))) for _ in range(60)]
    texts = [t if i % 4 else " ".join(x.upper() + "!!" for x in t.split()) for i, t in enumerate(texts)]
    texts += [t.replace(" ", "  ", 3) for t in texts[:20]] + [t + " " + word() for t in texts[:20]] + [f"{texts[5]} mail a{i}@b.example and 4111 1111 1111 1111" for i in range(3)]
    texts += [None, ""]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(not (t or "!!").split()[0].endswith("!!")) if t else 0, 0) for i, t in enumerate(texts) if i % 3]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model, extract = quality.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")), quality.Extractor()
    kept = [(i, t) for i, t in enumerate(texts) if model.score(extract.columns(t or "")) >= 0.7]
    assert 40 < len(kept) < len(texts)
    seen, once = set(), []
    for i, t in kept:
        key = hashlib.sha256(re.sub(r"[ \t-\r]+", " ", t or "").encode()).digest()
        if key not in seen:
            seen.add(key)
            once.append((i, t))
    assert len(once) < len(kept)
    heads = {c for i, _, c in near_groups(once)}
    single = [(i, t) for i, t in once if i in heads]
    assert len(single) < len(once)
    want = {}
    for i, t in single:
        for kind, rule in RULES.items():
            t = re.sub(rule, f"[{kind.upper()}]", t or "") if kind in ("email", "card") else t
        ids = np.array([*LIBRARY.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want[i] = ids
    assert got.groupby("doc_id").length.sum().to_dict() == {i: len(x) for i, x in want.items()}
    for r in got.itertuples():
        assert r.ids_crc32 == zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes())


def test_quality_stage_on_odd_tables(spark, tmp_path):
    """No documents, no labels, nulls, repeated rows, a very long text and a clashing column."""
    docs = spark.createDataFrame([(1, "a b " * 200_000, "x"), (2, None, "y"), (2, None, "y"), (None, "", None)], "doc_id bigint, text string, quality string")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for frame in (docs, docs.limit(0)):
        # Nothing is learned: every row scores 0.5 and goes.
        got = corpus_pipeline.keep_good(spark, frame, str(tmp_path))
        assert got.columns == docs.columns and got.count() == 0


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame([(1, None, None, None, None)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, docs, "").columns == docs.columns, name
        assert stage(spark, docs.limit(0), "").count() == 0
