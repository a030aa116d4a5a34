import itertools

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm.langid import LEAST, START, Lattice, expected_counts, predict, letter_runs, sample_shares, train, vocabulary, word_scores

NAMES = ["", START, "a", "b", "ab", "ba", START + "a", "bab", "aa"]
LATTICE = Lattice(NAMES)
LOGP = np.log(np.random.default_rng(3).dirichlet(np.ones(len(NAMES)), 2).T)


def segmentations(word):
    """All ways to cut a word into pieces, unknown letters as piece 0."""
    if not word:
        yield ()
    for n in range(1, len(word) + 1):
        head = word[:n]
        piece = NAMES.index(head) if head in NAMES else 0 if n == 1 else None
        if piece is not None:
            for rest in segmentations(word[n:]):
                yield (piece, *rest)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abx", min_size=1, max_size=7), min_size=1, max_size=5))
def test_sums_all_segmentations(words):
    got = word_scores(LATTICE, words, LOGP)
    counts = np.arange(1, 2 * len(words) + 1, dtype=float).reshape(-1, 2)
    want_counts = np.zeros_like(LOGP)
    for word, row, weight in zip(words, got, counts, strict=True):
        ways = list(segmentations(START + word))
        p = np.array([np.exp(LOGP[list(w)].sum(axis=0)) for w in ways])
        assert np.allclose(row, np.log(p.sum(axis=0)))
        for way, share in zip(ways, p / p.sum(axis=0), strict=True):
            for piece in way:
                want_counts[piece] += share * weight
    assert np.allclose(expected_counts(LATTICE, words, counts, LOGP), want_counts)


@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=30) | st.text(alphabet="a½²Ⅷé_1 日", max_size=12))
def test_letter_runs(text):
    assert letter_runs(text) == [x for x in "".join(c if c.isalpha() else " " for c in text).split(" ") if x]


def test_long_word_stays_finite():
    assert np.isfinite(word_scores(LATTICE, ["ab" * 5000], LOGP)).all()


def test_frame(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    assert START in vocabulary(path)
    texts = {"en": "the house and the garden with that which is there", "de": "das haus und der garten mit dem was dort ist", "fr": "la maison et le jardin avec ce qui est dans"}
    rows = [(i, lang, " ".join(np.roll(text.split(), i))) for i, (lang, text) in enumerate(itertools.islice(itertools.cycle(texts.items()), 120))]
    rows += [(500, "en", None), (501, None, ""), (502, "de", "123 !!"), (None, "fr", "Le jardin est dans la maison"), (503, None, "日本語"), (504, "en", "½ ² Ⅷ 12")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id bigint, lang string, text string, score double")
    model = train(docs, path)
    assert model.languages == ["de", "en", "fr"]
    assert np.allclose(np.exp(model.logp).sum(axis=0), 1)
    got = {r.doc_id: r for r in predict(docs, model).collect()}
    assert all(got[i].lang_pred == lang and got[i].score > 0.9 for i, lang, _ in rows[:120])
    assert {got[i].lang_pred for i in (500, 501, 502, 504)} == {"und"} and got[None].lang_pred == "fr" and got[503].lang_pred in model.languages
    assert predict(docs.limit(0), model).count() == 0
    nothing = predict(docs, train(docs.limit(0), path)).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_learns_rare_languages_of_a_large_table(spark):
    """Six languages with four rows each among 4,000 rows of two others, and a sample of 120 documents."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = [(i, "en", "the house and the garden with that which is there") if i % 2 else (i, "de", "das haus und der garten mit dem was dort ist") for i in range(4000)]
    rare = {"fr": "la maison et le jardin avec ce qui est", "es": "la casa y el huerto con lo que hay", "it": "gli uomini della casa sono nel giardino", "sv": "huset och den stora byn som är där", "pl": "dom oraz ten ogród który jest tam", "fi": "talo ja puutarha joka on siellä"}
    rows += [(10_000 + 100 * k + i, lang, text) for k, (lang, text) in enumerate(rare.items()) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    model = train(docs, path, max_docs=120)
    assert model.languages == sorted({"en", "de", *rare})
    share = dict(zip(model.languages, np.exp(model.prior), strict=True))
    assert abs(sum(share.values()) - 1) < 1e-9 and 0.3 < share["en"] < 0.7 and share["fr"] < 0.01
    got = predict(docs, model).where("doc_id >= 10000").collect()
    assert {r.doc_id: r.lang_pred for r in got} == {i: lang for i, lang, _ in rows if i >= 10_000}


def test_sample_shares():
    assert sample_shares({}, 100) == {} and sample_shares({"a": 30, "b": 60}, 100) == {"a": 1.0, "b": 1.0}
    assert sample_shares({"a": 100, "b": 10_000, "c": 100_000}, 4100) == {"a": 1.0, "b": 0.2, "c": 0.02}
    many = sample_shares({str(i): 1000 for i in range(200)}, 100)
    assert set(many.values()) == {LEAST / 1000}
