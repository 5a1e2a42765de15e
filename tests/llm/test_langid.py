from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import langid

TEXTS = {
    "en": "the quick brown fox jumps over the lazy dog and runs through the old forest with all of his friends while the sun is shining",
    "de": "der schnelle braune fuchs springt über den faulen hund und läuft durch den alten wald mit allen seinen freunden während die sonne scheint",
    "ru": "быстрая коричневая лиса прыгает через ленивую собаку и бежит через старый лес со всеми своими друзьями пока светит солнце",
}


@pytest.fixture(scope="module")
def model(spark):
    rows = [(t, lang) for lang, t in TEXTS.items() for _ in range(4)] + [(None, "en"), ("ignored words", None), ("", "de")]
    return langid.train(spark.createDataFrame(rows, "text string, lang string"))


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    lengths = np.array([4, 0, 1, 6, 2, 6])
    scores = rng.normal(scale=3, size=(int(lengths.sum()), 3))
    labels, at = langid.viterbi(scores, lengths, 2.0), 0
    for n in lengths:
        own = scores[at : at + n]
        best = max((sum(own[i, p] for i, p in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:], strict=False)), path) for path in product(range(3), repeat=int(n))) if n else (0, ())
        assert tuple(labels[at : at + n]) == best[1]
        at += n


def test_words_split_the_same_whatever_the_batch(model):
    texts = [TEXTS["en"], TEXTS["de"], None, "", "123 !!", "Sonne"]
    whole = langid.predict_batch(model, pa.array(texts))
    single = [langid.predict_batch(model, pa.array([t], pa.string())) for t in texts]
    assert whole[0] == [s[0][0] for s in single] and whole[2] == [s[2][0] for s in single]
    assert whole[0] == ["en", "de", "und", "und", "und", "de"] and whole[1][2:5].tolist() == [0, 0, 0]


def test_scripts_narrow_and_spans_follow(model):
    assert model.languages == ["de", "en", "ru"]
    text = TEXTS["en"] + " " + TEXTS["ru"]
    (lang,), (score,), (spans,) = langid.predict_batch(model, pa.array([text]))
    cut = len(TEXTS["en"]) + 1
    assert spans == f"en:0:{cut},ru:{cut}:{len(text)}" and 0.5 <= score < 1 and lang in ("en", "ru")
    assert langid.predict_batch(model, pa.array(["漢字"]))[0][0] in model.languages


def test_nothing_learned(spark, docs):
    empty = langid.train(spark.createDataFrame([], "text string, lang string"))
    assert {r.lang_pred for r in langid.predict(docs, empty).collect()} == {"und"}


def test_frames(docs, corpus, no_docs, clashing, model):
    rows = langid.predict(docs, model).collect()
    assert len(rows) == len(corpus) and all(0 <= r.score <= 1 for r in rows)
    held = {r.id: r.lang_pred for r in rows}
    assert held[200] == held[201] == held[202] == "und" and held[203] != "und"
    assert langid.predict(no_docs, model).count() == 0 and langid.keep_known(no_docs, model).count() == 0
    kept = langid.keep_known(clashing, model, least=0.3)
    assert kept.columns == clashing.columns and {200, 201, 202}.isdisjoint(r.doc_id for r in kept.collect())


def test_scoring_of_long_texts_holds_little_memory():
    import tracemalloc

    distinct = [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576 % 26)}langword" for i in range(80_000)]
    model = langid.Model(["de", "en"], np.zeros((langid.BINS, 2), np.float32), np.ones((14, 2), bool))
    tracemalloc.start()
    try:
        langid.word_scores(model, distinct)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 40 << 20
