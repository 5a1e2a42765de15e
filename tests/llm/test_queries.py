import zlib

import pytest
from test_quality import junk, prose

from tidemark.llm import langid, quality, queries

COLUMNS = {
    "op1_simhash": "doc_id fingerprint component_id", "op2_multiset": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op3_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op4_quality": "doc_id held_out score predicted", "op5_reputation": "page_id host path rule verdict",
    "op6_ngram": "doc_id held_out n_tokens n_known train_tokens base_score score", "op7_webp": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op8_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op9_mixing": "doc_id size source_size target taken", "op10_langid": "doc_id held_out lang_pred score",
}


@pytest.fixture(scope="module")
def tables(spark, docs, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('tables')}"
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(0, 60, 2)] + [(None, 1, None), (7, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(i, f"https://Host{i % 3}.example.com/en/{i}", "") for i in range(20)] + [(20, None, None)], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_every_query_gives_its_contracts_columns(spark, tables, corpus, name):
    found = queries.QUERIES[name](spark, tables)
    assert set(COLUMNS[name].split()) <= set(found.columns)
    rows = found.collect()
    if name == "op5_reputation":
        assert len(rows) == 21 and {r.verdict for r in rows} <= {"allow", "block"}
    elif name == "op8_packing":
        assert {r.doc_id for r in rows} == {i for i, *_ in corpus}
    else:
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, *_ in corpus)
    modulus, kept = {"op4_quality": (5, 0), "op6_ngram": (10, 0), "op10_langid": (4, 2)}.get(name, (0, 0))
    for r in rows if modulus else ():
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % modulus == kept)
    if name == "op4_quality":
        assert all(r.predicted == int(r.score >= 0.3) for r in rows)


def test_langid_scores_and_labels_against_a_plain_version(spark):
    rows = [("der Hund und die Katze", "de"), ("the dog and the cat", "en"), ("die Katze schläft", "de"), ("a cat sleeps here", "en")]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"))
    points = lambda w: [0, *map(ord, w), 0]
    bins = lambda w: [((a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) >> 7) % langid.BINS for a, b, c in zip(points(w), points(w)[1:], points(w)[2:], strict=False)]
    counts = {lang: [0] * langid.BINS for lang in ("de", "en")}
    for text, lang in rows:
        for word in text.lower().split():
            for b in bins(word):
                counts[lang][b] += 1
    import math

    score = lambda w, lang: sum(math.log((counts[lang][b] + 0.5) / (sum(counts[lang]) + 0.5 * langid.BINS)) for b in bins(w))
    words = ["katze", "the", "sleeps", "unbekannt"]
    got, letters = langid.word_scores(model, words)
    assert letters.tolist() == [5, 3, 6, 9]
    for i, w in enumerate(words):
        assert got[i].tolist() == pytest.approx([score(w, "de"), score(w, "en")], rel=1e-4)


@pytest.mark.parametrize("text", ["½", "②", "Ⅷ 12", "_ - !", "́"])
def test_what_isnt_a_letter_has_no_language(spark, text):
    import pyarrow as pa

    model = langid.train(spark.createDataFrame([("the cat", "en"), ("die Katze", "de")], "text string, lang string"))
    assert langid.predict_batch(model, pa.array([text])) [0] == ["und"]


def test_class_prior_without_negative_labels():
    import random

    import numpy as np

    rng = random.Random(3)
    good = np.array([quality.statistics(prose(rng, 60)) for _ in range(400)], float)
    web = np.array([quality.statistics(prose(rng, 60) if i % 10 < 7 else junk(rng, 60)) for i in range(800)], float)
    assert 0.6 < quality.class_prior(good, web) < 0.8


def test_added_tokens_stand_for_themselves():
    import numpy as np

    from tidemark.llm import packing

    got = np.frombuffer(packing.Encoder(queries.byte_bpe()).encode("a <|endoftext|> b"), "<u4").tolist()
    assert got == [64, 220, 50256, 275]


def test_internal_names_dont_meet_the_callers(spark, docs):
    from pyspark.sql import functions as F

    from tidemark.llm import mixing, overlap, simhash

    names = ("__size", "__source", "__at", "__stratum", "__copy", "__of", "__target", "__gone", "gone", "GONE_", "row")
    odd = docs.withColumns({n: F.lit(n) for n in names})
    for keep in (simhash.keep_one, overlap.keep_one, mixing.mix):
        kept = keep(odd)
        assert kept.columns == odd.columns
        rows = kept.select(*names).distinct().collect()
        assert [tuple(r) for r in rows] == [names]
