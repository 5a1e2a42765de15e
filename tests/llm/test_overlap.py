import random
from itertools import combinations

import corpus_pipeline
import numpy as np
import pytest
from conftest import prose
from pyspark.sql import functions as F
from test_simhash import brute_components

from tidemark.llm import overlap
from tidemark.llm.simhash import fingerprint


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b) > 0


@pytest.fixture(scope="module")
def edited():
    """Copies with a word changed here and there around a few texts, so that overlaps lie around 0.8 and buckets are crowded."""
    rng, rows = random.Random(11), []
    for base in range(6):
        words = prose(rng, rng.choice((40, 150, 400))).split()
        for _ in range(60 if base == 0 else 12):
            own = list(words)
            for _ in range(rng.randint(0, max(2, len(words) // 40))):
                own[rng.randrange(len(own))] = f"other{rng.randrange(9999)}"
            rows.append((len(rows), " ".join(own)))
    return rows + [(900 + i, t) for i, t in enumerate(("", None, " \n", "one", "One", "a b c d", "a b c d e"))]


@pytest.mark.parametrize("cell", [overlap.CELL, 2000])
def test_against_brute_force(spark, edited, cell, monkeypatch):
    monkeypatch.setattr(overlap, "CELL", cell)
    sets = {i: shingles(t) for i, t in edited}
    want = brute_components([(a, b) for a, b in combinations(sets, 2) if alike(sets[a], sets[b])], list(sets))
    frame = spark.createDataFrame(edited, "doc_id long, text string").repartition(3)
    assert {r.id: r.component for r in overlap.near_duplicates(frame).collect()} == want


def test_every_pair_at_the_limit_is_found():
    """Sets that share eight ninths of their shingles, so a similarity of 0.8, share a key and pass the sketch."""
    rng, n = np.random.default_rng(4), 400
    common = rng.integers(0, 1 << 63, (n, 80)).astype(np.uint64)
    one, two = (overlap.min_hashes(np.concatenate([common, rng.integers(0, 1 << 63, (n, 10)).astype(np.uint64)], axis=1).reshape(-1), np.full(n, 90)) for _ in range(2))
    assert ((overlap.band_keys(one) == overlap.band_keys(two)).any(axis=1)).all()
    assert ((one == two).sum(axis=1) >= overlap.LEAST).all()
    other = overlap.min_hashes(rng.integers(0, 1 << 63, n * 90).astype(np.uint64), np.full(n, 90))
    assert not (overlap.band_keys(one) == overlap.band_keys(other)).any()


def test_the_pipelines_stage_drops_edited_copies(spark):
    words = prose(random.Random(2), 200).split()
    rows = [(1, " ".join(words)), (2, " ".join([*words[:50], "edited", *words[51:120], "twice", *words[121:]])), (3, prose(random.Random(3), 200))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert alike(shingles(rows[0][1]), shingles(rows[1][1]))
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame, "").collect()) == [1, 3]


def test_fingerprints_link_without_min_hashes(spark, monkeypatch):
    """Without any min-hash key in common, copies within two bits are linked if their sets are alike, and only then."""
    monkeypatch.setattr(overlap, "band_keys", lambda least: np.random.default_rng().integers(0, 1 << 63, (len(least), overlap.BANDS)).astype(np.uint64))
    rng = random.Random(8)
    long, often = prose(rng, 4000), prose(rng, 30)
    near = [long + " end", long + " stop"]
    apart = [" ".join([often] * 60 + [prose(rng, 40)]) for _ in range(2)]  # repeats weigh in a fingerprint, not in a set
    rows = [*enumerate(near, 1), *enumerate(apart, 11), (21, prose(rng, 300))]
    prints = {i: fingerprint(t, overlap.SHINGLE) for i, t in rows}
    assert (prints[1] ^ prints[2]).bit_count() <= 2 and (prints[11] ^ prints[12]).bit_count() <= 2
    assert alike(*map(shingles, near)) and not alike(*map(shingles, apart))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.id: r.component for r in overlap.near_duplicates(frame).collect()} == {1: 1, 2: 1, 11: 11, 12: 12, 21: 21}


def test_edges(spark, docs, no_docs, clashing):
    assert overlap.keep_one(no_docs).count() == 0
    kept = overlap.keep_one(clashing)
    assert kept.columns == clashing.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 3 in ids and not any(100 <= (i or 0) < 140 for i in ids) and None in ids and ids.count(1) == 2
    same = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("all the same words here").alias("text"))
    assert overlap.near_duplicates(same).where("component = 0").count() == 3000
