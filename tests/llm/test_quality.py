import random
import zlib

import numpy as np
import pytest

from tidemark.llm import quality
from tidemark.llm.common import crc_remainder


def prose(rng, n):
    words = [rng.choice(("the", "and", "of", "to", "in")) if rng.random() < 0.4 else "".join(rng.choice(("an", "er", "ing", "tion", "ou", "re")) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return " ".join(w.capitalize() if i % 9 == 0 else w + "." * (i % 9 == 8) for i, w in enumerate(words))


def junk(rng, n):
    kind = rng.randrange(3)
    if kind == 0:
        return " ".join(rng.choice("ab cd ef gh".split()) + rng.choice(("###", "$$$", "%%%")) for _ in range(n))
    return " ".join(["spam"] * n) if kind == 1 else prose(rng, n).upper().replace(" ", "!! ")


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, 60) if i % 5 else junk(rng, 60)) for i in range(600)]
    labels = [(i, int(i % 5 > 0)) for i in range(0, 600, 2)] + [(None, 1), (4, None), (10**9, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy(tables):
    docs, labels = tables
    rows = quality.classify(docs, labels, lambda i: crc_remainder(i, 5) != 0).collect()
    held = [r for r in rows if zlib.crc32(str(r.id).encode()) % 5 == 0]
    assert len(held) > 60 and np.mean([(r.score >= 0.3) == (r.id % 5 > 0) for r in held]) > 0.95


def test_risk_never_chases_negative_estimates():
    rng = np.random.default_rng(0)
    good = rng.normal(1, 1, (500, quality.FEATURES))
    web = np.concatenate([rng.normal(1, 1, (800, quality.FEATURES)), rng.normal(-1, 1, (200, quality.FEATURES))])
    scorer = quality.fit(good, web, 0.8)
    assert scorer.score(rng.normal(1, 1, (300, quality.FEATURES))).mean() > 0.9 > 0.3 > scorer.score(rng.normal(-1, 1, (300, quality.FEATURES))).mean()


def test_edges(spark, docs, corpus, no_docs, clashing, tables):
    labels = tables[1]
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == len(corpus) and all(0 <= r.score <= 1 for r in rows)
    assert quality.classify(no_docs, labels).count() == 0
    none = quality.classify(docs, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    assert sorted(quality.classify(clashing, labels).collect(), key=str) == sorted(rows, key=str)
    assert quality.statistics(None).tolist() == quality.statistics("").tolist()
