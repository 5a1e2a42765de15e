import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COMMON = "the and of to in is that for it as was with be by on not he his but at".split()


def prose(rng, n):
    made = lambda: "".join(rng.choice(("an", "the", "er", "ing", "tion", "ou", "re", "le", "st", "on")) for _ in range(rng.randint(1, 4)))
    words = [rng.choice(COMMON) if rng.random() < 0.4 else made() for _ in range(n)]
    out = ""
    for i, w in enumerate(words):
        out += (w.capitalize() if i % 9 == 0 else w) + (".\n" if i % 27 == 26 else ". " if i % 9 == 8 else " ")
    return out.strip()


@pytest.fixture(scope="session")
def corpus():
    """Rows with copies, near copies, nulls, empty and long texts, repeated rows and null ids."""
    rng = random.Random(5)
    rows = []
    for i in range(60):
        text = prose(rng, rng.randint(1, 120))
        rows.append((i, text, ("en", "de", None)[i % 3], f"s{i % 4}" if i % 7 else None, len(text)))
    rows += [(100 + k, rows[3][1], "en", "s1", None) for k in range(40)]
    rows += [(200, None, None, None, None), (201, "", "en", "s0", 0), (202, " \t\n", "en", "s0", 3), (203, "one", "en", "s2", 3), (204, "a b", "en", "s2", 3)]
    rows += [(205, prose(rng, 6000), "en", "s3", None), (206, "word " * 3000, "en", "s3", None), (None, "text without an id here", "en", "s1", None), (1, rows[1][1], rows[1][2], rows[1][3], rows[1][4])]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("x") for c in ("id", "print", "key", "score", "size", "copies", "start", "bucket", "hashes", "media", "spans", "component", "fingerprint")})
