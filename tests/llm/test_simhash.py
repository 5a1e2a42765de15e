import random
from itertools import combinations

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.components import components


def brute_print(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs, nodes):
    root = {n: n for n in nodes}
    for _ in nodes:
        changed = False
        for a, b in pairs:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
        if not changed:
            break
    return root


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB cÉ\t\n\x1c d", max_size=40))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_print(text)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=2))
def test_close_fingerprints_have_a_common_key(a, bits):
    b = a
    for x in bits:
        b ^= 1 << x
    _, keys_a = simhash.bucket_keys(np.array([a], np.uint64))
    _, keys_b = simhash.bucket_keys(np.array([b], np.uint64))
    assert set(keys_a) & set(keys_b)


def test_golay_code_is_perfect():
    index = simhash.golay_index()
    assert np.bincount(index, minlength=4096).tolist() == [2048] * 4096


def test_against_brute_force(docs, corpus):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(corpus)
    prints = {i: brute_print(t) for i, t, *_ in corpus}
    assert all(r.print & (2**64 - 1) == prints[r.id] for r in rows)
    pairs = [(a, b) for a, b in combinations([i for i in prints if i is not None], 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    root = brute_components(pairs, [i for i in prints if i is not None])
    assert all(r.component == root[r.id] for r in rows if r.id is not None)


def chains(spark):
    """Distinct fingerprints around a few centres, so that buckets are crowded."""
    rng, out = random.Random(3), set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(150):
            p = centre
            for _ in range(rng.randint(0, 5)):
                p ^= 1 << rng.randrange(64)
            out.add(p)
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in out)
    return signed, spark.createDataFrame([(p,) for p in signed], "print long")


def test_links_reach_all_close_pairs(spark):
    signed, frame = chains(spark)
    for bits in (0, 1, 2):
        for bucket in (4, 32, 10_000):
            found = [(r.a, r.b) for r in simhash.links(frame, bits, bucket).collect()]
            assert all(((a ^ b) & (2**64 - 1)).bit_count() <= bits for a, b in found)
            wanted = [(a, b) for a, b in combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= bits]
            assert brute_components(found, signed) == brute_components(wanted, signed), (bits, bucket)


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(i, i + 1) for i in range(400, 480)] + [(7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = brute_components(pairs, {x for p in pairs for x in p})
    assert all(found.get(n, n) == r for n, r in want.items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one(docs, no_docs, clashing, corpus):
    kept = simhash.keep_one(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert 3 in ids and not any(100 <= (i or 0) < 140 for i in ids) and None in ids and ids.count(1) == 2
    assert simhash.keep_one(no_docs).count() == 0 and simhash.near_duplicates(no_docs).count() == 0
    assert sorted(simhash.near_duplicates(clashing).select("id", "component").collect(), key=str) == sorted(simhash.near_duplicates(docs).select("id", "component").collect(), key=str)
    assert set(simhash.keep_one(clashing).columns) == set(clashing.columns)


def test_hot_group_is_no_hot_join(spark):
    same = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("all the same words here").alias("text"))
    rows = simhash.near_duplicates(same)
    assert rows.where("component = 0").count() == 3000


