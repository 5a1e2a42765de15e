import hashlib
import math
from collections import defaultdict
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, full, total = set(names), {}, sum(sizes.values())
    while left:
        share = Fraction(total - sum(full.values()), sum(weight[s] for s in left))
        over = {s for s in left if weight[s] * share > most * sizes[s]} or {s for s in left if weight[s] * share == most * sizes[s]}
        if not over:
            break
        full |= {s: most * sizes[s] for s in over}
        left -= over
    share = Fraction(total - sum(full.values()), sum(weight[s] for s in left)) if left else 0
    return {s: float(full[s] if s in full else weight[s] * share) for s in names}


@settings(max_examples=12, deadline=None)
@given(st.dictionaries(st.one_of(st.none(), st.sampled_from([f"s{i}" for i in range(12)])), st.integers(0, 5000), min_size=1))
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
    want = brute_targets(sizes)
    got = {r.source: (r.target, r.source_size) for r in mixing.targets(rows).collect()}
    assert set(got) == set(want)
    for s, t in want.items():
        assert got[s][0] == pytest.approx(t) and got[s][1] == sizes[s]


def brute_copies(rows):
    """Copies of rows (id, text, source) of fewer than 4096 a source: [(id, size, copies)] in the rows' order."""
    size, target = [len((t or "").split()) for _, t, _ in rows], defaultdict(int)
    for n, (*_, s) in zip(size, rows, strict=True):
        target[s] += n
    total, target = dict(target), brute_targets(dict(target))
    part = lambda text, a: int(hashlib.md5(text.encode()).hexdigest()[a : a + 8], 16) / 2**32
    out = [0] * len(rows)
    for s in total:
        rate = target[s] / total[s] if total[s] else 0.0
        start, fraction = part(f"{s or ''}:0:mix", 0), rate - math.floor(rate)
        key = lambda i: f"{rows[i][0] if rows[i][0] is not None else hashlib.md5(rows[i][1].encode()).hexdigest()}:mix"
        own = sorted((i for i in range(len(rows)) if rows[i][2] == s), key=lambda i: (-size[i], part(key(i), 0), part(key(i), 8)))
        for at, i in enumerate(own, 1):
            out[i] = math.floor(rate) + math.floor(fraction * at + start) - math.floor(fraction * (at - 1) + start)
    return [(i, n, c) for (i, *_), n, c in zip(rows, size, out, strict=True)]


def test_copies_against_brute_force(docs, corpus):
    got = sorted(((r.id, r["size"], r.copies) for r in mixing.copies(docs).collect()), key=str)
    assert got == sorted(brute_copies([(i, t, s) for i, t, _, s, _ in corpus]), key=str)


def test_copies(docs, corpus, no_docs, clashing):
    rows = mixing.copies(docs).collect()
    assert len(rows) == len(corpus)
    sizes = defaultdict(int)
    for _, text, _, source, _ in corpus:
        sizes[source] += len((text or "").split())
    want = brute_targets(dict(sizes))
    for r in rows:
        assert 0 <= r.copies <= 3 and r.target in [pytest.approx(t) for t in want.values()]
        if r.source_size:
            assert int(r.target / r.source_size) <= r.copies <= int(r.target / r.source_size) + 1
        else:
            assert r.copies == 0
    assert sorted(mixing.copies(docs.repartition(7)).collect(), key=str) == sorted(rows, key=str) == sorted(mixing.copies(clashing).collect(), key=str)
    assert mixing.copies(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0


def test_mix_repeats_rows(docs, clashing):
    taken = defaultdict(int)
    for r in mixing.copies(docs).collect():
        taken[r.id] += r.copies
    held = defaultdict(int)
    for r in mixing.mix(docs).collect():
        held[r.doc_id] += 1
    assert {k: v for k, v in taken.items() if v} == dict(held)
    assert mixing.mix(clashing).columns == clashing.columns


def test_draws_come_near_the_targets(spark, monkeypatch):
    rows = spark.range(6000).selectExpr("id as doc_id", "concat('s', id % 3) as source", "repeat('w ', cast(id % 40 + 1 as int)) as text")
    for stratum in (4096, 100):
        monkeypatch.setattr(mixing, "STRATUM", stratum)
        got = defaultdict(int)
        for r in mixing.copies(rows).collect():
            got[r.target] += r["size"] * r.copies
        assert len(got) == 3 and all(abs(v - t) < 0.01 * t for t, v in got.items())
