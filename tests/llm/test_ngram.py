import math
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs

from tidemark.llm import eliasfano, ngram
from tidemark.llm.eliasfano import Sequence, encode


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2**50), max_size=400), st.lists(st.integers(0, 2**50), max_size=30))
def test_sequences(values, queries):
    values = np.sort(np.array(values, np.int64))
    s = Sequence(encode(values))
    at = np.arange(len(values))
    assert s.get(at).tolist() == values.tolist()
    keys = np.sort(np.array([*queries, *values[::3].tolist()], np.int64))
    place, same = s.lower_bound(keys)
    assert place.tolist() == np.searchsorted(values, keys).tolist() and same.tolist() == np.isin(keys, values).tolist()


def test_sparse_lookups_skip_blocks():
    values = np.cumsum(np.random.default_rng(0).integers(1, 1000, 200_000))
    s = Sequence(encode(values))
    keys = np.sort(np.concatenate([values[[5, 70_000, 199_999]], values[[9, 150_000]] + 1]))
    assert s.lower_bound(keys)[0].tolist() == np.searchsorted(values, keys).tolist()


def brute(train, texts, order=3, discount=ngram.DISCOUNT):
    split = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()  # noqa: E731  (the corpus has ASCII white space only)
    lists = [["<s>", *split(t), "</s>"] for t in train]
    counts = [Counter() for _ in range(order + 1)]
    for words in lists:
        for k in range(1, order + 1):
            for i in range(len(words) - k + 1):
                gram = tuple(words[i : i + k])
                if (k > 1 or gram != ("<s>",)) and not (k > 2 and gram[0] == "<s>"):
                    counts[k][gram] += 1
    n = sum(counts[1].values())
    once = sum(c == 1 for c in counts[1].values())
    kept = [None, None, *({g: c for g, c in counts[k].items() if c >= ngram.LEAST} for k in range(2, order + 1))]
    for k in range(3, order + 1):
        kept[k] = {g: c for g, c in kept[k].items() if g[:-1] in kept[k - 1] and g[1:] in kept[k - 1]}
    unknown = (once + 0.5) / (n + 1)
    total = lambda c: len(train) if c == ("<s>",) else counts[len(c)][c]
    held = Counter()
    for k in range(2, order + 1):
        for g, c in kept[k].items():
            held[g[:-1]] += (c - discount) / total(g[:-1])

    def p(words, i):
        w = words[i]
        value = counts[1][(w,)] / n * (1 - unknown) if (w,) in counts[1] else unknown
        for k in range(2, order + 1):
            if i - k + 1 < 0:
                break
            context = tuple(words[i - k + 1 : i])
            value *= max(0, 1 - held[context]) if context in held else 1
            if context + (w,) in kept[k]:
                value += (kept[k][context + (w,)] - discount) / total(context)
        return value

    out = []
    for t in texts:
        words = ["<s>", *split(t), "</s>"]
        own = [words[i] for i in range(1, len(words))]
        out.append((len(own), sum((w,) in counts[1] for w in own), sum(math.log10((counts[1][(w,)] + 0.1) / (n + 0.1 * (len(counts[1]) + 1))) for w in own), sum(math.log10(p(words, i)) for i in range(1, len(words)))))
    return n, out


@pytest.mark.parametrize("together", [ngram.TOGETHER, 500])
def test_scores_against_brute_force(spark, docs, corpus, together, monkeypatch):
    monkeypatch.setattr(ngram, "TOGETHER", together)
    train = docs.where("doc_id % 10 > 2")
    n, want = brute([t for i, t, *_ in corpus if i is not None and i % 10 > 2], [t for _, t, *_ in corpus])
    trie = ngram.train(train)
    assert trie.tokens == n and len(trie.levels) == 3 and sum(s.n for s in trie.levels[2]) > 0
    got = {}
    for r in ngram.score(docs, trie).collect():
        got.setdefault(r.id, r)
    for (i, *_), (tokens, known, base, score) in zip(corpus, want, strict=True):
        assert (got[i].n_tokens, got[i].n_known) == (tokens, known)
        assert got[i].base_score == pytest.approx(base) and got[i].score == pytest.approx(score, abs=3e-4 * tokens), i  # steps of 1/4096


def test_probabilities_sum_to_one(spark, docs, corpus):
    trie = ngram.train(docs)
    words = sorted({w for _, t, *_ in corpus for w in (t or "").lower().split()})
    for context in ("", "the", "of the"):
        texts = [f"{context} {w}" for w in [*words, "neverseenbefore"]]
        scored = spark.createDataFrame(list(enumerate([*texts, context])), "doc_id long, text string")
        rows = sorted((r.id, r.score) for r in ngram.score(scored, trie).collect())
        assert len(rows) == len(texts) + 1 and all(s < 0 for _, s in rows)


def test_edges(spark, docs, no_docs, clashing, corpus):
    empty = ngram.train(no_docs)
    rows = ngram.score(docs, empty).collect()
    assert len(rows) == len(corpus) and all(r.n_known == 0 and r.score <= 0 for r in rows)
    one = ngram.train(docs.where("doc_id = 201"))
    assert one.tokens == 1 and ngram.score(docs, one).where("id = 201").first().n_known == 1
    trie = ngram.train(docs)
    assert ngram.score(no_docs, trie).count() == 0
    assert sorted(ngram.score(clashing, trie).collect(), key=str) == sorted(ngram.score(docs, trie).collect(), key=str)


def test_ngrams_seen_once_are_kept(spark):
    rows = [(1, "p q r s t"), (2, "p u r v t"), (3, "t q p")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    trie = ngram.train(frame)
    lists = [["<s>", *t.split(), "</s>"] for _, t in rows]
    pairs = {tuple(w[i : i + 2]) for w in lists for i in range(len(w) - 1)}
    triples = {tuple(w[i : i + 3]) for w in lists for i in range(1, len(w) - 2)}
    assert [sum(s.n for s in level) for level in trie.levels[1:]] == [len(pairs), len(triples)]
    seen, unseen = (ngram.score(spark.createDataFrame([(1, t)], "doc_id long, text string"), trie).first().score for t in ("q r s", "q v s"))
    assert seen > unseen + 1


def test_shards_are_bounded(spark, docs, monkeypatch):
    hot = " ".join(f"a b w{i}" for i in range(1500))
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(900, hot)], "doc_id long, text string")).coalesce(1)
    whole = ngram.train(frame)
    want = sorted((r for r in ngram.score(frame, whole).collect()), key=str)
    monkeypatch.setattr(ngram, "SHARD", 200)
    cut = ngram.train(frame)
    assert [sum(s.n for s in level) for level in cut.levels] == [sum(s.n for s in level) for level in whole.levels]
    assert max(s.n for level in cut.levels for s in level) <= 400
    got = sorted((r for r in ngram.score(frame, cut).collect()), key=str)
    for a, b in zip(got, want, strict=True):
        assert a[:4] == b[:4] and a.score == pytest.approx(b.score, abs=3e-4 * a.n_tokens)


def test_fans(spark, docs):
    trie = ngram.train(docs, order=4)
    for level in (2, 3, 4):
        keys = np.concatenate([ngram.sequence(s.path, "keys").get(np.arange(s.n)) for s in trie.levels[level - 1] if s.n])
        parent, child = keys >> trie.widths[level - 2], keys & ((1 << trie.widths[level - 2]) - 1)
        known = parent < sum(s.n for s in trie.levels[level - 2])  # all but the start symbol
        assert (child[known] < ngram._fans(trie, level, parent[known])).all()


def test_lookups_hold_nothing_of_a_sequence():
    values = np.cumsum(np.random.default_rng(0).integers(1, 1000, 1_000_000))
    s = Sequence(encode(values))
    tracemalloc.start()
    s.lower_bound(values[[5, 700_000]]), s.get(np.array([9, 999_999]))
    held, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 50_000


def test_files_that_are_not_mounted_are_copied(tmp_path, monkeypatch):
    monkeypatch.setenv("SPARK_LOCAL_DIRS", f"{tmp_path}/own")
    (tmp_path / "own").mkdir()
    eliasfano.save(f"{tmp_path}/far/x.trie", {"a": np.arange(1000)})
    monkeypatch.setattr(eliasfano, "_place", lambda path: (fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem()), path.removeprefix(str(tmp_path))))
    assert eliasfano.open_file(f"{tmp_path}/far/x.trie")["a"].tolist() == list(range(1000))
    assert len(list((tmp_path / "own").iterdir())) == 1
