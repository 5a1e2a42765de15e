import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import packing
from tidemark.llm.queries import byte_bpe


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(byte_bpe())
    return t


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(byte_bpe())


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.text(max_size=30), st.lists(st.sampled_from(["a", " ", "  ", "\n", "it's", "'ll", "12", "!", "é", "\xa0", "\x1c", "\x85", "<|endoftext|>", "漢"]), max_size=15).map("".join)))
def test_ids_are_the_tokenizers(tokenizer, encoder, text):
    assert encoder.encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def brute_fit(lengths, size):
    rooms, window = [], [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fit = [r for r in rooms if r >= lengths[i]]
        room = min(fit) if fit else size
        if fit:
            rooms.remove(room)
        window[i] = room
        if room - lengths[i]:
            rooms.append(room - lengths[i])
    return window


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 37), max_size=80))
def test_best_fit_takes_the_tightest_window(lengths):
    window, offset = packing.best_fit(lengths, 37)
    assert [37 - o for o in offset] == brute_fit(lengths, 37)
    held = defaultdict(list)
    for n, w, o in zip(lengths, window, offset, strict=True):
        held[w].append((o, n))
    for parts in held.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 37


def check(rows, corpus, tokenizer, size=1024):
    windows, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
        docs[r.id].append(r)
    for parts in windows.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(n for _, n in parts) <= size
    for i, text, *_ in corpus:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted(docs[i], key=lambda r: r.start)
        copies = len(own) // len({r.start for r in own})
        at = 0
        for r in own[::copies]:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()) and r.doc_tokens == len(ids)
            at += r.length
        assert at == len(ids)


def test_all_ids_in_gapless_windows(docs, corpus, tokenizer, clashing, no_docs):
    rows = packing.pack(packing.pieces(docs, byte_bpe())).collect()
    check(rows, corpus, tokenizer)
    assert sum(r.id == 1 for r in rows) == 2
    used = sum(r.length for r in rows)
    assert used >= 0.97 * 1024 * len({r.sequence_id for r in rows}) - 1024 * 8
    assert packing.pack(packing.pieces(no_docs, byte_bpe())).count() == 0
    assert packing.pack(packing.pieces(clashing, byte_bpe())).count() == len(rows)


def test_runs_of_pieces(docs, corpus, tokenizer, monkeypatch):
    random.seed(1)
    monkeypatch.setattr(packing, "TOGETHER", 16)
    check(packing.pack(packing.pieces(docs, byte_bpe())).collect(), corpus, tokenizer)
