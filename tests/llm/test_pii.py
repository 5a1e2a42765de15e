import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            double = [int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(reversed(digits))]
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and sum(double) % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((*m.span(), kind))
    return sorted(out, key=lambda s: (s[0], pii.BASE.index(s[2])))


PARTS = st.sampled_from(["a", "b.c", "@", ".", "-", "_", "+1", " ", "(", ")", "4111 1111 1111 1111", "10.0.0.1", "256", "0007", "x@y.z", "é", "4111-1111", "\n", "+49 (30) 555-1234", "9"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PARTS, max_size=14).map("".join))
def test_base_spans(text):
    assert pii.base_spans(text) == brute(text)


def test_long_runs_take_linear_time():
    for text in ("7" * 200_000, "a" * 200_000, "@" * 100_000, "1." * 100_000, "+1" * 100_000):
        pii.base_spans(text)


def test_field_on_other_rows_of_the_table():
    field, rows = pii.default_field(), pii.labelled_table(150, seed=99)
    found = pii.find_batch(field, [t for t, _ in rows])
    hit = sum(len(set(s) & set(a)) for (_, s), (_, a) in zip(rows, found, strict=True))
    valid = sum(1 for t, s in rows for a, b, k in s if pii._plausible(k, t[a:b]))
    extra = sum(len(set(a) - set(s)) for (_, s), (_, a) in zip(rows, found, strict=True))
    assert hit >= 0.95 * valid and extra <= 0.05 * valid


def whole_viterbi(field, scores):
    """The plain algorithm over one whole sequence."""
    best, back = scores[0].astype(float), []
    for row in scores[1:]:
        reach = best[:, None] + field.move
        back.append(reach.argmax(axis=0))
        best = reach.max(axis=0) + row
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    field = pii.Field(np.zeros(0, np.int64), np.zeros((1, 3)), rng.normal(size=(3, 3)))
    for n in (1, 2, 5):
        emit = rng.normal(size=(n, 3))
        paths = np.array(np.meshgrid(*[range(3)] * n)).reshape(n, -1).T
        scores = [emit[np.arange(n), p].sum() + sum(field.move[a, b] for a, b in zip(p, p[1:], strict=False)) for p in paths]
        got = pii.decode(field, np.concatenate([emit, rng.normal(size=(7, 3))]), np.array([n, 7]))
        assert got[:n].tolist() == paths[int(np.argmax(scores))].tolist() == whole_viterbi(field, emit)


def test_cutting_at_sure_tokens_keeps_the_best_path():
    field = pii.default_field()
    texts = [t for t, _ in pii.labelled_table(80, seed=5)]
    texts.append(" ".join(texts[:30]))
    tokens = pii.tokens_of(texts)
    scores, lengths = pii.emissions(field, tokens), np.bincount(tokens.owner)
    want = np.concatenate([whole_viterbi(field, x) for x in np.split(scores, np.cumsum(lengths)[:-1])])
    assert pii.decode(field, scores, lengths).tolist() == want.tolist() and want.any()


TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab Z9\u0664\u00bd_@.\n\u00e9\U0001f600\u4e2d"), max_size=30), max_size=5))
def test_tokens_and_features_against_a_plain_version(texts):
    tokens = pii.tokens_of(texts)
    want = [(i, m.start(), m.end()) for i, t in enumerate(texts) for m in TOKEN.finditer(t)]
    assert list(zip(tokens.owner.tolist(), tokens.start.tolist(), tokens.end.tolist(), strict=True)) == want
    whole = pii.features(tokens, 0, len(want))
    for at in range(len(want)):
        assert (pii.features(tokens, at, at + 1) == whole[at]).all()


def test_cue_words_reach_six_tokens():
    tokens = pii.tokens_of(["a Password b c d e f g h", "i"])
    assert [int(i > 0) for i in tokens.cue] == [0, 1, 0, 0, 0, 0, 0, 0, 0, 0]
    near = pii.features(tokens, 0, 10)[:, 6] & 0xFF
    assert (near > 0).tolist() == [False, False] + [True] * 6 + [False, False]


def test_a_long_secret_is_one_span():
    text = "see token = \"" + "0123456789abcdef" * 400 + "\" here"
    (_, spans), = pii.find_batch(pii.default_field(), [text])
    assert spans == [(13, 13 + 6400, "secret")]


def test_clean_text_is_left_alone():
    clean = ["Chapter 12 has 345 pages, 2024-01-03, 12:30 and $9.99.", "Version 1.2.3 of 10,000,000 items", "met at noon dot the end", ""]
    assert [a for _, a in pii.find_batch(pii.default_field(), clean)] == [[], [], [], []]


def test_frames(spark, docs, no_docs, clashing):
    rows = spark.createDataFrame([(1, "mail a.b@c.de or é +1 (843) 555-4223", 40), (2, None, None), (None, "", 0), (1, 'token = "254a3ed195c502ef96b5857aa82e5fbcfb6b6856" x', 9)], "doc_id long, text string, n_chars int")
    found = {(r.id, r.base): r.spans for r in pii.find(rows).collect()}
    assert found[(1, "email:5:13,phone:19:36")] == "email:5:13,phone:19:36"
    assert found[(1, "")].startswith("secret:9:") and found[(2, "")] == "" and found[(None, "")] == ""
    masked = {r.text: r.n_chars for r in pii.mask(rows).collect()}
    assert masked["mail [EMAIL] or é [PHONE]"] == 25 and masked[None] is None and masked['token = "[SECRET]" x'] == 20
    assert pii.find(no_docs).count() == 0 and pii.mask(no_docs).count() == 0
    assert sorted(pii.find(clashing).collect(), key=str) == sorted(pii.find(docs).collect(), key=str)
    assert pii.mask(clashing).columns == clashing.columns


def test_every_spelled_out_form_is_found():
    forms = [f"marto{at}erlima{dot}com" for at in (" at ", " [at] ", "[at]", " (at) ") for dot in (" dot ", " [dot] ", "[dot]", " (dot) ")]
    texts = [f"The other words stand here, {form}. Others follow." for form in forms]
    found = [s for _, s in pii.find_batch(pii.default_field(), texts)]
    assert [pii.masked(t, s) for t, s in zip(texts, found, strict=True)] == ["The other words stand here, [EMAIL]. Others follow."] * 16


def test_dense_text_is_not_cut():
    one = "iban DE12 3456 7890 1234 5678 90, call (555) 123-4567 "
    text = one * 120
    (_, found), = pii.find_batch(pii.default_field(), [text])
    want = [(at + a, at + b, k) for at in range(0, len(text), len(one)) for a, b, k in ((5, 32, "account"), (39, 53, "phone"))]
    assert len(set(want) - set(found)) == 0
