"""Personal data: exact patterns, and a linear-chain conditional random field over word-shape features.

The patterns find e-mail addresses, IPv4 addresses, payment cards and international phone numbers. The field adds what
they can't: spelled-out addresses, national phone numbers, identity numbers, account numbers and secrets. It is trained
on a small labelled table (``labelled_table``, or the caller's), by gradient ascent on the likelihood, and decoded by
Viterbi over whole texts in numpy batches. A token whose score for no kind leads by more than any transitions around it
can make up for has no kind on every best path; texts are cut there, which leaves the best path as it is, and only the
stretches between such tokens go through the lattice. The patterns' spans stay, and the field's never overlap them.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "id", "account", "secret")
#: Patterns; each is scanned in linear time.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Words that tell what follows; tokens that such a word reaches.
CUES = ("token", "secret", "password", "passwd", "key", "apikey", "ssn", "iban", "account", "passport", "tel", "phone", "call", "fax", "mobile", "email", "mail", "at", "dot", "id", "card", "number", "no")
REACH = 6
#: Tokens whose features are made at once, with neighbours beside them; tokens, with padding, decoded together; characters
#: of the texts handled together.
AT_ONCE, BESIDE, TOGETHER, SLICE = 1 << 15, 8, 1 << 15, 300_000
#: Codes of shapes: digits by number, hexadecimal letters, other letters, text bounds, other characters.
HEX, LETTERS, BEGIN, FINISH, OTHER = 10, 12, 28, 29, 32


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by the patterns: leftmost, not overlapping within a kind, failed matches dropped."""
    found = []
    if "@" in text:
        p, free = text.find("@"), 0
        while p >= 0:
            start = p
            while start > free and text[start - 1] in LOCAL:
                start -= 1
            m = DOMAIN.match(text, p) if start < p else None
            if m:
                found.append((start, m.end(), "email"))
                free = m.end()
            p = text.find("@", max(p + 1, free))
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            found.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            found.append((*m.span(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                found.append((*m.span(), "phone"))
    return sorted(found, key=lambda s: (s[0], BASE.index(s[2])))


@lru_cache(maxsize=1)
def _characters() -> np.ndarray:
    """For each code point: 0 space, 1 letter, 2 digit, 3 other; 4 is added to upper case and 8 to hexadecimal letters."""
    every = np.arange(0x110000, dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")
    out = np.full(len(every), 3, np.uint8)
    for kind, pattern in ((1, r"[^\W\d_]+"), (2, r"\d+"), (0, r"\s+")):
        for m in re.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    out[[i for i in np.flatnonzero(out == 1).tolist() if every[i].isupper()]] |= 4
    out[[ord(c) for c in "abcdefABCDEF"]] |= 8
    return out


def _word_key(word: str) -> int:
    return int.from_bytes(word.encode("ascii").ljust(8, b"\0"), "little")


#: The cue words, all of at most eight letters, as numbers in order, and which cue each is.
_CUE_KEYS = np.array(sorted(map(_word_key, CUES)), np.int64)


@dataclass
class Tokens:
    """Tokens of some texts: the text of each, where it begins and ends in the text, shape and cue word (0: none)."""

    owner: np.ndarray
    start: np.ndarray
    end: np.ndarray
    shape: np.ndarray
    cue: np.ndarray


def tokens_of(texts: list[str]) -> Tokens:
    """Runs of letters, runs of digits, and other characters but white space one by one."""
    joined = "\n".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    about = _characters()[points]
    kind = about & 3
    new = np.ones(len(kind), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 3)
    bounds = np.append(np.flatnonzero(new), len(kind)).astype(np.int32)
    keep = kind[bounds[:-1]] > 0 if len(kind) else np.zeros(0, bool)
    start, end = bounds[:-1][keep], bounds[1:][keep]
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    owner = (np.searchsorted(begins, start, "right") - 1).astype(np.int32)
    size, first, last = end - start, about[start], about[end - 1]
    hexes = np.concatenate(([0], np.cumsum(about >> 3 & 1, dtype=np.int32)))
    letters = LETTERS + ((first >> 2 & 1) * 2 + (last >> 2 & 1)) * 4 + np.minimum(size, 4) - 1
    letters = np.where((size >= 2) & (hexes[end] - hexes[start] == size), HEX + (size >= 4), letters)
    digits = np.where(size < 8, size, np.where(size < 13, 8, 9))
    other = OTHER + np.minimum(points[start], 128).astype(np.int64)
    sort = first & 3
    shape = np.where(sort == 1, letters, np.where(sort == 2, digits, other)).astype(np.uint8)
    cue = np.zeros(len(start), np.uint8)
    short = np.flatnonzero((sort == 1) & (size <= 8) & (size > 1))
    key = np.zeros(len(short), np.int64)
    for i in range(8):
        on = size[short] > i
        c = points[np.minimum(start[short] + i, len(points) - 1)]
        c = np.where((c >= 65) & (c <= 90), c + 32, np.where(c < 128, c, 0)).astype(np.int64)
        key |= np.where(on, c, 0) << 8 * i
    at = np.minimum(np.searchsorted(_CUE_KEYS, key), len(_CUE_KEYS) - 1)
    cue[short] = np.where(_CUE_KEYS[at] == key, at + 1, 0)
    return Tokens(owner, start - begins[owner].astype(np.int32), end - begins[owner].astype(np.int32), shape, cue)


def features(tokens: Tokens, a: int, b: int) -> np.ndarray:
    """Keys of the features of tokens ``a`` to ``b``, one row each: a token's own and its neighbours' shapes and cue
    words, and whether space stands before it. The first byte tells the kind of feature."""
    low, high = max(0, a - BESIDE), min(len(tokens.owner), b + BESIDE)
    part = lambda x: x[low:high].astype(np.int64)
    owner, start, end, own, cue = map(part, (tokens.owner, tokens.start, tokens.end, tokens.shape, tokens.cue))

    def beside(step: int, bound: int) -> np.ndarray:
        out = np.full(len(own), bound, np.int64)
        here, there = (slice(step, None), slice(None, -step)) if step > 0 else (slice(None, step), slice(-step, None))
        out[here] = np.where(owner[here] == owner[there], own[there], bound)
        return out

    b1, b2, a1, a2 = beside(1, BEGIN), beside(2, BEGIN), beside(-1, FINISH), beside(-2, FINISH)
    glued = np.zeros(len(own), np.int64)
    glued[1:] = (owner[1:] == owner[:-1]) & (start[1:] == end[:-1])
    place = np.arange(len(own))
    last = np.concatenate(([-1], np.maximum.accumulate(np.where(cue > 0, place, -1))[:-1])) if len(own) else place
    near = np.where((last >= 0) & (place - last <= REACH) & (owner[last] == owner), cue[last], 0)
    rows = (own, cue, b1 << 16 | glued << 8 | own, own << 8 | a1, b2 << 8 | b1, a1 << 8 | a2, near, near << 8 | own, b1 << 16 | own << 8 | a1)
    return np.stack([np.int64(i) << 32 | row for i, row in enumerate(rows)], axis=1)[a - low : b - low]


@dataclass
class Field:
    index: np.ndarray  # keys of the known features in order
    emit: np.ndarray  # (features + 1, labels); the last row is of unknown features, zero
    move: np.ndarray  # (labels, labels)

    @property
    def labels(self) -> tuple[str, ...]:
        return ("", *KINDS)


def _coded(index: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(index, keys), max(0, len(index) - 1))
    return np.where(index[at] == keys, at, len(index)) if len(index) else np.zeros(keys.shape, np.int64)


def emissions(field: Field, tokens: Tokens) -> np.ndarray:
    """(tokens, labels): the sum of each token's feature weights."""
    out, n = np.empty((len(tokens.owner), field.emit.shape[1]), np.float32), len(tokens.owner)
    emit = field.emit.astype(np.float32)
    for a in range(0, n, AT_ONCE):
        b = min(n, a + AT_ONCE)
        coded = _coded(field.index, features(tokens, a, b))
        out[a:b] = emit[coded[:, 0]]
        for column in coded.T[1:]:
            out[a:b] += emit[column]
    return out


def labelled_table(n: int = 900, seed: int = 7) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """The small labelled table: (text, spans), written by rule from templates around invented filler words."""
    rng = np.random.default_rng(seed)
    pick = lambda seq: seq[rng.integers(len(seq))]
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    hexes = lambda k: "".join(pick("0123456789abcdef") for _ in range(k))
    syllables = ("an", "the", "er", "ing", "tion", "ou", "re", "le", "ch", "ung", "ei", "que", "ción", "ado", "éa", "st", "ö", "è", "in", "on")
    word = lambda: "".join(pick(syllables) for _ in range(rng.integers(1, 5)))
    name = lambda: "".join(pick(("an", "er", "li", "to", "ma", "jo")) for _ in range(rng.integers(2, 4)))
    makers = (
        ("email", lambda: f"{name()}.{digits(2)}@mail{digits(1)}.{pick(('example', 'site'))}.{pick(('com', 'org', 'net'))}"),
        ("email", lambda: f"{name()}{pick((' at ', ' [at] ', '[at]', ' (at) '))}{name()}{pick((' dot ', ' [dot] ', '[dot]', ' (dot) '))}{pick(('com', 'org', 'net', 'de'))}"),
        ("ip", lambda: ".".join(str(x) for x in rng.integers(1, 255, 4))),
        ("card", lambda: pick(("4", "5", "3")) + pick((digits(15), f"{digits(3)} {digits(4)} {digits(4)} {digits(4)}", f"{digits(3)}-{digits(4)}-{digits(4)}-{digits(4)}"))),
        ("card", lambda: digits(16)),
        ("phone", lambda: f"+{pick(('1', '44', '49', '33'))} ({digits(3)}) 555-{digits(4)}"),
        ("phone", lambda: pick((f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}"))),
        ("id", lambda: f"{digits(3)}-{digits(2)}-{digits(4)}"),
        ("account", lambda: f"{pick(('DE', 'FR', 'ES', 'GB'))}{digits(2)}{pick((digits(18), f' {digits(4)} {digits(4)} {digits(4)} {digits(4)} {digits(2)}'))}"),
        ("secret", lambda: hexes(40)),
        ("secret", lambda: hexes(32)),
        ("secret", lambda: hexes(40).upper()),
    )
    plain = (lambda: f"{digits(rng.integers(1, 6))}", lambda: f"20{digits(2)}-0{pick('123456789')}-{digits(2)}", lambda: f"{digits(1)}.{digits(1)}.{digits(1)}", lambda: f"${digits(2)}.{digits(2)}", lambda: f"{digits(2)}:{digits(2)}", lambda: f"{digits(4)}/{digits(2)}", lambda: f"{word()}{digits(2)}", lambda: f"page {digits(3)} of {digits(3)}", lambda: f"{digits(2)}%", lambda: f"{digits(1)},{digits(3)},{digits(3)}", lambda: f"@{name()}", lambda: f"{word()} at {word()}", lambda: f"no. {digits(3)}", lambda: f"#{digits(4)}", lambda: f"key {word()}", lambda: f"({digits(4)})")
    before = {"secret": ('token = "', 'TOKEN = "', "secret: ", "key=", 'password = "', ""), "id": ("ssn ", "id no ", "", "SSN: "), "account": ("iban ", "account ", ""), "phone": ("tel ", "call ", "phone: ", "", "")}
    rows = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.integers(1, 3)):
            text += " ".join(pick((word, lambda: word().capitalize(), lambda: word().upper()))() + pick(("", "", "", ",", ".", "!!", "%%%", " |", "$$$")) for _ in range(rng.integers(2, 8))) + pick((" ", " ", "\n"))
            if rng.random() < 0.45:
                text += pick(plain)()
            else:
                kind, make = pick(makers)
                lead = pick(before.get(kind, ("",)))
                text += lead
                start = len(text)
                text += make()
                spans.append((start, len(text), kind))
                text += '"' if lead.endswith('"') else ""
            text += pick((" ", ". ", ", ", "\n", "!! ", "%%% "))
        rows.append((text, spans))
    return rows


def _lattice(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Padded (sequences, steps, labels) of sequences that begin at ``starts`` in ``scores``."""
    out = np.zeros((len(lengths), int(lengths.max()), scores.shape[1]), scores.dtype)
    step = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(lengths)), lengths), step] = scores[np.repeat(starts, lengths) + step]
    return out


def train(table: list[tuple[str, list[tuple[int, int, str]]]] | None = None, rounds: int = 60, rate: float = 0.2, penalty: float = 1e-4) -> Field:
    """Fit emission and transition weights to a labelled table by Adam on the penalised log-likelihood."""
    table = labelled_table() if table is None else table
    names, tokens = ("", *KINDS), tokens_of([t for t, _ in table])
    count, n = len(tokens.owner), len(names)
    keys = features(tokens, 0, count)
    index = np.unique(keys)
    field = Field(index, np.zeros((len(index) + 1, n)), np.zeros((n, n)))
    if not count:
        return field
    gold = np.array([next((names.index(k) for a, b, k in table[i][1] if a <= start and end <= b), 0) for i, start, end in zip(tokens.owner, tokens.start, tokens.end, strict=True)])
    flat = _coded(index, keys)
    _, lengths = np.unique(tokens.owner, return_counts=True)
    starts = np.cumsum(lengths) - lengths
    owner, place = np.repeat(np.arange(len(lengths)), lengths), np.arange(count) - np.repeat(starts, lengths)
    seen = np.zeros_like(field.emit)
    np.add.at(seen, (flat, gold[:, None]), 1)
    moves = np.zeros((n, n))
    follows = place[1:] > 0
    np.add.at(moves, (gold[:-1][follows], gold[1:][follows]), 1)
    memory = [[np.zeros_like(w), np.zeros_like(w)] for w in (field.emit, field.move)]
    soft = lambda x, axis: (m := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis=axis))
    for step in range(1, rounds + 1):
        scores = _lattice(field.emit[flat].sum(axis=1), starts, lengths)
        count, steps, _ = scores.shape
        forward, backward = np.zeros_like(scores), np.zeros_like(scores)
        forward[:, 0] = scores[:, 0]
        for t in range(1, steps):
            forward[:, t] = np.where((lengths > t)[:, None], soft(forward[:, t - 1, :, None] + field.move, 1) + scores[:, t], forward[:, t - 1])
        for t in range(steps - 2, -1, -1):
            backward[:, t] = np.where((lengths > t + 1)[:, None], soft(field.move + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], 2), 0)
        whole = soft(forward[:, -1], 1)
        node = np.exp(forward + backward - whole[:, None, None])[owner, place]
        expected = np.zeros_like(seen)
        for k in range(n):
            expected[:, k] = np.bincount(flat.ravel(), weights=np.repeat(node[:, k], flat.shape[1]), minlength=len(expected))
        pairs = np.zeros((n, n))
        for t in range(1, steps):
            on = lengths > t
            pairs += np.exp(forward[on, t - 1, :, None] + field.move + (scores[on, t] + backward[on, t])[:, None, :] - whole[on, None, None]).sum(axis=0)
        for (one, two), weights, slope in zip(memory, (field.emit, field.move), ((seen - expected) / count, (moves - pairs) / count), strict=True):
            slope = slope - penalty * weights
            one += 0.1 * (slope - one)
            two += 0.001 * (slope**2 - two)
            weights += rate * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-8)
        field.emit[-1] = 0
    return field


@lru_cache(maxsize=1)
def default_field() -> Field:
    """The field trained on ``labelled_table()``; the same in every process."""
    return train()


def decode(field: Field, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The best label of each row of ``scores``, which holds sequences of ``lengths`` rows one after the other."""
    move = field.move.astype(scores.dtype)
    out, starts = np.zeros(len(scores), np.int8), np.cumsum(lengths) - lengths
    # what another label than none could gain by its transitions; a token that leads by more is on every best path
    gain = np.maximum(0, (move[:, 1:] - move[:, :1]).max(axis=0)) + np.maximum(0, (move[1:] - move[:1]).max(axis=1))
    sure = (scores[:, :1] - scores[:, 1:] > gain + 1e-3).all(axis=1)
    edge = np.zeros(len(scores) + 1, bool)  # before which rows a sequence begins
    edge[starts], edge[-1] = True, True
    open_ = ~sure
    begins = np.flatnonzero(open_ & (edge[:-1] | np.concatenate(([True], sure[:-1])))) if len(scores) else np.zeros(0, np.int64)
    ends = np.flatnonzero(open_ & (edge[1:] | np.concatenate((sure[1:], [True])))) + 1 if len(scores) else begins
    size = ends - begins
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        to = at + 1
        while to < min(len(order), at + 4096) and (to - at + 1) * size[order[to]] <= TOGETHER:
            to += 1
        part, at = order[at:to], to
        lattice, n = _lattice(scores, begins[part], size[part]), size[part]
        lattice[:, 0] += np.where(edge[begins[part]], 0, move[0][:, None]).T
        lattice[np.arange(len(part)), n - 1] += np.where(edge[ends[part]], 0, move[:, 0][:, None]).T
        best, back = lattice[:, 0], np.zeros(lattice.shape, np.int8)
        for t in range(1, lattice.shape[1]):
            reach = best[:, :, None] + move
            back[:, t] = reach.argmax(axis=1)
            best = np.where((n > t)[:, None], reach.max(axis=1) + lattice[:, t], best)
        now = best.argmax(axis=1)
        for t in range(lattice.shape[1] - 1, -1, -1):
            on = n > t
            out[begins[part][on] + t] = now[on]
            if t:
                now = np.where(on, back[np.arange(len(part)), t, now], now)
    return out


def _plausible(kind: str, text: str) -> bool:
    """Limits that keep other numbers out of the field's spans; a card must pass Luhn as for the patterns."""
    digits = re.sub(r"[^0-9]", "", text)
    if kind == "email":
        return "@" in text or bool(re.search(r"\bat\b.*\bdot\b", text, re.IGNORECASE | re.DOTALL))
    if kind == "ip":
        parts = text.split(".")
        return len(parts) == 4 and all(p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "account":
        return bool(re.match(r"[A-Z]{2}[0-9]{2}", text)) and 12 <= len(digits) <= 34
    return {"phone": 9 <= len(digits) <= 15, "id": len(digits) == 9, "secret": len(text) >= 20 and any(c.isdigit() for c in text)}[kind]


def find_batch(field: Field, texts: list[str]) -> list[tuple[list, list]]:
    """(the patterns' spans, all spans) of each text, as (start, end, kind) in order."""
    tokens = tokens_of(texts)
    lengths = np.bincount(tokens.owner, minlength=len(texts))
    labels = decode(field, emissions(field, tokens), lengths[lengths > 0])
    more: list[list] = [[] for _ in texts]
    new = np.ones(len(labels), bool)
    new[1:] = (labels[1:] != labels[:-1]) | (tokens.owner[1:] != tokens.owner[:-1])
    bounds = np.append(np.flatnonzero(new), len(labels))
    named = np.flatnonzero(labels[bounds[:-1]]) if len(labels) else []
    for a, b in zip(bounds[:-1][named].tolist(), (bounds[1:][named] - 1).tolist(), strict=True):
        i, start, end, kind = int(tokens.owner[a]), int(tokens.start[a]), int(tokens.end[b]), field.labels[labels[a]]
        if _plausible(kind, texts[i][start:end]):
            more[i].append((start, end, kind))
    out = []
    for own, extra in zip(map(base_spans, texts), more, strict=True):
        if extra and own:  # own spans begin in order; of those that begin before an extra one's end none may end after its start
            begins, reach = [a for a, *_ in own], np.maximum.accumulate([b for _, b, _ in own])
            extra = [x for x in extra if not (k := bisect_left(begins, x[1])) or reach[k - 1] <= x[0]]
        out.append((own, sorted([*own, *extra], key=lambda s: (s[0], KINDS.index(s[2]), s[1]))))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """(id, base, spans): each row's spans as ``kind:start:end`` in code points, end exclusive, comma-joined.

    ``base`` has the patterns' spans alone. Null and empty texts have none; repeated rows and null ids are rows like
    any other; columns besides the two named are not read.
    """
    field = field or default_field()
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(1), SLICE):
                part = batch.slice(a, b - a)
                found = find_batch(field, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([joined(b) for b, _ in found], pa.string()), pa.array([joined(s) for _, s in found], pa.string())], ["id", "base", "spans"])

    return map_arrow(rows, run, "id long, base string, spans string")


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    parts, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def mask(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", field: Field | None = None) -> DataFrame:
    """``docs`` with personal data masked in ``text_col`` and ``chars_col`` (if there) set to the new length.

    Null texts stay null and a text without personal data stays as it is, with its length. Every row is kept, repeated
    rows and null ids too, with all columns whatever their names; an empty table gives an empty one.
    """
    field, names, schema = field or default_field(), docs.columns, docs.schema

    def run(batches):
        for whole in batches:
            for a, b in slices(whole.column(names.index(text_col)).cast(pa.string()), SLICE):
                batch = whole.slice(a, b - a)
                texts, columns = batch.column(names.index(text_col)).to_pylist(), list(batch.columns)
                new = [t if t is None else masked(t, s) for t, (_, s) in zip(texts, find_batch(field, [t or "" for t in texts]), strict=True)]
                columns[names.index(text_col)] = pa.array(new, batch.schema.field(text_col).type)
                if chars_col in names:
                    at = names.index(chars_col)
                    old = batch.column(at)
                    columns[at] = pa.array([c if t == u else len(u) for c, t, u in zip(old.to_pylist(), texts, new, strict=True)], old.type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_arrow(docs, run, schema)
