"""Language identification: script ranges, per-word scores and Viterbi with a switching penalty.

A word's score for a language is the sum, over the word's letter trigrams, of the log-likelihood under the language's
trigram counts. Languages that are not written in the word's script can't be its label. Viterbi over the words, with a
fixed penalty for each change of language, cuts a text into spans; the language with the most letters is its label.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise, slices

#: First code points of script ranges, in order, and the scripts (0: letters of no listed script).
SCRIPT_STARTS = (0x0, 0x41, 0x250, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0xE00, 0xE80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0)
SCRIPTS = (0, 1, 0, 2, 3, 4, 5, 6, 0, 7, 8, 0, 9, 10, 11, 1, 2, 0, 12, 0, 13, 0, 10, 0)
#: Hash bins of trigrams, penalty of a switch (natural log), characters handled together, score of an excluded language,
#: trigrams handled together, most languages.
BINS, SWITCH, TOGETHER, EXCLUDED, AT_ONCE, MOST = 1 << 15, 12.0, 250_000, -1e6, 1 << 17, 1000
#: Letters are the characters of the general categories L.
NOT_LETTERS = regex.compile(r"[^\p{L} ]")


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # (BINS, languages), float32 log-likelihoods
    scripts: np.ndarray  # (14, languages), bool: the language is written in the script


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], pa.Array]:
    """(words of each text, index of each word among the distinct ones, these without what isn't a letter in lower
    case, the words themselves)."""
    parts = pc.utf8_split_whitespace(texts)
    words = parts.flatten()
    coded = words.dictionary_encode()
    distinct = NOT_LETTERS.sub("", " ".join(x or "_" for x in coded.dictionary.to_pylist()).lower()).split(" ") if len(coded.dictionary) else []
    return pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64), coded.indices.to_numpy(zero_copy_only=False), distinct, words


class Trigrams:
    """The trigrams of distinct words, bounds included, with the letters and the script of each word."""

    def __init__(self, distinct: list[str]):
        self.points = np.frombuffer(("\x00".join(["", *distinct, ""]) + "\x00").encode("utf-32-le", "surrogatepass"), np.uint32)
        self.lengths = np.fromiter(map(len, distinct), np.int64, len(distinct))
        self.scripts = np.zeros(len(distinct), np.int64)
        for word, at in self._blocks():
            kinds = np.array(SCRIPTS)[np.searchsorted(SCRIPT_STARTS, self.points[at], "right") - 1]
            new = np.flatnonzero(np.diff(word, prepend=-1))
            self.scripts[word[new]] = np.maximum(self.scripts[word[new]], np.maximum.reduceat(kinds, new))

    def _blocks(self):
        ends = np.cumsum(self.lengths)
        for a in range(0, int(ends[-1]) if len(ends) else 0, AT_ONCE):
            place = np.arange(a, min(int(ends[-1]), a + AT_ONCE))
            word = np.searchsorted(ends, place, "right")
            yield word, place + word + 1

    def __iter__(self):
        """(word, bin) of some trigrams at a time."""
        for word, at in self._blocks():
            before, here, after = (self.points[at + k].astype(np.int64) for k in (-1, 0, 1))
            yield word, ((before * 0x9E3779B1 + here * 0x85EBCA77 + after * 0xC2B2AE3D) >> 7) % BINS


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = MOST) -> Model:
    """Count letter trigrams by language over all rows with a text and a language; the driver gets BINS rows a language.

    Rows with a null are ignored, repeated rows count each time. More than ``most`` languages are a ValueError, since
    driver and tasks hold BINS scores for each. Without rows nothing is learned, and all is ``und``.
    """
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(1), batch.column(0).to_pylist()
            for a, b in slices(texts, TOGETHER):
                lengths, index, distinct, _ = _words(texts.slice(a, b - a))
                grams = Trigrams(distinct)
                names = sorted(set(langs[a:b]))
                own = np.repeat(np.array([names.index(x) for x in langs[a:b]]), lengths)
                uses = [np.bincount(index[own == i], minlength=len(distinct)).astype(np.float64) for i in range(len(names))]
                for name, used in zip(names, uses, strict=True):
                    held.setdefault(name, np.zeros(BINS + 16))[BINS:] += np.bincount(grams.scripts, weights=used * grams.lengths, minlength=16)
                for word, bins in grams:
                    for name, used in zip(names, uses, strict=True):
                        held[name][:BINS] += np.bincount(bins, weights=used[word], minlength=BINS)
        for name, total in held.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(total[at], pa.int64(), safe=False)], ["lang", "bin", "n"])

    counts = map_arrow(rows, count, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    counts = materialise(counts)
    if (distinct := counts.select("lang").distinct().count()) > most:
        raise ValueError(f"{distinct} languages; at most {most} can be learned")
    counts = counts.toPandas()
    languages = sorted(set(counts["lang"]))
    table = np.zeros((BINS + 16, len(languages)))
    table[counts["bin"].to_numpy(np.int64), [languages.index(x) for x in counts["lang"]]] = counts["n"]
    grams, scripts = table[:BINS], table[BINS:]
    share = scripts / np.maximum(1, scripts.sum(axis=0))
    with np.errstate(divide="ignore"):
        scores = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * BINS))
    return Model(languages, scores.astype(np.float32), share > 0.01)


def word_scores(model: Model, distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(score by word and language, letters of each word). A script that no language uses excludes none."""
    grams = Trigrams(distinct)
    out = np.zeros((len(distinct), len(model.languages)), np.float32)
    for word, bins in grams:
        low, high = int(word[0]), int(word[-1]) + 1
        for lang in range(out.shape[1]):
            out[low:high, lang] += np.bincount(word - low, weights=model.scores[bins, lang], minlength=high - low).astype(np.float32)
    written = model.scripts[grams.scripts]
    out[~written & written.any(axis=1)[:, None] & (grams.lengths > 0)[:, None]] = EXCLUDED
    return out, grams.lengths


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each row of ``scores``, which holds sequences of ``lengths`` rows one after the other.

    A row whose best label leads by more than two switches has it on every best path, so a sequence is cut before such
    rows: what stands before pays a switch at its end if it ends in another label. All pieces then advance together,
    longest first, so that a step handles one word of each that is not yet over.
    """
    labels = np.zeros(len(scores), np.int64)
    if not len(scores) or scores.shape[1] < 2:
        return labels
    two = np.partition(scores, -2, axis=1)
    sure, edge = two[:, -1] - two[:, -2] > 2 * switch + 1e-3, np.zeros(len(scores) + 1, bool)
    edge[np.cumsum(lengths) - lengths] = True
    cut = np.flatnonzero(sure & ~edge[:-1])
    if len(cut):
        scores = scores.copy()
        scores[cut - 1] -= np.where(np.arange(scores.shape[1]) == scores[cut].argmax(axis=1)[:, None], 0, switch).astype(scores.dtype)
        edge[cut] = True
    edge[-1] = True
    bounds = np.flatnonzero(edge)
    lengths, starts = np.diff(bounds), bounds[:-1]
    order = np.argsort(-lengths, kind="stable")
    lengths, starts = lengths[order], starts[order]
    steps = int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(steps), "left")
    offset = np.cumsum(active) - active
    from_best, stays = np.empty(len(scores), np.int16), np.empty(scores.shape, bool)
    best = scores[starts]
    for t in range(1, steps):
        n = active[t]
        best = best[:n]
        top = best.argmax(axis=1)
        jump = best[np.arange(n), top] - switch
        stay = best >= jump[:, None]
        from_best[offset[t] : offset[t] + n], stays[offset[t] : offset[t] + n] = top, stay
        best = np.where(stay, best, jump[:, None]) + scores[starts[:n] + t]
        if t + 1 == steps or active[t + 1] < n:
            over = np.arange(active[t + 1] if t + 1 < steps else 0, n)
            labels[starts[over] + t] = best[over].argmax(axis=1)
    ended = np.flatnonzero(lengths == 1)
    labels[starts[ended]] = scores[starts[ended]].argmax(axis=1)
    for t in range(steps - 1, 0, -1):
        n, at = active[t], offset[t]
        now = labels[starts[:n] + t]
        labels[starts[:n] + t - 1] = np.where(stays[at + np.arange(n), now], now, from_best[at : at + n])
    return labels


def predict_batch(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray, list[str]]:
    """(language or ``und``, share of its letters, spans ``lang:start:end`` in code points, comma-joined) of each text."""
    texts = pc.fill_null(texts, "")
    lengths, index, distinct, words = _words(texts)
    n, names = len(lengths), model.languages
    if not names or not len(index):
        return ["und"] * n, np.zeros(n), [""] * n
    scored, letters = word_scores(model, distinct)
    full = letters[index] > 0
    owner = np.repeat(np.arange(n), lengths)
    kept, kept_owner = index[full], owner[full]
    counts = np.bincount(kept_owner, minlength=n)
    labels = viterbi(scored[kept], counts)
    by = np.bincount(kept_owner * len(names) + labels, weights=letters[kept], minlength=n * len(names)).reshape(n, len(names))
    total, top = by.sum(axis=1), by.argmax(axis=1)
    share = by[np.arange(n), top] / np.maximum(1, total)
    spans, ends, begins = [""] * n, np.cumsum(counts), np.cumsum(lengths) - lengths
    for i in np.flatnonzero(total):
        own = labels[ends[i] - counts[i] : ends[i]]
        if (own == own[0]).all():
            spans[i] = f"{names[own[0]]}:0:{len(texts[int(i)].as_py())}"
        else:
            text, places, at, begin = texts[int(i)].as_py(), [], 0, int(begins[i])
            for k, word in enumerate(words.slice(begin, int(lengths[i])).to_pylist()):  # words stand in their order, with white space between
                at = text.index(word, at)
                if full[begin + k]:
                    places.append(at)
                at += len(word)
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist()]
            bounds = [0, *(places[c] for c in cuts[1:]), len(text)]
            spans[i] = ",".join(f"{names[own[c]]}:{a}:{b}" for c, a, b in zip(cuts, bounds[:-1], bounds[1:], strict=True))
    return [names[t] if k else "und" for t, k in zip(top, total, strict=True)], np.where(total > 0, share, 0.0), spans


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, spans) of each row's whole text.

    Null texts and texts without a letter are ``und`` with score 0 and no spans; so is everything if nothing was
    learned. Repeated rows and null ids are rows like any other; ties go to the language first in order.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for a, b in slices(texts, TOGETHER):
                lang, score, spans = predict_batch(model, texts.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(spans, pa.string())], ["id", "lang_pred", "score", "spans"])

    return map_arrow(rows, run, "id long, lang_pred string, score double, spans string")


def keep_known(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows, all columns kept, whose text has a language that takes at least the share ``least`` of its letters.

    Null texts and texts without a letter go; repeated rows and null ids stay or go like any other row, whatever extra
    columns there are; an empty table gives an empty one.
    """
    names = docs.columns

    def run(batches):
        at = names.index(text_col)
        for batch in batches:
            texts = pc.fill_null(batch.column(at).cast(pa.string()), "")
            keep = []
            for a, b in slices(texts, TOGETHER):
                lang, score, _ = predict_batch(model, texts.slice(a, b - a))
                keep += [x != "und" and s >= least for x, s in zip(lang, score, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_arrow(docs, run, docs.schema)
