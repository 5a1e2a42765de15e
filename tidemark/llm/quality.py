"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text are drawn as bounded samples; the class prior, the share of good text among
the unlabelled, is estimated from these two alone: wherever a score cuts, the share of the unlabelled above it is at
least the prior times that of the positives, and the least such bound is taken (Scott 2015). A logistic scorer over text statistics minimises the non-negative unbiased risk: with prior p, the
risk of calling unlabelled text bad, less p times that of calling positives bad, estimates the risk on bad text; where
a batch's estimate falls below zero the step climbs back instead (Kiryo et al. 2017).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise

#: Most rows of either sample, gradient steps, rows of a batch, learning rate, weight penalty.
SAMPLE, STEPS, BATCH, RATE, PENALTY = 4000, 800, 512, 0.02, 1e-3
#: Byte classes: control, space, digit, upper, lower, sentence marks, other ASCII marks, beyond ASCII.
CLASSES = np.zeros(256, np.uint8)
CLASSES[[9, 10, 11, 12, 13, 32]] = 1
CLASSES[48:58], CLASSES[65:91], CLASSES[97:123] = 2, 3, 4
for _marks, _kind in ((b".,;:?'\"()-", 5), (b"!#$%&*+/<=>@[\\]^_`{|}~", 6)):
    CLASSES[list(_marks)] = _kind
CLASSES[128:] = 7
FEATURES = 28


def statistics(text: str | None) -> np.ndarray:
    """The features of one whole text; none depends on labels, language, source or id."""
    data = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(FEATURES, np.float32)
    raw = np.frombuffer(data, np.uint8)
    n = max(1, len(raw))
    counts = np.bincount(raw, minlength=256)
    out[:8] = np.bincount(CLASSES, weights=counts, minlength=8)[:8] / n
    words = data.split()
    k = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:], strict=False)))
    marks = np.sort(counts[[33, 35, 36, 37, 38, 42, 64, 94, 123, 124, 125, 126]])[::-1]
    out[8] = np.log1p(len(words))
    out[9] = len(set(words)) / k
    out[10] = pairs / max(1, len(words) - 1) if len(words) > 1 else 1
    out[11] = len(set(lines)) / max(1, len(lines))
    out[12] = lengths.mean() / 10 if len(words) else 0
    out[13] = lengths.std() / 10 if len(words) else 0
    out[14] = (lengths > 25).mean() if len(words) else 0
    out[15] = np.log1p(len(data) / max(1, len(lines)))
    out[16] = sum(a == b for a, b in zip(words, words[1:], strict=False)) / k
    out[17] = marks[0] / k
    out[18] = marks[:4].sum() / k
    out[19] = (counts[46] + counts[63]) / k
    out[20] = counts[44] / k
    out[21] = counts[124] / k
    out[22] = counts[33] / k
    letters = counts[65:91].sum() + counts[97:123].sum()
    out[23] = counts[65:91].sum() / max(1, letters)
    shares = counts[counts > 0] / n
    out[24] = -(shares * np.log2(shares)).sum() / 8 if len(raw) else 0
    out[25] = _top_share(words) if words else 0
    out[26] = float(not words)
    out[27] = float(len(words) < 5)
    return out


def _top_share(words: list[bytes]) -> float:
    """Share of the most frequent word of at least four bytes."""
    held: dict[bytes, int] = {}
    for w in words:
        if len(w) > 3:
            held[w] = held.get(w, 0) + 1
    return max(held.values(), default=0) / len(words)


@dataclass
class Scorer:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        z = np.clip((rows - self.mean) / self.scale, -4, 4) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(positives: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 11) -> Scorer:
    """Minimise the non-negative unbiased risk with the logistic loss; an empty sample leaves the prior as score."""
    prior = min(max(prior, 0.01), 0.99)
    width = FEATURES
    if not len(positives) or not len(unlabelled):
        return Scorer(np.zeros(width), np.ones(width), np.zeros(width), float(np.log(prior / (1 - prior))), prior)
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0)
    scale = np.where(scale < 1e-6, 1.0, scale)
    p, u = (np.clip((x - mean) / scale, -4, 4) for x in (positives, unlabelled))
    rng, w, b = np.random.default_rng(seed), np.zeros(width), 0.0
    one, two = np.zeros(width + 1), np.zeros(width + 1)
    kept = np.zeros(width + 1)
    for step in range(1, STEPS + 1):
        xp, xu = p[rng.integers(0, len(p), BATCH)], u[rng.integers(0, len(u), BATCH)]
        sp, su = (1 / (1 + np.exp(-(x @ w + b))) for x in (xp, xu))
        as_bad_p, as_bad_u = -np.log1p(-np.minimum(sp, 1 - 1e-9)), -np.log1p(-np.minimum(su, 1 - 1e-9))
        slope = lambda x, g: np.append(g @ x, g.sum()) / len(x)
        bad = slope(xu, su) - prior * slope(xp, sp)
        if as_bad_u.mean() - prior * as_bad_p.mean() >= 0:
            g = prior * slope(xp, sp - 1) + bad
        else:
            g = -bad
        g[:-1] += PENALTY * w
        one += 0.1 * (g - one)
        two += 0.001 * (g * g - two)
        change = RATE * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-8)
        w, b = w - change[:-1], b - change[-1]
        if step > STEPS // 2:
            kept += np.append(w, b) / (STEPS - STEPS // 2)
    return Scorer(mean, scale, kept[:-1], float(kept[-1]), prior)


def class_prior(positives: np.ndarray, unlabelled: np.ndarray, least: float = 0.7) -> float:
    """The share of good rows among ``unlabelled``: the least ratio of the shares of both above a score.

    Scores come from a scorer fitted to even odds; cuts are those that leave at least the share ``least`` of the
    positives above, where a ratio is no matter of a few rows. Without rows of either kind it is one half.
    """
    if not len(positives) or not len(unlabelled):
        return 0.5
    ranker = fit(positives, unlabelled, 0.5)
    p, u = np.sort(ranker.score(positives)), np.sort(ranker.score(unlabelled))
    cuts = np.quantile(p, np.linspace(0, 1 - least, 81))
    above = lambda x: 1 - np.searchsorted(x, cuts, "left") / len(x)
    return float(np.clip((above(u) / above(p)).min(), 0.01, 0.99))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, features): the statistics of each row's whole text as 32-bit floats in one binary value.

    A null text counts as empty; repeated rows and null ids are rows like any other; only the two columns are read; an
    empty table gives an empty one.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([statistics(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], ["id", "features"])

    return map_arrow(rows, run, "id long, features binary")


def _sample(rows: DataFrame, most: int) -> np.ndarray:
    """Up to ``most`` rows with the lowest hashes of id and features, as a matrix: the documented bound of the fit.

    Rows above a hash that twice as many are expected below are left out first, so that the tasks together send the
    driver about ``2 * most`` rows, however many tasks there are.
    """
    place = F.xxhash64("id", "features")
    share = min(1.0, 2 * most / max(1, rows.count()))
    near = rows if share == 1 else rows.where(place < int(-(2**63) + share * 2**64))
    held = near.orderBy(place, "id", "features").limit(most).select("features").collect()
    return np.array([np.frombuffer(r[0], np.float32) for r in held], np.float64).reshape(-1, FEATURES)


def train(rows: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", label_col: str = "quality") -> Scorer:
    """Fit on ``rows`` (id, features) and ``labels`` (id, 0 or 1): at most ``sample`` positives and as many unlabelled.

    Unlabelled text is a sample of all ``rows``, good and bad, whose labels aren't looked at; rows labelled 0 are not
    used as such. Null labels and ids are ignored; an id with several labels counts with its largest.
    """
    marks = labels.select(labels[id_col].cast("long").alias("id"), labels[label_col].cast("int").alias("mark")).where("id is not null and mark is not null").groupBy("id").agg(F.max("mark").alias("mark"))
    positives = _sample(rows.join(marks.where("mark = 1"), "id", "left_semi"), sample)
    unlabelled = _sample(rows, sample)
    return fit(positives, unlabelled, class_prior(positives, unlabelled))


def score(rows: DataFrame, scorer: Scorer) -> DataFrame:
    """(id, score) from (id, features), 0 to 1; equal features have equal scores, and repeated rows and null ids stay."""

    def run(batches):
        for batch in batches:
            matrix = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer.score(matrix), pa.float64())], ["id", "score"])

    return map_arrow(rows, run, "id long, score double")


def classify(docs: DataFrame, labels: DataFrame, learn_from=None, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(id, score): how likely each row of ``docs`` is good, 0 to 1, by a scorer fitted as ``train`` says.

    ``learn_from``, a function from the column ``id`` to a condition, limits the ids that are learned from. Null and
    empty texts have a score like any other; repeated rows and null ids are kept; without labels or documents the
    score is the prior. Features are computed once, in a table of small rows in the shared folder.
    """
    rows = materialise(features(docs, id_col, text_col))
    usable = rows if learn_from is None else rows.where(learn_from(F.col("id")))
    known = labels if learn_from is None else labels.where(learn_from(labels[id_col]))
    return score(rows, train(usable, known, sample, id_col))
