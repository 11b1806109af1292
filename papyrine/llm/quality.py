"""Quality classifier: hashed word n-grams, logistic regression, FTRL-proximal.

Features of a text are word n-grams hashed to ``1 << bits`` weights: words and
word pairs (A-Z lower-cased), the words' skeletons (runs of letters, capitals and
digits collapsed, signs kept) and pairs of them, and whether a word repeats one
of the three before it.  Each kind enters as its mean over the text, so a score
is a sparse dot product independent of length.  Training walks a bounded sample
on the driver with follow-the-regularised-leader updates; a held part of the
sample calibrates the score (Platt).  The L1 term leaves rare words at weight
zero, so unknown vocabulary counts as neutral.

Defined results: null and empty texts have no n-grams and get the score of the
calibrated intercept; texts of any length are scored whole; repeated rows and ids
are scored each for itself and nothing is ranked, so ties do not arise; an empty
table gives no rows; without labels of both kinds every score is 0.5, or near the
one label there is.  A column named like the score is replaced, others are kept.
A score comes from differences of sums over a portion of texts, so it may differ
in its last digits with the texts beside it; it is rounded to 9 places, which
leaves the same score for the same text on any partitioning but for a text whose
score lies that near to a rounding edge.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import arrow_map
from . import kernels
from .samples import fold, labelled_sample

_KINDS = 5
_SCALE = 4.0
_SIGNS = np.arange(256, dtype=np.uint8)
_SIGNS[65:91] = 65
_SIGNS[97:123] = 97
_SIGNS[48:58] = 48
_SIGNS[128:] = 97


def skeletons(data: np.ndarray, words: kernels.Words) -> np.ndarray:
    """Hash of each word's skeleton: equal neighbours of its character classes collapse."""
    out = []
    for begin in range(0, len(words.starts), 1 << 17):
        s, e = words.starts[begin : begin + (1 << 17)], words.ends[begin : begin + (1 << 17)]
        low, high = int(s[0]), int(e[-1])
        part = _SIGNS[data[low:high]]
        first = np.zeros(high - low, bool)
        first[s - low] = True
        keep = first.copy()
        keep[1:] |= part[1:] != part[:-1]
        keep &= ~kernels.SPACE[part] | first
        at = np.flatnonzero(keep)
        kept = part[at]
        a, b = np.searchsorted(at, s - low), np.searchsorted(at, e - low)
        power, inverse = kernels._power_tables(len(kept) + 1)
        total = np.zeros(len(kept) + 1, np.uint64)
        np.cumsum(kernels._LETTER_CODES[kept] * power[: len(kept)], out=total[1:])
        out.append(kernels.mix((total[b] - total[a]) * inverse[a]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Weight indices of every word and kind, and the range of words of each text."""
    words = kernels.hash_words(data, offsets)
    h, s = words.hashes, skeletons(data, words)
    start = np.zeros(len(h), bool)
    start[words.first[:-1][words.counts() > 0]] = True

    def pairs(x: np.ndarray, salt: int) -> np.ndarray:
        before = np.empty_like(x)
        before[1:] = x[:-1]
        before[start] = 0
        return kernels.mix(before * np.uint64(0xD6E8FEB86659FD93) + x + np.uint64(salt))

    position = np.arange(len(h)) - np.repeat(words.first[:-1], words.counts())
    repeat = np.zeros(len(h), np.uint64)
    for gap in (3, 2, 1):
        if len(h) > gap:
            same = np.zeros(len(h), bool)
            same[gap:] = h[gap:] == h[:-gap]
            repeat[same & (position >= gap)] = gap
    shift = np.uint64(64 - bits)
    kinds = [h, pairs(h, 1), kernels.mix(s + np.uint64(2)), pairs(s, 3), kernels.mix(repeat + np.uint64(4))]
    return [(x >> shift).astype(np.int64) for x in kinds], words.first


@dataclass
class QualityModel:
    weights: np.ndarray
    intercept: float
    slope: float
    bits: int

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        kinds, first = features(data, offsets, self.bits)
        total = np.zeros(len(first) - 1)
        for index in kinds:
            run = np.concatenate([[0.0], np.cumsum(self.weights[index], dtype=np.float64)])
            total += run[first[1:]] - run[first[:-1]]
        return total * _SCALE / np.maximum(1, np.diff(first))

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(data, offsets) + self.intercept, -40, 40)))


def platt(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic fit with smoothed targets (Newton steps)."""
    high, low = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (high + 1) / (high + 2), 1 / (low + 2))
    x = np.stack([margins, np.ones_like(margins)], 1)
    w = np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (p - target) + 1e-3 * (w - [1, 0])
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def train(sample: list[tuple[bytes, int]], bits: int = 20, passes: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.001) -> QualityModel:
    """FTRL-proximal over the sample; every fifth text only calibrates."""
    size = 1 << bits
    if len({y for _, y in sample}) < 2:
        only = float(sample[0][1]) if sample else 0.5
        return QualityModel(np.zeros(size, np.float32), 8 * (only - 0.5), 1.0, bits)
    rows = []
    for text, label in sample:
        kinds, first = features(*kernels.text_buffer(pa.array([text], pa.binary())), bits)
        index, count = np.unique(np.concatenate(kinds), return_counts=True)
        rows.append((index, count * (_SCALE / max(1, int(first[-1]))), float(label)))
    z, n = np.zeros(size), np.zeros(size)
    bias, bias_n = 0.0, 1.0
    order = np.random.default_rng(7)
    fitted = [i for i in range(len(rows)) if i % 5]
    for _ in range(passes):
        for i in order.permutation(fitted):
            index, x, y = rows[i]
            zi, ni = z[index], n[index]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + root) / alpha + l2))
            p = 1 / (1 + np.exp(-np.clip(w @ x + bias, -40, 40)))
            g = (p - y) * x
            z[index] += g - (np.sqrt(ni + g * g) - root) / alpha * w
            n[index] += g * g
            bias_n += (p - y) ** 2
            bias -= 0.1 * (p - y) / np.sqrt(bias_n)
    weights = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2)).astype(np.float32)
    model = QualityModel(weights, bias, 1.0, bits)
    held = [i for i in range(len(rows)) if i % 5 == 0]
    labels = np.array([rows[i][2] for i in held])
    if 0 < labels.sum() < len(labels):
        margins = np.array([weights[rows[i][0]] @ rows[i][1] for i in held])
        model.slope, model.intercept = platt(margins, labels)
    return model


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 4, held_fold: int = 2, sample_rows: int = 5000, max_bytes: int = 200_000) -> QualityModel:
    """Train on at most ``sample_rows`` labelled documents outside the held-out fold."""
    usable = labels.where(fold("doc_id", folds) != held_fold)
    return train([(t, int(y)) for t, y in labelled_sample(docs, usable, label_col, sample_rows, max_bytes) if y in (0, 1)])


def score(df: DataFrame, model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``df`` with ``score_col``; ``model`` has ``scores(data, offsets)`` and is broadcast (its size is fixed by its bits)."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    base = df.drop(score_col)
    schema = base.withColumn(score_col, F.lit(0.0)).schema
    names = schema.names

    def make():
        found = shared.value

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            data, offsets = kernels.text_buffer(b.column(text_col))
            out = [np.round(found.scores(*part), 9) for part in kernels.portions(data, offsets)]
            return pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(out) if out else np.zeros(0))], names=names)

        return step

    return arrow_map(base, make, schema)
