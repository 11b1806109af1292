"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the mean of its bag's embeddings, a window the mean of its words, and
a two-class softmax scores the window; a text is as toxic as its worst window
(overlapping windows of ``2 * half`` words), so a few words count in a text of
any length.  Embeddings and softmax are trained jointly in numpy on a bounded
sample of labelled texts: the gradient of the text's loss flows through its
worst window into every n-gram of it, and misspelt or inflected forms share
n-gram vectors with the forms seen.  Scoring folds the softmax into the
embeddings (one number a bucket), so it is one gather for each n-gram.

Defined results: a text without words (null, empty, white space) has the score
of an empty window; texts of any length are scored whole, and a longer text has
more windows, so its score can only be that of a worse one; repeated rows and ids
are scored each for itself, ties of windows have one value; an empty table gives
no rows; without labels of both kinds every score is 0.5, or near the one label
there is.  A column named like the score is replaced, others are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .quality import platt
from .samples import fold, interleave, labelled_sample
from .subwords import Bags

SIZES = (3, 4, 5, 6)


def _windows(word_values: np.ndarray, first: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end word of every window, the window range of each text, and its values' means."""
    counts = np.diff(first)
    blocks = np.maximum(1, -(-counts // half))
    windows = np.maximum(1, blocks - 1)
    windows[counts == 0] = 0
    of = np.concatenate([[0], np.cumsum(windows)])
    doc = np.repeat(np.arange(len(counts)), windows)
    begin = first[doc] + (np.arange(of[-1]) - of[doc]) * half
    end = np.minimum(begin + 2 * half, first[doc + 1])
    run = np.concatenate([[0.0], np.cumsum(word_values)])
    return begin, end, of, (run[end] - run[begin]) / np.maximum(1, end - begin)


def _worst(values: np.ndarray, of: np.ndarray, empty: float) -> np.ndarray:
    out = np.full(len(of) - 1, empty)
    some = np.diff(of) > 0
    if len(values):
        out[some] = np.maximum.reduceat(values, of[:-1][some])
    return out


@dataclass
class ToxicityModel:
    table: np.ndarray
    bias: float
    slope: float
    intercept: float
    bits: int
    half: int

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        bags = Bags(data, offsets, SIZES, self.bits)
        words = bags.word_sums(self.table)[:, 0] / bags.bag_sizes()
        _, _, of, values = _windows(words, bags.first, self.half)
        return _worst(values, of, 0.0) + self.bias

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = []
        for part in kernels.portions(data, offsets, 1 << 20):
            out.append(1 / (1 + np.exp(-np.clip(self.slope * self.margins(*part) + self.intercept, -40, 40))))
        return np.concatenate(out) if out else np.zeros(0)


def train(sample: list[tuple[bytes, int]], bits: int = 18, dims: int = 8, half: int = 4, passes: int = 8, rate: float = 0.5) -> ToxicityModel:
    """Joint training with Adagrad steps; every fifth text only calibrates."""
    rng = np.random.default_rng(11)
    size = 1 << bits
    if len({y for _, y in sample}) < 2:
        only = float(sample[0][1]) if sample else 0.5
        return ToxicityModel(np.zeros(size, np.float32), 0.0, 1.0, 8 * (only - 0.5), bits, half)
    embed = (rng.standard_normal((size, dims)) * 0.3 / np.sqrt(dims)).astype(np.float32)
    soft = rng.standard_normal((2, dims)) * 0.5
    bias = np.zeros(2)
    embed_sq, soft_sq, bias_sq = np.full(size, 1e-4, np.float32), 1e-2, 1.0
    bags = [Bags(*kernels.text_buffer(pa.array([t], pa.binary())), SIZES, bits) for t, _ in sample]
    labels = np.array([y for _, y in sample])
    fitted = np.array([i for i in range(len(sample)) if i % 5 and len(bags[i].low)])
    for _ in range(passes):
        for count, i in enumerate(rng.permutation(fitted)):
            bag = bags[i]
            if count % 64 == 0:
                table = (embed @ (soft[1] - soft[0])).astype(np.float32)
            words = bag.word_sums(table)[:, 0] / bag.bag_sizes()
            begin, end, _, values = _windows(words, bag.first, half)
            worst = int(np.argmax(values))
            a, b = int(begin[worst]), int(end[worst])
            index, weight = [], []
            for w in range(a, b):
                low, high = int(bag.low[w]), int(bag.high[w])
                own = np.concatenate([bag.words[w : w + 1], *(g[low : max(low, high - n + 1)] for n, g in zip(SIZES, bag.grams, strict=True))])
                index.append(own)
                weight.append(np.full(len(own), 1 / (len(own) * (b - a))))
            index, weight = np.concatenate(index), np.concatenate(weight)
            hidden = weight @ embed[index]
            logits = soft @ hidden + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = soft.T @ p
            gradient = weight[:, None] * back[None, :]
            square = weight * weight * float(back @ back)
            np.add.at(embed_sq, index, square)
            np.add.at(embed, index, -rate * gradient / np.sqrt(embed_sq[index])[:, None])
            outer = np.outer(p, hidden)
            soft_sq += float((outer * outer).sum())
            soft -= 0.1 * rate * outer / np.sqrt(soft_sq)
            bias_sq += float(p @ p)
            bias -= rate * p / np.sqrt(bias_sq)
    table = (embed @ (soft[1] - soft[0])).astype(np.float32)
    model = ToxicityModel(table, float(bias[1] - bias[0]), 1.0, 0.0, bits, half)
    held = [i for i in range(len(sample)) if i % 5 == 0]
    if 0 < labels[held].sum() < len(held):
        margins = model.margins(*kernels.text_buffer(pa.array([sample[i][0] for i in held], pa.binary())))
        model.slope, model.intercept = platt(margins, labels[held].astype(float))
    return model


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", folds: int = 3, held_fold: int = 1, class_rows: int = 1200, max_bytes: int = 50_000) -> ToxicityModel:
    """Train on at most ``class_rows`` labelled documents of each class outside the held-out fold."""
    usable = labels.where(fold("doc_id", folds) != held_fold)
    sides = [labelled_sample(docs, usable.where(F.col(label_col) == y), label_col, class_rows, max_bytes) for y in (0, 1)]
    return train([(t, int(y)) for t, y in interleave(*sides)])
