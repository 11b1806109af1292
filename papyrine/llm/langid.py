"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of all n-grams of its words; the softmax
over it is trained with the embeddings by stochastic gradient descent in numpy,
on random crops of a bounded sample of documents with a known language, so
that short texts are met in training.  A held part of the sample sets the
temperature (calibration) and the score under which a prediction is to be
rejected: the smallest at which the accepted predictions reach ``precision``.

Defined results: a text that is null or has no letter is ``und`` with score 0
and rejected; if nothing can be learned every text is ``und``; texts of any length
count whole; equal probabilities give the language first in alphabetical order;
repeated rows and ids are predicted each for itself; an empty table gives no rows.
Columns named lang_pred, score or rejected are replaced, others are kept.  Scores
are rounded to 9 places (see ``quality``).
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
from .subwords import Bags

SIZES = (2, 3, 4)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    run = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
    found = run[offsets[1:]] > run[offsets[:-1]]
    for i in np.flatnonzero(~found & (np.diff(offsets) > 1)):
        found[i] = any(map(str.isalpha, bytes(data[offsets[i] : offsets[i + 1]]).decode("utf-8", "replace")))
    return found


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float
    bits: int

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        bags = Bags(data, offsets, SIZES, self.bits)
        sums, sizes = bags.word_sums(self.table), bags.bag_sizes()
        run = np.vstack([np.zeros((1, sums.shape[1])), np.cumsum(sums, axis=0)])
        count = np.concatenate([[0], np.cumsum(sizes)])
        total = run[bags.first[1:]] - run[bags.first[:-1]]
        logits = total / np.maximum(1, count[bags.first[1:]] - count[bags.first[:-1]])[:, None] + self.bias
        p = np.exp((logits - logits.max(axis=1, keepdims=True)) / self.temperature)
        return p / p.sum(axis=1, keepdims=True)


def _crop(text: bytes, rng: np.random.Generator) -> bytes:
    words = text.split()
    if len(words) < 4:
        return text
    width = int(min(len(words), 2 ** rng.uniform(0, 6)) or 1)
    at = int(rng.integers(0, len(words) - width + 1))
    return b" ".join(words[at : at + width])


def train(sample: list[tuple[bytes, str]], bits: int = 18, dims: int = 8, crops: int = 3, passes: int = 3, rate: float = 0.5, precision: float = 0.97) -> LanguageModel:
    """Plain SGD with a decaying rate over crops; every fifth text only calibrates."""
    rng = np.random.default_rng(5)
    languages = sorted({y for _, y in sample})
    if not languages:
        return LanguageModel([], np.zeros((1 << bits, 1), np.float32), np.zeros(1), 1.0, 2.0, bits)
    code = {y: i for i, y in enumerate(languages)}
    embed = (rng.standard_normal((1 << bits, dims)) * 0.5).astype(np.float32)
    soft, bias = rng.standard_normal((len(languages), dims)) * 0.5, np.zeros(len(languages))
    items = [(_crop(t, rng), code[y]) for i, (t, y) in enumerate(sample) if i % 5 for _ in range(crops)]
    bags = [np.concatenate(list(b.lists())) for b in (Bags(*kernels.text_buffer(pa.array([t], pa.binary())), SIZES, bits) for t, _ in items) if len(b.low)]
    labels = [y for t, y in items if t.split()]
    steps, done = passes * len(bags), 0
    for _ in range(passes):
        for i in rng.permutation(len(bags)):
            index = bags[i]
            pace = rate * (1 - done / steps)
            done += 1
            hidden = embed[index].mean(axis=0)
            logits = soft @ hidden + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = soft.T @ p
            soft -= pace * np.outer(p, hidden)
            bias -= 0.1 * pace * p
            np.subtract.at(embed, index, (pace * back).astype(np.float32))  # fastText's step: the mean's gradient goes whole to each part
    model = LanguageModel(languages, (embed @ soft.T).astype(np.float32), bias, 1.0, 0.0, bits)
    held = [(_crop(t, rng), code[y]) for i, (t, y) in enumerate(sample) if i % 5 == 0 for _ in range(2)]
    held = [x for x in held if x[0].split()]
    if held and len(languages) > 1:
        truth = np.array([y for _, y in held])
        buffers = kernels.text_buffer(pa.array([t for t, _ in held], pa.binary()))

        def loss(temperature: float) -> float:
            model.temperature = temperature
            return float(-np.log(np.maximum(model.probabilities(*buffers)[np.arange(len(truth)), truth], 1e-12)).mean())

        model.temperature = min(np.geomspace(0.02, 20, 61), key=loss)
        p = model.probabilities(*buffers)
        order = np.argsort(-p.max(axis=1))
        right = np.cumsum((p.argmax(axis=1) == truth)[order]) / np.arange(1, len(order) + 1)
        enough = np.flatnonzero(right >= precision)
        model.reject_below = float(p.max(axis=1)[order][enough[-1]]) if len(enough) else 1.0
    return model


def fit(docs: DataFrame, lang_col: str = "lang", folds: int = 3, held_fold: int = 1, sample_rows: int = 5000, max_bytes: int = 200_000) -> LanguageModel:
    """Train on at most ``sample_rows`` documents with a language outside the held-out fold."""
    usable = docs.where(fold("doc_id", folds) != held_fold)
    return train(labelled_sample(docs, usable, lang_col, sample_rows, max_bytes))


def predict(df: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``df`` with lang_pred, score and rejected."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    base = df.drop("lang_pred", "score", "rejected")
    schema = base.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "rejected": F.lit(True)}).schema

    def make():
        found = shared.value
        names = np.array([*found.languages, "und"], object)

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            data, offsets = kernels.text_buffer(b.column(text_col))
            picked, scores = [], []
            for part in kernels.portions(data, offsets, 1 << 20):
                p = found.probabilities(*part) if found.languages else np.zeros((len(part[1]) - 1, 1))
                letters = has_letter(*part) & bool(found.languages)
                picked.append(np.where(letters, p.argmax(axis=1), len(found.languages)))
                scores.append(np.where(letters, p.max(axis=1), 0.0))
            choice = np.concatenate(picked) if picked else np.zeros(0, np.int64)
            score = np.round(np.concatenate(scores), 9) if scores else np.zeros(0)
            return pa.RecordBatch.from_arrays([*b.columns, pa.array(names[choice], pa.string()), pa.array(score), pa.array(score < found.reject_below)], names=schema.names)

        return step

    return arrow_map(base, make, schema)
