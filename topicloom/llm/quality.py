"""Quality scores from a support vector machine on n-grams that naive Bayes has weighed.

Two kinds of n-grams are looked for in the whole text: three bytes in a row, and one to three
words in a row by shape (letter case, digits, signs, same as the word before). Each counts as
present or not. A present n-gram has the logarithm of the ratio of its shares in the two
classes as its value, and the vector of a text is scaled to length one. A linear model with
hinge loss is fitted by dual coordinate descent; its margins become probabilities by a
logistic curve, fitted on rows that the model has not seen.

Bounded: the model is fitted on about ``MOST_ROWS`` labelled documents, chosen by a hash of
the key; every document is scored.

Defined cases: a null or empty text has no n-gram and gets the score of the constant alone.
Without rows of both labels, every score is the smoothed share of label 1. Repeated rows
are scored each; a null key is kept. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.blocks import blocks, bytes_in, find_words
from topicloom.llm.labelled import fold, labelled_sample

#: Labelled documents that the model is fitted on, at most (in expectation).
MOST_ROWS = 8_000
#: Least score that counts as label 1.
THRESHOLD = 0.3

_HALF = 17
_FEATURES = 1 << (_HALF + 1)
_NOT_SPACE = ~bytes_in((0x20, 0x20), (0x09, 0x0D))
_UPPER = bytes_in((0x41, 0x5A))
_DIGIT = bytes_in((0x30, 0x39))
_LOWER = bytes_in((0x61, 0x7A), (0x80, 0xFF))
_SIGN = bytes_in((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
_SPREAD = np.uint32(2654435761)


def _bucket(ids: np.ndarray, half: int) -> np.ndarray:
    """Numbers spread over one half of the features."""
    spread = (ids.astype(np.uint32) * _SPREAD) >> np.uint32(32 - _HALF)
    return spread.astype(np.int64) + (half << _HALF)


def _shapes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shape of every word, first word of every text)."""
    words = find_words(data, offsets, _NOT_SPACE)
    if not len(words.starts):
        return np.empty(0, dtype=np.int64), words.first

    def count(table: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(table[data])])
        return total[words.ends] - total[words.starts]

    same = np.zeros(len(words.hashes), dtype=np.int64)
    same[1:] = words.hashes[1:] == words.hashes[:-1]
    heads = words.first[:-1][words.first[:-1] < len(same)]
    same[heads] = 0
    shape = (
        (count(_UPPER) > 0) * 1 + (count(_LOWER) > 0) * 2 + (count(_DIGIT) > 0) * 4
        + np.minimum(count(_SIGN), 3) * 8 + same * 32
    )
    return shape, words.first


def ngrams(data: np.ndarray, offsets: np.ndarray):
    """Yield the sorted distinct n-gram numbers of each text of a block."""
    wide = data.astype(np.uint32)
    triples = np.empty(0, dtype=np.int64)
    if len(wide) > 2:
        triples = _bucket(wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:], 0)
    shape, first = _shapes(data, offsets)
    pairs = 64 + shape[:-1] * 64 + shape[1:]
    triads = 4160 + (shape[:-2] * 64 + shape[1:-1]) * 64 + shape[2:]
    runs = [_bucket(x, 1) for x in (shape, pairs, triads)]
    seen = np.zeros(_FEATURES, dtype=bool)
    for a, b, x, y in zip(offsets[:-1], offsets[1:], first[:-1], first[1:]):
        seen[triples[a:max(b - 2, a)]] = True
        for n, run in enumerate(runs):
            seen[run[x:max(y - n, x)]] = True
        present = np.flatnonzero(seen)
        seen[present] = False
        yield present


@dataclass(frozen=True)
class QualityModel:
    """Weights of the n-grams, and the curve from margins to probabilities."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, present: np.ndarray) -> float:
        ratio = self.ratio[present]
        length = float(np.sqrt((ratio * ratio).sum()))
        inner = float((self.weight[present] * ratio).sum())
        return self.bias + (inner / length if length else 0.0)

    def score(self, present: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-(self.slope * self.margin(present) + self.shift))))


def coordinate_descent(
    rows: list[np.ndarray], values: list[np.ndarray], sign: np.ndarray, cost: np.ndarray,
    size: int, rounds: int = 20, seed: int = 7,
) -> tuple[np.ndarray, float]:
    """(weights, bias) of the linear machine with hinge loss, solved in its dual.

    One coordinate is one row; a step sets it to its best value within [0, cost] and moves
    the weights along the row. The bias is the weight of a constant feature.
    """
    weight, bias = np.zeros(size), 0.0
    alpha = np.zeros(len(rows))
    square = np.array([float((v * v).sum()) + 1.0 for v in values])
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        largest = 0.0
        for i in order.permutation(len(rows)):
            at, value = rows[i], values[i]
            gradient = sign[i] * (float((weight[at] * value).sum()) + bias) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            step = new - alpha[i]
            if step:
                alpha[i] = new
                weight[at] += step * sign[i] * value
                bias += step * sign[i]
                largest = max(largest, abs(step))
        if largest < 1e-4:
            break
    return weight, bias


def _logistic(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the probability of label 1, with smoothed targets."""
    ones = label.sum()
    target = np.where(label == 1, (ones + 1) / (ones + 2), 1 / (len(label) - ones + 2))
    slope, shift = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30)))
        error, width = p - target, np.maximum(p * (1 - p), 1e-6)
        gradient = np.array([(error * margin).sum() + 1e-3 * (slope - 1), error.sum()])
        hessian = np.array([
            [(width * margin * margin).sum() + 1e-3, (width * margin).sum()],
            [(width * margin).sum(), width.sum() + 1e-6],
        ])
        move = np.linalg.solve(hessian, gradient)
        slope, shift = slope - move[0], shift - move[1]
        if np.abs(move).max() < 1e-8:
            break
    return float(max(slope, 1e-3)), float(shift)


def fit_quality(sample: DataFrame, key: str = "doc_id", cost: float = 1.0) -> QualityModel:
    """Fit on a bounded sample (key, text, label).

    Rows whose key has remainder 1 of 5 fit the curve, the others the machine.
    """

    def run(batches):
        for rows, data, offsets in blocks(batches, "text"):
            found = [p.astype(np.int32) for p in ngrams(data, offsets)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f.tobytes() for f in found], pa.binary()),
                 rows.column("label"), rows.column("part")],
                names=["present", "label", "part"],
            )

    parted = sample.select("text", "label", fold(F.col(key), 5).alias("part"))
    table = parted.mapInArrow(run, "present binary, label int, part int").toArrow()
    rows = [np.frombuffer(x.as_buffer(), dtype=np.int32)
            for x in table.column("present").combine_chunks()]
    label = np.asarray(table.column("label"), dtype=np.int64)
    held = np.asarray(table.column("part")) == 1
    share = (label.sum() + 1) / (len(label) + 2)
    flat = QualityModel(np.zeros(_FEATURES), np.zeros(_FEATURES), 0.0, 1.0,
                        float(np.log(share / (1 - share))))
    if held.sum() < 20 or len(set(label[held])) < 2:
        held = np.zeros(len(label), dtype=bool)
    fit = np.flatnonzero(~held)
    if len(set(label[fit])) < 2:
        return flat
    counts = np.ones((2, _FEATURES))
    for i in fit:
        counts[label[i], rows[i]] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    ratio[counts.sum(axis=0) == 2] = 0.0
    values = []
    for i in fit:
        value = ratio[rows[i]]
        length = np.sqrt((value * value).sum())
        values.append(value / length if length else value)
    ones = label[fit].sum()
    # The rarer class counts as much as the other one.
    per_class = len(fit) / (2 * np.array([len(fit) - ones, ones]))
    weight, bias = coordinate_descent(
        [rows[i] for i in fit], values, np.where(label[fit] == 1, 1.0, -1.0),
        cost * per_class[label[fit]], _FEATURES,
    )
    raw = QualityModel(ratio, weight, bias, 1.0, 0.0)
    curve = np.flatnonzero(held) if held.any() else fit
    margin = np.array([raw.margin(rows[i]) for i in curve])
    slope, shift = _logistic(margin, label[curve])
    return QualityModel(ratio.astype(np.float32), weight.astype(np.float32), bias, slope, shift)


def score_quality(
    docs: DataFrame, model: QualityModel, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, score) per document: the probability of label 1."""
    # Its size is fixed by the number of features.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for rows, data, offsets in blocks(batches, text):
            scores = [model.score(p) for p in ngrams(data, offsets)]
            yield pa.RecordBatch.from_arrays(
                [rows.column(key), pa.array(scores, pa.float64())], names=[key, "score"]
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, score double")


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    held_out: Column,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    most_rows: int = MOST_ROWS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(key, held_out, score, predicted); ``held_out`` rows are not learned from."""
    sample = labelled_sample(docs, labels, key, text, label, ~held_out, most_rows)
    scored = score_quality(docs, fit_quality(sample, key), key, text)
    return scored.select(
        key, held_out.alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
