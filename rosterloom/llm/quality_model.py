"""Quality classifier: naive Bayes log-count ratios times n-gram indicators, under a linear hinge-loss model.

Indicators are hashed n-grams of bytes, of byte classes and of words. Each is scaled by
its log-count ratio between the classes; dual coordinate descent then fits the hinge
loss. A sigmoid fitted to margins of rows left out of a fit turns margins into scores.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterloom.llm.shared import held_out
from rosterloom.llm.words import SPACED, bounds, grams, hashes, mix, slices

#: Hashed features of each of the three families.
BUCKETS = 1 << 16
BYTE_GRAMS, CLASS_GRAMS, WORD_GRAMS = (1, 2, 3), (2, 4, 6), (1, 2)
#: Bound of the labelled sample that the model is fitted on, chosen by a hash of doc_id. A row of
#: it has at most SET_BYTES of features, so that at most 150 MB are gathered for the fit.
SAMPLE = 6000
SET_BYTES = 3 * BUCKETS // 8
#: Added to counts; hinge-loss cost; passes over the sample.
SMOOTH, COST, PASSES = 1.0, 0.1, 12
#: A score from here on predicts quality 1.
THRESHOLD = 0.3

# Byte classes: digits, capitals, small letters and non-ASCII as one each; everything else is itself.
_b = np.arange(256)
CLASS = np.where((_b >= 48) & (_b <= 57), 48, np.where((_b >= 65) & (_b <= 90), 65, np.where((_b >= 97) | (_b == 96), 97, _b)))
CLASS[123:127] = np.arange(123, 127)
CLASS = CLASS.astype(np.uint64)


def features(data: np.ndarray, offsets: np.ndarray):
    """For each text of a slice: the distinct hashed n-grams it has."""
    with np.errstate(over="ignore"):
        families = []
        for family, (codes, sizes) in enumerate(((data.astype(np.uint64), BYTE_GRAMS), (CLASS[data], CLASS_GRAMS))):
            for n in sizes:
                if len(codes) < n:
                    continue
                code = codes[: len(codes) - n + 1].copy()
                for j in range(1, n):
                    code = code * np.uint64(257) + codes[j : len(codes) - n + 1 + j]
                code = (mix(code + np.uint64(n << 56)) % np.uint64(BUCKETS)).astype(np.int32) + family * BUCKETS
                families.append((n, code))
    starts, ends, owner = bounds(data, offsets, SPACED)
    words = hashes(data, starts, ends)
    first = np.searchsorted(owner, np.arange(len(offsets)))
    of_words = []
    for n in WORD_GRAMS:
        codes, at = grams(words, owner, n)
        of_words.append(((codes % np.uint64(BUCKETS)).astype(np.int32) + 2 * BUCKETS, np.searchsorted(at, first)))
    have = np.zeros(3 * BUCKETS, bool)
    for k in range(len(offsets) - 1):
        have[:] = False
        for n, code in families:
            have[code[offsets[k] : max(offsets[k], offsets[k + 1] - n + 1)]] = True
        for code, cut in of_words:
            have[code[cut[k] : cut[k + 1]]] = True
        yield np.flatnonzero(have)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, margin: float) -> float:
        return 1 / (1 + math.exp(-min(50.0, max(-50.0, self.slope * margin + self.offset))))


def packed(found: np.ndarray) -> bytes:
    """The features in the shorter form: a bit each, or 32-bit numbers."""
    if 4 * len(found) < SET_BYTES:
        return found.astype("<i4").tobytes()
    have = np.zeros(3 * BUCKETS, bool)
    have[found] = True
    return np.packbits(have).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i4") if len(data) < SET_BYTES else np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8)))


class Rows:
    """Rows of features, unpacked one at a time."""

    def __init__(self, data: list[bytes]):
        self._data = data

    def __len__(self) -> int:
        return len(self._data)

    def __getitem__(self, i: int) -> np.ndarray:
        return unpacked(self._data[i])

    def __iter__(self):
        return map(unpacked, self._data)

    def where(self, chosen: np.ndarray) -> Rows:
        return Rows([self._data[i] for i in np.flatnonzero(chosen)])


def log_ratios(rows: Rows | list[np.ndarray], positive: np.ndarray) -> np.ndarray:
    counts = np.full((2, 3 * BUCKETS), SMOOTH)
    for row, y in zip(rows, positive):
        counts[int(y), row] += 1
    shares = counts / counts.sum(axis=1, keepdims=True)
    return np.log(shares[1] / shares[0])


def dual_descent(rows: Rows | list[np.ndarray], values: np.ndarray, positive: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights (already times ``values``) and bias of the L1-loss linear SVM; texts are scaled to unit length."""
    weights, bias = np.zeros(len(values)), 0.0
    length = np.array([max(1e-9, math.sqrt(float((values[r] ** 2).sum()))) for r in rows])
    square = np.array([float(((values[r] / n) ** 2).sum()) + 1.0 for r, n in zip(rows, length)])
    dual, sign = np.zeros(len(rows)), np.where(positive, 1.0, -1.0)
    share = max(1e-9, float(np.mean(positive)))
    cost = COST * 10 * np.where(positive, 0.5 / share, 0.5 / max(1e-9, 1 - share))
    order = np.random.default_rng(seed)
    for _ in range(PASSES):
        for i in order.permutation(len(rows)):
            row = rows[i]
            x = values[row] / length[i]
            gradient = sign[i] * (float(weights[row] @ x) + bias) - 1
            new = min(cost[i], max(0.0, dual[i] - gradient / square[i]))
            if new != dual[i]:
                step = (new - dual[i]) * sign[i]
                weights[row] += step * x
                bias += step
                dual[i] = new
    return weights * values, bias


def _margins(rows, weights, values, bias):
    return np.array([weights[r].sum() / max(1e-9, math.sqrt(float((values[r] ** 2).sum()))) + bias for r in rows])


def sigmoid_fit(margins: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps on the log loss with smoothed targets."""
    n1, n0 = positive.sum(), (~positive).sum()
    target = np.where(positive, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    beta, x = np.array([1.0, 0.0]), np.column_stack([margins, np.ones(len(margins))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + np.eye(2) * 1e-3
        step = np.linalg.solve(hessian, x.T @ (target - p) - 1e-3 * beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(0.0, beta[0])), float(beta[1])


@dataclass
class Fitted:
    weights: np.ndarray
    values: np.ndarray
    model: Model


def _feature_rows(batches):
    for batch in batches:
        for row, data, offsets in slices(batch.column(1)):
            for k, found in enumerate(features(data, offsets)):
                at = row + k
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1), batch.column(2).slice(at, 1), pa.array([packed(found)], pa.binary())], names=["quality", "doc_id", "found"])


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Fitted:
    """Fit on at most ``sample`` labelled rows that are not held out, chosen by a hash of their doc_id.

    Of several labels of a doc_id the greatest counts, and of several rows the one whose packed
    features come first. Null labels and doc_ids are not learned from; null and empty texts have
    no features; very long texts give theirs whole. Without rows of both classes (as without any
    rows) every text gets the share of quality 1 among the rows (0.5 without any). Other columns
    are ignored, whatever their names.
    """
    chosen = labels.filter(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # The broadcast side has ``sample`` rows at most.
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("quality").cast("long").alias("quality"), "text", "doc_id")
    rows = rows.mapInArrow(_feature_rows, f"quality long, doc_id {kind}, found binary")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("found", "quality")).alias("row")).select("row.found", "row.quality").collect()
    rows = sorted((bytes(r.found), r.quality) for r in rows)
    positive = np.array([quality == 1 for _, quality in rows], bool)
    found = Rows([data for data, _ in rows])
    if not len(rows) or positive.all() or not positive.any():
        share = float(positive.mean()) if len(rows) else 0.5
        share = min(1 - 1e-6, max(1e-6, share))
        none = np.zeros(3 * BUCKETS)
        return Fitted(none, none, Model(none, 0.0, 0.0, math.log(share / (1 - share))))
    margins = np.zeros(len(rows))
    for half in (0, 1):
        seen = np.arange(len(rows)) % 2 == half
        if positive[seen].all() or not positive[seen].any():
            continue
        values = log_ratios(found.where(seen), positive[seen])
        weights, bias = dual_descent(found.where(seen), values, positive[seen])
        margins[~seen] = _margins(found.where(~seen), weights, values, bias)
    slope, offset = sigmoid_fit(margins, positive)
    values = log_ratios(found, positive)
    weights, bias = dual_descent(found, values, positive)
    return Fitted(weights, values, Model(weights, bias, slope, offset))


def score(documents: DataFrame, fitted: Fitted) -> DataFrame:
    """doc_id and score (0 to 1) of every row; null and empty texts have no n-grams and get the bias alone.

    Very long texts are scored whole; repeated rows, equal and null doc_ids are scored each;
    there are no ties; an empty table gives none; other columns are ignored, whatever their names.
    """
    shared = documents.sparkSession.sparkContext.broadcast(fitted)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches):
        own = shared.value
        weights, squares = own.weights, own.values**2
        for batch in batches:
            out = []
            for _, data, offsets in slices(batch.column(1)):
                for found in features(data, offsets):
                    margin = weights[found].sum() / max(1e-9, math.sqrt(float(squares[found].sum()))) + own.model.bias
                    out.append(own.model.score(float(margin)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
