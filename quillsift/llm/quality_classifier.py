"""Quality classifier: support vectors over n-gram indicators scaled by naive Bayes log-count ratios.

Features are hashed byte 2- and 3-grams and words of a text, and indicators of its shape (length, share
of distinct words, of upper case, of symbols), each present or not. An indicator's value is the log of
the ratio of its smoothed shares in the two classes; rows have unit length. A linear hinge-loss model is
fitted by dual coordinate descent, its weights drawn towards their mean size, and its margins are turned
into probabilities by a logistic curve fitted on rows that the fit did not see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm.common import doc_remainder, labelled_sample, row_sums, sparse_rows, text_bytes, tidy, word_hashes

BITS = 16
#: Labelled rows that the classifier is fitted on, at most (in expectation).
SAMPLE_ROWS = 8_000
FOLDS, HELD = 3, 1

_SEEN = np.zeros(1 << BITS, bool)
_SHIFT = np.uint32(32 - BITS)


def _shape(raw: bytes, words: list[bytes]) -> list[int]:
    n = max(1, len(words))
    letters = max(1, len(raw))
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>!?_=~^\\/{}[]@"))
    lines = raw.split(b"\n")
    return [
        1000 + len(words).bit_length(),
        1100 + 20 * len(set(words)) // n,
        1200 + 20 * upper // letters,
        1300 + min(40, 200 * symbols // letters),
        1400 + min(40, 2 * letters // n),
        1500 + 20 * len(set(lines)) // len(lines),
    ]


def features(text: str | None) -> np.ndarray:
    """Sorted distinct indices of a text's indicators."""
    raw = text_bytes(text)
    words = raw.split()
    _SEEN[word_hashes().array(words) >> np.uint64(64 - BITS)] = True
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    code = b
    for n in (2, 3):
        if len(b) < n:
            break
        code = (code[:-1] << np.uint32(8)) | b[n - 1 :]
        _SEEN[((code + np.uint32(n)) * np.uint32(2654435761)) >> _SHIFT] = True
    _SEEN[((np.array(_shape(raw, words), np.uint32) + np.uint32(77777)) * np.uint32(2246822519)) >> _SHIFT] = True
    found = np.flatnonzero(_SEEN)
    _SEEN[found] = False
    return found.astype(np.uint32)


@dataclass
class QualityModel:
    weights: np.ndarray  # float64: SVM weight x log-count ratio
    squares: np.ndarray  # float64: squared log-count ratio, for the unit length of rows
    bias: float
    slope: float
    shift: float

    def margin(self, idx: np.ndarray) -> float:
        return float(self.weights[idx].sum() / max(1e-12, self.squares[idx].sum()) ** 0.5) + self.bias

    def score(self, text: str | None) -> float:
        z = self.slope * self.margin(features(text)) + self.shift
        return 1.0 / (1.0 + float(np.exp(-min(60.0, max(-60.0, z)))))


def log_count_ratio(idx: np.ndarray, starts: np.ndarray, labels: np.ndarray, size: int, smoothing: float = 1.0) -> np.ndarray:
    """log of (share of an indicator in class 1) / (share in class 0), both smoothed."""
    own = np.repeat(labels, np.diff(starts))
    p = smoothing + np.bincount(idx, weights=own, minlength=size)
    q = smoothing + np.bincount(idx, weights=1.0 - own, minlength=size)
    p, q = p / (smoothing + labels.sum()), q / (smoothing + (1 - labels).sum())
    return np.log(p / q)


def dual_descent(idx: np.ndarray, values: np.ndarray, starts: np.ndarray, signs: np.ndarray, size: int, cost: np.ndarray, rounds: int = 10, seed: int = 7) -> tuple[np.ndarray, float]:
    """Linear hinge-loss SVM by dual coordinate descent; ``cost``: upper bound of each row's variable.

    The bias is the weight of a constant feature of value 1.
    """
    n = len(signs)
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(n)
    norm = row_sums(values * values, starts) + 1.0
    rows = [(idx[a:b], values[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    random = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in random.permutation(n):
            at, x = rows[i]
            gradient = signs[i] * (w[at] @ x + bias) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            change = (new - alpha[i]) * signs[i]
            if change:
                alpha[i] = new
                w[at] += change * x
                bias += change
                moved = max(moved, abs(change))
        if moved < 1e-3:
            break
    return w, bias


def _logistic_curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Newton steps for P(1) = sigmoid(a * margin + b), lightly held to a = 2, b = 0."""
    x = np.stack([margins, np.ones(len(margins))], 1)
    theta = np.array([2.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -60, 60)))
        gradient = x.T @ (p - labels) + 0.1 * (theta - [2.0, 0.0])
        theta = theta - np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 0.1 * np.eye(2), gradient)
        theta[0] = min(max(theta[0], 0.2), 50.0)
    return float(theta[0]), float(theta[1])


def fit_rows(rows: list[bytes], labels: np.ndarray, cost: float = 1.0, mix: float = 0.5) -> QualityModel:
    """``mix``: share of the SVM's own weights; the rest is their mean size. One class only, or no rows: a constant model."""
    size = 1 << BITS
    n = len(rows)
    if n == 0 or labels.min() == labels.max():
        return QualityModel(np.zeros(size), np.zeros(size), 0.0, 0.0, 4.0 if n and labels[0] == 1 else -4.0)

    def train(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        idx, starts = sparse_rows([rows[i] for i in at])
        y = labels[at]
        ratio = log_count_ratio(idx, starts, y, size)
        ratio[np.bincount(idx, minlength=size) < 3] = 0.0
        values = ratio[idx]
        values = values / np.repeat(np.sqrt(np.maximum(1e-12, row_sums(values * values, starts))), np.diff(starts))
        each = np.where(y > 0, 0.5 * len(y) / max(1, y.sum()), 0.5 * len(y) / max(1, (1 - y).sum())) ** 0.5
        w, bias = dual_descent(idx, values, starts, np.where(y > 0, 1.0, -1.0), size, cost * each)
        level = np.abs(w).sum() / max(1, np.count_nonzero(w))
        return ((1 - mix) * level * np.sign(np.abs(w)) + mix * w) * ratio, ratio * ratio, bias

    part = np.arange(n) % 4 == 0
    if len(set(labels[~part])) < 2 or len(set(labels[part])) < 2:
        slope, shift = 2.0, 0.0
    else:
        model = QualityModel(*train(np.flatnonzero(~part)), 1.0, 0.0)
        slope, shift = _logistic_curve(np.array([model.margin(np.frombuffer(rows[i], np.uint32)) for i in np.flatnonzero(part)]), labels[part])
    return QualityModel(*train(np.arange(n)), slope, shift)


@tidy
def _featurise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame({"doc_id": frame["doc_id"].array, "label": frame["label"].array, "own": [features(t).tobytes() for t in frame["text"]]})


def fit(documents: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS, **options) -> QualityModel:
    sample = labelled_sample(documents, labels, "quality", FOLDS, HELD, bound)
    rows = sample.mapInPandas(_featurise, "doc_id long, label int, own binary").toPandas().sort_values(["doc_id", "own"], kind="stable")
    return fit_rows(list(rows["own"]), rows["label"].to_numpy(np.float64), **options)


def quality(documents: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``documents``.

    Null and empty texts are scored by their shape alone. A null id counts as not held out and is never
    learned from. Repeated rows are scored each by itself. An empty table gives an empty result, and
    without labels of both classes the score is a constant. Further columns are ignored.
    """
    model = fit(documents, labels, bound)

    @tidy
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"].array, "score": np.array([model.score(t) for t in frame["text"]], np.float64)})

    scored = documents.select("doc_id", "text").mapInPandas(run, "doc_id long, score double")
    held = F.coalesce(doc_remainder("doc_id", FOLDS) == HELD, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
