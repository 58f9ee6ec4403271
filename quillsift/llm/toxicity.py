"""Toxicity: a counterfactually regularised logistic classifier over hashed words, word pairs and letter runs.

Fitting. Every labelled text of the bounded sample that mentions an identity term gets a counterfactual
twin, in which each mention is swapped for another term of its group; the loss adds the squared change
of the raw score between the two, so that a group mention alone moves a score little.
The model is a few MB, whatever the size of the corpus, and goes to the executors with the task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm.common import doc_remainder, labelled_sample, row_sums, sparse_rows, text_bytes, tidy, word_hashes

BITS = 20
#: Labelled rows that the classifier is fitted on, at most (in expectation).
SAMPLE_ROWS = 5_000
FOLDS = 5

#: Terms of one group stand for one another in counterfactual twins.
IDENTITY_GROUPS = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer", "heterosexual"),
    ("woman", "man", "girl", "boy"),
    ("women", "men", "girls", "boys"),
    ("american", "mexican", "chinese", "indian", "russian", "german", "french", "spanish", "turkish", "polish"),
    ("deaf", "blind", "disabled", "autistic"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "hindúes"),
)
_GROUP_OF = {t.encode(): tuple(x.encode() for x in g) for g in IDENTITY_GROUPS for t in g}

_SPACE_PUNCTUATION = bytes(c if c >= 128 or chr(c).isalnum() or c == 39 else 32 for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Words in lower case (A-Z), ASCII punctuation being white space."""
    return text_bytes(text).lower().translate(_SPACE_PUNCTUATION).split()


def codes(words: list[bytes]) -> np.ndarray:
    """Indices of the hashed words, adjacent pairs and 5-byte runs (white space at word ends included), repeats and all."""
    h = word_hashes().array(words)
    pair = h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + (h[1:] ^ np.uint64(0x165667B19E3779F9)) * np.uint64(0x9E3779B185EBCA87)
    run = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint64)
    for n in range(1, 5):
        run = (run[:-1] << np.uint64(8)) | (run[1:] & np.uint64(255))
    run = (run + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    run ^= run >> np.uint64(32)
    run *= np.uint64(0x9E3779B97F4A7C15)
    return (np.concatenate([h, pair, run]) >> np.uint64(64 - BITS)).astype(np.uint32)


def features(words: list[bytes]) -> np.ndarray:
    return np.unique(codes(words))


def counterfactual(words: list[bytes]) -> list[bytes] | None:
    """The words with every identity term swapped for another of its group; None if there is none.

    The replacement follows from the text's own words, so that a rerun swaps the same.
    """
    places = [i for i, w in enumerate(words) if w in _GROUP_OF]
    if not places:
        return None
    turn = zlib.crc32(b" ".join(words))
    out = list(words)
    for i in places:
        group = _GROUP_OF[words[i]]
        at = group.index(words[i])
        out[i] = group[(at + 1 + turn % (len(group) - 1)) % len(group)]
    return out


@dataclass
class ToxicityModel:
    weights: np.ndarray  # float32, one a hashed feature
    bias: float

    def raw(self, words: list[bytes]) -> float:
        at = codes(words)
        return float(self.weights[np.unique(at[self.weights[at] != 0])].sum(dtype=np.float64)) + self.bias

    def score(self, text: str | None) -> float:
        return 1.0 / (1.0 + float(np.exp(-min(60.0, max(-60.0, self.raw(tokens(text)))))))


def fit_rows(rows: list[bytes], twins: list[tuple[int, bytes]], labels: np.ndarray, consistency: float = 1.0, l2: float = 1e-4, rounds: int = 120, least: int = 5, deviation: float = 6.0) -> ToxicityModel:
    """Gradient descent (Adam steps) on log loss + ``consistency`` x squared twin difference + L2.

    ``rows``: uint32 features of each text; ``twins``: (row, features of its counterfactual).
    Features of fewer than ``least`` texts, or whose count in toxic texts is less than ``deviation``
    standard deviations off the expected one, get no weight. One class only, or no rows: a constant model.
    """
    size = 1 << BITS
    n = len(rows)
    positive = float(labels.sum()) if n else 0.0
    if n == 0 or positive in (0.0, float(n)):
        return ToxicityModel(np.zeros(size, np.float32), 4.0 if n and positive == n else -4.0)
    counts, toxic = np.zeros(size, np.int64), np.zeros(size, np.int64)
    slices = [slice(i, i + 256) for i in range(0, n, 256)]
    for part in slices:
        idx, starts = sparse_rows(rows[part])
        counts += np.bincount(idx, minlength=size)
        toxic += np.bincount(idx[np.repeat(labels[part] > 0, np.diff(starts))], minlength=size)
    share = positive / n
    off = np.abs(toxic - counts * share) / np.sqrt(np.maximum(1e-9, counts * share * (1 - share)))
    frequent = np.flatnonzero((counts >= least) & (off >= min(deviation, 0.5 * (n * (1 - share) / share) ** 0.5)))
    place = np.full(size, -1, np.int64)
    place[frequent] = np.arange(len(frequent))

    def compact(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Column, row starts and row of each feature that counts."""
        kept = [at[at >= 0] for at in (place[np.frombuffer(b, np.uint32)] for b in blobs)]
        sizes = np.array([len(k) for k in kept], np.int64)
        return np.concatenate([*kept, np.zeros(0, np.int64)]), np.r_[0, np.cumsum(sizes)], np.repeat(np.arange(len(kept)), sizes)

    x, xs, xr = compact(rows)
    t, ts, tr = compact([b for _, b in twins])
    of = np.array([i for i, _ in twins], np.int64)
    m = len(frequent)
    w, bias = np.zeros(m), float(np.log(positive / (n - positive)))
    first, second, b_first, b_second = np.zeros(m), np.zeros(m), 0.0, 0.0
    weight = np.where(labels > 0, 0.5 * n / positive, 0.5 * n / (n - positive)) ** 0.5
    for step in range(1, rounds + 1):
        z = row_sums(w[x], xs)
        residual = weight * (1.0 / (1.0 + np.exp(-np.clip(z + bias, -60, 60))) - labels) / n
        per_row = residual.copy()
        grad = np.zeros(m)
        if len(of):
            change = 2.0 * consistency * (z[of] - row_sums(w[t], ts)) / len(of)
            np.add.at(per_row, of, change)
            grad -= np.bincount(t, weights=change[tr], minlength=m)
        grad += np.bincount(x, weights=per_row[xr], minlength=m) + l2 * w
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        rate = 0.05 * (1.0 if step < rounds * 0.7 else 0.3)
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8 + 1e-5)
        g = residual.sum()
        b_first, b_second = 0.9 * b_first + 0.1 * g, 0.99 * b_second + 0.01 * g * g
        bias -= rate * (b_first / (1 - 0.9**step)) / (b_second**0.5 / (1 - 0.99**step) ** 0.5 + 1e-8)
    full = np.zeros(size, np.float32)
    full[frequent] = w
    return ToxicityModel(full, bias)


@tidy
def _featurise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for i, text, label in zip(frame["doc_id"], frame["text"], frame["label"], strict=True):
            words = tokens(text)
            twin = counterfactual(words)
            out.append((i, label, features(words).tobytes(), None if twin is None else features(twin).tobytes()))
        yield pd.DataFrame(out, columns=["doc_id", "label", "own", "twin"])


def fit(documents: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS, **options) -> ToxicityModel:
    """Learns from at most about ``bound`` labelled rows outside the held-out fold."""
    sample = labelled_sample(documents, labels, "toxic", FOLDS, 0, bound)
    rows = sample.mapInPandas(_featurise, "doc_id long, label int, own binary, twin binary").toPandas().sort_values(["doc_id", "own"], kind="stable")
    twins = [(i, b) for i, b in enumerate(rows["twin"]) if b is not None]
    return fit_rows(list(rows["own"]), twins, rows["label"].to_numpy(np.float64), **options)


def score(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """All columns of ``documents`` but an earlier score, with score and predicted."""
    schema = documents.select("doc_id").schema.add("score", "double")

    @tidy
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"].array, "score": np.array([model.score(t) for t in frame["text"]], np.float64)})

    return documents.select("doc_id", "text").mapInPandas(run, schema)


def drop_toxic(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``documents``, all columns, that score under 0.5."""

    @tidy
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[[model.score(t) < 0.5 for t in frame["text"]]]

    return documents.mapInPandas(run, documents.schema)


def toxicity(documents: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``documents``.

    Null and empty texts get the score of the bias alone. A null id counts as not held out and is
    never learned from. Repeated rows are scored each by itself. An empty table gives an empty result,
    and without labels of both classes the score is a constant. Further columns are ignored.
    """
    scored = score(documents, fit(documents, labels, bound))
    held = F.coalesce(doc_remainder("doc_id", FOLDS) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
