"""Exact top-k search by inner product over an impact-ordered, score-at-a-time index.

Components are integers. A block of vectors is indexed by dimension: its rows in posting segments of
equal quantised component, each segment knowing its smallest and largest component. For a query, what a
dimension adds to a score lies in a range that its segments give; a row starts from the sum of the
smallest contributions, and every segment adds the excess over that. Segments are processed by descending
excess, their rows' accumulators growing by the certain part. Processing stops only on proof: when the
rows whose accumulator plus everything still possible reaches the k-th best certain score are few, those
rows are scored exactly, and nothing else can be among the k best.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 1024
LEVELS = 16
#: Queries and candidates that meet in one task, on average.
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 4096
EXACT = 1 << 53


class ImpactIndex:
    """Posting segments of a block of vectors (rows x dimensions, integer valued)."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.vectors, self.ids = vectors, ids
        rows, dims = vectors.shape
        self.low = np.zeros((dims, LEVELS))
        self.high = np.zeros((dims, LEVELS))
        self.filled = np.zeros((dims, LEVELS), bool)
        self.postings: list[list[np.ndarray]] = []
        for d in range(dims):
            column = vectors[:, d]
            least, most = column.min(), column.max()
            level = np.minimum(LEVELS - 1, (column - least) * LEVELS // max(1.0, most - least + 1)).astype(np.int64)
            order = np.argsort(level, kind="stable")
            parts = np.split(order, np.searchsorted(level[order], np.arange(1, LEVELS)))
            for s, part in enumerate(parts):
                if len(part):
                    self.low[d, s], self.high[d, s], self.filled[d, s] = column[part].min(), column[part].max(), True
            self.postings.append(parts)

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k best rows, by score, then id; ``own`` takes no part."""
        n, dims = self.vectors.shape
        others = n - int(np.count_nonzero(self.ids == own))
        k = min(k, others)
        if k == 0:
            return self.ids[:0], np.zeros(0)
        if float(np.abs(self.vectors).max()) * float(np.abs(query).max()) * dims >= EXACT:  # sums of floats prove nothing here
            return self._best(np.arange(n), query, own, k)
        positive = query[:, None] >= 0
        certain = np.where(positive, query[:, None] * self.low, query[:, None] * self.high)
        possible = np.where(positive, query[:, None] * self.high, query[:, None] * self.low)
        floor = np.where(self.filled, certain, np.inf).min(1)
        gain = np.where(self.filled, certain - floor[:, None], -1.0)
        most = np.where(self.filled, possible - floor[:, None], -1.0)
        slack = np.where(self.filled, possible - certain, 0.0).max(1)
        # Segments by descending excess; segments that can add nothing certain are never needed.
        order = np.argsort(-most, axis=None, kind="stable")
        order = order[most.ravel()[order] > 0]
        left = [sorted((float(m) for m in row if m > 0), reverse=True) for row in most]
        at = [0] * dims
        rest = np.array([x[0] if x else 0.0 for x in left])  # what an unseen dimension may still add
        touched = np.zeros(dims, bool)
        score = np.zeros(n)
        if others < n:
            score[self.ids == own] = -np.inf
        check = max(8, len(order) // 12)
        members = None
        for done, flat in enumerate(order.tolist(), 1):
            d, s = divmod(flat, LEVELS)
            if gain[d, s]:
                score[self.postings[d][s]] += gain[d, s]
            touched[d] = True
            at[d] += 1
            rest[d] = left[d][at[d]] if at[d] < len(left[d]) else 0.0
            if done % check == 0 or done == len(order):
                # A row has been met in a dimension (up to the slack of its segment) or may still get the rest.
                open_sum = float(np.maximum(rest, np.where(touched, slack, 0.0)).sum())
                least = np.partition(score, n - k)[n - k]
                members = np.flatnonzero(score + open_sum >= least)
                if len(members) <= max(4 * k, n // 64):
                    break
        return self._best(np.arange(n) if members is None else members, query, own, k)

    def _best(self, members: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        members = members[self.ids[members] != own]
        exact = exact_scores(self.vectors[members], query)
        if exact.dtype == object:
            best = np.array(sorted(range(len(exact)), key=lambda i: (-exact[i], self.ids[members[i]]))[:k], np.int64)
        else:
            best = np.lexsort((self.ids[members], -exact))[:k]
        return self.ids[members][best], exact[best]


def exact_scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products; beyond 53 bits with Python's integers, held to 64 bits."""
    if not len(vectors):
        return np.zeros(0, np.int64)
    if float(np.abs(vectors).max()) * float(np.abs(query).max()) * max(1, vectors.shape[1]) < EXACT:
        return (vectors @ query).astype(np.int64)
    q = [int(x) for x in query]
    top = (1 << 63) - 1
    return np.array([min(top, max(-top - 1, sum(int(a) * b for a, b in zip(v, q, strict=True)))) for v in vectors], object)


def _matrix(frame: pd.DataFrame, dims: int) -> np.ndarray:
    out = np.zeros((len(frame), dims))
    for i, v in enumerate(frame["vector"]):
        out[i, : len(v)] = v
    return out


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and the components floor(SCALE * x) of the vectors that take part."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("vector"))


def top_k(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` best of every query (ids divisible by ``every``).

    Vectors that are null, or hold null or non-finite components, and vectors without id take no part.
    Shorter vectors count as filled up with zeros; empty ones score 0. Rows that repeat an id are
    candidates of their own, but a query never meets its own id, and is asked once, with the smallest
    of its vectors. Ties go to the smaller id. Scores beyond 64 bits are held to them. An empty table
    gives an empty result. Further columns are ignored.

    Queries and candidates are dealt into blocks, and every pair of blocks is one task: a task holds at
    most some thousand vectors, whatever the size of the table.
    """
    ready = quantised(vectors)
    asked = ready.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    n, queries = ready.count(), asked.count()
    candidate_blocks, query_blocks = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-queries // QUERY_BLOCK))
    block = lambda count: F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = asked.select("vec_id", "vector", block(query_blocks).alias("q"), each(candidate_blocks).alias("c"))
    right = ready.select("vec_id", "vector", block(candidate_blocks).alias("c"), each(query_blocks).alias("q"))

    def search(questions: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(questions) and len(candidates):
            dims = max(1, max(map(len, questions["vector"])), max(map(len, candidates["vector"])))
            index = ImpactIndex(_matrix(candidates, dims), candidates["vec_id"].to_numpy(np.int64))
            for i, q in zip(questions["vec_id"], _matrix(questions, dims), strict=True):
                ids, scores = index.search(q, int(i), k)
                out += [(int(i), int(v), int(s)) for v, s in zip(ids, scores, strict=True)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    found = left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInPandas(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
