"""Removal of repeated byte strings across documents, by suffix sorting of what may repeat.

A byte goes if a string of WIDTH bytes that covers it also starts in a document with a smaller id.
Sorting the suffixes of all positions would shuffle several times the corpus, so positions are thinned
out first, without losing any repeat. A string of WIDTH bytes has LEFT + 1 grams of GRAM bytes; the gram
of the smallest hash is its anchor, and equal strings have equal anchors. Texts are dealt by a hash of the
row into groups of GROUP_BYTES; the steps between them exchange arrays of numbers only:

1. keys: every group sends the distinct hashes of its anchors (32 bits each within a bucket).
2. shared: a bucket answers by one bit a hash whether more than one document has it.
3. suffixes: of shared anchors, a group sorts the contexts, deep-shallow: the bytes of the strings that have
   the anchor. Of equal contexts the one in the smallest document goes on, as bytes, to a bucket; in larger
   documents of the group, all its strings are settled.
4. strings: a bucket sorts the contexts of all groups deep-shallow, from the anchor to the right and from the
   anchor to the left, names equal prefixes of each length, and finds the smallest document of each string
   as a pair of names.
5. The groups mark what is settled and cut it out.

Hashes only select what may repeat; bytes go where sorting found the same bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillsift.llm.common import text_bytes, tidy
from quillsift.llm.suffix_sort import ranges, deep_shallow_order, neighbour_prefixes, prefix_names

WIDTH = 50
GRAM = 20
LEFT = WIDTH - GRAM
GROUP_BYTES = 8 << 20
CHUNK_BYTES = 96 << 10
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)

#: Groups to a bucket: there are fewer buckets than groups, and fewer messages between them.
SHARE = 2

#: Rows between groups and buckets. kind 0: keys; 1: shared bits; 2: settled strings; 3: contexts.
PART_SCHEMA = "g int, bucket int, kind int, a binary, b binary, c binary, d binary"
DIGEST_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
TEXT_SCHEMA = DIGEST_SCHEMA + ", kept string, spans array<bigint>"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the GRAM bytes from each position on, by doubling 1, 2, 4, 8, 16, then 16 + 4."""
    h = data.astype(np.uint64) + np.uint64(1)
    h *= _MIX[0]
    h ^= h >> np.uint64(31)
    four = None
    for level, span in enumerate((1, 2, 4, 8)):
        h = h[:-span] * _MIX[level + 1] + h[span:]
        if span == 2:
            four = h
    h = h[: len(data) - GRAM + 1] * _MIX[5] + four[16 : 16 + len(data) - GRAM + 1]
    h ^= h >> np.uint64(32)
    h *= _MIX[0]
    h ^= h >> np.uint64(29)
    return h


def _sliding(values: np.ndarray, best) -> np.ndarray:
    """best over LEFT + 1 = 31 neighbours, by doubling."""
    out = values
    for span in (1, 2, 4, 8):
        out = best(out[:-span], out[span:])
    return best(out[: len(values) - LEFT], out[15 : 15 + len(values) - LEFT])


class Group:
    """The texts of one group in one buffer, by id, then text."""

    def __init__(self, frame: pd.DataFrame):
        texts = list(map(text_bytes, frame["text"]))
        known = [(int(i), t, k) for k, (i, t) in enumerate(zip(frame["doc_id"], texts, strict=True)) if not pd.isna(i)]
        known.sort(key=lambda r: r[:2])
        #: Row of the frame of each text in the buffer, then of the rows without id.
        self.order = [k for _, _, k in known] + [k for k, i in enumerate(frame["doc_id"]) if pd.isna(i)]
        self.without_id = [texts[k] for k in self.order[len(known) :]]
        rows = [(i, t) for i, t, _ in known]
        self.ids = np.array([i for i, _ in rows], np.int64)
        self.ends = np.cumsum(np.array([len(t) for _, t in rows], np.int64)) if rows else np.zeros(0, np.int64)
        self.starts = np.r_[0, self.ends[:-1]].astype(np.int64) if rows else self.ends
        self.data = b"".join(t for _, t in rows)
        self.array = np.frombuffer(self.data, np.uint8)

    def _chunks(self) -> Iterator[tuple[int, int]]:
        begin = 0
        while begin < len(self.ids):
            stop = max(begin + 1, int(np.searchsorted(self.ends, self.starts[begin] + CHUNK_BYTES, "right")))
            yield begin, stop
            begin = stop

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Position and gram hash of every anchor, and how far before it the first and the last string start that have it."""
        found = []
        for begin, stop in self._chunks():
            base, top = int(self.starts[begin]), int(self.ends[stop - 1])
            if top - base < WIDTH:
                continue
            sizes = self.ends[begin:stop] - self.starts[begin:stop]
            h = gram_hashes(self.array[base:top])
            end = np.repeat(self.ends[begin:stop] - base, sizes)
            least = _sliding(h, np.minimum)
            least[end[: len(least)] < np.arange(len(least)) + WIDTH] = 0  # strings across documents
            reach = np.zeros(len(h) + LEFT, np.uint64)
            reach[LEFT : LEFT + len(least)] = least
            most = _sliding(reach, np.maximum)
            at = np.flatnonzero((most == h) & (most > 0))
            own = h[at]
            first, last = np.zeros(len(at), np.uint8), np.full(len(at), LEFT, np.uint8)
            for before in range(LEFT + 1):  # ``reach`` at ``at + LEFT - before`` is the string that starts ``before`` bytes earlier
                has = reach[at + (LEFT - before)] == own
                first[has] = before
                last[has & (last == LEFT)] = before
            found.append((at + base, own, first, last))
        kinds = (np.int64, np.uint64, np.uint8, np.uint8)
        return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, kind) for k, kind in enumerate(kinds))

    def document_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, "right") - 1 if len(places) else places

    def distinct_codes(self, keys: np.ndarray, places: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct bucket << 32 | 32 bits; whether two ids have it; of each anchor, its place among them."""
        codes = (keys >> np.uint64(36)) % np.uint64(buckets) << np.uint64(32) | keys & np.uint64(0xFFFFFFFF)
        order = np.argsort(codes, kind="stable")  # places rise, and so do ids
        ranked = codes[order]
        begin = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, np.int64)
        stop = np.r_[begin[1:], len(ranked)] - 1 if len(begin) else begin
        ids = self.ids[self.document_of(places)][order]
        member = np.zeros(len(codes), np.int64)
        member[order] = np.cumsum(np.r_[False, ranked[1:] != ranked[:-1]]) if len(ranked) else 0
        return ranked[begin], ids[begin] != ids[stop], member


def _by_bucket(codes: np.ndarray) -> Iterator[tuple[int, int, int]]:
    bucket = (codes >> np.uint64(32)).astype(np.int64)
    begin = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    for a, b in zip(begin, np.r_[begin[1:], len(bucket)], strict=True):
        yield int(bucket[a]), int(a), int(b)


def _rows(rows: list[tuple]) -> pd.DataFrame:
    filled = [(*r, *([None] * (7 - len(r)))) for r in rows]
    return pd.DataFrame(filled, columns=["g", "bucket", "kind", "a", "b", "c", "d"]).astype({"g": "int32", "bucket": "int32", "kind": "int32"})


def _of(frame: pd.DataFrame, kind: int) -> pd.DataFrame:
    return frame[frame["kind"] == kind]


def _joined(blobs, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype)


#: A context: its document, the place of the anchor, and how far before that its first and its last string start.
HEAD = np.dtype([("id", "<i8"), ("at", "<u4"), ("first", "u1"), ("last", "u1")])


def send_keys(buckets: int):
    @tidy
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        group = Group(frame)
        places, keys, _, _ = group.anchors()
        codes, several, _ = group.distinct_codes(keys, places, buckets)
        small = codes.astype(np.uint32)
        return _rows([(int(key[0]), b, 0, small[i:j].tobytes(), np.packbits(several[i:j]).tobytes()) for b, i, j in _by_bucket(codes)])

    return run


@tidy
def answer_shared(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    lengths = [len(a) // 4 for a in frame["a"]]
    codes = _joined(frame["a"], "<u4")
    several = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for b, n in zip(frame["b"], lengths, strict=True)])
    names, counts = np.unique(codes, return_inverse=True, return_counts=True)[1:]
    shared = (counts > 1) | (np.bincount(names, weights=several) > 0)
    bits, out, at = shared[names], [], 0
    for g, n in zip(frame["g"], lengths, strict=True):
        if bits[at : at + n].any():
            out.append((int(g), int(key[0]), 1, np.packbits(bits[at : at + n]).tobytes()))
        at += n
    return _rows(out)


def _least(run: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id of each row's run; runs are numbered from 0 and adjacent."""
    if not len(run):
        return ids
    return np.minimum.reduceat(ids, np.flatnonzero(np.r_[True, run[1:] != run[:-1]]))[run]


def all_strings(head: np.ndarray) -> np.ndarray:
    """Mask of the strings of each context: bit k for the one that starts k bytes before the anchor."""
    one = np.uint64(1)
    return (((one << (head["first"].astype(np.uint64) + one)) - one) & ~((one << head["last"].astype(np.uint64)) - one)).astype(np.uint32)


def context_matrix(text: np.ndarray, begin: np.ndarray, head: np.ndarray) -> np.ndarray:
    """A row a context, whose bytes begin at ``begin`` of ``text``: from the anchor to the right, from it to the left, and both lengths; zeros beyond."""
    out = np.zeros((len(head), WIDTH + LEFT + 2), np.uint8)
    first, last = head["first"].astype(np.int64), head["last"].astype(np.int64)
    anchor = begin + first
    for column in range(WIDTH):
        has = np.flatnonzero(column < WIDTH - last)
        out[has, column] = text[anchor[has] + column]
    for column in range(LEFT):
        has = np.flatnonzero(column < first)
        out[has, WIDTH + column] = text[anchor[has] - 1 - column]
    out[:, -2], out[:, -1] = head["first"], head["last"]
    return out


def equal_contexts(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted order of the contexts, the run of equal ones of each row in that order, and its common prefix with the row before."""
    order = deep_shallow_order(matrix)
    prefixes = neighbour_prefixes(matrix, order)
    return order, np.cumsum(prefixes < matrix.shape[1]) - 1, prefixes


def send_suffixes(buckets: int):
    @tidy
    def run(key: tuple, frame: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return _rows([])
        g, group = int(key[0]), Group(frame)
        places, keys, first, last = group.anchors()
        codes, _, member = group.distinct_codes(keys, places, buckets)
        bits = dict(zip(answers["bucket"], answers["a"], strict=True))
        shared = np.zeros(len(codes), bool)
        for b, i, j in _by_bucket(codes):
            if b in bits:
                shared[i:j] = np.unpackbits(np.frombuffer(bits[b], np.uint8), count=j - i).astype(bool)
        keep = shared[member] if len(member) else np.zeros(0, bool)
        bucket = (codes >> np.uint64(32)).astype(np.int64)[member[keep]]
        head = np.zeros(len(bucket), HEAD)
        head["at"], head["first"], head["last"] = places[keep], first[keep], last[keep]
        head["id"] = group.ids[group.document_of(places[keep])]
        by_bucket = np.argsort(bucket, kind="stable")
        out, settled = [], [head[:0]]
        for part in np.split(by_bucket, np.flatnonzero(np.diff(bucket[by_bucket])) + 1):
            if not len(part):
                continue
            rows = head[part]
            begin = rows["at"].astype(np.int64) - rows["first"]
            order, run_of, _ = equal_contexts(context_matrix(group.array, begin, rows))
            later = np.zeros(len(rows), bool)
            later[order] = rows["id"][order] > _least(run_of, rows["id"][order])
            settled.append(rows[later])
            rows, begin = rows[~later], begin[~later]
            sizes = WIDTH + rows["first"].astype(np.int64) - rows["last"]
            out.append((g, int(bucket[part[0]]), 3, rows.tobytes(), group.array[ranges(begin, sizes)].tobytes()))
        settled = np.concatenate(settled)
        if len(settled):  # a bucket takes what a group settled by itself along, so that one table goes on
            out.append((g, g % buckets, 2, settled["at"].astype("<u4").tobytes(), all_strings(settled).astype("<u4").tobytes()))
        return _rows(out)

    return run


def repeated_strings(head: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Of each context the mask of its strings that stand in a smaller document too; ``text``: the bytes of the contexts, one after the other."""
    mask = np.zeros(len(head), np.uint32)
    if len(head) < 2:
        return mask
    sizes = WIDTH + head["first"].astype(np.int64) - head["last"]
    matrix = context_matrix(text, np.cumsum(sizes) - sizes, head)
    order, run, prefixes = equal_contexts(matrix)
    least = _least(run, head["id"][order])
    # Of equal contexts, those in larger documents go as a whole; one of each kind is looked at further.
    kind = np.r_[True, run[1:] != run[:-1]]
    one = order[kind]
    kinds, ids, prefixes = head[one], least[kind], prefixes[kind]
    left = prefix_names(np.ascontiguousarray(matrix[one, WIDTH : WIDTH + LEFT]), list(range(LEFT + 1)), shallow=16)
    found = np.zeros(len(kinds), np.uint32)
    for before in range(LEFT + 1):
        at = np.flatnonzero((kinds["first"] >= before) & (kinds["last"] <= before))
        if len(at) < 2:
            continue
        name = np.cumsum(prefixes < WIDTH - before)[at] * (len(kinds) + 1) + left[before][at]
        turn = np.argsort(name, kind="stable")
        own = ids[at[turn]]
        found[at[turn[own > _least(np.cumsum(np.r_[False, np.diff(name[turn]) != 0]), own)]]] |= np.uint32(1 << before)
    mask[order] = np.where(head["id"][order] > least, all_strings(head[order]), found[run])
    return mask


@tidy
def settle_strings(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    passed, contexts = _of(frame, 2), _of(frame, 3)
    out = [(int(g), int(key[0]), 2, a, b) for g, a, b in zip(passed["g"], passed["a"], passed["b"], strict=True)]
    head = _joined(contexts["a"], HEAD)
    mask, at = repeated_strings(head, _joined(contexts["b"], np.uint8)), 0
    for g, blob in zip(contexts["g"], contexts["a"], strict=True):
        n = len(blob) // HEAD.itemsize
        hit = at + np.flatnonzero(mask[at : at + n])
        if len(hit):
            out.append((int(g), int(key[0]), 2, head["at"][hit].astype("<u4").tobytes(), mask[hit].astype("<u4").tobytes()))
        at += n
    return _rows(out)


def merged_spans(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans, touching ones joined."""
    if not len(begin):
        return begin, end
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    fresh = np.flatnonzero(np.r_[True, begin[1:] > reach[:-1]])
    return begin[fresh], reach[np.r_[fresh[1:], len(begin)] - 1]


def cut_out(texts: bool, carry: list[str]):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept", "spans"] * texts

    @tidy
    def run(key: tuple, frame: pd.DataFrame, settled: pd.DataFrame) -> pd.DataFrame:
        group = Group(frame) if len(frame) else None
        if group is None:
            return pd.DataFrame([], columns=names + [f"carry_{c}" for c in carry])
        at, mask = _joined(settled["a"], "<u4").astype(np.int64), _joined(settled["b"], "<u4")
        begin, end = [], []
        for before in range(LEFT + 1):
            hit = at[mask >> np.uint32(before) & np.uint32(1) > 0] - before
            begin.append(hit)
            end.append(hit + WIDTH)
        begin, end = np.concatenate(begin), np.concatenate(end)
        # Spans never cross documents, but touch at their ends: they are joined document by document.
        order = np.argsort(begin, kind="stable")
        begin, end = begin[order], end[order]
        first = np.searchsorted(begin, group.starts)
        last = np.r_[first[1:], len(begin)]
        rows = []
        for k, (i, a, b) in enumerate(zip(group.ids.tolist(), group.starts.tolist(), group.ends.tolist(), strict=True)):
            x, y = merged_spans(begin[first[k] : last[k]], end[first[k] : last[k]]) if a < b else (begin[:0], begin[:0])
            edges = [a, *np.stack([x, y], 1).ravel().tolist(), b]
            kept = b"".join(group.data[edges[n] : edges[n + 1]] for n in range(0, len(edges), 2))
            row = (i, b - a, b - a - len(kept), len(x), hashlib.sha256(kept).hexdigest())
            rows.append((*row, kept.decode("utf-8", "ignore"), [e - a for e in edges[1:-1]]) if texts else row)
        for t in group.without_id:
            row = (None, len(t), 0, 0, hashlib.sha256(t).hexdigest())
            rows.append((*row, t.decode("utf-8", "ignore"), []) if texts else row)
        out = pd.DataFrame(rows, columns=names)
        out["doc_id"] = pd.array([None if pd.isna(i) else int(i) for i in (r[0] for r in rows)], "Int64")
        for c in carry:
            out[f"carry_{c}"] = frame[f"carry_{c}"].array.take(group.order)
        return out

    return run


def suffix_dedup(documents: DataFrame, texts: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """n_bytes, n_removed, n_spans and kept_sha256 of every row; with ``texts`` also the kept text and the removed spans.

    Columns named in ``carry`` come along as ``carry_<name>``, so that nothing has to be joined back.

    Spans are byte offsets (begin, end, begin, ...). The kept text leaves out bytes of characters that were
    cut through. A null text counts as empty. A row without id is left whole, and removes nothing elsewhere. Rows of
    one id do not remove each other's bytes, whether they repeat or clash. Texts under WIDTH bytes are
    left whole. An empty table gives an empty result. Further columns are ignored.
    """
    size = documents.select(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n")).agg(F.sum("n")).first()[0] or 0
    groups = max(1, -(-size // GROUP_BYTES))
    dealt = documents.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int").alias("g"), F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(c).alias(f"carry_{c}") for c in carry])
    buckets = -(-groups // SHARE)
    keys = dealt.groupBy("g").applyInPandas(send_keys(buckets), PART_SCHEMA)
    shared = keys.groupBy("bucket").applyInPandas(answer_shared, PART_SCHEMA)
    contexts = dealt.groupBy("g").cogroup(shared.groupBy("g")).applyInPandas(send_suffixes(buckets), PART_SCHEMA)
    settled = contexts.groupBy("bucket").applyInPandas(settle_strings, PART_SCHEMA)
    schema = T.StructType.fromDDL(TEXT_SCHEMA if texts else DIGEST_SCHEMA)
    for field in dealt.select(*[f"carry_{c}" for c in carry]).schema:
        schema.add(field.name, field.dataType)
    return dealt.groupBy("g").cogroup(settled.groupBy("g")).applyInPandas(cut_out(texts, list(carry)), schema)
