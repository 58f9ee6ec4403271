"""SimHash near-duplicates, compared bit-sliced, and their connected components.

Fingerprints equal bit for bit are one node. Two fingerprints within 3 bits agree on at least two of five
bit blocks, so every link is found in one of ten tables keyed by two blocks (25 or 26 bits). The rows of a
table key are compared bit-sliced: all fingerprints of a batch stand as 64 bit planes, each one long
integer, and one shift compares every row with the one d places below. The differing bits of a plane are
added into carry-save counters (two bits and an overflow), and a shift is abandoned once every row's
count is over the radius. Keys of many fingerprints are dealt as pairs of chunks, each compared once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillsift.llm.common import checkpointed, text_bytes, tidy
from quillsift.llm.components import connected_components

RADIUS = 3
BLOCKS = (13, 13, 13, 13, 12)
#: A table key with more fingerprints is dealt as pairs of chunks of about this size.
CHUNK = 1024


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of the text's 3-word shingles, as a signed integer; 0 without words."""
    words = text_bytes(text).lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(words, words[1:], words[2:], strict=False)) if len(words) > 2 else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64)
    ones = np.zeros(64, np.int64)
    for begin in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[begin : begin + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(documents: DataFrame) -> DataFrame:
    @tidy
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"].array, "fp": np.array([fingerprint(t) for t in frame["text"]], np.int64)})

    schema = documents.select(F.col("doc_id").cast("long").alias("doc_id")).schema.add("fp", "long")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, schema)


def bit_planes(fps: np.ndarray) -> list[int]:
    """Plane b as one integer: bit i is bit b of fingerprint i."""
    bits = np.unpackbits(fps.astype(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return [int.from_bytes(np.packbits(bits[:, b], bitorder="little").tobytes(), "little") for b in range(64)]


def _set_bits(value: int, size: int) -> np.ndarray:
    raw = np.frombuffer(value.to_bytes(size // 8 + 1, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little"))


def close_pairs(fps: np.ndarray, cell: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs (i, i + d) of one cell, within RADIUS bits, for each shift d.

    Rows of a cell are adjacent. ``side`` is 0 where all rows of a cell are compared, else the chunk
    (1 or 2): rows of the same chunk are then compared elsewhere.
    """
    n = len(fps)
    if n < 2:
        return
    order = np.arange(n)
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    place = order - np.repeat(starts, np.diff(np.r_[starts, n]))
    planes = bit_planes(fps)
    for d in range(1, int(place.max()) + 1):
        valid = (place[d:] >= d) & ((side[d:] == 0) | (side[d:] != side[:-d]))
        open_rows = int.from_bytes(np.packbits(valid, bitorder="little").tobytes(), "little")
        one = two = over = 0
        for at, plane in enumerate(planes):
            differs = (plane ^ (plane >> d)) & open_rows
            carry = one & differs
            one ^= differs
            over |= two & carry
            two ^= carry
            if at & 7 == 7:
                open_rows &= ~over  # rows beyond the radius are not counted any more
                if not open_rows:
                    break
        close = open_rows & ~over
        if close:
            below = _set_bits(close, n)
            yield below, below + d


def spanning_links(fps: np.ndarray, nodes: np.ndarray, cell: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
    """Of the links of a batch, a spanning forest: (larger node, smaller node)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    out = []
    for left, right in close_pairs(fps, cell, side):
        for a, b in zip(nodes[left].tolist(), nodes[right].tolist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                out.append((max(a, b), min(a, b)))
    return out


@tidy
def _link(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by cell; a cell that the batch may have cut waits for the next one."""
    kept: pd.DataFrame | None = None

    def links(frame: pd.DataFrame) -> pd.DataFrame:
        a = frame[["key", "lo", "hi"]].to_numpy()
        cell = np.cumsum(np.r_[False, (a[1:] != a[:-1]).any(1)])
        side = np.where(a[:, 1] == a[:, 2], 0, np.where(frame["chunk"].to_numpy() == a[:, 1], 1, 2))
        found = spanning_links(frame["fp"].to_numpy(np.int64), frame["node"].to_numpy(np.int64), cell, side)
        return pd.DataFrame(np.array(found, np.int64).reshape(-1, 2), columns=["u", "v"])

    for frame in frames:
        if kept is not None:
            frame = pd.concat([kept, frame], ignore_index=True)
        last = frame[["key", "lo", "hi"]].to_numpy()
        cut = int(np.argmax((last == last[-1]).all(1)[::-1] == False)) if len(last) else 0  # noqa: E712  rows of the last cell
        whole = len(frame) - cut if (last != last[-1]).any() else 0
        kept = frame.iloc[whole:]
        if whole:
            yield links(frame.iloc[:whole])
    if kept is not None and len(kept):
        yield links(kept)


def links(nodes: DataFrame) -> DataFrame:
    """(u, v) with u > v: links between the distinct fingerprints of ``nodes`` (fp, node), enough to connect all that are linked."""
    shifts = np.cumsum((0, *BLOCKS[:-1])).tolist()
    part = [F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in zip(shifts, BLOCKS, strict=True)]
    keys = [
        F.lit(t << 32).bitwiseOR(F.shiftleft(part[i], 13)).bitwiseOR(part[j])
        for t, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))
    ]
    keyed = nodes.select("fp", "node", F.explode(F.array(*keys)).alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumnRenamed("key", "shared_key")
    parts = F.ceil(F.col("n") / F.lit(float(CHUNK))).cast("int")
    rows = (
        keyed.join(shared, F.col("key") == F.col("shared_key"))
        .select("fp", "node", "key", parts.alias("parts"))
        .withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("fp", "node", "key", "chunk", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"))
    )
    spark = nodes.sparkSession
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(count, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "fp").mapInPandas(_link, "u long, v long")


@F.pandas_udf(T.LongType())
def fingerprint_of(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def members(documents: DataFrame) -> DataFrame:
    """doc_id, fp, label and component_id of every row; the label, a fingerprint, names the component also where ids don't."""
    fps = checkpointed(fingerprints(documents))  # 20 bytes a document
    # A fingerprint is its own node: ids of any sign, or none, only meet after the labelling.
    nodes = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = connected_components(links(nodes.select("fp", F.col("fp").alias("node"))))
    linked = labels.join(nodes, F.col("node") == F.col("fp")).select(F.col("fp").alias("linked"), "label", "least")
    least = linked.groupBy(F.col("label").alias("of_label")).agg(F.min("least").alias("component"))
    linked = linked.join(least, F.col("label") == F.col("of_label")).select("linked", "label", "component")
    of_fp = nodes.join(linked, F.col("fp") == F.col("linked"), "left").select(
        F.col("fp").alias("of_fp"), F.coalesce("label", "fp").alias("label"), F.when(F.col("label").isNull(), F.col("least")).otherwise(F.col("component")).alias("component_id")
    )
    return fps.join(of_fp, F.col("fp") == F.col("of_fp"), "left").select("doc_id", "fp", "label", "component_id")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``documents`` (doc_id, text).

    Null and empty texts have the fingerprint zero, which links like any other. Rows of a null id are
    kept, with the smallest id of their component, or null where no member has one. Repeated rows get
    equal results. An empty table gives an empty result. Further columns are ignored.
    """
    return members(documents).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
