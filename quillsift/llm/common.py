"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.functions.batches import give_back

WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: bytes.split() knows exactly these separators."""
    return text_bytes(text).split()


def doc_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the session names (spark.checkpoint.dir). Only a local session, which has one machine, gets one where none is named."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if named is None:
            import tempfile

            named = tempfile.mkdtemp(prefix="quillsift-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


#: What a worker remembers between partitions: one memory only, that of the operator that ran last.
_HELD: dict[object, object] = {}


def worker_memory[M](key: object, make: Callable[[], M]) -> M:
    """The memory of ``key`` in this worker. Asking for another one drops it, so that memories of several stages never add up."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def tidy[F: Callable](run: F) -> F:
    """``run``, a function of one to three arguments over frames, giving memory back when it is done."""

    def done(out):
        if isinstance(out, Iterator):
            return _after(out)
        give_back()
        return out

    # The engine counts the arguments of a function, so that they are spelled out.
    match run.__code__.co_argcount:
        case 1:
            return wraps(run)(lambda a: done(run(a)))
        case 2:
            return wraps(run)(lambda a, b: done(run(a, b)))
        case _:
            return wraps(run)(lambda a, b, c: done(run(a, b, c)))


def _after(frames: Iterator) -> Iterator:
    try:
        yield from frames
    finally:
        give_back()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class WordHashes(dict):
    """Word -> 64-bit hash; emptied when it holds more than ``limit`` bytes."""

    #: Bytes that an entry takes beside its word.
    ENTRY = 180

    def __init__(self, limit: int = 32 << 20):
        super().__init__()
        self.limit, self.held = limit, 0

    def __missing__(self, word: bytes) -> int:
        value = (zlib.crc32(word) << 32 | zlib.crc32(word, 0x9E3779B9)) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        value ^= value >> 29
        if self.held > self.limit:
            self.clear()
            self.held = 0
        self.held += self.ENTRY + len(word)
        self[word] = value
        return value

    def array(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


def word_hashes() -> WordHashes:
    return worker_memory("word hashes", WordHashes)


def sparse_rows(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """uint32 blobs, one a row, as CSR (indices, row starts)."""
    starts = np.zeros(len(blobs) + 1, np.int64)
    np.cumsum([len(b) // 4 for b in blobs], out=starts[1:])
    return np.frombuffer(b"".join(blobs), np.int32), starts


def row_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of ``values`` in each CSR row, empty rows included."""
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[starts[1:]] - total[starts[:-1]]


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, held_modulus: int, held_value: int, bound: int) -> DataFrame:
    """(doc_id, text, label) of training rows, about ``bound`` at most.

    Rows of the held-out remainder and rows without id or label never come in. Where more than
    ``bound`` labelled rows exist, an even share of them is taken by a hash of the id. Repeated
    label rows count once, with the larger label.
    """
    known = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (doc_remainder("doc_id", held_modulus) != held_value))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    share = min(1.0, bound / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < int(share * (1 << 20)))
    # The sample is bounded, so that its ids (16 bytes each) may be sent to every executor.
    return documents.select("doc_id", "text").join(F.broadcast(known), "doc_id")
