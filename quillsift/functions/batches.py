"""Functions of one row's values, run in Python over Arrow batches in small pieces."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of text, and rows, whose results are made and handed back at a time.
PIECE_BYTES, PIECE_ROWS = 1 << 20, 500


def give_back() -> None:
    """Hands freed memory back to the system: a reused worker otherwise keeps the peak of all its partitions."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def pieces(columns: tuple[pa.Array, ...]) -> Iterator[tuple[pa.Array, ...]]:
    """Arrays of strings, cut after ``PIECE_ROWS`` rows or as many as ``PIECE_BYTES`` allow; a longer row is a piece alone."""
    rows = len(columns[0])
    ends = np.cumsum(sum(pc.binary_length(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns))
    at = 0
    while at < rows:
        most = (ends[at - 1] if at else 0) + PIECE_BYTES
        end = min(max(int(np.searchsorted(ends, most, side="right")), at + 1), at + PIECE_ROWS)
        yield tuple(c.slice(at, end - at) for c in columns)
        at = end


def rowwise(returns: T.DataType, prepare: Callable[[], Callable]):
    """UDF over columns of strings; ``prepare`` is called once a task and gives the function of a row's values (nulls are None).

    The engine bounds an incoming batch in bytes. Results are made and sent piece by piece, so that
    what a worker holds beside that batch does not go with the number or the length of its rows.
    """
    kind = to_arrow_type(returns)

    @F.arrow_udf(returns)
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        try:
            of = prepare()
            for columns in batches:
                for piece in pieces(columns if isinstance(columns, tuple) else (columns,)):
                    yield pa.array([of(*row) for row in zip(*(c.to_pylist() for c in piece), strict=True)], kind)
                columns = piece = None  # else two batches are held while the next one is read
        finally:
            give_back()

    return run


def textwise(returns: T.DataType, of: Callable):
    """``rowwise`` for a function of one text; null stays null."""
    return rowwise(returns, lambda: lambda text: None if text is None else of(text))
