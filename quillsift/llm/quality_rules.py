"""Quality rules whose cutoffs come from mergeable quantile sketches per language and source.

The sketch of a group is a log-linear histogram: a non-negative integer falls into the bucket that
keeps its top ``PRECISION`` bits, so a bucket's lower bound is within 1/32 of every member. Sketches
merge by adding counts, which a partial aggregation does before the shuffle; a group of any size ends
as some hundred buckets a feature. Cutoffs are read from a group's own sketch mixed with the sketch of
all documents (``PRIOR`` rows' worth), so that small groups lean on the whole. A cutoff is a fence: the
quantile at HIGH, plus REACH times its distance from the one at MIDDLE. No constant stands under it: where
nine in ten documents of a group have nothing of a kind, any share of it is out of line there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillsift.llm.common import checkpointed, text_bytes, tidy

PRECISION = 6
#: Ratios per 1000, of which a document must not be above the cutoff.
RATIOS = ("symbol_permille", "dup_line_permille", "repeat_permille", "word_length_permille")
#: Per mille of the quantiles that a cutoff is made of, and how far it is beyond the higher one.
HIGH, MIDDLE, REACH = 900, 500, 2
PRIOR = 200

BASE_SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())]
    + [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")]
)


def repeated_words(tokens: list[bytes], width: int = 8) -> int:
    """Words in ``width``-word windows (a power of two) found twice or more, the first included.

    Windows are named exactly by rank doubling: a window of 2k words is the pair of two of k.
    """
    n = len(tokens)
    if n < width + 1:
        return 0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(t, len(names)) for t in tokens), np.int64, n)
    if len(names) == n:
        return 0
    span = 1
    while span < width:
        pair = ids[:-span] * (n + 1) + ids[span:]
        ids = np.unique(pair, return_inverse=True)[1]
        span *= 2
    starts = np.flatnonzero(np.bincount(ids)[ids] > 1)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def base_counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    raw = text_bytes(text)
    tokens = raw.split()
    packed = b"".join(tokens)
    chars = len(packed.decode("utf-8", "surrogatepass")) if tokens else 0
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return (
        len(tokens),
        chars,
        len(packed) - len(packed.translate(None, b"#*$%&|<>")),
        len(lines) - len(set(lines)),
        repeated_words(tokens),
        len(lines),
    )


@tidy
def _measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        counts = [base_counts(t) for t in frame["text"]]
        out = pd.DataFrame(np.array(counts, np.int64).reshape(-1, 6), columns=BASE_SCHEMA.names[3:])
        for at, name in enumerate(("doc_id", "lang", "source")):
            out.insert(at, name, frame[name].array)
        yield out


def bucket(value: Column) -> Column:
    """Lower bound of the sketch bucket of a non-negative integer."""
    drop = F.greatest(F.length(F.bin(value)) - PRECISION, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def measured(documents: DataFrame) -> DataFrame:
    """Base counts and ratios of every document; one pass over the texts, no shuffle."""
    counts = documents.select("doc_id", "lang", "source", "text").mapInPandas(_measure, BASE_SCHEMA)
    per = lambda part, whole: F.when(F.col(whole) > 0, F.expr(f"1000 * {part} div {whole}")).otherwise(F.lit(0)).cast("long")
    return counts.withColumns(
        {
            "symbol_permille": per("n_symbols", "word_chars"),
            "dup_line_permille": per("n_dup_lines", "n_lines"),
            "repeat_permille": per("n_repeat_words", "n_words"),
            "word_length_permille": per("word_chars", "n_words"),
            "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
        }
    )


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, feature, bucket, n) over documents that pass the base rules."""
    long = rows.where(~F.col("base_failed")).select(
        "lang", "source", F.explode(F.array(*[F.struct(F.lit(r).alias("feature"), bucket(F.col(r)).alias("bucket")) for r in RATIOS])).alias("x")
    )
    return long.groupBy("lang", "source", "x.feature", "x.bucket").agg(F.count(F.lit(1)).alias("n"))


def bucket_end(start: Column) -> Column:
    """Largest value in the sketch bucket that begins at ``start``."""
    drop = F.greatest(F.length(F.bin(start)) - PRECISION, F.lit(0))
    return start + F.call_function("shiftleft", F.lit(1).cast("long"), drop) - 1


def cutoffs(sketch: DataFrame) -> DataFrame:
    """One row a (lang, source) with the cutoff of every ratio."""
    whole = sketch.groupBy("feature", "bucket").agg(F.sum("n").alias("n_all"))
    total = whole.groupBy("feature").agg(F.sum("n_all").alias("n_total"))
    groups = sketch.select("lang", "source", "feature").distinct()
    prior = groups.join(whole, "feature").join(total, "feature").select("lang", "source", "feature", "bucket", (F.lit(1.0) * PRIOR * F.col("n_all") / F.col("n_total")).alias("w"))
    mixed = (
        sketch.select("lang", "source", "feature", "bucket", F.col("n").cast("double").alias("w"))
        .unionByName(prior)
        .groupBy("lang", "source", "feature", "bucket")
        .agg(F.sum("w").alias("w"))
        .groupBy("lang", "source", "feature")
        .agg(F.sort_array(F.collect_list(F.struct("bucket", "w"))).alias("b"), F.sum("w").alias("all_w"))
    )
    # A group has some hundred buckets, whatever its number of rows: the fold over them is bounded.
    nowhere = F.lit(-1).cast("long")

    def step(s: Column, x: Column) -> Column:
        seen = s["seen"] + x["w"]
        reached = lambda at, permille: F.when((at < 0) & (seen * 1000 >= F.col("all_w") * permille - 1e-6), bucket_end(x["bucket"])).otherwise(at)
        return F.struct(seen.alias("seen"), reached(s["middle"], MIDDLE).alias("middle"), reached(s["high"], HIGH).alias("high"))

    walk = F.aggregate("b", F.struct(F.lit(0.0).alias("seen"), nowhere.alias("middle"), nowhere.alias("high")), step)
    cut = walk["high"] + REACH * (walk["high"] - walk["middle"])
    return (
        mixed.select("lang", "source", "feature", cut.alias("cut"))
        .groupBy("lang", "source")
        .pivot("feature", list(RATIOS))
        .agg(F.first("cut"))
        .select("lang", "source", *[F.col(r).alias(f"{r}_cut") for r in RATIOS])
    )


def quality_rules(documents: DataFrame) -> DataFrame:
    """Base counts, cutoffs and verdict of every row of ``documents`` (doc_id, text, lang, source).

    Null and empty texts have no words and fail the base rules. Null languages and sources are groups
    of their own. Repeated rows are judged each by itself; ties with a cutoff are kept. An empty table
    gives an empty result. Further columns of ``documents`` are ignored.
    """
    rows = checkpointed(measured(documents))  # some 100 bytes a document; read for the sketches and again for the verdict
    cuts = cutoffs(sketches(rows)).withColumnsRenamed({"lang": "cut_lang", "source": "cut_source"})
    within = F.lit(True)
    for ratio in RATIOS:
        within &= F.coalesce(F.col(ratio) <= F.col(f"{ratio}_cut"), F.lit(False))
    names = [f"{r}_cut" for r in RATIOS]
    return rows.join(cuts, F.col("lang").eqNullSafe(F.col("cut_lang")) & F.col("source").eqNullSafe(F.col("cut_source")), "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & within).alias("kept"), *names
    )
