"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every document of a source is to be taken the same expected number of times c (target / size of the
source): floor(c) times for certain, and once more with the fractional probability. Pairs of documents
play for that probability: mass (probability x words) moves from one to the other, the direction drawn so
that expectations stay, until one of the two is decided. A block of documents is folded in this way into
decided documents and one residual; residuals meet in blocks of their own, level by level, until one is
left a source. The words taken so differ from the target by less than the size of one document; as the
long documents of a block play first, the residual is mostly a short one. Masses are integers, so that nothing is lost by rounding on the way. Draws are hashes of the ids: reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillsift.llm.common import WORD_PATTERN, checkpointed

#: Units of probability, and documents of a block on average.
SCALE = 1 << 20
BLOCK = 512
MOST_REPEATS = 3
WEIGHTS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, target, n): shares by weight, none above MOST_REPEATS times its size.

    Resharing the excess until none is above ends at one water level: each source gets the smaller
    of its cap and weight x level, and the level is the largest of (total - caps of the k sources
    that fill first) / (weights of the others). One row a source goes through the windows.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    ranked = sources.withColumn("weight", (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(WEIGHTS)) + 1).cast("double"))
    capped = ranked.withColumn("cap", F.col("source_size").cast("double") * MOST_REPEATS)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cap")
    rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    leveled = capped.withColumn("level", (F.sum("source_size").over(everything) - before) / rest)
    return leveled.select("source", "source_size", "n", F.least(F.col("cap"), F.col("weight") * F.max("level").over(everything)).alias("target"))


def _fold(level: int) -> str:
    """SQL that folds the array ``units`` into decided documents (done) and one residual (cur)."""
    unit = "named_struct('r', {0}.r, 't', {0}.t, 'doc_id', {0}.doc_id, 'size', {0}.size, 'mass', {1})"
    decided = "named_struct('doc_id', {0}.doc_id, 'size', {0}.size, 'extra', if({1} = {0}.size * {2}L and {0}.size > 0, 1, 0))"
    keep_x = unit.format("x", "x.mass - e.delta")
    keep_cur = unit.format("s.cur", "s.cur.mass + e.delta")
    done_x = decided.format("x", "(x.mass - e.delta)", SCALE)
    done_cur = decided.format("s.cur", "(s.cur.mass + e.delta)", SCALE)
    return f"""
    aggregate(slice(units, 2, size(units)),
      named_struct('cur', units[0], 'done', cast(array() as array<struct<doc_id: bigint, size: bigint, extra: int>>)),
      (s, x) -> transform(
        transform(
          array(named_struct('up', least(s.cur.size * {SCALE}L - s.cur.mass, x.mass), 'down', least(s.cur.mass, x.size * {SCALE}L - x.mass))),
          d -> named_struct('delta', if(pmod(xxhash64(s.cur.doc_id, x.doc_id, {level}), greatest(d.up + d.down, 1L)) < d.down, d.up, -d.down))),
        e -> if(s.cur.mass + e.delta = 0 or s.cur.mass + e.delta = s.cur.size * {SCALE}L,
                named_struct('cur', {keep_x}, 'done', concat(s.done, array({done_cur}))),
                named_struct('cur', {keep_cur}, 'done', concat(s.done, array({done_x})))))[0])"""


def mix(documents: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and source of every row of ``documents`` (doc_id, text, source).

    Null and empty texts have size 0 and take no words. The null source is a source of its own, the last
    one. Repeated rows are documents of their own. Sources of size 0 have the target 0. An empty table
    gives an empty result. Further columns are ignored.
    """
    sized = checkpointed(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size")))
    targets = checkpointed(source_targets(sized))  # one row a source
    keyed = targets.withColumnRenamed("source", "of_source")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    planned = (
        sized.join(keyed, F.col("source").eqNullSafe(F.col("of_source")))
        .drop("of_source")
        .withColumn("sure", F.floor(share).cast("int"))
        .withColumn("chance", F.round((share - F.floor(share)) * SCALE).cast("long"))
    )
    told = ["source", "source_size", "target", "sure"]
    open_units = (F.col("size") > 0) & (F.col("chance") > 0) & (F.col("chance") < SCALE)
    results = [planned.where(~open_units).select("doc_id", "size", *told, (F.col("chance") >= SCALE).cast("int").alias("extra"))]
    units = planned.where(open_units).select(*told, "n", "doc_id", "size", (F.col("size") * F.col("chance")).alias("mass"))
    largest = targets.agg(F.max("n")).first()[0] or 1
    levels = max(1, math.ceil(math.log(max(2, largest), BLOCK)))
    for level in range(levels):
        blocks = F.ceil(F.col("n") / F.lit(float(BLOCK ** (level + 1)))).cast("long")
        folded = (
            units.withColumn("block", F.pmod(F.xxhash64("doc_id", "size", F.lit(level)), blocks))
            .groupBy(*told, "n", "block")
            .agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("r"), F.xxhash64("doc_id", F.lit(~level)).alias("t"), "doc_id", "size", "mass"))).alias("units"))
            .select(*told, "n", F.expr(_fold(level)).alias("s"))
        )
        folded = checkpointed(folded)
        results.append(folded.select(*told, F.explode("s.done").alias("d")).select("d.doc_id", "d.size", *told, "d.extra"))
        units = folded.select(*told, "n", "s.cur.doc_id", "s.cur.size", "s.cur.mass")
    # At the last level a source is one block; its one residual goes the way that is nearer to the target.
    last = 2 * F.col("mass") >= F.col("size") * SCALE
    results.append(units.select("doc_id", "size", *told, last.cast("int").alias("extra")))
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    copies = (F.col("sure") + F.col("extra")).cast("int")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), "source")
