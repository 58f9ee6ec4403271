"""The corpus pipeline: toxicity, near-duplicates, repeated passages, source weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillsift.llm.common import checkpoint_folder, checkpointed, table
from quillsift.llm.mixing import mix, word_count
from quillsift.llm.packing import best_fit_pack
from quillsift.llm.simhash import fingerprint_of, members
from quillsift.llm.suffix_dedup import suffix_dedup
from quillsift.llm.toxicity import drop_toxic, fit


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have: documents may bring columns of any name."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, finds toxic go.

    Null and empty texts have the score of the bias alone. Rows of a null id are judged, but not learned from.
    Repeated rows are judged each by itself; without labels of both classes, or without rows, nothing goes.
    """
    return drop_toxic(docs, fit(docs, table(spark, sf_dir, "labels")))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row of the smallest id stays. Rows without id stay.

    Null and empty texts have the fingerprint zero and are one group. An empty table stays empty. Where rows
    share that id, it is the row of the smallest fingerprint and then of the smallest text; rows
    of one id in different groups stay, one a group.
    """
    found = members(docs).where("doc_id is not null")
    first = F.col("doc_id") == F.col("component_id")
    ids = checkpointed(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(first).alias("stays")).where("stays").select("doc_id", "n"))
    alone = docs.join(ids.where("n = 1"), "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where("doc_id is null"))
    repeated = ids.where("n > 1")
    if repeated.isEmpty():
        return alone
    stay = found.where(first).groupBy("label", "doc_id").agg(F.min("fp").alias("fp")).select("doc_id", "fp")
    # Only rows that share an id are fingerprinted again, to tell them apart.
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    fp, row = _unused(docs, "fp"), _unused(docs, "row")
    shared = checkpointed(docs.join(repeated, "doc_id", "left_semi"))  # else the fingerprints may move below this join
    shared = shared.withColumn(fp, fingerprint_of("text")).join(stay.withColumnRenamed("fp", fp), ["doc_id", fp], "left_semi")
    chosen = shared.groupBy("doc_id", fp).agg(F.min(F.struct("text", *others)).alias(row)).select("doc_id", f"{row}.*").select(*docs.columns)
    return alone.unionByName(chosen)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages that start in an earlier document are cut out, with what is left of a cut character.

    A document of which no word is left goes; documents without repeats, empty and null ones too, stay as
    they are. Rows of a null id are left whole. Rows of one id do not remove each other's bytes.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    had = _unused(docs, "had_text")
    cut = suffix_dedup(docs.withColumn(had, F.col("text").isNotNull()), texts=True, carry=(*others, had))
    changed = F.col("n_removed") > 0
    text = F.when(F.col(f"carry_{had}"), F.col("kept"))
    out = cut.where(~changed | F.col("kept").rlike(r"[^\x20\x09-\x0D]")).select(
        "doc_id", text.alias("text"), *[(F.when(changed, F.length("kept").cast("long")).otherwise(F.col("carry_n_chars")) if c == "n_chars" else F.col(f"carry_{c}")).alias(c) for c in others]
    )
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it. Rows without id are left out of the mix and stay.

    Documents without a word weigh nothing and come as often as every one of their source does for certain.
    An empty table stays empty. Where rows share an id, each is taken as often as the mix
    takes its size; of rows of one id and size, which of them is drawn does not matter to the mix.
    """
    with_id, without_id = docs.where("doc_id is not null"), docs.where("doc_id is null")
    key, size, times, turn, number, kind = (_unused(docs, c) for c in ("mixed_id", "size", "copies", "turn", "copy", "mixed_source"))
    mixed = checkpointed(mix(with_id).select(F.col("doc_id").alias(key), F.col("size").alias(size), F.col("copies").alias(times), F.col("source").alias(kind)))
    repeated = checkpointed(mixed.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key))
    document = F.col("doc_id") == F.col(key)

    def taken(rows: DataFrame) -> DataFrame:
        return rows.where(F.col(times) > 0).withColumn(number, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)

    if repeated.isEmpty():
        return taken(with_id.join(mixed.where(F.col(times) > 0), document)).unionByName(without_id)
    alone = taken(with_id.join(mixed.join(repeated, key, "left_anti"), document))
    # Rows that share an id, a size and a source are numbered on both sides; a marker keeps null sources equal.
    marked = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    rows = with_id.join(repeated, document, "left_semi").withColumns({size: word_count(F.col("text")), kind: marked("source"), key: F.col("doc_id")})
    several = mixed.join(repeated, key, "left_semi").withColumn(kind, marked(kind))
    turns = lambda order: F.row_number().over(Window.partitionBy(key, size, kind).orderBy(order))
    each = rows.withColumn(turn, turns("text")).join(several.withColumn(turn, turns(times)), [key, size, kind, turn])
    return alone.unionByName(taken(each)).unionByName(without_id)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of a document, with its sequence and place there. Null and empty texts are a piece of one end token."""
    return best_fit_pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", remove_toxic),
    ("simhash_near_dedup", remove_near_duplicates),
    ("suffix_array_dedup", remove_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Classifiers, fingerprints, draws and tokens are not for SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus. What a stage wrote is deleted once the next one is written; the last one's input stays, as the result reads it."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            _delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
