"""Language-model scoring of whole texts: word counts of the corpus, and a gated recurrent model over them.

Counts cover every training text: counted per task, summed by word. The most frequent words (HEAD_WORDS
at most) go to every executor; the counts of all other words are joined where they are needed. The
recurrent model starts as the unigram model of these counts, is trained by the driver on a share of the
training texts, and then by the tasks on all of them: every training text comes in one of the rounds, in
the task that reads it. The tasks' models are averaged after each round, weighted by words, FAN_IN at a
time and level by level, so that no task and not the driver ever holds more models than that.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm.common import checkpointed, doc_remainder, text_bytes, tidy
from quillsift.llm.gated_lm import OTHER, OWN_WORDS, GatedLM, Trainer, log10_probabilities

FOLDS = 10
HEAD_WORDS = 150_000
SMOOTHING = 0.1
#: The end of a text; no word has white space.
END = b"\n"
#: Texts that the driver starts with, at most (in expectation); rounds that the one pass over all texts is split into.
START_TEXTS = 1500
ROUNDS = 2
#: Texts that a task trains on side by side, its rate, and models that are averaged at once.
TOGETHER, RATE, FAN_IN = 128, 0.01, 16
#: Words that a task scores at once, and those of one text more: many long texts then run side by side to their ends.
WORDS_AT_ONCE = 2_000_000


def tokens(text: str | None) -> list[bytes]:
    """Words in lower case (A-Z), then one end."""
    return [*text_bytes(text).lower().split(), END]


@tidy
def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter = Counter()
    for frame in frames:
        for text in frame["text"]:
            counts.update(tokens(text))
            if len(counts) > 500_000:
                yield pd.DataFrame({"word": list(counts.keys()), "c": list(counts.values())})
                counts.clear()
    yield pd.DataFrame({"word": list(counts.keys()), "c": np.array(list(counts.values()), np.int64)})


def word_counts(training: DataFrame) -> DataFrame:
    """(word, c) over all texts, ends included."""
    return training.select("text").mapInPandas(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """The frequent words, most frequent first, with N and V of all; rebuilt from bytes by the executors."""

    words: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int

    @property
    def denominator(self) -> float:
        return self.total + SMOOTHING * (self.distinct + 1)

    @property
    def other_mass(self) -> float:
        """Smoothed counts of all words but the LM's own, the unseen one included."""
        own = self.counts[:OWN_WORDS]
        return max(SMOOTHING, self.denominator - float(own.sum()) - SMOOTHING * len(own))

    def start_model(self) -> GatedLM:
        return GatedLM.unigram(self.counts[:OWN_WORDS] + SMOOTHING, self.other_mass)


def frequent_words(counts: DataFrame) -> Vocabulary:
    """The words above the least count that leaves HEAD_WORDS at most."""
    level = F.floor(F.log2("c") * 16)  # some hundred levels at any size
    levels = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c"), F.min("c").alias("least")).orderBy(F.desc("level")).collect()
    kept, cut = 0, None
    for row in levels:
        if kept + row["n"] > HEAD_WORDS:
            break
        kept, cut = kept + row["n"], row["least"]
    rows = counts.where(F.col("c") >= cut).collect() if cut is not None else []
    rows = sorted(((bytes(r["word"]), r["c"]) for r in rows), key=lambda r: (-r[1], r[0]))
    return Vocabulary([w for w, _ in rows], np.array([c for _, c in rows], np.int64), sum(r["c"] for r in levels), sum(r["n"] for r in levels))


MODEL_SCHEMA = "part int, words long, model binary"

_PLACES: list = [None, None, {}]


def _places(sent, most: int = HEAD_WORDS) -> dict[bytes, int]:
    """Place of each of the ``most`` most frequent words, built once a worker and stage."""
    if _PLACES[0] is not sent.value or _PLACES[1] != most:
        _PLACES[:] = [sent.value, most, {w: i for i, w in enumerate(sent.value.words[:most])}]
    return _PLACES[2]


def _own_ids(words: list[bytes], places: dict[bytes, int]) -> np.ndarray:
    return np.fromiter(map(places.get, words, repeat(OTHER)), np.int64, len(words))


def _part(rows: DataFrame, salt: str, parts: int) -> DataFrame:
    return rows.where(F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 20)) < F.lit((1 << 20) // parts))


def _round(rows: DataFrame, turn: int, rounds: int) -> DataFrame:
    """The rows of a round; each row is in one of the ``rounds``."""
    return rows.where(F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(rounds)) == turn)


def train(training: DataFrame, vocabulary: Vocabulary, sent, rounds: int = ROUNDS) -> GatedLM:
    """``training``: (doc_id, text), of which ``vocabulary`` was counted; ``sent``: its broadcast."""
    model = vocabulary.start_model()
    texts = training.count()
    if not texts:
        return model

    def ids(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = _places(sent, OWN_WORDS)
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"].array, "ids": [_own_ids(tokens(t), places).astype("<u2").tobytes() for t in frame["text"]]})

    start = _part(training, "start", max(1, -(-texts // START_TEXTS))).mapInPandas(ids, "doc_id long, ids binary").toPandas().sort_values(["doc_id", "ids"])
    Trainer(model, rate=0.01).train([np.frombuffer(b, "<u2").astype(np.int64) for b in start["ids"]])
    for turn in range(rounds):
        blob = training.sparkSession.sparkContext.broadcast(model.to_bytes())

        def local(frames: Iterator[pd.DataFrame], blob=blob) -> Iterator[pd.DataFrame]:
            places, own = _places(sent, OWN_WORDS), GatedLM.from_bytes(blob.value)
            seen = Trainer(own, rate=RATE, texts=TOGETHER).train(_own_ids(tokens(t), places) for frame in frames for t in frame["text"])
            if seen:
                yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "words": [seen], "model": [own.to_bytes()]})

        models = checkpointed(_round(training, turn, rounds).mapInPandas(local, MODEL_SCHEMA))
        while models.count() > FAN_IN:
            models = checkpointed(models.groupBy(F.floor(F.col("part") / FAN_IN).cast("int").alias("of")).applyInPandas(_average, MODEL_SCHEMA))
        rows = models.toPandas()
        if len(rows):
            model = GatedLM.from_bytes(_average((0,), rows)["model"][0])
    return model


def _average(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """The mean of some models, weighted by the words that they saw, and the words of all."""
    total, weight = None, 0
    for words, blob in sorted(zip(frame["words"], frame["model"], strict=True)):
        part = np.frombuffer(blob, "<f4").astype(np.float64) * words
        total, weight = part if total is None else total + part, weight + words
    return pd.DataFrame({"part": [int(key[0])], "words": [weight], "model": [(total / weight).astype("<f4").tobytes()]})


def lm_scores(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``documents``.

    A null text counts as empty: its end is its only token. Rows of a null id are scored, but count as not
    held out and are not learned from. Repeated rows are scored, and learned from, each by itself. Without
    training texts every token is unknown and the score is the base score. An empty table gives an empty
    result. Further columns are ignored.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    training = rows.where(doc_remainder("doc_id", FOLDS) != 0)
    counts = checkpointed(word_counts(training))
    vocabulary = frequent_words(counts)
    sent = spark.sparkContext.broadcast(vocabulary)
    model = spark.sparkContext.broadcast(train(training, vocabulary, sent).to_bytes())
    log_denominator, log_other = float(np.log10(vocabulary.denominator)), float(np.log10(vocabulary.other_mass))
    log_counts = np.log10(vocabulary.counts + SMOOTHING)

    @tidy
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places, lm = _places(sent), GatedLM.from_bytes(model.value)
        row = TaskContext.get().partitionId() << 40
        for frame in frames:
            texts, out, held = [], [], 0
            for k, (i, text) in enumerate(zip(frame["doc_id"], frame["text"], strict=True), 1):
                words = tokens(text)
                at = np.fromiter(map(places.get, words, repeat(-1)), np.int64, len(words))
                known = at[at >= 0]
                rare = [words[j] for j in np.flatnonzero(at < 0)]
                further = known[known >= OWN_WORDS]
                base = float(log_counts[known].sum()) - log_denominator * len(words)
                own = float(log_counts[further].sum()) - log_other * (len(further) + len(rare))
                texts.append(np.where((at < 0) | (at >= OWN_WORDS), OTHER, at).astype(np.uint16))
                out.append((row, i, len(words), len(known), base, own, rare))
                row, held = row + 1, held + len(words)
                if held < WORDS_AT_ONCE and k < len(frame):
                    continue
                part = pd.DataFrame(out, columns=["row", "doc_id", "n_tokens", "n_known", "base_score", "score", "rare"])
                part["doc_id"] = pd.array([None if pd.isna(i) else int(i) for i in part["doc_id"]], "Int64")
                part["score"] += log10_probabilities(lm, texts)
                yield part
                texts, out, held = [], [], 0

    head = ["doc_id", "n_tokens", "n_known", "base_score", "score"]
    scored = rows.mapInPandas(run, "row long, doc_id long, n_tokens long, n_known long, base_score double, score double, rare array<binary>")
    # One row a rare word; the first of a text also carries what is known already. A text without rare
    # words looks up a word of its own that no text can have.
    spread = scored.select("row", *head, F.posexplode_outer("rare").alias("pos", "r"))
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    nothing = F.concat(F.lit("\n\n"), F.col("row").cast("string")).cast("binary")
    looked = spread.select("row", *[F.when(first, F.col(c)).alias(c) for c in head], F.col("r").isNotNull().alias("is_rare"), F.coalesce("r", nothing).alias("rare_word")).join(
        counts, F.col("rare_word") == F.col("word"), "left"
    )
    rare_log = F.when(F.col("is_rare"), F.log10(F.coalesce(F.col("c"), F.lit(0)) + F.lit(SMOOTHING))).otherwise(0.0)
    summed = looked.groupBy("row").agg(*[F.max(c).alias(c) for c in head], F.sum(rare_log).alias("rare_log"), F.count_if(F.col("c") > 0).alias("rare_known"))
    held = F.coalesce(doc_remainder("doc_id", FOLDS) == 0, F.lit(False))
    return summed.select(
        "doc_id",
        held.alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.col("rare_known")).cast("long").alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.col("rare_log")).alias("base_score"),
        (F.col("score") + F.col("rare_log")).alias("score"),
    )
