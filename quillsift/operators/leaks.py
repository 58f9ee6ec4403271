"""Leak detection: an independent second look, by normalised text and lookups. Any row means: do not send.

``find_leaks`` is the whole detector for one text; ``leaks`` runs it over a column. The joins below are
the detectors that are equi-joins once tokens or windows are exploded; their dictionaries come from a
roster, whose size the validators bound, and so may be broadcast.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillsift.functions.batches import rowwise, textwise
from quillsift.functions.names import deletions, near, normalise, ocr_fold, reach, squeeze, utf8
from quillsift.operators.redaction import EMAIL, MID_CAPITAL, WORD, is_author_word, zone
from quillsift.operators.roster import DIGIT_LOOKALIKES, FLAGS, HEAD, Roster

LEAK = T.ArrayType(T.StructType([T.StructField("student_id", T.StringType()), T.StructField("kind", T.StringType())]))

CAPITAL_WORD = regex.compile(r"\p{Lu}[\p{L}\p{M}'’]*", FLAGS)
_LOOKS = "".join(regex.sub(r"([|!])", r"\\\1", x) for x in DIGIT_LOOKALIKES.values()) + "347"
ID_RUN = regex.compile(rf"[{_LOOKS}](?:[^\p{{L}}\p{{N}}\n]{{0,3}}[{_LOOKS}])*+", FLAGS)
_READ_AS = str.maketrans({c: d for d, cs in DIGIT_LOOKALIKES.items() for c in cs})
_READ_LETTERS_AS = str.maketrans({c: d for d, cs in DIGIT_LOOKALIKES.items() for c in cs if c not in "|!"})
_NOT_DIGITS = regex.compile(r"[^0-9]+")
SHORTEST_ID_DIGITS = 3


def _term_hits(tokens: list[str], starts: dict) -> Iterator[tuple]:
    for i, token in enumerate(tokens):
        for term, hits in starts.get(token, ()):
            if tuple(tokens[i : i + len(term)]) == term:
                yield from hits


def windows(text: str, sizes: list[int]) -> set[str]:
    """All substrings of the given lengths."""
    return {text[i : i + n] for n in sizes for i in range(len(text) - n + 1)}


def id_readings(text: str) -> Iterator[str]:
    """Digits that runs of digits and lookalikes may stand for; bars are separators or ones."""
    for run in ID_RUN.findall(unicodedata.normalize("NFKC", text)):
        if sum(c in "0123456789" for c in run) >= SHORTEST_ID_DIGITS:
            yield _NOT_DIGITS.sub("", run.translate(_READ_LETTERS_AS))
            yield _NOT_DIGITS.sub("", run.translate(_READ_AS))


def find_leaks(text: str, roster: Roster, first_names: bool = True, zones: bool | None = None, author: str | None = None) -> list[tuple[str | None, str]]:
    """Distinct (owner, kind). ``zones`` is as ``first_names`` unless given."""
    found: dict[tuple[str | None, str], None] = {}

    def add(owners, kind: str) -> None:
        found.update(((o, kind), None) for o in owners)

    tokens = normalise(text).split()
    for owner, kind in _term_hits(tokens, roster.term_starts):
        add([owner], kind)
    capitals = CAPITAL_WORD.findall(text)
    for owner, kind, is_first in _term_hits(normalise(" ".join(capitals)).split(), roster.capital_starts):
        if first_names or not is_first:
            add([owner], kind)
    for digits in id_readings(text):
        add(sorted(windows(digits, roster.id_sizes) & roster.student_ids), "studentId")

    words = [t for t in tokens if t != "dot"]
    glued = "".join(words)
    edges, at = {0}, 0
    for w in words:
        at += len(w)
        edges.add(at)
    for begin in sorted(edges):
        for size in roster.local_sizes:
            if begin + size in edges and (owners := roster.locals.get(glued[begin : begin + size])):
                add(owners, "email")
    everything = "".join(tokens)
    for head in sorted(windows(everything, [HEAD]) & roster.merged_heads.keys()):
        for run in roster.merged_heads[head]:
            if run in everything:
                add(roster.merged[run], "name")
    for word in map(squeeze, capitals):
        for size in roster.surname_sizes:
            if len(word) > size:
                for end in (word[:size], word[-size:]):
                    add(roster.long_surnames.get(end, ()), "name")
    folded = ocr_fold(" ".join(words))
    if any(d in folded for d in roster.folded_domains) or ("@" in text and EMAIL.search(text)):
        add([None], "email")

    if first_names if zones is None else zones:
        lines = text.split("\n")
        for i in sorted(zone(lines)):
            for word in WORD.findall(lines[i]):
                for name in roster.near_names(word) if word != "REDACTED" else ():
                    add(roster.owners[name], "name")
    if author in roster.authors:
        parts, _ = roster.authors[author]
        if any(is_author_word(w, parts, roster.in_bytes) for w in MID_CAPITAL.findall(text)):
            add([author], "name")
    return list(found)


def leaks(documents: DataFrame, roster: Roster, text: str = "text", author: str | None = None, out: str = "leaks", first_names: bool = True) -> DataFrame:
    """``documents`` with the array of leaks of a text column added. Null texts leak nothing."""
    sent = documents.sparkSession.sparkContext.broadcast(roster)

    def prepare():
        compiled = sent.value
        return lambda written, who: [] if written is None else [{"student_id": o, "kind": k} for o, k in find_leaks(written, compiled, first_names, author=who)]

    by: Column = F.col(author).cast("string") if author else F.lit(None).cast("string")
    return documents.withColumn(out, rowwise(LEAK, prepare)(F.col(text), by))


normalised = textwise(T.StringType(), normalise)


def token_runs(starts: dict[str, int]):
    """UDF: the distinct runs of a text's normalised tokens, joined by a space, that begin with a key of ``starts`` and have up to its value of tokens."""

    def of(text: str) -> list[str]:
        tokens = normalise(text).split()
        found = ((i, n) for i, token in enumerate(tokens) for n in range(1, starts.get(token, 0) + 1))
        return list(dict.fromkeys(" ".join(tokens[i : i + n]) for i, n in found if i + n <= len(tokens)))

    return textwise(T.ArrayType(T.StringType()), of)


def term_frame(spark: SparkSession, roster: Roster, capital: bool = False) -> DataFrame:
    """(term, student_id, kind): what a run of normalised tokens may be."""
    terms = roster.capital_terms if capital else roster.terms
    rows = sorted({(" ".join(t), hit[0], hit[1]) for t, hits in terms.items() for hit in hits})
    return spark.createDataFrame(rows, "term string, student_id string, kind string")


def term_leaks(documents: DataFrame, terms: DataFrame, text: Column, key: str = "doc_id") -> DataFrame:
    """(key, student_id, kind), distinct: token runs of a text that are terms (an equi-join on exploded runs).

    The terms are a roster's, whose size is bounded: their first tokens go with the task, so that a
    text sends the runs that begin like a term, and not a multiple of itself.
    """
    tokens = F.split("term", " ")
    starts = {r["head"]: r["longest"] for r in terms.groupBy(tokens[0].alias("head")).agg(F.max(F.size(tokens)).alias("longest")).collect()}
    exploded = documents.select(key, text.alias("t")).select(key, F.explode(token_runs(starts)("t")).alias("run"))
    return exploded.join(F.broadcast(terms), F.col("run") == F.col("term")).select(key, "student_id", "kind").distinct()


def substring_leaks(documents: DataFrame, needles: list[tuple[str, str]], hay: Column, kind: str, key: str = "doc_id") -> DataFrame:
    """(key, student_id, kind), distinct: (needle, student_id) whose needle stands anywhere in a text.

    The needles are a roster's, whose size is bounded; each is one search in the text, in generated code.
    """
    if not needles:
        return documents.select(key, F.lit(None).cast("string").alias("student_id"), F.lit(kind).alias("kind")).limit(0)
    hits = F.array_compact(F.array(*[F.when(F.contains("hay", F.lit(needle)), F.lit(owner)) for needle, owner in needles]))
    return documents.select(key, hay.alias("hay")).select(key, F.explode(F.array_distinct(hits)).alias("student_id"), F.lit(kind).alias("kind"))


def _per_text(roster: Roster, spark: SparkSession, found):
    """UDF: the distinct strings that ``found`` (text, author, roster) gives for a text."""
    sent = spark.sparkContext.broadcast(roster)

    def prepare():
        compiled = sent.value
        return lambda text, author: [] if text is None else sorted(set(found(text, author, compiled)))

    return rowwise(T.ArrayType(T.StringType()), prepare)


def glued_leaks(documents: DataFrame, roster: Roster, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, student_id): whole tokens in a row, "dot" left out, that are a local part once glued. Runs ⋈ local parts; runs that are none stay behind."""

    def runs(t: str, _author: str | None, r: Roster) -> Iterator[str]:
        tokens = [w for w in normalise(t).split() if w != "dot"]
        edges = [0]
        for w in tokens:
            edges.append(edges[-1] + len(w))
        known, glued = set(edges), "".join(tokens)
        return (run for b in edges for n in r.local_sizes if b + n in known and (run := glued[b : b + n]) in r.locals)

    spark = documents.sparkSession
    locals_ = spark.createDataFrame(sorted({(x, o) for x, owners in roster.locals.items() for o in owners}), "local string, student_id string")
    found = documents.select(key, F.explode(_per_text(roster, spark, runs)(F.col(text), F.lit(None).cast("string"))).alias("run"))
    return found.join(F.broadcast(locals_), F.col("run") == F.col("local")).select(key, "student_id").distinct()


def zone_names(documents: DataFrame, roster: Roster, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, name): folded names that words of a text's zones come near."""

    def names(t: str, _author: str | None, r: Roster) -> Iterator[str]:
        lines = t.split("\n")
        return (n for i in zone(lines) for w in WORD.findall(lines[i]) if w != "REDACTED" for n in r.near_names(w))

    return documents.select(key, F.explode(_per_text(roster, documents.sparkSession, names)(F.col(text), F.lit(None).cast("string"))).alias("name"))


def author_leaks(documents: DataFrame, roster: Roster, author: str, text: str = "text") -> DataFrame:
    """The rows of ``documents`` in which a capitalised word inside a sentence comes near its author's own name."""

    def words(t: str, a: str | None, r: Roster) -> Iterator[str]:
        return (w for w in MID_CAPITAL.findall(t) if is_author_word(w, r.authors[a][0], r.in_bytes)) if a in r.authors else iter(())

    return documents.where(F.size(_per_text(roster, documents.sparkSession, words)(F.col(text), F.col(author).cast("string"))) > 0)


#: All digits that a text's runs of digits and lookalikes may stand for, by a space.
id_hay = textwise(T.StringType(), lambda text: " ".join(id_readings(text)))


def deletion_variants(depth: int, longest: int, in_bytes: bool = False):
    """UDF: what is left of a word of ``longest`` letters (or bytes) at most after up to ``depth`` deletions."""

    def of(word: str | None) -> list[str]:
        word = utf8(word) if in_bytes and word else word
        return sorted(deletions(word, depth)) if word is not None and len(word) <= longest else []

    return rowwise(T.ArrayType(T.StringType()), lambda: of)


def name_variants(in_bytes: bool = False):
    return textwise(T.ArrayType(T.StringType()), lambda n: sorted(deletions(utf8(n) if in_bytes else n, reach(n))))


def is_near(in_bytes: bool = False):
    return rowwise(T.BooleanType(), lambda: lambda word, name: near(word, name, in_bytes))


ocr_folded = textwise(T.StringType(), ocr_fold)


def near_name_matches(words: DataFrame, names: DataFrame, in_bytes: bool = False) -> DataFrame:
    """(word, name) where the folded word is within the name's tier of edits: an equi-join on deletion variants, then a check.

    ``words``: (word), distinct, as written; ``names``: (name), folded. Longer words than the longest name
    and its two edits can't be near. ``in_bytes``: edits are counted in bytes of UTF-8.
    """
    longest = names.select(F.max(F.octet_length("name") if in_bytes else F.length("name"))).first()[0] or 0
    folded = words.select("word", ocr_folded("word").alias("folded")).where(F.length("folded") >= 2)
    left = folded.select("word", "folded", F.explode(deletion_variants(2, longest + 2, in_bytes)("folded")).alias("variant"))
    right = names.select("name", F.explode(name_variants(in_bytes)("name")).alias("variant_of"))
    met = left.join(right, F.col("variant") == F.col("variant_of")).select("word", "folded", "name").distinct()
    return met.where(is_near(in_bytes)("folded", "name")).select("word", "name")


def fuzzy_name_matches(words: DataFrame, names: DataFrame) -> DataFrame:
    """(word, name) at most one edit apart (swaps count one): an equi-join on deletion variants, then a check.

    ``words``: (word), distinct; ``names``: (name). ``near_name_matches`` has the tiers and the folding.
    """
    variants = deletion_variants(1, (names.select(F.max(F.length("name"))).first()[0] or 0) + 1)
    left = words.select("word", F.explode(variants("word")).alias("variant"))
    right = names.select("name", F.explode(variants("name")).alias("variant_of"))
    met = left.join(F.broadcast(right), F.col("variant") == F.col("variant_of")).select("word", "name").distinct()
    a, b = F.col("word"), F.col("name")
    swapped = (F.length(a) == F.length(b)) & F.exists(
        F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))),
        lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))) == b,
    )
    return met.where((F.levenshtein(a, b) <= 1) | swapped)
