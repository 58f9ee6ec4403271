"""The corpus pipeline against plain versions of its stages on a small fixture."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from quillsift.llm import packing, toxicity
from tests.llm.test_operators import WORD, plain_components, plain_fingerprint, plain_removal, plain_targets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(12)
    vocabulary = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 9))) for _ in range(600)]
    passage = " ".join(rnd.choices(vocabulary, k=30)) + " größe"
    texts = []
    for i in range(160):
        t = " ".join(rnd.choices(vocabulary, k=rnd.choice([4, 30, 120])))
        texts.append(t + " vilewort" * 2 if i % 8 == 1 else f"{t[:60]}é {passage} ü{t[60:]}" if i % 9 == 0 else t)
    texts += [texts[2], texts[2], texts[20].replace(" ", "  "), None, ""]
    rows = [(i, t, "en", ["a", "a", "b", None][i % 4], len(t or "")) for i, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 8 == 1)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def test_stages_one_by_one(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    model = toxicity.fit(docs, spark.read.parquet(f"{path}/labels.parquet"))
    got = stages["toxicity"](spark, docs, path)
    assert got.columns == COLUMNS
    clean = sorted(tuple(r) for r in got.collect())
    assert clean == sorted(r for r in rows if model.score(r[1]) < 0.5)
    assert not any("vilewort" in (t or "") for _, t, *_ in clean) and len(clean) > 130

    docs = got.persist()
    got = stages["simhash_near_dedup"](spark, docs, path)
    assert got.columns == COLUMNS
    component = plain_components({i: plain_fingerprint(t) for i, t, *_ in clean})
    single = sorted(r for r in clean if component[r[0]] == r[0])
    assert sorted(tuple(r) for r in got.collect()) == single and len(single) < len(clean)

    docs = got.persist()
    got = stages["suffix_array_dedup"](spark, docs, path)
    assert got.columns == COLUMNS
    digests = {i: (n, d) for i, _, n, _, d in plain_removal([(i, t) for i, t, *_ in single])}
    cut = sorted((tuple(r) for r in got.collect()), key=lambda r: r[0])
    old = {r[0]: r for r in single}
    assert any(n for n, _ in digests.values())
    for r in cut:
        removed, digest = digests[r[0]]
        if not removed:
            assert r == old[r[0]]
        else:
            assert r[4] == len(r[1]) and (hashlib.sha256(r[1].encode()).hexdigest() == digest or len(r[1].encode()) + removed <= len(old[r[0]][1].encode()))
    assert {r[0] for r in cut} >= {i for i, (n, _) in digests.items() if not n}

    docs = got.persist()
    got = stages["mixing"](spark, docs, path)
    assert got.columns == COLUMNS
    mixed = [tuple(r) for r in got.collect()]
    copies = Counter(r[0] for r in mixed)
    sizes, taken, largest = Counter(), Counter(), Counter()
    for i, t, _, s, _ in cut:
        n = len(WORD.findall(t or ""))
        sizes[s] += n
        taken[s] += n * copies[i]
        largest[s] = max(largest[s], n)
    want = plain_targets(sizes)
    assert max(copies.values()) <= 3 and all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    assert {r for r in mixed} <= set(cut)

    docs = got.persist()
    packed = stages["packing"](spark, docs, path).toPandas()
    tokens = packing.word_tokens(packing.default_tokenizer())
    assert Counter(zip(packed["doc_id"], packed["ids_crc32"], strict=True)) == Counter((r[0], zlib.crc32(tokens.ids(r[1]) + np.array([1], "<u4").tobytes())) for r in mixed)
    assert packed["sequence_id"].nunique() <= math.ceil(packed["length"].sum() / 4096) + 1


def test_run(spark, folder):
    got = corpus_pipeline.run(spark, folder[0]).toPandas()
    assert len(got) > 50 and (got.groupby("sequence_id")["length"].sum() <= 4096).all()
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "mixing", "packing"]


def test_stages_on_rough_tables(spark, folder):
    """Null and repeated ids, null, empty and very long texts, ties, and columns whose names the stages use themselves."""
    path, _ = folder
    schema = "doc_id long, text string, lang string, source string, n_chars long, copy int, copies string, mixed_id int, fp string, had_text string, turn int, row string, size string"
    more = (77, "own", 5, "fp", "had", 9, "row", "size")
    rnd = random.Random(5)
    long = " ".join("".join(rnd.choices("abcdefghij", k=5)) for _ in range(30_000))
    word = lambda n: " ".join("".join(rnd.choices("klmnopqr", k=6)) for _ in range(n))
    same = word(40)
    rows = [(None, word(30)), (None, None), (1, None), (2, ""), (3, long), (4, word(40)), (4, word(40)), (5, same), (5, same), (6, same), (-7, word(25)), (8, "x")]
    rows = [(i, t, None if k % 2 else "en", [None, "a"][k % 2], len(t or ""), *more) for k, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(rows, schema).coalesce(2)
    stages = dict(corpus_pipeline.STAGES)
    for name in list(stages)[:-1]:
        assert stages[name](spark, docs.limit(0), path).collect() == []
        got = stages[name](spark, docs, path)
        assert got.columns == docs.columns
        got = [tuple(r) for r in got.collect()]
        assert all(r[5:] == more for r in got)
        if name == "toxicity":
            assert Counter(got) == Counter(rows)
        elif name == "simhash_near_dedup":
            kept = Counter((r[0], r[1]) for r in got)
            assert kept[(5, same)] == 1 and (6, same) not in kept  # of a group one row of the smallest id
            assert kept[(1, None)] + kept[(2, "")] == 1 and sum(i == 4 for i, _ in kept) == 2
            assert kept[(None, rows[0][1])] == 1 and kept[(3, long)] == 1 and kept[(-7, rows[10][1])] == 1
        elif name == "suffix_array_dedup":
            left = [(r[0], r[1]) for r in got]
            assert left.count((5, same)) == 2 and not any(i == 6 for i, _ in left)  # nothing is left of the copy under a larger id
            assert {(None, rows[0][1]), (None, None), (1, None), (2, ""), (3, long)} <= set(left)
        else:
            times = Counter((r[0], r[1]) for r in got)
            assert times[(None, rows[0][1])] == 1 and times[(None, None)] == 1
            assert max(times.values()) <= 6 and set(got) <= set(rows)  # three times each of two equal rows
            words, want = Counter(), Counter()
            for r in rows:
                if r[0] is not None:
                    want[r[3]] += len(WORD.findall(r[1] or ""))
            for r in got:
                if r[0] is not None:
                    words[r[3]] += len(WORD.findall(r[1] or ""))
            target = plain_targets(want)
            largest = {s: max(len(WORD.findall(r[1] or "")) for r in rows if r[0] is not None and r[3] == s) for s in want}
            assert all(abs(words[s] - target[s]) <= largest[s] for s in want), (words, target, want)
    packed = stages["packing"](spark, docs, path)
    assert packed.where("length = 1").count() == 3 and stages["packing"](spark, docs.limit(0), path).collect() == []


def test_run_deletes_what_is_read(spark, folder):
    import pathlib

    base = pathlib.Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = set(base.glob("pipeline-*"))
    corpus_pipeline.run(spark, folder[0]).count()
    (new,) = set(base.glob("pipeline-*")) - before
    assert [p.name for p in new.iterdir()] == ["3-mixing"]
