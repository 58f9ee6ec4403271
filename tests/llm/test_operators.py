"""The operators against plain versions on small fixtures with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillsift.llm import components, gated_lm, impact_search, lm_scoring, mixing, packing, quality_classifier, quality_rules, simhash, suffix_dedup, suffix_sort, token_counts, toxicity
from quillsift.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, block int"


def texts(n=60, seed=3):
    rnd = random.Random(seed)
    vocabulary = ["the", "of", "And", "river", "straße", "état", "mañana", "tree.", "x|y", "#tag", "42", "ＡＢ", "don't"] + ["".join(rnd.choices("abcdefgh", k=rnd.randint(2, 9))) for _ in range(200)]
    passage = " ".join(rnd.choices(vocabulary, k=40))
    out = []
    for i in range(n):
        t = " ".join(rnd.choices(vocabulary, k=rnd.choice([1, 5, 30, 80, 300])))
        out.append(t + "\n" + passage + "\n" + t[:20] if i % 5 == 0 else t)
    near = out[10].split()
    for k in range(4):
        near[k * 3] = "changed"
        out.append(" ".join(near))
    return [*out, out[3], out[3], None, "", " \t\n", "a" * 3000, "é" * 120, "é" * 119 + "e", "rep eat " * 200, "\n".join(["same line here"] * 9), "😀 " * 60]


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, ["en", "de", None][i % 3], ["a", "b", None, "ü"][i % 4] if i % 7 else "a", None, 0.5, 7) for i, t in enumerate(texts())]
    return [*out, out[5], (None, "no id at all, " * 8, "en", "a", 1, 0.1, 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def table(df):
    return [r.asDict() for r in df.collect()]


# --- toxicity -------------------------------------------------------------------------------------------------------


def sentence(rnd, extra=()):
    words = [*rnd.choices(["we", "saw", "some", "green", "houses", "near", "a", "lake", "today", "again"], k=12), *extra]
    rnd.shuffle(words)
    return " ".join(words)


def test_toxicity_learns_and_counterfactuals_hold_group_mentions():
    rnd = random.Random(1)
    data = [(sentence(rnd, ["vilewort", "muslim"] if i % 3 else ["vilewort"]), 1) if i % 2 else (sentence(rnd, ["christian"] if i % 3 else ()), 0) for i in range(400)]
    words = [toxicity.tokens(t) for t, _ in data]
    own = [toxicity.features(w).tobytes() for w in words]
    twins = [(i, toxicity.features(c).tobytes()) for i, w in enumerate(words) if (c := toxicity.counterfactual(w))]
    labels = np.array([y for _, y in data], float)
    held = toxicity.fit_rows(own, twins, labels, consistency=5.0, deviation=3.0)
    free = toxicity.fit_rows(own, [], labels, deviation=3.0)
    mention = "we saw a muslim near the lake"
    assert held.score("a vilewort again") > 0.5 > held.score("a lake again")
    assert abs(held.raw(toxicity.tokens(mention)) - held.raw(toxicity.tokens(mention.replace("muslim", "jewish")))) < abs(free.raw(toxicity.tokens(mention)) - free.raw(toxicity.tokens(mention.replace("muslim", "jewish"))))
    assert toxicity.counterfactual([b"plain"]) is None


def test_counterfactuals_hold_group_mentions_with_the_defaults_of_the_query():
    rnd = random.Random(1)
    data = [(sentence(rnd, ["vilewort", "muslim"] if i % 3 else ["vilewort"]), 1) if i % 2 else (sentence(rnd, ["christian"] if i % 3 else ()), 0) for i in range(2000)]
    words = [toxicity.tokens(t) for t, _ in data]
    own = [toxicity.features(w).tobytes() for w in words]
    twins = [(i, toxicity.features(c).tobytes()) for i, w in enumerate(words) if (c := toxicity.counterfactual(w))]
    labels = np.array([y for _, y in data], float)
    held, free = toxicity.fit_rows(own, twins, labels), toxicity.fit_rows(own, [], labels)
    gap = lambda m: abs(m.raw([b"a", b"muslim", b"here"]) - m.raw([b"a", b"jewish", b"here"]))
    assert gap(held) < gap(free) and held.score("a vilewort again") > 0.5


def test_toxicity_query(spark, docs, rows, empty):
    labels = spark.createDataFrame([(i, 0, int(i % 5 == 1)) for i in range(60)] + [(None, 1, 1), (3, None, None), (7, 0, 0)], "doc_id long, quality int, toxic int")
    got = table(toxicity.toxicity(docs, labels))
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert toxicity.toxicity(empty, labels).count() == 0
    assert {r["predicted"] for r in table(toxicity.toxicity(docs, labels.limit(0)))} == {0}
    model = toxicity.fit(docs, labels)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in got)


# --- quality rules --------------------------------------------------------------------------------------------------


def plain_base(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def test_quality_rules(docs, rows, empty):
    got = table(quality_rules.quality_rules(docs))
    assert len(got) == len(rows)
    by_id = {i: t for i, t, *_ in rows}
    for r in got:
        base = plain_base(by_id[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base
        assert r["base_failed"] == (base[0] < 20 or 100 * base[4] > 30 * base[0]) and not (r["base_failed"] and r["kept"])
    assert any(r["kept"] for r in got) and quality_rules.quality_rules(empty).count() == 0


def test_adaptive_cutoffs_follow_the_group(spark):
    prose = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}rest" for i in range(100)]
    # In one group 20 of 3000 texts have 4 % of symbols and the rest none, in the other every text has 7 %.
    texts = [("clean", " ".join(["#" * 24, *prose] if i < 20 else prose)) for i in range(3000)] + [("signs", " ".join(["#" * 46, *prose])) for _ in range(500)]
    df = spark.createDataFrame([(i, t, "en", s) for i, (s, t) in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = quality_rules.quality_rules(df).collect()
    assert {r["doc_id"] for r in got if r["kept"]} == set(range(20, 3500))
    cuts = {texts[r["doc_id"]][0]: r["symbol_permille_cut"] for r in got}
    assert cuts["clean"] == 0 and 70 <= cuts["signs"] <= 100  # no constant serves both groups
    # The groups' own sketches decide: in one table of one group the rare signs set no cutoff of their own.
    assert quality_rules.quality_rules(df.limit(0)).count() == 0


def test_sketches_merge_and_bound_the_error(spark):
    values = [int(random.Random(2).paretovariate(0.5) * 10) % 10**9 for _ in range(3)] + list(range(3000))
    df = spark.createDataFrame([(v,) for v in values], "v long").withColumn("b", quality_rules.bucket(F.col("v")))
    for r in df.collect():
        assert r["b"] <= r["v"] <= r["b"] * (1 + 1 / 32)


# --- SimHash --------------------------------------------------------------------------------------------------------


def plain_components(fps):
    """Smallest id of each fingerprint's component, all pairs compared."""
    kinds = sorted(set(fps.values()))
    parent = {k: k for k in kinds}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(kinds):
        for b in kinds[i + 1 :]:
            if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3:
                parent[root(a)] = root(b)
    least = {}
    for i, f in fps.items():
        least[root(f)] = min(i, least.get(root(f), i))
    return {i: least[root(f)] for i, f in fps.items()}


def plain_fingerprint(text):
    import xxhash

    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64)) if hashes else 0


def test_near_duplicates(docs, rows, empty):
    got = table(simhash.near_duplicates(docs))
    fps = {i: plain_fingerprint(t) for i, t, *_ in rows if i is not None}
    want = plain_components(fps)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert (int(r["fingerprint"], 16), r["component_id"]) == (fps[r["doc_id"]], want[r["doc_id"]])
    assert simhash.near_duplicates(empty).count() == 0


def near_texts(seed):
    """Two texts whose fingerprints differ in 1 to 3 bits."""
    rnd = random.Random(seed)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(400)]
    a = " ".join(words)
    near = (" ".join([*words, f"x{k}"]) for k in range(1000))
    return a, next(b for b in near if 1 <= (plain_fingerprint(a) ^ plain_fingerprint(b)).bit_count() <= 3)


def test_components_keep_ids_beside_rows_without_and_below_zero(spark):
    (a, b), (c, d), (e, f) = near_texts(1), near_texts(2), near_texts(3)
    data = [(7, a), (9, a), (None, b), (-5, c), (3, d), (None, e), (None, f)]
    got = simhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=key) == sorted([(7, 7), (9, 7), (None, 7), (-5, -5), (3, -5), (None, None), (None, None)], key=key)


def test_pipeline_keeps_a_row_of_every_group(spark):
    import corpus_pipeline

    (a, b), (c, d), (e, _) = near_texts(1), near_texts(2), near_texts(3)
    data = [(7, a, 1), (9, a, 1), (None, b, 1), (-5, c, 1), (3, d, 1), (20, e, 1), (20, "quite another text", 1), (30, "a text twice", 1), (30, "a text twice", 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, n_chars long")
    got = corpus_pipeline.remove_near_duplicates(spark, df, "")
    assert got.columns == df.columns
    want = [(7, a), (None, b), (-5, c), (20, e), (20, "quite another text"), (30, "a text twice")]
    assert sorted((str(r["doc_id"]), r["text"]) for r in got.collect()) == sorted((str(i), t) for i, t in want)


def test_bit_sliced_comparison_in_chunks(spark, monkeypatch):
    rnd = random.Random(4)
    centre = rnd.getrandbits(63)
    fps = list({centre ^ sum(1 << b for b in rnd.sample(range(63), rnd.randint(0, 4))) for _ in range(300)} | {rnd.getrandbits(63) for _ in range(200)})
    monkeypatch.setattr(simhash, "CHUNK", 16)
    nodes = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, node long")
    labels = {r["node"]: r["label"] for r in connected_components(simhash.links(nodes)).collect()}
    want = plain_components(dict(enumerate(fps)))
    assert all(labels.get(i, i) == want[i] for i in want)


def test_components_write_few_files(spark, monkeypatch):
    """As many files a round as its rows need, also where the engine does not join small partitions."""
    written, plain = [], components.checkpointed

    def counted(df):
        out = plain(df)
        written.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(components, "checkpointed", counted)
    monkeypatch.setattr(components, "FILE_ROWS", 30, raising=False)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        chain = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(102, 101)], "u long, v long")
        got = {r["node"]: r["label"] for r in components.connected_components(chain).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {i: 0 for i in range(41)} | {101: 101, 102: 101}
    assert len(written) > 5 and max(written[1:]) <= 3


def test_components(spark):
    rnd = random.Random(9)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 99) for i in range(1, 30)] + [(rnd.randint(200, 400), rnd.randint(200, 400)) for _ in range(150)] + [(7, 7), (None, 3), (500, 500)]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for u, v in pairs:
        if u is not None and v is not None:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent}


# --- top-k ----------------------------------------------------------------------------------------------------------


def test_top_k(spark, monkeypatch):
    rnd = np.random.default_rng(5)
    vectors = [(int(i), [float(x) for x in rnd.normal(size=8).round(2)]) for i in range(330)] + [(400, None), (401, [1.0, None] + [0.0] * 6), (402, [float("nan")] * 8), (403, [0.5, 0.5]), (500, [1.0] * 8), (501, [1.0] * 8), (502, []), (500, [0.25] * 8), (None, [1.0] * 8), (600, [1e18] * 8)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    monkeypatch.setattr(impact_search, "CANDIDATE_BLOCK", 100)
    monkeypatch.setattr(impact_search, "QUERY_BLOCK", 2)
    got = {}
    for r in impact_search.top_k(df).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["vec_id"])
    ready = [(i, [math.floor(1024 * x) for x in v] + [0] * (8 - len(v))) for i, v in vectors if i is not None and v is not None and all(x is not None and not math.isnan(x) for x in v)]
    questions = {}
    for i, v in ready:
        if i % 100 == 0:
            questions[i] = min(v, questions.get(i, v))
    top = 2**63 - 1
    for i, q in questions.items():
        scores = sorted((-min(top, max(-top - 1, sum(a * b for a, b in zip(q, v, strict=True)))), j) for j, v in ready if j != i)[:10]
        assert [got[i][k + 1] for k in range(10)] == [(-s, j) for s, j in scores]
    assert set(got) == set(questions)
    assert impact_search.top_k(df.limit(0)).count() == 0


# --- language model -------------------------------------------------------------------------------------------------


def test_model_is_a_distribution_and_learns():
    counts = np.sort(np.random.default_rng(0).integers(1, 90, 100))[::-1].astype(float)
    model = gated_lm.GatedLM.unigram(counts, 30.0)
    h = np.random.default_rng(1).standard_normal((1, gated_lm.WIDTH)).astype(np.float32)
    model.class_w += 0.1
    ids = np.r_[np.arange(100), gated_lm.OTHER]
    assert abs(np.exp(model.log_probabilities(np.repeat(h, 101, 0), ids)).sum() - 1) < 1e-4
    data = [np.tile(np.arange(6), 30) for _ in range(40)]
    model = gated_lm.GatedLM.unigram(counts, 30.0)
    before = gated_lm.log10_probabilities(model, data).sum()
    trainer = gated_lm.Trainer(model, rate=0.02)
    for _ in range(4):
        trainer.train(data)
    assert gated_lm.log10_probabilities(model, data).sum() > before * 0.6
    assert np.allclose(gated_lm.log10_probabilities(gated_lm.GatedLM.from_bytes(model.to_bytes()), data), gated_lm.log10_probabilities(model, data))
    mixed = [data[0][:n] for n in (1, 70, 0, 180)]
    alone = [gated_lm.log10_probabilities(model, [t])[0] for t in mixed]
    assert np.allclose(gated_lm.log10_probabilities(model, mixed), alone, rtol=1e-4)


def test_training_reads_each_word_once_and_windows_do_not_change_scores(monkeypatch):
    monkeypatch.setattr(gated_lm, "SECTION", 50)
    rnd = np.random.default_rng(6)
    data = [rnd.integers(0, 200, n) for n in (1, 400, 0, 49, 50, 51, 33, 7)]
    model = gated_lm.GatedLM.unigram(np.ones(200), 5.0)
    trainer, fed = gated_lm.Trainer(model, steps=16, texts=3), []
    window = trainer.window

    def spy(ids, valid, h):
        fed.extend(ids[valid].tolist())
        return window(ids, valid, h)

    trainer.window = spy
    assert trainer.train(iter(data)) == 591
    assert sorted(fed) == sorted(np.concatenate(data).tolist())
    assert np.allclose(gated_lm.log10_probabilities(model, data, together=2, words=10), gated_lm.log10_probabilities(model, data), rtol=1e-4)
    assert gated_lm.Trainer(model).train([]) == 0


def test_scores_match_a_plain_walk_over_the_words():
    rnd = np.random.default_rng(8)
    model = gated_lm.GatedLM.unigram(rnd.integers(1, 90, gated_lm.OWN_WORDS) + 0.1, 700.0)
    for a in model.arrays():
        a += rnd.standard_normal(a.shape).astype(np.float32) * 0.2
    w = gated_lm.WIDTH
    data = [rnd.integers(0, gated_lm.OWN_WORDS + 1, n) for n in (300, 1, 0, 65, 64)]

    def plain(text):
        h, total = np.zeros(w), 0.0
        for word in text:
            c = min(word // gated_lm.PER_CLASS, gated_lm.CLASSES)
            over = np.exp(h @ model.class_w + model.class_b)
            total += math.log10(over[c] / over.sum())
            if word != gated_lm.OTHER:
                within = np.exp(h @ model.word_w[c] + model.word_b[c])
                total += math.log10(within[word % gated_lm.PER_CLASS] / within.sum())
            x, u = model.x[word], h @ model.u
            z, r = (1 / (1 + np.exp(-(x[k : k + w] + u[k : k + w]))) for k in (0, w))
            h = (1 - z) * np.tanh(x[2 * w :] + r * u[2 * w :]) + z * h
        return total

    assert np.allclose(gated_lm.log10_probabilities(model, data), [plain(t) for t in data], rtol=1e-4)


def test_gradients_match_differences():
    rnd = np.random.default_rng(3)
    model = gated_lm.GatedLM.unigram(np.ones(200), 5.0)
    for a in model.arrays():
        a += rnd.standard_normal(a.shape).astype(np.float32) * 0.1 * (np.abs(a) < 1e6)
    ids, valid = gated_lm.padded([rnd.integers(0, 200, 7), rnd.integers(0, 200, 4)])
    trainer = gated_lm.Trainer(model)
    seen = []
    trainer._apply = seen.append
    trainer.window(ids, valid, np.zeros((2, gated_lm.WIDTH), np.float32))

    def loss():
        before, _ = model.states(ids, np.zeros((2, gated_lm.WIDTH), np.float32))
        at = np.flatnonzero(valid.ravel())
        return -model.log_probabilities(before.reshape(-1, gated_lm.WIDTH)[at].astype(np.float64), ids.ravel()[at]).mean()

    for array, gradient in zip(model.arrays(), seen[0], strict=True):
        at = np.unravel_index(np.argmax(np.abs(gradient)), gradient.shape)
        old, step = array[at], np.float32(1e-2)
        array[at] = old + step
        up = loss()
        array[at] = old - step
        down = loss()
        array[at] = old
        assert abs((up - down) / (2 * step) - gradient[at]) < 2e-3 + 0.05 * abs(gradient[at])


def test_lm_bounds_the_softmax_of_a_model_at_once(monkeypatch):
    """One look at all classes says that exp is safe, not one for every group of classes and every window."""
    looks, plain = [], gated_lm._tame
    monkeypatch.setattr(gated_lm, "_tame", lambda w, b: looks.append(w.shape) or plain(w, b))
    model = gated_lm.GatedLM.unigram(1e6 / np.arange(1, gated_lm.OWN_WORDS + 1), 4e6)
    ids = np.repeat(np.arange(0, gated_lm.OWN_WORDS, 64), np.arange(gated_lm.CLASSES) + 1)
    h = np.random.default_rng(4).uniform(-1, 1, (len(ids), gated_lm.WIDTH)).astype(np.float32)
    assert np.isfinite(model.log_probabilities(h, ids)).all()
    assert len(looks) == 2


@pytest.mark.parametrize("head", [150_000, 40])
def test_lm_scores(docs, rows, empty, monkeypatch, head):
    monkeypatch.setattr(lm_scoring, "HEAD_WORDS", head)
    got = table(lm_scoring.lm_scores(docs))
    tokens = [(i, WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + [None]) for i, t, *_ in rows]
    counts = Counter(w for i, ws in tokens if i is not None and zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted((-1 if i is None else i, len(ws), sum(counts[w] > 0 for w in ws), round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 4)) for i, ws in tokens)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n} and all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    if head == 40:
        assert lm_scoring.lm_scores(empty).count() == 0


def test_every_training_text_is_learned_from(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "START_TEXTS", 1)
    rnd = random.Random(4)
    starts = [rnd.randrange(12) for _ in range(20_000)]
    df = spark.createDataFrame([(i, " ".join(f"w{(s + k) % 12}" for k in range(60))) for i, s in enumerate(starts)], "doc_id long, text string")
    parts = [{r["doc_id"] for r in lm_scoring._round(df, k, lm_scoring.ROUNDS).collect()} for k in range(lm_scoring.ROUNDS)]
    assert sorted(i for p in parts for i in p) == list(range(20_000))
    got = lm_scoring.lm_scores(df).where("held_out").agg(F.sum("score").alias("score"), F.sum("base_score").alias("base")).first()
    assert got["score"] > 0.8 * got["base"]  # the order of the words tells the next one; counts alone don't


# --- token counts ---------------------------------------------------------------------------------------------------


def test_token_counts(docs, rows, empty, monkeypatch):
    scores = token_counts.piece_scores(token_counts.default_pieces())
    longest = max(map(len, scores))

    def plain(word):
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            size = len(word[end - 1].encode())
            options = [(best[-1][0] + token_counts.BYTE_SCORE * size, best[-1][1] - size)]
            options += [(best[b][0] + scores[word[b:end]], best[b][1] - 1) for b in range(max(0, end - longest), end) if word[b:end] in scores]
            best.append(max(options))
        return -best[-1][1]

    got = table(token_counts.token_counts(docs))
    want = {i: (len(WORD.findall(t or "")), sum(plain("▁" + w) for w in WORD.findall(t or ""))) for i, t, *_ in rows}
    assert len(got) == len(rows) and all((r["n_words"], r["n_tokens"]) == want[r["doc_id"]] for r in got)
    assert token_counts.token_counts(empty).count() == 0


# --- mixing ---------------------------------------------------------------------------------------------------------


def plain_targets(sizes):
    """Share by weight, cap at three times, reshare the excess until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in over}


@pytest.mark.parametrize("block", [512, 4])
def test_mixing(spark, docs, rows, empty, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK", block)
    small = spark.createDataFrame([(1000 + i, "w " * 3, None, s, None, 0.0, 0) for i, s in enumerate(["tiny", "tiny2", "zero"])] + [(2000, "", None, "zero2", None, 0.0, 0)], SCHEMA)
    got = table(mixing.mix(docs.unionByName(small)))
    everything = [*rows, *[tuple(r) for r in small.collect()]]
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"]) for r in got) == sorted((-1 if i is None else i, len(WORD.findall(t or ""))) for i, t, *_ in everything)
    sizes = Counter()
    for _, t, _, s, *_ in everything:
        sizes[s] += len(WORD.findall(t or ""))
    want = plain_targets(sizes)
    source = {i: s for i, _, _, s, *_ in everything}
    taken, largest = Counter(), Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6
        assert r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 3
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    assert all(abs(taken[s] - want[s]) <= largest[s] + 1e-6 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, table(mixing.mix(docs.unionByName(small).repartition(2)))))
    assert mixing.mix(empty).count() == 0


# --- packing --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("capacity", [4096, 50])
def test_packing(docs, rows, empty, capacity):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    got = pd.DataFrame(table(packing.best_fit_pack(docs, capacity=capacity)))
    want = []
    for i, t, *_ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(-1 if i is None else i, k, k * capacity, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for k, p in enumerate(ids[a : a + capacity] for a in range(0, len(ids), capacity))]
    assert sorted(zip(got["doc_id"].fillna(-1).astype(int), got["piece"], got["start"], got["length"], got["ids_crc32"], strict=True)) == sorted(want)
    for _, x in got.sort_values("offset").groupby("sequence_id"):
        assert x["length"].sum() <= capacity and x["offset"].tolist() == np.r_[0, np.cumsum(x["length"])[:-1]].tolist()
    assert got["sequence_id"].nunique() <= math.ceil(got["length"].sum() / capacity) * 1.05 + 1
    assert packing.best_fit_pack(empty).count() == 0


def can_pack(lengths, capacity, bins):
    """Whether ``bins`` bins suffice, by trying everything."""
    load = [0] * bins

    def place(i):
        if i == len(lengths):
            return True
        seen = set()
        for b in range(bins):
            if load[b] + lengths[i] <= capacity and load[b] not in seen:
                seen.add(load[b])
                load[b] += lengths[i]
                if place(i + 1):
                    return True
                load[b] -= lengths[i]
        return False

    return place(0)


def test_local_search_saves_bins_that_best_fit_wastes():
    rnd = random.Random(1)
    wasted = saved = 0
    for _ in range(400):
        lengths = np.array(sorted((rnd.randint(10, 60) for _ in range(rnd.randint(6, 13))), reverse=True))
        bins = packing.best_fit(lengths, 100)
        fewest = -(-int(lengths.sum()) // 100)
        if len(bins) > fewest and can_pack(lengths.tolist(), 100, len(bins) - 1):
            found = packing.pack(lengths, 100)
            assert sorted(i for b in found for i in b) == list(range(len(lengths))) and all(lengths[b].sum() <= 100 for b in found)
            wasted, saved = wasted + 1, saved + (len(found) < len(bins))
    assert wasted >= 10 and saved >= 0.9 * wasted


def test_local_search_steps_raise_squared_fill():
    lengths = np.sort(np.random.default_rng(4).integers(900, 2500, 200))[::-1].copy()
    bins = packing.best_fit(lengths, 4096)
    state = packing.Swaps(bins, lengths, 4096)
    before = state.fill.copy()
    while (step := next((x for a in np.argsort(state.fill) if 0 < state.fill[a] < 4096 and (x := state.best_step(int(a)))), None)) and state.used() > state.least:
        gain, leave, come, b = step
        a = int(state.of[leave[0]])
        assert len(leave) in (1, 2) and 0 < gain <= 4096 - state.fill[b]
        state.of[leave] = b
        if come >= 0:
            state.of[come] = a
        state.fill[b] += gain
        state.fill[a] -= gain
        state._refresh()
        assert (state.fill**2).sum() > (before**2).sum() and (np.bincount(state.of, weights=lengths, minlength=len(bins)) == state.fill).all()
        before = state.fill.copy()
    assert len(packing.pack(lengths)) < len(bins)
    rnd = np.random.default_rng(8)
    lengths = np.sort(rnd.integers(1, 100, 500))[::-1]
    packed = packing.pack(lengths, 100)
    assert sorted(i for b in packed for i in b) == list(range(500)) and len(packed) <= len(packing.best_fit(lengths, 100))


# --- suffixes -------------------------------------------------------------------------------------------------------


def test_deep_shallow_order():
    rnd = np.random.default_rng(6)
    for alphabet, n in ((2, 400), (256, 300), (1, 50)):
        m = rnd.integers(0, alphabet, (n, 45)).astype(np.uint8)
        m[n // 2 :, :33] = m[0, :33]
        m[-5:] = m[0]
        order = suffix_sort.deep_shallow_order(m, 24)
        ranked = [m[i].tobytes() for i in order]
        assert ranked == sorted(ranked) and sorted(order) == list(range(n))
        names = suffix_sort.prefix_names(m, [0, 7, 30, 45])
        for depth, name in names.items():
            kinds = {}
            assert all(kinds.setdefault(int(k), m[i, :depth].tobytes()) == m[i, :depth].tobytes() for i, k in enumerate(name)) and len(kinds) == len({r[:depth].tobytes() for r in m})
    assert suffix_sort.blind_trie_order([]) == [] and suffix_sort.blind_trie_order([b"b", b"a", b"b"]) == [1, 0, 2]


def plain_removal(documents):
    """(n_bytes, n_removed, n_spans, sha256) by a set of all strings of smaller ids."""
    seen, waiting, last, out = set(), set(), None, []
    for i, t in sorted((x for x in documents if x[0] is not None), key=lambda x: x[0]):
        if i != last:
            seen |= waiting
            waiting, last = set(), i
        b = (t or "").encode()
        cover = bytearray(len(b))
        for k in range(len(b) - 49):
            if b[k : k + 50] in seen:
                cover[k : k + 50] = b"\1" * 50
            waiting.add(b[k : k + 50])
        kept = bytes(c for c, x in zip(b, cover, strict=True) if not x)
        spans = sum(cover[k] and not (k and cover[k - 1]) for k in range(len(b)))
        out.append((i, len(b), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_sorting_decides_what_repeats():
    rnd = random.Random(3)
    gram = b"twenty bytes, always"
    for trial in range(20):
        kinds = [(bytes(rnd.choices(b"ab", k=30)), bytes(rnd.choices(b"ab", k=30))) for _ in range(4)]
        head, text, strings = np.zeros(60, suffix_dedup.HEAD), b"", []
        for i in range(60):
            left, right = rnd.choice(kinds)
            left = bytes(rnd.choices(b"ab", k=30 - (cut := rnd.choice([5, 29, 30])))) + left[30 - cut :]  # a common end
            first = rnd.randint(0, 30)
            last = rnd.randint(0, first)
            head[i] = (rnd.randint(0, 25), i, first, last)
            text += left[30 - first :] + gram + right[: 30 - last]
            strings.append({k: left[30 - k :] + gram + right[: 30 - k] for k in range(last, first + 1)})
        got = suffix_dedup.repeated_strings(head, np.frombuffer(text, np.uint8))
        for i in range(60):
            want = sum(1 << k for k, x in strings[i].items() if any(head["id"][j] < head["id"][i] and strings[j].get(k) == x for j in range(60)))
            assert got[i] == want, (trial, i)


@pytest.mark.parametrize("size", [16 << 20, 3000])
def test_suffix_dedup(docs, rows, empty, monkeypatch, size):
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", size)
    got = table(suffix_dedup.suffix_dedup(docs))
    want = plain_removal([(i, t) for i, t, *_ in rows])
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got if r["doc_id"] is not None) == want
    assert len(got) == len(rows) and sum(n for _, _, n, _, _ in want) > 2000
    if size == 3000:
        kept = table(suffix_dedup.suffix_dedup(docs, texts=True))
        assert all(r["kept"] is not None and sum(r["spans"][1::2]) - sum(r["spans"][::2]) == r["n_removed"] for r in kept)
        assert suffix_dedup.suffix_dedup(empty).count() == 0


# --- quality classifier ---------------------------------------------------------------------------------------------


def test_quality_classifier(spark, docs, rows, empty):
    rnd = random.Random(2)
    good = [sentence(rnd) for _ in range(150)]
    bad = [sentence(rnd).upper().replace(" ", "!! ") for _ in range(80)]
    own = [quality_classifier.features(t).tobytes() for t in good + bad]
    y = np.array([1.0] * 150 + [0.0] * 80)
    model = quality_classifier.fit_rows(own, y)
    assert np.mean([model.score(sentence(rnd)) > 0.5 for _ in range(50)]) > 0.95 and np.mean([model.score(sentence(rnd).upper().replace(" ", "!! ")) < 0.5 for _ in range(50)]) > 0.95
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(60)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    got = table(quality_classifier.quality(docs, labels))
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert quality_classifier.quality(empty, labels).count() == 0


def test_dual_descent_reaches_the_optimum():
    rnd = np.random.default_rng(4)
    x = rnd.standard_normal((40, 5))
    y = np.where(x[:, 0] + 0.5 * x[:, 1] + 0.3 * rnd.standard_normal(40) > 0, 1.0, -1.0)
    idx, starts = np.tile(np.arange(5), 40), np.arange(0, 201, 5)
    w, b = quality_classifier.dual_descent(idx, x.ravel(), starts, y, 5, np.full(40, 1.0), rounds=400)
    value = lambda w, b: 0.5 * (w @ w + b * b) + np.maximum(0, 1 - y * (x @ w + b)).sum()
    assert all(value(w, b) <= value(w + 0.05 * rnd.standard_normal(5), b + 0.05 * rnd.standard_normal()) + 1e-3 for _ in range(200))


def test_sql_of_registered_queries():
    from quillsift.llm import queries

    assert set(queries.SQL) <= set(queries.QUERIES) and duckdb is not None
