"""Literal cases of redaction and leak detection. The roster is invented; the forms are those that occur."""

import random
import time

import pytest

from quillsift.functions.names import deletions, near, ocr_fold, within
from quillsift.operators.leaks import find_leaks
from quillsift.operators.redaction import MARK, STEPS, redact
from quillsift.operators.roster import Person, Roster
from quillsift.sources.sample_roster import sample_roster

R = sample_roster()
BODY = "The town should plant more trees along the river because shade keeps people outside."


def prose(words):
    return f"The visitors heard that {words} talked at length about the old bridge."


@pytest.mark.parametrize(
    "text",
    [
        "Tomas Keller", "KELLER, TOMAS", "Keller Tomas", "tomas.keller@northvale.edu", "ID 700200301", "700-200-301", "Mark D'Arcy", "D’Arcy", "Rose Lirn", "github: rhalvorsen2", "contact r halvorsen2 for more",
        "t. keller@northvale.edu", "rose. lim@northvale.edu", "rose lirn@northvale.edu", "Leila Farouc", "Tornas Keller", "Whitlock,Dean", "Deam Whitlock", "dean whitlook", "Mark 0'Arcy", "Mark D Arcy",
        "R. Lirn", "Rose Lin", "Leila Faruok",
    ],
)
def test_identifiers_go(text):
    out = redact(text, R)
    assert MARK in out
    for part in ("keller", "tomas", "arcy", "lirn", "lim", "halvorsen", "farou", "whitlo", "northvale", "7002003", "faruok"):
        assert part not in out.lower(), out
    assert find_leaks(out, R) == []


@pytest.mark.parametrize("text", ["ID 7OO2OO3O5", "70O-2O0-3O5", "700,200,305", "(700) 200-305", "700|200]305", "７００２００３０５", "7002003O5"])
def test_student_ids_go_however_written(text):
    assert MARK in redact(text, R)
    assert find_leaks(redact(text, R), R) == []
    assert any(kind == "studentId" for _, kind in find_leaks(text, R))


@pytest.mark.parametrize(
    "address", ["rose.lim at northvale dot edu", "rose. lim at northvale dot edu", "rose.lirn northvale.eclu", "r.lim(at)northvale(dot)edu", "roselimnorthvale.edu", "@northvale.edu", "roze.lim@n0rthvale.edu"]
)
def test_school_addresses_go_whole(address):
    out = redact(f"Contact: {address}.", R)
    assert out == f"Contact: {MARK}."
    assert find_leaks(out, R) == []


@pytest.mark.parametrize(
    "text",
    [
        "You should mark every rose on the map before the hart runs away into the forest.",
        "Scores were 90, 85, 77 and 92 in 1990, 2000 and 2010, as everybody in the room knew.",
        "The northern valley educates walkers, and funding for the education of walkers rose again.",
        "Its name: River Street Walk, a street that changed the middle of the town for good.",
    ],
)
def test_prose_stays(text):
    assert redact(text, R) == text
    assert find_leaks(text, R) == []


def test_neighbouring_words():
    assert redact(prose("Then Tomas"), R) == prose(f"Then {MARK}")
    assert redact(prose("Well, Leila"), R) == prose(f"Well, {MARK}")
    assert redact(prose("keller tomas"), R) == prose("keller tomas")
    assert find_leaks(prose("keller tomas"), R)
    assert redact(f"Tomas Keller\nWhen boats leave, {BODY}", R) == f"{MARK}\nWhen boats leave, {BODY}"
    assert redact(f"{BODY} Credit: A. B. rose Tomas Keller R.L. took it.", R) == f"{BODY} Credit: {MARK} took it."


def test_forms_zones_and_author():
    form = f"Name: Tommy Keler\nStudent ID: 7OO 2OO\nE-mail:\nt.kel\n\n{BODY}"
    assert redact(form, R) == f"Name: {MARK}\nStudent ID: {MARK}\nE-mail:\n{MARK}\n\n{BODY}"
    for header in ("Tonas Kellar\nENG 101", "Leyla Farook\nENG 101", "Rose\nLin", "Submitted by Ms. Kellar"):
        out = redact(f"{header}\n\n{BODY}", R)
        assert MARK in out and out.endswith(BODY) and find_leaks(out, R) == []
    text = "As Leyla Farook argued in class, the bridge needs fewer cars. L.F. agreed with that view."
    assert redact(text, R, "700200308") == f"As {MARK} argued in class, the bridge needs fewer cars. {MARK} agreed with that view."
    assert redact(text, R) == text
    assert ("700200308", "name") in find_leaks(text, R, author="700200308")
    assert redact(f"{BODY} As Professor Vargas (ivargas@northvale.edu) said.", R) == f"{BODY} As Professor {MARK} ({MARK}) said."


@pytest.mark.parametrize("text", ["PhotobyTomasKeller", "Thanks toLeilaFarouk", "Whitlockand friends"])
def test_what_redaction_misses_is_found(text):
    assert find_leaks(redact(text, R), R)


def test_output_guard():
    assert find_leaks("You will mark the rose with care.", R, first_names=False) == []
    assert len(find_leaks("Nice work, Whitlock.", R, first_names=False)) == 1


@pytest.mark.parametrize(
    "text", ["7OO2Z3" * 6000, "a" * 32000 + " @", "a" * 32000 + " northvale.edu", "rose " * 6000 + "Tomas Keller", "A. " * 10000 + "Tomas Keller", "a." * 10000 + " northvale.edu", MARK * 6000]
)
def test_hostile_texts_are_fast(text):
    start = time.perf_counter()
    find_leaks(redact(text, R, "700200301"), R, author="700200301")
    assert time.perf_counter() - start < 1


def test_closeness():
    assert within("jordna", "jordan", 1) and not within("ca", "abc", 2) and within("ca", "abc", 3)
    assert ocr_fold("A1varez") == "alvarez" and ocr_fold("Kirn") == "kim"
    assert near("muhammad", "mohammed") and not near("kit", "lim")
    assert deletions("abc", 2) == {"abc", "ab", "ac", "bc", "a", "b", "c"}


def test_empty_roster_is_refused():
    with pytest.raises(ValueError):
        Roster((Person("A", "B", "a@b.c"),))


def test_too_large_roster_is_refused():
    people = [Person("Ana", f"Q{chr(97 + i % 26)}{chr(97 + i // 26)}", f"s{i}@northvale.edu", str(7000000 + i)) for i in range(501)]
    with pytest.raises(ValueError):
        Roster(tuple(people))


def test_leaks_cost_the_same_with_a_large_roster():
    rnd = random.Random(6)
    word = lambda n: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=n)).capitalize()
    crowd = Roster(tuple(Person(word(rnd.randint(3, 9)), word(rnd.randint(4, 10)), f"{word(8).lower()}{i}@northvale.edu", str(8_000_000 + i)) for i in range(480)) + R.people)
    text = "\n".join(" ".join(word(rnd.randint(3, 9)) for _ in range(3)) for _ in range(300))

    def took(roster):
        start = time.perf_counter()
        find_leaks(text, roster)
        return time.perf_counter() - start

    took(R), took(crowd)  # words that were folded once are remembered
    assert took(crowd) < 4 * took(R) + 0.05
    for leak in ("Tomas Keller", "700 200 301", "Thanks toLeilaFarouk", "Whitlockand friends", "Tonas Kellar"):
        assert set(find_leaks(leak, R)) <= set(find_leaks(leak, crowd)) and find_leaks(leak, R)


def test_steps_through_spark(spark):
    from quillsift.operators.leaks import leaks
    from quillsift.operators.redaction import redacted

    rows = [(1, "Tomas Keller wrote", None), (2, None, "700200301"), (3, "", None), (4, "L.F. said so", "700200308"), (5, "a." * 10000 + " northvale.edu", None)]
    df = leaks(redacted(spark.createDataFrame(rows, "id int, text string, who string"), R, author="who"), R, author="who")
    got = {r["id"]: (r["redacted"], [tuple(x) for x in r["leaks"]]) for r in df.collect()}
    for i, text, who in rows:
        assert got[i] == (None, []) if text is None else (redact(text, R, who), find_leaks(text, R, author=who))
    assert [n for n, _ in STEPS][0] == "compatibility_forms" and STEPS[-1][0] == "collapse"


def test_joins_find_what_the_detector_finds(spark):
    from quillsift.operators import leaks as L

    long = "abcdefghij" * 6
    roster = Roster((Person("Grace", "Kirn", "gkirn@northvale.edu", "700200301"), Person(long, "Halvorsen", "h@northvale.edu", "812345602")))
    written = ["Halvorsen", "Halvrosen", "HaIvorsn", "Halvo", "Hxlvxrsen", "hxlxxrsen", "KIM", "Kiim", "Kxxm", "Grcae", "G", "çrace", long, long[:-2], long + "xy", long + "xyz", "1" * 400]
    words = spark.createDataFrame([(w,) for w in written] + [(None,)], "word string")
    names = spark.createDataFrame([(n,) for n in roster.owners], "name string")
    want = {(w, n) for w in written for n in roster.near_names(w)}
    assert {tuple(r) for r in L.near_name_matches(words, names).collect()} == want
    assert {("Hxlvxrsen", "halvorsen"), (long + "xy", long)} <= want
    one = {tuple(r) for r in L.fuzzy_name_matches(spark.createDataFrame([(long,), (long + "x",)], "word string"), names).collect()}
    assert one == {(long, long), (long + "x", long)}

    texts = ["ID 700200301", "7OO-2oo 3O1", "no. 700|200|301", "8l2 345 6O2", "8|2345602", "70020030", "", None]
    ids = [(i, i) for i in sorted(roster.student_ids)]
    found = L.substring_leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ids, L.id_hay("text"), "studentId")
    want = {(k, o, kind) for k, t in enumerate(texts) if t for o, kind in find_leaks(t, roster) if kind == "studentId"}
    assert {tuple(r) for r in found.collect()} == want and {k for k, *_ in want} == {0, 1, 2, 3, 4}


def test_term_runs_do_not_multiply_texts(spark):
    from quillsift.operators import leaks as L

    texts = ["word " * 5000 + "Rose Lim rose.lim@northvale.edu", "rose", "Lim, Rose. Keller", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    runs = dict(df.select("doc_id", L.token_runs({"rose": 2, "lim": 3})("text").alias("runs")).collect())
    assert runs[0] == ["rose", "rose lim", "lim", "lim rose", "lim rose lim", "lim northvale", "lim northvale edu"]
    assert runs[1] == ["rose"] and runs[2] == ["lim", "lim rose", "lim rose keller", "rose", "rose keller"] and runs[3] == [] and runs[4] is None
    found = {tuple(r) for r in L.term_leaks(df, L.term_frame(spark, R), df["text"]).collect()}
    assert found == {(0, "700200306", "name"), (0, "700200306", "email"), (2, "700200306", "name")}


def test_texts_are_worked_off_in_pieces(spark):
    import pyarrow as pa
    from pyspark.sql import types as T

    from quillsift.functions import batches as B

    texts = ["a" * 700_000, "b" * 700_000, None, "c" * 3_000_000, "", *["d"] * 1200]
    cut = [p[0].to_pylist() for p in B.pieces((pa.array(texts), pa.array([None] * len(texts), pa.string())))]
    assert [t for p in cut for t in p] == texts and list(B.pieces((pa.array([], pa.string()),))) == []
    assert max(map(len, cut)) <= B.PIECE_ROWS and all(len(p) == 1 or sum(len(t or "") for t in p) <= B.PIECE_BYTES for p in cut)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    sizes = B.rowwise(T.LongType(), lambda: lambda t, u: None if t is None else len(t) + len(u))
    assert [r[0] for r in df.orderBy("id").select(sizes("text", "text")).collect()] == [None if t is None else 2 * len(t) for t in texts]


#: A submission's header may be near a name in letters and not in bytes: a sharp s has two bytes (the same word stands in the texts of sf0.1).
ODD = ("ßeinä", "Leilß", "ßein", "Lßm", "LeilÄ", "日eila", "Farouß")


@pytest.fixture(scope="module")
def odd_table(tmp_path_factory):
    import duckdb

    folder = tmp_path_factory.mktemp("odd")
    texts = [f"{w}\n\n{BODY} As {w} said." for w in ODD]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, 'de')", [(16 + 48 * k + person, t) for k, t in enumerate(texts) for person in (5, 7)])
    con.execute(f"COPY documents TO '{folder}/documents.parquet' (FORMAT parquet)")
    return str(folder), con


def same_as_sql(spark, odd_table, name):
    from quillsift.plans import catalog

    folder, con = odd_table
    got, want = catalog.QUERIES[name](spark, folder), con.execute(catalog.SQL[name])
    columns = [d[0] for d in want.description]
    rows = sorted(map(str, want.fetchall()))
    assert rows and sorted(str(tuple(r)) for r in got.select(*columns).collect()) == rows


def test_near_names_count_edits_as_sql_does(spark, odd_table):
    assert near("ßeina", "leila") and not near("ßeina", "leila", in_bytes=True) and near("leilß", "leila", in_bytes=True)
    same_as_sql(spark, odd_table, "near_names")


@pytest.mark.parametrize("name", ["zone_names", "redact_zones", "author_words", "redact_author"])
def test_steps_count_edits_as_sql_does(spark, odd_table, name):
    same_as_sql(spark, odd_table, name)


def test_redaction_counts_letters():
    text = f"ßeinä\n\n{BODY}"
    assert redact(text, R).startswith(MARK) and R.near_names("ßeinä") == ("leila",) and sample_roster(in_bytes=True).near_names("ßeinä") == ()
    assert ("700200308", "name") in find_leaks(text, R)


def longest_array(udf, *columns):
    """Rows of the largest Arrow array that a UDF makes of one batch of these columns."""
    import pyarrow as pa

    arrays = tuple(pa.array(c, pa.string()) for c in columns)
    made = [len(x) for x in udf.func(iter([arrays if len(arrays) > 1 else arrays[0]]))]
    assert sum(made) == len(columns[0])
    return max(made)


def test_udfs_make_results_in_pieces(spark, monkeypatch):
    from quillsift.functions import batches as B
    from quillsift.operators import leaks as L
    from quillsift.operators import redaction

    made = []
    rowwise = B.rowwise
    for module in (redaction, L):
        monkeypatch.setattr(module, "rowwise", lambda *a: made.append(rowwise(*a)) or made[-1])
    df = spark.createDataFrame([(1, "Tomas Keller", None)], "id int, text string, who string")
    redaction.redacted(df, R, author="who"), redaction.after_step(df, R, "folded_names"), L.leaks(df, R), L.glued_leaks(df, R, key="id"), L.zone_names(df, R, key="id")
    texts = [BODY] * 1200
    assert len(made) == 5
    for udf in made:
        assert longest_array(udf, texts, [None] * len(texts)) <= B.PIECE_ROWS
    for udf in (L.id_hay, L.normalised, L.ocr_folded, L.deletion_variants(2, 9), L.token_runs({"the": 2})):
        assert longest_array(udf, texts) <= B.PIECE_ROWS
