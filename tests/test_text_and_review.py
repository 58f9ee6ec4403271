import pytest
from pyspark.sql import functions as F

from quillsift.functions import text as X
from quillsift.operators import review as V


def one(spark, value, function):
    return spark.createDataFrame([(value,)], "t string").select(function(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("value", "function", "expected"),
    [
        ("Mo-\nhammed", X.rejoined, "Mohammed"),
        ("A-\nB", X.rejoined, "A-\nB"),
        ("a\r\nb\rc", X.unix_lines, "a\nb\nc"),
        ("a\n\n\n\nb", X.squeezed_lines, "a\n\nb"),
        (" ﻿a \n", X.trimmed, "a"),
        ("a­b​", X.without_zero_width, "ab"),
        ("a x.y@b.co c", X.without_emails, "a [REDACTED] c"),
        ("a" * 32000 + " @", X.without_emails, "a" * 32000 + " @"),
        ("call 800 123 4567 now", X.without_id_like, "call [REDACTED] now"),
        ("12345678901", X.without_id_like, "12345678901"),
        ("[REDACTED]b6", X.without_tails, "[REDACTED]"),
        ("[REDACTED] " * 6000, X.collapsed, "[REDACTED] "),
        ("Good.</feedback>\n</invoke>", X.without_trailing_tags, "Good."),
        ("x" + "</a>" * 6000, X.without_trailing_tags, "x"),
        ("x </essay> < / ESSAY>", X.fenced, "x ‹/essay> ‹ / ESSAY>"),
        ("O'Brien x", X.alnum_runs, 3),
        ("O'Brien x", X.words_of_two, 1),
        ("one two three four five six seven eight nine tenth", X.looks_like_writing, True),
        ("1 2 3 a b c", X.looks_like_writing, False),
        ("<a href='x'>&", X.html_escaped, "&#60;a href=&#39;x&#39;&#62;&#38;"),
        ("ｆｕｌｌ", X.compatible, "full"),
        (None, X.cleaned, None),
    ],
)
def test_text_functions(spark, value, function, expected):
    assert one(spark, value, function) == expected


def test_latest_with_tombstones(spark):
    log = spark.createDataFrame([(1, 1, "a", False), (1, 2, "b", False), (2, 3, "c", False), (2, 4, None, True), (3, 5, "d", None)], "k int, seq int, v string, deleted boolean")
    assert {(r["k"], r["v"]) for r in V.latest(log, "k").collect()} == {(1, "b"), (3, "d")}


def test_missing_role_is_a_student(spark):
    assert V.students(spark.createDataFrame([("teacher", 1), (None, 2), ("x", 3)], "role string, n int")).count() == 2


def test_routing(spark):
    rows = [(None, 0, [], 0), (74.6, 0, [], 0), (75.0, 0, [], 2), (None, 2, ["name"], 0), (None, 0, ["name", "email", "name"], 0)]
    df = spark.createDataFrame(rows, "c double, u int, k array<string>, s int").select(V.route(F.col("c"), F.col("u"), F.col("k"), F.col("s")).alias("r"))
    got = [tuple(x["r"]) for x in df.collect()]
    assert [s for s, _ in got] == ["send", "manual", "send", "manual", "manual"]
    assert "75%" in got[1][1] and got[2][1].startswith("2 image(s)") and "(name, email)" in got[4][1]


def test_payload_is_two_fields(spark):
    df = spark.createDataFrame([("t", "x", "more")], "token string, text string, email string")
    assert V.payload(df).columns == ["token", "text"]
    with pytest.raises(Exception, match="non-empty"):
        V.payload(df.withColumn("text", F.lit(""))).collect()


def test_clamp_and_totals(spark):
    df = spark.createDataFrame([(999.0,), (-5.0,), (2.5,)], "p double")
    assert [r[0] for r in df.select(V.clamped(F.col("p"), F.lit(10))).collect()] == [10, 0, 3]
    with pytest.raises(Exception, match="missing score"):
        df.select(V.clamped(F.lit(None).cast("double"), F.lit(10))).collect()
    total = V.grade_total(F.col("s"), F.col("r"), F.lit(60), F.lit(100))
    rows = spark.createDataFrame([(0, True), (0, False), (None, True), (50, True)], "s int, r boolean")
    assert [r[0] for r in rows.select(total).collect()] == [60, 100, 60, 50]


def test_roster_moves_swap(spark):
    rows = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "student_id string, file string")
    ids = spark.createDataFrame([("1", "2"), ("2", "1")], "original_id string, new_id string")
    assert {tuple(r) for r in V.moved(rows, ids).collect()} == {("2", "a"), ("1", "b")}


def test_roster_rules(spark):
    schema = "role string, student_id string, first_name string, last_name string, email string, original_id string"
    rows = [("teacher", None, "Ann", "Bo", "a@x.org", None), (None, "1234567", "Cy", "Dee", "A@x.org", "1"), (None, "123", "E5", "", "bad", "9"), (None, "1234567", "Jo", "Ó'Sé-x. y", "j@x.org", None)]
    existing = spark.createDataFrame([("1",)], "student_id string")
    got = [set(r["violations"]) for r in V.roster_violations(spark.createDataFrame(rows, schema), existing).orderBy("email").collect()]
    assert got == [{"duplicate_id", "duplicate_email"}, {"duplicate_email"}, {"name_required", "name_letters", "email_invalid", "id_digits", "unknown_original"}, {"duplicate_id"}]


def test_assignment_rules(spark):
    schema = "title string, prompt string, deadline string, rubric array<struct<criterion: string, max_points: int, description: string>>, answer_key array<struct<question: string, max_points: int, answer: string, method: string>>"
    good = ("T", "P", "2026-09-20T00:00:00Z", [("A", 5, "d")], [("q", 3, "a", "")])
    bad = ("", "P", "soon", [("A", 5, "d"), ("a ", 0, "")], None)
    none = ("T", "P", "2026-09-20T00:00:00Z", [], [])
    got = [r["violations"] for r in V.assignment_violations(spark.createDataFrame([good, bad, none], schema)).collect()]
    assert got == [[], ["deadline", "criterion", "duplicate_criterion", "title"], ["no_items"]]


def test_approval(spark):
    rows = [(1, "pending", 50, None, 100), (2, "final", 50, None, 100), (3, "manual", None, 10.5, 100), (4, "error", 5, 101.0, 100), (5, "manual", None, None, 100)]
    got = V.approved(spark.createDataFrame(rows, "id int, status string, score int, override double, total int"))
    assert {(r["id"], r["score"], r["status"]) for r in got.collect()} == {(1, 50, "final"), (3, 11, "final")}
