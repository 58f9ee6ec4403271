"""Queries of the write side, the views and the small functions, on tables derived from the shared ones, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillsift.functions import text as X
from quillsift.operators import records as R
from quillsift.operators import review as V
from quillsift.plans.review_queries import _BUSY, _GRADE_TOTAL, _PEOPLE, _STALE, _SUBS, CURRENT_TOTAL, GRADES, LAST_ORDERS, VERSION, _busy, _grades, _read, _students, _submissions

# The same expressions on both sides.
FIRST, LAST = "split_part(c_name, '#', 1)", "split_part(c_name, '#', 2)"
EXTENSIONS = (".txt", ".pdf", ".PNG", ".jpeg", ".docx", ".md", ".ppt")
EXTENSION = "CASE {k} % 7 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(EXTENSIONS)) + " END"
CONFIDENCE = "CASE WHEN p_size % 4 = 0 THEN NULL ELSE CAST(p_size * 2 AS DOUBLE) END"
TAGGED = "text || CASE WHEN doc_id % 2 = 0 THEN ' </essay> <x:y/> </antml-call>' ELSE '' END"
ESSAY = "replace(replace(text, ' the ', ' < / Essay> '), ' of ', ' <essay ')"
MARKUP = "replace(replace(replace(text, ' the ', ' <b> & '), ' of ', ' \"x\" '), ' de ', ' ''y'' ')"


def event_numbers(spark, sf_dir):
    events = _read(spark, sf_dir, "events").select("event_id", "value")
    return R.numbered(events, "value", "event_id", start=10).select("event_id", "seq")


def assignment_versions(spark, sf_dir):
    """Line items save the assignment that their part stands for, one after the other."""
    current = _read(spark, sf_dir, "part").where("p_partkey % 5 <> 0").select("p_partkey", (F.col("p_size") % 4 + 1).alias("version"))
    changes = _read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice").alias("seq"))
    return R.latest_version(R.next_versions(current, changes, "p_partkey", "seq"), "p_partkey").select("p_partkey", "version", F.col("seq.l_orderkey").alias("last_order"))


def _arrived(spark, sf_dir):
    """New work of students with debts, one of ten under an id that nobody has."""
    debtors = _read(spark, sf_dir, "customer").where("c_acctbal < 0")
    return debtors.select(F.expr("CASE WHEN c_custkey % 10 = 3 THEN -c_custkey ELSE c_custkey END").alias("student_id"), F.lit(0).cast("long").alias("submitted_at"))


def resubmissions(spark, sf_dir):
    submissions, grades = R.replace_submissions(_submissions(spark, sf_dir), _grades(spark, sf_dir).select("student_id", "status"), _arrived(spark, sf_dir), _students(spark, sf_dir))
    return submissions.join(grades, "student_id", "left")


def submission_errors(spark, sf_dir):
    return R.enrolled(_arrived(spark, sf_dir), _students(spark, sf_dir), _busy(spark, sf_dir)).select("student_id", "error")


def moved_grades(spark, sf_dir):
    ids = _students(spark, sf_dir).where("student_id % 10 <> 0").select(F.col("student_id").alias("original_id"), F.expr("CASE WHEN student_id % 2 = 0 THEN student_id + 1 ELSE student_id - 1 END").alias("new_id"))
    submissions, grades = R.move_students(_submissions(spark, sf_dir), _grades(spark, sf_dir).select("student_id", "status", "score"), ids)
    return submissions.join(grades, "student_id")


def _assignments(spark, sf_dir):
    lines = _read(spark, sf_dir, "lineitem")
    item = F.struct(F.concat(F.lit("Q"), F.col("l_linenumber").cast("string")).alias("question"), F.col("l_quantity").cast("long").alias("max_points"), F.col("l_linestatus").alias("answer"))
    of = lambda flag: F.collect_list(F.when(F.col("l_returnflag") == "R" if flag else F.col("l_returnflag") != "R", item))
    return lines.groupBy(F.col("l_orderkey").alias("assignment_id")).agg(
        F.max(F.concat(F.lit("Order "), F.col("l_orderkey").cast("string"))).alias("title"),
        F.max("l_shipdate").alias("deadline"), F.count(F.lit(1)).alias("version"), of(True).alias("rubric"), of(False).alias("answer_key"),
    )


def assignment_summaries(spark, sf_dir):
    return R.assignment_summary(_assignments(spark, sf_dir)).select("assignment_id", "title", F.date_format("deadline", "yyyy-MM-dd").alias("deadline"), "version", "total_points")


def shown_questions(spark, sf_dir):
    shown = _assignments(spark, sf_dir).select("assignment_id", F.explode(R.shown_questions(F.col("answer_key"))).alias("q"))
    return shown.select("assignment_id", "q.*")


def saved_grades(spark, sf_dir):
    graded = _grades(spark, sf_dir).select("student_id", "status", "score")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("student_id"))
    saved = R.stamped(graded, F.lit(VERSION), F.lit(CURRENT_TOTAL), at)
    return saved.select("student_id", "status", "assignment_version", "total_points", F.unix_seconds("graded_at").alias("graded_at"))


def grade_outcomes(spark, sf_dir):
    """Documents without a label were routed by hand; toxic ones stand for failed calls, documents with an email for replies that name somebody."""
    labels = _read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    joined = _read(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    routed = F.when(F.col("quality").isNull(), "manual").otherwise("send")
    kinds = F.when(X.has_email(F.col("text")), F.array(F.lit("email"))).otherwise(F.array().cast("array<string>"))
    made = R.outcome(routed, F.when(F.col("quality").isNull(), "unlabelled"), F.when(F.col("toxic") == 1, "call failed"), kinds, F.col("n_chars") % 100)
    return joined.select("doc_id", made.alias("o")).select("doc_id", "o.*")


def page_confidence(spark, sf_dir):
    """Parts are pages of the document that their size stands for; those of one type were not kept."""
    kept = _read(spark, sf_dir, "part").select("p_size", F.when(~F.col("p_type").like("PROMO%"), F.col("p_retailprice")).alias("c"))
    return kept.groupBy("p_size").agg(R.lowest_confidence(F.collect_list("c")).alias("confidence"))


def text_views(spark, sf_dir):
    view = R.read_text(F.col("p_name"), F.expr(CONFIDENCE), F.expr("CASE WHEN p_partkey % 9 = 0 THEN 1 ELSE 0 END"), F.col("p_partkey") % 3, F.when(F.col("p_partkey") % 11 == 0, "could not read that file"))
    return _read(spark, sf_dir, "part").select("p_partkey", view.alias("v")).select("p_partkey", "v.*")


def preview_kinds(spark, sf_dir):
    return _read(spark, sf_dir, "part").groupBy(R.preview_kind(F.expr(EXTENSION.format(k="p_partkey"))).alias("kind")).agg(F.count(F.lit(1)).alias("files"))


def first_teacher(spark, sf_dir):
    roster = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("place"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 50 == 0, "teacher").alias("role"))
    return R.teacher_of(roster, "place").select("name")


def _people(spark, sf_dir):
    return _read(spark, sf_dir, "customer").where("c_custkey % 50 <> 0").select(
        F.col("c_custkey").alias("student_id"), F.expr(FIRST).alias("first_name"), F.expr(LAST).alias("last_name"), (F.col("c_custkey") % 40 == 7).alias("student_view")
    )


def view_as(spark, sf_dir):
    return R.student_in_view(_people(spark, sf_dir), "student_id")


def students_in_view(spark, sf_dir):
    return R.one_in_view(_people(spark, sf_dir), "student_id").select("student_id", "student_view", R.name_of(F.col("first_name"), F.col("last_name"))["last_name"].alias("last_name"))


def detail_of_one(spark, sf_dir):
    return R.submission_detail(F.lit(148), _students(spark, sf_dir), _submissions(spark, sf_dir), _grades(spark, sf_dir), _busy(spark, sf_dir), VERSION, CURRENT_TOTAL)


def student_pages(spark, sf_dir):
    pages = R.student_pages(_students(spark, sf_dir), _submissions(spark, sf_dir), _grades(spark, sf_dir), CURRENT_TOTAL)
    return pages.select("student_id", "state", F.col("grade.score").alias("score"), F.col("grade.total_points").alias("total_points"))


def regrade_codes(spark, sf_dir):
    asked = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("student_id"))
    return R.regrade_requests(asked, _submissions(spark, sf_dir), _busy(spark, sf_dir)).groupBy("code").agg(F.count(F.lit(1)).alias("requests"))


def outdated_grades(spark, sf_dir):
    return R.outdated_after(_grades(spark, sf_dir), F.lit(VERSION))


def gradebook_totals(spark, sf_dir):
    return R.book_totals(V.gradebook(_students(spark, sf_dir), _submissions(spark, sf_dir), _grades(spark, sf_dir), _busy(spark, sf_dir), VERSION, CURRENT_TOTAL))


def queue_size(spark, sf_dir):
    return R.queue_size(_submissions(spark, sf_dir), _students(spark, sf_dir), _grades(spark, sf_dir), _busy(spark, sf_dir))


def shuffled_queue(spark, sf_dir):
    return R.shuffled(V.ungraded_queue(_submissions(spark, sf_dir), _students(spark, sf_dir), _grades(spark, sf_dir), _busy(spark, sf_dir)), 7).select("student_id")


def payload_tokens(spark, sf_dir):
    """One row: tokens are as many as rows, and look like tokens."""
    drawn = R.with_token(_read(spark, sf_dir, "documents").select("doc_id"))
    return drawn.agg(F.count_distinct("token").alias("tokens"), F.bool_and(F.col("token").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")).alias("sound"))


def agent_payloads(spark, sf_dir):
    sent = _read(spark, sf_dir, "documents").where("length(text) > 0").select(F.col("doc_id").cast("string").alias("token"), "text", "lang")
    return V.payload(sent).select("token", F.md5("text").alias("text_md5"))


def text_fields(spark, sf_dir):
    """Titles of at most 22 characters, without which there is none; a third of them blank."""
    title = F.expr("CASE WHEN p_partkey % 3 = 0 THEN chr(9) || ' ' ELSE ' ' || p_name || chr(10) END")
    return _read(spark, sf_dir, "part").select("p_partkey", R.text_error(title, "title", 22).alias("error"))


def whole_numbers(spark, sf_dir):
    return _read(spark, sf_dir, "part").select("p_partkey", R.whole_error(F.expr("CASE WHEN p_size % 5 = 0 THEN p_size + 0.5 WHEN p_size % 5 = 1 THEN NULL ELSE p_retailprice - p_retailprice % 1 END"), "points", 1, 1000).alias("error"))


def short_digests(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", X.short_digest(F.encode("text", "utf-8")).alias("digest"))


def untagged_comments(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(X.without_trailing_tags(F.expr(TAGGED))).alias("comment_md5"))


def fenced_essays(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(X.fenced(F.expr(ESSAY))).alias("essay_md5"))


def escaped_texts(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(X.html_escaped(F.expr(MARKUP))).alias("html_md5"))


def shown_times(spark, sf_dir):
    ts = F.col("ts").cast("timestamp_ntz")
    return _read(spark, sf_dir, "events").select("event_id", R.shown_time(ts).alias("shown"), R.local_input(ts, (F.col("user_id") % 24 * 60 - 720).cast("int")).alias("local"))


QUERIES = {
    f.__name__: f
    for f in (
        event_numbers, assignment_versions, resubmissions, submission_errors, moved_grades, assignment_summaries, shown_questions, saved_grades, grade_outcomes, page_confidence, text_views,
        preview_kinds, first_teacher, view_as, students_in_view, detail_of_one, student_pages, regrade_codes, outdated_grades, gradebook_totals, queue_size, shuffled_queue, payload_tokens,
        agent_payloads, text_fields, whole_numbers, short_digests, untagged_comments, fenced_essays, escaped_texts, shown_times,
    )
}

_ARRIVED = "arrived AS (SELECT CASE WHEN c_custkey % 10 = 3 THEN -c_custkey ELSE c_custkey END AS student_id, CAST(0 AS BIGINT) AS submitted_at FROM customer WHERE c_acctbal < 0)"
_QUEUE = "SELECT student_id FROM subs WHERE student_id IN (SELECT student_id FROM people) AND student_id NOT IN (SELECT student_id FROM grades WHERE status = 'final') AND student_id NOT IN (SELECT student_id FROM busy)"
_EMAIL = r"(?:\[REDACTED\]|[\p{L}\p{N}._%+-])+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+"
_BOOK = f"""book AS (SELECT p.student_id, name, submitted_at, CASE WHEN submitted_at IS NULL THEN 'missing' WHEN b.student_id IS NOT NULL THEN 'grading' ELSE coalesce(status, 'ungraded') END AS status,
 coalesce({_STALE}, false) AS stale, CASE WHEN status IS NOT NULL THEN {_GRADE_TOTAL} END AS total_points, score
FROM people p LEFT JOIN subs s ON p.student_id = s.student_id LEFT JOIN grades g ON p.student_id = g.student_id LEFT JOIN busy b ON p.student_id = b.student_id)"""
_VIEWED = f"c AS (SELECT c_custkey AS student_id, {FIRST} AS first_name, {LAST} AS last_name, c_custkey % 40 = 7 AS v FROM customer WHERE c_custkey % 50 <> 0)"

SQL = {
    "event_numbers": "SELECT event_id, 10 + row_number() OVER (ORDER BY value, event_id) AS seq FROM events",
    "assignment_versions": """WITH c AS (SELECT p_partkey, p_size % 4 + 1 AS version FROM part WHERE p_partkey % 5 <> 0)
SELECT l_partkey AS p_partkey, CAST(coalesce(max(c.version), 1) + count(*) AS INTEGER) AS version, max(l_orderkey) AS last_order FROM lineitem LEFT JOIN c ON l_partkey = p_partkey GROUP BY l_partkey""",
    "resubmissions": f"""WITH {LAST_ORDERS}, {GRADES}, {_PEOPLE}, {_SUBS}, {_ARRIVED}, a AS (SELECT * FROM arrived WHERE student_id IN (SELECT student_id FROM people)),
n AS (SELECT * FROM subs WHERE student_id NOT IN (SELECT student_id FROM a) UNION ALL SELECT * FROM a)
SELECT n.student_id, submitted_at, CASE WHEN n.student_id NOT IN (SELECT student_id FROM a) THEN status END AS status FROM n LEFT JOIN grades g ON n.student_id = g.student_id""",
    "submission_errors": f"""WITH {_PEOPLE}, {_BUSY}, {_ARRIVED} SELECT student_id, CASE WHEN student_id NOT IN (SELECT student_id FROM people) THEN 'unknown student'
 WHEN student_id IN (SELECT student_id FROM busy) THEN 'your previous submission is being graded; try again in a moment' END AS error FROM arrived""",
    "moved_grades": f"""WITH {LAST_ORDERS}, {GRADES}, {_PEOPLE}, {_SUBS} SELECT CASE WHEN s.student_id % 2 = 0 THEN s.student_id + 1 ELSE s.student_id - 1 END AS student_id, submitted_at, status, score
FROM subs s JOIN grades g ON s.student_id = g.student_id WHERE s.student_id IN (SELECT student_id FROM people WHERE student_id % 10 <> 0)""",
    "assignment_summaries": "SELECT l_orderkey AS assignment_id, 'Order ' || l_orderkey AS title, strftime(max(l_shipdate), '%Y-%m-%d') AS deadline, count(*) AS version, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total_points FROM lineitem GROUP BY l_orderkey",
    "shown_questions": "SELECT l_orderkey AS assignment_id, 'Q' || l_linenumber AS question, CAST(l_quantity AS BIGINT) AS max_points FROM lineitem WHERE l_returnflag <> 'R'",
    "saved_grades": f"WITH {LAST_ORDERS}, {GRADES} SELECT student_id, status, {VERSION} AS assignment_version, {CURRENT_TOTAL} AS total_points, 1700000000 + student_id AS graded_at FROM grades",
    "grade_outcomes": f"""WITH j AS (SELECT d.doc_id, n_chars, quality, toxic, regexp_matches(text, '{_EMAIL}') AS named FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT doc_id, CASE WHEN quality IS NULL THEN 'manual' WHEN toxic = 1 THEN 'error' WHEN named THEN 'manual' ELSE 'pending' END AS status,
 CASE WHEN quality IS NULL THEN 'unlabelled' WHEN toxic = 1 THEN 'call failed' WHEN named THEN 'Agent output contained a student identifier.' END AS reason,
 CASE WHEN quality IS NOT NULL AND toxic = 0 AND NOT named THEN n_chars % 100 END AS score FROM j""",
    "page_confidence": "SELECT p_size, min(CASE WHEN p_type NOT LIKE 'PROMO%' THEN p_retailprice END) AS confidence FROM part GROUP BY p_size",
    "text_views": f"""WITH p AS (SELECT *, {CONFIDENCE} AS c, p_partkey % 11 <> 0 AS fine FROM part)
SELECT p_partkey, CASE WHEN fine THEN p_name END AS text, CASE WHEN fine THEN c IS NOT NULL END AS ocr, CASE WHEN fine THEN p_partkey % 9 = 0 OR coalesce(c < 75, false) END AS weak_ocr,
 CASE WHEN fine THEN p_partkey % 3 END AS skipped_images, CASE WHEN NOT fine THEN 'could not read that file' END AS text_error FROM p""",
    "preview_kinds": f"""SELECT CASE WHEN lower(e) IN ('.png', '.jpg', '.jpeg') THEN 'image' WHEN lower(e) IN ('.pdf', '.docx', '.doc', '.pptx', '.ppt') THEN 'pdf' END AS kind, count(*) AS files
FROM (SELECT {EXTENSION.format(k="p_partkey")} AS e FROM part) GROUP BY 1""",
    "first_teacher": "SELECT c_name AS name FROM customer WHERE c_custkey % 50 = 0 ORDER BY c_custkey LIMIT 1",
    "view_as": f"WITH {_VIEWED} SELECT student_id, first_name, last_name FROM c ORDER BY v DESC, student_id LIMIT 1",
    "students_in_view": f"WITH {_VIEWED} SELECT student_id, student_id = (SELECT min(student_id) FROM c WHERE v) AS student_view, last_name FROM c",
    "detail_of_one": f"WITH {LAST_ORDERS}, {GRADES}, {_PEOPLE}, {_SUBS}, {_BUSY}, {_BOOK} SELECT * FROM book WHERE student_id = 148",
    "student_pages": f"""WITH {LAST_ORDERS}, {GRADES}, {_PEOPLE}, {_SUBS}
SELECT p.student_id, CASE WHEN submitted_at IS NULL THEN 'not_submitted' WHEN status = 'final' THEN 'graded' ELSE 'submitted' END AS state,
 CASE WHEN status = 'final' THEN score END AS score, CASE WHEN status = 'final' THEN {_GRADE_TOTAL} END AS total_points
FROM people p LEFT JOIN subs s ON p.student_id = s.student_id LEFT JOIN grades g ON p.student_id = g.student_id""",
    "regrade_codes": f"""WITH {LAST_ORDERS}, {_SUBS}, {_BUSY}
SELECT CASE WHEN c_custkey NOT IN (SELECT student_id FROM subs) THEN 404 WHEN c_custkey IN (SELECT student_id FROM busy) THEN 409 ELSE 202 END AS code, count(*) AS requests FROM customer GROUP BY 1""",
    "outdated_grades": f"WITH {LAST_ORDERS}, {GRADES} SELECT count(*) FILTER ({_STALE}) AS outdated FROM grades",
    "gradebook_totals": f"""WITH {LAST_ORDERS}, {GRADES}, {_PEOPLE}, {_SUBS}, {_BUSY}, {_BOOK}
SELECT count(*) FILTER (stale AND status <> 'grading') AS outdated, bool_or(status = 'grading') AS busy, CAST(sum(total_points) AS BIGINT) AS points FROM book""",
    "queue_size": f"WITH {LAST_ORDERS}, {GRADES}, {_PEOPLE}, {_SUBS}, {_BUSY}, q AS ({_QUEUE}) SELECT count(*) AS queued FROM q",
    "shuffled_queue": f"WITH {LAST_ORDERS}, {GRADES}, {_PEOPLE}, {_SUBS}, {_BUSY} {_QUEUE}",
    "payload_tokens": "SELECT count(*) AS tokens, true AS sound FROM documents",
    "agent_payloads": "SELECT CAST(doc_id AS VARCHAR) AS token, md5(text) AS text_md5 FROM documents WHERE length(text) > 0",
    "text_fields": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'title is required' WHEN length(trim(p_name)) > 22 THEN 'title must be at most 22 characters' END AS error FROM part",
    "whole_numbers": """SELECT p_partkey, CASE WHEN p_size % 5 IN (0, 1) OR floor(p_retailprice) < 1 OR floor(p_retailprice) > 1000 THEN 'points must be a whole number from 1 to 1000' END AS error FROM part""",
    "short_digests": "SELECT doc_id, substring(sha256(text), 1, 16) AS digest FROM documents",
    "untagged_comments": f"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace({TAGGED}, '(?:\\s*</?[\\w:-]+>)+\\s*$', ''), '^\\s+', ''), '\\s+$', '')) AS comment_md5 FROM documents",
    "fenced_essays": f"SELECT doc_id, md5(regexp_replace({ESSAY}, '<(\\s*/?\\s*essay)', '‹\\1', 'gi')) AS essay_md5 FROM documents",
    "escaped_texts": f"SELECT doc_id, md5(replace(replace(replace(replace(replace({MARKUP}, '&', '&#38;'), '<', '&#60;'), '>', '&#62;'), '\"', '&#34;'), '''', '&#39;')) AS html_md5 FROM documents",
    "shown_times": """SELECT event_id, strftime(ts, '%b %-d, %Y, %-I:%M %p') AS shown, strftime(ts + to_minutes(CAST(user_id % 24 * 60 - 720 AS INTEGER)), '%Y-%m-%dT%H:%M') AS local FROM events""",
}
