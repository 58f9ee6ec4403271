"""Queries of review state, scores and validation, on tables derived from the shared ones, with their SQL.

Customers stand for students, orders for submissions and their grades, line items for scored items, and
events for the log of changes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillsift.operators import review as V

VERSION, CURRENT_TOTAL = 4, 100

# The same expressions on both sides.
STATUS = "CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'P' THEN 'manual' ELSE 'pending' END"
HAS_RUBRIC = "o_orderpriority <> '5-LOW'"
SCORED = "CAST(floor(o_totalprice / 2500) AS BIGINT)"
TOTAL = "CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(0 AS BIGINT) WHEN o_orderpriority = '2-HIGH' THEN NULL ELSE CAST(150 AS BIGINT) END"
OWN = "CAST(60 + o_orderkey % 50 AS BIGINT)"
GRADED_VERSION = "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(1 + o_orderkey % 4 AS INTEGER) END"
LAST_ORDERS = "last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1)"
GRADES = f"""grades AS (SELECT o_custkey AS student_id, {STATUS} AS status, {HAS_RUBRIC} AS has_rubric, {SCORED} AS score, {TOTAL} AS total_points, {OWN} AS own_points,
  {GRADED_VERSION} AS assignment_version FROM last)"""


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _last_orders(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders").withColumn("deleted", F.lit(False))
    return V.latest(orders, "o_custkey", "o_orderkey")


def _students(spark, sf_dir):
    people = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("student_id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 50 == 0, "teacher").alias("role"))
    return V.students(people).drop("role")


def _submissions(spark, sf_dir):
    return _last_orders(spark, sf_dir).select(F.col("o_custkey").alias("student_id"), F.col("o_orderkey").alias("submitted_at"))


def _grades(spark, sf_dir):
    return _last_orders(spark, sf_dir).select(
        F.col("o_custkey").alias("student_id"), F.expr(STATUS).alias("status"), F.expr(HAS_RUBRIC).alias("has_rubric"), F.expr(SCORED).alias("score"),
        F.expr(TOTAL).alias("total_points"), F.expr(OWN).alias("own_points"), F.expr(GRADED_VERSION).alias("assignment_version"),
    )


def _busy(spark, sf_dir):
    return _read(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("student_id")).distinct()


def latest_grade(spark, sf_dir):
    events = _read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", (F.col("event_type") == "error").alias("deleted"))
    return V.latest(events, "user_id", "event_id").select("user_id", "event_id", "event_type", "value")


def gradebook(spark, sf_dir):
    return V.gradebook(_students(spark, sf_dir), _submissions(spark, sf_dir), _grades(spark, sf_dir), _busy(spark, sf_dir), VERSION, CURRENT_TOTAL)


def ungraded_queue(spark, sf_dir):
    return V.ungraded_queue(_submissions(spark, sf_dir), _students(spark, sf_dir), _grades(spark, sf_dir), _busy(spark, sf_dir))


def submission_flags(spark, sf_dir):
    return V.submission_flags(_students(spark, sf_dir), _submissions(spark, sf_dir))


def roster_move(spark, sf_dir):
    """Neighbouring ids swap; every tenth student is removed."""
    ids = _students(spark, sf_dir).where("student_id % 10 <> 0").select(F.col("student_id").alias("original_id"), F.expr("CASE WHEN student_id % 2 = 0 THEN student_id + 1 ELSE student_id - 1 END").alias("new_id"))
    return V.moved(_submissions(spark, sf_dir), ids)


def replaced_submissions(spark, sf_dir):
    arrived = _read(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("student_id"), F.lit(0).cast("long").alias("submitted_at"))
    return V.replaced(_submissions(spark, sf_dir), arrived)


def stale_count(spark, sf_dir):
    stale = V.is_stale(F.col("has_rubric"), F.col("assignment_version"), F.lit(VERSION))
    return _grades(spark, sf_dir).groupBy("status").agg(F.count_if(stale).alias("outdated"), F.count(F.lit(1)).alias("grades"))


def grade_totals(spark, sf_dir):
    return _grades(spark, sf_dir).select("student_id", V.grade_total(F.col("total_points"), F.col("has_rubric"), F.col("own_points"), F.lit(CURRENT_TOTAL)).alias("total"))


def approve_grades(spark, sf_dir):
    open_grades = _grades(spark, sf_dir).select(
        "student_id", "status", "score", F.expr("CASE WHEN student_id % 3 = 0 THEN student_id % 120 + 0.5 END").cast("double").alias("override"),
        V.grade_total(F.col("total_points"), F.col("has_rubric"), F.col("own_points"), F.lit(CURRENT_TOTAL)).cast("long").alias("total"),
    )
    return V.approved(open_grades).select("student_id", "status", "score")


def score_submissions(spark, sf_dir):
    """Line items are a reply's items, named by their line number modulo 5; the last of a name counts, the others of the rubric must be there."""
    reply = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("grade_id"), (F.col("l_linenumber") % 5).alias("item"), F.struct("l_linenumber", "l_partkey", "l_quantity").alias("place"), (F.col("l_quantity") - 10).alias("points"))
    rubric = reply.select("grade_id", "item", F.lit(30).alias("max_points")).distinct()
    return V.score_items(rubric, reply).groupBy("grade_id").agg(F.sum("points").alias("raw_score"), F.sum("max_points").alias("total"))


def clamp_points(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", V.clamped(F.col("value") - 20, F.lit(50)).alias("points"))


def assignment_totals(spark, sf_dir):
    items = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_quantity").cast("long").alias("max_points"))).alias("rubric"))
    return items.select(F.col("l_orderkey").alias("assignment_id"), V.points(F.col("rubric")).alias("total_points"))


def student_states(spark, sf_dir):
    joined = _students(spark, sf_dir).join(_submissions(spark, sf_dir), "student_id", "left").join(_grades(spark, sf_dir), "student_id", "left")
    final = F.col("status") == "final"
    return joined.select("student_id", V.student_view(F.col("status"), F.col("submitted_at").isNotNull()).alias("state"), F.when(final, F.col("score")).otherwise(F.lit(-1)).cast("long").alias("shown_score"))


def image_verdicts(spark, sf_dir):
    """Parts stand for images: what was read, how surely, how often and how large."""
    words = F.when(F.col("p_size") % 10 != 9, F.col("p_size") % 5)
    verdict = V.image_verdict(words, F.col("p_retailprice") % 100, F.col("p_partkey") % 3, F.col("p_size") * 20, F.col("p_size") % 2 == 0)
    return _read(spark, sf_dir, "part").groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("images"))


def distinct_images(spark, sf_dir):
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "text", (F.length("text") * 2).alias("width"), F.length("text").alias("height"))
    return V.distinct_images(turns, "conv_id", "text", "turn", "width", "height")


def roster_violations(spark, sf_dir):
    people = _read(spark, sf_dir, "customer").select(
        F.lit(None).cast("string").alias("role"), F.expr("CAST(1000000 + c_custkey % 1400 AS STRING)").alias("student_id"), F.expr("CASE WHEN c_custkey % 9 = 0 THEN '' ELSE 'Ann' END").alias("first_name"),
        F.expr("CASE WHEN c_custkey % 11 = 0 THEN c_name ELSE 'Bell' END").alias("last_name"), F.expr("CASE WHEN c_custkey % 13 = 0 THEN 'nobody' ELSE c_name || '@x.org' END").alias("email"),
        F.lit(None).cast("string").alias("original_id"), F.col("c_custkey"),
    )
    return V.roster_violations(people).select("c_custkey", F.array_join("violations", ",").alias("violations"))


def roster_size(spark, sf_dir):
    """Whether the customers of a segment could be a roster."""
    people = _read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), F.lit(None).cast("string").alias("role"))
    return V.roster_size_error(people.where("segment = 'BUILDING'")).unionByName(V.roster_size_error(people))


QUERIES = {
    f.__name__: f
    for f in (
        latest_grade, gradebook, ungraded_queue, submission_flags, roster_move, replaced_submissions, stale_count, grade_totals, approve_grades, score_submissions, clamp_points,
        assignment_totals, student_states, image_verdicts, distinct_images, roster_violations, roster_size,
    )
}

_PEOPLE = "people AS (SELECT c_custkey AS student_id, c_name AS name FROM customer WHERE c_custkey % 50 <> 0)"
_SUBS = "subs AS (SELECT o_custkey AS student_id, o_orderkey AS submitted_at FROM last)"
_BUSY = "busy AS (SELECT DISTINCT user_id AS student_id FROM events WHERE event_type = 'purchase')"
_GRADE_TOTAL = f"CASE WHEN total_points > 0 THEN total_points WHEN has_rubric THEN own_points ELSE {CURRENT_TOTAL} END"
_STALE = f"has_rubric AND coalesce(assignment_version, 1) <> {VERSION}"

SQL = {
    "roster_size": """SELECT CASE WHEN count(*) NOT BETWEEN 1 AND 500 THEN 'the roster needs 1 to 500 students' END AS error FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT CASE WHEN count(*) NOT BETWEEN 1 AND 500 THEN 'the roster needs 1 to 500 students' END FROM customer""",
    "latest_grade": "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type <> 'error'",
    "gradebook": f"""WITH {LAST_ORDERS}, {GRADES}, {_PEOPLE}, {_SUBS}, {_BUSY}
SELECT p.student_id, name, submitted_at, CASE WHEN submitted_at IS NULL THEN 'missing' WHEN b.student_id IS NOT NULL THEN 'grading' ELSE coalesce(status, 'ungraded') END AS status,
 coalesce({_STALE}, false) AS stale, CASE WHEN status IS NOT NULL THEN {_GRADE_TOTAL} END AS total_points, score
FROM people p LEFT JOIN subs s ON p.student_id = s.student_id LEFT JOIN grades g ON p.student_id = g.student_id LEFT JOIN busy b ON p.student_id = b.student_id""",
    "ungraded_queue": f"""WITH {LAST_ORDERS}, {GRADES}, {_PEOPLE}, {_SUBS}, {_BUSY}
SELECT * FROM subs WHERE student_id IN (SELECT student_id FROM people) AND student_id NOT IN (SELECT student_id FROM grades WHERE status = 'final') AND student_id NOT IN (SELECT student_id FROM busy)""",
    "submission_flags": f"WITH {LAST_ORDERS}, {_PEOPLE}, {_SUBS} SELECT student_id, name, student_id IN (SELECT student_id FROM subs) AS has_submission FROM people",
    "roster_move": f"""WITH {LAST_ORDERS}, {_PEOPLE}, {_SUBS} SELECT CASE WHEN student_id % 2 = 0 THEN student_id + 1 ELSE student_id - 1 END AS student_id, submitted_at
FROM subs WHERE student_id IN (SELECT student_id FROM people WHERE student_id % 10 <> 0)""",
    "replaced_submissions": f"""WITH {LAST_ORDERS}, {_SUBS}, a AS (SELECT c_custkey AS student_id, CAST(0 AS BIGINT) AS submitted_at FROM customer WHERE c_acctbal < 0)
SELECT * FROM subs WHERE student_id NOT IN (SELECT student_id FROM a) UNION ALL SELECT * FROM a""",
    "stale_count": f"WITH {LAST_ORDERS}, {GRADES} SELECT status, count(*) FILTER ({_STALE}) AS outdated, count(*) AS grades FROM grades GROUP BY status",
    "grade_totals": f"WITH {LAST_ORDERS}, {GRADES} SELECT student_id, {_GRADE_TOTAL} AS total FROM grades",
    "approve_grades": f"""WITH {LAST_ORDERS}, {GRADES}, o AS (SELECT student_id, status, coalesce(CASE WHEN student_id % 3 = 0 THEN CAST(student_id % 120 + 0.5 AS DOUBLE) END, CAST(score AS DOUBLE)) AS s, {_GRADE_TOTAL} AS t FROM grades)
SELECT student_id, 'final' AS status, CAST(floor(s + 0.5) AS BIGINT) AS score FROM o WHERE status IN ('pending', 'manual', 'error') AND s >= 0 AND s <= t""",
    "score_submissions": """WITH r AS (SELECT grade_id, points FROM (SELECT l_orderkey AS grade_id, l_quantity - 10 AS points, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 5 ORDER BY l_linenumber DESC, l_partkey DESC, l_quantity DESC) AS rn FROM lineitem) WHERE rn = 1)
SELECT grade_id, CAST(sum(greatest(0, least(30, floor(points + 0.5)))) AS BIGINT) AS raw_score, CAST(30 * count(*) AS BIGINT) AS total FROM r GROUP BY grade_id""",
    "clamp_points": "SELECT event_id, CAST(greatest(0, least(50, floor(value - 20 + 0.5))) AS BIGINT) AS points FROM events",
    "assignment_totals": "SELECT l_orderkey AS assignment_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total_points FROM lineitem GROUP BY 1",
    "student_states": f"""WITH {LAST_ORDERS}, {GRADES}, {_PEOPLE}, {_SUBS}
SELECT p.student_id, CASE WHEN submitted_at IS NULL THEN 'not_submitted' WHEN status = 'final' THEN 'graded' ELSE 'submitted' END AS state, CASE WHEN status = 'final' THEN score ELSE -1 END AS shown_score
FROM people p LEFT JOIN subs s ON p.student_id = s.student_id LEFT JOIN grades g ON p.student_id = g.student_id""",
    "image_verdicts": """SELECT CASE WHEN p_size % 10 = 9 THEN 'skipped' WHEN p_size % 5 >= 2 AND p_retailprice % 100 >= 75 THEN 'kept' WHEN p_size % 5 < 2 AND (p_partkey % 3 > 1 OR p_size * 20 <= 400) THEN 'dropped'
 WHEN p_size % 2 = 0 THEN 'unreadable' ELSE 'skipped' END AS verdict, count(*) AS images FROM part GROUP BY 1""",
    "distinct_images": "SELECT conv_id, sha256(text) AS digest, count(*) AS uses, min(turn) AS first_place FROM conversations WHERE length(text) * 2 > 100 GROUP BY 1, 2",
    "roster_violations": """WITH p AS (SELECT c_custkey, CAST(1000000 + c_custkey % 1400 AS VARCHAR) AS id, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE 'Ann' END AS f, CASE WHEN c_custkey % 11 = 0 THEN c_name ELSE 'Bell' END AS l,
 CASE WHEN c_custkey % 13 = 0 THEN 'nobody' ELSE c_name || '@x.org' END AS e FROM customer),
c AS (SELECT *, count(*) OVER (PARTITION BY id) AS ids, count(*) OVER (PARTITION BY lower(e)) AS es FROM p)
SELECT c_custkey, array_to_string(list_filter([CASE WHEN f = '' THEN 'name_required' END, CASE WHEN NOT (regexp_full_match(f, '\\p{L}[\\p{L}\\p{M}''’. -]*') AND regexp_full_match(l, '\\p{L}[\\p{L}\\p{M}''’. -]*')) THEN 'name_letters' END,
 CASE WHEN NOT regexp_full_match(e, '[^\\s@,;<>]+@[^\\s@,;<>]+\\.[^\\s@,;<>]+') THEN 'email_invalid' END, CASE WHEN ids > 1 THEN 'duplicate_id' END, CASE WHEN es > 1 THEN 'duplicate_email' END], lambda x: x IS NOT NULL), ',') AS violations FROM c""",
}
