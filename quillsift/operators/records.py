"""The write side and the views of the review state: numbered events, versions, submissions that replace others, detail.

Nothing is rewritten in place. A write is a DataFrame of new events or versions; a view joins the latest rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillsift.functions import text as X
from quillsift.operators import review as V

#: Files that can be shown as they are, or once converted, by their extension.
PREVIEW_TYPES = {
    ".pdf": "application/pdf", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg",
    ".docx": "application/pdf", ".doc": "application/pdf", ".pptx": "application/pdf", ".ppt": "application/pdf",
}


def numbered(events: DataFrame, order: str, tie: str, start: int = 0, slices: int = 64) -> DataFrame:
    """``events`` with ``seq``: their place from ``start`` + 1 on in the order of a number, then of ``tie``.

    A total order without a global sort: approximate quantiles cut the order into slices, each numbered by
    itself after the rows of the slices before it, whose counts are a table of at most ``slices`` + 1 rows.
    """
    cuts = events.agg(F.percentile_approx(order, [i / slices for i in range(1, slices)], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    slice_of = F.lit(0)
    for cut in cuts:
        slice_of += F.when(F.col(order) > cut, 1).otherwise(0)
    sliced = events.withColumn("_slice", slice_of)
    counts = sorted((r["_slice"], r["count"]) for r in sliced.groupBy("_slice").count().collect())
    before, offsets = start, []
    for at, n in counts:
        offsets += [F.lit(at), F.lit(before).cast("long")]
        before += n
    if not offsets:
        return events.withColumn("seq", F.lit(None).cast("long"))
    own = F.row_number().over(Window.partitionBy("_slice").orderBy(order, tie))
    return sliced.withColumn("seq", F.create_map(*offsets)[F.col("_slice")] + own).drop("_slice")


def next_versions(current: DataFrame, changes: DataFrame, key: str, seq: str) -> DataFrame:
    """The changes of each key, in the order of ``seq``, as its versions after the current one; every save is one version more.

    ``current``: (key, version). A change of a key without a current version starts at 2, as an assignment has version 1 before it is saved.
    """
    turn = F.row_number().over(Window.partitionBy(key).orderBy(seq))
    return changes.join(current.select(key, "version"), key, "left").withColumn("version", (F.coalesce("version", F.lit(1)) + turn).cast("int"))


def latest_version(versions: DataFrame, key: str) -> DataFrame:
    others = [c for c in versions.columns if c != key]
    return versions.groupBy(key).agg(F.max_by(F.struct(*others), "version").alias("_last")).select(key, "_last.*")


def enrolled(arrived: DataFrame, people: DataFrame, busy: DataFrame) -> DataFrame:
    """``arrived`` with the error that stops a submission: an unknown student, or one whose work is being graded."""
    known = people.select("student_id", F.lit(True).alias("_known")).distinct()
    grading = busy.select("student_id", F.lit(True).alias("_busy")).distinct()
    error = F.when(F.col("_known").isNull(), "unknown student").when(F.col("_busy"), "your previous submission is being graded; try again in a moment")
    return arrived.join(known, "student_id", "left").join(grading, "student_id", "left").withColumn("error", error).drop("_known", "_busy")


def replace_submissions(submissions: DataFrame, grades: DataFrame, arrived: DataFrame, people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(submissions, grades) after ``arrived``: one submission a student, the newest, and no grade of what it replaces.

    What comes from students who are not enrolled is left out.
    """
    sound = arrived.join(people.select("student_id").distinct(), "student_id", "left_semi")
    return V.replaced(submissions, sound), grades.join(sound.select("student_id").distinct(), "student_id", "left_anti")


def move_students(submissions: DataFrame, grades: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables under the new ids, all at once; removed students lose both."""
    return V.moved(submissions, ids), V.moved(grades, ids)


def total_points(rubric: Column, answer_key: Column) -> Column:
    return V.points(rubric) + V.points(answer_key)


def stamped(grades: DataFrame, version: Column, total: Column, at: Column) -> DataFrame:
    """Grades as they are saved: with the assignment's version, what it was out of, and when."""
    return grades.withColumns({"assignment_version": version, "total_points": total, "graded_at": at})


def outcome(status: Column, reason: Column, failed: Column, reply_leaks: Column, raw_score: Column) -> Column:
    """struct(status, reason, score) of a graded submission.

    ``status``, ``reason``: of the routing; ``failed``: message of a failed call, or null; ``reply_leaks``: kinds of leaks in the reply.
    """
    made = lambda s, r, score: F.struct(F.lit(s).alias("status"), r.cast("string").alias("reason"), score.cast("long").alias("score"))
    nothing = F.lit(None)
    return (
        F.when(status == "manual", made("manual", reason, nothing))
        .when(failed.isNotNull(), made("error", failed, nothing))
        .when(F.size(reply_leaks) > 0, made("manual", F.lit("Agent output contained a student identifier."), nothing))
        .otherwise(made("pending", reason, raw_score))
    )


def lowest_confidence(confidences: Column) -> Column:
    """Of what was kept; null if nothing was read."""
    return F.array_min(confidences)


def teacher_of(roster: DataFrame, place: str) -> DataFrame:
    """The first teacher, or no row."""
    others = [c for c in roster.columns if c != place]
    return roster.where(F.col("role") == "teacher").groupBy().agg(F.min_by(F.struct(*others), place).alias("t")).where("t is not null").select("t.*")


def student_in_view(people: DataFrame, place: str) -> DataFrame:
    """The student that the student view opens: the first marked one, else the first."""
    chosen = F.struct((~F.coalesce(F.col("student_view"), F.lit(False))).alias("m"), F.col(place).alias("p"))
    return people.groupBy().agg(F.min_by(F.struct("student_id", "first_name", "last_name"), chosen).alias("s")).where("s is not null").select("s.*")


def one_in_view(people: DataFrame, place: str) -> DataFrame:
    """``people`` with student_view true for exactly one of them. The one row is found by partial aggregation and joined back by its place."""
    marked = F.coalesce(F.col("student_view"), F.lit(False))
    chosen = people.agg(F.coalesce(F.min(F.when(marked, F.col(place))), F.min(place)).alias("_chosen"))
    at = chosen.first()[0]
    return people.withColumn("student_view", F.col(place).eqNullSafe(F.lit(at)) if at is not None else F.lit(False))


def assignment_summary(assignments: DataFrame) -> DataFrame:
    """title, deadline, version and total_points."""
    keys = [c for c in assignments.columns if c not in ("title", "prompt", "deadline", "version", "rubric", "answer_key")]
    return assignments.select(*keys, "title", "deadline", "version", total_points(F.col("rubric"), F.col("answer_key")).alias("total_points"))


def name_of(first: Column, last: Column) -> Column:
    return F.when(first.isNotNull() | last.isNotNull(), F.struct(first.alias("first_name"), last.alias("last_name")))


def preview_kind(extension: Column) -> Column:
    """image or pdf where a file can be shown, else null."""
    kinds = F.create_map(*[F.lit(v) for k, kind in PREVIEW_TYPES.items() for v in (k, "image" if kind.startswith("image/") else "pdf")])
    return kinds[F.lower(extension)]


def read_text(text: Column, confidence: Column, unreadable: Column, skipped: Column, error: Column) -> Column:
    """struct of what a view tells of a submission's text; after an error, of the error alone."""
    fine = error.isNull()
    return F.struct(
        F.when(fine, text).alias("text"),
        F.when(fine, confidence.isNotNull()).alias("ocr"),
        F.when(fine, V.weak_ocr(confidence, unreadable)).alias("weak_ocr"),
        F.when(fine, skipped).alias("skipped_images"),
        error.alias("text_error"),
    )


def submission_detail(student: Column, people: DataFrame, submissions: DataFrame, grades: DataFrame, busy: DataFrame, version: int, current_total: int) -> DataFrame:
    """What a teacher sees of one student: no row for an unknown one."""
    one = lambda df: df.where(F.col("student_id") == student)
    return V.gradebook(one(people), one(submissions), one(grades), one(busy), version, current_total)


def student_pages(people: DataFrame, submissions: DataFrame, grades: DataFrame, current_total: int) -> DataFrame:
    """What students see: their state, and a score, what it is out of and feedback only once it is final."""
    joined = people.join(submissions, "student_id", "left").join(grades, "student_id", "left")
    final = F.coalesce(F.col("status") == "final", F.lit(False)) & F.col("submitted_at").isNotNull()
    total = V.grade_total(F.col("total_points"), F.coalesce(F.col("has_rubric"), F.lit(False)), F.col("own_points"), F.lit(current_total))
    return joined.select(
        *people.columns,
        V.student_view(F.col("status"), F.col("submitted_at").isNotNull()).alias("state"),
        F.when(final, F.struct(F.col("score"), total.alias("total_points"))).alias("grade"),
    )


def shown_questions(answer_key: Column) -> Column:
    """Questions and their points: expected answers and methods never reach a student."""
    return F.transform(answer_key, lambda x: F.struct(x["question"].alias("question"), x["max_points"].alias("max_points")))


def regrade_requests(requests: DataFrame, submissions: DataFrame, busy: DataFrame) -> DataFrame:
    """``requests`` (student_id) with the status of asking for one grading, final grades included: 404 without submission, 409 while grading, 202."""
    there = submissions.select("student_id", F.lit(True).alias("_there")).distinct()
    grading = busy.select("student_id", F.lit(True).alias("_busy")).distinct()
    code = F.when(F.col("_there").isNull(), 404).when(F.col("_busy"), 409).otherwise(202)
    return requests.join(there, "student_id", "left").join(grading, "student_id", "left").withColumn("code", code).drop("_there", "_busy")


def outdated_after(grades: DataFrame, version: Column) -> DataFrame:
    """One row: the grades, enrolled or not, that a new version of the assignment leaves outdated."""
    return grades.agg(F.count_if(V.is_stale(F.col("has_rubric"), F.col("assignment_version"), version)).alias("outdated"))


def book_totals(book: DataFrame) -> DataFrame:
    """One row over a grade book: outdated rows that are not being graded, whether any is, and all points."""
    grading = F.col("status") == "grading"
    return book.agg(
        F.count_if(F.col("stale") & ~grading).alias("outdated"), F.coalesce(F.bool_or(grading), F.lit(False)).alias("busy"), F.coalesce(F.sum("total_points"), F.lit(0)).cast("long").alias("points")
    )


def queue_size(submissions: DataFrame, people: DataFrame, grades: DataFrame, busy: DataFrame) -> DataFrame:
    return V.ungraded_queue(submissions, people, grades, busy).agg(F.count(F.lit(1)).alias("queued"))


def shuffled(rows: DataFrame, seed: int) -> DataFrame:
    """In an order that tells nothing of the rows."""
    return rows.orderBy(F.rand(seed))


def with_token(rows: DataFrame) -> DataFrame:
    """A random token a row. Save the rows before they are used twice: every evaluation draws again."""
    return rows.withColumn("token", F.uuid())


def text_error(value: Column, name: str, most: int, required: bool = True) -> Column:
    """What is wrong with a text field, or null."""
    trimmed = F.coalesce(X.trimmed(value), F.lit(""))
    error = F.when(F.length(trimmed) > most, f"{name} must be at most {most} characters")
    return F.when(trimmed == "", f"{name} is required").otherwise(error) if required else error


def whole_error(value: Column, name: str, least: int, most: int) -> Column:
    """What is wrong with a whole number, or null."""
    number = value.cast("double")
    sound = F.coalesce((number == F.floor(number)) & number.between(least, most), F.lit(False))
    return F.when(~sound, f"{name} must be a whole number from {least} to {most}")


def local_input(at: Column, minutes: Column) -> Column:
    """A time of a zone so many minutes off UTC as an input field takes it."""
    return F.date_format(at + F.make_dt_interval(F.lit(0), F.lit(0), minutes, F.lit(0)), "yyyy-MM-dd'T'HH:mm")


def shown_time(at: Column) -> Column:
    return F.date_format(at, "MMM d, yyyy, h:mm a")
