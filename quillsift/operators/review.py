"""Review state as an append-only log of events and views of its latest rows; scores; the grade book.

A table is never rewritten in place: a change is an event with a rising ``seq``, a deletion a tombstone,
and the state of a key its event of the largest ``seq``. Finding it is one aggregation (max_by), with
partial results before the shuffle and no sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.functions import text as X

OCR_LEAST_CONFIDENCE = 75
LEAST_IMAGE_WORDS, LOGO_PIXELS, ICON_PIXELS = 2, 400, 100
OPEN_STATES = ("pending", "manual", "error")


def latest(events: DataFrame, key: str, seq: str = "seq", deleted: str = "deleted") -> DataFrame:
    """The last event of every key, unless it is a tombstone."""
    others = [c for c in events.columns if c != key]
    last = events.groupBy(key).agg(F.max_by(F.struct(*others), F.col(seq)).alias("_last"))
    return last.select(key, "_last.*").where(~F.coalesce(F.col(deleted), F.lit(False)))


def students(roster: DataFrame) -> DataFrame:
    """Everybody but teachers; a missing role is a student's."""
    return roster.where(~F.col("role").eqNullSafe("teacher"))


def weak_ocr(confidence: Column, unreadable: Column) -> Column:
    """No confidence means that nothing was read from an image, which is not weak."""
    return (F.coalesce(unreadable, F.lit(0)) > 0) | F.coalesce(confidence < OCR_LEAST_CONFIDENCE, F.lit(False))


def route(confidence: Column, unreadable: Column, leak_kinds: Column, skipped: Column) -> Column:
    """struct(status, reason) of a submission: fail closed, in this order."""
    reason = lambda status, text: F.struct(F.lit(status).alias("status"), text.cast("string").alias("reason"))
    kinds = F.array_join(F.array_distinct(leak_kinds), ", ")
    return (
        F.when(F.coalesce(unreadable, F.lit(0)) > 0, reason("manual", F.concat(unreadable.cast("string"), F.lit(" photographed passage(s) couldn't be read confidently; not sent to the agent."))))
        .when(weak_ocr(confidence, unreadable), reason("manual", F.concat(F.lit("Text was read by OCR with low confidence ("), F.round(confidence).cast("long").cast("string"), F.lit("%); not sent to the agent."))))
        .when(F.size(leak_kinds) > 0, reason("manual", F.concat(F.lit("Identifiers survived redaction ("), kinds, F.lit("); not sent to the agent."))))
        .when(skipped > 0, reason("send", F.concat(skipped.cast("string"), F.lit(" image(s) couldn't be read and were left out of what the agent graded. Check the original."))))
        .otherwise(reason("send", F.lit(None)))
    )


def payload(df: DataFrame, token: str = "token", text: str = "text") -> DataFrame:
    """Exactly token and text, both non-empty strings; anything else fails the query."""
    sound = lambda c: F.when(F.length(F.col(c)) > 0, F.col(c)).otherwise(F.raise_error(F.lit(f"payload field {c} must be a non-empty string")))
    return df.select(sound(token).alias("token"), sound(text).alias("text"))


def image_verdict(words: Column, confidence: Column, uses: Column, longer_side: Column, writing: Column) -> Column:
    """What becomes of an embedded image that was read; one that was not (null words) is skipped."""
    return (
        F.when(words.isNull(), "skipped")
        .when((words >= LEAST_IMAGE_WORDS) & (confidence >= OCR_LEAST_CONFIDENCE), "kept")
        .when((words < LEAST_IMAGE_WORDS) & ((uses > 1) | (longer_side <= LOGO_PIXELS)), "dropped")
        .when(writing, "unreadable")
        .otherwise("skipped")
    )


def distinct_images(images: DataFrame, document: str, content: str, order: str, width: str, height: str) -> DataFrame:
    """One row a document and image: uses and first place; icons are left out."""
    return (
        images.where(F.greatest(width, height) > ICON_PIXELS)
        .groupBy(document, F.sha2(content, 256).alias("digest"))
        .agg(F.count(F.lit(1)).alias("uses"), F.min(order).alias("first_place"))
    )


def points(items: Column) -> Column:
    """Sum of the largest points of an array of items; none counts nothing."""
    return F.coalesce(F.aggregate(items, F.lit(0).cast("long"), lambda s, x: s + x["max_points"]), F.lit(0).cast("long"))


def clamped(value: Column, most: Column) -> Column:
    """Points rounded half up and held to 0..most; no finite number fails the query."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(finite, F.greatest(F.lit(0), F.least(most, F.floor(value + 0.5)))).otherwise(F.raise_error(F.lit("missing score"))).cast("long")


def grade_total(stored: Column, has_rubric: Column, own: Column, current: Column) -> Column:
    """What a grade is out of: stored, else its own items, else the current assignment. A stored 0 is none."""
    return F.when(stored > 0, stored).when(has_rubric, own).otherwise(current)


def is_stale(has_rubric: Column, version: Column, current: Column) -> Column:
    """Graded against another version. A grade without rubric is never stale."""
    return F.coalesce(has_rubric, F.lit(False)) & (F.coalesce(version, F.lit(1)) != current)


def status_of(submitted: Column, in_progress: Column, status: Column) -> Column:
    return F.when(~submitted, "missing").when(in_progress, "grading").otherwise(F.coalesce(status, F.lit("ungraded")))


def score_items(rubric: DataFrame, reply: DataFrame, grade: str = "grade_id", item: str = "item") -> DataFrame:
    """Items ⟕ a reply's items by name; of repeated names the last counts, unknown ones are dropped.

    ``rubric``: (grade, item, max_points); ``reply``: (grade, item, place, points).
    """
    last = reply.groupBy(grade, item).agg(F.max_by("points", "place").alias("points"))
    return rubric.join(last, [grade, item], "left").withColumn("points", clamped(F.col("points").cast("double"), F.col("max_points")))


def approved(grades: DataFrame, override: str = "override", total: str = "total") -> DataFrame:
    """Open grades whose score (the override, if there is one) is within 0..total become final."""
    score = F.coalesce(F.col(override).cast("double"), F.col("score").cast("double"))
    sound = F.col("status").isin(*OPEN_STATES) & score.isNotNull() & ~F.isnan(score) & (score >= 0) & (score <= F.col(total))
    return grades.where(sound).withColumn("score", F.floor(score + 0.5).cast("long")).withColumn("status", F.lit("final"))


def gradebook(people: DataFrame, submissions: DataFrame, grades: DataFrame, busy: DataFrame, version: int, current_total: int) -> DataFrame:
    """Students ⟕ submissions ⟕ grades: status, staleness and what the grade is out of."""
    joined = (
        people.join(submissions, "student_id", "left")
        .join(grades, "student_id", "left")
        .join(busy.select("student_id", F.lit(True).alias("busy")).distinct(), "student_id", "left")
    )
    has_rubric = F.coalesce(F.col("has_rubric"), F.lit(False))
    return joined.select(
        *people.columns,
        "submitted_at",
        status_of(F.col("submitted_at").isNotNull(), F.coalesce(F.col("busy"), F.lit(False)), F.col("status")).alias("status"),
        is_stale(has_rubric, F.col("assignment_version"), F.lit(version)).alias("stale"),
        F.when(F.col("status").isNotNull(), grade_total(F.col("total_points"), has_rubric, F.col("own_points"), F.lit(current_total))).alias("total_points"),
        "score",
    )


def ungraded_queue(submissions: DataFrame, people: DataFrame, grades: DataFrame, busy: DataFrame) -> DataFrame:
    """Submissions of enrolled students that are neither final nor being graded."""
    closed = grades.where("status = 'final'").select("student_id").union(busy.select("student_id"))
    return submissions.join(people, "student_id", "left_semi").join(closed, "student_id", "left_anti")


def submission_flags(people: DataFrame, submissions: DataFrame) -> DataFrame:
    marked = submissions.select("student_id", F.lit(True).alias("has_submission")).distinct()
    return people.join(marked, "student_id", "left").withColumn("has_submission", F.coalesce("has_submission", F.lit(False)))


def moved(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows under their new ids, all at once, so that swaps are safe; rows of removed students go.

    ``ids``: (original_id, new_id).
    """
    others = [c for c in rows.columns if c != "student_id"]
    return rows.join(ids, F.col("student_id") == F.col("original_id")).select(F.col("new_id").alias("student_id"), *others)


def replaced(submissions: DataFrame, arrived: DataFrame) -> DataFrame:
    """One submission a student: what arrived takes the place of what was there."""
    return submissions.join(arrived, "student_id", "left_anti").unionByName(arrived)


def student_view(status: Column, submitted: Column) -> Column:
    return F.when(~submitted, "not_submitted").when(status == "final", "graded").otherwise("submitted")


def _repeated(checked: DataFrame, value: Column, flag: str) -> DataFrame:
    """``checked`` with whether the value of a row stands in other rows too. Missing values are never compared, however many there are."""
    key = f"_{flag}_key"
    several = checked.select(value.alias(key)).where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key, F.lit(True).alias(flag))
    return checked.join(several, value == F.col(key), "left").drop(key)


def roster_violations(people: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """``people`` with the array of rules that a row breaks (role, student_id, first_name, last_name, email, original_id).

    Fields count without white space at their ends. ``roster_size_error`` has the rule on the number of rows.
    """
    name = r"^\p{L}[\p{L}\p{M}'’. -]*\z"
    first, last, email, student = X.trimmed(F.col("first_name")), X.trimmed(F.col("last_name")), F.lower(X.trimmed(F.col("email"))), X.trimmed(F.col("student_id"))
    teacher = F.col("role").eqNullSafe("teacher")
    checked = _repeated(_repeated(people, student, "_same_id"), email, "_same_email")
    rules = {
        "name_required": F.coalesce((first == "") | (last == ""), F.lit(True)),
        "name_length": F.coalesce((F.length(first) > 60) | (F.length(last) > 60), F.lit(False)),
        "name_letters": ~(first.rlike(name) & last.rlike(name)),
        "email_invalid": ~email.rlike(r"^[^\s@,;<>]+@[^\s@,;<>]+\.[^\s@,;<>]+\z") | (F.length(email) > 254),
        "id_digits": ~teacher & ~F.coalesce(student, F.lit("")).rlike(r"^[0-9]{7,12}\z"),
        "duplicate_id": F.col("_same_id").isNotNull(),
        "duplicate_email": F.col("_same_email").isNotNull(),
    }
    if existing is not None:
        known = existing.select(F.col("student_id").alias("_known_id")).distinct()
        checked = _repeated(checked.join(known, F.col("original_id") == F.col("_known_id"), "left"), F.col("original_id"), "_same_original")
        rules["unknown_original"] = F.col("original_id").isNotNull() & (F.col("_known_id").isNull() | F.col("_same_original").isNotNull())
    broken = F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit(True)), F.lit(k)) for k, v in rules.items()]))
    return checked.withColumn("violations", broken).select(*people.columns, "violations")


def roster_size_error(people: DataFrame, most: int = 500) -> DataFrame:
    """One row: what is wrong with the number of students, or null."""
    n = F.count(F.lit(1))
    return students(people).agg(F.when((n < 1) | (n > most), f"the roster needs 1 to {most} students").alias("error"))


def assignment_violations(assignments: DataFrame) -> DataFrame:
    """``assignments`` (title, prompt, deadline, rubric, answer_key) with the array of rules that a row breaks."""
    size = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0))
    missing = lambda c, most: F.coalesce(X.trimmed(F.col(c)) == "", F.lit(True)) | (F.length(X.trimmed(F.col(c))) > most)
    item = lambda x, name, most: F.coalesce(X.trimmed(x[name]) == "", F.lit(True)) | (F.length(X.trimmed(x[name])) > most)
    span = lambda x: ~F.coalesce(x["max_points"].between(1, 1000), F.lit(False))
    names = F.transform("rubric", lambda x: F.lower(X.trimmed(x["criterion"])))
    rules = {
        "deadline": F.try_to_timestamp("deadline").isNull(),
        "rubric_size": size("rubric") > 20,
        "answer_key_size": size("answer_key") > 50,
        "no_items": (size("rubric") == 0) & (size("answer_key") == 0),
        "criterion": F.exists("rubric", lambda x: item(x, "criterion", 60) | span(x) | item(x, "description", 500)),
        "duplicate_criterion": F.size(F.array_distinct(names)) < F.size(names),
        "question": F.exists("answer_key", lambda x: item(x, "question", 1000) | span(x) | item(x, "answer", 2000) | (F.length(x["method"]) > 2000)),
        "title": missing("title", 200),
        "prompt": missing("prompt", 5000),
    }
    return assignments.withColumn("violations", F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in rules.items()])))
