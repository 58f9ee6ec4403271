"""Readers of the review tables, with explicit types: ids stay strings, missing files are empty tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillsift.functions import text as X

PERSON = "role string, studentId string, firstName string, lastName string, email string, studentView boolean"
SUBMISSION = "studentId string, file string, submittedAt timestamp"
_ITEM = "array<struct<criterion: string, maxPoints: int, description: string>>"
_KEY = "array<struct<question: string, maxPoints: int, answer: string, method: string>>"
ASSIGNMENT = f"title string, prompt string, deadline timestamp, version int, rubric {_ITEM}, answerKey {_KEY}"
_SCORED = "array<struct<criterion: string, points: int, maxPoints: int, comment: string>>"
_ANSWERS = "array<struct<question: string, points: int, maxPoints: int, answer: string, method: string, comment: string>>"
GRADE = (
    f"status string, reason string, rubric {_SCORED}, answers {_ANSWERS}, feedback string, rawScore int, score int, model string, sessionId string, "
    "agentView struct<token: string, text: string>, assignmentVersion int, totalPoints int, gradedAt timestamp, approvedAt timestamp"
)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, PERSON)


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, SUBMISSION)


def read_assignment(spark: SparkSession, path: str) -> DataFrame:
    """Version 1 and an empty answer key where there is none."""
    raw = read_json(spark, path, ASSIGNMENT)
    return raw.withColumns({"version": F.coalesce("version", F.lit(1)), "answerKey": F.coalesce("answerKey", F.array().cast(raw.schema["answerKey"].dataType))})


def read_grades(spark: SparkSession, path: str) -> DataFrame:
    """One row a student of a document that maps student ids to grades; a missing file has none."""
    schema = f"studentId string, {GRADE}"
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    grades = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", T.MapType(T.StringType(), T.StructType.fromDDL(GRADE)))).alias("studentId", "grade"))
    return grades.select("studentId", "grade.*")


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """file, content, length of every file under a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content", "length")


def extension(file: Column) -> Column:
    return F.lower(F.regexp_extract(file, r"[^/.](\.[^./]*)\z", 1))


def parsed_uploads(uploads: DataFrame) -> DataFrame:
    """(text, file_name, file_base64) rows with ext, content and error: a pasted text wins and becomes .txt."""
    # What may be uploaded, and how much.
    types = (".txt", ".md", ".docx", ".doc", ".pdf", ".pptx", ".ppt", ".png", ".jpg", ".jpeg")
    largest = 15 * 1024 * 1024
    essay = X.trimmed(F.col("text"))
    pasted = F.coalesce(essay != "", F.lit(False))
    filed = F.col("file_name").isNotNull() & F.col("file_base64").isNotNull()
    out = uploads.withColumn("ext", F.when(pasted, F.lit(".txt")).when(filed, extension(F.col("file_name"))))
    out = out.withColumn("content", F.when(pasted, F.encode(essay, "utf-8")).when(filed, F.expr("try_to_binary(file_base64, 'base64')")))
    error = (
        F.when(~pasted & ~filed, "paste your essay or choose a file")
        .when(~F.col("ext").isin(*types), "file must be one of " + ", ".join(types))
        .when(F.octet_length("content") > largest, "file is larger than 15 MB")
        .when(F.col("content").isNull(), "could not read that file")
    )
    return out.withColumn("error", error)
