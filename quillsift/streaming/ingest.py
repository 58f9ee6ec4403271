"""Extension: submissions as a stream. The reference semantics have no streams; this applies the batch
operators to each micro-batch, so that results are those of the batch queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillsift.operators.leaks import leaks
from quillsift.operators.redaction import redacted
from quillsift.operators.roster import Roster


def redacted_stream(submissions: DataFrame, roster: Roster, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """Each submission once (repeats within ``late`` are dropped), redacted, with its leaks. Stateless but for that."""
    once = submissions.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
    return leaks(redacted(once, roster), roster, text="redacted").drop("text")


def arrivals(submissions: DataFrame, at: str, every: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Submissions that arrived in each window."""
    return submissions.withWatermark(at, late).groupBy(F.window(at, every)).agg(F.count(F.lit(1)).alias("submissions"))


def start_log(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream to a log in Parquet, each batch exactly once."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
