"""Streaming forms. The batch semantics have no late data; watermarks here are this library's own choice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.fingerprint import line_features


def features(stream: DataFrame) -> DataFrame:
    """Features of a stream of lines; stateless."""
    return line_features(stream)


def act_counts(stream: DataFrame, late: str = "30 days", window: str = "1 day") -> DataFrame:
    """Speech acts by day of captured_at and period, updated as lines arrive; lines later than `late` are left out by the watermark.

    Lines stored twice (same line_uid) count once within the watermark.
    """
    once = stream.withWatermark("captured_at", late).dropDuplicatesWithinWatermark(["line_uid"])
    acts = once.select("captured_at", T.missing("phase").alias("phase"), F.explode("speech_acts").alias("a"))
    return acts.groupBy(F.window("captured_at", window), "phase", F.col("a.type").alias("act")).agg(F.count(F.lit(1)).alias("n"))
