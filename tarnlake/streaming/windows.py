"""Streaming forms of batch operators, as an extension: monthly sentiment, first-seen comments, and time-limited caches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.sentiment import counts, sign


def monthly(units: DataFrame, late: str = "2 days") -> DataFrame:
    """A28 on a stream: counts by candidate and day within the month; rows later than `late` are left out.

    Calendar months are no fixed windows, so state is kept by day, and months are sums of what has been emitted.
    """
    day = F.window("posted_at", "1 day")
    agg = units.where("candidate IS NOT NULL").withWatermark("posted_at", late).groupBy(day, "candidate").agg(*counts(), F.sum(sign()).cast("long").alias("signed"))
    return agg.select("candidate", F.date_format("window.start", "yyyy-MM").alias("month"), F.col("window.start").alias("day"), "n", "pos", "neg", "neu", "signed")


def first_seen(comments: DataFrame, late: str = "1 day", prefix: int = 200) -> DataFrame:
    """F07 on a stream: comments that pass the basic cut, the first of each beginning within the watermark."""
    kept = comments.withColumn("text", F.trim("text")).where(X.basic_drop("text").isNull())
    return kept.withColumn("beginning", F.substring("text", 1, prefix)).withWatermark("posted_at", late).dropDuplicatesWithinWatermark(["beginning"]).drop("beginning")
