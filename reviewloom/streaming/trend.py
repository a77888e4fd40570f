"""The weekly trend over a stream of reviews (an extension: the product is batch only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.operators.analytics import stars


def first_seen(stream: DataFrame, lateness: str = "7 days") -> DataFrame:
    """Reviews of a stream, each id once within the lateness; rows without an id or a time are left out."""
    rows = stream.filter("reviewId <> '' and at is not null")
    return rows.withWatermark("at", lateness).dropDuplicatesWithinWatermark(["reviewId"])


def weekly_trend(stream: DataFrame, lateness: str = "7 days") -> DataFrame:
    """(week, n, avg_rating) of a stream of scraped reviews; weeks begin on Mondays, later rows are dropped once a week is final."""
    s = stars(F.col("score").cast("string"))
    week = F.window("at", "7 days", startTime="4 days")  # the epoch was a Thursday
    grouped = stream.withWatermark("at", lateness).filter("at is not null").groupBy(week.alias("w")).agg(F.count(s).alias("n"), F.avg(F.when(s.between(1, 5), s)).alias("avg_rating"))
    return grouped.select(F.col("w.start").cast("date").alias("week"), "n", F.coalesce(F.round("avg_rating", 2), F.lit(0.0)).alias("avg_rating"))
