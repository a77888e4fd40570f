"""Ingest and cleaning of scraped reviews (SCRAPED to CLEAN_REVIEW)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.config import DEFAULTS, EngineConfig
from reviewloom.functions import text as T
from reviewloom.staging import spread, stage

#: Why a review is dropped, in the order the checks are made.
REASONS = ("empty", "non_english", "short")


def map_review(scraped: DataFrame) -> DataFrame:
    """Scraped fields renamed, with the product's defaults for missing ones; the date as text, empty if there is none."""
    blank, zero = F.lit(""), F.lit(0)
    return scraped.select(
        "seq", F.coalesce("reviewId", blank).alias("review_id"), F.coalesce("userName", blank).alias("author_name"), F.coalesce("content", blank).alias("text"),
        F.coalesce("score", zero).alias("star_rating"), F.coalesce(F.date_format("at", "yyyy-MM-dd"), blank).alias("date"),
        F.coalesce("thumbsUpCount", zero).alias("thumbs_up_count"), F.coalesce("appVersion", blank).alias("app_version"),
    )


def in_window(scraped: DataFrame, start: str, end: str | None = None) -> DataFrame:
    """Rows from ``start`` on (a row without a time counts as inside), and before the day after ``end`` if it is enforced."""
    inside = F.col("at").isNull() | (F.col("at") >= F.lit(start).cast("timestamp"))
    if end is not None:
        inside &= F.col("at").isNull() | (F.col("at") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp"))
    return scraped.filter(inside)


def fetch(scraped: DataFrame, cfg: EngineConfig = DEFAULTS, end: str | None = None) -> DataFrame:
    """What a fetch of the window gives: rows inside it, the first of each id by ``seq``, none without an id, mapped."""
    rows = in_window(scraped, cfg.window_start, end if cfg.enforce_week_end else None).filter("reviewId <> ''")
    columns = [c for c in rows.columns if c != "reviewId"]
    first = rows.groupBy("reviewId").agg(F.min_by(F.struct(*columns), "seq").alias("r")).select("reviewId", "r.*")
    return map_review(first)


def with_reason(raw: DataFrame, cfg: EngineConfig = DEFAULTS, form: str = "NFKC", english: Column | None = None) -> DataFrame:
    """RAW_REVIEW rows with their processed text and the reason to drop them, null for those kept.

    english: another language predicate over the column ``processed``.
    """
    processed = T.strip_html_urls(T.normalise_unicode(F.coalesce("text", F.lit("")), form))
    reason = lambda p, judged: F.when(p == "", "empty").when(~judged, "non_english").when(F.length(p) < cfg.min_review_length, "short")
    if english is not None:
        return spread(raw).withColumn("processed", processed).withColumn("reason", reason(F.col("processed"), english))
    # Bound as a variable, the processed text is computed once, not once for each place where it is looked at.
    judge = lambda p: F.struct(p.alias("processed"), reason(p, T.is_english(p)).alias("reason"))
    rows = spread(raw).withColumn("_judged", F.element_at(F.transform(F.array(processed), judge), 1))
    return rows.select(*raw.columns, "_judged.processed", "_judged.reason")


def clean(raw: DataFrame, cfg: EngineConfig = DEFAULTS, form: str = "NFKC", english: Column | None = None) -> DataFrame:
    """CLEAN_REVIEW: the kept reviews, their processed text as it is and in lower case."""
    kept = with_reason(raw, cfg, form, english).filter("reason is null")
    return kept.select(
        "seq", "review_id", F.col("processed").alias("original_text"), F.lower("processed").alias("cleaned_text"), F.col("star_rating").alias("rating"),
        "date", "author_name", "thumbs_up_count", "app_version",
    )


def discards(raw: DataFrame, cfg: EngineConfig = DEFAULTS, form: str = "NFKC") -> DataFrame:
    """How many reviews were kept and dropped, by reason; reasons that don't occur have no row."""
    return with_reason(raw, cfg, form).groupBy(F.coalesce("reason", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n"))


def pii_scrub(reviews: DataFrame) -> DataFrame:
    """Both text columns scrubbed, with the number of values of each kind: the greater of the two columns'."""
    original, in_original = T.scrub(F.col("original_text"))
    cleaned, in_cleaned = T.scrub(F.col("cleaned_text"))
    counts = [F.greatest(in_original[k], in_cleaned[k]).alias(f"n_{k}") for k in in_original]
    return spread(reviews.select("seq", "review_id", "original_text", "cleaned_text")).select("seq", "review_id", original.alias("original_text"), cleaned.alias("cleaned_text"), *counts)


def pii_counts(reviews: DataFrame) -> DataFrame:
    """One row: values redacted by kind, and reviews with any."""
    s = pii_scrub(reviews)
    kinds = [c for c in s.columns if c.startswith("n_")]
    anything = sum((F.col(c) for c in kinds), F.lit(0)) > 0
    return s.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in kinds), F.count_if(anything).alias("reviews_with_pii"))


def exact_dedup(reviews: DataFrame) -> DataFrame:
    """The first row by ``seq`` of each review_id; rows without an id are one group, as are those with an empty one."""
    columns = [c for c in reviews.columns if c != "review_id"]
    return reviews.groupBy("review_id").agg(F.min_by(F.struct(*columns), "seq").alias("r")).select("review_id", "r.*").select(*reviews.columns)


def row_numbers(df: DataFrame, order: str, name: str = "row_no") -> DataFrame:
    """Consecutive numbers from 1 in the order of a unique column, without bringing all rows into one task.

    Rows are cut into ranges by range partitioning of the order; each range numbers its own rows and adds the sizes of those before.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = stage(df.repartitionByRange(parts, order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_size"))
    before = Window.partitionBy().orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(order)
    return ranged.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_before") + F.row_number().over(inside)).drop("_range", "_before")
