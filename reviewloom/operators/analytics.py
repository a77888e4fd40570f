"""Weekly insight aggregates over clean reviews and theme members.

Inputs: reviews (CLEAN_REVIEW with ``seq``), members (theme_id, review_id, pos), themes (theme_id, label, rank, is_top_3).
Nulls: a rating that is no whole number counts as missing, a date that is none leaves the row out of the trend, null and
empty versions are "not reported". Empty tables give empty results, or zeros where a fixed set of rows is reported.
Shares and means are 0.0 where there is nothing to divide by. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.config import DEFAULTS, EngineConfig

#: Names of the funnel's stages, in order.
FUNNEL_STAGES = ("fetched", "cleaned", "chunked", "in a theme", "outliers")


def stars(rating: Column) -> Column:
    """The rating as a whole number, else null; values outside 1 to 5 are kept for the caller to judge."""
    return F.when(F.trim(rating).rlike(r"^[+-]?[0-9]+$"), F.trim(rating).try_cast("int"))


def valid_stars(rating: Column) -> Column:
    s = stars(rating)
    return F.when(s.between(1, 5), s)


def review_day(date: Column) -> Column:
    day = F.substring(date, 1, 10)
    return F.when(day.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), day.try_cast("date"))


def pct(part: Column, whole: Column) -> Column:
    """Percentage to one digit, half to even; 0.0 of nothing."""
    return F.coalesce(F.bround(part * 100.0 / F.nullif(whole, F.lit(0)), 1), F.lit(0.0))


def mean2(column: Column) -> Column:
    return F.coalesce(F.round(F.avg(column), 2), F.lit(0.0))


def insights(raw: DataFrame, reviews: DataFrame, chunks: DataFrame, members: DataFrame, themes: DataFrame, fees: DataFrame, cfg: EngineConfig = DEFAULTS) -> dict:
    """All figures of a report in one bundle, ready for JSON: each is a table of one row a stage, star, week, version, theme or quote.

    themes: (theme_id, label); fees: the reviews about fees.
    """
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    named = theme_breakdown(members, reviews).join(themes.select("theme_id", "label"), "theme_id", "left").orderBy("rank")
    found = {
        "funnel": rows(funnel(raw, reviews, chunks, members).orderBy("position")), "ratings": rows(rating_distribution(reviews).orderBy("stars")), "summary": rows(rating_summary(reviews))[0],
        "trend": rows(weekly_change(reviews).orderBy("week")), "versions": rows(version_breakdown(reviews).orderBy("position")), "themes": rows(named),
        "quotes": rows(top_quotes(reviews, cfg)), "fees": rows(fee_stats(fees, reviews))[0],
    }
    found["worst_theme"] = min(found["themes"], key=lambda t: (t["avg_rating"], t["rank"]), default=None)
    found["largest_theme"] = found["themes"][0] if found["themes"] else None
    return found


def weekly_trend(reviews: DataFrame) -> DataFrame:
    """Weeks (their Monday) with the number of parsable ratings, out-of-range ones included, and the mean of those in 1..5."""
    r = reviews.select(review_day(F.col("date")).alias("d"), stars(F.col("rating")).alias("s")).filter("d is not null")
    return r.groupBy(F.date_trunc("week", "d").cast("date").alias("week")).agg(F.count("s").alias("n"), mean2(F.when(F.col("s").between(1, 5), F.col("s"))).alias("avg_rating"))


def weekly_change(reviews: DataFrame) -> DataFrame:
    """The trend with its change from the week before (an extension: the product reports the series only).

    The window runs over one row a week.
    """
    by_week = Window.partitionBy().orderBy("week")
    return weekly_trend(reviews).withColumn("n_change", F.col("n") - F.lag("n").over(by_week))


def rating_distribution(reviews: DataFrame) -> DataFrame:
    """All five buckets, whether they occur or not: (stars, n, pct)."""
    counted = reviews.select(valid_stars(F.col("rating")).alias("stars")).filter("stars is not null").groupBy("stars").agg(F.count("*").alias("n"))
    five = reviews.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("stars"))
    return five.join(counted, "stars", "left").select("stars", F.coalesce("n", F.lit(0)).alias("n")).withColumn("pct", pct(F.col("n"), F.sum("n").over(Window.partitionBy())))


def rating_summary(reviews: DataFrame) -> DataFrame:
    """One row: total, average, negative_count, negative_pct of the valid ratings."""
    s = reviews.select(valid_stars(F.col("rating")).alias("s"))
    negative = F.count_if(F.col("s") <= 2)
    return s.agg(F.count("s").alias("total"), mean2(F.col("s")).alias("average"), negative.alias("negative_count"), pct(negative, F.count("s")).alias("negative_pct"))


def version_breakdown(reviews: DataFrame, cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """Versions with enough valid ratings, most rated first; position breaks ties by first appearance."""
    r = reviews.select(F.nullif(F.col("app_version"), F.lit("")).alias("version"), valid_stars(F.col("rating")).alias("s"), "seq").filter("version is not null and s is not null")
    grouped = r.groupBy("version").agg(F.count("*").alias("n"), mean2(F.col("s")).alias("avg_rating"), pct(F.count_if(F.col("s") <= 2), F.count("*")).alias("negative_pct"), F.min("seq").alias("first_seq"))
    kept = grouped.filter(F.col("n") >= cfg.version_floor)
    return kept.withColumn("position", F.row_number().over(Window.partitionBy().orderBy(F.desc("n"), "first_seq"))).drop("first_seq")


def top_quotes(reviews: DataFrame, cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """The negative reviews with most thumbs; the limit comes before blank texts are dropped, so there may be fewer rows."""
    r = reviews.select("seq", "original_text", "cleaned_text", "date", valid_stars(F.col("rating")).alias("stars"), F.coalesce("thumbs_up_count", F.lit(0)).alias("thumbs_up"))
    top = r.filter("stars <= 2").orderBy(F.desc("thumbs_up"), "seq").limit(cfg.top_quotes)
    return top.filter("coalesce(original_text, '') <> '' or coalesce(cleaned_text, '') <> ''").select("seq", F.coalesce("original_text", "cleaned_text").alias("text"), "stars", "thumbs_up", "date")


def latest_by_id(reviews: DataFrame) -> DataFrame:
    """One row for each review_id, the last by ``seq``, with the columns the theme metrics need."""
    picked = F.max_by(F.struct("rating", "thumbs_up_count", "original_text", "cleaned_text"), "seq").alias("r")
    return reviews.filter("review_id is not null").groupBy("review_id").agg(picked, F.max("seq").alias("seq")).select("review_id", "seq", "r.*")


def theme_breakdown(members: DataFrame, reviews: DataFrame) -> DataFrame:
    """Themes by size: members include ids without a review; ratings and thumbs are of those with one.

    Members (theme_id >= 0; -1 is no theme) are joined with the last review of each id; equal sizes rank by theme_id.
    """
    themed = members.filter("theme_id >= 0")
    found = latest_by_id(reviews).withColumn("found", F.lit(True))
    s = valid_stars(F.col("rating"))
    rows = themed.join(found, "review_id", "left").withColumn("s", s)
    grouped = rows.groupBy("theme_id").agg(
        F.count("*").alias("n"), mean2(F.col("s")).alias("avg_rating"), pct(F.count_if(F.col("s") <= 2), F.count("s")).alias("negative_pct"),
        F.coalesce(F.sum(F.coalesce("thumbs_up_count", F.lit(0))), F.lit(0)).alias("thumbs_up"),
    )
    everything, by_size = Window.partitionBy(), Window.partitionBy().orderBy(F.desc("n"), "theme_id")
    ranked = grouped.withColumn("share_pct", pct(F.col("n"), F.sum("n").over(everything))).withColumn("rank", F.row_number().over(by_size))
    return ranked.withColumn("is_top_3", F.col("rank") <= 3)


def worst_theme(members: DataFrame, reviews: DataFrame) -> DataFrame:
    """The theme of lowest mean rating; one without ratings has 0.0 and therefore wins; ties go to the better rank."""
    return theme_breakdown(members, reviews).orderBy("avg_rating", "rank").limit(1).select("theme_id", "n", "avg_rating")


def largest_theme(members: DataFrame, reviews: DataFrame) -> DataFrame:
    return theme_breakdown(members, reviews).orderBy("rank").limit(1).select("theme_id", "n", "share_pct")


def funnel(raw: DataFrame, cleaned: DataFrame, chunks: DataFrame, members: DataFrame) -> DataFrame:
    """Five fixed rows in order: (position, stage, n, pct_of_raw)."""
    counts = (
        raw.agg(F.count("*").alias("c1"))
        .crossJoin(cleaned.agg(F.count("*").alias("c2"))).crossJoin(chunks.agg(F.count("*").alias("c3")))
        .crossJoin(members.agg(F.count_if(F.col("theme_id") >= 0).alias("c4"), F.count_if(F.col("theme_id") < 0).alias("c5")))
    )  # five one-row aggregates side by side
    stacked = ", ".join(f"{i}, '{name}', c{i}, c1" for i, name in enumerate(FUNNEL_STAGES, 1))
    rows = counts.select(F.expr(f"stack(5, {stacked}) as (position, stage, n, raw)"))
    return rows.select("position", "stage", "n", pct(F.col("n"), F.col("raw")).alias("pct_of_raw"))


def fee_stats(fee_reviews: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row: n, pct_of_corpus, avg_rating of the reviews about fees."""
    fees = fee_reviews.agg(F.count("*").alias("n"), mean2(valid_stars(F.col("rating"))).alias("avg_rating"))
    return fees.crossJoin(reviews.agg(F.count("*").alias("corpus"))).select("n", pct(F.col("n"), F.col("corpus")).alias("pct_of_corpus"), "avg_rating")
