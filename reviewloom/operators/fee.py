"""Reviews about fees and charges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The words of the fee predicate.
FEE_KEYWORDS = (
    "fee", "fees", "charge", "charges", "charged", "charging",
    "brokerage", "commission", "deduction", "deducted", "deduct",
    "hidden", "extra", "cost", "costs", "pricing", "price",
    "transaction", "tax", "taxes", "gst", "stt", "stamp duty",
    "dp charges", "amc", "maintenance", "penalty", "fine",
    "subscription", "premium", "plan", "free", "paid",
    "money deducted", "amount deducted", "unexpected charge",
    "why was i charged", "overcharged", "overcharge",
)


def minimal_keywords() -> list[str]:
    """Keywords that contain no other: any text with a keyword has one of them, so the rest need not be looked for."""
    return [k for k in FEE_KEYWORDS if not any(o != k and o in k for o in FEE_KEYWORDS)]


def mentions_fee(text: Column, whole_words: bool = False) -> Column:
    """Whether a keyword occurs anywhere in the text ("coffee" has "fee"), or as whole words if asked; null is no."""
    words = "|".join(FEE_KEYWORDS if whole_words else minimal_keywords())
    return F.coalesce(F.lower(text).rlike(rf"\b(?:{words})\b" if whole_words else words), F.lit(False))


def fee_reviews(reviews: DataFrame, members: DataFrame, whole_words: bool = False) -> DataFrame:
    """The reviews in some theme (not among the outliers) that mention fees; each id once, its last row."""
    last = last_rows(reviews)
    return last.filter(mentions_fee(F.col("cleaned_text"), whole_words)).join(members.filter("theme_id >= 0").select("review_id").distinct(), "review_id", "left_semi")


def last_rows(reviews: DataFrame) -> DataFrame:
    """The last row by ``seq`` of each review_id; rows without an id are left out."""
    columns = [c for c in reviews.columns if c != "review_id"]
    picked = F.max_by(F.struct(*columns), "seq").alias("r")
    return reviews.filter("review_id is not null").groupBy("review_id").agg(picked).select("review_id", "r.*")
