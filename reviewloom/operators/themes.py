"""Names of themes: samples for a labeller, cleaning of its answers, and labels from the words of a theme."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.config import DEFAULTS, EngineConfig
from reviewloom.operators.fee import last_rows

# Labels that say nothing, and words that carry no meaning in a label.
USELESS_LABELS = (
    "theme", "themes", "cluster", "clusters", "general", "other", "others",
    "misc", "miscellaneous", "feedback", "user feedback", "reviews",
    "review", "negative feedback", "positive feedback", "mixed feedback",
    "n/a", "none", "unknown", "various",
)
STOPWORDS = (
    "the", "and", "for", "are", "but", "not", "you", "your", "with", "this",
    "that", "have", "has", "had", "was", "were", "been", "its", "it's", "from",
    "they", "them", "then", "than", "can", "cant", "will", "would", "could",
    "should", "there", "their", "what", "when", "why", "how", "all", "any",
    "get", "got", "very", "just", "only", "also", "too", "out", "about",
    "after", "before", "even", "more", "most", "much", "some", "such", "into",
    "over", "under", "again", "once", "does", "did", "doing", "done", "app",
    "application", "please", "thanks", "thank", "good", "bad", "best", "worst",
    "like", "dont", "don't", "i'm", "im", "one", "two", "use", "using",
    "used", "make", "made", "want", "need", "know", "time", "every", "always",
    "never", "still", "now", "back", "give", "given", "take", "taken", "see",
    "keep", "keeps", "really", "lot", "many", "going", "way", "thing", "things",
    "review", "reviews", "user", "users", "star", "stars",
)


def sample(members: DataFrame, reviews: DataFrame, cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """(theme_id, pos, text): the first members of each theme by ``pos``; blank and missing texts are dropped afterwards.

    The original text counts, the cleaned one where it is null.
    """
    first = Window.partitionBy("theme_id").orderBy("pos")
    picked = members.filter("theme_id >= 0").withColumn("n", F.row_number().over(first)).filter(F.col("n") <= cfg.label_sample)
    texts = last_rows(reviews).select("review_id", F.coalesce("original_text", "cleaned_text").alias("text"))
    return picked.join(texts, "review_id").filter("text <> ''").select("theme_id", "pos", "text")


def clean_label(raw: Column, cfg: EngineConfig = DEFAULTS) -> Column:
    """A labeller's answer without wrappers: its last line, no bullets, prefix, marks or quotes, at most so many words.

    Empty if nothing useful is left, and for null.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    x = F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit(""))
    x = F.regexp_replace(x, r"^[-*•0-9.)\s]+", "")
    x = F.regexp_replace(x, r"^(?i)(theme|category|label)\s*[:\-]\s*", "")
    x = F.regexp_replace(x, r"\*\*|`|#", "")
    for edge in (r"^\s+|\s+$", r'^"+|"+$', r"^'+|'+$", r"^\s+|\s+$"):
        x = F.regexp_replace(x, edge, "")
    x = F.regexp_replace(x, r"\s+", " ")
    x = F.regexp_replace(F.regexp_replace(x, r"\.+$", ""), r"\s+$", "")
    x = F.array_join(F.slice(F.split(x, " "), 1, cfg.label_words), " ")
    useless = F.lower(x).isin(*USELESS_LABELS) | x.rlike(r"^(?i)(theme|cluster)\s*[0-9]+$")
    return F.when(useless, F.lit("")).otherwise(x)


def keyword_labels(sampled: DataFrame, per_theme: int = 3) -> DataFrame:
    """(theme_id, label) from (theme_id, pos, text): the commonest words, ties by first occurrence, as "First, second, third".

    Themes without any meaningful word have no row.
    """
    words = sampled.select("theme_id", "pos", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z']{3,})"))).alias("at", "word"))
    counted = words.filter(~F.col("word").isin(*STOPWORDS)).groupBy("theme_id", "word").agg(F.count("*").alias("n"), F.min(F.struct("pos", "at")).alias("first"))
    ranked = counted.withColumn("r", F.row_number().over(Window.partitionBy("theme_id").orderBy(F.desc("n"), "first"))).filter(F.col("r") <= per_theme)
    joined = ranked.groupBy("theme_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "word"))), lambda s: s["word"]), ", ").alias("label"))
    return joined.select("theme_id", F.concat(F.upper(F.substring("label", 1, 1)), F.substring("label", 2, 1 << 20)).alias("label"))


def label_themes(ranked: DataFrame, sampled: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """(theme_id, label): the labeller's cleaned answer (theme_id, raw), else the keywords, else "Unnamed theme n" by rank."""
    base = ranked.select("theme_id", "rank").join(keyword_labels(sampled), "theme_id", "left")
    given = answers.select("theme_id", F.nullif(clean_label(F.col("raw")), F.lit("")).alias("given")) if answers is not None else None
    base = base.join(given, "theme_id", "left") if given is not None else base.withColumn("given", F.lit(None).cast("string"))
    return base.select("theme_id", F.coalesce("given", F.nullif(F.col("label"), F.lit("")), F.concat(F.lit("Unnamed theme "), F.col("rank"))).alias("label"))


def prompt_blocks(sampled: DataFrame) -> DataFrame:
    """(theme_id, n, block): the sampled texts of a theme as numbered lines, in order."""
    numbered = sampled.withColumn("i", F.row_number().over(Window.partitionBy("theme_id").orderBy("pos")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda s: F.concat(s["i"].cast("string"), F.lit(". "), s["text"]))
    return numbered.groupBy("theme_id").agg(F.count("*").alias("n"), F.array_join(lines, "\n").alias("block"))
