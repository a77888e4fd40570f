"""Text expressions that stay in the JVM, and the one that can't (NFKC)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from reviewloom.config import DEFAULTS, EngineConfig

BLANKS = " \n\t"

# Common words that tell languages apart once a text is plain ASCII.
LANGUAGE_WORDS = {
    "en": "the and is it to of for in this that not very app my with are was have you but on so good i they no can a please me be has worst best bad nice use time all from when service money day after by too easy love great excellent useful trading super more any only just don does",
    "es": "el los las una muy por para con que es mi su pero como esta buena bueno mejor gracias aplicacion malo todo cuando de en la no se dinero excelente",
    "de": "der die das und ist nicht sehr ich ein eine mit fur auf zu es den von wird aber schon gut schlecht geld immer kein bitte nach bei wieder",
    "fr": "le les des une est tres pas je pour avec dans que mais sur ce bonne bon mon merci application argent tout depuis plus ne et du au cette",
    "hi": "hai bahut nahi acha accha achha ka ki ke ko mein se aur ye yeh kya koi bhi nhi h paise mera kar raha rahe karo liye bhai sab ho gaya wala",
}


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFKC")


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFC")


def strip(text: Column) -> Column:
    """Blanks, tabs and line ends off both ends."""
    return F.btrim(text, F.lit(BLANKS))


def normalise_unicode(text: Column, form: str = "NFKC") -> Column:
    """Compatibility composition, then everything but printable ASCII, tab and line end deleted, then stripped.

    Only texts with other characters go through Python.
    """
    composed = F.when(text.rlike(r"[^\x00-\x7F]"), (_nfkc if form == "NFKC" else _nfc)(F.when(text.rlike(r"[^\x00-\x7F]"), text))).otherwise(text)
    return strip(F.regexp_replace(composed, r"[^\x20-\x7E\n\t]", ""))


def strip_html_urls(text: Column) -> Column:
    """Tags and links deleted, then stripped."""
    for pattern in (r"<[^>]+>", r"https?://\S+", r"www\.\S+"):
        text = F.regexp_replace(text, pattern, "")
    return strip(text)


def is_english(text: Column) -> Column:
    """At least as many common English words as of any other language, and some letter; blank texts are not."""
    scores = {lang: F.regexp_count(F.lower(text), F.lit(language_pattern(lang))) for lang in LANGUAGE_WORDS}
    best_other = F.greatest(*(scores[k] for k in scores if k != "en"))
    return F.coalesce(text.rlike("[A-Za-z]") & (scores["en"] >= best_other), F.lit(False))


def language_pattern(lang: str) -> str:
    return r"\b(?:" + "|".join(LANGUAGE_WORDS[lang].split()) + r")\b"


def words(text: Column) -> Column:
    """The words between blanks; none for null."""
    return F.coalesce(F.filter(F.split(text, r"\s+"), lambda w: w != ""), F.array().cast("array<string>"))


def shingles(text: Column, k: int = DEFAULTS.shingle_words) -> Column:
    """The distinct runs of ``k`` words; shorter texts have their words, empty and null ones a single empty shingle."""
    w = words(text)
    n = F.size(w)
    runs = F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.array_join(F.slice(w, i + 1, k), " "))
    return F.array_distinct(F.when(n == 0, F.array(F.lit(""))).when(n < k, w).otherwise(runs))


def tokens(text: Column) -> Column:
    """The default token rule: runs of letters, digits and underscores, and every other sign by itself, in lower case."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9_]+|[^a-z0-9_\s])")), F.array().cast("array<string>"))


def sentences(text: Column) -> Column:
    """Sentences with their end marks, stripped, without empty ones."""
    found = F.regexp_extract_all(text, F.lit(r"([^.!?]+[.!?]*)"))
    return F.filter(F.transform(found, strip), lambda s: s != "")


def window_count(n: Column, cfg: EngineConfig = DEFAULTS) -> Column:
    """Sliding windows over n tokens: one up to the window's size, then one more for each further step begun."""
    step = cfg.window_tokens - cfg.window_overlap
    return F.when(n <= cfg.window_tokens, F.lit(1)).otherwise(F.ceil((n - cfg.window_tokens) / F.lit(float(step))).cast("int") + 1)


def windows(token_array: Column, cfg: EngineConfig = DEFAULTS) -> Column:
    step = cfg.window_tokens - cfg.window_overlap
    n = window_count(F.size(token_array), cfg)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(token_array, i * step + 1, cfg.window_tokens), " "))


# Patterns of the product's scrubber, in the order they are applied.
PII_RULES = (
    ("email", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", "[EMAIL]"),
    ("id", r"[A-Z]{2,}[0-9]{6,}", "[ID]"),
    ("name", r"(?i)(?:my name is|i am|i'm)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)", "[NAME]"),
    ("phone", r"\+?[0-9][0-9\s\-]{7,}", "[PHONE]"),
)


def scrub(text: Column) -> tuple[Column, dict[str, Column]]:
    """(scrubbed text, number of replacements by rule): each rule sees what the ones before it left."""
    counts = {}
    for kind, pattern, tag in PII_RULES:
        counts[kind] = F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))
        text = F.regexp_replace(text, pattern, tag)
    return text, counts
