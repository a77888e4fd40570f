"""Chunks of reviews, batches of chunks, and the vector cache.

Texts: null counts as empty. Token rule: functions.text.tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.config import DEFAULTS, EngineConfig
from reviewloom.functions import text as T
from reviewloom.operators.clean import row_numbers


def tiers(reviews: DataFrame, cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """(seq, review_id, n_tokens, tier): whole, sentence or sliding, by the number of tokens."""
    n = F.size(T.tokens(F.col("cleaned_text")))
    tier = F.when(n <= cfg.chunk_whole_tokens, "whole").when(n <= cfg.chunk_sentence_tokens, "sentence").otherwise("sliding")
    return reviews.select("seq", "review_id", n.alias("n_tokens"), tier.alias("tier"))


def tier_counts(reviews: DataFrame, cfg: EngineConfig = DEFAULTS) -> DataFrame:
    return tiers(reviews, cfg).groupBy("tier").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens"))


def chunk(reviews: DataFrame, cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """CHUNK rows with the review's seq: the whole text, its sentences, or overlapping windows of tokens.

    A text of the sentence tier without sentences is one chunk.
    """
    text = F.coalesce("cleaned_text", F.lit(""))
    tok = T.tokens(text)
    n = F.size(tok)
    s = T.sentences(text)
    pieces = (
        F.when(n <= cfg.chunk_whole_tokens, F.array(text))
        .when(n <= cfg.chunk_sentence_tokens, F.when(F.size(s) > 0, s).otherwise(F.array(text)))
        .otherwise(T.windows(tok, cfg))
    )
    rows = reviews.select("seq", "review_id", pieces.alias("pieces"))
    exploded = rows.select("seq", "review_id", F.size("pieces").alias("total_chunks"), F.posexplode("pieces").alias("chunk_index", "chunk_text"))
    return exploded.select(F.concat("review_id", F.lit("_chunk_"), "chunk_index").alias("chunk_id"), "seq", "review_id", "chunk_index", "chunk_text", "total_chunks")


def sliding_chunks(reviews: DataFrame, cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """(seq, chunk_index, n_tokens): the windows of every text, whatever its tier."""
    rows = reviews.select("seq", F.posexplode(T.windows(T.tokens(F.col("cleaned_text")), cfg)).alias("chunk_index", "w"))
    return rows.select("seq", "chunk_index", F.size(F.filter(F.split("w", " "), lambda x: x != "")).alias("n_tokens"))


def sentence_chunks(reviews: DataFrame) -> DataFrame:
    """(seq, sentence_index, sentence) of every text."""
    return reviews.select("seq", F.posexplode(T.sentences(F.coalesce("cleaned_text", F.lit("")))).alias("sentence_index", "sentence"))


def uncached(chunks: DataFrame, cached: DataFrame) -> DataFrame:
    """The chunks without a cached vector; those without an id are among them."""
    return chunks.join(cached.select("chunk_id").filter("chunk_id is not null").distinct(), "chunk_id", "left_anti")


def batches(chunks: DataFrame, cached: DataFrame, order: str = "seq", cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """Chunks without a cached vector, in batches of a fixed size by input order: with a column batch_id from 0."""
    return row_numbers(uncached(chunks, cached), order).withColumn("batch_id", F.expr(f"(row_no - 1) div {cfg.embed_batch}"))


def batch_sizes(chunks: DataFrame, cached: DataFrame, order: str = "seq", cfg: EngineConfig = DEFAULTS) -> DataFrame:
    return batches(chunks, cached, order, cfg).groupBy("batch_id").agg(F.count("*").alias("n"), F.min(order).alias("first_seq"), F.max(order).alias("last_seq"))


def upsert(cached: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The cache with new rows in place of old ones of the same key; cached rows without a new one stay."""
    return cached.join(new.select(key).filter(f"{key} is not null").distinct(), key, "left_anti").select(*cached.columns).unionByName(new.select(*cached.columns))
