"""Queries of the training-data operators, with the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewloom.llm import incremental, mih, mixing, near_dup, peaks, pii, splitting, tokenizer
from reviewloom.sources.tables import table

QUERIES = {
    "p1_found": lambda spark, d: near_dup.NearDuplicates(table(spark, d, "clean_reviews"), "seq", "cleaned_text").row_pairs(),
    "p1_links": lambda spark, d: near_dup.NearDuplicates(table(spark, d, "clean_reviews"), "seq", "cleaned_text").links(),
    "p1_groups": lambda spark, d: near_dup.NearDuplicates(table(spark, d, "clean_reviews"), "seq", "cleaned_text").groups(),
    "p2_found": lambda spark, d: incremental.IncrementalIndex(spark).build(table(spark, d, "clean_reviews")).admit_batches(table(spark, d, "new_reviews")).filter("duplicate").select("seq"),
    "p3_found": lambda spark, d: peaks.Themes(table(spark, d, "clean_reviews")).same_theme(table(spark, d, "theme_pairs").filter("seq_a < seq_b")),
    "p3_themes": lambda spark, d: peaks.Themes(table(spark, d, "clean_reviews")).report(),
    "p4_found": lambda spark, d: pii.find_values(table(spark, d, "clean_reviews"), table(spark, d, "known_names"), "seq", ["original_text", "cleaned_text"]).drop("end_pos"),
    "p4_redacted": lambda spark, d: pii.redact_columns(table(spark, d, "clean_reviews"), table(spark, d, "known_names"), "seq", ["original_text", "cleaned_text"]),
    "p5_found": lambda spark, d: mih.MultiIndex(table(spark, d, "chunk_vectors")).neighbour_pairs(),
    "p5_neighbours": lambda spark, d: mih.MultiIndex(table(spark, d, "chunk_vectors")).nearest(),
    "p6_ids": lambda spark, d: tokenizer.encode_column(table(spark, d, "documents"), "doc_id", "text"),
    "p6_round_trip": lambda spark, d: tokenizer.decode_column(tokenizer.encode_column(table(spark, d, "documents"), "doc_id", "text"), "doc_id", "ids"),
    "p7_report": lambda spark, d: mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1],
    "p7_copies": lambda spark, d: mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0],
    "p8_found": lambda spark, d: splitting.split_oversized(table(spark, d, "documents"), "doc_id", "text").filter("piece_no = 0").select("doc_id"),
    "p8_pieces": lambda spark, d: splitting.split_oversized(table(spark, d, "documents"), "doc_id", "text"),
}

ORACLE_SQL = {
    "p6_round_trip": "select doc_id, coalesce(text, '') as text from documents",
}
