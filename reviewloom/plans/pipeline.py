"""The weekly run: from scraped reviews to a validated report, and its delivery as a separate step.

Three results are written and read back: the scrubbed corpus, the vectors, and the members of themes. Everything else stays
lazy. What reaches the driver is tables of a few rows: themes, quotes, counts.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.config import DEFAULTS, EngineConfig
from reviewloom.operators import analytics, chunk, clean, dedup, delivery, density, fee, report, themes, validate, vectors
from reviewloom.protocols import Clusterer, Delivery, Embedder, TextGenerator
from reviewloom.staging import stage


@dataclass
class Run:
    """What a run leaves behind; ``report_markdown`` is None if there were no reviews."""

    product: str
    week_start: str
    week_end: str
    corpus: DataFrame
    members: DataFrame
    themes: DataFrame
    review_count: int
    report_markdown: str | None
    passed: bool = True
    warnings: list[str] = field(default_factory=list)

    @property
    def key(self) -> str:
        return report.report_key(self.product, self.week_start, self.week_end)

    def pending(self) -> str:
        """The handoff to delivery: counts in place of lists."""
        return json.dumps({"product": self.product, "week_start": self.week_start, "week_end": self.week_end, "review_count": self.review_count, "theme_count": self.themes.count(), "report_markdown": self.report_markdown, "report_key": self.key})


def corpus_of(scraped: DataFrame, cfg: EngineConfig = DEFAULTS, end: str | None = None, greedy: bool = False) -> DataFrame:
    """Fetched, cleaned, deduplicated by id and by text, scrubbed; written once."""
    cleaned = stage(clean.exact_dedup(clean.clean(clean.fetch(scraped, cfg, end), cfg)).withColumn("rating", F.col("rating").cast("string")), "cleaned")
    near = dedup.ShingleNeighbours(cleaned, cfg)
    kept = cleaned.join(near.greedy() if greedy else near.first_only(), "seq", "left_semi")
    scrubbed = clean.pii_scrub(kept).select("seq", "original_text", "cleaned_text")
    return stage(kept.drop("original_text", "cleaned_text").join(scrubbed, "seq"), "corpus")


def cluster(vector_rows: DataFrame, cfg: EngineConfig = DEFAULTS, clusterer: Clusterer | None = None, relaxed: Clusterer | None = None) -> DataFrame:
    """(chunk_id, review_id, label): the given clusterer (density clustering, unless given), once more in its relaxed form if
    there is too much noise, and k-means if it finds too few clusters."""
    if clusterer is None:
        clusterer = lambda v: density.hdbscan(v, cfg, cfg.hdbscan_min_cluster)
        relaxed = lambda v: density.hdbscan(v, cfg, cfg.hdbscan_relaxed_cluster)
    labels = stage(clusterer(vector_rows), "labels")
    shape = vectors.cluster_shape(labels).first()
    if relaxed is not None and shape["clusters"] >= cfg.min_clusters and shape["noise_share"] > cfg.noise_share:
        labels = stage(relaxed(vector_rows), "labels")
        shape = vectors.cluster_shape(labels).first()
    if shape["clusters"] >= cfg.min_clusters:
        return labels
    return stage(vectors.kmeans(vector_rows, cfg), "labels")


def generate(scraped: DataFrame, product: str, week_end: str, cfg: EngineConfig = DEFAULTS, embedder: Embedder | None = None, clusterer: Clusterer | None = None, relaxed: Clusterer | None = None, writer: TextGenerator | None = None) -> Run:
    """Everything up to a validated report. Nothing here can deliver."""
    corpus = corpus_of(scraped, cfg, week_end)
    count = corpus.count()
    chunks = chunk.chunk(corpus, cfg)
    embed = embedder or vectors.hash_embed
    vector_rows = stage(chunks.join(embed(chunks, "chunk_id", "chunk_text", cfg.embed_dim), "chunk_id"), "vectors")
    votes = vectors.majority_vote(cluster(vector_rows, cfg, clusterer, relaxed))
    position = corpus.groupBy("review_id").agg(F.min("seq").alias("pos"))
    members = votes.join(position, "review_id").select("theme_id", "review_id", "pos")
    ranks = stage(vectors.cap_and_rank(members, cfg), "ranks")
    final = members.join(ranks.select("theme_id", "final_id"), "theme_id", "left").select(F.coalesce(F.when(F.col("final_id") == -2, 1 << 20).otherwise(F.col("final_id")), "theme_id").cast("int").alias("theme_id"), "review_id", "pos")
    final = stage(final, "members")
    breakdown = analytics.theme_breakdown(final, corpus)
    labelled = stage(breakdown.join(themes.label_themes(breakdown, themes.sample(final, corpus, cfg)), "theme_id"), "themes")
    rows = [r.asDict() for r in labelled.orderBy("rank").collect()]
    fees = analytics.fee_stats(fee.fee_reviews(corpus, final), corpus).first().asDict()
    quotes = [r.asDict() for r in analytics.top_quotes(corpus, cfg).collect()]
    run = Run(product, cfg.window_start, week_end, corpus, final, labelled, count, None)
    spark = scraped.sparkSession
    for attempt in range(cfg.max_validation_retries):
        if not rows:
            run.warnings.append("no themes")
            return run
        text = report.markdown(product, rows, quotes, fees) if writer is None else writer("Write the weekly review report.", json.dumps({"themes": rows, "quotes": quotes, "fees": fees}, default=str))
        reports = spark.createDataFrame([(1, text)], "report_id long, markdown string")
        found = validate.blockquotes(reports)
        verdict = validate.decide(reports, validate.quote_match(found, corpus, cfg), validate.missing_sections(reports)).first()
        run.report_markdown, run.passed = text, verdict["passed"]
        if run.passed or writer is None:
            break
    if not run.passed:
        run.warnings.append("the report didn't pass its checks")
    if validate.word_count(reports, cfg).first()["too_long"]:
        run.warnings.append("the report is long")
    run.warnings += [f"theme {r['theme_id']} isn't named" for r in validate.theme_coverage(reports, labelled.select("theme_id", "label", "n"), cfg).filter("not covered").collect()]
    return run


def deliver(pending: str, channel: Delivery, recipients: list[str], delivered_before: set[str], log: delivery.AuditLog | None = None, folder: str | None = None) -> dict | None:
    """Sends a pending report once; the record of it, or None if its key was delivered before, as the set or the log says.

    With a folder the report is saved there as a file as well; with a log the record is entered into it.
    """
    p = json.loads(pending)
    if p["report_key"] in delivered_before or log is not None and log.delivered(p["product"], p["week_start"], p["report_key"]):
        return None
    if folder is not None:
        delivery.save_report(folder, p["product"], p["week_start"], p["report_markdown"] or "")
    ok = channel.send(f"{p['product']}: reviews of the week from {p['week_start']}", report.to_html(p["report_markdown"] or ""), recipients)
    record = {k: p[k] for k in ("product", "week_start", "week_end", "review_count", "theme_count", "report_key")} | {"ok": ok, "recipients": ", ".join(recipients)}
    if log is not None:
        log.record(record | {"delivered_at": datetime.now(UTC).isoformat(timespec="seconds")})
    return record
