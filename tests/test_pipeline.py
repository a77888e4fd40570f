"""A whole run on the smallest table, and delivery."""

from pyspark.sql import functions as F

from reviewloom.plans import pipeline
from reviewloom.sources.tables import table


def test_run(spark):
    run = pipeline.generate(table(spark, "/root/testdata/sf0.001", "raw_reviews"), "App", "2026-09-10")
    assert run.review_count == run.corpus.count() > 0 and run.passed and run.report_markdown
    ids = run.members.select("review_id")
    assert ids.count() == ids.distinct().count() == run.corpus.select("review_id").distinct().count()
    assert 3 <= run.themes.count() <= 10

    sent = []

    class Channel:
        def send(self, subject, html, recipients):
            sent.append(subject)
            return True

    record = pipeline.deliver(run.pending(), Channel(), ["a@b.example"], set())
    assert record["ok"] and len(sent) == 1 and pipeline.deliver(run.pending(), Channel(), [], {run.key}) is None


def test_clusterer_is_relaxed_and_replaced(spark):
    v = spark.createDataFrame([(f"c{i}", f"r{i}", [float(i % 4), 1.0]) for i in range(20)], "chunk_id string, review_id string, embedding array<float>")
    calls = []

    def noisy(df):
        calls.append("strict")
        return df.select("chunk_id", "review_id", F.when(F.expr("substr(chunk_id, 2) < '5'"), -1).otherwise(F.expr("cast(substr(chunk_id, 2) as int) % 4")).alias("label"))

    def calm(df):
        calls.append("relaxed")
        return df.select("chunk_id", "review_id", F.expr("cast(substr(chunk_id, 2) as int) % 4").alias("label"))

    assert pipeline.cluster(v, clusterer=noisy, relaxed=calm).filter("label = -1").count() == 0 and calls == ["strict", "relaxed"]
    one = lambda df: df.select("chunk_id", "review_id", F.lit(0).alias("label"))
    assert pipeline.cluster(v, clusterer=one).select("label").distinct().count() >= 3
