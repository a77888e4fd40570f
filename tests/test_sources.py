"""The paged listing, caches and the streaming trend."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from reviewloom.operators import analytics
from reviewloom.schemas import SCRAPED
from reviewloom.sources import store
from reviewloom.streaming import trend

ROWS = [{"reviewId": f"r{i}", "content": "t", "score": i % 6, "at": datetime(2026, 8, 30) - timedelta(days=i), "thumbsUpCount": 0} for i in range(40)]


def pages(token, size):
    at = token or 0
    return ROWS[at : at + size], at + size if at + size < len(ROWS) else None


def test_listing_stops_at_the_window():
    got = list(store.read_listing(pages, datetime(2026, 8, 20), 7))
    assert [r["reviewId"] for r in got] == [f"r{i}" for i in range(11)] and [r["seq"] for r in got] == list(range(11))
    assert len(list(store.read_listing(pages, datetime(2020, 1, 1), 7))) == 40
    assert list(store.read_listing(lambda t, n: ([], None), datetime(2020, 1, 1))) == []


def test_listing_retries_then_gives_what_it_has():
    waits, calls = [], []

    def flaky(token, size):
        calls.append(token)
        if token == 14 or len(calls) == 1:
            raise OSError
        return pages(token, size)

    assert len(list(store.read_listing(flaky, datetime(2020, 1, 1), 7, pause=waits.append))) == 14
    assert waits == [1.0, 1.0, 2.0]


def test_data_source(spark):
    def build():
        rows = [(datetime(2026, 8, 30) - timedelta(days=i), f"r{i}") for i in range(40)]

        class Listing(store.PagedListing):
            @staticmethod
            def page(token, size):
                at = token or 0
                return [{"reviewId": r, "at": t} for t, r in rows[at : at + size]], at + size if at + size < 40 else None

        return Listing

    spark.dataSource.register(build())
    df = spark.read.format("review_listing").option("start", "2026-08-20").option("page_size", "7").load()
    assert df.count() == 11 and df.columns == [f.split()[0] for f in SCRAPED.split(", ")]


def test_caches(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    path = f"file://{tmp_path}/t"
    assert store.cached(spark, path, make).count() == 3 and store.cached(spark, path, make).count() == 3 and made == [1]
    v = spark.createDataFrame([("a", 1), ("b", 1)], "chunk_id string, v int")
    store.upsert_vectors(spark, f"file://{tmp_path}/v", v)
    got = store.upsert_vectors(spark, f"file://{tmp_path}/v", spark.createDataFrame([("b", 2), ("c", 2)], "chunk_id string, v int"))
    assert sorted(map(tuple, got.collect())) == [("a", 1), ("b", 2), ("c", 2)]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"r{i % 30}", "u", "t", i % 7, datetime(2026, 7, 20) + timedelta(hours=9 * i), 0, "") for i in range(120)]
    df = spark.createDataFrame(rows, SCRAPED)
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = trend.weekly_trend(stream).writeStream.format("memory").queryName("weeks").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    batch = analytics.weekly_trend(df.select(F.date_format("at", "yyyy-MM-dd").alias("date"), F.col("score").cast("string").alias("rating")))
    assert sorted(map(tuple, spark.table("weeks").collect())) == sorted(map(tuple, batch.collect()))
    q = trend.first_seen(stream).select("reviewId").writeStream.format("memory").queryName("ids").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    ids = [r[0] for r in spark.table("ids").collect()]
    assert set(ids) == {f"r{i}" for i in range(30)}
