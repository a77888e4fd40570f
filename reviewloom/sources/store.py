"""A paged review listing as a Spark data source, and file caches around it.

``PagedListing`` is the seam where a real store client goes: any callable that gives a page of rows, newest first, and the
token of the next page. Without one, files are the source.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from reviewloom.schemas import CLEAN_REVIEW, SCRAPED
from reviewloom.staging import stage

Page = tuple[list[dict], object]


def read_listing(page: Callable[[object, int], Page], start: datetime, page_size: int = 200, retries: int = 3, pause: Callable[[float], None] = time.sleep) -> Iterator[dict]:
    """Rows from the newest on until one is older than ``start``, the listing ends, or a page fails ``retries`` times."""
    token: object = None
    seq = 0
    while True:
        for attempt in range(retries):
            try:
                rows, token = page(token, page_size)
                break
            except Exception:
                if attempt == retries - 1:
                    return
                pause(2.0**attempt)
        if not rows:
            return
        for row in rows:
            if isinstance(row.get("at"), datetime) and row["at"] < start:
                return
            yield {"seq": seq, **row}
            seq += 1
        if token is None:
            return


class PagedListing(DataSource):
    """``spark.dataSource.register`` a subclass that sets ``page``; options: start (ISO date), page_size."""

    page: Callable[[object, int], Page] | None = None

    @classmethod
    def name(cls) -> str:
        return "review_listing"

    def schema(self) -> str:
        return SCRAPED

    def reader(self, schema) -> DataSourceReader:
        return _Reader(type(self).page, self.options)


class _Reader(DataSourceReader):
    def __init__(self, page, options) -> None:
        self.page, self.options = page, options

    def partitions(self):
        return [InputPartition(0)]  # a listing is read by its token, page after page

    def read(self, partition):
        start = datetime.fromisoformat(self.options.get("start", "1970-01-01"))
        for row in read_listing(self.page, start, int(self.options.get("page_size", "200"))):
            yield tuple(row.get(f.split()[0]) for f in SCRAPED.split(", "))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The parquet table at ``path``; made and written first if it isn't there. Key the path by product and window."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_clean_json(spark: SparkSession, path: str) -> DataFrame:
    """A clean corpus as a JSON array or JSON lines; ``seq`` is the position if the file has none. Malformed rows are null."""
    df = spark.read.schema(CLEAN_REVIEW).option("multiLine", True).json(path)
    return df.filter("review_id is not null or cleaned_text is not null")


def write_clean(df: DataFrame, path: str, fmt: str = "json") -> None:
    df.write.mode("overwrite").format(fmt).save(path)


def upsert_vectors(spark: SparkSession, path: str, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The vector cache at ``path`` with new rows in place of old ones; written beside the old one, then swapped in."""
    from reviewloom.operators.chunk import upsert

    merged = upsert(spark.read.parquet(path), new, key) if exists(spark, f"{path}/_SUCCESS") else new
    stage(merged, "vector-cache").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
