"""Vector operators: centroids, quotes near them, votes, clustering, and the offline embedder.

VECTOR rows hold (chunk_id, review_id, chunk_index, embedding); labels are (chunk_id, label) with -1 for outliers.
Null embeddings and empty ones take no part. Sums are in doubles.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.config import DEFAULTS, EngineConfig
from reviewloom.staging import stage


def mean_vectors(rows: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """(by, n, centroid): the mean of the vectors of each group, added up before the shuffle, dimension by dimension."""
    long = rows.filter(F.col(vector).isNotNull()).select(by, F.posexplode(vector).alias("dim", "x"))
    means = long.groupBy(by, "dim").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    return means.groupBy(by).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("centroid"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors; null if one is null or all zeros."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def representative_quotes(vectors: DataFrame, members: DataFrame, reviews: DataFrame, cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """(theme_id, rank, review_id, similarity, quote): the first chunks nearest to the mean of all chunks of a theme.

    A review counts by one first chunk, that of the smallest seq. Ties go to the smaller review_id. Blank quotes are
    dropped after ranking, so a theme may have fewer.
    """
    themed = vectors.filter("embedding is not null").join(members.filter("theme_id >= 0").select("theme_id", "review_id").distinct(), "review_id")
    centroids = mean_vectors(themed, "theme_id")
    firsts = themed.filter("chunk_index = 0").groupBy("theme_id", "review_id").agg(F.min_by("embedding", "seq").alias("embedding"))
    scored = firsts.join(F.broadcast(centroids.select("theme_id", "centroid")), "theme_id").withColumn("similarity", F.round(cosine(F.col("embedding"), F.col("centroid")), 6)).filter("similarity is not null")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("theme_id").orderBy(F.desc("similarity"), "review_id"))).filter(F.col("rank") <= cfg.quotes_per_theme)
    text = reviews.filter("review_id is not null").groupBy("review_id").agg(F.max_by(F.coalesce("original_text", "cleaned_text"), "seq").alias("quote"))
    return ranked.select("theme_id", "rank", "review_id", "similarity").join(text, "review_id").filter("quote <> ''").select("theme_id", "rank", "review_id", "similarity", "quote")


def majority_vote(labels: DataFrame) -> DataFrame:
    """(review_id, theme_id, votes) from (review_id, chunk_id, label): the commonest label of a review's chunks.

    Ties go to the label met first in the order of chunk ids; -1 can win. Rows without a review are left out.
    """
    counted = labels.filter("review_id is not null").groupBy("review_id", "label").agg(F.count("*").alias("votes"), F.min("chunk_id").alias("first_chunk"))
    best = counted.groupBy("review_id").agg(F.min_by(F.struct("label", "votes"), F.struct(-F.col("votes"), F.col("first_chunk"))).alias("b"))
    return best.select("review_id", F.col("b.label").alias("theme_id"), F.col("b.votes").alias("votes"))


def cap_and_rank(members: DataFrame, cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """(theme_id, final_id, n, rank, is_top_3) for each theme: the smallest merged into one beyond the cap.

    final_id is the theme's own id, or -2 for the merged one, which is ranked by its joint size like any other.
    Windows run over one row a theme.
    """
    sizes = members.filter("theme_id >= 0").groupBy("theme_id").agg(F.count("*").alias("size"))
    order = Window.partitionBy().orderBy(F.desc("size"), "theme_id")
    placed = sizes.withColumn("place", F.row_number().over(order)).withColumn("total", F.count("*").over(Window.partitionBy()))
    final = F.when((F.col("total") > cfg.max_clusters) & (F.col("place") >= cfg.max_clusters), F.lit(-2)).otherwise(F.col("theme_id"))
    merged = placed.withColumn("final_id", final)
    joint = merged.groupBy("final_id").agg(F.sum("size").alias("n"), F.min("place").alias("place"))
    ranked = joint.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.desc("n"), "place"))).withColumn("is_top_3", F.col("rank") <= 3).drop("place")
    return merged.select("theme_id", "final_id").join(ranked, "final_id").select("theme_id", "final_id", "n", "rank", "is_top_3")


def noise_reviews(members: DataFrame, reviews: DataFrame) -> DataFrame:
    """The last row of each review among the outliers; ids without a review are dropped."""
    from reviewloom.operators.fee import last_rows

    return last_rows(reviews).join(members.filter("theme_id = -1").select("review_id").distinct(), "review_id", "left_semi")


def cluster_shape(labels: DataFrame) -> DataFrame:
    """One row: clusters (without the outliers), share of outliers; 0 of nothing."""
    return labels.agg(F.count_distinct(F.when(F.col("label") != -1, F.col("label"))).alias("clusters"), F.coalesce(F.avg((F.col("label") == -1).cast("double")), F.lit(0.0)).alias("noise_share"))


def chunk_meta(labels: DataFrame, chunks: DataFrame) -> DataFrame:
    """Labels with the review and index of their chunk; a chunk without a row gets them from its id."""
    known = chunks.groupBy("chunk_id").agg(F.min("review_id").alias("known_review"), F.min("chunk_index").alias("known_index"))
    from_id = F.nullif(F.regexp_extract("chunk_id", "^(.*)_chunk_", 1), F.lit(""))
    return labels.join(known, "chunk_id", "left").select("chunk_id", "label", F.coalesce("known_review", from_id, "chunk_id").alias("review_id"), F.coalesce("known_index", F.lit(0)).alias("chunk_index"))


_WORD = re.compile(r"[a-z0-9]+")


def hash_embed(df: DataFrame, key: str, text: str, dim: int = DEFAULTS.embed_dim) -> DataFrame:
    """(key, embedding): unit vectors of signed hashed words and character trigrams, the offline stand-in for a model.

    A text without words has zeros.
    """

    def vector(t: str | None) -> np.ndarray:
        v = np.zeros(dim)
        for w in _WORD.findall((t or "").lower()):
            for f in (w, *(f"#{w}#"[i : i + 3] for i in range(len(w)))):
                h = int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "little")
                v[h % dim] += 1.0 if h >> 63 else -1.0
        n = np.linalg.norm(v)
        return (v / n if n else v).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str | None, np.ndarray] = {}
        for batch in batches:
            if len(memo) > 20_000:
                memo.clear()
            rows = []
            for t in batch.column(1).to_pylist():
                if t not in memo:
                    memo[t] = vector(t)
                rows.append(memo[t])
            flat = np.concatenate(rows) if rows else np.zeros(0, np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * dim), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["k", "embedding"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, embedding array<float>").withColumnRenamed("k", key)


def _unit_features(vectors: DataFrame) -> DataFrame:
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector

    usable = vectors.filter("embedding is not null").filter(F.exists("embedding", lambda x: x != 0)).withColumn("raw", array_to_vector(F.col("embedding")))
    return Normalizer(inputCol="raw", outputCol="unit", p=2.0).transform(usable).drop("raw")


def reduce_dimensions(vectors: DataFrame, cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """VECTOR rows with ``reduced``: principal components of the unit vectors (in place of a manifold method)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    unit = _unit_features(vectors)
    first = unit.select(F.size("embedding").alias("d")).first()
    if first is None:
        return vectors.filter("false").withColumn("reduced", F.lit(None).cast("array<double>"))
    model = PCA(k=min(cfg.reduced_dim, first["d"]), inputCol="unit", outputCol="pc").fit(unit)
    return model.transform(unit).withColumn("reduced", vector_to_array("pc")).drop("unit", "pc")


def kmeans(vectors: DataFrame, cfg: EngineConfig = DEFAULTS, starts: int = 10) -> DataFrame:
    """(chunk_id, review_id, label): k-means over the unit vectors, the cheapest of some starts."""
    from pyspark.ml.clustering import KMeans

    unit = stage(_unit_features(vectors).select("chunk_id", "review_id", "unit"), "unit-vectors")
    n = unit.count()
    if not n:
        return vectors.filter("false").select("chunk_id", "review_id", F.lit(None).cast("int").alias("label"))
    models = [KMeans(k=min(cfg.kmeans_k, n), seed=42 + i, featuresCol="unit", predictionCol="label").fit(unit) for i in range(starts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(unit).select("chunk_id", "review_id", "label")
