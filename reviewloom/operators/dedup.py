"""Near duplicates by exact Jaccard similarity of word shingles, and the groups they form.

Equal shingle sets are one class; classes are paired by prefix filtering: with shingles in a fixed order, rare ones first,
two sets of similarity t share one of their first n - ceil(t * n) + 1 shingles. Nothing is lost by that, and a common
shingle never becomes a join key unless a text has nothing rarer. Null texts count as empty; empty texts are alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.config import DEFAULTS, EngineConfig
from reviewloom.functions import text as T
from reviewloom.staging import spread, stage


def shingle_rows(reviews: DataFrame, cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """(seq, n_shingles, first_shingle): the size of each review's shingle set and its first shingle."""
    s = T.shingles(F.col("cleaned_text"), cfg.shingle_words)
    return reviews.select("seq", F.size(s).alias("n_shingles"), F.element_at(s, 1).alias("first_shingle"))


class ShingleNeighbours:
    """members: (seq, date, cls); classes: (cls, shingles); pairs: (a, b, similarity) of classes, a < b."""

    def __init__(self, reviews: DataFrame, cfg: EngineConfig = DEFAULTS) -> None:
        t = cfg.near_dup_threshold
        rows = spread(reviews.select("seq", "date", "cleaned_text")).select("seq", F.coalesce("date", F.lit("")).alias("date"), F.array_sort(T.shingles(F.col("cleaned_text"), cfg.shingle_words)).alias("s"))
        key = F.sha2(F.array_join("s", "\n"), 256)
        keyed = stage(rows.withColumn("key", key), "shingles")
        heads = keyed.groupBy("key").agg(F.min("seq").alias("cls"))
        self.members = stage(keyed.join(heads, "key").select("seq", "date", "cls"), "members")
        self.classes = stage(keyed.join(heads.select(F.col("cls").alias("seq")), "seq", "left_semi").select(F.col("seq").alias("cls"), F.transform("s", lambda x: F.xxhash64(x)).alias("h")), "classes")
        each = self.classes.select("cls", F.size("h").alias("n"), F.explode("h").alias("x"))
        frequency = each.groupBy("x").agg(F.count("*").alias("df"))
        ordered = each.filter("n > 0").join(frequency, "x").groupBy("cls", "n").agg(F.array_sort(F.collect_list(F.struct("df", "x"))).alias("o"))
        prefix = F.slice("o", F.lit(1), (F.col("n") - F.ceil(F.lit(t) * F.col("n") - 1e-9) + 1).cast("int"))
        keys = stage(ordered.select("cls", "n", F.explode(prefix).alias("p")).select("cls", "n", F.col("p.x").alias("x")), "prefixes")
        sized = (F.col("l.n") >= F.col("r.n") * t - 1e-9) & (F.col("r.n") >= F.col("l.n") * t - 1e-9)
        candidates = keys.alias("l").join(keys.alias("r"), (F.col("l.x") == F.col("r.x")) & (F.col("l.cls") < F.col("r.cls")) & sized).select(F.col("l.cls").alias("a"), F.col("r.cls").alias("b")).distinct()
        both = candidates.join(self.classes.select(F.col("cls").alias("a"), F.col("h").alias("x")), "a").join(self.classes.select(F.col("cls").alias("b"), F.col("h").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y"))
        similarity = common / (F.size("x") + F.size("y") - common)
        self.pairs = stage(both.select("a", "b", similarity.alias("similarity")).filter(F.col("similarity") >= t), "pairs")

    def neighbour_counts(self) -> DataFrame:
        """(seq, copies, links): rows with the same shingles, and classes of other shingles that are near."""
        ends = self.pairs.select(F.col("a").alias("cls")).unionByName(self.pairs.select(F.col("b").alias("cls"))).groupBy("cls").agg(F.count("*").alias("links"))
        sizes = self.members.groupBy("cls").agg(F.count("*").alias("copies"))
        return self.members.join(sizes, "cls").join(ends, "cls", "left").select("seq", "copies", F.coalesce("links", F.lit(0)).alias("links"))

    def first_only(self) -> DataFrame:
        """(seq) of the rows without an earlier near duplicate, by date, then seq; undated rows come first."""
        order = F.struct("date", "seq")
        first = self.members.groupBy("cls").agg(F.min(order).alias("first"))
        both = self.pairs.select("a", "b").unionByName(self.pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.join(first.select(F.col("cls").alias("b"), F.col("first").alias("f")), "b").groupBy(F.col("a").alias("cls")).agg(F.min("f").alias("near_first"))
        least = first.join(near, "cls", "left").select("cls", F.least("first", F.coalesce("near_first", "first")).alias("least"))
        return self.members.join(least, "cls").filter(F.struct("date", "seq") == F.col("least")).select("seq")

    def greedy(self) -> DataFrame:
        """(seq) kept by the product's greedy rule: in input order, a class that is still free leads a group and takes its
        free neighbours; the earliest row by (date, seq) of each group stays.

        A class leads exactly if no earlier neighbour does, and otherwise belongs to its earliest leading neighbour. That is
        settled in rounds over the pairs, all classes at once whose earlier neighbours are settled.
        """
        edges = stage(self.pairs.select("a", "b").unionByName(self.pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
        state = stage(edges.select(F.col("a").alias("cls")).distinct().withColumn("leads", F.lit(None).cast("boolean")), "leaders")
        while state.filter("leads is null").limit(1).count():
            earlier = edges.filter("b < a").join(state.select(F.col("cls").alias("b"), F.col("leads").alias("b_leads")), "b")
            heard = earlier.groupBy(F.col("a").alias("cls")).agg(F.max(F.coalesce("b_leads", F.lit(False))).alias("led"), F.max(F.col("b_leads").isNull()).alias("waits"))
            verdict = F.when(F.coalesce("led", F.lit(False)), False).when(~F.coalesce("waits", F.lit(False)), True)
            state = stage(state.join(heard, "cls", "left").select("cls", F.coalesce("leads", verdict).alias("leads")), "leaders")
        leaders = state.filter("leads").select(F.col("cls").alias("b"))
        led = edges.join(leaders, "b").join(state.filter("not leads").select(F.col("cls").alias("a")), "a", "left_semi").groupBy(F.col("a").alias("cls")).agg(F.min("b").alias("leader"))
        grouped = self.members.join(led, "cls", "left").select("seq", "date", F.coalesce("leader", "cls").alias("leader"))
        return grouped.groupBy("leader").agg(F.min(F.struct("date", "seq")).alias("f")).select(F.col("f.seq").alias("seq"))
