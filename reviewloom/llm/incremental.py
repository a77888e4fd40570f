"""Deduplication of new batches against all history, by an incremental inverted index of rare-token prefixes.

The index lies in a folder of the shared storage, as segments of three tables and a numbered manifest that names them:

- ``order``: the frequency of tokens in the first history, folded into a fixed number of slots. It fixes the order of
  tokens, rare ones first, for the life of the index; any fixed order gives right results, a fresh one shorter lists.
- ``texts``: a row for each distinct bag accepted (its id, key and text), in buckets of ids.
- ``postings``: a row for each token of a bag's prefix, with the bag's size, the token's position and a parity sketch of
  the bag, in buckets of tokens.
- ``ids``: the review ids accepted, in buckets of their hash.

A segment has as many buckets as it holds ``bucket_rows`` rows (powers of two), so a bucket stays of one size however long
the history grows. A batch reads only the buckets that its tokens, ids and candidates fall into: what a batch of given size
reads is bounded by its own keys, not by the history. A batch adds one segment a table; eight segments of like size (within a
factor of eight) are merged into one, so there are seven at most for each eightfold growth and a row is rewritten as often. A new manifest is
renamed into place last: whatever a broken run left behind is named by none and never read. There is one writer at a time.

Two bags at similarity t share a token of their prefixes of n - ceil(t * n) + 1 tokens. A batch's prefixes are joined with
the postings on the token; sizes, positions and sketches drop what can't be near, without loss, inside that join; texts of
what remains are fetched by id and verified exactly.

Rows are taken in order (batch, key). A row is a duplicate if a row accepted before has its review id or a near text.
Which rows of a batch are accepted depends on those before them; that is resolved in rounds, in each of which all rows
are settled that have no unsettled row before them with the same id or a near text. Null, empty and blank ids match nothing; null,
empty and short texts are near to nothing. Null batch numbers come before all others. Other columns are ignored.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm.words import MIN_WORDS, THRESHOLD, compared, elements, mix, with_bags
from reviewloom.staging import filesystem, fresh_path, stage, unstage

#: Slots of the token order: 2 ** SLOT_BITS counters, 1 MB whatever the history's size. That array is what is broadcast.
SLOT_BITS = 18
SKETCH_WORDS = 4
#: Rows of a bucket, and the most buckets of a segment (beyond that buckets grow).
BUCKET_ROWS, MAX_BUCKETS = 250_000, 1 << 15
#: As many segments of like size (within a factor of eight) are merged into one.
MERGED = 8
#: A batch's keys are broadcast to the history's buckets up to so many rows; beyond that both sides are shuffled.
BROADCAST_ROWS = 200_000
#: Batches that one call takes one after the other; more are refused.
MAX_BATCHES = 100_000
POSTING = "token long, id long, n int, pos int, s0 long, s1 long, s2 long, s3 long"
#: The columns of each table, and what its buckets are of.
TABLES = {"postings": (POSTING, "token"), "texts": ("id long, bag binary, text string", "id"), "ids": ("review_id string", "xxhash64(review_id)")}


def _slots(e: np.ndarray) -> np.ndarray:
    return (e >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def prefix_length(n: int, threshold: float) -> int:
    return n - int(np.ceil(threshold * n - 1e-9)) + 1


def sketch(e: np.ndarray) -> np.ndarray:
    """Parities of the elements by bit; two sketches differ in at most as many bits as the bags have elements apart."""
    bit = (mix(e) >> np.uint64(56)).astype(np.int64) % (64 * SKETCH_WORDS)
    parity = (np.bincount(bit, minlength=64 * SKETCH_WORDS) & 1).astype(np.uint8)
    return np.packbits(parity).view(np.int64)


def _small(df: DataFrame, n: int) -> DataFrame:
    """``df``, broadcast if it is known to have at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


class IncrementalIndex:
    def __init__(self, spark: SparkSession, path: str | None = None, threshold: float = THRESHOLD, least: int = MIN_WORDS, bucket_rows: int = BUCKET_ROWS) -> None:
        """An index at ``path``, which may exist already; by default a new one in the shared folder, gone when the driver ends."""
        self.spark, self.path = spark, path or fresh_path(spark, "dedup-index")
        self.threshold, self.least, self.bucket_rows = threshold, least, bucket_rows
        self._order: np.ndarray | None = None
        self._version, self._manifest = self._latest()

    # Segments and manifests

    def _latest(self) -> tuple[int, dict]:
        fs, folder = filesystem(self.spark, f"{self.path}/manifests")
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        version = max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)
        if not version:
            return 0, {"order": None, **{t: [] for t in TABLES}}
        _, p = filesystem(self.spark, f"{self.path}/manifests/{version:010d}.json")
        stream = fs.open(p)
        try:
            return version, json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        """Puts a manifest in place of the last one and deletes the segments that it no longer names."""
        fs, temporary = filesystem(self.spark, f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = fs.create(temporary, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        _, final = filesystem(self.spark, f"{self.path}/manifests/{self._version + 1:010d}.json")
        if fs.exists(final) or not fs.rename(temporary, final):
            raise RuntimeError(f"another writer has changed the index at {self.path}")
        kept = {s["path"] for t in TABLES for s in manifest[t]}
        for old in {s["path"] for t in TABLES for s in self._manifest[t]} - kept:
            fs.delete(filesystem(self.spark, old)[1], True)
        self._version, self._manifest = self._version + 1, manifest

    def _segment(self, df: DataFrame, table: str, expected: int) -> dict | None:
        """Writes rows of a table as a segment for about ``expected`` rows; None if there are none."""
        buckets = min(MAX_BUCKETS, 1 << max(0, int(np.ceil(np.log2(max(1, expected) / self.bucket_rows)))))
        path, counted = f"{self.path}/segments/{table}-{uuid.uuid4().hex}", Observation()
        schema, key = TABLES[table]
        rows = df.select(*(c.split()[0] for c in schema.split(", "))).observe(counted, F.count(F.lit(1)).alias("n"))
        if buckets > 1:
            # Rebalanced by bucket: a bucket that outgrows a task, as of a hot token, is divided among several.
            rows = rows.withColumn("bucket", F.expr(f"cast(pmod({key}, {buckets}) as int)")).hint("rebalance", F.col("bucket"))
            rows.sortWithinPartitions("bucket", schema.split()[0]).write.option("compression", "zstd").partitionBy("bucket").parquet(path)
        else:
            rows.write.option("compression", "zstd").parquet(path)
        return {"path": path, "rows": counted.get["n"], "buckets": buckets} if counted.get["n"] else None

    def _add(self, new: dict[str, tuple[DataFrame, int]], order: str | None = None) -> None:
        """Appends rows to the tables, merges segments of like size, and commits both at once."""
        manifest = {"order": order or self._manifest["order"]}
        for table in TABLES:
            segments = list(self._manifest[table])
            added = self._segment(*new[table][:1], table, new[table][1]) if table in new else None
            segments += [added] if added else []
            while True:
                level = lambda s: int(np.log2(s["rows"]) // 3)
                alike = next((like for like in ([s for s in segments if level(s) == k] for k in sorted({level(s) for s in segments})) if len(like) >= MERGED), None)
                if alike is None:
                    break
                merged = self._segment(self._rows(table, alike), table, sum(s["rows"] for s in alike))
                for s in alike:
                    segments.remove(s)
                segments.append(merged)
            manifest[table] = segments
        self._commit(manifest)

    def _rows(self, table: str, segments: list[dict] | None = None, buckets: set[int] | None = None, columns: str = "*") -> DataFrame:
        """The rows of a table, of the given buckets (of the finest division there is) or all."""
        schema, _ = TABLES[table]
        parts = []
        for s in self._manifest[table] if segments is None else segments:
            if s["buckets"] == 1:
                parts.append(self.spark.read.schema(schema).parquet(s["path"]).select(columns))
                continue
            found = self.spark.read.schema(f"{schema}, bucket int").parquet(s["path"])
            own = None if buckets is None else {b % s["buckets"] for b in buckets}
            if own is not None and len(own) < s["buckets"]:
                found = found.filter(F.col("bucket").isin(sorted(own)))
            parts.append(found.drop("bucket").select(columns))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema).select(columns)

    def _buckets(self, table: str, keys: DataFrame) -> set[int] | None:
        """The buckets into which keys of a table fall: at most MAX_BUCKETS numbers. None: all."""
        finest = max((s["buckets"] for s in self._manifest[table]), default=1)
        if finest == 1:
            return None
        return {r[0] for r in keys.select(F.expr(f"pmod({TABLES[table][1]}, {finest})")).distinct().collect()}

    def probed(self, table: str, keys: DataFrame, columns: str = "*") -> DataFrame:
        """The rows of a table in the buckets of the given keys (with the column that its buckets are of)."""
        return self._rows(table, None, self._buckets(table, keys), columns)

    # Building

    def build(self, history: DataFrame, key: str = "seq", review_id: str = "review_id", text: str = "cleaned_text") -> IncrementalIndex:
        """Makes the index of a first history, all of which counts as accepted."""
        rows = with_bags(history.select(F.col(key).cast("long").alias("seq"), F.col(text).alias("text")), self.least).filter("bag is not null")
        counted = Observation()
        texts = stage(rows.groupBy("bag").agg(F.min_by("text", "seq").alias("text")).select(F.xxhash64("bag").alias("id"), "bag", "text").observe(counted, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")), "history-texts")
        order = f"{self.path}/segments/order-{uuid.uuid4().hex}"
        self._token_counts(texts).write.parquet(order)
        self._manifest["order"] = order
        n, chars = counted.get["n"], counted.get["chars"]
        ids = history.select(F.col(review_id).alias("review_id")).filter(F.trim("review_id") != "").distinct()
        # About a fifth of a text's words, of some six signs, are in its prefix.
        self._add({"texts": (texts, n), "postings": (self._postings(texts), n + chars // 30), "ids": (ids, n)}, order)
        unstage(texts)
        return self

    def _token_counts(self, rows: DataFrame) -> DataFrame:
        least = self.least

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros(1 << SLOT_BITS, np.int64)
            for batch in batches:
                for t in batch.column(0).to_pylist():
                    np.add.at(counts, _slots(elements(t, least)), 1)
            slots = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(counts[slots])], names=["slot", "n"])

        return rows.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))

    def order(self) -> np.ndarray:
        """The counter of each slot: at most 2 ** SLOT_BITS rows come to the driver."""
        if self._order is None:
            rows = self.spark.read.schema("slot long, n long").parquet(self._manifest["order"]).toArrow()
            self._order = np.zeros(1 << SLOT_BITS, np.uint32)
            self._order[rows.column(0).to_numpy()] = np.minimum(rows.column(1).to_numpy(), 0xFFFFFFFF)
        return self._order

    def _postings(self, texts: DataFrame, with_text: bool = False) -> DataFrame:
        """POSTING rows of (id, bag, text); with bag and text in the row of a bag's first token if asked for."""
        order, threshold = self.spark.sparkContext.broadcast(self.order()), self.threshold

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rank = order.value
            for batch in batches:
                for at in range(0, batch.num_rows, 5000):
                    part = batch.slice(at, 5000)
                    tokens, ids, sizes, positions, sketches = [], [], [], [], []
                    for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                        e = elements(t)
                        k = prefix_length(len(e), threshold)
                        first = e[np.lexsort((e, rank[_slots(e)]))[:k]]
                        tokens.append(first)
                        ids.append(np.full(k, i, np.int64))
                        sizes.append(np.full(k, len(e), np.int32))
                        positions.append(np.arange(k, dtype=np.int32))
                        sketches.append(np.broadcast_to(sketch(e), (k, SKETCH_WORDS)))
                    if tokens:
                        s = np.concatenate(sketches)
                        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
                        columns = [np.concatenate(tokens).view(np.int64), np.concatenate(ids), np.concatenate(sizes), np.concatenate(positions), *(np.ascontiguousarray(s[:, j]) for j in range(SKETCH_WORDS))]
                        arrays = [pa.array(c) for c in columns]
                        if with_text:
                            at = pa.array(np.where(columns[3] == 0, np.repeat(np.arange(len(tokens)), size), -1), mask=columns[3] != 0)
                            arrays += [part.column(2).take(at), part.column(1).take(at)]
                        yield pa.RecordBatch.from_arrays(arrays, names=["token", "id", "n", "pos", "s0", "s1", "s2", "s3", *(["bag", "text"] if with_text else [])])

        return texts.select("id", "text", "bag").mapInArrow(run, POSTING + (", bag binary, text string" if with_text else ""))

    # Probing

    def _may_be_near(self) -> Column:
        """Whether the bags of the postings l and r may reach the threshold, judged at the first token they share."""
        n = F.col("l.n") + F.col("r.n")
        least = F.ceil(F.lit(self.threshold / (1 + self.threshold)) * n - F.lit(1e-9))
        rest = 1 + F.least(F.col("l.n") - F.col("l.pos"), F.col("r.n") - F.col("r.pos")) - 1
        apart = sum(F.bit_count(F.col(f"l.s{i}").bitwiseXOR(F.col(f"r.s{i}"))) for i in range(SKETCH_WORDS))
        return (
            (F.col("r.n") >= F.col("l.n") * self.threshold - 1e-9) & (F.col("l.n") >= F.col("r.n") * self.threshold - 1e-9)
            & (rest >= least) & (apart <= n - 2 * least)
        )

    def _hits(self, table: str, keys: DataFrame, n: int, on: str) -> DataFrame:
        """The keys of a batch that the history has: its buckets are read past the batch's keys, never shuffled for a small batch."""
        known = self.probed(table, keys if on == "review_id" else keys.select("id"), on)
        return known.join(_small(keys.select(on), n), on, "left_semi").distinct()

    def _prepared(self, batch: DataFrame, key: str, batch_no: str, review_id: str, text: str) -> DataFrame:
        rows = batch.select(F.col(key).cast("long").alias("seq"), F.col(batch_no).cast("long").alias("batch_no"), F.when(F.trim(review_id) != "", F.col(review_id)).alias("review_id"), F.col(text).alias("text"))
        o = F.struct(F.coalesce("batch_no", F.lit(-(2**62))).alias("batch"), F.col("seq"))
        return with_bags(rows, self.least).withColumn("id", F.when(F.col("bag").isNotNull(), F.xxhash64("bag"))).withColumn("o", o)

    def admit(self, batch: DataFrame, key: str = "seq", batch_no: str = "batch_no", review_id: str = "review_id", text: str = "cleaned_text", append: bool = True) -> DataFrame:
        """(seq, batch_no, duplicate) of every row of a batch; accepted rows enter the index.

        Rows of several batches at once are judged in their order, with the same result as one batch after the other.
        """
        counted = Observation()
        rows = stage(self._prepared(batch, key, batch_no, review_id, text).observe(counted, F.count(F.lit(1)).alias("n")), "batch")
        return self._flagged(rows, self._admit(rows, counted.get["n"], append))

    def admit_batches(self, batches: DataFrame, key: str = "seq", batch_no: str = "batch_no", review_id: str = "review_id", text: str = "cleaned_text", at_once: int = 4) -> DataFrame:
        """(seq, batch_no, duplicate) of all rows, ``at_once`` batches a step: what a step accepts enters the index before the next step probes it.

        The result doesn't depend on ``at_once``, as the rows of a step are judged in their order; it is the number of commits
        that is paid for, each with some forty small jobs.
        """
        prepared = self._prepared(batches, key, batch_no, review_id, text).withColumn("part", F.col("batch_no"))
        rows = stage(prepared.hint("rebalance", F.col("part")), "batches", ["part"])
        sizes = rows.groupBy("part").agg(F.count("*").alias("n")).orderBy(F.asc_nulls_first("part")).limit(MAX_BATCHES + 1).collect()
        if len(sizes) > MAX_BATCHES:
            raise ValueError(f"more than {MAX_BATCHES} batches at once")
        accepted = []
        for at in range(0, len(sizes), at_once):
            step = sizes[at : at + at_once]
            inside = reduce(Column.__or__, (F.col("part").eqNullSafe(F.lit(r["part"])) for r in step))
            accepted.append(self._admit(rows.filter(inside), sum(r["n"] for r in step), True))
        return self._flagged(rows, reduce(DataFrame.unionByName, accepted) if accepted else rows.select("o").limit(0))

    def _flagged(self, rows: DataFrame, accepted: DataFrame) -> DataFrame:
        return rows.select("o", "seq", "batch_no").join(accepted.withColumn("kept", F.lit(True)), "o", "left").select("seq", "batch_no", F.col("kept").isNull().alias("duplicate"))

    def _admit(self, rows: DataFrame, n: int, append: bool) -> DataFrame:
        """(o) of the accepted rows among ``n`` prepared ones."""
        by_id = self._hits("ids", rows.select("review_id").filter("review_id is not null"), n, "review_id")
        open_rows = stage(rows.join(by_id, "review_id", "left_anti").select("o", "review_id", "id", "bag", "text"), "open")
        # The texts of the batch, one for each bag, against the history and against each other.
        distinct = open_rows.filter("bag is not null").groupBy("bag").agg(F.min_by("text", "o").alias("text")).select(F.xxhash64("bag").alias("id"), "bag", "text")
        counted = Observation()
        postings = stage(self._postings(distinct, True).observe(counted, F.count(F.lit(1)).alias("n")), "postings")
        m = counted.get["n"]
        fresh = postings.filter("pos = 0").select("id", "bag", "text")
        keys = postings.drop("bag", "text")
        history = self.probed("postings", keys.select("token"))
        met = (F.col("l.token") == F.col("r.token")) & self._may_be_near()
        old = history.alias("r").join(_small(keys, m).alias("l"), met).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), F.lit(True).alias("old"))
        new = keys.alias("l").join(keys.alias("r"), met & (F.col("l.id") < F.col("r.id"))).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), F.lit(False).alias("old"))
        paired = Observation()
        pairs = edges = stage(old.unionByName(new).distinct().observe(paired, F.count(F.lit(1)).alias("n")), "candidates")
        if paired.get["n"]:
            wanted = pairs.filter("old").select(F.col("b").alias("id")).distinct()
            fetched = self.probed("texts", wanted, ["id", "text"]).join(_small(wanted, paired.get["n"]), "id", "left_semi")
            others = fetched.withColumn("old", F.lit(True)).unionByName(fresh.select("id", "text").withColumn("old", F.lit(False)))
            edges = stage(self._near(pairs, fresh, others), "edges")
        known = edges.filter("old").select(F.col("a").alias("id")).distinct()
        left = stage(open_rows.join(known, "id", "left_anti").select("o", "review_id", "id"), "left")
        accepted = self._resolve(left, edges.filter("not old").select("a", "b"))
        if append:
            taken = left.join(accepted, "o", "left_semi")
            texts = taken.select("id").filter("id is not null").distinct()
            self._add({
                "texts": (fresh.join(texts, "id", "left_semi"), n), "postings": (keys.join(texts, "id", "left_semi"), m),
                "ids": (taken.select("review_id").filter("review_id is not null").distinct(), n),
            })
        unstage(open_rows, postings, pairs, edges)
        return accepted

    def _near(self, pairs: DataFrame, fresh: DataFrame, others: DataFrame) -> DataFrame:
        """The candidates (a, b, old) whose texts are near, a among the fresh ones and b among the others (id, text, old)."""
        t = fresh.select("id", "text")
        both = pairs.join(t.select(F.col("id").alias("a"), F.col("text").alias("_ta")), "a").join(others.select(F.col("id").alias("b"), "old", F.col("text").alias("_tb")), ["b", "old"])
        return compared(both.select("a", "b", "old", "_ta", "_tb"), self.threshold)

    def _resolve(self, rows: DataFrame, edges: DataFrame) -> DataFrame:
        """The ``o`` of accepted rows among (o, review_id, id), none of which has a duplicate in the history.

        A row publishes its review id and its bag, and listens to them and to near bags; groups of copies are thus as
        many rows as they have members, never pairs. The number of rounds is the longest chain of rows that depend on each other.
        """
        id_key, bag_key = F.concat(F.lit("i"), F.col("review_id")), F.concat(F.lit("b"), F.col("id").cast("string"))
        published = rows.select("o", F.explode(F.array_compact(F.array(id_key, bag_key))).alias("key"))
        both_ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        heard = published.withColumn("own", F.lit(True)).unionByName(rows.join(both_ways, rows.id == both_ways.a).select("o", F.concat(F.lit("b"), F.col("b").cast("string")).alias("key"), F.lit(False).alias("own")))
        shared = published.groupBy("key").agg(F.count("*").alias("n"))
        # Only rows that hear of another row take part in the rounds.
        counted = Observation()
        tied = stage(heard.groupBy("key", "o").agg(F.max("own").alias("own")).join(shared, "key").filter("n > 1 or not own").select("o", "key", "own").observe(counted, F.count(F.lit(1)).alias("n")), "heard")
        if not counted.get["n"]:
            return rows.select("o")
        # A row that others hear of but that hears of none is settled from the start: it is accepted.
        state = tied.select("o").distinct().withColumn("settled", F.lit(None).cast("boolean"))
        said_by = published.join(tied.select("key").distinct(), "key", "left_semi")
        rounds = []
        while True:
            said = said_by.join(state.withColumn("known", F.lit(True)), "o", "left").groupBy("key").agg(
                F.min(F.when(F.col("settled") | F.col("known").isNull(), F.col("o"))).alias("kept"), F.min(F.when(F.col("settled").isNull() & F.col("known"), F.col("o"))).alias("unsettled")
            )
            now = tied.select("o", "key").join(state.filter("settled is null"), "o").join(said, "key", "left").groupBy("o").agg(F.min("kept").alias("kept"), F.min("unsettled").alias("unsettled"))
            verdict = now.select("o", F.when(F.col("kept") < F.col("o"), False).when(F.coalesce(F.col("unsettled") >= F.col("o"), F.lit(True)), True).alias("settled"))
            counted = Observation()
            state = stage(state.filter("settled is not null").unionByName(verdict).observe(counted, F.count_if(F.col("settled").isNull()).alias("n")), "round")
            rounds.append(state)
            if not counted.get["n"]:
                break
        accepted = stage(rows.select("o").join(state.filter("not settled").select("o"), "o", "left_anti"), "accepted")
        unstage(tied, *rounds)
        return accepted
