"""Most similar vectors by multi-index hashing over learned binary codes.

Vectors are scaled to unit length and rotated by a matrix learned on a bounded sample (principal axes, then alternating
rotation and binarisation), so that their signs are 64-bit codes. The code is cut into four substrings of 16 bits with an
index each. If two codes differ in at most ``RADIUS`` bits, one of their substrings differs in at most ``RADIUS // 4``;
probing all keys within that distance in each index therefore retrieves every code within the radius. What is retrieved
is compared by quantised vectors under a proven error bound, and the rest is ranked by the exact cosine.

Codes are divided at random into blocks of at most about ``BLOCK`` times ``PART``, and every two blocks meet in one task, which
holds the four indexes of one of them. A vector is thus sent once for each block, and no task grows with the collection. Where
keys are crowded, all codes of a key are compared with all that they can reach at once.

That serves neighbours above a floor. The nearest at any cosine (``nearest``) are often a fifth of all bits away. For them
codes of 256 bits are cut into sixteen substrings, each probed within r bits, which proves all codes within 16 * (r + 1) - 1
bits and finds most beyond that: a code further away is still retrieved if one of its sixteen substrings is near. The radius
grows (``NEAR_RADII``) for those vectors whose k-th neighbour so far is so far away that others like it are missed with more
than a chance of 1 - ``EXPECTED``; the last radius retrieves everything. All that is retrieved is ranked by quantised vectors
under the proven bound, then exactly.

Vectors that are null, hold nulls or NaN, are all zeros, or have another length than most, take no part. Equal vectors are
one class until the ranking, in which each row counts by itself; ties go to the smaller seq; a row is no neighbour of itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.staging import spread, stage

#: The rotation is learned on at most so many vectors, those with the smallest hash of their seq.
SAMPLE, ROUNDS = 20_000, 40
BITS, SUBSTRINGS, RADIUS = 64, 4, 11
_SUB = BITS // SUBSTRINGS
#: A retrieved code this many bits beyond the radius is still ranked: the probes find some of those as well.
BEYOND = 3
PART = 100_000
#: Codes of a block at most, in multiples of PART, and the least number of blocks.
BLOCK, BLOCKS = 8, 6
#: Codes a key from which those of a key are compared together.
CROWDED = 4
#: Codes of ``nearest``, the bits within which each substring is probed, and the least chance to retrieve a vector as near as the k-th found.
NEAR_BITS, NEAR_RADII, EXPECTED = 256, (2, 4, 6, _SUB), 0.75
def learn_rotation(x: np.ndarray, bits: int = BITS, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """(dimension, bits): a projection on principal axes, rotated so that signs lose little."""
    dim = x.shape[1]
    _, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, ::-1]
    rng = np.random.default_rng(seed)
    blocks = []
    for _ in range(-(-bits // dim)):
        width = min(bits, dim)
        z = x @ axes[:, :width]
        r, _ = np.linalg.qr(rng.normal(size=(width, width)))
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.where(z @ r >= 0, 1.0, -1.0).T @ z)
            r = (u @ vt).T
        blocks.append(axes[:, :width] @ r)
    return np.concatenate(blocks, axis=1)[:, :bits]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.ListArray) else column
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def masks_within(bits: int, radius: int) -> np.ndarray:
    """All numbers of ``bits`` bits with at most ``radius`` set."""
    x = np.arange(1 << bits)
    return x[np.bitwise_count(x) <= radius]


def least_cosine(radius: int) -> float:
    """The cosine down to which a vector's code is retrieved with a chance of ``EXPECTED``, bits differing independently."""

    def chance(p: float) -> float:
        one = sum(comb(_SUB, i) * p**i * (1 - p) ** (_SUB - i) for i in range(radius + 1))
        return 1 - (1 - one) ** (NEAR_BITS // _SUB)

    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if chance(mid) >= EXPECTED else (low, mid)
    return float(np.cos(np.pi * low))


def retrieved(key: np.ndarray, q: np.ndarray, scale: np.ndarray, asked_key: np.ndarray, asked_q: np.ndarray, asked_scale: np.ndarray, k: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(asked, found): for each asked vector those whose key is within ``radius`` bits and which may be among its ``k`` nearest.

    Cosines are those of quantised vectors; what may exceed the k-th best under their error bound is kept. One more is
    allowed for, as a vector meets itself.
    """
    order = np.argsort(key, kind="stable")
    first = np.searchsorted(key[order], np.arange((1 << _SUB) + 1))
    masks = masks_within(_SUB, radius).astype(np.int64)
    slack = np.sqrt(q.shape[1]) * 0.5 * 1.01 * scale
    asked, found = [], []
    for i in range(len(asked_key)):
        keys = asked_key[i] ^ masks
        starts, counts = first[keys], first[keys + 1] - first[keys]
        filled = counts > 0
        starts, counts = starts[filled], counts[filled]
        if not len(starts):
            continue
        at = order[np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
        c = (q[at].astype(np.float32) @ asked_q[i].astype(np.float32)) * (scale[at] * asked_scale[i])
        off = slack[at] + np.sqrt(q.shape[1]) * 0.5 * 1.01 * asked_scale[i]
        if len(at) > k + 1:
            least = np.partition(c - off, len(at) - k - 1)[len(at) - k - 1]
            keep = c + off >= least
            at = at[keep]
        asked.append(np.full(len(at), i))
        found.append(at)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *asked]), np.concatenate([none, *found])


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(seq, v): the rows whose vectors can be compared."""
    v = F.col("v")
    rows = df.select(F.col(key).cast("long").alias("seq"), F.col(vector).alias("v")).filter(
        v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    )
    common = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    return rows.filter(F.size("v") == (common[0]["dim"] if common else 0))


class MultiIndex:
    """Similar vectors of a table; ``classes`` holds (rep, v) of the distinct vectors, rep the smallest seq of equal ones."""

    def __init__(self, df: DataFrame, key: str = "seq", vector: str = "embedding", radius: int = RADIUS, floor: float = 0.9) -> None:
        """floor: neighbours below this cosine aren't asked for; ``radius`` is what catches those above it."""
        self.spark, self.radius, self.floor = df.sparkSession, radius, floor
        self.rows = usable(spread(df.select(key, vector)), key, vector)
        classes = self.rows.groupBy("v").agg(F.min("seq").alias("rep"), F.count("*").alias("copies"))
        self.classes = stage(classes, "vectors")
        self.dim = len((self.classes.select("v").first() or {"v": []})["v"])

    def _rotation(self, bits: int = BITS) -> np.ndarray:
        sample = self.classes.select("rep", "v").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("v").toArrow()
        x = _matrix(sample.column("v").combine_chunks(), self.dim)
        return learn_rotation(x / np.linalg.norm(x, axis=1, keepdims=True), bits)

    def _routed(self, blocks: int) -> DataFrame:
        """A row for each vector and block that its own one meets: (pair, first, rep, code, q, scale); first for the lower of the two blocks."""
        rotation, dim = self.spark.sparkContext.broadcast(self._rotation()), self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            other = np.arange(blocks)
            for batch in batches:
                for at in range(0, batch.num_rows, 4000):
                    part = batch.slice(at, 4000)
                    x = _matrix(part.column(1), dim)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    code = np.packbits(x @ rotation.value >= 0, axis=1).view(np.uint64)[:, 0]
                    scale = np.abs(x).max(axis=1) / 127
                    q = np.round(x / scale[:, None]).astype(np.int8)
                    packed = pa.Array.from_buffers(pa.binary(dim), len(x), [None, pa.py_buffer(q.tobytes())]).cast(pa.binary())
                    own = (part.column(0).to_numpy() * 2654435761 % (1 << 32) >> 7) % blocks
                    rows, met = np.repeat(np.arange(len(x)), blocks), np.tile(other, len(x))
                    low, high, take = np.minimum(own[rows], met), np.maximum(own[rows], met), pa.array(rows)
                    yield pa.RecordBatch.from_arrays([pa.array((low * blocks + high).astype(np.int32)), pa.array(own[rows] == low), part.column(0).take(take), pa.array(code.view(np.int64)[rows]), packed.take(take), pa.array(scale[rows])], names=["pair", "first", "rep", "code", "q", "scale"])

        return self.classes.select("rep", "v").mapInArrow(run, "pair int, first boolean, rep long, code long, q binary, scale double")

    def candidates(self) -> DataFrame:
        """(a, b), a < b: the classes whose codes are within the radius and whose cosine may reach the floor."""
        n = self.classes.count()
        if not n:
            return self.spark.createDataFrame([], "a long, b long")
        blocks = max(BLOCKS, -(-n // (BLOCK * PART)))
        dim, radius, floor, crowded = self.dim, self.radius, self.floor, CROWDED
        near_keys = masks_within(_SUB, radius // SUBSTRINGS).astype(np.int64)

        def one_by_one(code: np.ndarray, key: np.ndarray, home: np.ndarray, first: np.ndarray, probing: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            at_once = max(1, 4_000_000 // max(1, len(home) // 16 + len(near_keys)))
            for at in range(0, len(probing), at_once):
                probes = probing[at : at + at_once]
                keys = (key[probes, None] ^ near_keys[None]).ravel()
                starts, counts = first[keys], first[keys + 1] - first[keys]
                filled = np.flatnonzero(counts)
                owner, starts, counts = probes[filled // len(near_keys)], starts[filled], counts[filled]
                ends = np.cumsum(counts)
                # Runs of candidates, some millions at a time.
                cut = np.unique(np.searchsorted(ends, np.arange(0, (ends[-1] if len(ends) else 0) + 4_000_000, 4_000_000), side="right"))
                for lo, hi in zip(cut, [*cut[1:], len(ends)]):
                    if lo < hi:
                        c = counts[lo:hi]
                        a = np.repeat(owner[lo:hi], c)
                        b = home[np.repeat(starts[lo:hi] - (np.cumsum(c) - c), c) + np.arange(c.sum())]
                        keep = np.bitwise_count(code[a] ^ code[b]) <= radius + BEYOND
                        yield a[keep], b[keep]

        def by_key(code: np.ndarray, key: np.ndarray, home: np.ndarray, first: np.ndarray, probing: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            held = code[home]
            probing = probing[np.argsort(key[probing], kind="stable")]
            each, begin, size = np.unique(key[probing], return_index=True, return_counts=True)
            found, many = [], 0
            for k, at, m in zip(each.tolist(), begin.tolist(), size.tolist()):
                keys = k ^ near_keys
                starts, c = first[keys], first[keys + 1] - first[keys]
                reach = np.repeat(starts - (np.cumsum(c) - c), c) + np.arange(c.sum())
                y = held[reach]
                step = max(1, 1_000_000 // max(1, len(y)))
                for i in range(at, at + m if len(y) else at, step):
                    probes = probing[i : min(i + step, at + m)]
                    hit = np.flatnonzero(np.bitwise_count(code[probes, None] ^ y[None]) <= radius + BEYOND)
                    found.append((probes[hit // len(y)], home[reach[hit % len(y)]]))
                    many += len(hit)
                    if many > 1_000_000:
                        yield tuple(np.concatenate(x) for x in zip(*found))
                        found, many = [], 0
            if found:
                yield tuple(np.concatenate(x) for x in zip(*found))

        def probe(block: pa.Table) -> pa.Table:
            block = block.combine_chunks()
            rep, scale, first_block = (block.column(c).to_numpy() for c in ("rep", "scale", "first"))
            code = block.column("code").to_numpy().view(np.uint64)
            packed = block.column("q").combine_chunks()
            packed = packed if isinstance(packed, pa.Array) else packed.chunk(0)
            q = np.frombuffer(packed.buffers()[2], np.int8)[np.frombuffer(packed.buffers()[1], np.int32)[packed.offset] :][: len(rep) * dim].reshape(-1, dim)
            pair = block.column("pair")[0].as_py()
            within = pair // blocks == pair % blocks
            home = np.flatnonzero(first_block)
            probing = home if within else np.flatnonzero(~first_block)
            # Quantisation moves a component by half a step at most, so a cosine by at most the sum below.
            slack = np.sqrt(dim) * 0.5 * scale
            found_a, found_b = [], []
            for sub in range(SUBSTRINGS):
                key = code.view(np.uint16).reshape(-1, SUBSTRINGS)[:, sub].astype(np.int64)
                home = home[np.argsort(key[home], kind="stable")]
                first = np.searchsorted(key[home], np.arange((1 << _SUB) + 1))
                way = by_key if len(home) >= crowded * np.count_nonzero(np.diff(first)) else one_by_one
                for a, b in way(code, key, home, first, probing):
                    if within:  # each pair is met from both sides
                        keep = rep[a] < rep[b]
                        a, b = a[keep], b[keep]
                    if sub:  # a pair is reported by the first index that finds it
                        x = code[a] ^ code[b]
                        earlier = np.bitwise_count(x.view(np.uint16).reshape(-1, SUBSTRINGS)[:, :sub]).min(axis=1)
                        keep = earlier > radius // SUBSTRINGS
                        a, b = a[keep], b[keep]
                    for k in range(0, len(a), 200_000):
                        i, j = a[k : k + 200_000], b[k : k + 200_000]
                        dot = np.einsum("ij,ij->i", q[i].astype(np.float32), q[j].astype(np.float32)) * scale[i] * scale[j]
                        keep = dot >= floor - slack[i] * 1.01 - slack[j] * 1.01 - 1e-3
                        found_a.append(rep[i[keep]])
                        found_b.append(rep[j[keep]])
            none = np.zeros(0, np.int64)
            a, b = np.concatenate([none, *found_a]), np.concatenate([none, *found_b])
            return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

        return self._routed(blocks).groupBy("pair").applyInArrow(probe, "a long, b long")

    def _cosines(self, pairs: DataFrame) -> DataFrame:
        """(a, b, cosine) of pairs of distinct vectors, exact to twelve digits."""
        dim = self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, y = (_matrix(batch.column(i), dim) for i in (2, 3))
                c = np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round(np.minimum(c, 1.0), 12))], names=["a", "b", "cosine"])

        v = self.classes.select("rep", "v")
        both = pairs.join(v.select(F.col("rep").alias("a"), F.col("v").alias("x")), "a").join(v.select(F.col("rep").alias("b"), F.col("v").alias("y")), "b")
        return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, cosine double")

    def class_pairs(self) -> DataFrame:
        """(a, b, cosine) of distinct vectors with a cosine of at least the floor."""
        return self._cosines(self.candidates()).filter(F.col("cosine") >= self.floor)

    def neighbours(self, k: int = 5) -> DataFrame:
        """(seq, neighbour, cosine, rank): the ``k`` most similar rows of each row that are at the floor or above."""
        pairs = stage(self.class_pairs(), "cosines")
        return self._ranked(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine")), k)

    def nearest(self, k: int = 5, every: int = 20) -> DataFrame:
        """(seq, neighbour, cosine, rank): the ``k`` most similar rows, at any cosine, of each row whose seq is divisible by ``every``.

        All rows are indexed and may be found. Cosines and the order are exact, what is found is not all: see the README for
        the recall.
        """
        n = self.classes.count()
        asked = self.rows.filter(F.col("seq") % every == 0)
        found = self.spark.createDataFrame([], "a long, b long, cosine double")
        if not n:
            return self._ranked(found, k, asked)
        rotation = self.spark.sparkContext.broadcast(self._rotation(NEAR_BITS))
        pending = stage(self.classes.join(asked.select("v").distinct(), "v", "left_semi").select("rep"), "asked")
        for radius in NEAR_RADII:
            pairs = stage(self._cosines(self._probed(pending, rotation, n, k, radius)), "retrieved")
            found = found.unionByName(pairs)
            if radius == NEAR_RADII[-1]:
                break
            kth = pairs.withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine")))).filter((F.col("n") == k) & (F.col("cosine") >= least_cosine(radius)))
            pending = stage(pending.join(kth.select(F.col("a").alias("rep")), "rep", "left_anti"), "pending")
            if pending.isEmpty():
                break
        return self._ranked(found.distinct(), k, asked)

    def _probed(self, asking: DataFrame, rotation: Broadcast, n: int, k: int, radius: int) -> DataFrame:
        """(a, b): for each asking class (rep) the classes that one of its substrings retrieves and that may be among its nearest."""
        dim = self.dim
        subs = NEAR_BITS // _SUB
        leading = max(0, min(_SUB - 2, int(np.ceil(np.log2(max(1, n / PART))))))
        reach = masks_within(leading, radius) if leading else np.zeros(1, np.int64)

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 2000):
                    batch = whole.slice(at, 2000)
                    x = _matrix(batch.column(1), dim)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    keys = np.packbits(x @ rotation.value >= 0, axis=1).view(np.uint16).astype(np.int64)
                    scale = np.abs(x).max(axis=1) / 127
                    packed = pa.Array.from_buffers(pa.binary(dim), len(x), [None, pa.py_buffer(np.round(x / scale[:, None]).astype(np.int8).tobytes())]).cast(pa.binary())
                    asks = batch.column(2).to_numpy(zero_copy_only=False)
                    for query, masks in ((False, np.zeros(1, np.int64)), (True, reach)):
                        own = np.flatnonzero(asks) if query else np.arange(len(x))
                        rows = np.repeat(own, len(masks) * subs)
                        sub = np.tile(np.repeat(np.arange(subs), len(masks)), len(own))
                        key = keys[rows, sub]
                        part = (key >> (_SUB - leading)) ^ np.tile(masks, len(own) * subs)
                        take = pa.array(rows)
                        yield pa.RecordBatch.from_arrays([pa.array(sub.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(np.full(len(rows), query)), batch.column(0).take(take), pa.array(key.astype(np.int32)), packed.take(take), pa.array(scale[rows])], names=["sub", "part", "query", "rep", "key", "q", "scale"])

        def probe(pdf: pd.DataFrame) -> pd.DataFrame:
            query = pdf["query"].to_numpy()
            key, scale, rep = pdf["key"].to_numpy().astype(np.int64), pdf["scale"].to_numpy(), pdf["rep"].to_numpy()
            q = np.frombuffer(b"".join(pdf["q"]), np.int8).reshape(len(pdf), dim)
            i, j = retrieved(key[~query], q[~query], scale[~query], key[query], q[query], scale[query], k, radius)
            a, b = rep[query][i], rep[~query][j]
            return pd.DataFrame({"a": a[a != b], "b": b[a != b]})

        marked = self.classes.join(asking.withColumn("asks", F.lit(True)), "rep", "left").select("rep", "v", F.coalesce("asks", F.lit(False)).alias("asks"))
        routed = marked.mapInArrow(route, "sub int, part int, query boolean, rep long, key int, q binary, scale double")
        shards = F.lit(1)
        if leading:
            crowds = stage(routed.filter("not query").groupBy("sub", "part").agg(F.ceil(F.count("*") / (4 * PART)).cast("int").alias("shards")), "crowds")
            routed = routed.join(F.broadcast(crowds), ["sub", "part"])  # at most 16 * 2 ** leading rows
            shards = F.col("shards")
        own = F.array(F.pmod(F.xxhash64("rep"), shards).cast("int"))
        placed = routed.withColumn("shard", F.explode(F.when(F.col("query"), F.sequence(F.lit(0), shards - 1)).otherwise(own)))
        return placed.select("sub", "part", "shard", "query", "rep", "key", "q", "scale").groupBy("sub", "part", "shard").applyInPandas(probe, "a long, b long").distinct()

    def _ranked(self, both: DataFrame, k: int, asked: DataFrame | None = None) -> DataFrame:
        """The first ``k`` rows of each row (of those asked for), from classes b near to classes a."""
        members = stage(self.rows.join(self.classes.filter("copies > 1").select("v", "rep"), "v").select("rep", "seq").unionByName(self.classes.filter("copies = 1").select("rep", F.col("rep").alias("seq"))), "members")
        by_seq = Window.partitionBy("rep").orderBy("seq")
        few = members.withColumn("n", F.row_number().over(by_seq)).filter(F.col("n") <= k + 1)
        offered = (
            both.join(few.filter(F.col("n") <= k).select(F.col("rep").alias("b"), F.col("seq").alias("neighbour")), "b").select(F.col("a").alias("rep"), "neighbour", "cosine")
            .unionByName(few.join(self.classes.filter("copies > 1").select("rep"), "rep", "left_semi").select("rep", F.col("seq").alias("neighbour"), F.lit(1.0).alias("cosine")))
        )
        # One more than k, as a row may itself be among the first of its class.
        best = offered.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("cosine"), "neighbour"))).filter(F.col("n") <= k + 1)
        wanted = members if asked is None else members.join(asked.select("seq"), "seq", "left_semi")
        per_row = wanted.join(best, "rep").filter("seq <> neighbour")
        ranked = per_row.withColumn("rank", F.row_number().over(Window.partitionBy("seq").orderBy("n")))
        return ranked.filter(F.col("rank") <= k).select("seq", "neighbour", "cosine", "rank")

    def neighbour_pairs(self, k: int = 5) -> DataFrame:
        """(seq_a, seq_b), seq_a < seq_b: pairs of which one at least is among the ``k`` most similar of the other."""
        n = self.neighbours(k)
        return n.select(F.least("seq", "neighbour").alias("seq_a"), F.greatest("seq", "neighbour").alias("seq_b")).distinct()
