"""Near-duplicate texts by MinHash candidates with Bayesian pruning and exact verification.

Rows with equal bags are one class; only classes are compared. Candidates are classes that agree in all MinHash values of
a band. Within the join on bands, further MinHash values (one bit of each) are compared in steps; a pair is dropped as
soon as the posterior probability that its similarity reaches the threshold falls below ``TOLERANCE``. What remains is
verified exactly on the texts, so no false pair comes out. A band that many classes share is one sort-merge join key, which
adaptive execution divides among tasks as it does any skewed partition; its pairs are compared inside the join, not emitted. The chance to miss a pair is that of no band agreeing
(5e-6 for a pair just at the threshold, far less above) plus the tolerance.

Null and empty texts, and those of fewer than ``MIN_WORDS`` words, are near to nothing. Rows with equal texts are near to
each other. Columns other than the key and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from reviewloom.llm.words import MIN_WORDS, THRESHOLD, bags, classes_of, elements, mix, verified
from reviewloom.staging import stage, unstage

#: Bands of MinHash values: a pair at similarity s shares none with probability (1 - s ** WIDTH) ** BANDS.
BANDS, WIDTH = 40, 6
#: Further MinHash values compared bit by bit, and after how many of them a pair may be dropped.
BITS, STEPS = 128, (32, 64, 128)
TOLERANCE = 1e-6
_TOKENS_AT_ONCE = 2048

_N = BANDS * WIDTH + BITS
_seeds = mix(np.arange(1, 2 * _N + 1, dtype=np.uint64))
_A = (_seeds[:_N] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (_seeds[_N:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_BAND_NO = mix(np.arange(1000, 1000 + BANDS, dtype=np.uint64))


def minhashes(e: np.ndarray) -> np.ndarray:
    """The values of all hash functions, well mixed."""
    x, y = e.astype(np.uint32), (e >> np.uint64(32)).astype(np.uint32)
    least = np.full(_N, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(e), _TOKENS_AT_ONCE):
        h = x[at : at + _TOKENS_AT_ONCE, None] * _A
        h += y[at : at + _TOKENS_AT_ONCE, None] * _B
        np.minimum(least, h.min(axis=0), out=least)
    least ^= least >> np.uint32(15)
    least *= np.uint32(0x2C1B3C6D)
    least ^= least >> np.uint32(12)
    least *= np.uint32(0x297A2D39)
    return least ^ (least >> np.uint32(15))


def signature(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, bits as two signed 64-bit numbers)."""
    v = minhashes(e)
    keys = _BAND_NO.copy()
    for column in v[: BANDS * WIDTH].reshape(BANDS, WIDTH).T:
        keys = mix(keys ^ column.astype(np.uint64))
    bits = np.packbits((v[BANDS * WIDTH :] >> np.uint32(31)).astype(np.uint8)).view(np.int64)
    return keys.view(np.int64), bits


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """The fewest of ``n`` matching bits with which a pair may still reach the threshold.

    A bit matches with probability p = (1 + s) / 2 at similarity s. With s uniform a priori, the posterior of
    p >= (1 + threshold) / 2 after m matches is a ratio of two incomplete beta integrals, sums of binomials here.
    """

    def above(x: float, m: int) -> float:  # the integral over p > x, but for a common factor
        return sum(comb(n + 1, j) * x**j * (1 - x) ** (n + 1 - j) for j in range(m + 1))

    for m in range(n + 1):
        if above((1 + threshold) / 2, m) >= tolerance * above(0.5, m):
            return m
    return n


def _likely(threshold: float, tolerance: float) -> Column:
    """Whether a pair of band rows l, r survives all steps; later steps are evaluated only for survivors of the earlier."""
    x0, x1 = (F.col(f"l.s{i}").bitwiseXOR(F.col(f"r.s{i}")) for i in (0, 1))
    differing = {32: F.bit_count(x0.bitwiseAND(F.lit(0xFFFFFFFF))), 64: F.bit_count(x0), 128: F.bit_count(x0) + F.bit_count(x1)}
    kept = F.lit(True)
    for n in STEPS:
        kept = kept & (differing[n] <= n - least_matches(n, threshold, tolerance))
    return kept


def _band_rows(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                signed = [signature(elements(t)) for t in part.column(1).to_pylist()]
                if not signed:
                    continue
                reps = np.repeat(part.column(0).to_numpy(zero_copy_only=False), BANDS)
                s = np.repeat(np.stack([bits for _, bits in signed]), BANDS, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([k for k, _ in signed])), pa.array(reps), pa.array(np.ascontiguousarray(s[:, 0])), pa.array(np.ascontiguousarray(s[:, 1]))], names=["band", "rep", "s0", "s1"])

    return classes.select("rep", "text").mapInArrow(run, "band long, rep long, s0 long, s1 long")


class NearDuplicates:
    """Near-duplicate classes of a table.

    rows: (seq, bag) of the rows long enough; classes: (bag, rep, text, copies); pairs: (a, b), a < b, of near classes by rep.
    """

    def __init__(self, df: DataFrame, key: str, text: str, threshold: float = THRESHOLD, least: int = MIN_WORDS, tolerance: float = TOLERANCE) -> None:
        rows = stage(bags(df, key, text, least), "bags")
        self.rows = rows.select("seq", "bag")
        self.classes = stage(classes_of(rows), "classes")
        bands = _band_rows(self.classes)
        candidates = (
            bands.alias("l").join(bands.alias("r"), (F.col("l.band") == F.col("r.band")) & (F.col("l.rep") < F.col("r.rep")) & _likely(threshold, tolerance))
            .select(F.col("l.rep").alias("a"), F.col("r.rep").alias("b")).distinct()
        )
        self.pairs = stage(verified(candidates, self.classes, threshold), "pairs")

    def members(self) -> DataFrame:
        """(rep, seq) of every row."""
        return self.rows.join(self.classes.select("bag", "rep"), "bag").select("rep", "seq")

    def row_pairs(self) -> DataFrame:
        """(seq_a, seq_b) of all near rows; as many as there are, so groups of copies come out quadratic by definition."""
        several = self.members().join(self.classes.filter("copies > 1").select("rep"), "rep", "left_semi")
        inside = several.alias("x").join(several.alias("y"), (F.col("x.rep") == F.col("y.rep")) & (F.col("x.seq") < F.col("y.seq"))).select(F.col("x.seq").alias("seq_a"), F.col("y.seq").alias("seq_b"))
        m = self.members()
        across = (
            self.pairs.join(m.select(F.col("rep").alias("a"), F.col("seq").alias("x")), "a").join(m.select(F.col("rep").alias("b"), F.col("seq").alias("y")), "b")
            .select(F.least("x", "y").alias("seq_a"), F.greatest("x", "y").alias("seq_b"))
        )
        return inside.unionByName(across)

    def links(self) -> DataFrame:
        """(seq, class_id, copies, links): for each row long enough the id of its class of equal bags, the rows of that class, and the classes near to it."""
        ends = self.pairs.select(F.col("a").alias("rep")).unionByName(self.pairs.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("links"))
        known = self.classes.select("bag", "rep", "copies").join(ends, "rep", "left")
        return self.rows.join(known, "bag").select("seq", F.col("rep").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))

    def groups(self) -> DataFrame:
        """(seq, group_id, size): the groups that near pairs and copies connect; group_id is the smallest seq of the group.

        Each class takes the least id among its neighbours', then the id of that one, until nothing moves: the distance that
        an id travels doubles with each round, and a round is a join over the pairs. Rows without a near one are groups of one.
        """
        both = self.pairs.unionByName(self.pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        heads = stage(both.groupBy("a").agg(F.least("a", F.min("b")).alias("head")), "heads")
        while True:
            near = both.join(heads.select(F.col("a").alias("b"), "head"), "b").groupBy("a").agg(F.min("head").alias("heard"))
            least = heads.join(near, "a").select("a", F.least("head", "heard").alias("to"), F.col("head").alias("was"))
            counted = Observation()
            jumped = least.join(heads.select(F.col("a").alias("to"), F.col("head").alias("further")), "to").select("a", F.least("to", "further").alias("head"), "was")
            moved = stage(jumped.observe(counted, F.count_if(F.col("head") < F.col("was")).alias("n")).select("a", "head"), "heads")
            unstage(heads)
            heads = moved
            if not counted.get["n"]:
                break
        ids = self.classes.join(heads.select(F.col("a").alias("rep"), "head"), "rep", "left").select("bag", "copies", F.coalesce("head", "rep").alias("group_id"))
        sizes = ids.groupBy("group_id").agg(F.sum("copies").alias("size"))
        return self.rows.join(ids.select("bag", "group_id"), "bag").join(sizes, "group_id").select("seq", "group_id", "size")
