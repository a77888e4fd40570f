"""Texts as bags of words, and the similarity of bags.

The words of a text are the maximal runs of a-z and 0-9 after lower-casing. A bag is held as a set of 64-bit elements,
one for each (word, occurrence number), so that the similarity of two bags (each word counting the lesser of its
frequencies in common, the greater in total) is the Jaccard similarity of two sets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.staging import spread

WORD = re.compile("[a-z0-9]+")
MIN_WORDS, THRESHOLD = 25, 0.8
MEMO_WORDS = 300_000
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_hash_of: dict[str, int] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all."""
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _STEP
    return x ^ (x >> np.uint64(32))


def elements(text: str | None, least: int = 1) -> np.ndarray | None:
    """The sorted elements of a text's bag; None for fewer than ``least`` words, and for null."""
    words = WORD.findall(text.lower()) if text else []
    if len(words) < least:
        return None
    if len(_hash_of) > MEMO_WORDS:
        _hash_of.clear()
    hashes = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        h = _hash_of.get(w)
        if h is None:
            h = _hash_of[w] = xxhash.xxh64_intdigest(w)
        hashes[i] = h
    hashes.sort()
    new = np.ones(len(hashes), bool)
    np.not_equal(hashes[1:], hashes[:-1], out=new[1:])
    at = np.arange(len(hashes))
    occurrence = at - np.maximum.accumulate(np.where(new, at, 0))
    found = mix(hashes + occurrence.astype(np.uint64) * _STEP)
    found.sort()
    return found


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


@cache
def as_fraction(threshold: float) -> Fraction:
    return Fraction(threshold).limit_denominator(10_000)


def near(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether the similarity reaches the threshold, in whole numbers: 0.8 is taken as four fifths."""
    t = as_fraction(threshold)
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common * t.denominator >= t.numerator * (len(a) + len(b) - common)


def with_bags(df: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """``df`` (with ``text``) and the key of each text's bag, 16 bytes; null bag and text for fewer than ``least`` words."""
    names = [c for c in df.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            texts = batch.column(len(names)).to_pylist()
            for i, t in enumerate(texts):
                e = elements(t, least)
                keys.append(None if e is None else xxhash.xxh3_128_digest(e.tobytes()))
                if e is None:
                    texts[i] = None
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(texts, pa.string()), pa.array(keys, pa.binary())], names=[*names, "text", "bag"])

    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in names)
    return spread(df.select(*names, "text")).mapInArrow(run, f"{schema}, text string, bag binary")


def bags(df: DataFrame, key: str, text: str, least: int = MIN_WORDS) -> DataFrame:
    """(seq, bag, text) of the rows with at least ``least`` words; equal bags have equal 16-byte keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, keys = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                e = elements(t, least)
                if e is not None:
                    keep.append(i)
                    keys.append(xxhash.xxh3_128_digest(e.tobytes()))
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column(0), pa.array(keys, pa.binary()), kept.column(1)], names=["seq", "bag", "text"])

    rows = spread(df.select(F.col(key).cast("long").alias("seq"), F.col(text).alias("text")))
    return rows.mapInArrow(run, "seq long, bag binary, text string")


def classes_of(rows: DataFrame) -> DataFrame:
    """(bag, rep, text, copies): one row for each bag, standing for all rows with it; rep is their smallest seq."""
    return rows.groupBy("bag").agg(F.min("seq").alias("rep"), F.min_by("text", "seq").alias("text"), F.count("*").alias("copies"))


def compared(pairs: DataFrame, threshold: float) -> DataFrame:
    """The rows whose last two columns, _ta and _tb, are near texts, by exact comparison, without these columns."""
    names = pairs.columns[:-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(len(names) + i).to_pylist() for i in (0, 1))
            memo: dict[str, np.ndarray] = {}

            def of(t: str) -> np.ndarray:
                if t not in memo:
                    memo[t] = elements(t)
                return memo[t]

            keep = [near(of(x), of(y), threshold) for x, y in zip(a, b)]
            yield pa.RecordBatch.from_arrays(batch.columns[: len(names)], names=names).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, pairs.select(*names).schema)


def verified(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of class ids whose texts are near; classes: (rep, text)."""
    t = classes.select("rep", "text")
    both = pairs.join(t.select(F.col("rep").alias("a"), F.col("text").alias("_ta")), "a").join(t.select(F.col("rep").alias("b"), F.col("text").alias("_tb")), "b")
    return compared(both.select("a", "b", "_ta", "_tb"), threshold)
