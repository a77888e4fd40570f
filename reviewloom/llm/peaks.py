"""Themes of a collection of texts by density peaks.

Texts become latent vectors: weighted words, projected on the leading axes of the whole collection, which a subspace
iteration over all texts finds. Equal vectors are one point with their number as its weight. Points are divided into cells
around pivots drawn from them, as many as give ``CELL`` points a cell, so that the cells of a point are those of its
neighbours. In blocked joins every point meets all points of its own and the ``VISITS`` - 1 next cells: their part of its
density is exact, with one kernel width for the whole collection; every further cell counts by its number of points at the
kernel value of its centre, so all points count in every density. The width is found in the same way: all records are
counted around all records, the near ones one by one and further cells at their centres. The nearest denser point is looked for in the same cells,
and among all points for those that are the densest of their cells. The peaks are chosen where density times distance falls
off most sharply within ``THEMES``, and all others follow their pointers, twice as far in each round, to one of them.
Crowded cells are divided among tasks, both as those met and as those meeting. The work grows in proportion to the points,
but for the comparison with pivots, of which there are at most ``MAX_PIVOTS``.

Equal bags of words are one record. Texts of fewer than ``LONG`` words are too short to make a theme: they follow the
nearest longer text, or belong to theme 0, general remarks, if none is near. So do null and empty texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.llm.words import bags, classes_of
from reviewloom.staging import stage, unstage

#: Words of the weighting: those in at least 1 / RARE and at most COMMON of the texts, the MAX_WORDS most frequent of them.
RARE, COMMON, MAX_WORDS = 2000, 0.12, 10_000
#: Latent axes: a few more than there are themes; more of them split themes by wording.
AXES, EXTRA, PASSES = 16, 8, 4
LONG = 12
#: Points of a cell on average, the cells that a point meets, and the most cells.
CELL, VISITS, MAX_PIVOTS = 2048, 3, 1 << 16
#: Points that are the densest of their cells, compared with all in one pass.
LEADERS_AT_ONCE = 20_000
#: Distances between records are counted in bins of a quarter of a power of two, so many at once: those from 2 ** -5 of a first estimate.
BINS, BELOW = 28, 20
#: "About a dozen" subjects, as the problem says.
THEMES = (10, 14)
#: The share of records that count as near, and the cosine below which a short text has no subject.
NEAR_SHARE, NO_SUBJECT = 0.01, 0.35
_WORD = re.compile(r"[a-z']{3,}")
_ANY_WORD = re.compile(r"[a-z0-9]+")


def _count_words(classes: DataFrame) -> DataFrame:
    """(word, n): in how many long texts each word occurs; the word '' counts the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            rows = list(counts.items())
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["word", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                low = t.lower()
                if len(_ANY_WORD.findall(low)) >= LONG:
                    counts.update({"", *_WORD.findall(low)})
            if len(counts) > 200_000:
                yield out()
        yield out()

    return classes.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _features(classes: DataFrame, weights: dict[str, tuple[int, float]]) -> DataFrame:
    """(rep, long, words, weights): each text as a sparse vector of unit length; empty if it has no weighted word."""
    known = classes.sparkSession.sparkContext.broadcast(({w: i for w, (i, _) in weights.items()}, np.array([idf for _, idf in weights.values()])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, idf = known.value
        for batch in batches:
            longs, ids, counts, sizes = [], [], [], []
            for t in batch.column(1).to_pylist():
                low = t.lower()
                longs.append(len(_ANY_WORD.findall(low)) >= LONG)
                before = len(ids)
                for w, n in Counter(_WORD.findall(low)).items():
                    i = number.get(w)
                    if i is not None:
                        ids.append(i)
                        counts.append(n)
                sizes.append(len(ids) - before)
            ids_, size = np.array(ids, np.int32), np.array(sizes, np.int64)
            row = np.repeat(np.arange(len(size)), size)
            v = idf[ids_] * (1 + np.log(np.array(counts, np.float64)))
            norm = np.sqrt(np.bincount(row, v * v, len(size)))
            offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (ids_, (v / norm[row]).astype(np.float32))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(longs, pa.bool_()), *lists], names=["rep", "long", "words", "weights"])

    return classes.select("rep", "text").mapInArrow(run, "rep long, long boolean, words array<int>, weights array<float>")


def _sparse(batch: pa.RecordBatch, words: int, weights: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of the batch's sparse rows."""
    lists = batch.column(words)
    sizes = np.diff(lists.offsets.to_numpy())
    return np.repeat(np.arange(batch.num_rows), sizes), lists.flatten().to_numpy(zero_copy_only=False), batch.column(weights).flatten().to_numpy(zero_copy_only=False).astype(np.float64)


def _dense(batch: pa.RecordBatch, words: int, weights: int, axes: np.ndarray) -> np.ndarray:
    rows, columns, values = _sparse(batch, words, weights)
    out = np.empty((batch.num_rows, axes.shape[1]))
    for k in range(axes.shape[1]):
        out[:, k] = np.bincount(rows, values * axes[columns, k], batch.num_rows)
    return out


def leading_axes(features: DataFrame, n_words: int, axes: int = AXES) -> np.ndarray:
    """(words, axes): the leading axes of all long texts but the first, which is their common mean.

    Each pass multiplies the collection's matrix of words by words with a thin one, in sums by word; a matrix of
    MAX_WORDS by axes is the most that reaches the driver.
    """
    spark = features.sparkSession
    width = min(axes + EXTRA, n_words)
    q, _ = np.linalg.qr(np.random.default_rng(5).normal(size=(n_words, width)))
    names = [f"v{k}" for k in range(width)]
    product = q
    for _ in range(PASSES):
        basis = spark.sparkContext.broadcast(q)

        def run(batches: Iterator[pa.RecordBatch], basis=basis) -> Iterator[pa.RecordBatch]:
            b = basis.value
            total = np.zeros(b.shape)
            for batch in batches:
                y = _dense(batch, 0, 1, b)
                rows, columns, values = _sparse(batch, 0, 1)
                for k in range(b.shape[1]):
                    total[:, k] += np.bincount(columns, values * y[rows, k], len(b))
            used = np.flatnonzero(np.abs(total).sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(np.ascontiguousarray(total[used, k])) for k in range(b.shape[1]))], names=["word", *names])

        sums = features.filter("long").select("words", "weights").mapInArrow(run, "word int, " + ", ".join(f"{n} double" for n in names)).groupBy("word").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
        product = np.zeros((n_words, width))
        product[sums.column("word").to_numpy()] = np.stack([sums.column(n).to_numpy() for n in names], axis=1)
        previous, (q, _) = q, np.linalg.qr(product)
        basis.unpersist()
    # The axes within the space found.
    values, turn = np.linalg.eigh(previous.T @ product)
    return (previous @ turn[:, ::-1])[:, 1:axes]


def _vectors(features: DataFrame, axes: np.ndarray) -> DataFrame:
    """(rep, long, z): latent vectors of unit length, null where there is nothing to project."""
    known = features.sparkSession.sparkContext.broadcast(axes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = _dense(batch, 2, 3, known.value)
            size = np.linalg.norm(z, axis=1)
            rows = [(z[i] / size[i]).astype(np.float32) if size[i] > 1e-6 else None for i in range(len(z))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float32()))], names=["rep", "long", "z"])

    return features.select("rep", "long", "words", "weights").mapInArrow(run, "rep long, long boolean, z array<float>")


def _bin(distance: np.ndarray) -> np.ndarray:
    """The number of the bin that holds a distance: bins begin at the numbers 1, 1.25, 1.5 and 1.75 times a power of two."""
    return np.maximum(distance, 0).astype(np.float32).view(np.int32) >> 21


def _bin_start(number: np.ndarray | int) -> np.ndarray:
    return (np.atleast_1d(number).astype(np.int32) << 21).view(np.float32).astype(np.float64)


def _counts(distance: np.ndarray, weight: np.ndarray, base: int) -> np.ndarray:
    """(rows, BINS): for each row of distances the weight of what lies below the ends of BINS bins from ``base`` on."""
    inside = distance < np.float32(_bin_start(base + BINS)[0])
    near = np.flatnonzero(inside.ravel())
    row = np.repeat(np.arange(len(distance)), np.count_nonzero(inside, axis=1))
    at = np.maximum(_bin(distance.ravel()[near]) - base, 0) + row * BINS
    each = np.bincount(at, None if (weight == 1).all() else weight[near - row * distance.shape[1]], len(distance) * BINS)
    return each.reshape(len(distance), BINS).cumsum(axis=1).astype(np.float64)


_COUNTS = [f"n{i}" for i in range(BINS)]


def _count_rows(rep: pa.Array, m: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([rep, m, *(pa.array(np.ascontiguousarray(n[:, i])) for i in range(BINS))], names=["rep", "m", *_COUNTS])


class Cells:
    """The cells of a table of points (rep, long, z, m): m rows have the vector z; ``centres`` holds (count, mean) of the long ones by cell."""

    def __init__(self, points: DataFrame, n_long: int, cell: int, visits: int) -> None:
        self.spark = points.sparkSession
        c = max(1, min(MAX_PIVOTS, -(-n_long // cell)))
        drawn = points.filter("long").select("rep", "z").orderBy(F.xxhash64("rep", F.lit(13)), "rep").limit(c).toPandas()
        self.pivots = self.spark.sparkContext.broadcast(np.stack(drawn["z"].to_numpy()).astype(np.float32))
        self.visits, self.cell, dim = min(visits, c), cell, len(drawn["z"].iat[0])
        pivots = self.pivots

        def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = pivots.value
            count, total, points_ = np.zeros(len(p)), np.zeros((len(p), dim)), np.zeros(len(p), np.int64)
            for batch in batches:
                z, m = _dense_rows(batch.column(0), dim), batch.column(1).to_numpy(zero_copy_only=False)
                home = (z @ p.T).argmax(axis=1)
                count += np.bincount(home, m, len(p))
                points_ += np.bincount(home, minlength=len(p))
                for k in range(dim):
                    total[:, k] += np.bincount(home, z[:, k] * m, len(p))
            used = np.flatnonzero(points_)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(count[used]), pa.array(points_[used]), *(pa.array(np.ascontiguousarray(total[used, k])) for k in range(dim))], names=["cell", "n", "points", *(f"s{k}" for k in range(dim))])

        sums = ["n", "points", *(f"s{k}" for k in range(dim))]
        kinds = ", ".join(f"{x} {'long' if x == 'points' else 'double'}" for x in sums)
        found = points.filter("long").select("z", "m").mapInArrow(homes, f"cell int, {kinds}").groupBy("cell").agg(*(F.sum(x).alias(x) for x in sums)).toArrow()
        at = found.column("cell").to_numpy()
        n, sizes, mean = np.zeros(c), np.zeros(c, np.int64), np.zeros((c, dim), np.float32)
        n[at], sizes[at] = found.column("n").to_numpy(), found.column("points").to_numpy()
        mean[at] = np.stack([found.column(f"s{k}").to_numpy() for k in range(dim)], axis=1) / n[at, None]
        self.dim = dim
        self.centres = self.spark.sparkContext.broadcast((n, mean, sizes))

    def routed(self, points: DataFrame, more: list[str]) -> DataFrame:
        """(cell, shard, part, query, met, rep, z, *more): a row for each cell that a point visits.

        A crowded cell's points are divided into shards of at most 4 * cell, its visitors into parts of at most as many
        rows as 4 * visits such shards; a visitor goes to all shards, a point to all parts.
        """
        pivots, centres, visits, dim, cell = self.pivots, self.centres, self.visits, self.dim, self.cell
        columns = ["rep", "z", *more]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p, (_, _, sizes) = pivots.value, centres.value
            shards = np.maximum(1, -(-sizes // (4 * cell)))
            for whole in batches:
                for start in range(0, whole.num_rows, 4000):
                    batch = whole.slice(start, 4000)
                    rep, s = batch.column(0).to_numpy(), _dense_rows(batch.column(1), dim) @ p.T
                    top = np.argpartition(-s, visits - 1, axis=1)[:, :visits] if visits < len(p) else np.tile(np.arange(len(p)), (len(s), 1))
                    home = s.argmax(axis=1)
                    row, visited = np.repeat(np.arange(len(s)), visits), top.ravel()
                    k = shards[visited]
                    # Every (shard, part) of the visited cell in which the row is met or asks.
                    row, visited, k, own = np.repeat(row, k * k), np.repeat(visited, k * k), np.repeat(k, k * k), np.concatenate([np.arange(x * x) for x in k]) if (k > 1).any() else np.zeros(len(row), np.int64)
                    shard, part = own // k, own % k
                    mixed = rep[row] * 2654435761 % (1 << 32) >> 7
                    met, query = (home[row] == visited) & (shard == mixed % k), part == (mixed >> 5) % k
                    keep = met | query
                    at = pa.array(row[keep])
                    places = [pa.array(x[keep].astype(np.int32)) for x in (visited, shard, part)]
                    yield pa.RecordBatch.from_arrays([*places, pa.array(query[keep]), pa.array(met[keep]), *(batch.column(i).take(at) for i in range(len(columns)))], names=["cell", "shard", "part", "query", "met", *columns])

        kinds = {c: points.schema[c].dataType.simpleString() for c in columns}
        return points.select(*columns).mapInArrow(run, "cell int, shard int, part int, query boolean, met boolean, " + ", ".join(f"{c} {k}" for c, k in kinds.items()))

    def far(self, points: DataFrame, width: float) -> DataFrame:
        """(rep, mass): the density that the cells which a point doesn't visit give, each at its centre."""
        pivots, centres, visits, dim = self.pivots, self.centres, self.visits, self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p, (n, mean, _) = pivots.value, centres.value
            for batch in batches:
                mass = np.zeros(batch.num_rows)
                if visits < len(p):
                    for at in range(0, batch.num_rows, 2000):
                        z = _dense_rows(batch.column(1).slice(at, 2000), dim)
                        k = kernel(1 - z @ mean.T, width) * n
                        np.put_along_axis(k, np.argpartition(-(z @ p.T), visits - 1, axis=1)[:, :visits], 0.0, axis=1)
                        mass[at : at + len(z)] = k.sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(mass)], names=["rep", "mass"])

        return points.select("rep", "z").mapInArrow(run, "rep long, mass double")

    def around(self, longs: DataFrame, base: int) -> DataFrame:
        """(rep, m, n0, n1, ..): how many records lie around each point below the ends of bins from ``base`` on, itself included."""
        pivots, centres, visits, dim = self.pivots, self.centres, self.visits, self.dim
        kinds = "rep long, m long, " + ", ".join(f"{n} double" for n in _COUNTS)

        def near(block: pa.Table) -> pa.Table:
            block = block.combine_chunks().sort_by("rep")
            z, weight = _dense_rows(block.column("z").combine_chunks(), dim), block.column("m").to_numpy().astype(np.float64)
            met, query = np.flatnonzero(block.column("met").to_numpy()), np.flatnonzero(block.column("query").to_numpy())
            y, of, n = z[met].T, weight[met], np.zeros((len(query), BINS))
            for i in range(0, len(query) if len(met) else 0, 256):
                n[i : i + 256] = _counts(1 - z[query[i : i + 256]] @ y, of, base)
            asked = block.take(pa.array(query)).combine_chunks()
            return pa.Table.from_batches([_count_rows(asked.column("rep").combine_chunks(), asked.column("m").combine_chunks(), n)])

        def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p, (count, mean, _) = pivots.value, centres.value
            at_once = max(1, 4_000_000 // len(p))
            for batch in batches:
                for at in range(0, batch.num_rows, at_once):
                    part = batch.slice(at, at_once)
                    z = _dense_rows(part.column(1), dim)
                    d = 1 - z @ mean.T
                    np.put_along_axis(d, np.argpartition(-(z @ p.T), visits - 1, axis=1)[:, :visits], np.float32(np.inf), axis=1)
                    yield _count_rows(part.column(0), part.column(2), _counts(d, count, base))

        found = self.routed(longs, ["m"]).groupBy("cell", "shard", "part").applyInArrow(near, kinds)
        if visits < len(pivots.value):
            found = found.unionByName(longs.select("rep", "z", "m").mapInArrow(far, kinds))
        return found.groupBy("rep").agg(F.first("m").alias("m"), *(F.sum(n).alias(n) for n in _COUNTS))

    def kernel_width(self, points: DataFrame) -> float:
        """The median, over all records, of the distance within which NEAR_SHARE of the records lie; interpolated within a bin."""
        n, mean, _ = self.centres.value
        total = int(n.sum())
        if total < 2:
            return 1e-6
        need = 1 + min(total - 1, max(1, int(total * NEAR_SHARE)))
        # First estimate: each cell's records at its centre, as far from one another as they are on average.
        reach = np.empty(len(n))
        for i in range(0, len(n), 128):
            d = 1 - mean[i : i + 128] @ mean.T
            order = d.argsort(axis=1)
            place = (np.take_along_axis(np.broadcast_to(n, d.shape), order, axis=1).cumsum(axis=1) >= need).argmax(axis=1)
            reach[i : i + 128] = np.take_along_axis(d, order, axis=1)[np.arange(len(d)), place]
        by_reach = reach.argsort()
        estimate = reach[by_reach][(n[by_reach].cumsum() * 2 >= total).argmax()]
        least = int(_bin(np.float32([1e-6]))[0])
        base = max(least, int(_bin(np.float32([estimate]))[0]) - BELOW)
        longs = points.filter("long")
        while True:
            enough = self.around(longs, base).agg(*(F.sum(F.when(F.col(c) >= need, F.col("m")).otherwise(0)).alias(c) for c in _COUNTS)).first()
            share = np.array([enough[c] or 0 for c in _COUNTS]) / total
            if share[0] >= 0.5 and base > least:  # the first bin holds all that is nearer
                base = max(least, base - BINS + 1)
            elif share[-1] < 0.5 and _bin_start(base + BINS)[0] < 4:
                base += BINS - 1
            else:
                break
        i = int((share >= 0.5).argmax())
        low, high = _bin_start(base + i)[0], _bin_start(base + i + 1)[0]
        if not i:
            return max(high, 1e-6)
        return max(float(low + (high - low) * (0.5 - share[i - 1]) / (share[i] - share[i - 1])), 1e-6)


def _dense_rows(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


def kernel(distance: np.ndarray, width: float) -> np.ndarray:
    d = distance / np.float32(width)
    return np.exp(-(d * d))


def _near(pdf: pd.DataFrame, width: float) -> pd.DataFrame:
    """Of a block: what each long point gets of density from those met, and the long point nearest to each short one."""
    pdf = pdf.sort_values("rep", ignore_index=True)
    z, rep, long = np.stack(pdf["z"].to_numpy()).astype(np.float32), pdf["rep"].to_numpy(), pdf["long"].to_numpy()
    met, query = np.flatnonzero(pdf["met"].to_numpy() & long), np.flatnonzero(pdf["query"].to_numpy())
    mass, best, nearest = np.zeros(len(z)), np.full(len(z), -2.0), np.full(len(z), -1, np.int64)
    weight, y = pdf["m"].to_numpy().astype(np.float32)[met], z[met].T
    for i in range(0, len(query) if len(met) else 0, 256):
        at = query[i : i + 256]
        s = z[at] @ y
        inner = long[at]
        mass[at[inner]] = kernel(1 - s[inner], width) @ weight
        best[at], nearest[at] = s.max(axis=1), rep[met[s.argmax(axis=1)]]
    return pd.DataFrame({"rep": rep[query], "mass": mass[query], "best": best[query], "nearest": nearest[query]})


def _nearest_denser(z: np.ndarray, rep: np.ndarray, rho: np.ndarray, asking: np.ndarray, met: np.ndarray) -> pd.DataFrame:
    """(rep, cosine, density, parent): for each asking place the nearest of the denser ones met, ties of density by rep; none without one."""
    met = met[np.lexsort((rep[met], -rho[met]))]
    # Those met before this place are denser.
    order = np.lexsort((np.r_[rep[met], rep[asking]], -np.r_[rho[met], rho[asking]]))
    ahead = np.cumsum(order < len(met))
    cut = np.empty(len(order), np.int64)
    cut[order] = ahead
    cut = np.minimum(cut[len(met) :], np.searchsorted(-rho[met], -rho[asking], side="right"))
    # A point that is both asking and met stands once among those counted if it comes first in the order of equal keys.
    out = []
    by_cut = np.argsort(cut, kind="stable")
    for i in range(0, len(asking), 256):
        take = by_cut[i : i + 256]
        c, at = cut[take], asking[take]
        if not c[-1]:
            continue
        s = z[at] @ z[met[: c[-1]]].T
        s[np.arange(c[-1])[None, :] >= c[:, None]] = -2
        s[rep[at][:, None] == rep[met[: c[-1]]][None, :]] = -2
        j = s.argmax(axis=1)
        cosine = s[np.arange(len(s)), j]
        some = cosine > -1.5
        to = met[j[some]]
        out.append(pd.DataFrame({"rep": rep[at][some], "cosine": cosine[some].astype(np.float64), "density": rho[to], "parent": rep[to]}))
    return pd.concat(out) if out else pd.DataFrame({"rep": np.zeros(0, np.int64), "cosine": np.zeros(0), "density": np.zeros(0), "parent": np.zeros(0, np.int64)})


def _denser(pdf: pd.DataFrame) -> pd.DataFrame:
    z = np.stack(pdf["z"].to_numpy()).astype(np.float32)
    return _nearest_denser(z, pdf["rep"].to_numpy(), pdf["rho"].to_numpy(), np.flatnonzero(pdf["query"].to_numpy()), np.flatnonzero(pdf["met"].to_numpy()))


def _denser_of_all(longs: DataFrame, leaders: pd.DataFrame) -> DataFrame:
    """The nearest denser point of each leader among all points (rep, rho, z)."""
    held = longs.sparkSession.sparkContext.broadcast((leaders["rep"].to_numpy(), leaders["rho"].to_numpy(), np.stack(leaders["z"].to_numpy()).astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep, rho, z = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                y, r, d = _dense_rows(part.column(2), z.shape[1]), part.column(0).to_numpy(), part.column(1).to_numpy()
                n = len(rep)
                pdf = _nearest_denser(np.concatenate([z, y]), np.r_[rep, r], np.r_[rho, d], np.arange(n), np.arange(n, n + len(r)))
                yield pa.RecordBatch.from_pandas(pdf, preserve_index=False)

    return longs.select("rep", "rho", "z").mapInArrow(run, "rep long, cosine double, density double, parent long")


def choose_peaks(gamma: np.ndarray, themes: tuple[int, int] = THEMES) -> int:
    """How many of the falling values are peaks: where the ratio of one to the next is greatest, within the bounds."""
    low, high = min(themes[0], len(gamma)), min(themes[1], len(gamma) - 1)
    if high < low:
        return len(gamma)
    return max(range(low, high + 1), key=lambda k: gamma[k - 1] / max(gamma[k], 1e-12))


class Themes:
    """rows: (seq, bag); classes: (bag, rep, text, copies); labels: (rep, theme_id, rho), rho 0 for short texts."""

    def __init__(self, df: DataFrame, key: str = "seq", text: str = "cleaned_text", themes: tuple[int, int] = THEMES, cell: int = CELL, visits: int = VISITS) -> None:
        self.all = df.select(F.col(key).cast("long").alias("seq"))
        rows = stage(bags(df, key, text, 1), "bags")
        self.rows = rows.select("seq", "bag")
        self.classes = stage(classes_of(rows), "classes")
        counts = stage(_count_words(self.classes), "word-counts")
        texts = counts.filter("word = ''").select("n").first()
        n = texts["n"] if texts else 0
        low, high = max(3, n / RARE), max(3, n * COMMON)
        words = counts.filter((F.col("word") != "") & (F.col("n") >= low) & (F.col("n") <= high)).orderBy(F.desc("n"), "word").limit(MAX_WORDS).collect()
        weights = {w["word"]: (i, float(np.log(n / w["n"]))) for i, w in enumerate(words)}
        if not weights:
            self.labels = self.classes.select("rep", F.lit(0).alias("theme_id"), F.lit(0.0).alias("rho"))
            return
        features = stage(_features(self.classes, weights), "features")
        z = stage(_vectors(features, leading_axes(features, len(weights))), "vectors")
        usable = z.filter("z is not null")
        points = stage(usable.groupBy("long", "z").agg(F.min("rep").alias("rep"), F.count("*").alias("m")), "points")
        counted = points.filter("long").agg(F.count("*").alias("n"), F.sum("m").alias("m")).first()
        n_long = counted["n"]
        if not n_long:
            self.labels = self.classes.select("rep", F.lit(0).alias("theme_id"), F.lit(0.0).alias("rho"))
            return
        cells = Cells(points, n_long, cell, visits)
        width = cells.kernel_width(points)
        block = ("cell", "shard", "part")
        near = cells.routed(points, ["long", "m"]).groupBy(*block).applyInPandas(lambda pdf: _near(pdf, width), "rep long, mass double, best double, nearest long")
        far = cells.far(points.filter("long"), width).select("rep", "mass", F.lit(-2.0).alias("best"), F.lit(-1).cast("long").alias("nearest"))
        joint = near.unionByName(far).groupBy("rep").agg(F.round(F.sum("mass") / counted["m"], 12).alias("rho"), F.max(F.struct("best", (-F.col("nearest")).alias("nearest"))).alias("s"))
        first = stage(points.select("rep", "long", "z").join(joint.select("rep", "rho", F.when(F.col("s.best") >= NO_SUBJECT, -F.col("s.nearest")).alias("nearest")), "rep"), "densities")
        longs = first.filter("long").select("rep", "rho", "z")
        best = lambda found: found.groupBy("rep").agg(F.max(F.struct("cosine", "density", (-F.col("parent")).alias("parent"))).alias("p"))
        denser = stage(best(cells.routed(longs, ["rho"]).groupBy(*block).applyInPandas(_denser, "rep long, cosine double, density double, parent long")), "denser")
        # The densest points of their cells, among all.
        leaders = stage(longs.join(denser, "rep", "left_anti"), "leaders")
        turns = -(-leaders.count() // LEADERS_AT_ONCE)
        for turn in range(turns):
            some = leaders.filter(F.pmod(F.xxhash64("rep"), F.lit(turns)) == turn).toPandas()
            if len(some):
                denser = denser.unionByName(best(_denser_of_all(longs, some)))
        # The densest record of all points to itself, from the greatest distance there is.
        self.pointers = stage(longs.select("rep", "rho").join(denser, "rep", "left").select("rep", "rho", F.coalesce(-F.col("p.parent"), "rep").alias("parent"), F.coalesce(1 - F.col("p.cosine"), F.lit(2.0)).alias("delta")), "pointers")
        gamma = F.col("rho") * F.col("delta")
        top = self.pointers.select("rep", gamma.alias("gamma")).orderBy(F.desc("gamma"), "rep").limit(themes[1] + 1).collect()
        peaks = [r["rep"] for r in top[: choose_peaks(np.array([r["gamma"] for r in top]), themes)]]
        head = F.col("rep").isin(peaks)
        ways = self.pointers.select("rep", F.when(head, F.col("rep")).otherwise(F.col("parent")).alias("parent"))
        while ways.filter(~F.col("parent").isin(peaks)).limit(1).count():
            ways = stage(ways.join(ways.select(F.col("rep").alias("parent"), F.col("parent").alias("further")), "parent").select("rep", F.col("further").alias("parent")), "ways")
        number = F.array_position(F.array(*(F.lit(r) for r in peaks)), F.col("parent")).cast("int")
        found = ways.select(F.col("rep").alias("root"), number.alias("theme_id"))
        own = first.select("long", "z", F.when(F.col("long"), F.col("rep")).otherwise(F.col("nearest")).alias("root"), F.when(F.col("long"), F.col("rho")).otherwise(0.0).alias("rho"))
        labelled = usable.join(own.join(found, "root", "left"), ["long", "z"]).select("rep", F.coalesce("theme_id", F.lit(0)).alias("theme_id"), "rho")
        self.labels = stage(labelled.unionByName(z.filter("z is null").select("rep", F.lit(0).alias("theme_id"), F.lit(0.0).alias("rho"))), "labels")
        unstage(features, counts, leaders)

    def row_labels(self) -> DataFrame:
        """(seq, theme_id) of every row; 0 for those without words."""
        known = self.rows.join(self.classes.select("bag", "rep"), "bag").join(self.labels, "rep").select("seq", "theme_id")
        return self.all.join(known, "seq", "left").select("seq", F.coalesce("theme_id", F.lit(0)).alias("theme_id"))

    def report(self, typical: int = 3) -> DataFrame:
        """(theme_id, size, rank, seq, text): each theme's rows, and its most typical texts: those of greatest density.

        There are at most as many themes as ``themes`` allows, so their sizes are that many rows.
        """
        sized = self.row_labels().groupBy("theme_id").agg(F.count("*").alias("size"))
        ranked = self.labels.join(self.classes.select("rep", "text"), "rep").withColumn("rank", F.row_number().over(Window.partitionBy("theme_id").orderBy(F.desc("rho"), "rep"))).filter(F.col("rank") <= typical)
        return ranked.join(F.broadcast(sized), "theme_id").select("theme_id", "size", "rank", F.col("rep").alias("seq"), "text")

    def same_theme(self, pairs: DataFrame) -> DataFrame:
        """The pairs (seq_a, seq_b) whose rows belong to the same theme."""
        of = self.row_labels()
        both = pairs.join(of.select(F.col("seq").alias("seq_a"), F.col("theme_id").alias("a")), "seq_a").join(of.select(F.col("seq").alias("seq_b"), F.col("theme_id").alias("b")), "seq_b")
        return both.filter("a = b").select("seq_a", "seq_b").distinct()
