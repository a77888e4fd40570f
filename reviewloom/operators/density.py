"""Density clustering of vectors: mutual reachability, minimum spanning tree, condensed tree, clusters of greatest stability.

The tree is built over micro-clusters: up to ``MICRO`` vectors drawn by hash, each with the number of rows that are nearest
to it. Counting rows and labelling them are passes over all rows; only the drawn vectors and their counts reach the driver.
With at most ``MICRO`` distinct vectors every one is drawn, and the result is that of all rows; beyond that distances within
a micro-cluster count as zero in the tree, and a row further from its micro-cluster than the cluster's reach is an outlier.

Null, empty and all-zero vectors take no part. Rows of no cluster have label -1; labels from 0 on go by falling size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.config import DEFAULTS, EngineConfig

#: The most micro-clusters; the tree over them takes memory and time in proportion to their square.
MICRO = 3000


def core_distances(distance: np.ndarray, weight: np.ndarray, neighbours: int) -> np.ndarray:
    """How far each centre must reach for so many rows, itself included; the farthest there is if there are fewer."""
    order = np.argsort(distance, axis=1, kind="stable")
    reached = np.cumsum(weight[order], axis=1)
    at = np.minimum((reached < neighbours).sum(axis=1), distance.shape[1] - 1)
    return distance[np.arange(len(distance)), order[np.arange(len(distance)), at]]


def spanning_tree(reach: np.ndarray) -> list[tuple[float, int, int]]:
    """The edges (length, a, b) of a minimum spanning tree, shortest first."""
    n = len(reach)
    inside = np.zeros(n, bool)
    best, source = np.full(n, np.inf), np.zeros(n, np.int64)
    edges, at = [], 0
    for _ in range(n - 1):
        inside[at] = True
        closer = (reach[at] < best) & ~inside
        best[closer], source[closer] = reach[at][closer], at
        at = int(np.argmin(np.where(inside, np.inf, best)))
        edges.append((float(best[at]), int(source[at]), at))
    return sorted(edges)


def stable_clusters(edges: list[tuple[float, int, int]], weight: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(cluster of each centre, the distance at which that cluster comes apart from others); -1 for none.

    The clusters of greatest stability with at least ``least`` rows, never all as one.
    """
    n = len(weight)
    head = list(range(n))

    def root(i: int) -> int:
        while head[i] != i:
            head[i] = head[head[i]]
            i = head[i]
        return i

    node, size, sides = list(range(n)), [float(w) for w in weight], {}
    for length, a, b in edges:  # node n + k joins two nodes
        a, b = root(a), root(b)
        sides[len(size)] = (node[a], node[b], 1 / max(length, 1e-12))
        head[b] = a
        node[a] = len(size)
        size.append(size[sides[node[a]][0]] + size[sides[node[a]][1]])

    birth, parent, stability, of = [0.0], [-1], [0.0], np.zeros(n, np.int64)

    def leave(top: int, cluster: int) -> None:
        below = [top]
        while below:
            x = below.pop()
            if x < n:
                of[x] = cluster
            else:
                below += sides[x][:2]

    stack = [(len(size) - 1, 0)]
    while stack:
        x, c = stack.pop()
        if x < n:
            of[x] = c
            continue
        left, right, density = sides[x]
        large = [s for s in (left, right) if size[s] >= least]
        gone = size[x] if len(large) != 1 else size[x] - size[large[0]]
        stability[c] += gone * (density - birth[c])
        for s in (left, right):
            if s not in large:
                leave(s, c)
            elif len(large) == 1:
                stack.append((s, c))
            else:
                birth.append(density)
                parent.append(c)
                stability.append(0.0)
                stack.append((s, len(birth) - 1))
    children = [0.0] * len(birth)
    chosen = [False] * len(birth)
    for c in range(len(birth) - 1, 0, -1):
        chosen[c] = stability[c] >= children[c]
        children[parent[c]] += max(stability[c], children[c])
    label = [-1] * len(birth)
    for c in range(1, len(birth)):  # a cluster above takes what is below it
        label[c] = label[parent[c]] if label[parent[c]] >= 0 else c if chosen[c] else -1
    found = np.array([label[c] for c in of])
    return found, np.array([1 / birth[c] if c >= 0 else 0.0 for c in found.tolist()])


def hdbscan(vectors: DataFrame, cfg: EngineConfig = DEFAULTS, least: int | None = None, vector: str = "embedding", micro: int = MICRO) -> DataFrame:
    """(chunk_id, review_id, label) of the rows with a usable vector, by the directions of their vectors."""
    usable = vectors.select("chunk_id", "review_id", F.col(vector).cast("array<double>").alias("v")).filter(F.exists("v", lambda x: x != 0))
    none = usable.select("chunk_id", "review_id", F.lit(-1).alias("label"))
    drawn = usable.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(micro).toArrow().column("v").to_pylist()
    if len(drawn) < 2:
        return none
    centres = np.array(drawn)
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    held = vectors.sparkSession.sparkContext.broadcast(centres)

    def nearest(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        x = np.array(column.to_pylist(), dtype=np.float64).reshape(-1, held.value.shape[1])
        s = x / np.linalg.norm(x, axis=1, keepdims=True) @ held.value.T
        return s.argmax(axis=1), np.sqrt(np.maximum(0.0, 2 - 2 * s.max(axis=1, initial=-1.0)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(held.value), np.int64)
        for batch in batches:
            n += np.bincount(nearest(batch.column(0))[0], minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n).astype(np.int32)), pa.array(n[n > 0])], names=["centre", "n"])

    counts = usable.select("v").mapInArrow(count, "centre int, n long").groupBy("centre").agg(F.sum("n").alias("n")).toArrow()
    weight = np.zeros(len(centres))
    weight[counts.column("centre").to_numpy()] = counts.column("n").to_numpy()
    distance = np.sqrt(np.maximum(0.0, 2 - 2 * centres @ centres.T))
    np.fill_diagonal(distance, 0.0)
    core = core_distances(distance, weight, cfg.hdbscan_min_samples)
    np.maximum(distance, core[:, None], out=distance)
    np.maximum(distance, core[None, :], out=distance)
    found, apart = stable_clusters(spanning_tree(distance), weight, least or cfg.hdbscan_min_cluster)
    sizes = {c: weight[found == c].sum() for c in set(found.tolist()) - {-1}}
    number = {c: i for i, c in enumerate(sorted(sizes, key=lambda c: (-sizes[c], c)))} | {-1: -1}
    labels = vectors.sparkSession.sparkContext.broadcast((np.array([number[c] for c in found.tolist()], np.int32), apart))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (number, apart), (at, far) = labels.value, nearest(batch.column(2))
            # A row further from its centre than the cluster is from others isn't in reach of the cluster.
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.where(far <= apart[at] + 1e-6, number[at], -1).astype(np.int32))], names=["chunk_id", "review_id", "label"])

    return usable.mapInArrow(label, "chunk_id string, review_id string, label int")
