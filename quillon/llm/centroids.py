"""Centroid clustering: k-means whose assignments are found by the threshold algorithm."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from quillon.llm.shared import col, without, written

#: Sums leave a task in parts of so many bits, so that parts of all tasks add up in 64.
PART_BITS = 40
#: Vectors assigned at once.
ROWS = 4096

ADDED = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


class Lists(NamedTuple):
    """Centroids (k x dims), and for each dimension their values in order and whose they are."""

    centroids: np.ndarray
    values: np.ndarray
    owners: np.ndarray


def sorted_lists(centroids: list[list[int]], dims: int, wide: bool) -> Lists:
    """The lists that `assign` walks; `wide` takes Python's integers in place of 64 bits."""
    table = np.array(centroids, object if wide else np.int64).reshape(len(centroids), dims)
    owners = np.argsort(table, axis=0, kind="stable")
    return Lists(table, np.take_along_axis(table, owners, axis=0).T, owners.T)


def assign(vectors: np.ndarray, lists: Lists) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector (of equals the first), and its squared distance.

    In each dimension the sorted list of centroids is walked outward from the vector's value,
    one step a round, the nearer side first. A centroid met for the first time in any list
    has its exact distance taken. What no list has shown yet is at least as far, in every
    dimension, as the next value on its list: a vector is done once the sum of the squares of
    these frontier distances is strictly more than its best distance, or a list is at its end.
    """
    n, dims = vectors.shape
    k = len(lists.centroids)
    wide = vectors.dtype == object
    far = 1 << 3000 if wide else 1 << 62
    best, who = np.full(n, far, vectors.dtype), np.full(n, k)
    above = np.empty((n, dims), np.int64)
    for d in range(dims):
        above[:, d] = np.searchsorted(lists.values[d], vectors[:, d])
    below = above - 1
    seen = np.zeros((n, k), bool)
    live, every = np.arange(n), np.arange(dims)

    def gaps(x: np.ndarray, down: np.ndarray, up: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        to_down = x - lists.values[every, np.maximum(down, 0)]
        to_up = lists.values[every, np.minimum(up, k - 1)] - x
        return np.where(down < 0, far, to_down), np.where(up >= k, far, to_up)

    to_down, to_up = gaps(vectors, below, above)
    while len(live):
        x, down, up = vectors[live], below[live], above[live]
        downward = to_down <= to_up
        met = lists.owners[every, np.where(downward, np.maximum(down, 0), np.minimum(up, k - 1))]
        fresh = np.zeros((len(live), k), bool)
        fresh[np.arange(len(live))[:, None], met] = True
        fresh &= ~seen[live]
        seen[live] |= fresh
        row, which = np.nonzero(fresh)
        exact = ((x[row] - lists.centroids[which]) ** 2).sum(axis=1)
        for c in np.unique(which).tolist():  # in order, so that the first of equals stays
            r, e = live[row[which == c]], exact[which == c]
            nearer = (e < best[r]) | ((e == best[r]) & (c < who[r]))
            best[r[nearer]], who[r[nearer]] = e[nearer], c
        below[live], above[live] = down - downward, up + ~downward
        to_down, to_up = gaps(x, below[live], above[live])
        ended = ((below[live] < 0) & (above[live] >= k)).any(axis=1)
        frontier = np.where(ended[:, None], 0, np.minimum(to_down, to_up))
        more = ~ended & ~((frontier**2).sum(axis=1) > best[live]).astype(bool)
        live, to_down, to_up = live[more], to_down[more], to_up[more]
    return who, best


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles, exactly; as 64-bit numbers if squared distances fit these."""
    dims = max(1, values.shape[1])
    if np.abs(values).max(initial=0) * scale < math.isqrt((1 << 60) // dims) // 2:
        return np.floor(values * scale).astype(np.int64)
    exact = [math.floor(x * scale) if abs(x) < 1 << 53 else int(x) * scale for x in values.ravel().tolist()]
    return np.array(exact, object).reshape(values.shape)


def _assigned(batch: pa.RecordBatch, centroids: list[list[int]], dims: int, scale: int) -> Iterator[tuple]:
    """Slices of a batch's vectors as whole numbers, with their clusters and distances."""
    column = batch.column(batch.schema.names.index("values"))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    values = flat.astype(np.float64).reshape(-1, dims)
    largest = max((abs(x) for c in centroids for x in c), default=0)
    for a in range(0, len(values), ROWS):
        x = whole(values[a : a + ROWS], scale)
        if x.dtype != object and largest >= math.isqrt((1 << 60) // dims) // 2:
            x = x.astype(object)
        yield x, *assign(x, sorted_lists(centroids, dims, x.dtype == object))


def _summer(
    centroids: list[list[int]], dims: int, scale: int
) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per task and cluster: vectors, and sums by dimension in parts of PART_BITS bits."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids)
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), object)
        for batch in batches:
            for x, who, _ in _assigned(batch, centroids, dims, scale):
                for c in np.unique(who).tolist():
                    counts[c] += int((who == c).sum())
                    sums[c] += x[who == c].sum(axis=0).astype(object)
        rows = []
        for c in np.flatnonzero(counts).tolist():
            part, left, n = 0, sums[c].tolist(), int(counts[c])
            while part == 0 or any(left):
                small = all(abs(s) < 1 << PART_BITS for s in left)
                rows.append((c, part, n, left if small else [s % (1 << PART_BITS) for s in left]))
                left = [] if small else [s >> PART_BITS for s in left]
                part, n = part + 1, 0
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["cluster", "part", "n", "sums"]
        )

    return run


def _marker(
    centroids: list[list[int]], dims: int, scale: int
) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clusters, distances = [], []
            for _, who, best in _assigned(batch, centroids, dims, scale):
                clusters += who.tolist()
                distances += [d if d < 1 << 63 else None for d in best.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(clusters, pa.int32()), pa.array(distances, pa.int64())],
                names=["row", "cluster", "distance"],
            )

    return run


def cluster(
    vectors: DataFrame,
    *,
    k: int = 8,
    dims: int = 64,
    rounds: int = 10,
    scale: int = 1024,
    seed: int = 3,
) -> DataFrame:
    """`vectors` (vec_id, embedding) with the cluster of each after `rounds` of k-means.

    Kept are rows whose embedding has exactly `dims` components, none null, infinite or not
    a number; all others, and rows of a null embedding, are left out. Components x are taken
    as floor(scale * x), exactly whatever their size. The first centroids are the kept vectors
    with the smallest lower-case SHA-256 of "seed:vec_id"; a null id comes last, and of equal
    ids the smaller vector first. A round assigns each vector to the nearest centroid, the
    first of equals, and replaces each centroid that has vectors by the floor of their mean in
    each component; after the last, vectors are assigned once more. Repeated rows are vectors
    like any other. With fewer than k kept vectors there are as many clusters; an empty table
    gives an empty result.

    Adds cluster, distance (squared), cluster_inertia and inertia (its sums), and
    centroid_sha256 (of the centroid's components, joined by commas), which replace columns
    of these names. A distance of 2**63 or more, and sums with one or as large, are null.

    Assignments are by the threshold algorithm (`assign`). A task sends k rows of sums a
    round, and the driver holds k centroids and nothing else. The vectors are written once.
    """
    vectors = without(vectors, ADDED)
    embedding = col("embedding").cast("array<double>")
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf)))
    rows = vectors.where((F.size(embedding) == dims) & finite).select(
        F.struct(*[col(c) for c in vectors.columns]).alias("row"), embedding.alias("values")
    )
    rows = written(rows)
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("row.vec_id").cast("string")), 256)
    firsts = rows.select(name.alias("name"), "values").orderBy(F.col("name").asc_nulls_last(), "values")
    centroids = [whole(np.array([r["values"]]), scale)[0].tolist() for r in firsts.limit(k).collect()]
    for _ in range(rounds if centroids else 0):
        centroids = _moved(rows, centroids, dims, scale)

    schema = StructType(
        [rows.schema["row"], StructField("cluster", IntegerType()), StructField("distance", LongType())]
    )
    marked = written(rows.select("row", "values").mapInArrow(_marker(centroids, dims, scale), schema))
    whole_sum = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    sums = {r.cluster: r.sum for r in marked.groupBy("cluster").agg(whole_sum.alias("sum")).collect()}
    total = None if None in sums.values() else sum(map(int, sums.values()))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def number(x: int | None) -> Column:
        return F.lit(None if x is None or x >= 1 << 63 else int(x)).cast("bigint")

    none = F.array().cast("array<bigint>")
    own = F.array(*[number(sums.get(c, 0)) for c in range(len(centroids))]) if centroids else none
    names = F.array(*[F.lit(d) for d in digests]).cast("array<string>")
    return marked.select(
        "row.*",
        "cluster",
        "distance",
        F.get(own, F.col("cluster")).alias("cluster_inertia"),
        number(total).alias("inertia"),
        F.get(names, F.col("cluster")).alias("centroid_sha256"),
    )


def _moved(rows: DataFrame, centroids: list[list[int]], dims: int, scale: int) -> list[list[int]]:
    """The centroids after one round."""
    schema = "cluster int, part int, n bigint, sums array<bigint>"
    parts = rows.select("values").mapInArrow(_summer(centroids, dims, scale), schema)
    sums = [F.sum(F.get("sums", F.lit(d))) for d in range(dims)]
    found = parts.groupBy("cluster", "part").agg(F.sum("n").alias("n"), F.array(*sums).alias("sums")).collect()
    counts, totals = [0] * len(centroids), [[0] * dims for _ in centroids]
    for r in found:
        counts[r.cluster] += r.n
        totals[r.cluster] = [t + (s << PART_BITS * r.part) for t, s in zip(totals[r.cluster], r.sums, strict=True)]
    return [[t // n for t in total] if n else old for old, n, total in zip(centroids, counts, totals, strict=True)]
