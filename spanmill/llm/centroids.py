"""Lloyd rounds on integer vectors, nearest centroids found by equal-average equal-variance search.

The centroids lie sorted by their component mean. A vector starts at its own mean and looks outward, on whichever side
the next mean is nearer. With d dimensions, means m and deviations v (lengths of the centred vectors),

    distance**2 >= d * (m_x - m_c)**2 + (v_x - v_c)**2,

so a mean too far away ends the search, and a deviation too far away passes over one centroid. What is left is compared
on the integers themselves. The inequalities are taken in floating point with a margin far above its error, so they
never turn away a centroid that the integers would choose.

Centroids are ``k`` rows of ``d`` numbers and go to the tasks as such; of every round, ``k * d`` sums come back.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.llm.tasks import Batches, in_arrow
from spanmill.llm.vectors import exact_sums, matrix
from spanmill.session import cut_lineage

DIMS, CENTROIDS, ROUNDS, SCALE = 64, 16, 3, 64
_MARGIN = 1e-9


def limit(dims: int) -> int:
    """The largest component for which a squared distance fits into a long."""
    return isqrt((1 << 62) // dims) // 2


@dataclass(frozen=True)
class Ranked:
    """Centroids in the order of their means."""

    rows: np.ndarray
    numbers: np.ndarray
    means: np.ndarray
    deviations: np.ndarray
    norms: np.ndarray


def spread(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, deviation and squared length of every row."""
    values = rows.astype(np.float64)
    means = values.mean(axis=1)
    centred = values - means[:, None]
    return means, np.sqrt(np.einsum("ij,ij->i", centred, centred)), np.einsum("ij,ij->i", values, values)


def rank(centroids: np.ndarray) -> Ranked:
    means, deviations, norms = spread(centroids)
    order = np.argsort(means, kind="stable")
    return Ranked(centroids[order], order, means[order], deviations[order], norms[order])


def nearest(x: np.ndarray, ranked: Ranked) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid (ties: the smaller one), its squared distance, and how many rows were compared."""
    n, dims = x.shape
    k = len(ranked.means)
    means, deviations, norms = spread(x)
    high = np.searchsorted(ranked.means, means)
    low = high - 1
    best, number, compared = np.full(n, (1 << 63) - 1, np.int64), np.full(n, k, np.int64), 0
    open_ = np.arange(n)
    below, above = np.append(ranked.means, -np.inf), np.append(ranked.means, np.inf)
    while len(open_):
        lo, hi, mean = low[open_], high[open_], means[open_]
        down, up = mean - below[lo], above[hi] - mean
        side = down <= up
        gap = dims * np.square(np.where(side, down, up))
        at = np.where(side, lo, hi)
        margin = best[open_] + _MARGIN * (norms[open_] + ranked.norms[np.minimum(at, k - 1)] + 1)
        go = np.isfinite(gap) & (gap <= margin)
        open_, at, side = open_[go], at[go], side[go]
        low[open_[side]] -= 1
        high[open_[~side]] += 1
        near = gap[go] + np.square(deviations[open_] - ranked.deviations[at]) <= margin[go]
        rows, at = open_[near], at[near]
        compared += len(rows)
        apart = x[rows] - ranked.rows[at]
        distance = np.einsum("ij,ij->i", apart, apart)
        theirs = ranked.numbers[at]
        better = (distance < best[rows]) | ((distance == best[rows]) & (theirs < number[rows]))
        best[rows[better]], number[rows[better]] = distance[better], theirs[better]
    return number, best, compared


def quantise(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): floor(scale * component) of the vectors with exactly ``dims`` finite components, as a written table."""
    bound = limit(dims)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            kept, values = matrix(batch.column("embedding"), dims)
            # A huge component may become infinite by the factor; it is clipped like the others.
            with np.errstate(over="ignore"):
                x = np.clip(np.floor(scale * values), -bound, bound).astype(np.int64)
            offsets = pa.array(np.arange(len(x) + 1) * dims, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(kept)), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], ["vec_id", "x"])

    return cut_lineage(in_arrow(vectors.select("vec_id", "embedding"), run, "vec_id bigint, x array<bigint>"))


def _rows_of(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, dims)


def move(points: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of the exact means of their vectors; those without vectors stay."""
    k, dims = centroids.shape

    def run(batches: Batches) -> Batches:
        ranked, sums, counts = rank(centroids), np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = _rows_of(batch, dims)
            number, _, _ = nearest(x, ranked)
            order = np.argsort(number, kind="stable")
            begin = np.flatnonzero(np.diff(number[order], prepend=-1))
            if len(begin):
                sums[number[order][begin]] += np.add.reduceat(x[order], begin, axis=0)
                counts += np.bincount(number, minlength=k)
        filled = np.flatnonzero(counts)
        lists = [[*sums[c].tolist(), int(counts[c])] for c in filled]
        yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), pa.array(lists, pa.list_(pa.int64()))], ["cluster", "sums"])

    parts = in_arrow(points.select("x"), run, "cluster int, sums array<bigint>")
    after = {c: [0] * (dims + 1) for c in range(k)}
    # At most k * (dims + 1) rows: the sums, and behind them the count.
    for cluster, dim, total in exact_sums(parts, ["cluster"]).collect():
        after[cluster][dim] = int(total)
    moved = centroids.copy()
    for cluster, (*sums, count) in after.items():
        if count:
            moved[cluster] = [s // count for s in sums]
    return moved


def first_centroids(points: DataFrame, count: int = CENTROIDS) -> np.ndarray:
    """The ``count`` vectors with the smallest sha256 of ``1:<vec_id>``, in that order; rows without vec_id start none."""
    digest = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = points.filter("vec_id IS NOT NULL").select(digest.alias("digest"), "x").orderBy("digest", "x").limit(count)
    rows = [r["x"] for r in first.collect()]
    return np.array(rows, np.int64).reshape(len(rows), len(rows[0]) if rows else 0)


def cluster(vectors: DataFrame, dims: int = DIMS, count: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept row of ``vectors`` (vec_id, embedding).

    Kept are the vectors with exactly ``dims`` components, none null, infinite or NaN. Vectors go to the nearest
    centroid in each of ``rounds`` rounds, and once more at the end.

    Edge cases: null vectors, empty ones and those of another length are left out, however long. Components beyond
    ``limit(dims)`` count as that limit, so that a distance fits into a long. Repeated rows count and come back each;
    a row without vec_id is assigned but never a starting centroid, and without any vec_id there are no centroids and
    no rows. Fewer vectors than ``count`` make as many centroids. Equal hashes (equal vec_ids) go by components, equal
    distances to the smaller number. An inertia too large for a long is null. An empty table gives an empty result.
    Other columns are ignored.
    """
    points = quantise(vectors, dims, scale)
    centroids = first_centroids(points, count)
    if not len(centroids):
        centroids, points = np.zeros((1, dims), np.int64), points.limit(0)
    for _ in range(rounds):
        centroids = move(points, centroids)

    def run(batches: Batches) -> Batches:
        ranked = rank(centroids)
        for batch in batches:
            number, distance, _ = nearest(_rows_of(batch, dims), ranked)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(number, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    assigned = cut_lineage(in_arrow(points, run, "vec_id bigint, cluster int, distance bigint"))
    inertia = F.sum(F.col("distance").cast("decimal(20,0)"))
    per_cluster = assigned.groupBy("cluster").agg(inertia.try_cast("bigint").alias("cluster_inertia"))
    total = assigned.agg(inertia.try_cast("bigint")).scalar()
    digests = [(c, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())]
    named = points.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string")
    # One row for each centroid.
    facts = F.broadcast(per_cluster.join(F.broadcast(named), "cluster"))
    return assigned.join(facts, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", total.alias("inertia"), "centroid_sha256")
