"""Centroid clustering by exponion search.

Every vector carries its centroid, an upper bound on the distance to it, and a lower bound on the distance to
any other. Where the upper bound is below the lower one, or below half the distance of the centroid to its
nearest fellow, the centroid stays. Otherwise the upper bound is made exact, and if that does not settle it,
only the centroids within a ball around the current one are scanned: those up to twice the upper bound plus
the distance to the nearest fellow away, which hold the nearest and the second nearest of all. They are the
beginning of the current centroid's list of fellows, sorted by distance. Comparisons that settle a vector are
strict and the ball's edge belongs to it, so that of centroids equally far the one with the smaller number is
found. When centroids move, bounds move by their steps.

Vectors and centroids are whole numbers, so distances, sums and means are exact; only the bounds are
floating point, and they are rounded away from a decision.

A round is one pass over a table of vectors with their bounds, without a shuffle of vectors: centroids go out
with the tasks, and sums per centroid, made in partial sums first, come back (a number for each component of ``k`` centroids). Each round's table
is written to the shared folder, so a lost executor costs a part of one round.

Edge cases: vectors that are null, have another number of components, or a component that is null, NaN or
infinite are left out; components beyond 2^27 count as 2^27 with their sign, so that squared distances fit
into 64 bits; a sum of distances beyond 64 bits is null; vec_id may be null (its text is empty in the hash)
and repeated (rows are vectors of their own, and of equal hashes the smaller vector starts first); with fewer
vectors than ``k`` there are as many centroids as vectors; equal starting centroids leave all but the first
of them empty; an empty table gives an empty table; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.session import ship_package, written

#: Components lie within this.
BOUND = 1 << 27
#: Relative slack of floating-point bounds.
SLACK = 1e-9
#: Vectors that a task works on at a time.
BLOCK = 4_096

STATE = "vec_id long, vec array<int>, cluster int, upper double, lower double"
ASSIGNED = "vec_id long, cluster int, distance long"


def whole_vectors(table: DataFrame, dims: int, scale: float, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, vec): vectors of ``dims`` finite components as floor(scale * x)."""
    x = F.col(f"`{vector}`").cast("array<double>")
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))
    usable = F.coalesce((F.size(x) == dims) & F.forall(x, finite), F.lit(False))
    number = lambda c: F.greatest(F.lit(-float(BOUND)), F.least(F.lit(float(BOUND)), F.floor(F.lit(float(scale)) * c).cast("double"))).cast("int")
    clamped = lambda c: number(F.greatest(F.lit(-1e12), F.least(F.lit(1e12), c)))
    return table.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.when(usable, F.transform(x, clamped)).alias("vec")).where("vec is not null")


def starting_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest hashes of seed and vec_id, in that order."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return np.array([r.vec for r in vectors.orderBy(order, "vec").limit(k).select("vec").collect()], "i8")


class Fellows:
    """Distances between centroids: of each the others sorted by distance, itself first."""

    def __init__(self, centroids: np.ndarray):
        self.centroids, self.k = centroids, len(centroids)
        apart = np.sqrt(((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2).astype("f8"))
        np.fill_diagonal(apart, -1.0)  # a centroid comes first in its own list, also before equal ones
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.sorted = np.maximum(np.take_along_axis(apart, self.order, 1), 0.0)
        self.nearest = self.sorted[:, 1] if self.k > 1 else np.full(1, np.inf)


def squared(vec: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    d = vec - centroids
    return np.einsum("ij,ij->i", d, d)


def search(vec: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, fellows: Fellows) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """New clusters and bounds, and how many distances were made. The ties rule holds for the result."""
    cluster, upper, lower, made = cluster.copy(), upper.copy(), lower.copy(), 0
    half = 0.5 * (1 - SLACK) * fellows.nearest
    settled = lambda at: upper[at] < np.maximum(lower[at], half[cluster[at]])
    open_ = np.flatnonzero(~settled(np.arange(len(vec))))
    exact = squared(vec[open_], fellows.centroids[cluster[open_]])
    made += len(open_)
    upper[open_] = np.sqrt(exact) * (1 + SLACK)
    open_ = open_[~settled(open_)]
    if fellows.k < 2:
        return cluster, upper, lower, made
    # How many of the current centroid's sorted fellows lie in the ball; the edge belongs to it.
    radius = (2 * upper[open_] + fellows.nearest[cluster[open_]]) * (1 + SLACK)
    reach = np.empty(len(open_), "i8")
    for c in np.unique(cluster[open_]):
        of = cluster[open_] == c
        reach[of] = np.searchsorted(fellows.sorted[c], radius[of], side="right")
    by_reach = np.argsort(-reach, kind="stable")
    open_, reach = open_[by_reach], reach[by_reach]
    first = np.full(len(open_), np.iinfo(np.int64).max)
    second, best = first.copy(), cluster[open_].copy()
    for place in range(int(reach.max(initial=0))):
        n = int(np.searchsorted(-reach, -place, side="left"))  # rows whose ball holds more fellows than that
        other = fellows.order[cluster[open_[:n]], place]
        d = squared(vec[open_[:n]], fellows.centroids[other])
        made += n
        wins = (d < first[:n]) | ((d == first[:n]) & (other < best[:n]))
        second[:n] = np.where(wins, first[:n], np.minimum(second[:n], d))
        best[:n] = np.where(wins, other, best[:n])
        first[:n] = np.where(wins, d, first[:n])
    cluster[open_] = best
    upper[open_] = np.sqrt(first.astype("f8")) * (1 + SLACK)
    lower[open_] = np.sqrt(second.astype("f8")) * (1 - SLACK)
    return cluster, upper, lower, made


def moved(cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds after every centroid has moved by its step."""
    order = np.argsort(-steps, kind="stable")
    most = np.full(len(steps), steps[order[0]])
    most[order[0]] = steps[order[1]] if len(steps) > 1 else 0.0
    return (upper + steps[cluster]) * (1 + SLACK), np.maximum(0.0, lower * (1 - SLACK) - most[cluster] * (1 + SLACK))


@dataclass
class Clustering:
    """(vec_id, cluster, distance) of every vector, and the centroids."""

    assigned: DataFrame
    centroids: np.ndarray


def _pass(state: DataFrame, fellows: Fellows, steps: np.ndarray | None, last: bool) -> DataFrame:
    """One search over the table: the new table, or in the last pass the assignment."""
    ship_package(state.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False)
                vec = flat.reshape(batch.num_rows, -1).astype("i8")
                cluster, upper, lower = (batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("cluster", "upper", "lower"))
                if steps is not None:
                    upper, lower = moved(cluster, upper, lower, steps)
                cluster, upper, lower, _ = search(vec, cluster, upper, lower, fellows)
                cluster = cluster.astype("i4")
                if last:
                    distance = squared(vec, fellows.centroids[cluster])
                    yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster), pa.array(distance)], names=["vec_id", "cluster", "distance"])
                else:
                    yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vec"), pa.array(cluster), pa.array(upper), pa.array(lower)], names=["vec_id", "vec", "cluster", "upper", "lower"])

    return state.mapInArrow(run, ASSIGNED if last else STATE)


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor(sum / count) of every centroid's vectors; those without vectors stay."""
    sums = state.select("cluster", F.posexplode("vec").alias("at", "x")).groupBy("cluster", "at").agg(F.count("*").alias("n"), F.sum(F.col("x").cast("long")).alias("s"))
    out = centroids.copy()
    for r in sums.collect():  # at most k rows a component
        out[r.cluster, r["at"]] = r.s // r.n
    return out


def cluster(vectors: DataFrame, k: int, rounds: int, seed: int) -> Clustering:
    """``rounds`` of assigning (vec_id, vec) to the nearest centroid and moving centroids to their means, and
    one assignment more."""
    vectors = written(vectors, "vectors")
    centroids = starting_centroids(vectors, k, seed)
    if not len(centroids):
        return Clustering(vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids)
    # Every vector starts at the first centroid, with bounds that settle nothing.
    state = vectors.select("vec_id", "vec", F.lit(0).cast("int").alias("cluster"), F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower"))
    steps = None
    for _ in range(rounds):
        state = written(_pass(state, Fellows(centroids), steps, False), "bounds")
        new = _means(state, centroids)
        steps = np.sqrt(((new - centroids) ** 2).sum(1).astype("f8")) * (1 + SLACK)
        centroids = new
    return Clustering(written(_pass(state, Fellows(centroids), steps, True), "assigned"), centroids)


def with_totals(made: Clustering) -> DataFrame:
    """Every vector's row with the sums of distances over its cluster and over all, and its centroid's hash."""
    spark, fits = made.assigned.sparkSession, lambda x: x if x < 1 << 63 else None
    sums = {r.cluster: int(r.s) for r in made.assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # at most k rows
    total = sum(sums.values())
    rows = [(c, fits(s), fits(total), hashlib.sha256(",".join(map(str, made.centroids[c].tolist())).encode()).hexdigest()) for c, s in sorted(sums.items())]
    per_cluster = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return made.assigned.join(F.broadcast(per_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
