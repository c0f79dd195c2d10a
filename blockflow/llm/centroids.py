"""Centroid clustering by Exponion search.

Every vector carries its cluster, an upper bound of the distance to its centroid and a lower bound of the distance to
the second nearest. When centroids have moved, the bounds move with them. A vector whose upper bound stays below the
lower bound, or below half the distance from its centroid to the nearest other one, keeps its cluster unread. For
the rest the own distance is computed, and if that does not settle it, only the centroids inside a ball around the own
centroid are scanned: radius twice the own distance plus the distance to the nearest other centroid, which holds the nearest
and the second nearest. A sorted list of distances from each centroid to all others gives the ball as a
prefix. The radius is inclusive and bounds are widened by SLACK, so ties are always scanned; distances are exact
integers, and of equal ones the smaller number wins.

On Spark: vectors with their bounds are one table a round, written to the shared folder (a lost executor costs a task,
not the rounds before); the new centroids are sums that each task makes for its own rows first. The driver holds the
centroids and sums of `k` clusters, nothing that grows with the vectors.

Defined results: a row is kept if its vector has exactly `dims` components, none null or non-finite; other rows give no row.
A scaled component beyond a long is the end of a long's range, and so is a distance or an inertia. Every row counts, repeated
ones too; a null id is hashed as an empty one; of rows with equal hashes the smaller vector starts first; fewer than `k`
kept rows are as many centroids, equal centroids stay apart (the smaller number takes the vectors); an empty table
gives an empty result; columns other than the id and the vector are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, written

SLACK = 1e-9
_LONG = 2**63 - 1


def kept_vectors(rows: DataFrame, dims: int, scale: int, vec_id: str, vector: str) -> DataFrame:
    """(id, v): the rows that count, v the components floor(scale * x) as longs."""
    x = F.col(vector)
    usable = lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) != float("inf"))
    kept = rows.where(F.coalesce(F.size(x) == dims, F.lit(False))).where(F.coalesce(F.forall(x, usable), F.lit(False)))
    return kept.select(F.col(vec_id).alias("id"), F.transform(x, lambda y: F.floor(F.lit(float(scale)) * y.cast("double"))).alias("v"))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of every row of x to every row of c: exact as doubles while squares stay below 2^53, else as Python integers."""
    if x.dtype != object:
        return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)
    out = np.empty((len(x), len(c)), object)
    for j, row in enumerate(c):
        out[:, j] = ((x - row) ** 2).sum(axis=1)
    return out


def _root(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(d2.astype(float), 0))


class Geometry:
    """What a round knows of its centroids: the distances between them, sorted from each, and how far each has moved."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None):
        self.c, k = now, len(now)
        between = _root(squared(now, now))
        self.order = np.argsort(between, axis=1, kind="stable")
        self.sorted = np.take_along_axis(between, self.order, axis=1)
        np.fill_diagonal(between, np.inf)
        self.nearest = between.min(axis=1) if k > 1 else np.full(k, np.inf)
        if before is None:
            self.moved = self.others = None
        else:
            self.moved = np.array([float(((a - b) ** 2).sum()) ** 0.5 for a, b in zip(now, before)])
            top = np.sort(self.moved)[::-1]
            # The largest move among the others: the second largest for the one that moved most.
            self.others = np.where(np.arange(k) == self.moved.argmax(), top[1] if k > 1 else 0.0, top[0])

    def full(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest centroid, its squared distance and a lower bound of the distance to the second, over all centroids."""
        return self._pick(squared(x, self.c), np.arange(len(self.c)))

    @staticmethod
    def _pick(d: np.ndarray, number: np.ndarray, outside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if outside is not None:
            d = np.where(outside, np.inf, d)
        best = d.min(axis=1)
        a = np.where(d == best[:, None], number, len(number) + number.max()).min(axis=1)
        rest = np.where(number == a[:, None], np.inf, d).min(axis=1)
        return a, best, np.where(np.isinf(rest.astype(float)), np.inf, _root(rest) * (1 - SLACK))

    def step(self, x: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cluster, upper and lower bound of each row in this round, and how many distances were computed for it."""
        seen = np.zeros(len(x), np.int64)
        if self.moved is None:
            a, best, lower = self.full(x)
            return a, _root(best) * (1 + SLACK), lower, seen + len(self.c)
        a, upper, lower = a.copy(), (upper + self.moved[a]) * (1 + SLACK), lower - self.others[a] * (1 + SLACK)
        settled = np.maximum(lower, self.nearest[a] / 2 * (1 - SLACK))
        at = np.flatnonzero(upper >= settled)
        upper[at] = _root(((x[at] - self.c[a[at]]) ** 2).sum(axis=1)) * (1 + SLACK)
        seen[at] += 1
        at = at[upper[at] >= settled[at]]
        ball = (2 * upper[at] + self.nearest[a[at]]) * (1 + SLACK)
        for own in np.unique(a[at]):
            rows, radius = at[a[at] == own], ball[a[at] == own]
            wide = np.searchsorted(self.sorted[own], radius, "right")
            # Rows whose balls hold about as many centroids are scanned together, over at most twice as many as each needs.
            rings = np.ceil(np.log2(np.maximum(wide, 2))).astype(int)
            for ring in np.unique(rings):
                pick = rings == ring
                number = self.order[own][: 2**ring]
                outside = np.arange(len(number)) >= wide[pick][:, None]
                now, best, second = self._pick(squared(x[rows[pick]], self.c[number]), number, outside)
                a[rows[pick]], upper[rows[pick]], lower[rows[pick]] = now, _root(best) * (1 + SLACK), second
                seen[rows[pick]] += wide[pick]
        return a, upper, lower, seen


def _vectors(column: pa.Array, dims: int, exact: bool) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    return flat.astype(float) if exact else flat.astype(object)


def _assign(geometry: Geometry, dims: int, exact: bool, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _vectors(b.column("v"), dims, exact)
            a, upper, lower, seen = geometry.step(x, b.column("cluster").to_numpy(), b.column("upper").to_numpy(), b.column("lower").to_numpy())
            seen = seen + b.column("scanned").to_numpy()
            head = [b.column("id"), b.column("v"), pa.array(a.astype(np.int32))]
            if last:
                d = ((x - geometry.c[a]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([*head, pa.array([min(int(y), _LONG) for y in d], pa.int64()), pa.array(seen)], ["id", "v", "cluster", "distance", "scanned"])
            else:
                yield pa.RecordBatch.from_arrays([*head, pa.array(upper), pa.array(lower), pa.array(seen)], ["id", "v", "cluster", "upper", "lower", "scanned"])

    return run


def clusters(
    rows: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2:", vec_id: str = "vec_id", vector: str = "embedding"
) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, v, cluster, distance, scanned) of every kept row, and the final centroids. scanned: distances that were computed for the row, over all rounds.

    Centroids start as the `k` kept vectors with the smallest SHA-256 of salt and id.
    """
    spark = rows.sparkSession
    state = written(kept_vectors(rows, dims, scale, vec_id, vector), "vectors")
    kind = state.schema["id"].dataType.simpleString()
    name = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = [r.v for r in state.select("v").orderBy(name, "v").limit(k).collect()]
    n, low, high = state.select(F.count("*"), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    size = max(-(low or 0), high or 0, 1)
    exact = 4 * dims * size**2 < 2**53
    plain = size * n < 2**62
    if not n:
        return spark.createDataFrame([], f"{vec_id} {kind}, v array<bigint>, cluster int, distance bigint, scanned bigint"), []
    now, before = np.array(first, float if exact else object), None
    state = state.select("*", F.lit(-1).alias("cluster"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"), F.lit(0).cast("long").alias("scanned"))
    schema = f"id {kind}, v array<bigint>, cluster int, "
    for _ in range(rounds):
        after = written(state.mapInArrow(_assign(Geometry(now, before), dims, exact, False), schema + "upper double, lower double, scanned bigint"), "bounds")
        remove(state)
        state = after
        part = lambda i: F.get("v", F.lit(i)) if plain else F.get("v", F.lit(i)).cast("decimal(20,0)")
        sums = state.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*[F.sum(part(i)) for i in range(dims)]).alias("s")).collect()  # k rows
        before, now = now, now.copy()
        for r in sums:
            now[r.cluster] = [int(s) // r.n for s in r.s]
    done = written(state.mapInArrow(_assign(Geometry(now, before), dims, exact, True), schema + "distance bigint, scanned bigint"), "clusters")
    remove(state)
    return done.withColumnRenamed("id", vec_id), [[int(y) for y in c] for c in now]


def with_inertia(found: DataFrame, centres: list[list[int]]) -> DataFrame:
    """found with cluster_inertia, inertia and centroid_sha256 (of the centroid's decimal components, joined by commas)."""
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}  # a row a cluster
    digest = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    rows = [(c, min(s, _LONG), min(sum(sums.values()), _LONG), digest[c]) for c, s in sums.items()]
    named = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(named), "cluster")
