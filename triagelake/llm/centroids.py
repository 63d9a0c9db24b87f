"""Centroid clustering in whole numbers, with geometrically tightened bounds.

Lloyd's rounds on vectors ``floor(1024 * x)``.  Every vector keeps its nearest
centroid, an upper bound of its distance to it and lower bounds of its
distances to the others.  When centroids move, a lower bound need not shrink by
the whole drift: the vectors of a cluster lie in a sphere around its centroid,
and in the plane through that centroid and the old and new place of another one
no point of the sphere comes closer to that one than the drift times the
cosine of the least angle between the drift and the sphere, seen from the
drift's midpoint (a point at angle ``t`` has ``|p - a| - |p - b| <= |a - b| *
cos t``, as the two distances add up to at least twice that to the midpoint).
Vectors whose bounds leave no doubt stay as they are; the others are scanned
exactly in integers.  Centroids change by the sums of what moved.

Vectors lie in blocks inside rows, which stay in the executors between rounds
(persisted; a lost block is computed again from the written vectors).  Only
sums and radii per centroid reach the driver.

Defined results: vectors that are NULL, have another number of components, or
hold NULL, non-finite or such large components (over ``2 ** 17``) that a
squared distance might not fit a long, are left out; rows that repeat an id are
vectors of their own; NULL ids are kept, and come last where hashes tie;
distances that tie go to the smaller number; with fewer vectors than centroids
there are as many centroids as vectors, with none there are no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.llm.arrow import tidy
from triagelake.session import checkpoint

SCALE = 1024
LARGEST = float(1 << 17)
BLOCK = 2048
# Whole numbers up to here multiply exactly in double precision.
SMALL = 1 << 21
STATE = "ids array<bigint>, vectors binary, nearest binary, upper binary, lower binary, distance binary, radius array<double>, moved array<decimal(38,0)>, scanned bigint"


def whole(df: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """``id, v``: the vectors to cluster, in whole numbers."""
    x = F.col(vector).cast("array<double>")
    ok = (F.size(x) == size) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST))
    scaled = F.transform(x, lambda c: F.floor(SCALE * c).cast("int"))
    return df.where(F.coalesce(ok, F.lit(False))).select(F.col(key).cast("long").alias("id"), scaled.alias("v"))


def start(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors of least hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = vectors.orderBy(digest, F.col("id").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of ``x`` to rows of ``c``."""
    if len(x) and max(np.abs(x).max(), np.abs(c).max()) <= SMALL:
        f, g = x.astype(float), c.astype(float)
        return ((f * f).sum(1)[:, None] - 2 * (f @ g.T) + (g * g).sum(1)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], axis=1)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """How much closer centroid ``j`` may have come to members of cluster ``i``, at most."""
    k = len(old)
    out = np.zeros((k, k))
    for j in range(k):
        step = (new[j] - old[j]).astype(float)
        drift = np.sqrt(step @ step)
        if not drift:
            continue
        middle = (old[j] + new[j]) / 2
        for i in range(k):
            to = old[i] - middle
            far = np.sqrt(to @ to)
            along = to @ step / drift
            across = np.sqrt(max(far * far - along * along, 0.0))
            if far <= radius[i]:
                cosine = 1.0
            else:
                # The angle at the midpoint, less the half angle that the sphere fills.
                half = np.arcsin(radius[i] / far)
                cosine = np.cos(max(np.arctan2(across, along) - half, 0.0))
            out[i, j] = drift * max(cosine, 0.0)
    return out


def slack(x: np.ndarray) -> np.ndarray:
    """Room for rounding."""
    return x * 1e-12 + 1e-6


def packed(batches, size: int) -> Iterator[pa.RecordBatch]:
    """Blocks of vectors from rows ``id, v``."""
    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK):
            part = batch.slice(i, BLOCK)
            v = part.column("v").flatten().to_numpy().reshape(-1, size).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), part.column("id"))
            yield pa.record_batch([ids, pa.array([v.tobytes()])], names=["ids", "vectors"])


class Step:
    """One assignment of blocks to the centroids ``new``.

    ``old`` and ``loose`` describe the step before; without them every vector
    is scanned.  ``exact`` asks for every vector's own distance.
    """

    def __init__(self, new, old=None, loose=None, exact=False):
        self.new, self.exact, self.first, self.loose = new, exact, old is None, loose
        if not self.first:
            self.drift = np.sqrt(((new - old).astype(float) ** 2).sum(1))

    def assign(self, x, near, upper, lower):
        """New nearest, bounds and distances, and how many vectors were scanned."""
        n, k = len(x), len(self.new)
        distance = np.full(n, -1, np.int64)
        if self.first:
            near, upper, lower = np.zeros(n, np.int64), np.zeros(n), np.zeros((n, k))
            doubt = np.arange(n)
        else:
            near, upper, lower = near.copy(), upper + self.drift[near], lower - self.loose[near]
            lower[np.arange(n), near] = np.inf
            close = lower.min(axis=1)
            close -= slack(np.abs(close))
            open_ = np.arange(n) if self.exact else np.flatnonzero(upper + slack(upper) >= close)
            for c in range(k):
                mine = open_[near[open_] == c]
                distance[mine] = squares(x[mine], self.new[c : c + 1])[:, 0]
            upper[open_] = np.sqrt(distance[open_])
            doubt = open_[upper[open_] + slack(upper[open_]) >= close[open_]]
        if len(doubt):
            d = squares(x[doubt], self.new)
            near[doubt], distance[doubt] = d.argmin(1), d.min(1)
            lower[doubt] = np.sqrt(d)
            upper[doubt] = np.sqrt(distance[doubt])
        return near, upper, lower, distance, len(doubt)

    def __call__(self, batches):
        k, size = self.new.shape
        for batch in batches:
            for row in range(batch.num_rows):
                x = np.frombuffer(batch.column("vectors")[row].as_buffer(), np.int32).reshape(-1, size).astype(np.int64)
                was = None if self.first else np.frombuffer(batch.column("nearest")[row].as_buffer(), np.int64)
                bounds = [None, None] if self.first else [np.frombuffer(batch.column(c)[row].as_buffer(), float) for c in ("upper", "lower")]
                if not self.first:
                    bounds[1] = bounds[1].reshape(-1, k)
                near, upper, lower, distance, scanned = self.assign(x, was, *bounds)
                radius = np.zeros(k)
                np.maximum.at(radius, near, upper + slack(upper))
                change = np.zeros((k, size + 1), np.int64)
                moved = np.arange(len(x)) if self.first else np.flatnonzero(near != was)
                full = np.c_[x[moved], np.ones(len(moved), np.int64)]
                np.add.at(change, near[moved], full)
                if not self.first:
                    np.subtract.at(change, was[moved], full)
                data = [
                    batch.column("ids").slice(row, 1), batch.column("vectors").slice(row, 1),
                    *[pa.array([a.tobytes()]) for a in (near, upper, lower, distance)],
                    pa.array([radius.tolist()], pa.list_(pa.float64())),
                    pa.array([change.ravel().tolist()], pa.list_(pa.int64())).cast(pa.list_(pa.decimal128(38, 0))),
                    pa.array([scanned], pa.int64()),
                ]
                yield pa.record_batch(data, names=["ids", "vectors", "nearest", "upper", "lower", "distance", "radius", "moved", "scanned"])


def totals(state: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Radii per cluster, changes of sums and counts, and how many vectors were scanned."""
    each = state.select(F.posexplode(F.arrays_zip("moved", "radius")), "scanned")
    rows = each.groupBy("pos").agg(
        F.sum("col.moved").cast("string").alias("moved"), F.max("col.radius").alias("radius"), F.sum("scanned").alias("scanned")
    )
    rows = sorted(rows.collect())  # a row for each component of each centroid
    radius = np.array([r.radius for r in rows if r.radius is not None])
    return radius, np.array([int(r.moved) for r in rows], object), rows[0].scanned


class Clusters:
    """What clustering gives.

    ``centroids`` holds the last centroids, ``scanned`` how many vectors each
    assignment scanned; ``members`` has a row ``id, cluster, distance`` for
    every vector.
    """

    def __init__(self, centroids: np.ndarray, scanned: list[int], members: DataFrame):
        self.centroids, self.scanned, self.members = centroids, scanned, members

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in self.centroids]


def fit(df: DataFrame, k: int, rounds: int, seed: int = 0, key: str = "id", vector: str = "v", size: int = 64) -> Clusters:
    """Cluster the vectors of ``df`` in ``rounds`` rounds and a last assignment."""
    vectors = checkpoint(whole(df, key, vector, size))
    centroids = start(vectors, k, seed)
    none = df.sparkSession.createDataFrame([], "id bigint, cluster int, distance bigint")
    if not len(centroids):
        return Clusters(np.zeros((0, size), np.int64), [], none)
    k = len(centroids)
    blocks = checkpoint(vectors.mapInArrow(tidy(lambda batches: packed(batches, size)), "ids array<bigint>, vectors binary"))
    step, state, scanned = Step(centroids), blocks, []
    sums = np.zeros((k, size + 1), object)
    for at in range(rounds + 1):
        after = state.mapInArrow(tidy(step), STATE).persist(StorageLevel.MEMORY_AND_DISK)
        radius, change, n = totals(after)
        if state is not blocks:
            state.unpersist()
        state = after
        scanned.append(n)
        if at == rounds:
            break
        sums += change.reshape(k, size + 1)
        moved = centroids.copy()
        for c in np.flatnonzero(sums[:, -1] > 0):
            moved[c] = [s // sums[c, -1] for s in sums[c, :-1]]
        step = Step(moved, centroids, loosening(centroids, moved, radius), exact=at == rounds - 1)
        centroids = moved

    def unpacked(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                near, distance = (np.frombuffer(batch.column(c)[row].as_buffer(), np.int64) for c in ("nearest", "distance"))
                ids = batch.column("ids").slice(row, 1).flatten()
                yield pa.record_batch([ids, pa.array(near.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"])

    kept = state.select("ids", "nearest", "distance")
    members = checkpoint(kept.mapInArrow(tidy(unpacked), "id bigint, cluster int, distance bigint"))
    state.unpersist()
    return Clusters(centroids, scanned, members)
