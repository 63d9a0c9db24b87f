"""k-means for many numbers of clusters and restarts, fitted in the same passes.

Every run starts by k-means|| (two rounds, twice k candidates each, weighted by
the rows nearest to them, of which k-means++ picks k) and goes on by Lloyd's
rounds until no centre moves by more than ``TOLERANCE``.  A pass over the rows
serves all runs that still move; sums per centre are added up by a shuffle, and
only centres reach the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOLERANCE = 1e-4
# Rounds and candidates per cluster of a round in the start, and Lloyd's rounds on the candidates.
ROUNDS, OVER, LOCAL = 2, 2, 30
# Rows measured at a time, and centres whose sums are added up in one task.
CHUNK, SLICE = 2048, 128


# --- inside tasks -------------------------------------------------------------

def matrix(column) -> np.ndarray:
    if column.null_count or column.flatten().null_count:
        raise ValueError("vectors to cluster must not be null or hold null")
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def chance(rows: np.ndarray, run: int, step: int) -> np.ndarray:
    """A number from 0 to 1 per row, run and step, from the hashes of the rows' keys."""
    x = rows.view(np.uint64) + np.uint64((run * 64 + step + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53


def near(x: np.ndarray, centres: list[np.ndarray]):
    """Per run the number of the nearest centre, and its squared distance, of each row."""
    every = np.concatenate(centres)
    part = (every * every).sum(axis=1) - 2 * (x @ every.T)
    own, at = (x * x).sum(axis=1), 0
    for c in centres:
        mine = part[:, at : at + len(c)]
        at += len(c)
        best = mine.argmin(axis=1)
        yield best, np.maximum(own + mine[np.arange(len(x)), best], 0.0)


def chunks(batches, *more: str):
    """Vectors and other columns, ``CHUNK`` rows at a time."""
    for whole in batches:
        for start in range(0, whole.num_rows, CHUNK):
            batch = whole.slice(start, CHUNK)
            yield matrix(batch.column("x")), *[batch.column(c).to_numpy() for c in more]


# --- passes over the rows -------------------------------------------------------

def totals(points: DataFrame, centres: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Per run the sums and sizes of the rows nearest to each centre, and the cost."""
    shared = points.sparkSession.sparkContext.broadcast(centres)
    width = centres[0].shape[1]

    def run(batches):
        mine = shared.value
        size = [len(c) for c in mine]
        out, first = np.zeros((sum(size), width + 2)), np.cumsum([0, *size])
        for (x,) in chunks(batches):
            hot = np.zeros((len(x), len(out)))
            for r, (best, cost) in enumerate(near(x, mine)):
                hot[np.arange(len(x)), first[r] + best] = 1
                out[first[r], -1] += cost.sum()
            out[:, :width] += hot.T @ x
            out[:, width] += hot.sum(axis=0)
        for at in range(0, len(out), SLICE):
            values = pa.array([out[at : at + SLICE].ravel()], pa.list_(pa.float64()))
            yield pa.record_batch([pa.array([at], pa.int32()), values], names=["at", "sums"])

    def added(table: pa.Table) -> pa.Table:
        whole = np.sum([s.values.to_numpy() for s in table.column("sums")], axis=0)
        return pa.table({"at": table.column("at").slice(0, 1), "sums": pa.array([whole], pa.list_(pa.float64()))})

    kind = "at int, sums array<double>"
    found = points.select("x").mapInArrow(run, kind).groupBy("at").applyInArrow(added, kind).toArrow()
    shared.destroy()
    order = np.argsort(found.column("at").to_numpy())
    lists = found.column("sums")
    out = np.concatenate([lists[int(i)].values.to_numpy() for i in order]).reshape(-1, width + 2)
    parts = np.split(out, np.cumsum([len(c) for c in centres])[:-1])
    return [p[:, :width] for p in parts], [p[:, width] for p in parts], np.array([p[0, -1] for p in parts])


def firsts(points: DataFrame, runs: range) -> list[np.ndarray]:
    """The first centre of every run: the row of least chance."""
    def run(batches):
        least, held = np.full(len(runs), 2.0), [None] * len(runs)
        for x, h in chunks(batches, "h"):
            for i, r in enumerate(runs):
                u = chance(h, r, 0)
                at = int(u.argmin())
                if u[at] < least[i]:
                    least[i], held[i] = u[at], x[at]
        some = [i for i, x in enumerate(held) if x is not None]
        if some:
            yield pa.record_batch(
                [pa.array(some, pa.int32()), pa.array(least[some]), pa.array([held[i] for i in some], pa.list_(pa.float64()))],
                names=["run", "u", "x"],
            )

    rows = points.mapInArrow(run, "run int, u double, x array<double>").groupBy("run").agg(F.min_by("x", "u").alias("x"))
    return [np.array([r.x]) for r in sorted(rows.collect())]


def drawn(points: DataFrame, centres: list[np.ndarray], share: np.ndarray, step: int) -> list[np.ndarray]:
    """Per run the rows drawn by their distance; ``share`` is the candidates asked for over the cost."""
    shared = points.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        for x, h in chunks(batches, "h"):
            for r, (_, cost) in enumerate(near(x, shared.value)):
                at = np.flatnonzero(chance(h, r, step) < share[r] * cost)
                if len(at):
                    vectors = pa.array(list(x[at]), pa.list_(pa.float64()))
                    yield pa.record_batch([pa.array(np.full(len(at), r, np.int32)), pa.array(h[at]), vectors], names=["run", "h", "x"])

    rows = points.mapInArrow(run, "run int, h long, x array<double>").collect()
    shared.destroy()
    out = [[*c] for c in centres]
    for r in sorted(rows):
        out[r.run].append(np.array(r.x))
    return [np.unique(np.array(c), axis=0) for c in out]


# --- the fit ----------------------------------------------------------------------

def picked(candidates: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ and Lloyd's rounds on weighted candidates."""
    if len(candidates) <= k:
        return candidates
    weight = np.maximum(weight, 1e-12)
    centres = candidates[rng.choice(len(candidates), 1, p=weight / weight.sum())]
    while len(centres) < k:
        ((_, cost),) = near(candidates, [centres])
        odds = weight * cost
        if not odds.sum() > 0:
            break
        centres = np.concatenate([centres, candidates[rng.choice(len(candidates), 1, p=odds / odds.sum())]])
    before = None
    for _ in range(LOCAL):
        ((best, _),) = near(candidates, [centres])
        if before is not None and (best == before).all():
            break
        before = best
        hot = np.eye(len(centres))[best] * weight[:, None]
        sizes = hot.sum(axis=0)
        centres = np.where(sizes[:, None] > 0, hot.T @ candidates / np.maximum(sizes, 1e-300)[:, None], centres)
    return centres


def starts(points: DataFrame, ks: list[int], seed: int) -> list[np.ndarray]:
    """The first centres of one run for every entry of ``ks``."""
    centres = firsts(points, range(seed, seed + len(ks)))
    if not centres:
        raise ValueError("no vectors to cluster")
    for step in range(1, ROUNDS + 1):
        cost = totals(points, centres)[2]
        share = np.divide(OVER * np.array(ks), cost, out=np.zeros(len(ks)), where=cost > 0)
        centres = drawn(points, centres, share, step)
    sizes = totals(points, centres)[1]
    return [picked(c, n, k, np.random.default_rng([seed, i])) for i, (c, n, k) in enumerate(zip(centres, sizes, ks))]


def fit(points: DataFrame, ks: list[int], seed: int, max_iter: int) -> list[tuple[np.ndarray, float]]:
    """Centres and cost of one run for every entry of ``ks``; ``points`` has a vector ``x`` and a hash ``h`` of the key."""
    centres, cost = starts(points, ks, seed), np.full(len(ks), np.inf)
    moving = list(range(len(ks)))
    for _ in range(max_iter):
        if not moving:
            break
        sums, sizes, found = totals(points, [centres[i] for i in moving])
        still = []
        for i, s, n, c in zip(moving, sums, sizes, found):
            # A centre without rows stays.
            new = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], centres[i])
            if ((new - centres[i]) ** 2).sum(axis=1).max() > TOLERANCE**2:
                still.append(i)
            centres[i], cost[i] = new, c
        moving = still
    return list(zip(centres, cost.tolist()))


def assigned(points: DataFrame, centres: list[np.ndarray], keep: list[str]) -> DataFrame:
    """Columns ``keep`` and ``clusters``, the number of the nearest centre of each run."""
    schema = T.StructType(points.select(*keep).schema.fields).add("clusters", T.ArrayType(T.IntegerType()))

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(start, CHUNK)
                best = np.stack([b for b, _ in near(matrix(batch.column("x")), centres)], axis=1).astype(np.int32)
                ends = pa.array(np.arange(0, best.size + 1, len(centres)).astype(np.int32))
                lists = pa.ListArray.from_arrays(ends, pa.array(best.ravel()))
                yield pa.record_batch([*[batch.column(c) for c in keep], lists], names=[*keep, "clusters"])

    return points.select(*keep, "x").mapInArrow(run, schema)
