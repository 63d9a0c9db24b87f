"""Clustering against Lloyd's rounds on Python integers."""

import hashlib
import math
import random

import numpy as np

from triagelake.llm import centroids


def lloyd(rows, k, rounds, seed):
    """Rows ``(id, vector of whole numbers)``; returns nearest, distance and centroids."""
    order = sorted(rows, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is None, r[0] or 0, r[1]))
    c = [list(v) for _, v in order[:k]]
    for at in range(rounds + 1):
        near = []
        for _, v in rows:
            d = [sum((a - b) ** 2 for a, b in zip(v, m)) for m in c]
            near.append((d.index(min(d)), min(d)))
        if at < rounds:
            for j in range(len(c)):
                mine = [v for (_, v), (n, _) in zip(rows, near) if n == j]
                if mine:
                    c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    return near, c


def check(spark, rows, k, rounds, size, seed=3):
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    got = centroids.fit(df, k, rounds, seed, size=size)
    ints = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    near, c = lloyd(ints, k, rounds, seed)
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted(map(tuple, got.members.collect()), key=key) == sorted([(i, *n) for (i, _), n in zip(ints, near)], key=key)
    assert got.centroids.tolist() == c
    return got


def test_clusters_are_those_of_plain_rounds(spark):
    rng = random.Random(1)
    spread = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(400)]
    check(spark, spread, 8, 10, 6)
    hubs = [[rng.uniform(-9, 9) for _ in range(6)] for _ in range(12)]
    tight = [(i, [x + rng.gauss(0, 0.3) for x in rng.choice(hubs)]) for i in range(3000)]
    got = check(spark, tight, 12, 10, 6)
    # Where clusters are clear, few vectors are scanned again.
    assert got.scanned[0] == 3000 and sum(got.scanned[3:]) < 0.3 * 3000 * len(got.scanned[3:])


def test_ties_and_repeats(spark):
    rng = random.Random(2)
    rows = [(i % 40, [float(rng.randrange(2)) for _ in range(3)]) for i in range(120)] + [(None, [0.0, 1.0, 0.0]), (None, [1.0, 1.0, 1.0])]
    check(spark, rows, 8, 4, 3)
    check(spark, rows[:3], 8, 4, 3)


def test_large_components(spark):
    rng = random.Random(3)
    check(spark, [(i, [rng.uniform(-1, 1) * centroids.LARGEST for _ in range(4)]) for i in range(200)], 5, 6, 4)


def test_odd_vectors_are_left_out(spark):
    ok = [1.0, 2.0]
    rows = [(1, ok, 1), (2, None, 2), (3, [], 3), (4, [1.0], 4), (5, [1.0, None], 5), (6, [1.0, float("nan")], 6),
            (7, [float("inf"), 0.0], 7), (8, [1e300, 0.0], 8), (None, ok, 9), (1, ok, 10)]
    df = spark.createDataFrame(rows, "id long, v array<double>, cluster int")
    got = centroids.fit(df, 2, 3, size=2).members
    assert sorted(map(str, got.collect())) == sorted(["Row(id=1, cluster=0, distance=0)"] * 2 + ["Row(id=None, cluster=0, distance=0)"])
    assert centroids.fit(df.limit(0), 2, 3, size=2).members.count() == 0


def test_loosening_bounds_the_sphere():
    """No point of a sphere comes closer than the bound, which is often far less than the drift."""
    rng, less = np.random.default_rng(4), 0
    for _ in range(200):
        old = rng.normal(size=(3, 5)) * 3
        new = old + rng.normal(size=(3, 5)) * rng.uniform(0, 2)
        radius = rng.uniform(0, 2, 3)
        bound = centroids.loosening(old, new, radius)
        drift = np.sqrt(((new - old) ** 2).sum(1))
        for i in range(3):
            p = rng.normal(size=(2000, 5))
            p = old[i] + p / np.linalg.norm(p, axis=1)[:, None] * radius[i]
            for j in range(3):
                closer = np.linalg.norm(p - old[j], axis=1) - np.linalg.norm(p - new[j], axis=1)
                assert closer.max() <= bound[i, j] + 1e-9 and bound[i, j] <= drift[j] + 1e-9
                less += i != j and bound[i, j] < 0.7 * drift[j]
    assert less > 300
