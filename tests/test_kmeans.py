"""k-means of many runs at once."""

import numpy as np
import pytest

from triagelake.operators import kmeans, topics


def blobs(n: int, k: int, size: int = 8):
    rng = np.random.default_rng(4)
    centres = np.eye(size)[:k] + 0.05
    own = np.arange(n) % k
    x = centres[own] + rng.normal(0, 0.03, (n, size))
    return own, x / np.linalg.norm(x, axis=1, keepdims=True)


def test_all_runs_are_fitted_in_the_same_passes(spark, monkeypatch):
    own, x = blobs(400, 5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
    passes, totals = [], kmeans.totals
    monkeypatch.setattr(kmeans, "totals", lambda points, centres: passes.append(len(centres)) or totals(points, centres))
    report, centres, rows = topics.choose_k(df, "v", "id", ks=(3, 4, 5, 6), restarts=4, max_iter=50)
    # 16 runs of some rounds each; one by one that were 16 times the passes.
    assert passes[0] == 16 and len(passes) <= 50 + kmeans.ROUNDS + 1
    told = {r.k: r for r in report.collect()}
    assert [k for k, r in told.items() if r.best] == [5] and told[5].silhouette > 0.9
    assert told[3].cost > told[4].cost > told[5].cost
    # The best run finds the groups, its cost is that of its centres, and rows go to the nearest.
    got = {r.id: r.cluster for r in rows.collect()}
    assert len({(own[i], c) for i, c in got.items()}) == 5 == len(set(got.values()))
    d = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    assert d.min(axis=1).sum() == pytest.approx(told[5].cost, rel=1e-3)
    assert all(d[i].argmin() == c for i, c in got.items())


def test_fewer_rows_than_clusters(spark):
    df = spark.createDataFrame([(i, [float(i // 2), 1.0]) for i in range(4)], "id long, v array<double>")
    report, _, rows = topics.choose_k(df, "v", "id", ks=(2, 3), restarts=2)
    assert {r.cost for r in report.collect()} == {0.0}
    assert len({r.cluster for r in rows.collect()}) == 2
