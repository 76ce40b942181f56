"""k-means against a plain loop; the nearest centre by a tree of pivots against all centres."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.operators import joins, metric, vectors


def lumps(seed, n=240, dims=6, centres=9, noise=0.3):
    rng = np.random.default_rng(seed)
    x = 3 * rng.normal(size=(centres, dims))[rng.integers(0, centres, n)] + noise * rng.normal(size=(n, dims))
    x[10:14] = x[3]
    return x


def table(spark, x):
    return spark.createDataFrame([(2 * i + 5, [float(a) for a in v]) for i, v in enumerate(x)], "ord long, vector array<double>").repartition(3)


def packed(spark, x, name="node"):
    return vectors.packed(table(spark, x).select(F.col("ord").alias(name), F.col("vector").alias("v")))


def loop(x, k, rounds):
    kinds = {}
    for i, v in enumerate(x):
        kinds.setdefault(v.tobytes(), 2 * i + 5)
    first = sorted(kinds.values(), key=lambda o: (hashlib.md5(f"42:{o}".encode()).hexdigest(), o))[:k]
    c = np.array([x[(o - 5) // 2] for o in first])
    was = None
    for _ in range(rounds):
        d2 = np.round(((x[:, None] - c[None]) ** 2).sum(axis=2), 12)
        at = d2.argmin(axis=1)
        if was is not None and (at == was).all():
            break
        was = at
        c = np.array([x[at == j].mean(axis=0) if (at == j).any() else c[j] for j in range(len(c))])
    return {2 * i + 5: int(j) for i, j in enumerate(at)}


@pytest.mark.parametrize("few", [4096, 1])
def test_kmeans_is_the_loop(spark, few):
    x = lumps(1)
    got = {r["ord"]: r["cluster_id"] for r in vectors.kmeans(table(spark, x), k=12, rounds=4, few=few).collect()}
    assert got == loop(x, 12, 4)


def test_default_number_and_end(spark):
    x = lumps(2, n=120, noise=0.05)
    got = {r["ord"]: r["cluster_id"] for r in vectors.kmeans(table(spark, x)).collect()}
    assert got == loop(x, 12, 20)


@pytest.mark.parametrize(("limit", "block", "noise"), [(1024, 4096, 0.3), (8, 16, 0.3), (4, 50, 0.02)])
def test_nearest_centre(spark, limit, block, noise):
    x, c = lumps(3, n=300, centres=30, noise=noise), lumps(4, n=90, centres=30, noise=noise)
    points, centres = packed(spark, x), packed(spark, c, "centre").withColumnRenamed("node", "centre")
    d2 = np.round(((x[:, None] - c[None]) ** 2).sum(axis=2), 9)
    want = {2 * i + 5: (2 * int(j) + 5, d2[i, j]) for i, j in enumerate(d2.argmin(axis=1))}
    for known in (points, points.withColumn("centre", (F.floor(F.col("node") % 90 / 2) * 2 + 5).cast("long"))):
        got = {r["node"]: (r["centre"], round(r["d2"], 9)) for r in metric.nearest(known, centres, limit, block, few=5).collect()}
        assert set(got) == set(want)
        assert all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)


def test_numbers_by_range(spark):
    got = joins.numbered(spark.range(3000).select((F.col("id") * 7919 % 3000).alias("v")), [F.desc("v")])
    assert {r["v"]: r["number"] for r in got.collect()} == {v: 2999 - v for v in range(3000)}


def test_only_rows_with_ties_have_all_their_distances_rounded(monkeypatch):
    """The nearest centre as by all rounded distances, the smallest of equal ones; without ties only one distance a row is rounded."""
    draw = np.random.default_rng(9)
    c, x = draw.normal(size=(300, 8)), draw.normal(size=(100, 8))
    c[200:210] = c[:10]
    x[:10] = c[:10] + 1e-9
    d2 = np.round(np.maximum(0, (x**2).sum(axis=1)[:, None] + (c**2).sum(axis=1) - 2 * x @ c.T), 12)
    seen, plain = [], np.round
    monkeypatch.setattr(np, "round", lambda a, *k: seen.append(np.size(a)) or plain(a, *k))
    best, found = metric.closest(x, c)
    assert (best == d2.argmin(axis=1)).all() and np.abs(found - d2.min(axis=1)).max() <= 2e-12
    assert (best[:10] == np.arange(10)).all() and sum(seen) <= 100 + 300 * np.count_nonzero((d2 == d2.min(axis=1)[:, None]).sum(axis=1) > 1)
