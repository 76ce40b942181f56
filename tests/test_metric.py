"""Range joins of vectors by a tree of pivots, against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.operators import joins, metric, vectors


def lumpy(seed, n=600, dims=8, centres=12, noise=0.15):
    """Unit vectors around centres of very different sizes, some of them equal, and a few zero vectors."""
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dims))
    x = c[np.minimum(rng.geometric(0.35, n) - 1, centres - 1)] + noise * rng.normal(size=(n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[n // 2 : n // 2 + 20] = x[0]
    x[-3:] = 0
    return x


def table(spark, x):
    return spark.createDataFrame([(int(i) * 3 + 1, [float(a) for a in v]) for i, v in enumerate(x)], "ord long, vector array<double>").repartition(4)


@pytest.mark.parametrize(("least", "block"), [(0.95, 16), (0.8, 40), (0.35, 16), (-0.2, 64), (1.0 - 1e-9, 8)])
def test_equals_all_pairs(spark, least, block):
    x = lumpy(int(100 * abs(least)))
    sims = x @ x.T
    want = {(int(i) * 3 + 1, int(j) * 3 + 1) for i, j in zip(*np.nonzero(np.triu(sims >= least, 1)), strict=True)}
    got = [(r["i"], r["j"]) for r in vectors.similar_pairs(table(spark, x), least, block=block).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_cells_are_divided_until_they_fit(spark):
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(300, 8)), 3, axis=0) + 0.001 * rng.normal(size=(900, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = vectors.packed(table(spark, x).select(F.lit("0").alias("cell"), F.col("ord").alias("node"), F.col("vector").alias("v")))
    cells = metric.pivot_cells(rows, 0.05, 24)
    sizes = [(r["h"], r["n"]) for r in cells.groupBy("cell").agg(F.sum(F.col("home").cast("int")).alias("h"), F.count("*").alias("n")).collect()]
    assert sum(h for h, _ in sizes) == 900 and max(h for h, _ in sizes) <= 24
    assert max(c["cell"].count("/") for c in cells.select("cell").distinct().collect()) >= 2
    assert sum(h * n for h, n in sizes) < 0.1 * 900**2


def test_unstructured_vectors_stay_whole_and_a_forced_cell_is_divided_once(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = vectors.packed(table(spark, x).select(F.lit("0").alias("cell"), F.col("ord").alias("node"), F.col("vector").alias("v")))
    assert [r["cell"] for r in metric.pivot_cells(rows, 1.0, 20).select("cell").distinct().collect()] == ["0"]
    forced = metric.pivot_cells(rows, 0.3, 1000, always=True)
    assert forced.filter("home").count() == 200 and forced.select("cell").distinct().count() == 2


def test_chunks_of_a_cell_agree(spark, monkeypatch):
    monkeypatch.setattr(metric, "CHUNK", 50)
    x = lumpy(8, n=400)
    got = {(r["i"], r["j"]) for r in vectors.similar_pairs(table(spark, x), 0.9, block=16).collect()}
    sims = x @ x.T
    assert got == {(int(i) * 3 + 1, int(j) * 3 + 1) for i, j in zip(*np.nonzero(np.triu(sims >= 0.9, 1)), strict=True)}


def test_empty_and_single(spark):
    none = spark.createDataFrame([], "ord long, vector array<double>")
    assert vectors.similar_pairs(none, 0.5).collect() == []
    assert vectors.similar_pairs(table(spark, np.eye(3)[:1]), 0.5).collect() == []


def test_counts_of_hot_and_other_keys(spark, monkeypatch):
    monkeypatch.setattr(joins, "LEAST", 10)
    monkeypatch.setattr(joins, "HOT", 4)  # fewer than there are keys
    rows = spark.range(1000).select(F.when(F.col("id") < 600, "a").otherwise((F.col("id") % 40).cast("string")).alias("k"), "id")
    got = joins.with_counts(rows, "k", n=F.count("*"))
    assert got.columns == ["k", "id", "n"] and got.count() == 1000
    assert {(r["k"], r["n"]) for r in got.collect()} == {("a", 600), *((str(k), 10) for k in range(40))}
