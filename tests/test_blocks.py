"""Blocks of cells that can't be divided: all pairs once, and a number of copies of each vector that doesn't grow with the table."""

import numpy as np
import pytest

from topicloom.operators import metric, vectors


@pytest.mark.parametrize(("n", "least", "block"), [(200, 0.2, 7), (300, 0.6, 16), (64, -0.5, 64)])
def test_all_pairs_once(spark, n, least, block):
    x = np.random.default_rng(n).normal(size=(n, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(3 * k, v.tolist()) for k, v in enumerate(x)], "ord long, vector array<double>").repartition(3)
    got = [(r["i"], r["j"]) for r in vectors.similar_pairs(rows, least, block=block).collect()]
    want = {(3 * int(i), 3 * int(j)) for i, j in zip(*np.nonzero(np.triu(x @ x.T >= least, 1)), strict=True)}
    assert len(got) == len(set(got)) and set(got) == want and want


def test_copies_of_a_vector_are_bounded(spark):
    n = spark.createDataFrame([(k,) for k in (1, 1024, 16_384, 600_000, 1_048_576, 2_097_152)], "n long")
    assert [r[0] for r in n.select(metric.blocks(n["n"], 1024)).collect()] == [1, 1, 16, 16, 16, 32]


def test_nearest_centres_in_several_parts_of_a_block(spark):
    """More centres than are compared at once, some of them equal: the smallest of the nearest."""
    draw = np.random.default_rng(4)
    c = draw.normal(size=(90, 3)).round(1)
    c[50:60] = c[:10]
    x = draw.normal(size=(70, 3))
    centres = spark.createDataFrame([(k, v.tobytes()) for k, v in enumerate(c)], "centre long, unit binary")
    points = spark.createDataFrame([(k, v.tobytes()) for k, v in enumerate(x)], "node long, unit binary")
    got = {r["node"]: r["centre"] for r in metric.nearest(points, centres, limit=4, block=8).collect()}
    assert got == dict(enumerate(metric.closest(x, c)[0].tolist()))
