"""Duplicate topics merged in rounds, against the sequential fold of the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from topicloom.operators import folds


def made(seed, topics, density, keys, hub=False):
    draw = random.Random(seed)
    rows, at = [], 0
    for t in range(topics):
        for _ in range(draw.choice([0, 1, 1, 2, 2, 3, 5])):
            rows.append((t, at, draw.choice([None, "", *[f"k{k}" for k in range(keys)]]), draw.choice([None, "", "a", "b", "c"])))
            at += 1
    pairs = [(i, j) for i in range(topics) for j in range(i + 1, topics) if draw.random() < density or (hub and i == 3)]
    draw.shuffle(pairs)
    return rows, pairs


def folded(rows, pairs, compat):
    """The loop itself, on the whole group."""
    names = sorted({r[0] for r in rows} | {x for p in pairs for x in p})
    place = {n: k for k, n in enumerate(names)}
    topics = [folds._Topic(domains=[]) for _ in names]
    for t, at, key, domain in rows:
        topic = topics[place[t]]
        topic.size += 1
        topic.domains.append(domain or "")
        if key:
            topic.items[key] = (domain or "", at)
    owner = folds.fold_duplicates(topics, {(place[a], place[b]) for a, b in pairs}, compat)
    out = []
    for k, w in owner.items():
        if k == w:
            out += [(names[k], p) for _, p in topics[k].items.values()] if topics[k].domains is None else [(t, at) for t, at, _, _ in rows if t == names[k]]
    return sorted(out)


@pytest.mark.parametrize("compat", [True, False])
@pytest.mark.parametrize(("seed", "topics", "density", "keys", "hub"), [(1, 14, 0.2, 9, False), (2, 12, 0.5, 30, False), (3, 30, 0.02, 60, True), (4, 25, 0.08, 4, False)])
def test_rounds_equal_the_loop(spark, seed, topics, density, keys, hub, compat):
    rows, pairs = made(seed, topics, density, keys, hub)
    df = spark.createDataFrame(rows, "topic long, ord long, key string, domain string").repartition(3)
    links = spark.createDataFrame(pairs, "i long, j long")
    got = sorted((r["topic"], r["ord"]) for r in folds.merge_duplicates(df, links, compat, most_rows=0).collect())
    assert got == folded(rows, pairs, compat)


def test_large_and_small_groups_side_by_side(spark):
    rows, pairs = made(5, 10, 0.3, 6)
    rows += [(100 + k, 1000 + k, f"z{k % 3}", "d") for k in range(4)] + [(200, 2000, None, None)]
    links = spark.createDataFrame([*pairs, (100, 101), (102, 103)], "i long, j long")
    df = spark.createDataFrame(rows, "topic long, ord long, key string, domain string")
    want = folded(rows, [*pairs, (100, 101), (102, 103)], True)
    for most in (0, 3, 10**6):
        assert sorted((r["topic"], r["ord"]) for r in folds.merge_duplicates(df, links, most_rows=most).collect()) == want


def test_a_hub_of_very_many_topics(spark):
    """100,000 topics that are all like the first: one round of wins, one article a topic, every third with a known key."""
    n = 100_000
    rows = spark.range(n).select(F.col("id").alias("topic"), F.col("id").alias("ord"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("key"), F.lit("d").alias("domain"))
    links = spark.range(1, n).select(F.lit(0).cast("long").alias("i"), F.col("id").alias("j"))
    got = folds.merge_in_rounds(rows, links)
    keys = {"same"} | {k for k in range(n) if k % 3}
    assert got.count() == len(keys) and [r["topic"] for r in got.select("topic").distinct().collect()] == [0]
    assert got.agg(F.max("ord")).first()[0] == n - 1
