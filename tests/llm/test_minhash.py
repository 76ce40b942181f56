import random
import re

import numpy as np
import pytest

from topicloom.llm.components import components
from topicloom.llm.minhash import _met, near_dedup, near_distinct, signatures


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                both = len(a & b)
                if a and b and 100 * both >= 75 * (len(a) + len(b) - both):
                    label[i] = label[j] = min(label[i], label[j])
    groups = {}
    for (i, _), k in zip(rows, label, strict=True):
        groups.setdefault(k, []).append(i)
    best = {k: min((i for i in v if i is not None), default=None) for k, v in groups.items()}
    return [len(s) for s in sets], [i if not s else best[k] for (i, _), k, s in zip(rows, label, sets, strict=True)]


def compare(rows, got):
    sizes, component = brute(rows)
    want = sorted((str(i), n, str(c)) for (i, _), n, c in zip(rows, sizes, component, strict=True))
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == want
    assert all(r["kept"] == (None if r["doc_id"] is None else r["doc_id"] == r["component_id"]) for r in got)


def test_odd_texts(spark, texts):
    rows = [(r["doc_id"], r["text"]) for r in texts.collect()]
    compare(rows, near_dedup(texts).collect())
    kept = near_distinct(texts)
    assert kept.columns == texts.columns
    assert kept.filter("doc_id in (1, 2, 3, 4)").count() == 1


@pytest.mark.parametrize("seed", range(3))
def test_near_copies_match_brute_force(spark, seed):
    """Variants of a few bases, with dropped and changed words: chains, and pairs on both sides of the limit."""
    draw = random.Random(seed)
    word = lambda: "w" + str(draw.randrange(3000))
    rows = []
    for b in range(4):
        base = [word() for _ in range(draw.choice([6, 12, 40, 120]))]
        for _ in range(14):
            text = [w if draw.random() > 0.03 else word() for w in base if draw.random() > 0.02]
            rows.append((len(rows), " ".join(text)))
    rows += [(len(rows) + k, " ".join(word() for _ in range(30))) for k in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    compare(rows, near_dedup(df).collect())


def test_hot_group(spark):
    base = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(i, base if i % 3 == 0 else f"{base} x{i % 5}" if i % 3 == 1 else f"other text {i} with words {i * 7} and {i * 11}") for i in range(600)], "doc_id long, text string")
    got = near_dedup(df).collect()
    assert sum(r["kept"] for r in got) == 201
    assert sum(r["component_id"] == 0 for r in got) == 400


def test_empty(spark, nothing):
    assert near_dedup(nothing).count() == 0
    assert near_distinct(nothing).columns == nothing.columns


def test_densified_bins_agree_like_the_sets():
    draw = np.random.default_rng(1)
    for n, shared in ((4, 3), (40, 30), (400, 330)):
        sets = []
        for _ in range(200):
            u = draw.integers(0, 2**64, 2 * n - shared, dtype=np.uint64)
            sets += [np.sort(u[:n]), np.sort(u[n - shared :])]
        sig = signatures(sets)
        assert (sig[0::2] == sig[1::2]).mean() == pytest.approx(shared / (2 * n - shared), abs=0.03)


def test_blocks_find_links_between_labels():
    import pyarrow as pa

    sets = [list(range(20)), list(range(1, 21)), list(range(100, 120)), list(range(15, 35))]
    table = pa.table({"i": [0] * 4, "j": [0] * 4, "first": [True] * 4, "label": [1, 2, 3, 4], "n": [20] * 4, "shared": [20] * 4, "grams": pa.array(sets, pa.list_(pa.int64()))})
    assert _met(table, 75) == [(1, 2)]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    draw = random.Random(seed)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5)]
    label = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in range(200):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == label


def test_components_with_hubs(spark, monkeypatch):
    """Nodes with very many edges take the broadcast way; the others the join."""
    from topicloom.llm import components as own

    monkeypatch.setattr(own, "LEAST_HUB", 8)
    edges = [(i, 1000) for i in range(300)] + [(i, 2000) for i in range(250, 600)] + [(3000 + i, 3001 + i) for i in range(20)] + [(2000, 3000), (None, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len(got) == 600 + 2 + 21 and set(got.values()) == {0}


@pytest.mark.parametrize("block", [300, 3000])
def test_residue_in_small_blocks(spark, block):
    """Buckets with several components, whose classes are dealt to many blocks by size."""
    from topicloom.llm.minhash import near_groups

    draw = random.Random(block)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(60):
        size = draw.choice([60, 80, 110, 150, 200])
        rows.append((k, " ".join(w if draw.random() > 0.012 else f"x{draw.randrange(10**6)}" for w in base[:size])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found_rows, found = near_groups(df, block=block)
    got = {r["id"]: r["component_id"] for r in found_rows.join(found, "print").selectExpr("row.doc_id as id", "component_id").collect()}
    assert got == {i: c for (i, _), c in zip(rows, brute(rows)[1], strict=True)}
