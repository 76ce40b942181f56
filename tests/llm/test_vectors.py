import numpy as np
import pytest

from topicloom.llm.embeddings import near_vectors


def brute(rows):
    sound = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and lab is not None for _, v, lab in rows]
    n = [0] * len(rows)
    label = list(range(len(rows)))
    links = []
    for i, (_, a, la) in enumerate(rows):
        for j, (_, b, lb) in enumerate(rows):
            if i != j and sound[i] and sound[j] and la == lb and len(a) == len(b):
                x, y = np.array(a, float), np.array(b, float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                    n[i] += 1
                    links.append((i, j))
    for _ in rows:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    groups = {}
    for k, i in enumerate(label):
        groups.setdefault(i, []).append(rows[k][0])
    return n, [min((x for x in groups[k] if x is not None), default=None) for k in label]


@pytest.mark.parametrize(("seed", "cell_rows"), [(0, 2048), (1, 16), (2, 5)])
def test_matches_brute_force(spark, seed, cell_rows):
    draw = np.random.default_rng(seed)
    rows = []
    for c in range(6):
        centre = draw.normal(size=8)
        for _ in range(15):
            v = centre + draw.normal(size=8) * draw.choice([0.05, 0.2, 0.5])
            rows.append((len(rows), [float(np.float32(x)) for x in v], c % 2))
    hot = [1.0, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.5]
    rows += [(200 + i, hot, 0) for i in range(40)] + [(300, [2 * x for x in hot], 0), (301, hot, 1), (302, hot, None)]
    rows += [(303, None, 0), (304, [], 0), (305, [0.0] * 8, 0), (306, [float("nan")] * 8, 0), (307, [1.0, None] + [0.0] * 6, 0), (308, [float("inf")] + [0.0] * 7, 0), (309, [1.0, 2.0], 0), (310, [1.0, 2.0], 0), (310, [1.0, 2.0], 0), (None, hot, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    n, component = brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows])
    got = near_vectors(df, cell_rows=cell_rows).collect()
    assert all(r["kept"] == (None if r["vec_id"] is None else r["vec_id"] == r["component_id"]) for r in got)
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in got) == sorted((str(r[0]), k, str(c)) for r, k, c in zip(rows, n, component, strict=True))


def test_empty(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("cell_rows", [1024, 32])
def test_linked_clusters_of_registered_size_go_through_pivots(spark, cell_rows, monkeypatch):
    """Labels of a few hundred vectors, as the registered table has them, with thousands of links."""
    from topicloom.llm import embeddings

    draw = np.random.default_rng(7)
    rows = []
    for label, n in ((0, 300), (1, 220), (2, 2), (3, 1)):
        centres = draw.normal(size=(12, 16))
        for _ in range(n):
            v = centres[min(draw.geometric(0.3) - 1, 11)] + 0.2 * draw.normal(size=16)
            rows.append((len(rows), [float(np.float32(x)) for x in v], label))
    seen = []
    cells = embeddings.pivot_cells
    monkeypatch.setattr(embeddings, "pivot_cells", lambda *a, **k: seen.append(cells(*a, **k)) or seen[-1])
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), cell_rows=cell_rows).collect()
    parts = {}
    for r in seen[0].select("cell").distinct().collect():
        parts.setdefault(r["cell"].split("|")[0], set()).add(r["cell"])
    assert {k: len(v) >= 2 for k, v in parts.items()} == {"0": True, "1": True, "2": True, "3": False}
    n, component = brute(rows)
    assert sum(n) > 2000
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(i, k, c) for i, (k, c) in enumerate(zip(n, component, strict=True))]


def test_a_vector_goes_once_to_each_of_few_parts(spark, monkeypatch):
    """A label without structure: rows of blocks are as many as rows of cells, where a part holds them; many parts give the same."""
    from topicloom.llm import embeddings

    draw = np.random.default_rng(11)
    rows = [(k, [float(np.float32(x)) for x in draw.normal(size=4)], 0) for k in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    seen, cells = [], embeddings.pivot_cells
    monkeypatch.setattr(embeddings, "pivot_cells", lambda *a, **k: seen.append(cells(*a, **k)) or seen[-1])
    n, component = brute(rows)
    assert sum(n) > 400
    for part_rows in (1000, 30):
        got = embeddings.near_vectors(df, cell_rows=400, part_rows=part_rows).collect()
        assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(i, k, c) for i, (k, c) in enumerate(zip(n, component, strict=True))]
    assert all(c.filter("home").count() == 400 and c.count() <= 600 for c in seen)  # only the later cell is visited
