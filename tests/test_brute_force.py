"""Registered queries that SQL can't express, as registered, on a whole small table against plain loops."""

import difflib
import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from topicloom import dims
from topicloom.functions import url
from topicloom.plans import book, catalogue


@pytest.fixture(scope="module")
def groups(spark, sf_dir):
    from pyspark.sql import functions as F

    rows = book.grouped(spark, sf_dir).withColumn("domain", url.domain(F.col("url"))).collect()
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["ord"]):
        out[r["cluster_id"]].append(r)
    return dict(sorted(out.items()))


@pytest.fixture(scope="module")
def units(spark, sf_dir):
    out = defaultdict(list)
    for r in sorted(book.table(spark, sf_dir, "embeddings").collect(), key=lambda r: r["vec_id"]):
        v = np.array(r["embedding"], float)
        out[r["label"]].append((r["vec_id"], v / max(np.linalg.norm(v), 1e-12)))
    return out


def test_fuzzy_topic_merge(spark, sf_dir, groups):
    titles = {c: " ".join(sorted((rows[0]["title"] or "").lower().split())) for c, rows in groups.items()}
    owner = {}
    for i in titles:
        if i not in owner:
            owner[i] = i
            for j in titles:
                if j > i and j not in owner and 100 * difflib.SequenceMatcher(None, titles[i], titles[j]).ratio() >= 55.0:
                    owner[j] = i
    got = {r["node"]: r["topic"] for r in catalogue.QUERIES["fuzzy_topic_merge"](spark, sf_dir).collect()}
    assert got == owner


def test_seq_ratio_dupes(spark, sf_dir, groups):
    stop = set(dims.TITLE_STOP)
    words = lambda t: {w for w in re.sub(r"[^a-z0-9\s]+", " ", (t or "").lower()).split() if len(w) > 2 and w not in stop}
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    kept = []
    for c, rows in groups.items():
        title, body, sources = rows[0]["title"] or "", rows[0]["description"] or "", {r["source"] for r in rows if r["source"]}
        for other in kept:
            if not sources or not other[3] or len(sources & other[3]) / min(len(sources), len(other[3])) < 0.5:
                continue
            a, b = words(other[1]), words(title)
            if (a and b and len(a & b) / len(a | b) >= 0.70) or ratio(other[1].lower(), title.lower()) >= 0.86 or ratio(other[2][:600].lower(), body[:600].lower()) >= 0.88:
                other[3] |= sources
                other[4] = len(other[3])
                break
        else:
            kept.append([c, title, body, set(sources), len(rows)])
    want = [(c, title, len(sources), n) for c, title, _, sources, n in kept[:10]]
    assert sorted((r["ord"], r["topic_title"] or "", r["n_sources"], r["num_sources"]) for r in catalogue.QUERIES["seq_ratio_dupes"](spark, sf_dir).collect()) == sorted(want)


def test_duplicate_topic_merge(spark, sf_dir, groups):
    """Pairs of shared sections, walked in order; the larger topic wins, then the more even one, then the first."""
    section = lambda u: re.sub(r"/[^/]*$", "", re.sub(r"/+$", "", re.sub(r"^www\.", "", re.sub(r"^[a-z]+://([^?#]*).*$", r"\1", u)))).lower()
    key = lambda r: re.sub(r"/+$", "", (r["url"] or "").split("?")[0]) or ((r["title"] or "") + (r["source"] or "")).lower()
    sets = {c: {section(r["url"]) for r in rows if r["url"]} - {""} for c, rows in groups.items()}
    held = {c: list(rows) for c, rows in groups.items()}

    def spread(rows):
        n = Counter(r["domain"] for r in rows if r["domain"])
        return -sum(v / sum(n.values()) * math.log2(v / sum(n.values())) for v in n.values())

    gone = set()
    for i in groups:
        if i in gone:
            continue
        for j in groups:
            if j <= i or j in gone or not (sets[i] or sets[j]) or len(sets[i] & sets[j]) / len(sets[i] | sets[j]) < 0.2:
                continue
            a, b = held[i], held[j]
            if len(a) != len(b):
                wins = len(a) > len(b)
            else:
                wins = spread(a) > spread(b) if abs(spread(a) - spread(b)) > 1e-6 else True
            w, lost = (i, j) if wins else (j, i)
            union = {}
            for r in [*held[w], *held[lost]]:
                if key(r):
                    union[key(r)] = r
            held[w] = list(union.values())
            gone.add(lost)
    want = sorted((c, r["ord"]) for c in groups if c not in gone for r in held[c])
    assert sorted((r["topic"], r["ord"]) for r in catalogue.QUERIES["duplicate_topic_merge"](spark, sf_dir).collect()) == want


def lumps(x):
    """Two-means by cosine with plain loops: from the row farthest from the first one, and the row farthest from that."""
    cos = lambda a, b: sum(p * q for p, q in zip(a, b, strict=True))

    def middle(rows):
        c = [sum(col) / len(rows) for col in zip(*rows, strict=True)]
        n = math.sqrt(cos(c, c))
        return [v / max(n, 1e-12) for v in c]

    def spread(rows):
        s = sorted(cos(r, middle(rows)) for r in rows)
        at = 0.1 * (len(s) - 1)
        low = s[int(at)] + (at - int(at)) * (s[min(int(at) + 1, len(s) - 1)] - s[int(at)])
        m = sum(s) / len(s)
        return low, math.sqrt(sum((v - m) ** 2 for v in s) / len(s))

    a = min(range(len(x)), key=lambda i: cos(x[i], x[0]))
    seeds = [x[a], x[min(range(len(x)), key=lambda i: cos(x[i], x[a]))]]
    for _ in range(5):
        halves = [[], []]
        for r in x:
            halves[cos(r, seeds[1]) > cos(r, seeds[0])].append(r)
        if not halves[0] or not halves[1]:
            return False
        seeds = [middle(h) for h in halves]
    if min(map(len, halves)) < 4:
        return False
    p, s = spread(x)
    after = [spread(h) for h in halves]
    mean = lambda k: sum(len(h) * v[k] for h, v in zip(halves, after, strict=True)) / len(x)
    return mean(0) - p >= 0.10 and s - mean(1) >= 0.03


def test_two_means_split(spark, sf_dir, units):
    got = {r["cluster_id"]: r["lumps"] for r in catalogue.QUERIES["two_means_split"](spark, sf_dir).collect()}
    assert got == {c: len(rows) >= 12 and lumps([v.tolist() for _, v in rows[:18]]) for c, rows in units.items()}
    from topicloom.operators.vectors import _two_lumps

    draw, seen = np.random.default_rng(1), set()
    for _ in range(60):
        x = draw.normal(size=(16, 4)) * draw.choice([0.05, 0.2, 0.5]) + np.where(np.arange(16)[:, None] < draw.integers(2, 15), [1.0, 0, 0, 0], [0, draw.choice([0.3, 1.0]), 0, 0])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        seen.add(lumps(x.tolist()))
        assert _two_lumps(x) == lumps(x.tolist())
    assert seen == {True, False}


def test_kmeans_sizes(spark, sf_dir, units):
    n = sum(map(len, units.values()))
    got = [r["n"] for r in catalogue.QUERIES["kmeans_sizes"](spark, sf_dir).collect()]
    assert sum(got) == n and 5 <= len(got) <= max(5, n // 10)


def test_dominant_merges_joins_all_others(spark, sf_dir, units):
    """With every gate open each cluster beside the three leaders joins the leader it is most like."""
    got = {r["cluster_id"]: r["into"] for r in catalogue.QUERIES["dominant_merges"](spark, sf_dir).collect()}
    centre = {c: np.mean([v for _, v in rows], axis=0) for c, rows in units.items()}
    centre = {c: v / np.linalg.norm(v) for c, v in centre.items()}
    leaders = set(centre) - set(got)
    assert len(leaders) == 3
    assert got == {c: max(leaders, key=lambda x: round(float(centre[x] @ v), 9)) for c, v in centre.items() if c not in leaders}


def test_offline_embeddings(spark, sf_dir):
    got = {r["ord"]: r["length"] for r in catalogue.QUERIES["offline_embeddings"](spark, sf_dir).collect()}
    for r in book.articles(spark, sf_dir).select("ord", "title").collect():
        count = Counter()
        for word in re.findall(r"\w+", (r["title"] or "").lower()):
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            count[(h >> 1) % 64] += 1 if h & 1 else -1
        assert got[r["ord"]] == pytest.approx(1.0 if any(count.values()) else 0.0, abs=1e-3)
