"""Importance resampling against a plain loop; the selection against sorting."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.llm import common
from topicloom.llm.resampling import bucket_counts, crc32_runs, kth, ranked, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, runs):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    return words, [" ".join(words[i : i + k]) for k in range(1, runs + 1) for i in range(len(words) - k + 1)]


def plain(docs, target, runs=1, buckets=10_000, percent=10, least=20):
    """(doc_id, n_features, weight, score, rank) of each row."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t, runs)[1])
    t = Counter(bucket(f) for text in target for f in features(text, runs)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (big_s + buckets) / ((s[b] + 1.0) * (big_t + buckets))))
    rows = []
    for i, text in docs:
        words, found = features(text, runs)
        weight = sum(gain(bucket(f)) for f in found)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able[: len(able) * percent // 100])}
    return sorted([(*r[:4], rank.get(id(r))) for r in rows], key=str)


def found(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_crc32_of_every_length():
    rng = np.random.default_rng(1)
    raw = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in [*range(0, 130), 5000, 1]]
    body = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(r) for r in raw])
    assert crc32_runs(body, ends - [len(r) for r in raw], ends).tolist() == [zlib.crc32(r) for r in raw]
    assert len(crc32_runs(body[:0], np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0


@pytest.mark.parametrize(("runs", "percent", "least"), [(1, 10, 20), (3, 50, 2), (2, 100, 1), (1, 0, 1)])
def test_equals_the_loop(spark, texts, runs, percent, least):
    target = spark.createDataFrame([("one two three",), (None,), ("A text of some words, and É",)], "text string")
    docs = [(r["doc_id"], r["text"]) for r in texts.collect()]
    got = found(resample(texts, target, runs=runs, percent=percent, least=least))
    assert got == plain(docs, [r[0] for r in target.collect()], runs, percent=percent, least=least)


def test_registered_tables(spark, sf_dir):
    docs, target = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")
    got = found(resample(docs, target))
    assert got == plain([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], [r["text"] for r in target.select("text").collect()])
    assert sum(r[4] is not None for r in got) > 10


def test_empty_tables(spark, texts, nothing):
    target = spark.createDataFrame([], "text string")
    assert found(resample(nothing, target)) == []
    docs = [(r["doc_id"], r["text"]) for r in texts.collect()]
    assert found(resample(texts, target, least=1, percent=30)) == plain(docs, [], least=1, percent=30)


def test_repeated_ids_and_ties_are_drawn_exactly_once(spark):
    words = " ".join(f"w{k}" for k in range(25))
    rows = [(7, words)] * 40 + [(None, words)] * 5 + [(1, "short")]
    got = found(resample(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame([("w1 w2",)], "text string"), percent=20))
    drawn = [r for r in got if r[4] is not None]
    assert len(got) == 46 and sorted(r[4] for r in drawn) == list(range(1, 10)) and all(r[1] == 25 for r in drawn)


@pytest.mark.parametrize("k", [1, 2, 17, 500, 999, 1000])
def test_radix_selection_equals_sorting(spark, k):
    rng = np.random.default_rng(k)
    wide = [-(2**63), 2**63 - 1, 0, -1]
    rows = [(int(a), int(b), i) for i, (a, b) in enumerate(zip([*rng.integers(-50, 50, 600), *rng.integers(-(2**63), 2**63 - 1, 396), *wide], rng.integers(-3, 3, 1000), strict=True))]
    df = spark.createDataFrame(rows, "score long, id long, place long").repartition(7)
    order = sorted(rows, key=lambda r: (-r[0], r[1], r[2]))
    limit = kth(df, [("score", True), ("id", False), ("place", False)], k)
    at = lambda r: (-r[0], r[1], r[2])[: len(limit)]
    edge = (-limit[0], *limit[1:])
    assert sum(at(r) <= edge for r in rows) == k and at(order[k - 1]) <= edge


def test_ranks_over_many_partitions(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"))
    got = {r["v"]: r["rank"] for r in ranked(df, [F.desc("v")]).collect()}
    assert got == {v: 5000 - v for v in range(5000)}


def test_counts_cover_all_texts(spark, texts):
    want = Counter(zlib.crc32(f.encode()) % 97 for r in texts.collect() for f in features(r["text"], 2)[1])
    assert {r["bucket"]: r["n"] for r in bucket_counts(texts, runs=2, buckets=97).collect()} == dict(want)
