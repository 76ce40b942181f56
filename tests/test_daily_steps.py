"""Steps of the daily run: incoherent clusters go, topics are merged in two passes, repeated summaries once."""

import math

from topicloom.plans import daily

OPTS = daily.Options("2024-01-01")


def article(cluster, ord_, angle, title="Harbour strike talks", **more):
    link = f"https://s{ord_}.example/{ord_}"
    row = {"cluster_id": cluster, "ord": ord_, "title": title, "description": "words", "url": link, "url_normalized": link, "source": f"s{ord_}", "bias": "Center", "published_date": "2024-01-01", "matter_score": 1.0, "embedding": [math.cos(angle), math.sin(angle)]}
    return row | more


def test_incoherent_clusters_go(spark):
    rows = [article(1, i, 0.01 * i) for i in range(3)]  # too few
    rows += [article(2, 10 + i, 0.01 * i) for i in range(6)]
    rows += [article(3, 20 + i, a) for i, a in enumerate([0, 0, 0, 0, 2.2])]  # small, with a wide tail
    rows += [article(4, 30 + i, 0.01 * i, title="Talks" if i == 0 else "") for i in range(6)]  # one title
    rows += [article(5, 40 + i, 0 if i < 15 else 2.2) for i in range(16)]  # trimmed
    got = {}
    for r in daily.coherent(spark.createDataFrame(rows)).collect():
        got.setdefault(r["cluster_id"], set()).add(r["ord"])
    assert got == {2: set(range(10, 16)), 5: set(range(40, 55))}


def test_second_pass_merges_what_the_first_made_alike(spark):
    link = lambda n: {"url": f"https://x.example/{n}", "url_normalized": f"https://x.example/{n}"}
    sets = [range(0, 6), range(6, 12), range(0, 12)]
    rows = [article(c, 100 * c + n, 0.0, title=f"t{c} w{n} {chr(97 + c) * 5}", **link(n)) for c, s in enumerate(sets) for n in s]
    df = spark.createDataFrame(rows)
    calls = []
    real = daily.folds.merge_duplicates
    daily.folds.merge_duplicates = lambda *a: (calls.append(1), real(*a))[1]
    try:
        got = daily.deduplicated(df, OPTS).collect()
    finally:
        daily.folds.merge_duplicates = real
    assert len(calls) == 2 and {r["url"] for r in got} == {f"https://x.example/{n}" for n in range(12)}


def test_repeated_summaries_are_one(spark):
    rows = [article(c, 10 * c + i, 0.01 * i, url=f"https://x.example/{i}") for c in (0, 1) for i in range(6)]
    got = daily.summaries(spark.createDataFrame(rows), OPTS).collect()
    assert len(got) == 1 and got[0]["num_sources"] == 6 and len(got[0]["sources"]) == 6
