"""Signatures of clusters with very many links, without listing a whole cluster."""

import pytest
from pyspark.sql import functions as F

from topicloom.operators import clusters


def table(spark, rows):
    return spark.createDataFrame([(c, i, u) for i, (c, u) in enumerate(rows)], "cluster_id long, ord long, url string").repartition(4)


@pytest.mark.parametrize("most", [1, 25, 400, 8000])
def test_signature_is_the_sorted_join(spark, most):
    links = [(1, f"https://a.example/{k * 37 % 101:03d}") for k in range(300)] + [(2, "https://b.example/x")] * 50 + [(2, "https://a.example/y"), (3, None), (3, ""), (4, "https://c.example/1")]
    got = {r["cluster_id"]: r["signature"] for r in clusters.url_signature(table(spark, links), most).collect()}
    want = {}
    for c, u in links:
        want.setdefault(c, [])
        if u:
            want[c].append(u.removeprefix("https://"))
    assert got == {c: "|".join(sorted(us))[:most] for c, us in want.items()}


def test_what_meets_of_a_hot_cluster_is_bounded(spark):
    rows = spark.range(50_000).select(F.lit(1).cast("long").alias("cluster_id"), F.concat(F.lit("https://hot.example/"), F.lpad("id", 6, "0")).alias("link"))
    first = clusters.first_links(rows, 800)
    assert [r["link"][-6:] for r in first.orderBy("link").collect()] == [f"{k:06d}" for k in range(30)]
    plan = first._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 2 and "collect_list" not in plan


def test_collapse_keeps_the_best_of_each_set(spark):
    rows = [(1, "https://a.example/x"), (1, "https://b.example/y"), (2, "https://b.example/y"), (2, "https://a.example/x"), (2, "https://a.example/x"), (3, None), (4, ""), (4, None), (5, "https://a.example/x")]
    got = {r["cluster_id"]: (r["size"], r["place"]) for r in clusters.signature_collapse(table(spark, rows)).collect()}
    assert got == {2: (3, 0), 4: (2, 5), 5: (1, 8)}
