from topicloom.plans import book, catalogue


def test_clusters_grow_with_the_table(spark, sf_dir):
    n = book.table(spark, sf_dir, "embeddings").count()
    got = catalogue.QUERIES["kmeans_sizes"](spark, sf_dir).collect()
    assert sum(r["n"] for r in got) == n
    assert 10 < len(got) <= max(5, n // 10)
