"""Caches in buckets: what a probe reads, what a compaction keeps."""

from pathlib import Path

from pyspark.sql import functions as F

from topicloom import schemas
from topicloom.sources import caches


def entries(spark, keys, ts, label="a"):
    return spark.createDataFrame([(k, f"{label}{k}", "why", ts) for k in keys], "key string, headline string, summary string, ts long").select("key", "headline", "summary", F.lit(None).cast("array<string>").alias("takeaways"), "ts")


def test_a_probe_reads_its_buckets_only(spark, tmp_path):
    path = str(tmp_path / "cache")
    caches.append(entries(spark, [f"k{i}" for i in range(600)], 1), path)
    keys = spark.createDataFrame([("k3",), ("k7",), ("other",)], "key string")
    found = caches.read(spark, path, schemas.SUMMARY_CACHE, keys)
    buckets = {r[0] for r in keys.select(caches.bucket_of("key")).collect()}
    assert {f.split("bucket=")[1].split("/")[0] for f in found.filter(F.col("key").isNotNull()).select(F.input_file_name().alias("f")).distinct().rdd.map(lambda r: r.f).collect()} <= buckets
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "In(key" in plan
    assert sorted(r["key"] for r in found.collect()) == ["k3", "k7"]
    assert caches.misses(keys, found, "key").collect()[0]["key"] == "other"


def test_many_keys_name_no_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(caches, "NAMED", 2)
    path = str(tmp_path / "cache")
    caches.append(entries(spark, [f"k{i}" for i in range(50)], 1), path)
    keys = spark.createDataFrame([(f"k{i}",) for i in range(10)], "key string")
    assert sorted(r["headline"] for r in caches.probe(keys, caches.read(spark, path, schemas.SUMMARY_CACHE, keys), "key").collect()) == sorted(f"ak{i}" for i in range(10))


def test_compaction_bounds_files_and_changes_no_probe(spark, tmp_path):
    path = str(tmp_path / "cache")
    keys = [f"k{i}" for i in range(40)]
    for ts in range(1, 6):
        caches.append(entries(spark, keys[: 8 * ts], ts, label=f"v{ts}-"), path)
    count = lambda: sum(1 for _ in Path(path).glob("bucket=*/*.parquet"))
    probe = lambda: sorted(tuple(r) for r in caches.probe(spark.createDataFrame([(k,) for k in keys], "key string"), caches.read(spark, path, schemas.SUMMARY_CACHE), "key").select("key", "headline", "ts").collect())
    before, seen = count(), probe()
    full = caches.compact(spark, path, schemas.SUMMARY_CACHE, most=2)
    assert 0 < full and count() < before and probe() == seen
    assert all(len(list(d.glob("*.parquet"))) <= 2 for d in Path(path).glob("bucket=*"))
    assert caches.compact(spark, path, schemas.SUMMARY_CACHE, most=2) == 0
    assert caches.compact(spark, str(tmp_path / "none"), schemas.SUMMARY_CACHE) == 0


def test_an_entry_that_stands_twice_is_one(spark, tmp_path):
    """As after a compaction that was broken off before it removed the old files."""
    path = str(tmp_path / "cache")
    for _ in range(2):
        caches.append(entries(spark, ["a", "b"], 7), path)
    rows = spark.createDataFrame([("a",), ("b",), ("b",)], "key string")
    assert sorted(r["headline"] for r in caches.probe(rows, caches.read(spark, path, schemas.SUMMARY_CACHE), "key").collect()) == ["aa", "ab", "ab"]
