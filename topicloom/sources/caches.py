"""Content-addressed caches as tables: probe by a left join, misses by an anti join, new rows by an append.

Entries lie in folders by the first digits of their key's hash (``bucket``), so a probe reads the buckets of its keys only; few
keys are looked up by Parquet's Bloom filters, too, which each file has for its keys. Appends add a file a bucket; ``compact``
writes the buckets of many files anew, with the last entry of each key. An entry that stands twice is the same entry: a
compaction that is broken off between writing and removing changes no result.
"""

from __future__ import annotations

import time
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import remove

#: Hash digits of a bucket; keys up to which a probe names them; files of a bucket that a compaction leaves alone.
DIGITS, NAMED, FILES = 2, 1_000, 8


def bucket_of(key: str) -> Column:
    return F.substring(F.md5(F.coalesce(F.col(key), F.lit("")).cast("binary")), 1, DIGITS)


def read(spark: SparkSession, path: str, schema: T.StructType, keys: DataFrame | None = None, key: str = "key") -> DataFrame:
    """The cache at ``path``, or what may hold the ``keys`` of a table; empty where there is none.

    A cache that can't be read is an error: nothing is embedded anew for it.
    """
    from pyspark.errors import AnalysisException

    try:
        found = spark.read.schema(T.StructType([*schema.fields, T.StructField("bucket", T.StringType())])).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    if keys is not None:
        wanted = [r[0] for r in keys.select(bucket_of(key)).distinct().collect()]  # 16 ** DIGITS rows at most
        if len(wanted) < 16**DIGITS:
            found = found.filter(F.col("bucket").isin(wanted))
        few = [r[0] for r in keys.filter(F.col(key).isNotNull()).select(key).distinct().limit(NAMED + 1).collect()]
        if len(few) <= NAMED:
            found = found.filter(F.col(key).isin(few))
    return found.select(*schema.names)


def probe(rows: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """``rows`` with the cached columns, null where there is none. The last entry of a key wins."""
    return rows.join(_last(cache, key), key, "left")


def misses(rows: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't cached."""
    return rows.join(cache.select(key).distinct(), key, "left_anti")


def _last(entries: DataFrame, key: str) -> DataFrame:
    """The last entry of each key."""
    if "ts" not in entries.columns:
        return entries.dropDuplicates([key])
    return entries.groupBy(key).agg(F.max_by(F.struct(*[c for c in entries.columns if c != key]), "ts").alias("_v")).select(key, "_v.*").select(*entries.columns)


def _write(entries: DataFrame, path: str, key: str) -> None:
    """One file a bucket; each write is committed as a whole."""
    rows = entries.withColumn("bucket", bucket_of(key)).repartition("bucket")
    rows.write.mode("append").partitionBy("bucket").option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(path)


def append(found: DataFrame, path: str, key: str = "key") -> None:
    """Adds entries."""
    _write(found if "ts" in found.columns else found.withColumn("ts", F.lit(int(time.time())).cast("long")), path, key)


def compact(spark: SparkSession, path: str, schema: T.StructType, key: str = "key", most: int = FILES) -> int:
    """Writes each bucket of more than ``most`` files as one, with the last entry of each key; how many buckets it were.

    Only one process may compact a cache at a time; others may probe and append meanwhile.
    """
    files = defaultdict(list)
    for file in read(spark, path, schema).inputFiles():
        if "/bucket=" in file:
            files[file.rsplit("/bucket=", 1)[1].split("/")[0]].append(file)
    full = {bucket: names for bucket, names in files.items() if len(names) > most}
    if full:
        old = [name for names in full.values() for name in names]
        _write(_last(spark.read.schema(schema).parquet(*old), key), path, key)
        for name in old:
            remove(spark, name)
    return len(full)


def filled(rows: DataFrame, path: str, schema: T.StructType, key: str, provide) -> DataFrame:
    """``rows`` with cached columns; what is missing is provided once for each key, appended and joined.

    ``provide(df)`` takes the distinct missing rows and returns the cache's columns. A null value is not cached.
    """
    spark = rows.sparkSession
    cache = read(spark, path, schema, rows, key)
    value = next(f.name for f in schema if f.name not in (key, "ts", "model"))
    fresh = provide(misses(rows, cache, key).dropDuplicates([key])).filter(F.col(value).isNotNull())
    append(fresh, path, key)
    return probe(rows, read(spark, path, schema, rows, key), key)
