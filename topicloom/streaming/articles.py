"""Articles as a stream: an optional form of the daily batch, with event-time windows and bounded state.

``first_of_urls`` keeps the batch's first rows by keyed state with an expiry; ``deduplicated`` is not the same as the batch's
keep-first: its state ends with the watermark, and rows without a timestamp are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from topicloom.functions import text, url
from topicloom.sources.tables import new_folder, written


def deduplicated(articles: DataFrame, delay: str = "1 day") -> DataFrame:
    """The first row of each normalised URL within ``delay`` of event time."""
    at = F.try_to_timestamp("published_at")
    rows = articles.withColumn("published_ts", at).withColumn("url_normalized", url.normalise(F.col("url")))
    return rows.withWatermark("published_ts", delay).dropDuplicatesWithinWatermark(["url_normalized"])


def daily_counts(articles: DataFrame, delay: str = "1 day") -> DataFrame:
    """Articles of each domain and day, final once the day is ``delay`` old."""
    rows = articles.withColumn("published_ts", F.try_to_timestamp("published_at")).filter("published_ts is not null")
    windowed = rows.withWatermark("published_ts", delay).groupBy(F.window("published_ts", "1 day"), url.domain(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))
    return windowed.select(F.col("window.start").alias("day"), "domain", "n")


class FirstOfKey(StatefulProcessor):
    """The first row of a key, by ``ord`` among those of one micro-batch; nothing more until the state has expired."""

    def __init__(self, expiry_ms: int) -> None:
        self.expiry_ms = expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "ord long", ttlDurationMs=self.expiry_ms or None)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.seen.exists():
            return
        best = None
        for part in rows:  # a key's rows come in parts: one row is kept of each
            first = part.loc[[part["ord"].idxmin()]]
            if best is None or first["ord"].iloc[0] < best["ord"].iloc[0]:
                best = first
        self.seen.update((int(best["ord"].iloc[0]),))
        yield best[["ord", "url", "url_normalized"]]


def first_of_urls(articles: DataFrame, expiry_ms: int = 0) -> DataFrame:
    """ord, url, url_normalized of the first article of each normalised URL; those without one are one, as in the batch.

    A stream of articles that come in order of ``ord`` gives the rows of the batch's keep-first. A key is forgotten ``expiry_ms``
    after it was seen (0: never), so state is bounded by the URLs of that time. To be started within ``stateful``.
    """
    keyed = articles.select("ord", "url", text.or_empty(url.normalise(F.col("url"))).alias("url_normalized"))
    mode = "ProcessingTime" if expiry_ms else "None"
    return keyed.groupBy("url_normalized").transformWithStateInPandas(FirstOfKey(expiry_ms), "ord long, url string, url_normalized string", "Append", mode)


def feed_bodies(spark: SparkSession, folder: str, most: int | None = None) -> DataFrame:
    """feed_ord, feed, body as a stream: each file of a folder is one fetched body; ``most`` files a micro-batch.

    ``feeds.entries`` reads it as it reads a batch of bodies.
    """
    reader = spark.readStream.format("text").option("wholetext", True)
    lines = (reader if most is None else reader.option("maxFilesPerTrigger", most)).load(folder)
    return lines.select(F.lit(0).cast("long").alias("feed_ord"), F.col("_metadata.file_name").alias("feed"), F.col("value").alias("body"))


@contextmanager
def stateful(spark: SparkSession, tasks: int | None = None) -> Iterator[None]:
    """Settings of queries with keyed state while they start; the session's own come back.

    Stores are RocksDB, small ones reserve no room, and what a stopped query has left in an executor's folder goes soon.
    """
    names = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.maintenanceInterval": "2s",
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",  # else a query with an expiry never runs out of batches
    } | ({"spark.sql.shuffle.partitions": str(tasks)} if tasks else {})
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def replayed(articles: DataFrame, parts: int = 3) -> DataFrame:
    """``first_of_urls`` of a table that is fed in ``parts`` by ``ord``, each to a new start of one query on one checkpoint."""
    spark, base = articles.sparkSession, new_folder(articles.sparkSession, "replay")
    rows = written(articles.select(F.col("ord").cast("long"), "url"), "articles")
    low, high = rows.agg(F.min("ord"), F.max("ord")).first()
    tasks = max(1, min(spark.sparkContext.defaultParallelism, rows.count() // 10_000 + 1))
    for k in range(parts):
        part = F.lit(0) if low is None else F.least(F.lit(parts - 1), F.floor((F.col("ord") - low) * parts / (high - low + 1)))
        rows.filter(part == k).write.mode("append").parquet(f"{base}/feed")
        with stateful(spark, tasks):
            found = first_of_urls(spark.readStream.schema("ord long, url string").parquet(f"{base}/feed"))
            found.writeStream.format("parquet").option("path", f"{base}/first").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("ord long, url string, url_normalized string").parquet(f"{base}/first")
