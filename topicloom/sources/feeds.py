"""News feeds and a news API as Python data sources, and the parsing of their replies in Spark.

``fetch`` is a function url -> body or None, set on the reader; it runs in the tasks, one partition per feed. Without a
network a mapping of URLs to bodies serves as well. Parsing, the 25-entry cut and the fallback feeds are DataFrame steps.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from topicloom import dims


class _Url(InputPartition):
    def __init__(self, place: int, url: str):
        super().__init__(place)
        self.place, self.url = place, url


class FeedSource(DataSource):
    """Format ``feeds``: feed_ord, feed, body. Options: ``urls`` (JSON list), ``bodies`` (JSON object url -> body), ``attempts``.

    A URL outside ``bodies`` is fetched over HTTP; a failed fetch has a null body.
    """

    @classmethod
    def name(cls) -> str:
        return "feeds"

    def schema(self) -> str:
        return "feed_ord long, feed string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _FeedReader(self.options)


class _FeedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = json.loads(options.get("urls", "[]"))
        self.bodies = json.loads(options.get("bodies", "null"))
        self.attempts = int(options.get("attempts", "2"))

    def partitions(self) -> list[_Url]:
        return [_Url(i, u) for i, u in enumerate(self.urls)]

    def read(self, partition: _Url) -> Iterator[tuple]:
        yield partition.place, partition.url, self._body(partition.url)

    def _body(self, url: str) -> str | None:
        if self.bodies is not None:
            return self.bodies.get(url)
        from urllib.request import urlopen

        for _ in range(self.attempts):
            try:
                with urlopen(url, timeout=20) as reply:
                    return reply.read().decode("utf-8", "replace")
            except (OSError, ValueError):
                continue
        return None


def scan(spark: SparkSession, urls: list[str], bodies: dict[str, str] | None = None) -> DataFrame:
    spark.dataSource.register(FeedSource)
    reader = spark.read.format("feeds").option("urls", json.dumps(urls))
    return (reader if bodies is None else reader.option("bodies", json.dumps(bodies))).load()


_ITEM = "title string, description string, link string, pubDate string, updated string"
_ENTRY = "title string, summary string, content string, link array<struct<_href: string, _rel: string>>, published string, updated string"


def _instant(c) -> Column:
    """A mail date or an ISO time; null for anything else."""
    plain = F.regexp_replace(F.regexp_replace(c, r"^\w{3},\s*", ""), r"\s(GMT|UTC?|Z)$", " +0000")
    return F.coalesce(F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(c))


def entries(bodies: DataFrame) -> DataFrame:
    """feed_ord, feed, feed_title, ord, title, summary, link, published, updated of RSS and Atom bodies.

    A body that isn't XML has none. An Atom entry without a summary gives its content; its link is the alternate one.
    """
    xml = bodies.filter(F.coalesce(F.col("body"), F.lit("")).rlike(r"(?s)^\s*<"))
    atom = F.col("body").rlike(r"(?s)^\s*(<\?[^>]*\?>\s*|<!--.*?-->\s*)*<feed[\s>]")
    read = lambda df, tag, schema: df.withColumn("x", F.from_xml("body", schema, {"mode": "PERMISSIVE", "rowTag": tag, "ignoreNamespace": "true"}))
    rss = read(xml.filter(~atom), "rss", f"channel struct<title: string, item: array<struct<{_ITEM}>>>")
    one = rss.select("feed_ord", "feed", F.col("x.channel.title").alias("feed_title"), F.posexplode("x.channel.item").alias("ord", "e"))
    one = one.select("feed_ord", "feed", "feed_title", F.col("ord").cast("long"), "e.title", F.col("e.description").alias("summary"), "e.link", _instant(F.col("e.pubDate")).alias("published"), _instant(F.col("e.updated")).alias("updated"))
    feed = read(xml.filter(atom), "feed", f"title string, entry array<struct<{_ENTRY}>>")
    two = feed.select("feed_ord", "feed", F.col("x.title").alias("feed_title"), F.posexplode("x.entry").alias("ord", "e"))
    main = F.filter("e.link", lambda k: F.coalesce(k["_rel"], F.lit("alternate")) == "alternate")
    link = F.coalesce(F.try_element_at(main, F.lit(1)), F.try_element_at("e.link", F.lit(1)))["_href"]
    two = two.select("feed_ord", "feed", "feed_title", F.col("ord").cast("long"), "e.title", F.coalesce("e.summary", "e.content").alias("summary"), link.alias("link"), _instant(F.col("e.published")).alias("published"), _instant(F.col("e.updated")).alias("updated"))
    return one.unionByName(two)


def feed_entries(spark: SparkSession, urls: list[str] | None = None, fallbacks: dict[str, str] | None = None, bodies: dict[str, str] | None = None) -> DataFrame:
    """Entries of all feeds; a feed without any is read from the feed that stands in for it, in the place of the first."""
    urls, fallbacks = urls or dims.FEEDS, dims.FALLBACK_FEEDS if fallbacks is None else fallbacks
    first = entries(scan(spark, urls, bodies))
    pairs = spark.createDataFrame([(urls.index(u), u, f) for u, f in fallbacks.items() if u in urls], "feed_ord long, feed string, other string")
    empty = pairs.join(first.select("feed").distinct(), "feed", "left_anti")
    # Only feeds without entries are read again; their number is at most that of the fallback table.
    wanted = [(r["feed_ord"], r["other"]) for r in empty.collect()]
    if not wanted:
        return first
    place = spark.createDataFrame(wanted, "place long, feed string")
    second = entries(scan(spark, [u for _, u in wanted], bodies)).drop("feed_ord").join(F.broadcast(place), "feed").withColumnRenamed("place", "feed_ord")
    return first.unionByName(second)


def api_rows(spark: SparkSession, body: str) -> DataFrame:
    """Rows of a news API reply, in order; none unless its status is ok."""
    one = spark.createDataFrame([(body,)], "body string")
    article = "struct<title:string,description:string,url:string,source:struct<name:string>,publishedAt:string>"
    parsed = one.select(F.from_json("body", f"status string, articles array<{article}>").alias("r")).filter("r.status = 'ok'")
    return parsed.select(F.posexplode("r.articles").alias("ord", "a")).select(F.col("ord").cast("long"), "a.*")
