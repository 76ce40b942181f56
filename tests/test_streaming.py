"""Keep-first as a stream with keyed state, against the batch; feeds that arrive as files."""

from pyspark.sql import functions as F

from topicloom.functions import text, url
from topicloom.operators import articles as ops
from topicloom.sources import feeds
from topicloom.streaming import articles as streaming


def test_replay_is_the_batch(spark):
    rows = spark.range(90).select(F.col("id").alias("ord"), F.when(F.col("id") % 11 == 0, None).otherwise(F.concat(F.lit("https://www.site.example/"), F.col("id") * 7 % 25, F.lit("?utm_source="), "id")).alias("url")).repartition(4)
    want = {r["ord"] for r in ops.keep_first(rows, text.or_empty(url.normalise(F.col("url")))).collect()}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = [r["ord"] for r in streaming.replayed(rows).collect()]
    assert sorted(got) == sorted(want) and spark.conf.get("spark.sql.shuffle.partitions") == before
    assert streaming.replayed(rows.limit(0)).count() == 0


def test_state_expires(spark, tmp_path):
    """Seen again after its expiry, a URL is first again."""
    import time

    schema = "ord long, url string"
    found = []
    for ord_ in (1, 2):
        spark.createDataFrame([(ord_, "https://a.example/x")], schema).write.mode("append").parquet(str(tmp_path / "in"))
        with streaming.stateful(spark, 1):
            stream = streaming.first_of_urls(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), expiry_ms=2000)
            stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        found.append(spark.read.parquet(str(tmp_path / "out")).count())
        time.sleep(4)
    assert found == [1, 2]


def test_feeds_arrive_as_files(spark, tmp_path):
    folder, out = tmp_path / "bodies", str(tmp_path / "entries")
    folder.mkdir()
    item = lambda k: f"<item><title>T{k}</title><link>https://a.example/{k}</link><pubDate>Wed, 10 Jan 2024 0{k}:00:00 GMT</pubDate></item>"
    bodies = {"one.xml": f"<rss><channel><title>A</title>{item(1)}{item(2)}</channel></rss>", "two.xml": f"<rss><channel><title>B</title>{item(3)}</channel></rss>", "bad.xml": "no feed"}
    for k, name in enumerate(bodies):
        (folder / name).write_text(bodies[name])
        stream = feeds.entries(streaming.feed_bodies(spark, str(folder), most=1))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        assert spark.read.parquet(out).count() == (2, 3, 3)[k]
    got = {(r["feed"], r["title"], r["link"]) for r in spark.read.parquet(out).collect()}
    assert got == {("one.xml", "T1", "https://a.example/1"), ("one.xml", "T2", "https://a.example/2"), ("two.xml", "T3", "https://a.example/3")}
