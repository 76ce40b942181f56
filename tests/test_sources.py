import json

from pyspark.sql import functions as F

from topicloom import schemas
from topicloom.operators import articles as art
from topicloom.operators import pictures
from topicloom.plans import daily
from topicloom.sources import caches, feeds, images, json_files

RSS = """<rss version="2.0"><channel><title>Feed</title>
<item><title>One</title><description>first thing</description><link>https://a/1</link><pubDate>Wed, 10 Jan 2024 10:00:00 GMT</pubDate></item>
<item><title>Two</title><description/><link>https://a/2</link></item></channel></rss>"""


def test_json_shapes(spark, tmp_path):
    arts = [{"title": "A", "url": "https://x/1"}, {"title": "B", "url": None}]
    (tmp_path / "bare.json").write_text(json.dumps([{"topic": "t", "articles": arts}]))
    (tmp_path / "boxed.json").write_text(json.dumps({"clusters": [{"articles": arts[:1]}, {}]}))
    (tmp_path / "arts.json").write_text(json.dumps(arts))
    bare = json_files.read_clusters(spark, str(tmp_path / "bare.json"))
    assert [(r["cluster_id"], r["ord"], r["title"]) for r in bare.collect()] == [(0, 0, "A"), (0, 1, "B")]
    assert json_files.read_clusters(spark, str(tmp_path / "boxed.json")).count() == 1
    assert json_files.read_articles(spark, str(tmp_path / "arts.json")).count() == 2
    assert json_files.read_articles(spark, str(tmp_path / "none.json")).count() == 0
    assert json_files.first_existing(spark, str(tmp_path / "none.json"), str(tmp_path / "arts.json")).endswith("arts.json")
    out = json_files.nested(bare.select("cluster_id", "ord", "title", "url"))
    assert json_files.export_array(out, str(tmp_path / "out.json"), "cluster_id") == 1
    assert [a["title"] for a in json.loads((tmp_path / "out.json").read_text())[0]["articles"]] == ["A", "B"]


def test_feeds_and_fallback(spark):
    bodies = {"https://one/": RSS, "https://spare/": RSS.replace("Feed", "Spare")}
    got = feeds.feed_entries(spark, ["https://one/", "https://two/"], {"https://two/": "https://spare/"}, bodies)
    rows = art.feed_articles(got, 1).orderBy("feed").collect()
    assert [(r["source"], r["title"], r["published_date"]) for r in rows] == [("Feed", "One", "2024-01-10"), ("Spare", "One", "2024-01-10")]


def test_api(spark):
    body = json.dumps({"status": "ok", "articles": [{"title": "T", "description": None, "url": "u", "source": {"name": "S"}, "publishedAt": "2024-01-10T00:00:00Z"}]})
    row = art.api_articles(feeds.api_rows(spark, body)).first()
    assert (row["source"], row["published_date"], row["description"]) == ("S", "2024-01-10", None)
    assert feeds.api_rows(spark, '{"status": "error"}').count() == 0


def test_collected(spark):
    body = json.dumps({"status": "ok", "articles": [{"title": "T", "url": "u", "source": {"name": "S"}, "publishedAt": "2024-01-10T00:00:00Z"}]})
    german = RSS.replace("first thing", "der Mann und die Frau ist nicht mit den Kindern von dem Haus")
    entries = feeds.feed_entries(spark, ["https://one/", "https://two/"], {}, {"https://one/": german, "https://two/": RSS})
    got = daily.collected(feeds.api_rows(spark, body), entries).orderBy("ord").collect()
    assert [(r["ord"], r["title"], r["source"]) for r in got] == [(0, "T", "S"), (1, "Two", "Feed"), (2, "One", "Feed"), (3, "Two", "Feed")]


def test_image_replies(spark):
    wiki = json.dumps({"query": {"pages": {"1": {"title": "File:Red castle.jpg", "imageinfo": [{"thumburl": "https://w/1.jpg", "extmetadata": {"ImageDescription": {"value": "<b>old</b> red castle hill"}, "LicenseShortName": {"value": "CC BY"}}}]}, "2": {"title": "File:Scan.pdf", "imageinfo": [{"thumburl": "https://w/2.pdf", "extmetadata": {"LicenseUrl": {"value": "x"}}}]}}}})
    rows = images.encyclopedia(spark.createDataFrame([(1, "red castle hill", wiki)], "query_id long, query string, body string"))
    assert [(r["title"], r["score"]) for r in pictures.best_found(rows).collect()] == [("File:Red castle.jpg", 3)]
    shots = json.dumps({"results": [{"urls": {"raw": "https://p/r"}, "alt_description": "a  hill", "user": {"name": "Ann"}, "links": {"html": "h"}}, {"urls": {}}]})
    got = images.photos(spark.createDataFrame([(1, "q", 0, shots)], "topic_id long, query string, ord int, body string")).collect()
    assert [(r["url"], r["alt"], r["description"], r["credit"]) for r in got] == [("https://p/r&w=900&fit=max&q=80", "a hill", "a hill", "Photo: Ann / Unsplash")]


def test_cache_round(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = spark.createDataFrame([("k1", "a"), ("k1", "a"), ("k2", "b")], "key string, t string")
    asked = []

    def provide(df):
        asked.append(sorted(r["key"] for r in df.collect()))
        return df.select("key", F.upper("t").alias("label"), F.lit("x").alias("why"))

    first = caches.filled(rows, path, schemas.EVENT_CACHE, "key", provide)
    assert sorted((r["key"], r["label"]) for r in first.collect()) == [("k1", "A"), ("k1", "A"), ("k2", "B")]
    caches.filled(rows, path, schemas.EVENT_CACHE, "key", provide)
    assert asked == [["k1", "k2"], []]


def test_dated_partitions(spark, tmp_path):
    path = str(tmp_path / "dated")
    for day, n in (("2024-01-01", 2), ("2024-01-02", 3), ("2024-01-01", 1)):
        json_files.write_dated(spark.range(n), path, day)
    from topicloom.operators.serving import latest

    table = spark.read.parquet(path)
    assert latest(table).count() == 3 and table.count() == 4


def test_daily_run(spark, sf_dir, tmp_path):
    from topicloom.plans.book import articles

    raw = articles(spark, sf_dir).select("ord", "title", "description", F.coalesce("url", F.concat(F.lit("https://site.example/"), "ord")).alias("url"), "source", "published_at", "published_date", "bias")
    opts = daily.Options("2024-01-02", top=5, merge_at=0.9, cache=str(tmp_path / "cache"))
    tables = daily.run(spark, raw, opts)
    assert tables["articles"].count() > 50
    found = tables["summaries"].collect()
    assert len(found) <= 5 and all(sum(r["bias_distribution"].values()) == 100 for r in found)
    assert tables["topics"].select("cluster_id").distinct().count() <= 5
    events = spark.read.parquet(str(tmp_path / "cache" / "events")).count()
    again = daily.run(spark, raw, opts)
    assert again["summaries"].count() == len(found)
    assert spark.read.parquet(str(tmp_path / "cache" / "events")).count() == events > 0
    assert tables["trust"].count() == tables["topics"].select("cluster_id").distinct().count()


def test_streaming_keeps_first(spark, tmp_path):
    from topicloom.streaming.articles import deduplicated

    src = tmp_path / "in"
    spark.createDataFrame([("https://a/1", "2024-01-10T00:00:00Z"), ("https://a/1?utm_source=x", "2024-01-10T01:00:00Z"), ("https://a/2", "2024-01-10T02:00:00Z")], "url string, published_at string").write.parquet(str(src))
    stream = spark.readStream.schema("url string, published_at string").parquet(str(src))
    q = deduplicated(stream).writeStream.format("memory").queryName("kept").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("kept").count() == 2


def test_exports_replace_files_in_one_step(spark, tmp_path):
    path = tmp_path / "out.json"
    for k in (1, 2):
        json_files.export_array(spark.range(k), str(path))
        assert len(json.loads(path.read_text())) == k and not (tmp_path / "out.json.part").exists()


def test_unreadable_cache_is_an_error(spark, tmp_path):
    import pytest

    assert caches.read(spark, str(tmp_path / "none"), schemas.EVENT_CACHE).count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception, match="(?i)parquet"):
        caches.read(spark, str(tmp_path / "bad"), schemas.EVENT_CACHE).count()


def test_daily_entry_point(spark, tmp_path, capsys):
    """A whole run from a feed: the files that people read, the console report, the caches."""
    import os

    import pytest

    items = "".join(f"<item><title>Harbour strike talks open</title><description>Dock workers met the port board again</description><link>https://h{i}.example/{i}</link><pubDate>Wed, 10 Jan 2024 1{i}:00:00 GMT</pubDate></item>" for i in range(8))
    feed = tmp_path / "feed.xml"
    feed.write_text(f"<rss version='2.0'><channel><title>Feed</title>{items}</channel></rss>")
    out = tmp_path / "out"
    args = ["--date", "2024-01-10", "--feeds", f"file://{feed}", "--output", str(out), "--cache", str(tmp_path / "cache"), "--print-report"]
    daily.main(args)
    told = capsys.readouterr().out
    assert "[1] size=8" in told and "Harbour strike talks" in told
    topics = json.loads((out / "final_clusters.json").read_text())
    assert len(topics) == 1 and len(topics[0]["articles"]) == 8 and topics[0]["source_diversity"]["unique_domains"] == 8
    summary = json.loads((out / "summaries.json").read_text())
    assert summary[0]["num_sources"] == 8 and summary[0]["topic_title"].startswith("Harbour strike talks")
    assert json.loads((out / "trust_log.json").read_text())["date"] == "2024-01-10"
    assert json.loads((out / "cohesion_report.json").read_text())["clusters_reported"] >= 1
    assert {"embeddings", "events", "summaries"} <= set(os.listdir(tmp_path / "cache"))
    assert spark.read.parquet(str(tmp_path / "cache" / "summaries")).count() == 1
    with pytest.raises(SystemExit):
        daily.main(["--date", "10.1.2024", "--input", "x", "--output", "y"])


def test_written_tables_are_dropped_and_swept(spark, tmp_path, monkeypatch):
    """By a bare path as by a full one; a sweep keeps the table that is still read."""
    from topicloom.sources import tables

    for root in (str(tmp_path / "bare"), f"file://{tmp_path}/full", f"file:{tmp_path}/short"):
        monkeypatch.setattr(tables, "shared_folder", lambda _, root=root: root)
        began = tables.mark()
        one, two, three = (tables.written(spark.range(k), f"t{k}") for k in (1, 2, 3))
        folder = next((tmp_path / root.rsplit("/", 1)[1]).glob("topicloom/*"))
        tables.drop_table(one)
        assert sorted(p.name.split("-")[0] for p in folder.iterdir()) == ["t2", "t3"]
        tables.sweep(began, three)
        assert [p.name.split("-")[0] for p in folder.iterdir()] == ["t3"] and three.count() == 3


def test_folder_where_none_is_set():
    """One local folder for an application without a shared one; none on a cluster."""
    import pytest

    from topicloom.sources import tables

    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077", "applicationId": "app-test"})

    with pytest.raises(ValueError, match="checkpoint"):
        tables.shared_folder(Session())
    Session.sparkContext.master = "local[2]"
    assert tables.shared_folder(Session()) == tables.shared_folder(Session()) == tables._LOCAL["app-test"]
