"""Queries on scans, sinks and caches, over small fixed tables where a file is made and over whole tables elsewhere."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from topicloom import schemas
from topicloom.operators import clusters, serving
from topicloom.operators import vectors as ops
from topicloom.sources import caches, feeds, json_files
from topicloom.sources.tables import new_folder

from .book import TARGET, Book, grouped, table
from .vector_queries import _FIRST, _rows

BOOK = Book()
query = BOOK.add


def _nations(spark, sf_dir):
    """Nations as articles of their regions."""
    return table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("cluster_id"), F.col("n_nationkey").cast("long").alias("ord"), F.col("n_name").alias("title"), F.concat(F.lit("https://x/"), "n_nationkey").alias("url"))


@query("""SELECT dense_rank() OVER (ORDER BY n_regionkey) - 1 AS cluster_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS ord, n_name AS title, 'https://x/' || n_nationkey AS url FROM nation""")
def cluster_file_scan(spark, sf_dir):
    """Lists of articles by cluster, written as a file that the page reads (twice, so that it replaces one), read back in both shapes."""
    path = new_folder(spark, "clusters.json")
    nested = json_files.nested(_nations(spark, sf_dir))
    json_files.export_array(nested.limit(1), path, "cluster_id")
    json_files.export_array(nested, path, "cluster_id")
    boxed = new_folder(spark, "boxed")
    spark.read.text(path, wholetext=True).select(F.concat(F.lit('{"clusters": '), "value", F.lit("}"))).coalesce(1).write.text(boxed)
    bare, again = (json_files.read_clusters(spark, p).select("cluster_id", "ord", "title", "url") for p in (path, boxed))
    return bare.join(again, ["cluster_id", "ord", "title", "url"])


@query("""SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS ord, n_name AS title, 'https://x/' || n_nationkey AS url, NULL::VARCHAR AS description FROM nation""")
def article_file_scan(spark, sf_dir):
    """A file of articles, the second of three places that exists."""
    path = new_folder(spark, "articles.json")
    json_files.export_array(_nations(spark, sf_dir).select("ord", "title", "url"), path, "ord")
    found = json_files.first_existing(spark, new_folder(spark, "none"), path, path + ".part")
    return json_files.read_articles(spark, found).select("ord", "title", "url", "description")


@query("""SELECT n_regionkey::BIGINT AS cluster_id, string_agg(n_name, '|' ORDER BY n_nationkey) AS titles FROM nation GROUP BY 1""")
def article_lists(spark, sf_dir):
    return json_files.nested(_nations(spark, sf_dir)).select("cluster_id", F.array_join(F.transform("articles", lambda a: a["title"]), "|").alias("titles"))


@query("""SELECT n_regionkey::BIGINT AS cluster_id, n_nationkey::BIGINT AS ord, '2024-01-02' AS dt FROM nation WHERE n_nationkey % 2 = 0""")
def dated_sink(spark, sf_dir):
    """Two days' partitions, the second written twice; the newest is what a reader gets."""
    path, rows = new_folder(spark, "dated"), _nations(spark, sf_dir).select("cluster_id", "ord")
    json_files.write_dated(rows, path, "2024-01-01")
    json_files.write_dated(rows, path, "2024-01-02")
    json_files.write_dated(rows.filter("ord % 2 = 0"), path, "2024-01-02")
    return serving.latest(spark.read.parquet(path)).select("cluster_id", "ord", F.col("dt").cast("string").alias("dt"))


def _bodies(spark, sf_dir) -> dict[str, str]:
    """A feed of either kind for each region, with its nations as entries."""
    rows = [tuple(r) for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_nationkey", "n_name", "n_regionkey").collect()]  # 25 rows
    out = {}
    for region in sorted({r for _, _, r in rows}):
        own = [(k, n) for k, n, r in rows if r == region]
        if region % 2:
            items = "".join(f"<entry><title type='html'>{n}</title><summary>s {k}</summary><link rel='alternate' href='https://x/{k}'/><link rel='self' href='https://self'/><published>2024-01-{k % 28 + 1:02d}T10:00:00Z</published></entry>" for k, n in own)
            out[f"https://feed/{region}"] = f"<?xml version='1.0'?><feed xmlns='http://www.w3.org/2005/Atom'><title>Region {region}</title>{items}</feed>"
        else:
            items = "".join(f"<item><title>{n}</title><description>s {k}</description><link>https://x/{k}</link><pubDate>Mon, {k % 28 + 1:02d} Jan 2024 10:00:00 GMT</pubDate></item>" for k, n in own)
            out[f"https://feed/{region}"] = f"<rss version='2.0'><channel><title>Region {region}</title>{items}</channel></rss>"
    return out


@query("""SELECT n_regionkey::BIGINT AS feed_ord, 'Region ' || n_regionkey AS feed_title, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS ord, n_name AS title, 's ' || n_nationkey AS summary, 'https://x/' || n_nationkey AS link,
        '2024-01-' || lpad((n_nationkey % 28 + 1)::VARCHAR, 2, '0') || 'T10:00:00Z' AS published FROM nation""")
def feed_scan(spark, sf_dir):
    """Feeds of both kinds, one of them read from the place that stands in for it."""
    bodies = _bodies(spark, sf_dir)
    urls = sorted(bodies)
    moved = {"https://other": bodies.pop(urls[0])}
    from topicloom.operators.articles import iso_timestamp

    got = feeds.feed_entries(spark, urls, {urls[0]: "https://other"}, bodies | moved)
    return got.select("feed_ord", "feed_title", "ord", "title", "summary", "link", iso_timestamp(F.col("published")).alias("published"))


@query("""SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS ord, n_name AS title, 'Region ' || n_regionkey AS source FROM nation""")
def api_scan(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # 25 rows
    body = json.dumps({"status": "ok", "articles": [{"title": r["n_name"], "source": {"name": f"Region {r['n_regionkey']}"}} for r in rows]})
    return feeds.api_rows(spark, body).select("ord", "title", F.col("source.name").alias("source"))


@query("""SELECT sha256(text) AS key, CASE WHEN min(doc_id) % 2 = 0 THEN 'SINGLE_EVENT' ELSE 'MIXED' END AS label, count(*) AS uses FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def event_cache(spark, sf_dir):
    """Half of the judgements are cached; the others are made once for each key, appended, and found by the second probe."""
    path = new_folder(spark, "events")
    rows = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("key"))
    keys = rows.groupBy("key").agg(F.min("doc_id").alias("first"))
    schema = "key string, label string, why string, ts long"
    judged = keys.select("key", F.when(F.col("first") % 2 == 0, "SINGLE_EVENT").otherwise("MIXED").alias("label"), F.lit("why").alias("why"))
    caches.append(judged.filter("substr(key, 1, 1) < '8'"), path)
    provide = lambda missing: missing.select("key").join(judged, "key")
    from pyspark.sql.types import _parse_datatype_string

    got = caches.filled(rows, path, _parse_datatype_string(schema), "key", provide)
    return got.groupBy("key", "label").agg(F.count("*").alias("uses"))


@query("""SELECT doc_id % 40 AS cluster_id, count(*) AS n, CASE doc_id % 40 % 4 WHEN 0 THEN 'SINGLE_EVENT' ELSE NULL END AS eventness_label, doc_id % 40 % 4 = 0 AS strict FROM documents WHERE doc_id % 40 % 4 NOT IN (1, 2) GROUP BY 1""")
def event_filters(spark, sf_dir):
    """Topics by their judgement, some without one: what either filter keeps."""
    k = F.col("cluster_id") % 4
    label = F.when(k == 0, "SINGLE_EVENT").when(k == 1, "MIXED").when(k == 2, "THEMATIC_BUCKET")
    rows = table(spark, sf_dir, "documents").groupBy((F.col("doc_id") % 40).alias("cluster_id")).agg(F.count("*").alias("n")).withColumn("eventness_label", label)
    strict = clusters.event_filter(rows, True).select("cluster_id", F.lit(True).alias("strict"))
    return clusters.event_filter(rows, False).join(strict, "cluster_id", "left").fillna(False, ["strict"])


@query("""SELECT n_regionkey::BIGINT AS cluster_id, count(*) AS n, array_to_string(list(n_name ORDER BY n_nationkey)[1:3], '|') AS titles FROM nation GROUP BY 1""")
def report_titles(spark, sf_dir):
    return clusters.first_titles(_nations(spark, sf_dir), 3).withColumn("titles", F.array_join("titles", "|"))


@query("""SELECT r_regionkey::BIGINT AS ord, r_name FROM region ORDER BY r_regionkey LIMIT 3""")
def front_page(spark, sf_dir):
    return serving.front(table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("ord"), "r_name"))


@query("""WITH a AS (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS place FROM nation), b AS (SELECT *, row_number() OVER (ORDER BY r_regionkey) - 1 AS place FROM region)
    SELECT place::INTEGER AS place, n_name, r_name FROM a JOIN b USING (place)""")
def zipped_files(spark, sf_dir):
    a = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ord"), "n_name")
    return clusters.zipped(a, table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("ord"), "r_name")).select("place", "n_name", "r_name")


@query("""SELECT coalesce(lang, 'Other') AS topic, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM documents GROUP BY 1""")
def topic_label_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), "lang")
    got = clusters.by_topic_label(rows.select("ord", F.when(F.col("ord") % 2 == 0, F.concat(F.lit(" "), "lang")).otherwise(F.col("lang")).alias("lang")), F.col("lang"))
    return got.select("topic", "n", F.element_at("articles", 1)["ord"].alias("first"), F.element_at("articles", -1)["ord"].alias("last"))


@query("""SELECT '2024-01-01' AS date, count(*) AS clusters, sum(n)::BIGINT AS articles, max(n) AS most FROM (SELECT label, count(*) AS n FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE label IS NOT NULL GROUP BY 1)""")
def trust_documents(spark, sf_dir):
    """The quality log as one JSON object, read again."""
    doc = json_files.trust_document(clusters.trust_log(grouped(spark, sf_dir)), TARGET)
    read = doc.select(F.from_json("json", "date string, clusters array<struct<cluster_id: long, num_articles: long>>").alias("d"))
    sizes = F.transform("d.clusters", lambda c: c["num_articles"])
    return read.select("d.date", F.size("d.clusters").cast("long").alias("clusters"), F.aggregate(sizes, F.lit(0).cast("long"), lambda a, b: a + b).alias("articles"), F.array_max(sizes).alias("most"))


@query(f"""WITH {_FIRST}, n AS (SELECT label AS cluster_id, count(*) AS a FROM embeddings GROUP BY 1),
    s AS (SELECT cluster_id, avg(sim) AS m, quantile_cont(sim, 0.1) AS p, stddev_pop(sim) AS s FROM sims GROUP BY 1),
    r AS (SELECT cluster_id, round(0.75 * p + 0.25 * m - 0.5 * s, 3) AS score FROM n JOIN s USING (cluster_id) WHERE a >= 4)
    SELECT 'm-1' AS model, count(*) AS clusters, min(score) AS worst FROM r""")
def cohesion_documents(spark, sf_dir):
    """The cohesion report as one JSON object, worst cluster first, read again."""
    doc = json_files.cohesion_document(ops.report(_rows(spark, sf_dir)), TARGET, "m-1")
    read = doc.select(F.from_json("json", "model string, clusters_reported long, clusters array<struct<sort_score: double>>").alias("d"))
    return read.select("d.model", F.col("d.clusters_reported").alias("clusters"), F.element_at("d.clusters", 1)["sort_score"].alias("worst"))
