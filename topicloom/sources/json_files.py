"""JSON files of articles and clusters: scans of either shape, whole-array exports that readers never see half-written."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom import schemas


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where))


def first_existing(spark: SparkSession, *paths: str) -> str | None:
    """The first of ``paths`` that exists."""
    return next((p for p in paths if _exists(spark, p)), None)


def read_articles(spark: SparkSession, path: str, schema: T.StructType = schemas.ARTICLE) -> DataFrame:
    """A JSON array (or lines) of articles, with ``ord``, the place in the file. A missing file has no rows."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema).withColumn("ord", F.lit(0).cast("long"))
    lines = spark.read.text(path, wholetext=True)
    listed = lines.select(F.from_json("value", T.ArrayType(schema)).alias("a"))
    return listed.select(F.posexplode("a").alias("ord", "x")).select("x.*", F.col("ord").cast("long"))


def read_clusters(spark: SparkSession, path: str, article: T.StructType = schemas.ARTICLE, extra: str = "") -> DataFrame:
    """Articles of a cluster file, a list of clusters or an object with ``clusters``: cluster_id (place), ord, the article.

    ``extra``: more cluster fields to keep, as a schema string. A file of another shape has no rows.
    """
    cluster = T.StructType([T.StructField("topic", T.StringType()), T.StructField("articles", T.ArrayType(article)), *(T._parse_datatype_string(extra).fields if extra else [])])
    lines = spark.read.text(path, wholetext=True)
    bare = F.from_json("value", T.ArrayType(cluster))
    boxed = F.from_json("value", T.StructType([T.StructField("clusters", T.ArrayType(cluster))]))["clusters"]
    kind = F.substring(F.regexp_replace("value", r"^\s+", ""), 1, 1)
    found = lines.select(F.when(kind == "[", bare).when(kind == "{", boxed).alias("c"))
    each = found.select(F.posexplode("c").alias("cluster_id", "cluster"))
    kept = [F.col(f"cluster.{f.name}").alias(f"cluster_{f.name}") for f in cluster.fields if f.name != "articles"]
    rows = each.select(F.col("cluster_id").cast("long"), *kept, F.posexplode("cluster.articles").alias("ord", "x"))
    return rows.select("cluster_id", *[F.col(f"cluster_{f.name}") for f in cluster.fields if f.name != "articles"], F.col("ord").cast("long"), "x.*")


def nested(articles: DataFrame, *cluster_columns: str) -> DataFrame:
    """One row per cluster with its articles in order: the shape of a cluster file."""
    fields = [c for c in articles.columns if c not in ("cluster_id", "ord", *cluster_columns)]
    return articles.groupBy("cluster_id", *cluster_columns).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(*fields).alias("a")))), lambda p: p["a"]).alias("articles"))


def write_dated(df: DataFrame, path: str, date: str, form: str = "parquet") -> None:
    """Appends the day's partition, replacing it if it is there."""
    df.withColumn("dt", F.lit(date)).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("dt").format(form).save(path)


def export_array(df: DataFrame, path: str, order: str | None = None) -> int:
    """The rows as one JSON array for the page, written beside ``path`` and renamed. For some topics, not for a corpus."""
    rows = [json.loads(r["j"]) for r in (df.orderBy(order) if order else df).select(F.to_json(F.struct(*df.columns)).alias("j")).collect()]
    _published(df.sparkSession, path, json.dumps(rows, ensure_ascii=False, indent=2))
    return len(rows)


def export_object(document: DataFrame, path: str) -> None:
    """The one row of a table with a column ``json`` as a file, in place of the one before."""
    _published(document.sparkSession, path, json.dumps(json.loads(document.first()["json"]), ensure_ascii=False, indent=2))


def _published(spark: SparkSession, path: str, body: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop
    final, part = hadoop.fs.Path(path), hadoop.fs.Path(path + ".part")
    out = final.getFileSystem(spark._jsc.hadoopConfiguration()).create(part, True)
    out.write(bytearray(body.encode()))
    out.close()
    _replace(spark, part, final)


def _replace(spark: SparkSession, part, final) -> None:
    """One file in place of another, in one step where the store can: readers find the old file or the new one."""
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.getFileSystem(spark._jsc.hadoopConfiguration()).getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(part, final, options)


def cohesion_document(report: DataFrame, date: str, model: str, least: int = 4, most: int = 18) -> DataFrame:
    """The cohesion report as one JSON object: its settings, and the clusters, worst first."""
    entry = F.struct("sort_score", "cluster_id", *[c for c in report.columns if c not in ("sort_score", "cluster_id")])
    rows = F.array_sort(F.collect_list(entry))
    return report.agg(F.to_json(F.struct(F.lit(date).alias("date"), F.lit(model).alias("model"), F.lit(least).alias("min_articles"), F.lit(most).alias("max_articles"), F.count("*").alias("clusters_reported"), rows.alias("clusters"))).alias("json"))


def trust_document(log: DataFrame, date: str) -> DataFrame:
    """The quality log as one JSON object: date and clusters in order."""
    entry = F.struct(*log.columns)
    return log.agg(F.to_json(F.struct(F.lit(date).alias("date"), F.array_sort(F.collect_list(entry)).alias("clusters"))).alias("json"))
