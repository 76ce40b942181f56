"""Single steps of the daily run on files, each with a date that defaults to today.

    python -m topicloom.plans.stages normalise --input articles.json --output articles_normalised.json
    python -m topicloom.plans.stages label --input articles_normalised.json --output articles_labelled.json
    python -m topicloom.plans.stages trust --input final_clusters.json --output trust_log.json
    python -m topicloom.plans.stages cohesion --input clusters.json --top 10 --json-out cohesion.json

Files are one day's articles or clusters, as the page and the reviewers read them.
"""

from __future__ import annotations

import argparse
import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom import providers
from topicloom.functions import text
from topicloom.operators import articles as art
from topicloom.operators import clusters, vectors
from topicloom.sources import json_files

from . import daily


def normalise(spark: SparkSession, source: str, target: str, opts: daily.Options) -> None:
    rows = art.normalised_first(json_files.read_articles(spark, source).drop("url_normalized"), opts.date, opts.compat)
    json_files.export_array(rows, target, "ord")


def label(spark: SparkSession, source: str, target: str, opts: daily.Options) -> None:
    """Labels, and beside them the articles that have none, for review."""
    rows = art.bias_labels(json_files.read_articles(spark, source), ("source", "outlet", "publisher", "site_name"))
    json_files.export_array(rows.drop("bias").withColumnRenamed("label", "bias"), target, "ord")
    json_files.export_array(art.unmapped(rows), f"{target}.unmapped.json")


def trust(spark: SparkSession, source: str, target: str, opts: daily.Options) -> None:
    log = clusters.trust_log(json_files.read_clusters(spark, source))
    json_files.export_object(json_files.trust_document(log, opts.date), target)


def cohesion(rows: DataFrame, embedder: providers.Embedder, least: int = 4, most: int = 18) -> DataFrame:
    """Cohesion of clusters, worst first, from their texts: the first ``most`` articles, without those that have no text."""
    size = rows.groupBy("cluster_id").agg(F.count("*").alias("articles_in_cluster"), F.min_by(F.left(text.squeezed(F.col("title")), F.lit(120)), "ord").alias("label")).filter(F.col("articles_in_cluster") >= least)
    told = clusters.head(rows.join(size.select("cluster_id"), "cluster_id", "left_semi"), most).withColumn("text", text.article_text(F.col("title"), F.col("description"), most=300)).filter("text <> ''")
    found = vectors.as_provider(told.select("cluster_id", "ord", "text"), "text", embedder.encode, embedder.dims)
    stats = vectors.cohesion(vectors.unit_rows(found, "vector"), "cluster_id", lone=None)
    score = F.round(0.75 * F.col("p10_sim") + 0.25 * F.col("mean_sim") - 0.5 * F.col("std_sim"), 3)
    few = F.col("n") < 2
    rounded = [F.when(~few, F.round(c, 3)).alias(c) for c in ("mean_sim", "p10_sim", "std_sim")]
    return size.join(stats, "cluster_id", "left").select("cluster_id", "articles_in_cluster", F.when(few, 0).otherwise(F.coalesce("n", F.lit(0))).cast("int").alias("sampled_articles"), *rounded, F.coalesce(F.when(~few, score), F.lit(999.0)).alias("sort_score"), "label").orderBy("sort_score", "cluster_id")


def lines(report: DataFrame, top: int) -> list[str]:
    return [f"- idx={r['cluster_id']:>3}  size={r['articles_in_cluster']:>2}  p10={r['p10_sim']}  mean={r['mean_sim']}  std={r['std_sim']}  score={r['sort_score']}  | {r['label'] or ''}" for r in report.limit(top).collect()]


def main(argv: list[str] | None = None) -> None:
    args = argparse.ArgumentParser(description="One step of the daily run, on files")
    args.add_argument("step", choices=["normalise", "label", "trust", "cohesion"])
    args.add_argument("--date", default=datetime.date.today().isoformat())
    args.add_argument("--input", required=True)
    args.add_argument("--output", help="the file to write; cohesion prints and takes --json-out instead")
    args.add_argument("--top", type=int, default=10)
    args.add_argument("--min-articles", type=int, default=4)
    args.add_argument("--max-per-cluster", type=int, default=18)
    args.add_argument("--json-out")
    got = args.parse_args(argv)
    if art.day_of(got.date) is None:
        args.error(f"not a date: {got.date}")
    if got.step != "cohesion" and not got.output:
        args.error("--output is needed")
    spark = SparkSession.builder.appName(f"daily topics: {got.step}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    opts = daily.Options(got.date)
    if got.step == "cohesion":
        report = cohesion(json_files.read_clusters(spark, got.input), opts.embedder, got.min_articles, got.max_per_cluster)
        print("\n".join(lines(report, got.top)) or "no cluster has as many articles")
        if got.json_out:
            json_files.export_object(json_files.cohesion_document(report, got.date, opts.embedder.name, got.min_articles, got.max_per_cluster), got.json_out)
        return
    {"normalise": normalise, "label": label, "trust": trust}[got.step](spark, got.input, got.output, opts)


if __name__ == "__main__":
    main()
