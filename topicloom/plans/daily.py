"""The daily run: articles in, ranked topics, summaries and quality logs out. Every stage is a DataFrame.

    python -m topicloom.plans.daily --date 2024-01-10 --input articles.json --output out/

Articles come from a file, or with --feeds from the feeds over HTTP. Beside the tables the run writes what the page and the
reviewers read: final_clusters.json, summaries.json, trust_log.json and cohesion_report.json; --print-report shows the
first titles of each topic.
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicloom import dims, providers, providers_http, schemas
from topicloom.functions import stats, text, url
from topicloom.functions import vectors as unit_vectors
from topicloom.operators import articles as art
from topicloom.operators import clusters, folds, pictures, serving, similarity, vectors
from topicloom.sources import caches, feeds, json_files
from topicloom.sources.tables import written

from . import illustrated


_RAW = ["title", "description", "url", "source", "published_at", "published_date"]


@dataclass
class Options:
    date: str
    top: int = 10
    judge: bool = True  # whether topics need a positive judgement at the end
    event_calls: int = 24
    merge_at: float = 0.85
    centroid_k: int | None = None
    compat: bool = True
    names: bool = False  # whether topics may also be one by a shared name and likeness (offline: capitalised words)
    cache: str | None = None  # folder of the embedding, event and summary caches
    embedder: providers.Embedder = field(default_factory=providers.HashingEmbedder)
    judge_model: providers.Judge = field(default_factory=providers.FixedJudge)
    summarizer: providers.Summarizer = field(default_factory=providers.ExtractiveSummarizer)
    zero_shot: providers.ZeroShot = field(default_factory=providers.KeywordZeroShot)
    encyclopedia: providers.ImageSearch | None = None  # without these topics have no pictures
    photos: providers.ImageSearch | None = None


def collected(api: DataFrame, entries: DataFrame) -> DataFrame:
    """Articles of an API reply, then those of feeds that pass the language gate, numbered in that order."""

    @F.pandas_udf("string")
    def language(col):
        return col.map(providers.guess_language)

    one = art.api_articles(api).select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("feed_ord"), F.col("ord").alias("place"), *_RAW)
    rows = art.feed_articles(entries).join(entries.select("feed", "feed_ord").distinct(), "feed")
    two = art.language_gate(rows.withColumn("_lang", language(art.gate_text(F.col("title"), F.col("description")))), F.col("_lang")).select(F.lit(1).alias("part"), "feed_ord", F.col("ord").alias("place"), *_RAW)
    # A day's articles are a few thousand; their number is one small window.
    return one.unionByName(two).withColumn("ord", F.row_number().over(Window.orderBy("part", "feed_ord", "place")) - 1).select(F.col("ord").cast("long"), *_RAW)


def labelled(raw: DataFrame, opts: Options) -> DataFrame:
    """Time box, first row of each URL, label."""
    rows = art.normalised_first(raw, opts.date, opts.compat)
    if "bias" not in rows.columns:
        rows = rows.withColumn("bias", F.lit(None).cast("string"))
    names = tuple(c for c in ("source", "outlet", "publisher", "site_name") if c in rows.columns)
    found = art.bias_labels(rows, names)
    return found.drop("bias").withColumnRenamed("label", "bias")


def embedded(articles: DataFrame, opts: Options) -> DataFrame:
    """``articles`` with ``embedding``; with a cache, only texts that it lacks are embedded, each once."""
    model = opts.embedder.name
    rows = articles.withColumn("_text", text.embedding_text(F.col("title"), F.col("description"), opts.compat))
    if opts.cache is None:
        return vectors.as_provider(rows, "_text", opts.embedder.encode, opts.embedder.dims).drop("_text").withColumnRenamed("vector", "embedding")

    def provide(missing: DataFrame) -> DataFrame:
        found = vectors.as_provider(missing.select("key", "_text"), "_text", opts.embedder.encode, opts.embedder.dims)
        some = F.exists("vector", lambda x: x != 0)  # a zero vector stands for a failure and isn't cached
        return found.select("key", F.when(some, F.col("vector")).alias("v"), F.lit(model).alias("model"))

    keyed = rows.withColumn("key", text.cache_key(model, F.col("_text")))
    got = caches.filled(keyed, f"{opts.cache}/embeddings", schemas.EMBEDDING_CACHE, "key", provide)
    zero = F.array_repeat(F.lit(0.0).cast("float"), opts.embedder.dims)
    return got.select(*articles.columns, F.coalesce("v", zero).alias("embedding"))


def cluster_vectors(rows: DataFrame, opts: Options, most: int = 10) -> DataFrame:
    """ord (the cluster), vector: the unit vector of each cluster's text, its first ``most`` articles as lines."""
    texts = clusters.joined_text(rows, text.prompt_line(F.col("title"), F.col("description")), "\n", most)
    found = vectors.as_provider(texts.select(F.col("cluster_id").alias("ord"), "text"), "text", opts.embedder.encode, opts.embedder.dims)
    return written(found.select("ord", unit_vectors.unit(F.col("vector").cast("array<double>")).alias("vector")), "cluster_vectors")


def title_vectors(rows: DataFrame, opts: Options) -> DataFrame:
    """cluster_id, vector: the unit vector of all titles of each cluster."""
    found = vectors.as_provider(clusters.title_text(rows), "text", opts.embedder.encode, opts.embedder.dims)
    return written(found.select("cluster_id", unit_vectors.unit(F.col("vector").cast("array<double>")).alias("vector")), "title_vectors")


def clustered(articles: DataFrame, opts: Options) -> DataFrame:
    """k-means clusters, those of similar texts merged, tails trimmed, tiny ones dropped."""
    raw = articles.select("ord", F.col("embedding").cast("array<double>").alias("vector"))
    rows = articles.join(vectors.kmeans(raw, opts.centroid_k), "ord")
    told = cluster_vectors(rows.withColumn("cluster_id", F.col("cluster_id").cast("long")), opts)
    merged = vectors.greedy_merge(told, vectors.similar_pairs(told, opts.merge_at))
    rows = rows.join(merged.select(F.col("node").alias("cluster_id"), "topic"), "cluster_id").drop("cluster_id").withColumnRenamed("topic", "cluster_id")
    rows = written(art.sizeable(rows, 2), "clusters")
    kept = vectors.trimmed(vectors.unit_rows(rows))
    rows = written(rows.join(kept, ["cluster_id", "ord"], "left_semi"), "trimmed")
    return art.sizeable(rows, 2, art.titled_or_linked(F.col("title"), F.col("url")))


def coherent(rows: DataFrame) -> DataFrame:
    """Late trim of tails; clusters of under two titles, under four articles, or small and incoherent are dropped."""

    def two_titles(some: DataFrame) -> DataFrame:
        return some.join(art.sizeable(some, 2, text.or_empty(F.col("title")) != "").select("cluster_id").distinct(), "cluster_id", "left_semi")

    rows = written(two_titles(rows), "titled")
    kept = vectors.trimmed(vectors.unit_rows(rows), cautious=False, floor=10)
    rows = written(two_titles(rows.join(kept, ["cluster_id", "ord"], "left_semi")), "late_trim")
    told = rows.filter(text.article_text(F.col("title"), F.col("description"), most=300) != "")
    loose = vectors.cohesion(vectors.unit_rows(told), "cluster_id").withColumnRenamed("n", "texts")
    size = rows.groupBy("cluster_id").agg(F.count("*").alias("n")).join(loose, "cluster_id", "left")
    bad = stats.incoherent(F.col("n"), F.coalesce("texts", F.lit(0)), F.coalesce("p10_sim", F.lit(1.0)), F.coalesce("std_sim", F.lit(0.0)))
    return rows.join(size.filter(~bad).select("cluster_id"), "cluster_id", "left_semi")


def duplicate_pairs(rows: DataFrame, opts: Options) -> DataFrame:
    """i, j of clusters that are one topic: shared URLs, or like titles (with names: a shared name and like titles)."""
    likely = similarity.tfidf_pairs(similarity.tfidf(clusters.title_text(rows), dims.TITLE_STOP), 0.78 if opts.names else 0.88)
    met = similarity.url_pairs(rows).join(likely, ["i", "j"], "full")
    if not opts.names:
        return met.filter(similarity.duplicate_topics(F.coalesce("jaccard", F.lit(0.0)), F.coalesce("sim", F.lit(0.0)))).select("i", "j")
    near = vectors.similar_pairs(title_vectors(rows, opts).withColumnRenamed("cluster_id", "ord"), 0.70).withColumnRenamed("sim", "semantic")
    names = clusters.title_text(rows).select("cluster_id", text.entities(F.col("text")).alias("names"))
    side = lambda k: names.select(F.col("cluster_id").alias(k), F.col("names").alias(f"names_{k}"))
    met = met.join(near, ["i", "j"], "full").join(side("i"), "i", "left").join(side("j"), "j", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    shared = F.coalesce(F.arrays_overlap("names_i", "names_j"), F.lit(False))
    return met.filter(similarity.duplicate_topics(zero("jaccard"), zero("sim"), zero("semantic"), shared)).select("i", "j")


def deduplicated(rows: DataFrame, opts: Options, passes: int = 2) -> DataFrame:
    """``rows`` after near-duplicate topics are merged, until none is or after ``passes``; cluster_id is the rank from 0."""
    topics = rows.select("cluster_id").distinct().count()
    for _ in range(passes):
        pairs = duplicate_pairs(rows, opts).select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
        key = url.merge_key(F.col("url_normalized"), F.col("url"), F.col("title"), F.col("source"))
        own = rows.select(F.col("cluster_id").alias("topic"), "ord", key.alias("key"), url.domain(F.col("url")).alias("domain"))
        stay = folds.merge_duplicates(own, pairs, opts.compat)
        rows = written(stay.withColumnRenamed("topic", "cluster_id").join(rows.drop("cluster_id"), "ord"), "final")
        before, topics = topics, rows.select("cluster_id").distinct().count()
        if topics == before:
            break
    return rows


def final_topics(rows: DataFrame, opts: Options) -> DataFrame:
    """Topics with measures and rank, after duplicates are collapsed, incoherent ones dropped and suspicious ones judged."""
    kept = clusters.signature_collapse(rows).select("cluster_id")
    # Written before it is looked at from many sides: plans that read it stay short.
    rows = written(coherent(written(rows.join(kept, "cluster_id", "left_semi"), "kept")), "collapsed")
    order = clusters.ranked(clusters.measured(rows, opts.date, F.col("bias")), "matter_score", "cluster_ord").select("cluster_id", "matter_score", "cluster_ord")
    ranks = {r["cluster_id"]: i for i, r in enumerate(order.collect())}  # topics of one run: at most a few hundred
    index = rows.sparkSession.createDataFrame(list(ranks.items()) or [(0, 0)], "cluster_id long, topic long")
    rows = written(rows.join(index, "cluster_id").drop("cluster_id").withColumnRenamed("topic", "cluster_id"), "indexed")
    rows = deduplicated(rows, opts)
    measures = clusters.measured(rows, opts.date, F.col("bias"))
    # Small fresh topics go one by one into the leading three that they are most like.
    day = art.parsed_date(art.article_date(F.col("published_date"), F.col("published_at")))
    centre = art.parsed_date(F.lit(opts.date))
    today = F.when(centre.isNull(), day.cast("string") == opts.date).otherwise(day.between(F.date_sub(centre, 1), F.date_add(centre, 1)))
    linked = rows.select("cluster_id", "ord", url.canonical(F.col("url")).alias("link"), day.isNotNull().alias("dated"), F.coalesce(today, F.lit(False)).alias("today"))
    stay = folds.merge_dominant(linked, measures, vectors.leader_similarities(measures, title_vectors(rows, opts)))
    rows = written(stay.join(rows.drop("cluster_id"), "ord"), "merged")
    measures = clusters.measured(rows, opts.date, F.col("bias"))
    loose = vectors.cohesion(vectors.unit_rows(rows), "cluster_id", most=18).select("cluster_id", "p10_sim", "std_sim")
    names = similarity.entity_share(rows)
    measures = measures.join(loose, "cluster_id", "left").join(names, "cluster_id")
    measures = measures.withColumn("suspicious", stats.suspicious(F.col("size"), F.col("entity_cohesion"), F.coalesce("p10_sim", F.lit(1.0)), F.coalesce("std_sim", F.lit(0.0)), F.col("today_ratio")))
    order = measures.orderBy(F.desc("matter_score"), "cluster_ord").select("cluster_id").collect()
    ranks_ = rows.sparkSession.createDataFrame([(r["cluster_id"], i) for i, r in enumerate(order)] or [(-1, 0)], "cluster_id long, rank long")
    keyed = clusters.url_signature(rows).select("cluster_id", F.concat(F.lit(f"{opts.judge_model.name}::"), "signature").alias("key"))
    known = caches.read(rows.sparkSession, f"{opts.cache}/events", schemas.EVENT_CACHE, keyed) if opts.cache else rows.sparkSession.createDataFrame([], schemas.EVENT_CACHE)
    cached = caches.probe(keyed, known, "key").select("cluster_id", "key", F.col("label").alias("cached"))
    gate = clusters.budget_gate(measures.join(ranks_, "cluster_id").join(cached, "cluster_id").withColumn("forced", F.col("rank") < max(opts.top + 30, 60)), opts.event_calls)
    names_ = rows.groupBy("cluster_id").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("ord", text.or_empty(F.col("title")).alias("t")))), 1, 12), lambda p: p["t"]).alias("titles"))
    ask = opts.judge_model.label

    @F.pandas_udf("string")
    def verdict(col):
        return col.map(lambda ts: ask(list(ts)))

    asked = gate.filter("decision = 'judge'").select("cluster_id", "key").join(names_, "cluster_id").select("cluster_id", "key", text.reply_event(verdict("titles")).alias("r")).select("cluster_id", "key", "r.label", "r.why")
    asked = written(asked, "judged")
    if opts.cache:
        caches.append(asked.select("key", "label", "why"), f"{opts.cache}/events")
        caches.compact(rows.sparkSession, f"{opts.cache}/events", schemas.EVENT_CACHE)
    judged = gate.join(asked.select("cluster_id", F.col("label").alias("_new")), "cluster_id", "left").withColumn("eventness_label", F.coalesce("_new", "cached")).drop("_new")
    judged = clusters.event_filter(judged.filter(F.col("decision") != "drop"), opts.judge)
    top = clusters.ranked(judged, "matter_score", "cluster_ord", opts.top)
    return rows.join(top.select("cluster_id", "matter_score", "eventness_label", "today_ratio"), "cluster_id")


def summaries(topics: DataFrame, opts: Options, least: int = 6) -> DataFrame:
    """One row per topic of at least ``least`` articles, near-duplicate ones merged: headline, summary, takeaways, shares, sources, category."""
    rows = art.sizeable(topics, least)
    central = vectors.central(vectors.unit_rows(rows), 10).select("cluster_id", "ord", "place")
    picked = rows.join(central, ["cluster_id", "ord"]).groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "title", "description"))), lambda p: F.struct(p["title"].alias("t"), p["description"].alias("d"))).alias("picked"))
    summarize, score, labels = opts.summarizer.summarize, opts.zero_shot.score, [x for x, _, _ in dims.CATEGORIES]

    @F.pandas_udf("string")
    def reply(col):
        return col.map(lambda xs: summarize([(x["t"] or "", x["d"] or "") for x in xs]))

    @F.pandas_udf("array<double>")
    def shares(col):
        return col.map(lambda t: score(t, labels))

    # A summary's key is made of all URLs of its cluster, the model and how many articles it may see.
    links = F.array_join(F.array_sort(F.collect_list(F.nullif(F.col("url"), F.lit("")))), "\n")
    keys = rows.groupBy("cluster_id").agg(text.cache_key(f"{opts.summarizer.name}:max10", links).alias("key"))
    keyed = picked.join(keys, "cluster_id")

    def provide(missing: DataFrame) -> DataFrame:
        asked = written(missing.select("key", reply("picked").alias("reply")).filter("reply is not null"), "replies")
        r = F.col("reply")
        return asked.select("key", text.reply_headline(r).alias("headline"), text.reply_body(r, opts.compat).alias("summary"), text.reply_takeaways(r).alias("takeaways"))

    if opts.cache:
        found = caches.filled(keyed, f"{opts.cache}/summaries", schemas.SUMMARY_CACHE, "key", provide)
    else:
        found = keyed.join(provide(keyed.dropDuplicates(["key"])), "key", "left")
    told = written(found.filter("headline is not null").select("cluster_id", F.col("headline").alias("topic_title"), "summary", "takeaways"), "told")
    scored = told.select("cluster_id", F.arrays_zip(shares(F.concat_ws(" ", "topic_title", "summary")).alias("s"), F.array(*map(F.lit, labels)).alias("l")).alias("z")).select(F.col("cluster_id").alias("topic_id"), F.explode("z").alias("z")).select("topic_id", F.col("z.l").alias("label"), F.col("z.s").alias("score"))
    category = pictures.runoff(scored).withColumnRenamed("topic_id", "cluster_id")
    share = clusters.label_shares(rows, F.col("bias")).groupBy("cluster_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "pct"))).alias("bias_distribution"))
    sources = rows.groupBy("cluster_id").agg(F.array_sort(F.collect_set(F.nullif(F.col("url"), F.lit("")))).alias("sources"), F.count("*").alias("num_sources"), F.max("matter_score").alias("matter_score"))
    chips = serving.chips(rows, F.col("bias"), F.lit(None).cast("string"))
    found = told.join(share, "cluster_id").join(sources, "cluster_id").join(chips, "cluster_id").join(category, "cluster_id", "left")
    query = text.image_query(F.col("topic_title"), F.col("summary"))
    found = found.withColumn("image_query", query)
    found = pictured(found, rows, opts)
    best = [F.desc("num_sources"), F.desc("matter_score"), "cluster_id"]
    # At most ``top`` rows are numbered; repeated ones are folded into the first.
    told = written(found.orderBy(*best).limit(opts.top).withColumn("ord", F.row_number().over(Window.orderBy(*best))), "told")
    stay = folds.merge_summaries(told, most=opts.top).select("ord", "sources", "num_sources")
    return told.drop("sources", "num_sources").join(stay, "ord").orderBy("ord").select(*found.columns)


def pictured(told: DataFrame, rows: DataFrame, opts: Options) -> DataFrame:
    """Summaries with the fields of their pictures, empty where there is none."""
    middle = vectors.most_central(vectors.unit_rows(rows)).join(rows.select("cluster_id", "ord", F.col("title").alias("central")), ["cluster_id", "ord"]).drop("ord")
    told = written(told, "told")
    chosen = illustrated.illustrated(told.select("cluster_id", "topic_title", "summary").join(middle, "cluster_id", "left"), opts.embedder, opts.encyclopedia, opts.photos)
    kept = chosen.select("cluster_id", *[F.col(f).alias(f"image_{f}") for f in illustrated.FIELDS], text.short_credit(F.col("credit")).alias("image_credit_short"))
    fields = [c for c in kept.columns if c != "cluster_id"]
    return told.join(kept, "cluster_id", "left").fillna("", fields).withColumns({"image_width": F.lit(600), "image_max_width": F.lit(600)})


def run(spark: SparkSession, raw: DataFrame, opts: Options) -> dict[str, DataFrame]:
    """raw: articles with ``ord``. Tables: articles, unmapped, topics, cohesion, trust, summaries."""
    rows = written(embedded(labelled(raw, opts), opts), "articles")
    groups = written(clustered(rows, opts), "groups")
    topics = written(final_topics(groups, opts), "topics")
    return {
        "articles": rows,
        "unmapped": rows.filter("bias = 'Unknown'").select("url", url.domain(F.col("url")).alias("domain"), "source", "title"),
        "topics": topics,
        "cohesion": vectors.report(vectors.unit_rows(groups)),
        "trust": clusters.trust_log(topics),
        "summaries": summaries(topics, opts),
    }


def export(tables: dict[str, DataFrame], output: str, opts: Options) -> None:
    """The files of a run that people read: topics, summaries, quality log, cohesion report."""
    topics = tables["topics"]
    spread = clusters.diversity(topics).select("cluster_id", F.struct("unique_domains", "total_with_domain", "top_domain", "top_share", "entropy").alias("source_diversity"))
    kept = [c for c in ("ord", "title", "description", "url", "source", "bias", "published_at", "published_date") if c in topics.columns]
    nested = json_files.nested(topics.select("cluster_id", "eventness_label", "today_ratio", "matter_score", *kept), "eventness_label", "today_ratio", "matter_score").join(spread, "cluster_id")
    json_files.export_array(nested.withColumn("rank", -F.col("matter_score")), f"{output}/final_clusters.json", "rank")
    json_files.export_array(tables["summaries"].withColumn("_at", F.monotonically_increasing_id()), f"{output}/summaries.json", "_at")
    json_files.export_object(json_files.trust_document(tables["trust"], opts.date), f"{output}/trust_log.json")
    json_files.export_object(json_files.cohesion_document(tables["cohesion"], opts.date, opts.embedder.name), f"{output}/cohesion_report.json")


def report(topics: DataFrame, most: int = 5) -> list[str]:
    """Lines of the console report: size and first titles of each topic, best first."""
    rank = topics.groupBy("cluster_id").agg(F.max("matter_score").alias("score"))
    rows = clusters.first_titles(topics, most).join(rank, "cluster_id").orderBy(F.desc("score"), "cluster_id").collect()  # at most the run's top topics
    return [line for i, r in enumerate(rows, 1) for line in (f"[{i}] size={r['n']}", *(f"   - {t}" for t in r["titles"]))]


def main(argv: list[str] | None = None) -> None:
    args = argparse.ArgumentParser(description="Daily topics from a JSON array of articles, or from feeds")
    args.add_argument("--date", required=True)
    args.add_argument("--input", help="a JSON array of articles; without it the feeds are read")
    args.add_argument("--feeds", nargs="*", help="URLs of feeds; without any, the built-in list")
    args.add_argument("--api-reply", help="a file with a news API's reply, read beside the feeds")
    args.add_argument("--news-key", help="key of the news API, asked beside the feeds")
    args.add_argument("--chat", nargs=3, metavar=("URL", "KEY", "MODEL"), help="a chat endpoint that judges and summarises topics")
    args.add_argument("--embed", nargs=3, metavar=("URL", "KEY", "MODEL"), help="an embeddings endpoint")
    args.add_argument("--pictures", action="store_true", help="search the encyclopedia for pictures")
    args.add_argument("--photo-key", help="client id of the photo search")
    args.add_argument("--output", required=True)
    args.add_argument("--cache", help="folder of the embedding, event and summary caches")
    args.add_argument("--top-k", type=int, default=10)
    args.add_argument("--names", action="store_true", help="topics may be one by shared names")
    args.add_argument("--no-judge", action="store_true")
    args.add_argument("--print-report", action="store_true")
    got = args.parse_args(argv)
    if art.day_of(got.date) is None:
        args.error(f"not a date: {got.date}")
    if got.input is None and got.feeds is None:
        args.error("either --input or --feeds is needed")
    spark = SparkSession.builder.appName("daily topics").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if got.input:
        raw = json_files.read_articles(spark, got.input)
    else:
        reply = spark.read.text(got.api_reply, wholetext=True).first()["value"] if got.api_reply else providers_http.news_reply(got.news_key, got.date) if got.news_key else "{}"
        raw = written(collected(feeds.api_rows(spark, reply), feeds.feed_entries(spark, got.feeds or None)), "collected")
    opts = Options(got.date, top=got.top_k, judge=not got.no_judge, names=got.names, cache=got.cache)
    if got.chat:
        opts.judge_model, opts.summarizer = providers_http.ChatJudge(*got.chat), providers_http.ChatSummarizer(*got.chat)
    if got.embed:
        opts.embedder = providers_http.ApiEmbedder(*got.embed)
    opts.encyclopedia = providers_http.EncyclopediaSearch() if got.pictures else None
    opts.photos = providers_http.PhotoSearch(got.photo_key) if got.photo_key else None
    output, tables = got.output.rstrip("/"), run(spark, raw, opts)
    for name, df in tables.items():
        json_files.write_dated(df, f"{output}/{name}", got.date)
    export(tables, output, opts)
    if got.print_report:
        print("\n".join(report(tables["topics"])))


if __name__ == "__main__":
    main()
