"""Pictures for the topics of a run: search replies of two providers, gates and scores, the first good one by query.

A topic's queries are tried in turn, and only topics that still lack a picture are asked for again, so providers get no
more calls than one topic after another would make. Topics are those of one run: ten or so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom import providers
from topicloom.functions import text
from topicloom.functions import vectors as unit_vectors
from topicloom.operators import pictures, vectors
from topicloom.sources import images
from topicloom.sources.tables import written

FIELDS = ("url", "alt", "description", "credit", "source", "source_url", "license")


def queries(title: Column, summary: Column, central: Column) -> Column:
    """What to search for, most telling first: names, short forms of the headline, its words, the central title and its head."""
    plain = lambda c: F.trim(text.or_empty(c))
    parts = F.concat(F.array(plain(text.entity_query(title))), text.short_queries(title, title), F.array(plain(text.image_query(title, summary)), plain(central), plain(text.headline_query(central))))
    return F.array_distinct(F.filter(parts, lambda q: q != ""))


def _replies(asked: DataFrame, search: providers.ImageSearch) -> DataFrame:
    """``asked`` (with ``query``) and ``body``, the provider's reply to each."""
    ask = search.search

    @F.pandas_udf("string")
    def reply(col):
        return col.map(ask)

    return written(asked.withColumn("body", reply("query")), "replies")


def _likeness(rows: DataFrame, one: str, other: str, into: str, embedder: providers.Embedder) -> DataFrame:
    """``rows`` with ``into``: cosine of two text columns; 0 where a text has no vector."""
    a = vectors.as_provider(rows, one, embedder.encode, embedder.dims).withColumnRenamed("vector", "_a")
    b = vectors.as_provider(a, other, embedder.encode, embedder.dims).withColumnRenamed("vector", "_b")
    as_doubles = lambda c: F.col(c).cast("array<double>")
    return b.withColumn(into, F.coalesce(unit_vectors.cosine(as_doubles("_a"), as_doubles("_b")), F.lit(0.0))).drop("_a", "_b")


def from_encyclopedia(asked: DataFrame, search: providers.ImageSearch, embedder: providers.Embedder) -> DataFrame:
    """cluster_id and the picture of each (cluster_id, query, topic): licensed, no scan, about the topic, of most query words."""
    replies = _replies(asked, search)
    found = images.encyclopedia(replies.select(F.col("cluster_id").alias("query_id"), "query", "body"))
    told = found.join(asked.select(F.col("cluster_id").alias("query_id"), "topic"), "query_id").withColumn("_seen", F.trim(F.concat_ws(" ", "title", "description")))
    fine = _likeness(told, "topic", "_seen", "_sim", embedder).filter(pictures.relevant(F.col("topic"), F.col("_seen"), F.col("_sim"), 0.30, 1))
    best = pictures.best_found(fine).select("query_id", "ord")
    rows = fine.join(best, ["query_id", "ord"])
    short = F.nullif(F.col("license"), F.lit(""))
    credit = F.concat(F.lit("Photo: "), F.concat_ws(" / ", F.nullif(F.col("credit"), F.lit("")), F.lit("Wikimedia Commons"), short))
    alt = text.squeezed(F.coalesce(F.nullif(F.col("description"), F.lit("")), F.col("query")))
    return rows.select(F.col("query_id").alias("cluster_id"), "url", alt.alias("alt"), F.coalesce(F.nullif(F.col("description"), F.lit("")), alt).alias("description"), credit.alias("credit"), F.lit("wikimedia").alias("source"), F.col("page").alias("source_url"), F.coalesce(short, F.lit("Wikimedia license")).alias("license"))


def from_photos(asked: DataFrame, search: providers.ImageSearch, embedder: providers.Embedder) -> DataFrame:
    """cluster_id and the photo of each (cluster_id, query, topic, title, central) that is clearly the best of all variants."""
    variants = asked.select("cluster_id", F.posexplode(text.photo_queries(F.col("query"), F.col("topic"), F.col("title"))).alias("ord", "query"))
    found = images.photos(_replies(variants, search).select(F.col("cluster_id").alias("topic_id"), "query", "ord", "body"))
    told = found.join(asked.select(F.col("cluster_id").alias("topic_id"), "topic", F.coalesce(F.nullif("central", F.lit("")), "topic").alias("_core")), "topic_id").withColumn("_seen", F.concat_ws(" ", "alt", "description"))
    for column, into in (("topic", "sim_topic"), ("query", "sim_query"), ("_core", "sim_core")):
        told = _likeness(told, column, "_seen", into, embedder)
    told = written(told, "photos")
    best = pictures.best_photo(told.select("topic_id", "ord", "sim_topic", "sim_query", "sim_core")).select("topic_id", "ord")
    return told.join(best, ["topic_id", "ord"]).select(F.col("topic_id").alias("cluster_id"), "url", "alt", "description", "credit", F.lit("unsplash").alias("source"), F.col("page").alias("source_url"), F.lit("Unsplash License").alias("license"))


def illustrated(topics: DataFrame, embedder: providers.Embedder, encyclopedia: providers.ImageSearch | None, photos: providers.ImageSearch | None) -> DataFrame:
    """cluster_id and the picture's FIELDS of the topics that one was found for. topics: cluster_id, topic_title, summary, central."""
    title, summary = F.col("topic_title"), F.col("summary")
    about = F.trim(F.concat(text.or_empty(title), F.lit(". "), text.or_empty(summary)))
    left = written(topics.select("cluster_id", title.alias("title"), F.coalesce("central", F.lit("")).alias("central"), about.alias("topic"), queries(title, summary, F.col("central")).alias("queries")), "illustrate")
    most = left.agg(F.max(F.size("queries")).alias("n")).first()["n"] or 0
    found = topics.sparkSession.createDataFrame([], ", ".join(["cluster_id long", *(f"{f} string" for f in FIELDS)]))
    for choose, search in ((from_encyclopedia, encyclopedia), (from_photos, photos)):
        for k in range(most if search is not None else 0):
            asked = left.filter(F.size("queries") > k).withColumn("query", F.col("queries")[k]).drop("queries")
            hits = written(choose(asked, search, embedder), "pictures")
            found = found.unionByName(hits)
            left = written(left.join(hits.select("cluster_id"), "cluster_id", "left_anti"), "illustrate")
            if left.isEmpty():
                return found
    return found
