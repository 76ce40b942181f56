"""Operators on flat article rows: projections, filters, keep-first, keyed unions, labels.

Rows carry ``ord``, their place in the input. Order is never taken from the DataFrame itself.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom import dims
from topicloom.functions import text, url


def api_articles(rows: DataFrame) -> DataFrame:
    """Articles of a news API's nested rows: title, description, url, source.name, publishedAt."""
    at = F.coalesce("publishedAt", F.lit(""))
    return rows.select(*[c for c in ("ord",) if c in rows.columns], "title", "description", "url", F.col("source.name").alias("source"), at.alias("published_at"), F.left(at, F.lit(10)).alias("published_date"))


def iso_timestamp(at: Column) -> Column:
    """UTC, to the second, with Z; empty for null."""
    return F.coalesce(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))


def feed_articles(entries: DataFrame, per_feed: int = 25) -> DataFrame:
    """Articles of feed entries (feed, feed_title, ord, title, summary, link, published, updated).

    The first ``per_feed`` entries of a feed come first; the language gate counts afterwards.
    """
    place = F.row_number().over(Window.partitionBy("feed").orderBy("ord"))
    at = iso_timestamp(F.coalesce("published", "updated"))
    return (
        entries.withColumn("_place", place)
        .filter(F.col("_place") <= per_feed)
        .select("feed", "ord", text.or_empty(F.col("title")).alias("title"), text.or_empty(F.col("summary")).alias("description"), text.or_empty(F.col("link")).alias("url"), F.coalesce("feed_title", "feed").alias("source"), at.alias("published_at"), F.left(at, F.lit(10)).alias("published_date"))
    )


def gate_text(title: Column, description: Column) -> Column:
    """What the language gate looks at."""
    return text.untagged(F.left(F.concat(text.or_empty(title), F.lit(". "), text.or_empty(description)), F.lit(800)))


def language_gate(articles: DataFrame, language: Column, wanted: str = "en", least: int = 25) -> DataFrame:
    """Keeps rows in the wanted language, short ones, and those whose language is unknown."""
    seen = gate_text(F.col("title"), F.col("description"))
    return articles.filter((F.length(seen) < least) | language.isNull() | (language == wanted))


def article_date(published_date: Column, published_at: Column) -> Column:
    """First ten characters of the date, else of the timestamp; empty where both are shorter."""
    ten = lambda c: F.when(F.length(url.stripped(text.or_empty(c))) >= 10, F.left(url.stripped(c), F.lit(10)))
    return F.coalesce(ten(published_date), ten(published_at), F.lit(""))


def parsed_date(day: Column) -> Column:
    """A date of ten characters; null where it isn't one."""
    return F.when(F.length(day) == 10, F.try_to_date(day, "yyyy-MM-dd"))


def day_of(date: str) -> datetime.date | None:
    """A date of the form YYYY-MM-DD given to a run; null where it isn't one."""
    try:
        return datetime.date.fromisoformat(date) if len(date) == 10 else None
    except ValueError:
        return None


def time_box(articles: DataFrame, target: str, days: int = 1) -> DataFrame:
    """Rows within ``days`` of the target date, and those without a valid date. An invalid target filters nothing."""
    centre = parsed_date(F.lit(target))
    day = parsed_date(article_date(F.col("published_date"), F.col("published_at")))
    return articles.filter(centre.isNull() | day.isNull() | day.between(F.date_sub(centre, days), F.date_add(centre, days)))


def keep_first(rows: DataFrame, key: Column, order: str = "ord") -> DataFrame:
    """The first row of each key by ``order``, which is unique; all null keys are one. One shuffle on the key, minima first.

    The winner's place is a map-side combined minimum, so a key with a third of all rows costs no more than another.
    """
    keyed = rows.withColumn("_key", F.coalesce(key, F.lit("")))
    first = keyed.groupBy("_key").agg(F.min(order).alias(order))
    return keyed.join(first.select(order), order, "left_semi").drop("_key")


def normalised_first(articles: DataFrame, target: str, compat: bool = True) -> DataFrame:
    """Time box, normalised URL, first row of each. ``compat``: all rows without a URL are one; else each stays."""
    boxed = time_box(articles, target).withColumn("url_normalized", url.normalise(F.col("url")))
    key = text.or_empty(F.col("url_normalized"))
    return keep_first(boxed, key if compat else F.when(key == "", F.concat(F.lit("\0"), F.col("ord").cast("string"))).otherwise(key))


def keyed_union(first: DataFrame, second: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """Union by key: a key keeps its first place, the last value wins, rows of ``second`` come later; empty keys go."""
    both = first.withColumn("_part", F.lit(0)).unionByName(second.withColumn("_part", F.lit(1))).filter(F.coalesce(F.col(key), F.lit("")) != "")
    own = Window.partitionBy(key)
    last = F.row_number().over(own.orderBy(F.desc("_part"), F.desc(order)))
    place = F.min(F.struct("_part", order)).over(own)
    kept = both.withColumn("_last", last).withColumn("_place", place).filter("_last = 1")
    return kept.select(*first.columns, F.col("_place._part").alias("place_part"), F.col(f"_place.{order}").alias("place_ord"))


def bias_labels(articles: DataFrame, names: tuple[str, ...] = ("source",), default: str = "Center") -> DataFrame:
    """``articles`` with ``label``: own label, domain override, domain's outlet, domain as a name, names in order, default.

    The lookup tables are fixed (under 200 rows) and broadcast.
    """
    spark = articles.sparkSession
    exact = dims.outlets(spark).select("name", "label")
    folded = dims.outlets(spark).groupBy(F.lower("name").alias("low")).agg(F.min_by("label", "ord").alias("label"))

    def by_name(df: DataFrame, column: Column, into: str) -> DataFrame:
        """Exact name, else the first in declaration order that agrees in any case."""
        one = exact.select(F.col("name").alias("_n"), F.col("label").alias("_e"))
        two = folded.select(F.col("low").alias("_l"), F.col("label").alias("_f"))
        keyed = df.withColumn("_k", column)
        met = keyed.join(F.broadcast(one), F.col("_k") == F.col("_n"), "left").join(F.broadcast(two), F.lower("_k") == F.col("_l"), "left")
        return met.withColumn(into, F.coalesce("_e", "_f")).drop("_k", "_n", "_e", "_l", "_f")

    df = articles.withColumn("_domain", url.domain(F.col("url")))
    rules = dims.overrides(spark).select(F.col("domain").alias("_od"), F.col("label").alias("_override"))
    alias = dims.domains(spark).select(F.col("domain").alias("_ad"), F.col("name").alias("_alias"))
    df = df.join(F.broadcast(rules), F.col("_domain") == F.col("_od"), "left").join(F.broadcast(alias), F.col("_domain") == F.col("_ad"), "left")
    df = by_name(df, F.col("_alias"), "_by_alias")
    direct = exact.select(F.col("name").alias("_dn"), F.col("label").alias("_by_domain"))
    df = df.join(F.broadcast(direct), F.col("_domain") == F.col("_dn"), "left")
    for i, name in enumerate(names):
        df = by_name(df, F.col(name), f"_by_{i}")
    own = F.when(text.or_empty(F.col("bias")) != "", text.canonical_label(F.col("bias")))
    found = F.coalesce(own, "_override", "_by_alias", "_by_domain", *[f"_by_{i}" for i in range(len(names))], F.lit(default))
    return df.withColumn("label", found).select(*articles.columns, "label")


def display_names(rows: DataFrame, domain: str = "domain") -> DataFrame:
    """``rows`` with ``display_name``: the outlet that a domain belongs to, also under www; null where none is known."""
    known = dims.domains(rows.sparkSession).select(F.col("domain").alias("_known"), F.col("name").alias("display_name"))
    bare = known.select(F.col("_known").alias("_bare"), F.col("display_name").alias("_under_www"))
    met = rows.join(F.broadcast(known), F.col(domain) == F.col("_known"), "left").join(F.broadcast(bare), F.col(domain) == F.concat(F.lit("www."), F.col("_bare")), "left")
    return met.select(*rows.columns, F.coalesce("display_name", "_under_www").alias("display_name"))


def unmapped(labelled: DataFrame) -> DataFrame:
    """Rows whose label is Unknown, for review."""
    who = F.coalesce(F.nullif(F.col("source"), F.lit("")), F.col("outlet")) if "outlet" in labelled.columns else F.col("source")
    return labelled.filter(F.col("label") == "Unknown").select("url", url.domain(F.col("url")).alias("domain"), who.alias("source"), "title")


def is_opinion(title: Column, link: Column) -> Column:
    has = lambda c, words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(text.or_empty(c)), w))
    return has(title, dims.OPINION_TITLE) | has(link, dims.OPINION_URL)


def thin_or_extreme(title: Column, description: Column, link: Column, raw_label: Column) -> Column:
    """Whether the older summariser left an article out."""
    return (F.length(text.or_empty(description)) < 30) | (F.coalesce(raw_label.isin("far-left", "far-right"), F.lit(False)) & is_opinion(title, link))


def snippet_weight(title: Column, link: Column, raw_label: Column, source: Column) -> Column:
    """Label weight, less for opinion, times the outlet's credibility."""
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    weight = F.coalesce(F.try_element_at(table(dims.LABEL_WEIGHTS), F.coalesce(raw_label, F.lit("unknown"))), F.lit(0.6))
    weight = weight * F.when(is_opinion(title, link), 0.6).otherwise(1.0)
    return weight * F.coalesce(F.try_element_at(table(dims.CREDIBILITY), F.coalesce(source, F.lit("unknown"))), F.lit(0.0))


def snippet_copies(weight: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(weight * 5)).cast("int")


def short_source(link: Column) -> Column:
    """Known outlet name of a domain, else its first label with a capital."""
    host = F.replace(url.authority(link), F.lit("www."), F.lit(""))
    known = F.create_map(*[F.lit(x) for kv in dims.SHORT_NAMES.items() for x in kv])
    first = F.substring_index(host, ".", 1)
    return F.coalesce(F.try_element_at(known, host), F.concat(F.upper(F.left(first, F.lit(1))), F.lower(F.substr(first, F.lit(2)))))


def off_topic(articles: DataFrame, rejected: DataFrame, least: int = 2) -> DataFrame:
    """Drops the titles rejected for a cluster (cluster_id, title), then clusters with fewer than ``least`` left."""
    left = articles.join(rejected.select("cluster_id", "title").distinct(), ["cluster_id", "title"], "left_anti")
    return with_size(left).filter(F.col("cluster_size") >= least).drop("cluster_size")


def with_size(articles: DataFrame) -> DataFrame:
    """``cluster_size`` of each article: counted by partial aggregation, then joined, so no cluster meets in one task."""
    return articles.join(articles.groupBy("cluster_id").agg(F.count("*").alias("cluster_size")), "cluster_id")


def sizeable(articles: DataFrame, least: int = 2, need: Column | None = None) -> DataFrame:
    """Articles for which ``need`` holds, of clusters with at least ``least`` such articles."""
    kept = articles if need is None else articles.filter(need)
    return with_size(kept).filter(F.col("cluster_size") >= least).drop("cluster_size")


def titled(title: Column) -> Column:
    return url.stripped(text.or_empty(title)) != ""


def titled_or_linked(title: Column, link: Column) -> Column:
    return (text.or_empty(title) != "") | (text.or_empty(link) != "")


def replicated(articles: DataFrame, weight: Column) -> DataFrame:
    """Each article as often as its weight says."""
    return articles.withColumn("copy", F.explode(F.sequence(F.lit(1), snippet_copies(weight))))


def described(articles: DataFrame) -> DataFrame:
    """Articles with a title or a description."""
    return articles.filter((text.or_empty(F.col("title")) != "") | (text.or_empty(F.col("description")) != ""))


def approved(clusters: DataFrame, reply: Column) -> DataFrame:
    """Clusters for which a model's reply begins with yes, in any case; without a reply they go."""
    return clusters.filter(F.coalesce(F.startswith(F.upper(url.stripped(reply)), F.lit("YES")), F.lit(False)))
