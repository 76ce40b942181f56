"""Aggregates and rankings of clusters: one row per cluster, from flat article rows with ``cluster_id`` and ``ord``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom import dims
from topicloom.functions import stats, text, url

from .articles import article_date, parsed_date


def counted(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """cluster_id, ``name``, n, first_ord of each value that isn't empty."""
    return rows.select("cluster_id", "ord", value.alias(name)).filter(F.coalesce(F.col(name), F.lit("")) != "").groupBy("cluster_id", name).agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))


def _concentration(articles: DataFrame) -> DataFrame:
    return counted(articles, url.stripped(F.col("source")), "source").groupBy("cluster_id").agg(F.round(F.max("n") / F.sum("n"), 3).alias("source_concentration"))


def concentration(articles: DataFrame) -> DataFrame:
    """Share of the most frequent source among those named, to 3 places; 0 where none is."""
    return articles.select("cluster_id").distinct().join(_concentration(articles), "cluster_id", "left").fillna(0.0, ["source_concentration"])


def _entropy() -> Column:
    """Base-2 entropy of the counts ``n`` of a group, from sums alone."""
    return F.greatest(F.lit(0.0), F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n"))


def _diversity(articles: DataFrame) -> DataFrame:
    return counted(articles, url.domain(F.col("url")), "domain").groupBy("cluster_id").agg(
        F.count("*").alias("unique_domains"),
        F.sum("n").alias("total_with_domain"),
        F.max_by("domain", F.struct("n", -F.col("first_ord"))).alias("top_domain"),
        F.round(F.max("n") / F.sum("n"), 3).alias("top_share"),
        (F.round(_entropy(), 3) + 0.0).alias("entropy"),
    )


_NO_DOMAIN = {"unique_domains": 0, "total_with_domain": 0, "top_domain": "", "top_share": 0.0, "entropy": 0.0}


def diversity(articles: DataFrame) -> DataFrame:
    """unique_domains, total_with_domain, top_domain, top_share, entropy; the first domain seen wins a tie."""
    return articles.select("cluster_id").distinct().join(_diversity(articles), "cluster_id", "left").fillna(_NO_DOMAIN)


def domain_entropy(articles: DataFrame) -> DataFrame:
    """Entropy of domains without rounding; the normalised URL stands in for a missing one."""
    link = F.coalesce(F.nullif(F.col("url"), F.lit("")), F.col("url_normalized"))
    found = counted(articles, url.domain(link), "domain").groupBy("cluster_id").agg(_entropy().alias("domain_entropy"))
    return articles.select("cluster_id").distinct().join(found, "cluster_id", "left").fillna(0.0, ["domain_entropy"])


def _freshness(target: str, days: int) -> Column:
    """Share of dated articles within ``days`` of the target; 1 where none is dated. An aggregate."""
    day = parsed_date(article_date(F.col("published_date"), F.col("published_at")))
    centre = parsed_date(F.lit(target))
    inside = F.when(centre.isNull(), day.cast("string") == target).otherwise(day.between(F.date_sub(centre, days), F.date_add(centre, days)))
    dated = F.count(day)
    return F.when(dated == 0, 1.0).otherwise(F.count_if(inside) / dated)


def freshness(articles: DataFrame, target: str, days: int = 1) -> DataFrame:
    """Share of dated articles within ``days`` of the target; 1 where none is dated."""
    return articles.groupBy("cluster_id").agg(_freshness(target, days).alias("today_ratio"))


def label_percent(articles: DataFrame, label: Column, trimmed: bool = True) -> DataFrame:
    """Whole percentages, half to even, over labels other than Unknown; they needn't add up to 100."""
    raw = F.coalesce(F.nullif(label, F.lit("")), F.lit("Unknown"))
    named = articles.select("cluster_id", text.title_case(url.stripped(raw) if trimmed else raw).alias("label")).filter("label <> 'Unknown'")
    n = named.groupBy("cluster_id", "label").agg(F.count("*").alias("n"))
    total = n.groupBy("cluster_id").agg(F.sum("n").alias("total"))
    return n.join(total, "cluster_id").select("cluster_id", "label", F.bround((F.col("n") / F.col("total")) * 100).cast("int").alias("pct"))


def largest_remainder(counts: DataFrame, groups: list[str], item: str, order: list[str], total: int = 100) -> DataFrame:
    """Whole shares of ``total`` by the largest remainder, ties in ``order``; items with nothing are left out.

    counts: groups, item, n. Every group has at most len(order) rows.
    """
    ranks = F.create_map(*[F.lit(x) for i, v in enumerate(order) for x in (v, i)])
    own = Window.partitionBy(*groups)
    exact = F.col("n") * float(total) / F.sum("n").over(own)
    rows = counts.withColumn("exact", exact).withColumn("low", F.floor("exact")).withColumn("rank", ranks[F.col(item)])
    rows = rows.withColumn("spare", total - F.sum("low").over(own)).withColumn("turn", F.row_number().over(own.orderBy(F.desc(F.col("exact") - F.col("low")), "rank")))
    return rows.select(*groups, item, (F.col("low") + (F.col("turn") <= F.col("spare")).cast("int")).cast("int").alias("pct")).filter("pct > 0")


def label_shares(articles: DataFrame, label: Column) -> DataFrame:
    """Percentages over the six canonical labels that add up to 100; a missing or foreign label is Center."""
    name = text.title_case(url.stripped(F.coalesce(F.nullif(label, F.lit("")), F.lit("Center"))))
    name = F.when(name.isin(dims.LABEL_ORDER), name).otherwise("Center")
    counts = articles.select("cluster_id", name.alias("label")).groupBy("cluster_id", "label").agg(F.count("*").alias("n"))
    return largest_remainder(counts, ["cluster_id"], "label", dims.LABEL_ORDER)


def label_percent_1dp(articles: DataFrame, label: Column) -> DataFrame:
    """Percentages of the labels as they are, to one place; a missing one is Center."""
    n = articles.select("cluster_id", F.coalesce(F.nullif(label, F.lit("")), F.lit("Center")).alias("label")).groupBy("cluster_id", "label").agg(F.count("*").alias("n"))
    total = n.groupBy("cluster_id").agg(F.sum("n").alias("total"))
    return n.join(total, "cluster_id").select("cluster_id", "label", F.round(F.col("n") * 100 / F.col("total"), 1).alias("pct"))


def majority_label(articles: DataFrame, label: Column) -> DataFrame:
    """The most frequent raw label (first seen on a tie), and its share as text."""
    n = articles.select("cluster_id", "ord", F.coalesce(label, F.lit("unknown")).alias("label")).groupBy("cluster_id", "label").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))
    return n.groupBy("cluster_id").agg(F.max_by("label", F.struct("n", -F.col("first_ord"))).alias("majority"), F.concat(F.bround(F.max("n") / F.sum("n") * 100).cast("int").cast("string"), F.lit("%")).alias("share"))


def label_count(articles: DataFrame, label: Column) -> DataFrame:
    return articles.groupBy("cluster_id").agg(F.count_distinct(F.nullif(url.stripped(label), F.lit(""))).alias("labels"))


def measured(articles: DataFrame, target: str, label: Column) -> DataFrame:
    """One row per cluster: size, spread over domains and labels, concentration, freshness, matter score.

    Three passes over the articles: by cluster, by cluster and source, by cluster and domain. Labels are a few words each.
    """
    labels = F.size(F.collect_set(F.nullif(url.stripped(label), F.lit(""))))
    base = articles.groupBy("cluster_id").agg(F.count("*").alias("size"), F.min("ord").alias("cluster_ord"), F.round(_freshness(target, 1), 3).alias("today_ratio"), labels.alias("labels"))
    every = base.join(_diversity(articles), "cluster_id", "left").join(_concentration(articles), "cluster_id", "left").fillna({**_NO_DOMAIN, "source_concentration": 0.0})
    score = stats.matter(F.col("size"), F.col("entropy"), F.col("unique_domains"), F.col("labels"), F.col("today_ratio"), F.col("source_concentration"))
    return every.withColumn("matter_score", score)


def ranked(clusters: DataFrame, score: str, order: str, top: int | None = None) -> DataFrame:
    """Highest score first, earlier clusters first on a tie; the first ``top`` of them (at least one)."""
    best = clusters.orderBy(F.desc(score), order)
    return best if top is None else best.limit(max(1, top))


def head(rows: DataFrame, n: int, by: str = "cluster_id", order: str = "ord") -> DataFrame:
    """The first ``n`` rows of each group. A group-limited window: each task passes on at most ``n`` rows of a group."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(by).orderBy(order))).filter(F.col("_place") <= n).drop("_place")


def joined_text(articles: DataFrame, line: Column, gap: str, most: int | None = None) -> DataFrame:
    """The lines of each cluster's first ``most`` articles, joined in order."""
    rows = head(articles, most) if most else articles
    pairs = F.array_sort(F.collect_list(F.struct("ord", line.alias("line"))))
    return rows.groupBy("cluster_id").agg(F.array_join(F.transform(pairs, lambda p: p["line"]), gap).alias("text"))


def title_text(articles: DataFrame) -> DataFrame:
    """All titles of a cluster, joined by blanks; its sources where it has no title."""
    lists = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c) != "", F.struct("ord", F.col(c).alias("v"))))), lambda p: p["v"]), " ")
    clean = articles.select("cluster_id", "ord", url.stripped(text.or_empty(F.col("title"))).alias("title"), url.stripped(text.or_empty(F.col("source"))).alias("source"))
    got = clean.groupBy("cluster_id").agg(lists("title").alias("titles"), lists("source").alias("sources"))
    return got.select("cluster_id", F.when(F.col("titles") != "", F.col("titles")).otherwise(F.col("sources")).alias("text"))


def domain_list(articles: DataFrame) -> DataFrame:
    """Distinct domains in order, every ``www.`` taken out, case kept."""
    host = F.replace(url.part(text.or_empty(F.col("url")), 2), F.lit("www."), F.lit(""))
    return articles.groupBy("cluster_id").agg(F.array_sort(F.collect_set(F.when(host != "", host))).alias("domains"))


#: Parts that a cluster's links are dealt to before their first characters meet.
SALTS = 64


def first_links(links: DataFrame, most: int) -> DataFrame:
    """cluster_id, link, n: of the sorted links (each n times), joined by one character, those that begin within ``most`` characters.

    Equal links are counted in each task first. A cluster's links are dealt to SALTS parts; each part keeps what could begin within
    ``most`` characters if it were alone, so at most SALTS times that many characters of a cluster meet.
    """
    counts = links.groupBy("cluster_id", "link").agg(F.count("*").alias("n")).withColumn("salt", F.pmod(F.xxhash64("link"), F.lit(SALTS)))
    long = F.col("n") * (F.length("link") + 1)

    def begun(*by: str) -> Column:
        return F.coalesce(F.sum(long).over(Window.partitionBy(*by).orderBy("link").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    part = counts.withColumn("_b", begun("cluster_id", "salt")).filter(F.col("_b") < most)
    return part.withColumn("_b", begun("cluster_id")).filter(F.col("_b") < most).select("cluster_id", "link", F.least("n", F.lit(most)).alias("n"))


def url_signature(articles: DataFrame, most: int = 8000) -> DataFrame:
    """Canonical URLs of a cluster, sorted, joined by bars, cut to ``most`` characters."""
    link = F.when(text.or_empty(F.col("url")) != "", url.canonical(F.col("url")))
    first = first_links(articles.select("cluster_id", link.alias("link")).filter("link is not null"), most)
    # What is listed begins within ``most`` characters: no list is longer than that.
    every = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("link", "n"))), lambda p: F.array_repeat(p["link"], p["n"].cast("int"))))
    joined = first.groupBy("cluster_id").agg(F.left(F.array_join(every, "|"), F.lit(most)).alias("signature"))
    return articles.select("cluster_id").distinct().join(joined, "cluster_id", "left").fillna("", ["signature"])


def signature_collapse(articles: DataFrame) -> DataFrame:
    """One cluster for each set of canonical URLs: the largest, then the one of most entropy, then the first."""
    link = F.when(text.or_empty(F.col("url")) != "", url.canonical(F.col("url")))
    size = articles.groupBy("cluster_id").agg(F.count("*").alias("size"), F.min("ord").alias("cluster_ord"))
    # A set is known by its size and by a sum and an exclusive or of two hashes of its members: sets needn't be gathered.
    each = articles.select("cluster_id", link.alias("link")).filter("link is not null").distinct()
    sets = each.groupBy("cluster_id").agg(F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("link").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64(F.lit(1), "link")).alias("xor")).alias("urls"))
    rows = size.join(sets, "cluster_id", "left").join(diversity(articles).select("cluster_id", "entropy"), "cluster_id")
    # The best cluster of a set is an aggregate: clusters of one set (those without URLs are one, too) needn't meet in a task.
    best = F.max_by(F.struct("cluster_id", "size", "entropy"), F.struct("size", "entropy", -F.col("cluster_ord")))
    return rows.groupBy("urls").agg(best.alias("b"), F.min("cluster_ord").alias("place")).select("b.cluster_id", "b.size", "b.entropy", "place")


def trust_log(articles: DataFrame, titles: int = 5, most: int = 140) -> DataFrame:
    """Quality record of each cluster: articles, domains, top domain and its share, first titles."""
    host = url.domain_without_any_www(F.col("url"))
    spread = counted(articles, host, "domain").groupBy("cluster_id").agg(F.count("*").alias("unique_domains"), F.max_by("domain", F.struct("n", -F.col("first_ord"))).alias("top_domain"), (F.max("n") / F.sum("n")).alias("top"))
    first = head(articles, titles).groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.left(text.or_empty(F.col("title")), F.lit(most)).alias("t")))), lambda p: p["t"]).alias("example_titles"))
    size = articles.groupBy("cluster_id").agg(F.count("*").alias("num_articles"))
    every = size.join(spread, "cluster_id", "left").join(first, "cluster_id")
    return every.select("cluster_id", "num_articles", F.coalesce("unique_domains", F.lit(0)).alias("unique_domains"), F.coalesce("top_domain", F.lit("")).alias("top_domain"), F.round(F.coalesce("top", F.lit(0.0)), 1).alias("top_share"), "example_titles")


def budget_gate(reviewed: DataFrame, budget: int = 24) -> DataFrame:
    """reviewed: rank, forced, suspicious, cached (label or null). Adds ``decision``.

    Rows that need a review and have no cached label use up the budget in rank order; beyond it forced rows are dropped
    and others pass. The rows are ranked topics of one run, so their running count is one small window.
    """
    need = (F.col("forced") | F.col("suspicious")) & F.col("cached").isNull()
    used = F.sum(need.cast("int")).over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    rows = reviewed.withColumn("used", used)
    decision = F.when(~(F.col("forced") | F.col("suspicious")), "pass").when(F.col("cached").isNotNull(), F.when(F.col("cached").isin("THEMATIC_BUCKET", "MIXED"), "drop").otherwise("keep")).when(F.col("used") <= budget, "judge").when(F.col("forced"), "drop").otherwise("pass")
    return rows.withColumn("decision", decision).drop("used")


def event_filter(judged: DataFrame, strict: bool) -> DataFrame:
    """Topics that aren't labelled as several; ``strict``: only those labelled as one event."""
    kept = judged.filter(~F.coalesce(F.col("eventness_label").isin("THEMATIC_BUCKET", "MIXED"), F.lit(False)))
    return kept.filter(F.col("eventness_label") == "SINGLE_EVENT") if strict else kept


def zipped(left: DataFrame, right: DataFrame, order: str = "ord") -> DataFrame:
    """Rows of two tables side by side, by place in their order from 0: cluster and summary files that belong together.

    The shorter table decides how many. Both are the topics of one run: their numbering is one small window each.
    """
    place = F.row_number().over(Window.orderBy(order)) - 1
    two = right.withColumn("place", place).drop(order)
    return left.withColumn("place", place).join(two, "place")


def by_topic_label(articles: DataFrame, label: Column) -> DataFrame:
    """Articles grouped by a model's topic label, in order; a missing or blank label is Other."""
    name = F.coalesce(F.nullif(url.stripped(label), F.lit("")), F.lit("Other"))
    fields = F.struct("ord", *[c for c in articles.columns if c != "ord"])
    return articles.groupBy(name.alias("topic")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(fields)).alias("articles"))


def first_titles(articles: DataFrame, most: int = 5) -> DataFrame:
    """cluster_id, n, titles: what the run's report prints of each cluster."""
    first = head(articles, most).groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", text.or_empty(F.col("title")).alias("t")))), lambda p: p["t"]).alias("titles"))
    return articles.groupBy("cluster_id").agg(F.count("*").alias("n")).join(first, "cluster_id")
