"""What the published page shows, as DataFrames: reading time, label roll-ups, lean counts, totals, chips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom import dims
from topicloom.functions import text


def reading_minutes(topics: Column) -> Column:
    """Three quarters of a minute for each topic and two more, between 3 and 12, half rounded up."""
    return F.greatest(F.lit(3), F.least(F.lit(12), F.round(topics * 0.75 + 2).cast("int")))


def rollup(shares: DataFrame, *by: str) -> DataFrame:
    """left, center, right, uncategorised percent of each topic, from (by, label, pct)."""
    total = lambda *labels: F.coalesce(F.sum(F.when(F.col("label").isin(*labels), F.col("pct"))), F.lit(0)).cast("int")
    return shares.groupBy(*by).agg(total("Far Left", "Left").alias("pct_left"), total("Center").alias("pct_center"), total("Right", "Far Right").alias("pct_right"), total("Unknown", "Uncategorized").alias("pct_uncat"))


def bar_label(name: str, pct: Column, full: int = 14, short: int = 9) -> Column:
    """Name and percent, percent alone, or nothing, as the bar has room."""
    number = F.concat(pct.cast("string"), F.lit("%"))
    return F.when(pct >= full, F.concat(F.lit(f"{name} "), number)).when(pct >= short, number).otherwise(F.lit(""))


def lean_counts(shares: DataFrame, sources: DataFrame, compat: bool = True) -> DataFrame:
    """Sources of each lean: topic, label, n, from (topic, label, pct) and (topic, num_sources).

    Unknown gets its rounded share; the rest is dealt by floors. ``compat``: what the floors leave over stays unshown, as
    the page always had it; else it goes to the largest fractions, first lean first.
    """
    known = [x for x in dims.LABEL_ORDER if x != "Unknown"]
    leans = F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(v).alias("label")) for i, v in enumerate(known)]))
    unknown = shares.filter(F.col("label").isin("Unknown", "Uncategorized")).groupBy("topic").agg(F.sum("pct").alias("u"))
    base = sources.join(unknown, "topic", "left").withColumn("uncat", F.least("num_sources", F.greatest(F.lit(0), F.round(F.col("num_sources") * F.coalesce("u", F.lit(0)) / 100).cast("long"))))
    each = base.select("topic", (F.col("num_sources") - F.col("uncat")).alias("rest"), "uncat", leans.alias("l")).select("topic", "rest", "uncat", "l.*")
    raw = each.join(shares, ["topic", "label"], "left").withColumn("raw", F.col("rest") * F.coalesce("pct", F.lit(0)) / 100)
    low = raw.withColumn("low", F.floor("raw"))
    if compat:
        dealt = low.select("topic", "label", F.col("low").cast("long").alias("n"))
    else:
        own = Window.partitionBy("topic")
        turn = F.row_number().over(own.orderBy(F.desc(F.col("raw") - F.col("low")), "rank"))
        spare = F.col("rest") - F.sum("low").over(own)
        dealt = low.withColumn("turn", turn).withColumn("spare", spare).select("topic", "label", (F.col("low") + F.floor(F.col("spare") / len(known)) + (F.col("turn") <= F.pmod("spare", F.lit(len(known)))).cast("int")).cast("long").alias("n"))
    return dealt.unionByName(base.select("topic", F.lit("Unknown").alias("label"), F.col("uncat").cast("long").alias("n")))


def chips(articles: DataFrame, bias: Column, source_name: Column) -> DataFrame:
    """html_chips of each cluster: anchors by label order, then name, then place."""
    label = text.title_case(F.coalesce(F.nullif(bias, F.lit("")), F.lit("Unknown")))
    ranks = F.create_map(*[F.lit(x) for i, v in enumerate(dims.LABEL_ORDER) for x in (v, i)])
    rank = F.coalesce(F.try_element_at(ranks, label), F.lit(len(dims.LABEL_ORDER) - 1))
    entry = F.struct(rank.alias("rank"), F.lower(text.or_empty(source_name)).alias("name"), "ord", text.chip(F.col("url"), bias, source_name).alias("html"))
    return articles.groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["html"]), " ").alias("html_chips"))


def lean_groups(articles: DataFrame, label: Column) -> DataFrame:
    """cluster_id, label, n, domains: a topic's sources by label, as the page lists them."""
    from topicloom.functions import url

    name = F.when(label.isin(dims.LABEL_ORDER), label).otherwise("Unknown")
    return articles.groupBy("cluster_id", name.alias("label")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.nullif(url.domain(F.col("url")), F.lit("")))).alias("domains"))


def totals(summaries: DataFrame) -> DataFrame:
    return summaries.agg(F.count("*").alias("topics"), F.coalesce(F.sum("num_sources"), F.lit(0)).alias("sources")).withColumn("minutes", reading_minutes(F.col("topics")))


def latest(rows: DataFrame, date: str = "dt") -> DataFrame:
    """Rows of the newest date; the date is a partition column, so only its files are read."""
    newest = rows.agg(F.max(date).alias(date))
    return rows.join(F.broadcast(newest), date, "left_semi")


def front(summaries: DataFrame, most: int = 3, order: str = "ord") -> DataFrame:
    """The topics that the front page shows: the first ones."""
    return summaries.orderBy(order).limit(most)
