"""Choosing categories and pictures from what providers return: gates, scores, margins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom import dims
from topicloom.functions import text


def scanned_page(title: Column, description: Column, link: Column) -> Column:
    """A document instead of a picture, by file ending or by a word anywhere in title and description."""
    low = lambda c: F.lower(text.or_empty(c))
    hay, address = F.concat(low(title), F.lit(" "), low(description)), low(link)
    any_of = lambda xs, test: F.exists(F.array(*[F.lit(x) for x in xs]), test)
    ends = any_of(dims.BAD_IMAGE_ENDINGS, lambda e: F.endswith(address, e) | F.contains(address, F.concat(e, F.lit("?"))) | F.endswith(low(title), e))
    return ends | any_of(dims.BAD_IMAGE_WORDS, lambda w: F.contains(hay, w))


def drawn(title: Column, description: Column) -> Column:
    hay = F.lower(F.concat(text.or_empty(title), F.lit(" "), text.or_empty(description)))
    return F.exists(F.array(*[F.lit(w) for w in dims.DRAWN_WORDS]), lambda w: F.contains(hay, w))


def best_found(candidates: DataFrame, least: int = 3) -> DataFrame:
    """Best licensed picture of each query: query_id, ord, query, title, description, url, license. The first wins a tie."""
    fine = candidates.filter((text.or_empty(F.col("url")) != "") & (text.or_empty(F.col("license")) != "") & ~scanned_page(F.col("title"), F.col("description"), F.col("url")) & ~drawn(F.col("title"), F.col("description")))
    scored = fine.withColumn("score", text.relevance(F.col("query"), F.col("title"), F.col("description"))).filter(F.col("score") >= least)
    best = scored.groupBy("query_id").agg(F.max_by(F.struct("ord", "title", "url", "score"), F.struct("score", -F.col("ord"))).alias("b"))
    return best.select("query_id", "b.*")


def keyword_overlap(topic: Column, picture: Column, least: int = 2) -> Column:
    own = lambda c: F.array_distinct(text.tokens(c, dims.IMAGE_STOP))
    return F.size(F.array_intersect(own(topic), own(picture))) >= least


def relevant(topic: Column, picture: Column, similarity: Column, threshold: float = 0.32, least: int = 2) -> Column:
    """Alike in meaning and in words."""
    return F.coalesce(similarity >= threshold, F.lit(False)) & keyword_overlap(topic, picture, least)


def photo_score(topic: Column, query: Column, core: Column) -> Column:
    """Score of a photo by its similarity to topic, query and core text; null if it passes neither gate."""
    strict = (topic >= 0.31) & (query >= 0.30)
    relaxed = (core >= 0.36) & (topic >= 0.29) & (query >= 0.27)
    lifted = F.when((query < 0.30) & (core >= 0.36), 0.30).otherwise(query)
    return F.when(strict | relaxed, 0.50 * core + 0.35 * topic + 0.15 * lifted)


def best_photo(candidates: DataFrame, margin: float = 0.020, strong: float = 0.36) -> DataFrame:
    """topic_id, ord, score of the best photo, unless the next is within ``margin`` and the best isn't strong.

    candidates: topic_id, ord, sim_topic, sim_query, sim_core. A missing second counts as -1.
    """
    scored = candidates.withColumn("score", photo_score(F.col("sim_topic"), F.col("sim_query"), F.coalesce("sim_core", "sim_topic"))).filter("score is not null")
    own = Window.partitionBy("topic_id").orderBy(F.desc("score"), "ord")
    placed = scored.withColumn("r", F.row_number().over(own)).withColumn("second", F.coalesce(F.lead("score").over(own), F.lit(-1.0)))
    return placed.filter((F.col("r") == 1) & ~((F.col("score") - F.col("second") < margin) & (F.col("score") < strong))).select("topic_id", "ord", "score")


def first_hit(candidates: DataFrame, key: str = "topic_id") -> DataFrame:
    """The first successful candidate of each topic, by source rank then order. candidates: key, rank, ord, value."""
    hits = candidates.filter(F.col("value").isNotNull())
    return hits.groupBy(key).agg(F.min_by("value", F.struct("rank", "ord")).alias("value"))


def _final_two(scores: DataFrame, close: float) -> DataFrame:
    """topic_id, l1, s1, l2, s2: the last two labels and their shares, by one aggregate of a topic's few labels."""
    ranked = lambda a: F.array_sort(a)
    entry = lambda score, label: F.struct(score.isNull().alias("none"), (-score).alias("m"), label.alias("label"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t - F.coalesce(x["m"], F.lit(0.0)))
    shared = lambda col: ranked(F.transform(col, lambda x: entry(-x["m"] / total(col), x["label"])))
    listed = scores.groupBy("topic_id").agg(ranked(F.collect_list(entry(F.col("score").cast("double"), F.col("label")))).alias("r"))
    three = listed.select("topic_id", F.slice("r", 1, 3).alias("r"))
    tight = (F.size("r") >= 3) & (F.get("r", F.lit(1))["m"] - F.get("r", F.lit(0))["m"] < close)
    second = three.select("topic_id", F.slice(F.when(tight, shared(F.col("r"))).otherwise(F.col("r")), 1, 2).alias("r"))
    two = second.select("topic_id", shared(F.col("r")).alias("r"))
    at = lambda k: F.get("r", F.lit(k))
    return two.select("topic_id", at(0)["label"].alias("l1"), (-at(0)["m"]).alias("s1"), at(1)["label"].alias("l2"), (-at(1)["m"]).alias("s2"))


def _rescored_two(scores: DataFrame, rescored, close: float) -> DataFrame:
    """The same with the shares of ``rescored``."""
    order = Window.partitionBy("topic_id").orderBy(F.desc("score"), "label")

    def top(df: DataFrame, n: int) -> DataFrame:
        return df.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= n)

    three = top(scores, 3)
    gap = three.groupBy("topic_id").agg((F.max(F.when(F.col("r") == 1, F.col("score"))) - F.max(F.when(F.col("r") == 2, F.col("score")))).alias("gap"), F.count("*").alias("n"))
    three = three.join(gap, "topic_id")
    tight = (F.col("gap") < close) & (F.col("n") >= 3)
    second = rescored(three.filter(tight).select("topic_id", "label", "score")).unionByName(three.filter(~tight | F.col("gap").isNull()).select("topic_id", "label", "score"))
    final = top(rescored(top(second, 2).select("topic_id", "label", "score")), 2)
    pick = lambda c, r: F.max(F.when(F.col("r") == r, F.col(c)))
    return final.groupBy("topic_id").agg(pick("label", 1).alias("l1"), pick("score", 1).alias("s1"), pick("label", 2).alias("l2"), pick("score", 2).alias("s2"))


def runoff(scores: DataFrame, rescored=None, close: float = 0.04, least: float = 0.42, margin: float = 0.12) -> DataFrame:
    """topic_id, category, slug, score, runner_up, runner_up_score by ranked label scores (topic_id, label, score).

    When the first two are within ``close``, the first three are scored again among themselves; the first two always
    are. ``rescored(df)`` stands for the classifier on such a choice (topic_id, label, score); the offline one shares
    out the scores again. A winner below ``least``, or less than ``margin`` ahead, gives no category.
    """
    final = _final_two(scores, close) if rescored is None else _rescored_two(scores, rescored, close)
    names = F.create_map(*[F.lit(x) for label, name, _ in dims.CATEGORIES for x in (label, name)])
    slugs = F.create_map(*[F.lit(x) for label, _, slug in dims.CATEGORIES for x in (label, slug)])
    rows = final.select("topic_id", "l1", "s1", "l2", F.coalesce("s2", F.lit(0.0)).alias("s2"))
    sure = (F.col("s1") >= least) & (F.col("s1") - F.col("s2") >= margin)
    return rows.select("topic_id", F.when(sure, F.try_element_at(names, F.col("l1"))).alias("category"), F.when(sure, F.try_element_at(slugs, F.col("l1"))).alias("category_slug"), F.round("s1", 3).alias("category_score"), F.try_element_at(names, F.col("l2")).alias("category_runner_up"), F.round("s2", 3).alias("category_runner_up_score"))


def credit(photographer: Column) -> Column:
    return F.concat(F.lit("Photo: "), F.when(F.trim(text.or_empty(photographer)) != "", F.concat(F.trim(photographer), F.lit(" / Unsplash"))).otherwise(F.lit("Unsplash")))
