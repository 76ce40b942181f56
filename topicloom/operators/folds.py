"""Order-dependent merges of ranked topics. Each reads what earlier steps changed, so it is one sequential fold.

Pairs are found in Spark before. Topics that no chain of pairs connects don't affect each other: each such group is folded
in a task of its own, and topics without a pair aren't folded at all. A group of duplicates with more than ``LIMIT`` topics is
decided in rounds over tables instead; the other folds refuse more than ``LIMIT`` rows instead of slowing down unseen.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.sources.tables import written

from .strings import sequence_ratio, sorted_words

LIMIT = 5000


def _checked(n: int) -> None:
    if n > LIMIT:
        raise ValueError(f"{n} topics in one run; this fold takes at most {LIMIT}")


@dataclass
class _Topic:
    """Articles by merge key, in first-seen order: key to (domain, place); ``domains`` of all articles, also of repeated keys."""

    items: dict[str, tuple[str, int]] = field(default_factory=dict)
    size: int = 0
    domains: list[str] | None = None

    def spread(self) -> float:
        counts = Counter(d for d in (self.domains if self.domains is not None else [d for d, _ in self.items.values()]) if d)
        total = sum(counts.values())
        return -sum(c / total * math.log2(c / total) for c in counts.values()) if total else 0.0


def fold_duplicates(topics: list[_Topic], pairs: set[tuple[int, int]], compat: bool = True) -> dict[int, int]:
    """Topic to the topic that took its articles (itself if it stays).

    Pairs are met in order; the larger topic wins, then the one of more even domains, then the first. ``compat``: a topic
    that lost goes on as the left side of its remaining pairs, so later ones may merge into it and be lost.
    """
    _checked(len(topics))
    taken: dict[int, int] = {}
    partners: dict[int, list[int]] = {}
    for i, j in pairs:
        partners.setdefault(min(i, j), []).append(max(i, j))
    for i in range(len(topics)):
        if i in taken:
            continue
        for j in sorted(partners.get(i, ())):
            if j in taken or (not compat and i in taken):
                continue
            a, b = topics[i], topics[j]
            if a.size != b.size:
                first = a.size > b.size
            else:
                lead = a.spread() - b.spread()
                first = lead > 0 if abs(lead) > 1e-6 else True
            w, lost = (i, j) if first else (j, i)
            merged = dict(topics[w].items)
            merged.update(topics[lost].items)
            topics[w].items, topics[w].size, topics[w].domains = merged, len(merged), None
            taken[lost] = w
    return {i: taken.get(i, i) for i in range(len(topics))}


def merge_duplicates(articles: DataFrame, pairs: DataFrame, compat: bool = True, most_rows: int = 100_000) -> DataFrame:
    """topic, ord of the articles that remain after duplicates are merged.

    articles: topic (0 and up, in rank order), ord, key, domain (``key`` null: not merged over); pairs: i, j. Groups of linked topics
    with up to LIMIT topics and ``most_rows`` articles are folded in a task each, larger ones in rounds (``merge_in_rounds``).
    """
    from .vectors import linked

    links = written(pairs.select(F.least("i", "j").cast("long").alias("i"), F.greatest("i", "j").cast("long").alias("j")).filter("i < j").distinct(), "links")
    both = links.unionByName(links.select(F.col("j").alias("i"), F.col("i").alias("j")))
    labels = linked(both.select(F.col("i").alias("ord")).distinct(), both).select(F.col("ord").alias("topic"), F.col("label").alias("part"))
    rows = articles.select(F.col("topic").cast("long"), F.col("ord").cast("long"), F.nullif(F.col("key"), F.lit("")).alias("key"), "domain")
    count = rows.groupBy("topic").agg(F.count("*").alias("n"))
    size = labels.join(count, "topic", "left").groupBy("part").agg(F.count("*").alias("topics"), F.sum("n").alias("n"))
    large = size.select("part", ((F.col("topics") > LIMIT) | (F.coalesce("n", F.lit(0)) > most_rows)).alias("large"))
    parts = written(labels.join(large, "part"), "parts")
    rows_ = written(rows.join(parts, "topic", "left"), "articles")
    right = written(links.join(parts.withColumnRenamed("topic", "i"), "i").select("part", "large", "i", "j"), "pairs")
    small = right.filter("not large").drop("large")
    folded = rows_.filter("not large").drop("large").groupBy("part").cogroup(small.groupBy("part")).applyInPandas(_folder(compat), "topic long, ord long")
    kept = folded.unionByName(rows_.filter("part is null").select("topic", "ord"))
    if right.filter("large").isEmpty():
        return kept
    return kept.unionByName(merge_in_rounds(rows_.filter("large").drop("part", "large"), right.filter("large").select("i", "j"), compat))


def _folder(compat: bool):
    def fold(rows: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*rows["topic"], *links["i"], *links["j"]})
        place = {name: k for k, name in enumerate(names)}
        topics = [_Topic(domains=[]) for _ in names]
        plain: dict[int, list[int]] = {}
        for name, at, key, domain in rows.sort_values(["topic", "ord"])[["topic", "ord", "key", "domain"]].itertuples(index=False):
            topic = topics[place[name]]
            topic.size += 1
            topic.domains.append(domain or "")
            plain.setdefault(place[name], []).append(at)
            if key:
                topic.items[key] = (domain or "", at)
        owner = fold_duplicates(topics, {(place[a], place[b]) for a, b in links[["i", "j"]].itertuples(index=False)}, compat)
        # A topic that ever won holds merged articles, also where its loser went on to another winner.
        out = [(names[t], at) for t, w in owner.items() if t == w for at in ([p for _, p in topics[t].items.values()] if topics[t].domains is None else plain.get(t, []))]
        return pd.DataFrame(out, columns=["topic", "ord"]).astype("int64")

    return fold


def _evenness(rows: DataFrame, by: str) -> DataFrame:
    """by, spread: entropy of the domains of each group of ``rows``, which are counted in each task before they meet."""
    counts = rows.filter(F.coalesce("domain", F.lit("")) != "").groupBy(by, "domain").agg(F.count("*").alias("c"))
    sums = counts.groupBy(by).agg(F.sum("c").alias("t"), F.sum(F.col("c") * F.log2(F.col("c").cast("double"))).alias("s"))
    return sums.select(by, (F.log2(F.col("t").cast("double")) - F.col("s") / F.col("t")).alias("spread"))


def merge_in_rounds(articles: DataFrame, pairs: DataFrame, compat: bool = True) -> DataFrame:
    """As ``merge_duplicates``, for linked topics of any number: the pairs are decided in rounds, topics live in tables.

    The fold meets pairs in order of (i, j). A round takes, for each topic i that no undecided pair has on its right, the pairs (i, j)
    from its first on whose j has no earlier undecided pair: what they read is settled, so all such topics go on side by side. Among
    the pairs of one i, all are decided at once up to the first that i doesn't win: if i wins, it holds its own keys and those of the
    partners so far, so its size at each pair is a running sum of the keys that a partner brings first. Then follow, at once as
    well, the pairs that i loses with that size. Equal sizes are decided one at a time, by the entropy of domains. So a hub
    takes as many rounds as its wins and losses take turns, and a round's cost follows the topics that change in it.
    """
    plain = articles.select("topic", "ord", "domain", "key")
    every = plain.select("topic").unionByName(pairs.select(F.col("i").alias("topic"))).unionByName(pairs.select(F.col("j").alias("topic"))).distinct()
    count = plain.groupBy("topic").agg(F.count("*").alias("size"))
    nodes = written(every.join(count, "topic", "left").select("topic", F.coalesce("size", F.lit(0)).alias("size"), F.lit(False).alias("merged"), F.lit(None).cast("long").alias("owner"), F.lit(False).alias("begun")), "nodes")
    items = written(plain.filter("key is not null").groupBy("topic", "key").agg(F.max_by(F.struct("domain", F.col("ord").alias("place")), "ord").alias("v")).select("topic", "key", "v.*"), "items")
    events = written(pairs.select("i", "j"), "events")
    node = lambda s, *wanted: nodes.select(F.col("topic").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in wanted])
    while True:
        met = events.join(node("i", "size", "owner", "begun"), "i").join(node("j", "size", "owner"), "j")
        gone = F.col("owner_j").isNotNull() | (F.col("owner_i").isNotNull() & (F.lit(not compat) | ~F.col("begun_i")))
        events = written(met.filter(~gone).select("i", "j", "size_i", "size_j"), "events")
        if events.isEmpty():
            break
        first = events.groupBy("j").agg(F.min("i").alias("lead"))
        free = events.join(first.select(F.col("j").alias("i")), "i", "left_anti").join(first, "j")
        wait = free.groupBy("i").agg(F.min(F.when(F.col("lead") != F.col("i"), F.col("j"))).alias("wait"))
        run = written(free.join(wait, "i").filter(F.col("wait").isNull() | (F.col("j") < F.col("wait"))).select("i", "j", "size_i", "size_j"), "run")
        # Keys that each partner is the first to bring, and i's size at each pair if it wins all before.
        base = items.join(run.select(F.col("i").alias("topic")).distinct(), "topic", "left_semi").select(F.col("topic").alias("i"), "key")
        brought = run.select("i", F.col("j").alias("topic")).join(items.select("topic", "key"), "topic").groupBy("i", "key").agg(F.min("topic").alias("j"))
        fresh = brought.join(base, ["i", "key"], "left_anti").groupBy("i", "j").agg(F.count("*").alias("fresh"))
        own = base.groupBy("i").agg(F.count("*").alias("own"))
        order = Window.partitionBy("i").orderBy("j")
        grown = run.join(fresh, ["i", "j"], "left").join(own, "i", "left").fillna(0, ["fresh", "own"])
        before = F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, -1))
        grown = grown.withColumn("holds", F.when(F.row_number().over(order) == 1, F.col("size_i")).otherwise(F.col("own") + F.coalesce(before, F.lit(0)))).withColumn("head", F.row_number().over(order) == 1)
        grown = written(grown.select("i", "j", "size_j", "holds", "head"), "grown")
        stop = grown.filter("size_j >= holds").groupBy("i").agg(F.min_by(F.struct("j", "holds", "head", (F.col("size_j") == F.col("holds")).alias("tie")), "j").alias("s")).select("i", F.col("s.j").alias("at"), F.col("s.holds").alias("held"), F.col("s.head").alias("head_"), "s.tie")
        seen = grown.join(stop, "i", "left")
        ends = seen.filter((F.col("j") > F.col("at")) & (F.col("size_j") <= F.col("held"))).groupBy("i").agg(F.min("j").alias("until"))
        seen = seen.join(ends, "i", "left")
        win = F.col("at").isNull() | (F.col("j") < F.col("at"))
        lose = ~F.coalesce("tie", F.lit(False)) & (F.col("j") >= F.col("at")) & (F.col("until").isNull() | (F.col("j") < F.col("until")))
        lose &= F.lit(compat) | (F.col("j") == F.col("at"))  # else i's turn ends when it loses
        decided = seen.select("i", "j", F.when(win, True).when(lose, False).alias("wins"))
        tied = written(stop.filter("tie and head_").select("i", F.col("at").alias("j")), "tied")
        if not tied.isEmpty():
            sides = tied.select(F.col("i").alias("topic")).unionByName(tied.select(F.col("j").alias("topic"))).distinct().join(nodes.select("topic", "merged"), "topic")
            known = sides.filter("merged").join(items, "topic").select("topic", "domain").unionByName(sides.filter("not merged").join(plain, "topic").select("topic", "domain"))
            spread = written(_evenness(known, "topic"), "spread")
            each = lambda s: spread.select(F.col("topic").alias(s), F.col("spread").alias(f"spread_{s}"))
            lead = F.coalesce("spread_i", F.lit(0.0)) - F.coalesce("spread_j", F.lit(0.0))
            judged = tied.join(each("i"), "i", "left").join(each("j"), "j", "left").select("i", "j", F.when(F.abs(lead) > 1e-6, lead > 0).otherwise(True).alias("wins"))
            decided = decided.filter("wins is not null").unionByName(judged)
        decided = written(decided.filter("wins is not null"), "decided")
        wins, losses = decided.filter("wins"), decided.filter("not wins")
        # What a winner takes over comes after its own, later partners after earlier ones; a loser hands over what it holds by then.
        last = lambda rows: rows.groupBy("topic", "key").agg(F.max_by(F.struct("domain", "place"), "turn").alias("v")).select("topic", "key", "v.*")
        winners = wins.select(F.col("i").alias("topic")).distinct()
        taken = wins.select(F.col("i").alias("topic"), F.col("j").alias("from")).join(items.withColumnRenamed("topic", "from"), "from").select("topic", "key", "domain", "place", F.col("from").alias("turn"))
        now = last(items.join(winners, "topic", "left_semi").select("*", F.lit(-1).cast("long").alias("turn")).unionByName(taken))
        lost = written(items.join(winners, "topic", "left_anti").unionByName(now), "items")
        keepers = losses.select(F.col("j").alias("topic"))
        handed = losses.select(F.col("j").alias("topic"), F.col("i").alias("from")).join(lost.withColumnRenamed("topic", "from"), "from").select("topic", "key", "domain", "place", F.lit(0).cast("long").alias("turn"))
        given = last(lost.join(keepers, "topic", "left_semi").select("*", F.lit(-1).cast("long").alias("turn")).unionByName(handed))
        items = written(lost.join(keepers, "topic", "left_anti").unionByName(given), "items")
        changed = winners.unionByName(keepers).distinct()
        sizes = changed.join(items, "topic", "left").groupBy("topic").agg(F.count("key").alias("new_size"))
        owners = wins.select(F.col("j").alias("topic"), F.col("i").alias("by")).unionByName(losses.groupBy(F.col("i").alias("topic")).agg(F.max("j").alias("by")))
        turns = run.select(F.col("i").alias("topic")).distinct().withColumn("turn", F.lit(True))
        told = nodes.join(sizes, "topic", "left").join(owners, "topic", "left").join(turns, "topic", "left")
        nodes = written(told.select("topic", F.coalesce("new_size", "size").alias("size"), (F.col("merged") | F.col("new_size").isNotNull()).alias("merged"), F.coalesce("by", "owner").alias("owner"), (F.col("begun") | F.col("turn").isNotNull()).alias("begun")), "nodes")
        events = written(events.select("i", "j").join(decided.select("i", "j"), ["i", "j"], "left_anti"), "events")
    roots = nodes.filter("owner is null")
    return roots.filter("merged").join(items, "topic").select("topic", F.col("place").alias("ord")).unionByName(roots.filter("not merged").join(plain, "topic").select("topic", "ord"))


def token_sort_ratio(a: str, b: str) -> float:
    """Sequence ratio of the sorted words in lower case, in percent."""
    return 100 * sequence_ratio(sorted_words(a), sorted_words(b))


def fold_summaries(items: list[dict], tokens, overlap: float = 0.50, title: float = 0.86, body: float = 0.88, most: int = 10) -> list[dict]:
    """Kept summaries in order; the first kept one that a summary repeats takes over its sources.

    items: topic_title, summary, sources; ``tokens`` splits a title into telling words.
    """
    _checked(len(items))
    kept: list[dict] = []
    for item in items:
        mine = set(item["sources"] or [])
        for other in kept:
            theirs = set(other["sources"] or [])
            if not mine or not theirs or len(mine & theirs) / min(len(mine), len(theirs)) < overlap:
                continue
            a, b = set(tokens(other["topic_title"])), set(tokens(item["topic_title"]))
            same = len(a & b) / len(a | b) if a and b else 0.0
            low = lambda x, n=None: (x or "")[:n].lower()
            if same >= 0.70 or sequence_ratio(low(other["topic_title"]), low(item["topic_title"])) >= title or sequence_ratio(low(other["summary"], 600), low(item["summary"], 600)) >= body:
                other["sources"] = sorted(mine | theirs)
                other["num_sources"] = len(other["sources"])
                break
        else:
            kept.append(dict(item))
    return kept[:most]


def merge_summaries(summaries: DataFrame, most: int = 10, **limits) -> DataFrame:
    """summaries: ord, topic_title, summary, sources, num_sources. Rows that stay, with united sources."""
    import re

    from topicloom import dims

    stop = set(dims.TITLE_STOP)
    split = lambda t: [w for w in re.sub(r"[^a-z0-9\s]+", " ", (t or "").lower()).split() if len(w) > 2 and w not in stop]

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        items = rows.sort_values("ord").drop(columns="run").to_dict("records")
        for item in items:
            item["sources"] = list(item["sources"]) if item["sources"] is not None else []
        return pd.DataFrame(fold_summaries(items, split, most=most, **limits), columns=["ord", "topic_title", "summary", "sources", "num_sources"])

    rows = summaries.select(F.lit(0).alias("run"), F.col("ord").cast("long"), "topic_title", "summary", "sources", F.col("num_sources").cast("long"))
    return rows.groupBy("run").applyInPandas(fold, "ord long, topic_title string, summary string, sources array<string>, num_sources long")


def _united(*urls) -> dict:
    """URLs that aren't empty, in order, each with what it names; a later one takes the place of an earlier one."""
    out: dict = {}
    for some in urls:
        out |= {u: v for u, v in (some.items() if isinstance(some, dict) else dict.fromkeys(some).items()) if u}
    return out


def fold_dominant(clusters: list[dict], sims: dict[tuple[int, int], float], refreshed, most: int = 25, fresh: float = 0.60, least: float = 0.86) -> dict[int, int]:
    """Cluster to the leader that absorbed it; of the rest, small fresh ones come in order of score.

    clusters: size, today_ratio, score, urls (a list, or a dict with what each names), in input order. A leader must be
    fresh at that moment: ``refreshed(urls)`` measures it anew after each merge, over the united URLs.
    """
    _checked(len(clusters))
    value = lambda c: c["today_ratio"] or 1.0
    ranks = sorted(range(len(clusters)), key=lambda i: -clusters[i]["score"])
    joined: dict[int, int] = {}
    for j in ranks[3:]:
        small = clusters[j]
        if small["size"] <= most and value(small) >= fresh:
            likeness = {i: sims[i, j] for i in ranks[:3] if value(clusters[i]) >= fresh and sims[i, j] >= least}
            if likeness:
                lead = clusters[joined.setdefault(j, max(likeness, key=likeness.get))]
                lead["urls"] = _united(lead["urls"], small["urls"])
                lead["size"], lead["today_ratio"] = len(lead["urls"]), round(refreshed(lead["urls"]), 3)
    return joined


def merge_dominant(articles: DataFrame, clusters: DataFrame, sims: DataFrame) -> DataFrame:
    """cluster_id, ord of the articles that remain after small fresh clusters went into the leading three.

    articles: cluster_id, ord, link (canonical URL; empty: lost when its cluster merges), dated, today; clusters:
    cluster_id, size, today_ratio, matter_score, cluster_ord; sims: lead, cluster_id, sim. Only the three leaders and the
    clusters that may join one are folded, in one group; all others keep their articles.
    """
    may = written(sims.filter(F.col("sim") >= 0.86).select(F.lit(0).alias("run"), "lead", "cluster_id", F.col("sim").cast("double")), "may")
    leads = sims.select(F.col("lead").alias("cluster_id")).distinct()
    some = written(leads.unionByName(may.select("cluster_id")).distinct(), "some")
    left = articles.join(some, "cluster_id", "left_semi").join(clusters.select("cluster_id", "size", F.coalesce("today_ratio", F.lit(1.0)).alias("today_ratio"), "matter_score", "cluster_ord"), "cluster_id").select(F.lit(0).alias("run"), F.col("cluster_id").cast("long"), F.col("ord").cast("long"), "link", "dated", "today", F.col("size").cast("long"), "today_ratio", "matter_score", F.col("cluster_ord").cast("long"))

    def fold(rows: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        heads = rows.drop_duplicates("cluster_id").sort_values(["matter_score", "cluster_ord"], ascending=[False, True], kind="stable")
        names = heads["cluster_id"].tolist()
        own = {name: part.sort_values("ord") for name, part in rows.groupby("cluster_id")}
        found = [
            {"size": size, "today_ratio": ratio, "score": score, "urls": {u: (place, dated, today) for u, place, dated, today in own[name][["link", "ord", "dated", "today"]].itertuples(index=False)}}
            for name, size, ratio, score in heads[["cluster_id", "size", "today_ratio", "matter_score"]].itertuples(index=False)
        ]
        known = {(names.index(a), names.index(b)): s for a, b, s in near[["lead", "cluster_id", "sim"]].itertuples(index=False)}
        every = {(i, j): known.get((i, j), -1.0) for i in range(3) for j in range(3, len(names))}

        def ratio(urls: dict) -> float:
            days = [today for _, dated, today in urls.values() if dated]
            return sum(map(bool, days)) / len(days) if days else 1.0

        joined = fold_dominant(found, every, ratio)
        grown = set(joined.values())
        out = [(names[k], place) for k in range(len(names)) if k not in joined for place in ([p for p, _, _ in found[k]["urls"].values()] if k in grown else own[names[k]]["ord"].tolist())]
        return pd.DataFrame(out, columns=["cluster_id", "ord"]).astype("int64")

    folded = left.groupBy("run").cogroup(may.groupBy("run")).applyInPandas(fold, "cluster_id long, ord long")
    return folded.unionByName(articles.join(some, "cluster_id", "left_anti").select(F.col("cluster_id").cast("long"), F.col("ord").cast("long")))
