"""Operators on article vectors: centroids, cohesion, central articles, tail trims, similar pairs, greedy merges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions import stats, vectors
from topicloom.sources.tables import written

from . import joins, metric, strings


def centroids(rows: DataFrame, *by: str, vector: str = "vector", unit: bool = True) -> DataFrame:
    """Mean vector of each group, of unit length. Means are combined in each task before the shuffle."""
    means = rows.groupBy(*by).agg(vector_to_array(Summarizer.mean(array_to_vector(F.col(vector)))).alias("centroid"))
    return means.withColumn("centroid", vectors.unit(F.col("centroid"))) if unit else means


def similarities(rows: DataFrame, *by: str, vector: str = "vector") -> DataFrame:
    """``rows`` with ``sim``: similarity of each unit vector to its group's centroid."""
    return rows.join(centroids(rows, *by, vector=vector), list(by)).withColumn("sim", vectors.dot(F.col(vector), F.col("centroid"))).drop("centroid")


def unit_rows(articles: DataFrame, embedding: str = "embedding") -> DataFrame:
    """cluster_id, ord, vector (unit length, doubles) of the rows that have one."""
    return articles.filter(F.col(embedding).isNotNull()).select("cluster_id", "ord", vectors.unit(F.col(embedding).cast("array<double>")).alias("vector"))


def cohesion(rows: DataFrame, *by: str, most: int | None = None, lone: float | None = 0.0) -> DataFrame:
    """n, mean_sim, p10_sim, std_sim of each group; ``lone`` stands for all three where a group has one row."""
    if most:
        rows = rows.withColumn("_p", F.row_number().over(Window.partitionBy(*by).orderBy("ord"))).filter(F.col("_p") <= most).drop("_p")
    found = similarities(rows, *by).groupBy(*by).agg(F.count("*").alias("n"), *stats.cohesion(F.col("sim")))
    few = lambda c: F.when(F.col("n") < 2, F.lit(lone).cast("double")).otherwise(F.col(c)).alias(c)
    return found.select(*by, "n", few("mean_sim"), few("p10_sim"), few("std_sim"))


def cohesion_fast(rows: DataFrame, most: int = 18, least: int = 4) -> DataFrame:
    """cluster_id, p10_sim, std_sim over the first ``most`` articles; 1 and 0 for fewer than ``least``."""
    found = cohesion(rows, "cluster_id", most=most)
    few = F.col("n") < least
    return found.select("cluster_id", F.when(few, 1.0).otherwise(F.col("p10_sim")).alias("p10_sim"), F.when(few, 0.0).otherwise(F.col("std_sim")).alias("std_sim"))


def report(rows: DataFrame, least: int = 4, most: int = 18) -> DataFrame:
    """Cohesion report, worst first: similarities of the first ``most`` articles of clusters with ``least`` or more."""
    size = rows.groupBy("cluster_id").agg(F.count("*").alias("articles_in_cluster")).filter(F.col("articles_in_cluster") >= least)
    found = cohesion(rows.join(size.select("cluster_id"), "cluster_id", "left_semi"), "cluster_id", most=most, lone=None)
    score = F.round(0.75 * F.col("p10_sim") + 0.25 * F.col("mean_sim") - 0.5 * F.col("std_sim"), 3)
    return size.join(found, "cluster_id").select("cluster_id", "articles_in_cluster", F.col("n").alias("sampled_articles"), "mean_sim", "p10_sim", "std_sim", F.coalesce(score, F.lit(999.0)).alias("sort_score")).orderBy("sort_score", "cluster_id")


def central(rows: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` articles nearest the centroid, nearest first (later ones first on a tie); a small cluster in its own order.

    Both orders are cut to ``k`` rows of a cluster in each task before they meet.
    """
    size = rows.groupBy("cluster_id").agg(F.count("*").alias("n"))
    sims = similarities(rows, "cluster_id").join(size, "cluster_id")
    own = Window.partitionBy("cluster_id")
    near = sims.filter(F.col("n") > k).withColumn("place", F.row_number().over(own.orderBy(F.desc("sim"), F.desc("ord")))).filter(F.col("place") <= k)
    plain = sims.filter(F.col("n") <= k).withColumn("place", F.row_number().over(own.orderBy("ord"))).filter(F.col("place") <= k)
    return near.unionByName(plain).select("cluster_id", "ord", "sim", "place")


def most_central(rows: DataFrame) -> DataFrame:
    """The one article of each cluster that is nearest the plain mean of its vectors, the first on a tie."""
    met = rows.join(centroids(rows, "cluster_id", unit=False), "cluster_id").withColumn("sim", vectors.cosine(F.col("vector"), F.col("centroid")))
    return met.groupBy("cluster_id").agg(F.max_by("ord", F.struct(F.round("sim", 9), -F.col("ord"))).alias("ord"))


#: Most articles that a trim takes off a cluster.
MOST_REMOVED = 8


def _worst(rows: DataFrame, most: int = MOST_REMOVED) -> DataFrame:
    """cluster_id, ord, vector, worst: the ``most`` articles farthest from each centroid, cut in each task."""
    order = Window.partitionBy("cluster_id").orderBy("sim", "ord")
    return similarities(rows, "cluster_id").withColumn("worst", F.row_number().over(order)).filter(F.col("worst") <= most).select("cluster_id", "ord", "vector", "worst")


def trim_candidates(rows: DataFrame, least: int = 6, share: float = 0.2) -> DataFrame:
    """Cohesion of each cluster without its k worst articles, k = 0 and up: cluster_id, n, k, mean_sim, p10_sim, std_sim.

    A centroid without some articles is the cluster's sum less theirs, so vectors are not copied for each k.
    """
    sums = rows.groupBy("cluster_id").agg(F.count("*").alias("n"), vector_to_array(Summarizer.sum(array_to_vector(F.col("vector")))).alias("sum")).filter(F.col("n") >= least)
    far = _worst(rows.join(sums.select("cluster_id"), "cluster_id", "left_semi"))
    listed = far.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("worst", "vector"))), lambda p: p["vector"]).alias("far"))
    most = F.greatest(F.lit(0), F.least(F.lit(MOST_REMOVED), F.ceil(F.col("n") * share).cast("int"), (F.col("n") - least).cast("int")))
    without = lambda k: F.aggregate(F.slice("far", 1, k), F.col("sum"), lambda s, v: F.zip_with(s, v, lambda a, b: a - b))
    centres = sums.join(listed, "cluster_id").select("cluster_id", "n", F.transform(F.sequence(F.lit(0), most), lambda k: vectors.unit(without(k))).alias("centres"))
    met = rows.join(centres, "cluster_id").join(far.select("cluster_id", "ord", "worst"), ["cluster_id", "ord"], "left")
    sims = F.transform("centres", lambda c: vectors.dot(F.col("vector"), c))
    tried = met.select("cluster_id", "n", F.coalesce("worst", F.lit(MOST_REMOVED + 1)).alias("worst"), F.posexplode(sims).alias("k", "sim")).filter(F.col("worst") > F.col("k"))
    return tried.groupBy("cluster_id", "n", "k").agg(*stats.cohesion(F.col("sim")))


def trims(candidates: DataFrame, cautious: bool = True, floor: int = 6) -> DataFrame:
    """How many articles to take off each cluster: the best (then smallest) k that helps enough, else 0.

    ``cautious``: clusters under ten articles must look doubly bad first. ``floor``: smaller clusters are left alone.
    """
    base = candidates.filter("k = 0").select("cluster_id", F.col("mean_sim").alias("m0"), F.col("p10_sim").alias("p0"), F.col("std_sim").alias("s0"))
    flagged = ((F.col("p0") < 0.55) | (F.col("s0") > 0.13)) & (F.col("n") >= floor)
    if cautious:
        flagged &= (F.col("n") >= 10) | ((F.col("p0") < 0.40) & (F.col("s0") > 0.18))
    better = (F.col("p10_sim") - F.col("p0") >= 0.04) | (F.col("s0") - F.col("std_sim") >= 0.03)
    score = 0.75 * F.col("p10_sim") + 0.25 * F.col("mean_sim") - 0.5 * F.col("std_sim")
    best = candidates.join(base, "cluster_id").filter((F.col("k") > 0) & flagged & better).groupBy("cluster_id").agg(F.max_by("k", F.struct(F.round(score, 9), -F.col("k"))).alias("removed"))
    return base.select("cluster_id").join(best, "cluster_id", "left").fillna(0, ["removed"])


def trimmed(rows: DataFrame, cautious: bool = True, floor: int = 6) -> DataFrame:
    """cluster_id, ord of the articles that stay."""
    gone = _worst(rows).join(trims(trim_candidates(rows), cautious, floor), "cluster_id").filter(F.col("worst") <= F.col("removed"))
    return rows.select("cluster_id", "ord").join(gone.select("cluster_id", "ord"), ["cluster_id", "ord"], "left_anti")


def packed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``unit``, the bytes of the array of doubles ``v``, in its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            flat, at = v.values.to_numpy(zero_copy_only=False), v.offsets.to_numpy()
            units = pa.array([flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in batch.schema.names if c != "v"], units], names=[*[c for c in batch.schema.names if c != "v"], "unit"])

    kept = [f for f in rows.schema if f.name != "v"]
    return rows.mapInArrow(run, ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in kept], "unit binary"]))


def similar_pairs(rows: DataFrame, least: float, key: str = "ord", vector: str = "vector", block: int = 1024) -> DataFrame:
    """(i, j, sim) with i < j for all unit vectors (or zero vectors) at least so similar.

    Vectors so similar are within r = sqrt(2 - 2 * least). A tree of pivots (``metric.pivot_cells``) deals them to cells of about
    ``block`` vectors, so that each pair meets where its smaller key is at home. A cell is joined as blocks by products of ``block``
    rows at a time, also one that can't be divided: vectors without structure, or a low ``least``, leave cells whole. Vectors of a cell
    go to a bounded number of its blocks (see ``metric.blocks``), those at home meet each other once.
    """
    radius = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-9
    slim = packed(rows.select(F.lit("0").alias("cell"), F.col(key).cast("long").alias("node"), F.col(vector).cast("array<double>").alias("v")))
    none = (lambda x: (x * x).sum(axis=1) == 0) if least > 0 else None
    cells = metric.pivot_cells(slim, radius, block, alone=none)
    sized = joins.with_counts(cells, "cell", _n=F.count("*"), _v=F.sum(1 - F.col("home").cast("int")))
    placed = sized.withColumn("parts", metric.blocks(F.col("_n"), block)).withColumn("part", F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int"))
    # Rows at home in blocks p < q meet there; in q, p only p's visitors are looked for.
    after = F.when(F.col("_v") > 0, 0).otherwise(F.col("part"))
    before = F.when(F.col("home"), F.col("part")).otherwise(F.col("parts") - 1)
    left = placed.filter("home").select("cell", F.col("part").alias("p"), F.explode(F.sequence(after, F.col("parts") - 1)).alias("q"), F.lit(True).alias("first"), "home", "node", "unit")
    right = placed.select("cell", F.explode(F.sequence(F.lit(0), before)).alias("p"), F.col("part").alias("q"), F.lit(False).alias("first"), "home", "node", "unit")

    def compare(table: pa.Table) -> pa.Table:
        first = table["first"].to_numpy()
        own = table["home"].to_numpy()[~first]
        ids, x = table["node"].to_numpy(), metric.matrix(table["unit"])
        mine, theirs, y = ids[first], ids[~first], np.ascontiguousarray(x[~first].T)
        x = x[first]
        once = own if table.num_rows and table["p"][0].as_py() != table["q"][0].as_py() else np.zeros(len(own), bool)  # pairs that meet nowhere else
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for lo in range(0, len(mine), block):
            for at in range(0, len(theirs), 4 * block):
                sims = x[lo : lo + block] @ y[:, at : at + 4 * block]
                i, j = np.nonzero(sims >= least)
                a, b = mine[lo + i], theirs[at + j]
                fine = (a < b) | (once[at + j] & (a != b))
                found.append((np.minimum(a, b)[fine], np.maximum(a, b)[fine], sims[i, j][fine]))
        i, j, sim = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"i": i, "j": j, "sim": sim})

    return left.unionByName(right).groupBy("cell", "p", "q").applyInArrow(compare, "i long, j long, sim double")


def alike_titles(rows: DataFrame, least: float = 80.0, key: str = "ord", title: str = "title", block: int = strings.BLOCK) -> DataFrame:
    """(i, j, ratio) with i < j for titles whose sorted words are so alike, in percent (see ``strings``)."""
    return strings.alike_rows(rows, least, key, title, block)


def nearest(rows: DataFrame) -> DataFrame:
    """Similarity of each article to the nearest other one of its cluster's rows. Meant for the first few of a cluster."""
    a = rows.select("cluster_id", "ord", F.col("vector").alias("a"))
    b = rows.select("cluster_id", F.col("ord").alias("other"), F.col("vector").alias("b"))
    return a.join(b, "cluster_id").filter("ord <> other").groupBy("cluster_id", "ord").agg(F.max(vectors.dot(F.col("a"), F.col("b"))).alias("nn_sim"))


def greedy_merge(nodes: DataFrame, pairs: DataFrame, key: str = "ord") -> DataFrame:
    """node, topic: in order, an unclaimed node founds a topic and claims its unclaimed later neighbours.

    The founders are the lexicographically first maximal independent set, found in rounds: a node founds once no earlier
    neighbour is undecided; neighbours of founders are claimed. Each claimed node joins its first founder.
    """
    pairs = written(pairs.select("i", "j"), "pairs")
    open_ = written(nodes.select(F.col(key).alias("node")), "open")
    live, founders = pairs, None
    while not open_.isEmpty():
        new = written(open_.join(live.select(F.col("j").alias("node")), "node", "left_anti"), "founders")
        founders = new if founders is None else founders.unionByName(new)
        claimed = live.join(new.select(F.col("node").alias("i")), "i", "left_semi").select(F.col("j").alias("node"))
        open_ = written(open_.join(new, "node", "left_anti").join(claimed, "node", "left_anti"), "open")
        live = written(live.join(open_.select(F.col("node").alias("i")), "i", "left_semi").join(open_.select(F.col("node").alias("j")), "j", "left_semi"), "live")
    if founders is None:
        return nodes.select(F.col(key).alias("node"), F.col(key).alias("topic")).limit(0)
    owner = pairs.join(founders.select(F.col("node").alias("i")), "i", "left_semi").groupBy(F.col("j").alias("node")).agg(F.min("i").alias("topic"))
    own = founders.select("node", F.col("node").alias("topic"))
    return own.unionByName(owner.join(founders, "node", "left_anti"))


#: Centres up to which an assignment broadcasts them all; more are found by ``metric.nearest``, with the same result.
FEW_CENTRES = 4096


def _assigned(points: DataFrame, centres: DataFrame, k: int, few: int) -> DataFrame:
    """node, unit, centre (the nearest of the ``k`` centres), moved. ``points`` may have the centre of the round before."""
    before = "centre" in points.columns
    if k > few:
        found = metric.nearest(points, centres).select("node", F.col("centre").alias("now"))
        moved = F.col("centre") != F.col("now") if before else F.lit(True)
        return points.join(found, "node").select("node", "unit", F.col("now").alias("centre"), moved.alias("moved"))
    drawn = centres.orderBy("centre").collect()  # ``few`` at most
    shared = points.sparkSession.sparkContext.broadcast((np.array([r["centre"] for r in drawn]), metric.matrix(pa.array([r["unit"] for r in drawn], pa.binary()))))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, at = shared.value
        for batch in batches:
            now = names[metric.closest(metric.matrix(batch.column("unit")), at)[0]] if batch.num_rows else np.zeros(0, np.int64)
            moved = now != batch.column("centre").to_numpy() if before else np.ones(len(now), bool)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("unit"), pa.array(now), pa.array(moved)], names=["node", "unit", "centre", "moved"])

    return points.mapInArrow(look, "node long, unit binary, centre long, moved boolean")


def kmeans(rows: DataFrame, k: int | None = None, seed: int = 42, rounds: int = 20, few: int = FEW_CENTRES) -> DataFrame:
    """cluster_id, ord by k-means on raw vectors (ord, vector); k is a tenth of the rows, at least 5.

    It begins with the k different vectors whose md5 of seed and smallest ord is smallest, numbered in that order. Each round
    gives every vector its nearest centre (the smallest of several) and moves each centre to the mean of its vectors; one that
    has none stays. Rounds end when no vector moves, or after ``rounds``. There are no more clusters than different vectors.
    """
    points = written(packed(rows.select(F.col("ord").cast("long").alias("node"), F.col("vector").cast("array<double>").alias("v"))), "points")
    kinds = written(points.groupBy("unit").agg(F.min("node").alias("first")), "kinds")
    n, different = points.count(), kinds.count()
    if n == 0:
        return rows.select(F.lit(0).alias("cluster_id"), "ord").limit(0)
    k = min(k or max(5, n // 10), different)
    order = [F.md5(F.concat(F.lit(f"{seed}:"), F.col("first").cast("string")).cast("binary")), F.col("first")]
    centres = written(joins.numbered(kinds, order, "centre").filter(F.col("centre") < k).select("centre", "unit"), "centres")
    placed = points
    for r in range(rounds):
        placed = written(_assigned(placed, centres, k, few), "placed")
        if r + 1 == rounds or placed.filter("moved").isEmpty():
            break
        centres = written(_means(placed, centres), "centres")
    return placed.select(F.col("centre").cast("int").alias("cluster_id"), F.col("node").alias("ord"))


def _means(placed: DataFrame, centres: DataFrame) -> DataFrame:
    """centre, unit: the mean of each centre's vectors, summed up in each task first; centres without any stay."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                names, at = np.unique(batch.column("centre").to_numpy(), return_inverse=True)
                x = metric.matrix(batch.column("unit"))
                total = np.zeros((len(names), x.shape[1]))
                np.add.at(total, at, x)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.bincount(at)), pa.array([t.tobytes() for t in total], pa.binary())], names=["centre", "n", "sum"])

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by centre: the last centre of a batch may go on in the next."""
        shown = lambda names, n, total: pa.RecordBatch.from_arrays([pa.array(names), pa.array([t.tobytes() for t in total / n[:, None]], pa.binary())], names=["centre", "unit"])
        last: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            names, at = np.unique(batch.column("centre").to_numpy(), return_inverse=True)
            x = metric.matrix(batch.column("sum"))
            n, total = np.bincount(at, batch.column("n").to_numpy()), np.zeros((len(names), x.shape[1]))
            np.add.at(total, at, x)
            if last is not None and last[0][0] == names[0]:
                n[0] += last[1][0]
                total[0] += last[2][0]
            elif last is not None:
                yield shown(*last)
            if len(names) > 1:
                yield shown(names[:-1], n[:-1], total[:-1])
            last = names[-1:], n[-1:], total[-1:]
        if last is not None:
            yield shown(*last)

    parts = placed.select("centre", "unit").mapInArrow(sums, "centre long, n long, sum binary")
    moved = parts.repartition("centre").sortWithinPartitions("centre").mapInArrow(means, "centre long, unit binary")
    return centres.join(moved.withColumnRenamed("unit", "moved"), "centre", "left").select("centre", F.coalesce("moved", "unit").alias("unit"))


def linked(nodes: DataFrame, both: DataFrame) -> DataFrame:
    """ord, label: the smallest node that each node reaches. nodes: ord; both: i, j in both directions, between nodes.

    Labels go along links and jump to their label's label, so rounds grow with the logarithm of the longest chain.
    """
    label = written(nodes.select("ord", F.col("ord").alias("label")), "labels")
    while True:
        near = both.join(label, both["i"] == label["ord"]).groupBy(F.col("j").alias("ord")).agg(F.min("label").alias("m"))
        moved = label.join(near, "ord", "left").select("ord", F.least("label", F.coalesce("m", "label")).alias("label"))
        new = written(moved.join(moved.select(F.col("ord").alias("label"), F.col("label").alias("next")), "label").select("ord", F.col("next").alias("label")), "labels")
        if new.join(label.withColumnRenamed("label", "old"), "ord").filter("label <> old").isEmpty():
            return new
        label = new


def dbscan(rows: DataFrame, reach: float = 0.55, least: int = 3) -> DataFrame:
    """ord, cluster (its smallest core's ord; -1 is noise) by density: cosine distance at most ``reach``, ``least`` points.

    Cores are joined along core pairs; a border point takes its smallest core's cluster.
    """
    pairs = written(similar_pairs(rows, 1 - reach), "near")
    both = pairs.select("i", "j").unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j")))
    cores = written(both.groupBy(F.col("i").alias("ord")).agg((F.count("*") + 1).alias("n")).filter(F.col("n") >= least).select("ord"), "cores")
    if least <= 1:
        cores = rows.select("ord")
    links = written(both.join(cores.select(F.col("ord").alias("i")), "i", "left_semi"), "core_links")
    inner = written(links.join(cores.select(F.col("ord").alias("j")), "j", "left_semi"), "core_pairs")
    label = linked(cores, inner)
    border = links.join(label, links["i"] == label["ord"]).groupBy(F.col("j").alias("ord")).agg(F.min("label").alias("near"))
    every = rows.select("ord").join(label, "ord", "left").join(border, "ord", "left")
    return every.select("ord", F.coalesce("label", "near", F.lit(-1)).cast("long").alias("cluster"))


def _two_lumps(x: np.ndarray, rounds: int = 5, least: int = 4, closer: float = 0.10, steadier: float = 0.03) -> bool:
    """Whether a partition of the unit rows in two is that much closer at its tenth percentile and steadier than the whole.

    The partition: cosine two-means. A part's direction is its row sum, so a round is one product of a 2 x n membership
    matrix with the rows; the first directions are the row least like the first row, and the row least like that one.
    """
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-12)
    gram = x @ x.T
    far = int(gram[0].argmin())
    member = np.zeros((2, len(x)))
    member[[0, 1], [far, int(gram[far].argmin())]] = 1
    for _ in range(rounds):
        near = x @ unit(member @ x).T
        second = near[:, 1] > near[:, 0]
        member = np.stack([~second, second]).astype(float)
        if second.all() or not second.any():
            return False
    if member.sum(axis=1).min() < least:
        return False
    tails = []
    for part in (np.ones(len(x)), *member):
        sims = x[part > 0] @ unit(part @ x)
        tails.append((np.percentile(sims, 10), sims.std()))
    share = member.sum(axis=1) / len(x)
    (p0, s0), after = tails[0], share @ np.array(tails[1:])
    return bool(after[0] - p0 >= closer and s0 - after[1] >= steadier)


def thematic(rows: DataFrame, least: int = 12, most: int = 18) -> DataFrame:
    """cluster_id, lumps: whether the first ``most`` articles are really two topics. Each group has ``most`` rows at most."""
    own = Window.partitionBy("cluster_id")
    first = rows.withColumn("n", F.count("*").over(own)).withColumn("p", F.row_number().over(own.orderBy("ord"))).filter(F.col("p") <= most)

    def look(table: pa.Table) -> pa.Table:
        order = np.argsort(table["p"].to_numpy())
        x = np.array(table["vector"].to_pylist(), np.float64)[order]
        fine = table["n"][0].as_py() >= least and len(x) >= 10 and _two_lumps(x)
        return pa.table({"cluster_id": table["cluster_id"][:1], "lumps": pa.array([bool(fine)])})

    return first.select(F.col("cluster_id").cast("long"), "n", "p", "vector").groupBy("cluster_id").applyInArrow(look, "cluster_id long, lumps boolean")


def _leaders(clusters: DataFrame) -> DataFrame:
    """The three clusters of the highest score, with ``tr``, their freshness."""
    tr = stats.today_value(F.col("today_ratio"))
    return clusters.orderBy(F.desc("matter_score"), "cluster_ord").limit(3).withColumn("tr", tr)


def dominant_merge(clusters: DataFrame, titles: DataFrame, most: int = 25, fresh: float = 0.60, least: float = 0.86) -> DataFrame:
    """cluster_id, into: small fresh clusters and the leading cluster (of the top three) that they are most like.

    clusters: cluster_id, size, today_ratio, matter_score, cluster_ord; titles: cluster_id, vector (unit). The three
    leaders are broadcast. Leaders' freshness is the one before any merge (``folds.merge_dominant`` is the sequential form).
    """
    tr = stats.today_value(F.col("today_ratio"))
    rank = _leaders(clusters)
    leads = rank.join(titles, "cluster_id").filter(F.col("tr") >= fresh).select(F.col("cluster_id").alias("into"), F.col("vector").alias("lead"), "matter_score", "cluster_ord")
    small = clusters.filter((F.col("size") <= most) & (tr >= fresh)).join(rank.select("cluster_id"), "cluster_id", "left_anti").join(titles, "cluster_id").select("cluster_id", "vector")
    met = small.join(F.broadcast(leads), vectors.dot(F.col("vector"), F.col("lead")) >= least)
    sim = vectors.dot(F.col("vector"), F.col("lead"))
    return met.groupBy("cluster_id").agg(F.max_by("into", F.struct(F.round(sim, 9), "matter_score", -F.col("cluster_ord"))).alias("into"))


def leader_similarities(clusters: DataFrame, titles: DataFrame) -> DataFrame:
    """lead, cluster_id, sim: each cluster beside the three leaders, which are broadcast."""
    rank = _leaders(clusters).select("cluster_id")
    leads = rank.join(titles, "cluster_id").select(F.col("cluster_id").alias("lead"), F.col("vector").alias("lead_vector"))
    others = titles.join(rank, "cluster_id", "left_anti")
    return others.join(F.broadcast(leads)).select("lead", "cluster_id", vectors.dot(F.col("vector"), F.col("lead_vector")).alias("sim"))


def as_provider(df: DataFrame, text: str, encode, dims_: int) -> DataFrame:
    """``df`` with ``vector``: ``encode(texts) -> matrix`` on Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = np.asarray(encode([t or "" for t in batch.column(text).to_pylist()]), np.float32).reshape(batch.num_rows, dims_)
            flat = pa.array(matrix.reshape(-1), pa.float32())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, matrix.size + 1, dims_, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "vector"])

    from pyspark.sql import types as T

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))]))

