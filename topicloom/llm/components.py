"""Connected components of an edge table by alternating star rounds.

Each round hangs every larger neighbour on a node's smallest neighbour (large star), then every smaller one (small star).
Minima are partial aggregates; they go back to the edges by a join, where a node with many edges is a hub: hubs (at most
2 * HUBS of them, whatever the table's size) are joined by a broadcast of their minima, so no join key has more than
max(LEAST_HUB, edges / HUBS) rows. A round's result is a written table, in as many parts as its edges need. Rounds end
when the edges are separate stars; they grow with the logarithm of the longest chain, and edges that are stars from the
start need none.

Defined cases: edges with a null end or equal ends are left out, repeated edges count once; without edges there are no
nodes; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Edges that one task of a round writes; hubs are broadcast: fewer than 2 * HUBS nodes have over edges / HUBS edges.
PART, HUBS, LEAST_HUB = 500_000, 5_000, 128


def _looked(edges: DataFrame) -> tuple[int, bool, int]:
    """How many edges there are; whether they are separate stars: no node hangs on two, none that hangs is hung on; most edges of a node."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("c"), F.lit(0).alias("p")), F.struct(F.col("v").alias("node"), F.lit(0).alias("c"), F.lit(1).alias("p")))).alias("e")).select("e.*")
    nodes = ends.groupBy("node").agg(F.sum("c").alias("c"), F.max("p").alias("p"), F.count("*").alias("d"))
    row = nodes.agg(F.sum("c").alias("n"), F.max(F.col("c") + F.col("p")).alias("most"), F.max("d").alias("d")).first()
    return row["n"] or 0, (row["most"] or 0) <= 1, row["d"] or 0


def hub_limit(n: int) -> int:
    """Rows of a key beyond which it is a hub, among ``n`` rows."""
    return max(LEAST_HUB, n // HUBS)


def hub_join(rows: DataFrame, values: DataFrame, key: str, limit: int) -> DataFrame:
    """``rows`` joined to ``values`` by ``key``; keys of over ``limit`` rows by broadcast, the others by their key.

    values: key, ``c`` (at least as many rows as the key has in ``rows``), and what is wanted.
    """
    values = common.written(values, "values")
    wanted = [c for c in values.columns if c not in (key, "c")]
    top = values.filter(F.col("c") > limit).select(F.col(key).alias("_hub"), *[F.col(c).alias(f"_hub_{c}") for c in wanted])
    marked = rows.join(F.broadcast(top), F.col(key) == F.col("_hub"), "left")
    rest = marked.filter("_hub is null").select(*rows.columns).join(values.filter(F.col("c") <= limit).drop("c"), key)
    return marked.filter("_hub is not null").select(*rows.columns, *[F.col(f"_hub_{c}").alias(c) for c in wanted]).unionByName(rest.select(*rows.columns, *wanted))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node) for each node of an edge between two different nodes."""
    now = common.written(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    n, stars, most = _looked(now)
    tasks = edges.sparkSession.sparkContext.defaultParallelism
    while not stars:
        limit = hub_limit(n)
        hubs = most > limit  # a node has no more edges after the large star than before it
        meet = (lambda rows, minima: hub_join(rows, minima, "u", limit)) if hubs else lambda rows, minima: rows.join(minima.drop("c"), "u")
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")).select("u", F.least("u", "m").alias("m"), "c")
        large = meet(now.select(F.col("v").alias("u"), F.col("u").alias("v")), low).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = common.written(large, "large") if hubs else large
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
        small = meet(large, low).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        small = common.written(small.coalesce(max(tasks, n // PART)), "edges")
        common.drop_table(now)
        now = small
        n, stars, most = _looked(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
