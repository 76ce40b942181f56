"""Sharding by extendible hashing.

A row's hash has 32 bits of its key, then 30 bits of its text. The directory starts with the whole table as one bucket;
a bucket over the byte limit splits on the next bit, and only such buckets do, until every shard fits. The directory is
found on sums by hash prefix, from the finest depths up and only while buckets fit, so neither rows nor sums come to the
driver, and depths far above the shards are not looked at. Rows that share all 62 bits (one key and one text, repeated) and still exceed the limit go on splitting by 62 bits of their place in the input.
A row that alone exceeds the limit is a shard of its own.

A shard's name is depth:prefix of its directory entry (and the same for the second hash where there is one). Defined
cases: a null text has no bytes; a null key is hashed as the word null; an empty table gives an empty result. Other
columns travel in a struct, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 62

#: A prefix of over cells / HUBS cells is joined by broadcast; a table has fewer than depths * HUBS of them.
HUBS, LEAST_HUB = 5_000, 128

#: Depths whose sums are made in one pass.
WINDOW = 8


def _bits(value: Column) -> Column:
    """32 bits of a value's md5."""
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, 8), 16, 10).cast("long")


def _walk(cells: DataFrame, reach: int, low: int, limit: int) -> tuple[DataFrame, int]:
    """((group, depth, q, sb) of the buckets that fit, the least depth looked at).

    Sums of WINDOW depths at a time, from the finest up. Above a bucket over the limit none fits, so the walk ends with
    the first window at whose top nothing fits.
    """
    found, top = [], reach + 1
    while top > low:
        top, below = max(low, top - WINDOW), top - 1
        depths = cells.select("group", "p", F.explode(F.sequence(F.lit(top), F.lit(below))).alias("depth"), "b", "n")
        sums = depths.groupBy("group", "depth", F.expr(f"shiftright(p, {reach} - depth)").alias("q")).agg(F.sum("b").alias("sb"), F.sum("n").alias("sn"))
        found.append(common.written(sums.filter((F.col("sb") <= limit) | (F.col("sn") == 1)).select("group", "depth", "q", "sb"), "fits"))
        if found[-1].filter(F.col("depth") == top).isEmpty():
            break
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every, top


def _split(rows: DataFrame, limit: int, step: int) -> DataFrame:
    """(group, h) of ``rows`` to (depth, shard_bytes): the first depth at which the bucket of h in its group fits."""
    total = rows.groupBy("group").agg(F.sum("n_bytes").alias("b")).agg(F.max("b")).first()[0] or 0
    reach = min(BITS, max(1, int(total // limit).bit_length()) + step)
    low, done, open_ = 0, None, rows.groupBy("group", "h").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
    while True:
        held = common.written(open_, "open")
        cells = common.written(held.groupBy("group", F.shiftright("h", BITS - reach).alias("p")).agg(F.sum("b").alias("b"), F.sum("n").alias("n")), "cells")
        fits, first = _walk(cells, reach, low, limit)
        # A cell's bucket is the first of its prefixes that fits.
        at = cells.select("group", "p", F.explode(F.sequence(F.lit(first), F.lit(reach))).alias("depth")).withColumn("q", F.expr(f"shiftright(p, {reach} - depth)"))
        best = _joined(at, fits, cells.count()).groupBy("group", "p").agg(F.min(F.struct("depth", "sb")).alias("at"))
        leaf = held.select("group", "h", F.shiftright("h", BITS - reach).alias("p")).join(best, ["group", "p"], "left").select("group", "h", F.col("at.depth").alias("depth"), F.col("at.sb").alias("shard_bytes"))
        leaf = common.written(leaf, "leaves")
        found = leaf.filter("depth is not null")
        done = found if done is None else done.unionByName(found)
        missing = leaf.filter("depth is null")
        if reach == BITS or missing.isEmpty():
            return done.unionByName(missing)
        open_ = held.join(missing.select("group", "h"), ["group", "h"], "left_semi")
        low, reach = reach + 1, min(BITS, reach + 3 * step)


def _joined(at: DataFrame, fits: DataFrame, n: int) -> DataFrame:
    """``at`` joined to ``fits`` by group, depth and q; prefixes of over n / HUBS cells, fit or not, by broadcast."""
    keys = ["group", "depth", "q"]
    hubs = at.groupBy(*keys).agg(F.count("*").alias("c")).filter(F.col("c") > max(LEAST_HUB, n // HUBS)).join(fits.select(*keys, "sb"), keys, "left")
    hubs = hubs.select(*[F.col(k).alias(f"hub_{k}") for k in keys], F.col("sb").alias("hub_sb"))
    marked = at.join(F.broadcast(hubs), [F.col(k) == F.col(f"hub_{k}") for k in keys], "left")
    rest = marked.filter("hub_q is null").select(*keys, "p").join(fits.select(*keys, "sb"), keys)
    return marked.filter("hub_sb is not null").select("group", "p", "depth", F.col("hub_sb").alias("sb")).unionByName(rest.select("group", "p", "depth", "sb"))


def shards(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text", step: int = 4) -> DataFrame:
    """``row`` (all columns of ``docs``), n_bytes, shard, depth, shard_bytes."""
    h = F.shiftleft(_bits(F.coalesce(F.col(key).cast("string"), F.lit("null"))), 30).bitwiseOR(F.shiftright(_bits(F.coalesce(F.col(text), F.lit(""))), 2))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"), h.alias("h"), F.lit("").alias("group"))
    name = lambda: F.concat_ws(":", F.col("depth"), F.expr(f"shiftright(h, {BITS} - depth)"))
    leaves = _split(rows.select("group", "h", "n_bytes"), limit, step)
    placed = rows.drop("group").join(leaves.drop("group"), "h")
    fit = placed.filter("depth is not null").select("row", "n_bytes", name().alias("shard"), "depth", "shard_bytes")
    if leaves.filter("depth is null").isEmpty():
        return fit
    # Equal keys and texts beyond the limit: by their place in the input. The table is written first, so places hold.
    left = placed.filter("depth is null").select("row", "n_bytes", F.concat(F.lit(f"{BITS}:"), F.col("h").cast("string")).alias("group"), F.shiftright(F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << 63) - 1)), 1).alias("h"))
    left = common.written(left, "repeats")
    more = _split(left.select("group", "h", "n_bytes"), limit, step).withColumn("depth", F.coalesce("depth", F.lit(BITS)))
    again = left.join(more, ["group", "h"]).select("row", "n_bytes", F.concat_ws("/", "group", name()).alias("shard"), (F.col("depth") + BITS).alias("depth"), "shard_bytes")
    return fit.unionByName(again)


def write_shards(docs: DataFrame, path: str, limit: int, **options) -> None:
    """Writes the rows as one folder of Parquet files per shard.

    The folders' column is ``_shard``, with further underscores if ``docs`` has a column of that name. Nulls, empty texts
    and repeated rows are written as they are; an empty table gives a folder without shards.
    """
    name = common.free_name(docs, "_shard")
    shards(docs, limit, **options).select("row.*", F.col("shard").alias(name)).repartition(name).write.partitionBy(name).parquet(path)
