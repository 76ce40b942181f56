"""Near-duplicate documents by one-permutation MinHash with optimal densification.

1. A document is its set of distinct 5-word shingles. Equal sets are one class from the start, whatever their number.
2. One hash of each shingle fills 128 bins with their minima; empty bins copy from bins drawn by a hash of bin and try
   (optimal densification). 42 bands of 3 bins make buckets: a pair of similarity 0.75 misses all with about 1e-10.
3. Each bucket is a star: every class is compared with the bucket's first class only, on full sets.
4. Links give components. Where a bucket still holds several components, its classes are compared with those of other
   components, unless their sizes, or the shingles that no other component has, show that they can't be linked. This is
   done on full sets, between sets of like size, in blocks of bounded size that count shared shingles by a matrix product
   and return only which components a link joins. So no link that a bucket shows is lost, and pairs are never made as rows.

Defined cases: null, empty and blank texts have an empty set and link with nothing; a text of fewer than five words has
one shingle, the whole sequence; equal rows are equal sets. A null id is never the smallest of a component that has
another; rows that repeat an id are each returned. ``kept`` says doc_id = component_id, so it is null for a null id and true
for each row that repeats a kept id, while ``near_distinct`` keeps one row of a component. Other columns travel in a struct.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import components, hub_join, hub_limit

BANDS, ROWS = 42, 3
BINS = 128
WORDS = 5

_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - (BINS.bit_length() - 1))


def shingle_sets(body: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    low = common.LOWER[body]
    starts, ends, first = common.words(low, offsets, _WORD)
    hashes = common.word_hashes(low, starts, ends)
    grams = common.shingle_hashes(hashes, k)
    out = []
    for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if j - i >= k:
            found = np.sort(grams[i : j - k + 1])
            out.append(found[np.concatenate([[True], found[1:] != found[:-1]])])
        elif j > i:
            whole = common.shingle_hashes(hashes[i:j], j - i)
            out.append(common.mix(whole + np.uint64(j - i)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Bin minima of each set, densified: sets x bins. A row of an empty set means nothing."""
    sig = np.zeros((len(sets), BINS), np.uint64)
    filled = np.zeros((len(sets), BINS), bool)
    for row, found in enumerate(sets):
        if len(found):
            at = np.searchsorted(found, _EDGES)
            filled[row] = np.append(at[1:], len(found)) > at
            sig[row] = found[np.minimum(at, len(found) - 1)]
    done = filled.copy()
    bins = np.arange(BINS, dtype=np.uint64)
    tries = 0
    todo = np.flatnonzero(~done.all(axis=1) & filled.any(axis=1))
    while len(todo):
        if tries < 4096:
            source = (common.mix(bins + np.uint64(BINS * (tries + 1))) % np.uint64(BINS)).astype(np.int64)
        else:  # every remaining bin meets every other in turn
            source = (np.arange(BINS) + tries) % BINS
        take = ~done[todo] & filled[todo][:, source]
        rows, cols = np.nonzero(take)
        # A copied minimum is told apart from the bin's own by the bin it came from.
        sig[todo[rows], cols] = sig[todo[rows], source[cols]]
        done[todo[rows], cols] = True
        tries += 1
        todo = todo[~done[todo].all(axis=1)]
    return sig


def bands(sig: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key for each band, different between bands."""
    out = np.zeros((len(sig), BANDS), np.uint64)
    for r in range(ROWS):
        out = common.mix(out * np.uint64(common.BASE) + sig[:, r : BANDS * ROWS : ROWS])
    return common.mix(out + np.arange(BANDS, dtype=np.uint64)[None, :])


def _prepared(docs: DataFrame, text: str) -> DataFrame:
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("row_id"))
    schema = T.StructType([*keyed.schema.fields, *T._parse_datatype_string("n_shingles long, print binary, bands array<long>").fields])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        for batch in batches:
            texts = batch.column(0).field(text)
            body, offsets = common.buffers(texts)
            for i, j in common.slices(offsets, 1 << 20):
                sets = shingle_sets(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                keys = bands(signatures(sets)).view(np.int64)
                sizes = [len(s) for s in sets]
                prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * (j - i) + 1, BANDS, dtype=np.int32)), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), lists], names=schema.names)

    return common.written(keyed.mapInArrow(sign, schema), "signatures")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, both, na, nb: sizes of the full sets and of what they share. texts: node, text."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    held = common.written(texts.join(nodes, "node", "left_semi"), "texts")
    joined = pairs.join(held.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").join(held.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        for batch in batches:
            (left, at), (right, bt) = common.buffers(batch.column(2)), common.buffers(batch.column(3))
            last: tuple[int | None, np.ndarray | None] = (None, None)
            for i, j in common.slices(at + bt, 1 << 20):
                keys = batch.column(0).slice(i, j - i).to_pylist()
                new = [r for r in range(j - i) if r == 0 and keys[0] != last[0] or r and keys[r] != keys[r - 1]]
                found = iter(shingle_sets(*common.buffers(batch.column(2).slice(i, j - i).take(pa.array(new, pa.int64())))))
                fresh, out = set(new), []
                for r, other in enumerate(shingle_sets(right[bt[i] : bt[j]], bt[i : j + 1] - bt[i])):
                    if r in fresh:
                        last = (keys[r], next(found))
                    own = last[1]
                    at_ = np.minimum(np.searchsorted(own, other), len(own) - 1)
                    out.append((int((own[at_] == other).sum()), len(own), len(other)))
                both, na, nb = (pa.array(x, pa.int64()) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), both, na, nb], names=["a", "b", "both", "na", "nb"])
            del left

    return common.written(joined.mapInArrow(compare, "a long, b long, both long, na long, nb long"), "verified")


def _shared(nodes: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, shared: how many shingles of its set stand in the set of one of ``nodes`` with another label; node, grams)."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        for batch in batches:
            body, offsets = common.buffers(batch.column(2))
            for i, j in common.slices(offsets, 1 << 20):
                sets = shingle_sets(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ends = np.cumsum([0, *map(len, sets)])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), lists], names=["node", "label", "grams"])

    held = texts.join(nodes.select("node", "label"), "node").select("node", "label", "text")
    sets = common.written(held.mapInArrow(grams, "node long, label long, grams array<long>"), "grams")
    each = sets.select("node", "label", F.explode("grams").alias("gram"))
    owned = each.groupBy("gram").agg(F.count("*").alias("c"), F.min("node").alias("node"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo = hi")
    single = owned.filter("c = 1").groupBy("node").agg(F.count("*").alias("own"))
    several = each.join(owned.filter("c > 1").select("gram"), "gram", "left_semi").groupBy("node").agg(F.count("*").alias("own"))
    own = single.unionByName(several).groupBy("node").agg(F.sum("own").alias("own"))
    return nodes.join(own, "node", "left").select("node", (F.col("n") - F.coalesce("own", F.lit(0))).alias("shared")), sets.select("node", "grams")


def _met(block: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Pairs of labels that a link between two rows of a block joins, as a forest. Full sets are compared, all at once."""
    first = np.array(block["first"].to_pylist(), bool)
    alone = block["i"][0].as_py() == block["j"][0].as_py() and not ("next" in block.column_names and block["next"][0].as_py())
    second = first if alone else ~first
    label, n, shared = (block[c].to_numpy() for c in ("label", "n", "shared"))
    sets = block["grams"].combine_chunks()
    if isinstance(sets, pa.ChunkedArray):
        sets = pa.concat_arrays(sets.chunks)
    values, at = sets.values.to_numpy(), sets.offsets.to_numpy()
    rows, cols = np.flatnonzero(first), np.flatnonzero(second)
    nr, nc = n[rows][:, None], n[cols][None, :]
    may = (label[rows][:, None] != label[cols][None, :]) & (np.minimum(nr, nc) * 100 >= np.maximum(nr, nc) * percent)
    may &= np.minimum(shared[rows][:, None], shared[cols][None, :]) * (100 + percent) >= (nr + nc) * percent
    keep_r, keep_c = may.any(axis=1), may.any(axis=0)
    rows, cols, may = rows[keep_r], cols[keep_c], may[keep_r][:, keep_c]
    if not len(rows) or not len(cols):
        return []
    flat = lambda who: (np.concatenate([values[at[i] : at[i + 1]] for i in who]), np.repeat(np.arange(len(who)), at[who + 1] - at[who]))
    (gr, ir), (gc, ic) = flat(rows), flat(cols)
    both = np.intersect1d(gr, gc)
    both_ = np.append(both, both[-1] if len(both) else 0)
    pr, pc = np.searchsorted(both, gr), np.searchsorted(both, gc)
    fr, fc = both_[pr] == gr, both_[pc] == gc
    pr, ir, pc, ic = pr[fr], ir[fr], pc[fc], ic[fc]
    inter = np.zeros((len(rows), len(cols)), np.float32)
    step = 2048
    for lo in range(0, len(both), step):
        left, right = np.zeros((len(rows), step), np.float32), np.zeros((len(cols), step), np.float32)
        now = (pr >= lo) & (pr < lo + step)
        left[ir[now], pr[now] - lo] = 1
        now = (pc >= lo) & (pc < lo + step)
        right[ic[now], pc[now] - lo] = 1
        inter += left @ right.T
    hit = may & (inter * (100 + percent) >= (n[rows][:, None] + n[cols][None, :]) * percent)
    r, c = np.nonzero(hit)
    pairs = np.unique(np.stack([label[rows[r]], label[cols[c]]], axis=1), axis=0)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in pairs.tolist():
        u, v = find(x), find(y)
        if u != v:
            root[max(u, v)] = min(u, v)
            out.append((x, y))
    return out


def _across(members: DataFrame, labels: DataFrame, texts: DataFrame, percent: int, block: int) -> DataFrame:
    """a, b: components (by label) that a link joins between classes of one bucket. members: key, node, n."""
    known = members.join(labels.withColumnRenamed("component", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = known.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("key")
    held = common.written(known.join(mixed, "key", "left_semi").select("key", "node", "n", "label"), "mixed")
    # A shingle that no class of another component has is never shared with one: sets with too many of them have no such link.
    shared, sets = _shared(held.select("node", "n", "label").distinct(), texts)
    live = common.written(held.join(shared, "node").filter(F.col("shared") * 100 >= F.col("n") * percent), "live")
    hubs = live.groupBy("key").agg(F.min("node").alias("hub"))
    clusters = components(live.join(hubs, "key").select("node", "hub").distinct(), "node", "hub")
    # Sizes of linked sets differ by a factor of 100 / percent at most: classes of such sizes meet themselves and the next.
    band = F.floor(F.log("n") / np.log(100 / percent) + 1e-9).cast("int") if percent < 100 else F.col("n").cast("int")
    nodes = live.select("node", "n", "label", "shared").distinct().join(clusters, "node").withColumn("band", band)
    sums = nodes.groupBy("component", "band").agg(F.ceil(F.sum("n") / block).cast("int").alias("parts"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    mixed_ = sums.groupBy("component").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo < hi").select("component")
    parts = common.written(sums.join(mixed_, "component", "left_semi").select("component", "band", "parts"), "parts")
    each = nodes.join(parts, ["component", "band"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    slim = ["node", "n", "label", "shared"]
    same = each.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    same = same.select("component", "band", F.lit(0).alias("next"), F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), (F.col("part") <= F.col("other")).alias("first"), *slim)
    above = parts.select("component", (F.col("band") - 1).alias("band"), F.col("parts").alias("others"))
    under = parts.select("component", (F.col("band") + 1).alias("band"), F.col("parts").alias("others"))
    met = lambda side: each.join(side, ["component", "band"]).select("*", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("other"))
    upper = met(above).select("component", "band", F.lit(1).alias("next"), F.col("part").alias("i"), F.col("other").alias("j"), F.lit(True).alias("first"), *slim)
    lower = met(under).select("component", (F.col("band") - 1).alias("band"), F.lit(1).alias("next"), F.col("other").alias("i"), F.col("part").alias("j"), F.lit(False).alias("first"), *slim)
    dealt = same.unionByName(upper).unionByName(lower)

    def meet(table: pa.Table) -> pa.Table:
        found = _met(table, percent)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return common.written(dealt.join(sets, "node").groupBy("component", "band", "next", "i", "j").applyInArrow(meet, "a long, b long"), "across")


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = 75, block: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """(signature rows: row, row_id, n_shingles, print; print, component_id, keep_row of each class of equal sets)."""
    rows = _prepared(docs, text)
    some = rows.filter("n_shingles > 0")
    order = F.struct(F.col("row")[doc_id].isNull().alias("none"), F.col("row")[doc_id].cast("long").alias("id"), F.col("row_id").alias("at"))
    classes = common.written(some.groupBy("print").agg(F.min("row_id").alias("node"), F.min(order).alias("best")), "classes")
    reps = some.select("row_id", "n_shingles", "bands").join(classes.select(F.col("node").alias("row_id")), "row_id", "left_semi")
    placed = reps.select(F.col("row_id").alias("node"), F.col("n_shingles").alias("n"), F.posexplode("bands").alias("band", "key"))
    # The first class of a bucket by one of three orders, so that a group of near copies gets several centres.
    turn = F.xxhash64("node", F.col("band") % 3)
    stars = placed.groupBy("key").agg(F.min(F.struct(turn.alias("turn"), "node", "n")).alias("first"), F.count("*").alias("c")).filter("c > 1").select("key", F.col("first.node").alias("centre"), F.col("first.n").alias("centre_n"))
    members = common.written(placed.drop("band").join(stars, "key"), "members")
    texts = rows.select(F.col("row_id").alias("node"), F.col("row")[text].alias("text"))

    linked = F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * percent
    # Sets of too different sizes can't be linked: their texts needn't meet.
    sized = F.least("n", "centre_n") * 100 >= F.greatest("n", "centre_n") * percent
    spokes = members.filter("node <> centre").filter(sized).select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).distinct()
    links = _verified(spokes, texts).filter(linked).select("a", "b")
    labels = common.written(components(links), "labels")
    more = _across(members.select("key", "node", "n"), labels, texts, percent, block)
    if not more.isEmpty():  # components joined: their names change where they are known, singles get one
        joined = components(more).withColumnRenamed("component", "next").withColumnRenamed("node", "component")
        every = labels.unionByName(joined.select(F.col("component").alias("node"), "component")).distinct()
        labels = every.join(joined, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    placed_ = common.written(classes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
    best = placed_.groupBy("component").agg(F.min("best").alias("first"), F.count("*").alias("c"))
    return rows, hub_join(placed_, best, "component", hub_limit(placed_.count())).select("print", F.col("first.id").alias("component_id"), F.col("first.at").alias("keep_row"))


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = 75) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    rows, found = near_groups(docs, text, doc_id, percent)
    slim = rows.select("row_id", F.col("row")[doc_id].alias("doc_id"), "n_shingles", "print")
    linked = slim.filter("n_shingles > 0").join(found, "print").select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    return linked.unionByName(slim.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").cast("long").alias("component_id"), (F.col("doc_id") == F.col("doc_id")).alias("kept")))


def near_distinct(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = 75) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component, with all their columns."""
    rows, found = near_groups(docs, text, doc_id, percent)
    gone = rows.filter("n_shingles > 0").select("row_id", "print").join(found, "print").filter("row_id <> keep_row").select(F.col("row_id").alias("gone"))
    return rows.join(gone, F.col("row_id") == F.col("gone"), "left_anti").select("row.*")
