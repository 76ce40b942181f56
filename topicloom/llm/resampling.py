"""Importance resampling towards a target distribution, with Gumbel noise and an exact distributed selection.

1. Features are runs of 1 to ``runs`` consecutive words, hashed by crc32 into ``buckets``. Each task counts the features of
   its texts into one array and hands on its non-zero buckets only, so a shuffle carries at most ``buckets`` rows a task.
2. A bucket's gain is the log ratio of its smoothed shares in target and corpus, in thousandths, rounded down. The gains are
   one array of ``buckets`` numbers, whatever the tables' size: it is broadcast, and a text's weight is a sum over it.
3. Scores are weights plus Gumbel noise from a hash of the id: drawing the highest is drawing without replacement in
   proportion to exp(weight / 1000). They are written once.
4. The k-th highest (score, id, place) is found by radix selection: a pass counts one digit of ``DIGIT`` bits among the rows
   that still agree with the digits known so far; at most 2 ** DIGIT counts come to the driver. A part of the key that
   no longer tells rows apart is skipped, and a pass begins at the highest bit in which keys differ.
5. Only the chosen rows are sorted, by range, and get their rank: rows before their partition plus place in it.

Defined cases: a null text has no words; without features the weight is 0; a text of fewer than ``least`` words is scored but
never drawn; equal scores go to the smaller id, a null id after all others, rows that repeat an id in the order in which they
were written; noise of a null id is drawn from an empty id; an empty table gives an empty one, and an empty target counts 0 in
every bucket. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Bits of a digit of the selection.
DIGIT = 12

_WORD = np.ones(256, bool)
_WORD[:0x30] = _WORD[0x3A:0x61] = _WORD[0x7B:0x80] = False

#: The remainders of crc32 (reflected polynomial 0xEDB88320) for one byte.
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)

#: Longer byte runs go to zlib one by one.
_LONG = 96


def crc32_runs(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of each run of bytes: all runs take their next byte at once, those that are at their end drop out."""
    size = ends - starts
    out = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-size, kind="stable")
    at, left = starts[order], -size[order]
    short = int(np.searchsorted(left, -_LONG))  # runs before it are longer
    for step in range(min(_LONG, int(size.max(initial=0)))):
        n = int(np.searchsorted(left, -step))  # runs of more than ``step`` bytes
        if n <= short:
            break
        some = order[short:n]
        crc = out[some]
        out[some] = _CRC[(crc ^ body[at[short:n] + step]) & np.uint32(255)] ^ (crc >> np.uint32(8))
    out ^= np.uint32(0xFFFFFFFF)
    raw = memoryview(np.ascontiguousarray(body))
    for i in order[:short].tolist():
        out[i] = zlib.crc32(raw[starts[i] : ends[i]])
    return out


def feature_buckets(body: np.ndarray, offsets: np.ndarray, runs: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature, text of each feature, words of each text). A to Z are small; words are joined by one blank."""
    low = common.LOWER[body]
    starts, ends, first = common.words(low, offsets, _WORD)
    n_words = np.diff(first)
    text = np.repeat(np.arange(len(n_words)), n_words)
    found, owner = [crc32_runs(low, starts, ends)], [text]
    if runs > 1 and len(starts):
        # The words one after another with a blank after each: a run of words is a run of bytes there, less the last blank.
        size = ends - starts
        to = np.concatenate([[0], np.cumsum(size + 1)])
        joined = np.full(int(to[-1]), 32, np.uint8)
        joined[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = low[np.arange(int(size.sum())) + np.repeat(starts - np.concatenate([[0], np.cumsum(size)[:-1]]), size)]
        for k in range(2, runs + 1):
            whole = np.flatnonzero(text[: len(text) - k + 1] == text[k - 1 :]) if len(text) >= k else np.zeros(0, np.int64)
            found.append(crc32_runs(joined, to[whole], to[whole + k] - 1))
            owner.append(text[whole])
    return np.concatenate(found) % np.uint32(buckets), np.concatenate(owner), n_words


def bucket_counts(docs: DataFrame, text: str = "text", runs: int = 1, buckets: int = 10_000) -> DataFrame:
    """bucket, n: how many features of all texts fall into each bucket that has any."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            body, offsets = common.buffers(batch.column(0))
            for i, j in common.slices(offsets, 1 << 20):
                found, _, _ = feature_buckets(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], runs, buckets)
                total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    return docs.select(text).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", runs: int = 1, buckets: int = 10_000) -> np.ndarray:
    """The gain of each bucket, in thousandths. ``buckets`` numbers: bounded whatever the tables' size."""
    both = bucket_counts(docs, text, runs, buckets).withColumnRenamed("n", "s").join(bucket_counts(target, target_text, runs, buckets).withColumnRenamed("n", "t"), "bucket", "full")
    both = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(both, "bucket", "left").fillna(0, ["s", "t"])
    with common.bounded_batches(docs.sparkSession):
        got = both.select("bucket", "s", "t").toArrow().to_pydict()
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    s[got["bucket"]], t[got["bucket"]] = got["s"], got["t"]
    above, below = (t + 1.0) * float(s.sum() + buckets), (s + 1.0) * float(t.sum() + buckets)
    return np.floor(1000.0 * np.log(above / below)).astype(np.int64)


def noise(doc_id: Column, seed: str) -> Column:
    """Gumbel noise of an id, in thousandths, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def scored(docs: DataFrame, gain: np.ndarray, text: str = "text", doc_id: str = "doc_id", runs: int = 1, seed: str = "2024") -> DataFrame:
    """doc_id, n_words, n_features, weight, score, place (a number of its own for each row), as a written table."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        worth = shared.value
        for batch in batches:
            body, offsets = common.buffers(batch.column(1))
            words_, features, weights = [], [], []
            for i, j in common.slices(offsets, 1 << 20):
                found, owner, n_words = feature_buckets(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], runs, len(worth))
                weight = np.zeros(j - i, np.int64)
                np.add.at(weight, owner, worth[found])
                words_.append(n_words)
                features.append(np.bincount(owner, minlength=j - i))
                weights.append(weight)
            columns = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (words_, features, weights)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], names=["doc_id", "n_words", "n_features", "weight"])

    found = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")
    return common.written(found.select("*", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), F.monotonically_increasing_id().alias("place")), "scored")


def _digit_pass(rows: DataFrame, key: Column, low: int, span: int, k: int) -> tuple[int, int, int]:
    """(smallest and largest key, rows before them) of the digit's bin that the k-th smallest key (from 1) falls into.

    Keys lie in low .. low + span; a bin is a power of two wide, the bins are 2 ** DIGIT at most.
    """
    wide = max(0, span.bit_length() - DIGIT)
    # Differences are taken on decimals: two 64-bit keys may lie further apart than 64 bits hold.
    digit = F.floor((key.cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")) / F.lit(1 << wide).cast("decimal(20,0)")).cast("int")
    counts = sorted((r["digit"], r["n"]) for r in rows.groupBy(digit.alias("digit")).agg(F.count("*").alias("n")).collect())  # 2 ** DIGIT rows at most
    before = 0
    for d, n in counts:
        if before + n >= k:
            return low + (d << wide), low + ((d + 1) << wide) - 1, before
        before += n
    raise ValueError("fewer keys than asked for")


def kth(rows: DataFrame, keys: list[tuple[str, bool]], k: int) -> list[int]:
    """The composite key (column, whether its highest values come first) at which exactly ``k`` rows stand, in key order.

    Keys are non-null longs, different for different rows when taken together. A column is narrowed digit by digit; once one
    value is left and not all of its rows are wanted, the next column decides among them.
    """
    out: list[int] = []
    for name, descending in keys:
        key = -F.col(name).cast("decimal(20,0)") if descending else F.col(name).cast("decimal(20,0)")
        ends = rows.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count("*").alias("n")).first()
        low, high = int(ends["lo"]), int(ends["hi"])
        if ends["n"] == k:  # all that are left are wanted
            out.append(-high if descending else high)
            return out
        while low < high:
            low, high, before = _digit_pass(rows, key, low, high - low, k)
            k -= before
            rows = rows.filter((key >= F.lit(low).cast("decimal(20,0)")) & (key <= F.lit(high).cast("decimal(20,0)")))
        out.append(-low if descending else low)
    return out


def _within(keys: list[tuple[str, bool]], limit: list[int]) -> Column:
    """Whether a row stands at or before the composite key ``limit``; columns beyond it are not looked at."""
    (name, descending), value = keys[0], F.lit(limit[0]).cast("long")
    better = F.col(name) > value if descending else F.col(name) < value
    if len(limit) == 1:
        return better | (F.col(name) == value)
    return better | ((F.col(name) == value) & _within(keys[1:], limit[1:]))


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``rank`` from 1: sorted by range, so no task sees all of them."""
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()  # partition number, then place in the partition
    kept = common.written(parts.select("*", F.shiftright(at, 33).alias("_part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "ranked")
    sizes = kept.groupBy("_part").agg((F.max("_at") + 1).alias("_n"))  # as many rows as partitions
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return kept.join(F.broadcast(before), "_part").select(*rows.columns, (F.col("_before") + F.col("_at") + 1).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", target_text: str = "text", runs: int = 1, buckets: int = 10_000, percent: int = 10, least: int = 20, seed: str = "2024") -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs``; rank is null where the row is not drawn."""
    gain = gains(docs, target, text, target_text, runs, buckets)
    rows = scored(docs, gain, text, doc_id, runs, seed)
    # A null id comes last: its rows are told apart by a first part of the key.
    rows = rows.withColumn("_none", F.col("doc_id").isNull().cast("long")).withColumn("_id", F.coalesce("doc_id", F.lit(0)))
    able = F.col("n_words") >= least
    wanted = rows.filter(able).count() * percent // 100
    shown = ["doc_id", "n_features", "weight", "score"]
    if not wanted:
        return rows.select(*shown, F.lit(None).cast("long").alias("rank"))
    keys = [("score", True), ("_none", False), ("_id", False), ("place", False)]
    drawn = able & _within(keys, kth(rows.filter(able), keys, wanted))
    chosen = ranked(rows.filter(drawn), [F.desc("score"), F.asc("_none"), F.asc("_id"), F.asc("place")])
    rest = rows.filter(~drawn).select(*shown, F.lit(None).cast("long").alias("rank"))
    return chosen.select(*shown, "rank").unionByName(rest)
