"""Packing token sequences by best-two-fit.

A document's ids, with an end id, are one item; only a document longer than a sequence is cut, into full pieces and a
rest. Items of one length are interchangeable, so the packing is planned on the histogram of lengths, which has at most
``capacity`` entries however large the corpus is: a bin is filled greedily with the longest item that still fits; then
its smallest item is replaced by the two unpacked items that fill the gap it leaves most tightly, if they fill it better.
Such a bin is repeated as often as its lengths last. Each item then finds its bin from its rank among the items of its
length, which is a prefix sum over the tasks that made the items. No task and no driver list grows with a length's count.

Defined cases: a null or empty text is the end id alone (one piece of length 1); repeated rows are packed once each; an
empty table gives an empty result. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .tokens import SPLITS, encoder

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, place long"


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, split: str = "words", end_id: int = 0, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per piece; ``place`` numbers the pieces of one length within a task. ``split``: see ``tokens``."""
    names = [x.split()[0] for x in _PIECES.split(", ")]
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(vocabulary), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            _, offsets = common.buffers(batch.column(1))
            for i, j in common.slices(offsets, 1 << 20):
                out: list[tuple] = []
                part = batch.column(1).slice(i, j - i)
                for key, ids in zip(batch.column(0).slice(i, j - i).to_pylist(), encode.batch(SPLITS[split](part)), strict=True):
                    ids += end
                    for k, lo in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[lo : lo + 4 * capacity]
                        n = len(own) // 4
                        out.append((key, k, lo // 4, n, zlib.crc32(own), task, int(seen[n])))
                        seen[n] += 1
                types = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(cut, _PIECES)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, bins, first bin, offset) runs: rank r of a length lies in the run with the last first rank <= r.

    Within a run, rank ``first + c * bins + b`` goes to bin ``first bin + b`` at ``offset + c * length``.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left)
    used = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    bins = 0
    while lengths:
        inside: dict[int, int] = {}
        gap = capacity
        while gap and (i := bisect_right(lengths, gap) - 1) >= 0:
            while i >= 0 and left[lengths[i]] <= inside.get(lengths[i], 0):
                i -= 1
            if i < 0:
                break
            n = lengths[i]
            take = min(left[n] - inside.get(n, 0), gap // n)
            inside[n] = inside.get(n, 0) + take
            gap -= take * n
        if gap and len(lengths) > 1:
            small = min(inside)
            pair = _two(lengths, left, inside, gap + small)
            if pair and sum(pair) > small:
                inside[small] -= 1
                for n in pair:
                    inside[n] = inside.get(n, 0) + 1
                inside = {n: k for n, k in inside.items() if k}
        times = min(left[n] // k for n, k in inside.items())
        offset = 0
        for n, k in sorted(inside.items(), reverse=True):
            runs.append((n, used[n], times, bins, offset))
            used[n] += times * k
            left[n] -= times * k
            offset += n * k
            if not left[n]:
                lengths.remove(n)
        bins += times
    return runs


def _two(lengths: list[int], left: dict[int, int], inside: dict[int, int], room: int) -> tuple[int, int] | None:
    """The two unpacked lengths of the largest sum within ``room``."""
    free = np.array([n for n in lengths if n < room and left[n] > inside.get(n, 0)], np.int64)
    if not len(free):
        return None
    spare = np.array([left[n] - inside.get(n, 0) for n in free.tolist()])
    at = np.searchsorted(free, room - free, side="right") - 1
    own = (at == np.arange(len(free))) & (spare < 2)
    at = np.where(own, at - 1, at)
    total = np.where(at >= 0, free + free[at], -1)
    best = int(total.argmax())
    return (int(free[best]), int(free[at[best]])) if total[best] > 0 else None


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, **options) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = common.written(pieces(docs, vocabulary, capacity, **options), "pieces")
    by_task = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = sorted(plan(counts, capacity))
    keys = np.array([n << 44 | first for n, first, *_ in runs], np.int64)
    table = np.array(runs, np.int64).reshape(-1, 5)
    shared = docs.sparkSession.sparkContext.broadcast((keys, table))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys_, table_ = shared.value
        for batch in batches:
            n, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            run = table_[np.searchsorted(keys_, n << 44 | rank, side="right") - 1]
            within = rank - run[:, 1]
            sequence, offset = run[:, 3] + within % run[:, 2], run[:, 4] + within // run[:, 2] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    ranked = cut.join(base, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("place")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
