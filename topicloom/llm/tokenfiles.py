"""Token ids in binary files of range-coded blocks, written in ascending order of document id and read back.

A file holds the documents of one id range, as segments of whole documents with about ``segment_ids`` ids (more only where
one document is longer). A segment: a header, an index of its documents (id, ids in it), the sizes and crc32 of its
blocks, and the blocks, each coded by ``rangecoder`` from reset tables. A file is a Parquet file with one row per segment,
uncompressed, so that Spark's commit protocol covers it and any store that Spark writes can hold it.

Defined cases: a null or empty text is its end id alone; null document ids come first; rows with equal ids follow each
other in order of a hash of their text; an empty table gives files without segments. A segment whose checksum fails raises ValueError.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, rangecoder
from .tokens import SPLITS, encoder

_MAGIC, _HEAD = b"TLID", struct.Struct("<4sHHIQII")
_NULL = -(1 << 63)


def pack_segment(keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray, block: int, id_bits: int) -> bytes:
    words, counts = rangecoder.encode(ids, block, id_bits)
    raw = ids.astype("<u4").tobytes()
    sums = np.array([zlib.crc32(raw[i : i + 4 * block]) for i in range(0, len(raw), 4 * block)], "<u4")
    index = zlib.compress(keys.astype("<i8").tobytes() + sizes.astype("<u4").tobytes() + counts.astype("<u4").tobytes() + sums.tobytes(), 1)
    head = _HEAD.pack(_MAGIC, 2, id_bits, block, len(ids), len(keys), len(index))
    body = head + index + words.astype("<u4").tobytes()
    return body + struct.pack("<I", zlib.crc32(head + index))


def unpack_segment(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, ids of each, all ids), every block checked."""
    magic, version, id_bits, block, n, docs, size = _HEAD.unpack_from(data)
    at = _HEAD.size
    if magic != _MAGIC or version != 2 or zlib.crc32(data[: at + size]) != struct.unpack_from("<I", data, len(data) - 4)[0]:
        raise ValueError("not a segment of token ids, or its index is damaged")
    index = zlib.decompress(data[at : at + size])
    blocks = -(-n // block)
    keys = np.frombuffer(index, "<i8", docs)
    sizes = np.frombuffer(index, "<u4", docs, 8 * docs).astype(np.int64)
    counts = np.frombuffer(index, "<u4", blocks, 12 * docs).astype(np.int64)
    sums = np.frombuffer(index, "<u4", blocks, 12 * docs + 4 * blocks)
    ids = rangecoder.decode(np.frombuffer(data, "<u4", int(counts.sum()), at + size), counts, n, block, id_bits)
    raw = ids.astype("<u4").tobytes()
    if any(zlib.crc32(raw[4 * block * i : 4 * block * (i + 1)]) != s for i, s in enumerate(sums)):
        raise ValueError("a block's checksum doesn't match its ids")
    return keys, sizes, ids


_SEGMENTS = "file int, segment int, n_ids long, payload binary"


def write_token_files(docs: DataFrame, path: str, vocabulary: str, split: str = "bytes", end_id: int = 0, id_bits: int = 16, files: int | None = None, block: int = 1 << 18, segment_ids: int = 4 << 20, text: str = "text", doc_id: str = "doc_id") -> None:
    """Writes all of ``docs`` to ``path``; each file's name is its place in the order of ids."""
    files = files or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    end = int(end_id).to_bytes(4, "little")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, file, segment = encoder(vocabulary), TaskContext.get().partitionId(), 0
        keys: list[int] = []
        parts: list[bytes] = []
        held = 0

        def done() -> pa.RecordBatch:
            sizes = np.array([len(p) // 4 for p in parts], np.int64)
            payload = pack_segment(np.array(keys, np.int64), sizes, np.frombuffer(b"".join(parts), "<u4"), block, id_bits)
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([segment], pa.int32()), pa.array([int(sizes.sum())]), pa.array([payload], pa.binary())], names=["file", "segment", "n_ids", "payload"])

        for batch in batches:
            _, offsets = common.buffers(batch.column(1))
            for i, j in common.slices(offsets, 1 << 20):
                for key, ids in zip(batch.column(0).slice(i, j - i).to_pylist(), encode.batch(SPLITS[split](batch.column(1).slice(i, j - i))), strict=True):
                    if parts and held + len(ids) // 4 + 1 > segment_ids:
                        yield done()
                        keys, parts, held, segment = [], [], 0, segment + 1
                    keys.append(_NULL if key is None else key)
                    parts.append(ids + end)
                    held += len(ids) // 4 + 1
        if parts:
            yield done()

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    spread = F.xxhash64("text")  # rows of one hot id can go to several files; they stay next to each other
    dealt = slim.repartitionByRange(files, F.col("doc_id").asc_nulls_first(), spread).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), spread, "text")
    with common.bounded_batches(docs.sparkSession):
        dealt.mapInArrow(code, _SEGMENTS).write.option("compression", "uncompressed").parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32, and ``ids`` (little-endian unsigned 32 bits) if asked for."""
    stored = spark.read.schema(_SEGMENTS).parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                file, segment, _, payload = (batch.column(c)[row].as_py() for c in range(4))
                keys, sizes, ids = unpack_segment(payload)
                raw, ends = ids.astype("<u4").tobytes(), np.cumsum(sizes)
                cuts = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                columns = [pa.array(np.full(len(keys), file, np.int32)), pa.array(np.full(len(keys), segment, np.int32)), pa.array(keys, mask=keys == _NULL), pa.array(ends - sizes), pa.array(sizes), pa.array([zlib.crc32(c) for c in cuts], pa.int64())]
                names = ["file", "segment", "doc_id", "within", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(cuts, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    found = stored.mapInArrow(decode, "file int, segment int, doc_id long, within long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    # Where a segment begins: files before it, then segments before it in its file. One row per file meets in one task.
    totals = stored.groupBy("file").agg(F.sum("n_ids").alias("n"))
    files = totals.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    segments = stored.select("file", "segment", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("above")).join(files, "file")
    starts = segments.select("file", "segment", (F.col("base") + F.col("above")).alias("base"))
    return found.join(starts, ["file", "segment"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
