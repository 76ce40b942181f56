"""Exact deduplication by Grace hashing.

1. Every row is written to spill files in the shared folder. Each Arrow batch first meets an open-addressing table that
   compares complete normalised texts, so a text goes on once for a batch, however many copies the batch holds.
2. A hash with very many records is hot: its records are dealt by hash and salt to groups of about FOLD, each group meets a
   table of its own, and one record of each text goes on; again, until no hash is hot. So one text in half of all rows
   comes to no task as more than its share.
3. Records are dealt to buckets by leading bits of their hash, one bucket to a task. Buckets whose records exceed
   ``bucket_bytes`` are divided again by further bits, round after round, until each fits or holds one hash only. The
   spill files of the buckets are Spark's shuffle files, so a lost executor's are made again.
4. Each bucket fills an open-addressing table, again on complete texts, which holds each different text once. Beside it
   stand the record numbers of each text, not their texts.
5. What a bucket decides goes back to the rows by joins on records: a record has the rows of one batch at most, and a
   folded record about FOLD others.

Defined cases: a null text is empty; all empty texts are equal; rows with equal texts are ordered by code points
(descending), id (a null id last), then place in the input, so one row of a group stays even when ids repeat. An empty
table gives an empty result. Other columns may have any names: they travel in one struct.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Deleted before texts are compared: blank, tab, line feed, vertical tab, form feed, carriage return.
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"

#: Records of a hot hash that meet at a time; a hash is hot with more records than that and than records / HOT, so fewer
#: than HOT hashes are, and are broadcast.
FOLD, HOT = 64, 5_000


class OpenTable:
    """Open addressing with linear probing; an entry matches when its hash and its complete content do."""

    def __init__(self, capacity: int = 1024):
        self.slots, self.mask = np.full(capacity, -1, np.int64), capacity - 1
        self.hashes: list[int] = []
        self.contents: list[bytes] = []

    def place(self, h: int, content: bytes) -> int:
        """The number of ``content`` in this table, which it gets if it is new."""
        if 2 * len(self.hashes) >= len(self.slots):
            self._grow()
        slots, j = self.slots, h & self.mask
        while (g := slots[j]) >= 0:
            if self.hashes[g] == h and self.contents[g] == content:
                return int(g)
            j = (j + 1) & self.mask
        slots[j] = g = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        return int(g)

    def _grow(self) -> None:
        self.slots, self.mask = np.full(2 * len(self.slots), -1, np.int64), 2 * len(self.slots) - 1
        for g, h in enumerate(self.hashes):
            j = h & self.mask
            while self.slots[j] >= 0:
                j = (j + 1) & self.mask
            self.slots[j] = g


def normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(None, WHITE)


_SPILL = "row_id long, rec_id long, h long, n_bytes long, sha binary, members long, best_chars long, best_id long, best_row long"


def _spill(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("row_id"))
    schema = T.StructType([keyed.schema["row"], *T._parse_datatype_string(_SPILL).fields])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        for batch in batches:
            rows = batch.column(0)
            texts, ids = rows.field(text), rows.field(doc_id).cast(pa.int64()).to_pylist()
            chars = pc.fill_null(pc.utf8_length(texts), 0).cast(pa.int64()).to_numpy(zero_copy_only=False)
            row_ids = batch.column(1).to_pylist()
            table, group, shas, sizes = OpenTable(), [], [], []
            for text_ in texts.to_pylist():
                content = normalised(text_)
                sha = hashlib.sha256(content).digest()
                shas.append(sha)
                sizes.append(len(content))
                group.append(table.place(int.from_bytes(sha[:8], "little", signed=True), content))
            first: dict[int, int] = {}
            best: dict[int, tuple] = {}
            members: dict[int, int] = {}
            for i, g in enumerate(group):
                first.setdefault(g, i)
                members[g] = members.get(g, 0) + 1
                key = (-int(chars[i]), ids[i] is None, ids[i] or 0, row_ids[i])
                if g not in best or key < best[g]:
                    best[g] = key
            lead = [first[g] == i for i, g in enumerate(group)]
            own = [best[g] if led else None for g, led in zip(group, lead, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    rows,
                    batch.column(1),
                    pa.array([row_ids[first[g]] for g in group], pa.int64()),
                    pa.array([table.hashes[g] for g in group], pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(shas, pa.binary()),
                    pa.array([members[g] if led else None for g, led in zip(group, lead, strict=True)], pa.int64()),
                    pa.array([-b[0] if b else None for b in own], pa.int64()),
                    pa.array([None if not b or b[1] else b[2] for b in own], pa.int64()),
                    pa.array([b[3] if b else None for b in own], pa.int64()),
                ],
                names=schema.names,
            )

    return common.written(keyed.mapInArrow(combine, schema), "grace")


_RECORD = ["rec_id", "h", "n_bytes", "text", "members", "best_chars", "best_id", "best_row"]
_RECORD_TYPES = "rec_id long, h long, n_bytes long, text string, members long, best_chars long, best_id long, best_row long"


def _key(chars: int, best_id: int | None, best_row: int) -> tuple:
    return -chars, best_id is None, best_id or 0, best_row


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each group of a hot hash: its records with the one that stands for their text; that one with the sums of all."""
    names = ["lead", *_RECORD]
    group, table, found, led = None, OpenTable(), [], []

    def done() -> pa.RecordBatch:
        rows = [(found[g][0], rec, *(found[g] if found[g][0] == rec else [None] * 8)[1:]) for rec, g in led]
        types = [pa.string() if n == "text" else pa.int64() for n in names]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    for batch in batches:
        for salt, *record in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rec, h, _, text, members, *best = record
            if (h, salt) != group:
                if led:
                    yield done()
                group, table, found, led = (h, salt), OpenTable(), [], []
            g = table.place(h, normalised(text))
            led.append((rec, g))
            if g == len(found):
                found.append(record)
            else:
                found[g][4] += members
                if _key(*best) < _key(*found[g][5:]):
                    found[g][5:] = best
    if led:
        yield done()


def _cooled(records: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Records without hot hashes, and (lead, rec_id) of each round that folded some."""
    rounds: list[DataFrame] = []
    while True:
        n = records.count()
        hot = common.written(records.groupBy("h").agg(F.count("*").alias("c")).filter(F.col("c") > max(FOLD, n // HOT)).select(F.col("h").alias("hot_h"), F.ceil(F.col("c") / FOLD).alias("groups")), "hot")
        if hot.isEmpty():
            return records, rounds
        marked = records.join(F.broadcast(hot), F.col("h") == F.col("hot_h"), "left")
        salted = marked.filter("hot_h is not null").select(F.pmod(F.xxhash64("rec_id", F.lit(len(rounds))), F.col("groups")).cast("int").alias("salt"), *_RECORD)
        tasks = max(records.sparkSession.sparkContext.defaultParallelism * 2, int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        folded = common.written(salted.repartition(tasks, "h", "salt").sortWithinPartitions("h", "salt").mapInArrow(_fold, f"lead long, {_RECORD_TYPES}"), "folded")
        rounds.append(folded.filter("lead <> rec_id").select("lead", "rec_id"))
        records = marked.filter("hot_h is null").select(*_RECORD).unionByName(folded.filter("lead = rec_id").select(*_RECORD))


def _buckets(records: DataFrame, bucket_bytes: int, bits: int) -> tuple[DataFrame, int]:
    """``records`` with the task of their bucket and the bucket itself, and how many tasks there are.

    Buckets over the limit are broadcast: at most all bytes / ``bucket_bytes``.
    """
    total = records.agg(F.sum("n_bytes").alias("b")).first()["b"] or 0
    depth = max(1, int(2 * total // bucket_bytes).bit_length(), records.sparkSession.sparkContext.defaultParallelism.bit_length() + 1)
    tasks = 1 << depth
    prefix = lambda d: F.shiftrightunsigned("h", 64 - d)
    records = records.withColumn("task", prefix(depth).cast("int")).withColumn("bucket", F.concat_ws("/", F.lit(depth), prefix(depth)))
    open_ = records.select("h", "n_bytes", F.col("bucket").alias("cell"))
    while depth < 64:
        sums = open_.groupBy("cell").agg(F.sum("n_bytes").alias("b"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        over = common.written(sums.filter((F.col("b") > bucket_bytes) & (F.col("lo") != F.col("hi"))).select(F.col("cell").alias("over_cell")), "over")
        if over.isEmpty():
            break
        depth = min(64, depth + bits)
        deeper = F.concat_ws("/", F.lit(depth), prefix(depth))
        full = F.col("over_cell").isNotNull()
        records = records.join(F.broadcast(over), F.col("bucket") == F.col("over_cell"), "left").withColumn("bucket", F.when(full, deeper).otherwise(F.col("bucket")))
        records = records.withColumn("task", F.when(full, F.pmod(F.hash("bucket"), F.lit(tasks))).otherwise(F.col("task"))).drop("over_cell")
        open_ = open_.join(F.broadcast(over), F.col("cell") == F.col("over_cell"), "left_semi").withColumn("cell", deeper)
    return records, tasks


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket after another: the row that stays and the size of the group, for each record."""
    names = ["rec_id", "keep_id", "keep_row", "group_size"]
    bucket, table, groups = None, OpenTable(), []

    def done() -> pa.RecordBatch:
        out = [(rec, None if best[1] else best[2], best[3], size) for recs, best, size in groups for rec in recs]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=names)

    for batch in batches:
        for cell, rec, h, text, members, *best in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if cell != bucket:
                if groups:
                    yield done()
                bucket, table, groups = cell, OpenTable(), []
            g, key = table.place(h, normalised(text)), _key(*best)
            if g == len(groups):
                groups.append([[rec], key, members])
            else:
                groups[g][0].append(rec)
                groups[g][1] = min(groups[g][1], key)
                groups[g][2] += members
    if groups:
        yield done()


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bucket_bytes: int = 64 << 20, split_bits: int = 4) -> tuple[DataFrame, DataFrame]:
    """(spilled rows: row, row_id, rec_id, sha ...; rec_id, keep_id, keep_row, group_size of each record of them)."""
    spill = _spill(docs, text, doc_id)
    records = spill.filter(F.col("row_id") == F.col("rec_id")).select("rec_id", "h", "n_bytes", F.col("row")[text].alias("text"), "members", "best_chars", "best_id", "best_row")
    records, rounds = _cooled(records)
    records, tasks = _buckets(records, bucket_bytes, split_bits)
    dealt = records.select("task", "bucket", "rec_id", "h", "text", "members", "best_chars", "best_id", "best_row").repartitionById(tasks, "task").sortWithinPartitions("bucket").drop("task")
    found = common.written(dealt.mapInArrow(_resolve, "rec_id long, keep_id long, keep_row long, group_size long"), "resolved")
    for folded in reversed(rounds):
        found = found.unionByName(folded.join(found.withColumnRenamed("rec_id", "lead"), "lead").select("rec_id", "keep_id", "keep_row", "group_size"))
    return spill, found


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept (this row stays), text_sha256."""
    spill, found = exact_groups(docs, text, doc_id, **options)
    return spill.select("rec_id", "row_id", F.col("row")[doc_id].alias("doc_id"), "sha").join(found, "rec_id").select("doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def exact_distinct(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    spill, found = exact_groups(docs, text, doc_id, **options)
    slim = spill.select("rec_id", "row_id").join(found, "rec_id").filter(F.col("row_id") != F.col("keep_row")).select(F.col("row_id").alias("gone"))
    return spill.join(slim, F.col("row_id") == F.col("gone"), "left_anti").select("row.*")
