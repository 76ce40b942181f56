"""Sales beside the version of their client that was valid when they were made, by a stateful streaming query.

Both tables are cut into batches by their day, written to the shared folder, and fed in order to one streaming query that is
started anew for each batch on one checkpoint. It reads sales and changes as one stream, dealt by cells of clients, and keeps
for each cell two lists: the unpruned versions, sorted by client, valid_at, seq and change_id, and the sales that wait. With
every batch each cell gets a clock row that carries both watermarks. Then, in this order: late changes are told, others are
merged into the sorted versions; sales that are due find their version by bisection and are emitted; the versions that the
smaller watermark has passed are pruned, all but the last of each client. A last start with an open clock empties the lists.

A cell is a group of clients of about ``CELL`` rows, not one client: a call into the state store takes about as long for one
client as for a cell, and a list's elements are sorted chunks of rows for the same reason. Work inside a cell is done for all
its clients at once. A client with more rows than a cell's (fewer than ``HUBS`` of them, whatever the tables' size; they are
found by partial counts and broadcast) is dealt to several cells: its sales by their id, its versions to each of them, so that
each cell has the client's whole version list. Nothing that grows with the input goes through the driver or one task: the
driver sees two maxima for each batch.

Defined cases: equal rows of changes are one version; a change without valid_at is left out, a null change_id counts as crc32 0
for its batch, and null seq and change_id come before others in a client's order (then balance_cents and op decide); a sale
without client has no versions, one without arrived_at comes with the last batch, days before the first with the first; a sale
without sold_at is emitted at once and has no version; rows that repeat a sale_id are each emitted; a balance that is null, not finite
or beyond a long's range has null cents; empty tables give an empty result. Other columns are only looked at for equal rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from . import common

#: Rows of both tables in a cell; clients with more rows than a cell, or than one in HUBS of all, are dealt to SALTS cells at most.
CELL, HUBS, SALTS = 16_384, 5_000, 32

#: Rows of a batch that one task of the streaming query takes, about.
TASK = 250_000

#: Rows of an element of a list in the state.
CHUNK = 8_192

#: What a row of the stream is.
CLOCK, CHANGE, SALE = 0, 1, 2

#: Stands for a null number on the stream; ``flags`` tell it from the number itself.
_NONE = -(1 << 63)

_ID, _CLIENT, _AT, _CENTS, _CHANGE = 1, 2, 4, 8, 16

_STREAM = "cell long, kind int, first boolean, flags int, id long, client long, at long, seq long, cents long, op string, batch long, sales_mark long, changes_mark long, last boolean"
_FOUND = "rec int, id long, batch long, n_held long, flags int, change_id long, cents long, op string"

_VERSION = pa.schema([("client", pa.int64()), ("at", pa.int64()), ("seq", pa.int64()), ("id", pa.int64()), ("cents", pa.int64()), ("flags", pa.int32()), ("op", pa.string())])
_SALE = pa.schema([("client", pa.int64()), ("at", pa.int64()), ("id", pa.int64()), ("flags", pa.int32())])


def micros(at: Column) -> Column:
    """Microseconds since 1970 of a time without a zone (of one with a zone: of the session's clock)."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), at.cast("timestamp_ntz"))


def cents(balance: Column) -> Column:
    """floor(100 * balance + 0.5); null where a long can't hold it."""
    value = F.floor(balance.cast("double") * 100 + 0.5)
    return F.when(F.abs(balance.cast("double")) < 9e16, value.cast("long"))


def batch_of(day: Column, batches: int, first: int, days: int) -> Column:
    """The batch of a day; ``least`` skips nulls, so without a day it is the last one."""
    return F.greatest(F.lit(0), F.least(F.lit(batches - 1), F.floor((day - first) * batches / days).cast("int")))


def _flag(*nulls: tuple[Column, int]) -> Column:
    total = F.lit(0)
    for is_null, bit in nulls:
        total = total + F.when(is_null, bit).otherwise(0)
    return total


def _known(c: Column) -> Column:
    return F.coalesce(c.cast("long"), F.lit(_NONE).cast("long"))


def cut(sales: DataFrame, changes: DataFrame, batches: int, first: int, days: int) -> DataFrame:
    """Both tables as rows of one stream, but for cell and clock: kind, flags, id, client, at, seq, cents, op, batch."""
    epoch = F.lit("1970-01-01").cast("date")
    day = lambda c: F.date_diff(c.cast("date"), epoch)
    s = sales.select("sale_id", "client_id", "sold_at", batch_of(day(F.col("arrived_at")), batches, first, days).alias("batch"))
    s = s.select(
        F.lit(SALE).alias("kind"),
        _flag((F.col("sale_id").isNull(), _ID), (F.col("client_id").isNull(), _CLIENT), (F.col("sold_at").isNull(), _AT)).alias("flags"),
        _known(F.col("sale_id")).alias("id"),
        _known(F.col("client_id")).alias("client"),
        _known(micros(F.col("sold_at"))).alias("at"),
        F.lit(0).cast("long").alias("seq"),
        F.lit(0).cast("long").alias("cents"),
        F.lit(None).cast("string").alias("op"),
        "batch",
    )
    late = F.coalesce(F.crc32(F.col("change_id").cast("string").cast("binary")), F.lit(0)) % 4
    c = changes.filter(F.col("valid_at").isNotNull()).distinct()
    c = c.select(
        F.lit(CHANGE).alias("kind"),
        _flag((F.col("change_id").isNull(), _ID), (F.col("client_id").isNull(), _CLIENT), (cents(F.col("balance")).isNull(), _CENTS)).alias("flags"),
        _known(F.col("change_id")).alias("id"),
        _known(F.col("client_id")).alias("client"),
        micros(F.col("valid_at")).alias("at"),
        _known(F.col("seq")).alias("seq"),
        _known(cents(F.col("balance"))).alias("cents"),
        "op",
        batch_of(day(F.col("valid_at")) + late.cast("int"), batches, first, days).alias("batch"),
    )
    return s.unionByName(c)


def dealt(rows: DataFrame, cell: int = CELL) -> tuple[DataFrame, DataFrame]:
    """(``rows`` with cell and first, each cell once). ``first``: of a version that goes to several cells, one row only."""
    counts = common.written(rows.groupBy("client").agg(F.count("*").alias("n"), F.sum((F.col("kind") == SALE).cast("int")).alias("sales")), "clients")
    total = counts.agg(F.sum("n")).first()[0] or 0
    cells, limit = max(1, -(-total // cell)), max(cell, total // HUBS)
    # Fewer than HUBS clients have more than one in HUBS of all rows: this table is bounded.
    hot = counts.filter((F.col("n") > limit) & (F.col("client") != _NONE)).select(F.col("client").alias("_hot"), F.least(F.lit(SALTS), F.ceil(F.col("sales") / limit)).cast("int").alias("_salts")).filter("_salts > 1")
    met = rows.join(F.broadcast(hot), F.col("client") == F.col("_hot"), "left").withColumn("_salts", F.coalesce("_salts", F.lit(1)))
    own = F.when((F.col("_salts") > 1) & (F.col("kind") == SALE), F.array(F.pmod(F.xxhash64("id"), F.col("_salts")).cast("int")))
    own = F.coalesce(own, F.when(F.col("_salts") > 1, F.sequence(F.lit(0), F.col("_salts") - 1)).otherwise(F.array(F.lit(0))))
    # A sale without client meets no version: any cell will do.
    by = F.when(F.col("client") == _NONE, F.xxhash64("id")).otherwise(F.xxhash64("client"))
    home = lambda c: F.pmod(c, F.lit(cells)) * F.lit(SALTS)
    placed = met.select(*rows.columns, home(by).alias("_home"), F.explode(own).alias("_salt"))
    placed = placed.select((F.col("_home") + F.col("_salt")).cast("long").alias("cell"), (F.col("_salt") == 0).alias("first"), *rows.columns)
    more = hot.select(home(F.xxhash64("_hot")).alias("_home"), F.explode(F.sequence(F.lit(1), F.col("_salts") - 1)).alias("_salt")).select((F.col("_home") + F.col("_salt")).cast("long").alias("cell"))
    every = rows.sparkSession.range(cells).select((F.col("id") * SALTS).alias("cell")).unionByName(more).distinct()
    return placed, every


def _bisect(at: np.ndarray, lo: np.ndarray, hi: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For each range lo .. hi of the sorted ``at``: how far its elements are at most ``wanted``. All ranges are halved at once."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        below = open_ & (at[np.minimum(mid, len(at) - 1)] <= wanted)
        lo = np.where(below, mid + 1, lo)
        hi = np.where(open_ & ~below, mid, hi)
    return lo


class Enricher(StatefulProcessor):
    """The two lists of one cell."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.versions = handle.getListState("versions", "chunk binary")
        self.waiting = handle.getListState("waiting", "chunk binary")

    def close(self) -> None:
        pass

    @staticmethod
    def _read(state, schema: pa.Schema) -> dict[str, np.ndarray]:
        batches = [pa.ipc.read_record_batch(pa.py_buffer(bytes(chunk)), schema) for (chunk,) in state.get()] if state.exists() else []
        table = pa.Table.from_batches(batches, schema)
        return {name: table[name].to_numpy() for name in schema.names}

    @staticmethod
    def _keep(state, rows: dict[str, np.ndarray], schema: pa.Schema) -> None:
        batch = pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type, from_pandas=True) for f in schema], schema=schema)
        if batch.num_rows:
            state.put([(batch.slice(i, CHUNK).serialize().to_pybytes(),) for i in range(0, batch.num_rows, CHUNK)])
        elif state.exists():
            state.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        take = lambda what, schema: {n: new[n].to_numpy()[what] for n in schema.names}
        kind = new["kind"].to_numpy()
        clock = new[kind == CLOCK].iloc[0]
        batch, last = int(clock["batch"]), bool(clock["last"])
        horizon, late_before = min(int(clock["sales_mark"]), int(clock["changes_mark"])), int(clock["changes_mark"])

        is_late = (kind == CHANGE) & (new["at"].to_numpy() < late_before)
        told = take(is_late & new["first"].to_numpy(), _VERSION)
        if len(told["id"]):
            yield self._shown(CHANGE, told["id"], told["flags"] & _ID, batch)

        held, fresh = self._read(self.versions, _VERSION), take((kind == CHANGE) & ~is_late, _VERSION)
        merged = {n: np.concatenate([held[n], fresh[n]]) for n in _VERSION.names}
        if len(fresh["id"]):
            names = pd.Series(merged["op"]).fillna("").to_numpy(dtype=object)
            order = np.lexsort((np.unique(names.astype(str), return_inverse=True)[1], merged["cents"], merged["id"], merged["seq"], merged["at"], merged["client"]))
            merged = {n: a[order] for n, a in merged.items()}
        clients, begin = np.unique(merged["client"], return_index=True)
        end = np.append(begin[1:], len(merged["client"]))

        sales, more = self._read(self.waiting, _SALE), take(kind == SALE, _SALE)
        sales = {n: np.concatenate([sales[n], more[n]]) for n in _SALE.names}
        undated = (sales["flags"] & _AT) > 0
        due = np.ones(len(undated), bool) if last else undated | (sales["at"] < horizon)
        if due.any():
            now = {n: a[due] for n, a in sales.items()}
            yield self._emitted(now, merged, clients, begin, end, batch)
        if due.any() or len(more["id"]):
            self._keep(self.waiting, {n: a[~due] for n, a in sales.items()}, _SALE)

        if last:
            self.versions.clear()
            return
        passed = _bisect(merged["at"], begin, end, np.full(len(begin), horizon))
        stays = np.arange(len(merged["at"])) >= np.repeat(np.maximum(begin, passed - 1), end - begin)
        if len(fresh["id"]) or not stays.all():
            self._keep(self.versions, {n: a[stays] for n, a in merged.items()}, _VERSION)

    def _emitted(self, now, merged, clients, begin, end, batch) -> pd.DataFrame:
        n = len(now["id"])
        place = np.searchsorted(clients, now["client"])
        known = (place < len(clients)) & ((now["flags"] & _CLIENT) == 0)
        known[known] = clients[place[known]] == now["client"][known]
        lo, hi = np.zeros(n, np.int64), np.zeros(n, np.int64)
        lo[known], hi[known] = begin[place[known]], end[place[known]]
        upto = _bisect(merged["at"], lo, hi, now["at"]) if len(merged["at"]) else lo
        has = (upto > lo) & ((now["flags"] & _AT) == 0)
        pick = np.where(has, upto - 1, 0)
        one = lambda name, fill: np.where(has, merged[name][pick], fill) if len(merged["at"]) else np.full(n, fill)
        own = one("flags", 0).astype(np.int64)
        flags = (now["flags"] & _ID) | np.where(~has | ((own & _ID) > 0), _CHANGE, 0) | np.where(~has | ((own & _CENTS) > 0), _CENTS, 0)
        return self._shown(SALE, now["id"], flags, batch, hi - lo, one("id", 0), one("cents", 0), one("op", None))

    @staticmethod
    def _shown(rec: int, ids, flags, batch: int, held=None, change=None, cents_=None, op=None) -> pd.DataFrame:
        n, long = len(ids), lambda x: np.zeros(len(ids), np.int64) if x is None else np.asarray(x).astype(np.int64)
        return pd.DataFrame({"rec": np.full(n, rec, np.int32), "id": long(ids), "batch": np.full(n, batch, np.int64), "n_held": long(held), "flags": np.asarray(flags).astype(np.int32), "change_id": long(change), "cents": long(cents_), "op": pd.Series([None] * n if op is None else list(op), dtype=object)})


@contextmanager
def _settings(spark: SparkSession, **names: str) -> Iterator[None]:
    """Settings while a query starts; the session's own come back."""
    names = {k.replace("__", "."): v for k, v in names.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def marks(pieces: DataFrame, batches: int, hours: int = 36) -> list[tuple[int, int]]:
    """(watermark of sales, of changes) that holds in each batch, in microseconds. Two maxima of each batch come to the driver."""
    known = pieces.filter(F.col("flags").bitwiseAND(_AT) == 0).groupBy("batch").agg(*[F.max(F.when(F.col("kind") == k, F.col("at"))).alias(f"m{k}") for k in (SALE, CHANGE)])
    best = {r["batch"]: (r[f"m{SALE}"], r[f"m{CHANGE}"]) for r in known.collect()}
    out, most = [], [None, None]
    for b in range(batches):
        out.append(tuple(_NONE if m is None else m - hours * 3_600_000_000 for m in most))
        most = [max((x for x in (m, n) if x is not None), default=None) for m, n in zip(most, best.get(b, (None, None)), strict=True)]
    return out


def enrich(sales: DataFrame, changes: DataFrame, batches: int = 10, first: int = 19_723, days: int = 152, hours: int = 36, cell: int = CELL) -> DataFrame:
    """rec (sale or late), id, batch, n_held, change_id, balance_cents, op.

    sales: sale_id, client_id, sold_at, arrived_at; changes: change_id, client_id, seq, op, valid_at, balance. ``first`` is the first
    batch's first day since 1970, ``days`` are cut into ``batches``.
    """
    spark = sales.sparkSession
    placed, cells = dealt(cut(sales, changes, batches, first, days), cell)
    base = common.new_folder(spark, "enrichment")
    placed.write.partitionBy("batch").parquet(f"{base}/pieces")
    cells.coalesce(8).write.parquet(f"{base}/cells")
    columns = [x.split()[0] for x in _STREAM.split(", ")]
    pieces = spark.read.schema(_STREAM.partition(", sales_mark")[0]).parquet(f"{base}/pieces")
    cells = spark.read.schema("cell long").parquet(f"{base}/cells")
    zero = F.lit(0).cast("long")
    clocks = cells.select("cell", F.lit(CLOCK).alias("kind"), F.lit(False).alias("first"), F.lit(0).alias("flags"), *[zero.alias(c) for c in ("id", "client", "at", "seq", "cents")], F.lit(None).cast("string").alias("op"))
    n = pieces.count()
    tasks = max(spark.sparkContext.defaultParallelism, -(-n // (batches * TASK)))
    held = marks(pieces, batches, hours)
    for b in range(batches + 1):
        end = b == batches
        clock = lambda rows, sm, cm, b=b, end=end: rows.withColumns({"batch": F.lit(b).cast("long"), "sales_mark": F.lit(sm).cast("long"), "changes_mark": F.lit(cm).cast("long"), "last": F.lit(end)}).select(*columns)
        sm, cm = (_NONE, _NONE) if end else held[b]
        rows = clock(clocks, sm, cm)
        if not end:
            rows = clock(pieces.filter(F.col("batch") == b), sm, cm).unionByName(rows)
        rows.write.mode("append").parquet(f"{base}/feed")
        with _settings(
            spark,
            spark__sql__shuffle__partitions=str(tasks),
            spark__sql__streaming__stateStore__providerClass="org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
            # Small stores needn't reserve room for their logs. A start has one batch, so a store that stays open after its task is only
            # memory and disk: there are as many as shuffle partitions, whatever the cells. Lists are read once, and Spark does not give
            # back the block cache of a store that it closes: none is kept.
            spark__sql__streaming__stateStore__rocksdb__allowFAllocate="false",
            spark__sql__streaming__stateStore__rocksdb__blockCacheSizeMB="0",
            spark__sql__streaming__stateStore__unloadOnCommit="true",
        ):
            stream = spark.readStream.schema(_STREAM).parquet(f"{base}/feed")
            found = stream.groupBy("cell").transformWithStateInPandas(Enricher(), _FOUND, "Append", "None")
            query = found.writeStream.format("parquet").outputMode("append").option("path", f"{base}/found").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
            query.awaitTermination()
    rows = spark.read.schema(_FOUND).parquet(f"{base}/found")
    sale = F.col("rec") == SALE
    shown = lambda bit, c: F.when(F.col("flags").bitwiseAND(bit) == 0, F.col(c))
    return rows.select(
        F.when(sale, "sale").otherwise("late").alias("rec"),
        shown(_ID, "id").alias("id"),
        "batch",
        F.when(sale, F.col("n_held")).alias("n_held"),
        F.when(sale, shown(_CHANGE, "change_id")).alias("change_id"),
        F.when(sale, shown(_CENTS, "cents")).alias("balance_cents"),
        F.when(sale, F.col("op")).alias("op"),
    )
