"""What the text operators share: tables in the shared folder, Arrow text buffers and rolling hashes.

Every hash here is a function of the bytes alone, so a task that is run again gives the same rows.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.sources import tables
from topicloom.sources.tables import drop_table, new_folder

__all__ = ["BASE", "LOWER", "buffers", "bounded_batches", "drop_table", "free_name", "held", "id_crc32", "mix", "new_folder", "release", "shingle_hashes", "slices", "table", "word_hashes", "words", "written"]

#: Odd multiplier of the rolling polynomial hash, modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


_HELD: dict[str, object] = {}


def held(name: str, make: Callable[[], object]) -> object:
    """What a worker process keeps between tasks (a vocabulary with its cache, a lattice): one such thing at a time."""
    if name not in _HELD:
        release()
        _HELD[name] = make()
    return _HELD[name]


def release(always: bool = False) -> None:
    """Gives back what other operators' tasks left in this worker process, or what was used on the driver (``always``)."""
    if _HELD or always:
        _HELD.clear()
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # another C library: memory goes back when it likes
            pass


@contextmanager
def bounded_batches(spark: SparkSession, rows: int = 256, size: int = 16 << 20) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows and ``size`` bytes while a job runs; the session's own settings come back."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as a table in the shared folder, by tasks with bounded batches, and read back."""
    with bounded_batches(df.sparkSession):
        return tables.written(df, label)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores after it as it takes that ``docs`` has no such column in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_crc32(col: str | Column) -> Column:
    """crc32 of an id's decimal text; null for a null id."""
    return F.crc32((F.col(col) if isinstance(col, str) else col).cast("string").cast("binary"))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of n + 1) of a string column; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, dtype=np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    body = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int):
    """Ranges (i, j) of texts of about ``most`` bytes together, so that work arrays stay small; one text is never cut."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix64's finisher)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(16, int(n).bit_length())
        for key, base in (("up", BASE), ("down", BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[key] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


#: ASCII letters to lower case; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(body: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text: n + 1) of the runs of bytes for which the 256-entry table ``is_word`` is true.

    A run ends where its text ends.
    """
    inside = is_word[body]
    before = np.zeros(len(body) + 1, np.int8)
    before[1:] = inside
    edge = np.zeros(len(body) + 1, bool)
    edge[offsets[:-1]] = True  # texts begin here
    start = inside & (~before[:-1].astype(bool) | edge[:-1])
    stops = np.empty(len(body) + 1, bool)
    stops[:-1] = ~inside | edge[:-1]
    stops[-1] = True
    starts = np.flatnonzero(start)
    ends = np.flatnonzero(stops[1:] & before[1:].astype(bool)) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of bytes, by differences of one prefix sum."""
    up, down = _powers(len(body) + 1)
    total = np.zeros(len(body) + 1, np.uint64)
    np.cumsum((body.astype(np.uint64) + np.uint64(1)) * up[: len(body)], out=total[1:], dtype=np.uint64)
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on; the last k - 1 words have none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(BASE) + hashes[j : j + n]
    return mix(out)
