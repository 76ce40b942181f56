"""Near-duplicate vectors by an exact metric range join.

Unit vectors of cosine c are sqrt(2 - 2c) apart, so links are pairs within that radius r. Pivots, drawn from each label
by hash, divide its vectors into the cells of their nearest pivot, whatever the label's size; a cell of more than
``cell_rows`` vectors is divided again by pivots of its own. A vector x at distance d(x, home) also goes to the
cell of pivot p when a vector within r of x may live there: by the triangle inequality only if
d(x, p) - d(x, home) <= 2r, and in Euclidean space only if (d(x, p)^2 - d(x, home)^2) / (2 d(home, p)) <= r. Of two cells
that are open to each other's vectors only the later one is visited, so a pair meets in one cell.
Cells are joined independently, each as blocks of two parts of bounded size, compared a tile at a time, so neither a dense cell nor
a hot label lands in one task. A vector goes once to each part of its cell, as the bytes it came with: parts are as large as a
task's memory allows, since what is shuffled grows with their number. A block counts links and returns a star of each of its
components, not the pairs. Equal vectors are one vector with a count from the start, told by their bytes' SHA-256.

Vectors with little structure in many dimensions are nearly equally far from all pivots. A sample of each cell tells; such a
label is divided by two pivots only, and its cells no further: the result stays exact, the work then grows with the square of a
label's size.

Defined cases: a null label, a null, empty or zero vector, or one with null or non-finite components links with nothing;
vectors of different lengths never link. A null vec_id is never a component's smallest id if there is another; rows that
repeat an id are each returned and count as other vectors. ``kept`` says vec_id = component_id: null for a null id, true for
each row that repeats such an id. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from topicloom.operators.joins import with_counts
from topicloom.operators.metric import pivot_cells

from . import common
from .components import components, hub_join, hub_limit


#: Rows and bytes of vectors of a part of a cell, rows and columns of a tile.
PART_ROWS, PART_BYTES, TILE, WIDE = 32_768, 1 << 26, 1_024, 4_096


def _join_all(top: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``top`` (the smallest row of each row's component) after links between the rows ``u`` and ``v``."""
    while True:
        a, b = top[u], top[v]
        apart = a != b
        if not apart.any():
            return top
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(top, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = top[top]
            if np.array_equal(up, top):
                break
            top = up


def near_vectors(vectors: DataFrame, cosine: float = 0.93, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cell_rows: int = 1024, part_rows: int = PART_ROWS) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept."""
    radius = float(np.sqrt(2 - 2 * cosine))
    kind = vectors.schema[embedding].dataType
    short = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    number = np.float32 if short else np.float64
    v, limit = F.col("v"), F.lit(float("inf"))
    sound = F.col("label").isNotNull() & v.isNotNull() & (F.size("v") > 0)
    sound &= F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit)), F.lit(False)) & F.coalesce(F.exists("v", lambda x: x != 0.0), F.lit(False))
    # Vectors of one label and length may meet: they are one cell at first. Other rows have none.
    cell = F.when(F.coalesce(sound, F.lit(False)), F.concat(F.col("label").cast("string"), F.lit("|"), F.size("v").cast("string")))
    read = vectors.select(F.monotonically_increasing_id().alias("row_id"), F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast("array<float>" if short else "array<double>").alias("v"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vs = batch.column(3)
            flat, at = vs.values.to_numpy(zero_copy_only=False), vs.offsets.to_numpy()
            units = [None if c is None else flat[a:b].astype(number).tobytes() for c, a, b in zip(batch.column(2).to_pylist(), at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(units, pa.binary())], names=["row_id", "vec_id", "cell", "unit"])

    def matrix(units: pa.ChunkedArray) -> np.ndarray:
        """Unit vectors of vectors of one length, from their bytes."""
        parts = units.to_pylist()
        x = np.frombuffer(b"".join(parts), number).reshape(len(parts), -1).astype(np.float64)
        if x.size:
            x /= np.abs(x).max(axis=1, keepdims=True)
            x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        return x

    id_type = read.schema["vec_id"].dataType.simpleString()
    rows = common.written(read.select("row_id", "vec_id", cell.alias("cell"), "v").mapInArrow(packed, f"row_id long, vec_id {id_type}, cell string, unit binary").withColumn("digest", F.unhex(F.sha2("unit", 256))), "vectors")
    keys = common.written(rows.drop("unit"), "keys")
    order = F.struct(F.col("vec_id").isNull().alias("none"), F.col("vec_id").alias("id"), F.col("row_id").alias("at"))
    classes = common.written(keys.filter("cell is not null").groupBy("cell", "digest").agg(F.min("row_id").alias("node"), F.count("*").alias("copies"), F.min(order).alias("best")), "classes")
    # Few vectors have copies as a rule: then their table is broadcast, and the vectors stay where they are.
    many = common.written(classes.filter("copies > 1").select("cell", "digest", "node", "copies"), "copies")
    unit = rows.filter("cell is not null").join(many, ["cell", "digest"], "left").filter("node is null or node = row_id").select("cell", F.col("row_id").alias("node"), F.coalesce("copies", F.lit(1).cast("long")).alias("copies"), "unit")
    dealt = pivot_cells(unit, radius, cell_rows, always=True, once=True, read=matrix)
    common.drop_table(rows)
    # Blocks: each pair of a cell's parts is one; a vector goes to those of its own part.
    sized = with_counts(dealt, "cell", _n=F.count("*"), _b=F.sum(F.octet_length("unit")))
    placed = sized.withColumn("parts", F.greatest(F.ceil(F.col("_n") / part_rows), F.ceil(F.col("_b") / PART_BYTES)).cast("int")).withColumn("part", F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int"))
    met = placed.select("cell", "part", "home", "node", "copies", "unit", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    met = met.select("cell", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), F.col("part") <= F.col("other"), "home", "node", "copies", "unit").toDF("cell", "i", "j", "first", "home", "node", "copies", "unit")

    def join(block: pa.Table) -> pa.Table:
        home, first = block["home"].to_numpy(), block["first"].to_numpy()
        turn = np.lexsort((~home, ~first))  # the first part's rows, those at home before visitors, then the other part's
        home, first, x = home[turn], first[turn], matrix(block["unit"])[turn]
        node, copies = block["node"].to_numpy()[turn], block["copies"].to_numpy()[turn]
        n, split = len(node), int(first.sum())
        same = bool(n) and block["i"][0].as_py() == block["j"][0].as_py()
        links, top = np.zeros(n, np.int64), np.arange(n)
        begin = 0 if same else split
        others = home[begin:].sum()  # visitors meet only rows at home
        for lo in range(0, split, TILE):
            hi = min(split, lo + TILE)
            for at in range(lo if same else begin, n if home[lo] else begin + others, WIDE):
                to = min(n, at + WIDE)
                mask = x[lo:hi] @ x[at:to].T >= cosine
                mask &= home[lo:hi, None] | home[at:to]
                if same:
                    mask &= np.arange(lo, hi)[:, None] < np.arange(at, to)
                u, v = np.nonzero(mask)
                if len(u):
                    u, v = u + lo, v + at
                    np.add.at(links, u, copies[v])
                    np.add.at(links, v, copies[u])
                    top = _join_all(top, u, v)
        hit = np.flatnonzero(links)
        return pa.table({"node": node[hit], "links": links[hit], "other": node[top[hit]]})

    blocks = ["cell", "i", "j"]
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # blocks are small in bytes and costly: not to be put together
    found = common.written(met.repartition(tasks, *blocks).groupBy(*blocks).applyInArrow(join, "node long, links long, other long"), "links")
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found, "node", "other")
    grouped = common.written(classes.select("node", "best").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")), "grouped")
    best = grouped.groupBy("component").agg(F.min("best").alias("first"), F.count("*").alias("c"))
    answer = hub_join(grouped, best, "component", hub_limit(grouped.count())).join(counted, "node", "left").select("node", F.coalesce("links", F.lit(0)).alias("links"), "first")
    of = keys.filter("cell is not null").join(classes.select("cell", "digest", "node", "copies"), ["cell", "digest"])
    sound_rows = of.join(answer, "node").select("vec_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("first.id").cast("long").alias("component_id"), (F.col("vec_id") == F.col("first.id")).alias("kept"))
    return sound_rows.unionByName(keys.filter("cell is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), (F.col("vec_id") == F.col("vec_id")).alias("kept")))
