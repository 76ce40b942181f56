"""Cells for range joins of vectors: a tree of pivots that is divided where it has to be.

A cell with too many vectors of its own gets pivots of its own, drawn from it by hash, and each of its vectors goes to the child
of the nearest pivot (there it is at home) and, as a visitor, to each child in which a vector within the radius may be at home:
not beyond the plane between both pivots by more than the radius, and not farther from the pivots than the triangle inequality
allows. Children that are still too large are divided in the next round, so no number of pivots is fixed, and rounds grow with
the logarithm of the table. What a division would save is estimated from a sample of the cell that every task sees alike; where
vectors have so little structure that it saves little, the cell stays whole. So any two vectors within the radius meet in the home
of either one. A round is one shuffle of the vectors in cells that are divided; a cell is dealt in chunks of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.sources.tables import written

from .joins import with_counts, with_values

#: Most pivots of one division, rows that tell whether it pays, rows of a chunk, rounds at most.
FAN, SAMPLE, CHUNK, ROUNDS = 32, 256, 20_000, 40

#: Blocks of a cell before they get larger than asked for, and rows of a block at most.
BLOCKS, MOST_ROWS = 16, 65_536

#: A division is kept if it leaves less than this share of the comparisons.
PAYS = 0.9


def matrix(units: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of float64 vectors of one length, from their bytes."""
    parts = [u for u in units.to_pylist()]
    return np.frombuffer(b"".join(parts), np.float64).reshape(len(parts), -1)


def reach(x: np.ndarray, pivots: np.ndarray, radius: float | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(home of each vector, vectors x pivots: whether a vector within ``radius`` of it may be at home there).

    ``radius`` is one number or one for each vector.
    """
    radius = np.asarray(radius, np.float64).reshape(-1, 1)
    square, own = (pivots**2).sum(axis=1), (x**2).sum(axis=1)
    between = np.sqrt(np.maximum(0, square[:, None] + square[None, :] - 2 * pivots @ pivots.T))
    d2 = np.maximum(0, own[:, None] + square[None, :] - 2 * x @ pivots.T)
    home = d2.argmin(axis=1)
    at = np.arange(len(x))
    d = np.sqrt(d2)
    goes = (d2 - d2[at, home][:, None] <= 2 * radius * between[home] + 1e-9) & (d - d[at, home][:, None] <= 2 * radius + 1e-9)
    goes[at, home] = True
    return home, goes


def _dealer(radius: float | None, force: bool, alone: Callable[[np.ndarray], np.ndarray] | None, kept: list[str], once: bool, matrix: Callable[[pa.ChunkedArray], np.ndarray]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A function of a chunk of a cell and the cell's guides (pivots and samples): the chunk's rows in the cell's children."""

    def deal(part: pa.Table, guide: pa.Table) -> pa.Table:
        names = ["cell", "final", "home", *kept]
        if not part.num_rows:
            return pa.table({c: part[c] if c != "final" else pa.array([], pa.bool_()) for c in names})
        own_guide = guide.filter(guide["_home"]).sort_by("_r")
        fan = own_guide["_fan"][0].as_py() if own_guide.num_rows else 0
        pivots, homes = (matrix(own_guide["unit"])[:fan], matrix(own_guide["unit"])[fan:]) if fan else (np.zeros((0, 1)), np.zeros((0, 1)))
        reach_of = lambda t: radius if radius is not None else t["radius"].to_numpy()
        x = matrix(part["unit"])
        if len(pivots) > 1:
            looking = own_guide.slice(fan) if radius is not None else guide.filter(pc.invert(guide["_home"]))
            goes = reach(matrix(looking["unit"]), pivots, reach_of(looking))[1] if looking.num_rows else np.ones((1, len(pivots)), bool)
            share = np.bincount(reach(homes, pivots, 0.0)[0], minlength=len(pivots)) / max(1, len(homes)) if len(homes) else np.ones(len(pivots))
            if (share * goes.mean(axis=0)).sum() > PAYS:
                pivots = pivots[: 2 * force]
        if len(pivots) < 2:
            return pa.table({"cell": part["cell"], "final": pa.array(np.ones(len(x), bool)), "home": part["home"], **{c: part[c] for c in kept}})
        home, goes = reach(x, pivots, reach_of(part))
        own = np.array(part["home"].to_pylist(), bool)
        if alone is not None:
            goes &= ~alone(x)[:, None]
        if once:
            goes &= ~own[:, None] | (np.arange(len(pivots)) > home[:, None])
        goes[np.flatnonzero(own), home[own]] = True
        r, c = np.nonzero(goes)
        base = part["cell"][0].as_py()
        children = pa.array([f"{base}/{k}" for k in range(len(pivots))], pa.string())
        take = pa.array(r)
        return pa.table({"cell": children.take(pa.array(c)), "final": pa.array(np.zeros(len(r), bool)), "home": pa.array(own[r] & (home[r] == c)), **{name: part[name].take(take) for name in kept}})

    return deal


def pivot_cells(vectors: DataFrame, radius: float | None, limit: int = 1024, always: bool = False, alone: Callable[[np.ndarray], np.ndarray] | None = None, once: bool = False, read: Callable[[pa.ChunkedArray], np.ndarray] = matrix) -> DataFrame:
    """cell, home and the other columns of ``vectors``, a row for each cell of each vector.

    vectors: cell (string; vectors of different cells never meet), node (long, different for each row), unit (float64 bytes of one
    length in a cell), more columns. ``limit``: home vectors of a cell that isn't divided. ``always``: each cell of two vectors or
    more is divided once, by two pivots where it doesn't pay. ``alone(matrix)`` tells vectors that reach no other: they only are at
    home. ``once``: a vector at home in a child visits only those after it, so two vectors meet in one cell: both at home, or one.
    ``read`` gives the vectors of other bytes than those of float64. Without a common ``radius``, ``vectors`` has columns home and radius: rows that aren't at home look for those that are,
    within a radius of their own.
    """
    columns = [c for c in vectors.columns if c not in ("cell", "home")]
    live = vectors.select("cell", "home" if radius is None else F.lit(True).alias("home"), *columns)
    leaves: list[DataFrame] = []
    for depth in range(ROUNDS):
        least = 1 if always and depth == 0 else limit
        live = written(live, "live") if depth == 0 else live
        sized = with_counts(live, "cell", _h=F.sum(F.col("home").cast("int")), _n=F.count("*"))
        leaves.append(sized.filter(F.col("_h") <= least).drop("_h", "_n"))
        large = sized.filter(F.col("_h") > least)
        if large.isEmpty():
            break
        force = always and depth == 0
        fan = F.greatest(F.lit(2), F.least(F.lit(FAN), F.ceil(F.col("_h") / limit))).cast("int")
        chunks = F.ceil(F.col("_n") / CHUNK).cast("int")
        turn = F.xxhash64("node", F.lit(depth))
        # Pivots come from vectors at home, samples from them and from those that look for them.
        some = large.select("cell", "unit", *([] if radius is not None else ["radius"]), F.col("home").alias("_home"), fan.alias("_fan"), chunks.alias("_chunks"), turn.alias("_turn"), "node", F.when(F.col("home"), F.col("_h")).otherwise(F.col("_n") - F.col("_h")).alias("_of"))
        some = some.filter("_home") if radius is not None else some
        few = some.filter(F.pmod(F.col("_turn"), F.col("_of")) < 4 * SAMPLE)  # about 4 * SAMPLE rows of a large cell, all of a small one
        first = few.withColumn("_r", F.row_number().over(Window.partitionBy("cell", "_home").orderBy("_turn", "node"))).filter(F.col("_r") <= FAN + SAMPLE)
        guides = first.select(F.col("cell").alias("cell"), F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_chunk"), "_home", "_r", "_fan", *[F.col(c).alias(c) for c in first.columns if c in ("unit", "radius")])
        rows = large.withColumn("_chunk", F.pmod(F.xxhash64("node", F.lit(-1)), chunks).cast("int")).drop("_h", "_n")
        kept = [c for c in rows.columns if c not in ("cell", "_chunk", "home")]
        schema = ", ".join(["cell string", "final boolean", "home boolean", *[f"{f.name} {f.dataType.simpleString()}" for f in large.schema if f.name in kept]])
        dealt = written(rows.groupBy("cell", "_chunk").cogroup(guides.groupBy("cell", "_chunk")).applyInArrow(_dealer(radius, force, alone, kept, once, read), schema), "dealt")
        leaves.append(dealt.filter("final").drop("final"))
        live = dealt.filter("not final").drop("final")
    else:
        leaves.append(live)
    out = leaves[0]
    for leaf in leaves[1:]:
        out = out.unionByName(leaf)
    return out


def blocks(n: Column, block: int) -> Column:
    """Blocks of a cell of ``n`` rows. Each row goes to as many of them: up to 16 * 65,536 rows their number doesn't grow with the cell."""
    return F.greatest(F.lit(1), F.least(F.ceil(n / block), F.lit(BLOCKS)), F.ceil(n / MOST_ROWS)).cast("int")


def nearest(points: DataFrame, centres: DataFrame, limit: int = 1024, block: int = 4096, few: int = 1024) -> DataFrame:
    """node, centre, d2: the nearest centre of each point (the smallest of several), and the squared distance.

    points: node, unit, and centre if one is known that may be near (else a hash draws up to ``few`` centres to begin with);
    centres: centre, unit, one row for each. A point looks for centres within its distance to the known one: cells of centres
    are divided by pivots, points go to the cells that the triangle inequality leaves open.
    """
    known = centres.select("centre", F.col("unit").alias("to"))
    if "centre" in points.columns:
        met = with_values(points, known.join(points.groupBy("centre").agg(F.count("*").alias("_c")), "centre"), "centre")
        found = met.select("node", "unit", "to")
    else:
        drawn = matrix(pa.array([r["to"] for r in known.orderBy(F.xxhash64("centre"), "centre").limit(few).collect()], pa.binary()))  # ``few`` centres at most
        shared = points.sparkSession.sparkContext.broadcast(drawn)

        def begin(batches):
            for batch in batches:
                home, _ = reach(matrix(batch.column("unit")), shared.value, 0.0) if batch.num_rows else (np.zeros(0, np.int64), None)
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("unit"), pa.array([shared.value[h].tobytes() for h in home], pa.binary())], names=["node", "unit", "to"])

        found = points.select("node", "unit").mapInArrow(begin, "node long, unit binary, to binary")

    def bounded(batches):
        for batch in batches:
            gap = matrix(batch.column("unit")) - matrix(batch.column("to")) if batch.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("unit"), pa.array(np.sqrt((gap**2).sum(axis=1)) * (1 + 1e-9) + 1e-9)], names=["node", "unit", "radius"])

    looking = found.select("node", "unit", "to").mapInArrow(bounded, "node long, unit binary, radius double").select(F.lit("0").alias("cell"), F.lit(False).alias("home"), "node", "unit", "radius")
    at_home = centres.select(F.lit("0").alias("cell"), F.lit(True).alias("home"), F.col("centre").cast("long").alias("node"), "unit", F.lit(0.0).alias("radius"))
    cells = with_counts(pivot_cells(looking.unionByName(at_home), None, limit), "cell", _h=F.sum(F.col("home").cast("int")), _n=F.count("*"))
    hs, ps = blocks(F.col("_h"), MOST_ROWS), blocks(F.col("_n") - F.col("_h"), block)
    dealt_to = lambda parts: F.pmod(F.xxhash64("node", F.lit(7)), parts).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), parts - 1))
    left = cells.filter("home").select("cell", dealt_to(hs).alias("p"), each(ps).alias("q"), "home", "node", "unit")
    right = cells.filter("not home and _h > 0").select("cell", each(hs).alias("p"), dealt_to(ps).alias("q"), "home", "node", "unit")

    def compare(table: pa.Table) -> pa.Table:
        own = np.array(table["home"].to_pylist(), bool)
        ids, x = table["node"].to_numpy(), matrix(table["unit"])
        if own.all() or not own.any():
            return pa.table({"node": pa.array([], pa.int64()), "d2": pa.array([], pa.float64()), "centre": pa.array([], pa.int64())})
        order = np.argsort(ids[own])  # the first of equal distances is the smallest centre
        c, names = x[own][order], ids[own][order]
        x = x[~own]
        best, d2 = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
        for lo in range(0, len(x), limit):
            part = slice(lo, lo + limit)
            for at in range(0, len(c), 8 * limit):
                now, near = closest(x[part], c[at : at + 8 * limit])
                nearer = near < d2[part]
                best[part], d2[part] = np.where(nearer, now + at, best[part]), np.where(nearer, near, d2[part])
        return pa.table({"node": ids[~own], "d2": d2, "centre": names[best]})

    met = left.unionByName(right).groupBy("cell", "p", "q").applyInArrow(compare, "node long, d2 double, centre long")
    return met.groupBy("node").agg(F.min(F.struct("d2", "centre")).alias("b")).select("node", "b.centre", "b.d2")


def closest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the nearest centre of each row, squared distance), by matrix products; differences of 1e-12 count as ties.

    Half the squared length of a centre is one more column of the product, so that its largest value tells the nearest one. Only rows
    with a second value that may be a tie have all their distances rounded and compared.
    """
    own, square = (x**2).sum(axis=1), (centres**2).sum(axis=1)
    near = np.column_stack([x, np.full(len(x), -0.5)]) @ np.column_stack([centres, square]).T
    at = np.arange(len(x))
    best = near.argmax(axis=1)
    found = near[at, best]
    least = found - (1e-11 + 1e-13 * (own + square.max(initial=0.0)))
    tied = np.flatnonzero(np.count_nonzero(near >= least[:, None], axis=1) > 1)
    if len(tied):
        d2 = np.round(np.maximum(0, own[tied, None] - 2 * near[tied]), 12)
        best[tied] = d2.argmin(axis=1)
        found[tied] = near[tied, best[tied]]
    return best, np.round(np.maximum(0, own - 2 * found), 12)
