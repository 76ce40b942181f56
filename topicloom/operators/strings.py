"""Similar texts by the ratio of their matching characters: an inverted index of q-grams, then verification.

The ratio r of two texts of T characters together is 2M / T, M the characters of their matching blocks. Matching blocks leave
x - M characters of one text (of length x) and y - M of the other; each of them spoils at most q of its text's q-grams or q - 1 of
the other's, so a text of length x has at most x - T * c q-grams that the other one lacks in a place that fits, with
c = (2q - 1) r / 2 - (q - 1). With q-grams ordered from rare to frequent, the first q-gram that both have in fitting places stands
among the first x - T * c + 1 of either. Two texts meet only if

* length: the shorter one could hold all matching characters,
* prefix: they share a q-gram within those first ones of both,
* position: its places differ by no more than the characters left over before them.

Postings of frequent q-grams are dealt to blocks, so no join key has more than 2 * ``BLOCK`` rows; each pair that meets is compared
once, by a bound from its characters first. How frequent a q-gram is, is known by hash: a table of ``BINS`` counts is broadcast,
whatever the texts. Texts too short for a q-gram that must be shared meet by single characters (q = 1) instead.

Where q-grams tell little (long texts of few syllables share most of theirs), the index would hold more meetings than there are
pairs of fitting lengths: both are counted first, and then texts meet in blocks of their lengths instead. Either way a pair is
aligned only if its longest common subsequence, which the matching blocks are a part of, has enough characters: the alignment in
bits (Hyyroe 2004) ends as soon as a beginning of both has left over more than both may lose; for short texts it runs for many pairs
at once, a word of bits each at a time. Characters and 3-grams that two texts share are counted for all pairs of a tile by a product
of matrices, with a column for each count that a character or 3-gram reaches. In a second text of 200 characters or more, difflib begins a block only at a character that is rare in
it, but for a common beginning: so texts that share R rare characters have at most R + 1 blocks, and share M - 2 * (R + 1) 3-grams.

Equal texts are one class: they are compared with nobody among themselves, and what is found for a class holds for its members.
"""

from __future__ import annotations

import difflib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.sources.tables import written

BINS, BLOCK = 1 << 16, 2_048

#: Rows of a block of lengths, blocks of a band before they get larger, rows and characters of a block at most, steps between bounds.
ROWS, PARTS, MOST_ROWS, MOST_CHARS, STEPS = 4_096, 16, 16_384, 1 << 24, 16

#: Length from which difflib leaves frequent characters out, bins of 3-grams, pairs aligned at once, bytes of their places at most.
LONG, TRIPLES, LANES, MOST_BYTES = 200, 1_024, 4_096, 1 << 27

#: Rows and columns of a tile of pairs, levels of counts that are told apart.
ROW_TILE, TILE, LEVELS = 256, 1_024, 2_048

#: Bands of length that a text may be away from another that matches it.
NEAR = 2

_EPS = 1e-9


def sequence_ratio(a: str, b: str) -> float:
    """Twice the matching characters over all characters, by longest matching blocks."""
    return difflib.SequenceMatcher(None, a or "", b or "").ratio()


def sorted_words(text: str | None) -> str:
    """The words of a text in small letters, in alphabetical order."""
    return " ".join(sorted((text or "").lower().split()))


def classes(rows: DataFrame, key: str = "ord", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(node, s: one row for each different text of sorted words; key, node). ``node`` is the smallest key of a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted_words(t) for t in batch.column(1).to_pylist()], pa.string())], names=["key", "s"])

    plain = written(rows.select(F.col(key).cast("long").alias("key"), F.col(text).alias("s")).mapInArrow(run, "key long, s string"), "texts")
    found = written(plain.groupBy("s").agg(F.min("key").alias("node")), "classes")
    return found.select("node", "s"), plain.join(found, "s").select(F.col("key").alias(key), "node")


def _grams(points: np.ndarray, q: int) -> np.ndarray:
    """The q-grams of a text's code points, one number each."""
    n = len(points) - q + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.zeros(n, np.int64)
    for k in range(q):
        out = (out << 21) | points[k : k + n]
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _bin(grams: np.ndarray) -> np.ndarray:
    return ((grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)


def gram_length(r: float) -> int:
    """The longest q-gram of which long enough texts must share one at ratio ``r``: 1 to 3."""
    return max(q for q in (1, 2, 3) if q == 1 or (2 * q - 1) * r / 2 - (q - 1) >= 0.1)


def _often(texts: DataFrame, q: int) -> np.ndarray:
    """How many q-grams of the texts fall into each bin."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, np.int64)
        for batch in batches:
            for s in batch.column(0).to_pylist():
                total += np.bincount(_bin(_grams(_points(s), q)), minlength=BINS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bin", "n"])

    counts = np.zeros(BINS, np.int64)
    for row in texts.select("s").mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():  # BINS rows at most
        counts[row["bin"]] = row["n"]
    return counts


def _postings(texts: DataFrame, r: float, q: int, block: int, counts: np.ndarray | None = None) -> DataFrame:
    """gram, p, q, first, node, x, rank, pos: the first q-grams of each text, each in every block pair that its part meets."""
    counts = _often(texts, q) if counts is None else counts
    shared = texts.sparkSession.sparkContext.broadcast(counts)
    c = (2 * q - 1) * r / 2 - (q - 1)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            out: list[tuple] = []
            for node, s in zip(batch.column("node").to_pylist(), batch.column("s").to_pylist(), strict=True):
                grams = _grams(_points(s), q)
                order = np.lexsort((np.arange(len(grams)), grams, often[_bin(grams)]))
                # Of all texts that may match it, the shortest leaves it most q-grams to lose.
                most = int(min(len(grams), math.floor(len(s) - len(s) * 2 / (2 - r) * c + _EPS) + 1))
                first = order[: max(0, most)]
                parts = np.maximum(1, -(-often[_bin(grams[first])] // block))
                part = (node * 0x9E3779B97F4A7C15 >> 20 & 0xFFFFFFFF) % parts
                out.append((np.full(len(first), node), np.full(len(first), len(s)), grams[first], np.arange(len(first)), first, part, parts))
            node, x, gram, rank, pos, part, parts = (np.concatenate(col) if out else np.zeros(0, np.int64) for col in (zip(*out, strict=True) if out else [()] * 7))
            long = lambda a: pa.array(a.astype(np.int64))
            yield pa.RecordBatch.from_arrays([long(a) for a in (gram, part, parts, node, x, rank, pos)], names=["gram", "part", "parts", "node", "x", "rank", "pos"])

    return texts.mapInArrow(post, "gram long, part long, parts long, node long, x long, rank long, pos long")


def _candidates(texts: DataFrame, r: float, q: int, block: int, counts: np.ndarray | None = None) -> DataFrame:
    """i, j: pairs of different texts that pass all filters, each once."""
    posts = written(_postings(texts, r, q, block, counts), "postings")
    side = lambda s, *at: posts.select("gram", *at, *[F.col(k).alias(f"{k}_{s}") for k in ("node", "x", "rank", "pos")])
    a = side("a", F.col("part").alias("p"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("q"))
    b = side("b", F.explode(F.sequence(F.lit(0).cast("long"), "part")).alias("p"), F.col("part").alias("q"))
    c = (2 * q - 1) * r / 2 - (q - 1)
    total = F.col("x_a") + F.col("x_b")
    need = total * (r / 2) - _EPS  # matching characters
    fits = (F.least("x_a", "x_b") >= need) & (F.col("rank_a") <= F.col("x_a") - total * c + _EPS) & (F.col("rank_b") <= F.col("x_b") - total * c + _EPS)
    fits &= (F.col("pos_a") - F.col("pos_b") <= F.col("x_a") - need) & (F.col("pos_b") - F.col("pos_a") <= F.col("x_b") - need)
    once = (F.col("p") < F.col("q")) | (F.col("node_a") < F.col("node_b"))
    met = a.join(b, ["gram", "p", "q"]).filter(once & (F.col("node_a") != F.col("node_b")) & fits)
    return met.select(F.least("node_a", "node_b").alias("i"), F.greatest("node_a", "node_b").alias("j")).distinct()


def _characters(texts: list[str]) -> np.ndarray:
    """How often each character occurs in each text, by its number modulo 128."""
    return np.stack([np.bincount(_points(s) % 128, minlength=128) for s in texts]).astype(np.int32) if texts else np.zeros((0, 128), np.int32)


def _places(a: str) -> dict[str, int]:
    """A bit set of the places of each character."""
    found: dict[str, list[int]] = {}
    for k, c in enumerate(a):
        found.setdefault(c, []).append(k)
    out = {}
    for c, at in found.items():
        bits = np.zeros(len(a), np.uint8)
        bits[at] = 1
        out[c] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    return out


def _reaches(places: dict[str, int], m: int, b: str, need: int) -> bool:
    """Whether a text of ``m`` characters (by its ``places``) and ``b`` have a common subsequence of ``need`` characters.

    A clear bit of ``v`` is a place at which the common subsequence with the beginning of ``b`` gets longer. If there is one of
    ``need`` characters, the first k of ``b`` go with at most the first k + m - need of the other, but for len(b) - need of them.
    """
    n, at = len(b), places.get
    full = v = (1 << m) - 1
    for k in range(0, n, STEPS):
        for c in b[k : k + STEPS]:
            u = v & at(c, 0)
            v = (v + u) | (v - u)
        v &= full
        k = min(n, k + STEPS)
        width = min(m, k + m - need)
        if width - (v & ((1 << width) - 1)).bit_count() < k - (n - need):
            return False
    return True


def _common(left: list[str], right: list[str], i: np.ndarray, j: np.ndarray, need: np.ndarray | None = None) -> np.ndarray | None:
    """Lengths of the longest common subsequences of left[i] and right[j], ``LANES`` pairs at once; None if too long for that.

    A pair that can't reach its ``need`` is left as soon as that shows, with 0.
    """
    letters = {c: k + 1 for k, c in enumerate(sorted(set().union(*left)))}  # 0 is any other character, and none
    width, steps = max(map(len, left)) // 64 + 1, max(map(len, right))
    if 64 * width * len(left) * (len(letters) + 1) > MOST_BYTES or 4 * steps * len(right) > MOST_BYTES:
        return None
    at = np.zeros((len(left), len(letters) + 1, 64 * width), bool)
    for k, s in enumerate(left):
        at[k, [letters[c] for c in s], np.arange(len(s))] = True
    places = np.ascontiguousarray(np.packbits(at, axis=2, bitorder="little").reshape(-1, 8 * width).view(np.uint64).T)  # a row for each word of bits
    codes = np.zeros((steps, len(right)), np.int32)
    for k, s in enumerate(right):
        codes[: len(s), k] = [letters.get(c, 0) for c in s]
    sizes, lengths, out = np.array([len(s) for s in right]), np.array([len(s) for s in left]), np.zeros(len(i), np.int64)
    ones = ~np.uint64(0)
    order = np.argsort(sizes[j], kind="stable")
    for lo in range(0, len(i), LANES):
        some = order[lo : lo + LANES]
        mine, theirs = i[some] * (len(letters) + 1), j[some]
        v = np.full((width, len(some)), ones)
        for k in range(sizes[theirs].max()):
            if need is not None and k % STEPS == 0 and k:
                # The first k characters go with so many of the left text at most (see ``_reaches``).
                lost = sizes[theirs] - need[some]
                reach = np.minimum(lengths[i[some]], k + lengths[i[some]] - need[some])
                stay = _clear(v, reach) >= np.minimum(k, sizes[theirs]) - lost
                if stay.mean() < 0.75:
                    some, mine, theirs, v = some[stay], mine[stay], theirs[stay], np.ascontiguousarray(v[:, stay])
                    if not len(some):
                        break
            index = mine + codes[k, theirs]
            carry: np.ndarray | None = None
            for w in range(width):
                u = places[w].take(index)
                u &= v[w]
                total = v[w] + u
                over = total < u
                if carry is not None:
                    total += carry
                    over |= total < carry
                carry = over.astype(np.uint64)
                u ^= v[w]
                np.bitwise_or(total, u, out=v[w])
        out[some] = 64 * width - np.bitwise_count(v).sum(axis=0, dtype=np.int64)
    return out


def _clear(v: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many of the ``first`` bits of each lane are clear."""
    found = np.zeros(v.shape[1], np.int64)
    for w, word in enumerate(v):
        bits = np.clip(first - 64 * w, 0, 64).astype(np.uint64)
        mask = np.where(bits == 64, ~np.uint64(0), (np.uint64(1) << (bits & np.uint64(63))) - np.uint64(1))
        found += np.bitwise_count(~word & mask)
    return found


def _minima(a: np.ndarray, b: np.ndarray, most: int, cap: bool = False) -> tuple[np.ndarray, bool]:
    """(the sum of the minima of each row of ``a`` and each row of ``b``, or a little more; whether it is exact).

    A column for each level that counts of both reach, so that minima are a product of matrices. Where there were over ``most``, only
    each so many-th level is looked at, or (``cap``) the first ones, and what is above them is taken as shared.
    """
    top = np.minimum(a.max(axis=0, initial=0), b.max(axis=0, initial=0)).astype(np.int64)
    all_, step, n = int(top.sum()), 1, top
    if all_ > most and cap:
        n = np.minimum(top, next((k for k in range(64, 0, -1) if np.minimum(top, k).sum() <= most), 1))
    elif all_ > most:
        step = -(-all_ // most)
        n = -(-top // step)
    column, level = np.repeat(np.arange(len(top)), n), 1 + step * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    up = lambda x: (x[:, column] >= level).astype(np.float32)
    found = step * (up(a) @ up(b).T)
    if all_ > most and cap:
        above = lambda x: (np.minimum(x, top) - np.minimum(x, n)).sum(axis=1)
        found += np.minimum(above(a)[:, None], above(b))
    return found, all_ <= most


def _marks(texts: list[str], long: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """(``_characters``; the same of the characters at which difflib begins blocks in a second text; 3-grams by bin). The last two if ``long``."""
    found = []
    for lo in range(0, max(1, len(texts)), ROW_TILE):
        part = texts[lo : lo + ROW_TILE]
        points, size = _points("".join(part)), np.array([len(s) for s in part], np.int64)
        row = np.repeat(np.arange(len(part)), size)
        count = lambda row, of, bins, n=None: np.bincount(row * bins + of, n, minlength=len(part) * bins).reshape(-1, bins).astype(np.int32)  # noqa: E731, B023
        marks = [count(row, points % 128, 128)]
        if long:
            key, n = np.unique(row << 21 | points, return_counts=True)
            some = (n <= size[key >> 21] // 100 + 1) | (size[key >> 21] < LONG)
            marks.append(count(key[some] >> 21, (key[some] & ((1 << 21) - 1)) % 128, 128, n[some]))
            whole = np.flatnonzero(row[2:] == row[:-2])  # 3-grams within a text
            marks.append(count(row[whole], _bin(_grams(points, 3)[whole]) % TRIPLES, TRIPLES))
        found.append(marks)
    marks = [np.concatenate(m) for m in zip(*found, strict=True)]
    return tuple(marks) if long else (marks[0], None, None)


def _needed(total: np.ndarray, r: float) -> np.ndarray:
    """Matching characters that texts of so many characters together must have."""
    return np.ceil(total * (r / 2) - _EPS).astype(np.int64)


def _ratio(i: int, a: str, j: int, b: str, r: float) -> tuple[int, int, float] | None:
    """(i, j, ratio in percent) if it reaches ``r``; the smaller node's text is the first."""
    (i, a), (j, b) = ((i, a), (j, b)) if i < j else ((j, b), (i, a))
    matcher = difflib.SequenceMatcher(None, a, b)
    found = matcher.quick_ratio() >= r - _EPS and 100 * matcher.ratio()
    return (i, j, found) if found and found >= 100 * r else None


def _table(found: list[tuple[int, int, float]]) -> pa.Table:
    i, j, ratio = zip(*found, strict=True) if found else ([], [], [])
    return pa.table({"i": pa.array(i, pa.int64()), "j": pa.array(j, pa.int64()), "ratio": pa.array(ratio, pa.float64())})


def _verified(pairs: DataFrame, texts: DataFrame, r: float) -> DataFrame:
    """i, j, ratio (in percent) of the pairs that reach it."""
    met = pairs.join(texts.select(F.col("node").alias("i"), F.col("s").alias("a")), "i").join(texts.select(F.col("node").alias("j"), F.col("s").alias("b")), "j").select("i", "j", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, j, left, right = (batch.column(k).to_pylist() for k in range(4))
            # Characters that both have bound the ratio from above: few pairs are aligned.
            both, total = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
            for lo in range(0, len(i), 4096):
                a, b = _characters(left[lo : lo + 4096]), _characters(right[lo : lo + 4096])
                both[lo : lo + 4096], total[lo : lo + 4096] = np.minimum(a, b).sum(axis=1), a.sum(axis=1) + b.sum(axis=1)
            need = _needed(total, r)
            likely = [k for k in np.flatnonzero(both >= need).tolist() if _reaches(_places(left[k]), len(left[k]), right[k], int(need[k]))]
            yield from _table([x for k in likely if (x := _ratio(i[k], left[k], j[k], right[k], r))]).to_batches()

    return met.mapInArrow(run, "i long, j long, ratio double")


def _bands(texts: DataFrame, r: float) -> DataFrame:
    """``texts`` that aren't empty with x and band: texts of fitting lengths are at most ``NEAR`` bands apart."""
    width = math.log(max((2 - r) / r, 1.05) * (1 + 1e-6)) / NEAR
    x = F.length("s")
    return texts.filter(x > 0).select("node", "s", x.alias("x"), F.floor(F.log(x) / width).cast("int").alias("band"))


def _by_length(banded: DataFrame, sizes: DataFrame, r: float) -> DataFrame:
    """i, j, ratio of the texts that reach it: all of fitting lengths meet in blocks. sizes: band, parts."""
    placed = banded.join(F.broadcast(sizes), "band").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    apart = F.explode(F.sequence(F.lit(0), F.lit(NEAR))).alias("d")
    other = F.broadcast(sizes.select(F.col("band").alias("with"), F.col("parts").alias("blocks")))
    each = lambda lo, hi: F.explode(F.sequence(lo, hi))
    own = F.col("d") == 0  # blocks of one band meet once
    left = placed.select("*", apart).join(other, F.col("with") == F.col("band") + F.col("d"))
    left = left.select(F.col("band").alias("k"), "d", F.col("part").alias("p"), each(F.when(own, F.col("part")).otherwise(0), F.col("blocks") - 1).alias("q"), F.lit(True).alias("first"), "node", "s")
    right = placed.select("*", apart).join(other, F.col("with") == F.col("band") - F.col("d"))
    right = right.select(F.col("with").alias("k"), "d", each(F.lit(0), F.when(own, F.col("part")).otherwise(F.col("blocks") - 1)).alias("p"), F.col("part").alias("q"), F.lit(False).alias("first"), "node", "s")

    def compare(table: pa.Table) -> pa.Table:
        first = np.array(table["first"].to_pylist(), bool)
        nodes, strings = table["node"].to_numpy(), table["s"].to_pylist()
        size = np.array([len(s) for s in strings])
        mine, theirs = np.flatnonzero(first), np.flatnonzero(~first)
        theirs = theirs[np.argsort(size[theirs], kind="stable")]
        same = table["d"][0].as_py() == 0 and table["p"][0].as_py() == table["q"][0].as_py()
        x, names = size[theirs], nodes[theirs]
        texts, others = [strings[k] for k in mine], [strings[k] for k in theirs]
        counts, rare, triples = zip(*(_marks(of, size.max(initial=0) >= LONG) for of in (texts, others)), strict=True)
        i, j, need = [], [], []
        length, own = size[mine], nodes[mine]
        for k in range(0, len(texts), ROW_TILE):
            a = slice(k, k + ROW_TILE)
            begin, end = np.searchsorted(x, [length[a].min() * r / (2 - r) - 1e-6, length[a].max() * (2 - r) / r + 1e-6])
            for at in range(begin, end, TILE):
                b = slice(at, min(end, at + TILE))
                least = _needed(length[a][:, None] + x[b], r)
                fits = np.minimum(length[a][:, None], x[b]) >= least
                if same:
                    fits &= names[b] > own[a][:, None]
                fits &= _minima(counts[0][a], counts[1][b], LEVELS)[0] >= least
                if not fits.any():
                    continue
                second = names[b] < own[a][:, None]  # the text of ``a`` is the second one of those pairs
                asked = fits & (np.where(second, length[a][:, None], x[b]) >= LONG)
                if asked.any():
                    blocks = np.where(second, _minima(rare[0][a], counts[1][b], LEVELS)[0], _minima(counts[0][a], rare[1][b], LEVELS)[0])
                    shared, exact = _minima(triples[0][a], triples[1][b], 2 * LEVELS, cap=True)
                    asked &= least > 2 * (blocks + 1)
                    fits &= ~(asked & (shared < least - 2 * (blocks + 1)))
                    some, others_ = np.nonzero(asked & fits) if not exact else ((), ())
                    for lo in range(0, len(some), TILE):
                        u, w = some[lo : lo + TILE], others_[lo : lo + TILE]
                        fits[u, w] = np.minimum(triples[0][a][u], triples[1][b][w]).sum(axis=1) >= least[u, w] - 2 * (blocks[u, w] + 1)
                some, others_ = np.nonzero(fits)
                i.append(some + k)
                j.append(others_ + at)
                need.append(least[some, others_])
        i, j, need = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (i, j, need))
        short = (size[mine][i] < 2 * LONG) & (x[j] < 2 * LONG) if len(i) else np.zeros(0, bool)
        likely = ~short
        if short.any():
            for k in range(0, len(texts), TILE):  # ``i`` goes by tiles of rows
                some = np.flatnonzero(short & (i >= k) & (i < k + TILE))
                if not len(some):
                    continue
                (a, at), (b, bt) = np.unique(i[some], return_inverse=True), np.unique(j[some], return_inverse=True)
                common = _common([texts[x] for x in a], [others[x] for x in b], at, bt, need[some])
                likely[some] = True if common is None else common >= need[some]
                short[some] = common is not None
        found, places = [], (-1, {})
        for k in np.flatnonzero(likely).tolist():
            text, other = texts[i[k]], others[j[k]]
            if not short[k]:
                places = places if places[0] == i[k] else (i[k], _places(text))
                if not _reaches(places[1], len(text), other, int(need[k])):
                    continue
            if pair := _ratio(int(nodes[mine[i[k]]]), text, int(names[j[k]]), other, r):
                found.append(pair)
        return _table(found)

    keys = ["k", "d", "p", "q"]
    tasks = int(banded.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # blocks are small in bytes and costly: not to be put together
    return left.unionByName(right).repartition(tasks, *keys).groupBy(*keys).applyInArrow(compare, "i long, j long, ratio double")


def alike(texts: DataFrame, least: float = 80.0, block: int = BLOCK, grams: bool | None = None) -> DataFrame:
    """(i, j, ratio) with i < j for different texts (node, s) whose ratio is at least so many percent (above 0).

    ``grams``: whether they meet by q-grams or by their lengths, with the same result; by default what holds fewer meetings.
    """
    r, texts = least / 100, written(texts.select("node", "s"), "alike")
    q = gram_length(r)
    banded = _bands(texts, r)
    size = {row["band"]: (row["n"], row["chars"]) for row in banded.groupBy("band").agg(F.count("*").alias("n"), F.sum("x").alias("chars")).collect()}  # logarithms of lengths
    counts = None if grams is False else _often(texts, q)
    if grams is None:
        c = (2 * q - 1) * r / 2 - (q - 1)
        grams = ((counts.astype(float) * (1 - 2 * c / (2 - r))) ** 2).sum() / 2 <= sum(n * size.get(k + d, (0, 0))[0] for k, (n, _) in size.items() for d in range(NEAR + 1))
    if not grams:
        parts = [(k, max(1, min(-(-n // (block if block < BLOCK else ROWS)), PARTS), -(-n // MOST_ROWS), -(-chars // MOST_CHARS))) for k, (n, chars) in size.items()]
        return _by_length(banded, texts.sparkSession.createDataFrame(parts, "band int, parts int"), r)
    pairs = _candidates(texts, r, q, block, counts)
    if q > 1:
        # Texts that must share a q-gram have T * c > q - 1 characters together; pairs below that meet by single characters.
        c = (2 * q - 1) * r / 2 - (q - 1)
        short = math.floor((q - 1) / c / (1 + r / (2 - r)) + _EPS) + q  # a pair's longer text is at most T / (1 + r / (2 - r)) long
        pairs = pairs.unionByName(_candidates(texts.filter(F.length("s") <= short), r, 1, block)).distinct()
    return _verified(pairs, texts, r)


def alike_rows(rows: DataFrame, least: float = 80.0, key: str = "ord", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(i, j, ratio) with i < j for all rows so alike, also those of equal texts: as many rows as there are pairs (see ``topics``)."""
    found, members = classes(rows, key, text)
    own, other = (members.select(F.col(key).alias(f"k{s}"), F.col("node").alias(s)) for s in "ij")
    apart = alike(found, least, block).join(own, "i").join(other, "j").select("ki", "kj", "ratio")
    equal = own.join(other, F.col("i") == F.col("j")).filter("ki < kj").select("ki", "kj", F.lit(100.0).alias("ratio"))
    return apart.unionByName(equal).select(F.least("ki", "kj").alias("i"), F.greatest("ki", "kj").alias("j"), "ratio")


def topics(rows: DataFrame, least: float = 80.0, key: str = "ord", text: str = "text") -> DataFrame:
    """node, topic: in order, an unclaimed row founds a topic and claims its unclaimed later neighbours (see ``greedy_merge``).

    Members of a class have the same neighbours and are each other's: whoever claims the first one claims all.
    """
    from .vectors import greedy_merge

    found, members = classes(rows, key, text)
    owner = greedy_merge(found.select(F.col("node").alias("ord")), alike(found, least))
    return members.join(owner, "node").select(F.col(key).alias("node"), "topic")
