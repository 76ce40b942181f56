"""Sampled segmentations by forward filtering and backward sampling over the piece lattice.

The lattice of a text has an edge for every vocabulary piece that stands at a place; a piece of rank r weighs
1 / (r + 100) ** alpha. Forward filtering sums the weights of all paths to each place, backward sampling draws the edge
into the last place by its share of that sum, and so on to the start: each segmentation comes with its exact probability.
Blanks are written as the vocabulary's blank sign; no piece reaches past a blank into the next word, so words are
independent parts of the lattice; so are the parts of a long word between places that no piece reaches across. Each
different part is filtered once, and all parts of a batch are sampled together.
Random numbers are a hash of row key, word and step, so a row's segmentation is the same on any cluster and partition.

A character without a piece of its own is its UTF-8 bytes (byte pieces); so is the blank sign when a text holds it
itself. Decoding is lossless for every text. Defined cases: null and empty texts have no pieces; a null key has the key hash 0;
rows with equal key and text are sampled alike; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_BLANK = "▁"

#: Words of more characters are cut where no piece reaches across, so that text without blanks is words again.
APART = 40
_WORDS = re.compile(r" *[^ ]+| +")


class _Rows:
    """Columns that grow at the end and can be cut back."""

    def __init__(self, *kinds: type):
        self.columns, self.n = [np.zeros(1 << 16, k) for k in kinds], 0

    def add(self, *parts: np.ndarray) -> None:
        n = self.n + len(parts[0])
        for k, part in enumerate(parts):
            if n > len(self.columns[k]):
                self.columns[k] = np.concatenate([self.columns[k][: self.n], np.zeros(max(n, 2 * self.n) - self.n, self.columns[k].dtype)])
            self.columns[k][self.n : n] = part
        self.n = n


class Lattice:
    """The words met so far, filtered: edges ordered by the place they reach, the likeliest first, with running shares.

    Up to ``most_edges`` stay for later batches; the edges of further words are cut off after their batch.
    """

    LONG = 40  # characters; longer words are filtered one by one, rescaled on the way

    def __init__(self, path: str, alpha: float = 1.0, most_edges: int = 3_000_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size, self.most = model.get_piece_size(), most_edges
        self.bytes_of: list[bytes] = []
        self.byte_id = np.full(256, -1, np.int64)
        trie: dict = {}
        rank = 0
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:-1], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:-1], 16)]))
                continue
            plain = piece.replace(_BLANK, " ")
            self.bytes_of.append(plain.encode())
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                continue
            if " " in plain.lstrip(" "):
                raise ValueError("a piece reaches past a blank; words are not independent parts of this lattice")
            node = trie
            for c in plain:
                node = node.setdefault(c, {})
            # Weights carry a factor for each character: all paths have the same characters, so shares stay as they are.
            node[""] = (i, 50.0 ** len(plain) / (rank + 100) ** alpha)
            rank += 1
        self.trie = trie
        self._table()
        self.extra: dict[str, int] = {}
        self.node_of: dict[str, int] = {}  # word: last place
        self.edges, self.places = _Rows(np.float64, np.int16, np.int32), _Rows(np.int64)

    def _table(self) -> None:
        """The trie as sorted transitions (state, character) and, by state, the piece that ends there."""
        keys, targets, piece, weight, todo = [], [], [-1], [0.0], [(0, self.trie)]
        while todo:
            state, node = todo.pop()
            for c, child in node.items():
                if c:
                    keys.append(state << 21 | ord(c))
                    targets.append(len(piece))
                    found = child.get("", (-1, 0.0))
                    piece.append(found[0])
                    weight.append(found[1])
                    todo.append((targets[-1], child))
        order = np.argsort(keys)
        self.keys, self.targets = np.append(np.array(keys, np.int64)[order], 1 << 62), np.append(np.array(targets, np.int64)[order], 0)
        self.piece, self.weight = np.array(piece, np.int64), np.array(weight)

    def _fallback(self, c: str) -> int:
        """The byte piece of a one-byte character, or a number beyond the vocabulary that stands for several."""
        raw = c.encode("utf-8", "surrogatepass")
        if len(raw) == 1:
            return int(self.byte_id[raw[0]])
        if c not in self.extra:
            self.extra[c] = self.size + len(self.extra)
            self.bytes_of.append(raw)
        return self.extra[c]

    def _filter(self, words: list[str]) -> np.ndarray:
        """Adds words of at most LONG characters, all at once; returns the last place of each."""
        lens = np.array([len(w) for w in words], np.int64)
        text = "".join(words)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        ends = np.cumsum(lens)
        begin = np.repeat(ends - lens, lens)  # of each character's word
        room = np.repeat(ends, lens) - np.arange(len(points))
        live, state, parts = np.arange(len(points)), np.zeros(len(points), np.int64), []
        single = np.zeros(len(points), bool)
        k = 0
        while len(live):
            key = state << 21 | points[live + k]
            at = np.searchsorted(self.keys, key)
            fine = self.keys[at] == key
            live, state = live[fine], self.targets[at[fine]]
            k += 1
            hit = self.piece[state] >= 0
            parts.append((live[hit], np.full(int(hit.sum()), k), self.piece[state[hit]], self.weight[state[hit]]))
            if k == 1:
                single[live[hit]] = True
            go = room[live] > k
            live, state = live[go], state[go]
        lone = np.flatnonzero(~single)
        parts.append((lone, np.ones(len(lone), np.int64), np.array([self._fallback(text[i]) for i in lone.tolist()], np.int64), np.full(len(lone), 50.0 * 1e-6)))
        start, size, ids, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort((start - begin[start]).astype(np.uint8), kind="stable")
        start, size, ids, weight = start[order], size[order], ids[order], weight[order]
        own = start - begin[start]
        reach = start + size - 1
        total = np.zeros(len(points))
        cuts = np.searchsorted(own, np.arange(int(own.max()) + 2))
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if i:
                weight[a:b] *= total[start[a:b] - 1]
            np.add.at(total, reach[a:b], weight[a:b])
        share = weight / total[reach]
        return self._put(reach, share, size, ids, len(points))[ends - 1]

    def _put(self, reach: np.ndarray, share: np.ndarray, size: np.ndarray, ids: np.ndarray, places: int) -> np.ndarray:
        """Stores edges; returns the numbers of the ``places`` that they reach."""
        order = np.argsort(reach - 0.999 * share)  # by place, the likeliest first
        reach, share = reach[order], share[order]
        first = np.searchsorted(reach, np.arange(places))
        run = np.cumsum(share)
        run -= np.concatenate([[0.0], run])[first][reach]
        run[np.append(first[1:], len(reach)) - 1] = 2.0
        numbers = self.places.n + np.arange(places)
        self.places.add(first + self.edges.n)
        self.edges.add(run, size[order], ids[order])
        return numbers

    def _filter_long(self, word: str) -> int:
        n = len(word)
        into: list[list] = [[] for _ in range(n + 1)]
        out: list[tuple[int, float, int, int]] = []
        for i in range(n + 1):
            a = 1.0
            if i:
                a = sum(e[2] for e in into[i])
                out += [(i - 1, e[2] / a, e[0], e[1]) for e in into[i]]
                into[i] = []
                if not 1e-200 < a < 1e200:  # only shares matter: rescale what later places have seen
                    for later in into[i + 1 : i + 64]:
                        for e in later:
                            e[2] /= a
                    a = 1.0
            node, j, single = self.trie, i, False
            while j < n and (node := node.get(word[j])) is not None:
                j += 1
                if (found := node.get("")) is not None:
                    into[j].append([j - i, found[0], a * found[1]])
                    single = single or j == i + 1
            if i < n and not single:
                into[i + 1].append([1, self._fallback(word[i]), a * 50.0 * 1e-6])
        reach, share, size, ids = (np.array(x) for x in zip(*out, strict=True))
        return int(self._put(reach, share, size, ids, n)[-1])

    def _apart(self, word: str) -> list[str]:
        """Parts of a long word that no piece reaches across: as independent of each other as words are."""
        points = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        n, k = len(points), 0
        reach = np.arange(1, n + 1)
        live, state = np.arange(n), np.zeros(n, np.int64)
        while len(live):
            key = state << 21 | points[live + k]
            at = np.searchsorted(self.keys, key)
            fine = self.keys[at] == key
            live, state = live[fine], self.targets[at[fine]]
            k += 1
            hit = self.piece[state] >= 0
            reach[live[hit]] = live[hit] + k
            go = live + k < n
            live, state = live[go], state[go]
        cuts = [0, *(np.flatnonzero(np.maximum.accumulate(reach)[:-1] <= np.arange(1, n)) + 1).tolist(), n]
        return [word[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _parts(self, text: str) -> list[str]:
        words = _WORDS.findall(text)
        if max(map(len, words), default=0) <= APART:
            return words
        return [part for w in words for part in (self._apart(w) if len(w) > APART else (w,))]

    def place(self, words: list[str]) -> np.ndarray:
        """The last place of each word."""
        known = self.node_of
        fresh = list(set(words).difference(known))
        short = [w for w in fresh if len(w) <= self.LONG]
        if short:
            known.update(zip(short, self._filter(short).tolist(), strict=True))
        for w in fresh:
            if len(w) > self.LONG:
                known[w] = self._filter_long(w)
        self.fresh = fresh
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def sample(self, texts: list[str], keys: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids of each): one drawn segmentation of each text."""
        parts = [self._parts(t) for t in texts]
        counts = np.array([len(p) for p in parts], np.int64)
        words = [w for p in parts for w in p]
        if not words:
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        held = self.edges.n, self.places.n
        at = self.place(words)
        (cum, back, ids), (begin,) = self.edges.columns, self.places.columns
        first = np.concatenate([[0], np.cumsum(counts)])[:-1]
        number = np.arange(len(words)) - np.repeat(first, counts)
        state = common.mix(np.repeat(common.mix(keys.astype(np.uint64) + np.uint64(seed)), counts) + number.astype(np.uint64) * np.uint64(common.BASE))
        live, node, left = np.arange(len(words)), at, np.fromiter(map(len, words), np.int64, len(words))
        size, steps = np.zeros(len(words), np.int64), []
        step = 0
        while len(live):
            u = (common.mix(state[live] + np.uint64(step + 1)) >> np.uint64(12)).astype(np.float64) / (1 << 52)
            edge = begin[node]
            on = np.flatnonzero(cum[edge] <= u)
            while len(on):
                edge[on] += 1
                on = on[cum[edge[on]] <= u[on]]
            steps.append((live, ids[edge]))
            size[live] += 1
            jump = back[edge]
            node, left = node - jump, left - jump
            go = left > 0
            live, node, left = live[go], node[go], left[go]
            step += 1
        ends = np.cumsum(size)
        out = np.zeros(int(ends[-1]), np.int64)
        for k, (who, what) in enumerate(steps):
            out[ends[who] - 1 - k] = what
        per = np.add.reduceat(np.append(size, 0), np.minimum(first, len(size)))
        per[counts == 0] = 0
        if self.edges.n > self.most:
            for w in self.fresh:
                del self.node_of[w]
            self.edges.n, self.places.n = held
        return self._expanded(out, per)

    def _expanded(self, ids: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers beyond the vocabulary become their byte pieces."""
        odd = np.flatnonzero(ids >= self.size)
        if not len(odd):
            return ids, per
        wide = np.ones(len(ids), np.int64)
        raw = [self.byte_id[list(self.bytes_of[i])] for i in ids[odd].tolist()]
        wide[odd] = [len(r) for r in raw]
        ends = np.cumsum(wide)
        out = np.repeat(ids, wide)
        for at, r in zip((ends - wide)[odd].tolist(), raw, strict=True):
            out[at : at + len(r)] = r
        owner = np.repeat(np.arange(len(per)), per)
        return out, np.bincount(owner, wide, minlength=len(per)).astype(np.int64)

    def decode(self, ids: list[int]) -> bytes:
        """The UTF-8 bytes of the text that ``ids`` segment."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


def lattice(path: str, alpha: float) -> Lattice:
    """One for each worker process."""
    return common.held(f"lattice:{path}:{alpha}", lambda: Lattice(path, alpha))


def sampled(docs: DataFrame, model: str, alpha: float = 1.0, seed: int = 0, text: str = "text", key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Per row: key, n_pieces, ids_crc32 (little-endian unsigned 32 bits), lossless, and ``ids`` as such bytes if asked for."""
    kind = docs.schema[key].dataType.simpleString()

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(model, alpha)
        for batch in batches:
            body, offsets = common.buffers(batch.column(1))
            for i, j in common.slices(offsets, 1 << 20):
                keys = batch.column(2).slice(i, j - i).to_numpy()
                texts = [t or "" for t in batch.column(1).slice(i, j - i).to_pylist()]
                ids, per = own.sample(texts, keys, seed)
                raw, ends, flat = ids.astype("<u4").tobytes(), np.cumsum(per), ids.tolist()
                cuts = [(e - n, e) for e, n in zip(ends.tolist(), per.tolist(), strict=True)]
                fine = [own.decode(flat[a:b]) == body[offsets[i + r] : offsets[i + r + 1]].tobytes() for r, (a, b) in enumerate(cuts)]
                columns = [batch.column(0).slice(i, j - i), pa.array(per), pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in cuts], pa.int64()), pa.array(fine)]
                names = [key, "n_pieces", "ids_crc32", "lossless"]
                if with_ids:
                    columns, names = [*columns, pa.array([raw[4 * a : 4 * b] for a, b in cuts], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    plain = docs.select(F.col(key), F.col(text), F.when(F.col(key).isNull(), F.lit(0)).otherwise(F.xxhash64(F.col(key))).cast("long").alias("key_hash"))
    return plain.mapInArrow(draw, f"{key} {kind}, n_pieces long, ids_crc32 long, lossless boolean" + ", ids binary" * with_ids)
