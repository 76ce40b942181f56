"""Token ids of whole texts by a public tokenizer, with a bounded memory of units already encoded.

A tokenizer splits a text before it merges pieces, and merges nothing across such a split. So a text may be cut where the
tokenizer certainly splits it, and its ids are those of its units, one after another: the library's own ids, while each
different unit is encoded once. ``parted`` and ``loosened`` cut texts for the two kinds of vocabulary in use. Units of up
to 15 bytes are looked up all at once in an open-addressing table of their complete bytes.

Defined cases: a null or empty text has no units and no ids; a text of any length is cut by its bytes alone; equal texts
have equal ids; no texts give no ids.
"""

from __future__ import annotations

import os
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from . import common

_U = np.uint64


@dataclass(frozen=True)
class Units:
    """Units of texts as ranges of ``body``; units first[i] to first[i + 1] are text i. ``plain``: one word of letters."""

    body: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    plain: np.ndarray


class _Memory:
    """Ids of units by entry number, and the entries by the bytes of their unit."""

    def __init__(self, most: int):
        self.bits = max(4, int(most).bit_length() + 1)
        self.low, self.high = np.zeros(1 << self.bits, _U), np.zeros(1 << self.bits, _U)
        self.entry = np.full(1 << self.bits, -1, np.int32)
        self.start, self.count, self.n = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), 0
        self.ids, self.n_ids = np.zeros(1 << 18, np.uint32), 0
        self.long: dict[bytes, int] = {}

    def add(self, coded: list[bytes]) -> np.ndarray:
        """Entry numbers of new units, given their ids."""
        flat = np.frombuffer(b"".join(coded), "<u4")
        count = np.array(list(map(len, coded)), np.int64) // 4
        while self.n + len(coded) > len(self.start):
            self.start, self.count = np.concatenate([self.start, self.start]), np.concatenate([self.count, self.count])
        while self.n_ids + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, self.ids])
        new = np.arange(self.n, self.n + len(coded))
        self.start[new], self.count[new] = self.n_ids + np.cumsum(count) - count, count
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        self.n, self.n_ids = self.n + len(coded), self.n_ids + len(flat)
        return new

    def place(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (common.mix(low ^ high * _U(common.BASE)) >> _U(64 - self.bits)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Entry of each unit; -1: not known."""
        at = self.place(low, high)
        found = self.entry.take(at)
        todo = np.flatnonzero((found >= 0) & ((self.low.take(at) != low) | (self.high.take(at) != high)))
        while len(todo):  # another unit's place: the next one
            at[todo] = (at[todo] + 1) & (len(self.entry) - 1)
            here = at[todo]
            found[todo] = self.entry[here]
            todo = todo[(found[todo] >= 0) & ((self.low[here] != low[todo]) | (self.high[here] != high[todo]))]
        return found

    def keep(self, low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> None:
        """Puts different units that aren't known into the table."""
        at = self.place(low, high)
        todo = np.arange(len(at))
        while len(todo):
            free = todo[self.entry[at[todo]] < 0]
            where, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.low[where], self.high[where], self.entry[where] = low[put], high[put], entries[put]
            done = np.zeros(len(at), bool)
            done[put] = True
            todo = todo[~done[todo]]
            at[todo] = (at[todo] + 1) & (len(self.entry) - 1)


def _alphabet() -> dict[int, int]:
    """The character that byte-level vocabularies write for each byte: its own if visible in Latin-1, else one from 256 on."""
    shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b > 173]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}


_ALPHABET = _alphabet()
_LINE = chr(_ALPHABET[10])

#: Keeps the first n bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)


class UnitEncoder:
    """Little-endian unsigned 32-bit ids of texts as byte strings."""

    def __init__(self, path: str, most: int = 1_000_000, longest: int = 40):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        marks = [(n, t.content) for n, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word)]
        self.mark_id, self.mark = marks[-1] if marks else (-1, "")
        self.most, self.longest = most, longest
        self.memory = _Memory(most)
        self.words = Tokenizer(self.tokenizer.model)  # the same merges, for words that are already apart
        self.words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.sizes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)  # bytes of each piece of a byte-level vocabulary
        for piece, n in self.tokenizer.get_vocab().items():
            self.sizes[n] = len(piece.removesuffix("</w>"))

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, units: list[bytes]) -> list[bytes]:
        """Ids of words of letters, which are told apart by the bytes of their pieces."""
        text = b"\n".join(units).decode("latin-1").translate(_ALPHABET).replace(_LINE, "\n")
        ids = np.array(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends, at = np.cumsum(list(map(len, units))), np.cumsum(self.sizes[ids])
        cut = np.searchsorted(at, ends)
        if not len(at) or cut[-1] != len(at) - 1 or not np.array_equal(at[cut], ends):
            return self._marked([u.decode() for u in units])  # not a byte-level vocabulary
        raw, cuts = ids.tobytes(), [0, *(4 * (cut + 1)).tolist()]
        return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _marked(self, units: list[str], step: int = 100) -> list[bytes]:
        """Many short texts in one call, with a special token between them that stands in none of them."""
        if not self.mark or any(self.mark[:2] in u for u in units):
            return self.whole(units)
        out: list[bytes] = []
        self.tokenizer.encode_special_tokens = False
        for i in range(0, len(units), step):
            ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join(units[i : i + step])], add_special_tokens=False)[0].ids, "<u4")
            raw, at = ids.tobytes(), 0
            for cut in (4 * np.flatnonzero(ids == self.mark_id)).tolist():
                out.append(raw[at:cut])
                at = cut + 4
            out.append(raw[at:])
        self.tokenizer.encode_special_tokens = True
        return out

    def _encoded(self, units: list[bytes], plain: np.ndarray) -> np.ndarray:
        """Entry numbers of different units that aren't known."""
        coded: list[bytes] = [b""] * len(units)
        easy, other = np.flatnonzero(plain).tolist(), np.flatnonzero(~plain).tolist()
        for i in range(0, len(easy), 256):
            for k, ids in zip(easy[i : i + 256], self._plain([units[k] for k in easy[i : i + 256]]), strict=True):
                coded[k] = ids
        for k, ids in zip(other, self._marked([units[k].decode() for k in other]), strict=True):
            coded[k] = ids
        return self.memory.add(coded)

    def batch(self, texts: Units) -> list[bytes]:
        """Ids of texts that are given as their units."""
        memory, size = self.memory, texts.ends - texts.starts
        held, raw = (memory.n, memory.n_ids), texts.body.tobytes()
        body = np.frombuffer(raw + bytes(16), np.uint8)
        words = np.ndarray((len(body) - 7,), "<u8", body, strides=(1,))  # the eight bytes from each place on
        entry = np.full(len(size), -1, np.int64)
        short = size <= 15
        who = np.flatnonzero(short)
        start, n = texts.starts[who], size[who]
        low = words.take(start) & _FIRST[np.minimum(n, 8)]
        high = words.take(start + 8) & _FIRST[np.maximum(n - 8, 0)] | n.astype(_U) << _U(56)
        found = memory.find(low, high)
        new = np.flatnonzero(found < 0)
        if len(new):
            order = new[np.lexsort((high[new], low[new]))]
            lead = np.ones(len(order), bool)
            lead[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
            one = order[lead]
            a, b = texts.starts[who[one]].tolist(), texts.ends[who[one]].tolist()
            entries = self._encoded([raw[i:j] for i, j in zip(a, b, strict=True)], texts.plain[who[one]])
            found[order] = entries[np.cumsum(lead) - 1]
            if memory.n <= self.most:  # what came first stays: the frequent units are among it
                memory.keep(low[one], high[one], entries)
                held = memory.n, memory.n_ids
        entry[who] = found
        rest = np.flatnonzero(~short).tolist()
        passing: list[bytes] = []
        if rest:
            units = [raw[i:j] for i, j in zip(texts.starts[rest].tolist(), texts.ends[rest].tolist(), strict=True)]
            fresh = {u: k for k, u in zip(rest, units, strict=True) if u not in memory.long}
            for some in ([u for u in fresh if len(u) <= self.longest], [u for u in fresh if len(u) > self.longest]):
                if some:
                    memory.long.update(zip(some, self._encoded(some, texts.plain[[fresh[u] for u in some]]).tolist(), strict=True))
                    if memory.n <= self.most and len(some[0]) <= self.longest:
                        held = memory.n, memory.n_ids
                    else:
                        passing += some
            entry[rest] = [memory.long[u] for u in units]
        count = memory.count[entry].astype(np.int64)
        ends = np.cumsum(count)
        ids = memory.ids[np.repeat(memory.start[entry] - ends + count, count) + np.arange(int(ends[-1]) if len(ends) else 0)].astype("<u4").tobytes()
        cuts = (4 * np.concatenate([[0], ends])[texts.first]).tolist()
        memory.n, memory.n_ids = held
        for u in passing:
            del memory.long[u]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _table(*codes: int) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(codes)] = True
    return out


_DIGITS, _CAPITALS, _SMALL = range(48, 58), range(65, 91), range(97, 123)
_SOLID = _table(*_DIGITS, *_CAPITALS, *_SMALL)
_LETTER = _table(*_CAPITALS, *_SMALL)
_GAP = _table(9, 10, 13, 32)
_BLANK = _table(*range(9, 14), *range(28, 33))
_MARK = _table(*(b for b in range(33, 127) if not chr(b).isalnum() and b != 39))
#: Second bytes, after 0xC3, of Latin-1 letters, and of those that are small.
_LATIN = _table(*(b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)))
_LATIN_SMALL = _table(0x9F, *(b for b in range(0xA0, 0xC0) if b != 0xB7))


def _marks(body: np.ndarray) -> np.ndarray:
    """ASCII marks after a letter or digit, where its run ends; an apostrophe may belong to the letters after it."""
    solid = np.zeros(len(body), bool)
    solid[1:] = _SOLID[body[:-1]]
    solid[2:] |= (body[:-2] == 0xC3) & _LATIN[body[1:-1]]
    return _MARK[body] & solid


def _lettered(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, letters: np.ndarray, seconds: np.ndarray) -> np.ndarray:
    """Whether the bytes of each range are letters only: of the table ``letters``, or 0xC3 and one of ``seconds``."""
    fine = letters[body]
    pair = (body[:-1] == 0xC3) & seconds[body[1:]]
    fine[:-1] |= pair
    fine[1:] |= pair
    other = np.zeros(len(body) + 1, np.int32)
    np.cumsum(~fine, out=other[1:])
    return (other[ends] == other[starts]) & (ends > starts)


def _plain(column: pa.Array) -> Units:
    body, offsets = common.buffers(column)
    some = np.flatnonzero(offsets[1:] > offsets[:-1])
    return Units(body, offsets[some], offsets[some + 1], np.searchsorted(some, np.arange(len(offsets))), np.zeros(len(some), bool))


def parted(column: pa.Array) -> Units:
    """Units for a byte-level vocabulary that keeps all text: a blank belongs to the word after it.

    A unit begins at a run of white space after another character, at a mark that ends a word, and at a letter after a
    single line end.
    """
    body, offsets = common.buffers(column)
    if not len(body):
        return _plain(column)
    blank = _BLANK[body]
    wide = np.zeros(len(body), bool)
    wide[1:] = (body[:-1] >= 0xC3) & (body[:-1] <= 0xDF)  # leading bytes of characters that are no white space
    dark = np.zeros(len(body), bool)  # the character before certainly isn't white space
    dark[1:] = np.where(body[:-1] < 128, ~blank[:-1], wide[:-1])
    line = np.zeros(len(body), bool)
    line[1:] = ((body == 10) & dark)[:-1]
    cut = blank & dark | _marks(body) | line & _LETTER[body]
    cut[offsets[:-1][offsets[:-1] < len(body)]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(body))
    plain = (body[starts] == 32) & _lettered(body, starts + 1, ends, _LETTER, _LATIN)
    return Units(body, starts, ends, np.searchsorted(starts, offsets), plain)


def loosened(column: pa.Array) -> Units:
    """Units for a vocabulary that lower-cases, drops white space and parts letters from marks: words without blanks."""
    body, offsets = common.buffers(column)
    if not len(body):
        return _plain(column)
    low = common.LOWER[body]
    cut = _marks(low)
    cut[offsets[:-1][offsets[:-1] < len(low)]] = True
    gap = _GAP[low]
    starts = np.flatnonzero(~gap & (cut | np.concatenate([[True], gap[:-1]])))
    stops = np.flatnonzero(np.append(gap | cut, True))
    ends = stops[np.searchsorted(stops, starts, side="right")]
    return Units(low, starts, ends, np.searchsorted(starts, offsets), _lettered(low, starts, ends, _LETTER, _LATIN_SMALL))


#: How texts may be cut for a vocabulary; ``whole`` is right for any.
SPLITS = {"whole": _plain, "bytes": parted, "words": loosened}


def encoder(path: str) -> UnitEncoder:
    """One for each worker process and vocabulary."""
    return common.held(f"encoder:{path}", lambda: UnitEncoder(path))


def vocabulary(name: str) -> str:
    """Where a file of the installed public vocabularies is."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
