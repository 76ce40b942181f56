"""A range coder for token ids, driven by adaptive order-0 to order-2 predictions.

Ids are cut into blocks, and a block into lanes: runs of its ids with a coder state each. Step t codes the t-th id of every
lane, so each operation is one NumPy call over all lanes of all blocks coded side by side. Lanes of a block share its
tables, which start empty and can be decoded without any other block.

Model, per block: order 2 and order 1 predict the id that followed the two ids, or the id, before; each prediction counts
how often it was right since. Order 0 is the frequency of each id in the block so far, put into force at steps that grow
by a factor. The three are mixed by weights learned in the block, one set for each state of the two predictions and
whether they agree: an id is coded as predicted by order 2, by order 1, by its order-0 frequency, or as new to the block.
A range coder with a 64-bit range, put out in 32-bit words with carry, codes which of the four it is and the place among
the frequencies.

A coded block is 32-bit words: how many ids are new; the lanes' sizes in words, two to a word; the new ids in order of
step and lane, two to a word where ids have 16 bits; the lanes' words.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_FULL, _LEAST, _WORD = _U((1 << 64) - 1), _U(1 << 32), _U(32)
_PART = 16  # bits of the mixed weights
_ORDER2 = 16  # bits of an order-2 table's places
_SURE = 3  # most hits that a prediction remembers
_STATES = 2 * (_SURE + 1) ** 2

#: Ids have at most so many bits; a block at most so many ids, as order 0 divides a range of 2**28 or more.
MOST_BITS, MOST_BLOCK = 17, 1 << 20

#: Lanes of a block at most, and ids of a lane at least (except where there is one lane).
LANES, LANE_IDS = 512, 512

#: Blocks coded side by side.
SIDE = 8


def _paired(values: np.ndarray) -> np.ndarray:
    """16-bit values, two to a 32-bit word."""
    return np.append(values, np.zeros(len(values) % 2, values.dtype)).astype("<u2").view("<u4")


def lanes(n: int) -> int:
    """Lanes of a block of ``n`` ids."""
    return max(1, min(LANES, n // LANE_IDS))


class _Model:
    def __init__(self, blocks: int, width: int, id_bits: int, steps: int):
        if not 1 <= id_bits <= MOST_BITS:
            raise ValueError(f"ids of 1 to {MOST_BITS} bits can be coded, not {id_bits}")
        self.blocks, self.ids, self.steps = blocks, 1 << id_bits, steps
        block = np.repeat(np.arange(blocks, dtype=np.int64), width)
        self.at1, self.at2, self.at0, self.at_state = block << id_bits, block << _ORDER2, block * (self.ids + 1), (block * _STATES).astype(np.int32)
        self.block = block
        self.one, self.two = np.zeros(blocks << id_bits, np.int32), np.zeros(blocks << _ORDER2, np.int32)
        self.prev, self.far = np.zeros(len(block), np.int64), np.zeros(len(block), np.uint32)
        self.seen = np.zeros((blocks, self.ids), np.int32)
        self.below = np.zeros(blocks * (self.ids + 1), np.int32)
        self.total, self.base = np.ones(blocks, _U), np.zeros(blocks, np.int64)
        self.sorted = np.zeros(1, np.int32)
        self.hits = np.full((blocks * _STATES, 4), 1, np.int64)
        self.next_count, self.counted, self.next_mix = 1, 0, 0

    def due(self, t: int, coded: np.ndarray) -> None:
        """Puts order-0 frequencies of the steps ``coded`` before step t into force, and the mixing weights, when it is time."""
        if t == self.next_count:
            new = coded[self.counted : t].astype(np.int64) + self.at1
            self.seen += np.bincount(new.reshape(-1), minlength=self.seen.size).reshape(self.seen.shape).astype(np.int32)
            self.below.reshape(self.blocks, -1)[:, 1:] = np.cumsum(self.seen, axis=1, dtype=np.int32)
            some = np.flatnonzero(self.seen)
            self.sorted = np.repeat((some % self.ids).astype(np.int32), self.seen.reshape(-1)[some])
            n = self.below[self.ids :: self.ids + 1].astype(np.int64)
            self.total, self.base = n.astype(_U), np.cumsum(n) - n
            self.lane_total, self.lane_base = self.total[self.block], self.base[self.block]
            self.counted, self.next_count = t, t + max(1, t // 2)
        if t == self.next_mix:
            self.mix()
            self.next_mix = t + max(1, min(16, t // 4))

    def mix(self) -> None:
        """Weights of the four ways in each state: none below 2**8 of 2**16, order 0 not below 2**12."""
        free = (1 << _PART) - 3 * 256 - 4096
        share = self.hits * free // self.hits.sum(axis=1, keepdims=True)
        share += np.array([256, 256, 4096, 256])
        share[:, 2] += (1 << _PART) - share.sum(axis=1)
        self.own = np.ascontiguousarray(share.reshape(-1).astype(_U))
        start = np.cumsum(share, axis=1) - share
        self.start = np.ascontiguousarray(start.reshape(-1).astype(_U))
        self.cuts = [np.ascontiguousarray(start[:, k].astype(np.int32)) for k in (1, 2, 3)]

    def look(self) -> None:
        """Predictions for the next id of each lane, and the state they are in."""
        prev = self.prev
        low = prev.astype(np.uint32)
        near = (low * np.uint32(0x85EBCA6B) ^ self.far) >> np.uint32(32 - _ORDER2)
        self.far = low * np.uint32(0xC2B2AE35)
        self.i2 = self.at2 + near
        self.i1 = self.at1 + prev
        self.v2, self.v1 = self.two.take(self.i2), self.one.take(self.i1)
        self.p2, self.p1 = self.v2 >> 2, self.v1 >> 2
        self.c2, self.c1 = self.v2 & 3, self.v1 & 3
        s = self.c2 << 2
        s += self.c1
        s <<= 1
        s += self.p2 == self.p1
        s += self.at_state
        self.state = s

    def learn(self, now: np.ndarray, way: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        """``now``: the ids in 32 bits; ``way``: state and way of each; which of them the predictions hit."""
        fresh = now << 2
        for table, at, v, c, hit in ((self.two, self.i2, self.v2, self.c2, hit2), (self.one, self.i1, self.v1, self.c1, hit1)):
            table[at] = np.where(hit, v + (c < _SURE), np.where(c > 0, v - 1, fresh))
        self.hits += np.bincount(way, minlength=self.hits.size).reshape(self.hits.shape) * 4
        self.prev = now.astype(np.int64)


def _encode(ids: np.ndarray, blocks: int, id_bits: int) -> list[np.ndarray]:
    """The words of each of ``blocks`` blocks of equal length, coded side by side."""
    n = len(ids) // blocks
    width = lanes(n)
    steps = -(-n // width)
    x = np.zeros((blocks, width * steps), np.int32)
    x[:, :n] = ids.reshape(blocks, n)
    x = np.ascontiguousarray(x.reshape(blocks * width, steps).T)
    m = _Model(blocks, width, id_bits, steps)
    count = blocks * width
    room = steps + 4
    out = np.zeros(count * room, np.uint32)
    begin = np.arange(count, dtype=np.int64) * room
    pos, low, rng = begin.copy(), np.zeros(count, _U), np.full(count, _FULL, _U)
    fresh_at, fresh = [], []

    def carry(at: np.ndarray) -> None:
        while len(at):
            out[at] += np.uint32(1)
            at = at[out[at] == 0] - 1

    for t in range(steps):
        m.due(t, x)
        m.look()
        now = x[t]
        hit2, hit1 = m.p2 == now, m.p1 == now
        at = m.at0 + now
        below = m.below.take(at)
        at += 1
        own = m.below.take(at) - below
        event = np.where(hit2, 0, np.where(hit1, 1, np.where(own > 0, 2, 3)))
        way = (m.state << 2) + event
        rng >>= _U(_PART)
        step = rng * m.start.take(way)
        rng *= m.own.take(way)
        by = np.flatnonzero(event == 2)
        if len(by):
            r = rng[by] // m.lane_total[by]
            step[by] += r * below[by].astype(_U)
            rng[by] = r * own[by].astype(_U)
        low += step
        over = np.flatnonzero(low < step)
        if len(over):
            carry(pos[over] - 1)
        new = np.flatnonzero(event == 3)
        if len(new):
            fresh_at.append(new)
            fresh.append(now[new])
        m.learn(now, way, hit2, hit1)
        go = np.flatnonzero(rng < _LEAST)
        if len(go):
            lo = low[go]
            out[pos[go]] = lo >> _WORD
            pos[go] += 1
            low[go] = lo << _WORD
            rng[go] <<= _WORD
    for _ in range(2):
        out[pos] = low >> _WORD
        low <<= _WORD
        pos += 1
    sizes = pos - begin
    news = np.concatenate(fresh) if fresh else np.zeros(0, np.int32)
    owner = np.concatenate(fresh_at) // width if fresh else np.zeros(0, np.int64)
    order = np.argsort(owner, kind="stable")
    new_ends = np.cumsum(np.bincount(owner, minlength=blocks))
    out, sizes, found = out.reshape(blocks, width, room), sizes.reshape(blocks, width), []
    for b in range(blocks):
        own = news[order[new_ends[b - 1] if b else 0 : new_ends[b]]]
        words = out[b][np.arange(room)[None, :] < sizes[b][:, None]]
        found.append(np.concatenate([np.array([len(own)], np.uint32), _paired(sizes[b]), _paired(own) if id_bits <= 16 else own.astype(np.uint32), words]))
    return found


def _parts(block: np.ndarray, width: int, id_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of all lanes, words of each lane, new ids) of a coded block."""
    n = int(block[0]) if len(block) else 0
    at = 1 + (width + 1) // 2
    to = at + ((n + 1) // 2 if id_bits <= 16 else n)
    sizes = block[1:at].astype("<u4").view("<u2")[:width].astype(np.int64)
    if len(sizes) < width or to + int(sizes.sum()) != len(block):
        raise ValueError("a block's parts don't match its length, so its checksum can't")
    news = block[at:to].astype("<u4").view("<u2")[:n] if id_bits <= 16 else block[at:to]
    return block[to:], sizes, news.astype(np.int32)


def _decode(coded: list[np.ndarray], n: int, id_bits: int) -> np.ndarray:
    """The ids of blocks of ``n`` ids each, decoded side by side."""
    blocks, width = len(coded), lanes(n)
    steps = -(-n // width)
    count = blocks * width
    parts = [_parts(b, width, id_bits) for b in coded]
    words, sizes, news = (np.concatenate([p[k] for p in parts]) for k in range(3))
    new_sizes = np.array([len(p[2]) for p in parts])
    pos = np.cumsum(sizes) - sizes
    held = np.concatenate([words, np.zeros(4, np.uint32)]).astype(_U)
    m = _Model(blocks, width, id_bits, steps)
    code, rng = held[pos] << _WORD | held[pos + 1], np.full(count, _FULL, _U)
    pos = pos + 2
    out = np.empty((steps, count), np.int32)
    new_at, news = np.cumsum(new_sizes) - new_sizes, np.append(news, 0).astype(np.int32)
    most = _U((1 << _PART) - 1)
    for t in range(steps):
        m.due(t, out)
        m.look()
        rng >>= _U(_PART)
        v = np.minimum(code // rng, most).astype(np.int32)
        state = m.state
        event = (v >= m.cuts[0].take(state)).view(np.int8) + (v >= m.cuts[1].take(state)).view(np.int8) + (v >= m.cuts[2].take(state)).view(np.int8)
        way = (state << 2) + event
        code -= rng * m.start.take(way)
        rng *= m.own.take(way)
        now = np.where(event == 0, m.p2, m.p1)
        by = np.flatnonzero(event == 2)
        if len(by):
            total = m.lane_total[by] if m.counted else _U(1)
            rb, cb = rng[by], code[by]
            r = rb // total
            place = np.minimum(cb // r, total - _U(1)).astype(np.int64)
            got = m.sorted.take(m.lane_base[by] + place) if m.counted else np.zeros(len(by), np.int32)
            now[by] = got
            at = m.at0[by] + got
            below = m.below.take(at)
            at += 1
            code[by] = cb - r * below.astype(_U)
            rng[by] = r * (m.below.take(at) - below).astype(_U)
        new = np.flatnonzero(event == 3)
        if len(new):
            owner = m.block[new]
            now[new] = news[np.minimum(new_at[owner] + np.arange(len(new)) - np.searchsorted(owner, owner), len(news) - 1)]
            new_at += np.bincount(owner, minlength=blocks)
        out[t] = now
        m.learn(now, way, m.p2 == now, m.p1 == now)
        go = np.flatnonzero(rng < _LEAST)
        if len(go):
            code[go] = code[go] << _WORD | held[np.minimum(pos[go], len(words))]  # damaged blocks may ask for more
            pos[go] += 1
            rng[go] <<= _WORD
    return out.T.reshape(blocks, -1)[:, :n].reshape(-1)


def encode(ids: np.ndarray, block: int, id_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit words of all blocks, one block after another; words of each block). Needs at least one id."""
    if block > MOST_BLOCK:
        raise ValueError(f"a block has at most {MOST_BLOCK} ids")
    full = len(ids) // block
    found = [x for b in range(0, full, SIDE) for x in _encode(ids[b * block : min(full, b + SIDE) * block], min(SIDE, full - b), id_bits)]
    if len(ids) % block:
        found += _encode(ids[full * block :], 1, id_bits)
    return np.concatenate(found), np.array([len(x) for x in found], np.int64)


def decode(words: np.ndarray, sizes: np.ndarray, n: int, block: int, id_bits: int) -> np.ndarray:
    """The ``n`` ids of ``encode``; also of some of its blocks, given their words and sizes."""
    ends = np.cumsum(sizes)
    coded = [words[e - s : e] for e, s in zip(ends.tolist(), np.asarray(sizes).tolist(), strict=True)]
    full = n // block
    found = [_decode(coded[b : min(full, b + SIDE)], block, id_bits) for b in range(0, full, SIDE)]
    if n % block:
        found.append(_decode(coded[full : full + 1], n % block, id_bits))
    return np.concatenate(found)
